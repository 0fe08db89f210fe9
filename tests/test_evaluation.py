"""Metrics, choices and verdicts. The counts, grid and model figures are published ones."""

import pytest
from pyspark.sql import functions as F

from reviewloom.functions.scoring import logits_to_prediction
from reviewloom.operators import comparison as cmp
from reviewloom.operators.evaluation import best_setting, classification_metrics, with_metrics


@pytest.mark.parametrize(
    "counts,expected",
    [
        ((11243, 1257, 1301, 11199), (0.8977, 0.8991, 0.8959, 0.8975)),
        ((11241, 1259, 1321, 11179), (0.8968, 0.8988, 0.8943, 0.8965)),
        ((3, 0, 2, 0), (0.6, 0.0, 0.0, 0.0)),
    ],
)
def test_metrics_from_counts(spark, counts, expected):
    row = with_metrics(spark.createDataFrame([counts], "tn long, fp long, fn long, tp long")).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == expected


def test_confusion_matrix_layout(spark):
    rows = [("m", y, p) for y, p, n in [(0, 0, 4), (0, 1, 3), (1, 0, 2), (1, 1, 1)] for _ in range(n)]
    df = spark.createDataFrame(rows, "model string, label int, pred int")
    assert classification_metrics(df, ["model"]).first()["confusion_matrix"] == [[4, 3], [2, 1]]


def test_published_grid_selects_c_1(spark):
    f1 = [0.871, 0.8998, 0.9146, 0.9038, 0.9016, 0.9005, 0.9001]
    grid = [(i, c, s) for i, (c, s) in enumerate(zip([0.01, 0.1, 1.0, 10.0, 30.0, 100.0, 300.0], f1))]
    df = spark.createDataFrame(grid, "grid_pos int, C double, f1 double")
    assert best_setting(df).first()["C"] == 1.0
    tied = df.withColumn("f1", F.lit(0.5))
    assert best_setting(tied).first()["C"] == 0.01


SLOT = "model string, accuracy double, f1 double, size_mb double, latency_ms double"


def test_verdict(spark):
    measured = spark.createDataFrame(
        [("logreg", 0.8977, 0.8975, 2.239, 0.48), ("svm", 0.8968, 0.8965, 2.239, 0.512)], SLOT
    )
    models = cmp.expected_models(measured, ["logreg", "svm", "transformer"])
    rows = {r["model"]: r for r in cmp.verdict(models, "logreg").collect()}
    assert rows["svm"]["f1_delta"] == -0.001 and rows["svm"]["beats_baseline"] is False
    assert "svm against logreg: F1 not higher" in rows["svm"]["summary"]
    assert "-0.0010" in rows["svm"]["summary"] and rows["svm"]["latency_ratio"] == 1.1
    assert rows["transformer"]["status"] == cmp.NOT_MEASURED
    assert rows["transformer"]["summary"] == "transformer: no figures so far."
    lines = [r["line"] for r in cmp.comparison_rows(models).orderBy("pos").collect()]
    assert lines[0] == "| logreg | 0.8977 | 0.8975 | 2.239 | 0.480 |"
    assert lines[2].startswith("| transformer | NOT YET MEASURED")
    assert {r["model"] for r in cmp.chart_rows(models).collect()} == {"logreg", "svm"}


def test_variants(spark):
    base = 0.9312
    measured = spark.createDataFrame(
        [
            ("fp32", 0.9312, base, 256.1, 307.1),
            ("dynamic_int8", None, base - 0.0091, 256.1 * (1 - 0.483), 259.7),
            ("onnx_int8", None, base - 0.0060, 64.3, 222.7),
            ("onnx_fp32", None, base - 0.0047, 256.1 * (1 - 0.002), 236.5),
        ],
        SLOT,
    )
    models = cmp.expected_models(measured, ["fp32", "dynamic_int8", "onnx_int8", "onnx_fp32"])
    variants = cmp.variant_summary(models, "fp32", unscored=["onnx_fp32"])
    rows = {r["model"]: r for r in variants.collect()}
    assert rows["dynamic_int8"]["speedup"] == 1.18 and rows["onnx_int8"]["speedup"] == 1.38
    assert rows["onnx_int8"]["size_reduction_pct"] == 74.9
    assert rows["onnx_int8"]["worthwhile"] is True and rows["onnx_fp32"]["worthwhile"] is None
    best = cmp.best_variant(variants).first()
    assert best["recommended_variant"] == "onnx_int8"
    assert best["decision"] == "Take onnx_int8: F1 changes by -0.0060, 74.9% smaller, mean time 222.7 ms instead of 307.1 ms."
    none = cmp.best_variant(variants.where("model = 'onnx_fp32'")).first()
    assert none["recommended_variant"] is None and none["decision"].startswith("Keep the original")
    assert "| onnx_fp32 | -0.0047 | 0.2% | 236.5 | N/A |" in [r["line"] for r in cmp.variant_rows(variants).collect()]


def test_worthwhile_is_strict(spark):
    df = spark.createDataFrame([(-0.01, 80.0, 2.0), (-0.0099, 5.0, 1.1), (-0.0099, 5.1, 1.0), (0.0, 0.0, 1.11)], "d double, s double, x double")
    got = df.select(cmp.is_worthwhile(F.col("d"), F.col("s"), F.col("x"))).collect()
    assert [r[0] for r in got] == [False, False, True, True]


def test_logits(spark):
    df = spark.createDataFrame([([1000.0, 1000.0],), ([-2.0, 3.0],)], "logits array<double>")
    rows = logits_to_prediction(df, "logits", "tag").collect()
    assert (rows[0]["pred"], rows[0]["sentiment"], rows[0]["confidence"]) == (0, "negative", 0.5)
    assert (rows[1]["pred"], rows[1]["sentiment"], rows[1]["confidence"]) == (1, "positive", 0.9933)


@pytest.mark.parametrize("label,pred", [(2, 1), (None, 1), (1, None), (0, -1)])
def test_labels_outside_the_matrix_are_an_error(spark, label, pred):
    df = spark.createDataFrame([("m", 1, 1), ("m", label, pred)], "model string, label int, pred int")
    with pytest.raises(Exception, match="must be 0 or 1"):
        classification_metrics(df, ["model"]).collect()


def test_rounding_is_that_of_the_stored_value(spark):
    """Ties to even on the exact binary value, as Python rounds."""
    import random

    from reviewloom.functions.scoring import round_exact

    rng = random.Random(3)
    values = [rng.choice([1, -1]) * rng.randint(0, 10 ** rng.randint(1, 8)) / rng.choice([8, 16, 1000, 10**5, 3, 7, 200, 2000]) for _ in range(5000)]
    values += [0.125, 2.675, 0.375, 2.5, 3.5, -0.125, 0.5, 1.005, 0.00005, 0.00015, 1e15, 1e300, 5e-324, -0.0]
    df = spark.createDataFrame(list(enumerate(map(float, values))), "i int, x double")
    for digits in (0, 1, 2, 4):
        got = {r.i: r.r for r in df.select("i", round_exact(F.col("x"), digits).alias("r")).collect()}
        assert [x for i, x in enumerate(values) if got[i] != round(float(x), digits)] == []
    odd = df.limit(1).select(round_exact(F.lit(float("nan")), 2).alias("n"), round_exact(F.lit(float("inf")), 2).alias("i"), round_exact(F.lit(None), 2).alias("z")).first()
    assert odd.n != odd.n and odd.i == float("inf") and odd.z is None


def test_ties_in_verdicts_and_variants(spark):
    from reviewloom.operators import comparison as cmp

    rows = [("base", 0, 0.9, 0.5, 8.0, 8.0), ("tie", 1, 0.9, 0.50005, 1.0, 2.0 / 0.35), ("other", 2, 0.9, 0.51, 8 / 2.25, 8 / 2.675)]
    models = spark.createDataFrame(rows, "model string, pos int, accuracy double, f1 double, size_mb double, latency_ms double").withColumn(
        "status", F.lit("measured")).withColumn("measured_on", F.lit("x"))
    got = {r.model: r for r in cmp.verdict(models, "base").collect()}
    variants = {r.model: r for r in cmp.variant_summary(models, "base", []).collect()}
    for name, _, _, f1, size, latency in rows[1:]:
        assert got[name].f1_delta == round(f1 - 0.5, 4) == variants[name].f1_delta
        assert (got[name].size_ratio, got[name].latency_ratio) == (round(size / 8.0, 1), round(latency / 8.0, 1))
        assert (variants[name].size_reduction_pct, variants[name].speedup) == (round((1 - size / 8.0) * 100, 1), round(8.0 / latency, 2))
