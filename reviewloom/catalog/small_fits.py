"""Fits on two numbers of the labelled documents, next to Newton steps in SQL.

Both losses are strictly convex, so any solver that converges gives the same numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.catalog.inputs import split_of, table
from reviewloom.operators.training import Problem, calibrate, calibrated_probabilities, fit_linear, model_table, tune
from reviewloom.sinks.tables import load_models, save_models
from reviewloom.storage import materialise, scratch_path

GRID = (0.01, 1.0, 100.0)
TIGHT = 1e-10
TERMS = ("length", "toxic")


def _rows(spark, sf_dir):
    """(id, label, indices, values, split): scaled log length and the toxic flag."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    values = F.array(F.log(F.col("n_chars") + 1.0) / 10, F.col("toxic").cast("double"))
    rows = docs.select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"), F.array(F.lit(0), F.lit(1)).alias("indices"),
        values.alias("values"), split_of(F.col("doc_id")).alias("split"),
    )
    return materialise(rows, "small-rows")


def _part(rows, name):
    return rows.where(F.col("split") == name).drop("split")


def _vocabulary(spark):
    return spark.createDataFrame(list(enumerate(TERMS)), "idx int, term string")


def _fits(spark, sf_dir, kind):
    rows = _part(_rows(spark, sf_dir), "train")
    return fit_linear(rows, [Problem(f"C={c:g}", c) for c in GRID], kind, 2, TIGHT)


def coefficients(spark, sf_dir, kind):
    found = model_table(spark, _fits(spark, sf_dir, kind), _vocabulary(spark))
    return found.select("model", F.coalesce("term", F.lit("bias")).alias("term"), F.round("coef", 4).alias("coef"))


def model_round_trip(spark, sf_dir):
    path = scratch_path(spark, "models")
    save_models(model_table(spark, _fits(spark, sf_dir, "squared_hinge"), _vocabulary(spark)), path)
    stored, intercepts = load_models(spark, path)
    bias = spark.createDataFrame([(m, "bias", v) for m, v in intercepts.items()], "model string, term string, coef double")
    return stored.select("model", "term", "coef").unionByName(bias).withColumn("coef", F.round("coef", 4))


def grid_scores(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    frames = [
        tune(_part(rows, "train"), _part(rows, "test"), kind, 2, GRID, tolerance=TIGHT).grid.select(F.lit(kind).alias("kind"), "C", "f1")
        for kind in ("logistic", "squared_hinge")
    ]
    return frames[0].unionByName(frames[1])


def calibrated_scores(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    model = calibrate(_part(rows, "train"), 1.0, 2, tolerance=TIGHT)
    scored = calibrated_probabilities(_part(rows, "test"), model)
    return scored.select("id", F.round("probability", 4).alias("probability"), "pred")


QUERIES = {
    "small_lr_fit": lambda s, d: coefficients(s, d, "logistic"),
    "small_svm_fit": lambda s, d: coefficients(s, d, "squared_hinge"),
    "small_grid": grid_scores,
    "small_calibrated": calibrated_scores,
    "model_round_trip": model_round_trip,
}

_ROWS = """r AS MATERIALIZED (SELECT doc_id AS id, quality AS label, CASE WHEN quality = 1 THEN 1.0 ELSE -1.0 END AS s,
    ln(n_chars + 1.0) / 10 AS a, CAST(toxic AS DOUBLE) AS b, CASE WHEN substr(md5('split:' || doc_id), 1, 1) < '8'
    THEN 'train' ELSE 'test' END AS split FROM documents JOIN labels USING (doc_id)),
    grid(c) AS (VALUES """ + ", ".join(f"(CAST({c} AS DOUBLE))" for c in GRID) + ")"


def _newton(name: str, source: str, kind: str, steps: int) -> str:
    """CTEs up to ``<name>`` (g, u, v, t): Newton steps for every group g of ``source`` (g, c, a, b, s)."""
    if kind == "logistic":
        slope, bend, free = "-s / (1 + exp(m))", "1 / ((1 + exp(m)) * (1 + exp(-m)))", "0.0"
    else:
        slope, bend, free = "-2 * s * greatest(0, 1 - m)", "CASE WHEN m < 1 THEN 2.0 ELSE 0.0 END", "1.0"
    parts = [f"{name}_0 AS MATERIALIZED (SELECT DISTINCT g, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 0.0::DOUBLE AS t FROM {source})"]
    for i in range(1, steps + 1):
        out = name if i == steps else f"{name}_{i}"
        parts.append(f"""{name}_s{i} AS MATERIALIZED (SELECT g, any_value(u) AS u, any_value(v) AS v, any_value(t) AS t,
            any_value(u) + any_value(c) * sum(d * a) AS x, any_value(v) + any_value(c) * sum(d * b) AS y,
            {free} * any_value(t) + any_value(c) * sum(d) AS z,
            1 + any_value(c) * sum(h * a * a) AS aa, any_value(c) * sum(h * a * b) AS ab, any_value(c) * sum(h * a) AS ac,
            1 + any_value(c) * sum(h * b * b) AS bb, any_value(c) * sum(h * b) AS bc, {free} + any_value(c) * sum(h) AS cc
            FROM (SELECT *, {slope} AS d, {bend} AS h FROM
                  (SELECT q.*, u, v, t, s * (u * a + v * b + t) AS m FROM {source} q JOIN {name}_{i - 1} USING (g))) GROUP BY g)""")
        det = "(aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac))"
        parts.append(f"""{out} AS MATERIALIZED (SELECT g,
            u - (x * (bb * cc - bc * bc) - ab * (y * cc - bc * z) + ac * (y * bc - bb * z)) / {det} AS u,
            v - (aa * (y * cc - bc * z) - x * (ab * cc - bc * ac) + ac * (ab * z - y * ac)) / {det} AS v,
            t - (aa * (bb * z - y * bc) - ab * (ab * z - y * ac) + x * (ab * bc - bb * ac)) / {det} AS t FROM {name}_s{i})""")
    return ",\n".join(parts)


_BY_C = "q AS MATERIALIZED (SELECT c AS g, c, a, b, s FROM r, grid WHERE split = 'train')"
STEPS = {"logistic": 14, "squared_hinge": 14}


def _sql_coefficients(kind: str) -> str:
    return f"""WITH {_ROWS}, {_BY_C}, {_newton('w', 'q', kind, STEPS[kind])}
        SELECT 'C=' || printf('%g', g) AS model, term, round(coef, 4) AS coef FROM
        (SELECT g, unnest(['length', 'toxic', 'bias']) AS term, unnest([u, v, t]) AS coef FROM w)"""


def _sql_f1(kind: str, name: str) -> str:
    return f"""SELECT '{kind}' AS kind, g AS "C", round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM
        (SELECT g, count_if(label = 1 AND m > 0) AS tp, count_if(label = 0 AND m > 0) AS fp, count_if(label = 1 AND m <= 0) AS fn
         FROM (SELECT g, label, u * a + v * b + t AS m FROM r, {name} WHERE split = 'test') GROUP BY g)"""


def _sql_sigmoids(steps: int = 20) -> str:
    """CTEs up to ``k`` (fold, pa, pb) from the held-out margins ``o`` (fold, label, m)."""
    parts = ["""k_0 AS MATERIALIZED (SELECT fold, 0.0::DOUBLE AS pa, ln((n0 + 1.0) / (n1 + 1.0)) AS pb, (n1 + 1.0) / (n1 + 2.0) AS hi,
        1.0 / (n0 + 2.0) AS lo FROM (SELECT fold, count_if(label = 1) AS n1, count_if(label <> 1) AS n0 FROM o GROUP BY fold))"""]
    for i in range(1, steps + 1):
        out = "k" if i == steps else f"k_{i}"
        parts.append(f"""{out} AS MATERIALIZED (SELECT fold, pa - (ga * hbb - gb * hab) / (haa * hbb - hab * hab + 1e-300) AS pa,
            pb - (gb * haa - ga * hab) / (haa * hbb - hab * hab + 1e-300) AS pb, hi, lo FROM
            (SELECT fold, any_value(pa) AS pa, any_value(pb) AS pb, any_value(hi) AS hi, any_value(lo) AS lo, sum((y - p) * m) AS ga,
             sum(y - p) AS gb, sum(p * (1 - p) * m * m) AS haa, sum(p * (1 - p) * m) AS hab, sum(p * (1 - p)) AS hbb FROM
             (SELECT *, CASE WHEN label = 1 THEN hi ELSE lo END AS y, 1 / (1 + exp(pa * m + pb)) AS p FROM o JOIN k_{i - 1} USING (fold))
             GROUP BY fold))""")
    return ",\n".join(parts)


_CALIBRATED = f"""WITH {_ROWS},
    f AS MATERIALIZED (SELECT *, ntile(5) OVER (PARTITION BY label ORDER BY md5('42:' || id), id) AS fold FROM r WHERE split = 'train'),
    q AS MATERIALIZED (SELECT g, 1.0::DOUBLE AS c, a, b, s FROM f, (SELECT unnest([1, 2, 3, 4, 5]) AS g) WHERE fold <> g),
    {_newton('w', 'q', 'squared_hinge', 14)},
    o AS MATERIALIZED (SELECT fold, label, u * a + v * b + t AS m FROM f JOIN w ON fold = g),
    {_sql_sigmoids()},
    p AS (SELECT id, avg(1 / (1 + exp(pa * (u * a + v * b + t) + pb))) AS probability FROM r, w JOIN k ON g = fold
          WHERE split = 'test' GROUP BY id)
    SELECT id, round(probability, 4) AS probability, CASE WHEN probability > 0.5 THEN 1 ELSE 0 END AS pred FROM p"""

ORACLES = {
    "small_lr_fit": _sql_coefficients("logistic"),
    "small_svm_fit": _sql_coefficients("squared_hinge"),
    "model_round_trip": _sql_coefficients("squared_hinge"),
    "small_grid": f"""WITH {_ROWS}, {_BY_C}, {_newton('w', 'q', 'logistic', 14)}, {_newton('x', 'q', 'squared_hinge', 14)}
        {_sql_f1('logistic', 'w')} UNION ALL {_sql_f1('squared_hinge', 'x')}""",
    "small_calibrated": _CALIBRATED,
}
