"""Comparison tables built from measured rows.

The models here are the languages of the corpus: F1 of one scorer on the
labelled documents of the language, size of its texts, and mean value of one
event type as timing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.catalog.inputs import table
from reviewloom.catalog.scoring import SQL_COUNTS, SQL_EVALUATED, SQL_METRICS, _evaluated
from reviewloom.operators import comparison as cmp
from reviewloom.operators.evaluation import classification_metrics
from reviewloom.operators.ranking import timing_statistics
from reviewloom.plans import reports as runs
from reviewloom.sources.reports import (
    MODEL_REPORT_SCHEMA, model_rows, read_document, read_report, write_document, write_report,
)
from reviewloom.storage import scratch_path

MODELS = ["en", "fr", "de", "es", "it"]
BASELINE = "en"
UNSCORED = ["es"]
TIMED_BY = {"en": "click", "fr": "view", "de": "purchase", "es": "signup"}


def _reports(spark, sf_dir):
    """(model_name, test_metrics, test_latency_ms, model_size_mb, latency_measured_on) per language."""
    scored = _evaluated(spark, sf_dir).where("model = 'logreg'")
    metrics = classification_metrics(scored, ["lang"])
    sizes = table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.round(F.sum("n_chars") / (1024 * 1024), 3).alias("model_size_mb")
    )
    names = F.create_map(*[F.lit(x) for lang, event in TIMED_BY.items() for x in (event, lang)])
    timings = timing_statistics(table(spark, sf_dir, "events"), ["event_type"], "value").withColumn(
        "lang", F.element_at(names, F.col("event_type"))
    )
    latency = ["n_measured", "mean_ms", "median_ms", "p95_ms", "min_ms", "max_ms"]
    return (
        metrics.join(sizes, "lang")
        .join(timings.where(F.col("lang").isNotNull()), "lang")
        .select(
            F.col("lang").alias("model_name"),
            F.struct("accuracy", "precision", "recall", "f1", "confusion_matrix").alias("test_metrics"),
            F.struct(*latency).alias("test_latency_ms"),
            "model_size_mb",
            F.lit("events").alias("latency_measured_on"),
        )
    )


def _models(spark, sf_dir):
    return cmp.expected_models(model_rows(_reports(spark, sf_dir)), MODELS)


def model_verdict(spark, sf_dir):
    return cmp.verdict(_models(spark, sf_dir), BASELINE)


def _variants(spark, sf_dir):
    return cmp.variant_summary(_models(spark, sf_dir), BASELINE, UNSCORED)


def variant_summary(spark, sf_dir):
    return _variants(spark, sf_dir).drop("pos")


def report_round_trip(spark, sf_dir):
    path = scratch_path(spark, "reports")
    write_report(_reports(spark, sf_dir), path)
    report = read_report(spark, path, MODEL_REPORT_SCHEMA)
    return model_rows(report).join(
        report.select(F.col("model_name").alias("model"), F.col("test_latency_ms.p95_ms").alias("p95_ms")), "model"
    )


def evaluated_models(spark, sf_dir):
    """One record per language, joined from metrics, timings and sizes; flat for comparison."""
    reports = _reports(spark, sf_dir)
    metrics = reports.select(F.col("model_name").alias("model"), "test_metrics.*")
    timings = reports.where("model_name <> 'fr'").select(F.col("model_name").alias("model"), "test_latency_ms.*")
    sizes = reports.select(F.col("model_name").alias("model"), F.col("model_size_mb").alias("size_mb"))
    return model_rows(cmp.evaluated_models(metrics, timings, sizes, "this run"))


def _artifacts(spark):
    return spark.createDataFrame([(m, f"models/{m}") for m in MODELS[:3]], "model string, artifact_path string")


def variant_artifacts(spark, sf_dir):
    models = _models(spark, sf_dir).withColumn("measured_on", F.when(F.col("model") != "de", F.col("measured_on")))
    found = cmp.variant_summary(models, BASELINE, UNSCORED, _artifacts(spark))
    return found.select("model", "worthwhile", "same_machine", "artifact_path")


def comparison_document(spark, sf_dir):
    path = scratch_path(spark, "document")
    models = _models(spark, sf_dir)
    write_document(cmp.comparison_document(models, cmp.verdict(models, BASELINE)), path)
    return read_document(spark, path)


def variant_document(spark, sf_dir):
    path = scratch_path(spark, "document")
    variants = _variants(spark, sf_dir)
    write_document(cmp.variant_document(variants, cmp.best_variant(variants)), path)
    return read_document(spark, path)


def comparison_report(spark, sf_dir):
    """Written and read again: the verdict lines next to the model rows."""
    path = scratch_path(spark, "comparison")
    models = _models(spark, sf_dir)
    report = runs.comparison_report(models, cmp.verdict(models, BASELINE))
    write_report(report, path)
    read = spark.read.schema(report.schema).json(path, multiLine=True)
    rows = read.select(F.inline("models"))
    lines = read.select(F.inline("verdicts")).select("model", "summary")
    return rows.join(lines, "model", "left").select("model", "pos", "accuracy", "f1", "status", "summary")


def variant_report(spark, sf_dir):
    path = scratch_path(spark, "variants")
    models, variants = _models(spark, sf_dir), _variants(spark, sf_dir)
    report = runs.variant_report(models.where(F.col("model") == BASELINE), variants, cmp.best_variant(variants))
    write_report(report, path)
    read = spark.read.schema(report.schema).json(path, multiLine=True)
    return read.select("recommended_variant", F.col("original.f1").alias("original_f1"), F.inline("variants")).select(
        "recommended_variant", "original_f1", "model", "f1_delta", "worthwhile"
    )


QUERIES = {
    "evaluated_models": evaluated_models,
    "variant_artifacts": variant_artifacts,
    "comparison_document": comparison_document,
    "variant_document": variant_document,
    "comparison_report": comparison_report,
    "variant_report": variant_report,
    "model_verdict": model_verdict,
    "variant_summary": variant_summary,
    "best_variant": lambda s, d: cmp.best_variant(_variants(s, d)),
    "markdown_rows": lambda s, d: cmp.comparison_rows(_models(s, d)),
    "variant_markdown_rows": lambda s, d: cmp.variant_rows(_variants(s, d)),
    "chart_rows": lambda s, d: cmp.chart_rows(_models(s, d)),
    "report_round_trip": report_round_trip,
}

_VARIANT_LINES = """variant_lines AS (SELECT pos, printf('| %s | %+.4f | %.1f%% | %.1f | %s |', model, f1_delta,
        size_reduction_pct, latency_ms, CASE WHEN worthwhile THEN 'Yes' WHEN NOT worthwhile THEN 'No' ELSE 'N/A' END)
        AS line FROM variants)"""
_DECISION = """b AS (SELECT * FROM variants WHERE worthwhile ORDER BY latency_ms, pos LIMIT 1),
    decision AS (SELECT model AS recommended_variant, CASE WHEN model IS NULL
        THEN 'Keep the original: no variant pays off.'
        ELSE printf('Take %s: F1 changes by %+.4f, %.1f%% smaller, mean time %.1f ms instead of %.1f ms.',
            model, f1_delta, size_reduction_pct, latency_ms, base_latency_ms) END AS decision
        FROM (SELECT 1) LEFT JOIN b ON true)"""


_WANTED = ", ".join(f"('{m}', {i})" for i, m in enumerate(MODELS))
_EVENT = " ".join(f"WHEN '{event}' THEN '{lang}'" for lang, event in TIMED_BY.items())
_MODELS = f"""{SQL_EVALUATED},
    c AS (SELECT lang, {SQL_COUNTS} FROM p WHERE model = 'logreg' GROUP BY lang),
    quality AS (SELECT lang AS model, {SQL_METRICS} FROM c),
    sizes AS (SELECT lang AS model, round(sum(n_chars) / 1048576, 3) AS size_mb FROM documents GROUP BY lang),
    timed AS (SELECT CASE event_type {_EVENT} END AS model, value, row_number() OVER
              (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n
              FROM events),
    timings AS (SELECT model, round(avg(value), 3) AS latency_ms,
                round(max(value) FILTER (k = least(n * 95 // 100, n - 1)), 3) AS p95_ms FROM timed GROUP BY model),
    measured AS (SELECT *, 'events' AS measured_on FROM quality JOIN sizes USING (model) JOIN timings USING (model)),
    wanted(model, pos) AS (VALUES {_WANTED}),
    models AS (SELECT *, CASE WHEN f1 IS NULL THEN 'NOT YET MEASURED' ELSE 'measured' END AS status
               FROM wanted LEFT JOIN measured USING (model)),
    base AS (SELECT f1 AS base_f1, size_mb AS base_size_mb, latency_ms AS base_latency_ms
             FROM models WHERE model = '{BASELINE}')"""
_VERDICT = f"""v AS (SELECT model, status, round(f1 - base_f1, 4) AS f1_delta,
    round(size_mb / base_size_mb, 1) AS size_ratio, round(latency_ms / base_latency_ms, 1) AS latency_ratio
    FROM models, base WHERE model <> '{BASELINE}')"""
_SUMMARY = f"""d AS (SELECT model, pos, f1, size_mb, latency_ms, base_latency_ms,
        round(f1 - base_f1, 4) AS f1_delta, round((1 - size_mb / base_size_mb) * 100, 1) AS size_reduction_pct,
        round(base_latency_ms / latency_ms, 2) AS speedup
        FROM models, base WHERE model <> '{BASELINE}' AND f1 IS NOT NULL),
    variants AS (SELECT *, CASE WHEN model NOT IN ('{"', '".join(UNSCORED)}') THEN f1_delta > -0.01
        AND (size_reduction_pct > 5 OR speedup > 1.1) END AS worthwhile FROM d)"""


_LINES = f"""sentences AS (SELECT model, status, f1_delta, f1_delta > 0 AS beats_baseline, size_ratio, latency_ratio,
        CASE WHEN status <> 'measured' THEN model || ': no figures so far.'
        ELSE printf('%s against {BASELINE}: F1 %s (%+.4f), size times %.1f, mean time times %.1f.', model,
            CASE WHEN f1_delta > 0 THEN 'higher' ELSE 'not higher' END, f1_delta,
            size_ratio, latency_ratio) END AS summary FROM v),
    table_rows AS (SELECT pos, CASE WHEN status = 'measured'
        THEN printf('| %s | %.4f | %.4f | %.3f | %.3f |', model, accuracy, f1, size_mb, latency_ms)
        ELSE '| ' || model || ' | NOT YET MEASURED | NOT YET MEASURED | -- | -- |' END AS line FROM models)"""


def _shown(column):
    return f"CASE WHEN {column} IS NULL THEN '—' ELSE printf('%.4f', {column}) END AS {column}"


ORACLES = {
    "model_verdict": f"WITH {_MODELS}, {_VERDICT}, {_LINES} SELECT * FROM sentences",
    "variant_summary": f"WITH {_MODELS}, {_SUMMARY} SELECT * EXCLUDE pos FROM variants",
    "best_variant": f"WITH {_MODELS}, {_SUMMARY}, {_DECISION} SELECT * FROM decision",
    "evaluated_models": f"""WITH {_MODELS} SELECT model, accuracy, f1, size_mb,
        CASE WHEN model <> 'fr' THEN latency_ms END AS latency_ms,
        CASE WHEN model <> 'fr' THEN 'this run' END AS measured_on FROM measured""",
    "variant_artifacts": f"""WITH {_MODELS}, {_SUMMARY} SELECT model, worthwhile,
        CASE WHEN model <> 'de' THEN true END AS same_machine,
        CASE WHEN model IN ('{MODELS[0]}', '{MODELS[1]}', '{MODELS[2]}') THEN 'models/' || model END AS artifact_path FROM variants""",
    "comparison_document": f"""WITH {_MODELS}, {_VERDICT}, {_LINES}, lines AS (
        SELECT 0 AS part, 0 AS pos, '# Model comparison' AS line UNION ALL SELECT 0, 1, '' UNION ALL
        SELECT 0, 2, '| Model | Accuracy | F1 | Size (MB) | Mean time (ms) | Measured on |' UNION ALL
        SELECT 0, 3, '|---|---|---|---|---|---|' UNION ALL
        SELECT 1, pos, line || ' ' || coalesce(measured_on, '--') || ' |' FROM models JOIN table_rows USING (pos) UNION ALL
        SELECT 2, 0, '' UNION ALL SELECT 2, 1, '## Verdict' UNION ALL SELECT 2, 2, '' UNION ALL
        SELECT 3, pos, '- ' || summary FROM sentences JOIN models USING (model))
        SELECT CAST(row_number() OVER (ORDER BY part, pos) - 1 AS INTEGER) AS pos, line FROM lines""",
    "comparison_report": f"""WITH {_MODELS}, {_VERDICT}, {_LINES}
        SELECT model, pos, accuracy, f1, models.status, summary FROM models LEFT JOIN sentences USING (model)""",
    "variant_report": f"""WITH {_MODELS}, {_SUMMARY} SELECT (SELECT model FROM variants WHERE worthwhile
        ORDER BY latency_ms, pos LIMIT 1) AS recommended_variant, (SELECT base_f1 FROM base) AS original_f1,
        model, f1_delta, worthwhile FROM variants""",
    "markdown_rows": f"""WITH {_MODELS} SELECT pos, CASE WHEN status = 'measured'
        THEN printf('| %s | %.4f | %.4f | %.3f | %.3f |', model, accuracy, f1, size_mb, latency_ms)
        ELSE '| ' || model || ' | NOT YET MEASURED | NOT YET MEASURED | -- | -- |' END AS line FROM models""",
    "variant_markdown_rows": f"WITH {_MODELS}, {_SUMMARY}, {_VARIANT_LINES} SELECT pos, line FROM variant_lines",
    "variant_document": f"""WITH {_MODELS}, {_SUMMARY}, {_VARIANT_LINES}, {_DECISION}, lines AS (
        SELECT 0 AS part, 0 AS pos, '# Variants' AS line UNION ALL SELECT 0, 1, '' UNION ALL
        SELECT 0, 2, '| Variant | F1 change | Size reduction | Mean time (ms) | Worthwhile |' UNION ALL
        SELECT 0, 3, '|---|---|---|---|---|' UNION ALL SELECT 1, pos, line FROM variant_lines UNION ALL
        SELECT 2, 0, '' UNION ALL SELECT 2, 1, '## Decision' UNION ALL SELECT 2, 2, '' UNION ALL
        SELECT 3, 0, decision FROM decision)
        SELECT CAST(row_number() OVER (ORDER BY part, pos) - 1 AS INTEGER) AS pos, line FROM lines""",
    "chart_rows": f"""WITH {_MODELS} SELECT model, printf('%.4f', accuracy) AS accuracy, {_shown('f1')},
        {_shown('size_mb')}, {_shown('latency_ms')} FROM models WHERE accuracy IS NOT NULL""",
    "report_round_trip": f"WITH {_MODELS} SELECT model, accuracy, f1, size_mb, latency_ms, measured_on, p95_ms FROM measured",
}
