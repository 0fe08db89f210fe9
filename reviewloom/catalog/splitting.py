"""Splits, samples, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.catalog.inputs import SQL_DOCUMENTS, documents, label_rows, table
from reviewloom.operators.leakage import remove_leaked_rows, shared_digests
from reviewloom.operators.splitting import stratified_folds, stratified_sample, stratified_split
from reviewloom.storage import materialise

SAMPLE_SIZE = 120


def split_rows(spark, sf_dir):
    return stratified_split(label_rows(spark, sf_dir), "doc_id")


def split_sizes(spark, sf_dir):
    return split_rows(spark, sf_dir).groupBy("split", "label").agg(F.count("*").alias("n_rows"))


def sample_rows(spark, sf_dir):
    return stratified_sample(label_rows(spark, sf_dir), "doc_id", size=SAMPLE_SIZE)


def fold_rows(spark, sf_dir):
    return stratified_folds(label_rows(spark, sf_dir), "doc_id")


def split_hygiene(spark, sf_dir):
    """Ids and texts shared between train, validation and test after leak removal."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "split")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    train, test = docs.where("split = 'train'").drop("split"), docs.where("split = 'test'").drop("split")
    kept = remove_leaked_rows(train, test, "text").join(labels, "doc_id")
    # Read by six checks below, so it is written once.
    parts = materialise(stratified_split(kept, "doc_id", keys=kept.select("doc_id", "label")), "parts")
    part = {s: parts.where(F.col("split") == s) for s in ("train", "validation")}
    part["test"] = test

    def shared_ids(a, b):
        return part[a].select("doc_id").join(part[b].select("doc_id"), "doc_id", "left_semi").distinct()

    rows = [
        frame.agg(F.count("*").alias("shared")).select(F.lit(name).alias("check"), "shared")
        for name, frame in [
            ("train/test ids", shared_ids("train", "test")),
            ("validation/test ids", shared_ids("validation", "test")),
            ("train/validation ids", shared_ids("train", "validation")),
            ("train/test texts", shared_digests(part["train"], part["test"], "text")),
            ("validation/test texts", shared_digests(part["validation"], part["test"], "text")),
            ("train/validation texts", shared_digests(part["train"], part["validation"], "text")),
        ]
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


QUERIES = {
    "stratified_split": split_rows,
    "stratified_split_sizes": split_sizes,
    "stratified_sample": sample_rows,
    "folds": fold_rows,
    "split_hygiene": split_hygiene,
}


def _sql_split(source: str) -> str:
    """CTEs on a table (doc_id, label): quota by largest remainder, then ``parts``."""
    return f"""sizes AS (SELECT label, count(*) AS c FROM {source} GROUP BY label),
    total AS (SELECT sum(c) AS n, ceil(0.10 * sum(c)) AS want FROM sizes),
    share AS (SELECT label, floor(want * c / n) AS k, round(want * c / n - floor(want * c / n), 9) AS r,
              want FROM sizes, total),
    quota AS (SELECT label, k + CASE WHEN row_number() OVER (ORDER BY r DESC, label)
              <= want - sum(k) OVER () THEN 1 ELSE 0 END AS k FROM share),
    placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) AS place
               FROM {source}),
    parts AS (SELECT placed.* EXCLUDE place, CASE WHEN place <= k THEN 'validation' ELSE 'train' END AS split
              FROM placed JOIN quota USING (label))"""


_ROWS = "rows AS (SELECT doc_id, quality AS label FROM documents JOIN labels USING (doc_id))"
_PLACED = "row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id)"

ORACLES = {
    "stratified_split": f"WITH {_ROWS}, {_sql_split('rows')} SELECT doc_id, label, split FROM parts",
    "stratified_split_sizes": f"""WITH {_ROWS}, {_sql_split('rows')}
        SELECT split, label, count(*) AS n_rows FROM parts GROUP BY split, label""",
    "stratified_sample": f"""WITH {_ROWS}, p AS (SELECT *, {_PLACED} AS place, count(*) OVER () AS n FROM rows)
        SELECT doc_id, label FROM p WHERE n <= {SAMPLE_SIZE} OR place <= {SAMPLE_SIZE // 2}""",
    "folds": f"""WITH {_ROWS} SELECT doc_id, label, CAST(ntile(5) OVER
        (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) AS INTEGER) AS fold FROM rows""",
    "split_hygiene": f"""WITH {SQL_DOCUMENTS},
    kept AS (SELECT doc_id, text, quality AS label FROM docs JOIN labels USING (doc_id) WHERE split = 'train'
             AND text NOT IN (SELECT text FROM docs WHERE split = 'test')),
    {_sql_split('kept')},
    every AS (SELECT doc_id, text, split FROM parts UNION ALL
              SELECT doc_id, text, split FROM docs WHERE split = 'test'),
    pairs(a, b) AS (VALUES ('train', 'test'), ('validation', 'test'), ('train', 'validation'))
    SELECT a || '/' || b || ' ids' AS "check", (SELECT count(*) FROM (SELECT doc_id FROM every WHERE split = a
        INTERSECT SELECT doc_id FROM every WHERE split = b)) AS shared FROM pairs
    UNION ALL SELECT a || '/' || b || ' texts', (SELECT count(*) FROM (SELECT text FROM every WHERE split = a
        INTERSECT SELECT text FROM every WHERE split = b)) FROM pairs""",
}
