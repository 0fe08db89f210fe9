"""Corpus quality and leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.catalog.inputs import (
    SQL_DOCUMENTS, SQL_LABELLED, document_rows, documents, label_rows, split_of, sql_blank, sql_word_count, table,
)
from reviewloom.operators import inspection as ins
from reviewloom.operators.leakage import leak_counts, remove_leaked_rows
from reviewloom.plans.reports import existing, inspect_csv_corpus
from reviewloom.sinks.tables import write_split_csv
from reviewloom.storage import scratch_path

SPLITS = ["train", "test", "validation"]


def _with_optional_label(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return documents(spark, sf_dir).join(labels, "doc_id", "left")


def labelled_rows(spark, sf_dir):
    return label_rows(spark, sf_dir).withColumn("split", split_of(F.col("doc_id")))


def cross_split_overlap(spark, sf_dir):
    return leak_counts(documents(spark, sf_dir), "text", "split").select("shared_texts")


def leak_removed_count(spark, sf_dir):
    return leak_counts(documents(spark, sf_dir), "text", "split").drop("shared_texts")


def leak_free_train(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "split")
    train, test = docs.where("split = 'train'").drop("split"), docs.where("split = 'test'")
    return remove_leaked_rows(train, test, "text")


def unlabelled_split_check(spark, sf_dir):
    """Splits by source: labels only where the table has them, else -1."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.col("source").alias("split"), F.coalesce("label", F.lit(-1)).alias("label")
    )
    return ins.unlabelled_splits(rows)


def _with_gaps(spark, sf_dir):
    """Conversation turns, some made null and some blank by a hash."""
    key = F.concat(F.lit("gap:"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    digit = F.substring(F.md5(key), 1, 1)
    text = F.when(digit < "2", F.lit(None)).when(digit < "4", F.lit(" \t\u00a0\n")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("role", text.alias("text"))


def source_status(spark, sf_dir):
    """Sources as files of the folder; good labels above 5 do not exist, so that one is empty."""
    names = ["documents", "labels", "absent"]
    counts = [
        table(spark, sf_dir, name).where(kept).select(F.lit(name).alias("source"))
        for name, kept in (("documents", "text is not null"), ("labels", "quality > 5"))
    ]
    counts = counts[0].union(counts[1]).groupBy("source").agg(F.count("*").alias("n_rows"))
    found = [f.removesuffix(".parquet") for f in existing(spark, sf_dir, [f"{n}.parquet" for n in names])]
    return ins.source_status(counts, names, found=found)


def second_corpus(spark, sf_dir):
    """Inspection of CSV splits, some texts null and some rows without label."""
    folder = scratch_path(spark, "second-corpus")
    rows = table(spark, sf_dir, "conversations").join(
        table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), "quality"), "conv_id", "left"
    )
    digit = F.substring(F.md5(F.concat(F.lit("null:"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))), 1, 1)
    rows = rows.withColumn("sentence", F.when(digit >= "2", F.col("text")))
    for role in ("user", "assistant"):
        write_split_csv(rows.where(F.col("role") == role).select("sentence", F.col("quality").alias("label")), f"{folder}/{role}.csv")
    found = inspect_csv_corpus(spark, folder)
    labels = [F.coalesce(F.element_at("class_balance", F.lit(x)), F.lit(0)).alias(f"label_{x}") for x in ("0", "1", "none")]
    return found.select("split", "n_rows", "duplicate_texts", "missing_texts", "min_words", "max_words", "mean_words", "status", *labels)


def inspection_summary(spark, sf_dir):
    rows = ins.inspection_summary(_with_optional_label(spark, sf_dir), "text", SPLITS)
    labels = [F.coalesce(F.element_at("class_balance", F.lit(x)), F.lit(0)).alias(f"label_{x}") for x in ("0", "1", "none")]
    return rows.select("*", *labels).drop("class_balance")


QUERIES = {
    "split_sizes": lambda s, d: ins.split_sizes(document_rows(s, d)),
    "class_balance": lambda s, d: ins.class_balance(labelled_rows(s, d)),
    "duplicates_total": lambda s, d: ins.duplicate_rows(documents(s, d), "text"),
    "duplicates_by_split": lambda s, d: ins.duplicate_rows(documents(s, d), "text", ["split"]),
    "missing_texts": lambda s, d: ins.missing_texts(_with_gaps(s, d), "text", ["role"]),
    "source_status": source_status,
    "second_corpus": second_corpus,
    "inspection_summary": inspection_summary,
    "cross_split_overlap": cross_split_overlap,
    "leak_removed_count": leak_removed_count,
    "leak_free_train": leak_free_train,
    "unlabelled_split_check": unlabelled_split_check,
}

_SHARED = "shared AS (SELECT text FROM docs WHERE split = 'train' INTERSECT SELECT text FROM docs WHERE split = 'test')"


def _sql_summary():
    return f"""WITH {SQL_DOCUMENTS},
    d AS (SELECT docs.*, quality AS label, {sql_word_count('text')} AS w, {sql_blank('text')} AS blank
          FROM docs LEFT JOIN labels USING (doc_id)),
    {_SHARED},
    both_levels AS (SELECT split, * EXCLUDE split FROM d UNION ALL SELECT 'total', * EXCLUDE split FROM d),
    agg AS (SELECT split, count(*) AS n_rows, count(*) - count(DISTINCT text) AS duplicate_texts,
            count_if(blank) AS missing_texts, min(w) AS min_words, max(w) AS max_words,
            round(avg(w), 1) AS mean_words, median(w) AS median_words,
            count(DISTINCT text) FILTER (text IN (SELECT text FROM shared)) AS cross_split_texts,
            count_if(label = 0) AS label_0, count_if(label = 1) AS label_1,
            count_if(label IS NULL) AS label_none FROM both_levels GROUP BY split),
    wanted(split) AS (VALUES ('train'), ('test'), ('validation'), ('total'))
    SELECT split, coalesce(n_rows, 0) AS n_rows, coalesce(duplicate_texts, 0) AS duplicate_texts,
           CAST(coalesce(missing_texts, 0) AS BIGINT) AS missing_texts, min_words, max_words, mean_words,
           median_words, coalesce(cross_split_texts, 0) AS cross_split_texts,
           CAST(coalesce(label_0, 0) AS BIGINT) AS label_0, CAST(coalesce(label_1, 0) AS BIGINT) AS label_1,
           CAST(coalesce(label_none, 0) AS BIGINT) AS label_none,
           CASE WHEN n_rows > 0 THEN 'ok' ELSE 'missing' END AS status
    FROM wanted LEFT JOIN agg USING (split)"""


ORACLES = {
    "split_sizes": f"""WITH {SQL_DOCUMENTS} SELECT coalesce(split, 'total') AS split, count(*) AS n_rows
        FROM docs GROUP BY ROLLUP (split)""",
    "class_balance": f"""WITH {SQL_LABELLED} SELECT split, label, count(*) AS n_rows
        FROM labelled GROUP BY split, label""",
    "duplicates_total": "SELECT count(*) - count(DISTINCT text) AS duplicate_rows FROM documents",
    "duplicates_by_split": f"""WITH {SQL_DOCUMENTS} SELECT split,
        count(*) - count(DISTINCT text) AS duplicate_rows FROM docs GROUP BY split""",
    "missing_texts": """SELECT role, CAST(count_if(text IS NULL OR trim(text) = '' OR substr(md5('gap:' || conv_id || '-' || turn), 1, 1) < '4')
        AS BIGINT) AS missing_texts FROM conversations GROUP BY role""",
    "source_status": """SELECT 'documents' AS source, count(text) AS n_rows, CASE WHEN count(text) > 0 THEN 'ok' ELSE 'empty' END
        AS status FROM documents UNION ALL SELECT 'labels', count(*) FILTER (quality > 5),
        CASE WHEN count(*) FILTER (quality > 5) > 0 THEN 'ok' ELSE 'empty' END FROM labels
        UNION ALL SELECT 'absent', 0, 'missing'""",
    "second_corpus": f"""WITH c AS (SELECT role AS split, quality, CASE WHEN substr(md5('null:' || conv_id || '-' || turn), 1, 1) >= '2'
        THEN text END AS text FROM conversations LEFT JOIN labels ON conv_id = doc_id WHERE role IN ('user', 'assistant')),
        w AS (SELECT *, coalesce({sql_word_count('text')}, 1) AS words FROM c),
        b AS (SELECT * FROM w UNION ALL SELECT 'total', * EXCLUDE split FROM w)
        SELECT split, count(*) AS n_rows, count(*) - count(DISTINCT coalesce(text, '<null>')) AS duplicate_texts,
        CAST(count_if(text IS NULL) AS BIGINT) AS missing_texts, min(words) AS min_words, max(words) AS max_words,
        round(avg(words), 1) AS mean_words, 'ok' AS status, CAST(count_if(quality = 0) AS BIGINT) AS label_0,
        CAST(count_if(quality = 1) AS BIGINT) AS label_1, CAST(count_if(quality IS NULL) AS BIGINT) AS label_none FROM b GROUP BY split""",
    "inspection_summary": _sql_summary(),
    "cross_split_overlap": f"WITH {SQL_DOCUMENTS}, {_SHARED} SELECT count(*) AS shared_texts FROM shared",
    "leak_removed_count": f"""WITH {SQL_DOCUMENTS}, t AS (SELECT text IN
        (SELECT text FROM docs WHERE split = 'test') AS leaked FROM docs WHERE split = 'train')
        SELECT count(*) AS rows_before, CAST(count_if(NOT leaked) AS BIGINT) AS rows_after,
               CAST(count_if(leaked) AS BIGINT) AS rows_removed FROM t""",
    "leak_free_train": f"""WITH {SQL_DOCUMENTS} SELECT doc_id, text FROM docs WHERE split = 'train'
        AND text NOT IN (SELECT text FROM docs WHERE split = 'test')""",
    "unlabelled_split_check": """SELECT source AS split, bool_and(coalesce(quality, -1) = -1) AS unlabelled
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
}
