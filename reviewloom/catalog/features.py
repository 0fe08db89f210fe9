"""Tokens, vocabulary, TF-IDF."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from reviewloom.catalog.inputs import (
    SQL_DOCUMENTS, cleaned, documents, sql_classical, sql_terms, sql_vocabulary, sql_weights,
    stored_vocabulary, text_table, train_vocabulary,
)
from reviewloom.operators import features as ft
from reviewloom.operators.ml_stages import TermVectorizer
from reviewloom.storage import scratch_path

TOP_K = ft.TfidfSettings(max_features=500)


def _clean_docs(spark, sf_dir, split=None):
    docs = documents(spark, sf_dir)
    if split:
        docs = docs.where(F.col("split") == split)
    return cleaned(docs.select("doc_id", "text")).drop("text")


def tokens(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", ft.tokenize(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def ngrams(spark, sf_dir):
    terms = ft.document_terms(text_table(spark, sf_dir, "documents", "doc_id"), "doc_id", "text")
    return terms.select("doc_id", F.size("terms").alias("n_terms"), F.array_join("terms", "|").alias("terms"))


def term_freq(spark, sf_dir):
    return ft.term_frequency(_clean_docs(spark, sf_dir), "doc_id", "clean")


def doc_freq(spark, sf_dir):
    return ft.document_frequency(_clean_docs(spark, sf_dir), "doc_id", "clean")


def vocabulary_topk(spark, sf_dir):
    return train_vocabulary(spark, sf_dir, TOP_K).withColumn("idf", F.round("idf", 6))


def vocabulary_size(spark, sf_dir):
    return train_vocabulary(spark, sf_dir).agg(F.count("*").alias("vocabulary_size"))


def _weights(spark, sf_dir, split):
    weights = ft.tfidf_weights(
        _clean_docs(spark, sf_dir, split), stored_vocabulary(spark, sf_dir), "doc_id", "clean"
    )
    return weights.withColumn("w", F.round("w", 6))


def sparse_vector_stats(spark, sf_dir):
    rows = ft.tfidf_vectors(
        _clean_docs(spark, sf_dir, "test"), stored_vocabulary(spark, sf_dir), "doc_id", "clean"
    )
    square = F.aggregate("values", F.lit(0.0), lambda acc, x: acc + x * x)
    # Position of every entry times its weight: ties indices and values together.
    tied = F.aggregate(
        F.arrays_zip("indices", "values"), F.lit(0.0), lambda acc, x: acc + x["indices"] * x["values"]
    )
    return rows.select(
        "doc_id", F.size("indices").alias("nnz"), F.round(F.sqrt(square), 6).alias("norm"),
        F.round(tied, 3).alias("index_moment"),
    )


def ml_pipeline_weights(spark, sf_dir):
    """The vectoriser as a stage of a stored pipeline: fitted, saved, loaded, applied to the test split."""
    path = scratch_path(spark, "pipeline-model")
    Pipeline(stages=[TermVectorizer(inputCol="clean")]).fit(_clean_docs(spark, sf_dir, "train")).write().save(path)
    loaded = PipelineModel.load(path)
    vectors = loaded.transform(_clean_docs(spark, sf_dir, "test")).select("doc_id", F.unwrap_udt("features").alias("v"))
    entries = vectors.select("doc_id", F.inline(F.arrays_zip("v.indices", "v.values")).alias("idx", "w"))
    terms = loaded.stages[0].vocabulary.select("idx", "term")
    return entries.join(terms, "idx").select("doc_id", "term", F.round("w", 6).alias("w"))


QUERIES = {
    "ml_pipeline_weights": ml_pipeline_weights,
    "tokens": tokens,
    "ngrams": ngrams,
    "term_freq": term_freq,
    "doc_freq": doc_freq,
    "vocabulary_topk": vocabulary_topk,
    "vocabulary_size": vocabulary_size,
    "tfidf_weights": lambda s, d: _weights(s, d, "train"),
    "tfidf_transform_test": lambda s, d: _weights(s, d, "test"),
    "sparse_vector_stats": sparse_vector_stats,
}

_CLEAN = f"c AS (SELECT doc_id, {sql_classical('text')} AS clean FROM documents)"
_TEST = f"test AS (SELECT doc_id, {sql_classical('text')} AS clean FROM docs WHERE split = 'test')"

ORACLES = {
    "tokens": f"""WITH {sql_terms('x', 'documents', 'doc_id', 'text')} SELECT doc_id,
        CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens FROM x_tok""",
    "ngrams": f"""WITH {sql_terms('x', 'documents', 'doc_id', 'text')}, g AS (SELECT doc_id, list_concat(t,
        list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM x_tok)
        SELECT doc_id, CAST(len(g) AS INTEGER) AS n_terms, array_to_string(g, '|') AS terms FROM g""",
    "term_freq": f"WITH {_CLEAN}, {sql_terms('x', 'c', 'doc_id', 'clean')} SELECT * FROM x_tf",
    "doc_freq": f"""WITH {_CLEAN}, {sql_terms('x', 'c', 'doc_id', 'clean')}
        SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM x_tf GROUP BY term""",
    "vocabulary_topk": f"WITH {sql_vocabulary(TOP_K)} SELECT term, idx, df, cf, round(idf, 6) AS idf FROM vocab",
    "vocabulary_size": f"WITH {sql_vocabulary()} SELECT count(*) AS vocabulary_size FROM vocab",
    "tfidf_weights": f"""WITH {sql_vocabulary()}, {sql_weights('x', 'train', 'doc_id', 'clean')}
        SELECT doc_id, term, round(w, 6) AS w FROM x_w""",
    "tfidf_transform_test": f"""WITH {sql_vocabulary()}, {_TEST}, {sql_weights('x', 'test', 'doc_id', 'clean')}
        SELECT doc_id, term, round(w, 6) AS w FROM x_w""",
    "ml_pipeline_weights": f"""WITH {sql_vocabulary()}, {_TEST}, {sql_weights('x', 'test', 'doc_id', 'clean')}
        SELECT doc_id, term, round(w, 6) AS w FROM x_w""",
    "sparse_vector_stats": f"""WITH {sql_vocabulary()}, {_TEST}, {sql_weights('x', 'test', 'doc_id', 'clean')}
        SELECT doc_id, CAST(count(idx) AS INTEGER) AS nnz, round(sqrt(coalesce(sum(w * w), 0)), 6) AS norm,
               round(coalesce(sum(idx * w), 0), 3) AS index_moment
        FROM test LEFT JOIN x_w USING (doc_id) GROUP BY doc_id""",
}
