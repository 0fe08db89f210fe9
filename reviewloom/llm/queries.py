"""Registered queries of the operators, each over its whole table with production settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.common import table
from reviewloom.llm.conversation_repair import repair_damaged
from reviewloom.llm.decontamination import contaminated
from reviewloom.llm.embedding_dedup import vector_components
from reviewloom.llm.language_id import fit_language_id, predict_language
from reviewloom.llm.language_model import score_texts
from reviewloom.llm.license_scan import scan_licenses
from reviewloom.llm.packing import pack_documents
from reviewloom.llm.personal_data import find_personal_data, train
from reviewloom.llm.quality import fit_quality, quality_scores
from reviewloom.llm.simhash_dedup import simhash_components
from reviewloom.llm.substring_dedup import remove_repeats
from reviewloom.llm.token_alignment import align_tokenizers
from reviewloom.llm.warc import read_archives, write_collection


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_language(docs, fit_language_id(docs))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages as archives and read the records back through the capture index."""
    folder, directory = write_collection(pages.sparkSession, pages, least_bytes=least_bytes)
    kind = pages.schema["page_id"].dataType.simpleString()
    found = read_archives(directory, folder, kind)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_records(table(spark, sf_dir, "pages"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), size=4, max_bits=4)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_components(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_personal_data(docs, train(docs))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_packing": op4_packing,
    "op5_warc": op5_warc,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_personal_data": op8_personal_data,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_license_scan": op11_license_scan,
    "op12_token_alignment": op12_token_alignment,
    "op13_conversation_repair": op13_conversation_repair,
}


def _sql_base32(hex_digits: str) -> str:
    """Base32 of 40 hex digits: five of them are four characters."""
    out = []
    for group in range(8):
        value = f"CAST('0x' || substr({hex_digits}, {5 * group + 1}, 5) AS INTEGER)"
        out += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({value} >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(out)


#: Operators that SQL can express over whole tables; the others rest on trained models, alignment or XXH64.
ORACLES: dict[str, str] = {
    "op5_warc": f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, url, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, payload_bytes, {_sql_base32("h")} AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> first THEN first END AS refers_to, url FROM d""",
    "op7_embedding_dedup": """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        good AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
            AND list_dot_product(e, e) > 0),
        links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
            AND list_cosine_similarity(a.e, b.e) >= 0.98),
        reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM v JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a""",
    "op10_substring_dedup": """WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        starts AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS k FROM
            (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
        late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM starts) WHERE r > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM late),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
        sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
}
