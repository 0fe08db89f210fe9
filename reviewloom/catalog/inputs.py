"""Tables the catalogue queries read, and the same inputs in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.cleaning import COMMON_REFERENCES, SPACE_CLASS, WORD_CLASS, clean_for_classical
from reviewloom.operators.features import TfidfSettings, fit_vocabulary
from reviewloom.storage import materialise, spread

# Stand-in linear models: coefficients are hashes of the terms.
HASH_MODELS = ("logreg", "distilbert")
HASH_INTERCEPTS = {"logreg": 0.05, "distilbert": -0.05}
SETTINGS = TfidfSettings()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A table whose texts are worked on, spread over the cores if need be."""
    return spread(table(spark, sf_dir, name), *keys)


def split_of(id_col: Column) -> Column:
    first = F.substring(F.md5(F.concat(F.lit("split:"), id_col.cast("string"))), 1, 1)
    return F.when(first < "8", "train").otherwise("test")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "documents", "doc_id").withColumn("split", split_of(F.col("doc_id")))


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for counts that do not look at the texts."""
    return table(spark, sf_dir, "documents").withColumn("split", split_of(F.col("doc_id")))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return documents(spark, sf_dir).join(labels, "doc_id")


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label) of labelled documents, without their texts."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id")


def cleaned(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("clean", clean_for_classical(F.col(text_col)))


def train_vocabulary(spark: SparkSession, sf_dir: str, settings: TfidfSettings = SETTINGS) -> DataFrame:
    train = cleaned(documents(spark, sf_dir).where(F.col("split") == "train").select("doc_id", "text"))
    return fit_vocabulary(train, "doc_id", "clean", settings)


def stored_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted vocabulary as a stored table, for queries that read it more than once."""
    return materialise(train_vocabulary(spark, sf_dir), "vocabulary")


def hash_coefficients(vocabulary: DataFrame, models=HASH_MODELS) -> DataFrame:
    """(model, term, coef): six hex digits of a hash, shifted to -0.5 .. 0.5."""
    named = vocabulary.select(F.explode(F.array(*[F.lit(m) for m in models])).alias("model"), "term")
    digits = F.substring(F.md5(F.concat("model", F.lit(":"), "term")), 1, 6)
    return named.withColumn("coef", F.conv(digits, 16, 10).cast("int") / 16777216.0 - 0.5)


# --- the same in SQL -------------------------------------------------------

SQL_SPLIT = "CASE WHEN substr(md5('split:' || doc_id), 1, 1) < '8' THEN 'train' ELSE 'test' END"
SQL_DOCUMENTS = f"docs AS (SELECT *, {SQL_SPLIT} AS split FROM documents)"
SQL_LABELLED = (
    f"{SQL_DOCUMENTS}, labelled AS "
    "(SELECT d.*, l.quality AS label FROM docs d JOIN labels l ON d.doc_id = l.doc_id)"
)


def sql_unescape(x: str) -> str:
    for reference, char in COMMON_REFERENCES.items():
        char = char.replace("'", "''")
        x = f"replace({x}, '{reference}', '{char}')"
    return x


def sql_strip(x: str) -> str:
    return f"regexp_replace({sql_unescape(x)}, '<[^>]+>', ' ', 'g')"


def sql_tidy(x: str) -> str:
    capped = f"regexp_replace({x}, '([!?.]){{3,}}', '\\1\\1\\1', 'g')"
    return f"coalesce(trim(regexp_replace({capped}, '[{SPACE_CLASS}]+', ' ', 'g')), '')"


def sql_classical(x: str) -> str:
    return sql_tidy(f"lower({sql_strip(x)})")


def sql_transformer(x: str) -> str:
    return sql_tidy(sql_strip(x))


def sql_word_count(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '[^{SPACE_CLASS}]+')) AS INTEGER)"


def sql_blank(x: str) -> str:
    return f"({x} IS NULL OR NOT regexp_matches({x}, '[^{SPACE_CLASS}]'))"


def sql_terms(name: str, source: str, id_col: str, text: str) -> str:
    """CTEs <name>_tok, <name>_terms (id, term) and <name>_tf (id, term, tf)."""
    return f"""
    {name}_tok AS (SELECT {id_col}, regexp_extract_all(lower({text}), '[{WORD_CLASS}]{{2,}}') AS t FROM {source}),
    {name}_terms AS (SELECT {id_col}, unnest(list_concat(t,
        list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM {name}_tok),
    {name}_tf AS (SELECT {id_col}, term, CAST(count(*) AS INTEGER) AS tf FROM {name}_terms GROUP BY ALL)"""


def sql_vocabulary(settings: TfidfSettings = SETTINGS) -> str:
    """CTEs up to ``vocab`` (term, idx, df, cf, idf), fitted on the train documents."""
    return f"""{SQL_DOCUMENTS},
    train AS (SELECT doc_id, {sql_classical('text')} AS clean FROM docs WHERE split = 'train'),
    {sql_terms('train', 'train', 'doc_id', 'clean')},
    n AS (SELECT count(*) AS n_docs FROM train),
    dfreq AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM train_tf GROUP BY term),
    kept AS (SELECT * FROM dfreq, n WHERE df >= {settings.min_df} AND df <= {settings.max_df} * n_docs
             ORDER BY cf DESC, term LIMIT {settings.max_features}),
    vocab AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, df, cf,
              ln((1 + n_docs) / (1 + df)) + 1 AS idf FROM kept)"""


def sql_weights(name: str, source: str, id_col: str, text: str) -> str:
    """CTE <name>_w (id, term, idx, w) on top of ``vocab``: unit rows."""
    return f"""{sql_terms(name, source, id_col, text)},
    {name}_raw AS (SELECT f.{id_col}, v.term, v.idx, (1 + ln(f.tf)) * v.idf AS w
                   FROM {name}_tf f JOIN vocab v ON f.term = v.term),
    {name}_w AS (SELECT {id_col}, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY {id_col})) AS w
                 FROM {name}_raw)"""


def sql_hash_coefficient(model: str, term: str) -> str:
    digest = f"md5({model} || ':' || {term})"
    digits = " + ".join(
        f"(strpos('0123456789abcdef', substr({digest}, {i}, 1)) - 1) * {16 ** (6 - i)}" for i in range(1, 7)
    )
    return f"(({digits}) / 16777216.0 - 0.5)"


def sql_margins(name: str, source: str, id_col: str, models=HASH_MODELS) -> str:
    """CTE <name>_m (id, model, margin) for every row of ``source`` on top of <name>_w."""
    values = ", ".join(f"('{m}', {HASH_INTERCEPTS[m]})" for m in models)
    return f"""hash_models(model, intercept) AS (VALUES {values}),
    coefs AS (SELECT model, term, {sql_hash_coefficient('model', 'term')} AS coef FROM vocab, hash_models),
    {name}_dot AS (SELECT w.{id_col}, c.model, sum(w.w * c.coef) AS dot
                   FROM {name}_w w JOIN coefs c ON w.term = c.term GROUP BY ALL),
    {name}_m AS (SELECT s.{id_col}, m.model, coalesce(d.dot, 0) + m.intercept AS margin
                 FROM {source} s CROSS JOIN hash_models m
                 LEFT JOIN {name}_dot d ON d.{id_col} = s.{id_col} AND d.model = m.model)"""
