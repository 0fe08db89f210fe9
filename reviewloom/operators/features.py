"""TF-IDF features: vocabulary fitted on train, reused frozen everywhere else.

Terms of a document are counted inside its row, those of a fit in slices of many rows, so no shuffle
is keyed by (document, term). The only large shuffle of a fit is the one by term, after
map-side sums; a transform is map-only while the vocabulary fits in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewloom.functions.cleaning import WORD_CLASS
from reviewloom.storage import materialise

# A vocabulary row takes about 50 bytes in a task.
BROADCAST_TERMS = 1_000_000
# Tokens (or the vocabulary's size, if larger, as each look-up hashes it anew) a task works on at once, whatever the length of
# the texts in an Arrow batch: about 100 bytes each.
TOKENS_AT_ONCE = 1 << 19


@dataclass(frozen=True)
class TfidfSettings:
    max_features: int = 50_000
    min_df: int = 2
    max_df: float = 0.9


def tokenize(text: Column) -> Column:
    """Lower-cased runs of two or more word characters; no stop words."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD_CLASS}]{{2,}}"), F.lit(0))


def with_bigrams(tokens: Column) -> Column:
    """Tokens followed by adjacent pairs joined by a space."""
    n = F.size(tokens)
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(tokens, pairs)


def document_terms(df: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """(id, *keep, terms ARRAY<STRING>): unigrams and bigrams in text order."""
    return (
        df.select(id_col, *keep, tokenize(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
        .select(id_col, *keep, with_bigrams(F.col("tokens")).alias("terms"))
    )


def document_term_counts(df: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """(id, *keep, counts ARRAY<STRUCT<term, tf>>): run lengths of the sorted terms."""
    ordered = document_terms(df, id_col, text_col, keep).select(
        id_col, *keep, F.sort_array("terms").alias("s")
    )
    positions = F.sequence(F.lit(0), F.size("s") - 1)
    first_of_run = F.filter(
        positions, lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1))
    )
    runs = ordered.select(
        id_col, *keep, "s", F.when(F.size("s") > 0, first_of_run).otherwise(F.array().cast("array<int>")).alias("r")
    )
    counts = F.transform(
        "r",
        lambda start, k: F.struct(
            F.get("s", start).alias("term"),
            (F.coalesce(F.get("r", k + 1), F.size("s")) - start).alias("tf"),
        ),
    )
    return runs.select(id_col, *keep, counts.alias("counts"))


def term_frequency(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf)."""
    # The outer form keeps the optimiser from copying the whole term expression
    # into a size filter, where it would be evaluated once per element.
    return (
        document_term_counts(df, id_col, text_col)
        .select(id_col, F.inline_outer("counts"))
        .where(F.col("term").isNotNull())
    )


def _term_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df, cf) of the token lists of each slice of a batch: rows with the term, and its occurrences."""
    for batch in batches:
        for part in bounded_slices(batch, 0, TOKENS_AT_ONCE):
            lists = part.column(0)
            row, coded = np.repeat(np.arange(len(lists)), list_lengths(lists)), lists.flatten().dictionary_encode()
            words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            same = row[1:] == row[:-1]
            # Pairs as numbers: only those that differ are joined to strings.
            pairs, pair = np.unique(code[:-1][same] * len(words) + code[1:][same], return_inverse=True)
            left, right = (words.take(pa.array(half)) for half in np.divmod(pairs, max(1, len(words))))
            for terms, rows, place in ((words, row, code), (pc.binary_join_element_wise(left, right, " "), row[1:][same], pair)):
                size = max(1, len(terms))
                in_rows = np.bincount(np.unique(rows * size + place) % size, minlength=len(terms))
                counts = (in_rows, np.bincount(place, minlength=len(terms)))
                yield pa.RecordBatch.from_arrays([terms, *(pa.array(c, pa.int64()) for c in counts)], names=["term", "df", "cf"])


def document_frequency(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, df, cf): documents with the term, and its occurrences. Each row is a document, also if ids repeat."""
    tokens = df.select(tokenize(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    return (
        # Summed up in slices of many rows before anything is shuffled.
        tokens.mapInArrow(_term_sums, "term string, df long, cf long")
        .groupBy("term")
        .agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    )


def fit_vocabulary(
    train: DataFrame, id_col: str, text_col: str, settings: TfidfSettings = TfidfSettings()
) -> DataFrame:
    """(term, idx, df, cf, idf) of the kept terms.

    Terms in too few or too many documents go first; the most frequent
    ``max_features`` of the rest stay, equal counts in term order. ``idx`` follows
    term order.
    """
    # One-row subquery; every document counts, also an empty one.
    n_docs = train.select(F.count("*").alias("n_docs")).scalar()
    usable = (
        document_frequency(train, id_col, text_col)
        .withColumn("n_docs", n_docs)
        .where((F.col("df") >= settings.min_df) & (F.col("df") <= F.lit(settings.max_df) * F.col("n_docs")))
    )
    # Stored once: read for the histogram of frequencies and for the terms above its cut.
    usable = materialise(usable, "term-frequencies")
    # One row for each frequency that occurs; only the terms at the cut itself are ordered.
    upto = F.sum("n").over(Window.orderBy(F.desc("cf")))
    reached = usable.groupBy("cf").agg(F.count("*").alias("n")).select("cf", "n", upto.alias("upto"))
    cut = reached.where(F.col("upto") >= settings.max_features).orderBy(F.desc("cf")).first()
    if cut is None:
        kept = usable
    else:
        room = settings.max_features - (cut["upto"] - cut["n"])
        ties = usable.where(F.col("cf") == cut["cf"])
        ties = ties if room == cut["n"] else ties.orderBy("term").limit(room)
        kept = usable.where(F.col("cf") > cut["cf"]).unionByName(ties)
    return kept.select(
        "term",
        # One task, on at most max_features rows.
        (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"),
        "df",
        "cf",
        (F.log((F.lit(1) + F.col("n_docs")) / (F.lit(1) + F.col("df"))) + 1).alias("idf"),
    )


@dataclass(frozen=True)
class TermTable:
    """A vocabulary held by the tasks: terms in index order, their idf and extra numbers."""

    terms: pa.Array
    idf: np.ndarray
    extra: np.ndarray


def term_table(vocabulary: DataFrame, extra: Sequence[str] = (), most: int = BROADCAST_TERMS) -> TermTable | None:
    """The vocabulary as arrays if it has at most ``most`` terms (counted), else None."""
    if vocabulary.count() > most:
        return None
    table = vocabulary.select("term", "idx", "idf", *extra).toArrow().sort_by("idx").combine_chunks()
    columns = [table[c].to_numpy() for c in extra]
    return TermTable(
        table["term"].combine_chunks() if table.num_rows else pa.array([], pa.string()),
        table["idf"].to_numpy(),
        np.nan_to_num(np.stack(columns)) if columns else np.zeros((0, table.num_rows)),
    )


def list_lengths(lists: pa.ListArray) -> np.ndarray:
    """Entries of each list, none for null."""
    return np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)


def bounded_slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices whose lists have at most ``most`` entries together (a longer list is alone)."""
    upto = np.cumsum(list_lengths(batch.column(column)))
    start = 0
    while start < batch.num_rows:
        before = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _known_weights(tokens: pa.ListArray, table: TermTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in the vocabulary, weight) of the known terms of a batch, in that order."""
    words, row = tokens.flatten(), np.repeat(np.arange(len(tokens)), list_lengths(tokens))
    found, rows = [words], [row]
    if len(words) > 1:
        same = row[1:] == row[:-1]
        left, right = (words.slice(i, len(words) - 1).filter(pa.array(same)) for i in (0, 1))
        found.append(pc.binary_join_element_wise(left, right, " "))
        rows.append(row[1:][same])
    place = np.concatenate([pc.index_in(f, value_set=table.terms).fill_null(-1).to_numpy() for f in found]).astype(np.int64)
    row, size = np.concatenate(rows), max(1, len(table.terms))
    key, tf = np.unique((row * size + place)[place >= 0], return_counts=True)
    return key // size, key % size, (1 + np.log(tf)) * table.idf[key % size]


def map_rows(df: DataFrame, table: TermTable, id_col: str, text_col: str, keep: Sequence[str], output, schema: str) -> DataFrame:
    """Map-only pass: ``output(n, row, place, weight)`` gives the arrays named in ``schema`` for n rows."""
    kept = list(dict.fromkeys([id_col, *keep]))
    # Plain arrays: a broadcast, unlike a function, does not carry this package's classes to the workers.
    shared = df.sparkSession.sparkContext.broadcast((table.terms, table.idf, table.extra))

    def work(batches):
        held = TermTable(*shared.value)
        names = [*kept, *[part.strip().split()[0] for part in schema.split("; ")]]
        for batch in batches:
            place = batch.schema.get_field_index
            for part in bounded_slices(batch, place("__tokens"), max(TOKENS_AT_ONCE, len(held.terms))):
                arrays = output(part.num_rows, *_known_weights(part.column(place("__tokens")), held), held)
                yield pa.RecordBatch.from_arrays([*[part.column(place(c)) for c in kept], *arrays], names=names)

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    tokens = tokenize(F.coalesce(F.col(text_col), F.lit(""))).alias("__tokens")
    return df.select(*kept, tokens).mapInArrow(work, f"{fields}, {schema.replace('; ', ', ')}")


def _row_lists(n: int, row: np.ndarray, *values) -> list[pa.ListArray]:
    offsets = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]


#: Bits a term of the vocabulary takes in the filter, bits set for it, and the filter's most bits (8 MB).
FILTER_BITS, FILTER_HASHES, MOST_FILTER_BITS = 16, 4, 1 << 26


def _filter_places(term: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(term, F.lit(k)), F.lit(bits)) for k in range(FILTER_HASHES)]


def term_filter(vocabulary: DataFrame) -> Callable[[Column], Column]:
    """A Bloom filter of the vocabulary's terms: true for all of them, and for few others.

    The bits are set by an aggregate and reach the tasks as one array of at most 8 MB,
    whatever the size of the vocabulary; beyond four million terms more of the others pass.
    """
    bits = 64
    while bits < min(MOST_FILTER_BITS, FILTER_BITS * vocabulary.count()):
        bits *= 2
    place = vocabulary.select(F.explode(F.array(*_filter_places(F.col("term"), bits))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    words = place.groupBy(F.shiftright("p", 6).alias("id")).agg(F.bit_or(bit).alias("bits"))
    dense = vocabulary.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    whole = dense.agg(F.array_sort(F.collect_list(F.struct("id", "bits"))).alias("w")).select(F.col("w.bits")).scalar()

    def member(term: Column) -> Column:
        hits = [F.getbit(F.get(whole, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in _filter_places(term, bits)]
        return reduce(lambda a, b: a & b, hits)

    return member


def candidate_terms(df: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """(id, *keep, term, tf): the counted terms of each row that pass the vocabulary's filter, in the mapper.

    Every row also has one marker, a term of its own that no text has, so that markers spread over the tasks.
    """
    member, marker = term_filter(vocabulary), F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    counts = document_term_counts(df, id_col, text_col, keep)
    counts = counts.withColumn("counts", F.concat("counts", F.array(F.struct(marker.alias("term"), F.lit(0).alias("tf")))))
    term = F.col("term")
    return counts.select(id_col, *keep, F.inline_outer("counts")).where(term.startswith("\0") | member(term))


def known_terms(
    df: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = (), row_col: str = "__row"
) -> DataFrame:
    """(row, id, *keep, <vocabulary columns>, w): unnormalised weights of known terms.

    The form for vocabularies too large for a task: shuffled by term, without the terms that a
    filter of the vocabulary rules out in the mapper. ``row_col`` numbers the rows, so that rows with equal ids stay apart. Every document also has one row with a
    null term, so documents without any known term stay in the result.
    """
    df = df.withColumn(row_col, F.monotonically_increasing_id())
    keep = [*keep, row_col]
    joined = (
        candidate_terms(df, vocabulary, id_col, text_col, keep)
        .join(vocabulary.withColumn("__known", F.lit(True)), "term", "left")
        .where(F.col("__known") | F.col("term").startswith("\0"))
        .withColumn("term", F.when(F.col("__known"), F.col("term")))
    )
    return joined.withColumn("w", F.when(F.col("__known"), (1 + F.log("tf")) * F.col("idf"))).drop("__known", "tf")


def _unit_rows(df, vocabulary, id_col, text_col, keep) -> DataFrame:
    """(id, *keep, indices, values) by a shuffle, for a vocabulary too large for a task."""
    entry = F.when(F.col("w").isNotNull(), F.struct("idx", "w"))
    rows = (
        known_terms(df, vocabulary.select("term", "idx", "idf"), id_col, text_col, keep)
        .groupBy("__row", id_col, *keep)
        .agg(F.array_sort(F.collect_list(entry)).alias("e"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    )
    return rows.select(
        id_col, *keep, F.col("e.idx").alias("indices"), F.transform("e.w", lambda w: w / F.col("norm")).alias("values")
    )


def tfidf_vectors(
    df: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = (), broadcast_terms: int = BROADCAST_TERMS
) -> DataFrame:
    """(id, *keep, indices ARRAY<INT>, values ARRAY<DOUBLE>): unit-length sparse rows.

    Map-only up to ``broadcast_terms`` terms (counted), a shuffle by term beyond.
    """
    table = term_table(vocabulary, most=broadcast_terms)
    if table is None:
        return _unit_rows(df, vocabulary, id_col, text_col, keep)

    def unit(n, row, place, weight, _):
        norm = np.sqrt(np.bincount(row, weight * weight, n))
        return _row_lists(n, row, place.astype(np.int32), weight / norm[row])

    return map_rows(df, table, id_col, text_col, keep, unit, "indices array<int>; values array<double>")


def tfidf_weights(
    df: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str, broadcast_terms: int = BROADCAST_TERMS
) -> DataFrame:
    """Long form: (id, term, w) with unit rows."""
    rows = tfidf_vectors(df, vocabulary, id_col, text_col, broadcast_terms=broadcast_terms)
    entries = rows.select(id_col, F.inline(F.arrays_zip("indices", "values")).alias("idx", "w"))
    return entries.join(vocabulary.select("idx", "term"), "idx").select(id_col, "term", "w")


def ml_vectors(rows: DataFrame, size: int, path: str) -> DataFrame:
    """The same rows with a Spark ML sparse vector column ``features``.

    Written once to ``path`` in the layout of the vector type and read back as
    that type, so no row passes through Python and the iterative fit reads a
    stored table.
    """
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T

    stored = rows.withColumn(
        "features",
        F.struct(
            F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), "indices", "values"
        ),
    ).drop("indices", "values")
    stored.write.mode("overwrite").parquet(path)
    fields = [
        T.StructField("features", VectorUDT()) if f.name == "features" else f for f in stored.schema.fields
    ]
    return rows.sparkSession.read.schema(T.StructType(fields)).parquet(path)
