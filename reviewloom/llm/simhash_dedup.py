"""Near-duplicate documents by SimHash with deletion-variant signatures.

A fingerprint is cut into segments, few enough that of two linked fingerprints at
least one segment differs by at most one bit (k differing bits: k // 2 + 1 segments).
Every segment is indexed whole, and once for each of its bits with that bit left out; equal
variants meet by an equality shuffle, and the whole fingerprints are compared there: all
of them where segments are equal, only those on both sides of the left-out bit elsewhere, so
that copies with equal segments are compared once and not under each of its bits.
Tasks report a forest of their links, never all pairs of a group.

Rows: null and empty texts have no words and the fingerprint zero; repeated rows and
equal texts are collapsed before the index; a null doc_id takes part, but is never
the smallest one. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import Forest, byte_column, components, majority_bits, mix64, runs
from reviewloom.storage import materialise

GROUP_ROWS = 20_000
SMALL_RUN = 48


def shingle_fingerprint(data: bytes, size: int, seed: int) -> int:
    """Majority fingerprint of the XXH64 of all shingles of ``size`` words, repeats included."""
    words = data.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < size:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - size] + 1)).tolist()
    values = [digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]
    return majority_bits(np.array(values, np.uint64))


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) of every row."""

    def work(batches):
        for batch in batches:
            fps = [shingle_fingerprint(x, size, seed) for x in byte_column(batch, "text")]
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def word_hashes(data: bytes) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words := data.lower().split()), np.uint64, len(words))


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the distinct shingles of ``size`` words; of fewer words, of the whole sequence in its order."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    shingle = np.zeros(len(hashes) - size + 1, np.uint64)
    for j in range(size):
        shingle = mix64(shingle * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(shingle)])
    return np.unique(shingle)


def similarity_prints(hashes: np.ndarray, shingle: np.ndarray) -> list[int]:
    """Two prints of the distinct words, three of the distinct shingles."""
    distinct = np.unique(hashes)
    salts = [np.uint64(x) for x in (0, 0x1B873593CC9E2D51)], [np.uint64(x) for x in (0, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85)]
    return [majority_bits(mix64(distinct ^ s)) for s in salts[0]] + [majority_bits(mix64(shingle ^ s)) for s in salts[1]]


def link_forest(nodes: DataFrame, prints: list[str], segments: list[tuple[int, int, int]], tests: list[str],
                max_bits: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links between nodes whose ``tests`` differ in at most ``max_bits`` bits.

    ``nodes``: distinct ``node`` with long columns. ``segments``: (index in ``prints``,
    shift, width). A segment value held by more than half of ``group_rows`` nodes (at
    most 2 x segments x nodes / group_rows values, listed on the driver) is cut
    into blocks of nodes; every pair of blocks is a group of its own, so that a group has
    at most about twice ``group_rows`` rows and no pair is lost.
    """
    values = F.array(*[
        F.struct(F.lit(s).alias("s"), F.shiftrightunsigned(F.col(prints[p]), shift).bitwiseAND(F.lit((1 << width) - 1)).alias("v"))
        for s, (p, shift, width) in enumerate(segments)
    ])
    counted = nodes.select(F.explode(values).alias("x")).groupBy("x.s", "x.v").count().where(F.col("count") > group_rows // 2)
    heavy = {(r[0], r[1]): r[2] for r in counted.collect()}
    columns = ["node", *dict.fromkeys(prints + tests)]
    tested = list(dict.fromkeys(tests))

    def variants(batches):
        for batch in batches:
            own = {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in columns}
            node = own["node"]
            keys, cells, rows, sides = [], [], [], []

            def put(key, cell, row, side):
                keys.append(key), cells.append(cell), rows.append(row), sides.append(side)

            base = 0
            for s, (p, shift, width) in enumerate(segments):
                value = (own[prints[p]].view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                count = np.array([heavy.get((s, v), 0) for v in value.tolist()]) if heavy else np.zeros(len(value), np.int64)
                for bit in range(width + 1):  # the last one leaves no bit out
                    flag = np.uint64(1 << bit) if bit < width else np.uint64(0)
                    key = (np.uint64(base + bit) << np.uint64(40)) | (value & ~flag)
                    side = ((value & flag) != 0).astype(np.int8) if bit < width else np.full(len(value), 2, np.int8)
                    total = count
                    if heavy and bit < width:
                        total = count + np.array([heavy.get((s, v), 0) for v in (value ^ flag).tolist()])
                    blocks = 1 + total // group_rows
                    single = np.flatnonzero(blocks == 1)
                    put(key[single], np.zeros(len(single), np.int32), single, side[single])
                    for i in np.flatnonzero(blocks > 1).tolist():
                        n = int(blocks[i])
                        mine = int(mix64(node[i : i + 1].view(np.uint64))[0] % np.uint64(n))
                        pair = [min(mine, j) * n + max(mine, j) for j in range(n)]
                        put(np.full(n, key[i]), np.array(pair, np.int32), np.full(n, i), np.full(n, side[i]))
                base += width + 1
            key, cell, row, side = np.concatenate(keys).view(np.int64), np.concatenate(cells), np.concatenate(rows), np.concatenate(sides)
            for a in range(0, len(key), 1 << 16):
                to = slice(a, a + (1 << 16))
                arrays = [key[to], cell[to], side[to], node[row[to]], *[own[c][row[to]] for c in tested]]
                names = ["key", "cell", "side", "node_id", *[f"t{i}" for i in range(len(tested))]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)

    schema = "key long, cell int, side byte, node_id long, " + ", ".join(f"t{i} long" for i in range(len(tested)))

    def links(batches):
        forest = Forest()
        for whole in runs(batches, ("key", "cell")):
            key, cell, side, node = (whole[c].to_numpy() for c in ("key", "cell", "side", "node_id"))
            test = np.stack([whole[f"t{i}"].to_numpy().view(np.uint64) for i in range(len(tested))])
            a, b = linked(key, cell, side, test, max_bits)
            pairs = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])]), axis=1)
            new = forest.add(*pairs)
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*new, strict=True)], names=["a", "b"])

    rows = nodes.select(*columns).mapInArrow(variants, schema)
    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(links, "a long, b long")


def distance(test: np.ndarray, a, b) -> np.ndarray:
    return sum(np.bitwise_count(test[i][a] ^ test[i][b]).astype(np.int16) for i in range(len(test)))


def linked(key: np.ndarray, cell: np.ndarray, side: np.ndarray, test: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal (key, cell): all of them in short runs, a spanning forest in long ones.

    Rows of side 0 are compared with those of side 1, rows of side 2 with each other.
    """
    n = len(key)
    start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))))
    size = np.diff(np.concatenate((start, [n])))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    short = size <= SMALL_RUN
    # Rows of short runs against the row d places on, for growing d.
    last = np.repeat(np.where(short, start + size, 0), size)
    alive = np.flatnonzero(last > np.arange(n) + 1)
    d = 1
    while len(alive):
        pair = alive[(side[alive] == 2) | (side[alive] != side[alive + d])]
        close = distance(test, pair, pair + d) <= max_bits
        left.append(pair[close]), right.append(pair[close] + d)
        d += 1
        alive = alive[last[alive] > alive + d]
    for s, m in zip(start[~short].tolist(), size[~short].tolist(), strict=True):
        rows = np.arange(s, s + m)
        if side[s] == 2:
            waiting = {2: rows}
        else:
            waiting = {k: rows[side[rows] == k] for k in (0, 1)}
            if not len(waiting[0]) or not len(waiting[1]):
                continue
        partner = {0: 1, 1: 0, 2: 2}
        first = next(iter(waiting))
        while len(waiting[first]):  # every link has an end on this side
            front, waiting[first] = [int(waiting[first][0])], waiting[first][1:]
            while front:
                x = front.pop()
                k = partner[int(side[x])]
                if not len(waiting[k]):
                    continue
                close = distance(test, waiting[k], x) <= max_bits
                found, waiting[k] = waiting[k][close], waiting[k][~close]
                left.append(np.full(len(found), x)), right.append(found)
                front += found.tolist()
    return np.concatenate(left), np.concatenate(right)


SEGMENTS_64 = [(0, 0, 22), (0, 22, 21), (0, 43, 21)]
#: Segments of the two prints of distinct words, 20 bits each.
SEGMENTS_WORDS = [(0, 0, 20), (0, 20, 20), (1, 0, 20), (1, 20, 20)]


def labelled(nodes: DataFrame, edges: DataFrame, low: str) -> DataFrame:
    """``node``, ``component`` (smallest ``low`` of the node's component)."""
    linked_nodes = components(edges, "simhash")
    rooted = nodes.join(linked_nodes, "node", "left").select("node", low, F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min(low).alias("component_id"))
    return rooted.join(least, "root").select("node", "root", "component_id")


def simhash_components(docs: DataFrame, size: int = 4, max_bits: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint``, ``component_id`` of every row (links: up to 4 differing bits)."""
    if max_bits // 2 + 1 > len(SEGMENTS_64):
        raise ValueError(f"three segments cover at most 5 bits, not {max_bits}")
    prints = materialise(fingerprints(docs, size), "simhash-prints")
    nodes = materialise(prints.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("low")), "simhash-nodes")
    keyed = nodes.select("node", F.col("node").alias("fp"))
    edges = link_forest(keyed, ["fp"], SEGMENTS_64, ["fp"], max_bits)
    found = labelled(nodes, edges, "low")
    return prints.join(found, prints["fp"] == found["node"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


#: Shingles of a block of a cluster, what every node adds to them, and the keys that may be broadcast.
BLOCK_SHINGLES, NODE_WEIGHT, BROADCAST_KEYS = 400_000, 200, 1_000_000
#: A shingle of so many nodes of a group is counted by a matrix product, a rarer one by listing its pairs.
COMMON = 32


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of shared shingles of every set of ``left`` with every set of ``right``."""
    shape = (len(left), len(right))
    rows = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)]
    values, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    columns = place[: len(rows[0])], place[len(rows[0]) :]
    held = [np.bincount(c, minlength=len(values)) for c in columns]
    both = (held[0] > 0) & (held[1] > 0)
    counts = np.zeros(shape, np.float32)
    common = np.flatnonzero(both & (np.minimum(*held) > COMMON))
    for start in range(0, len(common), 2048):
        part = np.full(len(values), -1)
        part[common[start : start + 2048]] = np.arange(len(common[start : start + 2048]))
        sides = []
        for n, row, column in zip(shape, rows, columns, strict=True):
            own = part[column] >= 0
            dense = np.zeros((n, min(2048, len(common) - start)), np.float32)
            dense[row[own], part[column[own]]] = 1
            sides.append(dense)
        counts += sides[0] @ sides[1].T
    rare = both.copy()
    rare[common] = False
    ordered = []
    for row, column in zip(rows, columns, strict=True):
        own = np.flatnonzero(rare[column])
        own = own[np.argsort(column[own], kind="stable")]
        ordered.append((row[own], column[own]))
    (row_a, column_a), (row_b, column_b) = ordered
    first = np.searchsorted(column_b, column_a)
    partners = held[1][column_a] if len(column_a) else np.zeros(0, np.int64)
    flat = counts.reshape(-1)
    for start in range(0, len(row_a), 1 << 15):
        n = partners[start : start + (1 << 15)]
        at = np.repeat(first[start : start + (1 << 15)] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell, times = np.unique(np.repeat(row_a[start : start + (1 << 15)], n) * shape[1] + row_b[at], return_counts=True)
        flat[cell] += times
    return counts


def spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """A forest (row, column) of the links between rows and columns of a boolean matrix."""
    rows, columns = np.ones(links.shape[0], bool), np.ones(links.shape[1], bool)
    out = []
    for start in np.flatnonzero(links.any(axis=1)).tolist():
        if not rows[start]:
            continue
        rows[start] = False
        front = [(0, start)]
        while front:
            side, x = front.pop()
            waiting, line = (columns, links[x]) if side == 0 else (rows, links[:, x])
            new = np.flatnonzero(line & waiting)
            waiting[new] = False
            out += [(x, y) if side == 0 else (y, x) for y in new.tolist()]
            front += [(1 - side, y) for y in new.tolist()]
    return out


def spanning_within(links: np.ndarray) -> list[tuple[int, int]]:
    """A forest of the links of a symmetric matrix, whose rows and columns are the same nodes."""
    waiting, out = np.ones(len(links), bool), []
    for start in range(len(links)):
        if not waiting[start]:
            continue
        waiting[start] = False
        front = [start]
        while front:
            x = front.pop()
            new = np.flatnonzero(links[x] & waiting).tolist()
            waiting[new] = False
            out += [(x, y) for y in new]
            front += new
    return out


def alike(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which sets of ``left`` and ``right`` have at least the given Jaccard similarity."""
    shared = shared_counts(left, right)
    total = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    # shared / (total - shared) >= similarity
    return shared * (1 + similarity) >= similarity * total - 1e-6


def verified(candidates: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, similarity: float,
             block_shingles: int = BLOCK_SHINGLES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """A forest ``a``, ``b`` of the links: pairs of nodes of one cluster whose sets of shingles have the similarity.

    ``candidates``: edges that join the nodes of a cluster; ``nodes``: ``node``, number of shingles ``n`` and the
    ``text_key`` of one of its texts. Every pair inside a cluster is compared, and none leaves the task
    that compares it: a large cluster is cut into blocks of bounded weight, every pair of
    blocks is a group, and a group reports a spanning forest of its links.
    """
    clusters = materialise(components(candidates, "similar"), "similar-clusters")
    weighed = clusters.join(nodes, "node").select("node", F.col("root").alias("cluster"), "text_key", (F.col("n") + NODE_WEIGHT).alias("weight"))
    weighed = materialise(weighed, "similar-weights")
    blocks = weighed.groupBy("cluster").agg(F.ceil(F.sum("weight") / block_shingles).cast("int").alias("blocks"))
    # Stored, so that the join reads two plain tables and a hot cluster can be split.
    blocks = materialise(blocks.where("blocks > 1"), "similar-blocks")
    placed = weighed.join(blocks, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node", F.lit(17)), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j")))
    placed = placed.select("node", "text_key", "cluster", own.alias("own"), F.explode(pairs).alias("g")).select("node", "text_key", "cluster", "own", "g.i", "g.j")

    def one_each(batches):
        for batch in batches:
            _, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            yield batch.take(pa.array(np.sort(first)))

    def sets(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                shingles = [shingle_set(word_hashes(x), size).tobytes() for x in byte_column(part, "text")]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shingles, pa.binary())], names=["text_key", "shingles"])

    needed = weighed.select("text_key").distinct()
    if weighed.count() <= broadcast_keys:
        # Eight bytes for each key, counted.
        needed = F.broadcast(needed)
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").join(needed, "text_key", "left_semi")
    texts = texts.mapInArrow(one_each, "text_key long, text string").mapInArrow(sets, "text_key long, shingles binary")
    found = materialise(texts.dropDuplicates(["text_key"]), "similar-sets")

    def links(batches):
        group, rows = None, []

        def forest():
            i, j = group[1:]
            sides = [[r for r in rows if r[0] == k] for k in (i, j)]
            left, right = ([np.frombuffer(r[2], np.uint64) for r in side] for side in sides)
            close = alike(left, right, similarity)
            new = spanning_within(close) if i == j else spanning(close)
            return [(sides[0][x][1], sides[1][y][1]) for x, y in new]

        def batch(new):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*new, strict=True)], names=["a", "b"])

        for part in batches:
            for cluster, i, j, own, node, shingles in zip(*[part.column(c).to_pylist() for c in range(6)], strict=True):
                if group != (cluster, i, j):
                    if len(rows) > 1 and (new := forest()):
                        yield batch(new)
                    group, rows = (cluster, i, j), []
                rows.append((own, node, shingles))
        if len(rows) > 1 and (new := forest()):
            yield batch(new)

    grouped = placed.join(found, "text_key").select("cluster", "i", "j", "own", "node", "shingles")
    grouped = grouped.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return materialise(grouped.mapInArrow(links, "a long, b long"), "similar-links")


def similar_components(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id``, ``text_key``, ``root``, ``component_id``: documents alike in their word shingles.

    Clusters of candidates come from deletion variants of prints of the distinct words, which a few
    changed words hardly move; two nodes are candidates if their 192-bit prints of the distinct shingles differ
    by at most 3.2 standard deviations more bits than sets of that similarity do on average. Only a
    forest of the candidates is kept, as it joins the same clusters. Inside a cluster every pair is
    compared by its exact sets of shingles; a link has at least the given Jaccard similarity. Texts
    of fewer words than a shingle are one shingle, the whole sequence. ``text_key`` is Spark's hash of the
    text, ``root`` names the group; one line for each row.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    most_bits = int(np.ceil(192 * share + 3.2 * np.sqrt(192 * share * (1 - share))))
    names = ["node", "w0", "w1", "s0", "s1", "s2", "n"]

    def work(batches):
        for batch in batches:
            rows = []
            for data in byte_column(batch, "text"):
                hashes = word_hashes(data)
                shingle = shingle_set(hashes, size)
                node = xxhash.xxh64_intdigest(hashes.tobytes(), 7)
                rows.append([node, *similarity_prints(hashes, shingle), len(shingle)])
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text_key")]
            values = np.array(rows, np.uint64).reshape(-1, len(names)).T.view(np.int64)
            arrays = [*kept, *[pa.array(np.ascontiguousarray(v)) for v in values]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key long, " + ", ".join(f"{n} long" for n in names)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    prints = materialise(texts.mapInArrow(work, schema), "similar-prints")
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("low"), *[F.min(c).alias(c) for c in [*names[1:], "text_key"]])
    nodes = materialise(nodes, "similar-nodes")
    candidates = link_forest(nodes, ["w0", "w1"], SEGMENTS_WORDS, ["s0", "s1", "s2"], most_bits)
    edges = verified(candidates, nodes.select("node", "n", "text_key"), docs, size, similarity)
    return prints.join(labelled(nodes, edges, "low"), "node").select("doc_id", "text_key", "root", "component_id")


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their group, one for each group.

    A group in which no row has an id keeps one of its rows. Rows that repeat an id
    within a group are told apart by nothing; any one of them stays.
    """
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("doc_id", "text_key", "root").count()
    several = first.groupBy("root").agg(F.sum("count").alias("rows"))
    first = first.join(several, "root").select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("root").alias("__root"), F.col("rows").alias("__rows")
    )
    first = materialise(first, "similar-first")
    hit = docs["doc_id"].eqNullSafe(first["__id"]) & (F.xxhash64(docs["text"]) == first["__key"])
    kept = docs.join(first, hit)
    alone = kept.where("__rows = 1")
    repeated = kept.where("__rows > 1").dropDuplicates(["__root"])
    return alone.union(repeated).select(*docs.columns)
