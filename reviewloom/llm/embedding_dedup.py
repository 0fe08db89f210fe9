"""Near-duplicate vectors by an exact metric range join.

Vectors are scaled to length one; cosine c corresponds to the distance r = sqrt(2 - 2c).
Vectors that are equal after scaling (to 12 decimals) are joined into one first. Pivots
of each label, a bounded sample, partition the rest: a vector's cell is that of its
nearest pivot. By the triangle inequality a partner of x in the cell of pivot j can only
exist if d(x, p_j) <= d(x, nearest pivot) + 2r, and only if d(x, p_j) <= r + the cell's
radius; x is copied there (to cells before its own, so that each pair meets once). Cells
are joined independently. A cell of more than ``cell_rows`` is cut into blocks and every
pair of blocks is a group of its own: no group is larger than two blocks, no pair is
lost. Copies are cut into blocks of their own, each compared with each block of the cell in a
group that compares home rows with copies only. Groups report link counts for each vector and a forest of links, not pairs.

Rows: vectors that are null, empty, zero or hold null or non-finite values, and
vectors without label, link with nothing; vectors of different size do not link; a null vec_id
takes part but is never the smallest; rows that repeat an id are vectors of their own. Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import Forest, components, mix64
from reviewloom.storage import materialise

CELL_ROWS, PIVOTS, TILE = 2_000, 32, 1_000


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``row``, ``vec_id``, ``label``, ``unit`` (null where a vector links with nothing) of every row."""
    kinds = {f: vectors.schema[f].dataType.simpleString() for f in ("vec_id", "label")}

    def work(batches):
        for batch in batches:
            units = []
            for values in batch.column(2).to_pylist():
                x = np.array(values or [], float) if values and None not in values else np.zeros(0)
                top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
                # Scaled by the largest value first: no overflow and no underflow to zero.
                units.append((x / top / np.linalg.norm(x / top)).tolist() if top > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.list_(pa.float64()))], names=["vec_id", "label", "unit"])

    own = vectors.select("vec_id", "label", "embedding").mapInArrow(work, f"vec_id {kinds['vec_id']}, label {kinds['label']}, unit array<double>")
    return own.withColumn("row", F.monotonically_increasing_id())


def choose_pivots(nodes: DataFrame, pivots: int) -> dict:
    """Pivots for each label (and vector size): about ``pivots`` by a hash of the node."""
    # A small label gives all it has, a large one about the given number.
    limit = F.least(F.lit(1_000_000), F.lit(1_000_000 * pivots) / F.col("count"))
    sizes = nodes.groupBy("label", "size").count()
    sample = nodes.join(F.broadcast(sizes), ["label", "size"]).where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < limit)
    found: dict = {}
    for r in sample.select("label", "size", "unit", "node").orderBy("node").collect():
        found.setdefault((r[0], r[1]), []).append(r[2])
    return {k: np.array(v) for k, v in found.items()}


def range_links(nodes: DataFrame, cosine: float, cell_rows: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """(``node``, ``n``: rows linked directly; links ``a``, ``b`` that join the components).

    ``nodes``: distinct ``node``, ``label``, ``size``, ``unit``, ``copies``.
    """
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-7
    centers = choose_pivots(nodes, pivots)
    # Nodes whose label has no pivot (none fell into the sample) share one cell.

    def distances(rows: list[dict]) -> list[np.ndarray]:
        """Distances of every row to the pivots of its label."""
        members: dict = {}
        for i, r in enumerate(rows):
            members.setdefault((r["label"], r["size"]), []).append(i)
        out = [np.zeros(1)] * len(rows)
        for key, own in members.items():
            if key in centers:
                unit = np.array([rows[i]["unit"] for i in own])
                found = np.sqrt(np.maximum(0.0, 2 - 2 * unit @ centers[key].T))
                for i, d in zip(own, found, strict=True):
                    out[i] = d
        return out

    def home(batches):
        for batch in batches:
            found = distances(batch.to_pylist())
            cells, far = [int(d.argmin()) for d in found], [float(d.min()) for d in found]
            arrays = [*batch.columns, pa.array(cells, pa.int32()), pa.array(far)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "cell", "far"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    placed = materialise(nodes.mapInArrow(home, f"{fields}, cell int, far double"), "vectors-in-cells")
    stats = placed.groupBy("label", "size", "cell").agg(F.max("far").alias("reach"), F.count("*").alias("n")).collect()
    reach = {(r[0], r[1], r[2]): r[3] for r in stats}
    blocks = {(r[0], r[1], r[2]): max(1, -(-r[4] // cell_rows)) for r in stats}

    def copied(r: dict, d: np.ndarray) -> list[int]:
        """Cells before its own that a row is copied to."""
        key = (r["label"], r["size"])
        return [j for j in range(r["cell"]) if (*key, j) in blocks and d[j] <= r["far"] + 2 * radius and d[j] <= reach[*key, j] + radius]

    def count_copies(batches):
        for batch in batches:
            rows = batch.to_pylist()
            found: dict = {}
            for r, d in zip(rows, distances(rows), strict=True):
                for j in copied(r, d):
                    found[r["label"], r["size"], j] = found.get((r["label"], r["size"], j), 0) + 1
            out = {"label": [k[0] for k in found], "size": [k[1] for k in found], "cell": [k[2] for k in found], "n": list(found.values())}
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("label", batch_type(label)), ("size", pa.int32()), ("cell", pa.int32()), ("n", pa.int64())]))

    label = nodes.schema["label"].dataType.simpleString()
    copies_in = placed.mapInArrow(count_copies, f"label {label}, size int, cell int, n long").groupBy("label", "size", "cell").agg(F.sum("n")).collect()
    copy_blocks = {(r[0], r[1], r[2]): -(-r[3] // cell_rows) for r in copies_in}

    def replicate(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = {k: [] for k in ("label", "size", "cell", "pair", "own", "node", "copies", "unit")}
            for r, d in zip(rows, distances(rows), strict=True):
                key = (r["label"], r["size"])
                spread = mix64(np.array([r["node"]], np.int64).view(np.uint64))[0]
                for j in [r["cell"], *copied(r, d)]:
                    n, m = blocks[*key, j], copy_blocks.get((*key, j), 0)
                    mine = int(spread % np.uint64(n))
                    if j == r["cell"]:  # at home: with every block of the cell, then with every block of copies
                        pairs = [(min(mine, b) * n + max(mine, b), 0 if mine == b else mine) for b in range(n)]
                        pairs += [(n * n + mine * m + b, 0) for b in range(m)]
                    else:  # a copy: its block with every block of the cell
                        own = int(spread % np.uint64(m))
                        pairs = [(n * n + a * m + own, -1) for a in range(n)]
                    for pair, own in pairs:
                        for k, v in zip(out, (r["label"], r["size"], j, pair, own, r["node"], r["copies"], r["unit"]), strict=True):
                            out[k].append(v)
            for a in range(0, len(out["node"]), 4096):
                yield pa.RecordBatch.from_pydict({k: v[a : a + 4096] for k, v in out.items()}, schema=target)

    schema = f"label {label}, size int, cell int, pair int, own int, node long, copies long, unit array<double>"
    target = pa.schema([
        ("label", batch_type(label)), ("size", pa.int32()), ("cell", pa.int32()), ("pair", pa.int32()), ("own", pa.int32()),
        ("node", pa.int64()), ("copies", pa.int64()), ("unit", pa.list_(pa.float64())),
    ])

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", ignore_index=True)
        unit, node, copies, own = np.stack(frame["unit"]), frame["node"].to_numpy(), frame["copies"].to_numpy(), frame["own"].to_numpy()
        n = blocks[frame["label"].iloc[0], int(frame["size"].iloc[0]), int(frame["cell"].iloc[0])]
        pair = frame["pair"].iloc[0]
        diagonal = pair < n * n and pair // n == pair % n
        count, forest, links = np.zeros(len(frame), np.int64), Forest(), []
        for a in range(0, len(frame), TILE):
            for b in range(a, len(frame), TILE):
                close = unit[a : a + TILE] @ unit[b : b + TILE].T >= cosine
                x, y = np.nonzero(close)
                x, y = x + a, y + b
                good = x < y
                if not diagonal:
                    good &= own[x] != own[y]
                x, y = x[good], y[good]
                np.add.at(count, x, copies[y]), np.add.at(count, y, copies[x])
                links += forest.add(node[x], node[y])
        linked = np.flatnonzero(count)
        return pd.DataFrame({
            "node": np.concatenate([node[linked], [a for a, _ in links]]).astype(np.int64),
            "n": np.concatenate([count[linked], np.zeros(len(links))]).astype(np.int64),
            "other": pd.array([None] * len(linked) + [b for _, b in links], dtype="Int64"),
        })

    groups = placed.mapInArrow(replicate, schema).groupBy("label", "size", "cell", "pair")
    found = materialise(groups.applyInPandas(join, "node long, n long, other long"), "vector-links")
    degrees = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    return degrees, found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))


def batch_type(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]


def vector_components(vectors: DataFrame, cosine: float = 0.98, cell_rows: int = CELL_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row."""
    rows = materialise(unit_vectors(vectors), "unit-vectors")
    usable = rows.where("unit is not null and label is not null")
    spelled = F.transform("unit", lambda v: F.round(v, 12) + 0.0)
    keyed = usable.withColumn("node", F.xxhash64("label", spelled))
    nodes = keyed.groupBy("node").agg(
        F.first("label").alias("label"), F.first(F.size("unit")).alias("size"), F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("low")
    )
    nodes = materialise(nodes, "vector-nodes")
    degrees, links = range_links(nodes.drop("low"), cosine, cell_rows, pivots)
    rooted = nodes.join(components(links, "vectors"), "node", "left").join(degrees, "node", "left").select(
        "node", "low", F.coalesce("root", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    found = rooted.join(least, "root").select("node", "n_links", "component_id")
    linked = keyed.select("vec_id", "node").join(found, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("unit is null or label is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast(linked.schema["component_id"].dataType).alias("component_id"))
    return linked.unionByName(alone).withColumn("component_id", F.col("component_id").cast("long")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
