"""Linear classifiers: logistic by Spark ML, squared hinge by full-batch gradients.

Spark ML has no squared-hinge model. One pass over the stored feature rows yields loss and gradient of every open
problem at once: all grid values of C, or all calibration folds, share each
scan. A pass takes as many tasks as the rows are worth, up to the cores; the vectors of the tasks are added up slice by
slice on the executors, and the driver gets one sum, as long as the vocabulary for each problem. Where the shared folder is
a local or mounted one, passes map the rows from files, so that no pass carries them through a socket. Logistic candidates are
independent Spark ML fits, run side by side on shares of the cores.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid
import warnings
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.evaluation import best_setting, classification_metrics
from reviewloom.operators.features import BROADCAST_TERMS, bounded_slices, list_lengths, ml_vectors
from reviewloom.operators.linear import long_predictions, vector_margins
from reviewloom.operators.lineage import refuse_split
from reviewloom.operators.splitting import FOLDS, SEED, stratified_folds
from reviewloom.storage import local_folder, scratch_path

# The grid, and the iteration limits of the two models.
C_GRID = (0.01, 0.1, 1.0, 10.0, 30.0, 100.0, 300.0)
MAX_ITERATIONS = {"logistic": 1000, "squared_hinge": 5000}
# Gradient norm relative to the start, about the default of common solvers.
TOLERANCE = 5e-5
#: Non-zero features a task works through in a pass; fewer rows get fewer tasks, as a pass lasts milliseconds.
NONZEROS_PER_TASK = 1_000_000
#: Non-zero features of a stored block (its arrays stay in a core's cache), and the most of a task (about a gigabyte).
NONZEROS_PER_BLOCK, MOST_NONZEROS_PER_TASK = 1 << 17, 1 << 26
#: Sums of a pass that have at most so many bytes in all go straight to the driver, larger ones are added up before.
STRAIGHT_BYTES = 1 << 19
#: Logistic fits that run at the same time.
CONCURRENT_FITS = 4
#: Spark ML's own tolerance for each unit of ours: 1e-6 at the default.
ML_TOLERANCE = 0.02


@dataclass(frozen=True)
class Problem:
    """One fit: its name, penalty, and the fold it must not see (if any)."""

    name: str
    c: float
    held_out: int | None = None


@dataclass
class Fit:
    name: str
    c: float
    weights: np.ndarray
    intercept: float
    loss: float
    iterations: int
    converged: bool
    passes: int = 0
    #: Wall seconds of the fit; in shared passes, its share of each.
    seconds: float = 0.0


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Blocks of sparse rows as arrays: label sign, fold and number of entries of the rows, then all entries."""
    for batch in batches:
        for part in bounded_slices(batch, batch.schema.get_field_index("indices"), NONZEROS_PER_BLOCK):
            yield {
                "y": np.where(part.column("label").to_numpy() == 1, 1.0, -1.0),
                "fold": part.column("fold").to_numpy().astype(np.int32),
                "n": list_lengths(part.column("indices")).astype(np.int32),
                "idx": part.column("indices").flatten().to_numpy(),
                "val": part.column("values").flatten().to_numpy(),
            }


_KINDS = (("y", np.float64), ("fold", np.int32), ("n", np.int32), ("idx", np.int32), ("val", np.float64))
_STORED = pa.schema([(name, pa.list_(pa.from_numpy_dtype(kind))) for name, kind in _KINDS])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks as plain buffers: one row per Arrow batch."""
    for block in _blocks_of(batches):
        yield pa.RecordBatch.from_pydict({name: pa.array([b.tobytes()], pa.binary()) for name, b in block.items()})


def _unpack(blocks) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of the blocks, the form that is kept: they are read in every pass, and arrays are pickled as they lie in memory."""
    for block in blocks:
        yield tuple(np.frombuffer(block[name], kind) for name, kind in _KINDS)


def _write_blocks(folder: str) -> Callable:
    """Blocks of a task in one Arrow file of their own, a block for each record batch; gives (part, file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A name for each attempt: what a lost attempt has left is never read.
        name = f"{folder}/{uuid.uuid4().hex}.arrow"
        with pa.OSFile(name, "wb") as out, pa.ipc.new_file(out, _STORED) as stored:
            for block in _blocks_of(batches):
                lists = [pa.ListArray.from_arrays(pa.array([0, len(b)], pa.int32()), pa.array(b)) for b in block.values()]
                stored.write_batch(pa.RecordBatch.from_arrays(lists, schema=_STORED))
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [name]})

    return run


def _map_blocks(names: Iterator[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of the stored blocks, without a copy: the pages are those of the file."""
    for name in names:
        with pa.memory_map(name) as source:
            stored = pa.ipc.open_file(source)
            for i in range(stored.num_record_batches):
                yield tuple(column.flatten().to_numpy() for column in stored.get_batch(i).columns)


def _losses(signed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared hinge loss and its derivative by the signed margin y * (w.x + b)."""
    gap = np.maximum(0.0, 1.0 - signed)
    return gap * gap, -2.0 * gap


def _partial_sums(held_out: Sequence[int | None], weights) -> Callable:
    """(loss, gradient, intercept gradient) per problem, summed over one partition."""

    def run(blocks) -> Iterator[np.ndarray]:
        w = weights.value  # (problems, d + 1), intercept last
        d = w.shape[1] - 1
        total = np.zeros((w.shape[0], d + 2))
        for y, fold, n, idx, val in blocks:
            # Converted once for all problems, as counting takes whole words; products lie in one buffer.
            idx, product = idx.astype(np.intp), np.empty(len(val))
            filled = np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[filled]
            for p in range(w.shape[0]):
                # This mode spares a copy of the result and a comparison; every index is within the vocabulary.
                np.multiply(val, w[p].take(idx, out=product, mode="wrap"), out=product)
                margin = np.full(len(y), w[p][d])
                if len(filled):
                    margin[filled] += np.add.reduceat(product, starts)
                loss, slope = _losses(y * margin)
                if held_out[p] is not None:
                    seen = fold != held_out[p]
                    loss, slope = loss * seen, slope * seen
                pull = slope * y
                total[p, 0] += loss.sum()
                np.multiply(val, np.repeat(pull, n), out=product)
                total[p, 1 : d + 1] += np.bincount(idx, weights=product, minlength=d)
                total[p, d + 1] += pull.sum()
        yield total

    return run


def _add_up(blocks, run: Callable, n_bytes: int) -> np.ndarray:
    """Sum of the partitions' arrays of about ``n_bytes`` each, always in the order of the partitions.

    Larger ones meet slice by slice on the executors, so that the driver gets one sum whatever the number of tasks.
    """
    n = blocks.getNumPartitions()
    if n == 1 or n * n_bytes <= STRAIGHT_BYTES:
        return blocks.mapPartitions(run).reduce(np.add)

    def cut(i, part):
        for total in run(part):
            for k, piece in enumerate(np.array_split(total, n, axis=-1)):
                yield k, (i, piece)

    def add(pieces):
        ordered = sorted(((k, i, piece) for k, (i, piece) in pieces), key=lambda x: x[:2])
        if ordered:
            yield ordered[0][0], reduce(np.add, [piece for _, _, piece in ordered])

    sums = blocks.mapPartitionsWithIndex(cut).partitionBy(n, int).mapPartitions(add)
    found = dict(sums.collect())
    sums.cleanShuffleDependencies()  # or the files of all passes wait for the driver's next collection
    return np.concatenate([found[k] for k in range(n)], axis=-1)


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    """Inner product without BLAS: its threads gain nothing at these lengths, and wait spinning on cores that tasks use."""
    return float(np.einsum("i,i->", a, b))


def _norm(a: np.ndarray) -> float:
    return _dot(a, a) ** 0.5


class _Lbfgs:
    """State of one minimisation, advanced one evaluation at a time."""

    # Long memory: a pass over the data costs far more than a vector on the driver.
    MEMORY = 30

    def __init__(self, problem: Problem, penalised: np.ndarray, tolerance: float, max_iterations: int):
        self.problem = problem
        self.mask = penalised
        self.tolerance = tolerance
        self.max_iterations = max_iterations
        self.point = np.zeros(len(penalised))
        self.trial = self.point
        self.value = np.inf
        self.gradient = None
        self.history: list[tuple[np.ndarray, np.ndarray]] = []
        self.iterations = 0
        self.passes = 0
        self.seconds = 0.0
        self.done = False
        self.converged = False

    def _objective(self, sums: np.ndarray) -> tuple[float, np.ndarray]:
        held = self.trial * self.mask
        return (
            0.5 * _dot(held, held) + self.problem.c * sums[0],
            held + self.problem.c * sums[1:],
        )

    def _direction(self) -> np.ndarray:
        q = self.gradient.copy()
        kept = []
        for s, g in reversed(self.history):
            a = _dot(s, q) / _dot(g, s)
            q -= a * g
            kept.append(a)
        if self.history:
            s, g = self.history[-1]
            q *= _dot(s, g) / _dot(g, g)
        for (s, g), a in zip(self.history, reversed(kept)):
            q += s * (a - _dot(g, q) / _dot(g, s))
        return -q

    def _start_search(self) -> None:
        self.direction = self._direction()
        self.slope = _dot(self.gradient, self.direction)
        if self.slope >= 0:  # stale curvature: fall back to steepest descent
            self.history.clear()
            self.direction = -self.gradient
            self.slope = -_dot(self.gradient, self.gradient)
        self.low, self.high = 0.0, np.inf
        self.step = 1.0 if self.history else 1.0 / max(1.0, _norm(self.gradient))
        self.trial = self.point + self.step * self.direction

    def feed(self, sums: np.ndarray) -> None:
        """Take the sums at ``trial``; choose the next trial or stop."""
        self.passes += 1
        value, gradient = self._objective(sums)
        if self.gradient is None:
            self.value, self.gradient = value, gradient
            self.scale = max(_norm(gradient), 1e-300)
            self._check()
            return
        # Weak Wolfe conditions by bisection.
        if value > self.value + 1e-4 * self.step * self.slope:
            self.high = self.step
        elif _dot(gradient, self.direction) < 0.9 * self.slope:
            self.low = self.step
        else:
            self._accept(value, gradient)
            return
        if self.high - self.low < 1e-12 * max(1.0, self.low):
            self.done = True  # no further progress in floating point
            return
        self.step = (self.low + self.high) / 2 if np.isfinite(self.high) else 2 * self.low
        self.trial = self.point + self.step * self.direction

    def _accept(self, value: float, gradient: np.ndarray) -> None:
        s, g = self.trial - self.point, gradient - self.gradient
        if _dot(s, g) > 1e-12 * _dot(g, g):
            self.history = [*self.history[1 - self.MEMORY :], (s, g)]
        self.point, self.value, self.gradient = self.trial, value, gradient
        self.iterations += 1
        self._check()

    def _check(self) -> None:
        self.converged = bool(_norm(self.gradient) <= self.tolerance * self.scale)
        if self.converged or self.iterations >= self.max_iterations:
            self.done = True
        else:
            self._start_search()

    def result(self) -> Fit:
        return Fit(
            self.problem.name, self.problem.c, self.point[:-1], float(self.point[-1]),
            self.value, self.iterations, self.converged, self.passes, self.seconds,
        )


def _checked_label():
    wrong = F.concat(F.lit("labels of a fit must be 0 or 1, found "), F.coalesce(F.col("label").cast("string"), F.lit("null")))
    return F.when(F.col("label").isin(0, 1), F.col("label")).otherwise(F.raise_error(wrong)).alias("label")


def _tasks_for(rows: DataFrame, problems: int = 1, beside: int = 1) -> int:
    """Tasks that a pass over the rows is worth, for so many problems at once; ``beside`` such passes share the cores."""
    nonzeros = rows.agg(F.sum(F.size("indices")).cast("long")).first()[0] or 0
    # More tasks than cores would only make more vectors to add up.
    most = max(-(-rows.sparkSession.sparkContext.defaultParallelism // beside), -(-nonzeros // MOST_NONZEROS_PER_TASK))
    return max(1, min(most, -(-nonzeros * problems // NONZEROS_PER_TASK)))


def side_by_side(spark, work: Callable, items: Sequence, most: int = CONCURRENT_FITS) -> list:
    """``work`` on every item from its own thread, each in a fair-scheduler pool of its own (which counts where the cluster schedules fairly)."""

    def run(numbered):
        i, item = numbered
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{i}")
        try:
            return work(item)
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    if len(items) == 1:
        return [work(items[0])]
    with ThreadPoolExecutor(min(most, max(1, len(items)))) as threads:
        # Wrapped one by one, as a wrapper hands the same copy of the properties to all its threads.
        return [f.result() for f in [threads.submit(inheritable_thread_target(spark)(run), item) for item in enumerate(items)]]


def _fit_logistic(
    rows: DataFrame, problems: Sequence[Problem], n_features: int, tolerance: float, max_iterations: int
) -> list[Fit]:
    """Logistic fits by Spark ML on vectors stored once, side by side; its blocks stay in the JVM."""
    path = scratch_path(rows.sparkSession, "vectors")
    checked = rows.select(_checked_label(), "fold", "indices", "values").coalesce(_tasks_for(rows))
    vectors = ml_vectors(checked.withColumn("label", F.col("label").cast("double")), n_features, path)
    counts = {r["fold"]: r["count"] for r in vectors.groupBy("fold").count().collect()}
    # Fits that run at the same time share the cores; with a task on every core for each of them, tasks would only wait.
    vectors = vectors.coalesce(_tasks_for(rows, beside=min(CONCURRENT_FITS, max(1, len(problems)))))

    def fit(p: Problem) -> Fit:
        start = time.perf_counter()
        seen = vectors if p.held_out is None else vectors.where(F.col("fold") != p.held_out)
        n = sum(v for k, v in counts.items() if k != p.held_out)
        model = fit_logistic_ml(seen, p.c, n, max_iterations, tolerance * ML_TOLERANCE)
        summary = model.summary
        loss = p.c * n * float(summary.objectiveHistory[-1])
        steps = summary.totalIterations
        seconds = time.perf_counter() - start
        return Fit(p.name, p.c, model.coefficients.toArray(), float(model.intercept), loss, steps, steps < max_iterations, steps + 1, seconds)

    return side_by_side(rows.sparkSession, fit, problems)


def _fit_squared_hinge(
    rows: DataFrame, problems: Sequence[Problem], n_features: int, tolerance: float, max_iterations: int
) -> list[Fit]:
    """Quasi-Newton fits of all problems in shared passes over blocks of the rows."""
    spark = rows.sparkSession
    sc, penalised = spark.sparkContext, np.ones(n_features + 1)
    checked = rows.select(_checked_label(), "fold", "indices", "values").coalesce(_tasks_for(rows, len(problems)))
    folder = local_folder(spark, scratch_path(spark, "blocks"))
    if folder:
        os.makedirs(folder)
    else:
        # The loop runs per partition on plain arrays; lost blocks come back from the stored rows.
        packed = checked.mapInArrow(_pack, "y binary, fold binary, n binary, idx binary, val binary")
        blocks = packed.rdd.mapPartitions(_unpack).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if folder:
            written = checked.mapInArrow(_write_blocks(folder), "part int, file string").collect()  # a name for each task
            files = [r["file"] for r in sorted(written, key=lambda r: r["part"])]
            blocks = sc.parallelize(files, max(1, len(files))).mapPartitions(_map_blocks)
        searches = [_Lbfgs(p, penalised, tolerance, max_iterations) for p in problems]
        while open_ := [s for s in searches if not s.done]:
            start = time.perf_counter()
            weights = sc.broadcast(np.array([s.trial for s in open_]))
            sums = _add_up(blocks, _partial_sums([s.problem.held_out for s in open_], weights), 8 * len(open_) * (n_features + 2))
            weights.unpersist()
            for search, part in zip(open_, sums, strict=True):
                search.feed(part)
            share = (time.perf_counter() - start) / len(open_)
            for search in open_:
                search.seconds += share
    finally:
        if folder:
            shutil.rmtree(folder, ignore_errors=True)
        else:
            blocks.unpersist()
    return [s.result() for s in searches]


def fit_linear(
    rows: DataFrame,
    problems: Sequence[Problem],
    kind: str,
    n_features: int,
    tolerance: float = TOLERANCE,
    max_iterations: int | None = None,
) -> list[Fit]:
    """Minimise ``0.5 |w|^2 + C * sum(loss)`` for every problem.

    ``rows``: (label, indices, values[, fold]), a stored table. ``kind`` is
    'logistic' (intercept not penalised) or 'squared_hinge' (penalised).
    """
    if kind not in MAX_ITERATIONS:
        raise ValueError(f"unknown loss {kind!r}")
    limit = max_iterations or MAX_ITERATIONS[kind]
    if "fold" not in rows.columns:
        rows = rows.withColumn("fold", F.lit(0))
    fit = _fit_logistic if kind == "logistic" else _fit_squared_hinge
    fits = fit(rows, problems, n_features, tolerance, limit)
    if unfinished := [f.name for f in fits if not f.converged]:
        warnings.warn(f"not converged: {', '.join(unfinished)}", stacklevel=2)
    return fits


def fit_logistic_ml(train: DataFrame, c: float, n_rows: int, max_iterations: int = 1000, tolerance: float = 1e-8):
    """The same logistic model by Spark ML, for a frame with a ``features`` vector."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(
        regParam=1.0 / (c * n_rows), elasticNetParam=0.0, standardization=False,
        maxIter=max_iterations, tol=tolerance,
    ).fit(train)


def fit_hinge_ml(train: DataFrame, c: float, n_rows: int, max_iterations: int = 100):
    """Plain-hinge SVM by Spark ML: a quick option, not the squared-hinge model."""
    from pyspark.ml.classification import LinearSVC

    return LinearSVC(regParam=1.0 / (c * n_rows), standardization=False, maxIter=max_iterations).fit(train)


def coefficient_matrix(fits: Sequence[Fit]) -> np.ndarray:
    """[terms, fits], the form ``vector_margins`` takes."""
    return np.stack([f.weights for f in fits], axis=1)


def coefficient_table(spark, fits: Sequence[Fit]) -> DataFrame:
    """(idx, c ARRAY<DOUBLE>): one row per vocabulary term, one entry per fit.

    Marked for broadcast when the number of terms allows it.
    """
    stacked = coefficient_matrix(fits)
    table = pa.table(
        {
            "idx": pa.array(np.arange(stacked.shape[0], dtype=np.int32)),
            "c": pa.FixedSizeListArray.from_arrays(pa.array(stacked.ravel()), stacked.shape[1]).cast(
                pa.list_(pa.float64())
            ),
        }
    )
    frame = spark.createDataFrame(table)
    return F.broadcast(frame) if stacked.shape[0] <= BROADCAST_TERMS else frame


def model_table(spark, fits: Sequence[Fit], vocabulary: DataFrame) -> DataFrame:
    """(model, term, coef), the stored form of fitted models; the intercept has a null term."""
    names = F.array(*[F.lit(f.name) for f in fits])
    coefs = (
        coefficient_table(spark, fits)
        .join(vocabulary.select("idx", "term"), "idx")
        .select("term", F.inline(F.arrays_zip(names.alias("model"), F.col("c").alias("coef"))).alias("model", "coef"))
    )
    bias = spark.createDataFrame(
        [(f.name, None, f.intercept) for f in fits], "model string, term string, coef double"
    )
    return bias.unionByName(coefs)


def intercepts_of(fits: Sequence[Fit]) -> dict[str, float]:
    return {f.name: f.intercept for f in fits}


@dataclass
class Tuning:
    grid: DataFrame
    best: Fit
    fits: list[Fit]


def tune(
    train: DataFrame,
    validation: DataFrame,
    kind: str,
    n_features: int,
    grid: Sequence[float] = C_GRID,
    id_col: str = "id",
    tolerance: float = TOLERANCE,
    max_iterations: int | None = None,
) -> Tuning:
    """Fit every C on train, score all of them on validation, keep the best F1.

    Every candidate keeps its metrics and the seconds of its fit (``fit_s``). The test split has no place in the
    signature, and a frame that reads it is refused. The first grid entry wins ties.
    """
    refuse_split({"train": train, "validation": validation})
    spark = train.sparkSession
    problems = [Problem(f"C={c:g}", c) for c in grid]
    fits = fit_linear(train, problems, kind, n_features, tolerance, max_iterations)
    scored = vector_margins(
        validation, coefficient_matrix(fits), intercepts_of(fits), id_col, ["label"]
    )
    metrics = classification_metrics(long_predictions(scored, id_col, ["label"]), ["model"])
    entries = spark.createDataFrame(
        [(i, f.name, f.c, f.iterations, f.converged, round(f.seconds, 3)) for i, f in enumerate(fits)],
        "grid_pos int, model string, C double, iterations int, converged boolean, fit_s double",
    )
    table = entries.join(metrics, "model", "left").drop("model")
    chosen = best_setting(table).first()
    return Tuning(table, fits[chosen["grid_pos"]], fits)


#: Step lengths tried in one pass of a sigmoid fit, the longest that helps is taken.
LADDER = (1.0, 0.5, 0.25, 0.125, 1 / 64, 1 / 4096)


def _margin_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            arrays = (batch.column("fold").to_numpy().astype(np.int32), batch.column("label").to_numpy() == 1, batch.column("margin").to_numpy().astype(np.float64))
            yield pa.RecordBatch.from_pydict({n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("fold", "label", "margin"), arrays, strict=True)})


def _sigmoid_sums(folds: np.ndarray, targets: np.ndarray, asked) -> Callable:
    """Per (length, fold): loss, gradient and curvature of the sigmoid's two numbers, summed over one partition."""

    def run(blocks) -> Iterator[np.ndarray]:
        candidates = asked.value  # (lengths, folds, 2)
        total = np.zeros((len(candidates), len(folds), 6))
        for block in blocks:
            place = np.searchsorted(folds, np.frombuffer(block["fold"], np.int32))
            target = targets[place, np.where(np.frombuffer(block["label"], bool), 0, 1)]
            margin = np.frombuffer(block["margin"], np.float64)
            for out, ab in zip(total, candidates, strict=True):
                z = ab[place, 0] * margin + ab[place, 1]
                # -(t log p + (1-t) log(1-p)) with p = 1 / (1 + e^z), written without overflow
                loss = np.maximum(z, 0.0) + np.log1p(np.exp(-np.abs(z))) - (1 - target) * z
                p = _falling(z)
                d, h = target - p, p * (1 - p)
                for i, x in enumerate((loss, d * margin, d, h * margin * margin, h * margin, h)):
                    out[:, i] += np.bincount(place, weights=x, minlength=len(folds))
        yield total

    return run


def _falling(z: np.ndarray) -> np.ndarray:
    """1 / (1 + e^z) without overflow."""
    small = np.exp(-np.abs(z))
    return np.where(z > 0, small, 1.0) / (1.0 + small)


def _platt(scored: DataFrame, max_steps: int = 100, tolerance: float = 1e-10) -> dict[int, tuple[float, float]]:
    """Sigmoid ``1 / (1 + exp(a * margin + b))`` per fold with smoothed targets.

    Newton steps for all folds together. A pass over the packed margins answers for a whole
    ladder of step lengths, so a step that is too long costs no pass of its own.
    """
    sizes = sorted(
        (r["fold"], r["pos"], r["neg"])
        for r in scored.groupBy("fold")
        .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
        .collect()
    )
    folds = np.array([k for k, _, _ in sizes], np.int32)
    pos, neg = (np.array([s[i] for s in sizes], float) for i in (1, 2))
    targets = np.stack([(pos + 1.0) / (pos + 2.0), 1.0 / (neg + 2.0)], axis=1)
    params = np.stack([np.zeros(len(folds)), np.log((neg + 1.0) / (pos + 1.0))], axis=1)
    sc = scored.sparkSession.sparkContext
    packed = scored.select("fold", "label", "margin").mapInArrow(_margin_blocks, "fold binary, label binary, margin binary")
    blocks = packed.rdd.persist(StorageLevel.MEMORY_AND_DISK)

    def evaluate(candidates):
        asked = sc.broadcast(candidates)
        sums = _add_up(blocks, _sigmoid_sums(folds, targets, asked), 8 * 6 * len(candidates) * len(folds))
        asked.unpersist()
        return sums

    try:
        state = evaluate(params[None])[0]
        open_ = np.ones(len(folds), bool)
        for _ in range(max_steps):
            steps = np.zeros_like(params)
            for k in np.flatnonzero(open_):
                _, ga, gb, haa, hab, hbb = state[k]
                steps[k] = -np.linalg.solve(np.array([[haa, hab], [hab, hbb]]) + 1e-12 * np.eye(2), np.array([ga, gb]))
            trials = params + np.array(LADDER)[:, None, None] * steps
            sums = evaluate(trials)
            for k in np.flatnonzero(open_):
                helped = np.flatnonzero(sums[:, k, 0] <= state[k, 0] + 1e-12)
                best = int(helped[0]) if len(helped) else len(LADDER) - 1
                moved = np.max(np.abs(trials[best, k] - params[k]))
                # No length helps only where rounding decides.
                open_[k] = len(helped) > 0 and moved > tolerance * (1 + np.max(np.abs(params[k])))
                if len(helped):
                    params[k], state[k] = trials[best, k], sums[best, k]
            if not open_.any():
                return {int(k): (float(a), float(b)) for k, (a, b) in zip(folds, params, strict=True)}
    finally:
        blocks.unpersist()
    raise RuntimeError(f"sigmoids of folds {folds[open_].tolist()} not finished after {max_steps} steps")


@dataclass
class Calibrated:
    fits: list[Fit]
    sigmoids: dict[int, tuple[float, float]]


def calibrate(
    train: DataFrame, c: float, n_features: int, id_col: str = "id", folds: int = FOLDS,
    seed: int = SEED, tolerance: float = TOLERANCE,
) -> Calibrated:
    """Per fold: an SVM on the other folds and a sigmoid on this one."""
    rows = stratified_folds(train, id_col, "label", folds, seed)
    problems = [Problem(f"fold={k}", c, held_out=k) for k in range(1, folds + 1)]
    fits = fit_linear(rows, problems, "squared_hinge", n_features, tolerance)
    scored = vector_margins(
        rows, coefficient_matrix(fits), intercepts_of(fits), id_col, ["label", "fold"]
    )
    own = F.element_at("margins", F.concat(F.lit("fold="), F.col("fold").cast("string")))
    return Calibrated(fits, _platt(scored.select("fold", "label", own.alias("margin")).coalesce(_tasks_for(train))))


def calibrated_probabilities(
    rows: DataFrame, model: Calibrated, id_col: str = "id", keep: Sequence[str] = ()
) -> DataFrame:
    """(id, *keep, probability, pred): mean of the folds' sigmoids."""
    scored = vector_margins(
        rows, coefficient_matrix(model.fits), intercepts_of(model.fits), id_col, keep
    )
    parts = [
        1.0 / (1.0 + F.exp(F.lit(a) * F.element_at("margins", F.lit(f"fold={k}")) + F.lit(b)))
        for k, (a, b) in sorted(model.sigmoids.items())
    ]
    mean = sum(parts[1:], parts[0]) / len(parts)
    return scored.select(id_col, *keep, mean.alias("probability")).withColumn(
        "pred", F.when(F.col("probability") > 0.5, 1).otherwise(0)
    )
