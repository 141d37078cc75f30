"""Random Forest transfer.

A forest's rows are binned once.  While the binned rows fit into a task's memory, trees are grown whole: every share of the trees is a task
that holds the binned rows (``trees``), so no histogram is ever sent.  Beyond that a forest is grown level by level by Spark ML, which sends
one histogram of all columns for every node and partition.  There the rows lie in few partitions, and as trees are independent, a forest
is grown as several smaller ones at the same time, each with its share of the trees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from . import trees as grown_trees
from .panel import error_metrics

TREES, MIN_LEAF, SEED = 500, 2, 42
LEAST_TREES = 8  # of a share
PARTITION_ROWS = 50_000  # at least, where there are more
SEED_STEP = 1_000_003  # between Spark ML's shares; it adds the partition's number to a seed
MAX_DEPTH = 30  # Spark's ceiling; the trees are otherwise grown out
MATRIX_BYTES = 96 * 2 ** 20  # binned rows of one task
COLUMN_BYTES = 64 * 2 ** 20  # values of the columns that one task cuts
MOST_COLUMNS = 2 ** 15 - 1
STRIP_ROWS = 2 ** 13  # rows that go down the trees at once


def forest(trees: int = TREES, seed: int = SEED, max_depth: int = MAX_DEPTH) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=trees, minInstancesPerNode=MIN_LEAF,
                                 featureSubsetStrategy="all", seed=seed, maxDepth=max_depth)


@dataclass
class FittedTree:
    tree: grown_trees.Tree
    thresholds: list[np.ndarray]

    def predict(self, vector) -> float:
        return float(self.tree.predict(grown_trees.binned(np.asarray([list(vector)], float), self.thresholds))[0])


@dataclass
class Share:
    """The trees that one task has grown; they come to the driver only when they are asked for."""

    number: int
    getNumTrees: int
    grown: DataFrame
    thresholds: list[np.ndarray]

    @property
    def trees(self) -> list[FittedTree]:
        rows = self.grown.where(F.col("share") == self.number).orderBy("number").collect()
        return [FittedTree(grown_trees.stored(r), self.thresholds) for r in rows]

    @property
    def toDebugString(self) -> str:
        lines = [f"share {self.number} of {self.getNumTrees} trees"]
        for i, fitted in enumerate(self.trees):
            tree, leaves = fitted.tree, iter(fitted.tree.value)
            lines += [f"  tree {i} node {n}: " + (f"{next(leaves)!r}" if c < 0 else f"column {c} <= {fitted.thresholds[c][b]!r}: {left}, {left + 1}")
                      for n, (c, b, left) in enumerate(zip(tree.column.tolist(), tree.bin.tolist(), tree.left.tolist()))]
        return "\n".join(lines)


@dataclass
class Forest:
    """The shares of one forest: its prediction is the mean over all trees."""

    shares: list[RandomForestRegressionModel] | list[Share]

    @property
    def trees(self) -> int:
        return sum(m.getNumTrees for m in self.shares)


def _at_once(make: Callable, over: Iterable) -> list:
    over = list(over)
    with ThreadPoolExecutor(max(1, len(over))) as pool:
        return list(pool.map(inheritable_thread_target(make), over))


def fit(rows: DataFrame, vector: str, score: str, trees: int = TREES, seed: int = SEED, side_by_side: int = 1, **settings) -> Forest:
    """``side_by_side``: how many fits the caller runs at the same time; they divide the cores."""
    data = rows.select(F.col(vector).cast("array<double>").alias("v"), F.col(score).cast("double").alias("y")).persist()
    try:
        count, whole, width, longest = data.agg(F.count(F.lit(1)), F.count(F.when(F.col("v").isNotNull() & F.col("y").isNotNull(), 1)),
                                                F.min(F.size("v")), F.max(F.size("v"))).first()
        if not count or whole < count or width != longest or not width:
            raise ValueError(f"a forest needs rows with a score and vectors of one length: {count} rows, {whole} with both, lengths {width} to {longest}")
        fits = width * count <= MATRIX_BYTES and width <= MOST_COLUMNS and 8 * count <= COLUMN_BYTES
        partitions = 1 if fits else max(1, count // PARTITION_ROWS)
        cores = rows.sparkSession.sparkContext.defaultParallelism
        shares = max(1, min(-(-cores // (partitions * side_by_side)), trees // LEAST_TREES))
        sizes = [trees // shares + (i < trees % shares) for i in range(shares)]
        if fits:
            return _grown_whole(data, count, width, sizes, seed, **settings)
        return _grown_by_level(data, partitions, sizes, seed, **settings)
    finally:
        data.unpersist()


def _grown_by_level(data: DataFrame, partitions: int, sizes: list[int], seed: int, **settings) -> Forest:
    few = data.select(array_to_vector("v").alias("features"), F.col("y").alias("label")).coalesce(partitions).persist()
    try:
        few.count()  # so that the shares do not compute the rows side by side
        return Forest(_at_once(lambda i: forest(trees=sizes[i], seed=seed + SEED_STEP * i, **settings).fit(few), range(len(sizes))))
    finally:
        few.unpersist()


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _thresholds(data: DataFrame, count: int, width: int) -> list[np.ndarray]:
    """Where each column is cut into bins, from all its values; a task has some of the columns."""
    cores = data.sparkSession.sparkContext.defaultParallelism
    each = max(1, min(-(-width // cores), COLUMN_BYTES // (8 * count)))
    parts = -(-width // each)

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = grown_trees.matrix(batch.column(0), width)
            if not np.isfinite(matrix).all() or np.isnan(batch.column(1).to_numpy()).any():
                raise ValueError("vectors must be finite, and scores numbers")
            yield grown_trees.batch(part=pa.array(range(parts), pa.int32()),
                         found=pa.array([matrix[:, i * each:(i + 1) * each].tobytes("F") for i in range(parts)], pa.binary()))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [(p, blob) for batch in batches for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        if blocks:
            first = blocks[0][0] * each
            own = min(each, width - first)
            values = [np.frombuffer(blob).reshape(own, -1) for _, blob in blocks]
            at = [grown_trees.cuts(np.concatenate([x[i] for x in values])) for i in range(own)]
            yield grown_trees.batch(column=pa.array(range(first, first + own), pa.int32()), at=pa.array(at, pa.list_(pa.float64())))

    found = data.mapInArrow(dealt, "part int, found binary").repartitionById(parts, "part").mapInArrow(cut, "column int, at array<double>")
    return [np.array(r["at"], float) for r in sorted(found.collect(), key=lambda r: r["column"])]


def _grown_whole(data: DataFrame, count: int, width: int, sizes: list[int], seed: int, max_depth: int = MAX_DEPTH) -> Forest:
    at, least = _thresholds(data, count, width), MIN_LEAF
    first = [sum(sizes[:i]) for i in range(len(sizes))]

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield grown_trees.batch(bins=pa.array([grown_trees.binned(grown_trees.matrix(batch.column(0), width), at).tobytes()], pa.binary()),
                         y=pa.array([batch.column(1).to_numpy().astype(float).tobytes()], pa.binary()))

    def grown(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, bins, y = None, [], []
        for batch in batches:
            if batch.num_rows:
                share = batch.column(0)[0].as_py()
                bins += [np.frombuffer(x, np.uint8) for x in batch.column(1).to_pylist()]
                y += [np.frombuffer(x) for x in batch.column(2).to_pylist()]
        if share is None:
            return
        matrix, labels = np.concatenate(bins).reshape(-1, width), np.concatenate(y)
        del bins, y
        for i, tree in enumerate(grown_trees.grow(matrix, labels, range(first[share], first[share] + sizes[share]), seed, least, max_depth)):
            yield grown_trees.batch(share=pa.array([share], pa.int32()), number=pa.array([i], pa.int32()), **tree.packed())

    dealt = data.mapInArrow(coded, "bins binary, y binary").select(_every(len(sizes)).alias("share"), "bins", "y")
    out = cut_lineage(dealt.repartitionById(len(sizes), "share").mapInArrow(grown, grown_trees.STORED))
    return Forest([Share(i, size, out, at) for i, size in enumerate(sizes)])


def predict(model: Forest, rows: DataFrame, vector: str, column: str = "rf") -> DataFrame:
    if isinstance(model.shares[0], Share):
        return _predicted_whole(model, rows, vector, column)
    scored, names = rows.withColumn("features", array_to_vector(vector)), [f"_share{i}" for i in range(len(model.shares))]
    for share, name in zip(model.shares, names):
        scored = share.setPredictionCol(name).transform(scored)
    total = reduce(lambda a, b: a + b, [F.col(name) * share.getNumTrees for share, name in zip(model.shares, names)])
    return scored.withColumn(column, total / model.trees).drop("features", *names)


def _predicted_whole(model: Forest, rows: DataFrame, vector: str, column: str) -> DataFrame:
    """Batches of rows go to every share, are summed over its trees, and are put together again.

    A batch is known by its content, and travels with its rows to one of the shares.
    """
    shares, at, trees = len(model.shares), model.shares[0].thresholds, model.trees
    width, cores = len(at), rows.sparkSession.sparkContext.defaultParallelism
    copies = max(1, -(-cores // shares))  # of the trees, so that every core has some of the rows
    place = rows.columns.index(vector)
    schema = rows.withColumn(column, F.lit(None).cast("double")).schema

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(batches):
            if batch.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as writer:
                    writer.write_batch(batch)
                whole = sink.getvalue().to_pybytes()
                name = f"{TaskContext.get().partitionId()}-{n}-{hashlib.blake2b(whole, digest_size=16).hexdigest()}"
                yield grown_trees.batch(block=pa.array([name]), bins=pa.array([grown_trees.binned(grown_trees.matrix(batch.column(place), width), at).tobytes()], pa.binary()),
                             whole=pa.array([whole], pa.binary()))

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[grown_trees.Tree] = []
        for batch in batches:  # the trees come first
            for r in batch.to_pylist():
                if r["block"] is None:
                    own.append(grown_trees.stored(r))
                    continue
                bins = np.frombuffer(r["bins"], np.uint8).reshape(-1, width)
                sums = np.zeros(len(bins))
                for i in range(0, len(bins), STRIP_ROWS):
                    for tree in own:
                        sums[i:i + STRIP_ROWS] += tree.predict(bins[i:i + STRIP_ROWS])
                yield grown_trees.batch(block=pa.array([r["block"]]), share=pa.array([r["part"] % shares], pa.int32()), trees=pa.array([len(own)], pa.int32()),
                             sums=pa.array([sums.tobytes()], pa.binary()), whole=pa.array([r["whole"]], pa.binary()))

    def joined(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: r["share"])
        if [r["share"] for r in found] != list(range(shares)) or sum(r["trees"] for r in found) != trees:
            raise ValueError("rows or trees changed while they were scored")
        batch = pa.ipc.open_stream(next(r["whole"] for r in found if r["whole"] is not None)).read_all()
        mean = pa.array(sum(np.frombuffer(r["sums"]) for r in found) / trees, pa.float64())
        columns = dict(zip(batch.column_names, batch.columns)) | {column: mean}
        return pa.table([columns[f.name] for f in schema], names=schema.names)

    home = F.pmod(F.xxhash64(F.lit("home"), "block"), F.lit(shares))
    blocks = rows.mapInArrow(packed, "block string, bins binary, whole binary").select("*", _every(shares).alias("_share")).select(
        (F.col("_share") + shares * F.pmod(F.xxhash64("block"), F.lit(copies))).cast("int").alias("part"), "block", "bins",
        F.when(home == F.col("_share"), F.col("whole")).alias("whole"))
    own = model.shares[0].grown.select("*", _every(copies).alias("_copy")).select(
        (F.col("share") + shares * F.col("_copy")).cast("int").alias("part"), "number", *grown_trees.KINDS)
    dealt = own.unionByName(blocks, allowMissingColumns=True).repartitionById(shares * copies, "part").sortWithinPartitions(
        F.col("block").asc_nulls_first(), "number")
    sums = dealt.mapInArrow(summed, "block string, share int, trees int, sums binary, whole binary")
    return sums.groupBy("block").applyInArrow(joined, schema)


def holdout(rows: DataFrame, key: str, vector: str, score: str, share: float = 0.2, seed: int = SEED,
            **settings) -> DataFrame:
    """Error metrics on a deterministic hash split; NaN with fewer than ten rows."""
    nan = F.lit(float("nan"))
    if rows.limit(10).count() < 10:
        return rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"), nan.alias("mae"), nan.alias("rmse"),
                                                 nan.alias("r2"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000)
    model = fit(rows.where(~bucket), vector, score, seed=seed, **settings)
    return error_metrics(predict(model, rows.where(bucket).select(vector, score), vector, "prediction"), score, "prediction")


def cross_validate(rows: DataFrame, vector: str, score: str, fold: str, **settings) -> DataFrame:
    """Out-of-fold error metrics of the forest; the rows are kept between the fits, and the folds are fitted at the same time: a forest's
    jobs are small, so one fit leaves most of a cluster idle."""
    rows = rows.select(vector, score, fold).persist()
    labels = sorted(r[0] for r in rows.select(fold).distinct().collect())

    def held_out(label) -> DataFrame:
        model = fit(rows.where(F.col(fold) != label), vector, score, **settings)
        return predict(model, rows.where(F.col(fold) == label), vector, "prediction").select(score, "prediction")

    rows.count()  # so that the fits do not compute the rows side by side
    out = reduce(DataFrame.unionByName, _at_once(held_out, labels))
    result = cut_lineage(error_metrics(out, score, "prediction").withColumn("method", F.lit("random_forest")))
    rows.unpersist()
    return result
