"""Centroid clustering over Hilbert-ordered blocks with zone maps.

Vectors are ordered along a Hilbert curve and cut into blocks; a block is one row of a scratch table, with its ids, its packed
components and the smallest and largest value of every component.  From that box follow the least and the greatest distance any of its
vectors can have from a centroid: a centroid whose least distance exceeds another one's greatest can be nearest to none of them.  Only
the remaining candidates are compared, exactly and as one matrix product; a block with one candidate needs no comparison.

The blocks are made once and read in every round.  A round returns exact sums for each task, cluster and component, which Spark adds up;
``k`` centroids come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import Scratch
from .topk import whole_components

MOST = 1 << 63


@dataclass(frozen=True)
class Settings:
    k: int = 16
    rounds: int = 3
    dim: int = 64
    scale: float = 64
    seed: str = "1"
    block: int = 128
    bits: int = 2  # of each component, for the order along the curve


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place along the Hilbert curve of points with ``bits`` bits in each coordinate, as byte strings that sort like numbers.

    The coordinates are turned into the curve's transposed index, one bit plane after the other from the top.
    """
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    plane = np.uint64(1) << np.uint64(bits - 1)
    while plane > 1:
        low = plane - np.uint64(1)
        for i in range(n):
            set_ = (x[i] & plane) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            if i:
                x[i] ^= swap
        plane >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    plane = np.uint64(1) << np.uint64(bits - 1)
    while plane > 1:
        flip ^= np.where((x[n - 1] & plane) != 0, plane - np.uint64(1), np.uint64(0))
        plane >>= np.uint64(1)
    x ^= flip
    planes = [((x >> np.uint64(b)) & np.uint64(1)).T for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def component_range(rows: DataFrame, dim: int) -> np.ndarray | None:
    """Smallest and largest value of every component (2 x dim), None without rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = matrix(batch.column(0), dim)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(own.min(0)), pa.array(own.max(0))], names=["i", "lo", "hi"])

    found = rows.select("vector").mapInArrow(run, "i int, lo long, hi long").groupBy("i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    return np.array([[r.lo, r.hi] for r in sorted(found, key=lambda r: r.i)]).T if found else None


def with_place(rows: DataFrame, span: np.ndarray, settings: Settings) -> DataFrame:
    """``rows`` (vec_id, vector) with their place along the curve."""
    low, width = span[0].astype(np.float64), np.maximum(span[1].astype(np.float64) - span[0], 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                share = (matrix(batch.column(1), settings.dim) - low) / width
                cells = np.clip((share * (1 << settings.bits)).astype(np.int64), 0, (1 << settings.bits) - 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(cells, settings.bits), pa.binary())], names=["vec_id", "vector", "place"])

    return rows.select("vec_id", "vector").mapInArrow(run, "vec_id long, vector array<long>, place binary")


def blocked(rows: DataFrame, span: np.ndarray, settings: Settings) -> DataFrame:
    """Blocks (ids, data, low, high) of consecutive vectors along the curve."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, settings.block):
                part = batch.slice(start, settings.block)
                own = matrix(part.column(1), settings.dim)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([own.astype("<i8").tobytes()], pa.binary()),
                    pa.array([own.min(0).tolist()], pa.list_(pa.int64())), pa.array([own.max(0).tolist()], pa.list_(pa.int64()))],
                    names=["ids", "data", "low", "high"])

    placed = with_place(rows, span, settings)
    # the id parts equal vectors, so that one that a third of the rows hold is dealt over many tasks
    dealt = placed.repartitionByRange("place", "vec_id").sortWithinPartitions("place", "vec_id")
    return dealt.select("vec_id", "vector").mapInArrow(run, "ids array<long>, data binary, low array<long>, high array<long>")


def kind_for(span: np.ndarray, dim: int):
    """The number type in which squared distances between points of the box ``span`` are exact."""
    widest = max(int(b) - int(a) for a, b in span.T)
    reach = max(abs(int(v)) for v in span.ravel())
    top = max(4 * reach * reach, widest * widest) * dim
    return np.float64 if top < 1 << 53 else np.int64 if top < MOST else object


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Centroids that can be nearest to a point of the box, in their order."""
    below, above = low - centroids, centroids - high
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(1)
    greatest = (np.maximum(abs(below), abs(above)) ** 2).sum(1)
    return np.flatnonzero(least <= greatest.min())


def nearest(own: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of every row; ties go to the smaller number."""
    chosen = centroids[among]
    distance = (own * own).sum(1)[:, None] - 2 * (own @ chosen.T) + (chosen * chosen).sum(1)[None, :]
    at = distance.argmin(1)
    return among[at], distance[np.arange(len(own)), at]


def opened(batch: pa.RecordBatch, i: int, kind, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, components, low and high of the i-th block of a batch."""
    own = np.frombuffer(batch.column(1)[i].as_buffer(), "<i8").reshape(-1, dim).astype(kind)
    low, high = (batch.column(c)[i].values.to_numpy().astype(kind) for c in (2, 3))
    return batch.column(0)[i].values.to_numpy(), own, low, high


def sums(blocks: DataFrame, centroids: np.ndarray, kind, settings: Settings) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise exact sum of every non-empty cluster."""
    dim, k = settings.dim, len(centroids)
    shared = centroids.astype(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * k, np.zeros((k, dim), object)
        for batch in batches:
            for i in range(batch.num_rows):
                _, own, low, high = opened(batch, i, kind, dim)
                among = candidates(low, high, shared)
                cluster = np.full(len(own), among[0]) if len(among) == 1 else nearest(own, shared, among)[0]
                for c in np.unique(cluster).tolist():
                    mine = own[cluster == c]
                    count[c] += len(mine)
                    total[c] += np.array([int(v) for v in mine.sum(0)], object)
        rows = [(c, d, count[c], Decimal(int(total[c, d]))) for c in range(k) if count[c] for d in range(dim)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)))],
                                             names=["cluster", "i", "n", "total"])

    added = blocks.mapInArrow(run, "cluster int, i int, n long, total decimal(38,0)").groupBy("cluster", "i").agg(
        F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for row in sorted(added, key=lambda r: (r.cluster, r.i)):
        out.setdefault(row.cluster, (row.n, []))[1].append(int(row.total))
    return out


def assigned(blocks: DataFrame, centroids: np.ndarray, kind, settings: Settings) -> DataFrame:
    """vec_id, cluster and distance (null beyond 64 bits) of every vector, and how many centroids its block was compared with."""
    dim, shared = settings.dim, centroids.astype(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, own, low, high = opened(batch, i, kind, dim)
                among = candidates(low, high, shared)
                cluster, distance = nearest(own, shared, among)
                exact = pa.array([int(d) if d < MOST else None for d in distance.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cluster.astype(np.int32)), exact,
                                                  pa.array(np.full(len(ids), len(among), np.int32))], names=["vec_id", "cluster", "distance", "compared"])

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long, compared int")


def first_centroids(rows: DataFrame, settings: Settings) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of their ids, in that order (equal ids by vector)."""
    hashed = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.col("vec_id").cast("string")), 256)
    top = rows.select(hashed.alias("h"), "vector").orderBy("h", "vector").limit(settings.k).collect()
    return np.array([r.vector for r in top], np.int64).reshape(-1, settings.dim)


def cluster(vectors: DataFrame, settings: Settings = Settings(), vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, compared) of every vector that takes part, and the final centroids.

    A vector takes part if it has an id and exactly ``dim`` components, none null or non-finite; its components become
    floor(scale * x) as 64-bit integers.  Centroids begin as ``first_centroids`` (all vectors, if there are fewer), and in every round
    become the floored means of their vectors; empty ones stay.  Ties go to the smaller number.  Rows that share an id each
    count; a table without vectors gives no rows; other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "centroids")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), whole_components(F.col(vector), settings.scale).alias("vector")) \
        .where((F.col("vec_id").isNotNull()) & (F.size("vector") == settings.dim))
    span = component_range(rows, settings.dim)
    if span is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, compared int"), np.zeros((0, settings.dim), np.int64)
    kind = kind_for(span, settings.dim)
    blocks = scratch.keep(blocked(rows, span, settings), "blocks")
    centroids = first_centroids(rows, settings)
    for _ in range(settings.rounds):
        for c, (n, total) in sums(blocks, centroids, kind, settings).items():
            centroids[c] = [t // n for t in total]
    return scratch.keep(assigned(blocks, centroids, kind, settings), "assigned"), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with cluster_inertia, inertia (null beyond 64 bits) and centroid_sha256."""
    added = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    whole = sum(int(t or 0) for t in added.values())
    by_cluster = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    long = lambda v: F.lit(int(v) if v is not None and int(v) < MOST else None).cast("long")
    text = lambda c: F.sha2(F.lit(",".join(str(int(v)) for v in c)), 256)
    no_rows = not len(centroids)
    return found.withColumns({
        "cluster_inertia": F.lit(0).cast("long") if no_rows else by_cluster([long(added.get(c)) for c in range(len(centroids))]),
        "inertia": long(whole),
        "centroid_sha256": F.lit("") if no_rows else by_cluster([text(c) for c in centroids])})
