"""MinHash near-duplicates through a multi-index Hamming join.

A document is its set of word shingles; documents with equal sets form a class and one of them stands for it.  A signature has
``chunks x width`` symbols of 16 bits, each agreeing with probability J.  Two signatures that differ in fewer than
``2 * chunks`` symbols have a chunk with one error at most (pigeonhole), so every chunk is indexed once for each of its symbols
with that symbol left out: all pairs below the signature distance share a key.  ``signature_plan`` takes the smallest signature
for which a pair at the similarity threshold exceeds that distance with probability ``miss`` at most.

Pairs are confirmed on full sets.  Nothing is emitted for all pairs of a bucket: first every member meets the bucket's smallest
member and the confirmed links are joined into components; then only buckets that still hold several components go on, small
ones pair by pair, large ones as pairs of bounded blocks whose task returns a spanning forest of the confirmed links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import Scratch
from .batches import slices
from .components import connected_components
from .workers import release

SMALL = 12  # buckets up to this size are paired as rows
BLOCK = 512  # documents of a block of a large bucket
ODD = np.uint64(0x9E3779B97F4A7C15)  # 2**64 / golden ratio


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * ODD
    x = (x ^ (x >> np.uint64(29))) * ODD
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Settings:
    """What makes two documents near-duplicates: 100 * intersection >= percent * union of their shingle sets."""

    words: int = 5
    percent: int = 80
    miss: float = 1e-5

    @property
    def plan(self) -> tuple[int, int]:
        return signature_plan(self.percent / 100, self.miss)


def signature_plan(similarity: float, miss: float) -> tuple[int, int]:
    """(chunks, symbols of a chunk)."""
    for width in (5, 4, 3, 2):
        for chunks in range(2, 17):
            n, most, p = chunks * width, 2 * chunks - 1, 1 - similarity
            if 1 - sum(comb(n, k) * p**k * (1 - p)**(n - k) for k in range(most + 1)) <= miss:
                return chunks, width
    raise ValueError("no signature of 16 chunks is safe for this similarity")


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashed = pd.util.hash_array(np.array(found, dtype=object), categorize=False)
    n = max(1, len(hashed) - words + 1)
    total = np.full(n, len(hashed) if len(hashed) < words else 0, np.uint64)
    for i in range(min(words, len(hashed))):
        total = mixed(total + hashed[i:i + n])
    return np.unique(total)


def same_enough(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature (16-bit symbols), text_hash of documents (doc_id, text, text_hash)."""
    chunks, width = settings.plan
    rng = np.random.default_rng(20_25)
    factor = rng.integers(0, 1 << 63, chunks * width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, chunks * width, dtype=np.uint64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text", 8 << 20):
            sizes, digests, made = [], [], []
            for value in batch.column(1).to_pylist():
                own = shingles(value, settings.words)
                sizes.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                least = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
                for start in range(0, len(own), 2048):
                    np.minimum(least, (own[start:start + 2048, None] * factor + shift).min(0), out=least)
                made.append(mixed(least).astype("<u2").tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                                              pa.array(made, pa.binary()), batch.column(2)],
                                             names=["doc_id", "n_shingles", "digest", "signature", "text_hash"])
        release()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary, text_hash long")


def index_keys(nodes: DataFrame, settings: Settings) -> DataFrame:
    """(key, node): every chunk of every signature with each of its symbols left out once."""
    chunks, width = settings.plan

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(chunks * width, dtype=np.uint64) << np.uint64(16)
        for batch in batches:
            if not batch.num_rows:
                continue
            symbols = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, chunks * width).astype(np.uint64)
            each = mixed(symbols + place + np.uint64(1 << 40)).reshape(-1, chunks, width)
            keys = mixed(each.sum(2, keepdims=True) - each + place.reshape(chunks, width)).reshape(len(symbols), -1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), keys.shape[1])))],
                                             names=["key", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "key long, node long")


def near_signatures(pairs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose signatures differ in fewer than 2 * chunks symbols."""
    chunks, width = settings.plan
    sides = [nodes.select(F.col("node").alias(end), F.col("signature").alias(f"{end}_signature")) for end in "ab"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, chunks * width) for i in (2, 3))
            near = pa.array((left != right).sum(1) < 2 * chunks)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "a_signature", "b_signature").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) that are similar enough on their full sets."""
    sides = [texts.select(F.col("node").alias(end), F.col("text").alias(f"{end}_text")) for end in "ab"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        last, held = None, None
        for batch in batches:
            keep = []
            for a, left, right in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                if a != last or held is None:
                    last, held = a, shingles(left.as_py(), settings.words)
                keep.append(same_enough(held, shingles(right, settings.words), settings.percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])
        held = None
        release()

    return pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


def forest(nodes: list[int], component: list[int], sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int,
           columns: int = 8192) -> list[tuple[int, int]]:
    """Confirmed links between two lists of rows that join different components, without the ones that close a circle.

    Intersections are counted as products of 0/1 matrices over the shingles that occur twice, some columns at a time.
    """
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    use = count[column] > 1
    row, column = row[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(number[-1]) + 1, columns):
        a, b = np.searchsorted(column, [start, start + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        both += part[left] @ part[right].T
    union = size[left][:, None] + size[right][None, :] - both
    root = {c: c for c in component}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    made = []
    for i, j in zip(*np.nonzero(100 * both >= percent * union)):
        a, b = int(left[i]), int(right[j])
        x, y = top(component[a]), top(component[b])
        if a != b and x != y:
            root[max(x, y)] = min(x, y)
            made.append((nodes[a], nodes[b]))
    return made


def block_links(members: DataFrame, texts: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """Links inside large buckets; ``members`` has key, node, pivot, component.

    A node's home is the smallest pivot of its buckets, which the buckets of one group of near copies mostly share; a home is
    cut into blocks of about ``BLOCK`` nodes, and blocks that meet in some bucket are compared.
    """
    homes = members.groupBy("node").agg(F.min("pivot").alias("home"), F.min("component").alias("component"))
    parts = homes.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("parts"))
    block = F.struct("home", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")).alias("block")
    home = scratch.keep(homes.join(parts, "home").select("node", "component", block))
    there = members.join(home.select("node", "block"), "node").select("key", "block").distinct()
    pairs = there.alias("x").join(there.alias("y"), "key").where("x.block <= y.block") \
        .select(F.col("x.block").alias("first"), F.col("y.block").alias("second")).distinct()
    pairs = scratch.keep(pairs.select("first", "second", F.monotonically_increasing_id().alias("pair")))
    sides = pairs.select("pair", F.col("first").alias("block"), F.lit(True).alias("is_first"), (F.col("first") == F.col("second")).alias("alone")) \
        .unionByName(pairs.where("first <> second").select("pair", F.col("second").alias("block"), F.lit(False).alias("is_first"), F.lit(False).alias("alone")))
    rows = sides.join(home, "block").join(texts, "node").select("pair", "node", "component", "is_first", "alone", "text")

    def run(group: pa.Table) -> pa.Table:
        release()
        sets = [shingles(t, settings.words) for t in group.column("text").to_pylist()]
        first = group.column("is_first").to_numpy(zero_copy_only=False)
        left = np.flatnonzero(first)
        right = left if group.column("alone")[0].as_py() else np.flatnonzero(~first)
        made = forest(group.column("node").to_pylist(), group.column("component").to_pylist(), sets, left, right, settings.percent) if len(right) else []
        return pa.table({"a": pa.array([x[0] for x in made], pa.int64()), "b": pa.array([x[1] for x in made], pa.int64())})

    return rows.groupBy("pair").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept (whether that is its own).

    ``doc_id`` is a long and names a document: of rows that share it the one with the smallest set digest is compared, and all get
    its component.  Rows with a null id, and documents without words, are linked with nothing and kept.  Whole texts are read;
    other columns are not.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    keep = scratch.keep
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    signed = keep(signatures(docs, settings), "signed")
    usable = signed.where("doc_id is not null and digest is not null")
    single = keep(usable.groupBy("doc_id").agg(F.min(F.struct("digest", "signature", "text_hash")).alias("own")).select("doc_id", "own.*"), "single")
    classes = single.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").alias("node"), "signature", "text_hash")).alias("own"))
    classes = keep(classes.select("digest", "own.*"), "classes")
    every = index_keys(classes, settings)  # made twice rather than written: it is larger than the classes it comes from
    stats = every.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keep(every.join(stats, "key").select("key", "node", "pivot", "n").distinct(), "members")
    stars = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    candidates = keep(near_signatures(stars, classes, settings), "candidates")
    wanted = classes.join(members.select("node").distinct(), "node").select("node", "text_hash")
    represented = docs.join(wanted, (docs["doc_id"] == wanted["node"]) & (docs["text_hash"] == wanted["text_hash"])).select("node", "text").distinct()
    texts = keep(represented, "texts")
    links = keep(confirmed(candidates, texts, settings), "links")
    parts = connected_components(links)
    named = members.where("n > 2").join(parts, "node", "left").select("key", "node", "pivot", "n", F.coalesce("component", "node").alias("component"))
    mixed_keys = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    rest = keep(named.join(mixed_keys, "key"), "rest")
    few = rest.where((F.col("n") <= SMALL) & (F.col("node") != F.col("pivot")))
    pairs = few.alias("x").join(few.alias("y"), "key").where("x.node < y.node and x.component <> y.component") \
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    more = confirmed(near_signatures(pairs, classes, settings), texts, settings)
    blocks = block_links(rest.where(F.col("n") > SMALL), texts, settings, scratch)
    found = keep(links.unionByName(more).unionByName(blocks), "found")
    scratch.drop(members, candidates, texts, links, rest)
    whole = connected_components(found)
    named = classes.join(whole, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    by_id = keep(single.join(named, "digest").select("doc_id", "component"), "components")
    scratch.drop(single, classes, found)
    out = signed.join(by_id, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
