"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, found through a block-max index.

Terms are words and their beginnings, so that inflected and compounded words share terms.  Every term of the examples counts; its
inverse document frequency is multiplied by its correlation with the label (phi, which does not grow with the number of
examples), so that telling terms outweigh a text's subject and language.  Examples lie in blocks of similar ones: terms that
many examples have are columns of a matrix with each block's largest weights, all others are postings.  A block is passed over
if its bound lies below the k-th cosine found; what is near the k-th is computed again in full precision.  Neighbours vote with their
cosine; votes are calibrated on the examples, each voted on by the others.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .batches import fresh_name, slices, widened
from .decontaminate import words
from .langid import cluster

BEGINNINGS = (4, 5, 6)  # bytes of a word that make terms besides the word itself
BLOCK = 256
BINS = 40
GROUP = 32  # examples of which the best stands for all when the k-th cosine is bounded from below; divides BLOCK
TOGETHER = 128  # texts that are searched for at a time
COMMON = 20  # terms of one in so many examples are columns


def terms(word: bytes) -> list[bytes]:
    return [word, *(b"^" + word[:n] for n in BEGINNINGS if len(word) > n)]


class WordTerms(dict):
    """Word -> numbers of its kept terms as int32 bytes, which join fast; forgets everything when full."""

    def __init__(self, vocabulary: dict[bytes, int], limit: int = 150_000):
        super().__init__()
        self.vocabulary, self.limit = vocabulary, limit

    def __missing__(self, word: bytes) -> bytes:
        known = [i for i in map(self.vocabulary.get, terms(word)) if i is not None]
        found = struct.pack(f"={len(known)}i", *known)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = found
        return found


class Vectors:
    """Texts -> sparse normalised TF-IDF vectors: (term numbers, weights), or None without a known term."""

    def __init__(self, vocabulary: dict[bytes, int], weight: np.ndarray):
        self.words, self.weight = WordTerms(vocabulary), weight

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.frombuffer(b"".join(map(self.words.__getitem__, words(text))), np.int32), return_counts=True)

    def weighted(self, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (1 + np.log(count)) * self.weight[at]
        return at, weight / np.sqrt((weight * weight).sum())

    def __call__(self, text: str | None):
        at, count = self.counted(text)
        return self.weighted(at, count) if len(at) else None


def packed(numbers: np.ndarray) -> bytes:
    """Differences by byte planes, which compress well."""
    return zlib.compress(np.diff(numbers, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i4").ravel(), dtype=np.int32)


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for ``size[0]`` places, then those from begin[1], and so on."""
    return np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


class BlockMaxIndex:
    """Exact nearest neighbours among sparse vectors with positive weights; see the module's text."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self._fill(*(np.concatenate([v[i] for v in vectors] or [np.zeros(0)]).astype(kind) for i, kind in ((0, np.int32), (1, np.float64))),
                   np.array([len(v[0]) for v in vectors], np.int64), n_terms)

    @classmethod
    def flat(cls, term: np.ndarray, weight: np.ndarray, size: np.ndarray, n_terms: int) -> BlockMaxIndex:
        """The same of vectors that lie one after the other; no copy is made of them."""
        made = cls.__new__(cls)
        made._fill(term, weight, size, n_terms)
        return made

    def _fill(self, term: np.ndarray, weight: np.ndarray, size: np.ndarray, n_terms: int) -> None:
        self.n_docs, self.n_terms, self.term, self.weight, self.size = len(size), n_terms, term, weight, size
        self.begin = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        twins: dict[bytes, int] = {}
        self.twin = np.array([twins.setdefault(blake2b(self.weight[a:b], digest_size=16, key=blake2b(self.term[a:b], digest_size=32).digest()).digest(), i)
                              for i, (a, b) in enumerate(zip(self.begin, self.begin[1:]))], np.int64)
        df = np.bincount(self.term, minlength=n_terms)
        self.column = np.full(n_terms, -1, np.int32)
        common = np.flatnonzero((df > 0) & (df * COMMON >= self.n_docs))
        self.column[common] = np.arange(len(common))
        self.n_columns = len(common)
        self.order = self._alike(common[np.argsort(-df[common], kind="stable")[:512]], df)  # of the examples in the blocks
        self._build()

    def _alike(self, chosen: np.ndarray, df: np.ndarray) -> np.ndarray:
        """An order in which examples that share their commonest terms lie together; it has no influence on results."""
        if not len(chosen) or self.n_docs <= BLOCK:
            return np.arange(self.n_docs)
        column = np.full(self.n_terms, -1)
        column[chosen] = np.arange(len(chosen))
        data, idf = np.zeros((self.n_docs, len(chosen)), np.float32), np.log((1 + self.n_docs) / (1 + df[chosen]))
        for i in range(self.n_docs):
            own = column[self.vector(i)[0]]
            own = own[own >= 0]
            data[i, own] = idf[own]
        data /= np.maximum(np.sqrt((data * data).sum(1, keepdims=True)), 1e-9)
        return np.argsort((data @ cluster(data, 8, 6).T).argmax(1), kind="stable")

    def _build(self) -> None:
        self.place = place = np.empty(self.n_docs, np.int32)
        place[self.order] = np.arange(self.n_docs)
        self.matrix = np.zeros((self.n_docs, self.n_columns), np.float32)
        for i in range(self.n_docs):
            at, weight = self.vector(i)
            own = self.column[at]
            self.matrix[place[i], own[own >= 0]] = weight[own >= 0]
        self.most = np.array([self.matrix[i:i + BLOCK].max(0) for i in range(0, self.n_docs, BLOCK)])
        rare = np.flatnonzero(self.column[self.term] < 0).astype(np.int32)
        rare = rare[np.argsort(self.term[rare], kind="stable")]
        self.posting = np.searchsorted(self.term[rare], np.arange(self.n_terms + 1))
        self.doc, self.part = np.repeat(place, self.size)[rare], self.weight[rare].astype(np.float32)

    def vector(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.term[self.begin[i]:self.begin[i + 1]], self.weight[self.begin[i]:self.begin[i + 1]]

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k largest (cosine, example), ties to the smaller example; only examples with a term in common."""
        return self.search([(at, weight)], k, [without])[0]

    def search(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int]) -> list[list[tuple[float, int]]]:
        """``nearest`` of several vectors at once."""
        if not self.n_docs or not vectors:
            return [[] for _ in vectors]
        rows = np.arange(len(vectors))
        query = np.zeros((len(vectors), self.n_columns), np.float32)
        score = np.zeros((len(vectors), len(self.most) * BLOCK), np.float32)
        doc, part = np.empty(0, np.int32), np.empty(0, np.float32)
        for i, (at, weight) in enumerate(vectors):
            own = self.column[at]
            query[i, own[own >= 0]] = weight[own >= 0]
            rare, weight = at[own < 0], weight[own < 0].astype(np.float32)
            begin, end = self.posting[rare], self.posting[rare + 1]
            n = int((end - begin).sum())
            if n > len(doc):  # the same memory for all texts, since fresh pages cost more than the sums
                doc, part = np.empty(2 * n, np.int32), np.empty(2 * n, np.float32)
            if n:
                lists = [slice(a, b) for a, b in zip(begin.tolist(), end.tolist())]
                np.concatenate([self.part[one] for one in lists], out=part[:n])
                part[:n] *= np.repeat(weight, end - begin)
                np.concatenate([self.doc[one] for one in lists], out=doc[:n])
                score[i] = np.bincount(doc[:n], part[:n], minlength=score.shape[1])
        slack = (self.n_columns + 16) * 2.0**-23  # more than single precision can be off
        bound = (query @ self.most.T + score.reshape(len(vectors), -1, BLOCK).max(2)) * (1 + slack)
        rank = np.empty(bound.shape, np.int64)
        np.put_along_axis(rank, np.argsort(-bound, axis=1, kind="stable"), np.arange(bound.shape[1])[None, :], 1)
        found = np.full(score.shape, -1, np.float32)
        left_out = np.array(without)
        place = self.place[left_out]
        kth = np.full(len(vectors), -1.0)
        best = np.full((len(vectors), score.shape[1] // GROUP), -1, np.float32)
        for first, last in ((0, 2), (2, bound.shape[1])):
            wanted = (rank >= first) & (rank < last) & (bound > 0) & (bound >= kth[:, None] - slack)
            for block in np.flatnonzero(wanted.any(0)).tolist():
                use, span = np.flatnonzero(wanted[:, block]), slice(block * BLOCK, min((block + 1) * BLOCK, self.n_docs))
                if len(use) == len(vectors):
                    np.matmul(query, self.matrix[span].T, out=found[:, span])
                    found[:, span] += score[:, span]
                else:
                    found[use, span] = score[use, span] + query[use] @ self.matrix[span].T
            found[rows[left_out >= 0], place[left_out >= 0]] = -1
            np.max(found.reshape(*best.shape, GROUP), axis=2, out=best)
            if best.shape[1] > k:  # k groups hold an example each that is at least as near
                kth = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k].astype(float)
        made, dense = [], np.zeros(self.n_terms)
        for i, (at, weight) in enumerate(vectors):
            groups = np.flatnonzero((best[i] > 0) & (best[i] >= kth[i] - 2 * slack))
            own = found[i].reshape(-1, GROUP)[groups]
            least = float(np.partition(own, own.size - k, axis=None)[own.size - k]) if own.size > k else -1.0
            group, at_place = np.nonzero((own > 0) & (own >= least - 2 * slack))
            near = self.order[groups[group] * GROUP + at_place]
            if not len(near):
                made.append([])
                continue
            only, back = np.unique(self.twin[near], return_inverse=True)  # equal examples are computed once
            use = ranges(self.begin[only], self.size[only])
            dense[at] = weight
            exact = np.add.reduceat(dense[self.term[use]] * self.weight[use], np.concatenate([[0], np.cumsum(self.size[only])[:-1]]))
            dense[at] = 0
            exact = np.round(exact, 12)[back]  # equal cosines are ties, whatever the order of their sums
            near, exact = near[exact > 0], exact[exact > 0]
            by = np.lexsort((near, -exact))[:k]
            made.append(list(zip(exact[by].tolist(), near[by].tolist())))
        return made


@dataclass
class Examples:
    """Bounded by the number of examples and their distinct terms; broadcast once, for calibration and scores.  Travels as packed
    term counts; each process makes the index of them when it is first asked."""

    vectors: Vectors
    size: np.ndarray  # distinct terms of every example
    term: bytes
    count: bytes
    labels: np.ndarray
    names: list
    k: int

    @cached_property
    def index(self) -> BlockMaxIndex:
        term, count, begin = unpacked(self.term), unpacked(self.count), np.concatenate([[0], np.cumsum(self.size)])
        weight = np.empty(len(term))
        for a, b in zip(begin.tolist(), begin[1:].tolist()):
            weight[a:b] = self.vectors.weighted(term[a:b], count[a:b])[1]
        del count
        return BlockMaxIndex.flat(term, weight, self.size, len(self.vectors.weight))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    def votes(self, vectors: list, without: list[int] | None = None) -> Iterator[tuple[float | None, list[tuple[float, int]]]]:
        """Vote and nearest examples of every vector (None: no vote)."""
        for start in range(0, len(vectors), TOGETHER):
            part = vectors[start:start + TOGETHER]
            use = [i for i, v in enumerate(part) if v is not None]
            found = self.index.search([part[i] for i in use], self.k, [without[start + i] if without else -1 for i in use])
            near: list[list[tuple[float, int]]] = [[] for _ in part]
            for i, own in zip(use, found):
                near[i] = own
            for own in near:
                total = sum(s for s, _ in own)
                yield (sum(s * self.labels[i] for s, i in own) / total if total else None), own


@dataclass
class Model:
    shared: Broadcast  # Examples
    base: float  # share of label 1 among examples without a term
    levels: np.ndarray  # calibrated score of each vote bin

    def score(self, vote: float | None) -> float:
        return self.base if vote is None else float(self.levels[min(BINS - 1, int(vote * BINS))])


def _weighted(examples: DataFrame, sizes: dict[int, int], least: float) -> tuple[dict[bytes, int], np.ndarray]:
    """All terms (with a chi-square of at least ``least``), and their inverse document frequencies times their correlation with the
    label.  With one label only there is nothing to tell apart, and no term."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            found = (Counter(), Counter())
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                found[label].update({t for w in set(words(text)) for t in terms(w)})
            keys = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([found[0][t] for t in keys], pa.int64()),
                                              pa.array([found[1][t] for t in keys], pa.int64())], names=["term", "zero", "one"])

    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not (n0 and n1):
        return {}, np.zeros(0)
    n = n0 + n1
    found = examples.mapInArrow(count, "term binary, zero long, one long").groupBy("term") \
        .agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).toArrow().sort_by("term")
    zero, one = (found.column(c).to_numpy().astype(np.float64) for c in ("zero", "one"))
    df = zero + one
    phi = np.abs(one * n0 - zero * n1) / np.sqrt(float(n0) * n1 * df * np.maximum(1, n - df))
    kept = (n * phi * phi >= least) & (phi > 0)
    names = found.column("term").filter(pa.array(kept)).to_pylist()
    return {t: i for i, t in enumerate(names)}, ((np.log((1 + n) / (1 + df)) + 0.1) * phi)[kept]


def fit(examples: DataFrame, bound: int = 12_000, k: int = 15, text: str = "text", label: str = "label", name: str = "name",
        least_chi2: float = 0.0, of: dict[int, int] | None = None) -> Model | None:
    """Index of at most ``bound`` labelled rows (the caller bounds them; more is an error).  None without examples.

    ``of`` says how many labelled rows of each label there are, if the examples are not an even sample of them; scores are
    calibrated to those shares.
    """
    rows = cut_lineage(examples.select(F.col(name).alias("name"), F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
                       .where("label in (0, 1)"))
    sizes = {row.label: row.n for row in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(sizes.values())
    if n > bound:
        raise ValueError(f"{n} examples; the bound is {bound}")
    if not n:
        return None
    vocabulary, weight = _weighted(rows, sizes, least_chi2)

    def sparse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vectors(vocabulary, weight)
        for batch in slices(batches, "text", 8 << 20):
            made = [own.counted(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("label"), *(pa.array([m[i].astype("<i4").tobytes() for m in made], pa.binary())
                                              for i in (0, 1))], names=["name", "label", "at", "count"])

    kind = rows.schema["name"].dataType.simpleString()
    found = rows.mapInArrow(sparse, f"name {kind}, label int, at binary, count binary").toArrow()  # at most `bound` rows
    names, labels = found.column("name").to_pylist(), found.column("label").to_pylist()
    at, count = ([np.frombuffer(v.as_buffer(), "<i4") for v in found.column(c)] for c in ("at", "count"))  # no copies
    bare = [labels[i] for i in range(n) if not len(at[i])]
    held = sorted((i for i in range(n) if len(at[i])), key=lambda i: (names[i] is None, names[i], labels[i]))
    flat = [packed(np.concatenate([part[i] for i in held] or [np.zeros(0, np.int32)])) for part in (at, count)]
    size = np.array([len(at[i]) for i in held], np.int64)
    del found, at, count
    pa.default_memory_pool().release_unused()
    whole = {side: max(size, (of or sizes).get(side, size)) for side, size in sizes.items()}
    each = {side: whole[side] / size * n / sum(whole.values()) for side, size in sizes.items()}  # what an example stands for
    share = sum(each[side] for side in labels if side) / n
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(Examples(Vectors(vocabulary, weight), size, *flat, np.array([labels[i] for i in held], np.float64),
                                                    [names[i] for i in held], k))
    return Model(shared, (sum(each[side] for side in bare if side) + share) / (sum(each[side] for side in bare) + 1), calibrated(spark, shared, len(held), each))


def calibrated(spark, shared: Broadcast, n: int, each: dict[int, float]) -> np.ndarray:
    """Share of label 1 by vote, each example voted on by the others, made monotone by pooling neighbouring bins."""

    def votes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            made = [vote for vote, _ in own.votes([own.index.vector(i) for i in ids], ids)]
            yield pa.RecordBatch.from_arrays([pa.array([-1 if v is None else min(BINS - 1, int(v * BINS)) for v in made], pa.int32()),
                                              pa.array([int(own.labels[i]) for i in ids], pa.int32())], names=["bin", "label"])

    total, ones = np.zeros(BINS), np.zeros(BINS)
    for row in spark.range(n).mapInArrow(votes, "bin int, label int").where("bin >= 0").groupBy("bin", "label").agg(F.count(F.lit(1)).alias("n")).collect():
        total[row.bin] += row.n * each[row.label]
        ones[row.bin] += row.n * each[row.label] * row.label
    middle = (np.arange(BINS) + 0.5) / BINS
    pools: list[list[float]] = []  # ones, total, bins; two imagined examples at the middle of each bin
    for o, t, m in zip(ones, total, middle):
        pools.append([o + 2 * m, t + 2, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    return np.concatenate([np.full(int(size), o / t) for o, t, size in pools])


def score(docs: DataFrame, model: Model | None, text: str = "text", evidence: bool = True, slice_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with score, predicted and, if asked for, evidence (names, labels and cosines of the nearest examples).

    Whole texts, no shuffle.  Null and empty texts and texts without a term of the examples get the share of label 1 among the examples
    without one; without a model all scores are 0.  Taken column names get underscores.
    """
    names = list(docs.columns)
    new: list[str] = []
    for wanted in ("score", "predicted") + ("evidence",) * evidence:
        new.append(fresh_name([*names, *new], wanted))
    at = names.index(text)
    proof = pa.list_(pa.struct([("name", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.shared.value if model else None
        for batch in slices(batches, text, slice_bytes):
            scores, proofs = [], []
            texts = batch.column(at).to_pylist()
            for vote, near in own.votes([own.vectors(t) for t in texts]) if own else ((None, []) for _ in texts):
                scores.append(model.score(vote) if own else 0.0)
                proofs.append([{"name": str(own.names[i]), "label": int(own.labels[i]), "cosine": s} for s, i in near] if evidence else None)
            made = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made] + [pa.array(proofs, proof)] * evidence, names=[*names, *new])

    kinds = ("double", "int", "array<struct<name: string, label: int, cosine: double>>")
    return docs.mapInArrow(run, widened(docs.schema, **dict(zip(new, kinds))))
