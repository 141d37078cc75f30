"""Benchmark decontamination with suffix arrays of the training text.

Documents are read in shards of bounded size.  Each shard becomes one array of word numbers with a suffix array over it; the
suffixes of the benchmark are looked up in it by binary search, all at once.  The interval of suffixes that begin with a
window gives every place where it occurs, the neighbours of the insertion point give the longest match.  A word that no
benchmark item has can be part of no match: it is number 0, ends every suffix before it and needs no entry of its own.

The benchmark is the stated query set.  It is read in blocks of at most ``block_words`` words (an item is never cut); there is
one pass over the documents for each block, and passes add up.  Only one block is broadcast at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .batches import fresh_name, slices, widened
from .workers import release

#: Bytes of a word stay (A-Z in lower case), all others become spaces; bytes from 0x80 on belong to words.
WORD_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class TestBlock:
    """Some benchmark items as word numbers, with their distinct windows and all their suffixes."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.names = [name for name, _ in items]
        self.number: dict[bytes, int] = {}
        for _, own in items:
            for w in own:
                self.number.setdefault(w, len(self.number) + 1)
        coded = [np.array([self.number[w] for w in own], np.int32) for _, own in items]
        self.depth = max(map(len, coded))
        self.text = np.concatenate([np.append(c, np.int32(0)) for c in coded] + [np.zeros(self.depth, np.int32)])
        starts = np.cumsum([0] + [len(c) + 1 for c in coded[:-1]])
        self.suffix = np.concatenate([s + np.arange(len(c)) for s, c in zip(starts, coded)])
        self.suffix_item = np.repeat(np.arange(len(coded)), [len(c) for c in coded])
        self.suffix_start = self.suffix - starts[self.suffix_item]
        self.suffix_length = np.concatenate([np.arange(len(c), 0, -1) for c in coded])
        owners: dict[bytes, set[int]] = {}
        first: dict[bytes, tuple[int, int]] = {}
        for i, (s, c) in enumerate(zip(starts, coded)):
            size = min(window, len(c))
            for p in range(len(c) - size + 1):
                key = c[p:p + size].tobytes()
                owners.setdefault(key, set()).add(i)
                first.setdefault(key, (s + p, size))
        self.window, self.window_length = map(np.array, zip(*first.values()))
        self.window_items = [sorted(owners[k]) for k in first]


class Shard:
    """Word numbers of several documents, each ended by a 0, and their suffix array."""

    def __init__(self, documents: list[list[bytes]], block: TestBlock):
        flat: list[bytes] = []
        for own in documents:
            flat += own
            flat.append(b"")
        self.sizes = np.array([len(own) for own in documents], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]]).astype(np.int64)
        n = len(flat)
        self.text = np.zeros(n + block.depth + 1, np.int32)
        self.text[:n] = np.fromiter(map(block.number.get, flat, repeat(0)), np.int32, n)
        self.block = block
        self.order = self._sorted(np.flatnonzero(self.text), block.depth)

    def _sorted(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Suffixes in the order of their first ``depth`` words; each round doubles the words by which ties are told apart."""
        if not len(at):
            return at
        stops = np.flatnonzero(self.text == 0)
        left = stops[np.searchsorted(stops, at)] - at  # words until the suffix ends
        by = np.argsort(self.text[at], kind="stable")
        at, left = at[by], left[by]
        rank = np.zeros(len(self.text), np.int64)  # 1 + where the group of equal suffixes begins; 0 at an end

        def groups(keys: np.ndarray) -> np.ndarray:
            return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))

        head = groups(self.text[at])
        rank[at] = np.repeat(head, np.diff(np.append(head, len(at)))) + 1
        tied, h = np.arange(len(at)), 1
        while h < depth and len(tied):
            own = rank[at[tied]]
            after = np.where(left[tied] > h, rank[np.minimum(at[tied] + h, len(rank) - 1)], 0)
            keys = own * (len(at) + 2) + after
            by = np.argsort(keys, kind="stable")
            keys, moved = keys[by], tied[by]
            at[tied], left[tied] = at[moved], left[moved]
            head = groups(keys)
            size = np.diff(np.append(head, len(keys)))
            # a group keeps its place: what was sorted lies where the group's members lay
            rank[at[tied]] = np.repeat(tied[head], size) + 1
            tied = tied[np.repeat(size > 1, size) & (left[tied] > h)]
            h *= 2
        return at

    def _search(self, start: np.ndarray, length: np.ndarray, beyond: bool) -> np.ndarray:
        """Where each pattern would be inserted: before (or ``beyond``) the suffixes that begin with it."""
        span = np.arange(int(length.max()))
        pattern = self.block.text[start[:, None] + span]
        pattern[span >= length[:, None]] = -1
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            found, wanted = self.text[self.order[middle][:, None] + span], pattern[open_]
            differs = (found != wanted) & (wanted >= 0)
            first = differs.argmax(1)[:, None]
            a, b = np.take_along_axis(found, first, 1)[:, 0], np.take_along_axis(wanted, first, 1)[:, 0]
            right = np.where(differs.any(1), a < b, beyond)
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
        return low

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every occurrence."""
        block = self.block
        low = self._search(block.window, block.window_length, False)
        count = self._search(block.window, block.window_length, True) - low
        window = np.repeat(np.arange(len(count)), count)
        place = self.order[np.arange(count.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count)]
        return window, place

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """Longest match of every benchmark suffix and where it is."""
        block = self.block
        best, where = np.zeros(len(block.suffix), np.int64), np.zeros(len(block.suffix), np.int64)
        if not len(self.order):
            return best, where
        span = np.arange(block.depth)
        at = self._search(block.suffix, block.suffix_length, False)
        for near in (at - 1, at):
            place = self.order[np.clip(near, 0, len(self.order) - 1)]
            same = (self.text[place[:, None] + span] == block.text[block.suffix[:, None] + span]) & (span < block.suffix_length[:, None])
            length = np.where((near >= 0) & (near < len(self.order)), np.where(same.all(1), block.depth, same.argmin(1)), 0)
            better = length > best
            best, where = np.where(better, length, best), np.where(better, place, where)
        return best, where

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1


def blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int) -> Iterator[TestBlock]:
    """Items with words, a block at a time; rows without an id are left out."""
    held, size = [], 0
    for name, value in benchmark.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        own = words(value)
        if name is None or not own:
            continue
        if held and size + len(own) > block_words:
            yield TestBlock(held, window)
            held, size = [], 0
        held.append((name, own))
        size += len(own)
    if held:
        yield TestBlock(held, window)


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
             window: int = 13, percent: int = 5, block_words: int = 1_000_000, slice_bytes: int = 6 << 20) -> DataFrame:
    """``docs`` with n_words, n_hit, hits (packed pairs of word positions), items (sorted ids) and contaminated.

    A window is ``window`` consecutive words of an item, or a whole shorter item; a document word inside any occurrence of a
    window is hit; a document is contaminated if at least ``percent`` of a hundred of its words are hit.  No shuffle: every document is judged
    in the task that reads it.  Null and empty texts have no words and are never contaminated; repeated rows are judged alike;
    items that share an id count once; an empty benchmark hits nothing.  Other columns are carried through; the new ones get
    underscores if their names are taken.
    """
    names = list(docs.columns)
    new = []
    for wanted in ("n_words", "n_hit", "hits", "items", "contaminated"):
        new.append(fresh_name([*names, *new], wanted))
    n_words, n_hit, hits, items, contaminated = new
    spark, at = docs.sparkSession, names.index(text)
    schema = widened(docs.schema, **{n_words: "long", hits: "binary", items: "array<string>", n_hit: "long"})
    marked = docs.withColumns({n_words: F.lit(None).cast("long"), hits: F.lit(None).cast("binary"),
                               items: F.lit(None).cast("array<string>"), n_hit: F.lit(None).cast("long")})

    def judge(before: DataFrame, block: TestBlock | None) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for batch in slices(batches, text, slice_bytes):
                yield from judged(batch, at, len(names), shared.value, schema.names)

        return before.mapInArrow(run, schema)

    passes = 0
    for block in blocks(benchmark, item_id, item_text, window, block_words):
        marked = judge(cut_lineage(marked) if passes else marked, block)
        passes += 1
    if not passes:
        marked = judge(marked, None)
    return marked.select(*names, n_words, n_hit, hits, items,
                         ((F.col(n_hit) > 0) & (F.col(n_hit) * 100 >= F.lit(percent) * F.col(n_words))).alias(contaminated))


def judged(batch: pa.RecordBatch, at: int, width: int, block: TestBlock | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    """One batch of documents against one block; adds to what earlier blocks have found."""
    documents = [words(t) for t in batch.column(at).to_pylist()]
    old_hits, old_items = batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist()
    count = np.array([len(own) for own in documents], np.int64)
    starts = np.concatenate([[0], np.cumsum(count + 1)]).astype(np.int64)
    edge = np.zeros(starts[-1] + 1, np.int64)
    found: dict[int, set[str]] = {i: set(own) for i, own in enumerate(old_items) if own}
    for i, packed in enumerate(old_hits):
        if packed:
            spans = np.frombuffer(packed, "<i8").reshape(-1, 2) + starts[i]
            np.add.at(edge, spans[:, 0], 1)
            np.add.at(edge, spans[:, 1], -1)
    if block is not None:
        shard = Shard(documents, block)
        window, place = shard.occurrences() if len(shard.order) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        np.add.at(edge, place, 1)
        np.add.at(edge, place + block.window_length[window], -1)
        for pair in np.unique(shard.document(place) * len(block.window) + window).tolist():
            doc, w = divmod(pair, len(block.window))
            found.setdefault(doc, set()).update(block.names[i] for i in block.window_items[w])
    covered = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)])
    turn = np.diff(covered)
    begin, end = np.flatnonzero(turn > 0), np.flatnonzero(turn < 0)  # hit runs; the 0 after a document ends its run
    first, last = np.searchsorted(begin, starts[:-1]), np.searchsorted(begin, starts[1:])
    length = np.concatenate([[0], np.cumsum(end - begin)])
    packed = [np.stack([begin[a:b], end[a:b]], 1).astype("<i8").__isub__(s).tobytes() if b > a else b""
              for a, b, s in zip(first.tolist(), last.tolist(), starts[:-1].tolist())]
    made = [pa.array(count), pa.array(packed, pa.binary()), pa.array([sorted(found.get(i, ())) for i in range(len(count))], pa.list_(pa.string())),
            pa.array(length[last] - length[first])]
    yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=names)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    marked = annotate(docs, benchmark, **settings)
    return marked.where(~F.col(marked.columns[-1])).select(*marked.columns[:len(docs.columns)])


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                    item_text: str = "text", least: int = 1, block_words: int = 1_000_000, slice_bytes: int = 6 << 20) -> DataFrame:
    """Longest verbatim match of every benchmark suffix in the corpus, with its place (smallest doc_id, then position, on ties
    between shards): item_id, item_start, length, doc_id, doc_start, counted in words.  Suffixes without ``least`` words in
    common with any document have no row."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"item_id string, item_start long, length long, doc_id {kind}, doc_start long"
    made = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark, item_id, item_text, 1, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", slice_bytes):
                block = shared.value
                shard = Shard([words(t) for t in batch.column(1).to_pylist()], block)
                length, place = shard.longest()
                use = np.flatnonzero(length >= least)
                doc = shard.document(place[use])
                yield pa.RecordBatch.from_arrays([
                    pa.array([block.names[i] for i in block.suffix_item[use]], pa.string()), pa.array(block.suffix_start[use]),
                    pa.array(length[use]), batch.column(0).take(pa.array(doc)), pa.array(place[use] - shard.starts[doc])],
                    names=["item_id", "item_start", "length", "doc_id", "doc_start"])

        made = made.unionByName(own.mapInArrow(run, schema))
    best = F.max_by(F.struct("length", "doc_id", "doc_start"), F.struct("length", -F.col("doc_id"), -F.col("doc_start")))
    return made.groupBy("item_id", "item_start").agg(best.alias("best")).select("item_id", "item_start", "best.*")
