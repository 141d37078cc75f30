"""Removal of long passages that an earlier document has, by difference-cover anchors.

A difference cover of period v is a set of residues whose differences are all residues modulo v.  For any two positions p and q
there is then a shift k < v with p + k and q + k both in the cover.  So if two documents share a window of ``words`` words, they share
an anchor of ``words - v + 1`` words that begins at a cover position in both, wherever the window lies in either: hashing
``len(cover)`` of every v positions finds all shared windows.

Anchors that two documents have go back to their documents.  Around such an anchor every window it can belong to is extended to its
full length.  Documents are dealt by the first document of most of their anchors, so copies meet in one batch,
where all but the first holder of a window are settled at once.  What is left, one row for each window of a batch that documents outside the
batch may hold too, is dealt by the window's 96-bit fingerprint, and the smallest document id holding it decides.  No pairs are made
anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import Scratch
from .batches import slices

ODD = np.uint64(0x9E3779B97F4A7C15)
SALT = (np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7))


def difference_cover(period: int) -> list[int]:
    """Smallest residues whose differences are all residues modulo ``period`` (the first such set in order)."""

    def extended(chosen: list[int], size: int) -> list[int] | None:
        if len(chosen) == size:
            return chosen if len({(a - b) % period for a in chosen for b in chosen}) == period else None
        for x in range(chosen[-1] + 1, period):
            if (found := extended([*chosen, x], size)) is not None:
                return found
        return None

    size = 1
    while (found := extended([0], size)) is None:
        size += 1
    return found


@lru_cache
def plan(words: int) -> tuple[int, list[int]]:
    """(period, cover): of the periods that leave anchors of two fifths of the window the one with the fewest cover positions."""
    options = [(v, difference_cover(v)) for v in (1, 3, 7, 13, 21, 31) if words - v + 1 >= max(1, 2 * words // 5)]
    return min(options, key=lambda o: len(o[1]) / o[0])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


def run_hashes(hashed: np.ndarray, size: int, salt: np.uint64) -> np.ndarray:
    """Hash of every run of ``size`` words, from runs of 1, 2, 4, ... words."""
    n = len(hashed) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, step, out, done = mixed(hashed + salt), 1, None, 0
    while True:
        if size & step:
            out = power[:n] if out is None else mixed(out * ODD + power[done:done + n])
            done += step
        if done == size:
            return out
        power = mixed(power[:-step] * ODD + power[step:])
        step *= 2


def anchors(docs: DataFrame, words: int) -> DataFrame:
    """(hash, doc_id): every document's distinct anchors; ``docs`` has doc_id and text."""
    period, cover = plan(words)
    chosen = np.zeros(period, bool)
    chosen[cover] = True

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            keys, owner = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = (text or "").encode().split()
                if doc is None or len(own) < words:
                    continue
                found = run_hashes(word_hashes(own), words - period + 1, SALT[0])
                found = np.unique(found[chosen[np.arange(len(found)) % period]])
                keys.append(found.view(np.int64))
                owner.append(np.full(len(found), doc, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owner))], names=["hash", "doc_id"])

    return docs.mapInArrow(run, "hash long, doc_id long")


def starts_near(at: np.ndarray, n: int, period: int) -> np.ndarray:
    """Of ``n`` windows those with an anchor (places ``at``) among their first ``period`` places, as a mask."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(np.maximum(at - period + 1, 0), n), 1)
    np.add.at(edge, np.minimum(at + 1, n), -1)
    return np.cumsum(edge[:-1]) > 0


def windows(near: DataFrame, words: int) -> DataFrame:
    """Rows of two kinds from documents with shared anchors (row, doc_id, text, shared).

    ``starts`` null: the first holders of a window inside a batch (h1, h2, doc_id, row, start), unless all documents that share one of its anchors are in
    the batch.  ``starts`` given: starts of the row's windows that a smaller doc_id of the same batch has too.
    """
    names = ["h1", "h2", "doc_id", "row", "start", "starts"]
    period, cover = plan(words)
    chosen = np.zeros(period, bool)
    chosen[cover] = True

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            lists = batch.column(3).flatten()
            known, first = np.unique(lists.field(0).to_numpy().view(np.uint64), return_index=True)
            holders = lists.field(1).to_numpy()[first]  # in how many rows of the whole table an anchor is
            rows, here = [], np.zeros(len(known), np.int64)
            for text in batch.column(2).to_pylist():
                hashed = word_hashes((text or "").encode().split())
                if len(hashed) < words:
                    rows.append((hashed, np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    continue
                found = run_hashes(hashed, words - period + 1, SALT[0])
                at = np.flatnonzero(chosen[np.arange(len(found)) % period])
                number = np.minimum(np.searchsorted(known, found[at]), len(known) - 1)
                shared = known[number] == found[at]
                rows.append((hashed, at[shared], number[shared]))
                here[np.unique(number[shared])] += 1
            elsewhere = here < holders
            h1, h2, start, size, opened = [], [], [], [], []
            for hashed, at, number in rows:
                n = max(0, len(hashed) - words + 1)
                use = np.flatnonzero(starts_near(at, n, period))
                opened.append(starts_near(at[elsewhere[number]], n, period)[use])
                h1.append(run_hashes(hashed, words, SALT[0])[use])
                h2.append((run_hashes(hashed, words, SALT[1])[use] >> np.uint64(32)).astype(np.uint32))
                start.append(use)
                size.append(len(use))
            h1, h2, start, opened = map(np.concatenate, (h1, h2, start, opened))
            place = np.repeat(np.arange(len(size)), size)
            doc = batch.column(1).to_numpy()[place]
            order = np.lexsort((doc, h2, h1))
            a, b, d = h1[order], h2[order], doc[order]
            head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(order) else np.zeros(0, np.int64)
            least = np.repeat(d[head], np.diff(np.append(head, len(order))))
            settled = np.zeros(len(order), bool)
            settled[order] = d > least
            row = batch.column(0).to_numpy()
            left = np.flatnonzero(~settled & opened)
            for cut in range(0, len(left), 1 << 16):
                use = left[cut:cut + (1 << 16)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(h1[use].view(np.int64)), pa.array(h2[use].view(np.int32)), pa.array(doc[use]), pa.array(row[place[use]]),
                    pa.array(start[use]), pa.nulls(len(use), pa.list_(pa.int64()))], names=names)
            ends = np.cumsum(size)
            done = [(int(row[i]), start[e - n:e][settled[e - n:e]]) for i, (e, n) in enumerate(zip(ends, size)) if settled[e - n:e].any()]
            if done:
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(len(done), pa.int64()), pa.nulls(len(done), pa.int32()), pa.nulls(len(done), pa.int64()),
                    pa.array([r for r, _ in done], pa.int64()), pa.nulls(len(done), pa.int64()), pa.array([s for _, s in done], pa.list_(pa.int64()))], names=names)

    return near.select("row", "doc_id", "text", "shared").mapInArrow(run, "h1 long, h2 int, doc_id long, row long, start long, starts array<long>")


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words and the digest of all words of every document (doc_id, text, text_key)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            own = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([len(w) for w in own], pa.int64()),
                pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in own], pa.string())], names=["doc_id", "text_key", "n_words", "digest"])

    return docs.mapInArrow(run, "doc_id long, text_key long, n_words long, digest string")


def cut_spans(near: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key, spans, n_removed, digest of documents that lose words; ``near`` has text and their windows' starts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            spans, removed, digests = [], [], []
            for text, parts in zip(batch.column(2).to_pylist(), batch.column(3)):
                own = (text or "").encode().split()
                at = np.unique(parts.values.to_numpy())
                begin = at[np.concatenate([[True], np.diff(at) > words])]
                end = at[np.concatenate([np.diff(at) > words, [True]])] + words
                spans.append([{"begin": b, "end": e} for b, e in zip(begin.tolist(), end.tolist())])
                removed.append(int((end - begin).sum()))
                for b, e in zip(begin[::-1].tolist(), end[::-1].tolist()):
                    del own[b:e]
                digests.append(hashlib.sha256(b" ".join(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "text_key", "spans", "n_removed", "digest"])

    return near.select("doc_id", "text_key", "text", "starts").mapInArrow(
        run, "doc_id long, text_key long, spans array<struct<begin:long,end:long>>, n_removed long, digest string")


def repeated_passages(docs: DataFrame, words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key (hash of the text), n_words, n_removed, spans (begin and end of the word runs that go) and kept_sha256 (of the kept
    words, joined by one space) of every row of ``docs``.

    A word goes if a window of ``words`` words covers it whose words also stand, in that order, in a row with a smaller doc_id; all windows are
    judged on the input.  Words are what white space (space and U+0009 to U+000D) separates, unchanged.  Null and empty texts, and texts of
    fewer words, lose nothing; rows that share a doc_id take nothing from each other; a row with a null id neither loses nor
    takes.  Other columns are not read.  ``without_passages`` gives the texts.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key"))
    found = anchors(docs.select("doc_id", "text"), words)
    first = found.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("holders"))
    first = first.where("first < last").select("hash", "first", "holders")
    shared = found.join(first, "hash").groupBy("doc_id").agg(
        F.mode("first", True).alias("home"), F.collect_list(F.struct("hash", "holders")).alias("shared"))
    near = docs.join(shared, "doc_id").hint("rebalance", "home").withColumn("row", F.monotonically_increasing_id())
    near = scratch.keep(near, "near")
    made = scratch.keep(windows(near, words), "windows")
    left = made.where("starts is null")
    owner = left.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last")
    gone = left.join(owner.select("h1", "h2", "owner"), ["h1", "h2"]).where("doc_id > owner").select("row", "start")
    later = gone.groupBy("row").agg(F.collect_list("start").alias("starts"))
    starts = made.where("starts is not null").select("row", "starts").unionByName(later).groupBy("row").agg(
        F.flatten(F.collect_list("starts")).alias("starts"))
    changed = scratch.keep(cut_spans(near.drop("shared").join(starts, "row"), words).dropDuplicates(["doc_id", "text_key"]), "changed")
    scratch.drop(near, made)
    every = digested(docs)
    lost = changed.select("doc_id", "text_key", "n_removed", "spans", F.col("digest").alias("new"))
    return every.join(lost, ["doc_id", "text_key"], "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("spans", F.array().cast("array<struct<begin:long,end:long>>")).alias("spans"), F.coalesce("new", "digest").alias("kept_sha256"))


def without_passages(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the spans of ``passages`` cut out of ``text``; texts that lose nothing stay as they are, the others' words are joined by
    one space."""
    cut = passages.where("n_removed > 0").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("spans").alias("_spans"))
    held = F.filter(F.split(F.col(text), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    kept = F.filter(held, lambda w, i: ~F.exists("_spans", lambda s: (i >= s["begin"]) & (i < s["end"])))
    joined = docs.join(cut, (docs[doc_id] == F.col("_doc")) & (F.xxhash64(docs[text]) == F.col("_key")), "left")
    return joined.select(*[F.when(F.col("_spans").isNull(), docs[c]).otherwise(F.array_join(kept, " ")).alias(c) if c == text else docs[c]
                           for c in docs.columns])
