"""Importance resampling towards a target distribution, over hashed word windows.

The tokenizers library's ``Split`` pre-tokeniser, with a pattern and nothing trained, returns the words of the lower-cased text with their
offsets.  Windows over the offset pairs are the features: a word, two neighbours, and so on, joined by one space.  A feature's
bucket is its CRC-32 modulo the number of buckets.  The CRC of a joined feature follows from those of its words: appending n
bytes to a CRC is a linear map that depends on n only, so runs of words are hashed as whole columns and no feature is ever
written out.

The corpus is tokenised once.  Every document's buckets are kept as a packed column in a scratch table; their histogram over all
documents and that of the target give each bucket's gain, and a second pass sums the gains.  Scores are whole numbers of a narrow
range, so ranks come from the counts of equal scores; only drawn rows are ordered, score by score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import Scratch
from .batches import slices
from .workers import held

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
PIECE = 1 << 16  # characters that are tokenised at once
LONG = 64  # bytes from which on a word is hashed on its own
WORDS_HELD = 1 << 18
SCORES = 256  # neighbouring scores counted together at first


@dataclass(frozen=True)
class Settings:
    """``runs``: words of the longest feature; ``percent`` of the documents with ``least_words`` words are drawn."""

    runs: int = 2
    buckets: int = 10_000
    percent: int = 25
    least_words: int = 20
    seed: str = "7"


class Splitter:
    """Words with their offsets, and CRC-32 sums of their runs."""

    def __init__(self):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex(WORD), behavior="removed", invert=True).pre_tokenize_str
        self.known: dict[str, tuple[int, int, int]] = {}
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
        #: shift[n, b, v]: what byte b of a CRC becomes, if its value is v, when n zero bytes are appended
        shift = np.zeros((LONG + 2, 4, 256), np.uint32)
        for b in range(4):
            shift[0, b] = np.arange(256, dtype=np.uint32) << np.uint32(8 * b)
        for n in range(1, LONG + 2):
            shift[n] = (shift[n - 1] >> np.uint32(8)) ^ table[shift[n - 1] & np.uint32(255)]
        self.shift = shift

    def words(self, text: str) -> Iterator[list[tuple[str, tuple[int, int]]]]:
        """(word, (start, end)) of a lower-cased text, in lists; cut between words only."""
        start = 0
        while start < len(text):
            stop = start + PIECE
            if stop < len(text):
                found = SEPARATOR.search(text, stop)
                stop = found.start() if found else len(text)
            part = self.split(text[start:stop])
            yield [(w, (a + start, b + start)) for w, (a, b) in part] if start else part
            start = stop

    def measure(self, word: str) -> tuple[int, int, int]:
        """CRC of the word, CRC of the word with a space after it, bytes."""
        if (found := self.known.get(word)) is None:
            raw = word.encode()
            crc = zlib.crc32(raw)
            found = (crc, zlib.crc32(b" ", crc), len(raw))
            if len(raw) <= LONG:
                if len(self.known) >= WORDS_HELD:
                    self.known.clear()
                self.known[word] = found
        return found

    def appended(self, crc: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
        """CRCs of texts with CRC ``crc``, each followed by ``size`` <= LONG bytes with CRC ``tail``."""
        out = tail.copy()
        for b in range(4):
            out ^= self.shift[size, b, (crc >> np.uint32(8 * b)) & np.uint32(255)]
        return out

    def features(self, text: str, runs: int) -> tuple[int, np.ndarray]:
        """Number of words, and the CRC-32 of every run of 1 to ``runs`` words."""
        lowered = text.encode().lower().decode()
        count, made = 0, []
        carried: list[tuple[str, tuple[int, int]]] = []
        for part in self.words(lowered):
            if not part:
                continue
            count += len(part)
            own = carried + part
            crc, spaced, size = np.array([self.measure(w) for w, _ in own], np.uint32).reshape(-1, 3).T
            fresh = len(carried)
            made.append(crc[fresh:])
            long = np.flatnonzero(size > LONG)
            running = spaced  # CRC of the run so far, with a space after it
            for n in range(2, runs + 1):
                if len(own) < n:
                    break
                last = np.arange(n - 1, len(own))
                joined = self.appended(running[:len(last)], crc[last], np.minimum(size[last], LONG))
                for i in long[long >= n - 1].tolist():  # long words have no shift table
                    joined[i - n + 1] = zlib.crc32(" ".join(lowered[a:b] for _, (a, b) in own[i - n + 1:i + 1]).encode())
                made.append(joined[last >= fresh])
                running = self.appended(joined, np.full(len(joined), zlib.crc32(b" "), np.uint32), np.ones(len(joined), np.int64))
            carried = own[-(runs - 1):] if runs > 1 else []
        return count, np.concatenate(made) if made else np.zeros(0, np.uint32)


def bucketed(texts: DataFrame, settings: Settings, slice_bytes: int = 4 << 20) -> DataFrame:
    """The other columns of ``texts``, n_words, n_features and the packed buckets of the column ``text``."""
    names = [c for c in texts.columns if c != "text"]
    kind = "<u2" if settings.buckets <= 1 << 16 else "<u4"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = held("importance", Splitter)
        for batch in slices(batches, "text", slice_bytes):
            counts, sizes, packed = [], [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                words, crc = splitter.features(text or "", settings.runs)
                counts.append(words)
                sizes.append(len(crc))
                packed.append((crc % np.uint32(settings.buckets)).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(packed, pa.binary())], names=[*names, "n_words", "n_features", "buckets"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return texts.mapInArrow(run, ", ".join(filter(None, [kept, "n_words long, n_features long, buckets binary"])))


def histogram(packed: DataFrame, settings: Settings) -> dict[int, int]:
    """How often each bucket occurs; at most ``settings.buckets`` numbers come to the driver."""
    kind = "<u2" if settings.buckets <= 1 << 16 else "<u4"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer(), kind), minlength=settings.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    counted = packed.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {row.bucket: row.n for row in counted.toLocalIterator()}


def gains(corpus: dict[int, int], target: dict[int, int], settings: Settings, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of the smoothed share in the target over that in the corpus) of every bucket."""
    s = np.array([corpus.get(b, 0) for b in range(settings.buckets)], np.float64)
    t = np.array([target.get(b, 0) for b in range(settings.buckets)], np.float64)
    ratio = ((t + 1) * (s.sum() + settings.buckets)) / ((s + 1) * (t.sum() + settings.buckets))
    return np.floor(scale * np.log(ratio)).astype(np.int64)


def weighed(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """``packed`` with the floored mean gain of each document's features (0 without any) instead of its buckets."""
    names = [c for c in packed.columns if c != "buckets"]
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(v.as_buffer(), kind) for v in batch.column(batch.schema.get_field_index("buckets"))]
            weight = [int(gain[b].sum()) // len(b) if len(b) else 0 for b in own]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(weight, pa.int64())],
                                             names=[*names, "weight"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema if f.name != "buckets")
    return packed.mapInArrow(run, f"{kept}, weight long")


def gumbel(doc_id: Column, seed: str) -> Column:
    """floor(1000 * Gumbel noise) drawn from the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """Rows of ``scored`` (score, doc_id, n_features, n_words, weight, n) with ``first``: 1 + the rows with a higher score, or the same one and a
    smaller (doc_id, n_features, ...).  Only the ``percent`` of a hundred with the highest scores are returned; ``n`` counts equal rows."""
    cell = F.floor(F.col("score") / F.lit(SCORES))
    per_score = scored.groupBy("score").agg(F.sum("n").alias("n"))
    per_cell = per_score.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n"))
    # a few hundred cells of neighbouring scores, whatever the number of documents
    ordered = W.orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, -1)
    above = per_cell.select("cell", F.coalesce(F.sum("n").over(ordered), F.lit(0)).alias("above"),
                            F.floor(F.lit(percent) * F.sum("n").over(W.partitionBy()) / 100).alias("drawn"))
    within = W.partitionBy("cell").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    before = per_score.withColumn("cell", cell).select("cell", "score", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inside")) \
        .join(above, "cell").select("score", (F.col("above") + F.col("inside")).alias("before"), "drawn").where("before < drawn")
    equal = W.partitionBy("score").orderBy("doc_id", "n_features", "n_words", "weight").rowsBetween(W.unboundedPreceding, -1)
    return scored.join(before, "score").withColumn("first", F.col("before") + F.coalesce(F.sum("n").over(equal), F.lit(0)) + 1)


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text",
             target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs``; rank is null unless the row is drawn.

    Whole texts are read, of ``docs`` and ``target`` alike; null and empty ones have no features and weight 0.  Rows with
    ``least_words`` words and an id compete; repeated rows compete each on its own and take consecutive ranks.  A null id has
    neither score nor rank.  Other columns are not read; an empty target leaves only the corpus's own rarity to weigh.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")
    packed = scratch.keep(bucketed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), settings), "buckets")
    wanted = histogram(bucketed(target.select(F.col(target_text).alias("text")), settings), settings)
    gain = gains(histogram(packed, settings), wanted, settings)
    scored = weighed(packed, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), settings.seed))
    scored = scratch.keep(scored, "scores")
    scratch.drop(packed)
    competes = (F.col("n_words") >= settings.least_words) & F.col("doc_id").isNotNull()
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    entries = scored.where(competes).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    drawn = ranked(entries, settings.percent)
    some = drawn.select(*columns, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("rank"), "drawn") \
        .select(*columns, F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).alias("rank"))
    others = scored.where(competes).join(drawn.select(F.col("score")).distinct(), "score", "left_anti")
    return some.unionByName(others.unionByName(scored.where(~competes)).select(*columns, F.lit(None).cast("long").alias("rank")))
