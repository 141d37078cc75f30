"""Token counts of whole texts; huge texts are encoded as overlapping chunks that are spliced where both chunks agree.

A byte-level tokenizer splits text into pieces from left to right and looks ahead by one character at most, so from a place where
a piece begins everything that follows depends on the text after it only.  The first chunk is right from its start up to
``guard`` characters before its end (what lies there may be cut).  A place where it and the next chunk both begin a piece is
therefore right in both: the count runs on in the next chunk from there, and so on.  If an overlap has no such place, the text
goes into another round with larger chunks and overlaps, in the end as one chunk.

What a piece comes to is asked of the library once for each worker and held; texts with added tokens in them go to the library whole.
"""

from __future__ import annotations

import json
import os
from collections import ChainMap
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .batches import fresh_name, slices, widened
from .workers import held


#: Fixed value: the pieces of a byte-level tokenizer, in the order in which they are tried.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SETTLED = regex.compile(r"[\x00-ɏ]*+")  # letters that are the same in every version of Unicode that libraries use
PIECES_HELD, LONG = 1 << 18, 64


class Counter:
    """Tokens of texts, from a memo of the tokens of their pieces: a piece has as many tokens alone as inside its text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.library = Tokenizer.from_file(path)
        self.split = Split(Regex(PIECE), "isolated").pre_tokenize_str
        self.find = regex.compile(PIECE).findall
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        """Counts by the library itself."""
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def is_plain(self, text: str) -> bool:
        """Whether no added token stands in the text."""
        return not any(token in text for token in self.added)

    def pieces(self, text: str) -> list[str]:
        """The pieces of a plain text, which joined are the text."""
        return self.find(text) if SETTLED.fullmatch(text) else [piece for piece, _ in self.split(text)]

    def sizes(self, split: list[list[str]]) -> list[list[int]]:
        """Tokens of every piece."""
        fresh = list(set().union(*split) - self.known.keys())
        if len(self.known) + len(fresh) > PIECES_HELD:
            self.known.clear()
            fresh = list(set().union(*split))
        found = dict(zip(fresh, self.whole(fresh)))
        self.known.update((piece, n) for piece, n in found.items() if len(piece) <= LONG)
        lookup = ChainMap(found, self.known) if any(len(piece) > LONG for piece in fresh) else self.known
        return [[lookup[piece] for piece in pieces] for pieces in split]

    def count(self, texts: list[str]) -> list[int]:
        plain = [self.is_plain(text) for text in texts]
        by_piece = iter(self.sizes([self.pieces(text) for text, p in zip(texts, plain) if p]))
        by_library = iter(self.whole([text for text, p in zip(texts, plain) if not p]))
        return [sum(next(by_piece)) if p else next(by_library) for p in plain]

    def starts(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """Tokens of a chunk, where its pieces begin, and how many tokens lie before each."""
        if self.is_plain(text):
            pieces = self.pieces(text)
            tokens = np.array(self.sizes([pieces])[0], np.int64)
            width = np.fromiter(map(len, pieces), np.int64, len(pieces))
            return int(tokens.sum()), np.cumsum(width) - width, np.cumsum(tokens) - tokens
        encoded = self.library.encode(text, add_special_tokens=False)
        word, at = np.array(encoded.word_ids), np.array([start for start, _ in encoded.offsets], np.int64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        return len(encoded), at[first], first


def counter(path: str) -> Counter:
    """The worker's counter."""
    return held(("tokens", path), lambda: Counter(path))


def guard(path: str) -> int | None:
    """Characters at a chunk's end that may be cut; None if the tokenizer's pieces depend on more than what follows them."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    pre = said.get("pre_tokenizer") or {}
    added = said.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    # offsets of a post-processor may leave blanks out
    if not plain or said.get("normalizer") or said.get("post_processor") or (said.get("model") or {}).get("type") != "BPE":
        return None
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
        return None
    return 2 + max([0, *(len(t["content"]) for t in added)])


def _chunks(huge: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, part, is_last, start, piece) of huge texts (key, text); parts are dealt over all tasks, equal texts once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = max(1, -(-(len(text) - overlap) // chunk))
                rows = [(key, i, i == n - 1, i * chunk, text[i * chunk:] if i == n - 1 else text[i * chunk:(i + 1) * chunk + overlap]) for i in range(n)]
                for i in range(0, n, 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i:i + 64])], names=["key", "part", "is_last", "start", "piece"])

    made = huge.mapInArrow(run, "key string, part long, is_last boolean, start long, piece string")
    return made.groupBy("key", "part").agg(F.min("is_last").alias("is_last"), F.min("start").alias("start"), F.min("piece").alias("piece"))


def _spliced(huge: DataFrame, path: str, chunk: int, overlap: int, cut: int) -> DataFrame:
    """(key, n_tokens), null where some overlap has no common place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "piece", 1):
            key, part, is_last, start, piece = (batch.column(i)[0].as_py() for i in range(5))
            n, at, before = counter(path).starts(piece)
            head = (at <= overlap) & (part > 0)
            tail = (at >= len(piece) - overlap) & (at <= len(piece) - cut) & (not is_last)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (key, part, n)] + [
                pa.array([x[side]], pa.list_(pa.int64())) for side in (head, tail) for x in (at + start, before)], names=names)

    names = ["key", "part", "n", "head_at", "head_before", "tail_at", "tail_before"]
    chunks = cut_lineage(_chunks(huge, chunk, overlap).mapInArrow(
        run, "key string, part long, n long, head_at array<long>, head_before array<long>, tail_at array<long>, tail_before array<long>"))
    after = chunks.select("key", (F.col("part") - 1).alias("part"), "head_at", "head_before")
    common = F.array_min(F.array_intersect("tail_at", "head_at"))
    joined = chunks.where("part >= 0").select("key", "part", "n", "tail_at", "tail_before").join(after, ["key", "part"]).withColumn("at", common)
    change = F.get("tail_before", F.array_position("tail_at", F.col("at")).cast("int") - 1) - F.col("n") \
        - F.get("head_before", F.array_position("head_at", F.col("at")).cast("int") - 1)
    seams = joined.select("key", change.alias("n"), F.col("at").isNull().cast("int").alias("open"))
    whole = chunks.select("key", "n", F.lit(0).alias("open")).unionByName(seams).groupBy("key").agg(F.sum("n").alias("n"), F.max("open").alias("open"))
    return whole.select("key", F.when(F.col("open") == 0, F.col("n")).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, text: str = "text", chunk: int = 32_768, overlap: int = 1_024, wider: int = 8,
                 slice_bytes: int = 1 << 20) -> DataFrame:
    """``docs`` with n_tokens of the whole ``text``.

    Texts of up to ``chunk`` characters are counted where they are read; longer ones in chunks that are dealt over all tasks.
    Null is empty and has no tokens; equal huge texts are encoded once; other columns are carried through (taken names get
    underscores).  Where the tokenizer's pieces depend on what precedes them, every text is encoded whole.
    """
    names = list(docs.columns)
    new = fresh_name(names, "n_tokens")
    key = fresh_name([*names, new], "text_key")
    at, cut = names.index(text), guard(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, slice_bytes):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found = counter(path).whole(texts) if cut is None else counter(path).count(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*names, new])

    if cut is None:
        return docs.mapInArrow(run, widened(docs.schema, **{new: "long"}))
    is_huge = F.length(text) > chunk
    small = docs.where(~F.coalesce(is_huge, F.lit(False))).mapInArrow(run, widened(docs.schema, **{new: "long"}))
    huge = docs.where(is_huge)
    left = huge.select(F.sha2(text, 256).alias("key"), F.col(text).alias("text"))
    found = None
    while True:
        round_ = cut_lineage(_spliced(left, path, chunk, overlap, cut))
        done = round_.where("n_tokens is not null")
        found = done if found is None else found.unionByName(done)
        failed = round_.where("n_tokens is null").select("key")
        if failed.isEmpty():
            break
        left = left.join(failed, "key", "left_semi").select("key", "text")
        chunk, overlap = chunk * wider, overlap * wider
    counts = found.select(F.col("key").alias(key), F.col("n_tokens").alias(new))
    whole = huge.withColumn(key, F.sha2(text, 256)).join(counts, key).select(*[F.col(f"`{c}`") for c in [*names, new]])
    return small.unionByName(whole)
