"""Byte-level BPE through a lazily determinised finite-state transducer, and streaming decode.

The merges of a rank file define which tokens may follow each other: a token sequence is an encoding exactly if every pair
of neighbours encodes to itself.  That is a non-deterministic transducer whose state is (last whole token, bytes of the
token being read).  It is determinised while it runs: a state holds every live alternative with the tokens it has not
agreed on yet, tokens that all alternatives share are emitted at once, and transitions are kept once they were built.
Lookahead is bounded, since an alternative dies as soon as its bytes are no prefix of any token.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import islice
from struct import pack, unpack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .batches import fresh_name, slices, widened
from .workers import held

PIECES, STATES, PAIRS = 200_000, 220_000, 600_000  # entries of the memos: pieces (two generations), states, pairs of tokens
PIECE_CHARS = 64  # longest piece that is remembered
FEW = 24  # a node with so many tokens below it, or fewer, is checked for a possible successor
NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Transducer:
    """Encodes one piece of text at a time; every memo is emptied when it is full."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.sorted = [ranks[data] for data in sorted(ranks)]
        self.trie: dict[int, int] = {}  # node << 8 | byte -> child << 20 | 1 + token that ends there, or 0 for none
        below: dict[int, int] = {}  # node -> first of the sorted tokens that begin with its bytes << 20 | their number
        for place, rank in enumerate(self.sorted):
            node, data = 0, self.token[rank]
            for n, byte in enumerate(data, 1):
                key = node << 8 | byte
                found = self.trie.get(key) or len(self.trie) + 1 << 20
                self.trie[key] = found = found | rank + 1 if n == len(data) else found
                node = found >> 20
                below[node] = below.get(node, place << 20) + 1
        self.below = {node: span for node, span in below.items() if span & 0xFFFFF <= FEW}
        self._tops: dict[int, tuple] = {}
        self._pairs: dict[int, bool] = {}
        self._open: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self._index: dict[bytes, int] = {}
        self._states: list[bytes] = []  # packed alternatives: last whole token, trie node, number of tokens not yet agreed on, those
        self._next: dict[int, int] = {}  # state << 8 | byte -> state
        self._emits: dict[int, tuple[int, ...]] = {}  # the same keys, where tokens are emitted
        self._ends: dict[int, tuple[int, ...]] = {}  # tokens still to emit where the data ends in a state
        self.start = self._state([(-1, (), 0)])

    def _state(self, alternatives: list[tuple]) -> int:
        flat = [x for last, waiting, node in alternatives for x in (last, node, len(waiting), *waiting)]
        packed = pack(f"<{len(flat)}i", *flat)
        if (found := self._index.get(packed)) is None:
            found = self._index[packed] = len(self._states)
            self._states.append(packed)
        return found

    def _alternatives(self, state: int) -> list[tuple]:
        packed = self._states[state]
        flat = unpack(f"<{len(packed) // 4}i", packed)
        out, i = [], 0
        while i < len(flat):
            end = i + 3 + flat[i + 2]
            out.append((flat[i], flat[i + 3:end], flat[i + 1]))
            i = end
        return out

    def _spines(self, token: int) -> tuple[bool, list[int], list[int]]:
        """Whether the token's bytes merge into it, and its tokens at the left and at the right edge from last made to first."""
        if (known := self._tops.get(token)) is None:
            data = self.token[token]
            parts = [data[i:i + 1] for i in range(len(data))]
            left, right = [self.ranks[parts[0]]], [self.ranks[parts[-1]]]
            while len(parts) > 1:
                best, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                if best == NEVER:
                    break
                if at == 0:
                    left.append(best)
                if at == len(parts) - 2:
                    right.append(best)
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            known = self._tops[token] = (len(parts) == 1, left[::-1], right[::-1])
        return known

    def _follows(self, left: int, right: int) -> bool:
        """Whether the border between two tokens survives: no merge across it comes before both edges have grown past it."""
        whole, starts, _ = self._spines(right)
        if not whole or left < 0:
            return whole
        token, ranks, ends = self.token, self.ranks, self._spines(left)[2]
        i = j = 0
        grown_left = grown_right = NEVER  # when the edge tokens are merged into something larger on their own side
        while True:
            across = ranks.get(token[ends[i]] + token[starts[j]], NEVER)
            if across < grown_left and across <= grown_right and across < NEVER:
                return False
            if i + 1 < len(ends) and (ends[i] > starts[j] or j + 1 == len(starts)):
                grown_left, i = ends[i], i + 1
            elif j + 1 < len(starts):
                grown_right, j = starts[j], j + 1
            else:
                return True

    def _pair(self, left: int, right: int) -> bool:
        key = left << 20 | right
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
                self._open.clear()
            known = self._pairs[key] = self._follows(left, right)
        return known

    def _possible(self, left: int, node: int) -> bool:
        """Whether some token that begins with the node's bytes can follow."""
        span = self.below.get(node)
        if span is None or left < 0:
            return True
        key = left << 20 | node
        if (known := self._open.get(key)) is None:
            first = span >> 20
            known = any(self._pair(left, token) for token in self.sorted[first:first + (span & 0xFFFFF)])
            self._open[key] = known
        return known

    def _step(self, state: int, byte: int) -> int:
        live, child = [], self.trie.get
        for last, waiting, node in self._alternatives(state):
            if found := child(node << 8 | byte):
                node, token = found >> 20, (found & 0xFFFFF) - 1
                if token >= 0 and self._pair(last, token):
                    live.append((last, waiting, node))
                    live.append((token, (*waiting, token), 0))
                elif self._possible(last, node):
                    live.append((last, waiting, node))
        common = live[0][1]
        for _, waiting, _ in live[1:]:
            n = 0
            while n < len(common) and n < len(waiting) and common[n] == waiting[n]:
                n += 1
            common = common[:n]
        if n := len(common):
            live = [(a, w[n:], p) for a, w, p in live]
            self._emits[state << 8 | byte] = common
        made = self._next[state << 8 | byte] = self._state(live)
        return made

    def encode(self, data: bytes) -> list[int]:
        state, out, known, emits = self.start, [], self._next, self._emits
        for byte in data:
            key = state << 8 | byte
            state = known.get(key)
            if state is None:
                if len(self._states) > STATES:  # inside a long piece too: go on from the same alternatives
                    live = self._alternatives(key >> 8)
                    self._reset()
                    known, emits = self._next, self._emits
                    key = self._state(live) << 8 | byte
                state = self._step(key >> 8, byte)
            if key in emits:
                out += emits[key]
        if data:
            end = self._ends.get(state)
            if end is None:
                end = self._ends[state] = next(waiting for _, waiting, node in self._alternatives(state) if not node)
            out += end
        return out


class _Pieces(dict):
    """Piece of text -> its ids as packed little-endian unsigned 32-bit integers; two generations of entries are kept."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = self.transducer.encode(piece.encode())
            packed = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= PIECE_CHARS:
            if len(self) >= PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Utf8Stream:
    """Incremental UTF-8: feed bytes, get the characters that are complete; a cut character waits for its rest."""

    #: lead byte range -> (continuation bytes, lowest and highest first continuation); the ranges of the UTF-8 standard
    LEADS = ((0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F),
             (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))

    def __init__(self):
        self.waiting = b""

    @classmethod
    def open_tail(cls, data: bytes) -> int:
        """How many bytes at the end begin a character without ending it."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if 0x80 <= lead < 0xC0:
                continue
            for low, high, more, first, last in cls.LEADS:
                if low <= lead <= high:
                    return back if back <= more and (back == 1 or first <= data[1 - back] <= last) else 0
            return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        cut = len(data) - self.open_tail(data)
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Encodes texts piece by piece and decodes id streams."""

    def __init__(self, path: str, pattern: str):
        self.pieces = _Pieces(Transducer(read_ranks(path)))
        self.token = self.pieces.transducer.token
        self.pattern = regex.compile(pattern)

    def encode(self, text: str, block: int = 1 << 18) -> bytes:
        if len(text) <= block:
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        found, out = (m.group() for m in self.pattern.finditer(text)), []
        while part := b"".join(map(self.pieces.__getitem__, islice(found, 1 << 16))):
            out.append(part)
        return b"".join(out)

    def decode_stream(self, packed: bytes, block: int = 1 << 16) -> Iterator[str]:
        stream, ids = Utf8Stream(), np.frombuffer(packed, "<u4")
        for i in range(0, len(ids), block):
            yield stream.feed(b"".join(map(self.token.__getitem__, ids[i:i + block].tolist())))
        yield stream.close()

    def decode(self, packed: bytes) -> str:
        return "".join(self.decode_stream(packed))


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec."""
    return held((path, pattern), lambda: Codec(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded",
           slice_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with the packed ids of ``text`` and, unless ``decoded`` is None, the text decoded from those ids.

    A row maps to a row, without a shuffle.  Null and empty texts have no ids; repeated rows repeat; other columns, whatever
    their names, are carried through (a new column whose name is taken gets underscores; ``docs.columns`` come first, the new
    ones last).  Texts of any length are read in blocks.
    """
    names = list(docs.columns)
    new = [fresh_name(names, ids)] + ([fresh_name([*names, ids], decoded)] if decoded else [])
    at = names.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, text, slice_bytes):
            packed = [own.encode(t or "") for t in batch.column(at).to_pylist()]
            made = [pa.array(packed, pa.binary())] + ([pa.array(map(own.decode, packed), pa.string())] if decoded else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, *new])

    return docs.mapInArrow(run, widened(docs.schema, **dict(zip(new, ("binary", "string")))))


def digests(encoded: DataFrame, keep: list[str], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Token count and SHA-256 of the packed ids and of the decoded bytes."""
    return encoded.select(*keep, (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                          F.sha2(F.encode(decoded, "utf-8"), 256).alias("decoded_sha256"))
