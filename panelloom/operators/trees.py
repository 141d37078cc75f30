"""Regression trees on binned rows, many nodes of many trees at a time.

A level of nodes is split in array operations.  The best cut of a large node comes from histograms of its bins; the rows of small nodes,
which are nearly all nodes, are sorted by bin in a network of minima and maxima over all columns and nodes of about one size, so a small
node costs its rows and no histogram.  A cut is the one of the most gain in variance, and of equal ones that of the first column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BINS = 32
SMALL_SIZES = (2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 40, 48, 64)  # places of a small node; a larger one has histograms
CHUNK = 2 ** 14         # cells of one place, or of the histograms, that are worked on at once
BATCH_ROWS = 2 ** 18    # rows of the trees that are grown side by side
LEAST_GAIN = 1e-12      # of a node's squares; below it a gain is rounding
_PLACE, _OFTEN = 6, 4   # bits of a row's place and of how often it is in a sample


def cuts(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds of one column: between all its values if they are few, else where they are divided most evenly."""
    distinct, counts = np.unique(values, return_counts=True)
    upto = np.cumsum(counts)[:-1]
    if len(upto) < bins:
        at = np.arange(len(upto))
    else:
        wanted = np.arange(1, bins) * (len(values) / bins)
        after = np.clip(np.searchsorted(upto, wanted), 1, len(upto) - 1)
        at = np.unique(np.where(wanted - upto[after - 1] < upto[after] - wanted, after - 1, after))
    low, high = distinct[at], distinct[at + 1]
    middle = low / 2 + high / 2
    return np.where((low <= middle) & (middle < high), middle, low)


def binned(matrix: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    """How many thresholds of its column lie below each value."""
    out = np.empty(matrix.shape, np.uint8)
    for f, at in enumerate(thresholds):
        out[:, f] = np.searchsorted(at, matrix[:, f], side="left")
    return out


@dataclass
class Tree:
    """Nodes in the order of their levels.  A node's rows go to ``left`` if their bin is ``bin`` at most, else to the next one; a leaf
    has column -1, and its mean is ``value[left]``."""

    column: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def predict(self, rows: np.ndarray) -> np.ndarray:
        out, here, at = np.empty(len(rows)), np.arange(len(rows)), np.zeros(len(rows), np.intp)
        flat, width = rows.ravel(), rows.shape[1]
        while len(here):
            column = self.column[at]
            ended = column < 0
            if ended.any():
                out[here[ended]] = self.value[self.left[at[ended]]]
                going = ~ended
                here, at, column = here[going], at[going], column[going]
            at = self.left[at] + (flat[here * width + column] > self.bin[at])
        return out

    def packed(self) -> dict[str, pa.Array]:
        return {k: pa.array([getattr(self, k).astype(kind).tobytes()], pa.binary()) for k, kind in KINDS.items()}


STORED = "share int, number int, column binary, bin binary, left binary, value binary"
KINDS = {"column": np.int16, "bin": np.uint8, "left": np.int32, "value": np.float64}


def stored(row) -> Tree:
    return Tree(*[np.frombuffer(row[k], kind) for k, kind in KINDS.items()])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten()
    if column.null_count or flat.null_count or any(x != width for x in np.unique(np.diff(column.offsets.to_numpy()))):
        raise ValueError(f"vectors must be whole and of length {width}")
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _network(n: int) -> Iterator[tuple[int, int, int]]:
    """Merge exchange: (first place, distance, how many places in a row)."""
    p = 1
    while p < n:
        k = p
        while k >= 1:
            for j in range(k % p, n - k, 2 * k):
                run = [i for i in range(j, j + min(k, n - j - k)) if i // (2 * p) == (i + k) // (2 * p)]
                for a, b in _runs(run):
                    yield a, k, b - a
            k //= 2
        p *= 2


def _runs(numbers: list[int]) -> Iterator[tuple[int, int]]:
    start = None
    for i, x in enumerate(numbers):
        start = x if start is None else start
        if i + 1 == len(numbers) or numbers[i + 1] != x + 1:
            yield start, x + 1
            start = None


@lru_cache(maxsize=None)
def network(n: int) -> tuple[tuple[int, int, int], ...]:
    return tuple(_network(n))


class Grower:
    """Grows trees on ``bins`` (rows x columns) and ``y``."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, least: int, depth: int):
        self.bins, self.y, self.least, self.depth = bins, y, least, depth
        self.columns = np.ascontiguousarray(bins.T)

    def grow(self, weights: list[np.ndarray]) -> list[Tree]:
        """A tree for each vector of ``weights``: how often its sample has every row."""
        own = [np.flatnonzero(w) for w in weights]
        rows = np.concatenate(own)
        w = np.concatenate([x[i] for x, i in zip(weights, own)]).astype(float)
        sizes = np.array([len(i) for i in own])
        tree, levels = np.arange(len(weights)), []
        for level in range(self.depth + 1):
            count = len(sizes)
            mean = np.zeros(count)
            column, cut = np.full(count, -1, np.int16), np.zeros(count, np.uint8)
            if len(rows):  # an empty sample is a leaf of 0
                start = np.concatenate([[0], np.cumsum(sizes)])
                there = np.flatnonzero(sizes)
                at, y = start[there], self.y[rows]
                total = np.add.reduceat(w, at)
                mean[there] = np.add.reduceat(w * y, at) / total
                open_ = (total >= 2 * self.least) & (np.minimum.reduceat(y, at) < np.maximum.reduceat(y, at))
                if level < self.depth and open_.any():
                    there, total = there[open_], total[open_]
                    node = np.repeat(np.arange(count), sizes)
                    centred = y - mean[node]
                    squares = np.add.reduceat(w * centred * centred, at)[open_]
                    gain, f, b = self._split(rows, w, w * centred, start[there], sizes[there], total)
                    found = gain * total > LEAST_GAIN * squares
                    column[there[found]], cut[there[found]] = f[found], b[found]
            split = column >= 0
            levels.append((tree, column, cut, mean, split))
            if not split.any():
                break
            keep = split[node]
            rows, w, node = rows[keep], w[keep], node[keep]
            parents = np.flatnonzero(split)
            number = (np.cumsum(split) - 1)[node]
            right = self.bins[rows, column[node]] > cut[node]
            child = 2 * number + right
            sizes = np.bincount(child, minlength=2 * len(parents))
            # stable: the rows of a node keep their order
            rank = np.cumsum(right)
            first = np.concatenate([[0], np.cumsum(sizes[0::2] + sizes[1::2])])
            before = np.concatenate([[0], rank])[first[:-1]]
            rank -= before[number]
            here = np.arange(len(rows)) - first[number]
            to = first[number] + np.where(right, sizes[0::2][number] + rank - 1, here - rank)
            moved, weight = np.empty_like(rows), np.empty_like(w)
            moved[to], weight[to] = rows, w
            rows, w, tree = moved, weight, np.repeat(tree[parents], 2)
        return self._trees(levels, len(weights))

    @staticmethod
    def _trees(levels: list[tuple], count: int) -> list[Tree]:
        tree, column, cut, mean, split = (np.concatenate(x) for x in zip(*levels))
        # a parent's children are two neighbours of the next level
        begins = np.cumsum([0, *(len(x[0]) for x in levels)])
        left = np.zeros(len(tree), np.int64)
        for i, (*_, cutting) in enumerate(levels):
            left[begins[i]:begins[i + 1]][cutting] = begins[i + 1] + 2 * np.arange(cutting.sum())
        order = np.argsort(tree, kind="stable")
        first = np.searchsorted(tree[order], np.arange(count + 1))
        place = np.empty(len(tree), np.int64)
        place[order] = np.arange(len(tree)) - first[tree[order]]
        out = []
        for t in range(count):
            own = order[first[t]:first[t + 1]]
            leaf = column[own] < 0
            at = np.where(leaf, np.cumsum(leaf) - 1, place[left[own]])
            out.append(Tree(column[own], cut[own], at.astype(np.int32), mean[own[leaf]]))
        return out

    def _split(self, rows, w, wy, start, size, total) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gain (over the node's weight), column and bin of the best cut of each node; ``wy`` adds up to 0 in each."""
        gain, f, b = np.zeros(len(start)), np.zeros(len(start), np.int16), np.zeros(len(start), np.uint8)
        classes = np.searchsorted(SMALL_SIZES, size)
        classes[np.maximum.reduceat(np.append(w, 0), np.stack([start, start + size], 1).ravel())[::2] >= 1 << _OFTEN] = len(SMALL_SIZES)
        order = np.argsort(classes, kind="stable")
        ends = np.searchsorted(classes[order], np.arange(len(SMALL_SIZES) + 2))
        each = max(1, CHUNK // self.bins.shape[1])
        for c in np.flatnonzero(np.diff(ends)):
            own = order[ends[c]:ends[c + 1]]
            if c == len(SMALL_SIZES):
                gain[own], f[own], b[own] = self._large(rows, w, wy, start[own], size[own], total[own])
                continue
            for i in range(0, len(own), each):
                part = own[i:i + each]
                gain[part], f[part], b[part] = self._small(rows, w, wy, start[part], size[part], total[part], SMALL_SIZES[c])
        return gain, f, b

    def _large(self, rows, w, wy, start, size, total):
        count, width = len(start), len(self.columns)
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        at = np.arange(size.sum()) + np.repeat(start - first, size)
        own, w, wy = rows[at], w[at], wy[at]
        base = np.repeat(np.arange(count) * BINS, size)
        best, f, b = np.zeros(count), np.zeros(count, np.int16), np.zeros(count, np.uint8)
        each = max(1, CHUNK // (count * BINS))
        n, limit = total[:, None], self.least * (total - self.least)[:, None]
        for f0 in range(0, width, each):
            many = min(each, width - f0)
            counts, sums = np.empty((many, count * BINS)), np.empty((many, count * BINS))
            for j in range(many):
                cell = base + self.columns[f0 + j].take(own)
                counts[j] = np.bincount(cell, w, count * BINS)
                sums[j] = np.bincount(cell, wy, count * BINS)
            left = np.cumsum(counts.reshape(many, count, BINS), axis=2)
            of = np.cumsum(sums.reshape(many, count, BINS), axis=2)
            d = left * (n - left)
            np.copyto(d, np.inf, where=d < limit)
            of *= of
            of /= d
            bin_ = of.argmax(axis=2)
            most = np.take_along_axis(of, bin_[:, :, None], 2)[:, :, 0]
            j = most.argmax(axis=0)
            here = np.arange(count)
            better = most[j, here] > best
            best[better], f[better], b[better] = most[j, here][better], (f0 + j)[better], bin_[j, here][better]
        return best, f, b

    def _small(self, rows, w, wy, start, size, total, places: int):
        count, width = len(start), self.bins.shape[1]
        cells, place = count * width, np.arange(places, dtype=np.uint16)[:, None]
        real = place < size
        at = np.where(real, start + place, 0)
        often, adds = np.where(real, w[at], 0), np.where(real, wy[at], 0)
        keys = self.bins[rows[at]].astype(np.uint16)  # place x node x column: bin, how often, place
        keys[~real] = BINS
        keys <<= _OFTEN + _PLACE
        keys |= (often.astype(np.uint16) << _PLACE | place)[:, :, None]
        keys = keys.reshape(places, cells)
        spare = np.empty((places, cells), np.uint16)
        for a, k, run in network(places):
            low, high, tmp = keys[a:a + run], keys[a + k:a + k + run], spare[:run]
            np.minimum(low, high, out=tmp)
            np.maximum(low, high, out=high)
            low[:] = tmp
        table = np.zeros((count, 1 << _PLACE), np.float32)
        table[:, :places] = adds.T
        first = np.repeat(np.arange(count) << _PLACE, width)
        n = np.repeat(total, width).astype(np.float32)
        limit = np.float32(self.least) * (n - np.float32(self.least))
        left, of, best = np.zeros((3, cells), np.float32)
        d, gain, took = np.empty((3, cells), np.float32)
        cell, number, cut, enough = np.empty(cells, np.intp), spare[0], np.empty(cells, bool), np.empty(cells, bool)
        for m in range(places - 1):
            np.bitwise_and(keys[m], (1 << _PLACE) - 1, out=number)
            cell[:] = number
            cell += first
            np.take(table, cell, out=took, mode="wrap")
            of += took
            np.right_shift(keys[m], _PLACE, out=number)
            np.bitwise_and(number, (1 << _OFTEN) - 1, out=number)
            took[:] = number
            left += took
            np.subtract(n, left, out=d)
            d *= left
            np.greater_equal(d, limit, out=enough)  # on both sides
            np.bitwise_xor(keys[m], keys[m + 1], out=number)
            np.greater_equal(number, 1 << _OFTEN + _PLACE, out=cut)
            cut &= enough
            np.maximum(d, 0.5, out=d)
            np.multiply(of, of, out=gain)
            gain /= d
            took[:] = cut
            gain *= took
            np.maximum(best, gain, out=best)
        best = best.reshape(count, width)
        f, here = best.argmax(axis=1), np.arange(count)
        return best[here, f], f, self._cut(keys.reshape(places, count, width)[:, here, f], table, total, best[here, f])

    def _cut(self, keys, table, total, best) -> np.ndarray:
        """The first bin after which a column, whose sorted keys are given, has its best gain."""
        often = (keys >> _PLACE & (1 << _OFTEN) - 1).astype(np.float32)
        adds = table[np.arange(len(total)), (keys & (1 << _PLACE) - 1).astype(np.intp)]
        # the operations of the search, in its order
        left, of, n = np.cumsum(often, axis=0)[:-1], np.cumsum(adds, axis=0)[:-1], total.astype(np.float32)
        d = (n - left) * left
        good = (d >= np.float32(self.least) * (n - np.float32(self.least))) & ((keys[:-1] ^ keys[1:]) >= 1 << _OFTEN + _PLACE)
        good &= of * of / np.maximum(d, np.float32(0.5)) == best
        return keys[good.argmax(axis=0), np.arange(len(total))] >> _OFTEN + _PLACE


def sample(rows: int, seed: int, tree: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap sample."""
    return np.random.default_rng([seed % 2 ** 63, tree]).poisson(1.0, rows)


def grow(bins: np.ndarray, y: np.ndarray, trees: range, seed: int, least: int, depth: int) -> Iterator[Tree]:
    """Trees of these numbers on bootstrap samples.  A tree depends on the rows, the seed and its number, not on the order the rows come in or
    on the trees that are grown with it."""
    order = np.lexsort((y, np.ascontiguousarray(bins).view(f"S{bins.shape[1]}").ravel()))
    grower = Grower(bins[order], y[order], least, depth)
    at_once = max(1, BATCH_ROWS // len(y))
    for i in range(0, len(trees), at_once):
        yield from grower.grow([sample(len(y), seed, t) for t in trees[i:i + at_once]])
