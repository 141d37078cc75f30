"""Plain versions of the operators for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANKS = " \t\n\x0b\x0c\r"


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def contamination(docs, items, window=13):
    """docs: (id, text), items: (id, text) -> (id, words, hit, sorted items, contaminated) in the order of docs."""
    windows = defaultdict(set)
    for name, text in items:
        own = WORD.findall(lower(text))
        for p in range(max(1, len(own) - window + 1) if own and name is not None else 0):
            windows[tuple(own[p:p + window])].add(str(name))
    out = []
    for name, text in docs:
        own = WORD.findall(lower(text))
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for p in range(len(own) - size + 1):
                if (names := windows.get(tuple(own[p:p + size]))) is not None:
                    found |= names
                    hit.update(range(p, p + size))
        out.append((name, len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own)))
    return out


def lines(docs, least_docs=3, least_chars=20):
    """docs: (id, text) -> (id, lines, dropped, kept)."""
    keys = [[lower(row).strip(BLANKS) for row in (text or "").split("\n")] for _, text in docs]
    holders = defaultdict(list)
    for (name, _), own in zip(docs, keys):
        for key in {k for k in own if len(k) >= least_chars}:
            holders[key].append(name)
    last = {k: max((n for n in names if n is not None), default=None) for k, names in holders.items() if len(names) >= least_docs}
    out = []
    for (name, text), own in zip(docs, keys):
        drop = [k in last and last[k] is not None and (name is None or name < last[k]) for k in own]
        out.append((name, len(own), sum(drop), "\n".join(row for row, d in zip((text or "").split("\n"), drop) if not d)))
    return out


def shingle_set(text, words):
    own = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    if not own:
        return frozenset()
    return frozenset(tuple(own[i:i + words]) for i in range(max(1, len(own) - words + 1)))


def near_duplicates(docs, words, percent):
    """docs: (id, text) with distinct ids -> {id: (shingles, component, kept)}."""
    sets = {name: shingle_set(text, words) for name, text in docs}
    root = {name: name for name in sets}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {n: (len(sets[n]), top(n), top(n) == n) for n in names}
