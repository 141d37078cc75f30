"""Importance resampling, substring removal and centroid clustering against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.llm import centroids, importance, substrings

DOCS = "doc_id long, text string"


# importance resampling -----------------------------------------------------------------------------------------------

def word_docs():
    rnd = random.Random(11)
    words = ["alpha", "beta", "Gamma", "ÄÖ", "x9", "déjà", "y" * 70, "z" * 64, "w" * 65]
    docs = [(i, rnd.choice([" ", ", ", "--"]).join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " .,"), (None, "alpha beta " * 30), (103, "A" * 300_000 + " alpha " * 40),
             (104, ("beta gamma, " * 20_000)), (105, docs[3][1])]
    return docs + [docs[5], (6, "alpha " * 25), (6, "alpha " * 25)]


def plain_features(text, runs):
    own = brute.WORD.findall(brute.lower(text))
    return len(own), [" ".join(own[i:i + n]) for n in range(1, runs + 1) for i in range(len(own) - n + 1)]


def plain_resample(docs, target, runs=2, buckets=10_000, percent=25, least=20):
    made = [plain_features(t, runs) for _, t in docs]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, own in made for f in own)
    t = Counter(bucket(f) for text in target for f in plain_features(text, runs)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in s}
    rows = []
    for (name, _), (words, own) in zip(docs, made):
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{name}".encode()).hexdigest()[:8], 16)
        score = None if name is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append((name, words, len(own), weight, score))
    compete = sorted((r for r in rows if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0], r[2], r[1], r[3]))
    drawn = [(*r, i + 1) for i, r in enumerate(compete[:percent * len(compete) // 100])]
    rest = Counter(rows) - Counter(r[:5] for r in drawn)
    return Counter(drawn) + Counter({(*r, None): n for r, n in rest.items()})


@pytest.mark.parametrize("runs, buckets, percent", [(2, 10_000, 25), (3, 50, 60), (1, 70_000, 100), (2, 7, 0)])
def test_resampling_equals_brute_force(spark, runs, buckets, percent):
    docs, target = word_docs(), ["Beta gamma beta", None, "", "déjà x9, alpha"]
    frame = spark.createDataFrame(docs, DOCS).withColumns({"RANK": F.lit("mine"), "n_words": F.lit(1), "bucket": F.lit(2)}).repartition(3)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance.resample(frame, items, importance.Settings(runs=runs, buckets=buckets, percent=percent))
    assert Counter(map(tuple, out.collect())) == plain_resample(docs, target, runs, buckets, percent)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    docs = spark.createDataFrame(word_docs(), DOCS)
    assert importance.resample(none, docs).collect() == []
    assert Counter(map(tuple, importance.resample(docs, none).collect())) == plain_resample(word_docs(), [])


def test_pieces_of_a_long_text_hold_every_word_once(monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 10)
    text = "alpha beta,gamma " * 9 + "q" * 50 + " end"
    splitter = importance.Splitter()
    assert [w for part in splitter.words(text) for w, (a, b) in part if text[a:b] == w] == brute.WORD.findall(text)
    assert sorted(splitter.features(text, 3)[1].tolist()) == sorted(zlib.crc32(f.encode()) for f in plain_features(text, 3)[1])


# substring removal ---------------------------------------------------------------------------------------------------

def passage_docs(words):
    rnd = random.Random(12)
    pool = [f"w{i}" for i in range(300)] + ["Ä", "W1"]
    base = [rnd.choice(pool) for _ in range(6 * words)]
    docs = []
    for i in range(60):
        own = [rnd.choice(pool) for _ in range(rnd.randint(0, 3 * words))]
        for _ in range(rnd.randint(0, 3)):  # passages around the limit, at any offset
            at, size, to = rnd.randrange(len(base)), rnd.choice([words - 1, words, words + 1, 2 * words]), rnd.randint(0, len(own))
            own[to:to] = base[at:at + size]
        docs.append((i, rnd.choice([" ", "\n", " \t"]).join(own)))
    rnd.shuffle(docs)
    docs += [(100 + i, docs[i % 3][1]) for i in range(9)]
    docs += [(200, None), (201, ""), (None, docs[0][1]), (202, "loop " * (3 * words)), (203, "loop " * (words + 5)), (204, "x" * 100_000 + " loop" * words)]
    return docs + [(3, docs[5][1]), (3, docs[6][1]), (50, docs[4][1]), (50, docs[4][1])]


def plain_passages(docs, words):
    split = [(name, (text or "").encode().split()) for name, text in docs]
    least = {}
    for name, own in split:
        for p in range(len(own) - words + 1):
            if name is not None:
                key = tuple(own[p:p + words])
                least[key] = min(least.get(key, name), name)
    out = []
    for name, own in split:
        gone = set()
        for p in range(len(own) - words + 1):
            if name is not None and least[tuple(own[p:p + words])] < name:
                gone.update(range(p, p + words))
        kept = [w for i, w in enumerate(own) if i not in gone]
        out.append((name, len(own), len(gone), brute.sha(b" ".join(kept))))
    return out


def test_cover_meets_every_shift():
    for words in (1, 2, 5, 13, 50, 77):
        period, cover = substrings.plan(words)
        assert 1 <= words - period + 1
        for p in range(period):
            for q in range(period):
                assert any((p + k) % period in cover and (q + k) % period in cover for k in range(period))
    assert substrings.plan(50)[0] == 31 and len(substrings.plan(50)[1]) == 6


@pytest.mark.parametrize("words, parts", [(50, 1), (50, 7), (13, 4), (1, 2)])
def test_passages_equal_brute_force(spark, words, parts):
    docs = passage_docs(words)
    frame = spark.createDataFrame(docs, DOCS).withColumns({"HASH": F.lit(1), "row": F.lit("mine"), "spans": F.lit(2)}).repartition(parts)
    found = substrings.repeated_passages(frame, words)
    rows = found.collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == Counter(plain_passages(docs, words))
    assert all(sum(s.end - s.begin for s in r.spans) == r.n_removed for r in rows)
    texts = substrings.without_passages(frame, found.dropDuplicates(["doc_id", "text_key"]))
    assert texts.columns == frame.columns
    want = Counter((name, sha) for name, _, _, sha in plain_passages(docs, words))
    assert Counter((r.doc_id, brute.sha(b" ".join((r.text or "").encode().split()))) for r in texts.collect()) == want


def test_passages_without_documents(spark):
    assert substrings.repeated_passages(spark.createDataFrame([], DOCS)).collect() == []


# centroid clustering -------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>"


def clustered_vectors(dim, n=400, middles=12, spread=0.02):
    rnd = np.random.default_rng(13)
    middle = rnd.normal(size=(middles, dim))
    rows = [(i, (middle[rnd.integers(middles)] + spread * rnd.normal(size=dim)).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [rows[3], (3, rows[4][1])]  # copies, a repeated row, a repeated id
    return rows + [(None, rows[0][1]), (2000, None), (2001, []), (2002, rows[0][1][1:]), (2003, [float("nan")] * dim), (2004, [None] * dim),
                   (2005, [float("inf")] * dim)]


def plain_clusters(rows, s):
    kept = [(i, [math.floor(s.scale * x) for x in v]) for i, v in rows
            if i is not None and v is not None and len(v) == s.dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{s.seed}:{i}".encode()).hexdigest(), v) for i, v in kept)
    middle = [v for _, v in order[:s.k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(middle))
    for _ in range(s.rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(middle)):
            if mine := [v for (_, v), c in zip(kept, own) if c == j]:
                middle[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    each = Counter()
    for _, c, d in found:
        each[c] += d
    return Counter((i, c, d, each[c], sum(each.values()), hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest()) for i, c, d in found)


@pytest.mark.parametrize("dim, k, scale, parts", [(64, 16, 64, 3), (3, 5, 1000, 1), (2, 700, 8, 2), (3, 4, 2e9, 2)])
def test_clusters_equal_brute_force(spark, dim, k, scale, parts):
    rows, settings = clustered_vectors(dim), centroids.Settings(k=k, dim=dim, scale=scale, block=16)
    frame = spark.createDataFrame(rows, VECTORS).withColumns({"CLUSTER": F.lit("mine"), "place": F.lit(1)}).repartition(parts)
    found, final = centroids.cluster(frame, settings)
    want = plain_clusters(rows, settings)
    if scale > 1e9:  # distances that no long holds are null
        assert Counter(r.cluster for r in found.collect()) == Counter(c for _, c, *_ in want.elements())
    else:
        assert Counter(map(tuple, centroids.with_inertia(found.drop("compared"), final).collect())) == want


def test_boxes_leave_few_candidates(spark):
    frame = spark.createDataFrame(clustered_vectors(64, n=3000, middles=40), VECTORS)
    found, _ = centroids.cluster(frame, centroids.Settings(block=16))
    assert found.agg(F.avg("compared")).first()[0] < 6  # of 16


def test_clusters_of_odd_tables(spark):
    for rows in ([], [(1, None)], [(None, [1.0] * 64)]):
        found, final = centroids.cluster(spark.createDataFrame(rows, VECTORS))
        assert centroids.with_inertia(found.drop("compared"), final).collect() == []
    found, final = centroids.cluster(spark.createDataFrame([(5, [0.5] * 64)], VECTORS))
    assert [(r.cluster, r.distance, r.inertia) for r in centroids.with_inertia(found, final).collect()] == [(0, 0, 0)]


def test_hilbert_keys_visit_neighbours():
    cells = np.array([[x, y] for x in range(16) for y in range(16)])
    keys = centroids.hilbert_keys(cells, 4)
    path = cells[sorted(range(256), key=lambda i: keys[i])]
    assert len(set(keys)) == 256 and (abs(np.diff(path, axis=0)).sum(1) == 1).all()
