"""Language identification by the nearest of several centroids per language.

A text is the TF-IDF vector of its byte trigrams (ASCII letters in lower case, other ASCII bytes as spaces), hashed into a fixed
number of dimensions and normalised.  Each language's training vectors are clustered on the sphere; a text takes the language
of the centroid with the largest cosine.  It is rejected if that cosine lies below the language's limit, a share of the cosine
that all but one in a hundred of its training texts reach.  A text of few trigrams comes only about sqrt(n) as near to its
centroid as a long one, so cosines of texts of n < ``FULL`` trigrams are measured against sqrt(n / FULL).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .batches import fresh_name, slices, widened
from .workers import release

UNKNOWN = "und"
DIMENSIONS = 1 << 14
TEXT_BYTES = bytes(c if 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
ASCII_LETTER = re.compile("[A-Za-z]")
FULL = 400
PIECE = 1 << 20  # bytes of a text that are counted at a time


def has_letter(text: str | None) -> bool:
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def counts(text: str) -> np.ndarray:
    """Trigram counts of a whole text."""
    data = np.frombuffer(b" " + text.encode().translate(TEXT_BYTES) + b" ", np.uint8)
    total = np.zeros(DIMENSIONS)
    for start in range(0, len(data) - 2, PIECE):
        part = data[start:start + PIECE + 2].astype(np.uint32)
        code = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
        total += np.bincount((code * np.uint32(2654435761)) >> np.uint32(18), minlength=DIMENSIONS)
    total[(0x202020 * 2654435761 % (1 << 32)) >> 18] = 0  # runs of spaces say nothing
    return total


def vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised vectors and numbers of trigrams."""
    made, size = np.empty((len(texts), DIMENSIONS), np.float32), np.empty(len(texts))
    for i, text in enumerate(texts):
        found = counts(text)
        size[i] = found.sum()
        found *= idf
        made[i] = found / max(np.sqrt(found @ found), 1e-12)
    return made, size


@dataclass
class Model:
    """Bounded by dimensions x languages x centroids."""

    languages: list[str]  # of each centroid
    centroids: np.ndarray
    limits: np.ndarray
    idf: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        made, size = vectors(texts, self.idf)
        cosine = made @ self.centroids.T
        best = cosine.argmax(1)
        top = np.clip(cosine[np.arange(len(texts)), best].astype(float), 0, 1)
        return [self.languages[i] for i in best], top, top < self.limits[best] * reach(size)


def reach(size: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip(size / FULL, 1 / FULL, 1))


def cluster(data: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out first centres; empty clusters go."""
    centres = data[:1]
    while len(centres) < min(k, len(data)):
        centres = np.concatenate([centres, data[[(data @ centres.T).max(1).argmin()]]])
    for _ in range(rounds):
        own = (data @ centres.T).argmax(1)
        sums = (own[None, :] == np.unique(own)[:, None]).astype(np.float32) @ data
        centres = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-12)
    return centres


def fit(labelled: DataFrame, sample_key: Column, text: str = "text", lang: str = "lang", per_language: int = 800,
        clusters: int = 4, reject_below: float = 0.5, languages: int = 1_000) -> Model | None:
    """Learn centroids from about ``per_language`` rows of every language, taken by the hash of ``sample_key``.  More languages
    than ``languages`` would exceed the model's bound, and are an error.

    The sample's bounds are these parameters; everything else of the operator covers all rows.  None if nothing can be learned.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.pmod(F.xxhash64(sample_key), F.lit(1 << 30)).alias("draw")) \
        .where("lang is not null and text is not null")
    sizes = labelled.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")) \
        .limit(languages + 1).collect()
    if len(sizes) > languages:
        raise ValueError(f"more than {languages} languages; the bound is {languages}")
    if not sizes:
        return None
    rates = spark.createDataFrame([(row.lang, min(1 << 30, (per_language << 30) // row.n)) for row in sizes], "lang string, rate long")
    sample = cut_lineage(rows.join(F.broadcast(rates), "lang").where("draw < rate").select("lang", "text").repartition(16))

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(DIMENSIONS), 0
        for batch in batches:
            for t in filter(has_letter, batch.column("text").to_pylist()):
                found, n = found + (counts(t) > 0), n + 1
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()]), pa.array([n])], names=["found", "n"])

    parts = sample.mapInArrow(frequencies, "found binary, n long").collect()  # one bounded row for each task of the sample
    n = sum(row.n for row in parts)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + sum(np.frombuffer(row.found) for row in parts))).astype(np.float32) + np.float32(0.05)

    def centres(group: pa.Table) -> pa.Table:
        texts = [t for t in group.column("text").to_pylist() if has_letter(t)]
        made, usual = np.zeros((0, DIMENSIONS), np.float32), 0.0
        if texts:
            data, size = vectors(texts, idf)
            made = cluster(data, clusters)
            usual = float(np.quantile((data @ made.T).max(1) / reach(size), 0.01))
        return pa.table({"lang": pa.array([group.column("lang")[0].as_py()] * len(made), pa.string()),
                         "centre": pa.array([c.astype(np.float32).tobytes() for c in made], pa.binary()), "usual": pa.array([usual] * len(made), pa.float64())})

    found = sample.groupBy("lang").applyInArrow(centres, "lang string, centre binary, usual double").collect()
    found.sort(key=lambda row: (row.lang, row.centre))
    if not found:
        return None
    return Model([row.lang for row in found], np.stack([np.frombuffer(row.centre, np.float32) for row in found]),
                 reject_below * np.array([row.usual for row in found]), idf)


def predict(docs: DataFrame, model: Model | None, text: str = "text", slice_rows: int = 64) -> DataFrame:
    """``docs`` with lang_pred, score (cosine with the nearest centroid) and rejected; no shuffle, whole texts.

    Texts that are null or have no letter, and all texts if nothing was learned, get ``und``, score 0 and are rejected.  Equal
    cosines go to the smaller language.  Other columns are carried through; taken names get underscores.
    """
    names = list(docs.columns)
    new: list[str] = []
    for wanted in ("lang_pred", "score", "rejected"):
        new.append(fresh_name([*names, *new], wanted))
    at = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own = shared.value
        for batch in slices(batches, text, 16 << 20):
            for start in range(0, batch.num_rows, slice_rows):
                part = batch.slice(start, slice_rows)
                texts = part.column(at).to_pylist()
                lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                use = [i for i, t in enumerate(texts) if own is not None and has_letter(t)]
                if use:
                    found, score[use], rejected[use] = own.predict([texts[i] for i in use])
                    for i, name in zip(use, found):
                        lang[i] = name
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang), pa.array(score), pa.array(rejected)], names=[*names, *new])
        release()

    return docs.mapInArrow(run, widened(docs.schema, **dict(zip(new, ("string", "double", "boolean")))))
