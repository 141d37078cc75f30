"""Text enrichment through a keyed cache: each distinct cleaned text reaches the provider once.

The provider is any ``list[str] -> list`` callable; it runs inside ``mapInPandas``, so calls are spread over the cluster.
New answers are appended to the cache in small units (see ``asking``) before anything reads them: a call that fails loses its own
answers only, runs at the same time do not ask twice, and a retry or a second use never asks again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import cache_key, clean_title
from .asking import answer_all

EMBEDDING_CACHE = "cache_key string, model string, normalized_text string, dimension int, vector array<double>"
TRANSLATION_CACHE = ("cache_key string, provider_id string, source_lang string, target_lang string, source_text string, "
                     "translated_text string, stored_at timestamp")

#: Titles whose machine translation misleads, with the translation to use.
TRANSLATION_OVERRIDES = {
    "Trabajadores de servicios de restauración, personales, protección y vendedores de comercio":
        "Food service, catering, hospitality, personal service, protection, and retail sales workers",
    "Directores y gerentes de empresas de alojamiento, restauración y comercio":
        "Directors and managers of accommodation, food service, catering, hospitality, and retail businesses",
    "Trabajadores asalariados de los servicios de restauración":
        "Salaried food service, catering, and hospitality workers",
}


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def guarded(frames: Iterator[pd.DataFrame], batch: int, reply: Callable[[pd.DataFrame], pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """``reply`` (columns ``names``) for parts of ``batch`` rows; a part it fails on comes back as one row with the column error."""
    for frame in frames:
        for start in range(0, len(frame), batch):
            part = frame.iloc[start:start + batch]
            try:
                yield reply(part)[names].astype(object).assign(error=None)
            except Exception as error:  # whatever a provider raises is told when the other answers are stored
                told = f"{type(error).__name__}: {error}"[:500]
                yield pd.DataFrame([[None] * len(names) + [told]], columns=[*names, "error"], dtype=object)


def embed(texts: DataFrame, text: str, provider: Callable[[list[str]], list], cache: str, model: str,
          batch: int = 256, **asking) -> DataFrame:
    """``text, embedding`` per distinct cleaned text; ``asking`` goes to ``answer_all``."""
    spark = texts.sparkSession
    wanted = texts.where(F.col(text).isNotNull()).select(clean_title(text).alias("text")).distinct().withColumn(
        "cache_key", cache_key(model, F.col("text")))
    names = ["cache_key", "model", "normalized_text", "dimension", "vector"]

    def missing() -> DataFrame:
        return wanted.join(read_or_empty(spark, cache, EMBEDDING_CACHE).select("cache_key"), "cache_key", "left_anti")

    def reply(part: pd.DataFrame) -> pd.DataFrame:
        vectors = [[float(x) for x in v] for v in provider(part["text"].tolist())]
        if len(vectors) != len(part):
            raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
        return pd.DataFrame({"cache_key": part["cache_key"].to_numpy(), "model": model, "normalized_text": part["text"].to_numpy(),
                             "dimension": [len(v) for v in vectors], "vector": vectors})

    def ask(rows: DataFrame) -> DataFrame:
        return rows.mapInPandas(lambda frames: guarded(frames, batch, reply, names), EMBEDDING_CACHE + ", error string")

    answer_all(missing, ask, cache, spark, **asking)
    # a key that two runs stored at once counts once
    stored = read_or_empty(spark, cache, EMBEDDING_CACHE).groupBy("cache_key").agg(F.min("vector").alias("embedding"))
    return wanted.join(stored, "cache_key").select("text", "embedding")


def translate(texts: DataFrame, text: str, provider: Callable[[list[str]], list[str]], cache: str, provider_id: str,
              overrides: dict[str, str] | None = None, source_lang: str = "es", target_lang: str = "en",
              batch: int = 256, **asking) -> DataFrame:
    """``text, translation`` per distinct cleaned text: overrides first (they also correct the cache), then the cache,
    then the provider.  An empty translation is an error.  ``asking`` goes to ``answer_all``."""
    spark = texts.sparkSession
    overrides = TRANSLATION_OVERRIDES if overrides is None else overrides
    key = cache_key(provider_id, source_lang, target_lang, F.col("text"))
    wanted = texts.where(F.col(text).isNotNull()).select(clean_title(text).alias("text")).distinct().withColumn(
        "cache_key", key)
    pairs = [F.lit(x) for kv in overrides.items() for x in kv] or [F.lit(""), F.lit("")]
    fixed = wanted.withColumn("translation", F.try_element_at(F.create_map(*pairs), F.col("text")))
    def state() -> DataFrame:
        return fixed.join(_latest(read_or_empty(spark, cache, TRANSLATION_CACHE)), "cache_key", "left")

    def stamped(answers: DataFrame) -> DataFrame:
        return answers.select(
            "cache_key", F.lit(provider_id).alias("provider_id"), F.lit(source_lang).alias("source_lang"),
            F.lit(target_lang).alias("target_lang"), F.col("text").alias("source_text"),
            F.col("translation").alias("translated_text"), F.current_timestamp().alias("stored_at"), *[c for c in answers.columns if c == "error"])

    def missing() -> DataFrame:
        return state().where("translation IS NULL AND cached IS NULL").select("cache_key", "text")

    def reply(part: pd.DataFrame) -> pd.DataFrame:
        answers = [" ".join(str(a).split()).strip("\"'") for a in provider(part["text"].tolist())]
        empty = [source for source, answer in zip(part["text"], answers) if not answer]
        if empty or len(answers) != len(part):
            raise ValueError(f"empty translation from {provider_id} for: {empty[0]}" if empty else f"{len(answers)} translations for {len(part)} texts")
        return part.assign(translation=answers)

    def ask(rows: DataFrame) -> DataFrame:
        return stamped(rows.mapInPandas(lambda frames: guarded(frames, batch, reply, ["cache_key", "text", "translation"]),
                                        "cache_key string, text string, translation string, error string"))

    corrections = state().where("translation IS NOT NULL AND NOT (translation <=> cached)").select("cache_key", "text", "translation")
    stamped(corrections).write.mode("append").parquet(cache)
    answer_all(missing, ask, cache, spark, **asking)
    stored = _latest(spark.read.schema(TRANSLATION_CACHE).parquet(cache))
    return wanted.join(stored, "cache_key").select("text", F.col("cached").alias("translation"))


def _latest(cache: DataFrame) -> DataFrame:
    return cache.groupBy("cache_key").agg(F.max_by("translated_text", "stored_at").alias("cached"))


def letter_counts(texts: list[str]) -> list[list[float]]:
    """A deterministic provider for tests and offline runs: how often each letter a-z occurs."""
    return [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]
