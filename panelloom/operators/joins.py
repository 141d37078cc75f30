"""Enrichment joins.  Catalyst and AQE choose broadcast or shuffle from measured sizes; nothing is hinted here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.codes import strip_code_suffix, zero_pad
from ..functions.text import clean_title, described_title
from .pick import keep_first

SCORE_PREFIX = "observed_exposure_"


def score_columns(df: DataFrame) -> list[str]:
    """Score columns in reporting order: forest, weighted, nearest, then anything else by name."""
    order = [SCORE_PREFIX + m for m in ("rf", "cosine_weighted", "cosine_nearest")]
    found = [c for c in df.columns if c.startswith(SCORE_PREFIX)]
    return sorted(found, key=lambda c: (order.index(c) if c in order else len(order), c))


def with_descriptions(scored: DataFrame, descriptions: DataFrame, key: str = "occ_code", title: str = "title",
                      description: str = "onet_description") -> DataFrame:
    """Left-join descriptions on the normalised code and build the text to embed."""
    left = scored.withColumn(key, strip_code_suffix(key))
    right = descriptions.withColumn(key, strip_code_suffix(key)).where(F.col(key).isNotNull())
    return left.join(right, key, "left").withColumn("embedding_text", described_title(title, description))


def label_keys(facts: DataFrame, labels: DataFrame | None, key: str = "OCUP1", label: str = "occupation_title",
               allow_code_labels: bool = False) -> DataFrame:
    """Distinct keys with a cleaned label; unlabelled keys are an error or get ``"<key column> <key>"``."""
    keys = facts.select(key).where(F.col(key).isNotNull()).distinct()
    if labels is None:
        out = keys.withColumn(label, F.lit(None).cast("string"))
    else:
        out = keys.join(labels.select(key, label), key, "left")
    missing = F.coalesce(F.trim(label), F.lit("")) == ""
    if allow_code_labels:
        fallback = F.concat(F.lit(f"{key} "), F.col(key).cast("string"))
        out = out.withColumn(label, F.when(missing, fallback).otherwise(F.col(label)))
    else:
        first = [r[0] for r in out.where(missing).select(key).orderBy(key).limit(10).collect()]
        if first:
            raise ValueError(f"missing labels for {key} codes {first}; give labels or allow code labels")
    return out.withColumn(label, clean_title(label))


def override_label(df: DataFrame, labels: DataFrame, key: str = "OCUP1", label: str = "occupation_title") -> DataFrame:
    """A looked-up label wins over the row's own."""
    lookup = labels.select(key, F.col(label).alias("_label"))
    joined = df.join(lookup, key, "left").withColumn(label, F.coalesce("_label", label))
    return joined.select(*df.columns)


def attach_scores(facts: DataFrame, scores: DataFrame, key: str = "OCUP1") -> DataFrame:
    """Left join of a score table on the trimmed key; scores coerced to numbers."""
    columns = score_columns(scores)
    right = scores.select(
        F.trim(F.col(key).cast("string")).alias(key), *[F.col(c).try_cast("double").alias(c) for c in columns]
    )
    return facts.withColumn(key, F.trim(F.col(key).cast("string"))).join(right, key, "left")


def attach_weights(df: DataFrame, weights: DataFrame, key: str = "CNO2",
                   weight: str = "employment_weight") -> DataFrame:
    """Left join of weights; keys without one weigh 0."""
    return df.join(weights.select(key, weight), key, "left").withColumn(weight, F.coalesce(weight, F.lit(0.0)))


def overlapping(left: DataFrame, right: DataFrame, key: str = "quarter") -> DataFrame:
    """Inner join of two series; having nothing in common is an error."""
    out = left.join(right, key, "inner")
    if out.isEmpty():
        raise ValueError(f"the two series share no {key}")
    return out


def restrict_to(df: DataFrame, keep: DataFrame, key: str = "quarter") -> DataFrame:
    return df.join(keep.select(key).distinct(), key, "left_semi")


def drop_finished(df: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(finished.select(*keys).distinct(), keys, "left_anti")


def attach_treatment(panel: DataFrame, eligible: DataFrame, unit: str = "cno4", flag: str = "treated") -> DataFrame:
    """Keep eligible units only and carry their treatment flag."""
    return panel.join(eligible.select(unit, flag), unit, "inner")


def replace_keys(df: DataFrame, override: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of overridden keys are replaced by the override rows."""
    keys = [key] if isinstance(key, str) else key
    kept = df.join(override.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(override, allowMissingColumns=True)


def normalise_scores(scores: DataFrame, order: list[str | Column], code: str = "CNO4") -> DataFrame:
    """Score table ready to join on ``cno4``: padded key, title and score columns, one row per key."""
    out = scores.withColumnRenamed(code, "cno4") if code != "cno4" else scores
    if "occupation_title" not in out.columns and "spanish_title" in out.columns:
        out = out.withColumnRenamed("spanish_title", "occupation_title")
    out = out.withColumn("cno4", zero_pad("cno4", 4))
    ranked = out.withColumn("_order", F.struct(*order))
    keep = ["cno4", "occupation_title", *score_columns(out)]
    return keep_first(ranked.select(*keep, "_order"), ["cno4"], ["_order"]).select(*keep)
