"""One row per key: keep-first, argmax and key-set operators.

All of them aggregate (``min_by``/``max_by``) instead of ranking inside a window, so each task sends one candidate per
key and a key that holds a large share of the rows never has to be gathered or sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row per key under an explicit order."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    sort_key = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"k{i}") for i, o in enumerate(order)])
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), sort_key).alias("_first"))
    return first.select(*keys, "_first.*").select(*df.columns)


def arg_max(df: DataFrame, keys: list[str], payload: list[str], value: str, ordinal: str) -> DataFrame:
    """Row with the largest ``value`` per key; ties go to the smallest ``ordinal``."""
    best = F.max_by(F.struct(*payload), F.struct(F.col(value), -F.col(ordinal)))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def distinct_keys_missing_from(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``done``."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicate keys with their counts; an empty result means the keys identify the rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` itself, failing at run time on the first key that occurs twice."""
    bad = assert_unique(df, keys).limit(1).collect()
    if bad:
        raise ValueError(f"{keys} do not identify rows: {bad[0].asDict()}")
    return df


def ordered_head(df: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first ``n`` rows in order (top-k per task, then a merge); all rows when ``n`` is empty."""
    return df.orderBy(*order).limit(n) if n else df


def with_ordinal(df: DataFrame, key: str, name: str = "ordinal") -> DataFrame:
    """Number the rows 0, 1, 2, ... in the order of ``key`` (unique) without bringing them into one task.

    Rows are range-partitioned and written out, then numbered inside each range from the range's offset.
    """
    ranges = cut_lineage(df.repartitionByRange(F.col(key)).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offset = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = ranges.withColumn("_i", F.row_number().over(W.partitionBy("_range").orderBy(key)) - 1)
    return numbered.join(sizes.select("_range", offset.alias("_offset")), "_range").select(
        *df.columns, (F.col("_offset") + F.col("_i")).cast("long").alias(name))
