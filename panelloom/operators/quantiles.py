"""Exact quantiles without sorting a group in one task.

Values are first counted (map-side, so a value that fills a third of the rows is one row afterwards) and dealt by range over
all tasks.  The ranges' totals locate the ranks that are needed, and only the ranges holding those ranks are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None,
                    rule: str = "linear") -> DataFrame:
    """One row per group with one column per requested quantile, plus ``n``.

    ``rule='linear'`` interpolates between order statistics; ``rule='average'`` is the other common definition: with
    N*p whole the mean of that order statistic and the next, else the next one up.
    """
    by = list(by or [])
    keys = by or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(1))
    counts = source.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    # written out once: a range keeps its number whatever is computed from it
    bucketed = cut_lineage(counts.repartitionByRange(*keys, "_v").withColumn("_b", F.spark_partition_id()))
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = bucketed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc")).withColumns({
        "_start": F.coalesce(F.sum("_bc").over(earlier), F.lit(0)), "n": F.sum("_bc").over(W.partitionBy(*keys))})

    # one literal table of probabilities; ranks are worked out once from its column, however many there are
    wanted = F.array(*[F.struct(F.lit(name).alias("_name"), F.lit(float(p)).alias("_p")) for name, p in probs.items()])
    needed = (
        totals.withColumn("_w", F.explode(wanted))
        .select(*keys, "n", "_b", "_start", "_bc", "_w.*").withColumns(_ranks(F.col("_p"), rule))
        .where((F.col("_hi") >= F.col("_start")) & (F.col("_lo") < F.col("_start") + F.col("_bc")))
    )
    hit_buckets = needed.select(*keys, "_b", "_start").distinct()
    ordered = bucketed.select(*keys, "_b", "_v", "_c").join(hit_buckets, [*keys, "_b"])
    upto = F.sum("_c").over(W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow))
    ordered = ordered.withColumn("_last", F.col("_start") + upto).withColumn("_first", F.col("_last") - F.col("_c"))
    ranks = needed.select(*keys, "_b", "n", "_name", "_lo", "_hi", "_frac")
    held = ordered.join(ranks, [*keys, "_b"])
    lo = (F.col("_lo") >= F.col("_first")) & (F.col("_lo") < F.col("_last"))
    hi = (F.col("_hi") >= F.col("_first")) & (F.col("_hi") < F.col("_last"))
    found = held.groupBy(*keys, "_name").agg(
        F.max(F.when(lo, F.col("_v"))).alias("_vlo"), F.max(F.when(hi, F.col("_v"))).alias("_vhi"),
        F.first("_frac").alias("_frac"), F.first("n").alias("n"),
    )
    quantile = F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")
    wide = found.groupBy(*keys).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_name", quantile))).alias("_q"))
    return wide.select(*by, "n", *[F.try_element_at("_q", F.lit(q)).alias(q) for q in probs])


def _ranks(p: Column, rule: str) -> dict[str, Column]:
    n = F.col("n")
    if rule == "linear":
        h = (n - 1) * p
        lo = F.floor(h)
        hi, frac = F.ceil(h), h - lo
    elif rule == "average":
        h = n * p
        whole = h == F.floor(h)
        lo = F.greatest(F.when(whole, F.floor(h) - 1).otherwise(F.floor(h)), F.lit(0))
        hi = F.least(F.when(whole, lo + 1).otherwise(lo), n - 1)
        frac = F.lit(0.5)
    else:
        raise ValueError(f"unknown quantile rule {rule}")
    return {"_lo": lo.cast("long"), "_hi": hi.cast("long"), "_frac": frac.cast("double")}
