"""Roll-ups through code hierarchies with survey weights and explicit coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import to_number
from ..functions.periods import month_start, quarter_label
from .joins import SCORE_PREFIX, attach_scores, attach_weights, score_columns

#: How a row says where its weights came from.
EQUAL_SOURCE = "equal CNO4 weights"
WEIGHTED_SOURCE = "INE EPA table 65134 CNO2 employment weights"
UNMATCHED_SOURCE = "equal CNO4 weights; no matching INE EPA CNO2 weight"


def weighted_exposure(micro: DataFrame, scores: DataFrame, unit: str = "OCUP1", industry: str = "ACT1",
                      period: str = "quarter", weight: str | None = None, labels: DataFrame | None = None,
                      coverage: str = "primary") -> DataFrame:
    """Industry x period weighted mean of every score, with total and covered weight.

    Records collapse to (industry, period, unit) weights before anything is joined, so the score table meets cells and
    not records and a unit holding most of the records costs one row per task.  ``coverage='primary'`` divides every
    score by the weight covered by the first score column; ``'per_score'`` by its own covered weight.
    """
    columns = score_columns(scores)
    if not columns:
        raise ValueError(f"the score table has no {SCORE_PREFIX}* column")
    w = to_number(weight, 0.0) if weight else F.lit(1.0)
    cells = (
        micro.select(
            F.trim(F.col(industry).cast("string")).alias(industry), F.col(period),
            F.trim(F.col(unit).cast("string")).alias(unit), w.alias("_w"),
        )
        .groupBy(industry, period, unit).agg(F.sum("_w").alias("_w"))
    )
    joined = attach_scores(cells, scores, unit)
    primary = columns[0]
    aggregates = [
        F.sum("_w").alias("total_weight"),
        F.sum(F.when(F.col(primary).isNotNull(), F.col("_w")).otherwise(0.0)).alias("covered_weight"),
        F.count_distinct(F.struct(unit)).alias("occupation_count"),
    ]
    for c in columns:
        aggregates.append(F.sum(F.coalesce(F.col("_w") * F.col(c), F.lit(0.0))).alias(f"_sum_{c}"))
        aggregates.append(F.sum(F.when(F.col(c).isNotNull(), F.col("_w")).otherwise(0.0)).alias(f"_cov_{c}"))
    grouped = joined.groupBy(industry, period).agg(*aggregates)
    grouped = grouped.where((F.col("total_weight") > 0) & (F.col("covered_weight") > 0))
    means = [
        (F.col(f"_sum_{c}") / (F.col("covered_weight") if coverage == "primary" else
                               F.when(F.col(f"_cov_{c}") > 0, F.col(f"_cov_{c}"))))
        .alias("observed_exposure_cnae_" + c.removeprefix(SCORE_PREFIX))
        for c in columns
    ]
    out = grouped.withColumnRenamed(industry, "cnae")
    if labels is None:
        out = out.withColumn("industry_name", F.lit(None).cast("string"))
    else:
        lookup = labels.select(F.trim(F.col("cnae").cast("string")).alias("cnae"), "industry_name")
        out = out.join(lookup, "cnae", "left")
    return out.select(
        "cnae", "industry_name", period, *means, "total_weight", "covered_weight",
        (F.col("covered_weight") / F.col("total_weight")).alias("coverage_share"), "occupation_count",
    )


def equal_mean(df: DataFrame, level: str, leaf: str = "CNO4", top: str = "OCUP1",
               top_of: Column | None = None) -> DataFrame:
    """Unweighted mean of every score per level, with the number of distinct leaves."""
    columns = [c for c in df.columns if c.startswith(SCORE_PREFIX)]
    out = df.groupBy(level).agg(
        *[F.avg(c).cast("double").alias(c) for c in columns], F.count_distinct(leaf).alias("cno4_count")
    )
    if level != top:
        out = out.withColumn(top, top_of if top_of is not None else F.substring(level, 1, 1))
    return out.withColumn(
        "occupation_title", F.concat(F.lit(f"{level} "), F.col(level).cast("string"))
    ).withColumn("aggregation_weight_source", F.lit(EQUAL_SOURCE))


def hierarchical_mean(df: DataFrame, weights: DataFrame | None, leaf: str = "CNO4", middle: str = "CNO2",
                      top: str = "OCUP1", weight: str = "employment_weight", top_of: Column | None = None,
                      renormalise: bool = False) -> DataFrame:
    """Leaf -> middle by equal weights, middle -> top by given weights, with equal-weight fallbacks.

    A null middle score drops out of the weighted sum while its weight stays in the denominator; ``renormalise`` drops
    that weight too.
    """
    columns = [c for c in df.columns if c.startswith(SCORE_PREFIX)]
    equal = df.groupBy(top).agg(
        F.count_distinct(leaf).alias("_n_leaf"), F.count_distinct(middle).alias("_n_middle"),
        *[F.avg(c).cast("double").alias(f"_eq_{c}") for c in columns],
    )
    if weights is None:
        return equal.select(
            top, _title(top), F.col("_n_leaf").alias("cno4_count"), F.lit(None).cast("long").alias("cno2_count"),
            F.lit(EQUAL_SOURCE).alias("aggregation_weight_source"), *[F.col(f"_eq_{c}").alias(c) for c in columns],
        )
    mid = attach_weights(equal_mean(df, middle, leaf, top, top_of), weights, middle, weight)
    everything = mid.agg(F.sum(weight)).scalar()
    w = F.col(weight)
    grouped = mid.groupBy(top).agg(
        F.sum(w).alias("_total"), F.sum("cno4_count").alias("_w_leaf"), F.count_distinct(middle).alias("_w_middle"),
        *[F.coalesce(F.sum(w * F.col(c)), F.lit(0.0)).alias(f"_num_{c}") for c in columns],
        *[F.sum(F.when(F.col(c).isNotNull(), w)).alias(f"_den_{c}") for c in columns],
    )
    joined = grouped.join(equal, top, "left").withColumn("_any", everything > 0)
    use = F.col("_any") & (F.col("_total") > 0)

    def value(c: str) -> Column:
        bottom = F.col(f"_den_{c}") if renormalise else F.col("_total")
        return F.when(use, F.col(f"_num_{c}") / F.when(bottom != 0, bottom)).otherwise(F.col(f"_eq_{c}")).alias(c)

    return joined.select(
        top, _title(top),
        F.when(use, F.col("_w_leaf")).otherwise(F.col("_n_leaf")).alias("cno4_count"),
        F.when(use, F.col("_w_middle")).when(F.col("_any"), F.col("_n_middle")).alias("cno2_count"),
        F.when(use, WEIGHTED_SOURCE).when(F.col("_any"), UNMATCHED_SOURCE).otherwise(EQUAL_SOURCE)
        .alias("aggregation_weight_source"),
        *[value(c) for c in columns],
    )


def _title(top: str) -> Column:
    return F.concat(F.lit(f"{top} "), F.col(top).cast("string")).alias("occupation_title")


def share_within(df: DataFrame, parent: str, amount: str, share: str = "employment_weight") -> DataFrame:
    """``amount`` over its parent's total (null for a zero total; null is a parent like any other).  Totals are aggregated and joined back: a window would gather the parent."""
    totals = df.groupBy(F.col(parent).alias("_parent")).agg(F.sum(amount).alias("_total"))
    joined = df.join(totals, F.col(parent).eqNullSafe(F.col("_parent")), "left")
    return joined.withColumn(share, F.try_divide(amount, "_total")).drop("_parent", "_total")


def latest_slice(df: DataFrame, period: str, condition: Column | None = None) -> DataFrame:
    """Rows of the latest period after filtering; the period is found by a scalar subquery."""
    kept = df if condition is None else df.where(condition)
    return kept.where(F.col(period) == kept.agg(F.max(period)).scalar())


def code_weights(df: DataFrame, occupation: str, amount: str, period: str, condition: Column,
                 pattern: str = r"^(\d{2})\s+(.+)$") -> DataFrame:
    """Employment weight of each 2-digit code within its 1-digit parent, latest period only."""
    from ..functions.codes import prefix, split_code_label
    from ..functions.numbers import parse_locale_number

    latest = split_code_label(latest_slice(df, period, condition), occupation, pattern=pattern)
    sized = latest.withColumn("employment_thousands", parse_locale_number(amount)).withColumn(
        "OCUP1", prefix("CNO2", 1)
    )
    return share_within(sized, "OCUP1", "employment_thousands").select(
        "CNO2", "OCUP1", "cno2_title", "employment_thousands", "employment_weight", F.col(period).alias("Periodo")
    )


def quarterly_stock(df: DataFrame, period: str, amount: str, value: str = "sepe_registered_unemployed",
                    months: str = "sepe_months") -> DataFrame:
    """Stock series by quarter: sum within each month, then the mean over the quarter's months."""
    monthly = (
        df.select(month_start(period).alias("_month"), F.col(amount).try_cast("double").alias("_y"))
        .dropna().groupBy("_month").agg(F.sum("_y").alias("_y"))
    )
    return monthly.groupBy(quarter_label("_month").alias("quarter")).agg(
        F.avg("_y").alias(value), F.count(F.lit(1)).alias(months)
    )


def filtered_totals(df: DataFrame, quarters: DataFrame, condition: Column, weight: str, period: str = "quarter",
                    value: str = "epa_unemployed", records: str = "epa_records") -> DataFrame:
    """Weighted total and record count of the matching rows per listed quarter; quarters without a match are 0."""
    totals = df.where(condition).groupBy(period).agg(
        F.sum(to_number(weight, 0.0)).alias(value), F.count(F.lit(1)).alias(records)
    )
    return quarters.select(period).distinct().join(totals, period, "left").fillna({value: 0.0, records: 0})
