"""Estimation panels: reading, balance, clocks, demeaning and profiles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.codes import zero_pad
from ..functions.numbers import finite_or_null, to_number
from ..functions.periods import month_start, months_since
from ..session import Scratch, cut_lineage
from .pick import keep_first
from .quantiles import exact_quantiles
from .vectorsum import vector_sums

INTERVENTION = "2022-09"
BASE_EVENT_TIME = -1


def is_total_row() -> Column:
    return (F.col("dimension") == "total") & (F.col("category") == "Total") & (F.col("gender") == "Total")


def estimation_panel(wide: DataFrame, intervention: str = INTERVENTION, unit: str = "cno4", period: str = "period",
                     stock: str = "parados", flow: str = "contratos", clock: str = "calendar",
                     scores: list[str] | None = None) -> DataFrame:
    """Total rows with padded unit, month, outcomes and event time.

    ``clock='calendar'`` counts months from the intervention; ``'rank'`` counts observed periods.
    """
    total = wide.where(is_total_row()).withColumns({
        unit: zero_pad(unit, 4), stock: to_number(stock), flow: to_number(flow),
        **{s: to_number(s) for s in scores or []},
    })
    total = total.withColumns({
        "period_dt": month_start(period), "event_unemployment": F.log1p(stock), "event_contracts": F.col(flow),
        "post": (F.col(period) >= intervention).cast("int"),
    })
    if clock == "rank":
        return total.join(period_index(total, period, intervention), period)
    return total.withColumn("event_time", months_since(period, intervention))


def period_index(panel: DataFrame, period: str, intervention: str) -> DataFrame:
    """Rank of each observed period and its offset from the intervention's rank.

    Periods are calendar slots, so the distinct list is short whatever the panel's size.
    """
    slots = panel.select(period).distinct()
    if slots.where(F.col(period) == intervention).isEmpty():
        raise ValueError(f"{intervention} is not among the periods of the panel")
    ranked = slots.select(period, F.row_number().over(W.orderBy(period)).alias("time_period"))  # one row per slot, never per unit
    at = ranked.where(F.col(period) == intervention).select("time_period").scalar()
    return ranked.withColumn("event_time", F.col("time_period") - at)


#: Memory for the three period x period matrices that a solver holds at once, on the driver or in one task.
MATRIX_BYTES = 1 << 30


def calendar(panel: DataFrame, period: str, *carry: str, limit: int = int((MATRIX_BYTES / 24) ** 0.5)) -> list:
    """The panel's periods in order (rows when other columns are carried along).

    Period x period matrices are solved on the driver or in one task; a calendar whose matrices would not fit is refused.
    """
    rows = panel.select(period, *carry).distinct().orderBy(period).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} periods")
    return rows if carry else [r[0] for r in rows]


def period_slots(panel: DataFrame, period: str, labels: list) -> DataFrame:
    """The calendar as a small table: _period and its slot t."""
    return panel.sparkSession.createDataFrame(list(zip(labels, range(len(labels)))), f"_period {panel.schema[period].dataType.simpleString()}, t int")


def balanced(panel: DataFrame, unit: str, period: str, outcome: str | None = None, rule: str = "max") -> DataFrame:
    """Units observed throughout: ``max`` keeps those with the largest count seen, ``all`` those seen in every period."""
    if rule == "max":
        counts = panel.groupBy(unit).agg(F.count(outcome or period).alias("_n"))
        top = counts.agg(F.max("_n")).scalar()
    elif rule == "all":
        counts = panel.groupBy(unit).agg(F.count_distinct(period).alias("_n"))
        top = panel.agg(F.count_distinct(period)).scalar()
    else:
        raise ValueError(f"unknown balance rule {rule}")
    return panel.join(counts.where(F.col("_n") == top).select(unit), unit, "left_semi")


@dataclass(frozen=True)
class PeriodEffects:
    """Period effects of several columns with unit effects partialled out (periods x columns), and which of them settled."""

    periods: list
    effects: np.ndarray
    converged: np.ndarray
    steps: int


def _cell_names(columns: list[str]) -> list[str]:
    return [f"{k}{i}" for i in range(len(columns)) for k in "ns"]


def _by_unit(panel: DataFrame, unit: str, period: str, columns: list[str], slots: DataFrame) -> DataFrame:
    """One row per unit: ``cells`` (slot, and count and sum of every column); rows collapse to cells before a unit is brought together."""
    values = {f"v{i}": finite_or_null(c) for i, c in enumerate(columns)}
    rows = panel.select(F.col(unit).alias("unit"), F.col(period).alias("period"), *[v.alias(n) for n, v in values.items()])
    sums = [a for i, n in enumerate(values) for a in (F.count(n).cast("double").alias(f"n{i}"), F.coalesce(F.sum(n), F.lit(0.0)).alias(f"s{i}"))]
    cells = rows.groupBy("unit", "period").agg(*sums).join(slots, "period")
    return cells.groupBy("unit").agg(F.collect_list(F.struct("slot", *_cell_names(columns))).alias("cells"))


def two_way_effects(panel: DataFrame, unit: str, period: str, columns: list[str], tolerance: float = 1e-12, most_steps: int = 200) -> PeriodEffects:
    """Period effects of an unbalanced panel by conjugate gradients on the period block.

    With units partialled out the normal equations have one unknown per period, ``(diag(n) - sum w w'/n) g = r``.  The matrix is never
    formed: a step is one pass over the units, which returns one number per period and column.  Null and non-finite values are
    left out column by column.  A column has settled when its residual is below ``tolerance`` of the right-hand side.
    """
    labels = calendar(panel, period)
    size, width = len(labels), len(columns)
    spark = panel.sparkSession
    slots = panel.select(F.col(period).alias("period")).distinct().withColumn("slot", F.row_number().over(W.orderBy("period")) - 1)
    scratch = Scratch(spark, "two-way")
    units = scratch.keep(_by_unit(panel, unit, period, columns, slots), "units")

    def passed(g: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(counts, sums over units): of ``s - n * mean(s)`` without ``g``, else of ``n * (g - mean(g))``; both size x width."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((2, width, size))
            for batch in batches:
                cells = batch.column(0)
                flat, starts = cells.flatten(), cells.offsets.to_numpy()
                owner, slot = np.repeat(np.arange(len(cells)), np.diff(starts)), flat.field(0).to_numpy()
                for i in range(width):
                    n, s = (flat.field(1 + 2 * i + k).to_numpy() for k in (0, 1))
                    s = s if g is None else n * g[slot, i]
                    total, weight = np.bincount(owner, s, len(cells)), np.bincount(owner, n, len(cells))
                    mean = np.divide(total, weight, out=np.zeros(len(cells)), where=weight > 0)
                    out[0, i] += np.bincount(slot, n, size)
                    out[1, i] += np.bincount(slot, s - n * mean[owner], size)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([out.ravel()], pa.list_(pa.float64()))], names=["key", "v"])

        found = vector_sums(units.select("cells").mapInArrow(run, "key int, v array<double>"), ["key"])[(0,)].reshape(2, width, size)
        return found[0].T, found[1].T

    if not size:
        return PeriodEffects([], np.zeros((0, width)), np.ones(width, bool), 0)
    counts, right = passed(None)
    inverse = np.divide(1.0, counts, out=np.zeros_like(counts), where=counts > 0)
    g, residual = np.zeros_like(right), right.copy()
    goal = tolerance * np.sqrt((right * right * inverse).sum(0))
    z = inverse * residual
    direction, norm, steps = z.copy(), (residual * z).sum(0), 0
    while (open_ := np.sqrt(np.maximum(norm, 0)) > goal).any() and steps < most_steps:
        _, image = passed(direction)
        curve = (direction * image).sum(0)
        step = np.divide(norm, curve, out=np.zeros(width), where=open_ & (curve > 0))
        g, residual = g + step * direction, residual - step * image
        z = inverse * residual
        after = (residual * z).sum(0)
        direction = z + np.divide(after, norm, out=np.zeros(width), where=norm > 0) * direction
        norm, steps = after, steps + 1
    scratch.close()
    return PeriodEffects(labels, g, ~(np.sqrt(np.maximum(norm, 0)) > goal), steps)


def demean_two_way(panel: DataFrame, unit: str, period: str, columns: list[str], tolerance: float = 1e-12, most_steps: int = 200) -> DataFrame:
    """``panel`` with ``<column>_demeaned``: what is left of a value without its unit's and its period's effect.

    Panels may have holes, and several rows for a unit and period.  On a balanced panel this is value - unit mean - period mean +
    grand mean.  Null where the value is null, or if the effects of the column have not settled in ``most_steps`` steps.
    """
    found = two_way_effects(panel, unit, period, columns, tolerance, most_steps)
    names = [f"_g{i}" for i in range(len(columns))]
    kind = panel.schema[period].dataType.simpleString()
    effects = panel.sparkSession.createDataFrame(
        [(p, *(float(x) if ok else None for x, ok in zip(row, found.converged))) for p, row in zip(found.periods, found.effects)],
        f"_period {kind}, " + ", ".join(f"{n} double" for n in names))
    placed = panel.join(effects, F.col(period).eqNullSafe(F.col("_period"))).drop("_period")
    left = [finite_or_null(c) - F.col(n) for c, n in zip(columns, names)]
    by_unit = placed.groupBy(F.col(unit).alias("_unit")).agg(*[F.avg(x).alias(f"_u{i}") for i, x in enumerate(left)])
    joined = placed.join(by_unit, F.col(unit).eqNullSafe(F.col("_unit")))
    return joined.select(*panel.columns, *[(x - F.col(f"_u{i}")).alias(f"{c}_demeaned") for i, (c, x) in enumerate(zip(columns, left))])


def base_difference(panel: DataFrame, unit: str, outcome: str, event_time: str = "event_time",
                    base: int = BASE_EVENT_TIME, result: str = "dy") -> DataFrame:
    """Outcome minus the unit's own outcome in the base period."""
    slice_ = panel.where(F.col(event_time) == base).select(unit, F.col(outcome).alias("_base"))
    return panel.join(slice_, unit).withColumn(result, F.col(outcome) - F.col("_base")).drop("_base")


def with_base_row(path: DataFrame, keys: list[str], zeros: list[str], event_time: str = "event_time",
                  base: int = BASE_EVENT_TIME) -> DataFrame:
    """Add the reference row (zeros at the base event time) to every estimated path."""
    reference = path.select(*keys).distinct() if keys else path.limit(1).select()
    reference = reference.withColumns({event_time: F.lit(base).cast(path.schema[event_time].dataType),
                                       **{z: F.lit(0.0) for z in zeros}})
    return path.unionByName(reference, allowMissingColumns=True)


def first_per_unit(panel: DataFrame, unit: str, period: str, columns: list[str]) -> DataFrame:
    """Each unit's values in its earliest period."""
    return keep_first(panel.select(unit, period, *columns), [unit], [period]).select(unit, *columns)


def unit_rows(panel: DataFrame, unit: str, period: str, periods: list, outcomes: list[str],
              doses: list[str]) -> DataFrame:
    """One row per unit: ``obs`` (period slot and outcomes, in order) and each dose as of the unit's first period.

    A unit has at most one entry per calendar slot (two are an error: they would shift its later slots), so the lists are
    as long as the calendar.  The table is written out once and everything after it reads that.
    """
    rows = panel.select(F.col(unit).alias("unit"), F.col(period).alias("_period"),
                        *[finite_or_null(o).alias(f"y{i}") for i, o in enumerate(outcomes)],
                        *[finite_or_null(d).alias(d) for d in doses]).join(period_slots(panel, period, periods), "_period").drop("_period")
    out = rows.groupBy("unit").agg(
        F.sort_array(F.collect_list(F.struct("t", *[f"y{i}" for i in range(len(outcomes))]))).alias("obs"),
        *[F.min_by(d, "t").alias(d) for d in doses],
        *[(F.max(d) > F.min(d)).alias(f"varies_{d}") for d in doses])
    own_slots = F.array_distinct(F.transform("obs", lambda o: o["t"]))
    twice = F.raise_error(F.concat(F.lit("a period occurs twice for unit "), F.col("unit").cast("string")))
    return cut_lineage(out.withColumn("obs", F.when(F.size("obs") == F.size(own_slots), F.col("obs")).otherwise(twice)))


def observed(obs: str, field: str) -> Column:
    """The non-null values of one outcome of ``unit_rows``, in period order."""
    return F.filter(F.transform(obs, lambda o: o[field]), lambda y: y.isNotNull())


def dose_quantiles(units: DataFrame, doses: list[str], probs: dict[str, float], rule: str = "linear") -> dict:
    """Quantiles over units of several doses in one pass: dose -> row."""
    long = units.select(F.explode(F.array(*[
        F.struct(F.lit(d).alias("dose"), F.col(d).cast("double").alias("x")) for d in doses])).alias("p")).select("p.*")
    return {r.dose: r for r in exact_quantiles(long, "x", probs, ["dose"], rule=rule).collect()}


def constant_dose(panel: DataFrame, unit: str, dose: str) -> DataFrame:
    """One row per unit with its dose; a dose that varies within a unit is an error."""
    per_unit = panel.groupBy(unit).agg(F.min(dose).alias(dose), F.max(dose).alias("_max"))
    bad = per_unit.where(F.col(dose) != F.col("_max")).select(unit).limit(1).collect()
    if bad:
        raise ValueError(f"{dose} varies within {unit} {bad[0][0]}")
    return per_unit.drop("_max")


def profile(panel: DataFrame, unit: str, period: str, sample: DataFrame | None = None) -> DataFrame:
    """Range and size of the panel, and how many units a sample of it lacks."""
    out = panel.agg(
        F.min(period).alias("period_min"), F.max(period).alias("period_max"),
        F.count_distinct(period).alias("n_periods"), F.count_distinct(unit).alias("n_units"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    if sample is None:
        return out
    size = sample.agg(F.count(F.lit(1))).scalar()
    return out.withColumn("n_sample", size).withColumn("n_dropped", F.col("n_units") - F.col("n_sample"))


def summary_statistics(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, sd, min, max and observations per variable, one row each."""
    stats = panel.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns
    ])).alias("s")).select("s.*")
    return stats.groupBy("variable").agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.count("x").alias("obs"),
    )


def design_counts(panel: DataFrame, unit: str, period: str, treated: str, post: str) -> DataFrame:
    """Treated and control units, pre and post periods."""
    on = F.col(treated) == 1
    after = F.col(post) == 1
    return panel.agg(
        F.count_distinct(F.when(on, F.col(unit))).alias("n_treated"),
        F.count_distinct(F.when(~on, F.col(unit))).alias("n_control"),
        F.count_distinct(period).alias("n_periods"),
        F.count_distinct(F.when(~after, F.col(period))).alias("n_pre_periods"),
        F.count_distinct(F.when(after, F.col(period))).alias("n_post_periods"),
    )


def error_metrics(df: DataFrame, truth: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """MAE, RMSE and R2 (NaN with fewer than two rows)."""
    y = F.col(truth)
    e = y - F.col(prediction)
    n, sse = F.count(e), F.sum(e * e)
    sst = F.var_pop(F.when(e.isNotNull(), y)) * n
    return df.groupBy(*(by or [])).agg(
        n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(n <= 1, F.lit(float("nan"))).when(sst > 0, 1 - sse / sst)
        .otherwise(F.when(sse == 0, 1.0).otherwise(0.0)).alias("r2"),
    )


def target_statistics(df: DataFrame, target: str, vector: str) -> DataFrame:
    return df.agg(
        F.count(target).alias("n_rows"), F.max(F.size(vector)).cast("long").alias("embedding_dim"),
        F.avg(target).alias("target_mean"), F.stddev_pop(target).alias("target_std"),
        F.min(target).alias("target_min"), F.max(target).alias("target_max"),
    )
