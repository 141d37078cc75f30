"""Continuous-dose difference-in-differences (Callaway, Goodman-Bacon and Sant'Anna).

Treated units adopt together; outcome changes against a base period are regressed on a cubic B-spline of the dose.  All
Spark ever sums are spline x spline and spline x period matrices, and bootstrap draws are multiplier sums of the same
size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.inference import Z95
from ..functions.numbers import keep_finite
from ..session import cut_lineage
from .panel import balanced, calendar, constant_dose, observed, unit_rows
from .quantiles import exact_quantiles
from .resampling import multipliers
from .vectorsum import vector_sums

DRAWS = 100
DEGREE, KNOTS = 3, 1

#: How a run says what its comparison units and its design are.
ZERO_RULE = "zero-dose CNOs"
QUARTILE_RULE = "bottom-quartile CNOs set as zero-dose baseline"
DESIGN = "continuous dose; positive/higher-dose CNOs adopt in {}"


@dataclass(frozen=True)
class DoseSpec:
    name: str
    outcome: str
    dose: str
    seed: int = 0


def dose_sample(panel: DataFrame, unit: str, period: str, outcome: str, dose: str, adoption: int) -> DataFrame:
    """Finite rows of units seen in every period, with adoption period ``g`` (0 = never) and dose ``d``.

    If any unit has dose 0 those are the comparison; otherwise units up to the first quartile are, with their dose set
    to 0.
    """
    rows = keep_finite(panel.select(unit, period, F.col(outcome).alias("y"), F.col(dose).alias("d_raw")), ["y", "d_raw"])
    rows = balanced(rows, unit, period, rule="all")
    units = constant_dose(rows, unit, "d_raw")
    q = exact_quantiles(units, "d_raw", {"q25": 0.25, "q50": 0.5, "q75": 0.75}).first()
    zero = not units.where("d_raw = 0").isEmpty()
    raw = F.col("d_raw")
    if zero:
        rows, exposed = rows.where(raw >= 0), raw > 0
    else:
        exposed = raw > F.lit(q.q25 if q else None)
    return rows.select(
        unit, period, "y", "d_raw", F.when(exposed, F.lit(adoption)).otherwise(0).alias("g"),
        F.when(exposed, raw).otherwise(0.0).alias("d"), F.lit(ZERO_RULE if zero else QUARTILE_RULE).alias("control_rule"),
        *[F.lit(q[c] if q else None).cast("double").alias(c) for c in ("q25", "q50", "q75")])


def _calendar(panel: DataFrame, period: str, intervention: str) -> tuple[list, int]:
    periods = calendar(panel, period)
    if intervention not in periods or periods.index(intervention) == 0:
        raise ValueError(f"{intervention} must be a period of the panel with one before it")
    return periods, periods.index(intervention)


def _dose_units(panel: DataFrame, unit: str, period: str, periods: list, specs: list[DoseSpec]):
    """One row per (specification, complete unit) with its dose under the comparison rule, and the rule per spec."""
    outcomes = sorted({s.outcome for s in specs})
    doses = sorted({s.dose for s in specs})
    table = unit_rows(panel, unit, period, periods, outcomes, doses)
    for d in doses:
        if not table.where(f"varies_{d}").isEmpty():
            raise ValueError(f"{d} varies within a {unit}")
    long = table.select(F.explode(F.array(*[F.struct(
        F.lit(i).alias("spec"), F.xxhash64(F.lit(s.seed + i), F.col("unit")).alias("key"), F.col(s.dose).alias("raw"),
        observed("obs", f"y{outcomes.index(s.outcome)}").alias("y")) for i, s in enumerate(specs)])).alias("s")).select("s.*")
    complete = cut_lineage(long.where((F.size("y") == len(periods)) & F.col("raw").isNotNull()))
    rules = {r.spec: r for r in exact_quantiles(complete, "raw", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["spec"]).join(
        complete.groupBy("spec").agg(F.count(F.when(F.col("raw") == 0, 1)).alias("zeros")), "spec").collect()}
    floors = [F.lit(x) for s, r in rules.items() for x in (s, 0.0 if r.zeros else r.q25)]
    above = F.col("raw") > F.element_at(F.create_map(*floors), F.col("spec")) if floors else F.lit(False)
    usable = ~F.col("spec").isin([s for s, r in rules.items() if r.zeros]) | (F.col("raw") >= 0)
    units = complete.where(usable).select("spec", "key", F.when(above, F.col("raw")).otherwise(0.0).alias("d"),
                                          above.alias("exposed"), "y")
    return units, rules


def run_table(panel: DataFrame, unit: str, period: str, specs: list[DoseSpec], intervention: str,
              draws: int = DRAWS) -> DataFrame:
    """One row per specification: design, size, quantiles and comparison rule of its sample.  One without complete units has
    no units, no quantiles and no rule."""
    periods, _ = _calendar(panel, period, intervention)
    units, rules = _dose_units(panel, unit, period, periods, specs)
    counts = {r.spec: r["count"] for r in units.groupBy("spec").count().collect()}
    rows = []
    for i, spec in enumerate(specs):
        r = rules.get(i)
        rule = None if r is None else ZERO_RULE if r.zeros else QUARTILE_RULE
        quantiles = (None,) * 3 if r is None else (r.q25, r.q50, r.q75)
        rows.append((spec.name, spec.outcome, spec.dose, DESIGN.format(intervention), rule, counts.get(i, 0), len(periods), *quantiles, draws))
    return panel.sparkSession.createDataFrame(
        rows, "spec string, outcome string, exposure string, design string, control_rule string, n_units long, n_periods long, "
        "q25 double, q50 double, q75 double, bootstraps int")


# ---- spline basis ---------------------------------------------------------------------------------------------


def spline_basis(x: np.ndarray, low: float, high: float, knots: list[float], degree: int = DEGREE,
                 derivative: bool = False) -> np.ndarray:
    """Intercept plus B-spline columns on [low, high] (the first B-spline is left out), or their slopes."""
    full = np.concatenate([[low] * (degree + 1), knots, [high] * (degree + 1)])

    def columns(deg: int) -> np.ndarray:
        t = full
        cell = np.clip(np.searchsorted(t, x, side="right") - 1, degree, len(t) - degree - 2)
        b = np.zeros((len(x), len(t) - 1))
        b[np.arange(len(x)), cell] = 1.0
        for k in range(1, deg + 1):
            nxt = np.zeros((len(x), len(t) - 1 - k))
            for j in range(len(t) - 1 - k):
                left, right = t[j + k] - t[j], t[j + k + 1] - t[j + 1]
                if left > 0:
                    nxt[:, j] += (x - t[j]) / left * b[:, j]
                if right > 0:
                    nxt[:, j] += (t[j + k + 1] - x) / right * b[:, j + 1]
            b = nxt
        return b

    if not derivative:
        return np.column_stack([np.ones(len(x)), columns(degree)[:, 1:]])
    lower = columns(degree - 1)
    count = len(full) - 1 - degree
    slope = np.zeros((len(x), count))
    for j in range(count):
        left, right = full[j + degree] - full[j], full[j + degree + 1] - full[j + 1]
        if left > 0:
            slope[:, j] += degree / left * lower[:, j]
        if right > 0:
            slope[:, j] -= degree / right * lower[:, j + 1]
    return np.column_stack([np.zeros(len(x)), slope[:, 1:]])


# ---- estimation -----------------------------------------------------------------------------------------------


@dataclass
class DoseFit:
    """Solved specification: coefficients per period, draws of their deviations, and the dose grid."""

    spec: DoseSpec
    low: float
    high: float
    knots: list[float]
    grid: np.ndarray
    event_time: np.ndarray
    beta: np.ndarray          # basis x periods
    base_mean: np.ndarray     # periods: comparison units
    slope_mean: np.ndarray    # basis: mean slope over treated units
    basis_mean: np.ndarray
    beta_draws: np.ndarray    # draws x basis x periods
    base_draws: np.ndarray    # draws x periods
    slope_draws: np.ndarray   # draws x periods: sampling of the dose distribution
    mean_draws: np.ndarray
    n_treated: int
    n_control: int


@dataclass
class MissingFit:
    """A specification that cannot be estimated, and why."""

    spec: DoseSpec
    reason: str


def _changes(y: np.ndarray, adoption: int, base: str) -> np.ndarray:
    """Outcome changes per period: after adoption against the last period before it; earlier ones against the period
    before (``varying``) or against that same last one (``universal``)."""
    out = y - y[:, adoption - 1:adoption]
    if base == "varying":
        out[:, 1:adoption] = np.diff(y[:, :adoption], axis=1)
        out[:, 0] = 0.0
    return out


def fit_doses(panel: DataFrame, unit: str, period: str, specs: list[DoseSpec], intervention: str, draws: int = DRAWS,
              base: str = "varying") -> list[DoseFit | MissingFit]:
    """Fit every specification, in their order; two passes over one row per unit whatever their number."""
    periods, adoption = _calendar(panel, period, intervention)
    units, _ = _dose_units(panel, unit, period, periods, specs)

    treated = units.where("exposed")
    points = {f"p{i}": 0.1 + 0.01 * i for i in range(90)}
    inner = {f"k{i}": (i + 1) / (KNOTS + 1) for i in range(KNOTS)}
    asked = exact_quantiles(treated, "d", points | inner | {"low": 0.0, "high": 1.0}, ["spec"]).collect()
    grid = {r.spec: [r[p] for p in points] for r in asked}
    knots = {r.spec: [r[k] for k in inner] for r in asked}
    bounds = {r.spec: (r.low, r.high) for r in asked}
    shape = {s: (*bounds[s], knots[s]) for s in bounds}
    size, width = len(periods), 1 + DEGREE + KNOTS

    first = vector_sums(units.mapInArrow(_dose_statistics(shape, adoption, base), "spec int, v array<double>"), ["spec"])
    solved = {}
    for (s,), flat in sorted(first.items()):
        q = flat[:width * width].reshape(width, width)
        rest = flat[width * width:]
        by = rest[:width * size].reshape(width, size)
        slope, mean, control = np.split(rest[width * size:], [width, 2 * width])
        n1, n0 = q[0, 0], control[-1]
        if n1 <= 0 or n0 <= 0:
            continue
        inverse = np.linalg.pinv(q, hermitian=True)
        solved[s] = {"inverse": inverse, "beta": inverse @ by, "slope": slope / n1, "mean": mean / n1,
                     "base": control[:-1] / n0, "n1": n1, "n0": n0}
    second = vector_sums(units.mapInArrow(
        _dose_draws(shape, adoption, base, solved, draws), "spec int, v array<double>"), ["spec"])
    out = []
    for s, spec in enumerate(specs):
        if s not in solved:
            out.append(MissingFit(spec, "no exposed unit is observed in every period" if s not in shape else "no comparison unit is observed in every period"))
            continue
        m = solved[s]
        flat = second[(s,)].reshape(draws, width * size + 2 * size + width)
        scores = flat[:, :width * size].reshape(draws, width, size)
        out.append(DoseFit(
            specs[s], *shape[s][:2], shape[s][2], np.array(grid[s]), np.arange(size) - adoption, m["beta"], m["base"],
            m["slope"], m["mean"], np.einsum("ab,rbt->rat", m["inverse"], scores),
            flat[:, width * size:width * size + size] / m["n0"],
            flat[:, width * size + size:width * size + 2 * size] / m["n1"],
            flat[:, width * size + 2 * size:] / m["n1"], int(m["n1"]), int(m["n0"])))
    return out


def _dose_groups(batches, shape, adoption: int, base: str):
    for batch in batches:
        spec, key, d = (batch.column(c).to_numpy() for c in ("spec", "key", "d"))
        y = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        for s in np.unique(spec):
            if int(s) not in shape:
                continue
            mine = spec == s
            change = _changes(y[mine], adoption, base)
            on = batch.column("exposed").to_numpy(zero_copy_only=False).astype(bool)[mine]
            low, high, knots = shape[int(s)]
            basis = spline_basis(d[mine][on], low, high, knots)
            slope = spline_basis(d[mine][on], low, high, knots, derivative=True)
            yield int(s), key[mine][on], basis, slope, change[on], key[mine][~on], change[~on]


def _vectors(totals: dict):
    if totals:
        yield pa.RecordBatch.from_pydict({"spec": pa.array(list(totals), pa.int32()),
                                          "v": pa.array(list(totals.values()), pa.list_(pa.float64()))})


def _dose_statistics(shape, adoption: int, base: str):
    def run(batches):
        totals: dict = {}
        for s, _, basis, slope, change, _, still in _dose_groups(batches, shape, adoption, base):
            flat = np.concatenate([(basis.T @ basis).ravel(), (basis.T @ change).ravel(), slope.sum(axis=0),
                                   basis.sum(axis=0), still.sum(axis=0), [float(len(still))]])
            totals[s] = totals.get(s, 0.0) + flat
        yield from _vectors(totals)
    return run


def _dose_draws(shape, adoption: int, base: str, solved: dict, draws: int):
    index = np.arange(1, draws + 1)

    def run(batches):
        totals: dict = {}
        for s, key, basis, slope, change, still_key, still in _dose_groups(batches, shape, adoption, base):
            if s not in solved:
                continue
            m = solved[s]
            xi, xi0 = multipliers(key, index), multipliers(still_key, index)
            error = change - basis @ m["beta"]
            width, size = basis.shape[1], change.shape[1]
            scores = np.stack([(xi * basis[:, [j]]).T @ error for j in range(width)], axis=1)
            flat = np.concatenate([
                scores.reshape(len(index), width * size), xi0.T @ (still - m["base"]),
                xi.T @ ((slope - m["slope"]) @ m["beta"]), xi.T @ (basis - m["mean"])], axis=1)
            totals[s] = totals.get(s, 0.0) + flat.ravel()
        yield from _vectors(totals)
    return run


def _sup_t(deviation: np.ndarray, se: np.ndarray, level: float) -> float | None:
    """The value that the largest standardised deviation of a draw exceeds with probability 1 - level; None without spread."""
    used = se > 1e-12
    return float(np.quantile((np.abs(deviation[:, used]) / se[used]).max(axis=1), level)) if used.any() else None


def dose_response(spark, fits: list[DoseFit | MissingFit], band_level: float = 0.95) -> DataFrame:
    """ATT(d) and ACRT(d) over the dose grid, averaged over the periods after adoption, with pointwise intervals and, by
    ``band_level``, bands that hold for the whole curve (sup-t over the draws)."""
    rows = []
    for f in fits:
        if isinstance(f, MissingFit):
            rows.append((f.spec.name, *[None] * 10, f.reason))
            continue
        post = f.event_time >= 0
        beta, draws = f.beta[:, post].mean(axis=1), f.beta_draws[:, :, post].mean(axis=2)
        shift, shift_draws = f.base_mean[post].mean(), f.base_draws[:, post].mean(axis=1)
        level = spline_basis(f.grid, f.low, f.high, f.knots)
        slope = spline_basis(f.grid, f.low, f.high, f.knots, derivative=True)
        att, acrt = level @ beta - shift, slope @ beta
        for what, est, moved in (("att", att, draws @ level.T - shift_draws[:, None]), ("acrt", acrt, draws @ slope.T)):
            se = moved.std(axis=0, ddof=1)
            critical = _sup_t(moved, se, band_level)
            for i, d in enumerate(f.grid):
                band = (None, None) if critical is None else (float(est[i] - critical * se[i]), float(est[i] + critical * se[i]))
                rows.append((f.spec.name, what, i, float(d), float(est[i]), float(se[i]), float(est[i] - Z95 * se[i]),
                             float(est[i] + Z95 * se[i]), critical, *band, None))
    return spark.createDataFrame(rows, "spec string, parameter string, grid_index int, dose double, estimate double, std_error double, "
                                 "ci_low double, ci_high double, critical_value double, band_low double, band_high double, reason string")


def dose_overall(spark, fits: list[DoseFit]) -> DataFrame:
    """Overall ATT and ACRT per specification; nulls and a reason where there is none."""
    rows = []
    for f in fits:
        if isinstance(f, MissingFit):
            rows.append((f.spec.name, *[None] * 6, f.reason))
            continue
        post = f.event_time >= 0
        beta, draws = f.beta[:, post].mean(axis=1), f.beta_draws[:, :, post].mean(axis=2)
        att = f.basis_mean @ beta - f.base_mean[post].mean()
        att_draws = draws @ f.basis_mean + f.mean_draws @ beta - f.base_draws[:, post].mean(axis=1)
        acrt = f.slope_mean @ beta
        acrt_draws = draws @ f.slope_mean + f.slope_draws[:, post].mean(axis=1)
        rows.append((f.spec.name, float(att), float(att_draws.std(ddof=1)), float(acrt),
                     float(acrt_draws.std(ddof=1)), f.n_treated, f.n_control, None))
    return spark.createDataFrame(rows, "spec string, att double, att_se double, acrt double, acrt_se double, "
                                 "n_treated long, n_control long, reason string")


def dose_event_study(spark, fits: list[DoseFit], level: float = 0.95) -> DataFrame:
    """Mean ACRT by relative period with simultaneous bands (sup-t over the draws); a period without spread has no band."""
    rows = []
    for f in fits:
        if isinstance(f, MissingFit):
            rows.append((f.spec.name, *[None] * 6, f.reason))
            continue
        estimate = f.slope_mean @ f.beta
        deviation = np.einsum("a,rat->rt", f.slope_mean, f.beta_draws) + f.slope_draws
        se = deviation.std(axis=0, ddof=1)
        critical = _sup_t(deviation, se, level)
        for t in range(len(se)):
            band = (None, None) if critical is None or se[t] <= 1e-12 else (
                float(estimate[t] - critical * se[t]), float(estimate[t] + critical * se[t]))
            rows.append((f.spec.name, int(f.event_time[t]), float(estimate[t]), float(se[t]), critical, *band, None))
    return spark.createDataFrame(rows, "spec string, event_time int, acrt double, std_error double, "
                                 "critical_value double, band_low double, band_high double, reason string")
