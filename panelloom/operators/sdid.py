"""Synthetic difference-in-differences for many specifications and bootstrap replicates at once.

The estimator follows Arkhangelsky, Athey, Hirshberg, Imbens and Wager (2021).  Nothing of the size units x units or
units x periods is ever gathered: Spark sums period x period matrices per (specification, replicate), grouped tasks solve
them, and unit weights are found through the dual of their ridge problem, which has one unknown per pre-period plus one,
so every Newton step is one distributed aggregation shared by all replicates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.inference import Z95, normal_two_sided
from ..functions.numbers import finite_or_null
from ..session import cut_lineage
from .panel import balanced, calendar, dose_quantiles, first_per_unit, observed, unit_rows
from .quantiles import exact_quantiles
from .regression import _flag
from .resampling import unit_counts
from .vectorsum import summed_blocks, vector_sums, whole_vector

REPLICATES = 100
CONTROL_RULES = {"top_vs_zero": "zero exposure", "top_vs_bottom": "bottom quartile"}
_CHUNK = 64  # replicates weighted together inside a task


@dataclass(frozen=True)
class SdidSpec:
    name: str
    outcome: str
    dose: str
    mode: str
    seed: int = 20260608


def sdid_sample(panel: DataFrame, unit: str, period: str, outcome: str, dose: str, mode: str, intervention: str,
                quantile_rule: str = "linear") -> DataFrame:
    """Units of one specification: quartile rule on each unit's first row, treated x post, units of maximum length."""
    first = first_per_unit(panel, unit, period, [dose]).where(finite_or_null(dose).isNotNull())
    q = exact_quantiles(first, dose, {"q25": 0.25, "q75": 0.75}, rule=quantile_rule).first()
    flagged = first.select(unit, _flag(F.col(dose), mode, q.q25, q.q75).alias("treated")).where(
        F.col("treated").isNotNull())
    rows = panel.select(unit, period, finite_or_null(outcome).alias("y")).where("y IS NOT NULL").join(flagged, unit)
    rows = rows.withColumn("post", (F.col(period) >= intervention).cast("int"))
    kept = balanced(rows, unit, period, "y", rule="max")
    return kept.select(unit, period, "y", "treated", "post", (F.col("treated") * F.col("post")).alias("d"),
                       F.lit(q.q25).alias("q25"), F.lit(q.q75).alias("q75"))


def sdid_paths(panel: DataFrame, unit: str, period: str, specs: list[SdidSpec], intervention: str,
               replicates: int = REPLICATES, tolerance: float = 1e-9, max_steps: int = 200) -> DataFrame:
    """Paths per specification, replicate (0 = the data) and period.

    Columns: ``spec, rep, event_time, period, post, treated_mean, synthetic_mean, effect, n_treated, n_control,
    q25, q75, converged, reason``.  ``effect`` is the treated-synthetic gap minus its pre-period average under the time
    weights.  A specification that cannot be estimated has one row without a period that tells the reason.
    """
    spark = panel.sparkSession
    periods = calendar(panel, period)
    before = sum(p < intervention for p in periods)
    if not 1 < before < len(periods):
        raise ValueError("the intervention must leave at least two periods before it and one after")
    outcomes = sorted({s.outcome for s in specs})
    doses = sorted({s.dose for s in specs})
    table = unit_rows(panel, unit, period, periods, outcomes, doses)
    cuts = dose_quantiles(table, doses, {"q25": 0.25, "q75": 0.75})
    entries = F.array(*[F.struct(
        F.lit(i).alias("spec"), F.xxhash64(F.lit(s.seed + i), F.col("unit")).alias("key"),
        (_flag(F.col(s.dose), s.mode, cuts[s.dose].q25, cuts[s.dose].q75) if s.dose in cuts
         else F.lit(None).cast("double")).alias("treated"),
        observed("obs", f"y{outcomes.index(s.outcome)}").alias("y")) for i, s in enumerate(specs)])
    samples = table.select(F.explode(entries).alias("s")).select("s.*").where("treated IS NOT NULL")
    # a unit of the specification's maximum length that does not cover the calendar cannot enter the weights
    units = cut_lineage(samples.where(F.size("y") == len(periods)))

    reps = np.arange(replicates + 1)
    sums = units.mapInArrow(_statistics_kernel(before, reps), "spec int, rep int, v array<double>")
    starts = summed_blocks(sums, ["spec", "rep"]).groupBy("spec", "rep").applyInPandas(
        _time_weights(before, len(periods)), "spec int, rep int, lam array<double>, b array<double>, eta double, "
        "treated_mean array<double>, n_treated double, n_control double, converged boolean")
    state = {(r.spec, r.rep): r for r in cut_lineage(starts).collect()}
    point, eta, settled = _solve_unit_weights(units, state, before, tolerance, max_steps)

    paths = units.mapInArrow(_synthetic_kernel(before, point, eta), "spec int, rep int, v array<double>")
    synthetic = vector_sums(paths, ["spec", "rep"])
    origin = periods.index(intervention) if intervention in periods else before
    out = []
    for key, r in state.items():
        if key not in synthetic:
            continue
        spec, treated = specs[key[0]], np.array(r.treated_mean)
        gap = treated - synthetic[key]
        effect = gap - float(np.array(r.lam) @ gap[:before])
        for t, p in enumerate(periods):
            out.append((spec.name, int(key[1]), t - origin, p, int(t >= before), float(treated[t]),
                        float(synthetic[key][t]), float(effect[t]), float(r.n_treated), float(r.n_control),
                        cuts[spec.dose].q25, cuts[spec.dose].q75, bool(r.converged) and key in settled, None))
    for i, spec in enumerate(specs):
        if (i, 0) not in synthetic:
            known = cuts.get(spec.dose)
            out.append((spec.name, 0, *[None] * 8, known and known.q25, known and known.q75, None,
                        "no dose" if known is None else "no treated or no comparison unit is observed in every period"))
    return spark.createDataFrame(out, _PATH)


_PATH = ("spec string, rep int, event_time int, period string, post int, treated_mean double, synthetic_mean double, "
         "effect double, n_treated double, n_control double, q25 double, q75 double, converged boolean, reason string")


def _arrays(batch: pa.RecordBatch):
    y = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return (batch.column("spec").to_numpy(), batch.column("key").to_numpy(),
            batch.column("treated").to_numpy() > 0, y)


def _rows(totals: dict):
    if totals:
        keys = list(totals)
        yield pa.RecordBatch.from_pydict({
            "spec": pa.array([k[0] for k in keys], pa.int32()), "rep": pa.array([int(k[1]) for k in keys], pa.int32()),
            "v": pa.array([totals[k] for k in keys], pa.list_(pa.float64()))})


def _statistics_kernel(before: int, reps: np.ndarray):
    """Per (spec, rep): treated count and sums, control count, control difference moments, control cross products."""
    def run(batches):
        totals: dict = {}
        for batch in batches:
            spec, key, treated, y = _arrays(batch)
            for s in np.unique(spec):
                mine = spec == s
                tr, co = y[mine & treated], y[mine & ~treated]
                steps = np.diff(co[:, :before], axis=1)
                z = np.column_stack([co[:, :before], co[:, before:].mean(axis=1), np.ones(len(co))])
                w_tr = unit_counts(key[mine & treated], reps)
                w_co = unit_counts(key[mine & ~treated], reps)
                head = np.column_stack([w_tr.sum(axis=0), w_co.sum(axis=0), w_co.T @ steps.sum(axis=1),
                                        w_co.T @ (steps * steps).sum(axis=1), w_tr.T @ tr])
                for r in reps:
                    gram = (z * w_co[:, r:r + 1]).T @ z
                    totals[(int(s), r)] = totals.get((int(s), r), 0.0) + np.concatenate([head[r], gram.ravel()])
        yield from _rows(totals)
    return run


def _time_weights(before: int, size: int):
    """Grouped solve: adds up the task sums of one (spec, rep) and finds its time weights and ridge strength."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = whole_vector(pdf)
        n_tr, n_co, step_sum, step_sq = flat[:4]
        if n_tr <= 0 or n_co <= 0:  # a resample without treated or comparison units says nothing
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (
                ("spec", "int32"), ("rep", "int32"), ("lam", object), ("b", object), ("eta", float),
                ("treated_mean", object), ("n_treated", float), ("n_control", float), ("converged", bool))})
        mean = flat[4:4 + size] / n_tr
        gram = flat[4 + size:].reshape(before + 2, before + 2)
        count = n_co * (before - 1)
        noise = np.sqrt(max(step_sq - step_sum ** 2 / count, 0.0) / max(count - 1, 1))
        centred = gram[:-1, :-1] - np.outer(gram[-1, :-1], gram[-1, :-1]) / n_co
        ridge = max((1e-6 * noise) ** 2 * n_co, 1e-12 * np.trace(centred))
        lam, done = simplex_least_squares(centred[:before, :before] + ridge * np.eye(before), centred[:before, before])
        zeta2 = np.sqrt(n_tr * (size - before)) * noise ** 2
        b = mean[:before] - mean[:before].mean()
        eta = max(zeta2 * before, 1e-10 * (1.0 + float(b @ b)))
        return pd.DataFrame({
            "spec": [int(pdf["spec"].iloc[0])], "rep": [int(pdf["rep"].iloc[0])], "lam": [lam], "b": [b], "eta": [eta],
            "treated_mean": [mean], "n_treated": [n_tr], "n_control": [n_co], "converged": [done]})
    return run


def simplex_least_squares(gram: np.ndarray, target: np.ndarray, max_steps: int = 10000) -> tuple[np.ndarray, bool]:
    """min x'Gx/2 - c'x over the simplex by an active set, and whether it came to its end: exact for the (small) positive
    definite G it is given."""
    size, done = len(target), False
    x = np.zeros(size)
    x[int(np.argmin(np.diag(gram) / 2 - target))] = 1.0
    free = x > 0
    for _ in range(max_steps):
        index = np.flatnonzero(free)
        k = len(index)
        kkt = np.zeros((k + 1, k + 1))
        kkt[:k, :k] = gram[np.ix_(index, index)]
        kkt[:k, k] = kkt[k, :k] = 1.0
        solution = np.linalg.lstsq(kkt, np.append(target[index], 1.0), rcond=None)[0][:k]
        if (solution < -1e-14).any():
            moving = solution < x[index]
            step = np.min(np.where(moving & (solution < 0), x[index] / np.where(moving, x[index] - solution, 1.0), 1.0))
            x[index] += step * (solution - x[index])
            drop = index[(x[index] <= 1e-13) & (solution < 0)]
            if not len(drop):
                drop = index[[int(np.argmin(x[index]))]]
            x[drop], free[drop] = 0.0, False
            continue
        x[index] = np.maximum(solution, 0.0)
        slope = gram @ x - target
        level = slope[index].mean()
        outside = np.where(free, np.inf, slope)
        best = int(np.argmin(outside))
        if outside[best] >= level - 1e-9 * (1.0 + abs(level)):
            done = True
            break
        free[best] = True
    return x / x.sum(), done


def _solve_unit_weights(units: DataFrame, state: dict, before: int, tolerance: float, max_steps: int):
    """Newton on the dual of the unit-weight problem, all (spec, rep) in lockstep; one aggregation per step.

    With a_i the centred pre-period path of control i and m_i its bootstrap count, the weights are
    ``m_i max(0, a_i.u + nu) / eta``; (u, nu) minimises ``|u|^2/2 - b.u - nu + sum m_i max(0, a_i.u + nu)^2 / (2 eta)``.
    """
    eta = {k: float(r.eta) for k, r in state.items()}
    b = {k: np.array(r.b) for k, r in state.items()}
    point = {k: np.append(np.zeros(before), eta[k] / r.n_control) for k, r in state.items()}
    best: dict = {}     # accepted point, objective, direction, slope, step
    open_keys, settled = set(state), set()
    for _ in range(max_steps):
        if not open_keys:
            break
        active = {k: point[k] for k in open_keys}
        sums = units.mapInArrow(_dual_kernel(before, active), "spec int, rep int, v array<double>")
        moves = summed_blocks(sums, ["spec", "rep"]).groupBy("spec", "rep").applyInPandas(
            _newton_step(before, active, eta, b), "spec int, rep int, f double, g double, slope double, p array<double>")
        for r in moves.collect():
            key = (r.spec, r.rep)
            trial, last = point[key], best.get(key)
            if last and r.f > last["f"] + 1e-4 * last["step"] * last["slope"] + 1e-12 * abs(last["f"]):
                last["step"] /= 2.0
                point[key] = last["x"] + last["step"] * last["p"]
                if last["step"] < 1e-12:
                    point[key] = last["x"]
                    open_keys.discard(key)
                continue
            if r.g <= tolerance:
                open_keys.discard(key)
                settled.add(key)
                continue
            best[key] = {"x": trial, "f": r.f, "p": np.array(r.p), "slope": r.slope, "step": 1.0}
            point[key] = trial + best[key]["p"]
    return point, eta, settled  # keys that are not settled ran out of steps, or of step length


def _control_groups(batches, before: int, keys):
    """Centred pre-period paths and bootstrap counts of the controls, by specification, in chunks of replicates."""
    wanted: dict = {}
    for s, r in sorted(keys):
        wanted.setdefault(s, []).append(r)
    for batch in batches:
        spec, key, treated, y = _arrays(batch)
        for s in np.unique(spec):
            rows = (spec == s) & ~treated
            todo = np.array(wanted.get(int(s), []), dtype=int)
            if not rows.any() or not len(todo):
                continue
            a = y[rows][:, :before]
            a = np.column_stack([a - a.mean(axis=1, keepdims=True), np.ones(len(a))])
            for start in range(0, len(todo), _CHUNK):
                part = todo[start:start + _CHUNK]
                yield int(s), part, a, unit_counts(key[rows], part), y[rows]


def _dual_kernel(before: int, point: dict):
    def run(batches):
        totals: dict = {}
        for s, part, a, m, _ in _control_groups(batches, before, point):
            lift = np.maximum(a @ np.column_stack([point[(s, r)] for r in part]), 0.0)
            weight = m * lift
            grad = a.T @ weight
            for j, r in enumerate(part):
                on = (weight[:, j] > 0)
                half = a[on] * np.sqrt(m[on, j])[:, None]
                flat = np.concatenate([[weight[:, j] @ lift[:, j]], grad[:, j], (half.T @ half).ravel()])
                totals[(s, r)] = totals.get((s, r), 0.0) + flat
        yield from _rows(totals)
    return run


def _newton_step(before: int, point: dict, eta: dict, b: dict):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = (int(pdf["spec"].iloc[0]), int(pdf["rep"].iloc[0]))
        flat = whole_vector(pdf)
        x, e, c = point[key], eta[key], np.append(b[key], 1.0)
        ridge = np.append(x[:before], 0.0)
        objective = 0.5 * ridge @ ridge - c @ x + flat[0] / (2 * e)
        gradient = ridge - c + flat[1:before + 2] / e
        hessian = flat[before + 2:].reshape(before + 1, before + 1) / e
        hessian[np.arange(before), np.arange(before)] += 1.0
        if hessian[before, before] <= 0:
            hessian[before, before] = 1.0 / e
        p = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        size = np.abs(gradient[:before]).max() / (1.0 + np.abs(b[key]).max()) + abs(gradient[before])
        return pd.DataFrame({"spec": [key[0]], "rep": [key[1]], "f": [objective], "g": [size],
                             "slope": [float(gradient @ p)], "p": [p]})
    return run


def _synthetic_kernel(before: int, point: dict, eta: dict):
    def run(batches):
        totals: dict = {}
        for s, part, a, m, y in _control_groups(batches, before, point):
            lift = np.maximum(a @ np.column_stack([point[(s, r)] for r in part]), 0.0)
            omega = m * lift / np.array([eta[(s, r)] for r in part])
            path = omega.T @ y
            for j, r in enumerate(part):
                totals[(s, r)] = totals.get((s, r), 0.0) + path[j]
        yield from _rows(totals)
    return run


def sdid_estimates(paths: DataFrame, specs: list[SdidSpec] | None = None) -> DataFrame:
    """ATT per specification with bootstrap error, normal p-value and bounds; with ``specs`` also what each one is.

    Replicates whose weights did not settle are counted in ``reps_completed`` but not in ``reps_converged``.
    """
    att = paths.where("post = 1").groupBy("spec", "rep").agg(
        F.avg("effect").alias("att"), F.first("n_treated").alias("n_treated"), F.first("n_control").alias("n_control"))
    shape = paths.where("rep = 0").groupBy("spec").agg(
        F.count("period").alias("n_periods"), F.sum("post").alias("n_post_periods"), F.max("q25").alias("q25"), F.max("q75").alias("q75"),
        F.bool_and("converged").alias("converged"), F.max("reason").alias("reason"))
    settled = paths.where("rep > 0").groupBy("spec").agg(F.count_distinct(F.when(F.col("converged"), F.col("rep"))).alias("reps_converged"))
    out = att.groupBy("spec").agg(
        F.max(F.when(F.col("rep") == 0, F.col("att"))).alias("att"),
        F.stddev_samp(F.when(F.col("rep") > 0, F.col("att"))).alias("std_error"),
        F.max(F.when(F.col("rep") == 0, F.col("n_treated"))).cast("long").alias("n_treated"),
        F.max(F.when(F.col("rep") == 0, F.col("n_control"))).cast("long").alias("n_control"),
        F.count(F.when(F.col("rep") > 0, 1)).alias("reps_completed"))
    out = shape.join(out, "spec", "left").join(settled, "spec", "left")
    z = F.abs(F.try_divide("att", "std_error"))
    rows = out.withColumns({
        "ci_low": F.col("att") - Z95 * F.col("std_error"), "ci_high": F.col("att") + Z95 * F.col("std_error"),
        "n_pre_periods": F.col("n_periods") - F.col("n_post_periods")})
    values = [(r.spec, normal_two_sided(r.z)) for r in out.select("spec", z.alias("z")).collect() if r.z is not None]
    p = paths.sparkSession.createDataFrame(values, "spec string, p_value double")
    rows = rows.join(p, "spec", "left")
    if specs is None:
        return rows
    said = [(s.name, s.outcome, s.dose, s.mode, CONTROL_RULES[s.mode]) for s in specs]
    return paths.sparkSession.createDataFrame(said, "spec string, outcome string, exposure string, mode string, control_rule string").join(
        rows, "spec", "left")


def sdid_levels(paths: DataFrame) -> DataFrame:
    """Treated and synthetic means by period."""
    return paths.where("rep = 0 AND period IS NOT NULL").select("spec", "period", "event_time", "treated_mean", "synthetic_mean")


def sdid_event_path(paths: DataFrame, max_effects: int | None = None) -> DataFrame:
    """Effects and placebos by event time with bootstrap errors and the reference row at -1; all effects unless a number is given."""
    rows = paths.where(F.col("event_time") != -1)
    stats = (rows if max_effects is None else rows.where(F.col("event_time") < max_effects)).groupBy("spec", "event_time").agg(
        F.max(F.when(F.col("rep") == 0, F.col("effect"))).alias("estimate"),
        F.stddev_samp(F.when(F.col("rep") > 0, F.col("effect"))).alias("std_error"),
        F.max(F.when(F.col("rep") == 0, F.col("n_treated"))).cast("long").alias("switchers"),
        F.count(F.when(F.col("rep") > 0, 1)).alias("reps_completed"))
    at = F.col("event_time")
    term = F.when(at >= 0, F.concat(F.lit("Effect_"), (at + 1).cast("string"))).otherwise(
        F.concat(F.lit("Placebo_"), (-at - 1).cast("string")))
    named = stats.select("spec", term.alias("term"), "event_time", "estimate", "std_error",
                         (F.col("estimate") - Z95 * F.col("std_error")).alias("ci_low"),
                         (F.col("estimate") + Z95 * F.col("std_error")).alias("ci_high"), "switchers", "reps_completed")
    reference = paths.select("spec").distinct().withColumns(
        {"term": F.lit("Reference"), "event_time": F.lit(-1), "estimate": F.lit(0.0)})
    return named.unionByName(reference, allowMissingColumns=True)
