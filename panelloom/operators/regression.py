"""OLS and two-way fixed-effects event studies from sufficient statistics.

Spark aggregates the cross products; the driver only inverts matrices whose size is the number of terms or of calendar
periods.  Fixed effects are never expanded into dummy columns: unit effects are partialled out algebraically, which is
exact on unbalanced panels too, because one unit contributes ``diag(w) - w w'/n`` to the period block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.inference import Z95, student_two_sided
from ..functions.numbers import finite_or_null
from ..session import cut_lineage
from .panel import calendar, period_slots, dose_quantiles
from .quantiles import exact_quantiles
from .vectorsum import vector_sums

_PARTIAL = "spec int, v array<double>"
RESULT = "coefficient double, std_error double, p_value double, r2 double, nobs long, k int"


def ols(df: DataFrame, outcome: str, terms: list[str], by: str | None = None, cluster: str | None = None,
        intercept: bool = True) -> DataFrame:
    """One row per group and term, with HC1 errors, or cluster-robust ones when ``cluster`` is given.

    Rows with a null or non-finite outcome or term are left out.
    """
    group = by or "_all"
    base = df if by else df.withColumn("_all", F.lit("all"))
    names = (["const"] if intercept else []) + terms
    columns = {f"x{i}": F.lit(1.0) if n == "const" else finite_or_null(n) for i, n in enumerate(names)}
    rows = base.select(F.col(group).cast("string").alias("g"), finite_or_null(outcome).alias("y"),
                       *[c.alias(x) for x, c in columns.items()],
                       *([F.col(cluster).alias("cluster")] if cluster else [])).dropna(subset=["y", *columns])
    xs = list(columns)
    pairs = [(a, b) for a in range(len(xs)) for b in range(a, len(xs))]
    first = rows.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), (F.var_pop("y") * F.count(F.lit(1))).alias("sst"),
        *[F.sum(F.col(xs[a]) * F.col(xs[b])).alias(f"xx{a}_{b}") for a, b in pairs],
        *[F.sum(F.col(x) * F.col("y")).alias(f"xy{i}") for i, x in enumerate(xs)],
    ).collect()
    inverse, beta = {}, {}
    for r in first:
        inverse[r.g] = np.linalg.pinv(_symmetric(r, "xx", len(xs)))
        beta[r.g] = inverse[r.g] @ np.array([r[f"xy{i}"] for i in range(len(xs))])

    spark = df.sparkSession
    betas = spark.createDataFrame([(g, [float(v) for v in b]) for g, b in beta.items()], "g string, b array<double>")
    fitted = sum((F.col(x) * F.col("b")[i] for i, x in enumerate(xs)), F.lit(0.0))
    resid = rows.join(betas, "g").withColumn("e", F.col("y") - fitted)
    ssr = F.sum(F.col("e") * F.col("e")).alias("ssr")
    if cluster:
        scores = resid.groupBy("g", "cluster").agg(ssr, *[F.sum(F.col(x) * F.col("e")).alias(f"s{i}")
                                                          for i, x in enumerate(xs)])
        second = scores.groupBy("g").agg(
            F.sum("ssr").alias("ssr"), F.count(F.lit(1)).alias("clusters"),
            *[F.sum(F.col(f"s{a}") * F.col(f"s{b}")).alias(f"m{a}_{b}") for a, b in pairs]).collect()
    else:
        e2 = F.col("e") * F.col("e")
        second = resid.groupBy("g").agg(
            ssr, *[F.sum(e2 * F.col(xs[a]) * F.col(xs[b])).alias(f"m{a}_{b}") for a, b in pairs]).collect()
    meat = {r.g: r for r in second}
    out = []
    for r in first:
        m, n, k = meat[r.g], r.n, len(xs)
        vcov = inverse[r.g] @ _symmetric(m, "m", k) @ inverse[r.g]
        dof = max(n - k, 1)
        if cluster:
            g = m.clusters
            dof = max(g - 1, 1)
            if g > 1 and n > k:
                vcov = vcov * (g / (g - 1)) * ((n - 1) / (n - k))
        elif n > k:
            vcov = vcov * n / (n - k)
        r2 = 1.0 - m.ssr / r.sst if r.sst and r.sst > 0 else None
        for i, name in enumerate(names):
            out.append((r.g, name, *_inference(beta[r.g][i], vcov[i, i], dof), r2, n, k))
    result = spark.createDataFrame(out, f"{by or '_all'} string, term string, {RESULT}")
    return result if by else result.drop("_all")


def _symmetric(row, prefix: str, size: int) -> np.ndarray:
    m = np.empty((size, size))
    for a in range(size):
        for b in range(a, size):
            m[a, b] = m[b, a] = row[f"{prefix}{a}_{b}"]
    return m


def _inference(estimate: float, variance: float, dof: float) -> tuple[float, float, float | None]:
    """Estimate, standard error and p-value; without an error there is no p-value."""
    estimate, se = float(estimate), float(np.sqrt(max(variance, 0.0)))
    return estimate, se, student_two_sided(estimate / se, float(dof)) if se > 0 else None


def ols_table(sample: DataFrame, outcome: str, measures: dict[str, str]) -> DataFrame:
    """Outcome on each score column in turn, all regressions in one grouped pass.  ``measures``: label -> column."""
    long = sample.select(F.col(outcome).alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(label).alias("measure"), F.col(c).cast("double").alias("score"))
        for label, c in measures.items()])).alias("m")).select("_y", "m.*")
    means = long.where(finite_or_null("score").isNotNull()).groupBy("measure").agg(F.avg("_y").alias("depvar_mean"))
    fits = ols(long, "_y", ["score"], by="measure").where("term = 'score'").drop("term", "k")
    return fits.join(means, "measure")


# ---- event studies --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Spec:
    """``mode``: ``continuous``, ``top_vs_zero`` or ``top_vs_bottom``; ``dose`` is a time-constant score column."""

    name: str
    dose: str
    mode: str


def treatment_sample(units: DataFrame, dose: str, mode: str, unit: str) -> DataFrame:
    """Eligible units with their treatment value; units without a score are left out.

    The flag is ``score >= q75``, the comparison units are zero-score or bottom-quartile units.
    """
    if mode == "continuous":
        return units.where(finite_or_null(dose).isNotNull()).select(unit, F.col(dose).cast("double").alias("treated"))
    q = exact_quantiles(units, dose, {"q25": 0.25, "q75": 0.75}).first()
    return units.where(finite_or_null(dose).isNotNull()).select(
        unit, _flag(F.col(dose), mode, q.q25, q.q75).alias("treated")).where(F.col("treated").isNotNull())


def _flag(dose: Column, mode: str, q25: float, q75: float) -> Column:
    top = F.when(dose >= q75, F.lit(1.0))
    if mode == "top_vs_zero":
        return top.when(dose == 0, F.lit(0.0))
    if mode == "top_vs_bottom":
        return top.when(dose <= q25, F.lit(0.0))
    raise ValueError(f"unknown mode {mode}")


#: How a study says what its sample is.
def sample_note(mode: str, q25: float | None, q75: float | None) -> str:
    if mode == "continuous":
        return "continuous exposure"
    if mode == "top_vs_zero":
        return f"top quartile vs zero exposure; q75={q75:.6f}"
    return f"top quartile vs bottom quartile; q25={q25:.6f}; q75={q75:.6f}"


def event_design(panel: DataFrame, outcome: str, dose: str, event_time: str = "event_time", base: int = -1) -> DataFrame:
    """Event-time columns of the design: how many rows each has and whether it varies (constant ones are dropped)."""
    rows = panel.where(finite_or_null(outcome).isNotNull() & finite_or_null(dose).isNotNull())
    return rows.where(F.col(event_time) != base).groupBy(event_time).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(dose).alias("dose_sum"),
        (F.max(F.abs(F.col(dose))) > 0).alias("kept"))


def event_study(panel: DataFrame, unit: str, period: str, event_time: str, outcomes: dict[str, str],
                specs: list[Spec], base: int = -1) -> DataFrame:
    """Dose (or flag) x event time with unit and period effects, errors clustered by unit.

    All specifications and outcomes go through the same two passes.  A coefficient the data do not identify (no comparison
    units, say) is null.  Several rows per unit and period are allowed; they
    collapse to counts and sums before a unit's rows are brought together, so a unit is never more than one row per
    period.
    """
    spark = panel.sparkSession
    calendar_rows = sorted(calendar(panel, period, event_time), key=lambda r: r[1])
    labels, times = [r[0] for r in calendar_rows], np.array([r[1] for r in calendar_rows])
    size = len(labels)
    names = list(outcomes)
    doses = sorted({s.dose for s in specs})
    values = {f"y{i}": finite_or_null(c) for i, c in enumerate(outcomes.values())}
    slots = period_slots(panel, period, labels)
    rows = panel.select(F.col(unit).alias("unit"), F.col(period).alias("_period"),
                        *[finite_or_null(d).alias(d) for d in doses], *[c.alias(n) for n, c in values.items()])
    sums = [a for n in values for a in (F.count(n).cast("double").alias(f"n_{n}"), F.coalesce(F.sum(n), F.lit(0.0)).alias(f"s_{n}"),
                                        F.coalesce(F.sum(F.col(n) * F.col(n)), F.lit(0.0)).alias(f"q_{n}"))]
    # rows collapse to cells before a period becomes a slot
    cells = rows.groupBy("unit", "_period").agg(*sums, *[F.min(d).alias(d) for d in doses]).join(slots, "_period")
    stat = [f"{k}_{n}" for n in values for k in "nsq"]
    per_unit = cut_lineage(cells.groupBy("unit").agg(F.collect_list(F.struct("t", *stat)).alias("cells"),
                                                     *[F.min(d).alias(d) for d in doses]))
    ranked = sorted({s.dose for s in specs if s.mode != "continuous"})
    quantile = dose_quantiles(per_unit, ranked, {"q25": 0.25, "q75": 0.75}) if ranked else {}
    treat = [(F.col(s.dose) if s.mode == "continuous" else
              _flag(F.col(s.dose), s.mode, quantile[s.dose].q25, quantile[s.dose].q75)).alias(f"d{i}")
             for i, s in enumerate(specs)]
    units = per_unit.select("cells", *treat)

    grams = vector_sums(units.mapInArrow(_gram_kernel(size, len(specs), len(names)), _PARTIAL), ["spec"])
    solved = {}
    for (key,), flat in sorted(grams.items()):
        solved[key] = _solve(flat, size, times, base)
    paths = {k: (s["gamma"], s["delta"], s["to_event"]) for k, s in solved.items()}
    errors = vector_sums(units.mapInArrow(_error_kernel(size, len(specs), len(names), paths), _PARTIAL), ["spec"])
    out = []
    for key, s in solved.items():
        spec, name = specs[key // len(names)], names[key % len(names)]
        q = quantile.get(spec.dose)
        note = sample_note(spec.mode, q and q.q25, q and q.q75)
        flat = errors[(key,)]
        n, k, g = s["n"], s["k"], s["units"]
        variance = flat[:-1]
        if g > 1 and n > k:
            variance = variance * (g / (g - 1)) * ((n - 1) / (n - k))
        r2 = float(1.0 - flat[-1] / s["sst"]) if s["sst"] > 0 else None
        for j, t in enumerate(s["event_index"]):
            b, se, p = _inference(s["beta"][j], variance[j], max(g - 1, 1))
            found = (b, se, p, b - Z95 * se, b + Z95 * se) if not s["loose"][j] else (None,) * 5
            out.append((spec.name, name, spec.dose, spec.mode, int(times[t]), *found, int(n), int(g), r2, int(k), note))
    return spark.createDataFrame(out, "spec string, outcome string, exposure_measure string, mode string, "
                                 "event_time int, coefficient double, std_error double, p_value double, ci_low double, "
                                 "ci_high double, nobs long, n_units long, r2_twfe double, k int, sample_note string")


def _dense(batch: pa.RecordBatch, size: int, outcomes: int) -> np.ndarray:
    """units x 3*outcomes x periods from the list column of cells."""
    cells = batch.column("cells")
    offsets = cells.offsets.to_numpy()
    owner = np.repeat(np.arange(len(cells)), np.diff(offsets))
    flat = cells.flatten()
    slot = flat.field("t").to_numpy(zero_copy_only=False)
    out = np.zeros((len(cells), 3 * outcomes, size))
    for j in range(3 * outcomes):
        out[owner, j, slot] = flat.field(j + 1).to_numpy(zero_copy_only=False)
    return out


def _samples(batch: pa.RecordBatch, specs: int, outcomes: int, size: int):
    """(key, dose, counts, sums, squares) of every specification and outcome over the units that enter it."""
    dense = _dense(batch, size, outcomes)
    for i in range(specs):
        dose = batch.column(f"d{i}").to_numpy(zero_copy_only=False).astype(float)
        for j in range(outcomes):
            w, s, q = dense[:, 3 * j], dense[:, 3 * j + 1], dense[:, 3 * j + 2]
            use = ~np.isnan(dose) & (w.sum(axis=1) > 0)
            if use.any():
                yield i * outcomes + j, dose[use], w[use], s[use], q[use]


def _emit(totals: dict[int, np.ndarray]):
    if totals:
        yield pa.RecordBatch.from_pydict(
            {"spec": pa.array(list(totals), pa.int32()), "v": pa.array(list(totals.values()), pa.list_(pa.float64()))})


def _gram_kernel(size: int, specs: int, outcomes: int):
    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, d, w, s, q in _samples(batch, specs, outcomes, size):
                n = w.sum(axis=1)
                mean = s.sum(axis=1) / n
                blocks = []
                for f in (d * d, d, np.ones_like(d)):
                    blocks.append(np.diag((f[:, None] * w).sum(axis=0)) - (w * (f / n)[:, None]).T @ w)
                centred = s - w * mean[:, None]
                flat = np.concatenate([b.ravel() for b in blocks] + [
                    (d[:, None] * centred).sum(axis=0), centred.sum(axis=0), w.sum(axis=0), (d * d) @ w,
                    [n.sum(), float(len(d)), s.sum(), q.sum()]])
                totals[key] = totals.get(key, 0.0) + flat
        yield from _emit(totals)
    return run


def _solve(flat: np.ndarray, size: int, times: np.ndarray, base: int) -> dict:
    blocks = flat[:3 * size * size].reshape(3, size, size)
    rest = flat[3 * size * size:]
    ey, py, seen, dose2 = rest[:size], rest[size:2 * size], rest[2 * size:3 * size], rest[3 * size:4 * size]
    n, units, total, squares = rest[4 * size:]
    present = np.flatnonzero(seen > 0)
    event_index = [t for t in present if times[t] != base and dose2[t] > 0]
    columns = np.array([*event_index, *(size + present[1:])], dtype=int)
    gram = np.block([[blocks[0], blocks[1]], [blocks[1].T, blocks[2]]])[np.ix_(columns, columns)]
    inverse = np.linalg.pinv(gram, hermitian=True)
    beta = inverse @ np.concatenate([ey, py])[columns]
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    level, direction = np.linalg.eigh(gram / np.outer(scale, scale))
    loose = (direction[:, level < 1e-9 * max(level.max(), 1.0)] ** 2).sum(axis=1) > 1e-9
    gamma, delta = np.zeros(size), np.zeros(size)
    gamma[event_index] = beta[:len(event_index)]
    delta[present[1:]] = beta[len(event_index):]
    # rows of the inverse that turn a unit's scores into its pull on each event coefficient
    to_event = np.zeros((len(event_index), 2 * size))
    to_event[:, columns] = inverse[:len(event_index)]
    return {"beta": beta, "event_index": event_index, "gamma": gamma, "delta": delta, "to_event": to_event, "loose": loose,
            "n": n, "units": units, "sst": squares - total * total / n,
            "k": len(event_index) + (units - 1) + (len(present) - 1) + 1}


def _error_kernel(size: int, specs: int, outcomes: int, paths: dict[int, tuple]):
    """Sums over units of the squared pull on every event coefficient, and the residual sum of squares."""
    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, d, w, s, q in _samples(batch, specs, outcomes, size):
                gamma, delta, to_event = paths[key]
                seen = w > 0
                cell_mean = np.divide(s, w, out=np.zeros_like(s), where=seen)
                r = np.where(seen, cell_mean - d[:, None] * gamma - delta, 0.0)
                r = np.where(seen, r - ((w * r).sum(axis=1) / w.sum(axis=1))[:, None], 0.0)
                e = w * r
                pull = d[:, None] * (e @ to_event[:, :size].T) + e @ to_event[:, size:].T
                spread = (q - np.where(seen, s * cell_mean, 0.0)).sum()  # rows of one cell around their mean
                flat = np.append((pull * pull).sum(axis=0), (w * r * r).sum() + max(spread, 0.0))
                totals[key] = totals.get(key, 0.0) + flat
        yield from _emit(totals)
    return run
