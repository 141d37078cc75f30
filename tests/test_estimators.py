import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import dose as dose_did, panel, regression, resampling, sdid


def fit(y, x, cluster=None):
    inv = np.linalg.pinv(x.T @ x)
    b = inv @ x.T @ y
    e = y - x @ b
    n, k = x.shape
    if cluster is None:
        meat, adj = (x * (e ** 2)[:, None]).T @ x, n / (n - k)
    else:
        groups = np.unique(cluster)
        scores = np.array([x[cluster == g].T @ e[cluster == g] for g in groups])
        meat, adj = scores.T @ scores, len(groups) / (len(groups) - 1) * (n - 1) / (n - k)
    return b, np.sqrt(np.diag(inv @ meat @ inv) * adj), 1 - (e @ e) / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize("cluster", [None, "g"])
def test_ols(spark, cluster):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    g = rng.integers(0, 15, 200)
    y = 1 + x @ [2, -1] + rng.normal(size=200) * (1 + g / 5)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(d)) for (a, b), c, d in zip(x, y, g)],
                               "x1 double, x2 double, y double, g int").repartition(5)
    df = df.unionByName(spark.createDataFrame([(float("nan"), 1.0, 1.0, 1)], df.schema))
    out = {r.term: r for r in regression.ols(df, "y", ["x1", "x2"], cluster=cluster).collect()}
    b, se, r2 = fit(y, np.column_stack([np.ones(200), x]), g if cluster else None)
    for i, t in enumerate(("const", "x1", "x2")):
        assert out[t].coefficient == pytest.approx(b[i]) and out[t].std_error == pytest.approx(se[i])
        assert out[t].nobs == 200 and out[t].r2 == pytest.approx(r2)


def panel_rows(rng, units, periods, holes=(), repeat=()):
    d = rng.random(units)
    d[:3] = 0.0
    rows = []
    for i in range(units):
        for t in range(periods):
            if (i, t) in holes:
                continue
            for _ in range(2 if (i, t) in repeat else 1):
                rows.append((i, t, t - 4, float(d[i]), float(rng.normal() + i + .3 * t + d[i] * max(t - 4, 0))))
    return rows


@pytest.mark.parametrize("holes,repeat", [((), ()), (((2, 3), (7, 5), (9, 0)), ()), (((1, 1),), ((4, 2), (5, 7)))])
def test_event_study_equals_dense_dummies(spark, holes, repeat):
    rng = np.random.default_rng(2)
    rows = panel_rows(rng, 15, 8, holes, repeat)
    df = spark.createDataFrame(rows, "u int, t int, e int, d double, y double").repartition(4)
    out = {r.event_time: r for r in regression.event_study(
        df, "u", "t", "e", {"y": "y"}, [regression.Spec("c", "d", "continuous")]).collect()}
    a = np.array(rows)
    times = [e for e in sorted(set(a[:, 2])) if e != -1]
    x = np.column_stack([a[:, 3] * (a[:, 2] == e) for e in times] + [a[:, 0] == i for i in range(1, 15)]
                        + [a[:, 1] == t for t in range(1, 8)] + [np.ones(len(a))]).astype(float)
    b, se, r2 = fit(a[:, 4], x, a[:, 0])
    for j, e in enumerate(times):
        r = out[int(e)]
        assert r.coefficient == pytest.approx(b[j], abs=1e-9) and r.std_error == pytest.approx(se[j], abs=1e-9)
        assert r.r2_twfe == pytest.approx(r2) and (r.nobs, r.n_units, r.k) == (len(a), 15, x.shape[1])


def test_unidentified_coefficients_are_null(spark):
    rows = panel_rows(np.random.default_rng(3), 10, 8)
    df = spark.createDataFrame(rows, "u int, t int, e int, d double, y double").where("d > 0")
    out = regression.event_study(df, "u", "t", "e", {"y": "y"}, [
        regression.Spec("z", "d", "top_vs_zero"), regression.Spec("c", "d", "continuous")])
    assert out.where("spec = 'z' AND coefficient IS NULL AND std_error IS NULL").count() == 7
    assert out.where("spec = 'c' AND coefficient IS NOT NULL").count() == 7


def test_treatment_samples_drop_null_scores(spark):
    units = spark.createDataFrame([(i, float(i) if i < 8 else None) for i in range(10)], "u int, d double")
    rows = {r.u: r.treated for r in regression.treatment_sample(units, "d", "top_vs_zero", "u").collect()}
    assert rows == {0: 0.0, 6: 1.0, 7: 1.0}
    rows = {r.u: r.treated for r in regression.treatment_sample(units, "d", "top_vs_bottom", "u").collect()}
    assert rows == {0: 0.0, 1: 0.0, 6: 1.0, 7: 1.0}


# ---- synthetic difference-in-differences ----------------------------------------------------------------------


def slow_simplex(gram, target, steps=200_000):
    """Frank-Wolfe with away steps; slow but independent of the code under test."""
    x = np.full(len(target), 1 / len(target))
    for _ in range(steps):
        g = gram @ x - target
        i, j = int(np.argmin(g)), int(np.argmax(np.where(x > 0, g, -np.inf)))
        d = np.zeros_like(x)
        d[i] += 1
        d[j] -= 1
        slope = -(g @ d)
        if slope < 1e-13:
            break
        x = x + min(x[j], slope / max(d @ gram @ d, 1e-300)) * d
    return x


def slow_sdid(y, treated, before):
    tr, co = y[treated], y[~treated]
    n1, post = len(tr), y.shape[1] - before
    sigma = np.diff(co[:, :before], axis=1).std(ddof=1)
    a = (co[:, :before] - co[:, :before].mean(axis=1, keepdims=True)).T
    b = tr[:, :before].mean(axis=0)
    b = b - b.mean()
    omega = slow_simplex(a.T @ a + np.sqrt(n1 * post) * sigma ** 2 * before * np.eye(len(co)), a.T @ b)
    z = co[:, :before] - co[:, :before].mean(axis=0)
    w = co[:, before:].mean(axis=1)
    lam = slow_simplex(z.T @ z + (1e-6 * sigma) ** 2 * len(co) * np.eye(before), z.T @ (w - w.mean()))
    gap = tr.mean(axis=0) - omega @ co
    return gap - lam @ gap[:before], omega @ co


def sdid_panel(rng, effect, units=40, periods=14, before=9):
    d = np.arange(units) / units
    factor = rng.normal(size=(2, periods)).cumsum(axis=1)
    y = rng.normal(size=(units, 1)) + (rng.random((units, 2)) @ factor) + .1 * rng.normal(size=(units, periods))
    treated = d >= np.quantile(d, .75)
    y[np.ix_(treated, range(before, periods))] += effect
    months = [f"2020-{t + 1:02d}" if t < 12 else f"2021-{t - 11:02d}" for t in range(periods)]
    return d, y, months


@pytest.mark.parametrize("effect", [0.0, 2.0])
def test_sdid_equals_an_independent_solve(spark, effect):
    rng = np.random.default_rng(4)
    d, y, months = sdid_panel(rng, effect)
    df = spark.createDataFrame([(i, m, float(d[i]), float(y[i, t])) for i in range(len(d)) for t, m in enumerate(months)],
                               "u int, p string, d double, y double").repartition(6)
    paths = sdid.sdid_paths(df, "u", "p", [sdid.SdidSpec("s", "y", "d", "top_vs_bottom")], months[9], replicates=20).persist()
    keep = (d >= np.quantile(d, .75)) | (d <= np.quantile(d, .25))
    want, synthetic = slow_sdid(y[keep], (d >= np.quantile(d, .75))[keep], 9)
    got = paths.where("rep = 0").orderBy("event_time").collect()
    assert [r.effect for r in got] == pytest.approx(list(want), abs=1e-5)
    assert [r.synthetic_mean for r in got] == pytest.approx(list(synthetic), abs=1e-5)
    est = sdid.sdid_estimates(paths).first()
    assert est.att == pytest.approx(want[9:].mean(), abs=1e-5) and abs(est.att - effect) < 4 * est.std_error
    assert (est.n_treated, est.n_control, est.n_periods, est.n_post_periods, est.n_pre_periods) == (10, 10, 14, 5, 9)
    assert est.reps_completed == 20 and est.std_error > 0
    path = {r.event_time: r for r in sdid.sdid_event_path(paths).collect()}
    assert path[-1].estimate == 0.0 and path[-1].term == "Reference"
    assert path[0].term == "Effect_1" and path[-2].term == "Placebo_1" and set(path) == set(range(-9, 5))


def sdid_frame(spark, d, y, months):
    rows = [(i, months[t], float(d[i]), float(y[i, t])) for i in range(len(d)) for t in range(len(months))]
    return spark.createDataFrame(rows, "u int, p string, d double, y double")


def months_from(year, n):
    return [f"{year + m // 12}-{m % 12 + 1:02d}" for m in range(n)]


def test_sdid_returns_every_effect(spark):
    months = months_from(2000, 88)
    rng = np.random.default_rng(4)
    d, y = rng.random(24), rng.normal(size=(24, 88)).cumsum(axis=1)
    paths = sdid.sdid_paths(sdid_frame(spark, d, y, months), "u", "p", [sdid.SdidSpec("s", "y", "d", "top_vs_bottom")], months[8], replicates=1).persist()
    assert [r.event_time for r in sdid.sdid_event_path(paths).orderBy("event_time").collect()] == list(range(-8, 80))
    assert sdid.sdid_event_path(paths, max_effects=3).agg(F.max("event_time")).first()[0] == 2


def test_sdid_specifications_that_cannot_be_estimated_tell_why(spark):
    months = months_from(2000, 8)
    rng = np.random.default_rng(5)
    d, y = 1 + rng.random(12), rng.normal(size=(12, 8))
    df = sdid_frame(spark, d, y, months).withColumn("none", F.lit(None).cast("double"))
    specs = [sdid.SdidSpec("ok", "y", "d", "top_vs_bottom"), sdid.SdidSpec("no zero", "y", "d", "top_vs_zero"), sdid.SdidSpec("no dose", "y", "none", "top_vs_zero")]
    paths = sdid.sdid_paths(df, "u", "p", specs, months[5], replicates=2).persist()
    rows = {r.spec: r for r in sdid.sdid_estimates(paths, specs).collect()}
    assert set(rows) == {"ok", "no zero", "no dose"} and rows["ok"].att is not None and rows["ok"].converged and rows["ok"].reason is None
    assert rows["no zero"].att is None and "comparison" in rows["no zero"].reason and rows["no dose"].reason == "no dose"
    assert rows["no zero"].control_rule == "zero exposure" and rows["ok"].outcome == "y" and rows["ok"].q25 < rows["ok"].q75
    assert {r.spec for r in sdid.sdid_levels(paths).collect()} == {"ok"}


def test_sdid_without_spread_between_replicates_has_no_p_value(spark):
    months = months_from(2000, 6)
    y = np.tile(np.arange(6.0), (8, 1))
    paths = sdid.sdid_paths(sdid_frame(spark, np.arange(8.0), y, months), "u", "p", [sdid.SdidSpec("s", "y", "d", "top_vs_bottom")], months[4], replicates=5)
    row = sdid.sdid_estimates(paths.withColumn("effect", F.lit(1.0)).where("period IS NOT NULL")).first()
    assert row.std_error == 0 and row.p_value is None and row.att == 1.0


def test_a_period_that_occurs_twice_is_an_error(spark):
    months = months_from(2000, 6)
    df = sdid_frame(spark, np.arange(8.0), np.zeros((8, 6)), months)
    twice = df.where(~((F.col("u") == 7) & (F.col("p") == months[1]))).unionByName(df.where((F.col("u") == 7) & (F.col("p") == months[2])))
    with pytest.raises(Exception, match="occurs twice"):
        sdid.sdid_paths(twice, "u", "p", [sdid.SdidSpec("s", "y", "d", "top_vs_bottom")], months[4], replicates=0).collect()


def test_more_periods_than_a_solver_would_take(spark):
    df = spark.range(2001).select(F.format_string("%05d", "id").alias("p"))
    rows = {r.p: (r.time_period, r.event_time) for r in panel.period_index(df, "p", "00100").collect()}
    assert len(rows) == 2001 and rows["02000"] == (2001, 1900) and rows["00000"] == (1, -100)
    with pytest.raises(ValueError, match="not among"):
        panel.period_index(df, "p", "x")


def test_simplex_least_squares_against_slow_solver():
    rng = np.random.default_rng(7)
    for size in (1, 2, 5, 30, 60):
        a = rng.normal(size=(size + 5, size))
        gram, target = a.T @ a + 1e-8 * np.eye(size), a.T @ rng.normal(size=size + 5)
        x, done = sdid.simplex_least_squares(gram, target)
        assert done
        slow = slow_simplex(gram, target)
        value = lambda v: v @ gram @ v / 2 - target @ v
        assert x.min() >= 0 and x.sum() == pytest.approx(1) and value(x) <= value(slow) + 1e-9


# ---- continuous dose ------------------------------------------------------------------------------------------


def test_spline_basis_is_a_basis_with_slopes():
    x = np.linspace(.1, .9, 41)
    b = dose_did.spline_basis(x, .1, .9, [.4])
    assert b.shape == (41, 5)
    for power in range(4):  # cubic polynomials are reproduced
        coef, *_ = np.linalg.lstsq(b, x ** power, rcond=None)
        assert b @ coef == pytest.approx(x ** power, abs=1e-10)
    step = 1e-6
    numeric = (dose_did.spline_basis(x[1:-1] + step, .1, .9, [.4]) - dose_did.spline_basis(x[1:-1] - step, .1, .9, [.4])) / (2 * step)
    assert dose_did.spline_basis(x[1:-1], .1, .9, [.4], derivative=True) == pytest.approx(numeric, abs=1e-5)


def dose_panel(rng, units=60, periods=8, before=4, noise=.01):
    d = rng.random(units)
    d[:12] = 0.0
    y = rng.normal(size=(units, 1)) + np.arange(periods) * .2 + noise * rng.normal(size=(units, periods))
    y[:, before:] += (d + d ** 2)[:, None]
    return d, y, [f"2022-{t + 1:02d}" for t in range(periods)]


def test_dose_response_recovers_a_known_curve(spark):
    d, y, months = dose_panel(np.random.default_rng(8))
    df = spark.createDataFrame([(i, m, float(d[i]), float(y[i, t])) for i in range(len(d)) for t, m in enumerate(months)],
                               "u int, p string, d double, y double").repartition(5)
    spec = dose_did.DoseSpec("s", "y", "d")
    fits = dose_did.fit_doses(df, "u", "p", [spec], months[4])
    curve = dose_did.dose_response(spark, fits).collect()
    for r in curve:
        truth = r.dose + r.dose ** 2 if r.parameter == "att" else 1 + 2 * r.dose
        assert abs(r.estimate - truth) < (.02 if r.parameter == "att" else .3)
    # against a plain least squares on the same basis
    on = d > 0
    change = y[:, 4:].mean(axis=1) - y[:, 3]
    f = fits[0]
    beta, *_ = np.linalg.lstsq(dose_did.spline_basis(d[on], f.low, f.high, f.knots), change[on], rcond=None)
    att = dose_did.spline_basis(f.grid, f.low, f.high, f.knots) @ beta - change[~on].mean()
    assert [r.estimate for r in curve if r.parameter == "att"] == pytest.approx(list(att), abs=1e-8)
    overall = dose_did.dose_overall(spark, fits).first()
    assert overall.att == pytest.approx(change[on].mean() - change[~on].mean())
    assert overall.acrt == pytest.approx(1 + 2 * d[on].mean(), abs=.1) and overall.att_se > 0
    events = {r.event_time: r for r in dose_did.dose_event_study(spark, fits).collect()}
    assert set(events) == set(range(-4, 4)) and events[-4].band_low is None  # nothing comes before the first period
    assert abs(events[-2].acrt) < .2 and abs(events[2].acrt - (1 + 2 * d[on].mean())) < .2
    assert events[1].band_low < events[1].acrt < events[1].band_high and events[1].critical_value > 1.96
    unseen = dose_did.DoseSpec("unseen", spec.outcome, "nothing")
    table, empty = dose_did.run_table(df.withColumn("nothing", F.lit(None).cast("double")), "u", "p", [spec, unseen], months[4]).collect()
    assert (table.control_rule, table.n_units, table.n_periods) == (dose_did.ZERO_RULE, 60, 8) and table.design.endswith(months[4])
    assert (empty.spec, empty.control_rule, empty.n_units, empty.q25) == ("unseen", None, 0, None)


def test_dose_without_zero_units_uses_the_first_quartile(spark):
    d, y, months = dose_panel(np.random.default_rng(9))
    d = d + .1
    df = spark.createDataFrame([(i, m, float(d[i]), float(y[i, t])) for i in range(len(d)) for t, m in enumerate(months)],
                               "u int, p string, d double, y double")
    sample = dose_did.dose_sample(df, "u", "p", "y", "d", 5)
    assert sample.first().control_rule == dose_did.QUARTILE_RULE
    q25 = np.quantile(d, .25)
    rows = sample.select("u", "d", "g").distinct().collect()
    assert all((r.d == 0 and r.g == 0) == (d[r.u] <= q25) for r in rows)


def test_dose_specifications_that_cannot_be_estimated_tell_why(spark):
    rng = np.random.default_rng(8)
    months = months_from(2000, 8)
    df = sdid_frame(spark, np.concatenate([np.zeros(6), 1 + rng.random(18)]), rng.normal(size=(24, 8)), months).withColumn("none", F.lit(None).cast("double"))
    fits = dose_did.fit_doses(df, "u", "p", [dose_did.DoseSpec("ok", "y", "d"), dose_did.DoseSpec("bad", "y", "none")], months[5], draws=30)
    overall = {r.spec: r for r in dose_did.dose_overall(spark, fits).collect()}
    assert overall["ok"].att is not None and overall["ok"].reason is None and overall["bad"].att is None and "exposed" in overall["bad"].reason
    curves = dose_did.dose_response(spark, fits)
    inside = curves.where("spec = 'ok'").select(F.min((F.col("band_low") <= F.col("ci_low")).cast("int")), F.min("critical_value")).first()
    assert inside[0] == 1 and inside[1] > 1.9 and curves.where("spec = 'bad'").count() == 1
    events = dose_did.dose_event_study(spark, fits)
    assert events.where("spec = 'ok'").count() == 8 and events.where("spec = 'ok' AND band_low IS NULL").count() >= 1


def test_dose_must_be_constant(spark):
    df = spark.createDataFrame([(1, "2022-01", 1.0, 1.0), (1, "2022-02", 2.0, 1.0)], "u int, p string, d double, y double")
    with pytest.raises(ValueError, match="varies"):
        dose_did.fit_doses(df, "u", "p", [dose_did.DoseSpec("s", "y", "d")], "2022-02")


def test_draws():
    keys = np.arange(-50_000, 50_000)
    counts = resampling.unit_counts(keys, np.arange(3))
    assert (counts[:, 0] == 1).all() and counts[:, 1].mean() == pytest.approx(1, abs=.02)
    assert counts[:, 2].var() == pytest.approx(1, abs=.03)
    xi = resampling.multipliers(keys, np.arange(1, 3))
    assert xi.mean(axis=0) == pytest.approx([0, 0], abs=.02) and xi.var(axis=0) == pytest.approx([1, 1], abs=.03)
    assert abs(np.corrcoef(xi.T)[0, 1]) < .02
    assert math.isclose(float((resampling.uniforms(keys[:5], np.array([1])) == resampling.uniforms(keys[:5], np.array([1]))).mean()), 1)


def test_an_exact_fit_has_no_p_value(spark):
    fit = regression.ols(spark.createDataFrame([(float(i), 2.0 * i) for i in range(5)], "x double, y double"), "y", ["x"])
    slope = fit.where("term = 'x'").first()
    assert slope.coefficient == pytest.approx(2) and (slope.p_value is None or slope.std_error > 0)
    assert regression._inference(1.0, 0.0, 5) == (1.0, 0.0, None)
