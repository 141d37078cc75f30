import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F

from panelloom.operators import forest, trees


def plain(bins, y, w, least, depth, rows=None):
    """The same tree, node by node: mean of each row's leaf."""
    rows = np.flatnonzero(w) if rows is None else rows
    out, (n, mean) = {}, (w[rows].sum(), np.average(y[rows], weights=w[rows]))
    best = (1e-9, None, None)
    for f in range(bins.shape[1]) if depth else []:
        for b in range(trees.BINS):
            left = rows[bins[rows, f] <= b]
            nl = w[left].sum()
            if least <= nl <= n - least:
                s = (w[left] * (y[left] - mean)).sum()
                gain = s * s / (nl * (n - nl))
                if gain > best[0] * (1 + 1e-6):
                    best = gain, f, b
    if best[1] is None:
        return {r: mean for r in rows}
    goes = bins[rows, best[1]] <= best[2]
    for side in (rows[goes], rows[~goes]):
        out |= plain(bins, y, w, least, depth - 1, side)
    return out


@pytest.mark.parametrize("least,depth", [(2, 30), (1, 30), (5, 4)])
def test_trees_equal_plain_ones(least, depth):
    rng = np.random.default_rng(8)
    matrix, y = rng.normal(size=(400, 4)), rng.normal(size=400)
    matrix[:, 3] = rng.integers(0, 3, 400)  # few values
    bins = trees.binned(matrix, [trees.cuts(matrix[:, f]) for f in range(4)])
    weights = [trees.sample(400, 1, t) for t in range(3)]
    weights[1][:5] = 20  # more often than a small node's keys can hold
    weights[2][:] = 0
    weights[2][7] = 3
    for tree, w in zip(trees.Grower(bins, y, least, depth).grow(weights), weights):
        want = plain(bins, y, w, least, depth)
        assert tree.predict(bins)[list(want)] == pytest.approx(list(want.values()))
        assert len(tree.value) == len(set(want.values()))


def test_networks_sort():
    rng = np.random.default_rng(2)
    for n in trees.SMALL_SIZES:
        x = rng.integers(0, 9, (50, n))
        for a, k, run in trees.network(n):
            low, high = x[:, a:a + run].copy(), x[:, a + k:a + k + run].copy()
            x[:, a:a + run], x[:, a + k:a + k + run] = np.minimum(low, high), np.maximum(low, high)
        assert (np.diff(x, axis=1) >= 0).all()


def test_cuts_divide_evenly():
    assert trees.cuts(np.array([3., 1, 1, 2])).tolist() == [1.5, 2.5] and trees.cuts(np.zeros(9)).tolist() == []
    values = np.random.default_rng(0).normal(size=3200)
    assert np.bincount(np.searchsorted(trees.cuts(values), values)).tolist() == [100] * 32
    near = np.array([1.0, np.nextafter(1.0, 2)])
    assert np.searchsorted(trees.cuts(near), near).tolist() == [0, 1]


def vectors(spark, rows, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, 6))
    return spark.createDataFrame([(i, [float(a) for a in v], float(v[0] + v[1])) for i, v in enumerate(x)], "id long, v array<double>, y double")


def test_a_forest_is_a_few_jobs_whatever_its_nodes(spark):
    df, context = vectors(spark, 600).persist(), spark.sparkContext
    df.count()
    context.setJobGroup("one forest", "counted")
    try:
        model = forest.fit(df, "v", "y", trees=32)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert model.trees == 32 and len(context.statusTracker().getJobIdsForGroup("one forest")) <= 8  # one for each level and share before
    assert forest.error_metrics(forest.predict(model, df, "v"), "y", "rf").first().r2 > .9


def test_a_forest_does_not_depend_on_how_rows_are_dealt(spark):
    df, found = vectors(spark, 150), []
    for dealt in (df.coalesce(1), df.repartition(5).orderBy(F.desc("id"))):
        model = forest.fit(dealt, "v", "y", trees=24)
        found.append([r.rf for r in forest.predict(model, dealt, "v").orderBy("id").collect()])
    assert found[0] == pytest.approx(found[1], abs=1e-12)


def test_rows_keep_their_columns(spark):
    df = vectors(spark, 30)
    model = forest.fit(df, "v", "y", trees=8)
    rows = df.select("id", F.lit(None).cast("string").alias("rf"), F.col("v").cast("array<float>").alias("v"),
                     F.struct(F.current_timestamp().alias("t"), F.col("id").cast("decimal(9,2)").alias("d")).alias("s"))
    out = forest.predict(model, rows, "v")
    assert out.columns == rows.columns and out.count() == 30 and out.where("rf IS NULL").isEmpty()
    assert {(r.id, int(r.s.d)) for r in out.collect()} == {(i, i) for i in range(30)}
    assert forest.predict(model, rows.where("id < 0"), "v").count() == 0
    assert out.select(F.sum("id")).first()[0] == 435


@pytest.mark.parametrize("bad", ["CAST(NULL AS array<double>)", "array(1D)", "array(double('NaN'), 1D, 1D, 1D, 1D, 1D)"])
def test_rows_that_are_no_vectors_are_errors(spark, bad):
    df = vectors(spark, 20)
    with pytest.raises(Exception, match="vectors"):
        forest.fit(df.withColumn("v", F.when(F.col("id") == 3, F.expr(bad)).otherwise(F.col("v"))), "v", "y", trees=8)


def test_rows_beyond_a_task_are_fitted_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(forest, "MATRIX_BYTES", 100)
    df = vectors(spark, 60)
    model = forest.fit(df, "v", "y", trees=8)
    assert all(isinstance(m, RandomForestRegressionModel) for m in model.shares)
    assert forest.predict(model, df, "v").where("rf IS NOT NULL").count() == 60


def test_folds_are_a_few_jobs_each(spark):
    df, context = vectors(spark, 200).withColumn("fold", (F.col("id") % 3).cast("int")).persist(), spark.sparkContext
    df.count()
    context.setJobGroup("folds", "counted")
    try:
        out = forest.cross_validate(df, "v", "y", "fold", trees=16).first()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert out.n == 200 and out.method == "random_forest" and out.r2 > .7
    assert len(context.statusTracker().getJobIdsForGroup("folds")) <= 40  # one for each level, share and fold before


def test_targets_of_many_batches_meet_every_share(spark):
    df = vectors(spark, 120)
    model = forest.fit(df, "v", "y", trees=24)
    want = {r.id: r.rf for r in forest.predict(model, df.coalesce(1), "v").collect()}
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "7")
    try:
        got = {r.id: r.rf for r in forest.predict(model, df.repartition(5), "v").collect()}
    finally:
        spark.conf.set(key, old)
    assert got == pytest.approx(want, abs=1e-12) and len(model.shares) == 3
