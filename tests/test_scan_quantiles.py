import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators.quantiles import exact_quantiles
from panelloom.operators.scan import running, spread


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_running_values_do_not_depend_on_chunks(spark, inclusive, chunk):
    rng = np.random.default_rng(1)
    rows = [(d, int(n), None if rng.random() < .4 else int(rng.integers(0, 50))) for d in ("a", "b")
            for n in np.sort(rng.choice(200, 60, replace=False))]
    df = spark.createDataFrame(rows, "doc string, n int, v int").repartition(5)
    out = running(df, ["doc"], "n", {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))},
                  inclusive, chunk)
    got = {(r.doc, r.n): (r.s, r.m, r.l) for r in out.collect()}
    for doc in ("a", "b"):
        seen = []
        for d, n, v in rows:
            if d != doc:
                continue
            now = seen + ([v] if v is not None else [])
            use = now if inclusive else seen
            assert got[(d, n)] == (sum(use), max(use) if use else None, use[-1] if use else None)
            seen = now


@pytest.mark.parametrize("ranges", [1, 7])
def test_exact_quantiles_under_skew(spark, ranges):
    rng = np.random.default_rng(2)
    values = {"a": np.concatenate([np.full(400, 3.0), rng.lognormal(0, 3, 800)]), "b": rng.integers(0, 9, 37).astype(float),
              "c": np.array([7.5])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v double")
    probs = {"q1": .01, "q25": .25, "q50": .5, "q75": .75, "q99": .99}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    out = exact_quantiles(df.repartition(6), "v", probs, ["g"]).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    for r in out:
        assert r.n == len(values[r.g])
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(values[r.g], p), rel=1e-12)


def test_average_rule(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 9)], "v double")
    r = exact_quantiles(df, "v", {"q25": .25, "q75": .75}, rule="average").first()
    assert (r.q25, r.q75) == (2.5, 6.5)
    r = exact_quantiles(df.where("v < 8"), "v", {"q25": .25, "q75": .75}, rule="average").first()
    assert (r.q25, r.q75) == (2.0, 6.0)


def test_lines_of_one_split_are_spread(spark):
    lines = spark.range(4000).coalesce(1).select(F.lit("d").alias("doc"), "id")
    out = spread(lines, ["doc"], "id", 100).withColumn("task", F.spark_partition_id())
    assert out.select("task").distinct().count() > 4 and out.count() == 4000
    assert out.groupBy(F.floor(F.col("id") / 100)).agg(F.count_distinct("task").alias("n")).where("n > 1").isEmpty()
