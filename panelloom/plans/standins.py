"""Roles played by the star-schema tables, as DataFrames and as the matching SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.periods import month_of, quarter_label

INTERVENTION = "1999-01"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shown_code(c) -> Column:
    """The four characters that are shown of a code.  Longer codes stay whole as keys: several share one shown form."""
    return F.lpad(F.col(c).cast("string"), 4, "0")


def micro(spark: SparkSession, folder: str) -> DataFrame:
    """Survey records.  Weights are additive, so lines collapse per part before they meet the part table."""
    lines = table(spark, folder, "lineitem").groupBy(
        "l_partkey", F.col("l_returnflag").alias("ACT1"), quarter_label("l_shipdate").alias("quarter")
    ).agg(F.sum("l_quantity").alias("FACTOREL"))
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("OCUP1"))
    return lines.join(parts, "l_partkey").drop("l_partkey")


MICRO = """micro AS (SELECT p_type AS "OCUP1", l_returnflag AS "ACT1", l_quantity AS "FACTOREL",
  concat(year(l_shipdate), 'Q', quarter(l_shipdate)) AS quarter FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores by part type; one type has none for the first method and another none for the second."""
    mean = table(spark, folder, "part").groupBy(F.col("p_type").alias("OCUP1")).agg(
        F.avg("p_retailprice").alias("_price"), F.avg("p_size").alias("_size"))
    return mean.select(
        "OCUP1", F.when(F.col("OCUP1") != "PROMO", F.col("_price") / 1000).alias("observed_exposure_rf"),
        F.when(F.col("OCUP1") != "SMALL", F.col("_size") / 50).alias("observed_exposure_cosine_weighted"))


SCORES = """scores AS (SELECT p_type AS "OCUP1",
  CASE WHEN p_type <> 'PROMO' THEN avg(p_retailprice) / 1000 END AS rf,
  CASE WHEN p_type <> 'SMALL' THEN avg(p_size) / 50 END AS cw FROM part GROUP BY 1)"""


def leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf scores: part -> type and brand -> type; prices are exact decimals, so that means do not depend on their order."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("CNO4"), F.concat_ws("|", "p_type", "p_brand").alias("CNO2"),
        F.col("p_type").alias("OCUP1"), (F.col("p_retailprice").cast("decimal(12,2)") * F.lit("0.001").cast("decimal(4,3)")).alias("observed_exposure_rf"),
        F.when(F.col("p_size") > 5, F.col("p_size") / 50).alias("observed_exposure_cosine_nearest"))


LEAVES = """leaves AS (SELECT cast(p_partkey AS VARCHAR) AS "CNO4", concat(p_type, '|', p_brand) AS "CNO2",
  p_type AS "OCUP1", CAST(p_retailprice AS DECIMAL(12,2)) * CAST(0.001 AS DECIMAL(4,3)) AS rf, CASE WHEN p_size > 5 THEN p_size / 50.0 END AS cn FROM part)"""


def middle_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Employment weight per middle level; the middles of one top level have none."""
    lines = table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    parts = table(spark, folder, "part")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.concat_ws("|", "p_type", "p_brand").alias("CNO2")).agg(F.sum(F.when(F.col("p_type") != "LARGE", F.col("q"))).alias("employment_weight"))


WEIGHTS = """weights AS (SELECT concat(p_type, '|', p_brand) AS "CNO2", sum(CASE WHEN p_type <> 'LARGE' THEN l_quantity END) AS employment_weight
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


def monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly panel: supplier x month with a stock, a flow and two time-constant doses."""
    lines = table(spark, folder, "lineitem").groupBy(
        F.col("l_suppkey").alias("unit"), month_of("l_shipdate").alias("period")
    ).agg(F.sum("l_quantity").alias("parados"), F.count(F.lit(1)).cast("double").alias("contratos"))
    return lines.join(doses(spark, folder), "unit")


def doses(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("unit"), F.greatest(F.col("s_acctbal"), F.lit(0.0)).alias("_a"), "s_nationkey"
    ).select("unit", (F.col("_a") / 10000).alias("dose"), (F.col("s_nationkey") / 25).alias("dose2"))


MONTHLY = """monthly AS (SELECT l_suppkey AS unit, strftime(l_shipdate, '%Y-%m') AS period,
  sum(l_quantity) AS parados, cast(count(*) AS DOUBLE) AS contratos,
  any_value(greatest(s_acctbal, 0.0) / 10000) AS dose, any_value(s_nationkey / 25.0) AS dose2
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Labelled (even) and unlabelled (odd) vectors."""
    rows = table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), (F.col("label") / 9).alias("score"))
    return rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1").drop("score")


VECTORS = """vecs AS (SELECT vec_id, cast(embedding AS DOUBLE[]) AS v, label / 9.0 AS score FROM embeddings),
 pairs AS (SELECT t.vec_id AS t_id, s.vec_id AS s_id, s.score AS score,
  CASE WHEN list_dot_product(t.v, t.v) > 0 AND list_dot_product(s.v, s.v) > 0
       THEN list_cosine_similarity(t.v, s.v) ELSE 0 END AS sim
  FROM vecs t JOIN vecs s ON t.vec_id % 2 = 1 AND s.vec_id % 2 = 0),
 near AS (SELECT t_id, s_id, sim, score FROM (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY sim DESC, s_id)
  AS rn FROM pairs) WHERE rn = 1),
 given AS (SELECT t_id, s_id, sim, score FROM (SELECT *, row_number() OVER (PARTITION BY s_id ORDER BY sim DESC, t_id)
  AS rn FROM pairs) WHERE rn = 1)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
