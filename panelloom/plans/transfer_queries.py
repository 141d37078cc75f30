"""Similarity transfer, forests and cache-aware enrichment on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_title
from ..operators import enrich, forest, transfer
from ..session import new_scratch
from .rollup_queries import rounded
from .standins import VECTORS, table, vectors, with_ctes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def _matches(spark, d):
    source, target = vectors(spark, d)
    return source, target, transfer.best_matches(source, target, "vec_id", "embedding")


WEIGHTED = """, got AS (SELECT t_id, sum(sim * score) AS num, sum(sim) AS den FROM given GROUP BY 1),
 scored AS (SELECT near.t_id, near.score AS nearest, CASE WHEN den > 0 THEN num / den ELSE near.score END AS weighted
  FROM near LEFT JOIN got USING (t_id)),
 mp AS (SELECT 'cosine_nearest' AS method, t_id, s_id, sim FROM near UNION ALL
  SELECT 'cosine_weighted', t_id, s_id, sim FROM given UNION ALL
  SELECT 'cosine_weighted', t_id, s_id, sim FROM near WHERE t_id NOT IN (SELECT t_id FROM given))"""


@query("j9", with_ctes(VECTORS) + """SELECT 'target' AS side, t_id AS ordinal, s_id AS best, round(sim, 6) AS similarity
 FROM near UNION ALL SELECT 'source', s_id, t_id, round(sim, 6) FROM given""")
def j9(spark, d):
    return rounded(_matches(spark, d)[2].drop("fold"))


@query("m1", """SELECT p_partkey, p_retailprice AS score, cast(len(embedding) AS INTEGER) AS dimension
 FROM part JOIN embeddings ON vec_id = p_partkey WHERE p_size > 3""")
def m1(spark, d):
    rows = table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit("v"), "p_partkey", F.lit(" (CNO 1)")).alias("title"),
        F.when(F.col("p_size") > 3, F.col("p_retailprice").cast("string")).otherwise("n/a").alias("score"))
    keyed = table(spark, d, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("text"), "embedding")
    out = transfer.attach_vectors(rows, keyed, clean_title("title"), score="score")
    return out.select("p_partkey", "score", F.size("embedding").alias("dimension"))


@query("m2", with_ctes(VECTORS) + "SELECT t_id AS ordinal, round(score, 6) AS cosine_nearest FROM near")
def m2(spark, d):
    source, _, matches = _matches(spark, d)
    return rounded(transfer.nearest_scores(matches, source, "vec_id", "score").drop("fold"))


@query("m3", with_ctes(VECTORS) + WEIGHTED +
       "SELECT t_id AS ordinal, round(nearest, 6) AS cosine_nearest, round(weighted, 6) AS cosine_weighted FROM scored")
def m3(spark, d):
    source, _, matches = _matches(spark, d)
    return rounded(transfer.weighted_scores(matches, source, "vec_id", "score").drop("fold"))


@query("m4", with_ctes(VECTORS) + WEIGHTED + """SELECT method, t_id AS target, s_id AS source,
 round(sim, 6) AS cosine_similarity, t.label AS target_label, s.label AS source_label, round(s.label / 9.0, 6)
 AS source_score FROM mp JOIN embeddings t ON t.vec_id = t_id JOIN embeddings s ON s.vec_id = s_id""")
def m4(spark, d):
    source, target, matches = _matches(spark, d)
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    out = transfer.match_table(matches, source.join(labels, "vec_id"), target.join(labels, "vec_id"), "vec_id", "score",
                               {"label": "source_label"}, {"label": "target_label"})
    return rounded(out)


OVERRIDES = {"0011": "S4", "0101": "S8", "0003": "S-missing"}
OVERRIDDEN = WEIGHTED + """, o AS (SELECT t.vec_id AS t_id, s.vec_id AS s_id, s.score,
  list_cosine_similarity(t.v, s.v) AS sim FROM vecs t JOIN vecs s ON (t.vec_id, s.vec_id) IN ((11, 4), (101, 8)))"""


def _coded(spark, d):
    source, target = vectors(spark, d)
    return (source.withColumn("code", F.concat(F.lit("S"), "vec_id")),
            target.withColumn("CNO4", F.lpad(F.col("vec_id").cast("string"), 4, "0")))


@query("m5", with_ctes(VECTORS) + OVERRIDDEN + """SELECT t_id AS ordinal, lpad(cast(t_id AS VARCHAR), 4, '0') AS "CNO4",
 round(coalesce(o.score, nearest), 6) AS cosine_nearest, round(coalesce(o.score, weighted), 6) AS cosine_weighted
 FROM scored LEFT JOIN o USING (t_id)""")
def m5(spark, d):
    source, target = _coded(spark, d)
    matches = transfer.best_matches(source, target, "vec_id", "embedding")
    scores = transfer.weighted_scores(matches, source, "vec_id", "score").drop("fold").join(
        target.select(F.col("vec_id").alias("ordinal"), "CNO4"), "ordinal")
    return rounded(transfer.override_scores(scores, source, OVERRIDES, "CNO4", "code", "score",
                                            ["cosine_nearest", "cosine_weighted"]))


@query("m5_pairs", with_ctes(VECTORS) + OVERRIDDEN + """SELECT method, t_id AS target, s_id AS source,
 round(sim, 6) AS similarity FROM mp WHERE t_id NOT IN (SELECT t_id FROM o) UNION ALL
 SELECT m, t_id, s_id, round(sim, 6) FROM o CROSS JOIN (SELECT unnest(['cosine_nearest', 'cosine_weighted']) AS m)""")
def m5_pairs(spark, d):
    source, target = _coded(spark, d)
    pairs = transfer.match_pairs(transfer.best_matches(source, target, "vec_id", "embedding"))
    return rounded(transfer.override_pairs(pairs, source, target, OVERRIDES, "vec_id", "embedding", "CNO4", "code"))


@query("m6")
def m6(spark, d):
    source, target = vectors(spark, d)
    model = forest.fit(source, "embedding", "score")
    return forest.predict(model, target, "embedding").select("vec_id", "rf")


@query("m6_bounds", """SELECT vec_id, true AS inside FROM embeddings WHERE vec_id % 2 = 1""")
def m6_bounds(spark, d):
    """A forest averages scores it has seen, so every target's value lies between the smallest and the largest of them."""
    source, target = vectors(spark, d)
    span = source.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    scored = forest.predict(forest.fit(source, "embedding", "score", trees=100), target, "embedding")
    return scored.select("vec_id", F.col("rf").between(span.low - 1e-9, span.high + 1e-9).alias("inside"))


@query("m8_forest_gain", """SELECT count(*) AS n, round(avg(abs(score - mean)), 6) AS mean_mae, true AS forest_is_better FROM
 (SELECT s.score, (SELECT avg(o.score) FROM (SELECT label / 9.0 AS score, (vec_id // 2) % 5 AS fold FROM embeddings WHERE vec_id % 2 = 0) o
  WHERE o.fold <> s.fold) AS mean FROM (SELECT label / 9.0 AS score, (vec_id // 2) % 5 AS fold FROM embeddings WHERE vec_id % 2 = 0) s)""")
def m8_forest_gain(spark, d):
    """The forest's out-of-fold error is below that of the mean of the other folds."""
    rows = vectors(spark, d)[0].withColumn("fold", F.expr("(vec_id div 2) % 5").cast("int"))
    mean = transfer.cross_validate(rows, "vec_id", "embedding", "score", "fold").where("method = 'global_mean'").select("n", F.col("mae").alias("mean_mae"))
    found = forest.cross_validate(rows, "embedding", "score", "fold", trees=100).select("mae")
    return rounded(mean.select("n", "mean_mae", (F.lit(found.first().mae) < F.col("mean_mae")).alias("forest_is_better")))


@query("m7")
def m7(spark, d):
    return forest.holdout(vectors(spark, d)[0], "vec_id", "embedding", "score")


@query("m8", """WITH vecs AS (SELECT vec_id, cast(embedding AS DOUBLE[]) AS v, label / 9.0 AS score,
  (vec_id // 2) % 5 AS fold FROM embeddings WHERE vec_id % 2 = 0),
 pairs AS (SELECT t.vec_id AS t_id, s.vec_id AS s_id, s.score, t.fold AS f, t.score AS truth,
  list_cosine_similarity(t.v, s.v) AS sim FROM vecs t JOIN vecs s ON t.fold <> s.fold),
 near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY sim DESC, s_id) AS rn FROM pairs)
  WHERE rn = 1),
 given AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s_id, f ORDER BY sim DESC, t_id) AS rn FROM pairs)
  WHERE rn = 1),
 got AS (SELECT t_id, sum(sim * score) AS num, sum(sim) AS den FROM given GROUP BY 1),
 p AS (SELECT 'cosine_nearest' AS method, truth, score AS p FROM near UNION ALL
  SELECT 'cosine_weighted', truth, CASE WHEN den > 0 THEN num / den ELSE score END FROM near LEFT JOIN got USING (t_id)
  UNION ALL SELECT 'global_mean', v.score, ((SELECT sum(score) FROM vecs) - s) / ((SELECT count(*) FROM vecs) - n)
  FROM vecs v JOIN (SELECT fold, sum(score) AS s, count(*) AS n FROM vecs GROUP BY 1) USING (fold))
 SELECT method, count(*) AS n, round(avg(abs(truth - p)), 6) AS mae, round(sqrt(avg(pow(truth - p, 2))), 6) AS rmse,
 round(1 - sum(pow(truth - p, 2)) / (var_pop(truth) * count(*)), 6) AS r2 FROM p GROUP BY 1""")
def m8(spark, d):
    rows = vectors(spark, d)[0].withColumn("fold", F.expr("(vec_id div 2) % 5").cast("int"))
    return rounded(transfer.cross_validate(rows, "vec_id", "embedding", "score", "fold"))


@query("m8_forest")
def m8_forest(spark, d):
    rows = transfer.hash_folds(vectors(spark, d)[0], "vec_id")
    return forest.cross_validate(rows, "embedding", "score", "fold")


@query("m9", """SELECT text, cast(26 AS INTEGER) AS dimension, cast(length(regexp_replace(lower(text), '[^a-z]', '',
 'g')) AS DOUBLE) AS letters FROM (SELECT DISTINCT concat(p_name, ' ', p_brand) AS text FROM part)""")
def m9(spark, d):
    titles = table(spark, d, "part").select(
        F.concat("p_name", F.lit(" "), "p_brand", F.lit(" (códigos CNO-"), "p_size", F.lit(").")).alias("title"))
    out = enrich.embed(titles, "title", enrich.letter_counts, new_scratch(spark, "embedding-cache"), "letters")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, b: a + b)
    return out.select("text", F.size("embedding").alias("dimension"), total.alias("letters"))


def _shout(texts: list[str]) -> list[str]:
    return [f'"{t.upper()}"' for t in texts]


@query("m10", """SELECT text, CASE WHEN text = 'small ring' THEN 'Little ring' ELSE upper(text) END AS translation
 FROM (SELECT DISTINCT p_name AS text FROM part)""")
def m10(spark, d):
    cache = new_scratch(spark, "translation-cache")
    titles = table(spark, d, "part").select("p_name")
    first = titles.where("p_size <= 20")
    enrich.translate(first, "p_name", _shout, cache, "shout", overrides={})
    return enrich.translate(titles, "p_name", _shout, cache, "shout", overrides={"small ring": "Little ring"})


@query("m11", with_ctes(VECTORS) + WEIGHTED + """SELECT t_id AS ordinal, round(nearest, 6) AS cosine_nearest,
 round(weighted, 6) AS cosine_weighted, true AS has_forest FROM scored""")
def m11(spark, d):
    """All three methods side by side; the forest is checked for presence only."""
    source, target, matches = _matches(spark, d)
    cosines = transfer.weighted_scores(matches, source, "vec_id", "score").drop("fold")
    rf = forest.predict(forest.fit(source, "embedding", "score"), target, "embedding").select(
        F.col("vec_id").alias("ordinal"), "rf")
    out = transfer.assemble(target.select(F.col("vec_id").alias("ordinal")), "ordinal", cosines, rf)
    return rounded(out.select("ordinal", "cosine_nearest", "cosine_weighted",
                              (F.col("rf").isNotNull() & ~F.isnan("rf")).alias("has_forest")))
