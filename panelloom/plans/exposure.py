"""From labelled occupations, notes and survey records to occupation and industry exposure, in one call."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.text import clean_title
from ..operators import enrich, forest, joins, rollup, transfer
from ..operators.pick import with_ordinal
from ..session import cut_lineage
from ..sources import files, store

METHODS = ("rf", "cosine_weighted", "cosine_nearest")


@dataclass
class Exposure:
    """``leaves``: scored target codes; ``occupations``: their roll-up; ``industries``: industry x period panel;
    ``matches``: what each score came from; ``metrics``: out-of-fold errors of the methods."""

    leaves: DataFrame
    occupations: DataFrame
    industries: DataFrame
    matches: DataFrame
    metrics: DataFrame


def build_exposure(scored: DataFrame, descriptions: DataFrame, taxonomy: DataFrame, records: DataFrame,
                   provider: Callable[[list[str]], list], cache: str, model: str, weights: DataFrame | None = None,
                   labels: DataFrame | None = None, industry_labels: DataFrame | None = None, weight: str | None = None,
                   methods: tuple[str, ...] = METHODS, overrides: dict[str, str] | None = None,
                   trees: int = forest.TREES) -> Exposure:
    """``scored``: occ_code, title, observed_exposure.  ``taxonomy``: CNO4, CNO2, OCUP1, occupation_title,
    embedding_text.  ``records``: quarter, ACT1, OCUP1 and optionally a weight column."""
    unknown = sorted(set(methods) - set(METHODS))
    if unknown or not methods:
        raise ValueError(f"unknown methods {unknown}; choose from {list(METHODS)}")
    overrides = transfer.AUDITED_MATCHES if overrides is None else overrides
    text = clean_title("embedding_text")
    labelled = joins.with_descriptions(scored, descriptions)
    texts = labelled.select("embedding_text").unionByName(taxonomy.select("embedding_text"))
    vectors = enrich.embed(texts, "embedding_text", provider, cache, model)
    source = cut_lineage(with_ordinal(
        transfer.attach_vectors(labelled, vectors, text, score="observed_exposure"), "occ_code"))
    target = cut_lineage(with_ordinal(transfer.attach_vectors(taxonomy, vectors, text, required=True), "CNO4"))

    leaves, pairs = target, None
    if set(methods) & {"cosine_weighted", "cosine_nearest"}:
        pairs = cut_lineage(transfer.best_matches(source, target, "ordinal", "embedding"))
        cosines = transfer.weighted_scores(pairs, source, "ordinal", "observed_exposure").drop("fold")
        leaves = transfer.override_scores(transfer.assemble(target, "ordinal", cosines), source, overrides, "CNO4", "occ_code",
                                          "observed_exposure", ["cosine_weighted", "cosine_nearest"])
    if "rf" in methods:
        fitted = forest.fit(source, "embedding", "observed_exposure", trees=trees)
        leaves = forest.predict(fitted, leaves, "embedding")
    leaves = leaves.select("CNO4", "CNO2", "OCUP1", "occupation_title",
                           *[F.col(m).alias(joins.SCORE_PREFIX + m) for m in METHODS if m in methods])

    occupations = rollup.hierarchical_mean(leaves, weights)
    if labels is not None:
        occupations = joins.override_label(occupations, labels)
    industries = rollup.weighted_exposure(records, occupations, weight=weight, labels=industry_labels)
    metrics = training_metrics(source, methods, trees)
    if pairs is None:  # forests have no matched sources
        return Exposure(leaves, occupations, industries, records.sparkSession.createDataFrame([], MATCHES), metrics)
    chosen = transfer.override_pairs(transfer.match_pairs(pairs), source, target, overrides, "ordinal", "embedding", "CNO4",
                                     "occ_code").where(F.col("method").isin(*methods))
    matches = chosen.join(target.select(F.col("ordinal").alias("target"), "CNO4", "CNO2", "OCUP1", "occupation_title"),
                          "target").join(
        source.select(F.col("ordinal").alias("source"), "occ_code", F.col("title").alias("source_title"),
                      F.col("observed_exposure").alias("source_score")), "source").select(
        "method", "CNO4", "CNO2", "OCUP1", "occupation_title", "occ_code", "source_title", "source_score",
        F.col("similarity").alias("cosine_similarity"))
    return Exposure(leaves, occupations, industries, matches, metrics)


MATCHES = ("method string, CNO4 string, CNO2 string, OCUP1 string, occupation_title string, occ_code string, source_title string, "
           "source_score double, cosine_similarity double")


def training_metrics(source: DataFrame, methods: tuple[str, ...], trees: int, folds: int = 5) -> DataFrame:
    """Out-of-fold errors of the global mean and of the chosen methods: method, n, mae, rmse, r2.

    Folds are dealt by ordinal, so none is empty; there are min(folds, rows) of them, and no metrics below two rows.
    """
    rows = source.count()
    k = min(folds, rows)
    if k < 2:
        return source.sparkSession.createDataFrame([], "method string, n long, mae double, rmse double, r2 double")
    dealt = source.withColumn("fold", (F.col("ordinal") % k).cast("int"))
    out = transfer.cross_validate(dealt, "ordinal", "embedding", "observed_exposure", "fold").where(
        F.col("method").isin("global_mean", *methods))
    if "rf" in methods:
        out = out.unionByName(forest.cross_validate(dealt, "embedding", "observed_exposure", "fold", trees=trees))
    return out


def store_exposure(built: Exposure, root: str, embedding_model: str, translation_model: str, model_sha256: str) -> DataFrame:
    """Upsert occupations and industries, export leaves, matches and metrics, and write the run's record, which is returned."""
    spark = built.leaves.sparkSession
    stamped = lambda df: store.stamp(df, embedding_model, translation_model, model_sha256)
    tables = {"occupations": (built.occupations.withColumnRenamed("OCUP1", "ocup1"), store.OCCUPATION_SCHEMA, store.OCCUPATION_KEY),
              "industries": (built.industries, store.INDUSTRY_SCHEMA, store.INDUSTRY_KEY)}
    versions = {name: store.KeyedTable(spark, f"{root}/{name}", schema, keys).upsert(stamped(df)) for name, (df, schema, keys) in tables.items()}
    run = f"{root}/runs/{uuid.uuid4().hex}"
    paths = {name: files.export(df, f"{run}/{name}", "csv") for name, df in (
        ("leaves", built.leaves), ("matches", built.matches), ("metrics", built.metrics))}
    record = files.run_record(spark, embedding_model=embedding_model, translation_model=translation_model, model_sha256=model_sha256,
                              **{f"{name}_version": version for name, version in versions.items()}, **paths)
    files.export(record, f"{run}/record")
    return record
