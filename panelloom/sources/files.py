"""Delimited files: scored tables, manifests, multi-period microdata, usage releases, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.codes import strip_code_suffix
from ..operators.reshape import two_group_pivot

SCORED_COLUMNS = ["occ_code", "title", "observed_exposure"]
MANIFEST_COLUMNS = ["quarter", "microdata_url"]
WEIGHT_COLUMNS = ["FACTOREL", "FACTOR", "PESO", "WEIGHT"]
USAGE_COLUMNS = ["date_start", "date_end", "geo_id", "geo_level", "category_name", "hierarchy_level", "metric_id",
                 "value", "node_name", "node_external_id"]
DELIMITERS = [",", ";", "\t", "|"]


def require_columns(df: DataFrame, needed: list[str], what: str) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")
    return df


def read_text_csv(spark: SparkSession, path: str | list[str], sep: str = ",", lines: bool = False) -> DataFrame:
    """All-string read with a header.  Quotes may span lines; such files are read by one task each.  With ``lines`` a row is a
    line, and large files are split."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False, escape='"', encoding="UTF-8", multiLine=not lines)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """Labelled score table: trimmed keys, numeric score, rows lacking any of the three dropped."""
    df = require_columns(read_text_csv(spark, path), SCORED_COLUMNS, "the score table")
    return df.withColumns({
        "occ_code": F.trim("occ_code"), "title": F.trim("title"),
        "observed_exposure": F.col("observed_exposure").try_cast("double"),
    }).dropna(subset=SCORED_COLUMNS)


def read_descriptions(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """Descriptions by occupation code, the detail suffix stripped and rows without a code dropped."""
    names = names or {"O*NET-SOC Code": "occ_code", "Title": "onet_title", "Description": "onet_description"}
    df = require_columns(read_text_csv(spark, path), list(names), "the description table")
    out = df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])
    return out.withColumn("occ_code", strip_code_suffix("occ_code")).dropna(subset=["occ_code"])


def read_manifest(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Quarters and where their files are; ``first`` keeps the earliest ones."""
    df = require_columns(read_text_csv(spark, path), MANIFEST_COLUMNS, "the manifest")
    df = df.withColumns({c: F.trim(c) for c in df.columns})
    return df.orderBy("quarter").limit(first) if first else df


def read_microdata(spark: SparkSession, manifest: DataFrame, location: str = "microdata_url",
                   required: tuple[str, ...] = ("OCUP1", "ACT1"), weights: list[str] = WEIGHT_COLUMNS) -> DataFrame:
    """Every listed period's records, stamped with the period.

    The manifest is one row per period; only each file's header line visits the driver, all in one job.  Files of one layout
    (delimiter and header) are read together, and each row takes its period from a join on the file it came from.  A record
    is a line: quoted line breaks are not supported in microdata.
    """
    layouts: dict[tuple[str, str], list[tuple[str, str]]] = {}
    listed = [(uri, row[0]) for row in manifest.select("quarter", location).collect() for uri in spark.read.text(row[1]).inputFiles()]
    first = spark.read.text([uri for uri, _ in listed]).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("i")).where("block = 0") if listed else None
    heads = {} if first is None else {_plain(r.file): r.head for r in first.groupBy("file").agg(F.min_by("value", "i").alias("head")).collect()}
    for uri, quarter in listed:
        if _plain(uri) not in heads:
            raise ValueError(f"{uri} is empty")
        header = heads[_plain(uri)].lstrip("\ufeff")
        sep = max(DELIMITERS, key=header.count)
        layouts.setdefault((sep, header), []).append((_plain(uri), quarter))

    frames = []
    for (sep, _), files in layouts.items():
        raw = read_text_csv(spark, [uri for uri, _ in files], sep, lines=True)
        names = [c.strip().lstrip("﻿").upper() for c in raw.columns]
        upper = raw.toDF(*names)
        require_columns(upper, list(required), f"microdata {files[0][0]}")
        keep = [*required, *[w for w in weights if w in names][:1]]
        where = spark.createDataFrame(files, "_file string, quarter string")
        stamped = raw.select(F.regexp_replace("_metadata.file_path", r"^file:/+", "file:/").alias("_file"), *[
            F.col(f"`{raw.columns[names.index(c)]}`").alias(c) for c in keep]).join(where, "_file")
        trimmed = stamped.withColumns({c: F.trim(c) for c in required})
        complete = [F.coalesce(F.col(c), F.lit("")) != "" for c in required]
        frames.append(trimmed.where(_all(complete)).select("quarter", *keep))
    if not frames:
        raise ValueError("the manifest lists no microdata")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _plain(uri: str) -> str:
    """Local paths come back as ``file:/`` or ``file:///``; make both the former."""
    return "file:/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    df = require_columns(read_text_csv(spark, path), USAGE_COLUMNS, "the usage release")
    return df.withColumns({"hierarchy_level": F.col("hierarchy_level").try_cast("int"),
                           "value": F.col("value").try_cast("double")})


def country_usage(usage: DataFrame, date_start: str | None = None) -> DataFrame:
    """Two countries' usage shares by major group, for the latest period unless one is given."""
    keep = ((F.col("geo_level") == "country") & F.col("geo_id").isin("ESP", "USA")
            & (F.col("category_name") == "soc_occupation") & (F.col("hierarchy_level") == 1)
            & (F.col("metric_id") == "pct"))
    chosen = usage.where(keep)
    slice_ = chosen.agg(F.max("date_start")).scalar() if date_start is None else F.lit(date_start)
    present = {r[0] for r in chosen.where(F.col("date_start") == slice_).select("geo_id").distinct().collect()}
    if present != {"ESP", "USA"}:
        raise ValueError(f"missing country values for {sorted({'ESP', 'USA'} - present)}")
    out = two_group_pivot(usage, ["node_external_id", "node_name", "date_start", "date_end"], "geo_id",
                          {"ESP": "spain_usage_pct", "USA": "us_usage_pct"}, "value", "date_start",
                          "spain_minus_us_pct", keep, date_start)
    return out.withColumnsRenamed({"node_external_id": "soc_major_group", "node_name": "job_group"}).orderBy(
        F.desc_nulls_last("spain_usage_pct"), "soc_major_group")


def export(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write a result; CSV gets a header."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)
    return path


def run_record(spark: SparkSession, **facts: str) -> DataFrame:
    """One row describing a run: settings and where its outputs went."""
    names = list(facts)
    return spark.createDataFrame([tuple(str(facts[n]) for n in names)], ", ".join(f"{n} string" for n in names))
