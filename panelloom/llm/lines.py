"""Line deduplication against levelled sorted runs of line hashes, with DataFrame operations only.

A run is a table of (h1, h2, n, last): a line key's 128-bit hash, in how many documents of its batches it was found, and the
largest document id among them.  Runs are bucketed and sorted by hash, so a batch is shuffled once and then merged with each
run as it lies.  A batch's keys are anti-joined with the runs, which drops what the runs settle already (the key is known to be
frequent and to have a larger last document), and the rest becomes a run of its own; when a level holds ``fanout`` runs they
are compacted into one of the next level.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage, new_scratch
from .batches import fresh_name

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OFTEN = 1_000  # a key in more documents than this, and than one in ``HEAVY`` line rows, is joined by broadcast
HEAVY = 20_000  # so there are at most this many of them


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else; texts of ASCII only take the faster built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(text: Column) -> Column:
    """The key of every line of a text; null is one empty line."""
    return F.transform(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))


def hashes(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


class LineRuns:
    """The levelled runs of one corpus.  Every run is a complete table in the shared folder; a run that was replaced stays valid
    for the plans that read it."""

    def __init__(self, spark: SparkSession, fanout: int = 4, least: int = 3):
        self.spark, self.fanout, self.least = spark, fanout, least
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []  # (table, folder) of every run

    def _write(self, rows: DataFrame, level: int) -> None:
        name, path = f"line_run_{uuid.uuid4().hex}", new_scratch(self.spark, f"lines-{level}")
        rows.select("h1", "h2", "n", "last").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        """One row for each key of several runs, read as one set of files: a union of bucketed tables says that it is dealt by
        key, but a columnar one (Spark 4.1) is not, and keys would stay apart."""
        rows = self.spark.read.schema(self.spark.table(runs[0][0]).schema).parquet(*[path for _, path in runs])
        return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def add(self, batch: DataFrame, least_chars: int = 20, doc_id: str = "doc_id", text: str = "text") -> None:
        """Merge-anti-join a batch of documents with the runs and add what is left as a run."""
        keys = F.filter(F.array_distinct(line_keys(F.col(text))), lambda k: F.length(k) >= least_chars)
        rows = batch.select(F.col(doc_id).alias("doc"), F.explode(keys).alias("key")).select("doc", *hashes("key"))
        new = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last"))
        for name, _ in [run for level in self.levels for run in level]:
            settled = self.spark.table(name).where(F.col("n") > max(self.least, OFTEN)).select("h1", "h2", F.col("last").alias("settled"))
            new = new.join(settled, (new["h1"] == settled["h1"]) & (new["h2"] == settled["h2"])
                           & (new["last"].isNull() | (new["last"] <= settled["settled"])), "left_anti")
        self._write(new, 0)

    def repeated(self) -> DataFrame:
        """(h1, h2, n, last) of the keys found in enough documents; ``n`` may miss documents of settled keys."""
        return self._merged([run for level in self.levels for run in level]).where(F.col("n") >= self.least)


def drop_repeated_lines(docs: DataFrame, batches: Iterable[DataFrame], least_docs: int = 3, least_chars: int = 20, fanout: int = 4,
                        doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with kept (the text without its dropped lines), n_lines and n_dropped.

    ``batches`` are the documents again, in parts that together hold each row once.  A line's key is the line without blanks at
    its ends and with A-Z in lower case.  Keys of at least ``least_chars`` code points in at least ``least_docs`` documents lose
    all their lines, except in the document with the largest id among theirs.  Every row counts as a document; rows that share
    the largest id all keep the line; a null id is smaller than any other, and keys that only such rows hold stay.  A null or
    empty text is one empty line.  Other columns are carried through; taken names get underscores.
    """
    runs = LineRuns(docs.sparkSession, fanout, least_docs)
    for batch in batches:
        runs.add(batch, least_chars, doc_id, text)
    names = list(docs.columns)
    new: list[str] = []
    for wanted in ("kept", "n_lines", "n_dropped", "_doc", "_text", "_places"):
        new.append(fresh_name([*names, *new], wanted))
    kept, n_lines, n_dropped, doc_key, text_key, places = new
    if not runs.levels:
        found = docs.withColumn(places, F.lit(None).cast("array<int>"))
    else:
        repeated = cut_lineage(runs.repeated())
        lines = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("text_hash"), F.posexplode(line_keys(F.col(text))).alias("place", "key")) \
            .where(F.length("key") >= least_chars).select("doc", "text_hash", "place", *hashes("key"))
        total = repeated.agg(F.sum("n")).first()[0] or 0
        often = max(OFTEN, total // HEAVY)
        heavy = repeated.where(F.col("n") > often).select("h1", "h2", F.col("last").alias("heavy_last"))
        light = repeated.where(F.col("n") <= often).select("h1", "h2", F.col("last").alias("light_last"))
        own = lines.join(F.broadcast(heavy), ["h1", "h2"], "left")  # at most HEAVY rows, since n sums to at most the line rows
        # a heavy line needs no partner: it goes on under a hash of its own place, so no task gets all of them
        hidden = F.col("heavy_last").isNotNull()
        spread = own.select("doc", "text_hash", "place", "heavy_last", F.when(hidden, F.xxhash64("doc", "text_hash", "place")).otherwise(F.col("h1")).alias("h1"),
                            F.when(hidden, F.lit(0).cast("long")).otherwise(F.col("h2")).alias("h2"))
        last = F.coalesce("heavy_last", "light_last")
        dropped = spread.join(light, ["h1", "h2"], "left").where(last.isNotNull() & (F.col("doc").isNull() | (F.col("doc") < last)))
        by_doc = dropped.groupBy(F.col("doc").alias(doc_key), F.col("text_hash").alias(text_key)).agg(F.collect_set("place").alias(places))
        found = docs.join(by_doc, docs[doc_id].eqNullSafe(by_doc[doc_key]) & (F.xxhash64(docs[text]) == by_doc[text_key]), "left")
    own_lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    rebuilt = F.transform(F.array(own_lines), lambda rows: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(rows) - 1), F.col(places)), lambda i: F.get(rows, i)), "\n"))[0]
    return found.select(*[F.col(f"`{c}`") for c in names],
                        F.when(F.col(places).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(rebuilt).alias(kept),
                        F.size(own_lines).cast("long").alias(n_lines), F.coalesce(F.size(places), F.lit(0)).cast("long").alias(n_dropped))


def file_batches(table: DataFrame, count: int = 4) -> list[DataFrame]:
    """A Parquet table as at most ``count`` batches of whole files, which together hold each row once.

    Anything else (a table in memory, or one that is not all rows of its files) is one batch.
    """
    files = sorted(table.inputFiles())
    read = table.sparkSession.read.schema(table.schema).parquet
    if not files or table.count() != read(*files).count():
        return [table]
    return [read(*files[i::count]) for i in range(count) if files[i::count]]
