"""A corpus pipeline of the operators in ``panelloom.llm``.

Each stage is written as Parquet in the shared folder and read again by the next one, so a lost executor costs no more than the
stage that runs.  When a stage is written, its intermediate tables and the stage before it are deleted.  Stages take and return the columns of ``documents`` (the last one adds to them); rows are documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelloom.llm import bpe, decontaminate, langid, lines, neardup
from panelloom.session import new_scratch, remove_folder, scratch_scope


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops what no learned language is near to, and texts that are null or have no letter.

    Learned from the documents' own languages, from the two thirds of the ids that ``op6_langid`` learns from.
    """
    learned = docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    judged = langid.predict(docs, langid.fit(learned, F.col("doc_id")))
    return judged.where(~F.col(judged.columns[-1])).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops lines of 20 code points or more that three documents or more hold, but for the largest doc_id; no document goes."""
    kept = lines.drop_repeated_lines(docs, lines.file_batches(docs))
    text = kept.columns[len(docs.columns)]
    replaced = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return kept.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps the smallest doc_id of every group of near-duplicates (5-word shingles, Jaccard of 80 in a hundred)."""
    judged = neardup.near_duplicates(docs, neardup.Settings(words=5, percent=80))
    kept = judged.where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def decontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents of which 5 in a hundred words or more lie in 13-word passages of benchmark items."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Adds every document's token count and the digests of its ids and of the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode(docs, path, public_tokenizers.PATTERN), docs.columns)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated),
          ("tokens", tokens)]

#: Learned language models, link components and merge tables have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{folder}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_scratch(spark, f"pipeline-{name}")
        with scratch_scope():
            stage(spark, docs, folder).write.parquet(path)
        if before:
            remove_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, folder)
