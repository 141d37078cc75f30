"""Resumable append as a file stream: new files are picked up, finished keys are skipped, reruns add nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.store import AppendTable


def drain(spark: SparkSession, source: str, schema: StructType | str, target: AppendTable, checkpoint: str,
          transform: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "parquet",
          files_per_batch: int | None = None, **options: str) -> None:
    """Process everything in ``source`` that no earlier run has, then stop.

    The stream's own checkpoint remembers finished files, and the table's log the last batch of this checkpoint, so a batch that is
    replayed after a failure is not added again; keys that other files brought before are skipped.
    """
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.load(source)

    def write(batch: DataFrame, number: int) -> None:
        target.append(transform(batch) if transform else batch, checkpoint, number)

    query = (rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
