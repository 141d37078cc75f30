"""Cutting Arrow batches into slices of bounded text size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.types import DataType, StructType


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in slices of about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def fresh_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column has that name (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def widened(schema: StructType, **columns: str) -> StructType:
    """A copy of the schema with more columns (name=type in DDL) at the end."""
    made = StructType(list(schema.fields))
    for name, kind in columns.items():
        made = made.add(name, DataType.fromDDL(kind))
    return made
