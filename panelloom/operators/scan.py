"""Running values over ordered lines that hold up when one document owns most of the lines.

A plain window would sort a whole document in one task.  Here each document is cut into chunks of consecutive line
numbers.  Every chunk is scanned once; what it adds up to is one row, and a second, tiny scan over those rows carries the
state forward.  With a boundary the values start again at every boundary row: the state of a chunk is then the pair (has it a boundary,
value since its last one), so nested keys need no shuffle of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

CHUNK_LINES = 1 << 16
#: kind -> (aggregate inside a chunk, aggregate over the totals of chunks)
KINDS = {"sum": (F.sum, F.sum), "max": (F.max, F.max), "min": (F.min, F.min),
         "last": (lambda c: F.last(c, ignorenulls=True), lambda c: F.last(c, ignorenulls=True))}


def spread(df: DataFrame, by: list[str], order: str, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """``df`` dealt by chunk over every core, for work on lines that costs more than their bytes tell: a small file is one split."""
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, *by, F.floor(F.col(order) / F.lit(chunk_lines)))


def chunked(df: DataFrame, order: str, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """``df`` with the column ``_chunk``, written once; scans over it, one on the other's result, share one shuffle."""
    return cut_lineage(df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk_lines))))


def running(df: DataFrame, by: list[str], order: str, values: dict[str, tuple[str, Column]],
            inclusive: bool = True, chunk_lines: int = CHUNK_LINES, boundary: Column | None = None) -> DataFrame:
    """Add running values along the integer column ``order`` (unique within ``by``).

    ``values`` maps an output name to ``(kind, column)``; kinds are ``sum``, ``max``, ``min`` and ``last`` (last non-null).
    ``inclusive=False`` leaves the current line out.  ``boundary`` marks rows at which all values start again.  A table from
    ``chunked`` keeps its column ``_chunk`` and is not written again.
    """
    if unknown := [kind for kind, _ in values.values() if kind not in KINDS]:
        raise ValueError(f"unknown running value {unknown[0]}")
    ready = "_chunk" in df.columns
    names = [c for c in df.columns if c not in values]
    inputs = {f"_in_{name}": column for name, (_, column) in values.items()} | ({"_edge": F.coalesce(boundary, F.lit(False)).cast("int")}
                                                                              if boundary is not None else {})
    source = df.withColumns(inputs)
    source = source if ready else chunked(source, order, chunk_lines)
    chunk = [*by, "_chunk"]
    along = W.partitionBy(*chunk).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    source = source.withColumn("_part", F.lit(0) if boundary is None else F.sum("_edge").over(along))
    part = chunk if boundary is None else [*chunk, "_part"]
    inside = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow if inclusive else -1)
    inner = source.select("*", *[KINDS[kind][0](F.col(f"_in_{name}")).over(inside).alias(f"_local_{name}") for name, (kind, _) in values.items()])

    last = lambda name: F.max_by(f"_in_{name}", F.when(F.col(f"_in_{name}").isNotNull(), F.col(order)))
    sums = source.groupBy(*chunk, "_part").agg(*[(last(name) if kind == "last" else KINDS[kind][0](F.col(f"_in_{name}"))).alias(f"_total_{name}")
                                                 for name, (kind, _) in values.items()])
    totals = sums.groupBy(*chunk).agg(F.max("_part").alias("_edges"), F.max_by(F.struct(*[f"_total_{name}" for name in values]), "_part").alias("_t")) \
        .select(*chunk, "_edges", "_t.*")
    ordered = W.partitionBy(*by).orderBy("_chunk")
    runs = totals.withColumn("_run", F.sum((F.col("_edges") > 0).cast("int")).over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow)))
    upto = W.partitionBy(*by, "_run").orderBy("_chunk").rowsBetween(W.unboundedPreceding, W.currentRow)
    states = runs.select(*chunk, *[KINDS[kind][1](F.col(f"_total_{name}")).over(upto).alias(f"_state_{name}") for name, (kind, _) in values.items()])
    carry = states.select(*chunk, *[F.lag(f"_state_{name}").over(ordered).alias(f"_carry_{name}") for name in values])

    joined = inner.join(carry, chunk, "left")
    out = []
    for name, (kind, _) in values.items():
        here, before = F.col(f"_local_{name}"), F.when(F.col("_part") == 0, F.col(f"_carry_{name}"))
        if kind == "sum":
            value = F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
        elif kind == "last":
            value = F.coalesce(here, before)
        else:
            value = (F.greatest if kind == "max" else F.least)(here, before)
        out.append(value.alias(name))
    return joined.select(*names, *out)
