"""Element-wise sums of the statistic vectors that tasks send back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

BLOCK = 4096


def summed_blocks(partials: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Keys, block, v: the sum of every block of the vectors.  ``partials`` has one ``v`` per task and key; a grouped task
    holds one block per task, never whole vectors."""
    starts = F.sequence(F.lit(0), F.floor((F.size("v") - 1) / block).cast("int"))
    blocks = partials.select(*keys, "v", F.explode(starts).alias("block")).select(
        *keys, "block", F.slice("v", F.col("block") * block + 1, block).alias("v"))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[:1][[*keys, "block"]].reset_index(drop=True)
        head["v"] = [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]
        return head

    types = ", ".join(f"{k} {partials.schema[k].dataType.simpleString()}" for k in keys)
    return blocks.groupBy(*keys, "block").applyInPandas(add, f"{types}, block int, v array<double>")


def whole_vector(blocks: pd.DataFrame) -> np.ndarray:
    """The vector of one key from its summed blocks."""
    return np.concatenate(blocks.sort_values("block")["v"].to_list())


def vector_sums(partials: DataFrame, keys: list[str], block: int = BLOCK) -> dict[tuple, np.ndarray]:
    """Key -> summed vector; the driver receives one vector per key."""
    pieces: dict[tuple, list] = {}
    for r in summed_blocks(partials, keys, block).collect():
        pieces.setdefault(tuple(r[k] for k in keys), []).append((r.block, r.v))
    return {k: np.concatenate([v for _, v in sorted(p)]) for k, p in pieces.items()}
