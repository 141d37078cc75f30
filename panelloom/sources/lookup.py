"""Code/label lookups buried in ordered cell tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import clean_title, normalize_space
from ..operators.pick import keep_first
from ..operators.scan import CHUNK_LINES, running


@dataclass(frozen=True)
class BlockRule:
    """A block opens after a row holding ``all_of`` / ``any_of`` the markers and closes at a blank row."""

    code: str
    label: str
    pattern: str
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    required: bool = False


#: The two lookups of a metadata workbook.
OCCUPATIONS = BlockRule("OCUP1", "occupation_title", r"^\d{1,2}$", all_of=("TOCUP", "OCUP1"), required=True)
INDUSTRIES = BlockRule("cnae", "industry_name", r"^[A-Z0-9]{1,2}$", any_of=("ACT1", "CNAE"))


def marked_lookup(cells: DataFrame, rule: BlockRule, sheet: str = "sheet", row_no: str = "row_no", values: str = "cells",
                  chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """First label of every code found inside a marked block; rows are ordered by sheet, then row number."""
    row = F.transform(values, lambda c: normalize_space(F.coalesce(c, F.lit(""))))
    base = cells.select(F.col(sheet).alias("sheet"), F.col(row_no).cast("long").alias("row_no"), row.alias("_row"))
    base = base.withColumns({"_code": F.coalesce(F.get("_row", 0), F.lit("")),
                             "_label": F.coalesce(F.get("_row", 1), F.lit("")), "_line": F.array_join("_row", " ")})
    has = lambda m: F.contains("_line", F.lit(m))
    marker: Column = F.lit(True)
    for m in rule.all_of:
        marker = marker & has(m)
    if rule.any_of:
        either = F.lit(False)
        for m in rule.any_of:
            either = either | has(m)
        marker = marker & either
    blank = (F.col("_code") == "") & (F.col("_label") == "")
    at = F.col("row_no")
    seen = running(base, ["sheet"], "row_no", {"_open": ("max", F.when(marker, at)), "_shut": ("max", F.when(blank, at))},
                   inclusive=False, chunk_lines=chunk_lines)
    inside = seen.where(F.col("_open").isNotNull() & (F.col("_shut").isNull() | (F.col("_open") > F.col("_shut"))))
    rows = inside.where(F.col("_code").rlike(rule.pattern) & (F.col("_label") != ""))
    first = keep_first(rows.select(F.col("_code").alias(rule.code), F.col("_label").alias(rule.label), "sheet", "row_no"),
                       [rule.code], ["sheet", "row_no"])
    out = first.select(rule.code, clean_title(rule.label).alias(rule.label))
    if rule.required and out.isEmpty():
        raise ValueError(f"no {rule.code} block found")
    return out
