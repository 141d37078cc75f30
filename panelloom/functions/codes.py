"""Classification codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import _col


def zero_pad(c: Column | str, width: int) -> Column:
    """Left-pad with zeros; codes already longer than ``width`` stay whole."""
    text = _col(c).cast("string")
    return F.when(F.char_length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def strip_code_suffix(c: Column | str) -> Column:
    return F.regexp_replace(_col(c).cast("string"), r"\.00$", "")


def prefix(c: Column | str, length: int) -> Column:
    return F.substring(_col(c).cast("string"), 1, length)


def with_hierarchy(df: DataFrame, code: str = "CNO4", levels: dict[str, int] | None = None) -> DataFrame:
    """Add the coarser levels of a code as its prefixes."""
    levels = levels or {"CNO2": 2, "OCUP1": 1}
    return df.withColumns({name: prefix(code, length) for name, length in levels.items()})


def split_code_label(df: DataFrame, c: str, code: str = "CNO2", label: str = "cno2_title",
                     pattern: str = r"^(\d{2})\s+(.+)$") -> DataFrame:
    """``"11 Managers"`` -> code and label; rows that do not look like that are dropped."""
    return df.where(F.col(c).rlike(pattern)).withColumns(
        {code: F.regexp_extract(c, pattern, 1), label: F.regexp_extract(c, pattern, 2)}
    )


def in_status(c: Column | str, statuses: tuple[str, ...] = ("05", "06")) -> Column:
    return zero_pad(c, 2).isin(*statuses)
