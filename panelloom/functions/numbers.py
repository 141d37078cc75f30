"""Numeric coercion as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import _col


def to_number(c: Column | str, default: float | None = None) -> Column:
    """Lenient cast to double: unparsable text and NaN become NULL, or ``default`` when given."""
    value = _col(c).try_cast("double")
    value = F.when(~F.isnan(value), value)
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def parse_locale_number(c: Column | str) -> Column:
    """``1.234,5 %`` -> 1234.5; empty or unparsable residue -> NULL."""
    text = F.translate(_col(c).cast("string"), "%.", "")
    text = F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"[^\d.\-]", "")
    return text.try_cast("double")


def finite_or_null(c: Column | str) -> Column:
    value = _col(c).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def keep_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null out non-finite values in ``columns`` and drop the rows that lack one of them."""
    return df.withColumns({c: finite_or_null(c) for c in columns}).dropna(subset=columns)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL are one thing in this engine: aggregates skip NULL but not NaN."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floats}) if floats else df
