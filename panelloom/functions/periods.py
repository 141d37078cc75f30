"""Months as ``YYYY-MM`` text, quarters as ``YYYYQn`` text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _col

#: Spanish month names.
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre",
          "noviembre", "diciembre"]


def month_number(name: Column | str) -> Column:
    """Month name -> ``"01"``..``"12"``, NULL when unknown."""
    pairs = [F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02d}")]
    return F.try_element_at(F.create_map(*pairs), F.lower(_col(name)))


def month_of(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def month_start(period: Column | str) -> Column:
    """First day of a ``YYYY-MM`` month, NULL when malformed."""
    return F.try_to_date(F.concat(_col(period).cast("string"), F.lit("-01")), "yyyy-MM-dd")


def quarter_label(day: Column | str) -> Column:
    day = _col(day)
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def months_since(period: Column | str, intervention: str) -> Column:
    """Calendar months from ``intervention`` (``YYYY-MM``) to the period."""
    year, month = (int(x) for x in intervention.split("-"))
    start = month_start(period)
    return (F.year(start) - year) * 12 + (F.month(start) - month)
