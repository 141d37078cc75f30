import math

import pytest
from pyspark.sql import functions as F

from panelloom.functions import codes, inference, numbers, periods, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


def test_clean_title(spark):
    raw = "Ocupaciones militares (códigos CNO-2011). Fuerzas armadas (códigos CNO-1994)"
    assert one(spark, text.clean_title("t"), t=raw) == "Ocupaciones militares. Fuerzas armadas"
    assert one(spark, text.clean_title("t"), t=" Jefes  de obra (CÓDIGO 12) . . ") == "Jefes de obra"
    assert one(spark, text.clean_title("t"), t="a .b" + " ." * 5000) == "a. b"


def test_normalize_space_covers_unicode_spaces(spark):
    assert one(spark, text.normalize_space("t"), t=" a \x1f b　\n") == "a b"


def test_repair_text(spark):
    assert one(spark, text.repair_text("t"), t="ma rco provi ncial coor- dina , y fin .") == "marco provincial coordina, y fin."


@pytest.mark.parametrize("raw,limit", [("uno dos, tres", 9), ("uno dos", 7), ("unodostres", 5), ("uno dos; tres", 8)])
def test_limit_text(spark, raw, limit):
    want = raw if len(raw) <= limit else raw[:limit].rsplit(" ", 1)[0].rstrip(" ,;") + "."
    assert one(spark, text.limit_text("t", limit), t=raw) == want


def test_described_title(spark):
    assert one(spark, text.described_title("t", "d"), t="Jefe (CNO)", d=" x  y ") == "O*NET occupation: Jefe. Description: x y"
    assert one(spark, text.described_title("t", "d"), t="Jefe", d=" ") == "Jefe"


def test_cache_key(spark):
    import hashlib
    assert one(spark, text.cache_key("m", F.col("t")), t="x") == hashlib.sha256(b"m\0x").hexdigest()


@pytest.mark.parametrize("raw,want", [("2.718", 2718.0), ("-4,06%", -4.06), ("-", None), (".", None), ("abc", None),
                                      ("1-2", None), ("1.234,5 x", 1234.5)])
def test_parse_locale_number(spark, raw, want):
    assert one(spark, numbers.parse_locale_number("t"), t=raw) == want


def test_codes(spark):
    assert one(spark, codes.zero_pad("t", 4), t="11") == "0011"
    assert one(spark, codes.zero_pad("t", 4), t="12345") == "12345"
    assert one(spark, codes.strip_code_suffix("t"), t="11-1011.00") == "11-1011"
    assert one(spark, codes.in_status("t"), t="5") is True
    split = codes.split_code_label(spark.createDataFrame([("11 Jefes",), ("Total",)], ["c"]), "c").collect()
    assert [(r.CNO2, r.cno2_title) for r in split] == [("11", "Jefes")]


def test_periods(spark):
    assert one(spark, periods.month_number("t"), t="Septiembre") == "09"
    assert one(spark, periods.month_number("t"), t="Anual") is None
    assert one(spark, periods.months_since("t", "2022-09"), t="2023-02") == 5
    assert one(spark, periods.quarter_label(periods.month_start("t")), t="2025-04") == "2025Q2"
    assert one(spark, periods.month_start("t"), t="2025-13") is None


def test_nan_to_null_and_keep_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert numbers.nan_to_null(df).where("x IS NULL").count() == 2
    assert [r.x for r in numbers.keep_finite(df, ["x"]).collect()] == [1.0]


@pytest.mark.parametrize("t,dof,want", [(2.0, 10, 0.07338803477074037), (0.5, 3, 0.6514), (12.706204736, 1, 0.05),
                                        (1.959963985, 1e7, 0.05)])
def test_student_tail(t, dof, want):
    assert inference.student_two_sided(t, dof) == pytest.approx(want, rel=1e-4)


def test_normal_tail_and_stars(spark):
    assert inference.normal_two_sided(1.959963985) == pytest.approx(0.05, rel=1e-8)
    assert math.isnan(inference.student_two_sided(float("nan"), 3))
    rows = spark.createDataFrame([(0.005,), (0.01,), (0.07,), (0.5,)], "p double")
    assert [r.s for r in rows.select(inference.stars("p").alias("s")).collect()] == ["***", "**", "*", ""]
