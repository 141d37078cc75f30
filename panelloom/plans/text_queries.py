"""Scalar functions over whole texts and columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, numbers, periods, text
from ..operators.panel import INTERVENTION
from .rollup_queries import rounded
from .standins import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


S = text.SPACE


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{S}+', ' ', 'g'))"


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


NOISY = "replace(text, ' the ', ' (códigos CNO-2011) . ')"
CLEANED = norm("regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + norm(NOISY) +
               f", '{text.CODE_PAREN}', '', 'g'), '{S}+\\.', '.', 'g'), '\\.{S}*', '. ', 'g'), '[.{S[1:]}+$', '')")


@query("p1", f"SELECT doc_id, {CLEANED} AS title FROM documents")
def p1(spark, d):
    noisy = F.replace("text", F.lit(" the "), F.lit(" (códigos CNO-2011) . "))
    return docs(spark, d).select("doc_id", text.clean_title(noisy).alias("title"))


@query("p2", f"SELECT doc_id, {norm('text')} AS text FROM documents")
def p2(spark, d):
    return docs(spark, d).select("doc_id", text.normalize_space("text").alias("text"))


@query("p3", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN NULL
 ELSE round(l_extendedprice, 2) END AS price FROM lineitem""")
def p3(spark, d):
    shown = F.concat(F.translate(F.format_number("l_extendedprice", 2), ",.", ".,"), F.lit(" %"))
    shown = F.when(F.col("l_returnflag") == "N", "-").otherwise(shown)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                              numbers.parse_locale_number(shown).alias("price"))


@query("p4", """SELECT p_partkey, CASE WHEN length(cast(p_partkey AS VARCHAR)) < 4 THEN
 lpad(cast(p_partkey AS VARCHAR), 4, '0') ELSE cast(p_partkey AS VARCHAR) END AS code FROM part""")
def p4(spark, d):
    raw = F.concat(F.col("p_partkey").cast("string"), F.lit(".00"))
    return table(spark, d, "part").select("p_partkey", codes.zero_pad(codes.strip_code_suffix(raw), 4).alias("code"))


CUST = ("CASE WHEN o_custkey < 1000 THEN lpad(cast(o_custkey AS VARCHAR), 4, '0') "
        "ELSE cast(o_custkey AS VARCHAR) END")


@query("p5", f"""SELECT o_orderkey, {CUST} AS "CNO4", left({CUST}, 2) AS "CNO2", left({CUST}, 1) AS "OCUP1" FROM orders""")
def p5(spark, d):
    o = table(spark, d, "orders")
    return codes.with_hierarchy(o.select("o_orderkey", codes.zero_pad("o_custkey", 4).alias("CNO4")))


@query("p6", """SELECT p_partkey, cast(p_size AS VARCHAR) AS "CNO2", p_name AS cno2_title FROM part WHERE p_size >= 10
 AND p_size <= 99""")
def p6(spark, d):
    raw = table(spark, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit("  "),
                                                               "p_name").alias("raw"))
    return codes.split_code_label(raw, "raw").drop("raw")


@query("p7", """SELECT p_partkey, CASE WHEN p_size > 25 THEN concat('O*NET occupation: ', p_name, '. Description: ',
 p_type, ' ', p_brand) ELSE p_name END AS embedding_text FROM part""")
def p7(spark, d):
    about = F.when(F.col("p_size") > 25, F.concat_ws("  ", "p_type", "p_brand")).when(F.col("p_size") > 10, " ")
    return table(spark, d, "part").select("p_partkey", text.described_title("p_name", about).alias("embedding_text"))


@query("p8", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS period, concat(year(o_orderdate), 'Q',
 quarter(o_orderdate)) AS quarter, (cast(year(o_orderdate) AS INT) - 2022) * 12 + cast(month(o_orderdate) AS INT) - 9
 AS event_time FROM orders""")
def p8(spark, d):
    month = periods.month_of("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", month.alias("period"), periods.quarter_label(periods.month_start(month)).alias("quarter"),
        periods.months_since(month, INTERVENTION).alias("event_time"))


@query("p9", """SELECT event_id, round(ln(value + 1), 6) AS log_value, value AS level_value FROM events""")
def p9(spark, d):
    return rounded(table(spark, d, "events").select("event_id", F.log1p("value").alias("log_value"),
                                                    F.col("value").alias("level_value")))


@query("p11", "SELECT o_orderkey FROM orders WHERE left(o_orderpriority, 1) IN ('4', '5')")
def p11(spark, d):
    status = F.substring("o_orderpriority", 1, 1)
    return table(spark, d, "orders").where(codes.in_status(status, ("04", "05"))).select("o_orderkey")


@query("p12", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS value,
 CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END AS weight FROM lineitem""")
def p12(spark, d):
    raw = F.when(F.col("l_returnflag") == "R", F.lit("n/a")).otherwise(F.col("l_quantity").cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                              numbers.to_number(raw).alias("value"),
                                              numbers.to_number(raw, 0.0).alias("weight"))


@query("p13", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%m') END AS month
 FROM orders""")
def p13(spark, d):
    names = F.array(*[F.lit(m.capitalize()) for m in periods.MONTHS])
    shown = F.when(F.col("o_orderstatus") == "P", "anual").otherwise(F.element_at(names, F.month("o_orderdate")))
    return table(spark, d, "orders").select("o_orderkey", periods.month_number(shown).alias("month"))


def limited(x: str, n: int) -> str:
    return (f"CASE WHEN length({x}) <= {n} THEN {x} ELSE concat(regexp_replace(regexp_replace(left({x}, {n}), "
            f"' [^ ]*$', ''), '[ ,;]+$', ''), '.') END")


@query("p14", f"SELECT doc_id, {limited(norm('text'), 1200)} AS text FROM documents")
def p14(spark, d):
    return docs(spark, d).select("doc_id", text.limit_text("text", 1200).alias("text"))


BROKEN = "replace(replace(text, 'en', 'e- n'), ' and', ' ma rco ,')"


@query("p15", "SELECT doc_id, " + norm("regexp_replace(regexp_replace(replace(replace(" + norm(BROKEN) +
       r", 'ma rco', 'marco'), 'provi ncial', 'provincial'), '([\p{L}\p{N}_])- ([\p{L}\p{N}_])', '\1\2', 'g'), '" + S +
       r"+([,.;:])', '\1', 'g')") + " AS text FROM documents")
def p15(spark, d):
    broken = F.replace(F.replace("text", F.lit("en"), F.lit("e- n")), F.lit(" and"), F.lit(" ma rco ,"))
    return docs(spark, d).select("doc_id", text.repair_text(broken).alias("text"))


@query("p16", f"SELECT doc_id, sha256(concat('model', chr(0), {norm('text')})) AS cache_key FROM documents")
def p16(spark, d):
    return docs(spark, d).select("doc_id", text.cache_key("model", text.normalize_space("text")).alias("cache_key"))
