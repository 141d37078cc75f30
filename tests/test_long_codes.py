"""Queries that show four characters of a code, on tables whose units have five digits and share what is shown."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Two copies of the smallest tables: units 1000... and 10000..., which all look like 1000."""
    root = tmp_path_factory.mktemp("codes")
    for name, key in (("supplier", "s_suppkey"), ("lineitem", "l_suppkey"), ("part", "p_partkey")):
        duckdb.execute(f"""COPY (SELECT t.* REPLACE (t.{key} + i AS {key}) FROM '{FOLDER}/{name}.parquet' t,
          (SELECT unnest([1000, 10000]) AS i)) TO '{root}/{name}.parquet' (FORMAT parquet)""")
    return str(root)


@pytest.mark.parametrize("name", ["j12", "s12", "s15", "s4", "s5_wide", "report_dataset"])
def test_long_codes(spark, tables, name):
    con = duckdb.connect()
    for t in ("supplier", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    ok, text = compare(spark, con, tables, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text
