"""What the physical plans must and must not contain."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from panelloom.operators import rollup
from panelloom.plans.standins import micro, scores

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in sorted(entry.queries()) if n[0] in "ajpw" or n in ("j9", "m2", "m3", "m4", "m5")])
def test_no_pairwise_join(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text  # no row-at-a-time Python


def test_flagship_reads_only_what_it_needs(spark):
    text = plan(rollup.weighted_exposure(micro(spark, FOLDER), scores(spark, FOLDER), weight="FACTOREL"))
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in text
    assert "l_tax" not in text and "p_name" not in text


def test_filters_reach_the_scan(spark):
    text = plan(entry.queries()["a7"](spark, FOLDER))
    assert "PushedFilters: [In(l_returnflag, [A,R])" in text or "PushedFilters: [In(l_returnflag, [R,A])" in text


def test_survey_records_meet_scores_after_they_are_aggregated(spark):
    text = plan(rollup.weighted_exposure(micro(spark, FOLDER), scores(spark, FOLDER), weight="FACTOREL"))
    score_join = text.index("observed_exposure_rf")
    assert text.count("HashAggregate") >= 4 and score_join >= 0
