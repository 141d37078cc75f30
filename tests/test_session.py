"""Scratch tables of one job."""

import os

from panelloom.session import SHUFFLE_CLEANUP, Scratch, scratch_scope


def test_scratch_tables_go_when_they_are_dropped(spark):
    scratch = Scratch(spark, "test")
    first, second = (scratch.keep(spark.range(10).selectExpr(f"id * {i} AS x").distinct(), "t") for i in (1, 2))
    assert first.count() == second.count() == 10
    folder = scratch.folder.removeprefix("file:")
    scratch.drop(first)
    assert len(os.listdir(folder)) == 1
    scratch.close()
    assert not os.path.exists(folder)
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"


def test_a_scope_closes_what_was_made_inside(spark):
    outside = Scratch(spark, "outside")
    outside.keep(spark.range(1))
    with scratch_scope():
        inside = Scratch(spark, "inside")
        inside.keep(spark.range(1))
    assert os.path.exists(outside.folder.removeprefix("file:")) and not os.path.exists(inside.folder.removeprefix("file:"))
    outside.close()
