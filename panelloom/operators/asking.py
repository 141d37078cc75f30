"""Asking a provider for many keys so that no answer is lost: keys are claimed, asked for in small units and stored unit by unit.

A run claims ranges of keys in a log beside the cache, so two runs do not ask for the same key; a claim that is not
renewed ends by itself.  A unit is one Spark job of at most ``unit_rows`` keys.  A call that fails is returned as a row that says
so, beside the answers of all other calls, which are stored; the error is raised when the units are through, or as soon as a unit has had no
answer at all.  The next run asks for what is missing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import Scratch
from ..sources.versions import VersionLog

RANGES = 256


def key_range(key: str = "cache_key"):
    return F.pmod(F.xxhash64(key), F.lit(RANGES)).cast("int")


class Claims:
    """Which run holds which ranges of keys, and until when."""

    def __init__(self, spark: SparkSession, root: str, lease: float):
        self.log, self.me, self.lease = VersionLog(spark, f"{root.rstrip('/')}/_claims"), uuid.uuid4().hex, lease

    def take(self, ranges: list[int]) -> set[int]:
        """Claim what no other run holds of ``ranges``; returns what is held now."""
        mine: set[int] = set()

        def change(_: int, state: dict) -> dict | None:
            now, mine_now = time.time(), set()
            live = {r: c for r, c in state.items() if c["until"] > now}
            for r in map(str, ranges):
                if live.get(r, {"run": self.me})["run"] == self.me:
                    live[r] = {"run": self.me, "until": now + self.lease}
                    mine_now.add(int(r))
            mine.clear()
            mine.update(mine_now)
            return live if mine_now else None

        self.log.commit(change)
        return mine

    def release(self) -> None:
        def change(_: int, state: dict) -> dict | None:
            kept = {r: c for r, c in state.items() if c["run"] != self.me}
            return kept if len(kept) < len(state) else None

        self.log.commit(change)


def answer_all(missing: Callable[[], DataFrame], ask: Callable[[DataFrame], DataFrame], cache: str, spark: SparkSession,
               unit_rows: int = 100_000, calls: int | None = None, lease: float = 3600, wait: float = 5) -> None:
    """Until ``missing()`` (with the column cache_key) has no rows: ``ask`` for them and append its answers to ``cache``.

    ``ask`` adds a string column ``error``; rows in which it is not null are not stored.  ``calls`` bounds the tasks that ask at the same
    time.  Ranges that another run holds are waited for, and asked for only if that run has left them unanswered.
    """
    claims, errors = Claims(spark, cache, lease), []
    try:
        while True:
            todo = {r.key_range: r.n for r in missing().groupBy(key_range().alias("key_range")).agg(F.count(F.lit(1)).alias("n")).collect()}
            if not todo:
                break
            mine = claims.take(sorted(todo))
            if not mine:
                time.sleep(wait)
                continue
            # what others answered between the count and the claim is no longer missing
            errors += _answer(missing().where(key_range().isin(sorted(mine))), ask, cache, spark, claims, sorted(mine), unit_rows, calls)
            claims.release()
            if errors:
                raise RuntimeError(f"{len(errors)} provider calls failed; what was answered is stored. First: {errors[0]}")
    finally:
        claims.release()


def _answer(missing: DataFrame, ask: Callable[[DataFrame], DataFrame], cache: str, spark: SparkSession, claims: Claims, ranges: list[int],
            unit_rows: int, calls: int | None) -> list[str]:
    scratch, errors = Scratch(spark, "asking"), []
    try:
        listed = scratch.keep(missing, "missing")
        units = max(1, -(-listed.count() // unit_rows))
        placed = scratch.folder + "/units"
        listed.withColumn("unit", F.pmod(F.xxhash64(F.lit("unit"), "cache_key"), F.lit(units)).cast("int")).write.partitionBy("unit").parquet(placed)
        by_unit = spark.read.parquet(placed)
        for unit in range(units):
            wanted = by_unit.where(F.col("unit") == unit).drop("unit")
            wanted = wanted.repartition(min(calls or unit_rows, spark.sparkContext.defaultParallelism))
            asked = scratch.keep(ask(wanted), "answers")
            good = asked.where("error is null").drop("error")
            stored = not good.isEmpty()
            if stored:
                good.write.mode("append").parquet(cache)
            failed = [r.error for r in asked.where("error is not null").select("error").distinct().limit(10).collect()]
            errors += failed
            scratch.drop(asked)
            if failed and not stored:
                break
            claims.take(ranges)  # the claim lives on while units come through
        return errors
    finally:
        scratch.close()
