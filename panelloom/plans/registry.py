"""All registered queries."""

from __future__ import annotations

from . import panel_queries, rollup_queries, source_queries, text_queries, transfer_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _family in (rollup_queries, text_queries, source_queries, transfer_queries, panel_queries):
    QUERIES.update(_family.QUERIES)
    ORACLES.update(_family.ORACLES)
