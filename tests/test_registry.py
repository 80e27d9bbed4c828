"""Registered queries against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, duck

FOLDER = "/root/testdata/sf0.001"
# One query per operator family here; tests/check.py runs all of them.
SAMPLE = [
    "form_diff", "arena_win_rate", "win_rate_diff", "trailing_3_months", "draft_rates", "draft_steps", "pool_flags", "head_to_head",
    "regional", "max_abs", "winshare", "ledger_best_worst", "ledger_summary", "region_report", "implied_odds", "text_numbers",
    "keep_first", "incremental_append", "stream_ingest", "player_totals", "agent_win_rate", "seeded_split", "label_report",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_duckdb(spark, name):
    assert compare(name, entry.queries()[name](spark, FOLDER), duck(FOLDER), entry.oracle_sql()[name]) is None
