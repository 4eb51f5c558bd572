"""Physical plans: what is read, and which joins are chosen."""

from __future__ import annotations

import re

import pytest

from tarnwick.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: Queries that join a single row (a total, the global model, the largest shift) to a table.
ONE_ROW = {
    "card_search", "card_search_by_name", "meta_counts", "rescored", "small_sample_notes", "ridge_scores", "fit_metric", "leaderboard_under", "leaderboard_over", "movers", "movers_fallback",
    "most_underpriced", "prediction_log", "daily_build",
}
EAGER = {"stream_flows"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_product_of_tables(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert name in ONE_ROW or "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "Pandas" not in plan


def read_columns(df, table):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(rf"{table}\.parquet[^\n]*ReadSchema: struct<([^>]*)>", plan)]


def test_only_needed_columns_are_read(spark):
    for columns in read_columns(QUERIES["pull_costs"](spark, SF), "lineitem"):
        assert columns <= {"l_orderkey", "l_partkey", "l_extendedprice", "l_quantity"}
    for columns in read_columns(QUERIES["rarity_counts"](spark, SF), "part"):
        assert columns <= {"p_partkey", "p_brand", "p_size"}


def test_filters_reach_the_scan(spark):
    plan = QUERIES["market_dynamics_as_of"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*ts", plan) or re.search(r"DataFilters: \[[^\]]*ts", plan)


def test_dated_log_makes_the_panel_once(spark, monkeypatch):
    from tarnwick.sources.dated import DatedTable

    read = []
    stage = DatedTable.stage
    monkeypatch.setattr(DatedTable, "stage", lambda self, df: read.append(df._jdf.queryExecution().executedPlan().toString()) or stage(self, df))
    QUERIES["dated_log"](spark, SF)
    assert len(read) == 4 and not [p for p in read if "lineitem.parquet" in p]
