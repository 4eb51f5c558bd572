"""Scans of dated files: which files are opened."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tarnwick.sources import files

D = dt.date


@pytest.fixture
def folder(tmp_path):
    for k in range(40):
        day = D(2026, 1, 1) + dt.timedelta(days=k)
        (tmp_path / f"price-{day}.json").write_text(json.dumps({"c1": 1.0 + k, "c2": None}))
        (tmp_path / f"snapshot-{day}.json").write_text(json.dumps({"c1": str(2.0 + k), "c2": "x"}))
        (tmp_path / f"ebay-{day}.json").write_text(json.dumps({"c1": {"active_listings": k, "avg_price": 2.5, "item_ids": ["a"]}, "c2": None}))
    (tmp_path / "price-latest.json").write_text('{"c1": 9.0}')
    (tmp_path / "price-2026-01-02.json.tmp").write_text('{"c1": 9.0}')
    (tmp_path / "ebay-2026-01-03.json").write_text("{broken")
    return str(tmp_path)


def opened(df):
    """The files that the scan of ``df`` read, when it has run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()


def test_as_of_leaves_later_files_unopened(spark, folder):
    until, since = F.lit(D(2026, 1, 10)), F.lit(D(2026, 1, 8))
    panel = files.price_panel(spark, folder, since, until)
    assert opened(panel) == 3 and [(r.date.day, r.price) for r in panel.orderBy("date").collect()] == [(8, 8.0), (9, 9.0), (10, 10.0)]
    history = files.price_history(spark, folder, until)
    assert opened(history) == 10 and history.count() == 10
    listings = files.listing_history(spark, folder, until)
    assert opened(listings) == 10 and {r.date.day for r in listings.collect()} == set(range(1, 11)) - {3}


def test_without_limits_only_files_of_the_kind_are_opened(spark, folder):
    panel = files.price_panel(spark, folder)
    assert opened(panel) == 40 and panel.count() == 40  # nor those of its kind without a date
    assert files.price_history(spark, folder, F.lit(D(2025, 1, 1))).count() == 0
