"""Feature lists evaluated together, against the single run and against plain arithmetic."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.functions import stats
from tarnwick.operators import backtest, evaluation
from tarnwick.plans.testmap import view

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("k", [1, 3, 12, 40])
def test_solution_is_that_of_ridge_regression(k):
    rng = np.random.default_rng(k)
    x = rng.standard_normal((200, k)) @ rng.standard_normal((k, k)) + rng.standard_normal(k)
    x[:, -1] = 3.0 if k > 1 else x[:, -1]  # one that does not vary
    y = rng.standard_normal(200)
    both = np.c_[x, y]
    own = list(range(0, k, 2)) + ([k - 1] if k > 1 and (k - 1) % 2 else [])
    base, w = evaluation.solve(200, both.mean(0), np.cov(both.T, bias=True).reshape(k + 1, k + 1), own, 2.5)
    spread = x.std(0)
    z = np.where(spread > 1e-12, (x - x.mean(0)) / np.where(spread > 1e-12, spread, 1), 0)[:, own]
    coef = np.linalg.solve(z.T @ z + 2.5 * np.eye(len(own)), z.T @ (y - y.mean()))
    assert np.allclose(base + x @ w, y.mean() + z @ coef)
    assert all(w[i] == 0 for i in range(k) if i not in own)


def test_each_list_is_as_if_it_ran_alone(spark):
    panel, cards = view(spark, SF, "panel"), view(spark, SF, "panel_cards")
    lists = {"three": (["char_premium", "scarcity", "months_since_release"], 1.0), "two": (["scarcity", "set_rank"], 5.0), "one": (["set_rank"], 0.5)}
    got = {r.list: r for r in evaluation.evaluate(panel, cards, lists).collect()}
    for name, (own, alpha) in lists.items():
        resid = backtest.residuals(panel, cards, None, own, alpha).withColumn("residual", F.round("residual", 9))
        obs = backtest.observations(resid, panel)
        want = {r.segment: r for r in stats.ic_summary(backtest.segment_ics(backtest.by_segment(obs), ["segment"]), ["segment"], lag=5).collect()}
        for segment, ic, t in (("all", "all_ic", None), ("fresh", "fresh_ic", "fresh_t"), ("mature", "mature_ic", "mature_t")):
            alone = want.get(segment)
            assert got[name][ic] == pytest.approx(alone.mean_ic if alone else None, abs=1e-6)
            assert t is None or got[name][t] == pytest.approx(alone.t_hac if alone else None, abs=1e-4)
        spread = backtest.decile_legs(obs.withColumn("k", F.lit(1)), ["k"]).first()
        assert got[name].decile_spread == pytest.approx(spread.spread if spread else None, abs=1e-6)
        last = resid.where(F.col("eval_date") == resid.agg(F.max("eval_date")).first()[0])
        assert got[name].r2_log == pytest.approx(last.agg(stats.squared_log_correlation("price", "expected_price")).first()[0], abs=1e-6)


def test_lists_without_enough_dates_are_null(spark):
    panel, cards = view(spark, SF, "panel"), view(spark, SF, "panel_cards")
    first = panel.agg(F.min("date")).first()[0]
    got = evaluation.evaluate(panel.where(F.col("date") <= F.date_add(F.lit(first), 14)), cards, {"a": (["scarcity"], 1.0)}).collect()
    assert len(got) == 1 and got[0].all_ic is None and got[0].decile_spread is None
