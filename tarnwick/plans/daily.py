"""The daily build over input tables, and the walk-forward report.  Only tables that several results need are written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick import constants as C
from tarnwick.functions import scores, stats
from tarnwick.lineage import cut
from tarnwick.operators import backtest, boards, dynamics, features, freshness, labels, ridge, sealed


@dataclass(frozen=True)
class Inputs:
    """``cards`` (operators' card table), ``sets``, ``snapshots`` and ``panel``; rate overrides, priors and graded
    populations (id, total, g10, rate) may be absent."""

    cards: DataFrame
    sets: DataFrame
    snapshots: DataFrame
    panel: DataFrame
    overrides: DataFrame | None = None
    priors: DataFrame | None = None
    populations: DataFrame | None = None


def build(inputs: Inputs, today: Column) -> dict[str, DataFrame]:
    """Named results: ``scored`` (a row per card), ``sets``, ``models``, ``under``, ``over``, ``movers``, ``log``, ``meta``.

    ``scored`` feeds five results; persist it before writing them all.
    """
    cards = sealed.with_pull_cost(sealed.with_pull_rates(inputs.cards, inputs.overrides), inputs.sets)
    made = features.card_features(cards, inputs.priors, today, [])
    made = cut(made.withColumn("cluster", ridge.cluster_key(F.col("supertype"), F.col("rarity"))))  # read by both fits and the scores
    own, whole = ridge.fit_clusters(made, [])
    scored = ridge.score(made, (own, whole), [])
    flow = dynamics.compute(dynamics.with_flows(inputs.snapshots, today), current=today)
    moves = labels.price_moves(inputs.panel, as_of=today)
    scored = scored.join(flow.withColumnRenamed("days", "days_observed"), "card_id", "left").join(moves, "card_id", "left")
    if inputs.populations is not None:
        graded = inputs.populations.select(F.col("id").alias("card_id"), F.struct("total", "g10", "rate").alias("population"))
        scored = scored.join(graded, "card_id", "left")
    scored = labels.signals(scored.withColumn("status", F.coalesce("status", F.lit("awaiting_data"))))
    scored = scored.withColumns(
        {
            "expected_price": F.round("expected_price", 4),
            "residual": F.round("residual", 6),
            "iq_score": scores.iq_score(F.col("scarcity"), F.col("char_premium"), F.col("set_rank")),
            "edge_reason": scores.edge_reason(F.col("market_price"), F.col("expected_price"), F.col("months_since_release")),
        }
    ).withColumn("edge", F.col("edge_reason").isNull())
    pool = boards.pool(scored)
    log = scored.where("residual is not null").select("card_id", F.round("market_price", 4).alias("m"), F.col("expected_price").alias("e"), F.col("residual").alias("r"), scores.verdict(F.col("residual")).alias("v"), today.alias("built_for"))
    status = freshness.live_dates(inputs.snapshots, today).select(F.col("newest").alias("latest_snapshot"), F.col("status").alias("listing_source"))
    meta = meta_counts(scored, own).crossJoin(F.broadcast(status))  # one row
    return {
        "scored": scored,
        "sets": boards.ranked_sets(sealed.sealed_value(inputs.sets, cards)),
        "models": ridge.export(own, whole),
        "under": boards.leaderboard(pool, True),
        "over": boards.leaderboard(pool, False),
        "movers": boards.movers(pool),
        "log": log,
        "meta": meta,
    }


def meta_counts(scored: DataFrame, own: DataFrame) -> DataFrame:
    """One row: cards, priced ones, sets, models of clusters (their number and names), logged predictions, fit."""
    counts = scored.agg(
        F.count(F.lit(1)).alias("n_cards"), F.count("market_price").alias("n_priced"), F.count_distinct("set_id").alias("n_sets"), F.count("residual").alias("n_logged"),
        F.round(stats.squared_log_correlation("market_price", "expected_price"), 6).alias("r2_log"),
    )
    named = own.where(F.col("n") >= C.MIN_CLUSTER).agg(F.count(F.lit(1)).alias("n_clusters"), F.array_sort(F.collect_list("cluster")).alias("clusters"))
    return counts.crossJoin(F.broadcast(named))  # one row


def report(panel: DataFrame, cards: DataFrame, priors: DataFrame | None = None) -> dict[str, DataFrame]:
    """The walk-forward report.  Residuals and observations are written to the shared folder once, for all results."""
    resid = cut(backtest.residuals(panel, cards, priors))
    wide = cut(backtest.observations(resid, panel, C.HORIZONS))
    obs = wide.where("horizon = 28")
    ics = backtest.segment_ics(backtest.by_segment(obs), ["segment"])
    return {
        "segments": stats.ic_summary(ics, ["segment"], lag=backtest.hac_lag(F.lit(28))),
        "horizons": stats.ic_summary(backtest.segment_ics(wide, ["horizon"]), ["horizon"], lag=backtest.hac_lag(F.col("horizon"))),
        "rarities": backtest.pooled_buckets(obs, F.col("rarity_group")),
        "tiers": backtest.pooled_buckets(obs, scores.price_tier(F.col("price"))),
        "deciles": backtest.decile_legs(wide, ["horizon"]),
        "hits": backtest.hit_rates(obs),
        "floors": stats.ic_summary(backtest.floor_sensitivity(obs), ["floor"], lag=backtest.hac_lag(F.lit(28))),
        "ages": backtest.by_age(obs),
        "series": ics,
    }
