"""Leaderboards, reviews, search and portfolio views.  Every order ends with the key, so ties are settled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick import constants as C
from tarnwick.functions import scores, stats, text
from tarnwick.operators import features


def pool(scored: DataFrame) -> DataFrame:
    """Cards that may be surfaced: priced at or above the floor, scored, and with an edge."""
    edge = scores.edge_reason(F.col("market_price"), F.col("expected_price"), F.col("months_since_release")).isNull()
    return scored.where(F.col("residual").isNotNull() & (F.col("market_price") >= C.BOARD_FLOOR) & F.col("expected_price").isNotNull() & edge)


def leaderboard(pool_: DataFrame, under: bool, size: int = C.BOARD_SIZE, key: str = "card_id") -> DataFrame:
    """The largest dollar gaps of expected over market price, or of market over expected; ``raw_diff`` is in cents, the
    order is not."""
    gap = F.col("expected_price") - F.col("market_price")
    rows = pool_.withColumn("__gap", gap).orderBy(F.desc("__gap") if under else F.asc("__gap"), key).limit(size)
    return rows.withColumn("raw_diff", F.round("__gap", 2)).drop("__gap")


def movers(pool_: DataFrame, size: int = C.BOARD_SIZE, key: str = "card_id") -> DataFrame:
    """By shift of supply saturation among cards with a current reading; if no card has one, by absolute dollar gap."""
    live = F.col("status") == "ok"
    shift = F.when(live, F.abs(F.col("supply_saturation") - 1.0)).otherwise(F.lit(0.0))
    gap = F.col("expected_price") - F.col("market_price")
    rows = pool_.withColumns({"shift": F.coalesce(shift, F.lit(0.0)), "__gap": gap, "raw_diff": F.round(gap, 2)})
    any_shift = rows.agg(F.coalesce(F.max("shift"), F.lit(0.0)).alias("__most"))
    rows = rows.crossJoin(F.broadcast(any_shift)).where((F.col("__most") == 0) | live)  # one row
    rank = F.when(F.col("__most") > 0, F.col("shift")).otherwise(F.abs("__gap"))
    basis = F.when(F.col("__most") > 0, "saturation_shift").otherwise("price_signal_fallback")
    out = rows.withColumns({"mover_basis": basis, "awaiting_data": F.col("__most") == 0, "__rank": rank})
    return out.orderBy(F.col("__rank").desc(), key).limit(size).drop("__most", "__rank", "__gap")


def ranked_sets(sealed: DataFrame) -> DataFrame:
    return sealed.orderBy(F.col("box_signal").desc_nulls_last(), "set_id")


def most_underpriced(scored: DataFrame, n: int, key: str = "card_id") -> DataFrame:
    return scored.where("residual is not null").orderBy("residual", key).limit(n)


def premium_review(cards: DataFrame, premiums: DataFrame, priors: DataFrame, key: str = "card_id") -> DataFrame:
    """Characters with a card of some price: what their prices say of them, their premium, and the gap between the two.

    Percentiles are within the rarity over all kinds of cards; the filter to creatures comes after.  Forms of a character
    are one: its name is the last of the lookup keys.  The premium is that of its last card that has one, and goes into
    the gap as it is; only what is shown is rounded.  ``source`` says where the character's own prior comes from.
    """
    ranked = stats.with_share_at_or_below(cards.where("market_price is not null"), "market_price", ["rarity"], "__pct")
    mine = ranked.where((F.col("supertype") == "Pokémon") & (F.col("base_name") != "")).join(premiums.select("base_name", "char_premium"), "base_name", "left")
    top = F.max(F.struct("market_price", (-F.col(key)).alias("order"), "name", "rarity")).alias("top")
    premium = F.max_by("char_premium", F.when(F.col("char_premium").isNotNull(), F.col(key))).alias("premium")
    found = mine.groupBy(F.element_at(text.variant_keys(F.col("base_name")), -1).alias("character")).agg(F.max("__pct").alias("pct"), top, premium)
    found = found.where(F.col("premium").isNotNull() & (F.col("top.market_price") >= C.REVIEW_PRICE))
    signal = F.round(10.0 * F.col("pct"), 2)
    return features.prior_lookup(found, priors, "character").select(
        "character", F.round("premium", 2).alias("premium"), signal.alias("price_signal"), F.round(signal - F.col("premium"), 2).alias("gap"),
        F.coalesce("prior_source", F.lit("structural")).alias("source"), F.col("top.name").alias("top_card"), F.col("top.rarity").alias("top_rarity"), F.round("top.market_price", 2).alias("top_price"),
    )


def review_flags(review: DataFrame) -> DataFrame:
    """Up to 18 characters on either side whose gap reaches 1.5."""
    low = review.where(F.col("gap") >= C.REVIEW_GAP).withColumn("flag", F.lit("underrated")).orderBy(F.col("gap").desc(), "character").limit(C.REVIEW_SIZE)
    high = review.where(F.col("gap") <= -C.REVIEW_GAP).withColumn("flag", F.lit("overrated")).orderBy("gap", "character").limit(C.REVIEW_SIZE)
    return low.unionByName(high)


SEARCH_ORDERS = {
    "price_desc": lambda: [F.coalesce("market_price", F.lit(-1.0)).desc()],
    "price_asc": lambda: [F.coalesce("market_price", F.lit(-1.0)).asc()],
    "iq": lambda: [F.coalesce("iq_score", F.lit(0.0)).desc()],
    "under": lambda: [F.coalesce("residual", F.lit(0.0)).asc()],
    "over": lambda: [F.coalesce("residual", F.lit(0.0)).desc()],
    "name": lambda: [F.lower("name"), F.col("name")],
}


def search(cards: DataFrame, query: str = "", set_id: str | None = None, order: str = "price_desc", limit: int = 120, key: str = "card_id") -> DataFrame:
    """Cards whose name, set or number contains the query, in one of six orders, with the number of all hits.

    The count is one row from an aggregation of its own, so the hits themselves go through a bounded top-k and are
    never gathered in one task.
    """
    q = query.lower()
    hits = cards.where(F.col("set_id") == set_id) if set_id else cards
    if q:
        hits = hits.where(F.lower("name").contains(q) | F.lower("set_name").contains(q) | F.lower("number").contains(q))
    total = hits.agg(F.count(F.lit(1)).alias("n_hits"))
    top = hits.orderBy(*SEARCH_ORDERS[order](), key).limit(limit)
    return top.crossJoin(F.broadcast(total))  # one row


def portfolio_totals(watched: DataFrame, prices: DataFrame) -> DataFrame:
    """Present value of all watched cards, and its change since they were added.

    A card without a price counts as nothing.  The change is the whole value less the prices at adding that are known,
    so a card without such a price adds its whole value; there is no change if none is known, and no share if they are
    nothing together.
    """
    rows = watched.join(prices, "card_id", "left")
    value, then = F.coalesce(F.sum("price"), F.lit(0.0)), F.sum("price_at_add")
    return rows.agg(
        F.count(F.lit(1)).alias("n_cards"),
        F.count("price_at_add").alias("n_bases"),
        F.round(value, 2).alias("value"),
        F.round(value - then, 2).alias("since_added"),
        F.round(F.when(then > 0, 100.0 * (value - then) / then), 2).alias("since_added_pct"),
    )
