"""Features of cards: character premium, scarcity, rank in the set, months since release.

Every function takes ``by``, extra grouping columns.  An empty list serves a single build; ``["eval_date"]`` serves a
walk-forward run over many dates with the same code, in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick import constants as C
from tarnwick.functions import scores, stats, text


def prior_lookup(characters: DataFrame, priors: DataFrame, name: str = "base_name") -> DataFrame:
    """``characters`` plus ``prior`` and ``prior_source``: the score of the first of a name's lookup keys that has one,
    overrides first, and whether it is ``user``, ``wiki`` or ``poll`` (the stronger where a key has both).

    ``priors`` has rows (key, poll, views, override), each score or null; it is a small input table.
    """
    stronger = F.when(F.col("poll").isNull() | (F.col("views") >= F.col("poll")), "wiki").otherwise("poll")
    scored = priors.select(F.col("key"), "override", scores.combined_prior(F.col("poll"), F.col("views")).alias("mixed"), stronger.alias("kind"))
    keys = characters.select(name).distinct().select(name, F.posexplode(text.variant_keys(F.col(name))).alias("pos", "key"))
    found = keys.join(scored, "key")
    first = lambda c, kind: F.min(F.when(F.col(c).isNotNull(), F.struct("pos", F.col(c).alias("score"), kind.alias("kind"))))
    best = F.coalesce(first("override", F.lit("user")), first("mixed", F.col("kind")))
    best = found.groupBy(name).agg(best.alias("b")).select(name, F.col("b.score").alias("prior"), F.col("b.kind").alias("prior_source"))
    return characters.join(best, name, "left")


def character_stats(cards: DataFrame, by: list[str]) -> DataFrame:
    """Printings, sets (a null set counts as one), chase sum, mean price and whether any printing is of the first region."""
    low, high = C.OLD_DEX
    return cards.where("base_name is not null and base_name <> ''").groupBy(*by, "base_name").agg(
        F.count(F.lit(1)).alias("n_printings"),
        (F.count_distinct("set_id") + F.max(F.col("set_id").isNull().cast("int"))).alias("n_sets"),
        F.round(F.sum(scores.chase_weight(F.col("rarity"))), 9).alias("chase"),
        F.avg("market_price").alias("mean_price"),
        F.coalesce(F.bool_or(F.col("dex").between(low, high)), F.lit(False)).alias("is_old"),
    )


def _share(value: str, by: list[str]) -> Column:
    return stats.share_at_or_below(value, by) if by else F.cume_dist().over(Window.orderBy(value))


def character_premium(cards: DataFrame, priors: DataFrame | None, by: list[str]) -> DataFrame:
    """Rows (by, base_name, char_premium, structural): the prior where there is one, else percentiles of breadth.

    Percentiles run over characters, already aggregated: a table of thousands of rows however many cards there are.  A
    logarithm keeps the order, so ranks need none.
    """
    made = character_stats(cards, by)
    parts = [_share(c, by) for c in ("n_printings", "n_sets", "chase")]
    blended = made.withColumn("__blend", F.round(sum((w * p for w, p in zip(C.PREMIUM_WEIGHTS, parts)), F.lit(0.0)), 12))
    scored = blended.withColumn("structural", 10.0 * _share("__blend", by))
    scored = prior_lookup(scored, priors) if priors is not None else scored.withColumn("prior", F.lit(None).cast("double"))
    base = F.coalesce("prior", F.col("structural") / 10.0 * C.PRIOR_FLOOR)
    lifted = F.when(F.col("is_old") & (base < C.OLD_CAP), F.least(F.lit(C.OLD_CAP), base + C.OLD_BONUS)).otherwise(base)
    return scored.select(*by, "base_name", F.round(lifted, 4).alias("char_premium"), F.round("structural", 6).alias("structural"), "n_printings", "n_sets", "chase")


def card_features(cards: DataFrame, priors: DataFrame | None, as_of, by: list[str]) -> DataFrame:
    """``cards`` plus ``char_premium, scarcity, set_rank, months_since_release``.

    An unknown or future release counts as 0 months.  ``as_of`` is a date column.
    """
    premium = character_premium(cards, priors, by).select(*by, "base_name", "char_premium")
    months = F.coalesce(scores.months_between(as_of, F.col("release_date")), F.lit(0.0))
    ranked = cards.withColumn("__ord", scores.rarity_rank(F.col("rarity")))
    ranked = stats.with_share_at_or_below(ranked, "__ord", [*by, "set_id"], "__share")
    ranked = ranked.withColumn("set_rank", F.round("__share", 4)).drop("__ord", "__share")
    ranked = ranked.withColumn("months_since_release", F.round(months, 6))
    ranked = ranked.withColumn("scarcity", scores.scarcity(F.col("rarity"), F.col("months_since_release")))
    return ranked.join(premium, [*by, "base_name"], "left")


def top_characters(cards: DataFrame, anchor: str, limit: int = 16) -> DataFrame:
    """Rows (base_name, best): the creatures of the highest best price, the anchor left out."""
    rows = cards.where((F.col("supertype") == "Pokémon") & F.col("base_name").isNotNull() & (F.col("base_name") != anchor))
    return rows.groupBy("base_name").agg(F.max(F.coalesce("market_price", F.lit(0.0))).alias("best")).orderBy(F.desc("best"), "base_name").limit(limit)
