"""Pull rates and expected value of sealed products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick import constants as C
from tarnwick.functions import scores


def base_rates(spark) -> DataFrame:
    return spark.createDataFrame(list(C.TIER_RATES.items()), "rarity string, base_rate double")


def rarity_counts(cards: DataFrame) -> DataFrame:
    """Rows (set_id, rarity, n)."""
    return cards.groupBy("set_id", "rarity").agg(F.count(F.lit(1)).alias("n"))


def staleness(dates: DataFrame, today: Column, most: int = 14) -> DataFrame:
    """One row (oldest, newest, label, stale): the range of the pasted days; the oldest decides whether it is stale."""
    out = dates.agg(F.min("as_of").alias("oldest"), F.max("as_of").alias("newest"))
    label = F.when(F.col("oldest") == F.col("newest"), F.col("oldest").cast("string")).otherwise(F.concat(F.col("oldest").cast("string"), F.lit(" to "), F.col("newest").cast("string")))
    return out.select("oldest", "newest", label.alias("label"), F.coalesce(F.datediff(today, "oldest") > most, F.lit(False)).alias("stale"))


def with_pull_rates(cards: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``cards`` plus ``tier_rate, n_in_tier, pull_rate``: the set's own rate, else the tier's, else the default.

    Rates are constants of a few rows; counts per (set, tier) come back by a join on that pair.
    """
    counts = rarity_counts(cards).withColumnRenamed("n", "n_in_tier")
    out = cards.join(F.broadcast(base_rates(cards.sparkSession)), "rarity", "left")  # fixed table
    if overrides is None:
        out = out.withColumn("override_rate", F.lit(None).cast("double"))
    else:
        out = out.join(overrides.select("set_id", "rarity", F.col("rate").alias("override_rate")), ["set_id", "rarity"], "left")
    out = out.join(counts, ["set_id", "rarity"], "left")
    out = out.withColumn("tier_rate", F.coalesce("override_rate", "base_rate", F.lit(C.DEFAULT_RATE)))
    out = out.withColumn("pull_rate", scores.pull_rate(F.col("tier_rate"), F.coalesce("n_in_tier", F.lit(0))))
    return out.drop("base_rate", "override_rate")


def with_pull_cost(cards: DataFrame, sets: DataFrame, price: str = "pack_price") -> DataFrame:
    """``cards`` with pull rates plus ``pull_cost``; a card without a set record costs 0."""
    priced = cards.join(sets.select("set_id", F.col(price).alias("__pack")), "set_id", "left")
    return priced.withColumn("pull_cost", scores.pull_cost(F.coalesce("__pack", F.lit(0.0)), F.col("pull_rate"))).drop("__pack")


def sealed_value(sets: DataFrame, cards: DataFrame) -> DataFrame:
    """``sets`` plus ``ev_per_pack, ev_per_box, pack_signal, box_signal, average_loss``; a set without cards has EV 0.

    ``cards`` come with pull rates; unpriced ones add nothing.
    """
    value = cards.where("market_price is not null").groupBy("set_id").agg(F.sum(F.col("pull_rate") * F.col("market_price")).alias("__ev"))
    out = sets.join(value, "set_id", "left").withColumn("ev_per_pack", F.coalesce("__ev", F.lit(0.0))).drop("__ev")
    out = out.withColumn("ev_per_box", F.col("ev_per_pack") * F.coalesce("packs_per_box", F.lit(9)))
    return out.withColumns(
        {
            "pack_signal": scores.signal(F.col("ev_per_pack"), F.col("pack_price")),
            "box_signal": scores.signal(F.col("ev_per_box"), F.col("box_price")),
            "average_loss": F.when(F.coalesce(F.col("pack_price"), F.lit(0.0)) != 0, F.col("pack_price") - F.col("ev_per_pack")),
        }
    )


def overlay(sets: DataFrame, feed: DataFrame) -> DataFrame:
    """Market prices over the configured ones where the feed has one for a set's pack or box; a price of 0 is none."""
    some = lambda c: F.nullif(F.col(c), F.lit(0.0))
    f = feed.select("set_id", some("pack_price").alias("__pack"), some("box_price").alias("__box"))
    out = sets.join(f, "set_id", "left")
    return out.withColumns({"pack_price": F.coalesce("__pack", "pack_price"), "box_price": F.coalesce("__box", "box_price")}).drop("__pack", "__box")


def sealed_feed(feed: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (set_id, as_of, pack, box) from ``as_of, sets map<name, array<product>>``: first match of each kind by name.

    The pack is the first product named ``Booster Pack``; the box the first that begins with ``Elite Trainer Box`` and
    does not name the store's own edition.  Sets that are not configured are ignored.
    """
    rows = feed.select("as_of", F.explode("sets").alias("name", "products")).join(sets.select("set_id", "name"), "name")
    pack = F.try_element_at(F.filter("products", lambda p: p["product"] == "Booster Pack"), F.lit(1))
    box = F.try_element_at(F.filter("products", lambda p: p["product"].startswith("Elite Trainer Box") & ~p["product"].contains("Pokemon Center")), F.lit(1))
    keep = lambda p: F.when(p.isNotNull(), F.struct(*[p[c].alias(c) for c in ("price", "change_24h", "sold_today", "listings")]))
    return rows.select("set_id", "as_of", keep(pack).alias("pack"), keep(box).alias("box"))
