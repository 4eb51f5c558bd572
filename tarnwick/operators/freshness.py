"""Freshness records, carry-forward on failure, and probes of the newest live snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_status(previous: DataFrame, now: Column, live: Column, not_live: Column) -> DataFrame:
    """The run record: ``prices_as_of`` moves to ``now`` only if something is live and nothing is not."""
    ok = (F.size(live) > 0) & (F.size(not_live) == 0)
    return previous.select(
        F.when(ok, now).otherwise(F.col("prices_as_of")).alias("prices_as_of"), now.alias("last_attempt_at"), ok.alias("last_attempt_ok"),
        F.array_sort(live).alias("sets_live"), F.array_sort(not_live).alias("sets_not_live"),
    )


def not_live(configured: Column, live: Column) -> Column:
    return F.array_sort(F.array_except(configured, live))


def carry_forward(live: DataFrame, cached: DataFrame, failed: DataFrame, key: str = "set_id") -> DataFrame:
    """Live rows and, for the keys that failed, the cached ones; the catalogue never shrinks on a failure."""
    return live.unionByName(cached.join(failed.select(key).distinct(), key, "left_semi").select(live.columns))


def live_dates(snapshots: DataFrame, today: Column, recent_days: int = 3) -> DataFrame:
    """One row: the newest date up to today with any positive active count, its age, whether it is recent, and in words."""
    days = snapshots.where(F.col("date") <= today).groupBy("date").agg(F.bool_or(F.coalesce(F.col("active") > 0, F.lit(False))).alias("live")).where("live")
    newest = days.agg(F.max("date").alias("newest"))
    age = F.datediff(today, F.col("newest"))
    state = F.when(age.isNull(), "none").when(age <= recent_days, "recent").otherwise("stale")
    return newest.select("newest", age.alias("age_days"), state.alias("state"), status_text(F.col("newest"), age, recent_days).alias("status"))


def status_text(newest: Column, age_days: Column, recent_days: int = 3) -> Column:
    """What the newest live snapshot says of the feed."""
    # Fixed wording.
    feed, day = "eBay Browse API active listings", newest.cast("string")
    return (
        F.when(newest.isNull(), F.lit("no live eBay snapshot yet (the collector writes neutral rows without API keys)"))
        .when(age_days <= recent_days, F.concat(F.lit(f"{feed} (latest snapshot "), day, F.lit(")")))
        .otherwise(F.concat(F.lit(f"{feed}, but the latest live snapshot is "), day, F.lit(" ("), age_days.cast("string"), F.lit(" days old)")))
    )


def due(items: DataFrame, seen: DataFrame, today: Column, days: int = 14, budget: int = 80, key: str = "id") -> DataFrame:
    """Items never fetched or fetched more than ``days`` ago, the longest waiting first, up to a call budget."""
    rows = items.join(seen.select(key, "fetched"), key, "left").where(F.col("fetched").isNull() | (F.col("fetched") < F.date_sub(today, days)))
    return rows.orderBy(F.col("fetched").asc_nulls_first(), key).limit(budget)


def merge_series(old: DataFrame, new: DataFrame, keys: list[str], value: str, order: str | None = None) -> DataFrame:
    """Union by key where the newer write wins; points without a key or a value are skipped.

    ``order`` says which of several writes of ``new`` for a key came last; without it keys are unique there.
    """
    when = F.lit(0).cast("long") if order is None else F.col(order).cast("long")
    sides = [df.select(*keys, value, F.struct(F.lit(k).alias("side"), (when if k else F.lit(0).cast("long")).alias("at")).alias("__w")) for k, df in enumerate((old, new))]
    both = sides[0].unionByName(sides[1]).dropna(subset=[*keys, value])
    return both.groupBy(*keys).agg(F.max_by(value, "__w").alias(value))


def most_graded(populations: DataFrame, limit: int = 15) -> DataFrame:
    """The cards of the largest graded population."""
    return populations.orderBy(F.desc("total"), "id").limit(limit)
