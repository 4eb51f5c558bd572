"""Walk-forward backtest: the model refitted as of each date, its residuals held against later returns.

Dates are a grouping key and not a loop: features, fits and scores of all dates are one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick import constants as C
from tarnwick.functions import scores, stats
from tarnwick.lineage import cut
from tarnwick.operators import asof, features, ridge


def residuals(panel: DataFrame, cards: DataFrame, priors: DataFrame | None = None, feature_list: list[str] = C.FEATURES, alpha: float = C.RIDGE_ALPHA) -> DataFrame:
    """Rows (eval_date, card_id, price, residual, expected, age_days, rarity): as of each date, over its priced cards.

    Features are made anew for each date over the cards priced then; dates of fewer than 12 cards make nothing.
    """
    at = panel.where("price > 0").select(F.col("date").alias("eval_date"), "card_id", F.col("price").alias("market_price")).join(cards.drop("market_price"), "card_id")
    enough = at.groupBy("eval_date").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= C.MIN_CLUSTER).select("eval_date")
    at = at.join(enough, "eval_date")
    made = features.card_features(at, priors, F.col("eval_date"), ["eval_date"])
    made = cut(made.withColumn("cluster", ridge.cluster_key(F.col("supertype"), F.col("rarity"))))  # read by both fits and the scores
    models = ridge.fit_clusters(made, ["eval_date"], feature_list, alpha)
    scored = ridge.score(made, models, ["eval_date"], feature_list)
    return scored.select("eval_date", "card_id", F.col("market_price").alias("price"), "residual", "expected_price", F.datediff("eval_date", "release_date").alias("age_days"), "rarity")


def observations(resid: DataFrame, panel: DataFrame, horizons: tuple[int, ...] = (28,), floor: float = C.BOARD_FLOOR) -> DataFrame:
    """Rows (horizon, date, card_id, mispricing, fwd, price, age_days, rarity_group): residual against forward return."""
    pairs = asof.nearest_forward(panel.select("date").distinct(), horizons)
    later = panel.select(F.col("date").alias("next_date"), "card_id", F.col("price").alias("__next"))
    rows = resid.where(F.col("price") >= floor).join(pairs, F.col("eval_date") == F.col("date"))
    rows = rows.join(later, ["next_date", "card_id"]).where("residual is not null and __next is not null")
    return rows.select(
        "horizon", "date", "card_id", (-F.col("residual")).alias("mispricing"), ((F.col("__next") - F.col("price")) / F.col("price")).alias("fwd"),
        "price", "age_days", scores.rarity_group(F.col("rarity")).alias("rarity_group"),
    )


def segments() -> dict[str, Column]:
    age, price = F.col("age_days"), F.col("price")
    no = F.lit(False)
    return {
        "all": F.lit(True),
        "mature": F.coalesce((price >= C.MATURE_PRICE) & (age > C.MATURE_DAYS), no),
        "fresh": F.coalesce(age.between(0, C.FRESH_DAYS), no),
        "surfaced": scores.surfaced(age, price),
    }


def by_segment(obs: DataFrame) -> DataFrame:
    """Each observation once for every segment it is in: overlapping groups in one pass."""
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in segments().items()]))
    return obs.withColumn("segment", F.explode(names))


def hac_lag(horizon: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(horizon / C.PANEL_STEP_DAYS).cast("int") + 1)


def segment_ics(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Per date and key the rank correlation of mispricing and forward return."""
    return stats.rank_correlation(obs, [*keys, "date"], "mispricing", "fwd")


def pooled_buckets(obs: DataFrame, bucket: Column, least: int = 30) -> DataFrame:
    """Rows (bucket, n, ic, frac_up, mean_return) over all dates together, buckets of at least 30 rows, the largest first.

    There are a handful of buckets, so ranks are made in bins of a bucket and not in one task for each.  Each ranking
    reads its rows three times, so they are cut before it.
    """
    rows = cut(obs.withColumn("bucket", bucket).where("bucket is not null").select("bucket", "mispricing", "fwd"))
    ranked = stats.with_doubled_rank(cut(stats.with_doubled_rank(rows, "mispricing", ["bucket"], "__x")), "fwd", ["bucket"], "__y")
    out = ranked.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.round(stats.rank_coefficient("__x", "__y"), 6).alias("ic"), F.round(F.avg((F.col("fwd") > 0).cast("double")), 6).alias("frac_up"), F.round(F.avg("fwd"), 6).alias("mean_return")
    )
    return out.where(F.col("n") >= least).orderBy(F.desc("n"), "bucket")


def floor_sensitivity(obs: DataFrame, floors: tuple[float, ...] = (2.0, 5.0, 10.0, 20.0)) -> DataFrame:
    """Per date and price floor the rank correlation, each observation once for every floor it reaches."""
    return segment_ics(obs.withColumn("floor", F.explode(F.array(*map(F.lit, floors)))).where("price >= floor"), ["floor"])


def by_age(obs: DataFrame) -> DataFrame:
    """Rows (bucket, n, mean_return, n_dates, mean_ic ..): forward returns and rank correlations by age of the card.

    A bucket without a correlation on any date is left out.
    """
    rows = obs.withColumn("bucket", scores.age_bucket(F.col("age_days"))).where("bucket is not null")
    ics = stats.ic_summary(segment_ics(rows, ["bucket"]), ["bucket"])
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("fwd").alias("mean_return")).join(ics, "bucket")


def decile_legs(obs: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    """Rows (keys, n_dates, top, bottom, spread): per date the mean return of the most and least mispriced tenth, averaged."""
    by = [*keys, "date"]
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    order = Window.partitionBy(*by).orderBy(F.round("mispricing", 9), "card_id")
    rows = obs.withColumns({"__n": n, "__at": F.row_number().over(order)}).where(F.col("__n") >= least)
    k = F.greatest(F.lit(1), F.floor(F.col("__n") / 10))
    legs = rows.groupBy(*by).agg(F.avg(F.when(F.col("__at") > F.col("__n") - k, F.col("fwd"))).alias("top"), F.avg(F.when(F.col("__at") <= k, F.col("fwd"))).alias("bottom"))
    return legs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_dates"), F.avg("top").alias("top"), F.avg("bottom").alias("bottom"), F.avg(F.col("top") - F.col("bottom")).alias("spread"))


def hit_rates(obs: DataFrame, band: float = C.VERDICT_BAND) -> DataFrame:
    """How often calls beyond the band were right: under-priced went up, over-priced went down; and the base rate."""
    under, over, up = F.col("mispricing") > band, F.col("mispricing") < -band, F.col("fwd") > 0
    share = lambda cond, of: F.round(F.try_divide(F.sum((of & cond).cast("double")), F.sum(of.cast("double"))), 6)
    return obs.agg(
        F.sum(under.cast("long")).alias("n_under"), share(up, under).alias("under_up"), F.sum(over.cast("long")).alias("n_over"),
        share(F.col("fwd") < 0, over).alias("over_down"), F.round(F.avg(up.cast("double")), 6).alias("base_up"),
    )
