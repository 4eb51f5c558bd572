"""Statistics on groups: percentiles, average ranks, rank correlation, HAC significance, robust means.

All are window functions or plain aggregates, so they run per key in parallel and combine partially.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share_at_or_below(value: str, keys: list[str]) -> Column:
    """The share of the group's rows whose value is at or below this row's."""
    return F.cume_dist().over(Window.partitionBy(*keys).orderBy(value))


def with_share_at_or_below(df: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """``df`` plus the same share, made from counts of distinct values: no task gets all rows of a key.

    For values that repeat (tiers, prices in cents) the counts are a small table, and the window runs over that.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    along, whole = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys)
    names = {k: f"__k_{k}" for k in [*keys, value]}
    shares = counts.withColumn(name, F.sum("__n").over(along) / F.sum("__n").over(whole)).withColumnsRenamed(names).drop("__n")
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()))
    return df.join(shares, same).drop(*names.values())


def doubled_rank(value: str, keys: list[str]) -> Column:
    """Twice the rank from 1, ties sharing the mean of their places: a whole number."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return 2 * F.rank().over(Window.partitionBy(*keys).orderBy(value)).cast("long") + ties - 1


def with_doubled_rank(df: DataFrame, value: str, keys: list[str], name: str, bins: int = 64) -> DataFrame:
    """``df`` plus the same rank for keys of very many rows: they are dealt to bins between approximate quantiles, counted
    there, and ranked within their bin, so no task gets a whole key.

    Bounds only decide who ranks a row; the rank is exact whatever they are.  Equal values share a bin.
    """
    cuts = F.percentile_approx(value, F.array(*[F.lit(k / bins) for k in range(1, bins)]), F.lit(1000))
    bounds = df.groupBy(*keys).agg(cuts.alias("__cuts"))
    rows = df.join(bounds, keys).withColumn("__bin", F.size(F.filter(F.col("__cuts"), lambda c: c < F.col(value)))).drop("__cuts")
    counts = rows.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__bin", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    ranked = rows.withColumn("__rank", doubled_rank(value, [*keys, "__bin"])).join(offsets, [*keys, "__bin"])
    return ranked.withColumn(name, F.col("__rank") + 2 * F.col("__offset")).drop("__bin", "__offset", "__rank")


def rank_coefficient(x: str, y: str) -> Column:
    """Spearman's coefficient of doubled ranks, null where a side is constant.

    Sums of products of whole numbers are exact, so a coefficient of 0 is 0 and not a remainder of rounding, which is what
    the count of positive ones hangs on.  The mean of n doubled ranks is n + 1.
    """
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    n = F.count(F.lit(1)).cast("decimal(12,0)")
    square = (n * (n + 1) * (n + 1)).cast("decimal(38,0)")
    co, sx, sy = (exact(F.col(a) * F.col(b)) - square for a, b in ((x, y), (x, x), (y, y)))
    double = lambda c: c.cast("double")
    return F.when((sx > 0) & (sy > 0), F.try_divide(double(co), F.sqrt(double(sx)) * F.sqrt(double(sy))))


def rank_correlation(df: DataFrame, keys: list[str], x: str, y: str, least: int = 8) -> DataFrame:
    """Rows (keys, n, ic): Spearman's coefficient of groups of at least ``least`` rows."""
    ranked = df.select(*keys, doubled_rank(x, keys).alias("__x"), doubled_rank(y, keys).alias("__y"))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rank_coefficient("__x", "__y").alias("ic")).where((F.col("n") >= least) & F.col("ic").isNotNull())


def ic_summary(ics: DataFrame, keys: list[str], order: str = "date", lag: Column | int = 5, most_lag: int = 13, least: int = 5) -> DataFrame:
    """Rows (keys, n_dates, mean_ic, std_ic, t_naive, t_hac, n_positive, sign_z).

    ``t_hac`` uses Bartlett weights up to ``lag``; the autocovariance at lag l is a mean over n - l products.  A
    variance that is not positive has no t.  Groups of fewer than ``least`` dates are left out.
    """
    lag = F.lit(lag) if isinstance(lag, int) else lag
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    centred = ics.withColumn("__d", F.col("ic") - F.avg("ic").over(own)).withColumn("__lag", lag)
    along = own.orderBy(order)
    for l in range(1, most_lag + 1):  # noqa: E741
        centred = centred.withColumn(f"__p{l}", F.col("__d") * F.lag("__d", l).over(along))
    autocov = [F.avg(f"__p{l}").alias(f"__g{l}") for l in range(1, most_lag + 1)]  # noqa: E741
    base = centred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_dates"),
        F.avg("ic").alias("mean_ic"),
        F.stddev_pop("ic").alias("std_ic"),
        F.sum((F.col("ic") > 0).cast("long")).alias("n_positive"),
        F.avg(F.col("__d") * F.col("__d")).alias("__g0"),
        F.max("__lag").alias("__lag"),
        *autocov,
    )
    reach = F.least(F.col("__lag"), F.col("n_dates") - 1)
    terms = [F.when(F.lit(l) <= reach, 2.0 * (1.0 - l / (F.col("__lag") + 1.0)) * F.coalesce(f"__g{l}", F.lit(0.0))).otherwise(0.0) for l in range(1, most_lag + 1)]  # noqa: E741
    variance = sum(terms, F.col("__g0"))
    n = F.col("n_dates").cast("double")
    out = base.withColumn("__v", variance).where(F.col("n_dates") >= least)
    return out.select(
        *keys,
        "n_dates",
        "mean_ic",
        "std_ic",
        F.when(F.col("std_ic") > 1e-12, F.try_divide("mean_ic", F.col("std_ic") / F.sqrt(n))).alias("t_naive"),
        F.when(F.col("__v") > 1e-18, F.try_divide("mean_ic", F.sqrt(F.col("__v") / n))).alias("t_hac"),
        "n_positive",
        F.try_divide(F.col("n_positive") - n / 2, F.sqrt(n) / 2).alias("sign_z"),
    )


def squared_log_correlation(market: str, expected: str) -> Column:
    """Squared correlation of logs over rows where both are positive; null where one side does not vary."""
    usable = (F.col(market) > 0) & (F.col(expected) > 0)
    x, y = F.when(usable, F.ln(market)), F.when(usable, F.ln(expected))
    spread = (F.coalesce(F.stddev_pop(x), F.lit(0.0)) > 1e-12) & (F.coalesce(F.stddev_pop(y), F.lit(0.0)) > 1e-12)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(spread, r * r)


def trimmed_means(df: DataFrame, keys: list[str], value: str, least: int = 4, reach: float = 1.5, digits: int = 2) -> DataFrame:
    """Rows (keys, n, mean): mean of what lies within the quartiles widened by 1.5 times their distance.

    Groups of fewer than ``least`` values are not trimmed; nor are those where nothing would be left.
    """
    bounds = df.groupBy(*keys).agg(F.count(value).alias("__n"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("__q"))
    low, high = F.col("__q")[0], F.col("__q")[1]
    inside = (F.col("__n") < least) | F.col(value).between(low - reach * (high - low), high + reach * (high - low))
    joined = df.join(bounds, keys)
    kept = F.count(F.when(inside, F.col(value)))
    return joined.groupBy(*keys).agg(
        F.when(kept > 0, kept).otherwise(F.count(value)).alias("n"),
        F.round(F.when(kept > 0, F.avg(F.when(inside, F.col(value)))).otherwise(F.avg(value)), digits).alias("mean"),
    )


def mean_in_order(value: str, order: str, digits: int) -> Column:
    """An aggregate: the mean of the values added in their order, rounded by whole steps, halves away from 0.

    A mean that ends in a five is rounded by the last bit of its sum, which hangs on the order of adding; so that is
    fixed, and partial sums are not used.  For groups whose values fit in a row.
    """
    rows = F.sort_array(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("at"), F.col(value).alias("v")))))
    mean = F.try_divide(F.aggregate(rows, F.lit(0.0), lambda total, i: total + i["v"]), F.count(value).cast("double"))
    steps = F.abs(mean) * 10.0**digits
    low = steps - F.pmod(steps, F.lit(1.0))
    whole = F.signum(mean) * (low + F.when(steps - low >= 0.5, 1.0).otherwise(0.0)) / 10.0**digits
    return F.when(F.abs(mean) < 1e15 / 10.0**digits, whole).otherwise(mean)
