"""Joins in time: nearest forward, backward, first in a window, and carried-forward grids.

Small sides (distinct dates) drive range joins; large sides are only ever equi-joined or windowed by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.constants import HORIZONS, TOLERANCE_DAYS


def nearest_forward(dates: DataFrame, horizons: tuple[int, ...] = HORIZONS, tolerance: int = TOLERANCE_DAYS, date: str = "date") -> DataFrame:
    """Rows (horizon, date, next_date): for each date the later one nearest to ``date + horizon``, within a tolerance.

    Of two equally near dates the earlier wins.  ``dates`` holds distinct dates.  A date can only match dates in
    [date + horizon - tolerance, date + horizon + tolerance], so each date is exploded to those few days and equi-joined:
    no range join, and work in proportion to dates.
    """
    wanted = dates.select(F.col(date).alias("date"), F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    near = wanted.select("date", "horizon", F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance))).alias("off"))
    near = near.withColumn("next_date", F.date_add("date", F.col("horizon") + F.col("off"))).where("next_date > date")
    found = near.join(dates.select(F.col(date).alias("next_date")), "next_date")
    best = F.min(F.struct(F.abs("off").alias("gap"), "next_date")).alias("best")
    return found.groupBy("horizon", "date").agg(best).select("horizon", "date", F.col("best.next_date").alias("next_date"))


def backward(series: DataFrame, keys: list[str], cutoff: Column, value: str, date: str = "date", most_stale: int | None = None) -> DataFrame:
    """Rows (keys, value, date): the newest point at or before the key's cutoff, none where it is too stale.

    ``cutoff`` is an expression over the series' columns; it has to be constant for a key.
    """
    usable = F.col(date) <= cutoff
    if most_stale is not None:
        usable = usable & (F.datediff(cutoff, F.col(date)) <= most_stale)
    best = F.max(F.struct(F.col(date).alias("date"), F.col(value).alias("value"))).alias("best")
    return series.where(usable).groupBy(*keys).agg(best).select(*keys, F.col("best.value").alias(value), F.col("best.date").alias(date))


def _with_last(series: DataFrame, key: str, date: str) -> DataFrame:
    """``series`` plus ``__last``, the key's latest date: an aggregation with partial results, joined back.

    AQE broadcasts it where there are few keys, and then no point of the series is shuffled before it is aggregated.
    """
    return series.join(series.groupBy(key).agg(F.max(date).alias("__last")), key)


def trends(series: DataFrame, key: str, value: str = "price", date: str = "date", days: tuple[int, ...] = (30, 90, 180), most_stale: dict[int, int] | None = None) -> DataFrame:
    """Rows (key, latest, n_points, trend_<d>d ..): change of the latest value against the one d days before.

    The base of a trend is the newest point at or before the cutoff; ``most_stale`` limits its age in days for each
    trend (none: any age).  One aggregation for the latest dates and one for all trends.
    """
    most_stale = {30: 14, 90: 14} if most_stale is None else most_stale
    rows = _with_last(series, key, date)
    aggs = [F.max_by(value, date).alias("latest"), F.count(F.lit(1)).alias("n_points")]
    for d in days:
        usable = F.col(date) <= F.date_sub(F.col("__last"), d)
        if d in most_stale:
            usable = usable & (F.col(date) >= F.date_sub(F.col("__last"), d + most_stale[d]))
        aggs.append(F.max(F.when(usable, F.struct(date, value))).alias(f"__b{d}"))
    found = rows.groupBy(key).agg(*aggs)
    change = [F.round(F.try_divide(F.col("latest") - F.col(f"__b{d}")[value], F.col(f"__b{d}")[value]), 4).alias(f"trend_{d}d") for d in days]
    return found.select(key, "latest", "n_points", *change)


def first_in_window(series: DataFrame, key: str, value: str, days: int, date: str = "date") -> DataFrame:
    """Rows (key, from_date, from_value, to_date, to_value, n): the latest point and the earliest within ``days`` of it."""
    rows = _with_last(series, key, date)
    inside = F.datediff(F.col("__last"), F.col(date)) <= days
    first, last = F.min(F.when(inside, F.struct(date, value))), F.max(F.struct(date, value))
    out = rows.groupBy(key).agg(first.alias("f"), last.alias("l"), F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("f")[date].alias("from_date"), F.col("f")[value].alias("from_value"), F.col("l")[date].alias("to_date"), F.col("l")[value].alias("to_value"), "n")


def carried_forward(panel: DataFrame, key: str, value: str, date: str = "date") -> DataFrame:
    """Rows (date, total): on each date of the panel, the sum over keys of the last value at or before it.

    No grid of dates by keys: each point contributes its change against the key's point before, and totals are running
    sums of the changes per date.
    """
    before = F.lag(value).over(Window.partitionBy(key).orderBy(date))
    changes = panel.where(F.col(value).isNotNull()).select(date, (F.col(value) - F.coalesce(before, F.lit(0.0))).alias("change"))
    daily = changes.groupBy(date).agg(F.sum("change").alias("change"))  # a row per date
    return daily.select(date, F.sum("change").over(Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
