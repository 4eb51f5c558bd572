"""Supply and demand of cards from dated listing snapshots.

Snapshots are rows (date, card_id, active, average, item_ids).  Unknown is null and never zero: a day without a valid
observation makes no flow, but its row still fills a place in the trailing frames, which count rows and not days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick import constants as C
from tarnwick.functions import scores
from tarnwick.lineage import cut


def flow_columns(active: Column, average: Column, ids: Column, active0: Column, average0: Column, ids0: Column) -> dict[str, Column]:
    """What changed from one observation to the next: listings new, ended, sold and unsold; null where either is unknown.

    With both id lists flows are gross; without, net.
    """
    known = active.isNotNull() & active0.isNotNull()
    gross = ids.isNotNull() & ids0.isNotNull()
    new = F.when(gross, F.size(F.array_except(ids, ids0))).otherwise(F.greatest(active - active0, F.lit(0)))
    ended = F.when(gross, F.size(F.array_except(ids0, ids))).otherwise(F.greatest(active0 - active, F.lit(0)))
    new, ended = F.when(known, new).cast("int"), F.when(known, ended).cast("int")
    sold = F.when(known, scores.sold_split(ended, average, average0))
    return {"new_listings": new, "ended_listings": ended, "est_sold": sold, "est_unsold": ended - sold}


def with_flows(snapshots: DataFrame, until: Column | None = None) -> DataFrame:
    """Flows against the row before of the same card, however old; stored flow values are made anew.

    Rows after ``until`` are left out before the window, so the limit reaches the scan (and prunes date partitions); it
    changes no earlier row.
    """
    if until is not None:
        snapshots = snapshots.where(F.col("date") <= until)
    w = Window.partitionBy("card_id").orderBy("date")
    prev = lambda c: F.lag(c).over(w)
    rows = snapshots.withColumns({"__active": prev("active"), "__average": prev("average"), "__ids": prev("item_ids")})
    flows = flow_columns(*[F.col(c) for c in ("active", "average", "item_ids", "__active", "__average", "__ids")])
    return rows.withColumns(flows).drop("__active", "__average", "__ids")


def yesterday_flows(today: DataFrame, history: DataFrame) -> DataFrame:
    """The live sweep's flows: against the row dated exactly one day before, if there is one."""
    before = history.select("card_id", F.date_add("date", 1).alias("date"), *[F.col(c).alias(f"__{c}") for c in ("active", "average", "item_ids")])
    rows = today.join(before, ["card_id", "date"], "left")
    flows = flow_columns(*[F.col(c) for c in ("active", "average", "item_ids", "__active", "__average", "__item_ids")])
    return rows.withColumns(flows).drop("__active", "__average", "__item_ids")


def with_trailing(flows: DataFrame, short: int = C.SHORT_ROWS, long: int = C.LONG_ROWS) -> DataFrame:
    """Trailing sums of sold and new listings and means of active ones over the last 7 and 30 rows; all-null stays null."""
    w = Window.partitionBy("card_id").orderBy("date")
    brief, wide = w.rowsBetween(-(short - 1), 0), w.rowsBetween(-(long - 1), 0)
    return flows.withColumns(
        {
            "sold_7": F.sum("est_sold").over(brief),
            "new_7": F.sum("new_listings").over(brief),
            "active_7": F.avg("active").over(brief),
            "active_30": F.avg("active").over(wide),
        }
    )


def compute(flows: DataFrame, current: Column | None = None, as_of: Column | None = None) -> DataFrame:
    """One row per card: status, demand pressure, supply saturation and their basis, by its latest admissible row.

    Rows after ``as_of`` or ``current`` are ignored.  A card whose latest row is unknown, or not of the current date,
    awaits data; so does one with a single row, or with neither a demand nor a shift to report.  The basis has the
    lengths of the frames where there were rows to look at, and the frames' means where they led to a reading.
    """
    rows = flows
    for limit in (as_of, current):
        if limit is not None:
            rows = rows.where(F.col("date") <= limit)
    last = F.max(F.struct("date", "active", "sold_7", "new_7", "active_7", "active_30")).alias("l")
    made = with_trailing(rows).groupBy("card_id").agg(last, F.count(F.lit(1)).alias("days"), F.max(F.when(F.col("active").isNotNull(), F.col("date"))).alias("last_observed"))
    active, sold, new, a7, a30 = (F.col(f"l.{c}") for c in ("active", "sold_7", "new_7", "active_7", "active_30"))
    stale = active.isNull() | (F.lit(False) if current is None else F.col("l.date") != current)
    single = ~stale & (F.col("days") < 2)
    demand = F.when(~stale & ~single & ((active + sold) > 0), F.round(F.try_divide(100.0 * sold, active + sold), 4))
    saturation = F.when(~stale & ~single & (a30 > 0), F.round(F.try_divide(a7, a30), 4))
    saturation = F.coalesce(saturation, F.lit(1.0))
    quiet = demand.isNull() & (saturation == 1.0)
    awaits = stale | single | quiet
    return made.select(
        "card_id",
        F.when(awaits, "awaiting_data").otherwise("ok").alias("status"),
        demand.alias("demand_pressure"),
        saturation.alias("supply_saturation"),
        F.when(~stale, active).alias("active_listings"),
        F.when(~stale & ~single, sold).alias("sold_7"),
        F.when(~stale & ~single, new).alias("new_7"),
        F.when(stale, "no_current_observation").alias("reason"),
        F.when(stale, F.col("last_observed")).alias("last_observed"),
        F.col("days").cast("long").alias("days"),
        F.when(~stale & ~single, F.lit(C.SHORT_ROWS)).alias("short_window"),
        F.when(~stale & ~single, F.lit(C.LONG_ROWS)).alias("long_window"),
        F.when(~awaits, F.round(a7, 4)).alias("short_active_avg"),
        F.when(~awaits, F.round(a30, 4)).alias("long_active_avg"),
    )


def window_lows(snapshots: DataFrame, days: int = 14) -> DataFrame:
    """Known averages plus ``low``, the least of the ``days`` calendar days up to the row, and ``is_low``."""
    w = Window.partitionBy("card_id").orderBy("__day").rangeBetween(-(days - 1), 0)
    rows = snapshots.where("average is not null").withColumn("__day", F.unix_date("date"))
    return rows.withColumn("low", F.min("average").over(w)).withColumn("is_low", F.col("average") <= F.col("low")).drop("__day")


def failure_runs(attempts: DataFrame, order: str = "seq", key: str = "sweep", unknown: str = "unknown", most: int = 30) -> DataFrame:
    """``attempts`` plus ``run`` (consecutive unknowns up to here) and ``issued`` (false behind the breaker's point).

    A sweep of any length is cut into blocks, ranges of its order.  Runs are made inside blocks; a scan over the blocks'
    summaries (a row for each block of a sweep) says which run each block is entered with, and whether the breaker
    tripped before it.  So no task holds a whole sweep.
    """
    placed = attempts.repartitionByRange(key, order).sortWithinPartitions(key, order).withColumn("__block", F.spark_partition_id())
    inside = Window.partitionBy(key, "__block").orderBy(order)
    known = (~F.col(unknown)).cast("int")
    rows = cut(placed.withColumn("__island", F.sum(known).over(inside)))
    along = Window.partitionBy(key, "__block", "__island").orderBy(order)
    rows = rows.withColumn("__run", F.sum(1 - known).over(along))

    # Of each block: whether it has a known row, and its run at the end, which goes on from the block before if it has none.
    blocks = rows.groupBy(key, "__block").agg((F.max("__island") > 0).alias("__breaks"), F.max_by("__run", order).alias("__tail"))
    chain = Window.partitionBy(key).orderBy("__block")
    blocks = blocks.withColumn("__stretch", F.sum(F.col("__breaks").cast("int")).over(chain))
    so_far = F.sum("__tail").over(Window.partitionBy(key, "__stretch").orderBy("__block"))
    entered = blocks.withColumn("__so_far", so_far).select(key, "__block", F.coalesce(F.lag("__so_far").over(chain), F.lit(0)).alias("__entered"))
    rows = _with_block(rows, entered, key)
    rows = cut(rows.withColumn("run", F.col("__run") + F.when(F.col("__island") == 0, F.col("__entered")).otherwise(0)))

    trips = (F.col("run") >= most).cast("int")
    tripped = rows.groupBy(key, "__block").agg(F.max(trips).alias("__trips"))
    tripped = tripped.select(key, "__block", F.coalesce(F.max("__trips").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__tripped"))
    rows = _with_block(rows, tripped, key)
    here = F.coalesce(F.max(trips).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("issued", (F.col("__tripped") == 0) & (here == 0)).drop("__block", "__island", "__run", "__entered", "__tripped")


def _with_block(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    side = side.withColumnsRenamed({key: "__key", "__block": "__of"})
    return rows.join(side, rows[key].eqNullSafe(side["__key"]) & (rows["__block"] == side["__of"])).drop("__key", "__of")
