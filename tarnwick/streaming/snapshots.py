"""Listing snapshots as a stream, in event time: files may land in any order and give the rows of the batch form.

The batch form (`operators.dynamics.with_flows`) compares neighbouring rows of a card.  Here a card's observations are
state, by their date.  A row is compared with the nearest earlier one there is, whatever landed first; the row after it,
if it is there already, is given out again, as its neighbour has changed.  So a result may have several rows for a card
and date, and the one of the latest micro-batch counts: `latest` reads it so.  A file that is read again changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarnwick.operators.dynamics import flow_columns

COLUMNS = "card_id long, date date, active int, average double, item_ids array<string>"
PAIRS = COLUMNS + ", active0 int, average0 double, item_ids0 array<string>"
NAMES = [c.split()[0] for c in PAIRS.split(", ")]
#: Keyed state is in RocksDB, so that it need not fit in an executor's memory.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of all days that a group has, by and large: few in a worker's memory, and yet few groups.
GROUP_ROWS = 10_000
DAY = 86_400_000


def read(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Snapshots landed as Parquet files, in order of arrival."""
    stream = spark.readStream.schema(COLUMNS).option("recursiveFileLookup", True)
    return (stream if files_per_trigger is None else stream.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)


def with_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # A micro-batch writes what it changed, and not a whole snapshot of each partition; those are made aside, now and then.
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", True)


def sizes(spark: SparkSession, rows: int) -> tuple[int, int]:
    """How many groups and state partitions a stream of about ``rows`` rows in all should have.

    A task of a micro-batch and a group in it have a price whatever their rows, so groups go with the rows, and there are
    no more partitions than groups or cores.
    """
    groups = 1 + rows // GROUP_ROWS
    return groups, min(groups, spark.sparkContext.defaultParallelism)


@contextmanager
def _shuffle_partitions(spark: SparkSession, n: int | None):
    """The session's number of shuffle partitions is ``n`` for a while; a stream that starts then has a copy of it."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    if n is not None:
        spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _plain(value):
    """A value as the state holds it: no number is None, an array a list."""
    if value is None or (not hasattr(value, "__len__") and pd.isna(value)):
        return None
    return list(value) if hasattr(value, "__len__") and not isinstance(value, str) else value


class Neighbours(StatefulProcessor):
    """Pairs each observation of a card with the one before it in time, for all cards of a group at once.

    The state of a group is a text for each day, with that day's cards: a call to the state costs far more than a row, so
    their number goes with groups and days and not with cards.
    """

    def __init__(self, keep_days: int | None):
        self.keep_days = keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "day int", "cards string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {k[0]: {card: tuple(value) for card, *value in json.loads(v[0])} for k, v in self.seen.iterator()}
        asked, stale = {}, set()  # days changed by card, days to write
        for batch in rows:
            dates = (pd.to_datetime(batch["date"]) - pd.Timestamp(0)).dt.days
            for card, day, *values in zip(batch["card_id"], dates, batch["active"], batch["average"], batch["item_ids"]):
                card, day = None if pd.isna(card) else card, int(day)
                active, average, ids = map(_plain, values)
                value = (None if active is None else int(active), None if average is None else float(average), ids)
                changed = asked.setdefault(card, set())
                if held.setdefault(day, {}).get(card, ()) != value:
                    held[day][card] = value
                    changed.add(day)
                    stale.add(day)
        out, along = [], sorted(held)
        dates = {day: (pd.Timestamp(0) + pd.Timedelta(days=day)).date() for day in along}
        for card, changed in asked.items():
            days = [day for day in along if card in held[day]]
            for n, day in enumerate(days):
                if day in changed or (n and days[n - 1] in changed):
                    before = held[days[n - 1]][card] if n else (None, None, None)
                    out.append((card, dates[day], *held[day][card], *before))
            if self.keep_days is not None:  # and one row beyond, that the first of those kept is compared with
                for day in [d for d in days if d < days[-1] - self.keep_days][:-1]:
                    del held[day][card]
                    stale.add(day)
        for day in stale:
            if held[day]:
                self.seen.updateValue((day,), (json.dumps([(card, *value) for card, value in held[day].items()]),))
            else:
                self.seen.removeKey((day,))
        yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def flows(snapshots: DataFrame, keep_days: int | None = None, groups: int = 256) -> DataFrame:
    """The stream with flows against each card's observation before.

    ``keep_days`` bounds a card's state to the days before its newest row, and one row more; a row that lands later than
    that may miss its neighbour.  Without it nothing is forgotten.  Cards are dealt to ``groups`` by their hash, and a
    group's rows are in one worker's memory at a time; the number stays as it is while a checkpoint is in use.
    """
    with_state(snapshots.sparkSession)
    # Ids go as text, since whole numbers next to a null would be floats in pandas.
    group = F.pmod(F.xxhash64("card_id"), F.lit(groups)).cast("int")
    paired = snapshots.withColumns({"__group": group, "card_id": F.col("card_id").cast("string")}).groupBy("__group").transformWithStateInPandas(Neighbours(keep_days), PAIRS.replace("card_id long", "card_id string"), "Update", "None")
    paired = paired.withColumn("card_id", F.col("card_id").cast("long"))
    made = flow_columns(*[F.col(c) for c in ("active", "average", "item_ids", "active0", "average0", "item_ids0")])
    return paired.withColumns(made).drop("active0", "average0", "item_ids0")


class Cache(StatefulProcessor):
    """Remembers when an item was fetched, and says when that has become too old."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fetched = handle.getValueState("fetched", "day int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        had = self.fetched.get()[0] if self.fetched.exists() else None
        days = pd.concat([r["fetched"] for r in rows])
        known = [d for d in days if not pd.isna(d)]
        newest = max([(pd.Timestamp(d) - pd.Timestamp(0)).days for d in known] + ([had] if had is not None else []), default=None)
        if newest is None:
            yield pd.DataFrame([(key[0], None)], columns=["id", "fetched"])  # never fetched: due at once
            return
        if newest != had:
            if had is not None:
                self.handle.deleteTimer(self._ends(had))
            self.fetched.update((newest,))
            self.handle.registerTimer(self._ends(newest))
        yield pd.DataFrame([], columns=["id", "fetched"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        day = self.fetched.get()[0]
        self.fetched.clear()
        yield pd.DataFrame([(key[0], (pd.Timestamp(0) + pd.Timedelta(days=day)).date())], columns=["id", "fetched"])

    def _ends(self, day: int) -> int:
        """The last moment of the last day on which an answer is fresh."""
        return (day + self.days + 1) * DAY - 1

    def close(self) -> None:
        pass


def due(items: DataFrame, days: int = 14) -> DataFrame:
    """Rows (id, fetched) of a stream of (id, at, fetched) as items fall due: at once if they never were fetched, else when
    event time is more than ``days`` days past their newest answer, which then leaves the state.

    ``at`` is the event time that moves the clock, a timestamp; ``fetched`` is the day of an answer, or null for an item
    that asks.  An answer that is newer moves the end of its item's time, an older one changes nothing.
    """
    with_state(items.sparkSession)
    timed = items.withWatermark("at", "0 seconds")
    return timed.groupBy("id").transformWithStateInPandas(Cache(days), "id long, fetched date", "Append", "EventTime")


def write_by_day(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", partitions: int | None = None):
    """Write flows as Parquet by micro-batch and day, each micro-batch once: a rerun overwrites its own part.

    ``partitions`` is the number of state partitions of a new checkpoint, by default the session's shuffle partitions.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("date").parquet(f"{path}/batch={batch_id}")

    with _shuffle_partitions(stream.sparkSession, partitions):
        return stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """What `write_by_day` wrote, the newest row of each card and date; None before the first micro-batch."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    values = [c for c in rows.columns if c not in ("card_id", "date", "batch")]
    return rows.groupBy("card_id", F.col("date").cast("date").alias("date")).agg(F.max_by(F.struct(*values), "batch").alias("v")).select("card_id", "date", "v.*")


def event_windows(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events per window and type; the watermark bounds the state.  Works on streams and batches."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    out = rows.groupBy(F.window("__ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "value")
