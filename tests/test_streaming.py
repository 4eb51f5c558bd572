"""Streams whose files land in any order, and state that ends in event time."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnwick.operators import dynamics
from tarnwick.plans.queries import QUERIES
from tarnwick.streaming import snapshots

D = dt.date
VALUES = ["active", "average", "item_ids", "new_listings", "ended_listings", "est_sold", "est_unsold"]


def history(cards=3, days=6):
    rng = random.Random(9)
    ids = lambda: None if rng.random() < 0.3 else sorted(rng.sample("abcdef", rng.randint(0, 4)))
    out = [(c, D(2026, 9, 1) + dt.timedelta(days=k), *((None, None, None) if rng.random() < 0.2 else (rng.randint(0, 9), float(rng.randint(5, 60)), ids()))) for c in range(cards) for k in range(days)]
    return [r for r in out if rng.random() < 0.9]


def landed(spark, rows, path, groups):
    for n, days in enumerate(groups):
        part = [r for r in rows if r[1] in days]
        spark.createDataFrame(part, snapshots.COLUMNS).coalesce(1).write.parquet(f"{path}/{n:03d}")


def streamed(spark, path, at, **how):
    stream = snapshots.flows(snapshots.read(spark, path, 1), **how)
    snapshots.write_by_day(stream, f"{at}/out", f"{at}/log").awaitTermination()
    return {(r.card_id, r.date): tuple(r[c] for c in VALUES) for r in snapshots.latest(spark, f"{at}/out").collect()}


def batch(spark, rows):
    return {(r.card_id, r.date): tuple(r[c] for c in VALUES) for r in dynamics.with_flows(spark.createDataFrame(rows, snapshots.COLUMNS)).collect()}


@pytest.mark.parametrize("order", ["newest first", "shuffled", "in order, two at a time"])
def test_files_in_any_order_give_the_batch_rows(spark, tmp_path, order):
    rows = history()
    days = sorted({r[1] for r in rows})
    groups = [[d] for d in days]
    if order == "newest first":
        groups.reverse()
    elif order == "shuffled":
        random.Random(2).shuffle(groups)
    else:
        groups = [days[k : k + 2] for k in range(0, len(days), 2)]
    landed(spark, rows, f"{tmp_path}/in", groups)
    assert streamed(spark, f"{tmp_path}/in", tmp_path) == batch(spark, rows)


def test_a_day_that_lands_again_and_a_corrected_day(spark, tmp_path):
    rows = history()
    days = sorted({r[1] for r in rows})
    landed(spark, rows, f"{tmp_path}/in", [[d] for d in days])
    first = streamed(spark, f"{tmp_path}/in", tmp_path)
    fixed = [(c, d, 7, 9.0, ["z"]) if (c, d) == (1, days[2]) else (c, d, *v) for c, d, *v in rows]
    landed(spark, [r for r in fixed if r[1] in (days[0], days[2])], f"{tmp_path}/in/again", [[days[0]], [days[2]]])
    assert first == batch(spark, rows) and streamed(spark, f"{tmp_path}/in", tmp_path) == batch(spark, fixed)


def test_bounded_state_is_exact_within_its_days(spark, tmp_path):
    rows = history(days=12)
    days = sorted({r[1] for r in rows})
    groups = [[d] for d in days]
    groups[2], groups[3] = groups[3], groups[2]
    landed(spark, rows, f"{tmp_path}/in", groups)
    assert streamed(spark, f"{tmp_path}/in", tmp_path, keep_days=2) == batch(spark, rows)


def test_cache_ends_after_fourteen_days(spark, tmp_path):
    schema = "id long, at timestamp, fetched date"
    day = lambda k, hour=12: dt.datetime(2026, 9, 1, hour) + dt.timedelta(days=k)
    clock = lambda k: (99, day(k), day(k).date())
    steps = [
        [(1, day(0), day(0).date()), (2, day(0), None), (3, day(0), day(0).date())],
        [(3, day(5), day(5).date()), (3, day(5), day(1).date())],
        [clock(14)], [clock(15)], [clock(19)], [clock(20)],
    ]
    seen, found = set(), []
    for n, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n:03d}")
        stream = snapshots.due(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"))
        put = lambda b, _: [seen.add((r.id, r.fetched)) for r in b.collect()] and None
        stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
        found.append(set(seen))
    first, third = (1, D(2026, 9, 1)), (3, D(2026, 9, 6))
    assert (2, None) in found[0]
    assert first not in found[2] and first in found[3]  # fresh on the fourteenth day, due on the fifteenth
    assert third not in found[4] and third in found[5] and (3, D(2026, 9, 1)) not in found[5]  # the newer answer counts


class CountedState:
    """A map state in memory that counts how often it is called."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getMapState(self, *_):  # noqa: N802
        return self

    def iterator(self):
        self.calls += 1
        return iter(list(self.held.items()))

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.held[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        del self.held[key]


@pytest.mark.parametrize("cards", [5, 500])
def test_calls_to_the_state_go_with_days_and_not_with_cards(cards):
    state = CountedState()
    step = snapshots.Neighbours(None)
    step.init(state)
    out = []
    for day in ("2026-09-02", "2026-09-01"):
        batch = pd.DataFrame({"card_id": [str(c) for c in range(cards)], "date": dt.date.fromisoformat(day), "active": 3, "average": 2.5, "item_ids": [["a", "b"]] * cards})
        out.append(pd.concat(step.handleInputRows((0,), iter([batch]), None)))
    assert [len(x) for x in out] == [cards, 2 * cards] and state.calls == 4


def test_rows_without_a_card_are_one_card(spark, tmp_path):
    rows = [(None, D(2026, 9, 1), 4, 2.0, None), (None, D(2026, 9, 2), 1, 2.0, None), (2**60 + 1, D(2026, 9, 1), 1, None, ["a"]), (2**60 + 1, D(2026, 9, 2), 1, None, ["b", None])]
    landed(spark, rows, f"{tmp_path}/in", [[D(2026, 9, 2)], [D(2026, 9, 1)]])
    assert streamed(spark, f"{tmp_path}/in", tmp_path) == batch(spark, rows)


def test_state_partitions_go_with_rows_and_cores(spark, monkeypatch):
    assert [snapshots.sizes(spark, n) for n in (0, 25_000, 10**6)] == [(1, 1), (3, 3), (101, 4)]
    started, write = [], snapshots.write_by_day
    monkeypatch.setattr(snapshots, "write_by_day", lambda *a, **how: started.append(write(*a, **how)) or started[-1])
    QUERIES["stream_flows"](spark, "/root/testdata/sf0.001")
    batches = [p for p in started[0].recentProgress if p.numInputRows]
    assert len(batches) == 30  # a micro-batch for each day still
    assert {p.stateOperators[0].numShufflePartitions for p in batches} == {1}
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"  # the session keeps its own number
