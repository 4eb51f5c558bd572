"""Days that are there whole or not at all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarnwick.sources.dated import DatedTable


def rows(spark, *values):
    return spark.createDataFrame([(v, d) for v, d in values], "v int, date string")


def seen(table, spark, day=None):
    found = table.read(spark, day)
    return None if found is None else sorted((r.v, str(r.date)) for r in found.collect())


def test_days_are_replaced_kept_and_added(spark, tmp_path):
    table = DatedTable(str(tmp_path / "t"))
    assert seen(table, spark) is None
    table.write(rows(spark, (1, "2026-01-01"), (2, "2026-01-02"), (3, "2026-01-02")))
    table.write(rows(spark, (9, "2026-01-02")))
    assert seen(table, spark) == [(1, "2026-01-01"), (9, "2026-01-02")]
    table.write(rows(spark, (7, "2026-01-02"), (8, "2026-01-03")), keep=True)
    assert seen(table, spark) == [(1, "2026-01-01"), (8, "2026-01-03"), (9, "2026-01-02")] and seen(table, spark, "2026-01-03") == [(8, "2026-01-03")]
    table.write(rows(spark).where("false"))
    table.write(rows(spark, (5, "2026-01-01")).withColumn("w", F.lit(1)))  # a new column
    assert seen(table, spark, "2026-01-01") == [(5, "2026-01-01")] and "w" in table.read(spark).columns


def test_what_a_dead_run_left_is_not_there(spark, tmp_path):
    table = DatedTable(str(tmp_path / "t"))
    table.write(rows(spark, (1, "2026-01-01")))
    table.stage(rows(spark, (2, "2026-01-01"), (3, "2026-01-02")))  # died before its record
    assert seen(table, spark) == [(1, "2026-01-01")]
    broken = rows(spark, (4, "2026-01-03"), (0, "2026-01-04")).withColumn("v", F.when(F.col("v") > 0, F.col("v")).otherwise(F.raise_error(F.lit("broken")).cast("int")))
    with pytest.raises(Exception, match="broken"):
        table.write(broken)
    assert seen(table, spark) == [(1, "2026-01-01")]
    wanted = spark.createDataFrame([("2026-01-01",), ("2026-01-02",), ("2026-01-03",)], "date string").select(F.col("date").cast("date").alias("date"))
    assert [str(r.date) for r in table.missing(wanted).orderBy("date").collect()] == ["2026-01-02", "2026-01-03"]
    table.write(rows(spark, (6, "2026-01-02")), keep=True)  # left-over files are no day that is done
    assert seen(table, spark) == [(1, "2026-01-01"), (6, "2026-01-02")]


def test_reads_open_only_the_folders_that_count(spark, tmp_path):
    table = DatedTable(str(tmp_path / "t"))
    for k in range(4):
        table.write(rows(spark, *[(k, f"2026-01-0{n}") for n in (1, 2, 3)]))
    assert seen(table, spark) == [(3, "2026-01-01"), (3, "2026-01-02"), (3, "2026-01-03")]
