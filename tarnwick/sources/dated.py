"""A table of days in which a day is there whole or not at all.

A write puts its rows in a folder of its own and then one small record that says which days it holds.  Readers see the
days of records only: what a run that died has left over is never read, and a day that is written again is replaced by
one record.  Records are counted up, and for each day the highest counts.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class DatedTable:
    """``path`` holds ``data/run=../<day>=..`` and ``commits``; ``day`` names the date column, which may
    be called anything but ``run``."""

    def __init__(self, path: str, day: str = "date"):
        self.path, self.day = path, day

    def committed(self, spark: SparkSession) -> DataFrame | None:
        """Rows (day, run, version): for each day that is there, the write that counts.  A row a day."""
        try:
            records = spark.read.schema(f"{self.day} date, run string, version long").parquet(f"{self.path}/commits")
        except AnalysisException:
            return None
        last = F.max(F.struct("version", "run")).alias("last")
        return records.groupBy(self.day).agg(last).select(self.day, "last.run", "last.version")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The rows of ``wanted`` whose day is not there yet."""
        there = self.committed(wanted.sparkSession)
        return wanted if there is None else wanted.join(there.select(self.day), self.day, "left_anti")

    def write(self, df: DataFrame, keep: bool = False) -> None:
        """Write the days of ``df``, each as a whole; with ``keep`` only those that are not there."""
        run = self.stage(self.missing(df) if keep else df)
        self.commit(df.sparkSession, run)

    def stage(self, df: DataFrame) -> str:
        """Write the rows without making them count; returns the run's name."""
        run = uuid.uuid4().hex
        df.withColumn(self.day, F.col(self.day).cast("date")).write.partitionBy(self.day).parquet(f"{self.path}/data/run={run}")
        return run

    def commit(self, spark: SparkSession, run: str) -> None:
        """Make a staged run's days count: one record file, which Spark renames into place when it is whole."""
        try:
            days = spark.read.parquet(f"{self.path}/data/run={run}").select(F.col(self.day).cast("date")).distinct()
        except AnalysisException:  # no rows were staged, so no day
            return
        there = self.committed(spark)
        version = 1 if there is None else 1 + (there.agg(F.max("version")).first()[0] or 0)
        record = days.select(self.day, F.lit(run).alias("run"), F.lit(version).cast("long").alias("version"))
        record.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def read(self, spark: SparkSession, day: str | None = None) -> DataFrame | None:
        """The rows of all days that are there, or of one; None before the first commit.

        The days' runs are joined as partition columns, so only the folders that count are read.
        """
        there = self.committed(spark)
        if there is None:
            return None
        if day is not None:
            there = there.where(F.col(self.day) == F.lit(day).cast("date"))
        rows = spark.read.option("mergeSchema", True).option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")
        rows = rows.withColumn(self.day, F.col(self.day).cast("date"))
        there = there.select(F.col(self.day).alias("__day"), F.col("run").alias("__run"))
        return rows.join(there, (rows["run"] == F.col("__run")) & (rows[self.day] == F.col("__day")), "left_semi").drop("run")
