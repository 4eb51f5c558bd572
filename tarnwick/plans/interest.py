"""Search interest end to end: the names that have no score yet, asked for in batches with an anchor, scored and kept."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.operators import features
from tarnwick.plans import sweep
from tarnwick.sources import files
from tarnwick.sources.dated import DatedTable

ANSWER = "map<string,map<string,int>>"


def stored(spark, path: str) -> DataFrame:
    """Rows (name, score, weekly), the newest of each name."""
    rows = DatedTable(path, "fetched").read(spark)
    if rows is None:
        return spark.createDataFrame([], "name string, score double, weekly map<string,double>")
    last = F.max_by(F.struct("score", "weekly"), "fetched").alias("v")
    return rows.groupBy("name").agg(last).select("name", "v.score", "v.weekly")


def collect_interest(cards: DataFrame, path: str, options: Mapping[str, str], anchor: str, limit: int = 160, size: int = 4, run: str | None = None) -> DataFrame:
    """Fetch what is missing and return rows (name, score, weekly) of all names that have a score.

    The names are the characters of the dearest cards.  Those that ``path`` has are not asked for again; the others go in
    batches of ``size`` beside the anchor, so that one answer holds what is compared.  An answer is a JSON map from term
    to a map from day to a whole number.  A batch is tried as often as ``options`` say (see `sources.sweep`); one that
    fails for good, or that has no anchor in it, leaves its names for the next run.  A run's scores are kept as a whole
    under its day, so a run that dies is as if it had not been.
    """
    spark = cards.sparkSession
    done = stored(spark, path)
    names = features.top_characters(cards, anchor, limit).select(F.col("base_name").alias("name"))
    batches = files.interest_batches(names, done, size)
    asked = batches.groupBy("batch").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))  # ``size`` names each
    asked = asked.select(F.concat(F.lit(f"{anchor},"), "names").alias("query"), F.col("batch").cast("long").alias("place"))
    n = asked.count()  # at most ``limit`` names
    if n:
        answers = sweep.ask(spark, asked, {**options, "pages": "1", "breaker": str(n), "calls": str(n)})
        parsed = answers.select(F.col("place").cast("int").alias("batch"), F.explode(F.from_json("body", ANSWER)).alias("term", "days"))
        points = parsed.select("batch", "term", F.explode("days").alias("day", "value")).select("batch", "term", F.to_date("day").alias("date"), "value")
        good = F.max((F.col("term") == anchor).cast("int")).over(Window.partitionBy("batch")) == 1  # a few terms a batch
        points = points.withColumn("__good", good).where("__good").drop("__good")
        scored = files.interest_scores(points, anchor).withColumn("fetched", F.lit(run or str(dt.date.today())).cast("date"))
        before = DatedTable(path, "fetched").read(spark, run or str(dt.date.today()))
        if before is not None:  # a second run on a day goes on from the first
            scored = scored.unionByName(before.join(scored.select("name"), "name", "left_anti").select(scored.columns))
        DatedTable(path, "fetched").write(scored)
    return stored(spark, path)
