"""The daily sweep end to end: plan, requests, observations, flows against yesterday, one written day."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwick.functions import text
from tarnwick.lineage import shared_folder
from tarnwick.operators import dynamics
from tarnwick.shipping import ship
from tarnwick.sources import files, rest
from tarnwick.sources.dated import DatedTable
from tarnwick.sources.sweep import ListingSweep

COLUMNS = ["card_id", "active", "average", "item_ids", "new_listings", "ended_listings", "est_sold", "est_unsold"]


def stored(spark: SparkSession, path: str, day: str) -> DataFrame | None:
    """The written snapshot of a day, if there is one."""
    found = DatedTable(path).read(spark, day)
    return None if found is None or found.isEmpty() else found


def ask(spark: SparkSession, planned: DataFrame, options: Mapping[str, str]) -> DataFrame:
    """Rows (card_id, page, body) for ``planned`` (card_id, query, in the order of ``place``).

    Places that the sweep does not reach have no rows.  The plan that goes to the source is as long as the budget.
    """
    ship(spark)
    spark.dataSource.register(ListingSweep)
    at = f"{shared_folder(spark)}/sweep-{uuid.uuid4().hex}"
    queries = [r["query"] for r in planned.orderBy("place").select("query").collect()]  # at most the budget's calls
    stream = spark.readStream.format("listing_sweep").options(**options, queries="\n".join(queries)).load()
    running = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/log").start(f"{at}/pages")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.schema("place long, query string, page int, body string").parquet(f"{at}/pages")


def plan(cards: DataFrame, budget: int, pages: int) -> DataFrame:
    """Rows (card_id, market_price, query, place) of the cards to ask for, in order of price, as many as the budget allows."""
    chosen = files.sweep_plan(cards, budget=budget, pages=pages)
    query = text.search_query(F.col("name"), F.col("set_name"), F.col("number"))
    rows = chosen.select("card_id", "market_price", F.regexp_replace(query, r"\s+", " ").alias("query")).where("query <> ''")
    # As many rows as the budget has calls, so their numbers may come from one task.
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("market_price"), "card_id")) - 1)


def collect_day(
    cards: DataFrame,
    path: str,
    day: str,
    options: Mapping[str, str] | None = None,
    credentials: tuple[str, str] | None = None,
    token_url: str = "",
    scope: str = "",
) -> DataFrame:
    """Write the snapshot of ``day`` to ``path`` and return it: a row for each of ``cards``.

    ``cards`` has card_id, name, set_name, number and market_price.  Without credentials a day that is there is kept as
    it is, and a day that is not gets neutral rows.  Without a token the rows are neutral.  Else the sweep of
    ``options`` (see `sources.sweep`) asks for the planned cards in order of price, and its pages become observations: a
    failed, malformed or unreached query is unknown (null), a confirmed empty one is 0.  Flows are against exactly the day
    before, if it is there.  The day is overwritten as a whole, so a run may be repeated.
    """
    spark = cards.sparkSession
    if credentials is None:
        there = stored(spark, path, day)
        if there is not None:
            return there
    token = rest.app_token(token_url, *credentials, scope) if credentials else None
    ids = cards.select("card_id")
    if token is None:
        seen = ids.limit(0).select("card_id", F.lit(False).alias("known"), F.lit(None).cast("int").alias("active"), F.lit(None).cast("double").alias("average"), F.lit(None).cast("array<string>").alias("item_ids"))
    else:
        options = {**(options or {}), "token": token}
        planned = plan(cards, int(options.get("calls", 4800)), int(options.get("pages", 1)))
        pages = ask(spark, planned, options).join(planned.select("place", "card_id", "market_price"), "place")
        seen = files.observations(pages, ["card_id"], page="page", market="market_price")
    today = files.sweep_rows(ids, seen).withColumn("date", F.lit(day).cast("date"))
    before = stored(spark, path, str(dt.date.fromisoformat(day) - dt.timedelta(days=1)))
    if before is None:
        before = today.limit(0)
    rows = dynamics.yesterday_flows(today, before.select("date", "card_id", "active", "average", "item_ids"))
    DatedTable(path).write(rows.select("date", *COLUMNS))
    return stored(spark, path, day)
