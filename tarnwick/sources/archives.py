"""Daily archives: fetched once into a table of binaries, unpacked on the executors.

The cache is a Parquet table (date, content) partitioned by date.  Fetching is a map over dates, so as many run at once
as there are tasks; a date that has no archive gives no row and is asked again the next time.
"""

from __future__ import annotations

import io
import urllib.error
import urllib.request
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.sources.dated import DatedTable

Members = Callable[[bytes], Iterator[tuple[str, bytes]]]


def fetched(url: str) -> bytes | None:
    """The body of an answer, or None on any failure."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url), timeout=120) as answer:
            return answer.read() or None
    except OSError:
        return None


def download(dates: DataFrame, url: str, get: Callable[[str], bytes | None] = fetched, tasks: int = 8) -> DataFrame:
    """Rows (date, content) of the dates' archives; ``url`` has ``{date}`` in it."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for date in batch["date"]:
                content = get(url.format(date=date))
                if content is not None:
                    yield pd.DataFrame({"date": [date], "content": [content]})

    return dates.select("date").distinct().repartition(tasks, "date").mapInPandas(fetch, "date date, content binary")


def prefetch(spark: SparkSession, dates: DataFrame, url: str, cache: str, get: Callable[[str], bytes | None] = fetched, tasks: int = 8) -> DataFrame:
    """The cache with the dates in it that it did not have; dates that it has are not fetched again.

    A date is in the cache when its archive was written whole and the write came to its end.
    """
    table = DatedTable(cache)
    table.write(download(table.missing(dates.select(F.col("date").cast("date").alias("date")).distinct()), url, get, tasks))
    found = table.read(spark)
    return spark.createDataFrame([], "content binary, date date") if found is None else found.select("content", "date")


def zip_members(content: bytes) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            yield name, z.read(name)


def seven_zip_members(content: bytes) -> Iterator[tuple[str, bytes]]:
    """Needs the optional library ``py7zr`` on the executors."""
    import py7zr

    with py7zr.SevenZipFile(io.BytesIO(content)) as z:
        for name, data in (z.readall() or {}).items():
            yield name, data.read()


def group_files(cache: DataFrame, groups: list[str] | None = None, members: Members = seven_zip_members) -> DataFrame:
    """Rows (date, group, value) of the wanted group files ``<date>/<category>/<group>/prices``; a broken archive gives none."""
    wanted = None if groups is None else set(groups)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for date, content in zip(batch["date"], batch["content"]):
                try:
                    found = list(members(bytes(content)))
                except (ValueError, OSError, zipfile.BadZipFile):
                    continue
                for name, data in found:
                    parts = name.split("/")
                    if len(parts) > 1 and parts[-1] == "prices" and (wanted is None or parts[-2] in wanted):
                        yield pd.DataFrame({"date": [date], "group": [parts[-2]], "value": [data.decode("utf-8", "replace")]})

    return cache.select("date", "content").mapInPandas(unpack, "date date, group string, value string")
