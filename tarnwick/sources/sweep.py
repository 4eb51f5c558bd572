"""A sweep over many queries under one budget, as a stream: ``spark.readStream.format("listing_sweep")``.

The offset is the place in the plan, with the calls, the milliseconds and the run of failures so far, whole numbers all.  So the budgets are
the sweep's, however many tasks or micro-batches there are: rows of a micro-batch are kept by Spark, a task that is
tried again reads them from there, and a query that starts again goes on from its checkpoint.

Options: ``url`` with ``{query}``, ``{page}``, ``{offset}`` and ``{size}`` in it; ``queries``, one per line in the order
in which they are asked; ``page_size``; ``pages`` (most pages of a query); ``field`` that holds a page's items;
``retries``, ``wait``, ``token`` as in `rest.fetch`; ``breaker`` (failed queries in a row), ``calls`` and ``seconds``
that end the sweep; ``chunk`` (queries of a micro-batch).

Rows are (place, query, page, body), the body as text; a failed query is a row without a body.  Queries behind the end
have no rows.  If the driver is lost within a micro-batch, its queries were asked and their answers are gone: they
are rows without a body then and are not asked again.
"""

from __future__ import annotations

import json
import time
import urllib.parse
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tarnwick.sources import rest

Row = tuple[int, str, int, str | None]


def says_something(page: object, first: bool, field: str) -> bool:
    """Whether a page is an observation, by the rule of `files.page_items`: a failed one adds to the run of failures."""
    total = page.get("total") if isinstance(page, dict) else None
    items = page.get(field, []) if isinstance(page, dict) else None
    if not isinstance(total, int) or isinstance(total, bool) or total < 0 or not isinstance(items, list) or not all(isinstance(i, dict) for i in items):
        return False
    return any(map(_usable, items)) if items else total == 0 or not first


def _usable(item: dict) -> bool:
    price = item.get("price")
    named = lambda x: isinstance(x, str) and x.strip() != ""
    try:
        value = float(price["value"])
        return named(item.get("itemId")) and named(price["currency"]) and 0 < value < float("inf")
    except (KeyError, TypeError, ValueError):
        return False


class ListingSweep(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing_sweep"

    def schema(self) -> str:
        return "place long, query string, page int, body string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return SweepReader(self.options)


class SweepReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        o = {k.lower(): v for k, v in dict(options).items()}
        self.url, self.field = o["url"], o.get("field", "itemSummaries")
        self.queries = [q for q in o.get("queries", "").split("\n") if q.strip()]
        self.size, self.pages, self.chunk = int(o.get("page_size", 200)), int(o.get("pages", 1)), int(o.get("chunk", 50))
        self.tries = (int(o.get("retries", 4)), o.get("token"), float(o.get("wait", 1.0)), str(o.get("linear", "true")).lower() == "true")
        self.breaker, self.calls, self.seconds = int(o.get("breaker", 30)), int(o.get("calls", 4800)), float(o.get("seconds", 1800))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"place": 0, "calls": 0, "failed": 0, "millis": 0}

    def ended(self, at: dict) -> bool:
        spent = at["calls"] + self.pages > self.calls or at["millis"] > 1000 * self.seconds or at["failed"] >= self.breaker
        return at["place"] >= len(self.queries) or spent

    def read(self, start: dict) -> tuple[Iterator[Row], dict]:
        """The rows of the next chunk, and where the sweep is then; the same offset and no rows at its end."""
        at, rows, last = dict(start), [], start["place"] + self.chunk
        while at["place"] < last and not self.ended(at):
            began = time.monotonic()
            found, calls, known = self._ask(at["place"])
            rows += found
            # A query is charged its most pages, and more only if it took more.
            at = {"place": at["place"] + 1, "calls": at["calls"] + max(calls, self.pages), "failed": 0 if known else at["failed"] + 1, "millis": at["millis"] + round(1000 * (time.monotonic() - began))}
        return iter(rows), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[Row]:  # noqa: N802
        return iter([(k, self.queries[k], 1, None) for k in range(start["place"], end["place"])])

    def _ask(self, place: int) -> tuple[list[Row], int, bool]:
        query, rows, known = self.queries[place], [], True
        for page in range(1, self.pages + 1):
            url = self.url.format(query=urllib.parse.quote(query), page=page, offset=(page - 1) * self.size, size=self.size)
            try:
                answer = rest.fetch(url, *self.tries)
            except (OSError, ValueError):
                return [(place, query, 1, None)], page, False
            rows.append((place, query, page, json.dumps(answer)))
            known = known and says_something(answer, page == 1, self.field)
            items = answer.get(self.field) if isinstance(answer, dict) else None
            if not isinstance(items, list) or len(items) < self.size:
                break
        return rows, len(rows), known
