"""A paged REST source as a Python data source: ``spark.read.format("paged_json")``.

Options: ``url`` with ``{query}``, ``{page}``, ``{offset}`` and ``{size}`` in it; ``queries`` (one per line); ``page_size``;
``pages`` (most pages of a query, 0: until a short one); ``field`` that holds the rows; ``whole`` (rows are whole pages
as text instead); ``retries`` (tries in all), ``wait``, ``linear`` (waits of 1.5, 3, .. instead of 1, 2, 4, ..);
``token``; ``on_failure`` ("error", or "unknown": a query that fails gives one row without a body).

``parallel`` deals the queries to so many tasks (else one each).  A budget is one for the whole read: with any of
``breaker`` (failed queries in a row), ``seconds`` of time or ``calls`` calls (each page is one) the queries are asked in
their order by one task, whatever ``parallel`` is; those it does not reach are unknown rows.  A task that is tried again
starts with a new budget; `sweep` is the form whose budget outlives that.  Rows are (query, page, body): the row's JSON as
text, to be parsed with a declared schema.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Answers that are worth another try.
AGAIN = (429, 500, 502, 503, 504)


def fetch(url: str, retries: int = 4, token: str | None = None, wait: float = 1.0, linear: bool = False) -> object:
    """The JSON of an answer, tried ``retries`` times in all.

    Waits 1, 2, 4, .. times ``wait`` in between (``linear``: 1.5, 3, ..).  Rate limits, server errors, lost connections
    and answers that are not JSON are tried again; any other refusal ends it at once.
    """
    for attempt in range(retries):
        try:
            request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
            with urllib.request.urlopen(request, timeout=30) as answer:
                return json.loads(answer.read().decode("utf-8"))
        except urllib.error.HTTPError as e:
            if e.code not in AGAIN or attempt == retries - 1:
                raise
        except (OSError, ValueError):  # URLError and timeouts are OSErrors, broken JSON is a ValueError
            if attempt == retries - 1:
                raise
        time.sleep(wait * (1.5 * (attempt + 1) if linear else 2**attempt))
    raise ValueError("no tries")


def app_token(url: str, app: str, secret: str, scope: str) -> str | None:
    """A client-credentials token, or None where there is none to get; the sweep is neutral then."""
    basic = base64.b64encode(f"{app}:{secret}".encode()).decode()
    body = urllib.parse.urlencode({"grant_type": "client_credentials", "scope": scope}).encode()
    headers = {"Authorization": f"Basic {basic}", "Content-Type": "application/x-www-form-urlencoded"}
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers, method="POST"), timeout=30) as answer:
            return json.loads(answer.read().decode()).get("access_token")
    except (OSError, ValueError):
        return None


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "query string, page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class Queries(InputPartition):
    def __init__(self, queries: list[str]):
        super().__init__(queries)
        self.queries = queries


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        o = {k.lower(): v for k, v in dict(options).items()}
        yes = lambda k: str(o.get(k, "false")).lower() == "true"
        self.url, self.queries, self.field = o["url"], [q for q in o["queries"].split("\n") if q.strip()], o.get("field", "data")
        self.size, self.pages, self.whole = int(o.get("page_size", 250)), int(o.get("pages", 0)), yes("whole")
        self.tries = (int(o.get("retries", 4)), o.get("token"), float(o.get("wait", 1.0)), yes("linear"))
        self.unknown, self.parallel = o.get("on_failure", "error") == "unknown", int(o.get("parallel", 0))
        self.asked = 0
        self.limited = any(k in o for k in ("breaker", "seconds", "calls"))
        self.breaker, self.seconds, self.calls = int(o.get("breaker", 30)), float(o.get("seconds", 1800)), int(o.get("calls", 4800))

    def partitions(self) -> list[InputPartition]:
        n = 1 if self.limited else self.parallel or len(self.queries)
        return [Queries(self.queries[k::n]) for k in range(min(n, len(self.queries)))]

    def read(self, partition: Queries) -> Iterator[tuple[str, int, str | None]]:
        began, failed, self.asked = time.monotonic(), 0, 0
        for query in partition.queries:
            if self.limited and (failed >= self.breaker or self.asked + max(self.pages, 1) > self.calls or time.monotonic() - began > self.seconds):
                yield query, 1, None
                continue
            try:
                rows = list(self._pages(query)) if self.unknown else self._pages(query)
                yield from rows
                failed = 0
            except (OSError, ValueError):
                if not self.unknown:
                    raise
                failed += 1
                yield query, 1, None

    def _pages(self, query: str) -> Iterator[tuple[str, int, str]]:
        page = 1
        while True:
            url = self.url.format(query=urllib.parse.quote(query), page=page, offset=(page - 1) * self.size, size=self.size)
            self.asked += 1
            answer = fetch(url, *self.tries)
            rows = answer.get(self.field) if isinstance(answer, dict) else answer
            rows = rows if isinstance(rows, list) else []
            if self.whole:
                yield query, page, json.dumps(answer)
            else:
                for row in rows:
                    yield query, page, json.dumps(row)
            if len(rows) < self.size or page == self.pages:
                return
            page += 1
