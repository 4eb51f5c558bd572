"""The sweep under one budget, against a server that counts its requests."""

from __future__ import annotations

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tarnwick.plans import sweep
from tarnwick.sources import rest
from tarnwick.sources.dated import DatedTable
from tarnwick.sources.sweep import SweepReader, says_something

CARD = "card_id string, name string, set_name string, number string, market_price double"


def page(ids, price="50.0"):
    return {"total": len(ids), "itemSummaries": [{"itemId": i, "title": "card", "price": {"value": price, "currency": "USD"}} for i in ids]}


@pytest.fixture
def server():
    """``server.answers`` maps the first word of a query to an answer: a dict, a list of pages, or a status to fail with."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
            up.asked.append(asked["q"])
            answer = up.answers.get(asked["q"].split()[0], up.answers.get("*"))
            if isinstance(answer, list):
                answer = answer[int(asked["page"]) - 1]
            self.send_response(answer if isinstance(answer, int) else 200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def do_POST(self):  # noqa: N802
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"access_token": "t"} if up.token else {}).encode())

        def log_message(self, *_):
            pass

    up = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    up.asked, up.answers, up.token = [], {}, True
    threading.Thread(target=up.serve_forever, daemon=True).start()
    up.base = f"http://127.0.0.1:{up.server_port}"
    up.url = up.base + "/search?q={query}&page={page}&limit={size}"
    yield up
    up.shutdown()


def cards(spark, names, price=lambda k: 100.0 - k):
    return spark.createDataFrame([(f"c{k}", n, "", "", price(k)) for k, n in enumerate(names)], CARD)


def options(server, **more):
    return {"url": server.url, "wait": "0", "retries": "1", **{k: str(v) for k, v in more.items()}}


def collected(spark, server, tmp_path, names, day="2026-09-26", **more):
    got = sweep.collect_day(cards(spark, names), str(tmp_path / "days"), day, options(server, **more), ("app", "cert"), server.base, "scope")
    return {r.card_id: r for r in got.collect()}


@pytest.mark.parametrize("chunk", [1, 2, 50])
def test_unknown_rows_trip_one_breaker(spark, server, tmp_path, chunk):
    server.answers["*"] = 400
    got = collected(spark, server, tmp_path, [f"Card{k}" for k in range(8)], breaker=3, chunk=chunk)
    assert len(server.asked) == 3 and len(got) == 8 and all(r.active is None for r in got.values())


def test_malformed_answers_trip_the_breaker_too(spark, server, tmp_path):
    server.answers["*"] = {"total": "many"}
    got = collected(spark, server, tmp_path, [f"Card{k}" for k in range(8)], breaker=3)
    assert len(server.asked) == 3 and all(r.active is None for r in got.values())


def test_confirmed_zeros_do_not(spark, server, tmp_path):
    server.answers["*"] = {"total": 0}
    got = collected(spark, server, tmp_path, [f"Card{k}" for k in range(8)], breaker=3, chunk=3)
    assert len(server.asked) == 8 and all(r.active == 0 for r in got.values())


def test_cards_are_asked_in_order_of_price_within_the_calls(spark, server, tmp_path):
    server.answers["*"] = page(["a"])
    rows = cards(spark, [f"Card{k}" for k in range(6)], price=lambda k: 10.0 + k)
    got = sweep.collect_day(rows, str(tmp_path / "days"), "2026-09-26", options(server, calls=4, chunk=3), ("app", "cert"), server.base)
    assert server.asked == ["Card5", "Card4", "Card3", "Card2"]
    assert {r.card_id for r in got.collect() if r.active is not None} == {"c5", "c4", "c3", "c2"}


def test_all_pages_count(spark, server, tmp_path):
    server.answers["*"] = [page(["a", "b"]), page(["c"])]
    got = collected(spark, server, tmp_path, [f"Card{k}" for k in range(5)], pages=2, page_size=2, calls=7, chunk=2)
    assert len(server.asked) == 6 and [r.active for _, r in sorted(got.items())] == [3, 3, 3, None, None]


def test_time_ends_a_sweep(spark, server, tmp_path):
    server.answers["*"] = page(["a"])
    assert all(r.active is None for r in collected(spark, server, tmp_path, ["One", "Two"], seconds=-1).values()) and not server.asked


def test_error_empty_and_normal_end_to_end(spark, server, tmp_path):
    path = str(tmp_path / "days")
    yesterday = [("2026-09-25", "c0", 3, 50.0, ["a", "b", "c"]), ("2026-09-25", "c1", 2, 50.0, ["x", "y"]), ("2026-09-25", "c2", 2, 50.0, ["p", "q"])]
    DatedTable(path).write(spark.createDataFrame(yesterday, "date string, card_id string, active int, average double, item_ids array<string>"))
    server.answers |= {"Erroring": 500, "Empty": {"total": 0}, "Normal": page(["q", "r"])}
    got = collected(spark, server, tmp_path, ["Erroring", "Empty", "Normal"])
    flow = lambda r: (r.active, r.new_listings, r.ended_listings, r.est_sold, r.est_unsold)
    assert [flow(got[c]) for c in ("c0", "c1", "c2")] == [(None,) * 5, (0, 0, 2, 1, 1), (2, 1, 1, 1, 0)]
    # The next day is not compared with the unknown one, and a day apart is not compared at all.
    server.answers["*"] = page(["a"])
    server.answers.pop("Erroring")
    later = collected(spark, server, tmp_path, ["Erroring", "Empty", "Normal"], day="2026-09-27")
    assert flow(later["c0"]) == (1, None, None, None, None)
    assert flow(collected(spark, server, tmp_path, ["Erroring", "Empty", "Normal"], day="2026-09-30")["c2"])[1:] == (None,) * 4


def test_without_a_key_a_day_is_kept(spark, server, tmp_path):
    server.answers["*"] = page(["a"])
    first = collected(spark, server, tmp_path, ["One", "Two"])
    kept = sweep.collect_day(cards(spark, ["One", "Two", "Three"]), str(tmp_path / "days"), "2026-09-26")
    assert {r.card_id: r.active for r in kept.collect()} == {c: r.active for c, r in first.items()}
    neutral = sweep.collect_day(cards(spark, ["One", "Two"]), str(tmp_path / "days"), "2026-09-28")
    assert [(r.active, r.item_ids) for r in neutral.collect()] == [(None, None)] * 2
    server.token = False
    refused = collected(spark, server, tmp_path, ["One"], day="2026-09-29")
    assert refused["c0"].active is None and len(server.asked) == 2


def test_a_sweep_that_starts_again_spends_nothing_twice(server):
    server.answers["*"] = page(["a"])
    reader = SweepReader(options(server, queries="A\nB\nC", chunk=2))
    rows, at = reader.read(reader.initialOffset())
    assert [(k, q) for k, q, _, _ in rows] == [(0, "A"), (1, "B")] and (at["place"], at["calls"]) == (2, 2)
    again = SweepReader(options(server, queries="A\nB\nC", chunk=2))
    assert list(again.readBetweenOffsets(reader.initialOffset(), at)) == [(0, "A", 1, None), (1, "B", 1, None)] and server.asked == ["A", "B"]
    rows, end = again.read(at)
    assert len(list(rows)) == 1 and server.asked == ["A", "B", "C"] and again.read(end)[1] == end


def test_batch_reads_have_one_budget_too(monkeypatch):
    asked = []

    def fetch(url, *a):
        asked.append(url)
        raise OSError("no answer")

    monkeypatch.setattr(rest, "fetch", fetch)
    for parallel in ("1", "8", "0"):
        asked.clear()
        reader = rest.PagedReader({"url": "{query}", "queries": "\n".join("abcdefgh"), "on_failure": "unknown", "whole": "true", "breaker": "3", "parallel": parallel})
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        assert len(asked) == 3 and len(rows) == 8
    monkeypatch.setattr(rest, "fetch", lambda url, *a: asked.append(url) or {"data": [1] * (2 if url.endswith("1") or url.endswith("2") else 0)})
    asked.clear()
    pages = rest.PagedReader({"url": "{query}/{page}", "queries": "a\nb\nc", "page_size": "2", "calls": "4", "parallel": "8", "on_failure": "unknown"})
    assert [r[2] for p in pages.partitions() for r in pages.read(p)].count(None) == 1 and len(asked) == 6  # three pages each, the third query finds the calls spent


@pytest.mark.parametrize(
    ("body", "first", "want"),
    [({"total": 0}, True, True), ({"total": 3, "itemSummaries": []}, True, False), ({"total": 3, "itemSummaries": []}, False, True), ({"total": True}, True, False), ([], True, False),
     (page(["a"]), True, True), (page(["a"], "-1"), True, False), (page(["a"], "nan"), True, False), ({"total": 1, "itemSummaries": ["x"]}, True, False), ({"total": 1.0}, True, False)],
)
def test_says_something(body, first, want):
    assert says_something(body, first, "itemSummaries") is want


def test_interest_goes_on_where_it_broke_off(spark, server, tmp_path):
    from tarnwick.plans import interest

    days = [f"2026-01-{d:02d}" for d in range(1, 11)]
    names = [f"Mon{k}" for k in range(6)]
    rows = spark.createDataFrame([(f"c{k}", n, "Pokémon", 50.0 - k) for k, n in enumerate(names)] + [("c9", "Anchor", "Pokémon", 900.0)], "card_id string, base_name string, supertype string, market_price double")

    def answer(terms, value=10):
        return {"Anchor": dict.fromkeys(days, 100), **{t: dict.fromkeys(days, value) for t in terms}}

    first, second = "Anchor,Mon0,Mon1,Mon2,Mon3", "Anchor,Mon4,Mon5"
    server.answers |= {first: answer(names[:4]), second: 503}
    run = lambda day: {r.name: r for r in interest.collect_interest(rows, str(tmp_path / "i"), options(server, retries=2), "Anchor", run=day).collect()}
    got = run("2026-02-01")
    assert server.asked == [first, second, second] and set(got) == {"Anchor", *names[:4]}  # the failing batch is tried twice
    assert got["Mon0"].score == 6.0 and got["Anchor"].score == 10.0 and len(got["Mon0"].weekly) == 10
    server.asked.clear()
    server.answers[second] = answer(names[4:], 1)
    assert set(run("2026-02-01")) == {"Anchor", *names} and server.asked == [second]
    server.asked.clear()
    done = run("2026-02-02")
    assert not server.asked and done["Mon5"].score == 2.0


def test_an_answer_without_the_anchor_scores_nothing(spark, server, tmp_path):
    from tarnwick.plans import interest

    rows = spark.createDataFrame([("c", "Mew", "Pokémon", 5.0)], "card_id string, base_name string, supertype string, market_price double")
    server.answers["*"] = {"Mew": {"2026-01-01": 5}}
    got = interest.collect_interest(rows, str(tmp_path / "i"), options(server), "Anchor")
    assert got.count() == 0 and len(server.asked) == 1
