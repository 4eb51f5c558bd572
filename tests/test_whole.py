"""Queries over all cards, against plain loops over the same views."""

from __future__ import annotations

from tarnwick.plans.queries import QUERIES
from tarnwick.plans.testmap import view

SF = "/root/testdata/sf0.01"


def test_carried_portfolio_has_all_cards(spark):
    points = sorted((str(r.date), r.card_id, r.price) for r in view(spark, SF, "panel").select("date", "card_id", "price").collect() if r.price is not None)
    last, want = {}, {}
    for date, card, price in points:
        last[card] = price
        want[date] = sum(last.values())
    got = {str(r.date): r.total for r in QUERIES["carried_portfolio"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(float(got[d]) - float(want[d])) < 0.01 for d in want)


def test_portfolio_watches_all_cards(spark):
    cards = view(spark, SF, "cards").collect()
    got = QUERIES["portfolio_totals"](spark, SF).first()
    assert got.n_cards == len(cards) and abs(float(got.value) - sum(float(r.market_price or 0) for r in cards)) < 0.01


def test_subtype_prices_are_of_all_cards(spark):
    names, best = ["Normal", "Holofoil", "Reverse Holofoil"], {}
    cards = [(r.card_id, float(r.market_price)) for r in view(spark, SF, "cards").collect() if r.market_price is not None]
    subtype = lambda i: ["Holofoil"] * 3 + ["Normal"] * 3 + ["Reverse Holofoil"] * 3 + ["Foil"] * 2
    for i, price in cards:
        key = i // 5, subtype(i)[i * 7919 % 11]
        best[key] = max(price, best.get(key, price))
    first = lambda i: [best[i // 5, n] for n in (names[i % 3], "Holofoil", "Normal") if (i // 5, n) in best]
    rest = lambda i: [best[i // 5, n] for n in ("Foil", "Reverse Holofoil") if (i // 5, n) in best]
    want = {i: (first(i) or rest(i))[0] for i, _ in cards}
    got = {r.card_id: r.price for r in QUERIES["subtype_price"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(float(got[i]) - want[i]) < 1e-6 for i in want)
