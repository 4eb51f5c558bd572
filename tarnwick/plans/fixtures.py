"""Literal inputs and what must come out of them, worked out by hand from the rules and not from the code.

The tests run the rules over them; some registered queries have them next to the rows of the tables.
"""

from __future__ import annotations

import json

CARD = "card_id long, group_id string, number string, name string, rarity string"
PRODUCT = "product_id long, group_id string, number string, name string, rarity string, position long"

MATCH_CARDS = [
    (-1, "fx", "25", "Pikachu", "Rare"), (-2, "fx", "26", "Mew", "Rare"), (-3, "fx", "27", "Eevee", "Rare"), (-4, "fx", "28", "Snorlax", None),
    (-5, "fx", "29", "Gengar ex", "Double Rare"), (-6, "fx", "30", "Ditto", "Rare"), (-7, "fx", "31", "Onix", "Rare"), (-8, "fx", "", "Abra", "Common"),
    (-9, "fx", "32", "Zubat", "Rare"), (-10, "fx", "007/165", "Flabébé", "Rare"), (-11, "fx", "33", "Bubbly Water", "Uncommon"),
]
MATCH_PRODUCTS = [
    (1, "fx", "25", "Pikachu Jumbo", "Rare", 1), (2, "fx", "025/165", "Pikachu - 025/165", "Rare", 2),
    (3, "fx", "26", "Mew (Poke Ball Pattern)", "Rare", 3), (4, "fx", "26", "Mew", "rare", 4),
    (5, "fx", "27", "Eevee", None, 5), (6, "fx", "27", "Eevee (Holo)", "Rare", 6),
    (7, "fx", "28", "Snorlax", None, 7), (8, "fx", "28", "Snorlax", "Rare", 8),
    (9, "fx", "29", "Gengar", "Double Rare", 9), (10, "fx", "29", "Gengar ex", "Double Rare", 10),
    (11, "fx", "30", "Metapod", "Rare", 11), (12, "fx", "099/165", "Ditto - 099/165", "Common", 12), (13, "fx", "98", "Ditto (Promo)", "Rare", 13),
    (14, "fx", "31", "Geodude", "Rare", 14), (15, "fx", "77", "Abra (Reverse)", "Common", 15), (16, "fx", "7", "Flabebe - 007/165", "Rare", 16),
    (17, "fx", "33", "Bubbly W", "Uncommon", 17), (18, "ot", "32", "Zubat", "Rare", 18),
]
#: (card_id, product_id, how, candidates)
MATCH_WANT = [
    (-1, 2, "number", 2),  # a word for another printing loses
    (-2, 4, "number", 2),  # tiers agree whatever their case, then no parenthesis
    (-3, 6, "number", 2),  # a product without a tier does not have the card's
    (-4, 7, "number", 2),  # a card without a tier agrees with none; first of equals
    (-5, 10, "number", 2),  # the whole name
    (-6, 13, "name", 1),  # the number is another card's; of the name's products the one of the tier
    (-7, 14, "number", 1),  # the number is another card's, but nothing has the name
    (-8, 15, "name", 0),
    (-9, None, None, 0),  # other group
    (-10, 16, "number", 1),
    (-11, 17, "number", 1),  # one name within the other
]


def _item(id_, price, title="card", currency="USD"):
    return {"itemId": id_, "title": title, "price": {"value": price, "currency": currency}}


def _page(total, *items, **more):
    return json.dumps({**more, "total": total, "itemSummaries": list(items)})


PAGE = "key long, page int, market double, body string"
PAGES = [
    (-1, 1, None, _page(6, *[_item(f"a{k}", p) for k, p in enumerate(["10", "10.00", "9", "11", "10", "5000"])])),
    (-2, 1, 100.0, _page(5, *[_item(f"b{k}", p) for k, p in enumerate(["40", "60", "100", "390", "410"])])),
    (-3, 1, 1.5, _page(2, _item("c1", "0.5"), _item("c2", "9"))),
    (-4, 1, 100.0, _page(2, _item("d1", "5"), _item("d2", "6"))),
    (-5, 1, None, _page(3, _item("e1", "1"), _item("e2", "2"))), (-5, 2, None, _page(3)),
    (-6, 1, None, _page(3, _item("f1", "1"))), (-6, 2, None, "{}"),
    (-7, 1, None, _page("2", _item("g1", "1"), meta={"total": 1})),
    (-8, 1, None, _page(2, _item("h1", "10"), _item("h1", "20"))),
    (-9, 1, None, _page(1, _item("i1", "10", currency=5))),
    (-10, 1, None, _page(1, _item("j1", 12.5))),
    (-11, 1, None, None),
    (-12, 1, None, _page(0)),
    (-13, 1, None, _page(2, _item("m1", "10", "Card PSA 10"), _item("m2", "10", currency="EUR"))),
    (-14, 1, 20.0, _page(8, *[_item(f"n{k}", p) for k, p in enumerate(["10", "20", "20", "21", "22", "79", "81", "1"])])),
    (-15, 1, None, _page(1, _item("o1", "1"), 5)),
    (-16, 1, None, _page(2)),
]
#: (key, known, active, average, number of ids)
PAGES_WANT = [
    (-1, True, 5, 10.0, 5),  # quartiles 10 and 10.75 reach from 8.875 to 11.875
    (-2, True, 3, 183.33, 3),  # the band of 100 is 50 to 400
    (-3, True, 2, 4.75, 2),  # no band below a market of 2
    (-4, True, 0, None, 0),
    (-5, True, 2, 1.5, 2),  # later pages may run out
    (-6, False, None, None, None),
    (-7, False, None, None, None),  # the total is a text; the nested one is another's
    (-8, True, 2, 15.0, 1),
    (-9, False, None, None, None),  # a currency that is no text
    (-10, True, 1, 12.5, 1),
    (-11, False, None, None, None),  # a failed request
    (-12, True, 0, None, 0),
    (-13, True, 0, None, 0),  # usable, but graded or foreign
    (-14, True, 4, 20.75, 4),  # the band leaves 10, 20, 20, 21, 22, 79; quartiles 20 and 21.75 reach from 17.375 to 24.375
    (-15, False, None, None, None),  # not a list of objects
    (-16, False, None, None, None),  # an empty first page that claims two
]
#: (set_id, pack, box, pack of the feed, box of the feed), (set_id, pack, box)
OVERLAY = [("fx1", 4.0, 100.0, 0.0, 55.0), ("fx2", 4.0, 100.0, None, 0.0), ("fx3", 4.0, 100.0, 5.0, None)]
OVERLAY_WANT = [("fx1", 4.0, 55.0), ("fx2", 4.0, 100.0), ("fx3", 5.0, 100.0)]

#: (id, price, expected, months, age in days), (id, reason, surfaced, verdict, age)
GATES = [(-1, 500.0, 100.0, 24.0, 730), (-2, 50.0, 50.0, 24.0, 730), (-3, 50.0, 10.0, 1.0, 30), (-4, 100.0, 100.0, 24.0, 90), (-5, 19.99, 10.0, 24.0, 91), (-6, None, 10.0, 24.0, 181), (-7, 20.0, 20.0, None, -3)]
GATES_WANT = [
    (-1, "chase premium the model can't price", True, "over", "180d+ (mature)"),
    (-2, "mature mid-price — model near-efficient here", False, "fair", "180d+ (mature)"),
    (-3, None, True, "over", "0-35d (fresh)"),
    (-4, None, True, "fair", "36-90d"),
    (-5, "chase premium the model can't price", True, "over", "91-180d"),
    (-6, None, None, None, "180d+ (mature)"),
    (-7, "mature mid-price — model near-efficient here", False, "fair", None),
]

#: (id, shipping, item price, price, t30, t90, t180, saturation)
DISPLAY = [
    (-1, None, 10.0, 10.0, -0.05, 0.0, 0.0, 0.90), (-2, 4.5, 20.0, 24.5, -0.03, 0.1, 0.2, 1.25), (-3, 0.0, 20.0, 20.0, 0.05, 0.10, None, 1.0),
    (-4, 4.5, None, 24.5, 0.02, 0.0, None, None), (-5, 6.0, 1234.4, 1240.4, 0.01, -0.1, None, 0.97), (-6, 1.0, 5.0, 5.0005, 0.04, -0.1, None, 1.03), (-7, 1.0, 5.0, 6.0, None, 0.2, 0.2, 2.0),
]
#: (id, shipping, trajectory, saturation)
DISPLAY_WANT = [
    (-1, "+ ship not listed", "Falling", "tightening −10%"), (-2, "$20 + $5 ship", "Cooling after run", "loosening +25%"), (-3, "free ship", "Accelerating ↑", "steady"),
    (-4, "free ship", "Steady ↑", "—"), (-5, "$1,234 + $6 ship", "Flat / digesting", "steady"), (-6, "free ship", "Choppy", "steady"), (-7, "$5 + $1 ship", None, "loosening +100%"),
]

#: (id, variants with their price, European average), (id, price, variant)
SECOND = [
    (-1, {"normal": 2.0, "holofoil": 5.004}, 9.0), (-2, {"normal": 0.0, "reverse-holofoil": 3.0}, 9.0), (-3, {"odd": 7.0}, 9.0), (-4, {"normal": 0.0}, 10.0), (-5, {}, None), (-6, {"normal": None}, 0.0),
]
SECOND_WANT = [(-1, 5.0, "tcgplayer:holofoil"), (-2, 3.0, "tcgplayer:reverse-holofoil"), (-3, 7.0, "tcgplayer:odd"), (-4, 10.8, "cardmarket:avg(EUR->USD)"), (-5, None, None), (-6, None, None)]

#: (id, name, supertype, number), (id, base name, folded, number, plain number)
NAMES = [
    (-1, "Team Rocket's Moltres ex", "Pokémon", "007/165"), (-2, "Morty's Conviction", "Trainer", "TG01/TG30"), (-3, "V VMAX", "Pokémon", "000"), (-4, " Ｐikaﬁ  ½ VSTAR V", "Pokémon", " sv12 "),
    (-5, "Flabébé", "Pokémon", ""), (-6, "Zoë Ångström Łódź", "Trainer", "0A1"),
]
NAMES_WANT = [
    (-1, "Moltres", "teamrocketsmoltresex", "7", "7/165"), (-2, "Morty's Conviction", "mortysconviction", "TG01", "TG01/TG30"), (-3, "V VMAX", "vvmax", "0", "0"),
    (-4, "Ｐikaﬁ ½", "pikafi12vstarv", "SV12", "SV12"), (-5, "Flabébé", "flabebe", None, "0"), (-6, "Zoë Ångström Łódź", "zoeangstromodz", "0A1", "A1"),
]

#: (batch, term, date, value): days without the anchor say nothing
INTEREST = [
    *[(1, "Anchor", f"2024-01-{d:02d}", v) for d, v in enumerate([50, 100, 0, 100, 100, 100, 100, 100, 100, 100], 1)],
    *[(1, "Mew", f"2024-01-{d:02d}", v) for d, v in enumerate([50, 90, 7, 10, 10, 10, 10, 10, 10, 10], 1)],
    (2, "Anchor", "2024-01-01", 0), (2, "Onix", "2024-01-01", 5),
]
#: (name, score, number of days): Mew's last eight are 0.9 once and 0.1 seven times, so 0.2; log10 of it is -0.69897
INTEREST_WANT = [("Anchor", 10.0, 0), ("Mew", 7.204, 9), ("Onix", 0.0, 0)]


def sql_value(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return f"{x!r}::DOUBLE" if isinstance(x, float) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A subquery of literal rows."""
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in rows) + f") v({names}))"

