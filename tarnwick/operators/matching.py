"""Matching a catalogue to products by number with a scored tie-break, and by exact name where that fails."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick import constants as C
from tarnwick.functions import text


def names_agree(a, b):
    """Either folded name contains the other; empty names agree with nothing."""
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def _keys(first: dict[str, Column], tier: Column, whole: Column) -> Column:
    """The look-up keys of a row: by number and by name, each alone, with the tier, with the whole name, and with both.

    A key with an empty part is left out, since nothing agrees with nothing.
    """
    out = []
    for kind, main in first.items():
        for part, (t, w) in {"": (False, False), "t": (True, False), "w": (False, True), "tw": (True, True)}.items():
            there = main.isNotNull() & (main != "") & ((tier != "") if t else F.lit(True)) & ((whole != "") if w else F.lit(True))
            key = F.struct(F.lit(kind + part).alias("kind"), main.alias("main"), (tier if t else F.lit("")).alias("tier"), (whole if w else F.lit("")).alias("whole"))
            out.append(F.when(there, key))
    return F.array_compact(F.array(*out))


def match_products(cards: DataFrame, products: DataFrame) -> DataFrame:
    """Rows (card_id, group_id, product_id, how, candidates): ``number``, ``name`` or null where nothing fits.

    ``cards``: card_id, group_id, number, name, rarity.  ``products``: product_id, group_id, number, name, rarity,
    position.  Candidates share group and number.  The best has the card's tier (both known, whatever their case), then
    no parenthesis in its name, then no word for another printing, then the card's whole name, then comes first.  It
    counts only if the folded names agree; otherwise the best of those with the card's folded name is taken, and
    failing that the one with the number.

    Products are reduced before they meet a card: of all that agree in a look-up key only the best can be chosen, so
    each key keeps that one.  A card has eight keys at most and so meets eight rows at most, however many products share
    its number or its name.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    number, name, tier = text.card_number(F.col("number")), low(F.col("name")), low(F.col("rarity"))
    folded, base = text.folded(F.col("name")), text.product_base(F.col("name"))
    other = functools.reduce(operator.or_, [name.contains(m) for m in C.OTHER_PRINTINGS])
    key = ["group_id", "key.kind", "key.main", "key.tier", "key.whole"]
    on = ["group_id", "kind", "main", "tier", "whole"]

    # The parts of the keys are columns first, as each is in several keys and folding a name costs more than all the rest.
    parts = [number.alias("__number"), name.alias("__low"), tier.alias("__tier")]
    keyed = lambda folded: _keys({"number": F.col("__number"), "name": F.col(folded)}, F.col("__tier"), F.col("__low"))
    p = products.select("product_id", "group_id", "position", base.alias("pname"), F.struct(name.contains("(").alias("paren"), other.alias("other")).alias("plain"), *parts)
    p = p.withColumn("key", F.explode(keyed("pname")))
    best = p.select(*key, F.struct("plain", "position", "product_id", "pname").alias("row")).groupBy(*on).agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("times"))

    c = cards.select("card_id", "group_id", folded.alias("__name"), *parts).select("card_id", "group_id", "__name", keyed("__name").alias("keys"))
    asked = c.select("card_id", "group_id", F.explode("keys").alias("key")).select("card_id", *key)
    of = lambda kind, column="row": F.max(F.when(F.col("kind") == kind, F.col(column)))
    kinds = [k + part for k in ("number", "name") for part in ("", "t", "w", "tw")]
    met = asked.join(best, on).groupBy("card_id").agg(*[of(k).alias(k) for k in kinds], of("number", "times").alias("candidates"))

    def chosen(kind: str) -> Column:
        pick = lambda any_, whole: F.when(F.col(f"{whole}.plain") == F.col(f"{any_}.plain"), F.col(whole)).otherwise(F.col(any_))
        return F.when(F.col(kind + "t").isNotNull(), pick(kind + "t", kind + "tw")).otherwise(pick(kind, kind + "w"))

    out = c.drop("keys").join(met.select("card_id", "candidates", chosen("number").alias("best"), chosen("name")["product_id"].alias("__named")), "card_id", "left")
    fits = F.coalesce(names_agree(F.col("__name"), F.col("best.pname")), F.lit(False))
    product = F.when(fits, F.col("best.product_id")).otherwise(F.coalesce("__named", "best.product_id"))
    how = F.when(fits, "number").when(F.col("__named").isNotNull(), "name").when(F.col("best").isNotNull(), "number")
    return out.select("card_id", "group_id", product.alias("product_id"), how.alias("how"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"))


def coverage(matches: DataFrame) -> DataFrame:
    """Rows per group: matched, total, those fixed by name and those with several candidates of their number."""
    return matches.groupBy("group_id").agg(
        F.count("product_id").alias("matched"), F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("how") == "name", 1)).alias("name_fixed"),
        F.count(F.when((F.col("candidates") > 1) & F.col("product_id").isNotNull(), 1)).alias("ambiguous"),
    )


def unmatched(cards: DataFrame, matches: DataFrame) -> DataFrame:
    return cards.join(matches.where("product_id is not null").select("card_id"), "card_id", "left_anti")


def subtype_price(wanted: DataFrame, prices: DataFrame, preferred: list[str]) -> DataFrame:
    """Rows (card_id, price): the product's price of the wanted subtype, else of the first preferred one, else of any."""
    order = F.array_position(F.array(*map(F.lit, preferred)), F.col("subtype"))
    rank = F.when(F.col("subtype") == F.col("wanted"), 0).when(order > 0, order.cast("int")).otherwise(len(preferred) + 1)
    rows = wanted.join(prices.where("price is not null"), "product_id").withColumn("__rank", rank)
    return rows.groupBy("card_id").agg(F.min(F.struct("__rank", "subtype", "price"))["price"].alias("price"))


def fill_gaps(cards: DataFrame, backup: DataFrame) -> DataFrame:
    """Prices from a second source by set and normal number, only for sets of which no card has a price."""
    priced = cards.groupBy("set_id").agg(F.bool_or(F.col("market_price").isNotNull()).alias("__any")).withColumnRenamed("set_id", "__set")
    rows = cards.join(priced, F.col("set_id").eqNullSafe(F.col("__set"))).drop("__set").withColumn("__num", text.plain_number(F.col("number")))
    b = backup.select("set_id", text.plain_number(F.col("number")).alias("__num"), F.col("price").alias("__backup")).groupBy("set_id", "__num").agg(F.min("__backup").alias("__backup"))
    out = rows.join(b, ["set_id", "__num"], "left")
    price = F.when(F.col("__any"), F.col("market_price")).otherwise(F.coalesce("market_price", "__backup"))
    source = F.when(F.col("market_price").isNull() & price.isNotNull(), "backup").when(price.isNotNull(), "primary")
    return out.withColumns({"market_price": price, "price_source": source}).drop("__any", "__num", "__backup")
