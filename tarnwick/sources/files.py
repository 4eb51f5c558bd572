"""Readers and writers of the domain's files: dated JSON maps, landed pages, catalogues, logs.

Schemas are declared, never inferred; what does not parse becomes null and is dropped where the rules say so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick import constants as C
from tarnwick.functions import scores, text
from tarnwick.operators.sealed import base_rates

PRICES = "map<string,double>"
LISTING = "struct<active_listings:int,avg_price:double,item_ids:array<string>>"
ITEMS = "array<struct<id:string,price:double>>"
SUMMARIES = "array<struct<itemId:string,title:string,price:struct<value:string,currency:variant>>>"
PRODUCT = "struct<product:string,price:double,change_24h:double,sold_today:int,listings:int>"

RAW_CARD = (
    "id string, name string, supertype string, number string, rarity string, set struct<id:string,name:string,series:string,releaseDate:string>, "
    "images struct<small:string,large:string>, nationalPokedexNumbers array<int>, tcgplayer struct<prices:map<string,struct<market:double>>,updatedAt:string>"
)


def dated_maps(spark: SparkSession, path: str, prefix: str, value: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Rows (date, key, value) from files ``<prefix>-YYYY-MM-DD.json`` that each hold a JSON map.

    The date is in the file's name.  Files without a date or with broken JSON, and empty maps, give no rows.  ``since``
    and ``until`` are constant dates, both included: they are asked of the file's name, so that Spark leaves the other
    files out before it opens any.
    """
    named = lambda day: F.concat(F.lit(f"{prefix}-"), day.cast("date").cast("string"), F.lit(".json"))
    name = F.col("_metadata.file_name")
    raw = spark.read.text(path, wholetext=True).where(name.startswith(f"{prefix}-"))
    if since is not None:
        raw = raw.where(name >= named(since))
    if until is not None:
        raw = raw.where(name <= named(until))
    raw = raw.select("value", name.alias("file"))
    day = F.try_to_date(F.regexp_extract("file", rf"{prefix}-(\d{{4}}-\d{{2}}-\d{{2}})\.json$", 1), "yyyy-MM-dd")
    parsed = raw.select(day.alias("date"), F.from_json("value", f"map<string,{value}>", {"mode": "PERMISSIVE"}).alias("m"))
    return parsed.where("date is not null and m is not null").select("date", F.explode("m").alias("key", "value"))


def price_panel(spark: SparkSession, path: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Rows (date, card_id, price) without null prices."""
    rows = dated_maps(spark, path, "price", "double", since, until)
    return rows.where("value is not null").select("date", F.col("key").alias("card_id"), F.col("value").alias("price"))


def price_history(spark: SparkSession, path: str, as_of: Column | None = None, since: Column | None = None) -> DataFrame:
    """Dated price snapshots up to ``as_of`` with prices that read as positive numbers."""
    rows = dated_maps(spark, path, "snapshot", "string", since, as_of)
    return rows.select("date", F.col("key").alias("card_id"), F.col("value").try_cast("double").alias("price")).where(F.col("price") > 0)


def listing_history(spark: SparkSession, path: str, as_of: Column | None = None, prefix: str = "ebay", since: Column | None = None) -> DataFrame:
    """Rows (date, card_id, active, average, item_ids) of daily listing snapshots up to ``as_of``; null rows stay."""
    rows = dated_maps(spark, path, prefix, LISTING, since, as_of).where("value is not null")
    return rows.select("date", F.col("key").alias("card_id"), F.col("value.active_listings").alias("active"), F.col("value.avg_price").alias("average"), F.col("value.item_ids").alias("item_ids"))


def variant_price(prices: Column) -> Column:
    """The market price of the first variant in the order of preference that is not 0, else of any."""
    listed = [F.nullif(prices[v]["market"], F.lit(0.0)) for v in C.VARIANTS]
    rest = F.try_element_at(F.filter(F.transform(F.map_values(prices), lambda v: v["market"]), lambda m: m.isNotNull() & (m != 0)), F.lit(1))
    return F.coalesce(*listed, rest)


def variant_used(prices: Column) -> Column:
    listed = [F.when(F.nullif(prices[v]["market"], F.lit(0.0)).isNotNull(), F.lit(v)) for v in C.VARIANTS]
    rest = F.try_element_at(F.map_keys(F.map_filter(prices, lambda k, v: v["market"].isNotNull() & (v["market"] != 0))), F.lit(1))
    return F.coalesce(*listed, rest)


def normal_cards(raw: DataFrame) -> DataFrame:
    """The flat card table from nested source records; tiers that the source has wrong are corrected."""
    supertype = F.coalesce("supertype", F.lit("Pokémon"))
    corrected = F.element_at(F.create_map(*[F.lit(x) for pair in C.TIER_CORRECTIONS.items() for x in pair]), F.col("id"))
    prices = F.col("tcgplayer.prices")
    return raw.select(
        "id", "name", text.base_name(F.col("name"), supertype).alias("base_name"), supertype.alias("supertype"), "number", F.coalesce(corrected, F.nullif(F.col("rarity"), F.lit("")), F.lit("Unknown")).alias("rarity"),
        F.col("set.id").alias("set_id"), F.col("set.name").alias("set_name"), F.col("set.series").alias("series"), text.slash_date(F.col("set.releaseDate")).alias("release_date"),
        F.col("images.small").alias("image_small"), F.col("images.large").alias("image_large"), variant_price(prices).alias("market_price"), variant_used(prices).alias("price_variant"),
        F.col("tcgplayer.updatedAt").alias("price_updated"), F.try_element_at("nationalPokedexNumbers", F.lit(1)).alias("dex"),
    )


def cards(spark: SparkSession, path: str) -> DataFrame:
    return normal_cards(spark.read.schema(RAW_CARD).json(path))


def secondary_price(listed: Column, average_eur: Column, updated: Column, updated_eur: Column) -> Column:
    """A struct (price, variant, updated) of the second price source: the first variant in the order of preference with
    a price, else any, else the European average in dollars; all null where there is none.

    ``listed`` is a map from variant to a struct with ``marketPrice``; prices of 0 are none.
    """
    price = lambda v: F.nullif(F.element_at(listed, v)["marketPrice"], F.lit(0.0))
    some = F.map_keys(F.map_filter(listed, lambda _, v: F.coalesce(v["marketPrice"] != 0, F.lit(False))))
    variant = F.coalesce(*[F.when(price(F.lit(v)).isNotNull(), F.lit(v)) for v in C.SECOND_VARIANTS], F.try_element_at(some, F.lit(1)))
    parts = lambda p, v, u: F.struct(F.round(p, 2).alias("price"), v.alias("variant"), u.alias("updated"))
    none = parts(F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    first = F.when(variant.isNotNull(), parts(price(variant), F.concat(F.lit("tcgplayer:"), variant), updated))
    second = F.when(F.coalesce(average_eur != 0, F.lit(False)), parts(average_eur * C.EUR_USD, F.lit("cardmarket:avg(EUR->USD)"), updated_eur))
    return F.coalesce(first, second, none)


def secondary_prices(spark: SparkSession, path: str) -> DataFrame:
    """Rows (number, price, variant, updated) of landed records of the second source, priced ones only."""
    schema = (
        "localId string, pricing struct<tcgplayer:struct<updated:string,holofoil:struct<marketPrice:double>,`reverse-holofoil`:struct<marketPrice:double>,"
        "normal:struct<marketPrice:double>,`first-edition-holofoil`:struct<marketPrice:double>>,cardmarket:struct<updated:string,avg:double>>, body string"
    )
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "body").json(path).where("localId is not null")
    shop, market = F.col("pricing.tcgplayer"), F.col("pricing.cardmarket")
    listed = F.map_filter(F.create_map(*[x for v in C.SECOND_VARIANTS for x in (F.lit(v), shop[v])]), lambda _, v: v.isNotNull())
    rows = raw.select(text.plain_number(F.col("localId")).alias("number"), secondary_price(listed, market["avg"], shop["updated"], market["updated"]).alias("p"))
    return rows.select("number", "p.*").where("price is not null")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once for each row.

    A column that is mentioned within a lambda is made again for each element of its array, and again for each mention.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def page_items(json: Column, first: Column) -> Column:
    """The usable items of one page that count, as an array of (id, price); null for a page that says nothing.

    A page is valid if its total is a whole number (as JSON, not a string, float or boolean) and at least 0, its items
    are a list of objects, a first page without items has total 0, and otherwise some item is usable.  Graded and
    foreign items are usable but not counted, so a page of only those is a confirmed 0.
    """
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    text_of = lambda v: F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))

    def pairs(page: Column, items: Column, listed: Column) -> Column:
        part = F.try_variant_get(page, "$.total", "variant")
        total = F.when(kind(part) == "BIGINT", F.try_variant_get(part, "$", "bigint"))
        usable = F.filter(listed, lambda i: scores.usable_listing(i["id"], i["value"], i["currency"]))
        counts = lambda i: (i["currency"] == "USD") & ~F.coalesce(text.is_graded(i["title"]), F.lit(False))

        def found(usable: Column) -> Column:
            valid = (total >= 0) & F.forall(items, lambda i: i.isNotNull()) & F.when(F.size(items) == 0, (total == 0) | ~first).otherwise(F.size(usable) > 0)
            rows = F.transform(F.filter(usable, counts), lambda i: F.struct(i["id"].alias("id"), i["value"].cast("double").alias("price")))
            return F.when(F.coalesce(valid, F.lit(False)), rows)

        return once(usable, found)

    def of_page(page: Column) -> Column:
        # One cast takes the fields out of all items; what is no object is null in it.  Only a page without a list is asked what it has.
        none = F.when(kind(F.try_variant_get(page, "$.itemSummaries", "variant")) == "VOID", F.array().cast(SUMMARIES))
        items = F.coalesce(F.try_variant_get(page, "$.itemSummaries", SUMMARIES), none)
        flat = lambda i: F.struct(i["itemId"].alias("id"), i["title"].alias("title"), i["price"]["value"].alias("value"), text_of(i["price"]["currency"]).alias("currency"))
        return once(items, lambda items: once(F.transform(items, flat), lambda listed: pairs(page, items, listed)))

    return once(F.try_parse_json(json), of_page)


def survivors(items: Column, market: Column) -> Column:
    """The items within the price band of the card's market price, then within the quartiles widened by 1.5 times their
    distance (four items at least, and never all trimmed)."""
    banded = F.filter(items, lambda i: F.coalesce(scores.in_price_band(i["price"], market), F.lit(True)))

    def trimmed(rows: Column) -> Column:
        n = F.size(rows)

        def bounds(prices: Column) -> Column:
            def quantile(q: float) -> Column:
                at = F.lit(q) * (n - 1)
                low = F.floor(at).cast("int")
                return F.get(prices, low) * (1 - (at - low)) + F.get(prices, F.least(low + 1, n - 1)) * (at - low)

            q1, q3 = quantile(0.25), quantile(0.75)
            return F.struct((q1 - 1.5 * (q3 - q1)).alias("low"), (q3 + 1.5 * (q3 - q1)).alias("high"))

        limits = once(F.sort_array(F.transform(rows, lambda i: i["price"])), bounds)
        kept = once(limits, lambda b: F.filter(rows, lambda i: i["price"].between(b["low"], b["high"])))
        return once(kept, lambda kept: F.when((n < 4) | (F.size(kept) == 0), rows).otherwise(kept))

    return once(banded, trimmed)


def observations(pages: DataFrame, keys: list[str], json: str = "body", page: str | None = None, market: str | None = None) -> DataFrame:
    """Listing pages as observations: rows (keys, known, active, average, item_ids).

    ``page`` numbers the pages of a key (its least is the first; without it each key has one page), ``market`` holds the
    card's market price.  A key with any page that says nothing, or none at all, is unknown: null, never 0.  The items of
    all pages are banded by the market price and trimmed by quartiles; what survives is counted, averaged to cents and
    listed by id.
    """
    number = F.lit(0) if page is None else F.col(page)
    first = F.lit(True) if page is None else number == F.min(number).over(Window.partitionBy(*keys))
    price = F.lit(None).cast("double") if market is None else F.col(market).cast("double")
    rows = pages.select(*keys, number.alias("__page"), price.alias("__market"), first.alias("__first"), F.col(json).alias("__json"))
    rows = rows.select(*keys, "__page", "__market", page_items(F.col("__json"), F.col("__first")).alias("__items"))
    if page is not None:  # a key's pages are bounded by the source's page limit
        all_ = F.array_sort(F.collect_list(F.struct("__page", F.coalesce("__items", F.array().cast(ITEMS)).alias("items"))))
        rows = rows.groupBy(*keys).agg(F.bool_and(F.col("__items").isNotNull()).alias("__known"), F.max("__market").alias("__market"), all_.alias("__all"))
        rows = rows.withColumn("__items", F.when(F.col("__known"), F.flatten(F.transform("__all", lambda p: p["items"]))))
    kept = rows.select(*keys, survivors(F.col("__items"), F.col("__market")).alias("__kept"))
    n, total = F.size("__kept"), F.aggregate("__kept", F.lit(0.0), lambda sum_, i: sum_ + i["price"])
    known = F.col("__kept").isNotNull()
    return kept.select(
        *keys, known.alias("known"), F.when(known, n).alias("active"), F.when(n > 0, scores.fixed(total / n, 2).cast("double")).alias("average"),
        F.when(known, F.sort_array(F.array_distinct(F.transform("__kept", lambda i: i["id"])))).alias("item_ids"),
    )


def populations(raw: DataFrame) -> DataFrame:
    """Graded populations: rows (id, total, g10, g9, rate) from ``id, total, g10, g9``; no rate without a total."""
    total, tens = F.coalesce("total", F.lit(0)), F.coalesce("g10", F.lit(0))
    return raw.select("id", total.alias("total"), tens.alias("g10"), F.coalesce("g9", F.lit(0)).alias("g9"), F.round(F.try_divide(tens.cast("double"), total.cast("double")), 4).alias("rate"))


def spec_map(spark: SparkSession, path: str) -> DataFrame:
    """Rows (id, spec) from ``{"cards": {id: spec}}`` or a flat map; only specs of digits."""
    raw = spark.read.text(path, wholetext=True).select("value")
    m = F.coalesce(F.from_json("value", "struct<cards:map<string,string>>")["cards"], F.from_json("value", "map<string,string>"))
    return raw.select(F.explode(m).alias("id", "spec")).where(F.col("spec").rlike(r"^\d+$"))


def or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A side file, or no rows where it is missing; records that are broken or of another shape are left out."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def price_status(spark: SparkSession, path: str) -> DataFrame:
    """One row ``prices_as_of`` of the freshness record; null where the file is missing, broken or no object."""
    raw = or_empty_text(spark, path)
    found = F.get_json_object("value", "$.prices_as_of")
    return raw.agg(F.max(F.when(F.ltrim("value").startswith("{") & F.try_parse_json("value").isNotNull(), found)).alias("prices_as_of"))


def population_file(spark: SparkSession, path: str) -> DataFrame:
    """Rows (id, total, g10, g9, rate, spec, fetched) of a population file; none where it is missing or of another shape."""
    kind = "struct<cards:map<string,struct<total:long,psa10:long,psa9:long,psa10_rate:double,spec:long,fetched:string>>>"
    rows = or_empty_text(spark, path).select(F.explode(F.from_json("value", kind)["cards"]).alias("id", "p"))
    return rows.where("p is not null").select("id", F.col("p.total").alias("total"), F.col("p.psa10").alias("g10"), F.col("p.psa9").alias("g9"), F.col("p.psa10_rate").alias("rate"), "p.spec", F.try_to_date("p.fetched", "yyyy-MM-dd").alias("fetched"))


def population_answers(answers: DataFrame, today: Column) -> DataFrame:
    """Rows of ``population_file`` from answers (id, spec, body); failed and unreadable ones (null) are left out."""
    pop = F.from_json("body", "struct<PSAPop:struct<Total:long,Grade10:long,Grade9:long>>")
    good = answers.where(F.try_parse_json("body").isNotNull())
    made = populations(good.select("id", "spec", pop["PSAPop"]["Total"].alias("total"), pop["PSAPop"]["Grade10"].alias("g10"), pop["PSAPop"]["Grade9"].alias("g9")))
    return made.join(good.select("id", F.col("spec").cast("long").alias("spec")), "id").withColumn("fetched", today)


def or_empty_text(spark: SparkSession, path: str) -> DataFrame:
    """The whole text of a file as one row ``value``, or no row."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.text(path, wholetext=True).select("value")
    except AnalysisException:
        return spark.createDataFrame([], "value string")


#: Files that the client needs, and those that it can do without.
CLIENT_FILES, SIDE_FILES = ("cards", "sets", "leaderboard", "model", "meta"), ("backtest", "watchlist", "sealed_trend", "price_history")


def client_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame | None]:
    """The client's files as tables (an array is a row for each element); a missing side file is None, a missing needed
    file an error."""
    from pyspark.errors import AnalysisException

    found: dict[str, DataFrame | None] = {}
    for name in (*CLIENT_FILES, *SIDE_FILES):
        try:
            found[name] = spark.read.option("multiLine", "true").json(f"{folder}/{name}.json")
        except AnalysisException:
            if name in CLIENT_FILES:
                raise
            found[name] = None
    return found


def write_by_day(df: DataFrame, path: str, day: str, keep: bool = False) -> None:
    """Overwrite only the days in ``df`` (or, with ``keep``, write only days that are not there): safe to run again."""
    spark = df.sparkSession
    if keep:
        from pyspark.errors import AnalysisException

        try:
            df = df.join(spark.read.parquet(path).select(day).distinct(), day, "left_anti")
        except AnalysisException:
            pass
        df.write.mode("append").partitionBy(day).parquet(path)
    else:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def compact_history(panel: DataFrame, eligible: DataFrame) -> DataFrame:
    """Rows (card_id, series) of the eligible cards: an array of (date, price rounded to cents) in order of date."""
    points = F.array_sort(F.collect_list(F.struct(F.col("date").cast("string").alias("date"), F.round("price", 2).alias("price"))))
    return panel.join(eligible.select("card_id").distinct(), "card_id", "left_semi").groupBy("card_id").agg(points.alias("series"))


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row; a number that JSON has no word for (not a number, infinite) is an error."""

    def checked(name: str) -> Column:
        c = F.col(f"`{name}`")
        wrong = F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(wrong, F.raise_error(F.lit(f"{name} is no JSON number"))).otherwise(c).alias(name)

    safe = [checked(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("value"))


def split_private(snapshots: DataFrame, private: str = "item_ids") -> tuple[DataFrame, DataFrame]:
    """(public table without the private column, private table of the newest date)."""
    newest = snapshots.agg(F.max("date").alias("date"))
    side = snapshots.join(F.broadcast(newest), "date").select("date", "card_id", private)  # one row
    return snapshots.drop(private), side


def restore_private(public: DataFrame, side: DataFrame, private: str = "item_ids") -> DataFrame:
    return public.join(side.select("date", "card_id", private), ["date", "card_id"], "left")


def key_paths(schema: T.DataType, key: str, path: str = "") -> list[str]:
    """Where a field of this name occurs in a schema, at any depth."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in ([f"{path}.{f.name}"] if f.name == key else []) + key_paths(f.dataType, key, f"{path}.{f.name}")]
    if isinstance(schema, T.ArrayType):
        return key_paths(schema.elementType, key, f"{path}[]")
    if isinstance(schema, T.MapType):
        return key_paths(schema.valueType, key, f"{path}{{}}")
    return []


def leaks(texts: DataFrame, key: str, column: str = "value") -> DataFrame:
    """Texts that hold the key as a JSON key at any depth, also where the text does not parse."""
    return texts.where(F.col(column).rlike(rf'"{key}"\s*:'))


def staged_problems(files: DataFrame, key: str = "item_ids") -> DataFrame:
    """Rows (name, problem) of files (name, content) that must not be published: JSON files with the key at any depth,
    and those that do not parse and name it."""
    content = F.col("content").cast("string")
    json = files.where(F.lower("name").endswith(".json")).select("name", content.alias("value"), F.try_parse_json(content).isNotNull().alias("parses"))
    problem = F.when(~F.col("parses") & F.col("value").contains(key), "does not parse and names it").when(F.col("parses") & F.col("value").rlike(rf'"{key}"\s*:'), "has it as a key")
    return json.select("name", problem.alias("problem")).where("problem is not null")


def refuse_staged(files: DataFrame, key: str = "item_ids") -> None:
    """Raise where a file must not be published (a few names are told)."""
    found = staged_problems(files, key).orderBy("name").limit(50).collect()
    if found:
        raise ValueError(f"{key}: " + "; ".join(f"{r['name']} {r['problem']}" for r in found))


def synthetic_snapshots(spark: SparkSession, cards_: DataFrame, start: str, days: int, seed: int = 20260617) -> DataFrame:
    """Seeded daily listing counts of ``cards_`` (card_id, rarity, market_price).

    The level falls with tier and price.  7.5 % of the cards tighten by 1.2 to 3 % of it a day, 7.5 % loosen as much,
    the others drift within 0.4 %; the average follows the market price against the drift.  All draws are hashes of
    seed, card and day.
    """
    unit = lambda *parts: F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1_000_003)) / 1_000_003.0
    between = lambda low, high, *parts: low + (high - low) * unit(*parts)
    of = lambda name: (F.col("card_id"), F.lit(name))
    supply = F.element_at(F.create_map(*[F.lit(x) for pair in C.TIER_SUPPLY.items() for x in pair]), F.coalesce("rarity", F.lit("Unknown")))
    price = F.coalesce(F.nullif(F.col("market_price"), F.lit(0.0)), F.lit(1.0))
    base = F.coalesce(supply, F.lit(C.TIER_SUPPLY["Unknown"])) * (0.4 + 0.6 / (1.0 + F.greatest(price, F.lit(0.0)) / 12.0)) * between(0.8, 1.2, *of("level"))
    roll, strength = unit(*of("profile")), between(0.012, 0.030, *of("slope"))
    slope = F.when(roll < 0.075, -strength).when(roll < 0.15, strength).otherwise(between(-0.004, 0.004, *of("drift")))
    made = cards_.select("card_id", "market_price", F.greatest(F.lit(3), F.round(base, 0)).alias("base"), slope.alias("slope"), between(0.04, 0.10, *of("noise")).alias("noise"))
    rows = made.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    wobble = F.col("noise") * (2 * unit("card_id", "day", F.lit("count")) - 1)
    active = F.greatest(F.lit(0), F.round(F.col("base") * (1 + F.col("slope") * F.col("day") + wobble), 0)).cast("int")
    average = F.round(F.col("market_price") * (1 - 0.5 * F.col("slope") * F.col("day") + 0.04 * (unit("card_id", "day", F.lit("price")) - 0.5)), 2)
    return rows.select(F.date_add(F.lit(start).cast("date"), F.col("day")).alias("date"), "card_id", active.alias("active"), average.alias("average"), F.lit(None).cast("array<string>").alias("item_ids"))


def interest_scores(interest: DataFrame, anchor: str, recent: int = 8) -> DataFrame:
    """Rows (name, score, weekly) from search interest (batch, term, date, value) that each batch measured with an anchor.

    Interest is that of the anchor's on the day (days where the anchor has none are left out); the score is of the mean
    over the last ``recent`` of them.  The anchor itself has the score 10.
    """
    base = interest.where(F.col("term") == anchor).select("batch", "date", F.nullif(F.col("value").cast("double"), F.lit(0.0)).alias("__anchor"))
    rows = interest.where(F.col("term") != anchor).join(base, ["batch", "date"], "left").withColumn("ratio", F.col("value") / F.col("__anchor"))
    last = F.row_number().over(Window.partitionBy("batch", "term").orderBy(F.col("ratio").isNull(), F.desc("date")))
    point = F.when(F.col("ratio").isNotNull(), F.struct(F.col("date").cast("string").alias("date"), F.round("ratio", 4).alias("ratio")))
    made = rows.withColumn("__k", last).groupBy(F.col("term").alias("name"), "batch").agg(
        scores.search_interest_score(F.coalesce(F.avg(F.when(F.col("__k") <= recent, F.col("ratio"))), F.lit(0.0))).alias("score"),
        F.map_from_entries(F.array_sort(F.collect_list(point))).alias("weekly"),
    )
    one = interest.where(F.col("term") == anchor).groupBy(F.col("term").alias("name")).agg(F.lit(10.0).alias("score"))
    top = one.withColumn("weekly", F.create_map().cast("map<string,double>"))
    made = made.select("name", "score", "weekly")
    return made.unionByName(top)


def interest_batches(names: DataFrame, done: DataFrame, size: int = 4) -> DataFrame:
    """Rows (batch, name) of the names that have no score yet, so that a run that broke off goes on from there."""
    todo = names.select("name").distinct().join(done.select("name"), "name", "left_anti")
    return todo.withColumn("batch", F.floor((F.row_number().over(Window.orderBy("name")) - 1) / size).cast("int"))  # a few hundred names


def chosen_titles(names: DataFrame, pages: DataFrame, word: str = "Pokémon") -> DataFrame:
    """Rows (name, title): the page that is about this very name.

    ``pages`` has rows (asked, normal, redirect, exists, categories), one for each asked title: its normal form and
    where that leads (null: stays).  The page ``name (word)`` is taken first, if it exists and is no list; else the bare
    name's, if its categories name the word.  Either counts only if its title without the word is the name.
    """
    canonical = F.coalesce("redirect", "normal", "asked")
    at = pages.select("asked", canonical.alias("title"), F.coalesce(F.col("exists"), F.lit(False)).alias("exists"), F.coalesce("categories", F.lit("")).alias("categories"))
    fine = F.col("exists") & ~F.col("title").contains("List of")
    special = at.where(fine).select(F.col("asked").alias("__special"), F.col("title").alias("__first"))
    plain = word.encode("ascii", "ignore").decode()
    about = F.col("categories").contains(word) | F.col("categories").contains(word.replace("é", "e") if plain != word else word)
    bare = at.where(fine & about).select(F.col("asked").alias("name"), F.col("title").alias("__second"))
    rows = names.select("name").distinct().withColumn("__special", F.concat("name", F.lit(f" ({word})"))).join(special, "__special", "left").join(bare, "name", "left")
    rows = rows.withColumn("title", F.coalesce("__first", "__second"))
    return rows.where(F.lower(F.replace("title", F.lit(f" ({word})"), F.lit(""))) == F.lower("name")).select("name", "title")


def yearly_views(chosen: DataFrame, monthly: DataFrame) -> DataFrame:
    """Rows (name, views): the sum of the chosen page's months (title, views); names without views are left out."""
    sums = monthly.groupBy("title").agg(F.sum("views").alias("views"))
    return chosen.join(sums, "title").where("views > 0").select("name", "views")


def rates(spark: SparkSession) -> DataFrame:
    return base_rates(spark)


def archive_rows(raw: DataFrame) -> DataFrame:
    """Rows (date, product_id, subtype, price) from group files (date, value) of ``{"results": [..]}``; files that do not
    parse give no rows."""
    schema = "struct<results:array<struct<productId:long,subTypeName:string,marketPrice:double>>>"
    rows = raw.select("date", F.explode(F.from_json("value", schema)["results"]).alias("p")).where("date is not null")
    return rows.select("date", F.col("p.productId").alias("product_id"), F.col("p.subTypeName").alias("subtype"), F.col("p.marketPrice").alias("price")).where("price is not null")


def unpacked_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows (date, value) of unpacked archives ``<YYYY-MM-DD>/<group>.json``."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return raw.select(F.try_to_date(F.regexp_extract("file", r"(\d{4}-\d{2}-\d{2})/[^/]+$", 1), "yyyy-MM-dd").alias("date"), "value")


def archive_prices(raw: DataFrame, wanted: DataFrame, preferred: tuple[str, ...] = C.SUBTYPES) -> DataFrame:
    """Rows (date, card_id, price) from group files (date, value).

    ``wanted`` has rows (card_id, product_id, wanted subtype).  A product's price is that of the wanted subtype, else of
    the first preferred one, else of any, to the cent.
    """
    order = F.array_position(F.array(*map(F.lit, preferred)), F.col("subtype"))
    rank = F.when(F.col("subtype") == F.col("wanted"), 0).when(order > 0, order.cast("int")).otherwise(len(preferred) + 1)
    best = F.min(F.struct(rank.alias("k"), "subtype", "price"))["price"]
    return archive_rows(raw).join(wanted, "product_id").groupBy("date", "card_id").agg(F.round(best, 2).alias("price"))


def sealed_prices(prices: DataFrame, tracked: DataFrame) -> DataFrame:
    """Prices to the cent of the tracked products only, with their label and group."""
    return prices.join(tracked, "product_id").select("date", "product_id", "label", F.round("price", 2).alias("price"))


def weekly_dates(spark: SparkSession, start: str, end: str, step_days: int = 7) -> DataFrame:
    """Rows (date) from start to end, both included."""
    ends = spark.range(1).select(F.lit(start).cast("date").alias("a"), F.lit(end).cast("date").alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {step_days} days"))).alias("date"))


def missing_dates(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """The wanted dates that an idempotent backfill still has to write."""
    return wanted.join(have.select("date").distinct(), "date", "left_anti")


def sweep_plan(cards_: DataFrame, budget: int = 4_800, size: int = C.SWEEP_SIZE, pages: int = 1) -> DataFrame:
    """The sweep's cards in order of price, as many as the call budget allows."""
    ranked = cards_.where(F.col("market_price") >= C.SWEEP_FLOOR).orderBy(F.desc("market_price"), "card_id")
    return ranked.limit(min(size, budget // pages))


def sweep_rows(cards_: DataFrame, observed: DataFrame) -> DataFrame:
    """A row for each swept card: its observation, or a neutral one (all null) where it was not reached."""
    columns = ["known", "active", "average", "item_ids"]
    out = cards_.select("card_id").join(observed.select("card_id", *columns), "card_id", "left")
    return out.withColumn("known", F.coalesce("known", F.lit(False)))
