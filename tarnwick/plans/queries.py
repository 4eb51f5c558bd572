"""The operators as named queries over the driver's tables; ``oracle`` has the same in another engine's SQL."""

from __future__ import annotations

import datetime as dt
import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick import constants as C
from tarnwick.functions import scores, stats, text
from tarnwick.lineage import cut
from tarnwick.operators import asof, backtest, boards, dynamics, evaluation, features, freshness, labels, matching, ridge, sealed
from tarnwick.plans import fixtures as fx
from tarnwick.plans.testmap import view
from tarnwick.sources import files

AS_OF = dt.date(2001, 8, 2)
LAST_DAY = dt.date(2024, 1, 30)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query; dates leave it as ISO text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if kind == "date" else F.col(f"`{c}`") for c, kind in df.dtypes])

    QUERIES[f.__name__] = run
    return f


def r(column, digits: int = 6, name: str | None = None):
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits).alias(name or (column if isinstance(column, str) else "value"))


# --- sealed products, pull rates, sets ---


@query
def sealed_value(spark, d):
    cards = sealed.with_pull_rates(view(spark, d, "cards"), view(spark, d, "overrides"))
    out = boards.ranked_sets(sealed.sealed_value(view(spark, d, "sets"), cards))
    return out.select("set_id", *[r(c, 7) for c in ("ev_per_pack", "ev_per_box", "pack_signal", "box_signal", "average_loss")], scores.ev_pill(F.round("box_signal", 7)).alias("pill"))


@query
def rarity_counts(spark, d):
    return sealed.rarity_counts(view(spark, d, "cards"))


@query
def pull_costs(spark, d):
    cards = sealed.with_pull_rates(view(spark, d, "cards"), view(spark, d, "overrides"))
    return sealed.with_pull_cost(cards, view(spark, d, "sets")).select("card_id", r("tier_rate"), F.col("n_in_tier"), r("pull_rate", 8), r("pull_cost", 4))


@query
def sealed_overlay(spark, d):
    feed = view(spark, d, "sets").where(F.length("set_id") == 7).select("set_id", (F.col("pack_price") * 2).alias("pack_price"), F.lit(None).cast("double").alias("box_price"))
    literal = spark.createDataFrame(fx.OVERLAY, "set_id string, pack_price double, box_price double, p double, b double")
    feed = feed.unionByName(literal.select("set_id", F.col("p").alias("pack_price"), F.col("b").alias("box_price")))
    sets = view(spark, d, "sets").select("set_id", "pack_price", "box_price").unionByName(literal.drop("p", "b"))
    return sealed.overlay(sets, feed).select("set_id", "pack_price", "box_price")


@query
def sealed_feed(spark, d):
    s = view(spark, d, "sets")
    item = lambda name, price, sold: F.struct(F.lit(name).alias("product"), price.alias("price"), F.lit(0.5).alias("change_24h"), F.lit(sold).alias("sold_today"), F.lit(7).alias("listings"))
    box = F.col("box_price")
    arr = F.array(item("Elite Trainer Box Pokemon Center", box * 2, 1), item("Booster Pack", F.col("pack_price"), 2), item("Elite Trainer Box Plus", box, 3), item("Booster Pack", box, 4))
    feed = s.select(F.lit(dt.date(2024, 1, 3)).alias("as_of"), F.create_map(F.col("name"), arr).alias("sets"))
    unknown = s.limit(1).select(F.lit(dt.date(2024, 1, 3)).alias("as_of"), F.create_map(F.lit("nobody's set"), arr).alias("sets"))
    found = sealed.sealed_feed(feed.unionByName(unknown), s)
    return found.select("set_id", F.col("as_of"), r(F.col("pack.price"), 4, "pack_price"), F.col("pack.sold_today").alias("pack_sold"), r(F.col("box.price"), 4, "box_price"), F.col("box.sold_today").alias("box_sold"))


@query
def sealed_staleness(spark, d):
    days = view(spark, d, "sets").select(F.date_add(F.lit(dt.date(2024, 1, 1)), F.length("set_id") * 5).alias("as_of"))
    return sealed.staleness(days, F.lit(LAST_DAY))


# --- text, prices, listings ---


@query
def base_names(spark, d):
    tails = F.element_at(F.array(*map(F.lit, C.MECHANICS)), (F.col("card_id") % len(C.MECHANICS) + 1).cast("int"))
    name = F.concat(F.when(F.col("card_id") % 4 == 0, "Owner's ").otherwise(""), F.col("name"), F.lit(" "), tails, F.when(F.col("card_id") % 3 == 0, " ex").otherwise(""))
    rows = view(spark, d, "cards").select("card_id", name.alias("full"), "supertype")
    return rows.select("card_id", "full", text.base_name(F.col("full"), F.col("supertype")).alias("base"))


@query
def folded_names(spark, d):
    cards = view(spark, d, "cards")
    name = F.concat(F.lit("Flabébé "), F.col("name"), F.lit(" (Holo) - promo"))
    keys = text.variant_keys(F.concat(F.lit("Mega "), F.col("name"), F.lit(" X")))
    return cards.select(
        "card_id", text.folded(name).alias("folded"), text.product_base(name).alias("product"), text.card_number(F.concat(F.lit("00"), F.col("number"))).alias("number"),
        text.variant_name(F.concat(F.lit("tcg:"), F.when(F.col("card_id") % 2 == 0, "reverse-holofoil").otherwise("normal"))).alias("variant"),
        F.array_join(keys, ",").alias("keys"), text.search_query(F.col("name"), F.lit("  "), F.col("number")).alias("query"), text.is_graded(F.concat(F.col("name"), F.lit(" PSA 9"))).alias("graded"),
    )


@query
def date_formats(spark, d):
    raw = F.when(F.col("card_id") % 3 == 0, F.date_format("release_date", "yyyy/MM/dd")).when(F.col("card_id") % 3 == 1, F.date_format("release_date", "yyyy-MM-dd")).otherwise("soon")
    rows = view(spark, d, "cards").select("card_id", text.slash_date(raw).alias("day"))
    return rows.select("card_id", "day", r(scores.months_between(F.lit(AS_OF), F.col("day")), 4, "months"), scores.age_label(F.lit(dt.date(1995, 3, 1)), F.col("day")).alias("label"))


@query
def variant_pick(spark, d):
    """First variant with a price that is not zero in the order of preference, else any; the tags tell which."""
    price, k = F.col("market_price"), F.col("card_id")
    prices = {"holofoil": F.when(k % 2 == 0, F.lit(0.0)), "reverseHolofoil": F.when(k % 3 == 0, price), "normal": F.when(k % 5 == 0, price * 2), "other": price * 3}
    listed = F.create_map(*[x for n, c in prices.items() for x in (F.lit(n), F.struct(c.alias("market")))])
    rows = view(spark, d, "cards").select("card_id", listed.alias("listed"))
    return rows.select("card_id", files.variant_used(F.col("listed")).alias("variant"), r(files.variant_price(F.col("listed")), 4, "price"))


@query
def normal_cards(spark, d):
    """Source records as JSON, read back and made flat; one of them has a wrong tier."""
    c = view(spark, d, "cards")
    known = F.when(F.col("card_id") == 7, F.lit(next(iter(C.TIER_CORRECTIONS)))).otherwise(F.concat(F.lit("x-"), F.col("card_id").cast("string")))
    name = F.concat(F.when(F.col("card_id") % 4 == 0, "Owner's ").otherwise(""), F.col("name"), F.when(F.col("card_id") % 3 == 0, " ex").otherwise(""))
    price = F.when(F.col("market_price").isNotNull(), F.create_map(F.lit("normal"), F.struct(F.col("market_price").alias("market"))))
    record = F.struct(
        known.alias("id"), name.alias("name"), F.when(F.col("supertype") == "Trainer", "Trainer").alias("supertype"), "number", F.when(F.col("card_id") % 6 > 0, F.col("rarity")).alias("rarity"),
        F.struct(F.col("set_id").alias("id"), F.col("set_name").alias("name"), F.date_format("release_date", "yyyy/MM/dd").alias("releaseDate")).alias("set"),
        F.struct(price.alias("prices"), F.lit("2024/01/01").alias("updatedAt")).alias("tcgplayer"), F.array("dex").alias("nationalPokedexNumbers"),
    )
    raw = c.select(F.from_json(F.to_json(record), files.RAW_CARD).alias("r")).select("r.*")
    return files.normal_cards(raw).select("id", "base_name", "supertype", "rarity", "set_id", F.col("release_date"), r("market_price", 4), "price_variant", F.col("dex"))


@query
def second_prices(spark, d):
    """The second source's pick: a known variant, any variant, the European average, nothing."""
    price, k = F.col("market_price"), F.col("card_id")
    listed = {"holofoil": F.when(k % 3 == 0, price).when(k % 3 == 1, F.lit(0.0)), "normal": F.when(k % 4 == 0, price * 2), "odd": F.when(k % 7 == 0, price * 3)}
    prices = F.create_map(*[x for n, c in listed.items() for x in (F.lit(n), F.struct(c.alias("marketPrice")))])
    rows = view(spark, d, "cards").select("card_id", prices.alias("listed"), F.when(k % 5 > 0, price).alias("eur"))
    return rows.select("card_id", files.secondary_price(F.col("listed"), F.col("eur"), F.lit("u"), F.lit("e")).alias("p")).select("card_id", "p.price", "p.variant")


@query
def subtype_price(spark, d):
    cards = view(spark, d, "cards").where("market_price is not null")
    subtype = F.element_at(F.array(*map(F.lit, ["Normal", "Holofoil", "Reverse Holofoil"])), (F.col("card_id") % 3 + 1).cast("int"))
    product, draw = F.expr("card_id div 5"), (F.col("card_id") * 7919) % 11  # five cards a product, of some of four subtypes
    wanted = cards.select("card_id", product.alias("product_id"), subtype.alias("wanted"))
    priced = F.when(draw < 3, "Holofoil").when(draw < 6, "Normal").when(draw < 9, "Reverse Holofoil").otherwise("Foil")
    prices = cards.select(product.alias("product_id"), priced.alias("subtype"), F.col("market_price").alias("price"))
    prices = prices.groupBy("product_id", "subtype").agg(F.max("price").alias("price"))
    return matching.subtype_price(wanted, prices, ["Holofoil", "Normal"])


@query
def archive_series(spark, d):
    """Group files as JSON, of which some are broken, read back: the wanted subtype's price, else the first preferred one's."""
    p = view(spark, d, "panel").where("price is not null")
    point = F.struct(F.col("card_id").alias("productId"), F.when(F.col("card_id") % 3 == 0, "Normal").otherwise("Odd").alias("subTypeName"), F.col("price").alias("marketPrice"))
    twice = F.struct(F.col("card_id").alias("productId"), F.lit("Holofoil").alias("subTypeName"), F.when(F.col("card_id") % 2 == 0, F.col("price") * 2).alias("marketPrice"))
    group = F.floor(F.col("card_id") / 100)
    bodies = p.groupBy("date", group.alias("g")).agg(F.flatten(F.collect_list(F.array(point, twice))).alias("results"))
    whole = F.to_json(F.struct("results"))
    raw = bodies.select("date", F.when((F.col("g") == 1) & (F.dayofmonth("date") < 8), F.substring(whole, 1, 40)).otherwise(whole).alias("value"))
    wanted = p.select("card_id").distinct().select("card_id", F.col("card_id").alias("product_id"), F.when(F.col("card_id") % 3 == 0, "Normal").otherwise("Reverse Holofoil").alias("wanted"))
    return files.archive_prices(raw, wanted)


@query
def price_band_means(spark, d):
    rows = view(spark, d, "listings")
    market = rows.groupBy("card_id").agg(F.round(F.avg("value"), 2).alias("market"))
    rows = rows.join(market, "card_id")
    kept = rows.where(scores.in_price_band(F.col("value"), F.col("market")))
    dropped = rows.groupBy("card_id").agg(F.sum((~scores.in_price_band(F.col("value"), F.col("market"))).cast("long")).alias("dropped"))
    mean = lambda name: r(F.col("mean") + 1e-9, 6, name)  # noqa: E731  means of cents often end in a five
    raw = stats.trimmed_means(rows, ["card_id"], "value", digits=12).select("card_id", F.col("n").alias("n_raw"), mean("mean_raw"))
    banded = stats.trimmed_means(kept, ["card_id"], "value", digits=12).select("card_id", F.col("n").alias("n_band"), mean("mean_band"))
    return raw.join(banded, "card_id", "left").join(dropped, "card_id")


@query
def usable_listings(spark, d):
    """Valid, graded and foreign listings told apart per card; a card of none but graded ones is a confirmed zero."""
    rows = view(spark, d, "listings").select(
        "card_id", F.when(F.col("event_id") % 13 == 0, "").otherwise(F.col("item")).alias("id"), F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("decimal(10,2)").cast("string")).alias("v"),
        F.when(F.col("event_id") % 7 == 0, "EUR").otherwise("USD").alias("currency"), F.when(F.col("event_type") == "signup", "card PSA 10").otherwise("card").alias("title"),
    )
    ok = scores.usable_listing(F.col("id"), F.col("v"), F.col("currency"))
    counted = ok & (F.col("currency") == "USD") & ~text.is_graded(F.col("title"))
    out = rows.groupBy("card_id").agg(F.sum(ok.cast("long")).alias("usable"), F.sum(counted.cast("long")).alias("counted"), F.count_distinct(F.when(counted, F.col("id"))).alias("ids"))
    return out.withColumn("active", F.when(F.col("usable") > 0, F.col("counted")))


# --- gates and display rules ---


@query
def gates(spark, d):
    cards = view(spark, d, "cards")
    p, exp = F.col("market_price"), F.col("market_price") * F.when(F.col("card_id") % 2 == 0, 0.5).otherwise(1.1)
    age = F.datediff(F.lit(dt.date(1995, 4, 1)), F.col("release_date"))
    months = F.when(F.col("release_date").isNotNull(), F.greatest(age, F.lit(0)) / C.DAYS_PER_MONTH)
    return cards.select(
        "card_id", scores.edge_reason(p, exp, months).alias("reason"), F.coalesce(scores.surfaced(age, p), F.lit(False)).alias("surfaced"), scores.verdict((p - exp) / exp).alias("verdict"),
        scores.rarity_group(F.col("rarity")).alias("grp"), scores.price_tier(p).alias("tier"), scores.age_bucket(age).alias("age"), scores.client_edge(F.when(F.col("card_id") % 3 == 0, F.lit(True)), months, p).alias("client_edge"),
    )


@query
def panels(spark, d):
    """Lines and cells of the client's panels."""
    rows = view(spark, d, "listings").groupBy("card_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("tens"), stats.mean_in_order("value", "event_id", 2).alias("price"))
    big = F.col("n") * 97
    flow = scores.flow_panel(F.when(F.col("card_id") % 3 > 0, "ok").otherwise("awaiting_data"), big, F.when(F.col("card_id") % 2 == 0, F.col("n")), F.col("tens"))
    pop = scores.population_panel(F.when(F.col("card_id") % 5 > 0, big).otherwise(0), F.col("tens"), F.try_divide(F.col("tens").cast("double"), F.col("n").cast("double")))
    cells = lambda p: F.array_join(F.transform(p, lambda x: F.concat(x["label"], F.lit("="), x["value"])), "; ")
    line = scores.sealed_line(F.col("price"), F.when(F.col("card_id") % 2 == 0, F.col("price") / -16), F.col("tens"), F.when(F.col("card_id") % 7 > 0, big), F.lit("2024-01-02"))
    slider = scores.slider_contribution(F.lit(0.5), F.col("price") / 64, F.lit(0.25), F.when(F.col("card_id") % 4 == 0, F.lit(0.0)).otherwise(F.lit(2.0)))
    return rows.select("card_id", cells(flow).alias("flow"), cells(pop).alias("population"), line.alias("line"), slider.alias("slider"), scores.feature_text("months_since_release", F.col("price")).alias("months"))


@query
def display_rules(spark, d):
    rows = view(spark, d, "listings").select("event_id", "card_id", "value", "date", (F.col("event_id") % 50).cast("double").alias("hours"))
    x = F.col("value") / 100.0
    banner = scores.refresh_banner(F.lit(LAST_DAY), F.when(F.col("event_id") % 4 > 0, F.col("date")), F.lit(dt.date(2024, 1, 29)))
    return rows.select(
        "event_id", scores.ev_pill(x - 0.2).alias("pill"), scores.saturation_tag(x + 0.5).alias("sat"), scores.ic_tone(x - 0.1).alias("tone"), scores.trend_chip(x - 0.2).alias("chip"),
        scores.shown_listing(F.when(F.col("event_id") % 2 == 0, "bin").otherwise("auction"), F.col("hours")).alias("shown"), scores.age_label(F.lit(LAST_DAY), F.col("date")).alias("age"),
        scores.under_market(F.col("value"), F.lit(30.0)).alias("under"), r(scores.saturation_gauge(x), 6, "gauge"), r(scores.demand_gauge(x), 6, "demand"),
        scores.shipping_label(F.when(F.col("event_id") % 3 == 0, F.lit(0.0)).when(F.col("event_id") % 3 == 1, F.lit(4.0)), F.col("value"), F.col("value") + F.when(F.col("event_id") % 3 == 1, 4.0).otherwise(0.0)).alias("shipping"), scores.short_count(F.col("event_id")).alias("short"),
        F.concat_ws("|", banner["kicker"], banner["label"], banner["sub"]).alias("banner"), scores.series_confidence(F.col("card_id")).alias("conf"),
    )


@query
def prior_scores(spark, d):
    v = (F.col("card_id") * 37).cast("double")
    rows = view(spark, d, "cards").select("card_id", scores.pageview_score(v).alias("views"), F.when(F.col("card_id") % 3 > 0, scores.poll_score(v + 1)).alias("poll"), scores.search_interest_score(v / 100000.0).alias("interest"))
    return rows.withColumn("prior", F.round(scores.combined_prior(F.col("poll"), F.when(F.col("card_id") % 2 == 0, F.col("views"))), 6))


# --- features and scores ---


def featured(spark, d):
    return features.card_features(view(spark, d, "cards"), view(spark, d, "priors"), F.lit(AS_OF), [])


def modelled(spark, d):
    cards = cut(featured(spark, d).withColumn("cluster", ridge.cluster_key(F.col("supertype"), F.col("rarity"))))
    models = ridge.fit_clusters(cards, [])
    return cards, models, ridge.score(cards, models, [])


@query
def character_premium(spark, d):
    return features.character_premium(view(spark, d, "cards"), view(spark, d, "priors"), [])


@query
def card_features(spark, d):
    f = featured(spark, d)
    iq = scores.iq_score(F.col("scarcity"), F.col("char_premium"), F.col("set_rank"))
    return f.select("card_id", r("char_premium", 4), r("scarcity", 4), r("set_rank", 4), r("months_since_release", 4), iq.alias("iq"))


@query
def cluster_ridge(spark, d):
    _, (own, _), _ = modelled(spark, d)
    return own.select("cluster", "n", *[r(F.col(c) + 1e-9, 5, c) for c in own.columns if c not in ("cluster", "n")])  # means of few cards end in a five


@query
def global_ridge(spark, d):
    _, (_, whole), _ = modelled(spark, d)
    return whole.select("n", *[r(F.col(c) + 1e-9, 5, c) for c in whole.columns if c != "n"])


@query
def ridge_scores(spark, d):
    _, _, scored = modelled(spark, d)
    part = lambda f: r(F.col("contributions")[f], 6, f"part_{f}")
    return scored.select("card_id", "cluster", F.col("model_n"), r("expected_price", 4), r("residual", 5), *[part(f) for f in C.FEATURES])


@query
def model_export(spark, d):
    _, models, _ = modelled(spark, d)
    e = ridge.export(*models, digits=None)
    # Means of a few values of six digits end in a 5 behind them rather often; a billionth decides how they are rounded.
    part = lambda c, k: F.round(F.get(c, F.lit(k)) + 1e-9, 6).alias(f"{c}_{k}")
    return e.select("cluster", "n", F.round(F.col("intercept") + 1e-9, 6).alias("intercept"), *[part(c, k) for c in ("means", "stds", "coefs") for k in range(len(C.FEATURES))])


@query
def small_sample_notes(spark, d):
    _, models, _ = modelled(spark, d)
    cards = view(spark, d, "cards").select("card_id", ridge.cluster_key(F.col("supertype"), F.col("rarity")).alias("cluster"))
    return ridge.model_sizes(cards, models)


@query
def rescored(spark, d):
    cards, (_, whole), _ = modelled(spark, d)
    m = whole.select([F.col(c).alias(f"m_{c}") for c in whole.columns])
    rows = cards.select("card_id", F.when(F.col("card_id") % 4 > 0, F.col("char_premium")).alias("a"), F.col("scarcity").alias("b"), F.col("months_since_release").alias("c")).crossJoin(F.broadcast(m))
    model = {"intercept": F.col("m_intercept")} | {f"{p}_{f}": F.col(f"m_{p}_{f}") for f in C.FEATURES for p in ("mean", "std", "coef")}
    return rows.select("card_id", r(ridge.rescore(model, dict(zip(C.FEATURES, (F.col("a"), F.col("b"), F.col("c"))))), 4, "price"))


@query
def fit_metric(spark, d):
    _, _, scored = modelled(spark, d)
    return scored.agg(r(stats.squared_log_correlation("market_price", "expected_price"), 6, "r2_log"), F.count("residual").alias("n"))


# --- boards ---


def board_rows(spark, d):
    _, _, scored = modelled(spark, d)
    rows = scored.withColumns({"expected_price": F.round("expected_price", 4), "residual": F.round("residual", 6)})
    return boards.pool(rows)


@query
def leaderboard_under(spark, d):
    return boards.leaderboard(board_rows(spark, d), True).select("card_id", "market_price", r("expected_price", 3), "raw_diff")


@query
def leaderboard_over(spark, d):
    return boards.leaderboard(board_rows(spark, d), False).select("card_id", "market_price", r("expected_price", 3), "raw_diff")


@query
def movers(spark, d):
    dyn = dynamics.compute(dynamics.with_flows(view(spark, d, "snapshots"), F.lit(LAST_DAY)), current=F.lit(LAST_DAY))
    out = boards.movers(board_rows(spark, d).join(dyn, "card_id", "left"))
    return out.select("card_id", r("shift", 4), "raw_diff", "mover_basis", "awaiting_data")


@query
def movers_fallback(spark, d):
    rows = board_rows(spark, d).withColumns({"status": F.lit("awaiting_data"), "supply_saturation": F.lit(1.0)})
    return boards.movers(rows).select("card_id", "raw_diff", "mover_basis", "awaiting_data")


@query
def most_underpriced(spark, d):
    _, _, scored = modelled(spark, d)
    return boards.most_underpriced(scored.withColumn("residual", F.round("residual", 5)), 25).select("card_id", "residual")


def formed(spark, d):
    """Cards of which a fifth are Mega forms, some with a letter, and a seventh of another form."""
    k, name = F.col("card_id"), F.col("name")
    form = F.when(k % 5 == 0, F.concat(F.lit("Mega "), name, F.lit(" X"))).when(k % 7 == 0, F.concat(F.lit("Mega "), name)).when(k % 11 == 0, F.concat(name, F.lit(" Y"))).otherwise(name)
    return view(spark, d, "cards").withColumn("base_name", form)


def reviewed(spark, d):
    cards, priors = formed(spark, d), view(spark, d, "priors")
    return boards.premium_review(cards, features.character_premium(cards, priors, []), priors)


@query
def premium_review(spark, d):
    return reviewed(spark, d)


@query
def review_flags(spark, d):
    review = reviewed(spark, d).withColumn("gap", F.round((F.col("gap") - 2.0), 2))
    return boards.review_flags(review).select("character", "gap", "flag")


@query
def card_search(spark, d):
    cards = view(spark, d, "cards").withColumns({"iq_score": F.lit(None).cast("double"), "residual": F.lit(None).cast("double")})
    return boards.search(cards, "Gear").select("card_id", "name", "market_price", "n_hits")


@query
def card_search_by_name(spark, d):
    cards = view(spark, d, "cards").withColumns({"iq_score": F.lit(None).cast("double"), "residual": F.lit(None).cast("double")})
    return boards.search(cards, "", "Brand#7", "name").select("card_id", "name", "n_hits")


@query
def top_characters(spark, d):
    return features.top_characters(view(spark, d, "cards"), "red widget")


@query
def sweep_universe(spark, d):
    return files.sweep_plan(view(spark, d, "cards")).select("card_id", "market_price")


@query
def meta_counts(spark, d):
    from tarnwick.plans.daily import meta_counts as counts

    _, (own, _), scored = modelled(spark, d)
    return counts(scored, own).withColumn("clusters", F.array_join("clusters", ", "))


@query
def set_names(spark, d):
    return view(spark, d, "cards").select("set_name").distinct()


# --- supply and demand ---


@query
def listing_flows(spark, d):
    return dynamics.with_flows(view(spark, d, "snapshots")).select("card_id", "date", "active", "new_listings", "ended_listings", "est_sold", "est_unsold")


@query
def yesterday_flows(spark, d):
    s = view(spark, d, "snapshots")
    return dynamics.yesterday_flows(s.where(F.col("date") == F.lit(LAST_DAY)), s).select("card_id", "active", "new_listings", "ended_listings", "est_sold", "est_unsold")


@query
def trailing_windows(spark, d):
    w = dynamics.with_trailing(dynamics.with_flows(view(spark, d, "snapshots")))
    return w.select("card_id", "date", "sold_7", "new_7", r("active_7"), r("active_30"))


@query
def market_dynamics(spark, d):
    return dynamics.compute(dynamics.with_flows(view(spark, d, "snapshots"), F.lit(LAST_DAY)), current=F.lit(LAST_DAY))


@query
def market_dynamics_as_of(spark, d):
    return dynamics.compute(dynamics.with_flows(view(spark, d, "snapshots"), F.lit(dt.date(2024, 1, 15))), as_of=F.lit(dt.date(2024, 1, 15)))


@query
def price_moves(spark, d):
    return labels.price_moves(view(spark, d, "panel"), as_of=F.lit(dt.date(2000, 1, 1)))


@query
def signal_labels(spark, d):
    dyn = dynamics.compute(dynamics.with_flows(view(spark, d, "snapshots"), F.lit(LAST_DAY)), current=F.lit(LAST_DAY))
    rows = dyn.drop("days").join(labels.price_moves(view(spark, d, "panel")), "card_id", "left")
    return labels.signals(rows).select("card_id", "price_state", "market_state", "label", "tone", "confidence", "detail")


@query
def source_status(spark, d):
    return freshness.live_dates(view(spark, d, "snapshots"), F.lit(dt.date(2024, 1, 28)))


@query
def breaker_runs(spark, d):
    rows = view(spark, d, "listings").select(F.col("event_id").alias("seq"), (F.col("card_id") % 10).alias("sweep"), F.col("event_type").isin("view", "click", "error").alias("unknown"))
    return dynamics.failure_runs(rows, most=6).select("seq", "run", "issued")


@query
def window_lows(spark, d):
    """Floor over the 14 days up to each point, and whether the point is a fresh low."""
    return dynamics.window_lows(view(spark, d, "snapshots")).select("card_id", "date", "low", "is_low")


# --- time joins ---


@query
def sealed_trends(spark, d):
    t = asof.trends(view(spark, d, "panel"), "card_id")
    return t.select("card_id", "latest", "n_points", "trend_30d", "trend_90d", "trend_180d", scores.trajectory(F.col("trend_30d"), F.col("trend_90d"), F.col("trend_180d")).alias("trajectory"), scores.series_confidence(F.col("n_points")).alias("confidence"))


@query
def backward_prices(spark, d):
    return asof.backward(view(spark, d, "panel"), ["card_id"], F.lit(dt.date(1998, 7, 3)), "price", most_stale=14)


@query
def nearest_forward_pairs(spark, d):
    return asof.nearest_forward(view(spark, d, "panel").select("date").distinct())


@query
def carried_portfolio(spark, d):
    rows = asof.carried_forward(view(spark, d, "panel"), "card_id", "price")
    return rows.select("date", r("total", 4))


@query
def portfolio_totals(spark, d):
    cards = view(spark, d, "cards")
    watched = cards.select("card_id", F.when(F.col("card_id") % 100 == 0, F.col("dex").cast("double")).alias("price_at_add"))
    return boards.portfolio_totals(watched, cards.select("card_id", F.col("market_price").alias("price")))


@query
def weekly_dates(spark, d):
    """The weeks that the panel spans."""
    span = view(spark, d, "panel").agg(F.min("date"), F.max("date")).first()
    return files.weekly_dates(spark, str(span[0]), str(span[1]))


@query
def backfill_missing(spark, d):
    """Weeks of the span that the panel does not have, the ones an idempotent backfill still has to write."""
    return files.missing_dates(files.weekly_dates(spark, "1994-01-03", "2002-01-07"), view(spark, d, "panel"))


@query
def price_history(spark, d):
    """Series of the cards above the floor as one compact string each."""
    panel = view(spark, d, "panel")
    dear = panel.groupBy("card_id").agg(F.max_by("price", "date").alias("last")).where("last >= 40").select("card_id")
    kept = files.compact_history(panel, dear)
    end = F.element_at("series", -1)
    return kept.select("card_id", F.size("series").alias("n"), F.get("series", F.lit(0))["date"].alias("first"), end["date"].alias("last"), r(end["price"], 2, "last_price"))


@query
def merged_series(spark, d):
    p = view(spark, d, "panel")
    new = p.where("card_id % 3 = 0").select("card_id", "date", F.explode(F.array(F.struct(F.lit(2).alias("at"), (F.col("price") * 2).alias("price")), F.struct(F.lit(1).alias("at"), (F.col("price") * 3).alias("price")))).alias("w"))
    bad = p.limit(1).select(F.lit(None).cast(p.schema["card_id"].dataType).alias("card_id"), "date", F.lit(9).alias("at"), "price")
    worse = p.select("card_id", "date", F.lit(9).alias("at"), F.lit(None).cast("double").alias("price"))
    new = new.select("card_id", "date", "w.at", "w.price").unionByName(bad).unionByName(worse)
    return freshness.merge_series(p, new, ["card_id", "date"], "price", "at").select("card_id", "date", r("price", 4))


# --- backtest ---


def panel_obs(spark, d, horizons=(28,)):
    panel = cut(view(spark, d, "panel"))
    resid = backtest.residuals(panel, view(spark, d, "panel_cards"))
    # Nine digits: ties and their ranks must not hang on the order in which partial sums met.
    resid = resid.withColumn("residual", F.round("residual", 9))
    return backtest.observations(resid, panel, horizons)


@query
def walk_forward_residuals(spark, d):
    resid = backtest.residuals(view(spark, d, "panel"), view(spark, d, "panel_cards"))
    return resid.select("eval_date", "card_id", r("residual", 5), r("expected_price", 3), "age_days")


@query
def forward_returns(spark, d):
    return panel_obs(spark, d).select("date", "card_id", r("mispricing", 5), r("fwd", 6), "age_days", "rarity_group")


@query
def rank_ics(spark, d):
    return backtest.segment_ics(panel_obs(spark, d), []).select("date", "n", r("ic", 5))


def summary_columns(df, keys):
    return df.select(*keys, "n_dates", *[r(c, 4) for c in ("mean_ic", "std_ic", "t_naive", "t_hac")], "n_positive", r("sign_z", 4))


@query
def ic_by_segment(spark, d):
    ics = backtest.segment_ics(backtest.by_segment(panel_obs(spark, d)), ["segment"])
    return summary_columns(stats.ic_summary(ics, ["segment"], lag=backtest.hac_lag(F.lit(28))), ["segment"])


@query
def ic_by_horizon(spark, d):
    ics = backtest.segment_ics(panel_obs(spark, d, C.HORIZONS), ["horizon"])
    return summary_columns(stats.ic_summary(ics, ["horizon"], lag=backtest.hac_lag(F.col("horizon"))), ["horizon"])


@query
def floor_sensitivity(spark, d):
    return summary_columns(stats.ic_summary(backtest.floor_sensitivity(panel_obs(spark, d)), ["floor"]), ["floor"])


@query
def ic_by_age(spark, d):
    return backtest.by_age(panel_obs(spark, d)).select("bucket", "n", r("mean_return", 6), "n_dates", r("mean_ic", 4))


@query
def ic_by_rarity(spark, d):
    return backtest.pooled_buckets(panel_obs(spark, d), F.col("rarity_group"))


@query
def ic_by_price_tier(spark, d):
    return backtest.pooled_buckets(panel_obs(spark, d), scores.price_tier(F.col("price")))


@query
def decile_legs(spark, d):
    return backtest.decile_legs(panel_obs(spark, d, C.HORIZONS), ["horizon"]).select("horizon", "n_dates", r("top", 5), r("bottom", 5), r("spread", 5))


@query
def hit_rates(spark, d):
    return backtest.hit_rates(panel_obs(spark, d))


@query
def two_feature_model(spark, d):
    """The walk-forward run with another feature list and penalty."""
    panel, cards = view(spark, d, "panel"), view(spark, d, "panel_cards")
    resid = backtest.residuals(panel, cards, None, ["scarcity", "set_rank"], 5.0).withColumn("residual", F.round("residual", 9))
    obs = backtest.observations(resid, panel)
    return summary_columns(stats.ic_summary(backtest.segment_ics(obs, []).withColumn("all", F.lit(1)), ["all"]), ["all"])


#: Every choice of two or three of four features, under two penalties.
EVALUATED = {f"{'+'.join(own)} {alpha:g}": (own, alpha) for k in (2, 3) for own in itertools.combinations(("char_premium", "months_since_release", "scarcity", "set_rank"), k) for alpha in (1.0, 5.0)}


@query
def feature_lists(spark, d):
    """Twenty feature lists and penalties, evaluated in one walk-forward run."""
    out = evaluation.evaluate(view(spark, d, "panel"), view(spark, d, "panel_cards"), EVALUATED)
    return out.select("list", *[r(c, 4) for c in ("fresh_ic", "fresh_t", "mature_ic", "mature_t", "all_ic", "decile_spread", "r2_log")])


# --- matching, catalogue, runs ---


def products(spark, d):
    c = view(spark, d, "cards")
    name = F.when(F.col("card_id") % 7 == 0, F.concat(F.col("name"), F.lit(" (Alternate) - promo"))).when(F.col("card_id") % 5 == 0, "misprint").otherwise(F.col("name"))
    number = F.when(F.col("card_id") % 11 == 0, "999").otherwise(F.concat(F.lit("0"), F.col("number")))
    return c.select((F.col("card_id") + 100000).alias("product_id"), F.col("set_id").alias("group_id"), number.alias("number"), name.alias("name"), "rarity", F.col("card_id").alias("position"))


def matched(spark, d):
    cards = view(spark, d, "cards").withColumn("group_id", F.col("set_id")).select("card_id", "group_id", "number", "name", "rarity")
    cards = cards.unionByName(spark.createDataFrame(fx.MATCH_CARDS, fx.CARD))
    return matching.match_products(cards, products(spark, d).unionByName(spark.createDataFrame(fx.MATCH_PRODUCTS, fx.PRODUCT)))


@query
def product_matches(spark, d):
    return matched(spark, d)


@query
def match_coverage(spark, d):
    return matching.coverage(matched(spark, d))


@query
def unmatched_cards(spark, d):
    return matching.unmatched(view(spark, d, "cards"), matched(spark, d)).select("card_id", "set_id")


@query
def gap_fill(spark, d):
    c = view(spark, d, "cards").withColumn("market_price", F.when(F.substring("set_id", 7, 2).cast("int") % 2 == 0, F.col("market_price")))
    backup = view(spark, d, "cards").where("card_id % 2 = 0").select("set_id", "number", (F.col("dex") * 1.08).alias("price"))
    return matching.fill_gaps(c, backup).select("card_id", r("market_price", 4), "price_source")


@query
def carried_catalogue(spark, d):
    c = view(spark, d, "cards").select("card_id", "set_id", "market_price")
    number = F.substring("set_id", 7, 2).cast("int")
    live = c.where(number % 4 != 0)
    failed = c.where(number % 4 == 0).select("set_id").distinct()
    return freshness.carry_forward(live, c.withColumn("market_price", F.lit(-1.0)), failed)


@query
def run_status(spark, d):
    """The record after a run in which the sets of every fourth number failed."""
    ids = view(spark, d, "sets").agg(F.array_sort(F.collect_set("set_id")).alias("all"), F.array_sort(F.collect_set(F.when(F.substring("set_id", 7, 2).cast("int") % 4 != 0, F.col("set_id")))).alias("live"))
    prev = ids.withColumn("prices_as_of", F.lit("2024-01-01T00:00:00Z"))
    out = freshness.next_status(prev, F.lit("2024-01-02T00:00:00Z"), F.col("live"), freshness.not_live(F.col("all"), F.col("live")))
    return out.select("prices_as_of", "last_attempt_at", "last_attempt_ok", F.size("sets_live").alias("n_live"), F.array_join("sets_not_live", ",").alias("not_live"))


@query
def prediction_log(spark, d):
    _, _, scored = modelled(spark, d)
    rows = scored.where("residual is not null")
    return rows.select("card_id", r("market_price", 4, "m"), r("expected_price", 3, "e"), r("residual", 5, "r"), scores.verdict(F.round("residual", 5)).alias("v"))


@query
def due_populations(spark, d):
    c = view(spark, d, "cards").select(F.col("card_id").alias("id"))
    seen = view(spark, d, "cards").where("card_id % 3 > 0").select(F.col("card_id").alias("id"), F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("card_id") % 28).cast("int")).alias("fetched"))
    return freshness.due(c, seen, F.lit(LAST_DAY), budget=900)


@query
def graded_population(spark, d):
    """Total, tens, and their share; the twenty most graded."""
    raw = view(spark, d, "listings").groupBy(F.col("card_id").alias("id")).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("g10"), F.count(F.when(F.col("event_type") == "view", 1)).alias("g9"))
    return freshness.most_graded(files.populations(raw), 20)


@query
def population_answers(spark, d):
    """Answers of a population service: full, without grades, of another shape, and failed ones."""
    rows = view(spark, d, "listings").groupBy(F.col("card_id").alias("id")).agg(F.count(F.lit(1)).alias("Total"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("Grade10"))
    full = F.to_json(F.struct(F.struct("Total", "Grade10").alias("PSAPop")))
    body = F.when(F.col("id") % 5 == 0, F.lit("broken {")).when(F.col("id") % 5 == 1, F.lit(None).cast("string")).when(F.col("id") % 5 == 2, F.lit("{}")).otherwise(full)
    got = files.population_answers(rows.select("id", F.col("id").cast("int").alias("spec"), body.alias("body")), F.lit(LAST_DAY))
    return got.select("id", "total", "g10", "g9", "rate", "spec", "fetched")


@query
def page_titles(spark, d):
    """The page of each name: the special one, else the bare one if it is about the subject; and its views of a year."""
    names = view(spark, d, "priors").select(F.col("key").alias("name"))
    n, title = F.length("name"), F.initcap("name")
    special = names.select(
        F.concat("name", F.lit(" (Pokémon)")).alias("asked"), F.concat(title, F.lit(" (Pokémon)")).alias("normal"), F.when(n % 2 == 0, F.lit("List of things")).alias("redirect"),
        (n % 3 > 0).alias("exists"), F.lit("").alias("categories"),
    )
    bare = names.select(F.col("name").alias("asked"), title.alias("normal"), F.when(n % 5 == 0, F.lit("Another page")).alias("redirect"), F.lit(True).alias("exists"), F.when(n % 7 > 0, "Pokémon species").alias("categories"))
    chosen = files.chosen_titles(names, special.unionByName(bare))
    months = view(spark, d, "cards").groupBy(F.initcap("name").alias("page")).agg(F.sum(F.when(F.col("dex") % 8 == 0, 0).otherwise(F.col("dex"))).alias("views"))
    monthly = months.select(F.col("page").alias("title"), "views").unionByName(months.select(F.concat("page", F.lit(" (Pokémon)")).alias("title"), (F.col("views") * 2).alias("views"))).unionByName(months.select(F.col("page").alias("title"), F.lit(1).cast("long").alias("views")))
    return files.yearly_views(chosen, monthly).join(chosen, "name").select("name", "title", "views")


@query
def search_interest(spark, d):
    """Events of a card in a day as interest in it, in three batches that each have the day's purchases as their anchor."""
    rows = view(spark, d, "listings").withColumn("batch", (F.col("card_id") % 3).cast("int"))
    terms = rows.groupBy("batch", F.concat(F.lit("card "), F.col("card_id")).alias("term"), "date").agg(F.count(F.lit(1)).cast("int").alias("value"))
    anchor = rows.groupBy("batch", F.lit("Anchor").alias("term"), "date").agg(F.count(F.when((F.col("event_type") == "purchase") & (F.day("date") % 5 > 0), 1)).cast("int").alias("value"))
    return files.interest_scores(terms.unionByName(anchor), "Anchor").select("name", "score", F.size("weekly").alias("n_days"))


@query
def private_ids(spark, d):
    """Ids of the newest day kept apart and put back; all others are gone."""
    public, side = files.split_private(view(spark, d, "snapshots"))
    return files.restore_private(public, side).select("card_id", "date", "active", F.size("item_ids").alias("n_ids"))


@query
def staged_problems(spark, d):
    """Files that must not be published: a key at any depth, a broken file that names it."""
    c = view(spark, d, "cards")
    k = F.col("card_id") % 6
    body = (
        F.when(k == 0, F.to_json(F.struct(F.struct(F.array(F.struct(F.array().cast("array<string>").alias("item_ids"))).alias("a")).alias("b"))))
        .when(k == 1, "broken item_ids {").when(k == 2, "broken {").when(k == 3, F.to_json(F.struct(F.lit("no item_ids here").alias("text")))).otherwise(F.to_json(F.struct("name")))
    )
    name = F.concat(F.lit("f"), F.col("card_id").cast("string"), F.when(F.col("card_id") % 4 == 0, ".txt").otherwise(".JSON"))
    return files.staged_problems(c.select(name.alias("name"), body.cast("binary").alias("content")))


@query
def json_rows(spark, d):
    return files.as_json(view(spark, d, "cards").select("card_id", "name", F.lit(None).cast("double").alias("nothing"), (F.col("dex") / 2.0).alias("half")))


@query
def listing_pages(spark, d):
    """Search pages as JSON, read back as observations; every seventh page is broken in some way and so unknown."""
    rows = view(spark, d, "listings").where("value > 0")
    item = F.struct(
        F.col("item").alias("itemId"), F.when(F.col("event_type") == "signup", "slab PSA 9").otherwise("card").alias("title"),
        F.struct(F.col("value").cast("decimal(10,2)").cast("string").alias("value"), F.when(F.col("event_type") == "error", "EUR").otherwise("USD").alias("currency")).alias("price"),
    )
    # All of a card is one page, so that there is something to band and to trim.  A band hangs on the last digit of the market price.
    pages = rows.groupBy("card_id").agg(F.sort_array(F.collect_list(item)).alias("itemSummaries"), F.count(F.lit(1)).alias("total"), stats.mean_in_order("value", "event_id", 2).alias("market"))
    body = F.to_json(F.struct("total", "itemSummaries"))
    k = F.col("card_id") % 28
    body = F.when(k == 0, "{}").when(k == 7, F.lit("[1, 2]")).when(k == 14, F.regexp_replace(body, '"total":(\\d+)', '"total":"$1"')).when(k == 21, '{"total":0,"itemSummaries":[]}').otherwise(body)
    real = files.observations(pages.select(F.col("card_id").alias("key"), body.alias("body"), "market"), ["key"], market="market")
    literal = files.observations(spark.createDataFrame(fx.PAGES, fx.PAGE), ["key"], page="page", market="market")
    return real.unionByName(literal).select("key", "known", "active", "average", F.size("item_ids").alias("n_ids"))


@query
def event_windows(spark, d):
    from tarnwick.streaming.snapshots import event_windows as windows

    out = windows(spark.read.parquet(f"{d}/events.parquet"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", r("value", 2))


@query
def daily_build(spark, d):
    from tarnwick.plans.daily import Inputs, build

    inputs = Inputs(*(view(spark, d, n) for n in ("cards", "sets", "snapshots", "panel", "overrides", "priors")))
    return build(inputs, F.lit(AS_OF))["scored"].select("card_id", "iq_score", r(F.col("expected_price") + 1e-9, 3, "expected_price"), r(F.col("residual") + 1e-9, 4, "residual"), "edge", "label", r("pull_cost", 3))


@query
def dated_log(spark, d):
    """A dated table after a write, a second one of some days, one that keeps what is there, and one that died half way."""
    import uuid

    from tarnwick.lineage import shared_folder
    from tarnwick.sources.dated import DatedTable

    table = DatedTable(f"{shared_folder(spark)}/dated-{uuid.uuid4().hex}")
    panel = cut(view(spark, d, "panel").select("date", "card_id", "price"))  # four writes; the join of all lines is made for the first
    year = F.year("date")
    table.write(panel.where(year <= 1996))
    table.write(panel.where(year == 1996).withColumn("price", F.col("price") * 2))
    table.write(panel.where(year.between(1996, 1998)).withColumn("price", F.col("price") * 3), keep=True)
    table.stage(panel.where(year >= 1998).withColumn("price", F.col("price") * 5))
    return table.read(spark).select("date", "card_id", r("price", 4))


@query
def stream_flows(spark, d):
    """Snapshots land as a file a day, the newest first, and are read one file at a time; the same rows as the batch form."""
    import uuid

    from tarnwick.lineage import shared_folder
    from tarnwick.shipping import ship
    from tarnwick.streaming import snapshots

    ship(spark)
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = view(spark, d, "snapshots").select(F.col("card_id").cast("long"), "date", F.col("active").cast("int"), "average", "item_ids")
    rows.repartition("date").write.partitionBy("date").parquet(f"{at}/days")
    rows = spark.read.schema(snapshots.COLUMNS).parquet(f"{at}/days")
    days = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("date")).collect()  # the span of the events, not their number
    for k, day in enumerate(days):  # reads that day's folder alone
        rows.where(F.col("date") == F.lit(day["date"])).coalesce(1).write.parquet(f"{at}/in/{k:05d}")
    groups, partitions = snapshots.sizes(spark, sum(day["n"] for day in days))
    stream = snapshots.flows(snapshots.read(spark, f"{at}/in", 1), groups=groups)
    snapshots.write_by_day(stream, f"{at}/out", f"{at}/log", partitions=partitions).awaitTermination()
    return snapshots.latest(spark, f"{at}/out").select("card_id", "date", "active", "new_listings", "ended_listings", "est_sold", "est_unsold")
