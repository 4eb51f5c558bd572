"""Scores, gates, bands and display rules as column functions.

Divisions are guarded (`try_divide` or a condition), so a missing or zero denominator gives null and not an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick import constants as C


def ladder(*steps: tuple[Column, object], default: object = None) -> Column:
    """The value of the first condition that holds."""
    out = F.when(steps[0][0], steps[0][1])
    for condition, value in steps[1:]:
        out = out.when(condition, value)
    return out.otherwise(default)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def months_between(later: Column, earlier: Column) -> Column:
    """Months of 30.4375 days, not below 0."""
    return F.greatest(F.lit(0.0), F.datediff(later, earlier) / F.lit(C.DAYS_PER_MONTH))


def rarity_rank(rarity: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for k, r in enumerate(C.RARITY_ORDER) for x in (r, k / (len(C.RARITY_ORDER) - 1))])
    return F.coalesce(ranks[rarity], F.lit(C.NEUTRAL_RANK))


def chase_weight(rarity: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in C.CHASE_WEIGHTS.items() for x in pair])
    return F.coalesce(weights[rarity], F.lit(0.0))


def scarcity(rarity: Column, months: Column) -> Column:
    by_rank, by_age = C.SCARCITY_WEIGHTS
    return F.round(10.0 * (by_rank * rarity_rank(rarity) + by_age * F.least(months / C.SCARCITY_MONTHS, F.lit(1.0))), 4)


def iq_score(scarcity_: Column, premium: Column, set_rank: Column, momentum: Column | None = None) -> Column:
    """0 to 100 from three live signals; a momentum between 0 and 1 takes a fifth of the weight where it is given."""
    parts = {
        "scarcity": clamp(F.coalesce(scarcity_, F.lit(0.0)) / 10.0),
        "char_premium": clamp(F.coalesce(premium, F.lit(0.0)) / 10.0),
        "set_rank": clamp(F.coalesce(set_rank, F.lit(0.5))),
    }
    blended = sum((parts[k] * w for k, w in C.IQ_WEIGHTS.items()), F.lit(0.0))
    if momentum is not None:
        blended = F.when(momentum.isNull(), blended).otherwise(0.8 * blended + 0.2 * clamp(momentum))
    return F.round(100.0 * clamp(blended), 2)


def pageview_score(views: Column) -> Column:
    return F.when(views <= 0, F.lit(0.0)).otherwise(F.round(clamp(F.log10(views.cast("double")) + 4.0, 6.5, 9.9), 4))


def poll_score(votes: Column) -> Column:
    return F.round(clamp(2.44 * F.log10(votes.cast("double")) - 3.27, C.PRIOR_FLOOR, 9.3), 4)


def search_interest_score(ratio: Column) -> Column:
    return F.when(ratio <= 0, F.lit(0.0)).otherwise(F.round(clamp(10.0 + 4.0 * F.log10(ratio), 0.0, 10.0), 3))


def combined_prior(poll: Column, views: Column) -> Column:
    """Both: 0.7 of the higher and 0.3 of the lower; views alone are capped; null without either."""
    both = 0.7 * F.greatest(poll, views) + 0.3 * F.least(poll, views)
    return F.when(poll.isNotNull() & views.isNotNull(), both).otherwise(F.coalesce(poll, F.when(views.isNotNull(), F.least(views, F.lit(C.SINGLE_SOURCE_CAP)))))


def pull_rate(rate: Column, n: Column) -> Column:
    """Chance of one given card in a pack: the tier's over the number of cards in it, 0 where either is not positive."""
    return F.when((n > 0) & (rate > 0), F.try_divide(rate, n)).otherwise(F.lit(0.0))


def pull_cost(pack_price: Column, rate: Column) -> Column:
    """Packs' price for one given card; 0 where it can't be pulled."""
    return F.when(rate > 0, F.try_divide(pack_price, rate)).otherwise(F.lit(0.0))


def signal(value: Column, cost: Column) -> Column:
    """(value - cost) / cost where the cost is positive."""
    return F.when(cost > 0, F.try_divide(value - cost, cost))


def verdict(residual: Column, band: float = C.VERDICT_BAND) -> Column:
    return ladder((residual.isNull(), None), (residual < -band, "under"), (residual > band, "over"), default="fair")


def edge_reason(price: Column, expected: Column, months: Column) -> Column:
    """Why no call is made on a card (null: a call is made).  Fresh and unpriced cards always get one."""
    low, high = C.DEAD_ZONE
    fresh = F.coalesce(months <= C.FRESH_DAYS / C.DAYS_PER_MONTH, F.lit(False))
    return ladder(
        (fresh | price.isNull(), None),
        ((price >= low) & (price < high), C.REASON_MID),
        ((expected > 0) & (price > C.CHASE_MULTIPLE * expected), C.REASON_CHASE),
    )


def surfaced(age_days: Column, price: Column) -> Column:
    """The backtest's gate: fresh by a known age, or outside the dead zone; no chase rule."""
    low, high = C.DEAD_ZONE
    return F.coalesce(age_days.between(0, C.FRESH_DAYS), F.lit(False)) | ~((price >= low) & (price < high))


def client_edge(edge: Column, months: Column, price: Column) -> Column:
    """The stored flag; without one, the rule for mature mid-priced cards."""
    low, high = C.DEAD_ZONE
    mature = ~F.coalesce(months <= C.FRESH_DAYS / C.DAYS_PER_MONTH, F.lit(False))
    return F.coalesce(edge, ~(mature & F.coalesce((price >= low) & (price < high), F.lit(False))))


def rarity_group(rarity: Column) -> Column:
    r = F.lower(F.coalesce(rarity, F.lit("")))
    return ladder(
        (r.contains("hyper"), "Hyper Rare"),
        (r.contains("special illustration"), "Special Illustration Rare"),
        (r.contains("illustration"), "Illustration Rare"),
        (r.contains("ultra") | r.contains("mega"), "Ultra/Mega Rare"),
        (r.contains("double"), "Double Rare"),
        (r.isin("common", "uncommon", "rare"), "Common/Uncommon/Rare"),
        default="Other",
    )


def price_tier(price: Column) -> Column:
    return ladder((price < 5, "$2-5"), (price < 20, "$5-20"), (price < 100, "$20-100"), (price >= 100, "$100+"))


def age_bucket(days: Column) -> Column:
    fresh, young, old, mature = C.AGE_BUCKETS
    return ladder((days < 0, None), (days <= 35, fresh), (days <= 90, young), (days <= 180, old), (days > 180, mature))


def sold_split(ended: Column, average: Column, average_before: Column) -> Column:
    """How many of the ended listings were sales: 60 %, more where prices fell and less where they rose; half to even."""
    drift = F.try_divide(average - average_before, average_before)
    usable = average.isNotNull() & (average != 0) & (average_before > 0)
    share = F.when(usable, clamp(0.6 - 1.5 * drift, 0.35, 0.85)).otherwise(F.lit(0.6))
    return F.when(ended == 0, F.lit(0)).otherwise(F.bround(ended * share, 0)).cast("int")


def ev_pill(value: Column) -> Column:
    return ladder((value.isNull(), None), (value >= 0.10, "Undervalued"), (value <= -0.10, "Overvalued"), default="Fair")


def saturation_tag(saturation: Column) -> Column:
    shift = F.concat(fixed(F.abs(saturation - 1) * 100, 0), F.lit("%"))
    tight, loose = F.concat(F.lit("tightening −"), shift), F.concat(F.lit("loosening +"), shift)
    return ladder((saturation.isNull(), C.DASH), (saturation < C.SATURATION_LOW, tight), (saturation > C.SATURATION_HIGH, loose), default="steady")


def ic_tone(ic: Column) -> Column:
    return ladder((ic.isNull(), None), (ic >= 0.04, "good"), (ic <= -0.02, "bad"), default="neutral")


def trend_chip(trend: Column) -> Column:
    return ladder((trend.isNull(), None), (F.abs(trend) <= 0.005, "flat"), (trend > 0, "up"), default="down")


def trajectory(t30: Column, t90: Column, t180: Column) -> Column:
    t90, t180 = F.coalesce(t90, F.lit(0.0)), F.coalesce(t180, F.lit(0.0))
    falling, cooling, accelerating, steady, flat, choppy = C.TRAJECTORIES
    return ladder(
        (t30.isNull(), None),
        ((t30 <= -0.04) & (t90 <= 0), falling),
        ((t30 <= -0.03) & (t180 > 0.15), cooling),
        ((t30 >= 0.05) & (t90 >= 0.10), accelerating),
        ((t30 >= 0.02) & (t90 >= 0), steady),
        (F.abs(t30) < 0.03, flat),
        default=choppy,
    )


def series_confidence(points: Column) -> Column:
    return ladder((points < 20, "low"), (points < 45, "med"), default="high")


def under_market(best: Column, market: Column) -> Column:
    """Percent below market, a whole number."""
    return F.when(market > 0, F.round((1 - F.try_divide(best, market)) * 100, 0).cast("int"))


def saturation_gauge(saturation: Column) -> Column:
    return clamp(saturation - 0.5)


def demand_gauge(demand: Column) -> Column:
    return clamp(demand / 0.40)


def dollars(x: Column, digits: int = 2) -> Column:
    """``$1,234.50``; a dash where there is no number."""
    return F.when(x.isNull() | F.isnan(x), C.DASH).otherwise(F.concat(F.lit("$"), F.format_number(F.round(x, digits), digits)))


def fixed(x: Column, digits: int) -> Column:
    """A number with so many digits and no separators."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def shipping_label(shipping: Column, item_price: Column, price: Column) -> Column:
    """What is known of shipping: not listed, on top of the item's price, or none."""
    unknown, paid, free = C.SHIPPING
    on_top = F.format_string(paid, dollars(item_price, 0), dollars(shipping, 0))
    return ladder((shipping.isNull(), unknown), (F.coalesce(price > item_price + 0.001, F.lit(False)), on_top), default=free)


def short_count(n: Column) -> Column:
    """1234 as 1.2k."""
    return F.when(n >= 1000, F.concat(fixed(n / 1000.0, 1), F.lit("k"))).otherwise(n.cast("string"))


def sealed_line(price: Column, change: Column, sold: Column, listings: Column, as_of: Column) -> Column:
    """Price, change of a day, sales and listings of a pack in one line; null without a pack."""
    change, sold = F.coalesce(change, F.lit(0.0)), F.coalesce(sold.cast("long"), F.lit(0))
    arrow = F.when(change >= 0, "▲").otherwise("▼")
    listed = F.coalesce(short_count(listings), F.lit(C.DASH))
    when = F.concat(F.lit("24h"), F.coalesce(F.concat(F.lit(" to "), as_of.cast("string")), F.lit("")))
    line = F.concat(dollars(price), F.lit(" "), arrow, F.lit(" "), fixed(F.abs(change), 1), F.lit("% · "), F.format_number(sold, 0), F.lit(" sold · "), listed, F.lit(" listed "), when)
    return line


def flow_panel(status: Column, active: Column, new_7: Column, sold_7: Column) -> Column:
    """Labelled numbers of the flow panel, for cards with a live reading only."""
    shown = lambda x: F.coalesce(F.format_number(x.cast("long"), 0), F.lit(C.DASH))
    cells = [F.struct(F.lit(label).alias("label"), shown(x).alias("value")) for label, x in zip(C.FLOW_CELLS, (active, new_7, sold_7))]
    return F.when(status == "ok", F.array(*cells))


def population_panel(total: Column, g10: Column, rate: Column) -> Column:
    """Labelled numbers of the grading panel, for cards with a population only."""
    gem = F.coalesce(F.concat(fixed(100 * rate, 1), F.lit("%")), F.lit(C.DASH))
    values = (F.format_number(total.cast("long"), 0), F.format_number(F.coalesce(g10.cast("long"), F.lit(0)), 0), gem)
    return F.when(F.coalesce(total > 0, F.lit(False)), F.array(*[F.struct(F.lit(label).alias("label"), x.alias("value")) for label, x in zip(C.POPULATION_CELLS, values)]))


def feature_text(feature: str, x: Column) -> Column:
    """A feature's value as the sliders show it."""
    shown = dollars(x, 0) if feature == "pull_cost" else F.concat(fixed(x, 0), F.lit(" mo")) if feature == "months_since_release" else fixed(x, 2)
    return F.when(x.isNull(), C.DASH).otherwise(shown)


def slider_contribution(coef: Column, x: Column, mean: Column, std: Column) -> Column:
    """What the moved slider does to the estimate, in log price; a feature that does not vary has no effect."""
    z = coef * F.try_divide(x - mean, std)
    way = F.when(z > 0.0005, C.SLIDER[0]).when(z < -0.0005, C.SLIDER[1]).otherwise(C.SLIDER[2])
    text = F.concat(way, F.lit(" the estimate (contribution "), F.when(z >= 0, "+").otherwise(""), fixed(z, 3), F.lit(" in log-price)"))
    return F.when(std == 0, C.SLIDER[3]).otherwise(text)


def calendar_day(iso: Column, zone: str | None = None) -> Column:
    """The calendar day of an ISO text: a bare date is that day, a time stamp is read in the viewer's time zone."""
    stamp = F.try_to_timestamp(iso)
    local = stamp if zone is None else F.from_utc_timestamp(F.to_utc_timestamp(stamp, F.current_timezone()), zone)
    return F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(iso, "yyyy-MM-dd")).otherwise(local.cast("date"))


def age_label(today: Column, day: Column) -> Column:
    days = F.datediff(today, day)
    return ladder((days.isNull(), None), (days <= 0, "Today"), (days == 1, "Yesterday"), default=F.concat(days.cast("string"), F.lit(" days ago")))


def shown_listing(kind: Column, hours_to_end: Column) -> Column:
    """Fixed-price listings always, auctions in their last 24 hours."""
    return F.coalesce((kind == "bin") | hours_to_end.between(0, 24), F.lit(False))


def refresh_banner(today: Column, prices_as_of: Column, built: Column) -> Column:
    """A struct (kicker, label, sub, days): the age of the prices where it is known, else that of the build."""
    priced, of_build, nothing = C.BANNER
    old = F.when(F.datediff(today, prices_as_of) >= 3, C.REFRESH).otherwise("")
    parts = lambda kicker, label, sub, days: F.struct(F.lit(kicker).alias("kicker"), label.alias("label"), sub.alias("sub"), days.alias("days"))
    prices = parts(priced, age_label(today, prices_as_of), F.concat(F.lit("as of "), prices_as_of.cast("string"), old), F.datediff(today, prices_as_of))
    site = parts(of_build, age_label(today, built), F.concat(F.lit("on "), built.cast("string")), F.datediff(today, built))
    return ladder((prices_as_of.isNotNull(), prices), (built.isNotNull(), site), default=parts(of_build, F.lit("Unknown"), F.lit(nothing), F.lit(None).cast("int")))


def usable_listing(item_id: Column, value: Column, currency: Column) -> Column:
    """A listing that says something: an id, a currency, and a finite positive price."""
    price = value.try_cast("double")
    finite = price.isNotNull() & ~F.isnan(price) & (price > 0) & (price < float("inf"))
    return F.coalesce((F.trim(item_id) != "") & (F.trim(currency) != "") & finite, F.lit(False))


def in_price_band(price: Column, market: Column) -> Column:
    low, high = C.PRICE_BAND
    return F.when(market >= C.BAND_ANCHOR, price.between(low * market, high * market)).otherwise(F.lit(True))
