"""Recent price moves and the label that fuses them with supply and demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick import constants as C
from tarnwick.functions.scores import fixed, ladder
from tarnwick.operators.asof import first_in_window

# Label and tone by (price state, market state).
TABLE = {
    ("up", "tightening"): ("Heating up", "hot"),
    ("up", "loosening"): ("Overextended — price up, supply building", "caution"),
    ("up", "steady"): ("Rising — no clear market driver", "warm"),
    ("up", "unknown"): ("Rising", "warm"),
    ("down", "tightening"): ("Opportunity — dipping with firm demand", "opportunity"),
    ("down", "loosening"): ("Cooling — price and demand sliding", "cold"),
    ("down", "steady"): ("Easing", "cool"),
    ("down", "unknown"): ("Falling", "cool"),
    ("flat", "tightening"): ("Demand building", "warm"),
    ("flat", "loosening"): ("Supply building", "cool"),
    ("flat", "steady"): ("Quiet — no recent divergence", "neutral"),
    ("flat", "unknown"): ("Quiet", "neutral"),
    ("unknown", "tightening"): ("Demand building", "warm"),
    ("unknown", "loosening"): ("Supply building", "cool"),
    ("unknown", "steady"): ("Quiet — no recent divergence", "neutral"),
    ("unknown", "unknown"): ("Awaiting data", "neutral"),
}


def price_moves(panel: DataFrame, key: str = "card_id", value: str = "price", as_of: Column | None = None) -> DataFrame:
    """Rows (key, pct, days, from_price, to_price, n): the latest price against the earliest within seven days of it.

    Keys without a second date in the window, or with a base that is not positive, have no row.
    """
    rows = panel.where(F.col(value) > 0)
    if as_of is not None:
        rows = rows.where(F.col("date") <= as_of)
    found = first_in_window(rows, key, value, C.PRICE_WINDOW_DAYS).where("from_date < to_date")
    change = F.round(100.0 * F.try_divide(F.col("to_value") - F.col("from_value"), F.col("from_value")), 2)
    return found.select(key, change.alias("pct"), F.datediff("to_date", "from_date").alias("days"), F.round("from_value", 2).alias("from_price"), F.round("to_value", 2).alias("to_price"), "n")


def price_state(pct: Column) -> Column:
    return ladder((pct.isNull(), "unknown"), (pct >= C.PRICE_UP, "up"), (pct <= C.PRICE_DOWN, "down"), default="flat")


def market_state(status: Column, demand: Column, saturation: Column) -> Column:
    tight = F.coalesce(demand >= C.DEMAND_HOT, F.lit(False)) | F.coalesce(saturation < C.SATURATION_LOW, F.lit(False))
    loose = F.coalesce(saturation > C.SATURATION_HIGH, F.lit(False))
    known = F.coalesce(status == "ok", F.lit(False))
    return ladder((~known, "unknown"), (tight & ~loose, "tightening"), (loose & ~tight, "loosening"), default="steady")


def signals(rows: DataFrame, pct: str = "pct", days: str = "days", status: str = "status", demand: str = "demand_pressure", saturation: str = "supply_saturation") -> DataFrame:
    """``rows`` plus ``price_state, market_state, label, tone, confidence, detail, basis``."""
    p, sat = F.col(pct), F.col(saturation)
    out = rows.withColumns({"price_state": price_state(p), "market_state": market_state(F.col(status), F.col(demand), sat)})
    pair = F.concat_ws("|", "price_state", "market_state")
    look = lambda k: F.create_map(*[F.lit(x) for key, v in TABLE.items() for x in ("|".join(key), v[k])])[pair]
    known = F.col("market_state") != "unknown"
    span = F.when(F.coalesce(F.col(days), F.lit(0)) > 0, F.concat(F.col(days).cast("string"), F.lit("d"))).otherwise("recent")
    percent = F.concat(F.lit("price "), F.when(p >= 0, "+").otherwise(""), fixed(p, 1), F.lit("% ("), span, F.lit(")"))
    flow = F.when(known & F.col(demand).isNotNull(), F.concat(F.lit("sell-through "), fixed(F.col(demand), 0), F.lit("%")))
    supply = F.when(known & (F.abs(sat - 1) >= 1 - C.SATURATION_LOW), F.concat(F.lit("supply ×"), fixed(sat, 2)))
    basis = F.struct("price_state", "market_state", p.alias("price_pct"), F.col(demand).alias("demand_pressure"), sat.alias("supply_saturation"))
    return out.withColumns(
        {
            "label": look(0),
            "tone": look(1),
            "confidence": ladder((known & p.isNotNull(), "full"), (known, "full"), (p.isNotNull(), "price_only"), default="none"),
            "detail": F.concat_ws(" · ", F.when(p.isNotNull(), percent), flow, supply),
            "basis": basis,
        }
    )
