"""The named queries in DuckDB's SQL, written apart from the DataFrame plans they check."""

from __future__ import annotations

import itertools

from tarnwick import constants as C
from tarnwick.operators.labels import TABLE
from tarnwick.plans import fixtures as fx
from tarnwick.plans.testmap import duck

AS_OF, LAST_DAY = "DATE '2001-08-02'", "DATE '2024-01-30'"


def values(pairs) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in p) + ")" for p in pairs)


def sql(*views: str, ctes: str = "", select: str) -> str:
    return duck(*views) + (", " + ctes.strip().rstrip(",") if ctes else "") + " " + select


ORDER = f"tiers(rarity, ord) AS (VALUES {values([(r, k / 13) for k, r in enumerate(C.RARITY_ORDER)])})"
CHASE = f"chases(rarity, w) AS (VALUES {values(C.CHASE_WEIGHTS.items())})"
RATES = f"base(rarity, rate) AS (VALUES {values(C.TIER_RATES.items())})"
PULLS = f"""{RATES},
 tiercount AS (SELECT set_id, rarity, count(*) AS n_in_tier FROM cards GROUP BY ALL),
 pulled AS (SELECT c.*, coalesce(o.rate, b.rate, 0.05::DOUBLE) AS tier_rate, n_in_tier,
   CASE WHEN coalesce(o.rate, b.rate, 0.05::DOUBLE) > 0 THEN coalesce(o.rate, b.rate, 0.05::DOUBLE) / n_in_tier ELSE 0::DOUBLE END AS pull_rate
   FROM cards c LEFT JOIN base b USING (rarity) LEFT JOIN overrides o ON o.set_id = c.set_id AND o.rarity = c.rarity
   JOIN tiercount t ON t.set_id = c.set_id AND t.rarity = c.rarity)"""


def signal(v: str, c: str) -> str:
    return f"CASE WHEN {c} > 0 THEN ({v} - {c}) / {c} END"


def premium(source: str = "cards", by: str = "", priors: bool = True) -> str:
    """Views chars and prem: the character premium, per ``by`` where it is given."""
    k, p = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    mixed = """(CASE WHEN poll IS NOT NULL AND views IS NOT NULL THEN 0.7::DOUBLE * greatest(poll, views) + 0.3::DOUBLE * least(poll, views)
               ELSE coalesce(poll, CASE WHEN views IS NOT NULL THEN least(views, 8.3::DOUBLE) END) END)"""
    prior = f"LEFT JOIN (SELECT key, coalesce(override, {mixed}) AS prior FROM priors) pr ON pr.key = base_name" if priors else "CROSS JOIN (SELECT NULL::DOUBLE AS prior) pr"
    return f"""{CHASE},
 chars AS (SELECT {k}base_name, count(*) AS n_printings, count(DISTINCT set_id) AS n_sets, round(sum(coalesce(w, 0))::DOUBLE, 9) AS chase,
   bool_or(dex BETWEEN 1 AND 151) AS is_old FROM {source} LEFT JOIN chases USING (rarity) GROUP BY ALL),
 pct AS (SELECT *, round(0.35::DOUBLE * cume_dist() OVER ({p}ORDER BY ln(1 + n_printings)) + 0.30::DOUBLE * cume_dist() OVER ({p}ORDER BY ln(1 + n_sets))
   + 0.35::DOUBLE * cume_dist() OVER ({p}ORDER BY ln(1 + chase)), 12) AS blend FROM chars),
 struct AS (SELECT *, 10 * cume_dist() OVER ({p}ORDER BY blend) AS structural FROM pct),
 based AS (SELECT s.*, coalesce(prior, structural / 10 * 6.0::DOUBLE) AS b FROM struct s {prior}),
 prem AS (SELECT {k}base_name, round(CASE WHEN is_old AND b < 9.5 THEN least(9.5::DOUBLE, b + 0.75::DOUBLE) ELSE b END, 4) AS char_premium,
   round(structural, 6) AS structural, n_printings, n_sets, chase FROM based)"""


def feats(source: str = "cards", by: str = "", as_of: str = AS_OF, priors: bool = True) -> str:
    k, j = (f"{by}, ", f"p.{by} = c.{by} AND ") if by else ("", "")
    return f"""{premium(source, by, priors)}, {ORDER},
 ranked AS (SELECT c.*, coalesce(ord, 0.5::DOUBLE) AS o, round(coalesce(greatest(0, ({as_of} - release_date) / 30.4375::DOUBLE), 0), 6) AS months_since_release
   FROM {source} c LEFT JOIN tiers USING (rarity)),
 feat AS (SELECT c.*, round(cume_dist() OVER (PARTITION BY {'c.' + by + ', ' if by else ''}set_id ORDER BY o), 4) AS set_rank,
   round(10 * (0.7::DOUBLE * o + 0.3::DOUBLE * least(months_since_release / 60.0::DOUBLE, 1.0::DOUBLE)), 4) AS scarcity, p.char_premium,
   supertype || ' · ' || CASE rarity WHEN 'MEGA_ATTACK_RARE' THEN 'Hyper Rare' WHEN 'Mega Hyper Rare' THEN 'Special Illustration Rare' ELSE rarity END AS cluster
   FROM ranked c LEFT JOIN prem p ON {j}p.base_name = c.base_name)"""


def ridge3(keys: str, source: str, name: str, f: tuple[str, ...], alpha: float = 1.0) -> str:
    """Closed form by Cramer's rule for two or three features over ``source`` (y, features)."""
    n = len(f)
    select = ", ".join([f"avg({x}) AS mean_{x}, stddev_pop({x}) AS s_{x}, covar_pop({x}, y) AS y_{x}" for x in f] + [f"covar_pop({a}, {b}) AS c_{a}_{b}" for i, a in enumerate(f) for b in f[i + 1 :]])
    std = ", ".join(f"CASE WHEN s_{x} < 1e-12 THEN 1.0::DOUBLE ELSE s_{x} END AS std_{x}" for x in f)
    ent = [f"n * CASE WHEN s_{x} >= 1e-12 THEN 1 ELSE 0 END + {alpha}::DOUBLE AS m{i}{i}, n * CASE WHEN s_{x} >= 1e-12 THEN y_{x} / std_{x} ELSE 0 END AS r{i}" for i, x in enumerate(f)]
    ent += [f"n * CASE WHEN s_{a} >= 1e-12 AND s_{f[j]} >= 1e-12 THEN c_{a}_{f[j]} / (std_{a} * std_{f[j]}) ELSE 0 END AS m{i}{j}" for i, a in enumerate(f) for j in range(i + 1, n)]
    if n == 3:
        det = "(m00 * (m11 * m22 - m12 * m12) - m01 * (m01 * m22 - m12 * m02) + m02 * (m01 * m12 - m11 * m02))"
        sol = [
            "(r0 * (m11 * m22 - m12 * m12) - m01 * (r1 * m22 - m12 * r2) + m02 * (r1 * m12 - m11 * r2))",
            "(m00 * (r1 * m22 - m12 * r2) - r0 * (m01 * m22 - m12 * m02) + m02 * (m01 * r2 - r1 * m02))",
            "(m00 * (m11 * r2 - r1 * m12) - m01 * (m01 * r2 - r1 * m02) + r0 * (m01 * m12 - m11 * m02))",
        ]
    else:
        det, sol = "(m00 * m11 - m01 * m01)", ["(r0 * m11 - m01 * r1)", "(m00 * r1 - m01 * r0)"]
    coef = ", ".join(f"{s} / {det} AS coef_{x}" for s, x in zip(sol, f))
    group = f"{keys}, " if keys else ""
    return f"""{name} AS (SELECT *, {coef} FROM (SELECT *, {', '.join(ent)} FROM (SELECT *, {std} FROM (
      SELECT {group}count(*) AS n, avg(y) AS intercept, {select} FROM {source} {'GROUP BY ALL' if keys else ''}))))"""


F3 = ("char_premium", "scarcity", "months_since_release")


def scored(by: str = "", f: tuple[str, ...] = F3, alpha: float = 1.0) -> str:
    b = f"{by}, " if by else ""
    on = f"o.{by} = c.{by} AND " if by else ""
    pick = lambda p: f"CASE WHEN o.n IS NOT NULL THEN o.{p} ELSE g.{p} END"
    z = {x: f"((coalesce(c.{x}, 0) - {pick('mean_' + x)}) / {pick('std_' + x)} * {pick('coef_' + x)})" for x in f}
    parts = ", ".join(f"{z[x]} AS z_{x}" for x in f)
    cols = ", ".join(f"coalesce({x}, 0)::DOUBLE AS {x}" for x in f)
    return f"""priced AS (SELECT {b}cluster, ln(market_price) AS y, {cols} FROM feat WHERE market_price > 0),
 {ridge3(b + 'cluster', 'priced', 'own', f, alpha)}, {ridge3(by, 'priced', 'whole', f, alpha)},
 scored AS (SELECT *, CASE WHEN expected_price > 0 THEN (market_price - expected_price) / expected_price END AS residual FROM (
   SELECT *, exp(b0 + {' + '.join('z_' + x for x in f)}) AS expected_price FROM (
   SELECT c.*, {pick('n')} AS model_n, {pick('intercept')} AS b0, {parts} FROM feat c LEFT JOIN (SELECT * FROM own WHERE n >= 12) o ON {on}o.cluster = c.cluster
   {'LEFT JOIN whole g ON g.' + by + ' = c.' + by if by else 'CROSS JOIN whole g'})))"""


MODEL = feats() + ", " + scored()
POOL = MODEL + """, rounded AS (SELECT * REPLACE (round(expected_price, 4) AS expected_price, round(residual, 6) AS residual) FROM scored),
 pool AS (SELECT *, round(expected_price - market_price, 2) AS raw_diff FROM rounded WHERE residual IS NOT NULL AND market_price >= 2.0 AND expected_price IS NOT NULL
   AND (months_since_release <= 35 / 30.4375::DOUBLE OR NOT ((market_price >= 20 AND market_price < 100) OR (expected_price > 0 AND market_price > 1.75::DOUBLE * expected_price))))"""

FLOWS = """prev AS (SELECT *, lag(active) OVER w AS a0, lag(average) OVER w AS v0, lag(item_ids) OVER w AS i0 FROM snapshots WINDOW w AS (PARTITION BY card_id ORDER BY date)),
 diffed AS (SELECT *, active IS NOT NULL AND a0 IS NOT NULL AS known, item_ids IS NOT NULL AND i0 IS NOT NULL AS gross FROM prev),
 counted AS (SELECT *, CASE WHEN NOT known THEN NULL WHEN gross THEN len(list_filter(item_ids, lambda x: NOT list_contains(i0, x))) ELSE greatest(active - a0, 0) END::INTEGER AS new_listings,
   CASE WHEN NOT known THEN NULL WHEN gross THEN len(list_filter(i0, lambda x: NOT list_contains(item_ids, x))) ELSE greatest(a0 - active, 0) END::INTEGER AS ended_listings FROM diffed),
 flows AS (SELECT *, ended_listings - est_sold AS est_unsold FROM (SELECT *, CASE WHEN NOT known THEN NULL WHEN ended_listings = 0 THEN 0
   ELSE round_even(ended_listings * CASE WHEN average IS NOT NULL AND average <> 0 AND v0 > 0 THEN greatest(0.35::DOUBLE, least(0.85::DOUBLE, 0.6::DOUBLE - 1.5::DOUBLE * ((average - v0) / v0))) ELSE 0.6::DOUBLE END, 0) END::INTEGER AS est_sold FROM counted))"""


def dyn(limit: str, current: str | None) -> str:
    stale = "l.active IS NULL" + (f" OR l.date <> {current}" if current else "")
    return FLOWS + f""",
 trail AS (SELECT *, sum(est_sold) OVER b::BIGINT AS sold_7, sum(new_listings) OVER b::BIGINT AS new_7, avg(active) OVER b AS a7, avg(active) OVER w AS a30 FROM flows WHERE date <= {limit}
   WINDOW b AS (PARTITION BY card_id ORDER BY date ROWS 6 PRECEDING), w AS (PARTITION BY card_id ORDER BY date ROWS 29 PRECEDING)),
 lastrow AS (SELECT * FROM trail QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY date DESC) = 1),
 info AS (SELECT card_id, count(*) AS days, max(CASE WHEN active IS NOT NULL THEN date END) AS last_observed FROM trail GROUP BY card_id),
 st AS (SELECT l.*, days, last_observed, ({stale}) AS stale FROM lastrow l JOIN info USING (card_id)),
 sat AS (SELECT *, NOT stale AND days < 2 AS single, CASE WHEN NOT stale AND days >= 2 AND active + sold_7 > 0 THEN round(100.0::DOUBLE * sold_7 / (active + sold_7), 4) END AS demand,
   coalesce(CASE WHEN NOT stale AND days >= 2 AND a30 > 0 THEN round(a7 / a30, 4) END, 1.0::DOUBLE) AS saturation FROM st),
 dyn AS (SELECT card_id, CASE WHEN stale OR single OR (demand IS NULL AND saturation = 1) THEN 'awaiting_data' ELSE 'ok' END AS status, demand AS demand_pressure, saturation AS supply_saturation,
   CASE WHEN NOT stale THEN active END AS active_listings, CASE WHEN NOT stale AND NOT single THEN sold_7 END AS sold_7, CASE WHEN NOT stale AND NOT single THEN new_7 END AS new_7,
   CASE WHEN stale THEN 'no_current_observation' END AS reason, CASE WHEN stale THEN last_observed END AS last_observed, days,
   CASE WHEN NOT stale AND NOT single THEN 7 END AS short_window, CASE WHEN NOT stale AND NOT single THEN 30 END AS long_window,
   CASE WHEN NOT (stale OR single OR (demand IS NULL AND saturation = 1)) THEN round(a7, 4) END AS short_active_avg,
   CASE WHEN NOT (stale OR single OR (demand IS NULL AND saturation = 1)) THEN round(a30, 4) END AS long_active_avg FROM sat)"""


def moves(limit: str) -> str:
    return f"""pts AS (SELECT *, max(date) OVER (PARTITION BY card_id) AS last FROM panel WHERE price > 0 AND date <= {limit}),
 ends AS (SELECT card_id, arg_min(price, date) FILTER (last - date <= 7) AS p0, min(date) FILTER (last - date <= 7) AS d0, arg_max(price, date) AS p1, max(date) AS d1, count(*) AS n FROM pts GROUP BY card_id),
 moves AS (SELECT card_id, round(100.0::DOUBLE * (p1 - p0) / p0, 2) AS pct, (d1 - d0)::INTEGER AS days, round(p0, 2) AS from_price, round(p1, 2) AS to_price, n FROM ends WHERE d0 < d1)"""


WALK = f"""at_ AS (SELECT p.date AS eval_date, c.*, p.price AS market_price FROM panel p JOIN panel_cards c USING (card_id) WHERE p.price > 0),
 atd AS (SELECT * FROM at_ WHERE eval_date IN (SELECT eval_date FROM at_ GROUP BY eval_date HAVING count(*) >= 12)),
 {{feats}}, {{scored}},
 resid AS (SELECT eval_date, card_id, market_price AS price, {{res}} AS residual, expected_price, (eval_date - release_date)::INTEGER AS age_days, rarity FROM scored)"""


def walk(f=F3, alpha=1.0, digits=True) -> str:
    return WALK.format(feats=feats("atd", "eval_date", "eval_date", priors=False), scored=scored("eval_date", f, alpha), res="round(residual, 9)" if digits else "residual")


GROUP = """CASE WHEN contains(lower(rarity), 'hyper') THEN 'Hyper Rare' WHEN contains(lower(rarity), 'special illustration') THEN 'Special Illustration Rare'
 WHEN contains(lower(rarity), 'illustration') THEN 'Illustration Rare' WHEN contains(lower(rarity), 'ultra') OR contains(lower(rarity), 'mega') THEN 'Ultra/Mega Rare'
 WHEN contains(lower(rarity), 'double') THEN 'Double Rare' WHEN lower(rarity) IN ('common', 'uncommon', 'rare') THEN 'Common/Uncommon/Rare' ELSE 'Other' END"""
TIER = "CASE WHEN price < 5 THEN '$2-5' WHEN price < 20 THEN '$5-20' WHEN price < 100 THEN '$20-100' ELSE '$100+' END"
BUCKET = "CASE WHEN age_days < 0 THEN NULL WHEN age_days <= 35 THEN '0-35d (fresh)' WHEN age_days <= 90 THEN '36-90d' WHEN age_days <= 180 THEN '91-180d' WHEN age_days > 180 THEN '180d+ (mature)' END"


def pairs(h=(28,)) -> str:
    return f"""ds AS (SELECT DISTINCT date FROM panel), hz(horizon) AS (VALUES {', '.join(f'({x})' for x in h)}),
 pairs AS (SELECT horizon, date, arg_min(nd, gap * 100000 + (nd - DATE '1990-01-01')) AS next_date FROM (
   SELECT horizon, a.date, b.date AS nd, abs(b.date - a.date - horizon) AS gap FROM ds a, ds b, hz WHERE b.date > a.date AND abs(b.date - a.date - horizon) <= 6) GROUP BY ALL)"""


def obs(h=(28,), f=F3, alpha=1.0) -> str:
    return f"""{walk(f, alpha)}, {pairs(h)},
 obs AS (SELECT horizon, r.eval_date AS date, r.card_id, -residual AS mispricing, (n.price - r.price) / r.price AS fwd, r.price, age_days, {GROUP} AS rarity_group
   FROM resid r JOIN pairs p ON p.date = r.eval_date JOIN panel n ON n.date = p.next_date AND n.card_id = r.card_id WHERE r.price >= 2.0 AND residual IS NOT NULL)"""


def rank(col: str, keys: str) -> str:
    """Twice the average rank, a whole number."""
    return f"(2 * rank() OVER (PARTITION BY {keys} ORDER BY {col}) + count(*) OVER (PARTITION BY {keys}, {col}) - 1)::HUGEINT"


#: Sums of whole numbers, so that a coefficient of 0 is 0.
RHO = """CASE WHEN sum(x * x) > count(*) * (count(*) + 1)::HUGEINT * (count(*) + 1) AND sum(y * y) > count(*) * (count(*) + 1)::HUGEINT * (count(*) + 1) THEN
 (sum(x * y) - count(*) * (count(*) + 1)::HUGEINT * (count(*) + 1))::DOUBLE
 / (sqrt((sum(x * x) - count(*) * (count(*) + 1)::HUGEINT * (count(*) + 1))::DOUBLE) * sqrt((sum(y * y) - count(*) * (count(*) + 1)::HUGEINT * (count(*) + 1))::DOUBLE)) END"""


def ics(source: str, keys: str = "", least: int = 8) -> str:
    k = f"{keys}, date" if keys else "date"
    return f"""rk AS (SELECT {k}, {rank('mispricing', k)} AS x, {rank('fwd', k)} AS y FROM {source}),
 ics AS (SELECT * FROM (SELECT {k}, count(*) AS n, {RHO} AS ic FROM rk GROUP BY ALL) WHERE n >= {least} AND ic IS NOT NULL)"""


def summary(keys: str, lag: str = "5") -> str:
    lags = range(1, 14)
    w = f"PARTITION BY {keys} ORDER BY date"
    g = ", ".join(f"avg(d * lag{l}) AS g{l}" for l in lags)  # noqa: E741
    terms = " + ".join(f"CASE WHEN {l} <= least(hac, n_dates - 1) THEN 2 * (1 - {l} / (hac + 1.0::DOUBLE)) * coalesce(g{l}, 0) ELSE 0 END" for l in lags)  # noqa: E741
    return f"""cen AS (SELECT *, ic - avg(ic) OVER (PARTITION BY {keys}) AS d, {lag} AS hac FROM ics),
 lagged AS (SELECT *, {', '.join(f'lag(d, {l}) OVER ({w}) AS lag{l}' for l in lags)} FROM cen),
 sm AS (SELECT {keys}, count(*) AS n_dates, avg(ic) AS m, stddev_pop(ic) AS s, sum((ic > 0)::INT)::BIGINT AS n_positive, avg(d * d) AS g0, max(hac) AS hac, {g} FROM lagged GROUP BY {keys}),
 smv AS (SELECT *, g0 + {terms} AS v FROM sm WHERE n_dates >= 5),
 summ AS (SELECT {keys}, n_dates, round(m, 4) AS mean_ic, round(s, 4) AS std_ic, round(CASE WHEN s > 1e-12 THEN m / (s / sqrt(n_dates)) END, 4) AS t_naive,
   round(CASE WHEN v > 1e-18 THEN m / sqrt(v / n_dates) END, 4) AS t_hac, n_positive, round((n_positive - n_dates / 2.0::DOUBLE) / (sqrt(n_dates) / 2), 4) AS sign_z FROM smv)"""


def pooled(bucket: str) -> str:
    return f"""bk AS (SELECT *, {bucket} AS bucket FROM obs), bb AS (SELECT bucket, fwd, {rank('mispricing', 'bucket')} AS x, {rank('fwd', 'bucket')} AS y FROM bk WHERE bucket IS NOT NULL)"""


POOLED = f"""SELECT * FROM (SELECT bucket, count(*) AS n, round({RHO}, 6) AS ic,
 round(avg((fwd > 0)::INT::DOUBLE), 6) AS frac_up, round(avg(fwd), 6) AS mean_return FROM bb GROUP BY bucket) WHERE n >= 30"""


def evaluated(label: str, f: tuple[str, ...], alpha: float) -> str:
    """The figures of one feature list: segments, tenths and the last fit."""
    ctes = obs((28,), f, alpha) + """, seg AS (SELECT *, unnest(list_filter(['all', CASE WHEN price >= 10 AND age_days > 90 THEN 'mature' END, CASE WHEN age_days BETWEEN 0 AND 35 THEN 'fresh' END], lambda x: x IS NOT NULL)) AS segment FROM obs), """
    ctes += ics("seg", "segment") + ", " + summary("segment") + """, dn AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY round(mispricing, 9), card_id) AS k FROM obs),
        lg AS (SELECT date, avg(fwd) FILTER (k > n - greatest(1, n // 10)) AS t, avg(fwd) FILTER (k <= greatest(1, n // 10)) AS b FROM dn WHERE n >= 20 GROUP BY ALL)"""
    pick = lambda segment, c: f"(SELECT {c} FROM summ WHERE segment = '{segment}')"
    select = f"""SELECT '{label}' AS list, {pick('fresh', 'mean_ic')} AS fresh_ic, {pick('fresh', 't_hac')} AS fresh_t, {pick('mature', 'mean_ic')} AS mature_ic, {pick('mature', 't_hac')} AS mature_t, {pick('all', 'mean_ic')} AS all_ic,
        (SELECT round(avg(t - b), 4) FROM lg) AS decile_spread, (SELECT round(corr(ln(market_price), ln(expected_price)) ** 2, 4) FROM scored WHERE eval_date = (SELECT max(eval_date) FROM scored)) AS r2_log"""
    return "(" + sql("panel", "panel_cards", ctes=ctes, select=select) + ")"


def trimmed(source: str, name: str) -> str:
    return f"""{name}q AS (SELECT card_id, count(value) AS c, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {source} GROUP BY card_id),
 {name} AS (SELECT card_id, CASE WHEN count(*) FILTER (ok) > 0 THEN count(*) FILTER (ok) ELSE count(*) END AS n,
   round(CASE WHEN count(*) FILTER (ok) > 0 THEN avg(value) FILTER (ok) ELSE avg(value) END + 1e-9::DOUBLE, 6) AS mean
   FROM (SELECT s.*, c < 4 OR value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM {source} s JOIN {name}q USING (card_id)) GROUP BY card_id)"""


TREND = """base AS (SELECT *, max(date) OVER (PARTITION BY card_id) AS last FROM panel),
 tr AS (SELECT card_id, arg_max(price, date) AS latest, count(*) AS n_points,
   arg_max(price, date) FILTER (date <= last - 30 AND date >= last - 44) AS b30, arg_max(price, date) FILTER (date <= last - 90 AND date >= last - 104) AS b90, arg_max(price, date) FILTER (date <= last - 180) AS b180
   FROM base GROUP BY card_id),
 tt AS (SELECT card_id, latest, n_points, round((latest - b30) / b30, 4) AS trend_30d, round((latest - b90) / b90, 4) AS trend_90d, round((latest - b180) / b180, 4) AS trend_180d FROM tr)"""

RCOLS = ", ".join(f"round({p}_{x} + 1e-9::DOUBLE, 5) AS {p}_{x}" for x in F3 for p in ("mean", "std", "coef"))
EXPORTED = ", ".join(f"{p}_{x}" for p in ("mean", "std", "coef") for x in F3)
MECH = "[" + ", ".join(f"'{m}'" for m in C.MECHANICS) + "]"
ORACLE: dict[str, str] = {
    "sealed_value": sql("cards", "sets", "overrides", ctes=PULLS + """, ev AS (SELECT set_id, sum(pull_rate * market_price) AS ev FROM pulled WHERE market_price IS NOT NULL GROUP BY set_id)""",
        select=f"""SELECT *, CASE WHEN box_signal IS NULL THEN NULL WHEN box_signal >= 0.10 THEN 'Undervalued' WHEN box_signal <= -0.10 THEN 'Overvalued' ELSE 'Fair' END AS pill FROM (
        SELECT s.set_id, round(coalesce(ev, 0), 7) AS ev_per_pack, round(coalesce(ev, 0) * packs_per_box, 7) AS ev_per_box, round({signal('coalesce(ev, 0)', 'pack_price')}, 7) AS pack_signal,
        round({signal('coalesce(ev, 0) * packs_per_box', 'box_price')}, 7) AS box_signal, round(pack_price - coalesce(ev, 0), 7) AS average_loss FROM sets s LEFT JOIN ev USING (set_id))"""),
    "rarity_counts": sql("cards", select="SELECT set_id, rarity, count(*) AS n FROM cards GROUP BY ALL"),
    "pull_costs": sql("cards", "sets", "overrides", ctes=PULLS, select="""SELECT card_id, round(tier_rate, 6) AS tier_rate, n_in_tier, round(pull_rate, 8) AS pull_rate,
        round(CASE WHEN pull_rate > 0 THEN pack_price / pull_rate ELSE 0 END, 4) AS pull_cost FROM pulled JOIN sets USING (set_id)"""),
    "sealed_overlay": sql("sets", ctes="feed AS (SELECT set_id, pack_price * 2 AS p FROM sets WHERE length(set_id) = 7)",
        select=f"SELECT set_id, coalesce(p, pack_price) AS pack_price, box_price FROM sets LEFT JOIN feed USING (set_id) UNION ALL SELECT * FROM {fx.values(fx.OVERLAY_WANT, 'set_id, pack_price, box_price')}"),
    "sealed_feed": sql("sets", ctes="""items AS (SELECT set_id, unnest([{'k': 1, 'name': 'Elite Trainer Box Pokemon Center', 'price': box_price * 2, 'sold': 1}, {'k': 2, 'name': 'Booster Pack', 'price': pack_price, 'sold': 2},
          {'k': 3, 'name': 'Elite Trainer Box Plus', 'price': box_price, 'sold': 3}, {'k': 4, 'name': 'Booster Pack', 'price': box_price, 'sold': 4}]) AS i FROM sets),
        pk AS (SELECT set_id, arg_min(i.price, i.k) AS price, arg_min(i.sold, i.k) AS sold FROM items WHERE i.name = 'Booster Pack' GROUP BY set_id),
        bx AS (SELECT set_id, arg_min(i.price, i.k) AS price, arg_min(i.sold, i.k) AS sold FROM items WHERE starts_with(i.name, 'Elite Trainer Box') AND NOT contains(i.name, 'Pokemon Center') GROUP BY set_id)""",
        select="SELECT set_id, DATE '2024-01-03' AS as_of, round(pk.price, 4) AS pack_price, pk.sold AS pack_sold, round(bx.price, 4) AS box_price, bx.sold AS box_sold FROM pk JOIN bx USING (set_id)"),
    "sealed_staleness": sql("sets", select=f"""SELECT min(d) AS oldest, max(d) AS newest, CASE WHEN min(d) = max(d) THEN min(d)::VARCHAR ELSE min(d) || ' to ' || max(d) END AS label, {LAST_DAY} - min(d) > 14 AS stale FROM (SELECT DATE '2024-01-01' + (length(set_id) * 5)::INTEGER AS d FROM sets)"""),
    "base_names": sql("cards", select=f"""SELECT card_id, full_ AS "full", regexp_replace(trim(CASE WHEN supertype = 'Pokémon' THEN regexp_replace(full_, '^.*''s ', '') ELSE full_ END), '( (ex|EX|V|VMAX|VSTAR|GX|BREAK|LV\\.X|δ|Prime|Star))+$', '') AS base
        FROM (SELECT card_id, supertype, CASE WHEN card_id % 4 = 0 THEN 'Owner''s ' ELSE '' END || name || ' ' || {MECH}[(card_id % 11 + 1)::INTEGER] || CASE WHEN card_id % 3 = 0 THEN ' ex' ELSE '' END AS full_ FROM cards)"""),
    "normal_cards": sql("cards", select="""SELECT CASE WHEN card_id = 7 THEN 'zsv10pt5-171' ELSE 'x-' || card_id END AS id,
        regexp_replace(CASE WHEN supertype = 'Trainer' AND card_id % 4 = 0 THEN 'Owner''s ' ELSE '' END || name || CASE WHEN card_id % 3 = 0 THEN ' ex' ELSE '' END, '( ex)+$', '') AS base_name,
        supertype, CASE WHEN card_id = 7 THEN 'Black White Rare' WHEN card_id % 6 > 0 THEN rarity ELSE 'Unknown' END AS rarity, set_id, release_date, round(nullif(market_price, 0), 4) AS market_price,
        CASE WHEN market_price <> 0 THEN 'normal' END AS price_variant, dex FROM cards"""),
    "second_prices": sql("cards", ctes="""q AS (SELECT card_id, CASE WHEN card_id % 3 = 0 THEN market_price END AS h, CASE WHEN card_id % 4 = 0 THEN market_price * 2 END AS n, CASE WHEN card_id % 7 = 0 THEN market_price * 3 END AS o,
        CASE WHEN card_id % 5 > 0 THEN market_price END AS e FROM cards)""", select="""SELECT card_id, round(CASE WHEN h <> 0 THEN h WHEN n <> 0 THEN n WHEN o <> 0 THEN o WHEN e <> 0 THEN e * 1.08::DOUBLE END, 2) AS price,
        CASE WHEN h <> 0 THEN 'tcgplayer:holofoil' WHEN n <> 0 THEN 'tcgplayer:normal' WHEN o <> 0 THEN 'tcgplayer:odd' WHEN e <> 0 THEN 'cardmarket:avg(EUR->USD)' END AS variant FROM q"""),
    "archive_series": sql("panel", ctes="""g AS (SELECT *, floor(card_id / 100) AS g, CASE WHEN card_id % 3 = 0 THEN 'Normal' ELSE 'Odd' END AS subtype FROM panel WHERE price IS NOT NULL),
        whole AS (SELECT * FROM g WHERE NOT (g = 1 AND day(date) < 8)),
        pts AS (SELECT date, card_id, subtype, price FROM whole UNION ALL SELECT date, card_id, 'Holofoil', price * 2 FROM whole WHERE card_id % 2 = 0)""",
        select="""SELECT date, card_id, round(arg_min(price, CASE WHEN subtype = CASE WHEN card_id % 3 = 0 THEN 'Normal' ELSE 'Reverse Holofoil' END THEN 0 WHEN subtype = 'Holofoil' THEN 1 WHEN subtype = 'Normal' THEN 2 ELSE 6 END), 2) AS price
        FROM pts GROUP BY ALL"""),
    "search_interest": sql("listings", ctes="""t AS (SELECT card_id % 3 AS batch, 'card ' || card_id AS name, date, count(*) AS v FROM listings GROUP BY ALL),
        an AS (SELECT card_id % 3 AS batch, date, count(*) FILTER (event_type = 'purchase' AND day(date) % 5 > 0) AS a FROM listings GROUP BY ALL),
        ra AS (SELECT name, date, v / nullif(a, 0)::DOUBLE AS ratio FROM t LEFT JOIN an USING (batch, date)),
        k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ratio IS NULL, date DESC) AS k FROM ra),
        m AS (SELECT name, coalesce(avg(ratio) FILTER (k <= 8), 0) AS m, count(ratio)::INTEGER AS n_days FROM k GROUP BY name)""",
        select="""SELECT name, CASE WHEN m <= 0 THEN 0::DOUBLE ELSE round(greatest(0, least(10, 10 + 4 * log10(nullif(m, 0)))), 3)::DOUBLE END AS score, n_days FROM m UNION ALL SELECT 'Anchor', 10.0::DOUBLE, 0 WHERE EXISTS (SELECT 1 FROM listings)"""),
    "panels": sql("listings", ctes="""a AS (SELECT card_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS tens, round(avg(value), 2) AS price FROM listings GROUP BY card_id), b AS (SELECT *, n * 97 AS big, (price / 64 - 0.25::DOUBLE) / 2 * 0.5::DOUBLE AS z FROM a)""",
        select="""SELECT card_id, CASE WHEN card_id % 3 > 0 THEN 'active listings=' || format('{:,}', big) || '; new (7d)=' || CASE WHEN card_id % 2 = 0 THEN format('{:,}', n) ELSE '—' END || '; sold est (7d)=' || format('{:,}', tens) END AS flow,
        CASE WHEN card_id % 5 > 0 THEN 'graded total=' || format('{:,}', big) || '; PSA 10=' || format('{:,}', tens) || '; gem rate=' || printf('%.1f', 100 * (tens / n::DOUBLE)) || '%' END AS population,
        '$' || format('{:,.2f}', price) || CASE WHEN card_id % 2 = 0 AND price > 0 THEN ' ▼ ' ELSE ' ▲ ' END || printf('%.1f', CASE WHEN card_id % 2 = 0 THEN price / 16 ELSE 0 END) || '% · ' || format('{:,}', tens) || ' sold · '
          || CASE WHEN card_id % 7 = 0 THEN '—' WHEN big >= 1000 THEN printf('%.1f', big / 1000.0::DOUBLE) || 'k' ELSE big::VARCHAR END || ' listed 24h to 2024-01-02' AS line,
        CASE WHEN card_id % 4 = 0 THEN 'No price effect in this cluster (flat in the model).' ELSE CASE WHEN z > 0.0005 THEN '▲ raises' WHEN z < -0.0005 THEN '▼ lowers' ELSE '· neutral' END
          || ' the estimate (contribution ' || CASE WHEN z >= 0 THEN '+' ELSE '' END || printf('%.3f', z) || ' in log-price)' END AS slider, printf('%.0f', price) || ' mo' AS months FROM b"""),
    "folded_names": sql("cards", ctes="f AS (SELECT *, 'Flabébé ' || name || ' (Holo) - promo' AS x, 'Mega ' || name || ' X' AS m, CASE WHEN card_id % 2 = 0 THEN 'reverseholofoil' ELSE 'normal' END AS v FROM cards)",
        select="""SELECT card_id, regexp_replace(lower(strip_accents(x)), '[^a-z0-9]', '', 'g') AS folded, regexp_replace(lower(strip_accents(split_part(split_part(x, ' - ', 1), '(', 1))), '[^a-z0-9]', '', 'g') AS product,
        coalesce(nullif(ltrim(split_part('00' || number, '/', 1), '0'), ''), '0') AS number, CASE v WHEN 'reverseholofoil' THEN 'Reverse Holofoil' WHEN 'normal' THEN 'Normal' ELSE 'Holofoil' END AS variant,
        array_to_string(list_distinct_in_order, ',') AS keys, name || ' ' || number AS query, regexp_matches(' ' || lower(name || ' PSA 9') || ' ', ' psa | cgc | bgs | sgc |graded') AS graded
        FROM (SELECT *, [m, regexp_replace(m, '^Mega ', ''), regexp_replace(regexp_replace(m, '^Mega ', ''), ' [XYZ]$', '')] AS list_distinct_in_order FROM f)"""),
    "date_formats": sql("cards", select=f"""SELECT card_id, d AS day, round(greatest(0, ({AS_OF} - d) / 30.4375::DOUBLE), 4) AS months,
        CASE WHEN d IS NULL THEN NULL WHEN DATE '1995-03-01' - d <= 0 THEN 'Today' WHEN DATE '1995-03-01' - d = 1 THEN 'Yesterday' ELSE (DATE '1995-03-01' - d) || ' days ago' END AS label
        FROM (SELECT card_id, CASE WHEN card_id % 3 < 2 THEN release_date END AS d FROM cards)"""),
    "variant_pick": sql("cards", select="""SELECT card_id, variant, round(CASE variant WHEN 'reverseHolofoil' THEN p WHEN 'normal' THEN p * 2 WHEN 'other' THEN p * 3 END, 4) AS price FROM (
        SELECT card_id, market_price AS p, CASE WHEN market_price IS NULL OR market_price = 0 THEN NULL WHEN card_id % 3 = 0 THEN 'reverseHolofoil' WHEN card_id % 5 = 0 THEN 'normal' ELSE 'other' END AS variant FROM cards)"""),
    "subtype_price": sql("cards", ctes="""wanted AS (SELECT card_id, card_id // 5 AS product_id, ['Normal', 'Holofoil', 'Reverse Holofoil'][(card_id % 3 + 1)::INTEGER] AS wanted FROM cards WHERE market_price IS NOT NULL),
        prices AS (SELECT card_id // 5 AS product_id, CASE WHEN (card_id * 7919) % 11 < 3 THEN 'Holofoil' WHEN (card_id * 7919) % 11 < 6 THEN 'Normal' WHEN (card_id * 7919) % 11 < 9 THEN 'Reverse Holofoil' ELSE 'Foil' END AS subtype, max(market_price) AS price FROM cards WHERE market_price IS NOT NULL GROUP BY ALL)""",
        select="""SELECT card_id, price FROM (SELECT w.card_id, p.price, row_number() OVER (PARTITION BY card_id ORDER BY CASE WHEN subtype = wanted THEN 0 WHEN subtype = 'Holofoil' THEN 1 WHEN subtype = 'Normal' THEN 2 ELSE 3 END, subtype, price) AS k
        FROM wanted w JOIN prices p USING (product_id)) WHERE k = 1"""),
    "price_band_means": sql("listings", ctes=f"""mk AS (SELECT card_id, round(avg(value), 2) AS market FROM listings GROUP BY card_id),
        lm AS (SELECT l.card_id, value, market < 2 OR value BETWEEN 0.5 * market AND 4 * market AS inside FROM listings l JOIN mk USING (card_id)), kept AS (SELECT * FROM lm WHERE inside),
        {trimmed('lm', 'raw')}, {trimmed('kept', 'banded')}""",
        select="""SELECT r.card_id, r.n AS n_raw, r.mean AS mean_raw, b.n AS n_band, b.mean AS mean_band, dropped FROM raw r LEFT JOIN banded b USING (card_id) JOIN (SELECT card_id, sum((NOT inside)::INT)::BIGINT AS dropped FROM lm GROUP BY card_id) USING (card_id)"""),
    "usable_listings": sql("listings", ctes="""u AS (SELECT card_id, item, event_id % 13 <> 0 AND event_type <> 'error' AND value > 0 AS ok, event_id % 7 <> 0 AND event_type <> 'signup' AS fine FROM listings)""",
        select="""SELECT card_id, usable, counted, ids, CASE WHEN usable > 0 THEN counted END AS active FROM (SELECT card_id, sum(ok::INT)::BIGINT AS usable, sum((ok AND fine)::INT)::BIGINT AS counted, count(DISTINCT CASE WHEN ok AND fine THEN item END) AS ids FROM u GROUP BY card_id)"""),
    "gates": sql("cards", ctes="""g AS (SELECT *, market_price AS price, market_price * CASE WHEN card_id % 2 = 0 THEN 0.5::DOUBLE ELSE 1.1::DOUBLE END AS e, (DATE '1995-04-01' - release_date)::INTEGER AS age_days FROM cards),
        g2 AS (SELECT *, greatest(age_days, 0) / 30.4375::DOUBLE AS months, price >= 20 AND price < 100 AS dead FROM g), g3 AS (SELECT *, coalesce(months <= 35 / 30.4375::DOUBLE, false) AS fresh FROM g2)""",
        select=f"""SELECT card_id, CASE WHEN fresh OR price IS NULL THEN NULL WHEN dead THEN 'mature mid-price — model near-efficient here' WHEN e > 0 AND price > 1.75::DOUBLE * e THEN 'chase premium the model can''t price' END AS reason,
        coalesce(coalesce(age_days BETWEEN 0 AND 35, false) OR NOT dead, false) AS surfaced, CASE WHEN price IS NULL THEN NULL WHEN (price - e) / e < -0.15::DOUBLE THEN 'under' WHEN (price - e) / e > 0.15::DOUBLE THEN 'over' ELSE 'fair' END AS verdict,
        {GROUP} AS grp, CASE WHEN price IS NULL THEN NULL ELSE {TIER} END AS tier, {BUCKET} AS age, CASE WHEN card_id % 3 = 0 THEN true ELSE NOT (NOT fresh AND coalesce(dead, false)) END AS client_edge FROM g3"""),
    "display_rules": sql("listings", select=f"""SELECT event_id, CASE WHEN x - 0.2 >= 0.10 THEN 'Undervalued' WHEN x - 0.2 <= -0.10 THEN 'Overvalued' ELSE 'Fair' END AS pill,
        CASE WHEN x + 0.5 < 0.97 THEN 'tightening −' || printf('%.0f', abs(x + 0.5 - 1) * 100) || '%' WHEN x + 0.5 > 1.03 THEN 'loosening +' || printf('%.0f', abs(x + 0.5 - 1) * 100) || '%' ELSE 'steady' END AS sat, CASE WHEN x - 0.1 >= 0.04 THEN 'good' WHEN x - 0.1 <= -0.02 THEN 'bad' ELSE 'neutral' END AS tone,
        CASE WHEN abs(x - 0.2) <= 0.005 THEN 'flat' WHEN x - 0.2 > 0 THEN 'up' ELSE 'down' END AS chip, event_id % 2 = 0 OR event_id % 50 BETWEEN 0 AND 24 AS shown,
        CASE WHEN {LAST_DAY} - date <= 0 THEN 'Today' WHEN {LAST_DAY} - date = 1 THEN 'Yesterday' ELSE ({LAST_DAY} - date) || ' days ago' END AS age, round((1 - value / 30.0::DOUBLE) * 100, 0)::INTEGER AS under,
        round(greatest(0, least(1, x - 0.5)), 6) AS gauge, round(greatest(0, least(1, x / 0.40::DOUBLE)), 6) AS demand,
        CASE event_id % 3 WHEN 0 THEN 'free ship' WHEN 1 THEN '$' || format('{{:,.0f}}', round(value, 0)) || ' + $4 ship' ELSE '+ ship not listed' END AS shipping,
        CASE WHEN event_id >= 1000 THEN printf('%.1f', event_id / 1000.0::DOUBLE) || 'k' ELSE event_id::VARCHAR END AS short,
        CASE WHEN event_id % 4 > 0 THEN 'Prices refreshed|' ELSE 'Site built|' END || CASE WHEN dd <= 0 THEN 'Today' WHEN dd = 1 THEN 'Yesterday' ELSE dd || ' days ago' END || '|' ||
        CASE WHEN event_id % 4 > 0 THEN 'as of ' || date || CASE WHEN {LAST_DAY} - date >= 3 THEN ' · refresh recommended' ELSE '' END ELSE 'on 2024-01-29' END AS banner,
        CASE WHEN card_id < 20 THEN 'low' WHEN card_id < 45 THEN 'med' ELSE 'high' END AS conf
        FROM (SELECT *, value / 100.0::DOUBLE AS x, {LAST_DAY} - CASE WHEN event_id % 4 > 0 THEN date ELSE DATE '2024-01-29' END AS dd FROM listings)"""),
    "prior_scores": sql("cards", select="""SELECT *, round(CASE WHEN poll IS NOT NULL AND v2 IS NOT NULL THEN 0.7::DOUBLE * greatest(poll, v2) + 0.3::DOUBLE * least(poll, v2) ELSE coalesce(poll, CASE WHEN v2 IS NOT NULL THEN least(v2, 8.3::DOUBLE) END) END, 6) AS prior FROM (
        SELECT *, CASE WHEN card_id % 2 = 0 THEN views END AS v2 FROM (SELECT card_id, CASE WHEN v <= 0 THEN 0 ELSE round(greatest(6.5, least(9.9, log10(nullif(v, 0)) + 4)), 4) END::DOUBLE AS views,
        CASE WHEN card_id % 3 > 0 THEN round(greatest(6.0, least(9.3, 2.44::DOUBLE * log10(v + 1) - 3.27::DOUBLE)), 4) END::DOUBLE AS poll,
        CASE WHEN v <= 0 THEN 0 ELSE round(greatest(0, least(10, 10 + 4 * log10(nullif(v, 0) / 100000.0::DOUBLE))), 3) END::DOUBLE AS interest FROM (SELECT card_id, (card_id * 37)::DOUBLE AS v FROM cards)))""").replace("SELECT *, round(CASE WHEN poll", "SELECT card_id, views, poll, interest, round(CASE WHEN poll"),
    "character_premium": sql("cards", "priors", ctes=premium(), select="SELECT * FROM prem"),
    "card_features": sql("cards", "priors", ctes=feats(), select="""SELECT card_id, char_premium, scarcity, set_rank, round(months_since_release, 4) AS months_since_release,
        round(100 * greatest(0, least(1, 0.40::DOUBLE * greatest(0, least(1, scarcity / 10)) + 0.35::DOUBLE * greatest(0, least(1, char_premium / 10)) + 0.25::DOUBLE * set_rank)), 2) AS iq FROM feat"""),
    "cluster_ridge": sql("cards", "priors", ctes=MODEL, select=f"SELECT cluster, n, round(intercept + 1e-9::DOUBLE, 5) AS intercept, {RCOLS} FROM own"),
    "global_ridge": sql("cards", "priors", ctes=MODEL, select=f"SELECT n, round(intercept + 1e-9::DOUBLE, 5) AS intercept, {RCOLS} FROM whole"),
    "ridge_scores": sql("cards", "priors", ctes=MODEL, select="SELECT card_id, cluster, model_n, round(expected_price, 4) AS expected_price, round(residual, 5) AS residual, " + ", ".join(f"round(z_{x}, 6) AS part_{x}" for x in F3) + " FROM scored"),
    "model_export": sql("cards", "priors", ctes=MODEL + ", both_ AS (SELECT cluster, n, intercept, " + EXPORTED + " FROM own UNION ALL SELECT 'global', n, intercept, " + EXPORTED + " FROM whole)",
        select="SELECT cluster, n, round(intercept + 1e-9::DOUBLE, 6) AS intercept, " + ", ".join(f"round({p}_{x} + 1e-9::DOUBLE, 6) AS {p}s_{k}" for p in ("mean", "std", "coef") for k, x in enumerate(F3)) + " FROM both_"),
    "small_sample_notes": sql("cards", "priors", ctes=MODEL, select="SELECT card_id, coalesce(o.n, w.n) AS n, coalesce(o.n, w.n) < 30 AS small FROM feat LEFT JOIN (SELECT * FROM own WHERE n >= 12) o USING (cluster) CROSS JOIN whole w"),
    "rescored": sql("cards", "priors", ctes=MODEL, select="""SELECT card_id, round(exp(intercept + CASE WHEN card_id % 4 > 0 AND char_premium IS NOT NULL THEN coef_char_premium * (char_premium - mean_char_premium) / std_char_premium ELSE 0 END
        + coef_scarcity * (scarcity - mean_scarcity) / std_scarcity + coef_months_since_release * (months_since_release - mean_months_since_release) / std_months_since_release), 4) AS price FROM feat CROSS JOIN whole"""),
    "fit_metric": sql("cards", "priors", ctes=MODEL, select="SELECT round(power(corr(ln(market_price), ln(expected_price)), 2), 6) AS r2_log, count(residual) AS n FROM scored WHERE market_price > 0"),
    "leaderboard_under": sql("cards", "priors", ctes=POOL, select="SELECT card_id, market_price, round(expected_price, 3) AS expected_price, raw_diff FROM pool ORDER BY expected_price - market_price DESC, card_id LIMIT 50"),
    "leaderboard_over": sql("cards", "priors", ctes=POOL, select="SELECT card_id, market_price, round(expected_price, 3) AS expected_price, raw_diff FROM pool ORDER BY expected_price - market_price, card_id LIMIT 50"),
    "movers": sql("cards", "priors", "snapshots", ctes=POOL + ", " + dyn(LAST_DAY, LAST_DAY) + """,
        sh AS (SELECT pool.*, status, coalesce(CASE WHEN status = 'ok' THEN abs(supply_saturation - 1) END, 0)::DOUBLE AS shift FROM pool LEFT JOIN dyn USING (card_id)), most AS (SELECT coalesce(max(shift), 0) AS m FROM sh)""",
        select="""SELECT card_id, round(shift, 4) AS shift, raw_diff, CASE WHEN m > 0 THEN 'saturation_shift' ELSE 'price_signal_fallback' END AS mover_basis, m = 0 AS awaiting_data
        FROM sh, most WHERE m = 0 OR status = 'ok' ORDER BY CASE WHEN m > 0 THEN shift ELSE abs(expected_price - market_price) END DESC, card_id LIMIT 50"""),
    "movers_fallback": sql("cards", "priors", ctes=POOL, select="SELECT card_id, raw_diff, 'price_signal_fallback' AS mover_basis, true AS awaiting_data FROM pool ORDER BY abs(expected_price - market_price) DESC, card_id LIMIT 50"),
    "most_underpriced": sql("cards", "priors", ctes=MODEL, select="SELECT card_id, round(residual, 5) AS residual FROM scored WHERE residual IS NOT NULL ORDER BY round(residual, 5), card_id LIMIT 25"),
}
FORMED = """fc AS (SELECT * REPLACE (CASE WHEN card_id % 5 = 0 THEN 'Mega ' || name || ' X' WHEN card_id % 7 = 0 THEN 'Mega ' || name WHEN card_id % 11 = 0 THEN name || ' Y' ELSE name END AS base_name) FROM cards)"""
_PRIOR = """pk AS (SELECT n AS nm, unnest(range(0, 3)) AS pos, unnest([n, regexp_replace(n, '^Mega ', ''), regexp_replace(regexp_replace(n, '^Mega ', ''), ' [XYZ]$', '')]) AS key FROM (SELECT DISTINCT base_name AS n FROM fc)),
 ps AS (SELECT nm, pos, override, CASE WHEN poll IS NOT NULL AND views IS NOT NULL THEN 0.7::DOUBLE * greatest(poll, views) + 0.3::DOUBLE * least(poll, views) ELSE coalesce(poll, CASE WHEN views IS NOT NULL THEN least(views, 8.3::DOUBLE) END) END AS mixed,
   CASE WHEN poll IS NULL OR views >= poll THEN 'wiki' ELSE 'poll' END AS kind FROM pk JOIN priors USING (key)),
 pb AS (SELECT nm AS key, CASE WHEN bool_or(override IS NOT NULL) THEN arg_min(override, pos) FILTER (override IS NOT NULL) ELSE arg_min(mixed, pos) FILTER (mixed IS NOT NULL) END AS override, NULL::DOUBLE AS poll, NULL::DOUBLE AS views,
   CASE WHEN bool_or(override IS NOT NULL) THEN 'user' ELSE arg_min(kind, pos) FILTER (mixed IS NOT NULL) END AS kind FROM ps GROUP BY nm)"""
REVIEW = FORMED + ", " + _PRIOR + ", " + premium("fc").replace("FROM priors)", "FROM pb)") + """, rp AS (SELECT *, cume_dist() OVER (PARTITION BY rarity ORDER BY market_price) AS pct FROM fc WHERE market_price IS NOT NULL),
 rv AS (SELECT regexp_replace(regexp_replace(base_name, '^Mega ', ''), ' [XYZ]$', '') AS character, max(pct) AS pct, max(market_price) AS top_price, first(name ORDER BY market_price DESC, card_id) AS top_card,
   first(rarity ORDER BY market_price DESC, card_id) AS top_rarity, last(char_premium ORDER BY card_id) FILTER (char_premium IS NOT NULL) AS p
   FROM rp LEFT JOIN prem USING (base_name) WHERE supertype = 'Pokémon' AND base_name <> '' GROUP BY character),
 own AS (SELECT key, poll, views, override FROM priors),
 review AS (SELECT character, round(p, 2) AS premium, round(10 * pct, 2) AS price_signal, round(round(10 * pct, 2) - p, 2) AS gap,
   CASE WHEN override IS NOT NULL THEN 'user' WHEN poll IS NULL AND views IS NULL THEN 'structural' WHEN poll IS NULL OR views >= poll THEN 'wiki' ELSE 'poll' END AS source, top_card, top_rarity, round(top_price, 2) AS top_price
   FROM rv LEFT JOIN own ON own.key = character WHERE p IS NOT NULL AND top_price >= 20)"""
LABELS = f"lab(k, label, tone) AS (VALUES {values([('|'.join(k), *v) for k, v in TABLE.items()])})"
MARKERS = ", ".join(f"'{m}'" for m in ("poke ball pattern", "master ball pattern", "pattern", "metal card", "jumbo", "oversized", "staff", "promo"))
PRODUCTS = f"""pr AS (SELECT card_id + 100000 AS product_id, set_id AS group_id, CASE WHEN card_id % 11 = 0 THEN '999' ELSE split_part(number, '/', 1) END AS num,
   CASE WHEN card_id % 7 = 0 THEN name || ' (Alternate) - promo' WHEN card_id % 5 = 0 THEN 'misprint' ELSE name END AS name, rarity, card_id AS position FROM cards),
 pf AS (SELECT *, lower(trim(name)) AS low, lower(coalesce(rarity, '')) AS tier, regexp_replace(lower(split_part(split_part(name, ' - ', 1), '(', 1)), '[^a-z0-9]', '', 'g') AS base FROM pr),
 ps AS (SELECT *, contains(low, '(') AS paren, len(list_filter([{MARKERS}], lambda m: contains(low, m))) > 0 AS other FROM pf),
 cf AS (SELECT card_id, set_id AS group_id, split_part(number, '/', 1) AS num, lower(trim(name)) AS low, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS base, lower(coalesce(rarity, '')) AS tier FROM cards),
 ranked AS (SELECT c.card_id, p.product_id, p.base AS pbase, c.num = p.num AS by_num, c.base = p.base AS by_name, count(*) FILTER (c.num = p.num) OVER (PARTITION BY c.card_id) AS candidates,
   row_number() OVER (PARTITION BY c.card_id, c.num = p.num ORDER BY (c.tier <> '' AND c.tier = p.tier) DESC, paren, other, (c.low <> '' AND c.low = p.low) DESC, position, product_id) AS kn,
   row_number() OVER (PARTITION BY c.card_id, c.base = p.base ORDER BY (c.tier <> '' AND c.tier = p.tier) DESC, paren, other, (c.low <> '' AND c.low = p.low) DESC, position, product_id) AS kb
   FROM cf c JOIN ps p ON p.group_id = c.group_id AND (p.num = c.num OR p.base = c.base)),
 best AS (SELECT card_id, product_id, pbase FROM ranked WHERE by_num AND kn = 1), named AS (SELECT card_id, product_id AS named FROM ranked WHERE by_name AND kb = 1),
 cn AS (SELECT card_id, max(candidates) AS candidates FROM ranked GROUP BY card_id),
 judged AS (SELECT c.card_id, c.group_id, b.product_id, n.named, coalesce(candidates, 0) AS candidates, coalesce(contains(c.base, b.pbase) OR contains(b.pbase, c.base), false) AS fits
   FROM cf c LEFT JOIN best b USING (card_id) LEFT JOIN named n USING (card_id) LEFT JOIN cn USING (card_id)),
 mt AS (SELECT card_id, group_id, CASE WHEN fits THEN product_id ELSE coalesce(named, product_id) END AS product_id,
   CASE WHEN fits THEN 'number' WHEN named IS NOT NULL THEN 'name' WHEN product_id IS NOT NULL THEN 'number' END AS how, candidates FROM judged
   UNION ALL SELECT card_id, 'fx', product_id, how, candidates FROM {fx.values(fx.MATCH_WANT, 'card_id, product_id, how, candidates')})"""
NUM = "CAST(substr(set_id, 7) AS INT)"
ORACLE |= {
    "premium_review": sql("cards", "priors", ctes=REVIEW, select="SELECT * FROM review"),
    "review_flags": sql("cards", "priors", ctes=REVIEW + ", rg AS (SELECT character, round(gap - 2.0, 2) AS gap FROM review)", select="""(SELECT character, gap, 'underrated' AS flag FROM rg WHERE gap >= 1.5 ORDER BY gap DESC, character LIMIT 18)
        UNION ALL (SELECT character, gap, 'overrated' AS flag FROM rg WHERE gap <= -1.5 ORDER BY gap, character LIMIT 18)"""),
    "card_search": sql("cards", ctes="h AS (SELECT * FROM cards WHERE contains(lower(name), 'gear') OR contains(lower(set_name), 'gear') OR contains(lower(number), 'gear'))",
        select="SELECT card_id, name, market_price, (SELECT count(*) FROM h) AS n_hits FROM h ORDER BY coalesce(market_price, -1) DESC, card_id LIMIT 120"),
    "card_search_by_name": sql("cards", ctes="h AS (SELECT * FROM cards WHERE set_id = 'Brand#7')", select="SELECT card_id, name, (SELECT count(*) FROM h) AS n_hits FROM h ORDER BY lower(name), name, card_id LIMIT 120"),
    "top_characters": sql("cards", select="SELECT base_name, max(coalesce(market_price, 0)) AS best FROM cards WHERE supertype = 'Pokémon' AND base_name <> 'red widget' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 16"),
    "sweep_universe": sql("cards", select="SELECT card_id, market_price FROM cards WHERE market_price >= 2 ORDER BY market_price DESC, card_id LIMIT 850"),
    "meta_counts": sql("cards", "priors", ctes=MODEL, select="""SELECT (SELECT count(*) FROM cards) AS n_cards, (SELECT count(market_price) FROM cards) AS n_priced, (SELECT count(DISTINCT set_id) FROM cards) AS n_sets,
        (SELECT count(residual) FROM scored) AS n_logged, (SELECT round(power(corr(ln(market_price), ln(expected_price)), 2), 6) FROM scored WHERE market_price > 0) AS r2_log,
        (SELECT count(*) FROM own WHERE n >= 12) AS n_clusters, (SELECT string_agg(cluster, ', ' ORDER BY cluster) FROM own WHERE n >= 12) AS clusters"""),
    "set_names": sql("cards", select="SELECT DISTINCT set_name FROM cards"),
    "listing_flows": sql("snapshots", ctes=FLOWS, select="SELECT card_id, date, active, new_listings, ended_listings, est_sold, est_unsold FROM flows"),
    "yesterday_flows": sql("snapshots", ctes=FLOWS.replace("lag(active) OVER w AS a0, lag(average) OVER w AS v0, lag(item_ids) OVER w AS i0 FROM snapshots WINDOW w AS (PARTITION BY card_id ORDER BY date)",
        f"a0: y.active, v0: y.average, i0: y.item_ids FROM (SELECT * FROM snapshots WHERE date = {LAST_DAY}) t LEFT JOIN (SELECT card_id AS yc, date AS yd, active, average, item_ids FROM snapshots) y ON yc = card_id AND yd = {LAST_DAY} - 1")
        .replace("SELECT *, a0:", "SELECT t.*, a0:"), select="SELECT card_id, active, new_listings, ended_listings, est_sold, est_unsold FROM flows"),
    "trailing_windows": sql("snapshots", ctes=dyn("DATE '2100-01-01'", None), select="SELECT card_id, date, sold_7, new_7, round(a7, 6) AS active_7, round(a30, 6) AS active_30 FROM trail"),
    "market_dynamics": sql("snapshots", ctes=dyn(LAST_DAY, LAST_DAY), select="SELECT * FROM dyn"),
    "market_dynamics_as_of": sql("snapshots", ctes=dyn("DATE '2024-01-15'", None), select="SELECT * FROM dyn"),
    "price_moves": sql("panel", ctes=moves("DATE '2000-01-01'"), select="SELECT * FROM moves"),
    "signal_labels": sql("snapshots", "panel", ctes=dyn(LAST_DAY, LAST_DAY) + ", " + moves("DATE '2100-01-01'") + f""", {LABELS},
        j AS (SELECT dyn.* EXCLUDE (days), pct, moves.days AS d, CASE WHEN pct IS NULL THEN 'unknown' WHEN pct >= 3 THEN 'up' WHEN pct <= -3 THEN 'down' ELSE 'flat' END AS price_state,
          coalesce(demand_pressure >= 15, false) OR coalesce(supply_saturation < 0.97, false) AS tight, coalesce(supply_saturation > 1.03, false) AS loose FROM dyn LEFT JOIN moves USING (card_id)),
        k AS (SELECT *, CASE WHEN status <> 'ok' THEN 'unknown' WHEN tight AND NOT loose THEN 'tightening' WHEN loose AND NOT tight THEN 'loosening' ELSE 'steady' END AS market_state FROM j)""",
        select="""SELECT card_id, price_state, market_state, label, tone, CASE WHEN market_state <> 'unknown' THEN 'full' WHEN pct IS NOT NULL THEN 'price_only' ELSE 'none' END AS confidence,
        concat_ws(' · ', CASE WHEN pct IS NOT NULL THEN 'price ' || CASE WHEN pct >= 0 THEN '+' ELSE '' END || printf('%.1f', pct) || '% (' || d || 'd)' END,
          CASE WHEN market_state <> 'unknown' AND demand_pressure IS NOT NULL THEN 'sell-through ' || printf('%.0f', demand_pressure) || '%' END,
          CASE WHEN market_state <> 'unknown' AND abs(supply_saturation - 1) >= 0.03 THEN 'supply ×' || printf('%.2f', supply_saturation) END) AS detail
        FROM k JOIN lab ON lab.k = price_state || '|' || market_state"""),
    "source_status": sql("snapshots", select="""SELECT n AS newest, (DATE '2024-01-28' - n)::INTEGER AS age_days, CASE WHEN n IS NULL THEN 'none' WHEN DATE '2024-01-28' - n <= 3 THEN 'recent' ELSE 'stale' END AS state,
        CASE WHEN n IS NULL THEN 'no live eBay snapshot yet (the collector writes neutral rows without API keys)' WHEN DATE '2024-01-28' - n <= 3 THEN 'eBay Browse API active listings (latest snapshot ' || n::VARCHAR || ')'
        ELSE 'eBay Browse API active listings, but the latest live snapshot is ' || n::VARCHAR || ' (' || (DATE '2024-01-28' - n)::VARCHAR || ' days old)' END AS status
        FROM (SELECT max(date) AS n FROM snapshots WHERE active > 0 AND date <= DATE '2024-01-28')"""),
    "breaker_runs": sql("listings", ctes="""b AS (SELECT event_id AS seq, card_id % 10 AS sweep, event_type IN ('view', 'click', 'error') AS unk FROM listings),
        i AS (SELECT *, sum((NOT unk)::INT) OVER (PARTITION BY sweep ORDER BY seq) AS island FROM b), rn AS (SELECT *, sum(unk::INT) OVER (PARTITION BY sweep, island ORDER BY seq)::BIGINT AS run FROM i)""",
        select="SELECT seq, run, coalesce(max(CASE WHEN run >= 6 THEN 1 ELSE 0 END) OVER (PARTITION BY sweep ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS issued FROM rn"),
    "window_lows": sql("snapshots", ctes="s AS (SELECT *, min(average) OVER (PARTITION BY card_id ORDER BY date RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND CURRENT ROW) AS low FROM snapshots WHERE average IS NOT NULL)",
        select="SELECT card_id, date, low, average <= low AS is_low FROM s"),
    "sealed_trends": sql("panel", ctes=TREND, select="""SELECT *, CASE WHEN trend_30d IS NULL THEN NULL WHEN trend_30d <= -0.04 AND coalesce(trend_90d, 0) <= 0 THEN 'Falling' WHEN trend_30d <= -0.03 AND coalesce(trend_180d, 0) > 0.15 THEN 'Cooling after run'
        WHEN trend_30d >= 0.05 AND coalesce(trend_90d, 0) >= 0.10 THEN 'Accelerating ↑' WHEN trend_30d >= 0.02 AND coalesce(trend_90d, 0) >= 0 THEN 'Steady ↑' WHEN abs(trend_30d) < 0.03 THEN 'Flat / digesting' ELSE 'Choppy' END AS trajectory,
        CASE WHEN n_points < 20 THEN 'low' WHEN n_points < 45 THEN 'med' ELSE 'high' END AS confidence FROM tt"""),
    "backward_prices": sql("panel", select="SELECT card_id, arg_max(price, date) AS price, max(date) AS date FROM panel WHERE date <= DATE '1998-07-03' AND date >= DATE '1998-07-03' - 14 GROUP BY card_id"),
    "nearest_forward_pairs": sql("panel", ctes=pairs((7, 28, 56, 84)), select="SELECT horizon, date, next_date FROM pairs"),
    "carried_portfolio": sql("panel", ctes="pp AS (SELECT * FROM panel)", select="""SELECT date, round(sum(price), 4) AS total FROM (SELECT d.date, k.card_id, last_value(p.price IGNORE NULLS) OVER (PARTITION BY k.card_id ORDER BY d.date) AS price
        FROM (SELECT DISTINCT date FROM pp) d CROSS JOIN (SELECT DISTINCT card_id FROM pp) k LEFT JOIN pp p ON p.date = d.date AND p.card_id = k.card_id) GROUP BY date"""),
    "portfolio_totals": sql("cards", ctes="w AS (SELECT market_price AS p, CASE WHEN card_id % 100 = 0 THEN dex::DOUBLE END AS a FROM cards)",
        select="""SELECT count(*) AS n_cards, count(a) AS n_bases, round(coalesce(sum(p), 0), 2) AS value, round(coalesce(sum(p), 0) - sum(a), 2) AS since_added,
        round(CASE WHEN sum(a) > 0 THEN 100 * (coalesce(sum(p), 0) - sum(a)) / sum(a) END, 2) AS since_added_pct FROM w"""),
    "weekly_dates": sql("panel", select="SELECT unnest(range((SELECT min(date) FROM panel)::TIMESTAMP, (SELECT max(date) FROM panel)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 7 DAYS))::DATE AS date"),
    "backfill_missing": sql("panel", select="SELECT d::DATE AS date FROM (SELECT unnest(range(DATE '1994-01-03', DATE '2002-01-08', INTERVAL 7 DAYS)) AS d) WHERE d::DATE NOT IN (SELECT date FROM panel)"),
    "price_history": sql("panel", select="SELECT card_id, count(*)::INTEGER AS n, min(date) AS first, max(date) AS last, round(arg_max(price, date), 2) AS last_price FROM panel GROUP BY card_id HAVING arg_max(price, date) >= 40"),
    "merged_series": sql("panel", select="SELECT card_id, date, round(CASE WHEN card_id % 3 = 0 THEN price * 2 ELSE price END, 4) AS price FROM panel"),
    "walk_forward_residuals": sql("panel", "panel_cards", ctes=walk(digits=False), select="SELECT eval_date, card_id, round(residual, 5) AS residual, round(expected_price, 3) AS expected_price, age_days FROM resid"),
    "forward_returns": sql("panel", "panel_cards", ctes=obs(), select="SELECT date, card_id, round(mispricing, 5) AS mispricing, round(fwd, 6) AS fwd, age_days, rarity_group FROM obs"),
    "rank_ics": sql("panel", "panel_cards", ctes=obs() + ", " + ics("obs"), select="SELECT date, n, round(ic, 5) AS ic FROM ics"),
    "ic_by_segment": sql("panel", "panel_cards", ctes=obs() + """, seg AS (SELECT *, unnest(list_filter(['all', CASE WHEN price >= 10 AND age_days > 90 THEN 'mature' END, CASE WHEN age_days BETWEEN 0 AND 35 THEN 'fresh' END,
        CASE WHEN coalesce(age_days BETWEEN 0 AND 35, false) OR NOT (price >= 20 AND price < 100) THEN 'surfaced' END], lambda x: x IS NOT NULL)) AS segment FROM obs), """ + ics("seg", "segment") + ", " + summary("segment"), select="SELECT * FROM summ"),
    "ic_by_horizon": sql("panel", "panel_cards", ctes=obs((7, 28, 56, 84)) + ", " + ics("obs", "horizon") + ", " + summary("horizon", "greatest(1, ceil(horizon / 7.0)::INTEGER + 1)"), select="SELECT * FROM summ"),
    "floor_sensitivity": sql("panel", "panel_cards", ctes=obs() + ", fl AS (SELECT obs.*, floor FROM obs, (VALUES (2.0::DOUBLE), (5.0::DOUBLE), (10.0::DOUBLE), (20.0::DOUBLE)) f(floor) WHERE price >= floor), " + ics("fl", "floor") + ", " + summary("floor"), select="SELECT * FROM summ"),
    "ic_by_age": sql("panel", "panel_cards", ctes=obs() + f", bu AS (SELECT *, {BUCKET} AS bucket FROM obs), bo AS (SELECT * FROM bu WHERE bucket IS NOT NULL), " + ics("bo", "bucket") + ", " + summary("bucket"),
        select="SELECT bucket, n, mean_return, n_dates, mean_ic FROM (SELECT bucket, count(*) AS n, round(avg(fwd), 6) AS mean_return FROM bo GROUP BY bucket) JOIN summ USING (bucket)"),
    "ic_by_rarity": sql("panel", "panel_cards", ctes=obs() + ", " + pooled("rarity_group"), select=POOLED),
    "ic_by_price_tier": sql("panel", "panel_cards", ctes=obs() + ", " + pooled(TIER), select=POOLED),
    "decile_legs": sql("panel", "panel_cards", ctes=obs((7, 28, 56, 84)) + """, dn AS (SELECT *, count(*) OVER (PARTITION BY horizon, date) AS n, row_number() OVER (PARTITION BY horizon, date ORDER BY round(mispricing, 9), card_id) AS k FROM obs),
        lg AS (SELECT horizon, date, avg(fwd) FILTER (k > n - greatest(1, n // 10)) AS t, avg(fwd) FILTER (k <= greatest(1, n // 10)) AS b FROM dn WHERE n >= 20 GROUP BY ALL)""",
        select="SELECT horizon, count(*) AS n_dates, round(avg(t), 5) AS top, round(avg(b), 5) AS bottom, round(avg(t - b), 5) AS spread FROM lg GROUP BY horizon"),
    "hit_rates": sql("panel", "panel_cards", ctes=obs(), select="""SELECT count(*) FILTER (mispricing > 0.15) AS n_under, round(avg((fwd > 0)::INT::DOUBLE) FILTER (mispricing > 0.15), 6) AS under_up, count(*) FILTER (mispricing < -0.15) AS n_over,
        round(avg((fwd < 0)::INT::DOUBLE) FILTER (mispricing < -0.15), 6) AS over_down, round(avg((fwd > 0)::INT::DOUBLE), 6) AS base_up FROM obs"""),
    "two_feature_model": sql("panel", "panel_cards", ctes=obs((28,), ("scarcity", "set_rank"), 5.0) + ", " + ics("obs").replace("SELECT date, count(*)", "SELECT date, 1 AS \"all\", count(*)") + ", " + summary('"all"'), select="SELECT * FROM summ"),
    "feature_lists": " UNION ALL ".join(evaluated(f"{'+'.join(f)} {alpha:g}", f, alpha) for k in (2, 3) for f in itertools.combinations(("char_premium", "months_since_release", "scarcity", "set_rank"), k) for alpha in (1.0, 5.0)),
    "product_matches": sql("cards", ctes=PRODUCTS, select="SELECT * FROM mt"),
    "match_coverage": sql("cards", ctes=PRODUCTS, select="SELECT group_id, count(product_id) AS matched, count(*) AS total, count(*) FILTER (how = 'name') AS name_fixed, count(*) FILTER (candidates > 1 AND product_id IS NOT NULL) AS ambiguous FROM mt GROUP BY group_id"),
    "unmatched_cards": sql("cards", ctes=PRODUCTS, select="SELECT card_id, group_id AS set_id FROM mt WHERE product_id IS NULL AND card_id > 0"),
    "gap_fill": sql("cards", ctes=f"""g AS (SELECT card_id, set_id, coalesce(nullif(ltrim(upper(trim(number)), '0'), ''), '0') AS num, CASE WHEN {NUM} % 2 = 0 THEN market_price END AS p FROM cards),
        a AS (SELECT *, max(p IS NOT NULL) OVER (PARTITION BY set_id) AS any_ FROM g), b AS (SELECT set_id, coalesce(nullif(ltrim(upper(trim(number)), '0'), ''), '0') AS num, min(dex * 1.08::DOUBLE) AS bp FROM cards WHERE card_id % 2 = 0 GROUP BY ALL),
        f AS (SELECT card_id, p, CASE WHEN any_ THEN p ELSE coalesce(p, bp) END AS x FROM a LEFT JOIN b USING (set_id, num))""",
        select="SELECT card_id, round(x, 4) AS market_price, CASE WHEN p IS NULL AND x IS NOT NULL THEN 'backup' WHEN x IS NOT NULL THEN 'primary' END AS price_source FROM f"),
    "carried_catalogue": sql("cards", select=f"SELECT card_id, set_id, CASE WHEN {NUM} % 4 = 0 THEN -1.0::DOUBLE ELSE market_price END AS market_price FROM cards"),
    "run_status": sql("sets", select=f"""SELECT '2024-01-01T00:00:00Z' AS prices_as_of, '2024-01-02T00:00:00Z' AS last_attempt_at, false AS last_attempt_ok, count(*) FILTER ({NUM} % 4 <> 0)::INTEGER AS n_live,
        string_agg(set_id, ',' ORDER BY set_id) FILTER ({NUM} % 4 = 0) AS not_live FROM sets"""),
    "prediction_log": sql("cards", "priors", ctes=MODEL, select="""SELECT card_id, round(market_price, 4) AS m, round(expected_price, 3) AS e, round(residual, 5) AS r,
        CASE WHEN round(residual, 5) < -0.15 THEN 'under' WHEN round(residual, 5) > 0.15 THEN 'over' ELSE 'fair' END AS v FROM scored WHERE residual IS NOT NULL"""),
    "due_populations": sql("cards", ctes=f"x AS (SELECT card_id AS id, CASE WHEN card_id % 3 > 0 THEN DATE '2024-01-01' + (card_id % 28)::INTEGER END AS fetched FROM cards)", select=f"SELECT * FROM x WHERE fetched IS NULL OR fetched < {LAST_DAY} - 14 ORDER BY fetched NULLS FIRST, id LIMIT 900"),
    "graded_population": sql("listings", select="""SELECT card_id AS id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS g10, count(*) FILTER (event_type = 'view') AS g9,
        round(count(*) FILTER (event_type = 'purchase') / count(*)::DOUBLE, 4) AS rate FROM listings GROUP BY card_id ORDER BY total DESC, card_id LIMIT 20"""),
    "population_answers": sql("listings", select=f"""SELECT id, CASE WHEN id % 5 = 2 THEN 0 ELSE total END AS total, CASE WHEN id % 5 = 2 THEN 0 ELSE tens END AS g10, 0 AS g9, CASE WHEN id % 5 <> 2 THEN round(tens / total::DOUBLE, 4) END AS rate,
        id AS spec, {LAST_DAY} AS fetched FROM (SELECT card_id AS id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS tens FROM listings GROUP BY card_id) WHERE id % 5 > 1"""),
    "page_titles": sql("cards", "priors", ctes="""nm AS (SELECT key AS name, length(key) AS n, list_reduce(list_transform(string_split(key, ' '), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b) AS t FROM priors),
        pick AS (SELECT name, CASE WHEN n % 3 > 0 AND n % 2 = 1 THEN t || ' (Pokémon)' WHEN n % 7 > 0 THEN CASE WHEN n % 5 = 0 THEN 'Another page' ELSE t END END AS title FROM nm),
        fit AS (SELECT * FROM pick WHERE lower(replace(title, ' (Pokémon)', '')) = lower(name)), v AS (SELECT name, sum(CASE WHEN dex % 8 = 0 THEN 0 ELSE dex END)::BIGINT AS v FROM cards GROUP BY name)""",
        select="SELECT name, title, CASE WHEN contains(title, '(Pokémon)') THEN v * 2 ELSE v + 1 END AS views FROM fit JOIN v USING (name) WHERE CASE WHEN contains(title, '(Pokémon)') THEN v * 2 ELSE v + 1 END > 0"),
    "private_ids": sql("snapshots", select="SELECT card_id, date, active, CASE WHEN date = (SELECT max(date) FROM snapshots) THEN len(item_ids) END AS n_ids FROM snapshots"),
    "staged_problems": sql("cards", select="""SELECT 'f' || card_id || '.JSON' AS name, CASE card_id % 6 WHEN 0 THEN 'has it as a key' ELSE 'does not parse and names it' END AS problem FROM cards WHERE card_id % 6 < 2 AND card_id % 4 <> 0"""),
    "json_rows": sql("cards", select="""SELECT '{"card_id":' || card_id || ',"name":"' || name || '","nothing":null,"half":' || CASE WHEN dex IS NULL THEN 'null' ELSE printf('%.1f', dex / 2.0::DOUBLE) END || '}' AS value FROM cards"""),
}

ORACLE |= {
    "listing_pages": sql("listings", ctes="""lv AS (SELECT *, value::DECIMAL(10,2)::VARCHAR AS v, value::DECIMAL(10,2)::DOUBLE AS p, event_type NOT IN ('signup', 'error') AS fine FROM listings WHERE value > 0),
        mk AS (SELECT card_id, round(avg(value), 2) AS m FROM lv GROUP BY card_id),
        ok AS (SELECT card_id, item, p, v, CASE WHEN event_type = 'signup' THEN 'slab PSA 9' ELSE 'card' END AS title FROM lv JOIN mk USING (card_id) WHERE fine AND (m < 2 OR p BETWEEN 0.5::DOUBLE * m AND 4.0::DOUBLE * m)),
        qs AS (SELECT card_id, count(*) AS n, quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.75) AS q3 FROM ok GROUP BY card_id),
        kept AS (SELECT o.*, n < 4 OR p BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS inside FROM ok o JOIN qs USING (card_id)),
        fin AS (SELECT * FROM kept WHERE inside OR card_id NOT IN (SELECT card_id FROM kept WHERE inside)),
        rws AS (SELECT card_id, count(*) AS n, list(p ORDER BY item, title, v) AS ps, count(DISTINCT item) AS ids FROM fin GROUP BY card_id)""",
        select=f"""SELECT mk.card_id AS key, k NOT IN (0, 7, 14) AS known, CASE WHEN k IN (0, 7, 14) THEN NULL WHEN k = 21 THEN 0 ELSE coalesce(n, 0) END AS active,
        CASE WHEN k NOT IN (0, 7, 14, 21) THEN printf('%.2f', list_reduce(list_prepend(0::DOUBLE, ps), lambda a, b: a + b) / n)::DOUBLE END AS average,
        CASE WHEN k IN (0, 7, 14) THEN NULL WHEN k = 21 THEN 0 ELSE coalesce(ids, 0) END AS n_ids FROM (SELECT *, card_id % 28 AS k FROM mk) mk LEFT JOIN rws USING (card_id)
        UNION ALL SELECT * FROM {fx.values(fx.PAGES_WANT, 'key, known, active, average, n_ids')}"""),
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL",
    "dated_log": sql("panel", select="SELECT date, card_id, round(price * CASE year(date) WHEN 1996 THEN 2 WHEN 1997 THEN 3 WHEN 1998 THEN 3 ELSE 1 END, 4) AS price FROM panel WHERE year(date) <= 1998"),
    "stream_flows": sql("snapshots", ctes=FLOWS, select="SELECT card_id, date, active, new_listings, ended_listings, est_sold, est_unsold FROM flows"),
    "daily_build": sql("cards", "sets", "panel", "overrides", "priors", ctes=MODEL + ", " + PULLS + ", " + moves(AS_OF) + """,
        mv AS (SELECT card_id, CASE WHEN pct >= 3 THEN 'Rising' WHEN pct <= -3 THEN 'Falling' ELSE 'Quiet' END AS label FROM moves)""",
        select="""SELECT s.card_id, round(100 * greatest(0, least(1, 0.40::DOUBLE * greatest(0, least(1, s.scarcity / 10)) + 0.35::DOUBLE * greatest(0, least(1, s.char_premium / 10)) + 0.25::DOUBLE * s.set_rank)), 2) AS iq_score,
        round(round(s.expected_price, 4) + 1e-9::DOUBLE, 3) AS expected_price, round(round(s.residual, 6) + 1e-9::DOUBLE, 4) AS residual,
        coalesce(s.months_since_release <= 35 / 30.4375::DOUBLE, false) OR s.market_price IS NULL OR NOT ((s.market_price >= 20 AND s.market_price < 100) OR (s.expected_price > 0 AND s.market_price > 1.75::DOUBLE * round(s.expected_price, 4))) AS edge,
        coalesce(label, 'Awaiting data') AS label, round(CASE WHEN pull_rate > 0 THEN pack_price / pull_rate ELSE 0 END, 3) AS pull_cost
        FROM scored s JOIN pulled p ON p.card_id = s.card_id JOIN sets t ON t.set_id = s.set_id LEFT JOIN mv ON mv.card_id = s.card_id"""),
}

#: Date columns of the results; both engines hand them out as ISO text.
DATES = {
    "sealed_feed": ["as_of"], "sealed_staleness": ["oldest", "newest"], "date_formats": ["day"], "listing_flows": ["date"], "trailing_windows": ["date"],
    "market_dynamics": ["last_observed"], "market_dynamics_as_of": ["last_observed"], "source_status": ["newest"], "window_lows": ["date"], "backward_prices": ["date"],
    "nearest_forward_pairs": ["date", "next_date"], "carried_portfolio": ["date"], "weekly_dates": ["date"], "backfill_missing": ["date"], "normal_cards": ["release_date"], "archive_series": ["date"], "population_answers": ["fetched"], "private_ids": ["date"], "price_history": ["first", "last"],
    "merged_series": ["date"], "walk_forward_residuals": ["eval_date"], "forward_returns": ["date"], "rank_ics": ["date"], "due_populations": ["fetched"], "stream_flows": ["date"], "dated_log": ["date"],
}
for _name, _columns in DATES.items():
    ORACLE[_name] = "SELECT * REPLACE (" + ", ".join(f'strftime("{c}", \'%Y-%m-%d\') AS "{c}"' for c in _columns) + f") FROM ({ORACLE[_name]})"
