"""The domain's tables made from a star schema: parts as cards, brands as sets, lines as prices, events as listings.

Each view is one SELECT in the SQL that Spark and DuckDB share, so both engines start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwick.constants import RARITY_ORDER

_TIER = "CASE {n} " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(RARITY_ORDER)) + " END"

#: Views over the star schema, each may use the ones before it.
VIEWS: dict[str, str] = {
    "lines": """SELECT l_partkey, l_suppkey, l_extendedprice / l_quantity / 100.0 AS unit_price, CAST(o_orderdate AS DATE) AS day
                FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "part_prices": """SELECT l_partkey, round(avg(unit_price), 2) AS market_price, min(day) AS first_day, count(*) AS n_lines FROM lines GROUP BY l_partkey""",
    "cards": f"""SELECT p_partkey AS card_id, p_name AS name, p_name AS base_name, p_brand AS set_id, concat('Set ', p_brand) AS set_name,
                concat(CAST(p_size AS STRING), '/050') AS number, {_TIER.format(n='p_size % 14')} AS rarity,
                CASE WHEN p_type = 'PROMO' THEN 'Trainer' ELSE 'Pokémon' END AS supertype, p_size * 4 AS dex,
                CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE market_price END AS market_price, first_day AS release_date
                FROM part LEFT JOIN part_prices ON p_partkey = l_partkey""",
    "sets": """SELECT p_brand AS set_id, concat('Set ', p_brand) AS name, CAST(4.0 + length(p_brand) + CAST(substr(p_brand, 7) AS INT) * 0.25 AS DOUBLE) AS pack_price,
               9 AS packs_per_box, CAST(100 + CAST(substr(p_brand, 7) AS INT) * 3 AS DOUBLE) AS box_price
               FROM (SELECT DISTINCT p_brand FROM part) b""",
    "overrides": """SELECT DISTINCT p_brand AS set_id, 'Ultra Rare' AS rarity, CAST(0.08 AS DOUBLE) AS rate FROM part WHERE CAST(substr(p_brand, 7) AS INT) % 3 = 0""",
    "priors": """SELECT DISTINCT p_name AS key, CASE WHEN length(p_name) % 2 = 0 THEN CAST(6.0 + length(p_name) / 10.0 AS DOUBLE) END AS poll,
                 CASE WHEN length(p_name) % 3 = 0 THEN CAST(9.0 AS DOUBLE) END AS views, CASE WHEN p_name = 'red widget' THEN CAST(10.0 AS DOUBLE) END AS override FROM part""",
    "panel": """SELECT date_add(DATE '1994-12-26', CAST(floor(datediff({day}, {epoch}) / 7) AS INT) * 7) AS date,
                CAST(substr(p_brand, 7) AS INT) * 10 + CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'PROMO' THEN 3 WHEN 'SMALL' THEN 4 ELSE 5 END AS card_id,
                round(avg(unit_price), 2) AS price FROM lines JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "panel_cards": f"""SELECT DISTINCT card_id, concat('Brand#', CAST(CAST(floor(card_id / 10) AS INT) AS STRING)) AS set_id, {_TIER.format(n='card_id % 10 + 3')} AS rarity,
                'Pokémon' AS supertype, concat('c', CAST(card_id % 20 AS STRING)) AS base_name, card_id % 200 AS dex,
                date_add(DATE '1995-01-01', CAST(card_id * 13 % 2000 AS INT)) AS release_date FROM panel""",
    "listings": """SELECT event_id, user_id AS card_id, CAST(ts AS DATE) AS date, value, event_type, get_json_object(props, '$.k') AS item FROM events""",
    "snapshots": """SELECT date, card_id, CASE WHEN (card_id + day(date)) % 11 = 0 THEN NULL ELSE CAST(count(*) AS INT) END AS active,
                CASE WHEN (card_id + day(date)) % 11 = 0 THEN NULL ELSE round(avg(value), 4) END AS average,
                CASE WHEN card_id % 3 = 0 OR (card_id + day(date)) % 11 = 0 THEN NULL ELSE sort_array(collect_set(item)) END AS item_ids
                FROM listings GROUP BY date, card_id""",
}
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name, with the tables and views that it needs put in place as common table expressions.

    Nothing is registered in the session; the optimizer sees one tree and prunes what is not used.
    """
    return spark.sql(_with(name), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _tables(name)})


def _needs(sql: str, among) -> list[str]:
    words = set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())
    return [n for n in among if n in words]


def chain(name: str) -> list[str]:
    """The views that ``name`` needs, itself last."""
    out: list[str] = []
    for n in _needs(VIEWS[name], VIEWS):
        if n != name:
            out += [x for x in chain(n) if x not in out]
    return [*out, name]


def _tables(name: str) -> list[str]:
    return sorted({t for n in chain(name) for t in _needs(VIEWS[n], TABLES)})


def _with(name: str) -> str:
    names = chain(name)
    parts = [f"{n} AS ({VIEWS[n].replace('{day}', 'day').replace('{epoch}', "DATE '1994-12-26'")})" for n in names]
    sql = "WITH " + ", ".join(parts) + f" SELECT * FROM {name}"
    for t in _tables(name):
        sql = _braced(sql, t)
    return sql


def _braced(sql: str, table: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", sql)


def duck(*names: str) -> str:
    """The common table expressions of views in DuckDB's words."""
    order: list[str] = []
    for name in names:
        order += [n for n in chain(name) if n not in order]
    swaps = [
        ("date_add(DATE '1994-12-26', CAST(floor(datediff({day}, {epoch}) / 7) AS INT) * 7)", "(DATE '1994-12-26' + CAST(floor((day - DATE '1994-12-26') / 7.0) AS INT) * 7)"),
        ("date_add(DATE '1995-01-01', CAST(card_id * 13 % 2000 AS INT))", "(DATE '1995-01-01' + CAST(card_id * 13 % 2000 AS INT))"),
        ("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"),
        ("sort_array(collect_set(item))", "list_sort(list_distinct(list(item)))"),
    ]
    parts = []
    for n in order:
        sql = VIEWS[n]
        for a, b in swaps:
            sql = sql.replace(a, b)
        parts.append(f"{n} AS ({sql})")
    return "WITH " + ", ".join(parts)
