"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the total size over its own share.  Each document draws a count
from a Poisson distribution of that mean, by inverting it at a number hashed from the seed and the document's id, and is
replicated that often; a global shuffle by a hash of (seed, id, copy) follows.  Counts depend on nothing but the id and
the rate, so partitions can be recomputed anywhere, and no source has to be gathered: a source that holds a third of the
rows is only a row of the small rate table.

Plan: one aggregation to a row per source; the inverse distribution of each as an array of its cumulative probabilities
(made in log space, so large rates do not underflow); a join by source, broadcast where the rate table was measured as small; one
shuffle of the replicated rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import bytes_of, cut, put, small_or_shuffled, text_of, unit_hash


def source_name(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def rates(docs: DataFrame, text_col: str, source_col: str, targets: Mapping[str, float] | None, power: float, total: float) -> DataFrame:
    """Rows (source, rate, cdf): mean copies of a source's documents and cumulative probabilities of 0, 1, .. copies."""
    size = F.octet_length(text_of(text_col)).cast("long") + 1
    sizes = docs.groupBy(source_name(source_col).alias("__source")).agg(F.sum(size).cast("double").alias("size"))
    if targets is None:
        weight = F.pow("size", F.lit(float(power)))
    else:
        weight = F.lit(0.0)
        for name, value in targets.items():
            weight = F.when(F.col("__source") == name, F.lit(float(value))).otherwise(weight)
    weighed = cut(sizes.withColumn("weight", weight))
    weights, bytes_ = weighed.agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.coalesce(F.sum("size"), F.lit(0.0))).first()
    rate = F.round(F.try_divide(F.col("weight") * F.lit(bytes_ * total), F.lit(weights) * F.col("size")), 9)
    rated = weighed.select("__source", F.coalesce(rate, F.lit(0.0)).alias("rate"))
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    terms = rated.where("rate > 0").select("__source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    so_far = Window.partitionBy("__source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    terms = terms.withColumn("log_factorial", F.sum(F.ln(F.greatest("k", F.lit(1)).cast("double"))).over(so_far))
    terms = terms.withColumn("p", F.exp(F.col("k") * F.ln("rate") - F.col("rate") - F.col("log_factorial")))
    terms = terms.withColumn("c", F.sum("p").over(so_far))
    cdf = F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"])
    return rated.join(terms.groupBy("__source").agg(cdf.alias("cdf")), "__source", "left")


def mix(
    docs: DataFrame,
    targets: Mapping[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    power: float = 0.7,
    total: float = 1.0,
) -> DataFrame:
    """Rows of ``docs`` replicated to the target mixture and shuffled globally, plus ``rate, n_copies, copy, shuffle_key``.

    ``targets`` maps sources to weights (sources that are not named get none); without it the weight of a source is its
    size to the ``power`` (1 leaves the mixture as it is, 0 makes sources equal).  Sizes are UTF-8 bytes plus one.
    ``total`` is the wanted size over the present one.  ``copy`` counts from 1 to ``n_copies``; documents that draw 0
    are not in the result.  The table of a rate's probabilities ends at rate + 12 sqrt(rate) + 40, beyond which less
    than 1e-15 is left: no number in [0, 1) that a hash of 52 bits can draw is cut off.  Rows come in the order of ``shuffle_key`` within each partition, dealt by that key.

    A null source is a source of its own (the empty name).  Null and empty texts have size 1.  Null ids draw as one id;
    rows that repeat an id draw the same count.  Texts of any length are copied whole.  An empty table gives an empty result.  Input columns named like an
    output are replaced.
    """
    table = cut(rates(docs, text_col, source_col, targets, power, total).withColumnsRenamed({"rate": "__rate", "cdf": "__cdf"}))
    n_bytes = bytes_of(table)
    key = F.col(id_col)
    rows = put(docs, {"__source": source_name(source_col), "__u": unit_hash(F.lit(seed), key)})
    rows = rows.join(small_or_shuffled(table, n_bytes), "__source")
    draw = F.size(F.filter("__cdf", lambda c: c <= F.col("__u"))).cast("int")
    rows = put(rows.where("__cdf is not null"), {"rate": F.col("__rate"), "n_copies": draw}).where("n_copies > 0").drop("__source", "__u", "__rate", "__cdf")
    rows = put(rows, {"copy": F.explode(F.sequence(F.lit(1), F.col("n_copies")))})
    rows = put(rows, {"shuffle_key": (unit_hash(F.lit(seed), F.lit("order"), key, F.col("copy")) * F.lit(float(1 << 52))).cast("long")})
    return rows.repartition("shuffle_key").sortWithinPartitions("shuffle_key", id_col)


def mix_sql(columns: str, seed: str = "mix", power: float = 0.7) -> str:
    """The same over the view ``documents`` for an engine with ``md5``; ``columns`` of the document are selected."""
    unit = lambda *parts: "(('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 13))::BIGINT)"
    key = "coalesce(d.doc_id::VARCHAR, '~')"
    return f"""
    WITH sizes AS (SELECT coalesce(source, '') AS s, sum(octet_length(encode(coalesce(text, ''))) + 1)::DOUBLE AS size FROM documents GROUP BY 1),
    weighed AS (SELECT *, pow(size, {power}::DOUBLE) AS weight FROM sizes),
    rated AS (SELECT s, round(weight * (sum(size) OVER ()) / ((sum(weight) OVER ()) * size), 9) AS rate FROM weighed),
    terms AS (SELECT s, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k FROM rated),
    facts AS (SELECT *, sum(ln(greatest(k, 1)::DOUBLE)) OVER (PARTITION BY s ORDER BY k ROWS UNBOUNDED PRECEDING) AS lf FROM terms),
    probs AS (SELECT *, sum(exp(k * ln(rate) - rate - lf)) OVER (PARTITION BY s ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM facts),
    cdf AS (SELECT s, any_value(rate) AS rate, list(c ORDER BY k) AS c FROM probs GROUP BY s),
    drawn AS (SELECT d.*, cdf.rate, len(list_filter(cdf.c, lambda x: x <= {unit(f"'{seed}'", key)}::DOUBLE / 4503599627370496::DOUBLE))::INTEGER AS n_copies
              FROM documents d JOIN cdf ON coalesce(d.source, '') = cdf.s),
    copies AS (SELECT *, unnest(range(1, n_copies + 1))::INTEGER AS copy FROM drawn WHERE n_copies > 0)
    SELECT {columns}, rate, n_copies, copy, {unit(f"'{seed}'", "'order'", key, "copy::VARCHAR")} AS shuffle_key FROM copies d"""
