"""Helpers shared by the text operators: cut lineage safely, broadcast only what is measured, name columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.lineage import cut, shared_folder  # noqa: F401

#: ASCII white space, the class ``[\x20\x09-\x0D]`` of every contract here.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"

#: A table is broadcast only after its bytes were measured and stay under this.
BROADCAST_BYTES = 16 << 20


def _size(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            each = F.aggregate(column, F.lit(0).cast("long"), lambda sum_, x: sum_ + _size(x, kind.elementType))
        else:
            each = F.size(column).cast("long") * 8
        return F.coalesce(each, F.lit(0)) + 32
    if isinstance(kind, T.StructType):
        return sum((_size(column[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    return F.lit(16).cast("long")


def bytes_of(df: DataFrame) -> int:
    """About the bytes of all rows, from one aggregation; ``df`` should be cut."""
    row = sum((_size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def small_or_shuffled(df: DataFrame, n_bytes: int, limit: int | None = None) -> DataFrame:
    """Hint a broadcast when the *measured* bytes stay under the limit; otherwise leave a shuffled join to AQE."""
    return F.broadcast(df) if n_bytes <= (BROADCAST_BYTES if limit is None else limit) else df


def dealt(rows: DataFrame, side: DataFrame, keys: list[str], times: str, total: int, salt: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, which has a row per key and in ``times`` how many of the ``total`` rows have it.

    A key of more than a ten-thousandth of the rows is split into pieces of that size by ``salt``.  The list of such keys
    is broadcast: it has at most 10,000 entries, since their rows add up to no more than the total.
    """
    per = max(512, total // 10_000)
    pieces = F.greatest(F.ceil(F.col(times) / per), F.lit(1)).cast("int")
    hot = side.where(F.col(times) > per).select(*keys, pieces.alias("__pieces"))
    spread = side.withColumn("__piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop(times)
    rows = rows.join(F.broadcast(hot), keys, "left").withColumn("__piece", F.pmod(salt, F.coalesce("__pieces", F.lit(1))).cast("int")).drop("__pieces")
    return rows.join(spread, [*keys, "__piece"], how).drop("__piece")


def text_of(column: str) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def put(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with these columns at the end; a column of the same name in the input is replaced by the output."""
    wanted = {name.lower() for name in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in wanted]
    return df.select(*kept, *[value.alias(name) for name, value in columns.items()])


def words_of(text: Column) -> Column:
    """Array of the maximal runs of anything but ASCII white space."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row even where ``body`` uses it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5: the same in any engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
