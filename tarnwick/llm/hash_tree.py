"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A row descends region, rack and shard.  At each node every child draws a straw ``-ln(u) / weight`` with ``u`` hashed
from the row's id and the child's name, and the shortest straw wins: a child is met in proportion to its weight among its
siblings.  A straw depends on nothing but the row, the child and the child's weight.  So a changed weight moves rows only
between that child's subtree and its siblings: a longer straw only loses rows, a shorter one only gains them, and what
is drawn inside the subtrees stays as it is.

Growth.  One more shard comes as a region of its own, with one rack and one shard and a shard's weight.  It draws one
more straw at the region level; no other straw changes, so all movement ends in the added shard.  This is the law
``key``: id and shard count decide.

Slots: rows of a shard are split into cells by another hash of id and text; cells are counted, a running sum over the few
cell counts gives each cell its offset, and rows are numbered within their cell.  So no shard has to be in one task, nor
has an id that a third of the rows share.  Cells grow with the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import bytes_of, cut, put, small_or_shuffled, text_of, unit_hash

#: Weights of a rack's shards; a rack (weight, shards); a region (weight, racks).
Rack = tuple[float, tuple[float, ...]]
Region = tuple[float, tuple[Rack, ...]]
#: Least cells of a shard, and about how many rows a cell is to have at most.
LEAST_CELLS, CELL_ROWS = 256, 1_000_000


def equal(regions: int, racks: int, shards: int) -> tuple[Region, ...]:
    """Equal shards; racks and regions weigh as many shards as they have."""
    return ((float(racks * shards), ((float(shards), (1.0,) * shards),) * racks),) * regions


@dataclass(frozen=True)
class Tree:
    """Regions of racks of shards, each node with a weight among its siblings; shards are numbered in that order."""

    regions: tuple[Region, ...] = field(default_factory=lambda: equal(2, 3, 4))

    @property
    def size(self) -> int:
        return sum(len(shards) for _, racks in self.regions for _, shards in racks)

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own."""
        return Tree((*self.regions, (weight, ((weight, (weight,)),))))

    def with_weight(self, weight: float, region: int, rack: int | None = None, shard: int | None = None) -> Tree:
        """The tree with another weight of one node: a shard, or a rack, or a region.  The weights above it stay."""
        own, racks = self.regions[region]
        if rack is None:
            changed = (weight, racks)
        else:
            its, shards = racks[rack]
            new = (weight, shards) if shard is None else (its, (*shards[:shard], weight, *shards[shard + 1 :]))
            changed = (own, (*racks[:rack], new, *racks[rack + 1 :]))
        return replace(self, regions=(*self.regions[:region], changed, *self.regions[region + 1 :]))

    def levels(self) -> tuple[list[list[float]], list[list[float]], list[int]]:
        """Weights of racks by region, of shards by (region, rack), both filled up with 0, and first shard numbers."""
        most = max(len(racks) for _, racks in self.regions)
        widest = max(len(shards) for _, racks in self.regions for _, shards in racks)
        filled = [[*racks, *[(0.0, ())] * (most - len(racks))] for _, racks in self.regions]
        leaves = [[*shards, *[0.0] * (widest - len(shards))] for racks in filled for _, shards in racks]
        sizes = [len(shards) for racks in filled for _, shards in racks]
        return [[w for w, _ in racks] for racks in filled], leaves, [sum(sizes[:k]) for k in range(len(sizes))]


def straw(key: Column, name: Column | str, weight: Column | float = 1.0) -> Column:
    """Endless for a child without weight."""
    name, weight = (F.lit(x) if isinstance(x, (str, float, int)) else x for x in (name, weight))
    drawn = -F.ln((unit_hash(key, name) * F.lit(float(1 << 52)) + 0.5) / F.lit(float(1 << 52)))
    return F.when(weight > 0, F.try_divide(drawn, weight)).otherwise(F.lit(float("inf")))


def drawn(key: Column, nodes: Column) -> Column:
    """The shortest straw (s, k) among an array of nodes (name, weight, k); of equal ones the lowest number."""
    straws = F.transform(nodes, lambda n: F.struct(straw(key, n["name"], n["weight"]).alias("s"), n["k"].alias("k")))
    return F.array_min(straws)


def children(names: list[str], weights: list[float]) -> Column:
    """Nodes under one parent as an array for `drawn`."""
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(k).alias("k")) for k, (n, w) in enumerate(zip(names, weights))])


def descended(df: DataFrame, key: Column, tree: Tree, name: str) -> DataFrame:
    """``df`` with the int column ``name``, the shard of ``key``, and ``__straw``, the length of its region's straw.

    Straws are drawn in one expression over an array for each level, so the generated code does not grow with the tree.
    """
    racks, leaves, first = tree.levels()
    wide = len(racks[0])
    tables = [
        children([f"region {r}" for r in range(len(racks))], [w for w, _ in tree.regions]),
        F.array(*[children([f"rack {g} {k}" for k in range(wide)], row) for g, row in enumerate(racks)]),
        F.array(*[children([f"shard {n // wide} {n % wide} {k}" for k in range(len(row))], row) for n, row in enumerate(leaves)]),
    ]
    df = df.withColumn("__top", drawn(key, tables[0]))
    df = df.withColumn("__node", F.col("__top.k") * wide + drawn(key, F.get(tables[1], F.col("__top.k")))["k"])
    leaf = drawn(key, F.get(tables[2], F.col("__node")))["k"]
    df = df.withColumn(name, (F.get(F.array(*map(F.lit, first)), F.col("__node")) + leaf).cast("int"))
    return df.withColumn("__straw", F.col("__top.s")).drop("__top", "__node")


def shard_of(df: DataFrame, key: Column, tree: Tree, name: str) -> DataFrame:
    """``df`` with the int column ``name``: the shard of ``key`` in ``tree``."""
    return descended(df, key, tree, name).drop("__straw")


def cells_for(rows: int, tree: Tree) -> int:
    return max(LEAST_CELLS, -(-rows // (tree.size * CELL_ROWS)))


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree: Tree = Tree(), cells: int | None = None) -> DataFrame:
    """All input rows and columns but the text, plus ``size, text_crc32, law, shard, slot, grown_shard``.

    ``slot`` is gapless from 0 in each shard, in the order of cell, id, CRC and size.  ``cells`` (of a shard) grow with
    the counted rows unless they are given.

    A null text has no bytes, so size 8 and CRC 0.  Texts of any length are measured whole and are not in the result.  Null ids are one key and share a shard.  Rows that repeat an id
    share a shard and get slots in turn; rows equal in every column are interchangeable there.  An empty table gives an
    empty result.  Input columns named like an output are replaced.
    """
    cells = cells_for(docs.count(), tree) if cells is None else cells
    text, key = text_of(text_col), F.col(id_col)
    crc = F.crc32(text.cast("binary"))
    rows = put(docs, {"size": F.octet_length(text).cast("long") + 8, "text_crc32": crc, "law": F.lit("key")}).drop(text_col)
    rows = rows.withColumn("__cell", _cell(key, F.col("text_crc32"), cells))
    rows = descended(rows, key, tree, "shard")
    # One more shard comes as a region of its own: one more straw decides, and no other changes.
    added = straw(key, f"region {len(tree.regions)}", 1.0)
    rows = rows.withColumn("grown_shard", F.when(added < F.col("__straw"), F.lit(tree.size)).otherwise(F.col("shard")))
    placed = cut(rows.drop("__straw"))  # counted and numbered, without reading texts again

    counts = placed.groupBy("shard", "__cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell
    offsets = cut(counts.select("shard", "__cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset")))
    order = Window.partitionBy("shard", "__cell").orderBy(F.col(id_col).asc_nulls_first(), "text_crc32", "size")
    numbered = placed.withColumn("__row", F.row_number().over(order) - 1)
    out = numbered.join(small_or_shuffled(offsets, bytes_of(offsets)), ["shard", "__cell"])
    columns = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    out = out.withColumn("slot", (F.col("__offset") + F.col("__row")).cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in {*columns, text_col.lower()}], *columns)


def _cell(key: Column, crc: Column, cells: int) -> Column:
    return F.floor(unit_hash(F.lit("cell"), key, crc) * cells).cast("int")


def straw_sql(key: str, name: str, weight: str) -> str:
    """The same straw for an engine with ``md5`` and hexadecimal literals."""
    bits = f"('0x' || substr(md5(concat_ws('|', coalesce({key}::VARCHAR, '~'), {name})), 1, 13))::BIGINT::DOUBLE"
    return f"CASE WHEN {weight} > 0 THEN -ln(({bits} + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / {weight} ELSE 'inf'::DOUBLE END"


def shard_sql(key: str, tree: Tree, source: str) -> str:
    """SQL for rows ``(*, sh)`` of ``source`` with the shard number; used as a check by another engine."""
    racks, leaves, first = tree.levels()
    pick = lambda straws: "list_min([" + ", ".join(f"{{'s': {s}, 'k': {k}}}" for k, s in enumerate(straws)) + "]).k"
    weight = lambda table, row, k: "[" + ", ".join(f"{w[k]}::DOUBLE" for w in table) + f"][{row} + 1]"
    top = [straw_sql(key, f"'region {r}'", f"{w}::DOUBLE") for r, (w, _) in enumerate(tree.regions)]
    rack = [straw_sql(key, f"'rack ' || g || ' {k}'", weight(racks, "g", k)) for k in range(len(racks[0]))]
    node = f"(g * {len(racks[0])} + r)"
    leaf = [straw_sql(key, f"'shard ' || g || ' ' || r || ' {k}'", weight(leaves, node, k)) for k in range(len(leaves[0]))]
    inner = f"SELECT *, {pick(leaf)} AS l FROM (SELECT *, {pick(rack)} AS r FROM (SELECT *, {pick(top)} AS g FROM {source}))"
    return f"SELECT * EXCLUDE (g, r, l), ({first}[{node} + 1] + l)::INTEGER AS sh FROM ({inner})"
