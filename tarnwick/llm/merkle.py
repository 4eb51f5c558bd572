"""A Merkle manifest of a dataset, with an authentication path for every row, by fractal traversal.

Each source is a tree over its rows in id order, and a top tree stands over the sources.  Every 16 consecutive nodes
make one of the level above.

1. Leaves are digests of rows, made by Spark's SHA-256.  Their places come from ranges of (source, id), so that a source
   of any size spreads over many tasks.
2. An aligned block of 16^3 leaves is one group.  Its root alone goes up; roots of blocks are leaves of the next round,
   which has a 4096th of the rows, until each source has one node.  The same rounds run over the sources' roots.
3. Paths come down the same rounds.  A block's leaves are walked once from left to right.  For each level the walk
   keeps the run of siblings that the present leaf is under, and beside it the next run while it is being built: each
   step gives every such builder one more leaf, so it is complete when the present run is used up.  Two runs for each
   level is all that the walk holds.  The path of the block's root, from the round above, is appended to each leaf's.

Paths are ordinary columns, and both checking a row against the root and tampering with it are column expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import cut
from tarnwick.llm.order import numbered

#: Nodes that make one of the level above, and levels of a block.
ARITY, LEVELS = 16, 3
BLOCK = ARITY**LEVELS
HEX = 64
PATH = "array<struct<at:int,siblings:string>>"
PATH_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.string())]))


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column | str) -> Column:
    """The digest of a row's values or columns, in order."""
    return F.sha2(F.concat(*[field(F.col(f"`{v}`") if isinstance(v, str) else v) for v in values]), 256)


def path_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level from the leaf, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: step["siblings"]), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path; at each level ``at`` siblings are to the left."""

    def up(node: Column, step: Column) -> Column:
        left = step["at"] * HEX
        return F.sha2(F.concat(F.substring(step["siblings"], F.lit(1), left), node, F.substring(step["siblings"], left + 1, F.length(step["siblings"]))), 256)

    return F.aggregate(path, leaf, up)


class Run:
    """The nodes of one run at some level, built leaf by leaf with a stack of unfinished runs below it."""

    def __init__(self, level: int):
        self.stack: list[list[str]] = [[] for _ in range(level + 1)]

    def add(self, node: str) -> None:
        for k, below in enumerate(self.stack):
            below.append(node)
            if k == len(self.stack) - 1 or len(below) < ARITY:
                return
            node, self.stack[k] = digest(below), []

    def close(self) -> list[str]:
        """The run's nodes; unfinished runs below it, the last of the block, become nodes as they are."""
        for k, below in enumerate(self.stack[:-1]):
            if below:
                self.stack[k] = []
                self.stack[k + 1].append(digest(below))
        return self.stack[-1]


def block_root(leaves: list[str], levels: int) -> str:
    """The node above ``levels`` levels of at most ``16 ** levels`` leaves."""
    top = Run(levels)
    for leaf in leaves:
        top.add(leaf)
    return top.close()[0]


def walk(leaves: list[str], levels: int) -> Iterator[list[dict]]:
    """The path of each leaf in turn, up to the block's root, by the walk of the module's docstring."""
    present, coming = [], [Run(level) for level in range(levels)]
    for level in range(levels):
        first = Run(level)
        for leaf in leaves[: ARITY ** (level + 1)]:
            first.add(leaf)
        present.append(first.close())
    for i in range(len(leaves)):
        path = []
        for level in range(levels):
            span = ARITY ** (level + 1)
            if i and i % span == 0:
                present[level], coming[level] = coming[level].close(), Run(level)
            at, run = i // ARITY**level % ARITY, present[level]
            path.append({"at": at, "siblings": "".join(run[:at] + run[at + 1 :])})
            if i + span < len(leaves):  # one leaf of the next run for each leaf of this one
                coming[level].add(leaves[i + span])
        yield path


def depth_of(nodes: int, most: int = LEVELS) -> int:
    """Levels above so many nodes, at most those of a block."""
    levels = 0
    while levels < most and nodes > ARITY**levels:
        levels += 1
    return levels


def roots_of(nodes: DataFrame) -> DataFrame:
    """Rows (tree, at, size, node) of blocks, ``at`` and ``size`` being their place and the count in their tree."""
    most = LEVELS

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        size = int(rows["size"].iloc[0])
        node = block_root(list(rows["node"]), depth_of(size, most))
        return pd.DataFrame([[key[0], int(key[1]), -(-size // BLOCK), node]], columns=["tree", "at", "size", "node"])

    nodes = nodes.select("tree", "at", "size", "node")
    return nodes.groupBy("tree", F.floor(F.col("at") / BLOCK).alias("block")).applyInPandas(block, "tree string, at long, size long, node string")


def with_paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` plus ``path`` and ``subroot``: the path within the block by the walk, then that of the block's own node.

    ``above`` has rows (tree, at, path, subroot) for the nodes that blocks become.
    """
    most = LEVELS

    def block(rows: pa.Table, top: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["__block"]).sort_by("at")
        rest, subroot = top["path"][0].as_py(), top["subroot"][0].as_py()
        size = rows["size"][0].as_py()
        paths = [[*path, *rest] for path in walk(rows["node"].to_pylist(), depth_of(size, most))]
        return rows.append_column("path", pa.array(paths, PATH_TYPE)).append_column("subroot", pa.array([subroot] * len(rows), pa.string()))

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields]
    mine = nodes.withColumn("__block", F.floor(F.col("at") / BLOCK)).groupBy("tree", "__block")
    tops = above.select("tree", F.col("at").alias("__block"), "path", "subroot").groupBy("tree", "__block")
    return mine.cogroup(tops).applyInArrow(block, ", ".join([*kinds, f"path {PATH}", "subroot string"]))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of blocks, each written, up to one node for each tree.  A round has a 4096th of the rows before."""
    rounds = [nodes]
    while rounds[-1].agg(F.coalesce(F.max("size"), F.lit(1))).first()[0] > 1:
        rounds.append(cut(roots_of(rounds[-1])))
    return rounds


def descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the first round with their paths; ``above`` has (tree, at, path, subroot) for those of the last."""
    for nodes in reversed(rounds[:-1]):
        above = with_paths(nodes, cut(above.select("tree", "at", "path", "subroot")))
    if len(rounds) > 1:
        return above
    above = above.select(F.col("tree").alias("__tree"), "path", "subroot")  # every tree is one node
    return rounds[0].join(above, F.col("tree") == F.col("__tree")).drop("__tree")


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "source",
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Rows (id, group, leaf, at, path, subroot, root), one for each input row, and the columns of ``carry``.

    ``leaf`` is the digest of ``fields``.  ``at`` is the row's place in its group by (id, leaf), nulls first.  ``path``
    has one step for each level up to the root: how many siblings are to the left, and their digests, joined.  ``carry``
    are expressions of the input row that go along, such as the leaf that another copy of the data claims.

    Every field may be null and is then told from an empty one.  A null group is a group of its own and comes first.
    Null ids come first in their group.  Rows that repeat an id are in the order of their leaves; rows equal in all
    fields are interchangeable.  Texts are hashed whole at any length.  A single row is its own subroot and root, with an
    empty path.  An empty table gives an empty one.  Only fields, id and group are read; other columns, whatever their
    names, are dropped.
    """
    carry = dict(carry or {})
    kind = docs.schema[group_col].dataType
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit(""))  # "" for null, before all others
    made = {"id": F.col(f"`{id_col}`"), "tree": tree, "node": leaf_of(*fields)}
    made["tie"] = F.monotonically_increasing_id()  # so that rows that repeat id and leaf need not meet in one task
    rows = cut(docs.select(*[c.alias(n) for n, c in made.items()], *[c.alias(f"carry_{n}") for n, c in carry.items()]))
    own = climb(numbered(rows, ["tree"], ["id", "node", "tie"], "at", "size").drop("tie"))
    subroots = own[-1].select("tree", "node")
    top = climb(numbered(subroots.withColumnRenamed("tree", "source"), [], ["source"], "at", "size").withColumn("tree", F.lit("")))
    root = top[-1].first()
    tip = top[-1].select("tree", "at", F.from_json(F.lit("[]"), PATH).alias("path"), F.col("node").alias("subroot"))
    sources = descend(top, tip).select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("at"), "path", F.col("node").alias("subroot"))
    out = descend(own, cut(sources))
    group = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).cast(kind)
    columns = [F.col("id").alias(id_col), group.alias(group_col), F.col("node").alias("leaf"), "at", "path", "subroot", F.lit(root["node"] if root else None).cast("string").alias("root")]
    return out.select(*columns, *[F.col(f"carry_{n}").alias(n) for n in carry])
