"""Nearest neighbours by inner product from a forest of random-projection trees.

1. Equal vectors are one point, with its least ids (one more than are asked for is enough, since ties go to the least).
2. Largest inner product becomes least distance by one more coordinate that gives all points the largest norm.
3. The forest is fitted on a bounded sample: each node splits its sample points at the median of their projection on the
   line between two centres that start at random points.  Every point is then put into a leaf of each tree.  Leaves grow
   in number with the points up to a bound.
4. A query searches all trees through one priority queue: the node whose worst margin on the way is best comes first,
   whichever tree it is in.  It stops after so many leaves, and not before one tree has given enough points.  The number
   of leaves is set on the sample: the least that finds ``target`` of the true neighbours of held-out sample points.
5. What the best sample points in a query's leaves reach is a bound: no point under it is among the nearest found.
6. Leaves are packed into blocks of bounded size; a leaf above that size is dealt to several.  A block meets the queries
   that visit it, in pieces of bounded size, scores the visited leaves exactly and keeps each query's best above its bound.
   The best of all blocks are merged, spread to the ids of equal vectors, and given to every row that asks.

Nothing grows without bound in one place: the forest, its sample and the counts of leaves are bounded by parameters; no
leaf or number of queries is capped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import BROADCAST_BYTES, bytes_of, cut, dealt, small_or_shuffled


@dataclass(frozen=True)
class Limits:
    """Trees; points of a leaf that are aimed at; most leaves of a tree; bounds of the sample, in vectors and bytes;
    wanted recall on the sample and how many of its points it is measured on; points and queries of a block."""

    trees: int = 4
    leaf_points: int = 256
    most_leaves: int = 4096
    sample: int = 32_768
    sample_bytes: int = 64 << 20
    target: float = 0.96
    asked: int = 128
    block_points: int = 8192
    block_queries: int = 4096
    seed: int = 7


class Forest:
    """Complete binary trees of one depth; node k has the children 2k+1 (projection up to the threshold) and 2k+2."""

    def __init__(self, directions: np.ndarray, thresholds: np.ndarray, depth: int):
        self.directions, self.thresholds, self.depth = directions, thresholds, depth
        self.trees, self.leaves = len(directions), 1 << depth

    @classmethod
    def fit(cls, points: np.ndarray, trees: int, depth: int, seed: int) -> Forest:
        rng, inner = np.random.default_rng(seed), (1 << depth) - 1
        directions, thresholds = np.zeros((trees, inner, points.shape[1])), np.zeros((trees, inner))
        for t in range(trees):
            held = {0: np.arange(len(points))}
            for k in range(inner):
                own = held.pop(k)
                w = cls._direction(points[own], rng)
                p = points[own] @ w
                b = float(np.median(p)) if len(own) else 0.0
                directions[t, k], thresholds[t, k] = w, b
                held[2 * k + 1], held[2 * k + 2] = own[p <= b], own[p > b]
        return cls(directions, thresholds, depth)

    @staticmethod
    def _direction(own: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        if len(own) < 2:
            return rng.standard_normal(own.shape[1]) / max(1, own.shape[1]) ** 0.5
        own = own[rng.choice(len(own), min(len(own), 512), replace=False)]
        a, b = own[0], own[1]
        for _ in range(4):
            near = (own * own).sum(1)[:, None] - 2 * own @ np.stack([a, b]).T + np.array([a @ a, b @ b])
            first = near[:, 0] <= near[:, 1]
            if first.all() or not first.any():
                break
            a, b = own[first].mean(0), own[~first].mean(0)
        w = a - b
        size = np.linalg.norm(w)
        return w / size if size > 0 else rng.standard_normal(own.shape[1]) / own.shape[1] ** 0.5

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree."""
        out = np.empty((len(points), self.trees), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                p = np.einsum("ij,ij->i", points, self.directions[t, node])
                node = 2 * node + 1 + (p > self.thresholds[t, node])
            out[:, t] = node - (self.leaves - 1)
        return out

    def margins(self, queries: np.ndarray) -> np.ndarray:
        """Signed distances (query, tree, node) from the splits."""
        flat = self.directions.reshape(-1, queries.shape[1])
        return (queries @ flat.T).reshape(len(queries), self.trees, -1) - self.thresholds

    def search(self, margin: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf), best first, for a query's margins; one queue for all trees."""
        inner = self.leaves - 1
        queue = [(-np.inf, t, 0) for t in range(self.trees)]
        rows = margin.tolist()
        while queue:
            worst, t, node = heapq.heappop(queue)
            if node >= inner:
                yield t, node - inner
                continue
            m = rows[t][node]
            heapq.heappush(queue, (max(worst, m), t, 2 * node + 1))
            heapq.heappush(queue, (max(worst, -m), t, 2 * node + 2))


def lifted(x: np.ndarray, scale: float, norm: float) -> np.ndarray:
    """Points with the coordinate that brings all to the largest norm, which becomes 1."""
    x = x / scale / norm
    return np.c_[x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))]


def directed(x: np.ndarray, scale: float) -> np.ndarray:
    """Queries as directions; their norm does not change the order of inner products."""
    x = x / scale
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.c_[np.divide(x, size, out=np.zeros_like(x), where=size > 0), np.zeros(len(x))]


def visits_for(forest: Forest, points: np.ndarray, raw: np.ndarray, k: int, limits: Limits) -> int:
    """The least number of leaves that finds the wanted share of the sample's true neighbours."""
    rng = np.random.default_rng(limits.seed + 1)
    asked = rng.choice(len(raw), min(len(raw), limits.asked), replace=False)
    leaves, margins = forest.leaf_of(points), forest.margins(directed(raw[asked], 1.0))
    found = []
    for row, i in enumerate(asked):
        score = raw @ raw[i]
        score[i] = -np.inf
        true = np.argpartition(-score, min(k, len(raw) - 1))[:k]
        place = np.empty((forest.trees, forest.leaves))
        for n, (t, leaf) in enumerate(forest.search(margins[row]), 1):
            place[t, leaf] = n
        found.append(np.min([place[t, leaves[true, t]] for t in range(forest.trees)], axis=0))
    return int(np.ceil(np.quantile(np.concatenate(found), limits.target)))


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros, which add nothing to an inner product."""
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def best_of(block: tuple[np.ndarray, np.ndarray], queries: np.ndarray, visits: list[list[int]], k: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, score) of each query's best ``k`` points in the leaves that it visits, none under its bound.

    ``block`` is points and their leaves, points in the order in which ties are settled.  Inner products are summed in
    the order of the components.
    """
    points, leaf = block
    asking: dict[int, list[int]] = {}
    for q, wanted in enumerate(visits):
        for n in wanted:
            asking.setdefault(n, []).append(q)
    least = bounds.copy()
    rounding = 1e-12 * np.sqrt((queries * queries).sum(1)) * np.sqrt((points * points).sum(1).max(initial=0.0))
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    waiting = 0

    def compact() -> None:
        q, p, s = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((p, -s, q))
        q, p, s = q[order], p[order], s[order]
        start = np.searchsorted(q, q, side="left")
        keep = np.arange(len(q)) - start < k
        last = np.arange(len(q)) - start == k - 1
        least[q[last]] = np.maximum(least[q[last]], s[last])
        held[:] = [(q[keep], p[keep], s[keep])]

    for n, own in sorted(asking.items()):
        at = np.flatnonzero(leaf == n)
        for from_ in range(0, len(own), 1024):
            who = np.array(own[from_ : from_ + 1024])
            rough = queries[who] @ points[at].T
            slack = 1e-9 * np.abs(least[who]) + rounding[who]
            bar = np.where(np.isfinite(least[who]), least[who] - slack, -np.inf)
            q, p = np.nonzero(~(rough < bar[:, None]))
            for to in range(0, len(q), 1 << 16):
                i, j = who[q[to : to + (1 << 16)]], at[p[to : to + (1 << 16)]]
                exact = np.cumsum(queries[i] * points[j], axis=1)[:, -1]
                held.append((i, j, exact))
                waiting += len(i)
                if waiting > 1 << 19:
                    compact()
                    waiting = 0
    compact()
    return held[0]


def reached(queries: np.ndarray, sample: np.ndarray, leaves: np.ndarray, visits: list[np.ndarray], k: int, slack: np.ndarray) -> np.ndarray:
    """What the ``k`` best of the sample reach for each query, counting only points in a leaf that it visits, less
    ``slack`` for rounding; fewer points bound nothing.

    ``leaves`` has a sample point's leaf in each tree, ``visits`` for each query what it visits of (tree, leaf).
    """
    out = np.full(len(queries), -np.inf)
    if len(sample) < k:
        return out
    scores, trees = queries @ sample.T, np.arange(leaves.shape[1])
    for i, seen in enumerate(visits):
        own = scores[i][seen[trees, leaves].any(axis=1)]
        if len(own) >= k:
            out[i] = np.partition(own, len(own) - k)[len(own) - k]
    return np.where(np.isfinite(out), out - 1e-9 * np.abs(out) - slack, -np.inf)


def usable(vector: Column) -> Column:
    """Not null, no component null or not finite, and not all of them zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbours(vectors: DataFrame, asks: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", limits: Limits = Limits()) -> DataFrame:
    """Rows (query_id, rank, id, score): the ``k`` nearest rows found for every row where ``asks`` holds.

    Nearness is the largest inner product in double precision, of the vectors as they are; ties go to the smaller id.
    A row is no candidate of itself.  All other candidates come if there are no more than ``k``.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows without an id.
    A shorter vector counts as filled up with zeros.  Rows that repeat id and vector are candidates of each other.  Long
    vectors are read whole.  An empty table gives an empty one.  Only id and vector are read, so other columns of any name do not
    clash; ``asks`` may read any column.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # no negative zeros
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    key = ["h1", "h2"]

    # Equal vectors: the least ids of each by a ranking that Spark limits before its shuffle, and a row for each that asks.
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where(F.col("n") <= k + 1)
    points = cut(least.groupBy(*key).agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")))
    counts = F.count(F.lit(1)).alias("times")
    queries = cut(rows.where("asks").groupBy(*key).agg(counts, F.first("v").alias("v")))
    size = F.array_max(F.transform("v", F.abs))
    n, dim, scale = points.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(size)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    norm = points.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.lit(scale)) * (x / F.lit(scale))))).first()[0] ** 0.5

    sample_size = max(2, min(limits.sample, limits.sample_bytes // (8 * dim)))
    in_sample = F.pmod(F.col("h1"), F.lit(1 << 20)) < min(1 << 20, -(-(2 << 20) * sample_size // n))  # about twice as many, then the least
    drawn = points.select("v", "h2").where(in_sample).orderBy("h2").limit(sample_size).select("v").toArrow()
    raw = matrix(drawn.column("v").to_pandas(), dim) / scale
    depth = max(0, min(n // limits.leaf_points, limits.most_leaves, len(raw) // 8).bit_length() - 1)
    sampled = lifted(raw, 1.0, norm)
    forest = Forest.fit(sampled, limits.trees if depth else 1, depth, limits.seed)
    visits = visits_for(forest, sampled, raw, k, limits) if depth else 1
    shared = spark.sparkContext.broadcast((forest.directions, forest.thresholds, forest.depth))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Forest(*shared.value)
        for batch in batches:
            x = matrix(batch.column("v").to_pandas(), dim)
            leaves = own.leaf_of(lifted(x, scale, norm))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(leaves), pa.list_(pa.int32()))], [*batch.schema.names, "leaves"])

    indexed = cut(points.mapInArrow(put, "h1 long, h2 long, ids array<long>, v array<double>, leaves array<int>"))
    # The sample once more, with the leaves that its points are in.
    drawn = indexed.select("v", "h2", "leaves").where(in_sample).orderBy("h2").limit(sample_size).toArrow()
    known = spark.sparkContext.broadcast((matrix(drawn.column("v").to_pandas(), dim), np.stack(drawn.column("leaves").to_pylist())))
    del drawn
    held = indexed.select(F.posexplode("leaves").alias("tree", "leaf"))
    sizes = np.zeros((forest.trees, forest.leaves), np.int64)
    for r in held.groupBy("tree", "leaf").count().collect():  # a row for each leaf of the forest, which is bounded
        sizes[r["tree"], r["leaf"]] = r["count"]
    first, pieces = blocks_for(sizes, limits.block_points)
    placed = spark.sparkContext.broadcast((sizes, first, pieces))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Forest(*shared.value)
        sizes, first, pieces = placed.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = matrix(part.column("v").to_pandas(), dim)
                margins = own.margins(directed(x, scale))
                who, block, wanted, seen = [], [], [], []
                for i in range(part.num_rows):
                    found, leaves = visited(own, margins[i], visits, k + 1, sizes, first, pieces)
                    seen.append(leaves)
                    for b, asked in found.items():
                        who.append(i)
                        block.append(b)
                        wanted.append(asked)
                bound = reached(x, *known.value, seen, k + 1, 1e-12 * np.sqrt((x * x).sum(1)) * norm * scale)
                taken = part.select(["h1", "h2", "v"]).take(pa.array(who, pa.int64()))
                made = [pa.array(bound[who]), pa.array(block, pa.int64()), pa.array(wanted, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*taken.columns, *made], ["h1", "h2", "v", "bound", "block", "wanted"])

    asked = cut(queries.mapInArrow(visit, "h1 long, h2 long, v array<double>, bound double, block long, wanted array<int>"))
    parts = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / limits.block_queries).cast("int").alias("parts"))
    parts = cut(parts)  # a row for each block
    n_bytes = bytes_of(parts)
    asked = asked.join(small_or_shuffled(parts, n_bytes), "block").withColumn("part", F.pmod("h2", F.col("parts")).cast("int")).drop("parts")
    table = [(t, leaf, int(first[t, leaf]), int(pieces[t, leaf])) for t in range(forest.trees) for leaf in range(forest.leaves)]
    table = F.broadcast(spark.createDataFrame(table, "tree int, leaf int, first long, pieces long"))  # a row for each leaf of the forest
    spread = indexed.select("h1", "h2", "ids", "v", F.posexplode("leaves").alias("tree", "leaf")).join(table, ["tree", "leaf"])
    spread = spread.select((F.col("first") + F.pmod("h1", F.col("pieces"))).alias("block"), (F.col("tree") * forest.leaves + F.col("leaf")).alias("leaf"), "h1", "h2", "ids", "v")
    spread = spread.join(small_or_shuffled(parts, n_bytes), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def meet(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        columns = ["h1", "h2", "c1", "c2", "score", "ids"]
        if not len(mine) or not len(theirs):
            return pd.DataFrame(columns=columns)
        mine = mine.assign(id=[x[0] for x in mine["ids"]]).sort_values("id", ignore_index=True)
        q, p, s = best_of((matrix(mine["v"], dim), mine["leaf"].to_numpy()), matrix(theirs["v"], dim), theirs["wanted"], k + 1, theirs["bound"].to_numpy(float))
        parts = [theirs[c].to_numpy()[q] for c in ("h1", "h2")] + [mine[c].to_numpy()[p] for c in ("h1", "h2")]
        return pd.DataFrame(dict(zip(columns, [*parts, s, mine["ids"].to_numpy()[p]])), columns=columns)

    met = spread.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(meet, "h1 long, h2 long, c1 long, c2 long, score double, ids array<long>")
    once = met.groupBy(*key, "c1", "c2").agg(F.first("score").alias("score"), F.first("ids").alias("ids"))  # what several trees found

    own = (F.col("c1") == F.col("h1")) & (F.col("c2") == F.col("h2"))
    each = once.select(*key, "score", own.alias("own"), F.explode("ids").alias("id"))
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "id", "own")
    each = each.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    best = each.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "score", "id", "own"))).alias("best"))
    best = cut(best.join(queries.select(*key, "times"), key))
    total = rows.where("asks").count()
    asking = rows.where("asks").select(F.col("id").alias("query_id"), *key)
    given = asking.join(F.broadcast(best.drop("times")), key) if bytes_of(best) <= BROADCAST_BYTES else dealt(asking, best, key, "times", total, F.xxhash64("query_id"))
    mine = F.array_min(F.transform(F.filter("best", lambda x: x["own"] & (x["id"] == F.col("query_id"))), lambda x: x["at"]))
    others = F.slice(F.filter("best", lambda x: x["at"] != F.coalesce(mine, F.lit(0))), 1, k)
    out = given.select("query_id", F.posexplode(others).alias("rank", "near"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("near.id").alias("id"), F.col("near.score").alias("score"))


def blocks_for(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each leaf and how many it has: leaves share a block of at most ``limit`` points, larger ones
    get several of their own."""
    first, pieces, n = np.zeros(sizes.shape, np.int64), np.ones(sizes.shape, np.int64), -1
    for t, row in enumerate(sizes):
        held = limit
        for leaf, size in enumerate(row):
            if size > limit:
                pieces[t, leaf] = -(-size // limit)
                first[t, leaf] = n + 1
                n, held = n + pieces[t, leaf], limit
                continue
            if held + size > limit:
                n, held = n + 1, 0
            first[t, leaf] = n
            held += size
    return first, pieces


def visited(forest: Forest, margin: np.ndarray, visits: int, need: int, sizes: np.ndarray, first: np.ndarray, pieces: np.ndarray) -> tuple[dict[int, list[int]], np.ndarray]:
    """Leaves by block: the best ``visits``, and more while no tree alone has given ``need`` points; and the same as a
    mask (tree, leaf)."""
    given, out, seen = [0] * forest.trees, {}, np.zeros(sizes.shape, bool)
    for n, (t, leaf) in enumerate(forest.search(margin)):
        if n >= visits and max(given) >= need:
            break
        size = int(sizes[t, leaf])
        given[t] += size
        seen[t, leaf] = True
        for b in range(int(first[t, leaf]), int(first[t, leaf] + pieces[t, leaf])) if size else ():
            out.setdefault(b, []).append(t * forest.leaves + leaf)
    return out, seen
