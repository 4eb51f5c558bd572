"""Near-duplicate classes with DartMinHash signatures (Christiani, *DartMinHash: Fast Sketching for Weighted Sets*, 2020).

Signatures.  Darts are thrown at the plane (weight, rank).  Which darts an element gets in a cell of the plane is a
function of the element and the cell alone, so equal elements of different texts get equal darts.  A text keeps the
darts that land inside its elements' regions: weight below the element's weight, rank below ``darts / total weight``.
Each dart belongs to one of k coordinates by its hash, and the one of least rank is that coordinate's value.  Two texts
agree on a coordinate with the probability of their weighted Jaccard similarity.  A text throws about k ln k darts,
however long it is, so signatures are sparse to make.

Classes.  1. Texts with the same shingle set are one node, so copies cost nothing further.  Nodes are named by 120 bits.
2. Nodes that agree on a band of coordinates share a bucket.  Only nodes of one bucket are ever compared, never more
distant members of a chain of buckets.  3. A bucket's leader is the member that shares most with others (in a group of
copies, the original).  Each node is compared with the ``LEADERS`` leaders that it shares the most buckets with: a few
rows a node, however large a bucket is.  Components of what is alike settle nearly all.  4. A bucket that then still has
members of several components is open.  Its largest component needs no comparison within itself; every other member is
compared with the whole bucket, which is dealt in blocks of bounded nodes and weight, a pair of blocks to a task.  So
every pair that shares a bucket is compared unless both are in one class already, and no link between classes is lost.
5. Components of the links at or above the threshold are the classes.  Comparisons are exact, on shingle sets that are
made once for the nodes that share a bucket and carried as hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import bytes_of, cut, small_or_shuffled, text_of
from tarnwick.llm.components import components
from tarnwick.llm.shingles import mix, shingle_hashes


@dataclass(frozen=True)
class Near:
    """32 bands of 6 coordinates find a pair of similarity 0.8 with probability 0.99994; weights: "set" or "count".

    ``block_nodes`` and ``block_weight`` bound the nodes and shingles of one block in the exact comparison.
    """

    words: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows: int = 6
    weights: str = "set"
    block_nodes: int = 256
    block_weight: int = 1_000_000


# Cumulative probabilities of a Poisson distribution with mean 1, as thresholds for 32-bit numbers.
_P1 = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1.0, 13.0)]))
_POISSON = (_P1 * 2.0**32).astype(np.uint64)


def darts(elements: np.ndarray, weights: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts that hit the regions [0, weight) x [0, limit): the index of the element, the dart's hash and its rank.

    The plane is cut in rectangles [2^i - 1, 2^(i+1) - 1) x [2^j - 1, 2^(j+1) - 1) (weights by ranks), each of which is
    divided into 2^i * 2^j cells of area 1: 2^j strips along the weights by 2^i along the ranks.  A cell gets a
    Poisson(1) number of darts.  Only cells that reach into a region are made, so work is in proportion to the hits.
    """
    of, names, ranks = [], [], []
    for i in range(int(np.log2(1.0 + weights.max(initial=0.0))) + 1):
        for j in range(int(np.log2(1.0 + limits.max(initial=0.0))) + 1):
            live = np.flatnonzero((weights > 2.0**i - 1) & (limits > 2.0**j - 1))
            if not len(live):
                continue
            wide, tall = 2.0 ** (i - j), 2.0 ** (j - i)
            strips = np.minimum(1 << j, np.ceil((weights[live] - (2.0**i - 1)) / wide)).astype(np.int64)
            steps = np.minimum(1 << i, np.ceil((limits[live] - (2.0**j - 1)) / tall)).astype(np.int64)
            cell_of, place = _spread(strips * steps)
            a, b = np.divmod(place, steps[cell_of])
            cell_of = live[cell_of]
            with np.errstate(over="ignore"):
                cell = (np.uint64((i << 8 | j) + 1) << np.uint64(48)) ^ (a.astype(np.uint64) << np.uint64(24)) ^ b.astype(np.uint64)
                seed = mix(elements[cell_of] ^ mix(cell))
                dart_of, number = _spread(np.searchsorted(_POISSON, seed >> np.uint64(32), side="right"))
                dart = mix(seed[dart_of] + np.uint64(0x9E3779B97F4A7C15) * (number.astype(np.uint64) + np.uint64(1)))
                name = mix(dart + np.uint64(0xD1B54A32D192ED03))
            rank = 2.0**j - 1 + tall * (b[dart_of] + (dart >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            at = 2.0**i - 1 + wide * (a[dart_of] + (name >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            owner = cell_of[dart_of]
            hit = (rank < limits[owner]) & (at < weights[owner])
            of.append(owner[hit])
            names.append(mix(name[hit] ^ (dart[hit] >> np.uint64(7))))
            ranks.append(rank[hit])
    return np.concatenate([np.zeros(0, np.int64), *of]), np.concatenate([np.zeros(0, np.uint64), *names]), np.concatenate([np.zeros(0), *ranks])


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``sizes[i]`` times i, and 0, 1, .. within each."""
    at = np.repeat(np.arange(len(sizes)), sizes)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """For each non-empty weighted set its k coordinates: of each the hash of its earliest dart.

    About k (ln k + 2) darts meet every coordinate nearly always; a set that misses one gets twice the darts.
    """
    out = np.zeros((len(sets), k), np.uint64)
    todo, wanted = np.arange(len(sets)), k * (np.log(k) + 2.0)
    while len(todo):
        sizes = np.array([len(sets[t][0]) for t in todo])
        owner = np.repeat(np.arange(len(todo)), sizes)
        limits = np.repeat([wanted / sets[t][1].sum() for t in todo], sizes)
        of, names, ranks = darts(np.concatenate([sets[t][0] for t in todo]), np.concatenate([sets[t][1] for t in todo]), limits)
        where = owner[of] * k + ((names >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((ranks, where))
        met, first = np.unique(where[order], return_index=True)
        out[todo[met // k], met % k] = names[order][first]
        todo, wanted = todo[np.bincount(met // k, minlength=len(todo)) < k], wanted * 2
    return out


def band_hashes(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for column in coordinates.reshape(bands, rows).T:
            out = mix(out ^ column) + column
    return mix(out)


def weighted(text: str, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles and their weights."""
    elements, counts = np.unique(shingle_hashes(text, near.words), return_counts=True)
    return elements, counts.astype(np.float64) if near.weights == "count" else np.ones(len(elements))


def set_name(elements: np.ndarray, weights: np.ndarray) -> Decimal | None:
    """The name of a weighted set's node: 60 bits each of two hashes; none for the empty set."""
    if not len(elements):
        return None
    with np.errstate(over="ignore"):
        each = mix(elements + mix(weights.astype(np.uint64)))
        one = int(mix(np.array([each.sum(dtype=np.uint64) + np.uint64(len(elements))]))[0])
        two = int(mix(np.array([(each * mix(each)).sum(dtype=np.uint64)]))[0])
    return Decimal((one >> 4 << 60) + (two >> 4))


NODE = "decimal(38,0)"
#: With how many of its buckets' leaders a node is compared before open buckets are compared as a whole.
LEADERS = 2
#: Elements for which darts are thrown at a time, and code points of which sets are made at a time.
BATCH, CHARS = 60_000, 2_000_000


def _sketch(near: Near):
    kind = pa.struct([("node", pa.decimal128(38, 0)), ("n", pa.int32()), ("bands", pa.list_(pa.int64()))])

    def rows_of(sets: list[tuple[np.ndarray, np.ndarray]]) -> list[dict]:
        some = [s for s in sets if len(s[0])]
        made = iter(signatures(some, near.bands * near.rows))
        rows = []
        for s in sets:
            bands = band_hashes(next(made), near.bands, near.rows).view(np.int64) if len(s[0]) else None
            rows.append({"node": set_name(*s), "n": len(s[0]), "bands": bands})
        return rows

    @F.arrow_udf(f"node {NODE}, n int, bands array<long>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows, sets, size = [], [], 0
            for scalar in texts:
                sets.append(weighted(scalar.as_py(), near))
                size += len(sets[-1][0])
                if size >= BATCH:
                    rows += rows_of(sets)
                    sets, size = [], 0
            yield pa.array(rows + rows_of(sets), kind)

    return sketch


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: Near = Near()) -> DataFrame:
    """One row for each input row: the id, ``text_key`` (a hash of the text), ``class_id`` (least id of the class),
    ``class_size`` (its rows), ``n_shingles`` and ``kept`` (true for the row of the class with the least id and key).

    Two texts are linked when the Jaccard similarity of their word shingles is at or above ``near.similarity``; a class
    is a connected component of links.  A text of fewer than five words is one shingle.

    Null, empty and blank texts have no shingles: each such row is its own class.  Rows with a null id take part; the
    class id is the least id that is not null, or null where there is none.  Rows that repeat an id or a text are rows
    of the class; rows that repeat both are one document and share ``kept``.  Rows that agree in id and key
    are equal, so there are no other ties.  Texts of any length are compared whole.  An empty table gives an empty
    result.  Only id and text are read; other columns, whatever their names, are dropped.
    """
    text = text_of(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    made = cut(keyed.select("id", "text_key", _sketch(near)(F.col("text")).alias("s")).select("id", "text_key", "s.*"))
    linked = cut(_linked(keyed, made.where("node is not null"), near))
    named = made.select("id", "text_key", "node", "n").join(small_or_shuffled(linked, bytes_of(linked)), "node", "left")
    named = named.withColumn("class", F.coalesce("component", "node")).drop("node", "component")

    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("text_key").alias("text_key")))
    classes = named.where("class is not null").groupBy("class").agg(first.alias("first"), F.count(F.lit(1)).alias("class_size"))
    many = cut(classes.where("class_size > 1"))
    out = named.join(small_or_shuffled(many, bytes_of(many)), "class", "left")
    is_first = F.col("first").isNull() | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.text_key")))
    return out.select(
        F.col("id").alias(id_col),
        "text_key",
        F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.col("n").cast("long").alias("n_shingles"),
        is_first.alias("kept"),
    )


def _buckets(made: DataFrame) -> DataFrame:
    """Rows (band, node, n, m, leader) for the nodes that share a bucket; m is the bucket's size."""
    nodes = made.groupBy("node").agg(F.first("bands").alias("bands"), F.first("n").alias("n"))
    slots = nodes.select("node", "n", F.explode("bands").alias("band"))
    sizes = slots.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("m")).where("least < most")
    shared = cut(slots.join(sizes.select("band", "m"), "band"))
    standing = cut(shared.groupBy("node").agg(F.sum("m").alias("standing")))
    ranked = shared.join(small_or_shuffled(standing, bytes_of(standing)), "node")
    leaders = ranked.groupBy("band").agg(F.max(F.struct("standing", "node"))["node"].alias("leader"))
    return cut(shared.join(leaders, "band"))


def _sets(keyed: DataFrame, made: DataFrame, nodes: DataFrame, near: Near) -> DataFrame:
    """Rows (node, elements, weights) with the shingle set of each of ``nodes``."""
    one = made.groupBy("node").agg(F.min(F.struct("id", "text_key")).alias("one")).join(nodes, "node", "left_semi")  # copies meet as partial rows
    one = cut(one.select("node", F.col("one.id").alias("one_id"), F.col("one.text_key").alias("one_key")))
    # By id and text: copies of a text, however many, are dealt apart; the distinct leaves one of rows that repeat both.
    same = (F.col("text_key") == F.col("one_key")) & F.col("id").eqNullSafe(F.col("one_id"))
    texts = keyed.join(small_or_shuffled(one, bytes_of(one)), same).select("node", "text").distinct()
    kind = pa.struct([("elements", pa.binary()), ("weights", pa.binary())])

    def row(text: str) -> dict:
        elements, weights = weighted(text, near)
        return {"elements": elements.tobytes(), "weights": None if near.weights == "set" else weights.astype(np.float32).tobytes()}

    @F.arrow_udf("elements binary, weights binary")
    def shingled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:  # a batch is answered in several smaller ones
            rows, size = [], 0
            for scalar in batch:
                text = scalar.as_py()
                rows.append(row(text))
                size += len(text)
                if size >= CHARS:
                    yield pa.array(rows, kind)
                    rows, size = [], 0
            if rows:
                yield pa.array(rows, kind)

    return cut(texts.select("node", shingled("text").alias("s")).select("node", "s.*"))


def _linked(keyed: DataFrame, made: DataFrame, near: Near) -> DataFrame:
    """Rows (node, component) for the classes of more than one node."""
    shared = _buckets(made)
    sets = _sets(keyed, made, shared.select("node").distinct(), near)
    edges = _compared(_with_leaders(shared, near).join(sets, "node"), near)
    linked = cut(components(edges))
    units = _open(shared, linked, near)
    if units.isEmpty():
        return linked
    more = _compared(units.join(sets, "node"), near)
    return components(more.unionByName(linked.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def _blocks(nodes: Column | str, weight: Column | str, near: Near) -> Column:
    return F.greatest(F.ceil(F.col(nodes) / near.block_nodes), F.ceil(F.col(weight) / near.block_weight)).cast("int")


def _with_leaders(shared: DataFrame, near: Near) -> DataFrame:
    """Units (u, x, y) of a leader, which asks, and a block of the nodes that are to be compared with it."""
    often = shared.where("node <> leader").groupBy("node", "n", "leader").agg(F.count(F.lit(1)).alias("times"))
    first = Window.partitionBy("node").orderBy(F.desc("times"), "leader")  # at most a row for each band
    pairs = cut(often.withColumn("k", F.row_number().over(first)).where(F.col("k") <= LEADERS).select("node", "n", "leader"))
    sizes = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("weight")).select("leader", _blocks("m", "weight", near).alias("blocks"))
    sizes = cut(sizes)
    unit = lambda df, node, x, asks: df.select(F.col("leader").cast("string").alias("u"), x.cast("int").alias("x"), F.lit(0).alias("y"), F.col(node).alias("node"), F.lit(asks).alias("asks"))
    mine = pairs.join(small_or_shuffled(sizes, bytes_of(sizes)), "leader")
    asking = sizes.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return unit(mine, "node", F.pmod(F.xxhash64("node"), F.col("blocks")), False).unionByName(unit(asking, "leader", F.col("x"), True))


def _open(shared: DataFrame, linked: DataFrame, near: Near) -> DataFrame:
    """Units (u, x, y) of a block x of an open bucket and a group y of its members outside the largest component.

    Buckets of the same members are one.
    """
    rows = shared.select("band", "node", "n").join(small_or_shuffled(linked, bytes_of(linked)), "node", "left")
    rows = rows.select("band", "node", "n", F.coalesce("component", "node").alias("component"))
    parts = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("weight"), F.sum(F.xxhash64("node") % (1 << 40)).alias("sign1"), F.sum(F.hash("node").cast("long")).alias("sign2"))
    main = F.max(F.struct("m", "component", "weight"))
    whole = parts.groupBy("band").agg(main.alias("main"), F.sum("m").alias("m"), F.sum("weight").alias("weight"), F.sum("sign1").alias("sign1"), F.sum("sign2").alias("sign2"))
    whole = whole.where("main.m < m").groupBy("m", "weight", "sign1", "sign2").agg(F.min_by(F.struct("main"), "band")["main"].alias("main"), F.min("band").alias("band"))
    whole = whole.select(
        "band", F.col("main.component").alias("main"), _blocks("m", "weight", near).alias("blocks"),
        F.greatest(F.ceil((F.col("m") - F.col("main.m")) / near.block_nodes), F.ceil((F.col("weight") - F.col("main.weight")) / near.block_weight)).cast("int").alias("groups"),
    )
    whole = cut(whole)
    mine, group = (F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(of)).cast("int") for salt, of in (("block", "blocks"), ("group", "groups")))
    members = cut(rows.join(small_or_shuffled(whole, bytes_of(whole)), "band").select("band", "node", mine.alias("mine"), F.when(F.col("component") != F.col("main"), group).alias("group"), "blocks", "groups"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    answers = members.withColumn("y", each("groups")).select("band", F.col("mine").alias("x"), "y", "node", F.coalesce(F.col("group") == F.col("y"), F.lit(False)).alias("asks"))
    asked = members.where("group is not null").withColumn("x", each("blocks")).where("x <> mine").select("band", "x", F.col("group").alias("y"), "node", F.lit(True).alias("asks"))
    return answers.unionByName(asked).withColumn("u", F.col("band").cast("string")).drop("band")


def _compared(units: DataFrame, near: Near) -> DataFrame:
    """Edges (a, b) that span the pairs at or above the threshold of which at least one asks, within each unit."""

    def compare(unit: pd.DataFrame) -> pd.DataFrame:
        ids, roots, out = unit["node"].to_numpy(), list(range(len(unit))), []

        def root(x: int) -> int:
            while roots[x] != x:
                roots[x] = roots[roots[x]]
                x = roots[x]
            return x

        sets = [np.frombuffer(e, np.uint64) for e in unit["elements"]]
        weights = [np.ones(len(s)) if w is None else np.frombuffer(w, np.float32).astype(np.float64) for s, w in zip(sets, unit["weights"])]
        for a, b in alike(list(zip(sets, weights)), near.similarity, asks=np.flatnonzero(unit["asks"].to_numpy(bool))):
            x, y = root(a), root(b)
            if x != y:
                roots[x] = y
                out.append((ids[a], ids[b]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)

    return units.groupBy("u", "x", "y").applyInPandas(compare, f"a {NODE}, b {NODE}")


def alike(sets: list[tuple[np.ndarray, np.ndarray]], similarity: float, columns: int = 4096, asks: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of sets whose exact (weighted) Jaccard similarity reaches the threshold; with ``asks``, those with one of it.

    Overlaps are sums of products of 0/1 matrices, made for some thousand shared elements at a time.  A weight counts as
    that many levels, as min(x, y) is the sum over levels of [x >= level] [y >= level].
    """
    m = len(sets)
    asks = np.arange(m) if asks is None else asks
    totals = np.array([w.sum() for _, w in sets])
    owner = np.repeat(np.arange(m), [len(e) for e, _ in sets])
    all_elements = np.concatenate([e for e, _ in sets])
    asked = np.unique(np.concatenate([all_elements[:0], *[sets[i][0] for i in asks]]))
    weight = np.concatenate([w for _, w in sets])
    if len(asks) < m:  # only what an asking set holds can be shared with it
        at = np.minimum(np.searchsorted(asked, all_elements), max(len(asked) - 1, 0))
        some = asked[at] == all_elements if len(asked) else np.zeros(len(all_elements), bool)
        owner, all_elements, weight = owner[some], all_elements[some], weight[some]
    _, element, often = np.unique(all_elements, return_inverse=True, return_counts=True)
    shared = often[element] > 1
    owner, element, weight = owner[shared], element[shared], weight[shared]
    overlap = np.zeros((len(asks), m))
    below = 0.0
    for level in np.unique(weight):
        has = weight >= level
        rows, (_, cols) = owner[has], np.unique(element[has], return_inverse=True)
        order = np.argsort(cols, kind="stable")
        rows, cols = rows[order], cols[order]
        for low in range(0, int(cols.max(initial=-1)) + 1, columns):
            part = slice(*np.searchsorted(cols, [low, low + columns]))
            block = np.zeros((m, min(columns, int(cols[-1]) + 1 - low)), np.float32)
            block[rows[part], cols[part] - low] = 1
            overlap += (level - below) * (block[asks] @ block.T)
        below = level
    union = totals[asks][:, None] + totals[None, :] - overlap
    a, b = np.nonzero(overlap >= similarity * union - 1e-9)
    a = asks[a]
    both = np.isin(b, asks)
    keep = (a < b) | ((a > b) & ~both)  # each pair once, no set with itself
    return zip(a[keep].tolist(), b[keep].tolist())
