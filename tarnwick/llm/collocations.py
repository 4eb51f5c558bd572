"""Phrase collocations: counts of all frequent phrases, scored by how much oftener their parts meet than by chance.

1. Words are counted in each language.  Those of at least ``least`` occurrences get dense numbers in the order of
   (language, word): a dictionary.  Every phrase that can be a result has such words only.
2. Texts become sequences of numbers, broken at the ends of pieces and at all other words, and are written once.
3. For each length, windows of numbers are packed into binary keys of one fixed width, so that their byte order is the
   order of the numbers.  Each task sorts and counts its keys first; the counted keys are dealt by ranges, sorted there
   (a radix sort on their first bytes) and equal neighbours are added up.
4. A window is counted only if both windows inside it that are one word shorter may be frequent.  That is asked of a
   bitmap of hashed keys with a fixed size, made from the frequent phrases of that length: it never denies one, and what
   it lets through in error is counted exactly and falls out.
5. Parts of a phrase are looked up by joins on their keys.

The bitmap has a fixed size.  The dictionary is broadcast in shards of measured size, each with a pass of its own where
there are several.  Sums over a key have a row for each task at most, so no word or phrase is too frequent for a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import BROADCAST_BYTES, bytes_of, cut, dealt, partitions, small_or_shuffled, text_of
from tarnwick.llm.order import numbered

#: Words of the longest phrase; bits of the bitmap, a power of two; keys or words that a task holds before it hands out.
LONGEST, BITMAP_BITS, HELD = 5, 1 << 26, 1 << 21
#: A task's words before they are handed out, and rows that a last ranking is made from at a time.
WORDS_HELD, RANKED = 1 << 18, 1 << 20
#: Piece ends become line ends, tabs become spaces.
BREAK = b"\n"
PIECES = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")


def tokens(text: str) -> list[bytes]:
    """Words in order, with a line end between pieces; some entries are empty."""
    return text.encode().lower().translate(PIECES).replace(BREAK, b" \n ").split(b" ")


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, word, f) from (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, word, n) for lang, c in held.items() for word, n in c.items()]
            held.clear()
            lang, word, n = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "f"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                found = text.as_py().encode().lower().translate(PIECES).split()  # of white space, pieces' ends are line ends by now
                held.setdefault(lang, Counter()).update(found)
                if sum(map(len, held.values())) > WORDS_HELD:
                    yield out()
        yield out()

    return docs.mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def encoded(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows (ids): a text's numbers as little-endian 32-bit integers, 0 where it is broken and at its end."""
    n_bytes = bytes_of(dictionary)
    shards = max(1, -(-n_bytes // BROADCAST_BYTES))
    spark = docs.sparkSession
    rows = docs.withColumn("ids", F.lit(b""))
    for shard in range(shards):  # one, unless the dictionary is larger than may be broadcast
        part: dict[str, dict[bytes, int]] = {}
        for r in dictionary.where(F.pmod(F.xxhash64("word"), F.lit(shards)) == shard).select("lang", "word", "id").toLocalIterator():
            part.setdefault(r["lang"], {})[r["word"].encode()] = r["id"]
        known = spark.sparkContext.broadcast(part)
        rows = rows.mapInArrow(_encode(known, shard == shards - 1), "lang string, text string, ids binary")
        if shard < shards - 1:
            rows = cut(rows)
    return cut(rows.where(F.octet_length("ids") > 4).select("ids"))


def _encode(known, last: bool) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for lang, text, before in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "ids"))):
                get = known.value.get(lang, {}).get
                found = tokens(text)
                row = np.fromiter((0 if w == BREAK else get(w, 0) if w else -1 for w in found), "<i4", len(found))
                row = np.append(row[row >= 0], 0).astype("<u4")
                if before:
                    row = np.maximum(row, np.frombuffer(before, "<u4"))
                if last:  # runs of breaks are one
                    row = row[np.append(True, (row[1:] > 0) | (row[:-1] > 0))]
                ids.append(row.tobytes())
            text = pa.nulls(len(ids), pa.string()) if last else batch.column("text")
            yield pa.RecordBatch.from_arrays([batch.column("lang"), text, pa.array(ids, pa.binary())], ["lang", "text", "ids"])

    return encode


class Keys:
    """Phrases as big-endian keys of one width: numbers left to right in fields of equal bits, a word of 64 bits holding
    as many as fit, 0 behind a phrase's end."""

    def __init__(self, most: int, longest: int):
        self.bits, self.longest = max(1, int(most).bit_length()), longest
        self.per = 64 // self.bits
        self.words = -(-longest // self.per)

    def pack(self, ids: np.ndarray) -> np.ndarray:
        """Keys (rows, words) from numbers (rows, length)."""
        out = np.zeros((len(ids), self.words), np.uint64)
        for k in range(ids.shape[1]):
            out[:, k // self.per] |= ids[:, k].astype(np.uint64) << np.uint64(64 - self.bits * (k % self.per + 1))
        return out

    def unpack(self, keys: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        return np.stack([(keys[:, k // self.per] >> np.uint64(64 - self.bits * (k % self.per + 1))) & mask for k in range(self.longest)], axis=1)

    def to_arrow(self, keys: np.ndarray) -> pa.Array:
        width = 8 * self.words
        offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int64) * width, pa.int32())
        return pa.Array.from_buffers(pa.binary(), len(keys), [None, offsets.buffers()[1], pa.py_buffer(keys.astype(">u8").tobytes())])

    def from_arrow(self, column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(-1, self.words).astype(np.uint64)


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys[:, 0], kind="stable") if keys.shape[1] == 1 else np.lexsort(keys.T[::-1])
    keys = keys[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    return keys[first], np.add.reduceat(counts[order], first)


def hashed(ids: np.ndarray) -> np.ndarray:
    """A hash of each row of numbers; its low bits name a bit of the bitmap."""
    h = np.zeros(len(ids), np.uint64)
    for k in range(ids.shape[1]):
        h = (h ^ ids[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def bitmap(grams: DataFrame, length: int, keys: Keys) -> np.ndarray:
    """A bitmap of the phrases in ``grams``: at most one row for each of its 64-bit words comes to the driver."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(hashed(keys.unpack(keys.from_arrow(batch.column("key")))[:, :length]) & np.uint64(BITMAP_BITS - 1))
            word = (bit >> np.uint64(6)).astype(np.int64)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), first) if len(word) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(bits.view(np.int64))], ["word", "bits"])

    marks = grams.select("key").mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(BITMAP_BITS // 64, np.uint64)
    found = marks.toPandas()
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def windows(texts: DataFrame, length: int, keys: Keys, shorter) -> DataFrame:
    """Rows (key, f): windows of ``length`` numbers without a break, counted in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = None if shorter is None else shorter.value
        held, counts = np.zeros((0, keys.words), np.uint64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def merged() -> None:
            nonlocal held, counts
            new = np.concatenate(waiting) if waiting else np.zeros((0, keys.words), np.uint64)
            waiting.clear()
            held, counts = counted(np.concatenate([held, new]), np.append(counts, np.ones(len(new), np.int64)))

        def out() -> pa.RecordBatch:
            nonlocal held, counts
            batch = pa.RecordBatch.from_arrays([keys.to_arrow(held), pa.array(counts)], ["key", "f"])
            held, counts = held[:0], counts[:0]
            return batch

        for batch in batches:
            for ids in slices(batch.column("ids"), length):
                n = len(ids) - length + 1
                if n <= 0:
                    continue
                view = np.lib.stride_tricks.sliding_window_view(ids, length)
                good = np.ones(n, bool)
                for k in range(length):
                    good &= ids[k : k + n] > 0
                if allowed is not None:
                    at = np.flatnonzero(good)
                    for part in (view[at, :-1], view[at, 1:]):
                        bit = hashed(part) & np.uint64(BITMAP_BITS - 1)
                        ok = (allowed[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
                        good[at[~ok]] = False
                waiting.append(keys.pack(view[good]))
                if sum(map(len, waiting)) > HELD:
                    merged()
                    if len(held) > HELD:
                        yield out()
        merged()
        for at in range(0, len(held), 1 << 18):
            yield pa.RecordBatch.from_arrays([keys.to_arrow(held[at : at + (1 << 18)]), pa.array(counts[at : at + (1 << 18)])], ["key", "f"])

    return texts.mapInArrow(count, "key binary, f long")


def slices(column: pa.Array, length: int) -> Iterator[np.ndarray]:
    """The numbers of several texts at once, which end in breaks; of long ones in stretches that overlap."""
    ids = np.frombuffer(b"".join(column.to_pylist()), "<u4")
    for at in range(0, len(ids), 1 << 20):
        yield ids[at : at + (1 << 20) + length - 1]


def run_lengths(partial: DataFrame, keys: Keys, least: int) -> DataFrame:
    """Rows (key, f) of at least ``least``: ranges of keys, sorted, equal neighbours added up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, so_far = np.zeros((0, keys.words), np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            key = np.concatenate([last, keys.from_arrow(batch.column("key"))])
            f = np.append(so_far, batch.column("f").to_numpy())
            if not len(key):
                continue
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            key, f = key[first], np.add.reduceat(f, first)
            last, so_far = key[-1:], f[-1:]
            keep = f[:-1] >= least
            yield pa.RecordBatch.from_arrays([keys.to_arrow(key[:-1][keep]), pa.array(f[:-1][keep])], ["key", "f"])
        keep = so_far >= least
        yield pa.RecordBatch.from_arrays([keys.to_arrow(last[keep]), pa.array(so_far[keep])], ["key", "f"])

    return partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(add, "key binary, f long")


def phrases(docs: DataFrame, least: int = 100, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame, Keys]:
    """Tables (lang, n), (id, lang, word) and (key, m, f) of all frequent phrases of 1 to ``longest`` words, and the keys."""
    words = cut(word_counts(docs))
    sums = cut(words.groupBy("lang").agg(F.sum("f").alias("n")))
    frequent = numbered(words.where(F.col("f") >= least), [], ["lang", "word"], "at")
    dictionary = cut(frequent.select((F.col("at") + 1).cast("int").alias("id"), "lang", "word", "f"))
    keys = Keys(dictionary.agg(F.coalesce(F.max("id"), F.lit(1))).first()[0], longest)
    texts = encoded(docs, dictionary)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([keys.to_arrow(keys.pack(batch.column("id").to_numpy()[:, None])), batch.column("f")], ["key", "f"])

    levels = [dictionary.select("id", "f").mapInArrow(single, "key binary, f long").withColumn("m", F.lit(1))]
    shorter = None
    for m in range(2, longest + 1):
        grams = cut(run_lengths(cut(windows(texts, m, keys, shorter)), keys, least))
        levels.append(grams.withColumn("m", F.lit(m)))
        if m < longest:
            marks = bitmap(grams, m, keys)
            if not marks.any():
                break
            shorter = docs.sparkSession.sparkContext.broadcast(marks)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return sums, dictionary, cut(out.select("key", "m", "f")), keys


def parts_of(grams: DataFrame, keys: Keys) -> DataFrame:
    """Rows (key, m, f, ids, cuts, inside): cuts (k, left, right) as keys, and the shorter phrases of two words or more."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_type = pa.struct([("k", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])
        as_bytes = lambda ids: keys.to_arrow(keys.pack(ids)).to_pylist()
        for batch in batches:
            m = batch.column("m").to_numpy()
            ids = keys.unpack(keys.from_arrow(batch.column("key"))).astype(np.int64)
            cuts: list[list] = [[] for _ in m]
            inside: list[list] = [[] for _ in m]
            for length in np.unique(m):
                rows = np.flatnonzero(m == length)
                part = {(a, b): as_bytes(ids[rows, a:b]) for a in range(length) for b in range(a + 1, length + 1) if b - a < length}
                for n, r in enumerate(rows):
                    cuts[r] = [{"k": k, "left": part[0, k][n], "right": part[k, int(length)][n]} for k in range(1, length)]
                    inside[r] = [x[n] for (a, b), x in part.items() if b - a > 1]
            arrays = [pa.array([list(i[:n]) for i, n in zip(ids, m)], pa.list_(pa.int32())), pa.array(cuts, pa.list_(cut_type)), pa.array(inside, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("m"), batch.column("f"), *arrays], ["key", "m", "f", "ids", "cuts", "inside"])

    return grams.mapInArrow(split, "key binary, m int, f long, ids array<int>, cuts array<struct<k:int,left:binary,right:binary>>, inside array<binary>")


def looked_up(rows: DataFrame, side: DataFrame, key: str, n_bytes: int, total: int) -> DataFrame:
    """``rows`` joined with ``side`` by one key; a large side by a shuffle that splits the keys of very many rows."""
    if n_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(side), key)
    times = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__times"))
    return dealt(rows, cut(side.join(times, key)), [key], "__times", total, F.xxhash64(*rows.columns))


def collocations(docs: DataFrame, least: int = 100, longest: int = LONGEST, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words.

    Words, pieces, counts and scores are as the contract of the query says: ``a`` of a phrase's occurrences is at least
    ``least``, its score is of the cut where ``floor(1000 a n / (l r))`` is least (of equal ones the first), and a phrase
    goes if it occurs only inside a longer one.  Order: score and ``a`` descending, then the phrase's bytes.

    Null texts are empty and give nothing.  A null language is ``und``, as is one of that name.  Repeated rows count
    as often as they occur.  Words may be of any length and texts too; both are read whole.  An empty table, or one
    without a phrase of enough occurrences, gives an empty one.  Only text and language are read, so other columns of
    any name do not clash.
    """
    docs = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), text_of(f"`{text_col}`").alias("text"))
    sums, dictionary, grams, keys = phrases(docs, least, longest)
    found = cut(parts_of(grams.where("m > 1"), keys))
    total = found.count() * 2 * longest
    side = grams.select("key", F.col("f").alias("of"))
    n_bytes = bytes_of(side)

    longer = found.select(F.explode("inside").alias("key"), "f").groupBy("key").agg(F.max("f").alias("most"))
    alone = found.join(longer, "key", "left").where(F.col("most").isNull() | (F.col("most") < F.col("f")))

    words = dictionary.select("id", "lang", "word")
    spelt = looked_up(alone.select("key", "f", F.posexplode("ids").alias("at", "id")), words, "id", bytes_of(words), total)
    phrase = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    spelt = spelt.groupBy("key").agg(phrase.alias("phrase"), F.first("lang").alias("lang"), F.first("f").alias("a"))
    spelt = spelt.join(small_or_shuffled(sums, bytes_of(sums)), "lang")

    cuts = alone.select("key", F.explode("cuts").alias("c")).select(F.col("key").alias("whole"), "c.*")
    cuts = looked_up(cuts.withColumnRenamed("left", "key"), side.withColumnRenamed("of", "l"), "key", n_bytes, total).drop("key")
    cuts = looked_up(cuts.withColumnRenamed("right", "key"), side.withColumnRenamed("of", "r"), "key", n_bytes, total).drop("key")
    scored = cuts.withColumnRenamed("whole", "key").join(spelt, "key")
    scored = scored.withColumn("score", F.expr("cast(1000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(n as decimal(38,0)) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("b")
    scored = scored.groupBy("key", "lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = cut(scored)
    pieces = max(partitions(docs.sparkSession), -(-total // RANKED))
    first = rows.withColumn("__piece", F.pmod(F.xxhash64("phrase"), F.lit(pieces)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__piece").orderBy(*order))).where(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return last.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

