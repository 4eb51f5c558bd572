"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last 16 code points cuts each text where the hash's low bits are zero, so equal stretches of
different documents are cut alike, wherever they stand.

1. Chunks are named by 128-bit hashes and counted over all documents; only names are shuffled.
2. The chunks that occur more than once are *shared*.  Of the texts that hold one, the text of the least name hands it
   out; copies of such a text meet in a hash aggregation, so each shared chunk is encoded once, for all documents.
3. The dictionary (name, ids) is joined with the chunk lists of the distinct texts; every text that holds shared chunks
   gets a parcel of their ids, and every row of that text the same one.
4. A document is made of the ids of its parcel and those of its other chunks, which occur nowhere else and are encoded
   there, so every chunk of the corpus is encoded once.

A chunk is encoded from its words and signs (no merge reaches over a blank); a worker keeps the ids of the words that it
has met in a bounded table, which is what makes a single chunk cheap and has no part in what is shared.

Concatenated chunk ids are wrong near the joins, where a cut may go through a word.  A join is repaired by encoding
again a stretch around it that begins behind a blank of the left chunk and ends at a blank of the right one (ASCII white
space ends a piece in every case: no merge, normal form or special string reaches over it).  What the stretch gives must
agree with the left chunk's ids up to that blank and with the right one's from there on; since those ids are known to be
final, the stretch is widened over further chunks until there is such a blank, at the worst over the whole text.

Texts without shared chunks are not shuffled where the names of the others were measured as small; otherwise texts meet
their parcels in one shuffled join, whose hot texts AQE splits.  A chunk that very many texts hold is dealt to many tasks.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm import common
from tarnwick.llm.common import SPACES, bytes_of, cut, dealt, put, small_or_shuffled, text_of

#: Mean, least and largest code points of a chunk, and how many words a worker's table keeps.
MEAN, LEAST, LARGEST, KEPT_PARTS = 1024, 256, 8192, 500_000
WINDOW = 16
_ODD = np.uint32(0x9E3779B1)


def cuts(text: str) -> list[int]:
    """The ends of the chunks of a text, the last being its length."""
    n = len(text)
    if n <= LEAST:
        return [n]
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    # Doubling: the hash of 2w code points from two hashes of w.
    rolled, width, factor = codes * _ODD, 1, int(_ODD)
    while width < WINDOW:
        power = np.uint32(pow(factor, width, 1 << 32))
        rolled = np.r_[rolled[:width], rolled[width:] + rolled[:-width] * power]
        width *= 2
    mixed = rolled ^ (rolled >> np.uint32(15))
    marks = np.flatnonzero((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - (MEAN - LEAST).bit_length()) == 0) + 1
    out, at = [], 0
    for mark in marks.tolist():
        while mark - at > LARGEST:
            at += LARGEST
            out.append(at)
        if mark - at >= LEAST:
            at = mark
            out.append(at)
    while n - at > LARGEST:
        at += LARGEST
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunks_of(text: str) -> list[str]:
    ends = cuts(text)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def named(chunk: str) -> tuple[int, int]:
    """The 128-bit name of a chunk as two signed numbers."""
    high, low = divmod(xxhash.xxh3_128_intdigest(chunk.encode("utf-8", "surrogatepass")), 1 << 64)
    return high - (high >> 63 << 64), low - (low >> 63 << 64)


BLANKS = re.compile(r"[\x20\x09-\x0D]+")
# A piece always ends between a letter or digit and one of these signs; next to other characters that is not certain.
_SIGN, _WORD = "#$%&*,.:;?!", "0-9A-Za-zÀ-ÖØ-öø-ÿ"
RUNS = re.compile(rf"[^\x20\x09-\x0D{_SIGN}]+|[{_SIGN}]+")
UNSURE = re.compile(rf"[^\x20\x09-\x0D{_SIGN}{_WORD}][{_SIGN}]|[{_SIGN}][^\x20\x09-\x0D{_SIGN}{_WORD}]")


class Chunk(NamedTuple):
    """A chunk's ids; ``head`` of them lie before its first blank and ``tail`` behind its last one.

    ``first`` and ``last`` are the code points where the first blank begins and the last one ends (-1: no blank).  The
    words next to those blanks are guards: ``left`` from code point ``left_at`` (in front of the last blank) and
    ``right`` up to ``right_at`` (behind the first blank), in ids.
    """

    ids: np.ndarray
    first: int
    last: int
    head: int = 0
    tail: int = 0
    left_at: int = 0
    left: int = 0
    right_at: int = 0
    right: int = 0


class Stretch(NamedTuple):
    """Text over a join, to be encoded again; its ids must begin with ``left`` and end with ``right``."""

    text: str
    left: np.ndarray
    right: np.ndarray


NONE = np.zeros(0, np.uint32)


class ChunkEncoder:
    """Encodes whole texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does."""

    def __init__(self, path: str):
        # Spark already runs a worker on each core; the library's own threads would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.parts: dict[str, bytes] = {}
        plain = self.library.decoder is None
        self.tokens = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size())] if plain else None
        self.encoded = self.used = self.disagreed = 0

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def chunks(self, chunks: set[str]) -> dict[str, Chunk]:
        """Each chunk encoded once, of its parts those that the worker has not met."""
        if len(self.parts) > KEPT_PARTS:  # the older half goes
            self.parts = dict(islice(self.parts.items(), len(self.parts) // 2, None))
        get = self.parts.get
        new = {c: sections(c) for c in chunks}
        found = {c: [list(map(get, s)) for s in cut_] for c, (cut_, _) in new.items()}
        lacking = [c for c, ids in found.items() if any(None in x for x in ids)]
        missing = list({p for c in lacking for s in new[c][0] for p in s if p not in self.parts})
        self.parts |= zip(missing, (array("I", ids).tobytes() for ids in self.ids(missing)))
        for c in lacking:
            found[c] = [list(map(get, s)) for s in new[c][0]]
        self.encoded += len(new)
        return {c: measured(ids, new[c][1]) for c, ids in found.items()}

    def encode_all(self, texts: list[str], parcels: list[dict[tuple[int, int], Chunk] | None] | None = None) -> list[np.ndarray]:
        """The ids of whole texts; ``parcels`` has the shared chunks of a text by name."""
        pieces, given = [], {}
        for text, parcel in zip(texts, parcels or [None] * len(texts)):
            pieces.append(chunks_of(text))
            if parcel:
                given |= {p: c for p in pieces[-1] if (c := parcel.get(named(p))) is not None}
        known = given | self.chunks({c for p in pieces for c in p if c not in given})
        self.used += sum(map(len, pieces))
        plans = [self._plan(p, known) for p in pieces]
        stretches = list({x.text for plan in plans for x in plan if isinstance(x, Stretch)})
        again = {s: np.array(ids, np.uint32) for s, ids in zip(stretches, self.ids(stretches))}
        return [self._joined(text, plan, again) for text, plan in zip(texts, plans)]

    def _plan(self, chunks: list[str], known: dict[str, Chunk]) -> list[np.ndarray | Stretch]:
        """What the ids of a text are made of: final ids of chunks, and stretches over joins."""
        plan: list[np.ndarray | Stretch] = []
        text, guard = "", NONE  # what is open on the left: its text, and the ids that its guard must give
        for k, chunk in enumerate(chunks):
            c, is_last = known[chunk], k == len(chunks) - 1
            if c.last < 0:  # no blank: the stretch goes on
                text += chunk
                continue
            if k:
                right = c.ids[c.head : c.head + c.right]
                plan.append(Stretch(text + chunk[: c.right_at], guard, right))
            plan.append(c.ids[c.head if k else 0 : len(c.ids) if is_last else len(c.ids) - c.tail])
            end = len(c.ids) - c.tail
            text, guard = ("", NONE) if is_last else (chunk[c.left_at :], c.ids[end - c.left : end])
        if text:
            plan.append(known[text].ids if len(chunks) == 1 else Stretch(text, guard, NONE))
        return plan

    def _joined(self, text: str, plan: list[np.ndarray | Stretch], again: dict[str, np.ndarray]) -> np.ndarray:
        parts = [NONE]
        for x in plan:
            if isinstance(x, Stretch):
                ids, end = again[x.text], len(again[x.text]) - len(x.right)
                if end < len(x.left) or not (np.array_equal(ids[: len(x.left)], x.left) and np.array_equal(ids[end:], x.right)):
                    self.disagreed += 1  # no agreement next to the blanks: the widest stretch is the text
                    return np.array(self.ids([text])[0], "<u4")
                x = ids[len(x.left) : end]
            parts.append(x)
        return np.concatenate(parts).astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        """As ``decode(ids, skip_special_tokens=False)``; a vocabulary without a decoder gives its tokens, blanks between."""
        if self.tokens is not None:
            return " ".join(map(self.tokens.__getitem__, ids.tolist()))
        return self.library.decode(ids.tolist(), skip_special_tokens=False)


def parts_of(text: str) -> list[str]:
    """A text's parts, over whose ends no merge reaches: words, and signs apart from words where that is certain."""
    return [w for w in BLANKS.split(text) if w] if UNSURE.search(text) else RUNS.findall(text)


def sections(chunk: str) -> tuple[list[list[str]], tuple[int, int, int, int]]:
    """The parts of a chunk's head, first word, middle, last word and tail (head, word, tail where there is a single
    word); and where blanks and guards are.

    Head and tail are cut words before the first and behind the last blank, the others are whole words.
    """
    first = BLANKS.search(chunk)
    if not first:
        return [parts_of(chunk)], (-1, -1, -1, -1)
    last = max(map(chunk.rfind, SPACES)) + 1
    body = chunk[first.start() : last].strip(SPACES)
    if not body:
        return [parts_of(chunk[: first.start()]), [], [], [], parts_of(chunk[last:])], (first.start(), last, last, first.start())
    after = BLANKS.search(body)
    right = body[: after.start()] if after else body
    left = body[max(map(body.rfind, SPACES)) + 1 :] if after else ""
    middle = body[len(right) : len(body) - len(left)]
    at = (first.start(), last, chunk.rfind(left or right, 0, last), first.end() + len(right))
    cut_ = [parts_of(x) for x in (chunk[: first.start()], right, middle, left, chunk[last:])]
    return (cut_ if after else [cut_[0], cut_[1], cut_[4]]), at


def measured(ids: list[list[bytes]], at: tuple[int, int, int, int]) -> Chunk:
    joined = np.frombuffer(b"".join([x for part in ids for x in part]), "<u4")
    first, last, left_at, right_at = at
    if first < 0:
        return Chunk(joined, -1, -1)
    sizes = [sum(map(len, part)) // 4 for part in ids]
    # With a single whole word, that is the guard on both sides.
    return Chunk(joined, first, last, sizes[0], sizes[-1], left_at, sizes[-2], right_at, sizes[1])


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One for each vocabulary and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


#: What the dictionary holds of a chunk, see ``Chunk``.
RECORD = "ids binary, first int, last int, head int, tail int, left_at int, left int, right_at int, right int"
NAMES = [x.split()[0] for x in RECORD.split(", ")]
_RECORD = pa.struct([(n, pa.binary() if n == "ids" else pa.int32()) for n in NAMES])


def _chunk(record: dict) -> Chunk:
    return Chunk(np.frombuffer(record["ids"], "<u4"), *[record[n] for n in NAMES[1:]])


def _listed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The names of a text's chunks."""
    kind = pa.list_(pa.struct([("c1", pa.int64()), ("c2", pa.int64())]))
    for batch in batches:
        names = [[named(c) for c in chunks_of(text.as_py())] for text in batch]
        flat = [n for row in names for n in row]
        pairs = pa.StructArray.from_arrays([pa.array([n[0] for n in flat], pa.int64()), pa.array([n[1] for n in flat], pa.int64())], ["c1", "c2"])
        yield pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(row) for row in names])], pa.int32()), pairs).cast(kind)


def text_names(text: Column) -> dict[str, Column]:
    """A text's 128-bit name in two columns."""
    return {"__t1": F.xxhash64(text), "__t2": F.xxhash64(F.lit("text"), text)}


def _parcels(texts: DataFrame, vocabulary: str) -> DataFrame:
    """Rows (__t1, __t2, parcel) for the distinct texts that hold shared chunks, from rows (__t1, __t2, text)."""
    names = F.arrow_udf(_listed, "array<struct<c1:bigint,c2:bigint>>")
    listed = cut(texts.select("__t1", "__t2", F.explode(names(F.col("text"))).alias("c")).select("__t1", "__t2", "c.c1", "c.c2"))
    shared = listed.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min("__t1").alias("owner")).where("n > 1")
    shared = cut(shared.select("c1", "c2", "owner", "n"))
    owners = cut(shared.groupBy("owner").agg(F.collect_list(F.struct("c1", "c2")).alias("wanted")))
    # The aggregation by whole text leaves one of each owner's copies in a task already.
    own = texts.join(small_or_shuffled(owners, bytes_of(owners)), F.col("__t1") == F.col("owner")).select("text", "wanted").distinct()

    @F.arrow_udf(f"array<struct<c1:bigint,c2:bigint,{', '.join(x.replace(' ', ':') for x in RECORD.split(', '))}>>")
    def encoded(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        e = encoder(vocabulary)
        kind = pa.list_(pa.struct([("c1", pa.int64()), ("c2", pa.int64()), *_RECORD]))
        for texts_, wanted in batches:
            for text, want in zip(texts_, wanted):
                names = {(w["c1"], w["c2"]) for w in want.as_py()}
                mine = {c: n for c in set(chunks_of(text.as_py())) if (n := named(c)) in names}
                yield pa.array([[{"c1": mine[c][0], "c2": mine[c][1], "ids": x.ids.tobytes()} | dict(zip(NAMES[1:], x[1:])) for c, x in e.chunks(set(mine)).items()]], kind)

    dictionary = own.select(F.explode(encoded("text", "wanted")).alias("x")).select("x.*").dropDuplicates(["c1", "c2"])
    record = F.struct("c1", "c2", *NAMES).alias("record")
    given = cut(dictionary.join(shared.select("c1", "c2", "n"), ["c1", "c2"]))
    found = dealt(listed.distinct(), given, ["c1", "c2"], "n", listed.count(), F.xxhash64("__t1"))
    return found.groupBy("__t1", "__t2").agg(F.collect_list(record).alias("parcel"))


def encode_and_decode(docs: DataFrame, vocabulary: str, text_col: str = "text", batch_chars: int = 500_000, decode: bool = True) -> DataFrame:
    """All input columns and rows plus ``ids`` (binary, little-endian unsigned 32-bit), ``n_tokens`` and, with
    ``decode``, ``decoded``.

    Null and empty texts have no ids and decode to the empty text.  Texts are encoded whole, whatever their length; a
    worker encodes about ``batch_chars`` code points at a time.  Repeated rows get equal results.  An empty table gives
    an empty result.  Input columns named like an output are replaced.
    """
    text = text_of(text_col)
    parcels = cut(_parcels(docs.select(text.alias("text")).select(*[c.alias(n) for n, c in text_names(F.col("text")).items()], "text"), vocabulary).withColumnRenamed("parcel", "__parcel"))
    rows, keys = put(docs, text_names(text)), ["__t1", "__t2"]
    n_bytes, flags = bytes_of(parcels), cut(parcels.select(*keys, F.lit(True).alias("__shares")))
    if n_bytes <= common.BROADCAST_BYTES or bytes_of(flags) > common.BROADCAST_BYTES:
        rows = rows.join(small_or_shuffled(parcels, n_bytes), keys, "left")
    else:  # the texts without a parcel stay where they are
        rows = rows.join(F.broadcast(flags), keys, "left")
        alone = rows.where("__shares is null").drop("__shares").withColumn("__parcel", F.lit(None).cast(parcels.schema["__parcel"].dataType))
        rows = rows.where("__shares").drop("__shares").join(parcels, keys).unionByName(alone)

    @F.arrow_udf("ids binary, n_tokens long, decoded string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        e = encoder(vocabulary)

        def coded(texts: list[str], given: list[dict | None]) -> pa.Array:
            coded_ = e.encode_all(texts, given)
            back = pa.array([e.decode(ids) for ids in coded_] if decode else [None] * len(coded_), pa.string())
            lengths = pa.array([len(ids) for ids in coded_], pa.int64())
            return pa.StructArray.from_arrays([pa.array([ids.tobytes() for ids in coded_], pa.binary()), lengths, back], ["ids", "n_tokens", "decoded"])

        for texts, parcels_ in batches:  # a batch is answered in several smaller ones
            waiting, given, size = [], [], 0
            for text_, parcel in zip(texts, parcels_):
                waiting.append(text_.as_py())
                given.append({(x["c1"], x["c2"]): _chunk(x) for x in parcel.as_py()} if parcel.is_valid else None)
                size += len(waiting[-1])
                if size >= batch_chars:
                    yield coded(waiting, given)
                    waiting, given, size = [], [], 0
            if waiting:
                yield coded(waiting, given)

    out = put(rows, {"__bpe": run(text, F.col("__parcel"))}).drop("__parcel", *keys)
    names = ["ids", "n_tokens"] + ["decoded"] * decode
    return put(out, {n: F.col(f"__bpe.{n}") for n in names}).drop("__bpe")
