"""Exact token counts at every prefix of a text, by dynamic programming over byte-level BPE.

For BPE with merges in rank order, a token sequence is what the encoder gives if and only if every neighbouring pair of
it is what the encoder gives for that pair's bytes.  So the encoding of a prefix is the encoding of a shorter prefix and
one last token, and that token is the only one that fits.  For a piece (what the pre-tokenizer cuts) of n bytes:

    last[j]  = the token t that ends at j with pair (last[j - len t], t) compatible
    count[j] = count[j - len t] + 1

which costs n times the longest token, also for a piece of a million letters, and gives the count at *every* prefix.

Across pieces the counts add up, with two corrections where a prefix is cut otherwise than the whole text: inside a run
of white space that goes on with a word (the run keeps its last blank while nothing follows it), and inside the
contractions ``'re 've 'll`` (a bare ``'r`` is two pieces).  Both are handled by taking such stretches as one *unit*.
Where this Python and the library know different versions of Unicode, the library is asked for the class of a code point
once and the text is cut as it says; counts are made from bytes in every case.  Units repeat a lot, so a worker keeps the deltas of the units it has seen in a bounded table.

The result is one signed number for each code point, ``count(prefix k) - count(prefix k - 1)``; sums of it answer how
many tokens a prefix has and how long a prefix fits a budget, without encoding again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnwick.llm.common import put, text_of

#: Units kept by a worker, and the longest one kept.
UNITS_KEPT, UNIT_CHARS = 800_000, 64

# The pattern of this family of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A class of the pattern, a letter that a code point of that class stays in one piece with, and one of the class that
#: every version of Unicode has.  What is of no class is white space.
CLASSES = ((r"\p{L}", "a", "\u4e2d"), (r"\p{N}", "1", "\u0663"), (r"[^\s\p{L}\p{N}]", "!", "\u00a7"))
WHITE = "\u3000"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Prefix counts for one vocabulary file of the ``tokenizers`` library (byte-level BPE, no normalizer)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("prefix counts are for byte-level BPE without a normalizer")
        letters = byte_letters()
        of = lambda token: bytes(letters[c] for c in token)
        added = {t["content"] for t in spec["added_tokens"]}
        self.tokens = {of(t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.longest = max(map(len, self.tokens))
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(of(a), of(b)): k for k, (a, b) in enumerate(pairs)}
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.fits = lru_cache(1 << 20)(self._fits)
        self.known: dict[str, bytes] = {}
        # Code points whose class was asked of the library, and stand-ins for those that ``regex`` classes otherwise.
        self.state = np.zeros(0x110000, np.uint8)  # not asked, the same class, another one
        self.stand_ins: dict[int, str] = {}
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        self.lead = regex.compile(r"\s*")
        self.classes = [(regex.compile(c), before, to) for c, before, to in CLASSES]
        body = r"(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)"
        self.units = regex.compile(
            r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"  # as in PIECES
            rf"|\s+ {body}|\s+[^\S ](?:'(?:[stmd]|re|ve|ll)|{body})|\s+"  # two or more white, then what follows
        )
        self.pieces = regex.compile(PIECES)

    def _fits(self, left: bytes, right: bytes) -> bool:
        """Whether the encoder gives exactly these two tokens for their joined bytes."""
        parts = [bytes((b,)) for b in left + right]
        ranks, none = self.ranks, len(self.ranks)
        while len(parts) > 1:
            order = [ranks.get(pair, none) for pair in zip(parts, parts[1:])]
            best = min(order)
            if best == none:
                break
            k = order.index(best)  # the leftmost of the lowest rank, as the library does
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts == [left, right]

    def piece(self, text: str) -> list[int]:
        """Tokens of each non-empty prefix (in code points) of one piece."""
        data = text.encode()
        n = len(data)
        count, last = [0] * (n + 1), [b""] * (n + 1)
        for j in range(1, n + 1):
            for k in range(max(0, j - self.longest), j):
                token = data[k:j]
                if token in self.tokens and (not k or self.fits(last[k], token)):
                    count[j], last[j] = count[k] + 1, token
                    break
        ends = accumulate(len(c.encode()) for c in text) if n != len(text) else range(1, n + 1)
        return [count[e] for e in ends]

    def joined(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            base = out[-1] if out else 0
            out += [base + c for c in self.piece(p)]
        return out

    def unit(self, text: str) -> list[int]:
        """Tokens of each non-empty prefix of a unit, each prefix cut as if the text ended with it."""
        white = self.lead.match(self.as_cut(text) if self.stand_ins else text).end()
        if text in ("'re", "'ve", "'ll"):
            return [*self.joined([text[0], text[1]]), self.piece(text)[-1]]
        if white < 2:
            return self.piece(text) if not white or text[0] == " " else self.joined([text[:1], *([text[1:]] if len(text) > 1 else [])])
        run = self.piece(text[:white])
        if white == len(text):
            return run
        rest = [" " + text[white:]] if text[white - 1] == " " else [text[white - 1], text[white:]]
        after = [run[white - 2] + c for c in self.joined(rest)]
        if text[white - 1] != " " and text[white:] in ("'re", "'ve", "'ll"):
            middle = run[white - 2] + self.joined([text[white - 1], "'", text[white + 1]])[-1]
            after[2] = middle
        return run + after[1:]

    def deltas(self, units: list[str]) -> list[int]:
        out: list[int] = []
        for u in units:
            counts = self.unit(u)
            out += [b - a for a, b in zip([0, *counts], counts)]
        return out

    def _known(self, unit: str) -> bytes:
        """The deltas of a unit as bytes; a delta outside int8 is not expected but allowed, see ``text``."""
        d = self.deltas([unit])
        if max(d) > 127 or min(d) < -128:
            raise OverflowError
        out = np.array(d, np.int8).tobytes()
        if len(unit) <= UNIT_CHARS:
            if len(self.known) >= UNITS_KEPT:
                self.known.clear()
            self.known[unit] = out
        return out

    def as_cut(self, text: str) -> str:
        """The text with code points that ``regex`` classes otherwise than the library as others of the library's class.

        The two may know different versions of Unicode.  The library is asked once for each code point that occurs.
        """
        if text.isascii():
            return text
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        state = self.state[codes]
        for code in np.unique(codes[state == 0]).tolist() if not state.min() else ():
            letter = chr(code)
            alone = lambda before: len(self.cutter.pre_tokenize_str(before + letter)) == 1  # noqa: E731, B023
            theirs = next((to for _, before, to in self.classes if alone(before)), WHITE)
            ours = next((to for class_, _, to in self.classes if class_.match(letter)), WHITE)
            self.state[code] = 1 if theirs == ours else 2
            if theirs != ours:
                self.stand_ins[code] = theirs
        return text.translate(self.stand_ins) if self.stand_ins and self.state[codes].max() == 2 else text

    def cut(self, text: str) -> list[str]:
        """The units of a text."""
        shown = self.as_cut(text)
        return self.units.findall(text) if shown is text else [text[m.start() : m.end()] for m in self.units.finditer(shown)]

    def ordinary(self, text: str) -> np.ndarray:
        """Deltas of a text without special tokens."""
        units = self.cut(text)
        get = self.known.get
        try:
            return np.frombuffer(b"".join([get(u) or self._known(u) for u in units]), np.int8)
        except OverflowError:
            return np.array(self.deltas(units), np.int64)

    def text(self, text: str) -> np.ndarray:
        """Deltas of a text, special strings in it read as special tokens."""
        found = list(self.special.finditer(text)) if self.special else []
        if not found:
            return self.ordinary(text)
        out, at = [], 0
        for m in found:
            before = self.ordinary(text[at : m.start()])
            out.append(before)
            # Prefixes that end within the special string are ordinary text: go on from the last unit before it.
            tail = self.cut(text[at : m.start()])[-1:]
            start = m.start() - len(tail[0]) if tail else m.start()
            base = int(before[: start - at].sum())
            part = base + np.cumsum(self.ordinary(text[start : m.end() - 1]))[m.start() - start :]
            ends = np.r_[int(before.sum()), part, int(before.sum()) + 1]
            out.append(np.diff(ends))
            at = m.end()
        out.append(self.ordinary(text[at:]))
        return np.concatenate([o.astype(np.int64) for o in out])


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One for each vocabulary and worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def store(deltas: np.ndarray) -> bytes:
    """Compressed deltas; the first byte tells their width."""
    if len(deltas) and deltas.dtype != np.int8 and (deltas.max() > 127 or deltas.min() < -128):
        return b"\x08" + zstandard.ZstdCompressor(level=1).compress(deltas.astype("<i8").tobytes())
    return b"\x01" + zstandard.ZstdCompressor(level=1).compress(deltas.astype(np.int8).tobytes())


def prefix_counts(stored: bytes) -> np.ndarray:
    """``counts[k]``: tokens of the first k code points, from k = 0 to the whole text."""
    kind = "<i8" if stored[:1] == b"\x08" else np.int8
    return np.r_[0, np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(stored[1:]), kind).astype(np.int64))]


def longest_fit(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def with_prefix_counts(docs: DataFrame, vocabulary: str, text_col: str = "text", budget: int = 512) -> DataFrame:
    """All input columns and rows plus ``n_tokens, fit_chars, prefix_counts``.

    ``prefix_counts`` holds the exact token count at every prefix (see ``prefix_counts``), ``n_tokens`` is its last
    value and ``fit_chars`` the code points of the longest prefix within ``budget``.  No text is cut.

    Null and empty texts have 0 tokens.  Repeated rows get equal results.  An empty table gives an empty result.  Input
    columns named like an output are replaced.  Map only: no shuffle, and a text is held once.
    """
    kind = pa.struct([("n_tokens", pa.int64()), ("fit_chars", pa.int64()), ("prefix_counts", pa.binary())])

    @F.arrow_udf("n_tokens long, fit_chars long, prefix_counts binary")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(vocabulary)
        for texts in batches:
            rows = []
            for scalar in texts:
                deltas = c.text(scalar.as_py())
                total = np.cumsum(deltas, dtype=np.int64)
                fit = len(deltas) if not len(total) or (total[-1] <= budget and total.max() <= budget) else longest_fit(np.r_[0, total], budget)
                rows.append({"n_tokens": int(total[-1]) if len(total) else 0, "fit_chars": fit, "prefix_counts": store(deltas)})
            yield pa.array(rows, kind)

    counted = put(docs, {"__count": count(text_of(text_col))})
    names = ("n_tokens", "fit_chars", "prefix_counts")
    return put(counted, {n: F.col(f"__count.{n}") for n in names}).drop("__count")


def tokens_of_prefix(stored: Column | str, chars: Column | str) -> Column:
    """Tokens of the first ``chars`` code points, read from the stored counts (null in, null out)."""

    @F.arrow_udf("long")
    def read(store_: pa.Array, chars_: pa.Array) -> pa.Array:
        ask = lambda s, n: int(prefix_counts(s)[n]) if s is not None and n is not None else None
        return pa.array([ask(s.as_py(), n.as_py()) for s, n in zip(store_, chars_)], pa.int64())

    return read(stored, chars)


def prefix_within(stored: Column | str, budget: Column | str) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens, read from the stored counts."""

    @F.arrow_udf("long")
    def read(store_: pa.Array, budget_: pa.Array) -> pa.Array:
        ask = lambda s, b: longest_fit(prefix_counts(s), b) if s is not None and b is not None else None
        return pa.array([ask(s.as_py(), b.as_py()) for s, b in zip(store_, budget_)], pa.int64())

    return read(stored, budget)
