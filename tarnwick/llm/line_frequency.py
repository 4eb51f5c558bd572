"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base figures of each text come from its own words and lines.  Across documents, each normalised line is hashed and the
distinct documents that hold it are counted per host; lines above the host's limit are taken out, and a document that
loses too much is rejected.

*Distinct documents* are distinct texts: a text copied a thousand times counts once, since copies are the business of
dedup and must not make a clean text look like boilerplate.

The limit is a count of texts and no share of the host: ``source`` is a coarse host, and a line on a twentieth of its
texts is boilerplate however large the host is.  So nothing bounds the lines above the limit of one host.

Plan: one shuffle of (host, line hash, text hash) with partial aggregation before it, one of the partial counts.  A line
that a third of the rows share is spread by text hash first and then met as one partial count per task.  The lines above
the limit are then joined by (host, line hash) with the lines of each distinct text, and what they hit is attached by
(host, text hash): no value holds more than one text's lines.  Both joins broadcast their small side only where it was
measured and are salted shuffles otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm import common
from tarnwick.llm.common import SPACE_CLASS, bytes_of, cut, let, put, text_of, words_of

WINDOW = 8
#: A key of a shuffled join is dealt to this many tasks.
SALT = 32
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Limits:
    """A line goes when more than ``min_documents`` distinct documents of the host hold it.

    ``max_share`` above 0 asks for more than that share of the host's distinct documents as well.

    A document goes when it fails a base rule, or when the lines taken from it leave fewer than ``min_words`` words or
    less than ``min_left`` of its words.
    """

    min_words: int = 20
    max_repeat_percent: int = 30
    min_documents: int = 30
    max_share: float = 0.0
    min_left: float = 0.30


def normal_line(line: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), SPACE_CLASS + "+", " "))


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of eight words that are found twice or more in the text, the first one included."""
    n = F.size(words)
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))))
    windows = F.coalesce(windows, F.array().cast("array<bigint>"))

    def starts(pairs: Column) -> Column:
        size = F.size(pairs)
        twin = lambda e, j: F.coalesce(F.get(pairs, j)["h"] == e["h"], F.lit(False))
        marked = F.transform(pairs, lambda e, i: F.when(twin(e, i - 1) | F.when(i + 1 < size, twin(e, i + 1)).otherwise(False), e["i"]))
        return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        none = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("sum"))
        return F.aggregate(let(pairs, starts), none, step)["sum"]

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def base_figures(text: Column) -> dict[str, Column]:
    words = words_of(text)
    lines = lines_of(text)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.regexp_replace(text, SPACE_CLASS + "+", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": let(words, repeated_words),
    }


def lines_by_text(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """Rows (host, doc, lines): the hash of a text and those of its distinct lines."""
    text = text_of(text_col)
    return docs.select(
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.xxhash64(text).alias("doc"),
        F.array_distinct(F.transform(lines_of(text), lambda line: F.xxhash64(normal_line(line)))).alias("lines"),
    )


def frequent_lines(docs: DataFrame, text_col: str, host_col: str, limits: Limits) -> DataFrame:
    """Rows (host, line) with the hash of each line above its host's limit."""
    each = lines_by_text(docs, text_col, host_col)
    held = each.select("host", "doc", F.explode("lines").alias("line")).distinct()
    counts = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limits.min_documents)
    if not limits.max_share:
        return counts.select("host", "line")
    hosts = each.select("host", "doc").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    return counts.join(hosts, "host").where(F.col("n") > limits.max_share * F.col("docs")).select("host", "line")


def attached(rows: DataFrame, small: DataFrame, n_small: int, keys: list[str], salt: Column, how: str) -> DataFrame:
    """``rows`` joined with ``small``: broadcast where that was measured as small, else shuffled by the keys and a salt."""
    if n_small <= common.BROADCAST_BYTES:
        return rows.join(F.broadcast(small), keys, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("__salt", F.pmod(salt, F.lit(SALT)).cast("int")).join(salted, [*keys, "__salt"], how).drop("__salt")


def hit_lines(docs: DataFrame, text_col: str, host_col: str, lines: DataFrame, n_bytes: int) -> DataFrame:
    """Rows (host, doc, frequent) for the texts that hold a line of ``lines``, with the hashes of those they hold."""
    held = lines_by_text(docs, text_col, host_col).select("host", "doc", F.explode("lines").alias("line"))
    hit = attached(held, lines, n_bytes, ["host", "line"], F.col("doc"), "inner")
    return hit.groupBy("host", "doc").agg(F.collect_set("line").alias("frequent"))


def quality_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """All input columns and rows plus ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_lines_removed, n_words_left, clean_text, kept``.

    ``clean_text`` is the text without the lines above the limit; ``kept`` is the verdict.

    Null or empty texts have no words: all figures are 0, ``base_failed`` holds and ``kept`` does not.  A null host is
    a host of its own (the empty name).  Repeated rows get equal results.  Texts of any length are read whole.  An empty table gives an empty result.  Input
    columns named like an output are replaced.
    """
    lines = cut(frequent_lines(docs, text_col, host_col, limits))
    n_bytes = bytes_of(lines)
    rows = put(docs, {"__host": F.coalesce(F.col(host_col).cast("string"), F.lit("")), "__doc": F.xxhash64(text_of(text_col))})
    if n_bytes:
        hit = cut(hit_lines(docs, text_col, host_col, lines, n_bytes).select(F.col("host").alias("__host"), F.col("doc").alias("__doc"), F.col("frequent").alias("__frequent")))
        rows = attached(rows, hit, bytes_of(hit), ["__host", "__doc"], F.monotonically_increasing_id(), "left")
    else:
        rows = rows.withColumn("__frequent", F.lit(None).cast("array<bigint>"))

    text = text_of(text_col)
    removable = F.col("__frequent").isNotNull()
    stays = lambda line: ~F.array_contains(F.col("__frequent"), F.xxhash64(normal_line(line))) | ~line.rlike(r"[^\x20\x09-\x0D]")
    left = F.when(removable, F.filter(F.split(text, "\n", -1), stays))
    rows = put(rows, base_figures(text) | {"__left": left})
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    rows = put(
        rows,
        {
            "base_failed": failed,
            "n_lines_removed": F.when(removable, F.size(F.split(text, "\n", -1)) - F.size("__left")).otherwise(0).cast("long"),
            "clean_text": F.when(removable, F.array_join("__left", "\n")).otherwise(text),
        },
    )
    untouched = F.col("n_lines_removed") == 0
    rows = put(rows, {"n_words_left": F.when(untouched, F.col("n_words")).otherwise(F.size(words_of(F.col("clean_text")))).cast("long")})
    depleted = (F.col("n_words_left") < limits.min_words) | (F.col("n_words_left") < limits.min_left * F.col("n_words"))
    return put(rows, {"kept": ~F.col("base_failed") & ~depleted}).drop("__host", "__doc", "__frequent", "__left")
