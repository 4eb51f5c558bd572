"""Exact dedup by counting quotient filters.

1. Each input partition builds a counting quotient filter of its texts' 64-bit fingerprints (texts stripped of ASCII
   white space), cut into blocks by the fingerprint's high bits.  Only those blocks are shuffled.
2. The blocks of a range merge by their sorted remainders; a fingerprint that many partitions saw is one counter, so a
   text that fills a third of the corpus weighs no more than any other.
3. Fingerprints counted above one go on.  Their documents, and no others, are routed to the byte verification: a hash
   aggregation whose key is the whole text, combined on the map side, so the copies of a hot text meet as partial rows.
4. Each class keeps the row with the most code points, then the smallest id; all rows get the verdict by a join on the
   SHA-256 of the text.

Plan: five passes over (id, text): a count, the fingerprints, the byte verification, a check for rows that tie, and the
output; one shuffle of filter blocks, one of the candidate texts after partial aggregation.
Ranges grow with the counted rows, so the filter that a task merges does not.  Where verdicts are too large to be
broadcast, the rows of a hot fingerprint or text are dealt to many tasks by their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm import common
from tarnwick.llm import quotient_filter as qf
from tarnwick.llm.common import SPACE_CLASS, bytes_of, cut, dealt, partitions, put, small_or_shuffled, text_of

#: Fingerprints gathered before a partition's filter is compacted, and about how many a range is to have at most.
BUFFER, RANGE_ROWS = 1 << 18, 1 << 22


def stripped(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.regexp_replace(text, SPACE_CLASS + "+", "")


def range_bits_for(rows: int, tasks: int) -> int:
    """Bits that name a range: as many ranges as tasks at least, and more where ranges would be too large."""
    return max(1, (max(tasks, -(-rows // RANGE_ROWS)) - 1).bit_length())


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """Rows (fp, fp_count) for the values counted above one in the single bigint column ``fp`` of so many rows."""
    range_bits = range_bits_for(rows, partitions(fingerprints.sparkSession))
    span_bits = 64 - range_bits

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, counts, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        for batch in batches:
            waiting.append(batch["fp"].to_numpy(np.int64).view(np.uint64))
            if sum(map(len, waiting)) > BUFFER:
                new = np.concatenate(waiting)
                held, counts = qf.counted(np.concatenate([held, new]), np.r_[counts, np.ones(len(new), np.int64)])
                waiting = []
        new = np.concatenate([np.zeros(0, np.uint64), *waiting])
        held, counts = qf.counted(np.concatenate([held, new]), np.r_[counts, np.ones(len(new), np.int64)])
        part = (held >> np.uint64(span_bits)).astype(np.int64)
        for k, at in zip(*np.unique(part, return_index=True)) if len(held) else ():
            to = np.searchsorted(part, k, side="right")
            block = qf.pack(held[at:to], counts[at:to], int(k) << span_bits, span_bits)
            yield pd.DataFrame({"part": [int(k)], "block": [block]})

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        values, counts = qf.merge(list(group["block"]))
        more = counts > 1
        return pd.DataFrame({"fp": values[more].view(np.int64), "fp_count": counts[more]})

    blocks = fingerprints.mapInPandas(build, "part long, block binary")
    return blocks.groupBy("part").applyInPandas(merged, "fp long, fp_count long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row, all input columns plus ``text_sha256, keep_id, group_size, kept``.

    Texts are equal when they agree after deleting ASCII white space.  Of equal texts the row with the most code points
    in the original text stays, then the smallest id (null ids last); among rows that agree in both, one stays.

    Null text counts as empty, and all empty texts are one group.  Very long texts are hashed whole.  An empty table
    gives an empty result.  Input columns named like an output are replaced.
    """
    rows = put(docs, {"__text": text_of(text_col)})
    rows = put(rows, {"__norm": stripped(F.col("__text"))})
    rows = put(rows, {"__fp": F.xxhash64("__norm"), "text_sha256": F.sha2("__norm", 256), "__cp": F.char_length("__text").cast("long")})

    total = docs.count()
    repeated = cut(repeated_fingerprints(rows.select(F.col("__fp").alias("fp")), total)).withColumnsRenamed({"fp": "__fp", "fp_count": "__times"})
    n_bytes = bytes_of(repeated)

    # Byte verification: the key of the aggregation is the whole stripped text.
    best = F.min(F.struct((-F.col("__cp")).alias("cp"), F.col("__id").isNull().alias("no_id"), F.col("__id").alias("id")))
    asked = rows.select("__fp", "__norm", "text_sha256", "__cp", F.col(id_col).alias("__id"))
    if n_bytes <= common.BROADCAST_BYTES:
        asked = asked.join(F.broadcast(repeated.select("__fp")), "__fp", "left_semi")
    else:
        asked = dealt(asked, repeated, ["__fp"], "__times", total, F.xxhash64("__id", "__cp"), "left_semi")
    classes = cut(
        asked.groupBy("__norm", "text_sha256")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("__size"))
        .where("__size > 1")
        .select(F.col("text_sha256").alias("__class"), F.col("best.id").alias("__keep"), (-F.col("best.cp")).alias("__most"), "__size")
    )
    plain = rows.drop("__norm", "__text", "__fp")
    n_bytes = bytes_of(classes)
    if n_bytes <= common.BROADCAST_BYTES:
        joined = plain.join(F.broadcast(classes), F.col("text_sha256") == F.col("__class"), "left")
    else:
        sized = classes.withColumn("__times", F.col("__size"))
        joined = dealt(plain.withColumn("__class", F.col("text_sha256")), sized, ["__class"], "__times", total, F.xxhash64(id_col, "__cp"), "left")
    is_best = F.col("__size").isNull() | ((F.col("__cp") == F.col("__most")) & F.col(id_col).eqNullSafe(F.col("__keep")))
    marked = put(
        joined,
        {
            "text_sha256": F.col("text_sha256"),
            "keep_id": F.when(F.col("__size").isNull(), F.col(id_col)).otherwise(F.col("__keep")),
            "group_size": F.coalesce(F.col("__size"), F.lit(1)).cast("long"),
            "kept": is_best,
        },
    )
    return _one_of_equal_winners(marked, id_col, text_col).drop("__cp", "__class", "__keep", "__most", "__size")


def _one_of_equal_winners(marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows that repeat the winner's id and length would all stay; of such a class the row of the least text stays.

    Where ids are distinct there is no such class, and the check is one small aggregation.
    """
    winners = F.col("kept") & (F.col("group_size") > 1)
    tied = cut(marked.where(winners).groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("text_sha256").alias("__tied")))
    n_bytes = bytes_of(tied)
    if not n_bytes:
        return marked
    out = marked.join(small_or_shuffled(tied, n_bytes), F.col("text_sha256") == F.col("__tied"), "left")
    hit = winners & F.col("__tied").isNotNull()
    # Rows numbered once and cut, so that a class of any size is settled by an aggregation with partial results.
    equal = cut(out.where(hit).withColumn("__at", F.monotonically_increasing_id()))
    best = equal.groupBy("text_sha256").agg(F.min(F.struct(text_of(text_col).alias("text"), "__at"))["__at"].alias("__first"))
    first = equal.join(best.select("__first"), F.col("__at") == F.col("__first"), "left").withColumn("kept", F.col("__first").isNotNull()).drop("__at", "__first")
    return first.unionByName(out.where(~hit)).drop("__tied")
