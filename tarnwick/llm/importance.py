"""Quality selection by importance resampling (Xie et al., *Data Selection for Language Models via Importance
Resampling*, 2023).

Texts are bags of hashed one- and two-grams (words and runs of punctuation) in a fixed number of buckets.  Two generative
models are fitted: bucket frequencies of the target (texts labelled good) and of the raw corpus.  A text's weight is the
ratio of its probabilities under the two, and the k texts of the largest log weight plus Gumbel noise are kept, which
samples k without replacement in proportion to the weights.  The noise is hashed from the id, so recomputation agrees.

Plan: one pass to count buckets (partial sums per partition, then one row per bucket), one to score; the k-th largest key
is found by narrowing a histogram, of which the driver sees a fixed number of counts.  Raw counts are over all texts.
The target model may be fitted on a bounded number of labelled rows (``most_labelled``, those of least hashed id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import cut, put, text_of, unit_hash
from tarnwick.llm.shingles import _BASE, _INVERSE, mix, powers

BUCKETS = 10_000
BINS = 4096


def token_hashes(text: str) -> np.ndarray:
    """One hash for each token: a run of letters and digits (all bytes above ASCII count as such) or one of other signs."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    word = (data >= 128) | ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122))
    kind = np.r_[np.int8(0), np.where(white, 0, np.where(word, 1, 2)).astype(np.int8), np.int8(0)]
    turns = kind[1:] != kind[:-1]
    start = np.flatnonzero(turns[:-1] & (kind[1:-1] > 0))
    end = np.flatnonzero(turns & (kind[:-1] > 0))
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), dtype=np.uint64)]
        return mix((sums[end] - sums[start]) * powers(_INVERSE, len(data))[start] + (end - start).astype(np.uint64))


def buckets_of(text: str, buckets: int = BUCKETS) -> np.ndarray:
    tokens = token_hashes(text)
    with np.errstate(over="ignore"):
        pairs = mix(tokens[:-1] * np.uint64(0xD6E8FEB86659FD93) + tokens[1:])
    return (np.r_[mix(tokens + np.uint64(7)), pairs] % np.uint64(buckets)).astype(np.int64)


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, good: str, most_labelled: int, buckets: int) -> tuple[np.ndarray, float]:
    """Log of target over raw frequency for each bucket, with one added to each count; and the share of good labels."""
    drawn = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.coalesce(F.expr(good), F.lit(False)).alias("__good")).distinct()
    drawn = cut(drawn.orderBy(F.xxhash64("__id"), "__id").limit(most_labelled))
    n, n_good = drawn.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("__good").cast("long")), F.lit(0))).first()
    target = drawn.where("__good").select("__id").distinct()  # at most ``most_labelled`` ids
    flagged = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("text")).join(F.broadcast(target.withColumn("t", F.lit(1))), "__id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, flag in zip(batch.column("text"), batch.column("t").to_pylist()):
                found = np.bincount(buckets_of(text.as_py(), buckets), minlength=buckets)
                sums[0] += found
                if flag:
                    sums[1] += found
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_pydict({"bucket": some, "raw": sums[0][some], "target": sums[1][some]})

    counts = flagged.select("text", "t").mapInArrow(count, "bucket long, raw long, target long")
    table: pd.DataFrame = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # a row per bucket
    raw, good_counts = np.ones(buckets), np.ones(buckets)
    raw[table["bucket"]] += table["raw"]
    good_counts[table["bucket"]] += table["target"]
    return np.log(good_counts / good_counts.sum()) - np.log(raw / raw.sum()), (n_good / n if n else 1.0)


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a double column, exactly: a histogram is narrowed until one value is left."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0:
        return None
    if k >= n:
        return low
    left = k
    while low < high:
        width = (high - low) / BINS
        if width == 0 or low + width == low or high - width == high:
            values = keys.where(F.col(column).between(low, high)).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc(column)).limit(BINS).collect()
            for value, count in values:  # neighbouring doubles: at most BINS distinct values
                if left <= count:
                    return value
                left -= count
            return low
        bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1)).cast("int")
        found = keys.where(F.col(column).between(low, high)).groupBy(bin_.alias("b"))
        for row in found.agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("b")).collect():
            if left <= row["n"]:
                low, high = row["low"], row["high"]
                break
            left -= row["n"]
    return low


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    good: str = "quality = 1",
    keep: float | None = None,
    seed: str = "gumbel",
    most_labelled: int = 50_000,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row for each input row: the id, ``log_weight``, ``gumbel_key`` and ``kept``.

    ``keep`` is the share of rows to keep; without it, the share of good ones among the labels.  ``kept`` holds for the
    k rows of the largest keys; rows that tie with the k-th are kept as well.

    Null and empty texts have weight 1 (log 0).  Rows with a null id take part and draw as one id; rows that repeat an
    id draw equal noise.  Without labels the target model is flat and all rows are kept.  Texts of any length are
    counted whole.  An empty table gives an empty result.  Of both tables only the columns named are read; others,
    whatever their names, are dropped.
    """
    ratios, share = log_ratios(docs, labels, id_col, text_col, good, most_labelled, buckets)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([round(float(ratios[buckets_of(t.as_py(), buckets)].sum()), 6) for t in batch], pa.float64())

    scored = docs.select(F.col(id_col), score(text_of(text_col)).alias("log_weight"))
    noise = -F.ln(-F.ln((unit_hash(F.lit(seed), F.col(id_col)) * F.lit(float(1 << 52)) + 0.5) / F.lit(float(1 << 52))))
    scored = cut(put(scored, {"log_weight": F.col("log_weight"), "gumbel_key": F.round(F.col("log_weight") + noise, 9)}))
    k = round(scored.count() * (share if keep is None else keep))
    least = kth_largest(scored, "gumbel_key", k)
    return put(scored, {"kept": F.lit(False) if least is None else F.col("gumbel_key") >= F.lit(least)})
