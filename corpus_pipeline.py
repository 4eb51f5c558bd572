"""From raw documents to encoded training documents, in five stages.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes what it returns as Parquet in the shared folder and
reads it again as the next one's documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm import bpe_chunks, common, dart_minhash, exact_dedup, line_frequency, mixing
from tarnwick.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines above their host's limit go; so do documents that fail a base rule or are depleted by that.

    Null and empty texts have no words, fail a base rule and go.  A null source is a host of its own.  Texts are read
    whole at any length.  Rows that repeat id and text get the same verdict, and equal texts count once for a line.  An
    empty table gives an empty one.  Only the columns of documents are read; others, whatever their names, are dropped.
    """
    ruled = line_frequency.quality_rules(docs.select(*COLUMNS)).where("kept")
    return ruled.withColumn("text", F.col("clean_text")).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one document stays: the longest, then the one of the least id.

    Null, empty and blank texts are one group, a null id comes last among equals, and of rows that repeat id and text
    one stays.  Texts are compared whole at any length.  An empty table gives an empty one.  Only the columns of
    documents are read; others, whatever their names, are dropped.
    """
    ship(spark)
    return exact_dedup.exact_dedup(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays.

    Null, empty and blank texts are in no class and stay.  A null id comes last in its class.  Rows that repeat id and
    text are one document and stay or go together; of texts that share the least id the one of the least hash stays.
    Texts are compared whole at any length.  An empty table gives an empty one.  Only the columns of documents are
    read; others, whatever their names, are dropped.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    gone = common.cut(dart_minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct())
    keyed = docs.withColumn("text_key", F.xxhash64(common.text_of("text")))
    same = (F.col("text_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return keyed.join(common.small_or_shuffled(gone, common.bytes_of(gone)), same, "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target mixture, in a global random order.

    A null source is a source of its own.  Null and empty texts weigh one byte and are replicated like others.  Null
    ids draw as one id, and rows that repeat an id draw the same count.  Texts stay whole at any length.  An empty table
    gives an empty one.  Only the columns of documents are read; others, whatever their names, are dropped.
    """
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document of the mixture, with digests of ids and decoded text.

    Null and empty texts have no ids.  Texts are encoded whole at any length; rows that repeat id or text get equal
    results, null ids and sources stay null.  An empty table gives an empty one.  Only id, text and source are read;
    other columns, whatever their names, are dropped.
    """
    ship(spark)
    coded = bpe_chunks.encode_and_decode(docs.select("doc_id", "text", "source"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "source", "ids", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Weighted hashing of shingles and the encoder are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
