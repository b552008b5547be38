"""Exact de-duplication by progressive refinement: length, then prefix hash, then full hash.

Only DataFrame functions. Every shuffle carries narrow keys; a group of copies that holds a third of
all rows is pre-aggregated before its shuffle, and the joins that put the verdict on the rows have a
staged table of group keys on the other side, so adaptive execution can split a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stage, table, text_of

PREFIX_CHARS = 128


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS,
                hash_all: bool = False) -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z; of each the row with the largest id stays.

    Returns id_col, text_hash, keep_id, group_size, kept, full_hash (bytes of SHA-256). Null text counts as
    empty; empty texts are copies of each other. A row that repeats another's id and text counts
    in group_size, and both rows are kept when theirs is the largest id. A null id loses to any
    other; a group of null ids only has keep_id null and keeps its rows. Other columns, whatever their names, are ignored.

    hash_all=False reads full content only for rows whose (length, prefix hash) another row shares, and
    leaves full_hash null elsewhere. hash_all=True takes full_hash of every row in the one scan, for
    callers that want the digest itself; groups are still refined among survivors only.
    """
    norm = ascii_lower(F.col("_text"))
    src = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    keyed = src.withColumn("_len", F.octet_length("_text")).withColumn(
        "_prefix", F.xxhash64(ascii_lower(F.substring("_text", 1, prefix_chars))))
    # Levels 1 and 2 in one aggregation: the prefix hash is only compared within a length.
    shared = stage(
        keyed.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        .select(F.col("_len").alias("_slen"), F.col("_prefix").alias("_sprefix")), "dedup-survivors")
    digest = F.unhex(F.sha2(norm.cast("binary"), 256))
    rows = keyed.withColumn("_full", digest).drop("_text") if hash_all else keyed
    tagged = rows.join(shared, (F.col("_len") == F.col("_slen")) & (F.col("_prefix") == F.col("_sprefix")), "left")
    survives = F.col("_slen").isNotNull()
    if not hash_all:
        tagged = tagged.withColumn("_full", F.when(survives, digest)).drop("_text")
    tagged = tagged.select("_id", "_hash", "_full", survives.alias("_survives"))
    # Level 3: the full hash, of survivors only.
    groups = stage(
        tagged.where("_survives").groupBy(F.col("_full").alias("_gfull"))
        .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "dedup-groups")
    out = tagged.join(groups, F.col("_full") == F.col("_gfull"), "left")
    alone = F.col("_gfull").isNull()
    return out.select(
        F.col("_id").alias(id_col), F.col("_hash").alias("text_hash"),
        F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("_full").alias("full_hash"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"), hash_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("full_hash")).alias("text_sha256"))


QUERIES = {"op8_exact_dedup": op8_exact_dedup}
ORACLES = {"op8_exact_dedup": """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t"""}
