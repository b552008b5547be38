"""Corpus preparation: quality rules, exact and near de-duplication, mixing to target weights, subword encoding.

Each stage works on all rows that its predecessor kept, and all but the last return the columns of documents. Rows
that a stage rejects are taken away by an anti-join on (doc_id, hash of the text). The list of rejects is narrow and
staged; where it is too long to be broadcast, a bitmap of it is, and only the texts that it marks are shuffled to the list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import stage, text_of
from docloom.llm.exact_dedup import exact_dedup
from docloom.llm.mixing import mix
from docloom.llm.near_dedup import near_duplicates
from docloom.llm.quality import quality_rules
from docloom.llm.sentencepiece import encode

#: Near duplicates share at least so many per cent of their 5-word shingles.
SIMILAR_PERCENT = 80
#: Rejects that are surely broadcast. Bits of the bitmap for each of more, and at most (16 MB).
FEW, BITS, MOST_BITS = 4096, 32, 1 << 27


def _bitmap_sides(docs: DataFrame, rejects: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """docs that rejects (_rid, _rhash) can't hold, told by a broadcast bitmap of their hashes, and all others.

    The bitmap has BITS bits for each of the count rejects, MOST_BITS at most: then fewer rows are told by it."""
    size = min(MOST_BITS, 1 << (max(1, count) * BITS - 1).bit_length())
    place = lambda *key: F.expr("bigint(1)") + F.pmod(F.xxhash64(*key), F.lit(size))
    marks = rejects.select(place("_rid", "_rhash").alias("_at"))
    marks = marks.groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    at = place(F.col("doc_id").cast(rejects.schema["_rid"].dataType), F.xxhash64(text_of()))
    met = docs.withColumn("_at", at).join(F.broadcast(marks), F.bitmap_bucket_number("_at") == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.bitmap_bit_position("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, int(bitmap_bit_position(_at) % 8))")) != 0, F.lit(False))
    return tuple(met.where(side).select(*docs.columns) for side in (~marked, marked))


def _without_rejects(docs: DataFrame, verdicts: DataFrame, name: str) -> DataFrame:
    """docs without the rows that verdicts (doc_id, text_hash, kept) reject."""
    rejects = stage(verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("_rid"), F.col("text_hash").alias("_rhash")).distinct(), name)
    without = lambda rows: rows.join(rejects, rows["doc_id"].eqNullSafe(rejects["_rid"]) & (F.xxhash64(text_of()) == rejects["_rhash"]), "left_anti")
    count = rejects.count()
    if count <= FEW:
        return without(docs)
    clear, marked = _bitmap_sides(docs, rejects, count)
    return clear.unionByName(without(marked))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers for their language and source."""
    return _without_rejects(docs, quality_rules(docs), "rejects-quality")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return _without_rejects(docs, exact_dedup(docs), "rejects-exact")


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return _without_rejects(docs, near_duplicates(docs, percent=SIMILAR_PERCENT), "rejects-near")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them; one cut to meet its source's target has its text and n_chars cut."""
    return mix(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each drawn document with the ids of its whole text, and whether decoding them gives the text back."""
    return encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "n_bytes", "round_trip", "ids")


STAGES = [("quality rules", quality), ("exact dedup", exact_duplicates), ("near dedup", near_duplicate_groups), ("mixing", mixing), ("sentencepiece", encoding)]
#: Robust estimates, signatures and the lattice are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = step(spark, docs, sf_dir)
    return docs
