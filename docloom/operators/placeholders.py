"""Template placeholders: what fields a template asks for, and tokens that survived rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: Placeholder syntaxes in order of priority, and how much context is kept.
KINDS = (("mustache", r"\{\{\s*([A-Z_][A-Z0-9_]*)\s*\}\}"), ("chevron", r"<<\s*([A-Z_][A-Z0-9_]*)\s*>>"), ("named_blank", r"__([A-Z][A-Z0-9_]*)__"),
         ("brace", r"\{\s*([A-Z_][A-Z0-9_]*)\s*\}"), ("bracket", r"\[\s*([A-Z_][A-Z0-9_]*)\s*\]"), ("anon_blank", r"_{3,}"))
CONTEXT = 80
ORPHAN = (r"\{\{\s*[A-Za-z_][A-Za-z0-9_.\-]*\s*\}\}|<<\s*[A-Za-z_][A-Za-z0-9_.\-]*\s*>>|__[A-Za-z][A-Za-z0-9_.\-]*__"
          r"|\{\s*[A-Za-z_][A-Za-z0-9_.\-]*\s*\}|\[\s*[A-Za-z_][A-Za-z0-9_.\-]*\s*\]|_{3,}")
ANY = "|".join(p.replace("([A-Z", "(?:[A-Z").replace("_]*)", "_]*)") for _, p in KINDS)


def placeholder_scan(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. One row for each (document, kind, name): token, start (from 0), context_before, context_after, field_no.

    One pass from left to right over all syntaxes, so an inner syntax is never seen within an outer one. Blanks are named BLANK_1, BLANK_2, ... in
    each document; of equal (kind, name) the first counts. field_no goes by kind, then position. Tokens that touch, such as ____NAME__, are read from the left."""
    gaps, found = F.split("text", ANY, -1), F.regexp_extract_all("text", F.lit(ANY), 0)
    rows = docs.select("doc_id", "text", gaps.alias("_gaps"), found.alias("_found")).select("doc_id", "text", "_gaps", "_found", F.posexplode("_found").alias("_i", "token"))
    before = lambda c, n: F.aggregate(F.slice(c, F.lit(1), n), F.lit(0), lambda a, x: a + F.char_length(x))
    rows = rows.withColumn("start", before(F.col("_gaps"), F.col("_i") + 1) + before(F.col("_found"), F.col("_i")))
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, pattern in reversed(KINDS):
        whole = F.col("token").rlike(f"^(?:{pattern})$")
        kind = F.when(whole, label).otherwise(kind)
        name = F.when(whole, F.regexp_extract("token", pattern, 1) if label != "anon_blank" else F.lit(None).cast("string")).otherwise(name)
    rows = rows.withColumn("kind", kind).withColumn("_name", name)
    here = Window.partitionBy("doc_id")
    blank = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("start"))
    rows = rows.withColumn("name", F.when(F.col("kind") == "anon_blank", F.concat(F.lit("BLANK_"), blank)).otherwise(F.col("_name")))
    rows = rows.withColumn("_first", F.row_number().over(Window.partitionBy("doc_id", "kind", "name").orderBy("start"))).where("_first = 1")
    rank = F.lit(len(KINDS))
    for i, (label, _) in enumerate(KINDS):
        rank = F.when(F.col("kind") == label, i).otherwise(rank)
    end = F.col("start") + F.char_length("token")
    from_ = F.greatest(F.lit(0), F.col("start") - CONTEXT)
    return rows.select("doc_id", F.row_number().over(here.orderBy(rank, "start")).alias("field_no"), "kind", "name", "token", "start",
                       F.regexp_replace(F.substring(F.col("text"), from_ + 1, F.col("start") - from_), r"(?U)\s+$", "").alias("context_before"),
                       F.regexp_replace(F.substring(F.col("text"), end + 1, F.lit(CONTEXT)), r"(?U)^\s+", "").alias("context_after"))


def orphan_tokens(text: Column) -> Column:
    """All tokens of any placeholder syntax, names in either case."""
    return F.regexp_extract_all(text, F.lit(ORPHAN), 0)


def orphan_summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_orphans and a note with the first five distinct tokens, sorted; documents that have any."""
    rows = docs.select("doc_id", orphan_tokens(F.col("text")).alias("_t")).where(F.size("_t") > 0)
    return rows.select("doc_id", F.size("_t").cast("long").alias("n_orphans"), F.array_join(F.slice(F.array_sort(F.array_distinct("_t")), 1, 5), ", ").alias("tokens"))


def blank_paragraphs(blocks: DataFrame) -> DataFrame:
    """blocks: doc_id, idx, text. Those whose text still holds a placeholder."""
    return blocks.where(strip(F.col("text")).rlike(r"\{\{[^}]+\}\}|\[[A-Z_]+\]|_{3,}"))
