"""Automatic paragraph numbering by windows: counters that restart under their parents, and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def letters(n: Column) -> Column:
    """1 as a, 26 as z, 27 as aa and so on."""
    start = F.struct(n.cast("long").alias("n"), F.lit("").alias("s"))
    step = lambda a, _: F.when(a["n"] <= 0, a).otherwise(F.struct(F.floor((a["n"] - 1) / 26).cast("long").alias("n"), F.concat(F.char(F.lit(97) + (a["n"] - 1) % 26), a["s"]).alias("s")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda a: a["s"])  # 26 to the 14th is beyond any long


def roman(n: Column) -> Column:
    place = lambda unit, one, five, ten: F.get(F.array(*map(F.lit, ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten])), (F.floor(n / unit) % 10).cast("int"))
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), place(100, "C", "D", "M"), place(10, "X", "L", "C"), place(1, "I", "V", "X"))


def format_count(n: Column, fmt: Column) -> Column:
    n = F.greatest(n, F.lit(1))
    return F.when(fmt == "lowerLetter", letters(n)).when(fmt == "upperLetter", F.upper(letters(n))).when(fmt == "lowerRoman", F.lower(roman(n))).when(fmt == "upperRoman", roman(n)).otherwise(n.cast("string"))


def numbering_levels(nums: DataFrame, abstracts: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """doc_id, num_id, ilvl, num_fmt, lvl_text, start: what the lists of each document come to.

    nums: doc_id, num_id, abstract_id, of which the greatest counts where a list points twice; abstracts: doc_id, abstract_id, ilvl, num_fmt, lvl_text, start; overrides: doc_id,
    num_id, ilvl and what a list changes, null where it keeps. A list that points nowhere has no levels but those it brings itself. Formats default to decimal, texts to nothing,
    starts to 1."""
    what = ["num_fmt", "lvl_text", "start"]
    lists = nums.groupBy("doc_id", "num_id").agg(F.max("abstract_id").alias("abstract_id"))
    made = lists.join(abstracts, ["doc_id", "abstract_id"]).select("doc_id", "num_id", "ilvl", *what)
    if overrides is not None:
        own = overrides.join(lists.select("doc_id", "num_id"), ["doc_id", "num_id"], "left_semi").groupBy("doc_id", "num_id", "ilvl").agg(*[F.max(c).alias(f"_{c}") for c in what])
        made = made.join(own, ["doc_id", "num_id", "ilvl"], "full").select("doc_id", "num_id", "ilvl", *[F.coalesce(f"_{c}", c).alias(c) for c in what])
    return made.select("doc_id", "num_id", "ilvl", F.coalesce("num_fmt", F.lit("decimal")).alias("num_fmt"), F.coalesce("lvl_text", F.lit("")).alias("lvl_text"), F.coalesce("start", F.lit(1)).alias("start"))


def numbering_markers(blocks: DataFrame, levels: DataFrame, depth: int = 3, bullet_letters: bool = False) -> DataFrame:
    """blocks: doc_id, idx, num_id, ilvl; levels: num_id, ilvl, num_fmt, lvl_text, start, and doc_id where each document has a style sheet of its own. doc_id, idx, marker of numbered paragraphs.

    A level counts within the stretch since a higher level of its list last counted; a bullet level also since a paragraph of another format. Levels below
    the paragraph's don't show. With bullet_letters, bullets of the first level count as a., b. and so on. Windows are one over the document and one over its lists, on narrow rows; a style sheet
    for all documents is broadcast. A stretch's count is the running count less what it was where the stretch began."""
    own = ["doc_id"] if "doc_id" in levels.columns else []
    listed = F.map_from_entries(F.collect_list(F.struct("ilvl", F.struct(F.col("num_fmt").alias("f"), F.col("lvl_text").alias("t"), F.col("start").alias("s")))))
    sheet = levels.groupBy(*own, "num_id").agg(listed.alias("_levels"))
    sheet = sheet if own else F.broadcast(sheet)
    info = lambda level: F.element_at("_levels", level)
    bullet = lambda level: F.coalesce(info(level)["f"] == "bullet", F.lit(False))
    rows = blocks.where("num_id IS NOT NULL").select("doc_id", "idx", "num_id", F.coalesce("ilvl", F.lit(0)).alias("ilvl")).join(sheet, [*own, "num_id"]).where(F.element_at("_levels", F.col("ilvl")).isNotNull())
    rows = rows.select("doc_id", "idx", "num_id", "ilvl", (info(F.col("ilvl"))["f"] != "bullet").alias("_no"), *[bullet(F.lit(n)).alias(f"_u{n}") for n in range(depth)])
    document = Window.partitionBy("doc_id").orderBy("idx")
    rows = rows.withColumn("_broken", F.coalesce(F.count_if("_no").over(document.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_no")
    this = Window.partitionBy("doc_id", "num_id").orderBy("idx")
    rows = rows.withColumns({f"_n{n}": F.count_if(F.col("ilvl") == n).over(this) for n in range(depth)} | {f"_s{n}": F.struct(F.count_if(F.col("ilvl") < n).over(this).alias("g"), F.when(F.col(f"_u{n}"), F.col("_broken")).otherwise(0).alias("b")) for n in range(depth)})
    begins = {f"_at{n}": F.when(~F.coalesce(F.lag(f"_s{n}").over(this) == F.col(f"_s{n}"), F.lit(False)), F.col(f"_n{n}") - (F.col("ilvl") == n).cast("int")) for n in range(depth)}
    rows = rows.withColumns(begins).withColumns({f"_c{n}": F.col(f"_n{n}") - F.max(f"_at{n}").over(this) for n in range(depth)})
    rows = rows.select("doc_id", "idx", "num_id", "ilvl", *[f"_c{n}" for n in range(depth)]).join(sheet, [*own, "num_id"])
    plain = info(F.col("ilvl"))["f"] == "bullet"
    marker = F.when(plain, F.lit("•")).otherwise(info(F.col("ilvl"))["t"])
    for level in range(depth):
        start = F.coalesce(info(F.lit(level))["s"], F.lit(1))
        count = F.when(F.col(f"_c{level}") > 0, F.col(f"_c{level}") + start - 1).otherwise(start)
        marker = F.replace(marker, F.lit(f"%{level + 1}"), format_count(count, F.coalesce(info(F.lit(level))["f"], F.lit("decimal"))))
    if bullet_letters:
        first = F.greatest(F.col("_c0") + F.coalesce(info(F.lit(0))["s"], F.lit(1)) - 1, F.lit(1))
        marker = F.when(plain & (F.col("ilvl") == 0), F.concat(letters(first), F.lit("."))).otherwise(marker)
    return rows.select("doc_id", "idx", marker.alias("marker"))
