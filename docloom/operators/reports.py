"""What goes in and out around a mapping: answers as JSON, cached plans, checklists, reports, and tables filled from records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .headers import table_key
from .slots import cell_fillable

#: Characters that answers must not hold, and texts that no correction may bring in.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
CHECKLIST_LINES = 80
CURRENT_CHARS = 140
KEY_CHARS = 16


def cleaned(text: Column) -> Column:
    """Without control characters and white space at the ends."""
    return strip(F.regexp_replace(text, CONTROL, ""))


def parse_records(answers: DataFrame, columns: list[tuple[str, bool]]) -> DataFrame:
    """answers: doc_id, response (JSON). doc_id, record_no, rec (map): the records that name all required columns, with the schema's columns only; others are null."""
    listed = F.from_json("response", "records array<string>")["records"]
    rows = answers.select("doc_id", F.posexplode(listed).alias("_at", "_r")).withColumn("_m", F.from_json("_r", "map<string,string>")).where("_m IS NOT NULL")
    needed = [c for c, r in columns if r]
    if needed:
        rows = rows.where(F.size(F.array_except(F.array(*map(F.lit, needed)), F.map_keys("_m"))) == 0)
    whole = F.create_map(*[x for c, _ in columns for x in (F.lit(c), F.try_element_at("_m", F.lit(c)))])
    return rows.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("_at")) - 1).alias("record_no"), whole.alias("rec"))


def parse_corrections(answers: DataFrame, banned: str | None = None) -> DataFrame:
    """answers: doc_id, response (JSON). doc_id, slot_id, new_text: the last correction of each slot that has text, none that matches banned."""
    listed = F.from_json("response", "corrections array<struct<slot_id:string,new_text:string>>")["corrections"]
    rows = answers.select("doc_id", F.posexplode(listed).alias("_at", "_c")).select("doc_id", "_at", "_c.slot_id", cleaned(F.col("_c.new_text")).alias("new_text"))
    rows = rows.where("slot_id IS NOT NULL AND new_text <> ''")
    if banned:
        rows = rows.where(~F.col("new_text").rlike(banned))
    return rows.groupBy("doc_id", "slot_id").agg(F.max_by("new_text", "_at").alias("new_text"))


def cell_checklist(cells: DataFrame, lines: int = CHECKLIST_LINES) -> DataFrame:
    """Fillable cells of each document, one line for the cells of a row with one text, `lines` at most: doc_id, line_no, table_no, row, first_col, last_col, current."""
    t = strip(F.coalesce("text", F.lit("")))
    rows = cells.where(cell_fillable(F.col("text"))).groupBy("doc_id", "table_no", "row", t.alias("_t")).agg(F.min("col").alias("first_col"), F.max("col").alias("last_col"))
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("table_no", "row", "first_col")) - 1
    rows = rows.withColumn("line_no", no).where(F.col("line_no") < lines)
    return rows.select("doc_id", "line_no", "table_no", "row", "first_col", "last_col", F.substring(F.replace("_t", F.lit("\n"), F.lit(" ")), 1, CURRENT_CHARS).alias("current"))


def drop_covered(fills: DataFrame, covered: DataFrame) -> DataFrame:
    """fills without the slots that a table schema fills."""
    return fills.join(covered.select("doc_id", "slot_id").distinct(), ["doc_id", "slot_id"], "left_anti")


def output_name(path: Column) -> Column:
    """The source's name with its suffix in it, so that a.docx and a.pdf don't meet."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)
    suffix = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"\.([^.]+)$", 1)).otherwise("")
    return F.concat(stem, F.lit("."), suffix, F.lit(".normalized.docx"))


def cache_key(template: Column, source: Column, version: str) -> Column:
    """Name of a plan in the cache: the beginnings of both hashes, and the version of the prompt."""
    return F.concat_ws("_", F.substring(F.sha2(template, 256), 1, KEY_CHARS), F.substring(F.sha2(source, 256), 1, KEY_CHARS), F.lit(version))


def load_plans(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """wanted: doc_id, key; cache: key, plan, saved_at. Plans that are cached (the latest of each key), and the documents that miss."""
    last = cache.groupBy("key").agg(F.max(F.struct("saved_at", "plan"))["plan"].alias("plan"))
    return wanted.join(last, "key").select("doc_id", "key", "plan"), wanted.join(last, "key", "left_anti")


_CACHE = "key string, plan string, saved_at timestamp"


def _move(spark: SparkSession, source: str, target: str) -> None:
    """One atomic rename, which fails where the target exists."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(target).toUri(), spark._jsc.hadoopConfiguration())
    files.mkdir(path(target).getParent(), getattr(jvm.org.apache.hadoop.fs.permission, "FsPermission").getDirDefault(), True)
    files.rename(path(source), path(target), spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))


def _listed(spark: SparkSession, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/commits")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def save_plans(plans: DataFrame, path: str, commit: str | None = None) -> bool:
    """Put plans (key, plan) into a cache with the time, all or none: they are written aside and moved in by one rename. False where the commit of that name is in already, so that a
    retry after a lost driver changes nothing. What a writer that died has left aside is never read."""
    spark = plans.sparkSession
    commit, aside = commit or uuid.uuid4().hex, f"{path.rstrip('/')}/aside/{uuid.uuid4().hex}"
    target = f"{path.rstrip('/')}/commits/{commit}"
    if any(p.endswith(f"/{commit}") for p in _listed(spark, path)):
        return False
    plans.select("key", "plan", F.current_timestamp().alias("saved_at")).write.parquet(aside)
    try:
        _move(spark, aside, target)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):  # another writer of the same commit was faster
            return False
        raise
    return True


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """key, plan, saved_at of all commits; an empty cache has no rows."""
    found = _listed(spark, path)
    return spark.read.schema(_CACHE).parquet(*found) if found else spark.createDataFrame([], _CACHE)


def compact_plans(spark: SparkSession, path: str) -> None:
    """The latest plan of each key as one commit in place of those there are now. Readers find the old ones, both or the new one, which come to the same."""
    old = _listed(spark, path)
    if not old:
        return
    last = spark.read.schema(_CACHE).parquet(*old).groupBy("key").agg(F.max(F.struct("saved_at", "plan")).alias("l")).select("key", "l.plan", "l.saved_at")
    aside = f"{path.rstrip('/')}/aside/{uuid.uuid4().hex}"
    last.write.parquet(aside)
    _move(spark, aside, f"{path.rstrip('/')}/commits/{uuid.uuid4().hex}")
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for p in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(p), True)


def item_reports(mapping: DataFrame, tiers: DataFrame) -> DataFrame:
    """doc_id, report: a JSON object for each document with its tier, summary and mapping, fields in order of their names."""
    field = F.struct("field", F.struct(F.coalesce("value", F.lit("")).alias("value"), "source", "confidence").alias("m"))
    by = mapping.groupBy("doc_id").agg(F.array_sort(F.collect_list(field)).alias("_f"), F.count(F.lit(1)).alias("total"), F.round(F.avg("confidence"), 3).alias("average_confidence"))
    whole = F.struct("tier", F.struct("total", "average_confidence").alias("mapping_summary"), F.map_from_entries("_f").alias("mapping"))
    return by.join(tiers, "doc_id").select("doc_id", F.to_json(whole).alias("report"))


def merge_hints(hints: DataFrame) -> DataFrame:
    """hints: doc_id, page, row_start, row_end, columns. Those that overlap or touch as one, with the most columns."""
    order = Window.partitionBy("doc_id", "page").orderBy("row_start", "row_end")
    reach = F.max("row_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = hints.withColumn("_new", F.when(F.col("row_start") <= reach + 1, 0).otherwise(1))
    rows = rows.withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "page", "_g").agg(F.min("row_start").alias("row_start"), F.max("row_end").alias("row_end"), F.max("columns").alias("columns")).drop("_g")


def width_ratio(line: Column, light: str = " ") -> Column:
    """From the first to the last character that isn't light, as a share of the line."""
    inner = F.regexp_replace(line, f"^[{light}]+|[{light}]+$", "")
    return F.when(F.char_length(line) == 0, 0.0).otherwise(F.char_length(inner) / F.char_length(line))


def fill_tables(cells: DataFrame, records: DataFrame) -> DataFrame:
    """Blank rows of tables filled from records, then new rows: doc_id, table_no, row, col, text.

    records: doc_id, table_no, record_no, rec (map from header to text). Values go under their headers, by the second row's where the first repeats one; a table's
    blank rows after the first are filled in order, other records are appended. Texts that a record lacks are empty; of headers with
    one key the record's last counts."""
    from .rendering import header_order

    heads = header_order(cells).select("doc_id", "table_no", "col", "header")
    rows = cells.groupBy("doc_id", "table_no", "row").agg(F.bool_and(strip(F.coalesce("text", F.lit(""))) == "").alias("_blank"))
    last = rows.groupBy("doc_id", "table_no").agg(F.max("row").alias("_last"))
    free = rows.where("_blank AND row > 0").withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "table_no").orderBy("row")) - 1).select("doc_id", "table_no", "_n", F.col("row").alias("_free"))
    numbered = records.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "table_no").orderBy("record_no")) - 1)
    placed = numbered.join(free, ["doc_id", "table_no", "_n"], "left").join(last, ["doc_id", "table_no"])
    appended = F.row_number().over(Window.partitionBy("doc_id", "table_no", F.col("_free").isNull()).orderBy("_n"))
    placed = placed.withColumn("row", F.coalesce("_free", (F.col("_last") + appended).cast("int")))
    values = placed.select("doc_id", "table_no", "row", F.posexplode("rec").alias("_i", "_h", "_v")).select("doc_id", "table_no", "row", table_key(F.col("_h")).alias("header"), "_i", "_v")
    values = values.groupBy("doc_id", "table_no", "row", "header").agg(F.max_by("_v", "_i").alias("_v"))
    made = placed.select("doc_id", "table_no", "row").join(heads, ["doc_id", "table_no"]).join(values, ["doc_id", "table_no", "row", "header"], "left")
    made = made.select("doc_id", "table_no", "row", "col", F.coalesce("_v", F.lit("")).alias("text"))
    kept = cells.join(made.select("doc_id", "table_no", "row").distinct(), ["doc_id", "table_no", "row"], "left_anti").select("doc_id", "table_no", "row", "col", "text")
    return kept.unionByName(made)


def fill_by_specs(cells: DataFrame, specs: DataFrame) -> DataFrame:
    """Tables filled by specs: doc_id, table_no, row, col, text, all cells and the new ones.

    specs: spec_no, headers, records (array of maps from header to text), those of a template. Each table takes the first spec whose headers it all has, by
    their keys, also those of a second row under repeated headers; each spec goes to one table of a document, the first. Tables without a spec, and those whose
    spec has no records, stay as they are; a spec without headers goes nowhere. Of repeated headers of a record the last counts."""
    from .rendering import header_order
    from .tables import pair_specs

    first = cells.where("row = 0").select("doc_id", "table_no", table_key(F.coalesce("text", F.lit(""))).alias("header"))
    headed = first.unionByName(header_order(cells).select("doc_id", "table_no", "header")).groupBy("doc_id", "table_no").agg(F.collect_set("header").alias("headers"))
    keyed = specs.where("size(headers) > 0").select("spec_no", F.transform("headers", table_key).alias("headers"))
    records = specs.select(F.col("spec_no").alias("_s"), F.posexplode("records").alias("record_no", "rec"))
    paired = pair_specs(headed, keyed).join(records, F.col("spec_no") == F.col("_s")).select("doc_id", "table_no", "record_no", "rec")
    return fill_tables(cells, paired)


def prune_empties(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """blocks without the blank paragraphs between an anchor (doc_id, idx: what was filled last in a section) and the next text."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    rows = blocks.join(anchors.select("doc_id", "idx", F.lit(True).alias("_anchor")).distinct(), ["doc_id", "idx"], "left")
    text = strip(F.coalesce("text", F.lit(""))) != ""
    # the last anchor or text so far: blank ones behind an anchor go
    mark = F.last(F.when(F.col("_anchor"), "anchor").when(text, "text"), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_m", mark).where(text | F.coalesce(F.col("_anchor"), F.lit(False)) | (F.coalesce("_m", F.lit("text")) == "text")).select(*blocks.columns)
