"""Rules-mode mapping in one call: sources in, copies of a template filled by their sections, tables and headers out, with a report for each."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import conformity, headers, layout, placeholders, rendering, sections, slots
from ..sources import docx, docx_files
from ..sources.staging import staged

MODES = ("string", "embeddings", "auto", "llm")
#: Fixed value: keys of the headers by which a table of revisions is known.
REVISION_TABLE = {"REV", "DATA", "ALTERACAO"}


@dataclass(frozen=True)
class Mapping:
    """files: path, content, error; matches: path, seq, source_name, target_name, score, method; report: a row for each source."""

    files: DataFrame
    matches: DataFrame
    report: DataFrame


def choose(found: DataFrame, targets: list[str], similarity: str = "auto", vectors: DataFrame | None = None, target_vectors: DataFrame | None = None, answers: DataFrame | None = None) -> DataFrame:
    """doc_id, seq, source_name, target_name, score, method of sections (doc_id, seq, name) against a template's headings.

    string: by words; embeddings: by vectors (doc_id, seq, vector) against target_vectors (target_id: place in targets, vector); auto: by words, and document by document by vectors where words
    reach too few headings; llm: by answers (name, target_name, score), and by words where there are none. Without vectors embeddings and auto go by words."""
    if similarity not in MODES:
        raise ValueError(f"unknown similarity: {similarity!r}")
    by_words = sections.match_headings(found, targets)
    if similarity == "string" or similarity == "llm" and answers is None or similarity != "llm" and vectors is None:
        return by_words
    named = found.select("doc_id", "seq", F.col("name").alias("source_name"))
    if similarity == "llm":
        told = answers.where(F.col("target_name").isin(targets)).groupBy(F.col("name").alias("source_name")).agg(F.max(F.struct("score", "target_name")).alias("a"))
        met = named.join(told, "source_name", "left")
        return met.select("doc_id", "seq", "source_name", F.col("a.target_name").alias("target_name"), F.coalesce("a.score", F.lit(0.0)).alias("score"), F.when(F.col("a").isNull(), "miss").otherwise("llm").alias("method"))
    near = sections.match_vectors(vectors.select(F.struct("doc_id", "seq").alias("source_id"), "vector"), target_vectors)
    near = near.select("source_id.doc_id", "source_id.seq", F.get(F.array(*map(F.lit, targets)), F.col("target_id").cast("int")).alias("target_name"), "score")
    by_vectors = named.join(near, ["doc_id", "seq"], "left").select("doc_id", "seq", "source_name", "target_name", F.coalesce("score", F.lit(0.0)).alias("score"),
                                                                    F.when(F.col("target_name").isNull(), "miss").otherwise("embedding").alias("method"))
    return by_vectors if similarity == "embeddings" else sections.choose_matches(by_words, by_vectors, targets)


def map_sections(spark: SparkSession, template: bytes, sources: DataFrame, today: str, similarity: str = "auto", auto_tables: bool = True, records: DataFrame | None = None, **matching) -> Mapping:
    """sources: path, content of Word files. A copy of the template for each, filled by rules; matching goes on to choose.

    Of sections of one name the richest counts. A table of the template with headers for revision, date and change gets the source's history and a last row of today (auto_tables); records
    (path, table_no, seq, rec) fill others. Where tables are filled, prose that they cover is left out. Header fields come from the source's header and history. Sources that can't be read keep
    their row in files and report with the error. The template is one file: it is read once, and sent with the tasks."""
    target = docx.read_blocks(spark.createDataFrame([("template", bytearray(template))], "path string, content binary")).withColumnRenamed("path", "doc_id")
    own = target.where("error IS NULL").collect()  # one file's paragraphs and cells
    if not own:
        raise ValueError("the template can't be read")
    target = spark.createDataFrame(own, target.schema)
    targets = [r["name"] for r in sections.target_sections(target.where("part = 'body' AND kind = 'paragraph'")).orderBy("seq").collect()]
    blocks = staged(docx.read_blocks(sources).withColumnRenamed("path", "doc_id"))
    errors = blocks.where("error IS NOT NULL").select("doc_id", "error").distinct()
    profile = docx_files.profile_source(spark, sources)
    found = staged(sections.dedupe_richest(profile.sections.withColumnRenamed("path", "doc_id")))
    matches = staged(choose(found, targets, similarity, **matching))

    cells = blocks.where("kind = 'cell'").select("doc_id", "table_no", "row", "col", "text")
    docs = sources.select(F.col("path").alias("doc_id")).distinct().join(errors.select("doc_id"), "doc_id", "left_anti")
    items = None if records is None else records.select(F.col("path").alias("doc_id"), "table_no", "seq", "rec")
    heads = {}
    for r in own:
        if r["kind"] == "cell" and r["row"] == 0:
            heads.setdefault(r["table_no"], []).append(r["text"] or "")
    keyed = {t: [r["k"] for r in spark.createDataFrame(list(enumerate(h)), "i int, t string").select("i", headers.table_key(F.col("t")).alias("k")).orderBy("i").collect()] for t, h in heads.items()} if auto_tables else {}
    table = next((t for t in sorted(keyed) if set(keyed[t]) >= REVISION_TABLE), None)
    if table is not None:
        name = {k: heads[table][keyed[table].index(k)] for k in REVISION_TABLE}
        spec = headers.history_spec(headers.history_rows(cells), docs, today)
        rec = F.create_map(F.lit(name["REV"]), "rev", F.lit(name["DATA"]), "date", F.lit(name["ALTERACAO"]), "change")
        history = spec.select("doc_id", F.lit(table).alias("table_no"), F.col("rev").cast("int").alias("seq"), rec.alias("rec"))
        items = history if items is None else items.unionByName(history)
    content = sections.suppress_tabular(sections.content_map(found, matches), items is not None)

    runs = docx.read_runs(sources).withColumnRenamed("path", "doc_id").where("part LIKE 'word/header%'")
    subs = headers.substitutions(headers.header_metadata(runs, cells), today).select("doc_id", F.posexplode("subs").alias("seq", "s"))
    nothing = {"kind": "string", "seq": "int", "key": "string", "value": "string", "table_no": "int", "row": "int", "col": "int", "rec": "map<string,string>"}
    item = lambda df, kind, **given: df.select("doc_id", *[(F.lit(kind) if c == "kind" else given.get(c, F.lit(None))).cast(t).alias(c) for c, t in nothing.items()])
    plan = item(content, "section", seq=F.lit(0), key=F.col("target_name"), value=F.col("content")).unionByName(item(subs, "header", seq=F.col("seq"), key=F.col("s.placeholder"), value=F.col("s.replacement")))
    if items is not None:
        plan = plan.unionByName(item(items, "record", seq=F.col("seq"), table_no=F.col("table_no"), rec=F.col("rec")))
    # the template's blocks for each source, from one literal
    listed = F.from_json(F.lit(json.dumps([r.asDict() for r in own], ensure_ascii=False)), f"array<{target.schema.simpleString()}>")
    each = docs.select("doc_id", F.explode(listed).alias("b")).select("doc_id", *[f"b.{c}" for c in target.columns if c != "doc_id"])
    edits = docx_files.plan_edits(each, staged(plan)).where("step <> 4")  # substitutions stay in headers here
    copies = docs.select(F.col("doc_id").alias("path"), F.lit(bytearray(template)).alias("content"))
    files = staged(docx_files.apply_plans(copies, edits).unionByName(errors.select(F.col("doc_id").alias("path"), F.lit(None).cast("binary").alias("content"), "error")))

    told = rendering.mapping_report(found, matches, list(dict.fromkeys(targets)))
    done = docx.read_blocks(files.where("content IS NOT NULL")).withColumnRenamed("path", "doc_id").where("part = 'body' AND kind = 'paragraph'")
    orphans = placeholders.blank_paragraphs(done.select("doc_id", "idx", F.coalesce("text", F.lit("")).alias("text"))).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("orphan_paragraphs"))
    n_tables = (plan.where("kind = 'record'").groupBy("doc_id").agg(F.count_distinct("table_no").alias("tables_filled")))
    none = F.array().cast("array<string>")
    report = files.select(F.col("path").alias("doc_id"), "error").join(told, "doc_id", "left").join(n_tables, "doc_id", "left").join(orphans, "doc_id", "left")
    report = report.select(F.col("doc_id").alias("path"), *[F.coalesce(c, none).alias(c) for c in ("mapped", "unmapped")], F.coalesce("unfilled", F.array(*map(F.lit, dict.fromkeys(targets))) if targets else none).alias("unfilled"),
                           F.coalesce("tables_filled", F.lit(0)).alias("tables_filled"), F.coalesce("orphan_paragraphs", none).alias("orphan_paragraphs"), "error")
    return Mapping(files, matches.withColumnRenamed("doc_id", "path"), report)


def slot_inventory(blocks: DataFrame) -> DataFrame:
    """All slots of files in one order: doc_id, seq, slot_id, location, kind, fillable, context; the body's paragraphs, then cells, headers and footers.

    blocks as read from files (path as doc_id). Cells with a drawing are data, those with a content control placeholders."""
    good = blocks.where("error IS NULL")
    body = slots.body_slots(good.where("part = 'body' AND kind = 'paragraph'")).select("doc_id", F.lit(0).alias("_p"), F.lit("").alias("_q"), F.col("idx").alias("_a"), F.lit(0).alias("_b"), F.lit(0).alias("_c"), "slot_id", F.lit("body").alias("location"), "kind", "fillable", "context")
    cells = good.where("kind = 'cell' AND NOT vmerge_cont").select("doc_id", "table_no", "row", "col", "text", F.col("drawing").alias("has_drawing"), F.col("control").isNotNull().alias("is_control"))
    tables = slots.cell_slots(cells).select("doc_id", F.lit(1).alias("_p"), F.lit("").alias("_q"), F.col("table_no").alias("_a"), F.col("row").alias("_b"), F.col("col").alias("_c"), "slot_id", F.lit("cell").alias("location"), "kind", "fillable", "context")
    parts = good.where("part <> 'body' AND trim(text) <> ''").withColumn("kind", slots.kind_of(F.col("text")))
    place = F.when(F.col("part").startswith("header"), "header").otherwise("footer")
    named = F.concat(place, F.lit("_para_word_"), "part", F.lit("_p"), F.col("idx").cast("string"))
    rest = parts.select("doc_id", F.when(place == "header", 2).otherwise(3).alias("_p"), F.col("part").alias("_q"), F.col("idx").alias("_a"), F.lit(0).alias("_b"), F.lit(0).alias("_c"), named.alias("slot_id"), place.alias("location"), "kind",
                        slots.fillable(F.col("kind")).alias("fillable"), F.substring(strip(F.col("text")), 1, 120).alias("context"))
    order = Window.partitionBy("doc_id").orderBy("_p", "_q", "_a", "_b", "_c")
    return body.unionByName(tables).unionByName(rest).withColumn("seq", F.row_number().over(order) - 1).select("doc_id", "seq", "slot_id", "location", "kind", "fillable", "context")


def file_fingerprint(blocks: DataFrame) -> DataFrame:
    """blocks as read from files, in the form that conformity.fingerprint counts: doc_id, level, is_list, is_table, cells. A paragraph is a list's by its style's name or its number."""
    good = blocks.where("error IS NULL AND part = 'body'")
    style = F.coalesce("style", F.lit(""))
    level = F.nullif(F.regexp_extract(style, r"(?i)Heading\s*(\d+)", 1), F.lit("")).cast("int")
    text = good.where("kind = 'paragraph'").select("doc_id", level.alias("level"), (F.contains(F.lower(style), F.lit("list")) | F.col("num_id").isNotNull()).alias("is_list"), F.lit(False).alias("is_table"), F.lit(None).cast("long").alias("cells"))
    tables = good.where("kind = 'cell'").groupBy("doc_id", "table_no").agg(F.count(F.lit(1)).alias("cells")).select("doc_id", F.lit(None).cast("int").alias("level"), F.lit(False).alias("is_list"), F.lit(True).alias("is_table"), "cells")
    return text.unionByName(tables)


def visual_dimension(template: DataFrame, candidates: DataFrame) -> DataFrame:
    """Failures of the visual dimension from layout grids (doc_id, page, row, line): the template's one document against every candidate's."""
    def counts(grid: DataFrame) -> DataFrame:
        d = layout.document_features(layout.page_features(grid))
        return d.select("doc_id", F.col("average_density").alias("density"), "headings", "tables", "placeholders")

    one = counts(template).first()
    if one is None:
        raise ValueError("the template has no grid")
    return conformity.visual_failures(one.asDict(), counts(candidates))
