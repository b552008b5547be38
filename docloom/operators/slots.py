"""What of a template is to be filled: kinds of paragraphs and cells, placeholders, empty tables.

blocks: doc_id, idx, text. cells: doc_id, table_no, row, col, text. runs: doc_id, part, run_no, paragraph, text. All neighbourhood rules are windows over a document
or a row, so a shuffle by document is all that they take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: Java reads classes and cases as Unicode with this flag only.
UNICODE = "(?U)"
#: Patterns by which templates mark what is to be filled in.
CAPS = "A-ZÁÉÍÓÚÂÊÔÃÕÇ"
MARKED = rf"\{{\{{[^}}]+\}}\}}|\[[A-Za-zÀ-ÿ_][^\]]{{0,40}}\]|<<[^>]+>>|\([{CAPS}_][{CAPS}_ ]{{2,40}}\)"
LEADER = r"_{3,}|\.{6,}|/{2,}"
MASK = r"X{3,}|0{4,}"
ROLE_X = (r"(?i)^(?:Diretor[a]?|Chefe|Gestor[a]?|Gerente|Coordenador[a]?|Supervisor[a]?|Reitor[a]?|Pró-Reitor[a]?|Pró-Reitoria|Vice-Reitor[a]?|Secretári[oa]|Procurador[a]?|Superintendente|Departamento|Divisão|Unidade|Setor)"
          r"[\w\s\-/áéíóúâêôãõçÁÉÍÓÚÂÊÔÃÕÇ]{0,55}\sX\s*$")
LABEL = r"^[\w\sÀ-ÿ/]{2,40}:\s*$"
LABEL_LEADER = r"^[\w\sÀ-ÿ/]{1,40}:\s*(?:_{3,}|\.{3,}|/+)\s*$"
INSTRUCTION = r"(?i)^\s*(Descrever|Identificar|Listar|Citar|Apontar|Indicar|Informar|Mencionar|Inserir|Detalhar|Especificar|Descreva|Cite|Liste|Aponte|Provê|Prover|Describe|List|Identify|State|Specify|Explain)\b"
CELL_INSTRUCTION = r"(?i)^\s*(Descrever|Identificar|Listar|Citar|Apontar|Indicar|Informar|Mencionar|Inserir|Detalhar|Especificar|Descreva|Cite|Liste|Aponte|Describe|List|Identify|State|Specify|Explain)\b"
HINT = r"\([^)]{5,}\)"
NUMBERED = rf"^\s*\d+(?:\.\d+)*[.:]?\s+[{CAPS}]"
HEADING = rf"^\s*(?:\d+(?:\.\d+)*[.:]?\s+\S|[{CAPS}][{CAPS}\s\-—–:]{{3,80}})\s*$"
EMPTY_RUN = 2
CELL_MASK = r"X{2,}|0{2,}|_{3,}|\.{6,}|/{2,}"
NAMES = ["Fulano", "Fulano de Tal", "Fulano (Titular)", "Ciclano", "Ciclano (Substituto)", "Beltrano", "Beltrano de Tal"]
#: Kinds of placeholders in templates and their patterns; groups of which the first is the token, where there is one.
SHAPES = [
    ("repeated", r"(?<![A-Za-z0-9])([X0]{3,}|[X0]{2,}(?:[/\-.][X0]{2,})+)(?![A-Za-z0-9])", 1),
    ("parens", rf"\(([{CAPS}_][{CAPS}_ ]{{1,40}})\)", 1),
    ("brackets", r"\[[A-Za-zÀ-ÿ_][\w.-]{0,40}\]", 0),
    ("curly", r"\{\{\s*[A-Za-z_][\w.-]*\s*\}\}", 0),
    ("double_angle", r"<<\s*[A-Za-z_][\w. -]*\s*>>", 0),
    ("angle", r"<\s*[a-zà-ÿ][a-zà-ÿ ]{1,30}\s*>", 0),
    ("underscore", r"_{3,}", 0),
    ("dot_leader", r"\.{6,}", 0),
    ("symbol_run", r"([§¶†‡])\1{2,}", 0),
    ("revision", r"(?i)\b(?:Rev\.?|Vers[aã]o|Ver\.)\s*0+\b", 0),
]
LABEL_EMPTY = rf"^[{CAPS}][A-Za-zÀ-ÿ ]{{1,30}}:\s*$"


def kind_of(text: Column) -> Column:
    """empty, heading_with_hint, placeholder, label_value, instruction, heading or data; the first that fits."""
    t = strip(text)
    numbered = t.rlike(NUMBERED)
    return (F.when(t == "", "empty").when(numbered & t.rlike(HINT), "heading_with_hint").when(t.rlike(MARKED), "placeholder").when(t.rlike(UNICODE + LABEL_LEADER) | t.rlike(UNICODE + LABEL), "label_value")
            .when(t.rlike(UNICODE + INSTRUCTION), "instruction").when(t.rlike(LEADER) & (F.char_length(t) <= 80), "placeholder").when(t.rlike(MASK) | t.rlike(UNICODE + ROLE_X), "placeholder")
            .when(numbered, "heading").otherwise("data"))


def fillable(kind: Column) -> Column:
    return ~kind.isin("heading", "data")


def looks_like_heading(text: Column) -> Column:
    t = strip(text)
    return t.rlike(HEADING) & ~t.endswith(".") & (F.char_length(t) <= 80)


def body_slots(blocks: DataFrame) -> DataFrame:
    """A slot for each paragraph: doc_id, slot_id, idx, kind, fillable, context (nearest text above, 120 characters).

    An empty paragraph counts where it follows a heading in a run of at most EMPTY_RUN. A bare label is a heading where the next text
    is an instruction or the next paragraph is empty."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    t = strip(F.coalesce("text", F.lit("")))
    rows = blocks.select("doc_id", "idx", t.alias("_t"), kind_of(F.coalesce("text", F.lit(""))).alias("_kind")).withColumn("_some", F.when(F.col("_t") != "", F.col("_t")))
    rows = rows.withColumn("_island", F.count("_some").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy("doc_id", "_island")
    rows = rows.withColumn("_lead", F.max("_some").over(island)).withColumn("_run", F.count(F.when(F.col("_some").isNull(), 1)).over(island))
    after = order.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("_next_kind", F.first(F.when(F.col("_some").isNotNull(), F.col("_kind")), True).over(after)).withColumn("_next", F.lead("_t").over(order))
    above = F.last("_some", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    heading = F.col("_t").rlike(LABEL) & ((F.coalesce("_next_kind", F.lit("")) == "instruction") | (F.coalesce(F.col("_next") == "", F.lit(False))))
    kind = F.when(heading, "heading").otherwise(F.col("_kind"))
    under = F.col("_lead").isNotNull() & looks_like_heading(F.col("_lead")) & (F.col("_run") <= EMPTY_RUN)
    open_ = F.when(F.col("_kind") == "empty", F.coalesce(under, F.lit(False))).otherwise(fillable(kind))
    return rows.select("doc_id", F.concat(F.lit("body_para_"), "idx").alias("slot_id"), "idx", kind.alias("kind"), open_.alias("fillable"), F.coalesce(F.substring(above, 1, 120), F.lit("")).alias("context"))


def cell_slots(cells: DataFrame, headed: DataFrame | None = None) -> DataFrame:
    """A slot for each cell: doc_id, slot_id, table_no, row, col, kind, fillable, context ('column="H"' and the texts beside it, 200 characters).

    headed: doc_id, table_no of tables whose first row names columns. Cells may have the flags has_drawing (data) and is_control (placeholder)."""
    t = strip(F.coalesce("text", F.lit("")))
    kind = kind_of(t)
    if "is_control" in cells.columns:
        kind = F.when(F.col("is_control"), "placeholder").otherwise(kind)
    if "has_drawing" in cells.columns:
        kind = F.when(F.col("has_drawing"), "data").otherwise(kind)
    rows = cells.select("doc_id", "table_no", "row", "col", t.alias("_t"), F.substring(t, 1, 60).alias("_short"), kind.alias("kind"))
    beside = Window.partitionBy("doc_id", "table_no", "row")
    rows = rows.withColumn("_row", F.array_sort(F.collect_list(F.struct("col", "_short")).over(beside)))
    others = F.transform(F.filter("_row", lambda x: (x["col"] != F.col("col")) & (x["_short"] != "")), lambda x: x["_short"])
    if headed is None:
        context = F.array_join(others, " | ")
    else:
        names = rows.where("row = 0").join(headed.select("doc_id", "table_no").distinct(), ["doc_id", "table_no"], "left_semi").select("doc_id", "table_no", "col", F.col("_short").alias("_name"))
        rows = rows.join(names, ["doc_id", "table_no", "col"], "left")
        named = (F.col("row") > 0) & (F.coalesce("_name", F.lit("")) != "")
        context = F.array_join(F.concat(F.when(named, F.array(F.concat(F.lit('column="'), "_name", F.lit('"')))).otherwise(F.array().cast("array<string>")), others), " | ")
    return rows.select("doc_id", F.concat(F.lit("cell_t"), "table_no", F.lit("_r"), "row", F.lit("_c"), "col").alias("slot_id"), "table_no", "row", "col", "kind", fillable(F.col("kind")).alias("fillable"),
                       F.substring(context, 1, 200).alias("context"))


def part_slots(runs: DataFrame, location: str = "header_para") -> DataFrame:
    """A slot for each paragraph of a header or footer part that has text: doc_id, slot_id, text, kind, fillable."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_no", "text"))), lambda x: x["text"]), "")
    rows = runs.groupBy("doc_id", "part", "paragraph").agg(text.alias("text")).where(strip(F.col("text")) != "")
    name = F.regexp_replace(F.regexp_replace("part", "/", "_"), r"\.xml", "")
    return rows.select("doc_id", F.concat(F.lit(location + "_"), name, F.lit("_p"), "paragraph").alias("slot_id"), "text", kind_of(F.col("text")).alias("kind")).withColumn("fillable", fillable(F.col("kind")))


def cell_fillable(text: Column) -> Column:
    """Empty, an instruction, a mask, a hint in brackets, a bare label or a stand-in name."""
    t = strip(F.coalesce(text, F.lit("")))
    return (t == "") | t.rlike(UNICODE + CELL_INSTRUCTION) | t.rlike(CELL_MASK) | (t.rlike(r"^\(.+\)$") & (F.char_length(t) <= 80)) | t.rlike(UNICODE + LABEL) | t.isin(*NAMES)


def empty_tables(cells: DataFrame) -> DataFrame:
    """Tables with a blank data row: doc_id, table_no, headers, sub_headers, empty_rows. The second row is a row of sub-headers where it has text and differs from the first."""
    t = strip(F.coalesce("text", F.lit("")))
    rows = cells.groupBy("doc_id", "table_no", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", t.alias("t")))), lambda x: x["t"]).alias("_c"))
    rows = rows.withColumn("_blank", F.forall("_c", lambda x: x == ""))
    at = lambda n: F.max(F.when(F.col("row") == n, F.col("_c")))
    found = rows.groupBy("doc_id", "table_no").agg(at(0).alias("headers"), at(1).alias("_second"), F.count_if(F.col("_blank") & (F.col("row") > 1)).alias("_later"), F.count_if(F.col("_blank") & (F.col("row") == 1)).alias("_at_one"))
    sub = F.coalesce(F.exists("_second", lambda x: x != "") & (F.col("_second") != F.col("headers")), F.lit(False))
    return found.select("doc_id", "table_no", "headers", F.when(sub, F.col("_second")).otherwise(F.transform("headers", lambda x: F.lit(""))).alias("sub_headers"),
                        (F.col("_later") + F.when(sub, 0).otherwise(F.col("_at_one"))).alias("empty_rows")).where("empty_rows >= 1")


def template_placeholders(blocks: DataFrame, text_col: str = "text") -> DataFrame:
    """Every match of every shape: the columns of blocks but the text, kind, token, context (the whole paragraph). One pass over the text."""
    t = F.coalesce(text_col, F.lit(""))
    named = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x.alias("token"))
    found = [F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(g)), named(k)) for k, p, g in SHAPES]
    label = F.when(strip(t).rlike(LABEL_EMPTY), F.array(F.struct(F.lit("label_empty").alias("kind"), strip(t).alias("token")))).otherwise(F.array().cast("array<struct<kind:string,token:string>>"))
    keep = [c for c in blocks.columns if c != text_col]
    return blocks.select(*keep, strip(t).alias("context"), F.explode(F.concat(*found, label)).alias("p")).where("context <> ''").select(*keep, "p.kind", "p.token", "context")
