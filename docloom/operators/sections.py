"""Sections: headings found in lines, text split under them, de-duplication, matching to a template's headings, content by target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import heading_key, strip, token_jaccard

#: Heading syntaxes, words without weight, synonyms of headings by canonical heading, footers, and headings that tables cover.
NUMBERED = r"^\s*(\d+(?:\.\d+)*)\.?\s+([A-ZÁÉÍÓÚÂÊÔÃÕÇ][A-Za-zÀ-ÿ\s\-/—–:&,()'’]{2,80}?)\s*$"
ALL_CAPS = r"^\s*([A-ZÁÉÍÓÚÂÊÔÃÕÇ][A-ZÁÉÍÓÚÂÊÔÃÕÇ\s\-/—–&]{2,80})\s*$"
TITLE_CASE = r"^\s*([A-ZÁÉÍÓÚÂÊÔÃÕÇ][a-zà-ÿ]{1,30}(?:\s+(?:[A-ZÁÉÍÓÚÂÊÔÃÕÇ][a-zà-ÿ]{1,30}|de|da|do|dos|das|e|of|the|and|in)){0,7})\s*$"
STYLE = r"(?i)^Heading\s*(\d+)\s*$"
STOP_WORDS = ["E", "DE", "DA", "DO", "DOS", "DAS", "A", "O", "AS", "OS"]
SYNONYMS = {
    "OBJETIVO": ["FINALIDADE", "PROPOSITO", "FINALIDADES"],
    "APLICACAO": ["ESCOPO", "AMBITO", "AMBITO DE APLICACAO", "ALCANCE", "ABRANGENCIA"],
    "NORMAS E DOCUMENTOS DE REFERENCIA": ["REFERENCIAS", "REFERENCIAS NORMATIVAS", "DOCUMENTOS DE REFERENCIA", "NORMAS"],
    "DEFINICOES": ["TERMOS E DEFINICOES", "GLOSSARIO", "TERMINOLOGIA", "DEFINICOES SIGLAS", "DEFINICOES E SIGLAS", "SIGLAS"],
    "SISTEMATICA": ["DESCRICAO", "PROCEDIMENTO", "DESCRICAO DA ATIVIDADE", "DESCRICAO DO PROCESSO", "METODOLOGIA", "PROCESSO", "DETALHAMENTO",
                    "DETALHAMENTO DAS ATIVIDADES", "EXECUCAO", "EXECUCAO DA TAREFA"],
    "RESPONSABILIDADE": ["RESPONSABILIDADES", "ATRIBUICOES", "ATRIBUICOES E RESPONSABILIDADES", "REGISTROS", "RESPONSABILIDADES AUTORIDADES",
                         "RESPONSABILIDADES E AUTORIDADES", "MATRIZ DE RESPONSABILIDADES"],
    "HISTORICO": ["HISTORICO DE REVISOES", "CONTROLE DE REVISOES", "REVISOES", "HISTORICO DE ALTERACOES", "HISTORICO DE REVISAO", "REGISTRO DE REVISOES"],
    "INTRODUCAO": ["APRESENTACAO"],
    "CONCLUSAO": ["CONCLUSOES", "CONSIDERACOES FINAIS"],
}
FOOTER = r"(?imU)^\s*(?:FORM\.[\w./-]+|REPRODUCAO\s+PROIBIDA|REPRODUÇÃO\s+PROIBIDA|FL\.\s*\d+\s*/\s*\d+|INTERNA\s+P[áa]gina\s+\d+\s+de\s+\d+|Refer[êe]ncias\s+e\s+Anexos|Dados\s+da\s+Refer[êe]ncia)"
TABULAR = ["RESPONSABILIDADE", "RESPONSABILIDADES", "ATRIBUICOES", "ATRIBUICOES E RESPONSABILIDADES", "HISTORICO", "HISTORICO DE REVISOES"]
LEAST_OVERLAP, LEAST_COSINE, LEAST_COVERAGE = 0.5, 0.55, 0.6


def heading(text: Column, style: Column | None = None, bold: Column | None = None) -> Column:
    """Null, or a struct (name, number, level). By style first, then numbered, then bold in title case, then all capitals unless it looks like a code, an acronym or a label."""
    t = strip(text)
    made = lambda name, number, level: F.struct(heading_key(name).alias("name"), number.cast("string").alias("number"), level.cast("int").alias("level"))
    none = F.lit(None).cast("string")
    letters, spaced = F.length(F.regexp_replace(t, "[^A-Za-z]", "")), t.contains(" ")
    marks = F.length(t) - F.length(F.regexp_replace(t, "[/-]", ""))
    capital = t.rlike(ALL_CAPS) & ~t.contains(":") & ~t.rlike(r"\d$") & (spaced | (letters >= 5)) & (marks < 2) & (spaced | ~t.rlike("[._-]")) & (F.char_length(t) <= 60) & ~t.rlike(r"^\(.*\)$")
    out = F.when(t == "", None)
    if style is not None:
        out = out.when(style.rlike(STYLE), made(t, none, F.regexp_extract(style, STYLE, 1)))
    number = F.regexp_extract(t, NUMBERED, 1)
    out = out.when(t.rlike(NUMBERED), made(F.regexp_extract(t, NUMBERED, 2), number, F.length(F.regexp_replace(number, r"[^.]", "")) + 1))
    if bold is not None:
        out = out.when(bold & ~t.rlike("[.,;:?!]$") & t.rlike(TITLE_CASE) & (F.char_length(t) <= 60), made(t, none, F.lit(1)))
    return out.when(capital, made(t, none, F.lit(1)))


def split_sections(docs: DataFrame) -> DataFrame:
    """doc_id, seq (from 1), name, raw_heading, number, level, content. Lines before the first heading are dropped. One shuffle, by document."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\R", -1)).alias("_pos", "_line"))
    lines = lines.withColumn("_h", heading(F.col("_line")))
    order = Window.partitionBy("doc_id").orderBy("_pos")
    lines = lines.withColumn("seq", F.sum(F.when(F.col("_h").isNotNull(), 1).otherwise(0)).over(order)).where("seq > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_h").isNull(), F.struct("_pos", "_line")))), lambda x: x["_line"]), "\n")
    by = lines.groupBy("doc_id", "seq").agg(F.max("_h").alias("_h"), F.max(F.when(F.col("_h").isNotNull(), F.col("_line"))).alias("_raw"), body.alias("_body"))
    return by.select("doc_id", F.col("seq").cast("int").alias("seq"), "_h.name", strip(F.col("_raw")).alias("raw_heading"), "_h.number", "_h.level", strip(F.col("_body")).alias("content"))


def dedupe_richest(sections: DataFrame) -> DataFrame:
    """Of sections of one name in a document the one with most content, in the first one's place (column place)."""
    same = Window.partitionBy("doc_id", "name")
    ranked = sections.withColumn("place", F.min("seq").over(same)).withColumn("_r", F.row_number().over(same.orderBy(F.desc(F.char_length(strip(F.col("content")))), "seq")))
    return ranked.where("_r = 1").drop("_r")


def canonical_heading(name: Column) -> Column:
    """The heading that name is a synonym of, or itself."""
    key = F.regexp_replace(F.upper(strip(name)), r"\s+", " ")
    pairs = [x for head, others in SYNONYMS.items() for o in others for x in (F.lit(o), F.lit(head))]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), key)


def match_headings(sections: DataFrame, targets: list[str]) -> DataFrame:
    """doc_id, seq, source_name, target_name, score, method. Equal canonical headings first (exact or synonym), else the largest overlap of words from 0.5 on, else a miss.

    The targets of a template are few: they stand in the plan, and each section is compared where it is, without a shuffle. On ties the first target counts."""
    canon = canonical_heading(F.col("name"))
    rows = sections.select("doc_id", "seq", F.col("name").alias("source_name"), canon.alias("_c"))
    frame = sections.sparkSession.createDataFrame([(i, t) for i, t in enumerate(targets)], "_i int, _target string").withColumn("_tc", canonical_heading(F.col("_target")))
    names = rows.select("source_name", "_c").distinct().crossJoin(F.broadcast(frame))  # distinct headings x the template's headings
    names = names.withColumn("_score", F.when(F.col("_c") == F.col("_tc"), 2.0).otherwise(token_jaccard(F.col("_c"), F.col("_tc"), STOP_WORDS)))
    best = names.groupBy("source_name", "_c").agg(F.max(F.struct("_score", (-F.col("_i")).alias("_o"), "_target")).alias("_b"))
    hit, same = F.col("_b._score") >= LEAST_OVERLAP, F.col("_b._score") == 2.0
    kind = F.when(same & (F.col("_c") != F.upper(F.trim("source_name"))), "synonym").when(same, "exact").when(hit, "token").otherwise("miss")
    best = best.select(F.col("source_name").alias("_n"), F.when(hit, F.col("_b._target")).alias("target_name"), F.when(same, 1.0).when(hit, F.col("_b._score")).otherwise(0.0).alias("score"), kind.alias("method"))
    return rows.join(best, F.col("source_name") == F.col("_n")).select("doc_id", "seq", "source_name", "target_name", "score", "method")


def match_vectors(sources: DataFrame, targets: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """sources: source_id, vector; targets: target_id, vector, a bounded list that is broadcast. The nearest target by cosine from `least` on, the first on ties: source_id, target_id, score."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda df: df.withColumn("_norm", F.sqrt(dot(F.col("vector"), F.col("vector"))))
    t = norm(targets).select("target_id", F.col("vector").alias("_tv"), F.col("_norm").alias("_tn"))
    met = norm(sources).crossJoin(F.broadcast(t)).withColumn("_s", F.when((F.col("_norm") > 0) & (F.col("_tn") > 0), dot(F.col("vector"), F.col("_tv")) / (F.col("_norm") * F.col("_tn"))).otherwise(0.0))
    best = met.groupBy("source_id").agg(F.max(F.struct("_s", (-F.col("target_id")).alias("_o"))).alias("_b"))
    return best.where(F.col("_b._s") >= least).select("source_id", (-F.col("_b._o")).alias("target_id"), F.col("_b._s").alias("score"))


def coverage(matches: DataFrame, targets: list[str]) -> DataFrame:
    """Share of the template's headings that a document fills: doc_id, coverage."""
    if not targets:
        return matches.select("doc_id").distinct().withColumn("coverage", F.lit(1.0))
    return matches.groupBy("doc_id").agg((F.count_distinct("target_name") / len(set(targets))).alias("coverage"))


def choose_matches(first: DataFrame, second: DataFrame, targets: list[str], least: float = LEAST_COVERAGE) -> DataFrame:
    """Document by document the second matching where the first covers less than `least` and the second covers more."""
    both = coverage(first, targets).join(coverage(second, targets).withColumnRenamed("coverage", "_second"), "doc_id", "left")
    other = both.where((F.col("coverage") < least) & (F.col("_second") > F.col("coverage"))).select("doc_id")
    return first.join(other, "doc_id", "left_anti").unionByName(second.join(other, "doc_id", "left_semi"))


def trim_at_footer(c: Column) -> Column:
    """Content up to the first footer line, without white space at its end."""
    parts = F.split(c, FOOTER, 2)
    return F.when(F.size(parts) > 1, F.regexp_replace(F.get(parts, F.lit(0)), r"(?U)\s+$", "")).otherwise(c)


def content_map(sections: DataFrame, matches: DataFrame) -> DataFrame:
    """doc_id, target_name, content: the matched sections' contents in order, without repeats, blank line between."""
    met = sections.select("doc_id", "seq", trim_at_footer(F.col("content")).alias("_text")).join(matches, ["doc_id", "seq"]).where("target_name IS NOT NULL AND trim(_text) <> ''")
    joined = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_text"))), lambda x: x["_text"])), "\n\n")
    return met.groupBy("doc_id", "target_name").agg(joined.alias("content"))


def suppress_tabular(content: DataFrame, has_rows: bool) -> DataFrame:
    """Where tables are filled, the prose of headings that they cover becomes empty."""
    return content.withColumn("content", F.when(F.col("target_name").isin(TABULAR), "").otherwise(F.col("content"))) if has_rows else content


def line_kind(line: Column) -> Column:
    """subsubheading (1.2.3 and a space), subheading (1.2 and a space), nota or body."""
    return (F.when(line.rlike(r"^\s*\d+(?:\.\d+){2,3}\.?\s+\S"), "subsubheading").when(line.rlike(r"^\s*\d+\.\d+\.?\s+\S"), "subheading")
            .when(line.rlike(r"(?i)^\s*nota\s*\d*[:.]\s"), "nota").otherwise("body"))


def collapse_blank(blocks: DataFrame) -> DataFrame:
    """blocks: doc_id, idx, text, and anchor (tables before the paragraph) where known. Of runs of empty paragraphs only the first; a table parts runs."""
    empty = strip(F.col("text")) == ""
    order = Window.partitionBy("doc_id").orderBy("idx")
    before = F.lag(empty).over(order)
    if "anchor" in blocks.columns:
        before = before & F.lag("anchor").over(order).eqNullSafe(F.col("anchor"))
    return blocks.withColumn("_e", empty).withColumn("_b", F.coalesce(before, F.lit(False))).where("NOT (_e AND _b)").drop("_e", "_b")


def target_sections(blocks: DataFrame) -> DataFrame:
    """blocks: doc_id, idx, text, and style and is_bold where known. doc_id, seq, name, raw_heading, number, level, heading_idx, content_idx (paragraphs up to the next heading, blank ones too).

    Paragraphs before the first heading belong to no section."""
    extra = [F.col(c) if c in blocks.columns else None for c in ("style", "is_bold")]
    rows = blocks.withColumn("_h", heading(F.coalesce("text", F.lit("")), *extra))
    order = Window.partitionBy("doc_id").orderBy("idx")
    rows = rows.withColumn("seq", F.sum(F.when(F.col("_h").isNotNull(), 1).otherwise(0)).over(order).cast("int")).where("seq > 0")
    by = rows.groupBy("doc_id", "seq").agg(F.max("_h").alias("_h"), F.max(F.when(F.col("_h").isNotNull(), strip(F.col("text")))).alias("raw_heading"), F.min("idx").alias("heading_idx"),
                                           F.array_sort(F.collect_list(F.when(F.col("_h").isNull(), F.col("idx")))).alias("content_idx"))
    return by.select("doc_id", "seq", "_h.name", "raw_heading", "_h.number", "_h.level", "heading_idx", "content_idx")


def source_sections(blocks: DataFrame, levels: DataFrame, bullet_letters: bool = True) -> DataFrame:
    """Sections of documents whose numbers are set by their lists: doc_id, seq, name, raw_heading, number, level, content.

    blocks: doc_id, idx, text, num_id, ilvl, and style where known; levels as in numbering_markers. Every paragraph with a number gets its marker before its text. Headings are told by
    style and text; else a paragraph of the first level whose marker begins with a digit is one of level 1, and its marker its number. Blank paragraphs don't count, nor do those before
    the first heading."""
    from .numbering import numbering_markers
    from .rendering import section_clean_up

    rows = blocks.withColumn("_t", strip(F.coalesce("text", F.lit("")))).where("_t <> ''")
    markers = numbering_markers(rows.select("doc_id", "idx", "num_id", "ilvl"), levels, bullet_letters=bullet_letters)
    rows = rows.join(markers, ["doc_id", "idx"], "left").withColumn("_m", F.coalesce("marker", F.lit("")))
    told = heading(F.col("_t"), F.col("style") if "style" in blocks.columns else None)
    numbered = (F.coalesce("ilvl", F.lit(0)) == 0) & F.col("num_id").isNotNull() & F.col("_m").rlike("^[0-9]")
    rows = rows.withColumn("_h", F.coalesce(told, F.when(numbered, F.struct(heading_key(F.col("_t")).alias("name"), F.regexp_replace("_m", r"[.]+$", "").alias("number"), F.lit(1).alias("level")))))
    rows = rows.withColumn("_line", F.when(F.col("_m") == "", F.col("_t")).otherwise(F.concat("_m", F.lit(" "), "_t")))
    rows = rows.withColumn("seq", F.sum(F.when(F.col("_h").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("idx")).cast("int")).where("seq > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_h").isNull(), F.struct("idx", "_line")))), lambda x: x["_line"]), "\n")
    by = rows.groupBy("doc_id", "seq").agg(F.max("_h").alias("_h"), F.max(F.when(F.col("_h").isNotNull(), F.col("_line"))).alias("raw_heading"), body.alias("content"))
    return section_clean_up(by.select("doc_id", "seq", "_h.name", "raw_heading", "_h.number", "_h.level", "content"))
