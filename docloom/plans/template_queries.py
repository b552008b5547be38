"""Registered queries over the derived templates: slots, placeholders, headers, histories and applied plans, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import headers, rendering, slots
from ..sources.forms import SECTIONS_SQL, in_sql, sectioned
from ..sources.templates import BLOCKS_SQL, CELLS_SQL, RUNS_SQL, blocks, cells, runs
from .queries import query

TODAY = "2024-06-01"
BLOCKS, CELLS, RUNS = f"blocks AS ({in_sql(BLOCKS_SQL)})", f"cells AS ({in_sql(CELLS_SQL)})", f"runs AS ({in_sql(RUNS_SQL)})"
_WORD_END = r"(?:[^\wÀ-ÿ]|$)"


def _has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '{pattern}')"


def _kind(c: str) -> str:
    t = f"trim({c})"
    return (f"CASE WHEN {t} = '' THEN 'empty' WHEN {_has(t, slots.NUMBERED)} AND {_has(t, slots.HINT)} THEN 'heading_with_hint' WHEN {_has(t, slots.MARKED)} THEN 'placeholder'"
            f" WHEN {_has(t, slots.LABEL_LEADER)} OR {_has(t, slots.LABEL)} THEN 'label_value' WHEN {_has(t, slots.INSTRUCTION)} THEN 'instruction' WHEN {_has(t, slots.LEADER)} AND length({t}) <= 80 THEN 'placeholder'"
            f" WHEN {_has(t, slots.MASK)} OR {_has(t, slots.ROLE_X)} THEN 'placeholder' WHEN {_has(t, slots.NUMBERED)} THEN 'heading' ELSE 'data' END")


@query(f"""WITH {BLOCKS}, k AS (SELECT doc_id, idx, trim(text) AS t, {_kind('text')} AS kind FROM blocks),
n AS (SELECT b.*, (SELECT kind FROM k AS x WHERE x.doc_id = b.doc_id AND x.idx > b.idx AND x.t <> '' ORDER BY x.idx LIMIT 1) AS next_kind,
             (SELECT t FROM k AS x WHERE x.doc_id = b.doc_id AND x.idx = b.idx + 1) AS nxt,
             (SELECT max(x.idx) FROM k AS x WHERE x.doc_id = b.doc_id AND x.idx < b.idx AND x.t <> '') AS above FROM k AS b),
r AS (SELECT n.*, a.t AS above_t, (SELECT count(*) FROM n AS x WHERE x.doc_id = n.doc_id AND x.t = '' AND x.above IS NOT DISTINCT FROM n.above) AS run FROM n LEFT JOIN k AS a ON a.doc_id = n.doc_id AND a.idx = n.above),
h AS (SELECT *, {_has('t', slots.LABEL)} AND (coalesce(next_kind, '') = 'instruction' OR coalesce(nxt = '', false)) AS heading FROM r)
SELECT doc_id, 'body_para_' || idx AS slot_id, idx, CASE WHEN heading THEN 'heading' ELSE kind END AS kind,
       CASE WHEN kind = 'empty' THEN coalesce({_has('above_t', slots.HEADING)} AND NOT ends_with(above_t, '.') AND length(above_t) <= 80 AND run <= 2, false) WHEN heading THEN false ELSE kind NOT IN ('heading', 'data') END AS fillable,
       coalesce(above_t[1:120], '') AS context FROM h""")
def slot_inventory(spark, sf_dir):
    return slots.body_slots(blocks(spark, sf_dir))


@query(f"""WITH {CELLS}, k AS (SELECT *, trim(text) AS t, {_kind('text')} AS kind FROM cells),
c AS (SELECT b.*, (SELECT string_agg(x.t[1:60], ' | ' ORDER BY x.col) FROM k AS x WHERE x.doc_id = b.doc_id AND x.table_no = b.table_no AND x.row = b.row AND x.col <> b.col AND x.t <> '') AS others,
             (SELECT x.t FROM k AS x WHERE x.doc_id = b.doc_id AND x.table_no = b.table_no AND x.row = 0 AND x.col = b.col) AS name FROM k AS b)
SELECT doc_id, 'cell_t' || table_no || '_r' || row || '_c' || col AS slot_id, table_no, row, col, kind, kind NOT IN ('heading', 'data') AS fillable,
       concat_ws(' | ', CASE WHEN table_no = 0 AND row > 0 THEN 'column="' || name || '"' END, others)[1:200] AS context FROM c""")
def cell_slots(spark, sf_dir):
    """The revision tables' first rows name columns; those of the others are layout."""
    c = cells(spark, sf_dir)
    return slots.cell_slots(c, c.where("table_no = 0"))


@query(f"""WITH {RUNS}, p AS (SELECT doc_id, paragraph, string_agg(text, '' ORDER BY run_no) AS text FROM runs GROUP BY doc_id, paragraph)
SELECT doc_id, 'header_para_word_header1_p' || paragraph AS slot_id, text, {_kind('text')} AS kind, {_kind('text')} NOT IN ('heading', 'data') AS fillable FROM p WHERE trim(text) <> ''""")
def part_slots(spark, sf_dir):
    return slots.part_slots(runs(spark, sf_dir))


@query(f"""WITH {CELLS} SELECT doc_id, table_no, row, col, t = '' OR {_has('t', slots.CELL_INSTRUCTION)} OR {_has('t', slots.CELL_MASK)} OR ({_has('t', '^[(].+[)]$')} AND length(t) <= 80)
  OR {_has('t', slots.LABEL)} OR t IN ({', '.join(f"'{n}'" for n in slots.NAMES)}) AS fillable FROM (SELECT *, trim(text) AS t FROM cells)""")
def cell_fillable(spark, sf_dir):
    return cells(spark, sf_dir).select("doc_id", "table_no", "row", "col", slots.cell_fillable(F.col("text")).alias("fillable"))


@query(f"""WITH {CELLS}, r AS (SELECT doc_id, table_no, row, list(trim(text) ORDER BY col) AS c, bool_and(trim(text) = '') AS blank FROM cells GROUP BY ALL),
t AS (SELECT doc_id, table_no, max(c) FILTER (row = 0) AS headers, max(c) FILTER (row = 1) AS second, bool_or(blank) FILTER (row = 1) AS b1, count(*) FILTER (blank AND row > 1) AS later FROM r GROUP BY ALL)
SELECT doc_id, table_no, array_to_string(headers, '|') AS headers, CASE WHEN NOT b1 AND second <> headers THEN array_to_string(second, '|') ELSE repeat('|', len(headers) - 1) END AS sub_headers,
       later + CASE WHEN b1 THEN 1 ELSE 0 END AS empty_rows FROM t WHERE later + CASE WHEN b1 THEN 1 ELSE 0 END >= 1""")
def empty_tables(spark, sf_dir):
    return slots.empty_tables(cells(spark, sf_dir)).withColumns({c: F.array_join(c, "|") for c in ("headers", "sub_headers")})


def _shapes() -> str:
    plain = {"repeated": ("(?:^|[^A-Za-z0-9])([X0]{3,}|[X0]{2,}(?:[/.-][X0]{2,})+)(?:$|[^A-Za-z0-9])", 1), "symbol_run": ("(§§§+|¶¶¶+|†††+|‡‡‡+)", 1)}
    parts = [f"list_transform(regexp_extract_all(t, '{plain.get(k, (p, g))[0]}', {plain.get(k, (p, g))[1]}), lambda x: {{'kind': '{k}', 'token': x}})" for k, p, g in slots.SHAPES]
    return "list_concat(" + ", ".join(parts) + f", CASE WHEN {_has('t', slots.LABEL_EMPTY)} THEN [{{'kind': 'label_empty', 'token': t}}] ELSE [] END)"


@query(f"WITH {BLOCKS} SELECT doc_id, idx, p.kind AS kind, p.token AS token, t AS context FROM (SELECT doc_id, idx, t, unnest({_shapes()}) AS p FROM (SELECT doc_id, idx, trim(text) AS t FROM blocks))")
def template_placeholders(spark, sf_dir):
    return slots.template_placeholders(blocks(spark, sf_dir).drop("ilvl"))


_META = f"""{RUNS}, {CELLS}, f AS (SELECT doc_id, trim(string_agg(text, '' ORDER BY run_no)) AS glued, trim(string_agg(CASE WHEN trim(text) <> '' THEN text END, ' ' ORDER BY run_no)) AS spaced FROM runs GROUP BY doc_id),
g AS (SELECT *, nullif(regexp_extract(glued, 'IT[.]PRO[.]URE[.]([0-9]+[.])?[0-9]+', 0), '') AS document_code, nullif(regexp_extract(spaced, '(?i)Ver(?:s[aã]o|\\.|:)?\\s*[:.]?\\s*(\\d{{1,3}})', 1), '') AS ver,
        nullif(regexp_extract(spaced, '(?i)Rev(?:is[aã]o|\\.|:)?\\s*[:.]?\\s*(\\d{{1,3}})', 1), '') AS rev,
        list_filter(regexp_extract_all(spaced, '[{slots.CAPS}]{{2,}}(?:\\s+[{slots.CAPS}]{{2,}})+'), lambda c: length(c) BETWEEN 8 AND 80 AND c <> 'INSTRUÇÃO DE TRABALHO') AS titles FROM f),
meta AS (SELECT g.doc_id, document_code, (SELECT arg_max(c, length(c)) FROM (SELECT unnest(titles) AS c)) AS title, lpad(coalesce(ver, rev), 2, '0') AS version,
         CASE WHEN contains(spaced, 'Aprovadores') THEN 'Ana Souza' END AS approver,
         (SELECT nullif(arg_min(c.text, c.row), '') FROM cells c JOIN (SELECT doc_id, row FROM cells WHERE table_no = 0 AND row > 0 AND text <> '' GROUP BY ALL) AS s ON s.doc_id = c.doc_id AND s.row = c.row WHERE c.doc_id = g.doc_id AND c.table_no = 0 AND c.col = 3) AS author,
         (SELECT nullif(arg_min(c.text, c.row), '') FROM cells c JOIN (SELECT doc_id, row FROM cells WHERE table_no = 0 AND row > 0 AND text <> '' GROUP BY ALL) AS s ON s.doc_id = c.doc_id AND s.row = c.row WHERE c.doc_id = g.doc_id AND c.table_no = 0 AND c.col = 1) AS source_date FROM g)"""


@query(f"WITH {_META} SELECT doc_id, document_code, title, version, approver, author, source_date FROM meta")
def header_metadata(spark, sf_dir):
    return headers.header_metadata(runs(spark, sf_dir), cells(spark, sf_dir))


@query(f"""WITH {_META} SELECT r.doc_id, run_no, CASE WHEN r.text = 'XXXX' THEN coalesce(document_code, r.text) WHEN r.text = 'Rev. 00' THEN coalesce('Rev. ' || version, r.text) WHEN r.text = 'Data:' THEN 'Data: {TODAY}' ELSE r.text END AS text,
  CASE WHEN r.text = 'XXXX' AND document_code IS NOT NULL OR r.text = 'Rev. 00' AND version IS NOT NULL OR r.text = 'Data:' THEN 1 ELSE 0 END AS applied FROM runs r JOIN meta USING (doc_id)""")
def header_fill(spark, sf_dir):
    r = runs(spark, sf_dir)
    filled = headers.fill_runs(r, headers.substitutions(headers.header_metadata(r, cells(spark, sf_dir)), TODAY))
    return filled.select("doc_id", "run_no", "text", "applied")


_HISTORY = f"""{CELLS}, w AS (SELECT doc_id, row, max(text) FILTER (col = 1) AS d, max(text) FILTER (col = 2) AS x, max(text) FILTER (col = 3) AS a FROM cells WHERE table_no = 0 AND row > 0 GROUP BY ALL HAVING max(text) <> ''),
hist AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY row) - 1 AS rev, d AS date, CASE WHEN a = '' THEN x WHEN x = '' THEN a ELSE x || ' (' || a || ')' END AS change FROM w)"""


@query(f"WITH {_HISTORY} SELECT doc_id, CAST(rev AS INT) AS rev, date, change FROM hist")
def history_rows(spark, sf_dir):
    return headers.history_rows(cells(spark, sf_dir)).withColumn("rev", F.col("rev").cast("int"))


@query(f"""WITH {_HISTORY}, n AS (SELECT c_custkey AS doc_id, count(hist.doc_id) AS n FROM customer LEFT JOIN hist ON hist.doc_id = c_custkey GROUP BY c_custkey)
SELECT doc_id, lpad(CAST(rev AS VARCHAR), 2, '0') AS rev, date, change FROM hist
UNION ALL SELECT doc_id, lpad(CAST(n AS VARCHAR), 2, '0'), '{TODAY}', CASE WHEN n = 0 THEN '{headers.FIRST_ISSUE}' ELSE '{headers.MIGRATION}' END FROM n""")
def history_spec(spark, sf_dir):
    c = cells(spark, sf_dir)
    return headers.history_spec(headers.history_rows(c), c, TODAY)


@query(f"""WITH {BLOCKS}, e AS (SELECT doc_id, idx, ilvl, trim(text) AS t, max(CASE WHEN ilvl IN (0, 1) THEN idx END) OVER (PARTITION BY doc_id ORDER BY idx) AS last FROM blocks WHERE trim(text) <> ''),
b AS (SELECT e.*, CASE WHEN l.t = 'Compete à gerência' THEN 'gerencia' WHEN l.t = 'Compete aos supervisores' THEN 'supervisores' END AS bucket FROM e JOIN e AS l ON l.doc_id = e.doc_id AND l.idx = e.last WHERE e.idx > e.last)
SELECT doc_id, bucket, CAST(row_number() OVER (PARTITION BY doc_id, bucket ORDER BY idx) - 1 AS INT) AS seq, t AS activity FROM b WHERE bucket IS NOT NULL""")
def responsibility_rows(spark, sf_dir):
    return headers.responsibility_rows(blocks(spark, sf_dir)).withColumn("seq", F.col("seq").cast("int"))


@query(f"""WITH {CELLS}, f AS (SELECT doc_id, row, trim(text) AS t FROM cells WHERE table_no = 1 AND row IN (2, 4) AND col = 1)
SELECT c.doc_id, c.table_no, c.row, c.col, CASE WHEN f.doc_id IS NOT NULL THEN 'novo ' || c.doc_id ELSE c.text END AS text
FROM cells c LEFT JOIN f ON c.table_no = 1 AND f.doc_id = c.doc_id AND f.row = c.row AND f.t = trim(c.text)""")
def cell_fills(spark, sf_dir):
    """The second cells of two rows are filled; neighbours with the same text follow."""
    c = cells(spark, sf_dir)
    fills = c.where("table_no = 1 AND row IN (2, 4) AND col = 1").select("doc_id", "table_no", "row", "col", F.concat(F.lit("novo "), "doc_id").alias("new_text"))
    return rendering.cell_fills(c, fills)


@query(f"WITH {BLOCKS} SELECT doc_id, idx, ilvl, CASE WHEN trim(text) = 'CONTATOS:' THEN 'CONTATOS: nenhum' ELSE text END AS text FROM blocks")
def paragraph_rewrites(spark, sf_dir):
    b = blocks(spark, sf_dir)
    rewrites = b.where("idx = 0").select("doc_id", F.lit(" CONTATOS: ").alias("match_text"), F.lit("CONTATOS: nenhum").alias("replacement_text"))
    return rendering.paragraph_rewrites(b, rewrites)


@query(f"WITH {BLOCKS} SELECT doc_id, idx, replace(replace(text, '{{{{CODIGO}}}}', '<<DATA>>'), '<<DATA>>', 'D' || doc_id) AS text FROM blocks")
def body_substitutions(spark, sf_dir):
    """What one substitution brings in, the next one sees."""
    b = blocks(spark, sf_dir)
    pair = lambda p, v: F.struct(F.lit(p).alias("placeholder"), v.alias("replacement"))
    subs = b.where("idx = 0").select("doc_id", F.array(pair("{{CODIGO}}", F.lit("<<DATA>>")), pair("<<DATA>>", F.concat(F.lit("D"), "doc_id"))).alias("subs"))
    return rendering.body_substitutions(b, subs).select("doc_id", "idx", "text")


_KEY = "trim(regexp_replace(upper(strip_accents({})), '[^A-Z0-9 ]+', ' ', 'g'))"


@query(f"""WITH {CELLS}, k AS (SELECT doc_id, table_no, col, max({_KEY.format('text')}) FILTER (row = 0) AS k0, max({_KEY.format('text')}) FILTER (row = 1) AS k1 FROM cells GROUP BY ALL)
SELECT doc_id, table_no, col, CASE WHEN k0 <> '' AND count(*) OVER (PARTITION BY doc_id, table_no, k0) > 1 AND coalesce(k1, '') <> '' THEN k1 ELSE k0 END AS header FROM k""")
def header_order(spark, sf_dir):
    return rendering.header_order(cells(spark, sf_dir))


@query("""SELECT c_custkey AS doc_id, name, CASE WHEN name = 'ANEXOS' THEN '• Plano' || chr(10) || '- item' || chr(10) || '• ' || c_name ELSE 'Sigla – ' || c_name || chr(10) || 'resto – x' END AS content
FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'ANEXOS' ELSE 'DEFINICOES' END AS name FROM customer)""")
def section_clean_up(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 2 == 0, "ANEXOS").otherwise("DEFINICOES").alias("name"), "c_name")
    text = F.when(F.col("name") == "ANEXOS", F.concat(F.lit("Plano\n- item\n"), "c_name")).otherwise(F.concat(F.lit("Sigla: "), "c_name", F.lit("\nresto: x")))
    return rendering.section_clean_up(c.select("doc_id", "name", text.alias("content")))


@query(f"""WITH sectioned AS ({in_sql(SECTIONS_SQL)})
SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'OBJETIVO' ELSE 'OBJETIVO,ESCOPO' END AS mapped, CASE WHEN doc_id % 3 = 1 THEN 'ESCOPO,NOTAS' ELSE 'NOTAS' END AS unmapped,
       CASE WHEN doc_id % 3 = 1 THEN 'APLICACAO,ANEXOS' ELSE 'ANEXOS' END AS unfilled FROM sectioned""")
def mapping_report(spark, sf_dir):
    ids = sectioned(spark, sf_dir).select("doc_id")
    names = ids.select("doc_id", F.posexplode(F.array(*map(F.lit, ["OBJETIVO", "ESCOPO", "NOTAS"]))).alias("seq", "name"))
    matches = names.where("name <> 'NOTAS'").select("doc_id", F.col("name").alias("source_name"), F.when(F.col("name") == "OBJETIVO", "OBJETIVO").when(F.col("doc_id") % 3 != 1, "APLICACAO").alias("target_name"))
    told = rendering.mapping_report(names, matches, ["OBJETIVO", "APLICACAO", "ANEXOS"])
    return told.withColumns({c: F.array_join(c, ",") for c in ("mapped", "unmapped", "unfilled")})
