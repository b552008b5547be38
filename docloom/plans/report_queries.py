"""Registered queries around a mapping: answers, checklists, caches, reports, filled tables; each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports, slots
from ..sources.forms import LINES_SQL, in_sql, lines
from ..sources.templates import blocks, cells
from .queries import BASE, REQUIRED, _mapping, fields, query
from .template_queries import BLOCKS, CELLS, _has

_ANSWERS = """a AS (SELECT c_custkey AS doc_id, '{"records": [{"nome": "' || c_name || '", "fone": "1", "x": "y"}, {"fone": "2"}, {"nome": "b"}], "corrections": [{"slot_id": "s1", "new_text": " a' || chr(29) || ' "}, {"slot_id": "s1", "new_text": "' || c_name || '"}, {"slot_id": "s2", "new_text": " "}, {"slot_id": "s3", "new_text": "lorem ipsum"}]}' AS response FROM customer)"""


def _answers(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.concat(F.lit('{"records": [{"nome": "'), "c_name", F.lit('", "fone": "1", "x": "y"}, {"fone": "2"}, {"nome": "b"}], "corrections": [{"slot_id": "s1", "new_text": " a\\u001d "}, {"slot_id": "s1", "new_text": "'),
                    "c_name", F.lit('"}, {"slot_id": "s2", "new_text": " "}, {"slot_id": "s3", "new_text": "lorem ipsum"}]}'))
    return c.select(F.col("c_custkey").alias("doc_id"), text.alias("response"))


@query("SELECT c_custkey AS doc_id, 0 AS record_no, c_name AS nome, '1' AS fone FROM customer UNION ALL SELECT c_custkey, 1, 'b', NULL FROM customer")
def parse_records(spark, sf_dir):
    found = reports.parse_records(_answers(spark, sf_dir), [("nome", True), ("fone", False)])
    return found.select("doc_id", F.col("record_no").cast("int").alias("record_no"), F.col("rec")["nome"].alias("nome"), F.col("rec")["fone"].alias("fone"))


@query("SELECT c_custkey AS doc_id, 's1' AS slot_id, c_name AS new_text FROM customer")
def parse_corrections(spark, sf_dir):
    return reports.parse_corrections(_answers(spark, sf_dir), "(?i)lorem ipsum")


@query(f"""WITH {CELLS}, t AS (SELECT *, trim(text) AS t FROM cells),
f AS (SELECT doc_id, table_no, row, t, min(col) AS first_col, max(col) AS last_col FROM t WHERE t = '' OR {_has('t', slots.CELL_INSTRUCTION)} OR {_has('t', slots.CELL_MASK)} OR ({_has('t', '^[(].+[)]$')} AND length(t) <= 80)
  OR {_has('t', slots.LABEL)} OR t IN ({', '.join(f"'{n}'" for n in slots.NAMES)}) GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY table_no, row, first_col) - 1 AS INT) AS line_no, table_no, row, first_col, last_col, t AS current FROM f""")
def cell_checklist(spark, sf_dir):
    return reports.cell_checklist(cells(spark, sf_dir)).withColumn("line_no", F.col("line_no").cast("int"))


@query(f"WITH {BLOCKS} SELECT doc_id, 'body_para_' || idx AS slot_id FROM blocks WHERE NOT (idx % 3 = 0 AND doc_id % 2 = 0)")
def drop_covered(spark, sf_dir):
    fills = slots.body_slots(blocks(spark, sf_dir)).select("doc_id", "slot_id", "idx")
    return reports.drop_covered(fills, fills.where("idx % 3 = 0 AND doc_id % 2 = 0")).drop("idx")


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN c_name || '.v2.docx.normalized.docx' ELSE c_name || '..normalized.docx' END AS name FROM customer")
def output_names(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("doc_id"), reports.output_name(F.concat(F.lit("/in/dir.x/"), "c_name", F.when(F.col("c_custkey") % 2 == 0, ".v2.docx").otherwise(""))).alias("name"))


@query("""SELECT c_custkey AS doc_id, sha256(c_mktsegment)[1:16] || '_' || sha256(c_name)[1:16] || '_v1' AS key, c_custkey % 3 = 0 AS hit, CASE WHEN c_custkey % 3 = 0 THEN 'plan ' || c_custkey END AS plan FROM customer""")
def plan_cache(spark, sf_dir):
    """Every third document has a plan, saved twice; the later one counts."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    wanted = c.select(F.col("c_custkey").alias("doc_id"), reports.cache_key(F.col("c_mktsegment"), F.col("c_name"), "v1").alias("key"))
    saved = wanted.where("doc_id % 3 = 0").select("key", F.explode(F.array(F.struct(F.lit("old").alias("plan"), F.timestamp_seconds(F.lit(1)).alias("saved_at")),
                                                                          F.struct(F.concat(F.lit("plan "), "doc_id").alias("plan"), F.timestamp_seconds(F.lit(2)).alias("saved_at")))).alias("s")).select("key", "s.*")
    hits, misses = reports.load_plans(wanted, saved)
    return hits.select("doc_id", "key", F.lit(True).alias("hit"), "plan").unionByName(misses.select("doc_id", "key", F.lit(False).alias("hit"), F.lit(None).cast("string").alias("plan")))


@query(BASE + """SELECT doc_id, tier, CAST(count(*) AS INT) AS total, round(CAST(avg(confidence) AS DOUBLE), 3) AS average_confidence, coalesce(max(value) FILTER (field = 'cliente'), '') AS cliente, max(source) FILTER (field = 'data') AS data_source
FROM mapping JOIN tiers USING (doc_id) GROUP BY doc_id, tier""")
def item_reports(spark, sf_dir):
    """The JSON of each report, read back."""
    mapping = _mapping(spark, sf_dir)
    made = reports.item_reports(mapping, fields.tier_by_doc(mapping, REQUIRED))
    kind = "tier string, mapping_summary struct<total:int,average_confidence:double>, mapping map<string,struct<value:string,source:string,confidence:double>>"
    r = made.select("doc_id", F.from_json("report", kind).alias("r"))
    return r.select("doc_id", "r.tier", "r.mapping_summary.total", "r.mapping_summary.average_confidence", F.col("r.mapping")["cliente"]["value"].alias("cliente"), F.col("r.mapping")["data"]["source"].alias("data_source"))


_HINTS = f"l AS ({in_sql(LINES_SQL)}), h AS (SELECT l_orderkey AS doc_id, 1 AS page, CAST(l_partkey % 40 AS INT) AS row_start, CAST(l_partkey % 40 + l_quantity % 7 AS INT) AS row_end, l_linenumber AS columns FROM l)"


@query(f"""WITH {_HINTS}, o AS (SELECT *, row_start <= 1 + max(row_end) OVER (PARTITION BY doc_id ORDER BY row_start, row_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS joined, row_number() OVER (PARTITION BY doc_id ORDER BY row_start, row_end) AS i FROM h),
g AS (SELECT *, count(*) FILTER (NOT coalesce(joined, false)) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM o) SELECT doc_id, page, min(row_start) AS row_start, max(row_end) AS row_end, max(columns) AS columns FROM g GROUP BY doc_id, page, g""")
def layout_hints(spark, sf_dir):
    start = (F.col("l_partkey") % 40).cast("int")
    return reports.merge_hints(lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), start.alias("row_start"), (start + F.col("l_quantity") % 7).cast("int").alias("row_end"), F.col("l_linenumber").alias("columns")))


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 9 = 0 THEN 0.0 ELSE length(c_mktsegment) / (3.0 + length(c_mktsegment)) END::DOUBLE AS ratio FROM customer")
def layout_width(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    line = F.when(F.col("c_custkey") % 9 == 0, "    ").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit("  ")))
    return c.select(F.col("c_custkey").alias("doc_id"), reports.width_ratio(line).cast("double").alias("ratio"))


@query(f"""WITH {CELLS}, k AS (SELECT doc_id, row FROM cells WHERE table_no = 1 GROUP BY doc_id, row), n(i) AS (VALUES (0), (1)),
m AS (SELECT c_custkey AS doc_id, CAST(4 + i AS INT) AS row, col, CASE col WHEN 0 THEN 'ato ' || i WHEN 1 THEN 'X' ELSE '' END AS text FROM customer CROSS JOIN n CROSS JOIN (VALUES (0), (1), (2)) AS c(col))
SELECT doc_id, 1 AS table_no, row, col, text FROM cells WHERE table_no = 1 AND row < 4 UNION ALL SELECT doc_id, 1, row, col, text FROM m""")
def fill_tables(spark, sf_dir):
    """Two records for the table of responsibilities: one takes its blank row, one is appended."""
    c = cells(spark, sf_dir).where("table_no = 1")
    rec = lambda i: F.create_map(F.lit("Atividades"), F.lit(f"ato {i}"), F.lit("Gerente Setorial"), F.lit("X"))
    records = c.where("row = 0 AND col = 0").select("doc_id", "table_no", F.posexplode(F.array(rec(0), rec(1))).alias("record_no", "rec"))
    return reports.fill_tables(c, records)


@query(f"""WITH {CELLS}, n(table_no, col, t) AS (VALUES (0, 0, '02'), (0, 1, '05/06/2022'), (0, 2, 'Revisão'), (0, 3, ''), (1, 0, 'ato'), (1, 1, 'X'), (1, 2, ''))
SELECT doc_id, table_no, row, col, CASE WHEN row > 0 AND (table_no = 0 AND (doc_id + row) % 4 = 0 OR table_no = 1 AND row = 4) THEN t ELSE text END AS text FROM cells JOIN n USING (table_no, col)
UNION ALL SELECT c_custkey, table_no, 4, col, t FROM customer CROSS JOIN n WHERE table_no = 0 AND c_custkey % 4 = 0""")
def fill_by_specs(spark, sf_dir):
    """Four specs (a revision takes the blank row, or a new one where there is none): one asks for a header that no table has, one for a table that an earlier spec takes, one names the column by its second row."""
    specs = spark.createDataFrame([
        (0, ["Atividades", "Prazo"], [{"Atividades": "never"}]), (1, ["VERSÃO", "Data"], [{"Versão": "02", "Data": "05/06/2022", "Alteração": "Revisão"}]),
        (2, ["Data"], [{"Data": "never"}]), (3, ["Atividades", "Gerente Setorial"], [{"Atividades": "ato", "Gerente Setorial": "X"}])], "spec_no int, headers array<string>, records array<map<string,string>>")
    return reports.fill_by_specs(cells(spark, sf_dir), specs)


@query(f"""WITH {BLOCKS}, m AS (SELECT *, trim(text) <> '' AS has_text, lag(CASE WHEN text = '1. OBJETIVO' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS first FROM blocks),
a AS (SELECT *, max(CASE WHEN first = 1 THEN idx END) OVER (PARTITION BY doc_id ORDER BY idx) AS anchor, max(CASE WHEN has_text AND coalesce(first, 0) = 0 THEN idx END) OVER (PARTITION BY doc_id ORDER BY idx) AS told FROM m)
SELECT doc_id, idx, text FROM a WHERE has_text OR first = 1 OR anchor IS NULL OR told > anchor""")
def prune_empties(spark, sf_dir):
    """What follows the heading of the first section was filled; blank paragraphs behind it go."""
    b = blocks(spark, sf_dir)
    return reports.prune_empties(b, b.where("text = '1. OBJETIVO'").select("doc_id", (F.col("idx") + 1).alias("idx"))).select("doc_id", "idx", "text")
