"""Registered queries over the derived corpora, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, validators
from ..operators import conformity, fields, layout, numbering, placeholders, security, sections, tables
from ..sources.forms import FORMS_SQL, LINES_SQL, SECTIONS_SQL, forms, in_sql, lines, sectioned

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

LINES = f"lines AS ({in_sql(LINES_SQL)})"
FORMS, SECTIONED = f"forms AS ({in_sql(FORMS_SQL)})", f"sectioned AS ({in_sql(SECTIONS_SQL)})"
PATTERNS = {"codigo": r"(?i)(?:Codigo|Code):\s*([A-Z]+-\d+(?:-\d+)*)", "data": r"(?i)(?:Data):\s*(\d{4}-\d{2}-\d{2})",
            "cliente": r"(?i)(?:Cliente):\s*([^\n]+)", "valor": r"(?i)(?:Valor):\s*(\d+)", "status": r"(?i)(?:Status):\s*([A-Z])"}
SCHEMA = [("codigo", "doc_code", True), ("data", "iso_date", True), ("cliente", "freetext", True), ("valor", "integer", True), ("status", "freetext", False)]
REQUIRED = [f for f, _, r in SCHEMA if r]
TARGETS = ["OBJETIVO", "APLICACAO", "DEFINICOES", "RESPONSABILIDADE", "HISTORICO"]
TEMPLATE = "LAUDO\nCodigo: {{CODIGO}}\nData: {{DATA}}\nCliente: {{CLIENTE}}\nValor: {{VALOR}}"
TOKENS = {"{{CODIGO}}": "codigo", "{{DATA}}": "data", "{{CLIENTE}}": "cliente", "{{VALOR}}": "valor"}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f
    return register


def _pick(field: str) -> str:
    return f"nullif(trim(regexp_extract(text, '{PATTERNS[field]}', 1)), '')"


WIDE = f"wide AS MATERIALIZED (SELECT doc_id, text, {', '.join(f'{_pick(f)} AS {f}' for f in PATTERNS)} FROM forms)"
LONG = "mapping AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT doc_id, '{f}' AS field, {f} AS value, CASE WHEN {f} IS NULL THEN 'missing' ELSE 'regex' END AS source, CASE WHEN {f} IS NULL THEN 0.0 ELSE 1.0 END AS confidence FROM wide" for f in PATTERNS) + ")"
TIERS = ("tiers AS (SELECT doc_id, CASE WHEN bool_or(source = 'missing' AND field IN ('codigo', 'data', 'cliente', 'valor')) THEN 'low' WHEN bool_or(source = 'llm') THEN 'medium' ELSE 'high' END AS tier FROM mapping GROUP BY doc_id)")
BASE = f"WITH {FORMS}, {WIDE}, {LONG}, {TIERS} "


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.extract_wide(forms(spark, sf_dir), PATTERNS)


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.mapping_long(_wide(spark, sf_dir), list(PATTERNS))


@query(BASE + "SELECT doc_id, codigo, data, cliente, valor, status FROM wide")
def field_extract_wide(spark, sf_dir):
    return _wide(spark, sf_dir).drop("text")


@query(BASE + "SELECT doc_id, field, value, source, CAST(confidence AS DOUBLE) AS confidence FROM mapping")
def mapping_long(spark, sf_dir):
    return _mapping(spark, sf_dir)


@query(BASE + """, asked AS (SELECT *, CASE WHEN field IN ('codigo', 'data') AND doc_id % 2 = 0 THEN upper(field) END AS answer FROM mapping)
SELECT doc_id, field, coalesce(value, answer) AS value, CASE WHEN value IS NOT NULL THEN 'regex' WHEN answer IS NULL THEN 'missing' ELSE 'llm' END AS source,
       CASE WHEN value IS NOT NULL THEN 1.0 WHEN answer IS NULL THEN 0.0 ELSE least(1.0, 0.5 + (doc_id % 10) / 10.0) END::DOUBLE AS confidence FROM asked""")
def mapping_with_answers(spark, sf_dir):
    """A table of answers stands in for the remote provider and fills what the patterns missed."""
    answers = forms(spark, sf_dir).select("doc_id", F.explode(F.array(F.lit("codigo"), F.lit("data"))).alias("field")).select(
        "doc_id", "field", F.when(F.col("doc_id") % 2 == 0, F.upper("field")).otherwise(" ").alias("answer"), (0.5 + (F.col("doc_id") % 10) / 10.0).alias("answer_confidence"))
    return fields.mapping_long(_wide(spark, sf_dir), list(PATTERNS), answers)


@query(BASE + """SELECT doc_id, count(*) AS total, count(*) FILTER (source = 'regex') AS n_regex, count(*) FILTER (source = 'llm') AS n_llm,
       count(*) FILTER (source = 'missing') AS n_missing, round(CAST(avg(confidence) AS DOUBLE), 3) AS average_confidence FROM mapping GROUP BY doc_id""")
def mapping_summary(spark, sf_dir):
    return fields.mapping_summary(_mapping(spark, sf_dir))


@query(BASE + "SELECT doc_id, tier FROM tiers")
def tier_by_doc(spark, sf_dir):
    return fields.tier_by_doc(_mapping(spark, sf_dir), REQUIRED)


@query(BASE + "SELECT t.tier, count(tiers.doc_id) AS n FROM (VALUES ('high'), ('medium'), ('low'), ('error')) AS t(tier) LEFT JOIN tiers ON tiers.tier = t.tier GROUP BY t.tier")
def tier_counts(spark, sf_dir):
    return fields.tier_counts(fields.tier_by_doc(_mapping(spark, sf_dir), REQUIRED))


@query(BASE + "SELECT count(*) AS n_docs, sum(CASE WHEN missing > 0 THEN 1 ELSE 0 END) AS mapping_calls, 5 + sum(CASE WHEN missing > 0 THEN 1 ELSE 0 END) AS llm_call_estimate FROM (SELECT doc_id, count(*) FILTER (source = 'missing') AS missing FROM mapping GROUP BY doc_id)")
def llm_call_estimate(spark, sf_dir):
    by = fields.mapping_summary(_mapping(spark, sf_dir))
    calls = F.count_if(F.col("n_missing") > 0)
    return by.agg(F.count(F.lit(1)).alias("n_docs"), calls.alias("mapping_calls"), (F.lit(len(SCHEMA)) + calls).alias("llm_call_estimate"))


@query(BASE + "SELECT doc_id, concat('LAUDO', chr(10), 'Codigo: ', coalesce(codigo, ''), chr(10), 'Data: ', coalesce(data, ''), chr(10), 'Cliente: ', coalesce(cliente, ''), chr(10), 'Valor: ', coalesce(valor, '')) AS text FROM wide")
def render_template(spark, sf_dir):
    return fields.render(TEMPLATE, _wide(spark, sf_dir), TOKENS)


@query(f"""WITH {FORMS} SELECT doc_id, kind, name, token FROM (
  SELECT doc_id, 'mustache' AS kind, 'CODIGO' AS name, '{{{{CODIGO}}}}' AS token FROM forms WHERE contains(text, '{{{{CODIGO}}}}')
  UNION ALL SELECT doc_id, 'bracket', 'DATA', '[DATA]' FROM forms WHERE contains(text, '[DATA]')
  UNION ALL SELECT doc_id, 'anon_blank', 'BLANK_1', '____' FROM forms WHERE contains(text, '____'))""")
def placeholder_scan(spark, sf_dir):
    return placeholders.placeholder_scan(forms(spark, sf_dir)).select("doc_id", "kind", "name", "token")


_ORPHANS = r"regexp_extract_all(text, '\{\{\s*[A-Za-z_][A-Za-z0-9_.\-]*\s*\}\}|<<\s*[A-Za-z_][A-Za-z0-9_.\-]*\s*>>|__[A-Za-z][A-Za-z0-9_.\-]*__|\{\s*[A-Za-z_][A-Za-z0-9_.\-]*\s*\}|\[\s*[A-Za-z_][A-Za-z0-9_.\-]*\s*\]|_{3,}')"


@query(f"WITH {FORMS} SELECT doc_id, len(t) AS n_orphans, array_to_string(list_sort(list_distinct(t))[1:5], ', ') AS tokens FROM (SELECT doc_id, {_ORPHANS} AS t FROM forms) WHERE len(t) > 0")
def orphan_placeholders(spark, sf_dir):
    return placeholders.orphan_summary(forms(spark, sf_dir))


def _golds(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All forms as gold texts, with their codes, dates and customers as examples."""
    gold = forms(spark, sf_dir).withColumn("gold_no", (F.col("doc_id") - 1).cast("int")).select("gold_no", "text", "doc_id")
    wide = fields.extract_wide(gold, PATTERNS)
    examples = wide.select("gold_no", F.explode(F.create_map(F.lit("codigo"), "codigo", F.lit("data"), "data", F.lit("cliente"), "cliente", F.lit("status"), "status")).alias("field", "example"))
    return gold.select("gold_no", "text"), examples.where("example IS NOT NULL").select("field", F.col("gold_no").alias("example_no"), "example")


_LABELS = r""", g AS (SELECT CAST(doc_id - 1 AS INT) AS no, * FROM wide),
ex AS (SELECT 'codigo' AS field, no, codigo AS example, text FROM g UNION ALL SELECT 'data', no, data, text FROM g UNION ALL SELECT 'cliente', no, cliente, text FROM g UNION ALL SELECT 'status', no, status, text FROM g),
gx AS (SELECT * FROM ex WHERE example IS NOT NULL),
met AS (SELECT e.field || '' AS field, e.no, g.no AS gold, e.example || '' AS example, g.text || '' AS text FROM gx e JOIN g ON e.no = g.no),
hit AS (SELECT * FROM (SELECT field, no, gold, regexp_extract(text, '(?:^|\n)([^\n:]*): ' || regexp_escape(example) || '(?:\n|$)', 1) AS label FROM met) WHERE label <> ''),
l AS (SELECT field, label, count(*) AS n, min((no, gold)) AS first FROM hit GROUP BY field, label)
"""


@query(BASE + _LABELS + "SELECT field, label, n, rank FROM (SELECT field, label, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, first) AS rank FROM l) WHERE rank <= 6")
def label_rank_topk(spark, sf_dir):
    return fields.label_rank(fields.example_labels(*_golds(spark, sf_dir)))


@query(BASE + _LABELS + r"""SELECT field, CASE WHEN bool_and(regexp_full_match(example, '\d{4}-\d{2}-\d{2}')) THEN 'iso_date' WHEN bool_and(regexp_full_match(example, '\d{2}/\d{2}/\d{4}')) THEN 'br_date'
  WHEN bool_and(regexp_full_match(example, '[A-Z]+-\d+(?:-\d+)*')) THEN 'doc_code' WHEN bool_and(regexp_full_match(example, '[A-Z]{2}')) THEN 'uf' WHEN bool_and(regexp_full_match(example, '\d+')) THEN 'integer' ELSE 'freetext' END AS shape,
  count(*) AS n_examples FROM gx GROUP BY field""")
def shape_detect_all_match(spark, sf_dir):
    return fields.shape_detection(_golds(spark, sf_dir)[1])


@query(BASE + _LABELS + r""", p(field, re) AS (VALUES ('codigo', '(?i)(?:Codigo):\s*([A-Z]+-\d+(?:-\d+)*)'), ('data', '(?i)(?:Data):\s*(\d{4}-\d{2}-\d{2})'), ('cliente', '(?i)(?:Client):\s*([^\n]+)')),
v AS (SELECT DISTINCT p.field, unnest(CASE p.field WHEN 'codigo' THEN regexp_extract_all(text, '(?i)(?:Codigo):\s*([A-Z]+-\d+(?:-\d+)*)', 1) WHEN 'data' THEN regexp_extract_all(text, '(?i)(?:Data):\s*(\d{4}-\d{2}-\d{2})', 1) ELSE regexp_extract_all(text, '(?i)(?:Client):\s*([^\n]+)', 1) END) AS value FROM p CROSS JOIN g)
SELECT gx.field, round(avg(CASE WHEN v.value IS NULL THEN 0.0 ELSE 1.0 END), 3) AS coverage FROM gx LEFT JOIN v ON v.field = gx.field AND v.value = gx.example GROUP BY gx.field""")
def pattern_coverage(spark, sf_dir):
    golds, examples = _golds(spark, sf_dir)
    return fields.pattern_coverage(golds, examples, {"codigo": r"(?i)(?:Codigo):\s*([A-Z]+-\d+(?:-\d+)*)", "data": PATTERNS["data"], "cliente": r"(?i)(?:Client):\s*([^\n]+)"})


_CPF = "lpad(CAST(c_custkey * 7919 % 1000000000 AS STRING), 9, '0')"


@query(f"""WITH c AS (SELECT c_custkey, {_CPF} AS n FROM customer),
d AS (SELECT c_custkey, n, list_transform(range(1, 10), lambda i: CAST(n[i] AS INT)) AS x FROM c),
a AS (SELECT *, (list_sum(list_transform(range(1, 10), lambda i: x[i] * (11 - i))) * 10 % 11) % 10 AS k1 FROM d),
b AS (SELECT *, ((list_sum(list_transform(range(1, 10), lambda i: x[i] * (12 - i))) + k1 * 2) * 10 % 11) % 10 AS k2 FROM a),
v AS (SELECT c_custkey, n, k1, k2, n || CAST(CAST(CASE WHEN c_custkey % 3 = 0 THEN k1 ELSE c_custkey % 10 END AS INT) AS STRING) || CAST(CAST(CASE WHEN c_custkey % 3 = 0 THEN k2 ELSE c_custkey % 7 END AS INT) AS STRING) AS cpf FROM b)
SELECT c_custkey AS doc_id, cpf[:3] || '.' || cpf[4:6] || '.' || cpf[7:9] || '-' || cpf[10:] AS cpf,
       cpf = n || CAST(CAST(k1 AS INT) AS STRING) || CAST(CAST(k2 AS INT) AS STRING) AND len(list_distinct(string_split(cpf, ''))) > 1 AS valid FROM v""")
def validate_cpf(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.expr(_CPF).alias("n"))
    digit = lambda i: F.substring("n", i + 1, 1).cast("int")
    c = c.withColumn("k1", sum((digit(i) * (10 - i) for i in range(1, 9)), digit(0) * 10) * 10 % 11 % 10)
    c = c.withColumn("k2", (sum((digit(i) * (11 - i) for i in range(1, 9)), digit(0) * 11) + F.col("k1") * 2) * 10 % 11 % 10)
    third = F.col("c_custkey") % 3 == 0
    cpf = F.concat("n", F.when(third, F.col("k1")).otherwise(F.col("c_custkey") % 10).cast("int").cast("string"), F.when(third, F.col("k2")).otherwise(F.col("c_custkey") % 7).cast("int").cast("string"))
    shown = F.regexp_replace(cpf, r"^(\d{3})(\d{3})(\d{3})(\d{2})$", "$1.$2.$3-$4")
    return c.select(F.col("c_custkey").alias("doc_id"), shown.alias("cpf")).withColumn("valid", validators.valid_cpf(F.col("cpf")))


@query(BASE + r"""SELECT doc_id, d AS value, regexp_full_match(d, '\d{4}-\d{2}-\d{2}') AND try_cast(d AS DATE) IS NOT NULL AS iso_ok,
  try_strptime(b, '%d/%m/%Y') IS NOT NULL AS br_ok FROM (SELECT doc_id, trim(regexp_extract(text, 'Data: ([^\n]*)', 1)) AS d,
  lpad(CAST(doc_id % 33 AS STRING), 2, '0') || '/' || lpad(CAST(doc_id % 14 AS STRING), 2, '0') || '/2023' AS b FROM forms)""")
def validate_dates(spark, sf_dir):
    rows = forms(spark, sf_dir).select("doc_id", F.trim(F.regexp_extract("text", r"Data: ([^\n]*)", 1)).alias("value"),
                                       F.concat(F.lpad((F.col("doc_id") % 33).cast("string"), 2, "0"), F.lit("/"), F.lpad((F.col("doc_id") % 14).cast("string"), 2, "0"), F.lit("/2023")).alias("_b"))
    return rows.select("doc_id", "value", validators.valid_iso_date(F.col("value")).alias("iso_ok"), validators.valid_br_date(F.col("_b")).alias("br_ok"))


@query("""SELECT c_custkey AS doc_id, c_custkey % 5 <> 0 AS email_ok, c_custkey % 4 <> 0 AS phone_ok, upper(substr(c_mktsegment, 1, 2)) IN ('AC','AL','AM','AP','BA','CE','DF','ES','GO','MA','MG','MS','MT','PA','PB','PE','PI','PR','RJ','RN','RO','RR','RS','SC','SE','SP','TO') AS uf_ok,
  len(regexp_replace(CAST(10000000 + c_custkey AS STRING) || CASE WHEN c_custkey % 3 = 0 THEN '1' ELSE '' END, '[^0-9]', '', 'g')) = 8 AS cep_ok FROM customer""")
def validate_contact(spark, sf_dir):
    c, key = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey")
    return c.select(key.alias("doc_id"), validators.valid_email(F.concat(F.lit(" c"), key, F.when(key % 5 == 0, "#x.com").otherwise("@x.com "))).alias("email_ok"),
                    validators.valid_phone_br(F.concat(F.lit("(81) 9"), F.when(key % 4 == 0, "999-12").otherwise("9999-1234"))).alias("phone_ok"),
                    validators.valid_state(F.left("c_mktsegment", F.lit(2))).alias("uf_ok"),
                    validators.valid_cep(F.concat((key + 10000000).cast("string"), F.when(key % 3 == 0, "-1").otherwise("-"))).alias("cep_ok"))


_FAILURES = f"""failures AS (
  SELECT doc_id, 'technical' AS dimension, field AS field_or_excerpt, 'filled' AS expected, 'missing' AS actual, 'critical' AS severity, 'required field not extracted' AS note FROM mapping WHERE source = 'missing' AND field IN ('codigo', 'data', 'cliente', 'valor')
  UNION ALL SELECT doc_id, 'technical', 'data', 'valid iso_date', value, 'critical', 'format validator rejected value' FROM mapping WHERE field = 'data' AND value IS NOT NULL AND try_cast(value AS DATE) IS NULL
  UNION ALL SELECT doc_id, 'technical', 'orphan_placeholders', '0', CAST(len(t) AS STRING), 'critical', 'unsubstituted tokens: ' || array_to_string(list_sort(list_distinct(t))[1:5], ', ') FROM (SELECT doc_id, {_ORPHANS} AS t FROM forms) WHERE len(t) > 0)"""


def _technical(spark, sf_dir):
    return conformity.technical_failures(_mapping(spark, sf_dir), SCHEMA, forms(spark, sf_dir))


@query(BASE + f", {_FAILURES} SELECT * FROM failures")
def technical_failures(spark, sf_dir):
    return _technical(spark, sf_dir)


_METRICS = LINES + """, m AS (
  SELECT l_orderkey AS doc_id, 'headings_h' || CAST(l_linenumber AS STRING) AS metric, CAST(count(*) AS BIGINT) AS n FROM lines WHERE l_linenumber <= 3 GROUP BY ALL
  UNION ALL SELECT l_orderkey, 'tables_count', count(*) FILTER (l_returnflag = 'R') FROM lines GROUP BY ALL
  UNION ALL SELECT l_orderkey, 'table_cells_total', CAST(sum(CAST(l_quantity AS BIGINT) % 10) AS BIGINT) FROM lines GROUP BY ALL
  UNION ALL SELECT l_orderkey, 'sections_count', count(*) FILTER (l_linenumber <= 3) FROM lines GROUP BY ALL
  UNION ALL SELECT l_orderkey, 'list_paragraphs', count(*) FILTER (l_linestatus = 'O') FROM lines GROUP BY ALL),
t(metric, e) AS (VALUES ('headings_h1', 1), ('headings_h2', 1), ('headings_h4', 2), ('tables_count', 1), ('table_cells_total', 20), ('sections_count', 3), ('list_paragraphs', 2)),
w AS (SELECT doc_id, metric, e FROM (SELECT DISTINCT l_orderkey AS doc_id FROM lines) CROSS JOIN t),
structural AS (
  SELECT doc_id, 'structural' AS dimension, metric AS field_or_excerpt, CAST(coalesce(e, 0) AS STRING) AS expected, CAST(coalesce(n, 0) AS STRING) AS actual,
    CASE WHEN abs(coalesce(e, 0) - coalesce(n, 0)) > CASE metric WHEN 'tables_count' THEN 0 WHEN 'table_cells_total' THEN 4 WHEN 'sections_count' THEN 0 WHEN 'list_paragraphs' THEN 2 ELSE 1 END THEN 'critical' ELSE 'warning' END AS severity,
    'count differs by ' || CAST(abs(coalesce(e, 0) - coalesce(n, 0)) AS STRING) AS note
  FROM w FULL JOIN m USING (doc_id, metric) WHERE coalesce(e, 0) <> coalesce(n, 0))"""


def _blocks(spark, sf_dir) -> DataFrame:
    """Order lines as document blocks."""
    return lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber")).alias("level"), (F.col("l_linestatus") == "O").alias("is_list"),
        (F.col("l_returnflag") == "R").alias("is_table"), (F.col("l_quantity").cast("long") % 10).alias("cells"))


def _structural(spark, sf_dir) -> DataFrame:
    template = spark.createDataFrame([("headings_h1", 1), ("headings_h2", 1), ("headings_h4", 2), ("tables_count", 1), ("table_cells_total", 20), ("sections_count", 3), ("list_paragraphs", 2)], "metric string, n long")
    return conformity.structural_failures(template, conformity.fingerprints(_blocks(spark, sf_dir)))


@query(f"WITH {_METRICS} SELECT * FROM structural")
def structural_diff(spark, sf_dir):
    return _structural(spark, sf_dir)


@query(f"WITH {_METRICS.split('t(metric')[0].rstrip().rstrip(',')} SELECT * FROM m")
def structural_fingerprint(spark, sf_dir):
    return conformity.fingerprint(_blocks(spark, sf_dir))


_SCORES = f"""scores AS (
  SELECT d.doc_id, x.dimension, x.skipped, CASE WHEN x.skipped THEN 'no provider' END AS skip_reason,
    CASE WHEN x.skipped THEN 1.0 ELSE CAST(greatest(0.0, least(1.0, 1.0 - coalesce(w, 0.0) / 4.0)) AS DOUBLE) END AS score, coalesce(c, 0) AS n_critical
  FROM (SELECT DISTINCT doc_id FROM forms) d CROSS JOIN (VALUES ('technical', false), ('structural', false), ('text', true), ('design', true)) AS x(dimension, skipped)
  LEFT JOIN (SELECT doc_id, dimension, CAST(sum(CASE WHEN severity = 'critical' THEN 1.0 ELSE 0.4 END) AS DOUBLE) AS w, count(*) FILTER (severity = 'critical') AS c
             FROM (SELECT doc_id, dimension, severity FROM failures UNION ALL SELECT doc_id, dimension, severity FROM structural) GROUP BY doc_id, dimension) f
    ON f.doc_id = d.doc_id AND f.dimension = x.dimension)"""


def _scores(spark, sf_dir):
    docs = forms(spark, sf_dir).select("doc_id")
    bad = _technical(spark, sf_dir).unionByName(_structural(spark, sf_dir))
    return conformity.dimension_scores(docs, bad, ["technical", "structural"], {"text": "no provider", "design": "no provider"})


@query(BASE + f", {_FAILURES}, {_METRICS}, {_SCORES} SELECT doc_id, dimension, round(score, 6) AS score, skipped, skip_reason, n_critical FROM scores")
def dimension_scores(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(BASE + f""", {_FAILURES}, {_METRICS}, {_SCORES}
SELECT doc_id, round(sum(score * w) / sum(w), 4) AS score, CAST(sum(n_critical) AS BIGINT) AS n_critical, round(sum(score * w) / sum(w), 4) >= 0.85 AND sum(n_critical) = 0 AS conforms
FROM (SELECT *, CASE dimension WHEN 'technical' THEN 0.2::DOUBLE WHEN 'structural' THEN 0.2::DOUBLE WHEN 'text' THEN 0.3::DOUBLE ELSE 0.15::DOUBLE END AS w FROM scores) GROUP BY doc_id""")
def conformity_verdict(spark, sf_dir):
    return conformity.verdicts(_scores(spark, sf_dir))


@query(f"WITH {_METRICS} SELECT doc_id, field_or_excerpt, severity FROM structural WHERE severity = 'critical'")
def severity_filter(spark, sf_dir):
    return conformity.severity_filter(_structural(spark, sf_dir), "critical").select("doc_id", "field_or_excerpt", "severity")


@query(f"WITH {LINES} " + "SELECT l_orderkey AS doc_id, score, CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.7 THEN 'medium' ELSE 'low' END AS label FROM (SELECT l_orderkey, round(0.6 * count(*) FILTER (l_returnflag <> 'R') / count(*) + 0.4 * count(*) FILTER (l_linestatus = 'F') / count(*), 3) AS score FROM lines GROUP BY l_orderkey)")
def confidence_label(spark, sf_dir):
    n = lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count_if(F.col("l_returnflag") != "R").alias("a"), F.count_if(F.col("l_linestatus") == "F").alias("b"), F.count(F.lit(1)).alias("n"))
    score = fields.confidence(F.col("a"), F.col("n"), F.col("b"), F.col("n"))
    return n.select("doc_id", score.alias("score"), fields.confidence_label(score).alias("label"))


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '\b[\w.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS email FROM documents")
def pii_email_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(dict(security.DETECTORS)["EMAIL"]), 0)).alias("email"))


_MASKED = r"""masked AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '\b\d{3}\.\d{3}\.\d{3}-\d{2}\b', '<CPF_001>'), '\bc\d+@example\.com\b', '<EMAIL_001>'), '\(\d{2}\)\s?9?\d{4,5}-\d{4}', '<PHONE_001>') AS masked FROM forms)"""


@query(f"WITH {FORMS}, {_MASKED} SELECT doc_id, masked FROM masked")
def pii_mask(spark, sf_dir):
    return security.mask_pii(forms(spark, sf_dir)).drop("mask")


@query(f"WITH {FORMS} SELECT doc_id, text FROM forms")
def pii_roundtrip(spark, sf_dir):
    return security.unmask(security.mask_pii(forms(spark, sf_dir)))


@query(f"WITH {FORMS}, {_MASKED} SELECT doc_id, unnest(['CPF', 'EMAIL', 'PHONE']) AS type, 1 AS n FROM masked WHERE contains(masked, '<CPF_001>')")
def pii_counts(spark, sf_dir):
    return security.pii_counts(security.mask_pii(forms(spark, sf_dir)))


@query(f"""WITH {FORMS} SELECT doc_id, 'ignore_instructions' AS rule, 'ignore all previous instructions' AS snippet, strpos(text, 'ignore all') - 1 AS position FROM forms WHERE contains(text, 'ignore all')
UNION ALL SELECT doc_id, 'force_response', 'print only "ok"', strpos(text, 'print only') - 1 FROM forms WHERE contains(text, 'print only')""")
def injection_hits(spark, sf_dir):
    return security.injection_hits(forms(spark, sf_dir))


@query("SELECT TIMESTAMP '2026-01-01 00:00:00' AS ts, 'extracted' AS event, sha256(text) AS doc_hash, source FROM documents")
def audit_hash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return security.audit_events(docs, "extracted", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"), source=F.col("source")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_ACCENT = "regexp_replace(upper(trim(regexp_replace(strip_accents({0}), '[^A-Za-z0-9 ]+', ' ', 'g'))), ' +', ' ', 'g')"
_SECTIONS = r"""ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM sectioned),
hd AS (SELECT *, trim(line) AS t, regexp_extract(trim(line), '^(\d+(?:\.\d+)*)\.?\s+[A-Z]', 1) AS num FROM ln),
hh AS (SELECT *, CASE WHEN num <> '' AND regexp_full_match(t, '\d+(?:\.\d+)*\.?\s+[A-Z][A-Za-z\s\-/:&,()]{2,80}') THEN 'n'
  WHEN regexp_full_match(t, '[A-Z][A-Z\s\-/&]{2,80}') AND (contains(t, ' ') OR len(t) >= 5) THEN 'c' END AS kind FROM hd),
sq AS (SELECT *, sum(CASE WHEN kind IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM hh),
sections AS (SELECT doc_id, CAST(seq AS INT) AS seq, max(CASE WHEN kind = 'n' THEN upper(regexp_extract(t, '^\d+(?:\.\d+)*\.?\s+(.*)$', 1)) WHEN kind = 'c' THEN t END) AS name,
  max(CASE WHEN kind IS NOT NULL THEN t END) AS raw_heading, max(CASE WHEN kind = 'n' THEN num END) AS number,
  CAST(max(CASE WHEN kind = 'n' THEN len(num) - len(replace(num, '.', '')) + 1 WHEN kind = 'c' THEN 1 END) AS INT) AS level,
  trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kind IS NULL), '')) AS content FROM sq WHERE seq > 0 GROUP BY doc_id, seq),
rich AS (SELECT * FROM (SELECT *, min(seq) OVER (PARTITION BY doc_id, name) AS place, row_number() OVER (PARTITION BY doc_id, name ORDER BY len(content) DESC, seq) AS r FROM sections) WHERE r = 1)"""


def _deduped(spark, sf_dir):
    return sections.dedupe_richest(sections.split_sections(sectioned(spark, sf_dir)))


@query(f"WITH {SECTIONED}, {_SECTIONS} SELECT * FROM sections")
def section_split(spark, sf_dir):
    return sections.split_sections(sectioned(spark, sf_dir))


@query(f"WITH {SECTIONED}, {_SECTIONS} SELECT doc_id, place, name, content FROM rich")
def dedupe_richest(spark, sf_dir):
    return _deduped(spark, sf_dir).select("doc_id", "place", "name", "content")


_MATCHES = """canon(name, target, score, method) AS (VALUES ('CAPA DO DOCUMENTO', NULL, 0.0, 'miss'), ('OBJETIVO', 'OBJETIVO', 1.0, 'exact'), ('ESCOPO', 'APLICACAO', 1.0, 'synonym'), ('CAMPO DE APLICACAO', 'APLICACAO', 0.5, 'token'),
  ('APLICACAO', 'APLICACAO', 1.0, 'exact'), ('DEFINICOES E SIGLAS', 'DEFINICOES', 1.0, 'synonym'), ('MATRIZ DE RESPONSABILIDADES', 'RESPONSABILIDADE', 1.0, 'synonym'), ('HISTORICO DAS REVISOES', 'HISTORICO', 0.5, 'token')),
matches AS (SELECT doc_id, seq, rich.name AS source_name, target AS target_name, CAST(score AS DOUBLE) AS score, method FROM rich LEFT JOIN canon ON canon.name = rich.name)"""


def _matches(spark, sf_dir):
    return sections.match_headings(_deduped(spark, sf_dir), TARGETS)


@query(f"WITH {SECTIONED}, {_SECTIONS}, {_MATCHES} SELECT * FROM matches WHERE method IN ('exact', 'synonym')")
def heading_match_exact_synonym(spark, sf_dir):
    return _matches(spark, sf_dir).where("method IN ('exact', 'synonym')")


@query(f"WITH {SECTIONED}, {_SECTIONS}, {_MATCHES} SELECT * FROM matches WHERE method IN ('token', 'miss')")
def heading_match_jaccard(spark, sf_dir):
    return _matches(spark, sf_dir).where("method IN ('token', 'miss')")


_TRIM = "trim(regexp_extract(content || chr(10) || 'FORM.', '(?s)^(.*?)\\s*FORM\\.', 1))"


@query(f"WITH {SECTIONED}, {_SECTIONS} SELECT doc_id, seq, {_TRIM} AS content FROM sections")
def footer_trim(spark, sf_dir):
    return sections.split_sections(sectioned(spark, sf_dir)).select("doc_id", "seq", sections.trim_at_footer(F.col("content")).alias("content"))


@query(f"""WITH {SECTIONED}, {_SECTIONS}, {_MATCHES}, c AS (SELECT doc_id, target_name, seq, {_TRIM} AS part FROM rich JOIN matches USING (doc_id, seq) WHERE target_name IS NOT NULL)
SELECT doc_id, target_name, string_agg(part, chr(10) || chr(10) ORDER BY seq) AS content FROM c WHERE part <> '' GROUP BY doc_id, target_name""")
def content_map(spark, sf_dir):
    return sections.content_map(_deduped(spark, sf_dir), _matches(spark, sf_dir))


@query(f"WITH {SECTIONED}, {_SECTIONS}, {_MATCHES} SELECT doc_id, count(DISTINCT target_name) / 5.0::DOUBLE AS coverage FROM matches GROUP BY doc_id")
def section_coverage(spark, sf_dir):
    return sections.coverage(_matches(spark, sf_dir), TARGETS)


@query("""WITH t AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
m AS (SELECT a.vec_id AS source_id, b.vec_id AS target_id, list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / (a.n * b.n) AS s FROM t a JOIN t b ON b.vec_id < 20 AND a.vec_id >= 20)
SELECT source_id, target_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY round(s, 9) DESC, target_id) AS r FROM m) WHERE r = 1 AND s >= 0.1""")
def embedding_match(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = sections.match_vectors(e.where("vec_id >= 20").select(F.col("vec_id").alias("source_id"), F.col("embedding").alias("vector")),
                                   e.where("vec_id < 20").select(F.col("vec_id").alias("target_id"), F.col("embedding").alias("vector")), least=0.1)
    return found.withColumn("score", F.round("score", 6))


LEVELS = [(1, 0, "decimal", "%1.", 1), (1, 1, "lowerLetter", "%1.%2)", 1), (1, 2, "upperRoman", "%3", 1)]


@query(f"WITH {LINES}, " + """b AS (SELECT l_orderkey AS doc_id, l_linenumber AS idx, CAST(l_partkey % 3 AS INT) AS ilvl FROM lines),
g AS (SELECT *, sum(CASE WHEN ilvl < 1 THEN 1 ELSE 0 END) OVER w AS g1, sum(CASE WHEN ilvl < 2 THEN 1 ELSE 0 END) OVER w AS g2, sum(CASE WHEN ilvl = 0 THEN 1 ELSE 0 END) OVER w AS c0 FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
c AS (SELECT *, sum(CASE WHEN ilvl = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, g1 ORDER BY idx) AS c1, sum(CASE WHEN ilvl = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, g2 ORDER BY idx) AS c2 FROM g)
SELECT doc_id, idx, CASE ilvl WHEN 0 THEN CAST(greatest(1, c0) AS STRING) || '.' WHEN 1 THEN CAST(greatest(1, c0) AS STRING) || '.' || chr(CAST(96 + greatest(1, c1) AS INT)) || ')'
  ELSE ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII', 'XIII', 'XIV', 'XV'][CAST(greatest(1, c2) AS INT)] END AS marker FROM c""")
def numbering_markers(spark, sf_dir):
    b = lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("idx"), F.lit(1).alias("num_id"), (F.col("l_partkey") % 3).cast("int").alias("ilvl"))
    return numbering.numbering_markers(b, spark.createDataFrame(LEVELS, "num_id int, ilvl int, num_fmt string, lvl_text string, start int"))


@query("SELECT s_suppkey AS table_id, CASE CAST(s_suppkey % 5 AS INT) WHEN 0 THEN 'contact_list' WHEN 1 THEN 'revision_table' WHEN 2 THEN 'participant_table' WHEN 3 THEN 'signature_box' END AS schema FROM supplier")
def schema_detect(spark, sf_dir):
    heads = [["Nº", "NOME", "Fone", "E-mail"], ["Version", "DATE", "Mudanças", "Solicitante"], ["Name", "Departamento", "Cargo"], ["Activity", "Data", "Nome", "Função"], ["Nome", "Setor"]]
    key = (F.col("s_suppkey") % 5).cast("int")
    t = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("table_id"), F.get(F.array(*[F.array(*map(F.lit, h)) for h in heads]), key).alias("headers"))
    return tables.schema_detect(t).drop("headers")


_INVENTORY = LINES + ", inv AS (SELECT l_orderkey AS table_no, l_linenumber AS row, [l_returnflag <> 'N', l_linestatus = 'O'] AS fillable FROM lines)"


@query(f"""WITH {_INVENTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY table_no ORDER BY row) AS k FROM inv WHERE fillable[1] OR fillable[2]),
rec AS (SELECT o_orderkey AS table_no, unnest([1, 2, 3]) AS k, o_orderstatus, o_orderpriority FROM orders)
SELECT table_no, row, 0 AS col, o_orderstatus || CAST(k AS STRING) AS value FROM r JOIN rec USING (table_no, k) WHERE fillable[1]
UNION ALL SELECT table_no, row, 1, o_orderpriority FROM r JOIN rec USING (table_no, k) WHERE fillable[2] AND k <> 2""")
def record_align(spark, sf_dir):
    inventory = lines(spark, sf_dir).select(F.col("l_orderkey").alias("table_no"), F.col("l_linenumber").alias("row"), F.array(F.col("l_returnflag") != "N", F.col("l_linestatus") == "O").alias("cell_fillable"))
    records = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("table_no"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("record_no"), "o_orderstatus", "o_orderpriority")
    records = records.select("table_no", "record_no", F.create_map(F.lit("Nome"), F.concat("o_orderstatus", F.col("record_no").cast("string")), F.lit("Setor"), F.when(F.col("record_no") == 2, "").otherwise(F.col("o_orderpriority"))).alias("rec"))
    return tables.align_records(inventory, records, ["Nome", "Setor"])


@query(f"WITH {LINES}, " + """c AS (SELECT l_orderkey AS table_no, l_linenumber AS row, unnest([0, 1]) AS col FROM lines)
SELECT table_no, row, col, CASE WHEN col = 0 AND row % 2 = 0 THEN '01/02/2023' WHEN col = 1 AND row % 3 = 0 THEN 'Ana' ELSE 'old' END AS text, (col = 0 AND row % 2 = 0) OR (col = 1 AND row % 3 = 0) AS filled FROM c""")
def typed_fill(spark, sf_dir):
    cells = lines(spark, sf_dir).select(F.col("l_orderkey").alias("table_no"), F.col("l_linenumber").alias("row"), F.explode(F.array(F.lit(0), F.lit(1))).alias("col")).withColumn("text", F.lit("old"))
    value = F.when(F.col("col") == 0, F.when(F.col("row") % 2 == 0, "01/02/2023").otherwise("Ana")).otherwise(F.when(F.col("row") % 3 == 0, "Ana").otherwise("01/02/2023"))
    return tables.typed_fills(cells.select("table_no", "row", "col", value.alias("value")), cells, spark.createDataFrame([(0, "date"), (1, "name")], "col int, col_type string"))


_PLANS = """p AS (SELECT c_custkey AS doc_id, 'k' || CAST(k AS STRING) AS key, CASE WHEN (c_custkey + k) % 3 = 0 THEN ' ' ELSE 'first' END AS value FROM customer CROSS JOIN range(0, 4) r(k) WHERE (c_custkey + k) % 4 <> 0),
q AS (SELECT c_custkey AS doc_id, 'k' || CAST(k AS STRING) AS key, 'retry' AS value FROM customer CROSS JOIN range(0, 4) r(k) WHERE (c_custkey + k) % 5 <> 0)"""


def _plans(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    key, n = F.concat(F.lit("k"), F.col("k").cast("string")).alias("key"), F.col("doc_id") + F.col("k")
    return rows.where(n % 4 != 0).select("doc_id", key, F.when(n % 3 == 0, " ").otherwise("first").alias("value")), rows.where(n % 5 != 0).select("doc_id", key, F.lit("retry").alias("value"))


@query(f"WITH {_PLANS} SELECT doc_id, key, coalesce(CASE WHEN trim(p.value) <> '' THEN p.value END, q.value, p.value) AS value FROM p FULL JOIN q USING (doc_id, key)")
def plan_merge(spark, sf_dir):
    return tables.merge_plans(*_plans(spark, sf_dir))


@query(f"WITH {_PLANS} SELECT doc_id, key FROM q WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = q.doc_id AND p.key = q.key AND trim(p.value) <> '')")
def plan_gaps(spark, sf_dir):
    first, retry = _plans(spark, sf_dir)
    return tables.plan_gaps(retry.select("doc_id", "key"), first)


@query("""SELECT p_partkey AS spec_no, 'user' AS origin FROM part WHERE p_partkey % 10 = 0
UNION ALL SELECT p_partkey, 'found' FROM part WHERE p_partkey % 10 <> 0 AND p_size NOT IN (SELECT p_size FROM part WHERE p_partkey % 10 = 0)""")
def spec_merge_anti(spark, sf_dir):
    """Specs are known by their header sets, here the size and its neighbour in either order."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    user = p.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("spec_no"), F.lit("user").alias("origin"), F.array(F.col("p_size"), -F.col("p_size")).alias("headers"))
    found = p.where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("spec_no"), F.lit("found").alias("origin"), F.array(-F.col("p_size"), F.col("p_size")).alias("headers"))
    return tables.merge_specs(user, found).drop("headers")


_GRID = LINES + ", grid AS (SELECT l_orderkey AS doc_id, 1 AS page, l_linenumber AS row, CAST(l_partkey % 11 AS INT) AS n, repeat('█', CAST(l_partkey % 11 AS INT)) || repeat(' ', CAST(10 - l_partkey % 11 AS INT)) AS line FROM lines)"


def _grid(spark, sf_dir):
    n = (F.col("l_partkey") % 11).cast("int")
    return lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("row"), F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit(" "), 10 - n)).alias("line"))


@query(f"""WITH {_GRID}, t AS (SELECT *, row - row_number() OVER (PARTITION BY doc_id ORDER BY row) AS g FROM grid WHERE n = 0)
SELECT doc_id, page, min(row) AS row_start, max(row) AS row_end FROM t GROUP BY doc_id, page, g HAVING max(row) - min(row) >= 1""")
def layout_breaks(spark, sf_dir):
    return layout.layout_breaks(_grid(spark, sf_dir))


@query(f"WITH {_GRID} SELECT doc_id, page, row, round(n / 10.0::DOUBLE, 3) AS density FROM (SELECT *, lead(n) OVER (PARTITION BY doc_id ORDER BY row) AS nx FROM grid) WHERE n / 10.0::DOUBLE >= 0.55 AND nx / 10.0::DOUBLE < 0.6::DOUBLE * (n / 10.0::DOUBLE)")
def layout_headings(spark, sf_dir):
    return layout.layout_headings(_grid(spark, sf_dir))


@query(f"WITH {_GRID} SELECT doc_id, page, row, '█' AS char, 0 AS col, n AS length FROM grid WHERE n >= 4")
def layout_runs(spark, sf_dir):
    return layout.layout_runs(_grid(spark, sf_dir))


@query(f"""WITH {_GRID}, d AS (SELECT doc_id, page, row, n / 10.0::DOUBLE AS d, row_number() OVER (PARTITION BY doc_id ORDER BY row) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS size FROM grid),
r AS (SELECT x.*, coalesce((SELECT min(y.i) FROM d AS y WHERE y.doc_id = x.doc_id AND y.i > x.i AND abs(y.d - x.d) > {layout.BAND_SPREAD}::DOUBLE), x.size) - x.i AS reach FROM d AS x),
s AS (SELECT doc_id, page, min(i) AS i FROM r WHERE d >= {layout.BAND_LEAST}::DOUBLE AND reach >= 4 AND i < size - 4 GROUP BY doc_id, page)
SELECT s.doc_id, s.page, r.row AS row_start, e.row AS row_end FROM s JOIN r USING (doc_id, i) JOIN d AS e ON e.doc_id = s.doc_id AND e.i = s.i + r.reach - 1""")
def layout_table_bands(spark, sf_dir):
    return layout.layout_table_bands(_grid(spark, sf_dir))


@query(f"WITH {_GRID} SELECT doc_id, 1 AS pages, count(*) AS rows, round(avg(n / 10.0::DOUBLE), 3) AS mean_density FROM grid GROUP BY doc_id")
def layout_summary(spark, sf_dir):
    return layout.page_summary(_grid(spark, sf_dir))


@query("SELECT s_suppkey, name, spec, threshold, n_fields, n_required, n_headings FROM supplier JOIN (VALUES " + ", ".join(
    f"({i}, '{f['name']}', '{f['spec']}', {f['threshold']}::DOUBLE, {len(f['fields'])}, {sum(r for _, _, r in f['fields'])}, {len(f['required_headings'])})" for i, f in enumerate(map(formats.load_format, formats.list_formats())))
    + ") AS t(i, name, spec, threshold, n_fields, n_required, n_headings) ON s_suppkey % 10 = i")
def format_catalog(spark, sf_dir):
    """Each supplier's documents have one of the ten formats, by name."""
    chosen = F.get(F.array(*map(F.lit, formats.list_formats())), (F.col("s_suppkey") % 10).cast("int")).alias("name")
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", chosen)
    return suppliers.join(formats.catalogue(spark), "name").select("s_suppkey", "name", "spec", "threshold", "n_fields", "n_required", "n_headings")
