"""Registered queries over documents in the formats of the catalogue; each with its DuckDB equivalent.

A supplier's document has the format of its key. Its texts follow from the star schema by the rule of each field's type, with known defects by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats
from ..operators import conformity, fields
from .queries import query

_KEY = "CAST(s_suppkey + 3 * field_no AS BIGINT)"
#: SQL of what a field holds, and of what its text has: a gap, a date or number that only looks right, or no value of its type.
_LOST, _SPOILT = "(s_suppkey + field_no) % 11 = 0", "(s_suppkey + field_no) % 13 = 0 AND type <> 'freetext'"
_SHOWN = f"CASE WHEN {_LOST} THEN NULL WHEN {_SPOILT} THEN CASE type WHEN 'iso_date' THEN '2026-02-30' WHEN 'cpf' THEN '111.111.111-11' ELSE '??' END ELSE {formats.value_sql(_KEY)} END"


def _literal(x) -> str:
    return str(x) if isinstance(x, (bool, int)) else f"'{x}'"


_ROWS = "c(name, format_no, field_no, field, type, required, label, code, hint) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in formats.field_rows()) + ")"
_FOUND = f"""{_ROWS}, v AS (SELECT *, nullif({_SHOWN}, '??') AS value FROM supplier JOIN c ON s_suppkey % 10 = format_no),
f AS (SELECT s_suppkey, name, field, value, CASE WHEN value IS NULL THEN CASE WHEN required THEN 'missing' ELSE 'absent' END WHEN value IN ('2026-02-30', '111.111.111-11') THEN 'invalid' ELSE 'ok' END AS status FROM v)"""


def _documents(spark, sf_dir):
    """s_suppkey, name, text; the first heading is left out for each seventh key."""
    rows = spark.createDataFrame(formats.field_rows(), formats.FIELD_SCHEMA)
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    values = suppliers.join(F.broadcast(rows), F.col("s_suppkey") % 10 == F.col("format_no")).withColumn("value", F.expr(_SHOWN))
    made = formats.texts(values, ["s_suppkey", "name"])
    return made.withColumn("text", F.when(F.col("s_suppkey") % 7 == 0, F.regexp_replace("text", "^[^\\n]*\\n", "")).otherwise(F.col("text")))


def _statuses(spark, docs):
    """What the patterns inferred from each format's gold texts find in docs, with the status of each field."""
    found = fields.extract_formats(docs, fields.infer_formats(formats.golds(spark), formats.examples(spark)))
    rows = spark.createDataFrame(formats.field_rows(), formats.FIELD_SCHEMA).select("name", "field", "type", "required")
    return conformity.field_status(found.join(F.broadcast(rows), ["name", "field"]))


@query(f"WITH {_FOUND} SELECT * FROM f")
def format_fields(spark, sf_dir):
    return _statuses(spark, _documents(spark, sf_dir)).select("s_suppkey", "name", "field", "value", "status")


_TERMS = ", ".join(f"('{f['name']}', {f['threshold']}::DOUBLE, {f['weights']['structural']}::DOUBLE, {f['weights']['technical']}::DOUBLE, {len(f['required_headings'])})" for f in map(formats.load_format, formats.list_formats()))


@query(f"""WITH {_FOUND}, t(name, threshold, ws, wt, heads) AS (VALUES {_TERMS}),
d AS (SELECT s_suppkey, name, count(*) FILTER (status IN ('missing', 'invalid')) AS n_critical, count(*) AS n, CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END AS gone FROM f GROUP BY s_suppkey, name),
s AS (SELECT *, round((ws * (1 - gone / heads) + wt * (1 - n_critical / n)) / (ws + wt), 3) AS score FROM d JOIN t USING (name))
SELECT s_suppkey, name, n_critical, CAST(gone AS BIGINT) AS n_headings_missing, score, score >= threshold AND n_critical = 0 AS passed FROM s""")
def format_verdicts(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return conformity.format_verdicts(docs, _statuses(spark, docs), [formats.load_format(n) for n in formats.list_formats()], "s_suppkey")
