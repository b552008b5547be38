"""A corpus of templates made from the customers: paragraphs, table cells and header runs, the same in Spark and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .forms import CUSTOMERS
from .staging import spread

#: Paragraphs with their list level; some are left out by the customer's key, so that runs of empty ones differ.
BLOCKS_SQL = """
SELECT c_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY n) - 1 AS INT) AS idx, CAST(ilvl AS INT) AS ilvl,
  replace(replace(line, '#N', c_name), '#S', c_mktsegment) AS text
FROM {customer} CROSS JOIN (VALUES (0, NULL, 'PROCEDIMENTO OPERACIONAL'), (1, NULL, ''), (2, 0, '1. OBJETIVO'), (3, NULL, ''), (4, NULL, ' '), (5, NULL, ''),
  (6, 0, '2. ESCOPO: (Descreva o escopo aqui)'), (7, NULL, 'Responsáveis:'), (8, NULL, 'Identificar as pessoas do setor #S'), (9, NULL, 'Autor: ____'), (10, NULL, 'Código {{{{CODIGO}}}} de #N'),
  (11, NULL, 'CONTATOS:'), (12, NULL, ''), (13, NULL, 'Texto corrido do documento.'), (14, NULL, 'Gestor do processo X'), (15, 0, '3. RESPONSABILIDADE'), (16, 1, 'Compete à gerência'),
  (17, NULL, 'Aprovar o plano de #S'), (18, 2, 'Liberar os recursos'), (19, 1, 'Compete aos supervisores'), (20, NULL, 'Treinar a equipe [SETOR]'), (21, 1, 'Disposições'), (22, NULL, 'Nada a opor'),
  (23, 0, '4. ANEXOS'), (24, NULL, 'Compete a todos'), (25, NULL, 'Rev. 00 de 00/00/00 <<DATA>> e (NOME DO SETOR) ......... XXXX')) AS t(n, ilvl, line)
WHERE NOT (n = 4 AND c_custkey % 2 = 0) AND NOT (n = 5 AND c_custkey % 3 = 0) AND NOT (n = 8 AND c_custkey % 5 = 0) AND NOT (n = 12 AND c_custkey % 7 = 0) AND NOT (n = 21 AND c_custkey % 4 = 0)"""

#: Table 0 holds revisions, table 1 people; some rows are blank.
CELLS_SQL = """
SELECT c_custkey AS doc_id, CAST(t AS INT) AS table_no, CAST(r AS INT) AS row, CAST(c AS INT) AS col, CASE WHEN r > 0 AND (c_custkey + r) % 4 = 0 AND t = 0 THEN '' ELSE replace(v, '#N', c_name) END AS text
FROM {customer} CROSS JOIN (VALUES (0, 0, 0, 'Versão'), (0, 0, 1, 'Data'), (0, 0, 2, 'Alteração'), (0, 0, 3, 'Autor'), (0, 1, 0, '00'), (0, 1, 1, '01/02/2020'), (0, 1, 2, 'Emissão'), (0, 1, 3, '#N'),
  (0, 2, 0, '01'), (0, 2, 1, '03/04/2021'), (0, 2, 2, 'Ajuste'), (0, 2, 3, ''), (0, 3, 0, '02'), (0, 3, 1, '05/06/2022'), (0, 3, 2, ''), (0, 3, 3, 'Ana'),
  (1, 0, 0, 'Atividades'), (1, 0, 1, 'Responsabilidade'), (1, 0, 2, 'Responsabilidade'), (1, 1, 0, ''), (1, 1, 1, 'Gerente Setorial'), (1, 1, 2, 'Supervisores'),
  (1, 2, 0, 'Fulano'), (1, 2, 1, 'XX'), (1, 2, 2, 'XX'), (1, 3, 0, '(nome do titular)'), (1, 3, 1, 'Cargo:'), (1, 3, 2, 'Descrever a função'), (1, 4, 0, ''), (1, 4, 1, ''), (1, 4, 2, '')) AS t(t, r, c, v)"""

RUNS_SQL = """
SELECT c_custkey AS doc_id, 'word/header1.xml' AS part, CAST(n AS INT) AS run_no, CAST(p AS INT) AS paragraph, replace(replace(replace(v, '#K', lpad(CAST(c_custkey AS STRING), 4, '0')), '#S', c_mktsegment), '#V', CAST(c_custkey % 30 AS STRING)) AS text
FROM {customer} CROSS JOIN (VALUES (0, 0, 'IT.PRO.'), (2, 0, 'URE.'), (3, 0, '01.#K'), (4, 1, 'INSTRUÇÃO DE TRABALHO'), (5, 1, ' '), (6, 1, 'PARTIDA DA ÁREA DE #S'), (7, 2, 'Ver.: #V'),
  (8, 3, 'Data:'), (9, 3, 'Rev. 00'), (10, 4, 'XXXX'), (11, 5, 'Aprovadores: Ana Souza Fl. 1/3')) AS t(n, p, v)
WHERE NOT (n = 3 AND c_custkey % 6 = 0) AND NOT (n = 7 AND c_custkey % 8 = 0) AND NOT (n = 11 AND c_custkey % 9 = 0)"""


def _read(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, customer=spread(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", CUSTOMERS))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, idx, ilvl, text."""
    return _read(spark, sf_dir, BLOCKS_SQL)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, table_no, row, col, text."""
    return _read(spark, sf_dir, CELLS_SQL)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, part, run_no, paragraph, text: the runs of a header."""
    return _read(spark, sf_dir, RUNS_SQL)


def _grid_sql() -> str:
    """Two pages of twelve rows for each customer, of four kinds: edges down some columns, a dense row with blank ones below it."""
    edges = {0: [(2, 1, 6, "█"), (7, 2, 8, "▒")], 1: [(2, 1, 6, "█"), (7, 2, 8, "▓"), (12, 1, 9, "█")], 2: [(2, 1, 4, "█"), (7, 1, 4, "█")],
             3: [(1, 0, 4, "█"), (3, 0, 4, "░"), (5, 0, 5, "█"), (9, 6, 11, "▒"), (11, 5, 11, "█"), (13, 6, 10, "▓")]}
    cols = []
    for c in range(14):
        marks = [f"WHEN k = {k} AND row BETWEEN {a} AND {b} THEN '{ch}'" for k, e in edges.items() for col, a, b, ch in e if col == c]
        cols.append(f"CASE WHEN k = 2 AND row = 7 THEN '{'█' if c < 10 else '░'}' {' '.join(marks)} ELSE ' ' END")
    rows = ", ".join(f"({r})" for r in range(12))
    return f"""
SELECT doc_id, page, row, concat({', '.join(cols)}) AS line FROM (SELECT c_custkey AS doc_id, CAST(p AS INT) AS page, CAST(r AS INT) AS row, (c_custkey + p) % 4 AS k
FROM {{customer}} CROSS JOIN (VALUES (1), (2)) AS p(p) CROSS JOIN (VALUES {rows}) AS r(r)) AS g"""


GRID_SQL = _grid_sql()

#: Numbering definitions by customer: lists that point at abstract lists, and levels that a list changes.
NUMS_SQL = """SELECT c_custkey AS doc_id, CAST(n AS INT) AS num_id, CAST(CASE WHEN n = 9 THEN 77 ELSE (c_custkey + n) % 2 END AS INT) AS abstract_id FROM {customer} CROSS JOIN (VALUES (1), (2), (9)) AS t(n)"""
ABSTRACTS_SQL = """SELECT c_custkey AS doc_id, CAST(a AS INT) AS abstract_id, CAST(l AS INT) AS ilvl, f AS num_fmt, t AS lvl_text, CAST(s AS INT) AS start FROM {customer} CROSS JOIN (VALUES (0, 0, 'decimal', '%1.', 1),
  (0, 1, 'lowerLetter', '%1.%2)', 1), (0, 2, 'upperRoman', '%3', 1), (1, 0, 'upperLetter', '%1 -', 3), (1, 1, 'decimal', '%1.%2', 1)) AS t(a, l, f, t, s)"""
OVERRIDES_SQL = """SELECT c_custkey AS doc_id, CAST(2 AS INT) AS num_id, CAST(l AS INT) AS ilvl, f AS num_fmt, t AS lvl_text, CAST(s AS INT) AS start FROM {customer} CROSS JOIN (VALUES (0, NULL, NULL, 5), (1, 'lowerRoman', '(%2)', NULL), (5, 'decimal', '%6', 1)) AS t(l, f, t, s)
WHERE c_custkey % 3 <> l"""

#: Cells with grid spans of one to three columns, and merges down three rows.
SPANS_SQL = """SELECT c_custkey AS doc_id, CAST(0 AS INT) AS table_no, CAST(r AS INT) AS row, CAST(c AS INT) AS cell_no, CAST(1 + (CASE WHEN c = 0 THEN c_custkey ELSE c_custkey + r + c END) % 3 AS INT) AS span,
  CASE WHEN c = 0 AND r BETWEEN 1 AND 3 THEN CASE WHEN r = 1 THEN 'restart' ELSE 'continue' END WHEN c = 3 AND r = 2 AND c_custkey % 2 = 0 THEN 'continue' END AS vmerge, concat('r', CAST(r AS STRING), 'c', CAST(c AS STRING), ' ', c_mktsegment) AS text
FROM {customer} CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS r(r) CROSS JOIN (VALUES (0), (1), (2), (3)) AS c(c)"""

#: A paragraph whose tokens lie in one run or across several, by the customer's key.
SPLIT_SQL = """SELECT c_custkey AS doc_id, 'body' AS part, CAST(0 AS INT) AS paragraph, CAST(n AS INT) AS run_no, CASE WHEN c_custkey % 2 = 1 AND n IN (4, 5) THEN CASE n WHEN 4 THEN ' e ' ELSE '{{{{NOME_' END ELSE v END AS text, c_name AS name
FROM {customer} CROSS JOIN (VALUES (0, 'Codigo: {{{{CO'), (1, 'DIGO}}}}'), (2, ' de {{{{NOME}}}}, '), (3, ''), (4, ' e {{{{NO'), (5, 'ME_'), (6, 'COMPLETO}}}} fim {{{{NOME')) AS t(n, v)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, row, line."""
    return _read(spark, sf_dir, GRID_SQL)


def numbering(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lists, levels of abstract lists, and what lists change of these."""
    return tuple(_read(spark, sf_dir, t) for t in (NUMS_SQL, ABSTRACTS_SQL, OVERRIDES_SQL))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, table_no, row, cell_no, span, vmerge, text."""
    return _read(spark, sf_dir, SPANS_SQL)


def split_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, part, paragraph, run_no, text, name."""
    return _read(spark, sf_dir, SPLIT_SQL)
