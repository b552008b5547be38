"""Registered queries on page geometry: sparse tables, features and summaries of pages; each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout
from ..sources.forms import in_sql
from ..sources.templates import GRID_SQL, grid
from .queries import query

GRID = f"grid AS MATERIALIZED ({in_sql(GRID_SQL)})"

#: Islands of rows down each column, then the sweep over a page's edges as a recursion with the bands as its state.
SPARSE = f"""{GRID}, marks AS (SELECT doc_id, page, row, c AS col FROM grid, range(0, 14) t(c) WHERE line[c + 1] IN ('█', '▓', '▒', '░')),
islands AS (SELECT doc_id, page, col, min(row) AS a, max(row) AS b FROM (SELECT *, row - row_number() OVER (PARTITION BY doc_id, page, col ORDER BY row) AS g FROM marks) GROUP BY doc_id, page, col, g),
edges AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY col) AS i FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, col ORDER BY b - a DESC, a) AS r FROM islands) WHERE r = 1 AND b - a >= 4),
sweep(doc_id, page, i, bands) AS (
  SELECT doc_id, page, 1::BIGINT, [{{'a': a, 'b': b, 'n': 1}}] FROM edges WHERE i = 1
  UNION ALL SELECT s.doc_id, s.page, e.i, CASE WHEN len(list_filter(bands, lambda x: greatest(x.a, e.a) <= least(x.b, e.b))) = 0 THEN list_append(bands, {{'a': e.a, 'b': e.b, 'n': 1}})
    ELSE list_transform(bands, lambda x, k: CASE WHEN k = list_position(list_transform(bands, lambda y: greatest(y.a, e.a) <= least(y.b, e.b)), true) THEN {{'a': greatest(x.a, e.a), 'b': least(x.b, e.b), 'n': x.n + 1}} ELSE x END) END
  FROM sweep s JOIN edges e ON e.doc_id = s.doc_id AND e.page = s.page AND e.i = s.i + 1),
sparse AS (SELECT doc_id, page, t.a AS row_start, t.b AS row_end, t.n AS columns FROM (SELECT doc_id, page, unnest(bands) AS t FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY i DESC) AS r FROM sweep) WHERE r = 1) WHERE t.n >= 2 AND t.b - t.a >= 4)"""

#: Greedy bands as a recursion over the rows of a page; then all tables merged, and the other features counted.
FEATURES = f"""WITH RECURSIVE {SPARSE},
dens AS (SELECT *, (length(line) - length(regexp_replace(line, '[█▓]', '', 'g'))) / length(line)::DOUBLE AS d FROM grid),
near AS (SELECT *, d >= 0.1 AND row < 8 AND abs(lead(d, 1) OVER w - d) <= 0.08::DOUBLE AND abs(lead(d, 2) OVER w - d) <= 0.08::DOUBLE AND abs(lead(d, 3) OVER w - d) <= 0.08::DOUBLE AS starts FROM dens WINDOW w AS (PARTITION BY doc_id, page ORDER BY row)),
fold(doc_id, page, row, ref, from_row, done) AS (
  SELECT doc_id, page, 0, CASE WHEN starts THEN d END, CASE WHEN starts THEN 0 END, []::STRUCT(a INT, b INT)[] FROM near WHERE row = 0
  UNION ALL SELECT f.doc_id, f.page, f.row + 1, CASE WHEN abs(n.d - ref) <= 0.08::DOUBLE THEN ref WHEN n.starts THEN n.d END, CASE WHEN abs(n.d - ref) <= 0.08::DOUBLE THEN from_row WHEN n.starts THEN n.row END,
    CASE WHEN ref IS NOT NULL AND NOT coalesce(abs(n.d - ref) <= 0.08::DOUBLE, false) THEN list_append(done, {{'a': from_row, 'b': f.row}}) ELSE done END
  FROM fold f LEFT JOIN near n ON n.doc_id = f.doc_id AND n.page = f.page AND n.row = f.row + 1 WHERE f.row < 12),
hints AS (SELECT doc_id, page, t.a AS a, t.b AS b FROM (SELECT doc_id, page, unnest(done) AS t FROM fold WHERE row = 12) UNION ALL SELECT doc_id, page, row_start, row_end FROM sparse),
apart AS (SELECT *, coalesce(a > 1 + max(b) OVER (PARTITION BY doc_id, page ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM hints),
n_tables AS (SELECT doc_id, page, count(*) FILTER (new) AS n FROM apart GROUP BY ALL),
n_heads AS (SELECT doc_id, page, count(*) AS n FROM (SELECT *, lead(d) OVER (PARTITION BY doc_id, page ORDER BY row) AS nx FROM dens) WHERE d >= 0.55 AND nx < 0.6::DOUBLE * d GROUP BY ALL),
n_breaks AS (SELECT doc_id, page, count(*) AS n FROM (SELECT doc_id, page, g FROM (SELECT *, row - row_number() OVER (PARTITION BY doc_id, page ORDER BY row) AS g FROM dens WHERE d <= 0.05) GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL),
n_marks AS (SELECT doc_id, page, sum(regexp_matches(line, '█{{4}}')::INT + regexp_matches(line, '▓{{4}}')::INT + regexp_matches(line, '▒{{4}}')::INT + regexp_matches(line, '░{{4}}')::INT) AS n FROM grid GROUP BY ALL),
pages AS (SELECT p.*, coalesce(h.n, 0) AS headings, coalesce(t.n, 0) AS tables, coalesce(b.n, 0) AS breaks, coalesce(m.n, 0) AS placeholders
  FROM (SELECT doc_id, page, count(*) AS rows, max(length(line)) AS cols, round(avg(d), 3) AS density FROM dens GROUP BY ALL) p
  LEFT JOIN n_heads h USING (doc_id, page) LEFT JOIN n_tables t USING (doc_id, page) LEFT JOIN n_breaks b USING (doc_id, page) LEFT JOIN n_marks m USING (doc_id, page)) """


@query(f"WITH RECURSIVE {SPARSE} SELECT doc_id, page, row_start, row_end, columns FROM sparse")
def layout_sparse_tables(spark, sf_dir):
    """Pages with two and with three edges, with edges of four rows, and with two bands of columns."""
    return layout.layout_sparse_tables(grid(spark, sf_dir))


@query(FEATURES + "SELECT doc_id, page, rows, cols, density, headings, tables, breaks, CAST(placeholders AS BIGINT) AS placeholders FROM pages")
def layout_features(spark, sf_dir):
    found = layout.page_features(grid(spark, sf_dir))
    return found.select("doc_id", "page", "rows", "cols", "density", *[F.coalesce(F.size(n), F.lit(0)).cast("long").alias(n) for n in ("headings", "tables", "breaks", "placeholders")])


@query(FEATURES + """SELECT doc_id, format('Document: {} pages, avg density={:.2f}' || chr(10) || 'Totals — headings={} tables={} section_breaks={} placeholders={}' || chr(10) || chr(10), count(*), round(avg(density), 3), sum(headings), sum(tables), sum(breaks), sum(placeholders))
  || string_agg(format('Page {}: H={} T={} S={} P={} d={:.2f}', page, headings, tables, breaks, CAST(placeholders AS BIGINT), density), chr(10) ORDER BY page) AS summary FROM pages GROUP BY doc_id""")
def layout_summaries(spark, sf_dir):
    return layout.document_summary(layout.document_features(layout.page_features(grid(spark, sf_dir))))
