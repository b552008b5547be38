"""How far the sources of a language differ in the terms they use, by wide term vectors.

Tasks count terms by (language, source) for a few megabytes of text at a time, so that a source or word of a third of all
rows sends one row a task on. Each term that stays is pivoted into one array with a place for each source of its
language. Higher-order functions turn the array into shares and emit the contribution of each pair of sources; partial
aggregation sums them before they are shuffled, so a task sends one row for each pair. Everything is exact in 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table, text_of
from .textbytes import LETTERS, batches_by_bytes, give_back, terms_of, utf8

LEAST_DOCS, TOP = 3, 200
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, occurrences, documents) of each few megabytes of lang, source, text."""
    for batch in batches:
        for part in batches_by_bytes(batch, "text"):
            names: dict[tuple, int] = {}
            group = np.array([names.setdefault(x, len(names)) for x in zip(part["lang"].to_pylist(), part["source"].to_pylist(), strict=True)], np.int64)
            doc, code, words = terms_of(utf8(part["text"]), LETTERS)
            size = max(1, len(words))
            each, times = np.unique(doc * size + code, return_counts=True)
            both, place = np.unique(group[each // size] * size + each % size, return_inverse=True)
            n = np.bincount(place, weights=times, minlength=len(both)).astype(np.int64)
            lang, source = (pa.array([x[i] for x in names], pa.string()).take(pa.array(both // size)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([lang, source, words.take(pa.array(both % size)), pa.array(n), pa.array(np.bincount(place, minlength=len(both)).astype(np.int64))], schema=_COUNTS)
        give_back()


def _share(c: str, m: str) -> str:
    """1 + floor(10**9 * (c + 1) / m) in two steps of long division, so that counts of up to 9 * 10**13 don't overflow."""
    rest = f"(100000 * (({c} + 1) % {m}))"
    return f"(1 + 1000000000 * (({c} + 1) div {m}) + 10000 * ({rest} div {m}) + (10000 * ({rest} % {m})) div {m})"


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: how far each other source of the language is off, and the terms typical of the source.

    Null text, language and source count as ''. Terms are runs of letters (any character beyond ASCII is one), lower-cased in A-Z; a language keeps those in at least
    least_docs of its rows (equal rows count each). Ties go to the lesser item in UTF-8. A source without terms has even shares; a language without kept terms has
    pairs of value 0 and no terms; an empty table gives no rows. Other columns are ignored, whatever their names."""
    rows = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text"))
    sources = rows.select("lang", "source").distinct().groupBy("lang").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    sources = stage(sources, "divergence-sources")
    counts = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    terms = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = terms.groupBy("lang", "term").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    wide = stage(terms.join(sources, "lang").select("lang", "term", F.expr("transform(sources, s -> coalesce(try_element_at(by, s), 0L))").alias("c")), "divergence-terms")

    sums = wide.select("lang", F.posexplode("c").alias("i", "n")).groupBy("lang", "i").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    sums = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("all"), F.max("v").alias("v"), F.sum("n").alias("total"))
    sizes = sums.selectExpr("lang", "transform(all, x -> x.n + v) m", "total + v m_all")
    known = stage(sources.join(sizes, "lang", "left"), "divergence-sizes")
    shares = wide.join(known.drop("sources"), "lang").selectExpr("lang", "term", "c", f"transform(c, (x, i) -> {_share('x', 'm[i]')}) p", f"{_share('aggregate(c, 0L, (a, x) -> a + x)', 'm_all')} q")

    off = "((x - {0}) * (x - {0})) div {0}"
    emitted = shares.select("lang", "p", F.posexplode("p").alias("i", "x")).select("lang", "i", F.posexplode(F.expr(f"transform(p, y -> {off.format('y')})")).alias("j", "f"))
    summed = emitted.groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
    pairs = known.select("lang", "sources", F.posexplode("sources").alias("i", "source")).select("lang", "source", "i", F.posexplode("sources").alias("j", "item")).where("i != j")
    pairs = pairs.join(summed, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(best))

    typical = shares.select("lang", "term", F.explode(F.expr(f"filter(transform(p, (x, i) -> struct(i AS i, c[i] AS n, x > q AS more, {off.format('q')} AS value)), s -> s.n > 0 AND s.more)")).alias("s"))
    typical = typical.select("lang", F.col("s.i").alias("i"), "term", F.col("s.value").alias("value"))
    typical = typical.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "i").orderBy(F.desc("value"), "term"))).where(F.col("rank") <= top)
    typical = typical.join(known.select("lang", "sources"), "lang").select("lang", F.expr("sources[i]").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(typical)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distances between all sources of each language, and the 200 most typical terms of each source."""
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, CAST(1 + (1000000000 * (coalesce(c, 0)::HUGEINT + 1)) // (n + v) AS HUGEINT) AS p
  FROM k JOIN n USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (
  SELECT lang, term, CAST(1 + (1000000000 * (sum(c)::HUGEINT + 1)) // ((SELECT sum(n) FROM n WHERE n.lang = c.lang) + any_value(v)) AS HUGEINT) AS q
  FROM c JOIN v USING (lang) GROUP BY lang, term),
o AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN o ON o.lang = x.lang AND o.source = x.source AND o.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
s AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM s WHERE part = 'pair' OR rank <= 200"""

QUERIES = {"op11_source_divergence": op11_source_divergence}
ORACLES = {"op11_source_divergence": ORACLE}
