"""Quality rules: base rules on word statistics, and robust multivariate outliers.

Minimum-covariance-determinant estimates for each language and source, by concentration steps. The steps
are Spark aggregations over all rows of a group: distances under the current estimate, the distance below which half
of the group lies (from counts in fixed bins), mean and covariance of those rows. No group is gathered in a
task, so one source may hold any share of the rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table, text_of
from .textbytes import chunks, utf8, windows

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The transformed statistics and the least spread that counts: a small part of the range, so that a statistic that is the same in most texts doesn't reject the first that differs.
FEATURES = {
    "_x1": ("log1p(n_words)", 0.5),
    "_x2": ("log1p(word_chars / greatest(1, n_words))", 0.1),
    "_x3": ("sqrt(n_symbols / greatest(1, word_chars))", 0.05),
    "_x4": ("sqrt(n_repeat_words / greatest(1, n_words))", 0.06),
    "_x5": ("log1p(n_dup_lines)", 0.35),
}
#: Starts: all rows, quartiles, and quartiles with few symbols, repeats and repeated lines.
STARTS = 3
LOW = {"_x3", "_x4", "_x5"}
#: The share of a normal sample beyond the cut-off; texts aren't normal, and clean ones with odd lengths must stay.
TAIL = 1e-9
SETTLED = 1e-4  # a start has settled when half the logarithm of its determinant falls by less
MIN_GROUP = 50
LEAST_ROWS = 11
_BINS = 16  # a factor of e has so many bins


def _stats(batches):
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for batch in batches:
        n = batch.num_rows
        out = {c: np.zeros(n, np.int64) for c in STATS}
        for c in chunks(utf8(batch.column("_text"))):
            at, m = slice(c.first, c.first + len(c.begin)), len(c.begin)
            begin, end, text = c.words()
            sums = c.sums()
            hashes = c.hashes(sums, begin, end)
            out["n_words"][at] = np.bincount(text, minlength=m)
            lead = np.concatenate(([0], np.cumsum((c.data & 0xC0) != 0x80, dtype=np.int64)))
            out["word_chars"][at] = np.bincount(text, lead[end] - lead[begin], m).astype(np.int64)
            out["n_symbols"][at] = c.per_text(symbol[c.data])
            # lines that hold a word: from after a newline to the next; texts are joined by newlines
            stop = np.flatnonzero(c.data == 10)
            start = np.concatenate(([0], stop[:-1] + 1))
            line = np.unique(np.searchsorted(stop, begin))
            owner = np.searchsorted(c.begin, start[line], "right") - 1
            key = c.hashes(sums, start[line], stop[line]) ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            _, once = np.unique(key, return_index=True)
            out["n_dup_lines"][at] = np.bincount(owner, minlength=m) - np.bincount(owner[once], minlength=m)
            runs, first = windows(hashes, text, 5)
            if len(runs):
                runs = runs ^ (text[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                order = np.argsort(runs, kind="stable")
                same = runs[order][1:] == runs[order][:-1]
                often = np.zeros(len(runs), bool)
                often[order[1:][same]] = often[order[:-1][same]] = True
                cover = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(cover, first[often], 1)
                np.add.at(cover, first[often] + 5, -1)
                out["n_repeat_words"][at] = np.bincount(text, np.cumsum(cover[:-1]) > 0, m).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("_key"), *(pa.array(out[c]) for c in STATS)], names=["_key", *STATS])


def text_statistics(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and the five base statistics of every whole text. Null text has none of anything."""
    rows = docs.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("_key"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    out = rows.mapInArrow(_stats, f"_key {kind}, " + ", ".join(f"{c} bigint" for c in STATS))
    return out.select("_key.*", *STATS)


def _solved(names: list[str]) -> Column:
    """Squared distance of the row's features from _mean under _chol, the inverse's factor rows, as one expression."""
    p = len(names)
    parts = []
    for i in range(p):
        dot = sum(((F.col(names[j]) - F.col(f"_m{j}")) * F.col(f"_l{i}{j}") for j in range(i + 1)), F.lit(0.0))
        parts.append(dot * dot)
    return sum(parts, F.lit(0.0))


def _factor(moments: DataFrame, floors: list[float], scale: float) -> DataFrame:
    """From a row of moments a group, the mean and the inverse Cholesky factor, with the floors added to the variances.

    A handful of numbers a group in plain expressions; groups are languages times sources."""
    p = len(floors)
    cov: dict[tuple[int, int], Column] = {}
    out = moments
    for i in range(p):
        out = out.withColumn(f"_m{i}", F.col(f"_s{i}") / F.col("_h"))
    for i in range(p):
        for j in range(i + 1):
            c = (F.col(f"_s{j}{i}") / F.col("_h") - F.col(f"_m{i}") * F.col(f"_m{j}")) * scale
            cov[i, j] = c + floors[i] ** 2 if i == j else c
    for i in range(p):  # Cholesky: c = g g'
        for j in range(i + 1):
            c = cov[i, j] - sum((F.col(f"_g{i}{k}") * F.col(f"_g{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"_g{i}{j}", F.sqrt(F.greatest(c, F.lit(1e-12))) if i == j else c / F.col(f"_g{j}{j}"))
    for i in range(p):  # the inverse of g, row by row
        for j in range(i + 1):
            c = F.lit(1.0) if i == j else -sum((F.col(f"_g{i}{k}") * F.col(f"_l{k}{j}") for k in range(j, i)), F.lit(0.0))
            out = out.withColumn(f"_l{i}{j}", c / F.col(f"_g{i}{i}"))
    size = sum((F.ln(f"_g{i}{i}") for i in range(p)), F.lit(0.0))  # half the logarithm of the determinant
    return out.select("_group", "_start", *[f"_m{i}" for i in range(p)], *[f"_l{i}{j}" for i in range(p) for j in range(i + 1)], size.alias("_det"))


def _moments(names: list[str]) -> list[Column]:
    p = len(names)
    return [F.count(F.lit(1)).alias("_h"), *[F.sum(n).alias(f"_s{i}") for i, n in enumerate(names)],
            *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"_s{i}{j}") for j in range(p) for i in range(j + 1)]]


def _quartile_starts(rows: DataFrame, names: list[str]) -> DataFrame:
    """For each group the mean and moments of an uncorrelated normal variable by quartiles, as _moments gives them; in the second the LOW features lie low."""
    q = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_h"), *[F.percentile_approx(n, [0.1, 0.25, 0.5, 0.75]).alias(f"_q{i}") for i, n in enumerate(names)])
    out = []
    for start in range(1, STARTS):
        mid = [F.element_at(f"_q{i}", 1 if start == 2 and n in LOW else 3) for i, n in enumerate(names)]
        var = [F.pow((F.element_at(f"_q{i}", 4) - F.element_at(f"_q{i}", 2)) / 1.349, 2) for i in range(len(names))]
        sums = [(m * F.col("_h")).alias(f"_s{i}") for i, m in enumerate(mid)]
        products = [((mid[i] * mid[j] + (var[i] if i == j else 0.0)) * F.col("_h")).alias(f"_s{i}{j}") for j in range(len(names)) for i in range(j + 1)]
        out.append(q.select("_group", F.lit(start).alias("_start"), "_h", *sums, *products))
    return out[0].unionByName(out[1])


def robust_distance(stats: DataFrame, lang: Column, source: Column, features: dict = FEATURES, min_group: int = MIN_GROUP) -> DataFrame:
    """Adds distance2, the squared Mahalanobis distance under the robust estimate of the row's language and source.

    From each start, concentration steps are taken until its determinant no longer falls: the half of the rows that lie
    nearest under the estimate gives the next one, with its covariance scaled for the half that was left out. Starts that have settled
    are left out of later steps; as each other one falls by SETTLED or more and the floors bound determinants from below, this ends.
    Of a group's estimates the one with the least determinant counts. Sources of fewer than min_group rows share the estimate of their language, languages of fewer
    share one; distance2 is null where even these are fewer than LEAST_ROWS. stats must be cheap to read again (staged)."""
    names = list(features)
    floors = [f for _, f in features.values()]
    rows = stats.withColumns({n: F.expr(e).cast("double") for n, (e, _) in features.items()}).withColumn("_la", lang).withColumn("_so", source)
    sizes = rows.groupBy("_la", "_so").agg(F.count(F.lit(1)).alias("_rows"))
    rest = sizes.where(F.col("_rows") < min_group).groupBy(F.col("_la").alias("_lr")).agg(F.sum("_rows").alias("_more"))
    sizes = stage(sizes.join(rest, F.col("_la") == F.col("_lr"), "left").select(F.col("_la").alias("_l2"), F.col("_so").alias("_s2"), F.when(F.col("_rows") >= min_group, F.concat_ws("|", F.lit("s"), "_la", "_so"))
                                        .when(F.col("_more") >= min_group, F.concat_ws("|", F.lit("l"), "_la")).otherwise("all").alias("_group")), "mcd-groups")
    rows = stage(rows.join(sizes, (F.col("_la") == F.col("_l2")) & (F.col("_so") == F.col("_s2"))).drop("_la", "_so", "_l2", "_s2"), "mcd-rows")
    whole = rows.groupBy("_group").agg(*_moments(names)).withColumn("_start", F.lit(0))
    moments, scale, found = whole.unionByName(_quartile_starts(rows, names)).where(f"_h >= {LEAST_ROWS}"), 1.0, []
    while True:
        estimate = _factor(moments, floors, scale)
        if len(found) > 1:  # the starts themselves come with another scale
            was = found[-1].select(F.col("_group").alias("_wg"), F.col("_start").alias("_ws"), F.col("_det").alias("_was"))
            estimate = estimate.join(was, (F.col("_group") == F.col("_wg")) & (F.col("_start") == F.col("_ws"))).drop("_wg", "_ws")
        else:
            estimate = estimate.withColumn("_was", F.lit(None).cast("double"))
        found.append(stage(estimate.withColumn("_going", F.col("_was").isNull() | (F.col("_det") < F.col("_was") - SETTLED)), "mcd-estimate"))
        going = found[-1].where("_going")
        if going.isEmpty():
            break
        far = rows.join(going.drop("_det", "_was", "_going"), "_group").withColumn("distance2", _solved(names))
        # at most a few hundred bins a group and start
        binned = far.withColumn("_bin", F.floor(F.ln(F.greatest(F.lit(1e-3), F.least(F.lit(1e6), F.col("distance2")))) * _BINS).cast("int"))
        counts = binned.groupBy("_group", "_start", "_bin").agg(F.count(F.lit(1)).alias("_n"))
        half = counts.groupBy("_group", "_start").agg(F.array_sort(F.collect_list(F.struct("_bin", "_n"))).alias("_c"), F.sum("_n").alias("_all"))
        half = stage(half.select(F.col("_group").alias("_hg"), F.col("_start").alias("_hs"), F.expr(
            "aggregate(_c, named_struct('run', 0L, 'at', CAST(NULL AS INT)), (a, x) -> named_struct('run', a.run + x._n,"
            " 'at', CASE WHEN a.at IS NULL AND 2 * (a.run + x._n) >= _all THEN x._bin ELSE a.at END)).at").alias("_at")), "mcd-half")
        kept = binned.join(half, (F.col("_group") == F.col("_hg")) & (F.col("_start") == F.col("_hs"))).where("_bin <= _at")
        # the covariance of a normal variable's nearer half is smaller by a factor that depends on the dimension
        moments, scale = kept.groupBy("_group", "_start").agg(*_moments(names)), _half_scale(len(names))
    every = [e.withColumn("_step", F.lit(i)) for i, e in enumerate(found) if i or len(found) == 1]
    least = F.row_number().over(Window.partitionBy("_group").orderBy("_det", "_step", "_start"))  # a few rows a group
    best = stage(reduce(DataFrame.unionByName, every).withColumn("_rank", least).where("_rank = 1").drop("_rank", "_det", "_start", "_was", "_going", "_step"), "mcd-best")
    return rows.join(best, "_group", "left").withColumn("distance2", _solved(names)).drop("_group", *names, *[c for c in best.columns if c != "_group"])


def _chi2(x: float, k: int) -> float:
    """The chi-square distribution function with k degrees of freedom, by its series."""
    return sum(math.exp(-x / 2 + (k / 2 + i) * math.log(x / 2) - math.lgamma(k / 2 + i + 1)) for i in range(400))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 1e-6, 300.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, k) < p else (low, mid)
    return low


def _half_scale(p: int) -> float:
    """What makes the covariance of the nearer half of a p-dimensional normal sample consistent: 0.5 / P(chi2 with p + 2 <= median of chi2 with p)."""
    return 0.5 / _chi2(chi2_quantile(0.5, p), p + 2)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                  tail: float = TAIL) -> DataFrame:
    """One row for each row of docs: id_col, text_hash, the base statistics, base_failed, distance2 and kept.

    A text fails the base rules with fewer than 10 words, or with more than a fifth of its words in repeated
    5-word windows; null and empty texts fail. Those that pass are kept unless their transformed statistics lie
    beyond the chi-square quantile of `tail` in the robust estimate of their language and source, which only passing texts enter. Null languages
    and sources are groups of their own. Repeated rows get a row each; other columns are ignored; an empty table gives no rows."""
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), F.col(text_col).alias("_t"),
                        F.xxhash64(text_of(text_col)).alias("text_hash"))
    stats = stage(text_statistics(keyed, ["_id", "_lang", "_source", "text_hash"], "_t"), "quality-stats")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    name = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(c).cast("string")))
    passed = robust_distance(stats.where(~F.col("base_failed")), name("_lang"), name("_source"))
    out = passed.unionByName(stats.where("base_failed").withColumn("distance2", F.lit(None).cast("double")))
    return out.select(F.col("_id").alias(id_col), "text_hash", *STATS, "base_failed", "distance2",
                      (~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= chi2_quantile(1 - tail, len(FEATURES)))).alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("distance2", "text_hash")


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES: dict[str, str] = {}
