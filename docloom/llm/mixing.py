"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Only DataFrame and SQL functions. Documents of a source fall by hash into at most MAX_BLOCKS blocks, so a
block is a random part of its source. The targets fix how many block draws each source
gives. A binary tree over the output shards then splits these exact quotas: each node hands its left half a
multivariate hypergeometric part of its counts, the right half the rest, so that every shard gets its
full capacity and the quotas of each source add up exactly. Each shard draws its own, disjoint range of the
source's permuted draws, and rows are shuffled within the shard by a hash.

What is windowed or exploded on its own is bounded: blocks by MAX_BLOCKS a source, tree nodes by shards x
sources. Documents meet block draws by a join on (source, block), over which a source with a third of all rows spreads evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stage, table, text_of

MAX_BLOCKS = 4096
MAX_REPEATS = 3
SHARD_WORDS = 4_000_000
LEAST_SHARDS = 16
SEED = 0


def _key(*parts: Column) -> Column:
    """60 bits of MD5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A row for each source: _source, _s (its place by code point, null last), _size, _docs (with words), _target.

    Weights 1, 2, 3 repeat along the places. A target is its weight's share of all words, at most max_repeats
    times the source's size; the excess goes to the others by weight. With the sources sorted by size over
    weight, the first whose share of what is left fits under its limit fixes the share of all after it."""
    by = sizes.groupBy("_source").agg(F.sum("_size").alias("_size"), F.count(F.when(F.col("_size") > 0, 1)).alias("_docs"))
    everything = Window.partitionBy(F.lit(0))  # one row a source
    by = by.withColumn("_s", F.row_number().over(everything.orderBy(F.col("_source").asc_nulls_last())))
    by = by.withColumn("_w", (F.lit(1) + (F.col("_s") - 1) % 3).cast("double")).withColumn("_cap", (F.col("_size") * max_repeats).cast("double"))
    order = everything.orderBy(F.col("_cap") / F.col("_w"), "_s")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    by = by.withColumn("_level", (F.sum("_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    by = by.withColumn("_capped", F.col("_cap") <= F.col("_level") * F.col("_w")).withColumn("_rank", F.row_number().over(order))
    share = F.min_by("_level", F.when(~F.col("_capped"), F.col("_rank"))).over(everything)
    return by.withColumn("_target", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.least(F.col("_cap"), share * F.col("_w")))).select(
        "_source", "_s", "_size", "_docs", "_target")


def _ln_gamma(x: str) -> str:
    """SQL for ln(gamma(x)), x >= 1: Stirling's series at x + 6, carried back."""
    y = f"({x} + 6D)"
    return (f"(({y} - 0.5D) * ln({y}) - {y} + 0.9189385332046727D + 1D / (12D * {y}) - 1D / (360D * power({y}, 3))"
            f" - ln({x} * ({x} + 1D) * ({x} + 2D) * ({x} + 3D) * ({x} + 4D) * ({x} + 5D)))")


def _let(name: str, value: str, body: str) -> str:
    """SQL with value computed once and known as name in body."""
    return f"transform(array({value}), {name} -> {body})[0]"


def hypergeometric(total: str, good: str, drawn: str, u: str) -> str:
    """SQL: how many of good among drawn out of total, at quantile u; exact inversion within ten standard deviations."""
    ln_p = "-(" + " + ".join(_ln_gamma(f"({v} + 1D)") for v in ("k", "(z.g - k)", "(z.d - k)", "(z.n - z.g - z.d + k)")) + ")"
    found = "aggregate(p, named_struct('c', 0D, 'i', 0), (run, y) -> CASE WHEN run.c < goal THEN named_struct('c', run.c + y, 'i', run.i + 1) ELSE run END).i"
    out = _let("goal", "aggregate(p, 0D, (run, y) -> run + y) * z.u", f"low + greatest(1, {found}) - 1")
    out = _let("p", _let("best", "array_max(l)", "transform(l, y -> exp(y - best))"), out)
    out = _let("l", f"transform(sequence(low, greatest(low, least(z.g, z.d, CAST(ceil(mean + wide) AS BIGINT)))), k -> {ln_p})", out)
    out = _let("low", "greatest(0L, z.d - (z.n - z.g), CAST(floor(mean - wide) AS BIGINT))", out)
    out = _let("wide", "10D * sqrt(mean * (1D - z.g / CAST(z.n AS DOUBLE)) * (z.n - z.d) / greatest(1D, z.n - 1D)) + 2D", out)
    out = _let("mean", "z.d * CAST(z.g AS DOUBLE) / z.n", out)
    return _let("z", f"named_struct('n', {total}, 'g', {good}, 'd', {drawn}, 'u', {u})", out)


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Split each source's draws among the shards. quotas: _s, _draws. Returns _s, _shard, _quota.

    Shard capacities differ by one draw at most. Rows of quota 0 are left out."""
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("_s").cast("int").alias("s"), F.col("_draws").cast("long").alias("n")))).alias("_counts"))
    nodes = nodes.select(F.lit(0).alias("_first"), F.lit(shards).alias("_width"), "_counts")
    one = hypergeometric("greatest(1L, a.total)", "x.n", "a.drawn", "_u(x.s)")
    one = one.replace("_u(x.s)", f"(conv(substring(md5(concat_ws(':', '{seed}', _first, _width, x.s)), 1, 13), 16, 10) / 4503599627370496D)")
    while True:
        nodes = nodes.withColumn("_all", F.expr("aggregate(_counts, 0L, (a, x) -> a + x.n)"))
        # Shard i of the whole tree holds the draws from i * all / shards on; a node's left half keeps this exact.
        nodes = nodes.withColumn("_drawn", F.expr("_all * (_width - floor(_width / 2)) div greatest(1, _width)"))
        left = F.expr("aggregate(_counts, named_struct('total', _all, 'drawn', _drawn, 'left', CAST(array() AS ARRAY<BIGINT>)),"
                      f" (a, x) -> transform(array({one}), d -> named_struct('total', a.total - x.n, 'drawn', a.drawn - d, 'left', concat(a.left, array(d))))[0]).left")
        if shards == 1:
            break
        nodes = nodes.withColumn("_left", F.when(F.col("_width") > 1, left))
        wide = "_width - CAST(floor(_width / 2) AS INT)"
        nodes = nodes.select(F.expr(
            "explode(CASE WHEN _width = 1 THEN array(named_struct('f', _first, 'w', _width, 'c', _counts)) ELSE array("
            f"named_struct('f', _first, 'w', {wide}, 'c', zip_with(_counts, _left, (x, l) -> named_struct('s', x.s, 'n', l))),"
            f"named_struct('f', _first + {wide}, 'w', _width - ({wide}), 'c', zip_with(_counts, _left, (x, l) -> named_struct('s', x.s, 'n', x.n - l)))) END) AS n"
        )).select(F.col("n.f").alias("_first"), F.col("n.w").alias("_width"), F.col("n.c").alias("_counts"))
        shards = (shards + 1) // 2
        nodes = stage(nodes, "mix-tree")
    return nodes.select(F.col("_first").alias("_shard"), F.explode("_counts").alias("c")).select(
        F.col("c.s").alias("_s"), "_shard", F.col("c.n").alias("_quota")).where("_quota > 0")


def plan_draws(rows: DataFrame, max_repeats: int = MAX_REPEATS, max_blocks: int = MAX_BLOCKS,
               shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """rows: _id, _size, _source, _mark (a hash that orders rows of one id, may be absent) and more. Adds _source_size, _target and _draws: array of (shard, epoch, words, key).

    Each source's words over all draws are its target, rounded: whole passes, then whole blocks of a last
    pass, then documents of one block in hash order, of which the last is cut. A document without words is
    never drawn."""
    if "_mark" not in rows.columns:
        rows = rows.withColumn("_mark", F.lit(0))
    rows = rows.withColumn("_h", _key(F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    sources = stage(source_targets(rows, max_repeats).withColumn("_goal", F.round("_target").cast("long")).withColumn(
        "_blocks", F.greatest(F.lit(1), F.least(F.col("_docs"), F.lit(max_blocks)))).withColumn(
        "_full", F.when(F.col("_size") > 0, F.expr("_goal div _size")).otherwise(0)).withColumn(
        "_left", F.when(F.col("_size") > 0, F.expr("_goal % _size")).otherwise(0)).withColumnRenamed("_source", "_name").withColumnRenamed("_size", "_source_size"), "mix-sources")
    placed = rows.join(sources, F.col("_source").eqNullSafe(F.col("_name")), "left").withColumn("_block", F.expr("pmod(_h, _blocks)"))
    order = Window.partitionBy("_s").orderBy("_block")
    blocks = placed.where("_size > 0").groupBy("_s", "_block").agg(F.sum("_size").alias("_words"), F.first("_full").alias("_full"), F.first("_left").alias("_left"))
    blocks = blocks.withColumn("_end", F.sum("_words").over(order))
    blocks = stage(blocks.withColumn("_part", F.expr("least(_words, greatest(0L, _left - (_end - _words)))")), "mix-blocks")
    # _part: words of this block in the last pass; between 0 and all of it in one block a source.
    draws = blocks.select("_s", "_block", F.explode(F.expr("sequence(0, CAST(_full AS INT))")).alias("_epoch"), "_full", "_part").where("_epoch < _full OR _part > 0")
    draws = draws.withColumn("_t", F.row_number().over(Window.partitionBy("_s").orderBy(_key(F.lit(seed + 1), F.col("_s"), F.col("_block"), F.col("_epoch")), "_block", "_epoch")) - 1)
    draws = stage(draws, "mix-draws")
    words = sources.agg(F.sum("_goal")).collect()[0][0] or 0  # one row
    quotas = split_quotas(draws.groupBy("_s").agg(F.count(F.lit(1)).alias("_draws")), max(LEAST_SHARDS, -(-words // shard_words)), seed)
    ends = quotas.withColumn("_to", F.sum("_quota").over(Window.partitionBy("_s").orderBy("_shard")))
    seats = ends.select(F.col("_s").alias("_s2"), "_shard", F.explode(F.expr("sequence(_to - _quota, _to - 1)")).alias("_t2"))
    dealt = draws.join(seats, (F.col("_s") == F.col("_s2")) & (F.col("_t") == F.col("_t2"))).groupBy("_s", "_block").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_epoch").alias("epoch"), F.col("_shard").alias("shard")))).alias("_dealt"))
    cut = blocks.where("_part > 0 AND _part < _words").select("_s", "_block", "_part")
    dealt = stage(dealt.join(cut, ["_s", "_block"], "left").select(F.col("_s").alias("_ds"), F.col("_block").alias("_dblock"), "_dealt", F.col("_part").alias("_cut")), "mix-dealt")
    met = placed.join(dealt, (F.col("_s") == F.col("_ds")) & (F.col("_block") == F.col("_dblock")), "left")
    before = Window.partitionBy("_s").orderBy("_h", "_id", "_mark").rowsBetween(Window.unboundedPreceding, -1)
    partial = met.where("_cut IS NOT NULL").withColumn("_last", F.least(F.col("_size"), F.greatest(
        F.lit(0), F.col("_cut") - F.coalesce(F.sum("_size").over(before), F.lit(0)))))
    whole = met.where("_cut IS NULL").withColumn("_last", F.col("_size"))
    out = whole.unionByName(partial)
    made = F.expr("filter(transform(coalesce(_dealt, array()), d -> named_struct('shard', d.shard, 'epoch', d.epoch, 'words',"
                  " CAST(CASE WHEN d.epoch < _full THEN _size ELSE _last END AS BIGINT), 'key',"
                  f" CAST(conv(substring(md5(concat_ws(':', '{seed + 2}', _h, d.epoch)), 1, 15), 16, 10) AS BIGINT))), d -> d.words > 0)")
    return out.withColumn("_draws", made).drop("_name", "_s", "_docs", "_goal", "_blocks", "_full", "_left", "_block", "_ds", "_dblock", "_dealt", "_cut", "_last", "_h", "_mark")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(id_col).alias("_id"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("_size"), F.col(source_col).alias("_source"), F.xxhash64(text_of(text_col)).alias("_mark")]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed rows: every column of docs, once for each draw, with mix_shard, mix_epoch, mix_words and mix_key.

    A document that the target cuts keeps its first mix_words words, joined by single spaces. Null text has no words
    and is never drawn; a null source is a source of its own, the last. Repeated rows are each drawn on their own. Columns
    of docs are carried in a struct, so names that clash with those used here do no harm, except that a column named like
    one of the four new ones is replaced. An empty table gives an empty one. Sort each shard by mix_key to shuffle it locally."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *_sized(docs, id_col, text_col, source_col))
    drawn = plan_draws(rows, **options).select("_row", "_size", F.explode("_draws").alias("_d"))
    words = F.slice(F.filter(F.split(text_of("_row." + text_col), r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.col("_d.words").cast("int"))
    text = F.when(F.col("_d.words") == F.col("_size"), F.col(f"_row.{text_col}")).otherwise(F.array_join(words, " "))
    added = {"mix_shard": "_d.shard", "mix_epoch": "_d.epoch", "mix_words": "_d.words", "mix_key": "_d.key"}
    return drawn.select(*[text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in added],
                        *[F.col(v).alias(k) for k, v in added.items()])


def write_shards(mixed: DataFrame, path: str) -> None:
    """Write the mix with one folder a shard, each shuffled locally by its keys."""
    mixed.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_key").write.partitionBy("mix_shard").parquet(path)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = stage(docs.select(*_sized(docs, "doc_id", "text", "source")), "mix-sizes")
    return plan_draws(sizes).select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), F.expr("aggregate(_draws, 0L, (a, d) -> a + d.words)").alias("taken"))


QUERIES = {"op5_mixing": op5_mixing}
ORACLES = {"op5_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('0:' || doc_id), 1, 15) AS BIGINT) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) FILTER (size > 0) AS docs,
         row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + (place - 1) % 3 AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / w, place) AS rk FROM w),
t AS (
  SELECT *, CASE WHEN cap <= level * w THEN cap
                 ELSE least(cap, w * (SELECT arg_min(level, rk) FROM l AS x WHERE x.cap > x.level * x.w)) END AS target FROM l),
g AS (
  SELECT *, greatest(1, least(docs, 4096)) AS blocks, CAST(round(target) AS BIGINT) AS goal FROM t),
p AS (
  SELECT d.doc_id, d.size, d.h, g.place, g.source_size, g.target, h % blocks AS block,
         CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN goal % source_size ELSE 0 END AS rest
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
b AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY place ORDER BY block, h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + least(size, greatest(0, rest - before)) AS BIGINT) AS taken FROM b"""}
