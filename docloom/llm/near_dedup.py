"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union of links.

The set of a text is its distinct 5-word shingles as 64-bit hashes. Equal sets are one node (their link is
certain), so a group of copies, however large, costs one row. Nodes that share a band are linked to the
bucket's smallest node, and then to the one that has most in common with others, when their full sets confirm it; then every pair of
a bucket that these links leave in different components is verified as well, unless exact bounds rule it out: the triangle inequality for the Jaccard
distance, and the shingles that only one of the nodes has. No bucket is capped, and pairs within what is already one component are
never emitted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, text_of
from .textbytes import chunks, mix64, utf8, windows

SHINGLE = 5
BANDS, ROWS = 20, 4  # at a similarity of 0.85 a pair misses all bands once in 2.5 million
PERCENT = 85


def superminhash(elements: np.ndarray, m: int) -> np.ndarray:
    """Signature of a set of distinct 64-bit elements: m values, each the least r + rank that falls to its slot.

    Element e gives the slots of its own random permutation the values r_0, 1 + r_1, 2 + r_2, ... All elements
    take rank j together; ranks stop as soon as no slot's value exceeds the next rank."""
    least = np.full(m, np.inf)
    order = None
    rows = np.arange(len(elements))
    for j in range(m):
        bits = mix64(elements + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        value = j + (bits >> np.uint64(11)).astype(np.float64) * 2.0**-53
        swap = j + ((mix64(bits) >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            slot, first = swap, swap
        else:
            if order is None:  # few sets get here with many elements; Fisher-Yates from the start
                order = np.broadcast_to(np.arange(m, dtype=np.int16), (len(elements), m)).copy()
                order[rows, 0], order[rows, first] = first, 0
            slot = order[rows, swap].astype(np.int64)
            order[rows, swap] = order[:, j]
        np.minimum.at(least, slot, value)
        if least.max() <= j + 1:
            break
    return least


def _sets(batch, key: str, k: int):
    """For each text of the batch, in order, its distinct shingles, sorted."""
    for c in chunks(t.lower() for t in utf8(batch.column(key))):  # bytes.lower() touches A-Z only
        begin, end, text = c.words()
        hashes = c.hashes(c.sums(), begin, end)
        runs, first = windows(hashes, text, k)
        n = len(c.begin)
        per = np.bincount(text, minlength=n)
        from_word, from_run = np.searchsorted(text, np.arange(n + 1)), np.searchsorted(text[first], np.arange(n + 1))
        for i in range(n):
            if per[i] >= k:
                yield np.unique(runs[from_run[i] : from_run[i + 1]])
            elif per[i]:  # the whole sequence is the one shingle
                own = hashes[from_word[i] : from_word[i + 1]]
                yield mix64(np.bitwise_xor.reduce(mix64(own + np.arange(1, per[i] + 1, dtype=np.uint64)), keepdims=True) + np.uint64(per[i]))
            else:
                yield np.empty(0, np.uint64)


def _signatures(k: int, bands: int, rows: int):
    def run(batches):
        odd = mix64(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            sizes, prints, keys = [], [], []
            for s in _sets(batch, "_text", k):
                sizes.append(len(s))
                if not len(s):
                    prints.append(None), keys.append(None)
                    continue
                prints.append(np.array([s.sum(), mix64(s ^ np.uint64(len(s))).sum()], np.uint64).tobytes())
                bits = superminhash(s, bands * rows).view(np.uint64).reshape(bands, rows)
                keys.append(mix64((bits * odd).sum(axis=1) + np.arange(bands, dtype=np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_hash"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                                             names=["_id", "_hash", "_n", "_print", "_bands"])
    return run


def _full_sets(k: int):
    def run(batches):
        for batch in batches:
            sets = [s.view(np.int64) for s in _sets(batch, "_text", k)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sets, pa.list_(pa.int64()))], names=["_id", "_set"])
    return run


def components(edges: DataFrame) -> DataFrame:
    """edges: _a, _b. Each node that has a link, with the smallest node of its component: _node, _comp.

    Large-star and small-star rounds until nothing changes: a node's neighbours are tied to the least node
    around it. Minima are aggregated before the shuffle and joined back from a staged table, so a node may have any number of links."""
    now = stage(edges.where("_a <> _b").select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).distinct(), "links")
    seen = None
    while True:  # each round shortens paths or changes nothing
        both = now.unionByName(now.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        low = stage(both.groupBy(F.col("_a").alias("_u")).agg(F.min("_b").alias("_m")).select("_u", F.least("_u", "_m").alias("_m")), "links-low")
        # large star: larger neighbours go to the least node around
        now = both.where("_b > _a").join(low, F.col("_a") == F.col("_u")).select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))
        # small star: the node and its smaller neighbours go to the least of these
        now = stage(now.where("_a <> _b").distinct(), "links")
        low = stage(now.groupBy(F.col("_a").alias("_u")).agg(F.min("_b").alias("_m")), "links-low")
        tied = now.join(low, F.col("_a") == F.col("_u")).select(F.explode(F.array(
            F.struct(F.col("_b").alias("_a"), F.col("_m").alias("_b")), F.struct(F.col("_a").alias("_a"), F.col("_m").alias("_b")))).alias("e"))
        now = stage(tied.select("e.*").where("_a <> _b").distinct(), "links")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_a", "_b").cast("decimal(20,0)"))).collect()[0]  # one row
        if state == seen:
            break
        seen = state
    pairs = now.select(F.col("_a").alias("_node"), F.col("_b").alias("_comp"))
    return stage(pairs.unionByName(pairs.select(F.col("_comp").alias("_node"), "_comp")).distinct(), "components")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (_a, _b) with _meet and _join, the sizes of intersection and union of their full sets."""
    one, two = sets.select(F.col("_id").alias("_ia"), F.col("_set").alias("_sa")), sets.select(F.col("_id").alias("_ib"), F.col("_set").alias("_sb"))
    met = pairs.join(two, F.col("_b") == F.col("_ib")).join(one, F.col("_a") == F.col("_ia"))
    met = met.withColumn("_meet", F.size(F.array_intersect("_sa", "_sb")))
    return met.select("_a", "_b", "_meet", (F.size("_sa") + F.size("_sb") - F.col("_meet")).alias("_join"))


def _differing_pairs(around: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """around: _centre, _node, _comp. Pairs (_a, _b) of nodes around one centre, in different components, that may be linked.

    With c shingles in the centre, m of which a node misses, and e of its own, let w = 100 m + percent e. Two nodes with o
    differences in common are linked when w1 + w2 - (100 + percent) o <= (100 - percent) c, their right side the slack. Nodes of
    w within the slack are linked with the centre, so one of a pair has more, and counts alone decide unless differences are shared: o must
    exceed w / (100 + percent) for each of two such nodes and for the nearer one, and (w - slack) / 100 for a far node beside a near one. So
    pairs meet by the rarest of their shared differences, as many as the bound leaves free, at a place from which enough of them remain. Differences that
    only one node around the centre has can't be shared and are left out."""
    several = stage(around.groupBy("_centre").agg(F.min("_comp").alias("_low"), F.max("_comp").alias("_high")).where("_low <> _high").select(F.col("_centre").alias("_c")), "near-several")
    told = around.join(several, F.col("_centre") == F.col("_c"), "left_semi")
    middle = stage(several.join(sets, F.col("_c") == F.col("_id")).select("_c", F.col("_set").alias("_middle")), "near-middles")
    met = told.join(sets, F.col("_node") == F.col("_id")).join(middle, F.col("_centre") == F.col("_c"))
    met = met.select("_centre", "_node", "_comp", F.size("_middle").alias("_size"), F.array_except("_middle", "_set").alias("_missing"), F.array_except("_set", "_middle").alias("_extra"))
    w = 100 * F.size("_missing") + percent * F.size("_extra")
    apart = met.select("_centre", "_node", "_comp", w.alias("_w"), ((100 - percent) * F.col("_size")).alias("_slack"), F.concat("_missing", "_extra").alias("_diff")).where(F.size("_diff") > 0)
    apart = stage(apart, "near-apart")
    each = apart.select("_centre", "_node", F.explode("_diff").alias("_d"))
    often = stage(each.groupBy("_centre", "_d").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_centre").alias("_oc"), F.col("_d").alias("_od"), "_n"), "near-often")
    ranked = each.join(often, (F.col("_centre") == F.col("_oc")) & (F.col("_d") == F.col("_od")))
    # a node's own differences, rarest first
    ranked = ranked.groupBy("_centre", "_node").agg(F.array_sort(F.collect_list(F.struct("_n", "_d"))).alias("_order")).withColumnRenamed("_centre", "_rc").withColumnRenamed("_node", "_rn")
    ranked = apart.drop("_diff").join(ranked, (F.col("_centre") == F.col("_rc")) & (F.col("_node") == F.col("_rn"))).drop("_rc", "_rn")
    far = F.col("_w") > F.col("_slack")
    free = F.size("_order") - F.floor(F.col("_w") / (100 + percent))
    free_near = F.when(far, F.size("_order") - F.greatest(F.lit(1), F.ceil((F.col("_w") - F.col("_slack")) / 100)) + 1).otherwise(0)
    ranked = ranked.select("_centre", "_node", "_comp", "_w", "_slack", far.alias("_far"), F.size("_order").alias("_all"), free.alias("_free"), free_near.alias("_free_near"),
                           F.posexplode(F.slice("_order", F.lit(1), F.greatest(F.lit(0), free, free_near).cast("int"))).alias("_at", "_o"))
    rows = stage(ranked.withColumn("_d", F.col("_o._d")).withColumn("_left", F.col("_all") - F.col("_at")).drop("_o", "_all"), "near-rarest")
    one, two = rows.where("_far"), rows.where("_at < _free").select(*[F.col(c).alias(c + "2") for c in ("_centre", "_d", "_node", "_comp", "_w", "_far", "_left")])
    enough = F.least("_left", "_left2") * (100 + percent) >= F.col("_w") + F.col("_w2") - F.col("_slack")
    both = one.join(two, (F.col("_centre") == F.col("_centre2")) & (F.col("_d") == F.col("_d2")) & (F.col("_comp") != F.col("_comp2")) & enough
                    & F.when(F.col("_far2"), (F.col("_node") < F.col("_node2")) & (F.col("_at") < F.col("_free"))).otherwise(F.col("_at") < F.col("_free_near")))
    return both.select(F.least("_node", "_node2").alias("_a"), F.greatest("_node", "_node2").alias("_b")).distinct()


def _majority(placed: DataFrame) -> DataFrame:
    """Of the buckets (_b2, _k2) that hold several components the one with most nodes, _most."""
    shares = placed.groupBy("_band", "_bkey", "_comp").agg(F.count(F.lit(1)).alias("_c"))
    return shares.groupBy("_band", "_bkey").agg(F.count(F.lit(1)).alias("_comps"), F.max_by("_comp", F.struct("_c", "_comp")).alias("_most")).where("_comps > 1").select(
        F.col("_band").alias("_b2"), F.col("_bkey").alias("_k2"), "_most")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, k: int = SHINGLE,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each row of docs id_col, text_hash, n_shingles, component_id, kept.

    Words are lower-cased in A-Z only. Two texts are linked when 100 * common shingles >= percent * all their
    shingles. A text of fewer than k words has one shingle, all of it; a null or wordless text has none and is
    linked with nothing. component_id is the smallest id reachable by links, kept marks the row that has it.
    Ids are expected to be distinct integers; rows that repeat an id get the same verdict if their texts are equal. Null ids come back alone, with component_id null
    and kept true. Other columns are ignored; an empty table gives no rows."""
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    hashed = texts.withColumn("_hash", F.xxhash64(text_of("_text")))
    signed = stage(hashed.mapInArrow(_signatures(k, bands, rows), "_id bigint, _hash bigint, _n bigint, _print binary, _bands array<bigint>"), "near-signatures")
    same = signed.where("_n > 0 AND _id IS NOT NULL").groupBy("_print").agg(F.min("_id").alias("_node"))
    nodes = stage(same.select(F.col("_print").alias("_p"), "_node"), "near-nodes")
    # one band array a node
    heads = signed.join(nodes, (F.col("_print") == F.col("_p")) & (F.col("_id") == F.col("_node"))).dropDuplicates(["_node"])
    slots = stage(heads.select("_node", "_n", F.posexplode("_bands").alias("_band", "_bkey")), "near-slots")
    full = stage(slots.groupBy("_band", "_bkey").agg(F.count(F.lit(1)).alias("_size"), F.min("_node").alias("_head")).where("_size > 1")
                 .select(F.col("_band").alias("_b1"), F.col("_bkey").alias("_k1"), "_head"), "near-buckets")
    held = stage(slots.join(full, (F.col("_band") == F.col("_b1")) & (F.col("_bkey") == F.col("_k1"))).select("_band", "_bkey", "_node", "_n", "_head"), "near-held")
    star = stage(held.where("_node <> _head").select(F.col("_head").alias("_a"), F.col("_node").alias("_b")).distinct(), "near-star")
    # full sets of the nodes that share a bucket, from their whole texts
    wanted = stage(held.select(F.col("_node").alias("_w")).distinct(), "near-wanted")
    again = texts.join(wanted, F.col("_id") == F.col("_w"), "left_semi")
    sets = stage(again.mapInArrow(_full_sets(k), "_id bigint, _set array<bigint>").dropDuplicates(["_id"]), "near-sets")
    judged = stage(_verified(star, sets), "near-judged")
    linked = F.col("_meet") * 100 >= F.col("_join") * percent
    links = judged.where(linked).select("_a", "_b")
    comps = components(links)
    # what is left: pairs of a bucket in different components
    placed = held.join(comps.withColumnRenamed("_node", "_cn"), F.col("_node") == F.col("_cn"), "left").withColumn("_comp", F.coalesce("_comp", "_node")).drop("_cn")
    placed = placed.join(judged.select(F.col("_a").alias("_ja"), F.col("_b").alias("_jb"), (1 - F.col("_meet") / F.col("_join")).alias("_far")),
                         (F.col("_head") == F.col("_ja")) & (F.col("_node") == F.col("_jb")), "left")
    placed = stage(placed.select("_band", "_bkey", "_node", "_n", "_comp", F.coalesce("_far", F.lit(0.0)).alias("_far")), "near-placed")
    mixed = stage(_majority(placed), "near-mixed")
    open_ = stage(placed.join(mixed, (F.col("_band") == F.col("_b2")) & (F.col("_bkey") == F.col("_k2"))).drop("_b2", "_k2"), "near-open")
    # shingles that no other of these nodes has can't be common to a pair: they bound every intersection
    here = open_.select(F.col("_node").alias("_on")).distinct()
    own = sets.join(here, F.col("_id") == F.col("_on"), "left_semi").select(F.explode("_set").alias("_sh"), "_id").groupBy("_sh").agg(F.count(F.lit(1)).alias("_c"), F.min("_id").alias("_owner"))
    own = stage(own.where("_c = 1").groupBy("_owner").agg(F.count(F.lit(1)).alias("_alone")), "near-own")
    open_ = open_.join(own, F.col("_node") == F.col("_owner"), "left").withColumn("_most_common", F.col("_n") - F.coalesce("_alone", F.lit(0))).drop("_owner", "_alone")
    open_ = stage(open_.where((F.col("_far") > 0) & (F.col("_most_common") * 100 >= F.col("_n") * percent)), "near-able")
    # a second star from the node of each bucket that has most in common with others: the original among its edited copies
    best = stage(open_.groupBy("_band", "_bkey").agg(F.max_by(F.struct("_node", "_comp"), F.struct(F.col("_most_common") / F.col("_n"), -F.col("_node"))).alias("_h"))
                 .select(F.col("_band").alias("_b3"), F.col("_bkey").alias("_k3"), F.col("_h._node").alias("_head3"), F.col("_h._comp").alias("_comp3")), "near-best")
    second = open_.join(best, (F.col("_band") == F.col("_b3")) & (F.col("_bkey") == F.col("_k3")) & (F.col("_comp") != F.col("_comp3")))
    second = stage(second.select(F.least("_node", "_head3").alias("_a"), F.greatest("_node", "_head3").alias("_b")).distinct(), "near-second")
    found = _verified(second, sets).where(linked).select("_a", "_b")
    comps = components(comps.select(F.col("_node").alias("_a"), F.col("_comp").alias("_b")).unionByName(found))
    # what is left lies around the centres: pairs of nodes in different components, neither of them the centre
    around = open_.select("_band", "_bkey", "_node").join(best, (F.col("_band") == F.col("_b3")) & (F.col("_bkey") == F.col("_k3"))).select(F.col("_head3").alias("_centre"), "_node").distinct()
    around = around.join(comps.withColumnRenamed("_node", "_cn"), F.col("_node") == F.col("_cn"), "left").select("_centre", "_node", F.coalesce("_comp", "_node").alias("_comp"))
    rest = stage(_differing_pairs(stage(around, "near-around"), sets, percent), "near-rest")
    more = _verified(rest, sets).where(linked).select("_a", "_b")
    # components as they are, and the links between them
    tied = comps.select(F.col("_node").alias("_a"), F.col("_comp").alias("_b")).unionByName(more)
    final = components(tied).withColumnRenamed("_node", "_fn")
    groups = stage(nodes.join(final, F.col("_node") == F.col("_fn"), "left").select("_p", F.coalesce("_comp", "_node").alias("_group")), "near-groups")
    out = signed.join(groups, F.col("_print") == F.col("_p"), "left").withColumn("_group", F.coalesce("_group", "_id"))
    return out.select(F.col("_id").alias(id_col), F.col("_hash").alias("text_hash"), F.col("_n").alias("n_shingles"), F.col("_group").alias("component_id"),
                      F.coalesce(F.col("_id") == F.col("_group"), F.lit(True)).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


QUERIES = {"op4_near_dedup": op4_near_dedup}
ORACLES: dict[str, str] = {"op4_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
x AS (SELECT doc_id, unnest(shingles) AS sh FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS meet FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * meet >= 85 * (na.n + nb.n - meet)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id, n.doc_id = min(root) AS kept
FROM n JOIN r ON r.node = n.doc_id GROUP BY 1, 2"""}
