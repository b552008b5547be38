"""Ranked lexical search: document-at-a-time merges over compressed postings, shard by shard.

A shard is what some megabytes of text in one task hold: its documents in order of their ids, and for each asked term the places
of its documents in that order with the term's occurrences, as differences in variable-length bytes. Shards are
one row each, so nothing is shuffled and no term's postings ever come together. Counts over all shards give the weights.
For each item a task merges the item's postings of a shard by a heap keyed by the next document of each list: a step takes the
least document and a run of documents from there on, completes their scores together and offers them to the item's bounded heap,
keyed by score, then id. Tasks keep that heap over all their shards; the best of each item are merged at the end.

The query set comes in blocks of a bounded number of bytes, which are all that is sent to the tasks.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, stage, table, text_of
from .textbytes import LETTERS_DIGITS, batches_by_bytes, give_back, terms_of, utf8

TOP = 10
RUN = 4096  # documents that a merge completes together
BLOCK_BYTES = 8 << 20  # of items handled in one pass over the documents
SHARD_BYTES = 16 << 20  # of text in a shard
NO_ID = 2**63 - 1  # ranks rows without id after all others of their score

_SHARD = pa.schema([("ids", pa.binary()), ("lengths", pa.binary()), ("terms", pa.list_(pa.int32())), ("docs", pa.list_(pa.int64())), ("postings", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())])
_FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def pack(values: np.ndarray) -> bytes:
    """Non-negative numbers as groups of seven bits, the lowest first, the top bit set on all but a number's last byte."""
    left, columns = values.astype(np.uint64), []
    size = np.ones(len(left), np.int64)
    while True:
        more = left >= 128
        columns.append((left & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7))
        left = left >> np.uint64(7)
        if not more.any():
            break
        size += left > 0
    table_ = np.stack(columns, axis=1)
    return table_[np.arange(len(columns)) < size[:, None]].tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    begins = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    shift = (np.arange(len(raw)) - np.repeat(begins, ends - begins + 1)).astype(np.uint64) * np.uint64(7)
    parts = (raw & 127).astype(np.uint64) << shift
    return np.add.reduceat(parts, begins).astype(np.int64) if len(ends) else np.empty(0, np.int64)


def _zigzag(x: np.ndarray) -> np.ndarray:
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def _unzigzag(x: np.ndarray) -> np.ndarray:
    x = x.view(np.uint64)
    return (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)


def _index(words: list[bytes]) -> Callable:
    """A task that makes shards for these terms, numbered in order, of rows (id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(words, pa.binary())
        for batch in batches:
            for part in batches_by_bytes(batch, "text", SHARD_BYTES):
                ids = part["id"].to_numpy(zero_copy_only=False) if not part["id"].null_count else pc.fill_null(part["id"], NO_ID).to_numpy()
                doc, code, found = terms_of(utf8(part["text"]), LETTERS_DIGITS)
                lengths = np.bincount(doc, minlength=len(ids))
                order = np.argsort(ids, kind="stable")
                order = order[lengths[order] > 0]  # a document without terms is in no list
                place = np.full(len(ids), -1, np.int64)
                place[order] = np.arange(len(order))
                number = pc.fill_null(pc.index_in(found.cast(pa.binary()), asked), -1).to_numpy().astype(np.int64)
                term = number[code] if len(code) else np.empty(0, np.int64)
                here, times = np.unique(term[term >= 0] * len(ids) + place[doc[term >= 0]], return_counts=True)
                at, of = here % max(1, len(ids)), here // max(1, len(ids))
                terms, begin, docs = np.unique(of, return_index=True, return_counts=True)
                gaps = np.diff(at, prepend=0)
                gaps[begin] = at[begin]
                postings = np.empty(2 * len(at), np.int64)
                postings[::2], postings[1::2] = gaps, times
                jumps = np.diff(ids[order], prepend=0)  # wraps around for ids far apart, and back on reading
                yield pa.RecordBatch.from_pylist([{"ids": pack(_zigzag(jumps)), "lengths": pack(lengths[order]), "terms": terms.tolist(), "docs": docs.tolist(), "postings": pack(postings),
                                                   "n_docs": len(order), "n_terms": int(lengths.sum())}], schema=_SHARD)
            give_back()

    return run


@dataclass
class Shard:
    """A shard with its postings unpacked: places and worth of a document for a term are places[begin[t]:end[t]], worth[...]."""

    ids: np.ndarray
    places: np.ndarray
    worth: np.ndarray
    lists: dict[int, tuple[int, int]]

    @classmethod
    def read(cls, row: dict, n_docs: int, n_terms: int) -> Shard:
        lengths, docs = unpack(row["lengths"]), np.array(row["docs"], np.int64)
        postings = unpack(row["postings"])
        gaps, times = postings[::2], postings[1::2]
        end = np.cumsum(docs)
        begin = end - docs
        run = np.cumsum(gaps)
        places = run - np.repeat((run[begin] - gaps[begin]) if len(docs) else docs, docs)
        if len(lengths) and 75 * int(lengths.max()) * n_docs >= 2**63:
            m = np.array([25 + 75 * int(n) * n_docs // n_terms for n in lengths], np.int64)
        else:
            m = 25 + 75 * lengths * n_docs // max(1, n_terms)
        worth = 1_000_000_000 * times // (1000 * times + 8 * m[places])
        return cls(np.cumsum(_unzigzag(unpack(row["ids"]))), places, worth, {t: (int(b), int(e)) for t, b, e in zip(row["terms"], begin, end, strict=True)})


class Best:
    """The TOP best of an item so far: a heap with the worst on top, by score, then by the id turned around."""

    def __init__(self, top: int) -> None:
        self.top, self.heap = top, []

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        floor = self.heap[0][0] if len(self.heap) == self.top else 1
        good = np.flatnonzero(scores >= floor)
        if len(good) > self.top:
            good = good[np.lexsort((ids[good], -scores[good]))[: self.top]]
        for s, i in zip(scores[good].tolist(), ids[good].tolist(), strict=True):
            if len(self.heap) < self.top:
                heapq.heappush(self.heap, (s, -i))
            else:
                heapq.heappushpop(self.heap, (s, -i))


def merge(shard: Shard, weights: list[tuple[int, int]], best: Best) -> None:
    """Score the shard's documents for one item, whose terms and weights are given, in order of their ids."""
    heads = [(int(shard.places[shard.lists[t][0]]), *shard.lists[t], w) for t, w in weights if t in shard.lists]
    heapq.heapify(heads)
    while heads:
        low = heads[0][0]
        scores = np.zeros(RUN, np.int64)
        while heads and heads[0][0] < low + RUN:
            _, at, end, w = heads[0]
            to = at + int(np.searchsorted(shard.places[at:end], low + RUN))
            scores[shard.places[at:to] - low] += w * shard.worth[at:to]
            if to < end:
                heapq.heapreplace(heads, (int(shard.places[to]), to, end, w))
            else:
                heapq.heappop(heads)
        ids = shard.ids[low : low + RUN]
        best.offer(ids, scores[: len(ids)])


def _rank(items: list[tuple[int, list[tuple[int, int]]]], n_docs: int, n_terms: int, top: int) -> Callable:
    """A task that ranks the documents of its shards for each item, a list of (term, weight)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {i: Best(top) for i, _ in items}
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard.read(batch.slice(k, 1).to_pylist()[0], n_docs, n_terms)
                for i, weights in items:
                    merge(shard, weights, best[i])
        rows = [{"item": i, "doc_id": None if d == -NO_ID else -d, "score": s} for i, b in best.items() for s, d in b.heap]
        yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)
        give_back()

    return run


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple[int, object, str]]]:
    """Lists of (number, id, text) of at most so many bytes, or of one item."""
    held, used = [], 0
    for number, r in enumerate(items.toLocalIterator(prefetchPartitions=True)):
        more = len(r["text"].encode())
        if held and used + more > size:
            yield held
            held, used = [], 0
        held.append((number, r["id"], r["text"]))
        used += more
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item, at most top of them, with scores above 0.

    Each row of items is an item and each row of docs a document, equal rows and ids too. Null or empty texts have no terms: such items get no rows, such documents
    count nowhere. Equal scores rank by ascending id, a null id last. Other columns are ignored, whatever their names. Empty tables give no rows."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("id"), text_of(text_col).alias("text"))
    kind = asked.schema["id"].dataType
    paths = []
    for block in _blocks(asked, block_bytes):
        owner, code, words = terms_of([t.encode() for _, _, t in block], LETTERS_DIGITS)
        vocabulary = words.cast(pa.binary()).to_pylist()
        index = stage(texts.mapInArrow(_index(vocabulary), "ids binary, lengths binary, terms array<int>, docs array<long>, postings binary, n_docs long, n_terms long"), "search-index")
        n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        held = index.select(F.explode(F.arrays_zip("terms", "docs")).alias("x")).groupBy("x.terms").agg(F.sum("x.docs").alias("df")).collect()  # a row a term of the block
        weight = {r["terms"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in held}
        times = [Counter() for _ in block]
        for o, c in zip(owner.tolist(), code.tolist(), strict=True):
            times[o][c] += 1
        weights = [(i, [(t, n * weight[t]) for t, n in sorted(times[o].items()) if weight.get(t)]) for o, (i, _, _) in enumerate(block)]
        found = index.mapInArrow(_rank([x for x in weights if x[1]], n_docs, n_terms, top), "item long, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = F.broadcast(spark.createDataFrame([(i, x) for i, x, _ in block], "item long, item_id " + kind.simpleString()))
        path = new_path(spark, "search-best")
        ranked.join(names, "item").select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), "doc_id", "score").write.parquet(path)
        paths.append(path)
    return spark.read.parquet(*paths) if paths else spark.createDataFrame([], f"{item_col} {kind.simpleString()}, rank int, doc_id long, score long")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
m AS (SELECT rid, doc_id, 25 + (75 * len(w) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
u AS (SELECT rid, unnest(w) AS term FROM d),
f AS (SELECT rid, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM i) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, n_docs),
r AS (
  SELECT item_id, doc_id, rid, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN f USING (term) JOIN m USING (rid) GROUP BY item_id, doc_id, rid HAVING score > 0),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {TOP}"""

QUERIES = {"op13_ranked_search": op13_ranked_search}
ORACLES = {"op13_ranked_search": ORACLE}
