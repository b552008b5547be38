"""Removal of passages that repeat across documents: bytes covered by a 50-byte string that starts in an earlier document.

Every 50-byte string is represented by its minimizer, the least hashed KEY-byte string in it, so equal strings meet under an
equal key at about a sixteenth of all places. First the places whose key occurs in two documents are found; only these
send their surroundings (all 50-byte strings that hold the key) on, and the least document of each string
is found among equal hashes. Rows between tasks are packed blobs of thousands of places, dealt by ranges of the hash. Whatever
repeats within a batch is settled there and sent on once, so that a passage or copy in a third of all documents
costs one entry a batch.
"""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of
from .textbytes import Chunk, _byte_values, _powers, chunks, give_back, mix64, utf8

LENGTH, KEY = 50, 20
SPAN = LENGTH - KEY + 1  # keys in a string
AROUND = SPAN - 1 + LENGTH  # bytes of the strings that hold a key
BUCKET_BYTES, STRING_BUCKET_BYTES = 4 << 20, 2 << 20  # of text for each bucket of places, and of surroundings
BIN_BYTES = 32 << 20  # of text whose shared places come together again
BATCH_BYTES = 2 << 20
ROWS = 8192  # entries handled together where each takes many numbers
NO_ID = 2**63 - 1


def anchors(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Places in the chunk that are the minimizer of a string within one text, and their hashes."""
    n = len(c.data) - LENGTH + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    starts = np.arange(n + SPAN - 1)
    least = hashes = c.hashes(c.sums(), starts, starts + KEY)
    at, span = starts.astype(np.int32), 1
    while span < SPAN:  # the least of ever longer runs, the first on ties
        step = min(span, SPAN - span)
        right = least[step:] < least[:-step]
        least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])
        span += step
    inside = np.zeros(n + 1, np.int32)
    long = c.end - c.begin >= LENGTH
    np.add.at(inside, c.begin[long], 1)
    np.add.at(inside, c.end[long] - LENGTH + 1, -1)
    used = at[np.cumsum(inside[:-1]) > 0]
    used = used[np.concatenate(([True], used[1:] != used[:-1]))] if len(used) else used
    return used.astype(np.int64), hashes[used]


def _groups(keys: np.ndarray, doc: np.ndarray):
    """Order by (key, doc); for each place in that order the least doc of its key, and whether the key has another doc."""
    order = np.lexsort((doc, keys))
    first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1]))) if len(order) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(order)))
    low, high = doc[order][first], doc[order][first + size - 1]
    return order, np.repeat(low, size), np.repeat(low != high, size)


def _lists(doc, mark, *columns):
    """Rows (doc, hash of the text, lists) from flat columns."""
    order = np.lexsort((columns[0], mark, doc))
    doc, mark = doc[order], mark[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])))) if len(doc) else np.empty(0, np.int64)
    offsets = pa.array(np.append(new, len(doc)).astype(np.int32))
    return [pa.array(doc[new]), pa.array(mark[new]), *(pa.ListArray.from_arrays(offsets, pa.array(c[order].astype(np.int32))) for c in columns)]


_PLACES = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("mark", pa.int64()), ("at", pa.list_(pa.int32())), ("docs", pa.binary()), ("marks", pa.binary()), ("owners", pa.binary()), ("places", pa.binary()), ("hashes", pa.binary())])
_PLACES_DDL = "bucket int, doc bigint, mark bigint, at array<int>, docs binary, marks binary, owners binary, places binary, hashes binary"


def _slices(batches, rows: int = 256):
    """Smaller batches, as Python objects take more room than Arrow's values."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        give_back()
    give_back()


def _deflate(batches):
    """Texts as they travel: compressed."""
    for batch in _slices(batches):
        packed = pa.array([zlib.compress(t, 1) for t in utf8(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([packed if n == "text" else batch.column(n) for n in batch.schema.names], names=batch.schema.names)


def _inflated(column) -> list[bytes]:
    return [zlib.decompress(t) for t in column.to_pylist()]


def _texts(batches, *more: str):
    """Chunks of about BATCH_BYTES at a time, with what belongs to their texts: lists of (chunk, doc, mark, other columns)."""
    held, size = [], 0
    for batch in _slices(batches):
        texts = _inflated(batch.column("text")) if more else utf8(batch.column("text"))  # what comes with more has travelled
        doc, mark = batch.column("doc").to_numpy(), batch.column("mark").to_numpy()
        other = [batch.column(m).to_pylist() for m in more]
        for c in chunks(texts):
            s = slice(c.first, c.first + len(c.begin))
            held.append((c, doc[s], mark[s], *(o[s] for o in other)))
            size += len(c.data)
            if size >= BATCH_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _planes(x: np.ndarray, keep: int = 4) -> bytes:
    """The upper `keep` bytes of unsigned numbers, all first bytes, then all second ones and so on: bytes that hardly change compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, -keep:].T).tobytes()


def _numbers(blob: bytes, kind, keep: int = 4) -> np.ndarray:
    out = np.zeros((len(blob) // keep, np.dtype(kind).itemsize), np.uint8)
    out[:, -keep:] = np.frombuffer(blob, np.uint8).reshape(keep, -1).T
    return out.reshape(-1).view(kind)


def _pack(schema, n: int, keys, doc, mark, owner, place, more: dict, direct: list):
    """Blob rows by bucket, with a small table of the texts that they name, and the rows that go through as they are."""
    bucket = _bucket(keys, n)
    order = np.lexsort((keys, bucket))
    cuts = np.flatnonzero(np.diff(np.concatenate(([-1], bucket[order], [-1]))))
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[a:b]
        _, first, index = np.unique(owner[at], return_index=True, return_inverse=True)
        rows.append({"bucket": int(bucket[at[0]]), "docs": doc[at[first]].tobytes(), "marks": mark[at[first]].tobytes(), "owners": _planes(index.astype(np.uint32)),
                     "places": _planes(place[at].astype(np.uint32)), **{k: (_planes(v[at].astype(np.uint32)) if k == "hashes" else zlib.compress(v[at].tobytes(), 1)) for k, v in more.items()}})
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)
    if len(direct[0]):
        made = dict(zip([f.name for f in schema][1 : 1 + len(direct)], direct, strict=True))
        made["bucket"] = pa.array(((made["doc"].to_numpy() ^ made["mark"].to_numpy()) & 0x7FFFFFFF) % n, pa.int32())
        yield pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(len(direct[0]), f.type)) for f in schema], schema=schema)


def _unpack(t: pa.Table):
    """doc, mark, place of all entries of the blobs."""
    doc, mark, place = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d, m, o, p in zip(*(t.column(c).to_pylist() for c in ("docs", "marks", "owners", "places")), strict=True):
        if o is not None:
            index = _numbers(o, np.uint32)
            doc.append(np.frombuffer(d, np.int64)[index]), mark.append(np.frombuffer(m, np.int64)[index]), place.append(_numbers(p, np.uint32).astype(np.int64))
    return np.concatenate(doc), np.concatenate(mark), np.concatenate(place)


def _send_places(n: int):
    def run(batches):
        for held in _texts(batches):
            keys, doc, mark, place, text, before = [], [], [], [], [], 0
            for c, d, m in held:
                at, h = anchors(c)
                owner = np.searchsorted(c.begin, at, "right") - 1
                keys.append(h), doc.append(d[owner]), mark.append(m[owner]), place.append(at - c.begin[owner]), text.append(owner + before)
                before += len(d)
            keys, doc, mark, place, text = map(np.concatenate, (keys, doc, mark, place, text))
            order, low, shared = _groups(keys, doc)
            direct = _lists(doc[order][shared], mark[order][shared], place[order][shared])
            sent = order[~shared | np.concatenate(([True], keys[order][1:] != keys[order][:-1]))] if len(order) else order
            yield from _pack(_PLACES, n, keys[sent], doc[sent], mark[sent], text[sent], place[sent], {"hashes": keys[sent]}, direct)
    return run


def _unpacked(t: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(zlib.decompress(x) for x in t.column(column).to_pylist() if x is not None), kind)


_FOUND = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("at", pa.list_(pa.int32()))])


def _shared_places(t: pa.Table) -> pa.Table:
    doc, mark, place = _unpack(t)
    # the lower 32 bits; the upper ones chose the bucket, of which there are as many as the text needs. A chance match only sends a place on
    keys = np.concatenate([np.empty(0, np.uint32), *(_numbers(x, np.uint32) for x in t.column("hashes").to_pylist() if x is not None)])
    order, _, shared = _groups(keys, doc)
    at = order[shared]
    found = pa.Table.from_arrays(_lists(doc[at], mark[at], place[at]), schema=_FOUND)
    through = t.filter(pc.is_valid(t.column("at"))).select(["doc", "mark", "at"]).cast(_FOUND)
    give_back()
    return pa.concat_tables([found, through])


def _binned_ddl(lists: int) -> str:
    return "bin int, docs array<bigint>, marks array<bigint>" + "".join(f", list{i} array<array<int>>" for i in range(lists))


def _binned(of, bins: int):
    """What `of` finds in a bucket (texts and their lists), packed by the bin of the texts: a row for each bin, not for each text."""
    def run(t: pa.Table) -> pa.Table:
        found = of(t).combine_chunks()
        doc, mark = (found.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("doc", "mark"))
        bin_ = (mix64(doc ^ mix64(mark)) % np.uint64(bins)).astype(np.int32)
        order = np.argsort(bin_, kind="stable")
        held, new = found.take(pa.array(order)).combine_chunks(), np.flatnonzero(np.diff(bin_[order], prepend=-1))
        offsets = pa.array(np.append(new, len(order)).astype(np.int32))
        whole = [x.chunk(0) if x.num_chunks else pa.array([], x.type) for x in held.columns]
        names = ["docs", "marks", *(f"list{i}" for i in range(len(whole) - 2))]
        return pa.table({"bin": pa.array(bin_[order][new], pa.int32())} | {n: pa.ListArray.from_arrays(offsets, x) for n, x in zip(names, whole, strict=True)})

    return run


def _unbinned(*names: str):
    """The lists of all texts of a bin, a row for each text."""
    def run(t: pa.Table) -> pa.Table:
        doc, mark = (np.concatenate([np.empty(0, np.int64), *(x.flatten().to_numpy() for x in t.column(c).chunks)]) for c in ("docs", "marks"))
        lists = [pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *(x.flatten() for x in t.column(f"list{i}").chunks)]) for i in range(len(names))]
        owner = np.repeat(np.arange(len(doc)), pc.list_value_length(lists[0]).to_numpy())
        out = pa.Table.from_arrays(_lists(doc[owner], mark[owner], *(x.flatten().to_numpy() for x in lists)), names=["_d", "_m", *names])
        give_back()
        return out

    return run


_STRINGS = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("mark", pa.int64()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())),
                      ("docs", pa.binary()), ("marks", pa.binary()), ("owners", pa.binary()), ("places", pa.binary()), ("valid", pa.binary()), ("bytes", pa.binary())])
_STRINGS_DDL = "bucket int, doc bigint, mark bigint, low array<int>, high array<int>, docs binary, marks binary, owners binary, places binary, valid binary, bytes binary"


def _send_strings(n: int):
    def run(batches):
        for held in _texts(batches, "at"):
            parts, before = [], 0
            for c, d, m, lists in held:
                base, before = before, before + len(d)
                sizes = np.fromiter((len(x) for x in lists), np.int64, len(lists))
                owner = np.repeat(np.arange(len(lists)), sizes)
                if not len(owner):
                    continue
                pairs = np.unique(np.stack([owner, np.fromiter((p for x in lists for p in x), np.int64, len(owner))]), axis=1)
                owner, place = pairs
                sums = c.sums()
                for a in range(0, len(owner), ROWS):  # a part at a time, as each entry takes AROUND numbers on the way
                    o, at = owner[a : a + ROWS], c.begin[owner[a : a + ROWS]] + place[a : a + ROWS]
                    where = (at - (SPAN - 1))[:, None] + np.arange(AROUND)
                    inside = (where >= c.begin[o][:, None]) & (where < c.end[o][:, None])
                    around = np.where(inside, c.data[np.clip(where, 0, len(c.data) - 1)], 0).astype(np.uint8)
                    valid = np.stack([inside.argmax(axis=1), AROUND - inside[:, ::-1].argmax(axis=1)], axis=1).astype(np.uint8)
                    same = mix64((_byte_values()[around] * _powers(AROUND)[0][:AROUND]).sum(axis=1) + valid[:, 0] * np.uint64(977) + valid[:, 1] * np.uint64(131071))
                    parts.append((c.hashes(sums, at, at + KEY), d[o], m[o], place[a : a + ROWS], valid, around, o + base, same))
            if not parts:
                continue
            keys, doc, mark, place, valid, around, text, same = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, low, _ = _groups(same, doc)
            later = order[doc[order] > low]  # the same surroundings stand in an earlier document: all its strings do
            direct = _lists(doc[later], mark[later], place[later] - (SPAN - 1) + valid[later, 0], place[later] - (SPAN - 1) + valid[later, 1])
            sent = order[doc[order] == low]
            yield from _pack(_STRINGS, n, keys[sent], doc[sent], mark[sent], text[sent], place[sent], {"valid": valid[sent], "bytes": around[sent]}, direct)
    return run


_RANGES = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32()))])


def _repeated(t: pa.Table) -> pa.Table:
    """The ranges of bytes covered by strings whose least document is an earlier one."""
    doc, mark, place = _unpack(t)
    valid, around = _unpacked(t, "valid", np.uint8).reshape(-1, 2), _unpacked(t, "bytes", np.uint8).reshape(-1, AROUND)
    up, down = _powers(AROUND)
    # sums of the LENGTH bytes from a start, carried on from one start to the next
    whole = np.empty(len(doc), np.uint64)
    for a in range(0, len(doc), ROWS):
        whole[a : a + ROWS] = (_byte_values()[around[a : a + ROWS, :LENGTH]] * up[:LENGTH]).sum(axis=1)
    # equal strings have their minimizer at the same place, so they stand at the same place around it
    first, last = np.full(len(doc), -1, np.int16), np.full(len(doc), -1, np.int16)
    for start in range(SPAN):
        here = np.flatnonzero((start >= valid[:, 0]) & (start + LENGTH <= valid[:, 1]))
        order, low, _ = _groups(mix64(whole[here] * down[start]), doc[here])
        if start + 1 < SPAN:
            whole += _byte_values()[around[:, start + LENGTH]] * up[start + LENGTH] - _byte_values()[around[:, start]] * up[start]
        again = here[order[doc[here[order]] > low]]
        first[again] = np.where(first[again] < 0, start, first[again])
        last[again] = start
    row = np.flatnonzero(last >= 0)  # starts are less than LENGTH apart, so their strings overlap
    at = place[row].astype(np.int64) - (SPAN - 1)
    merged = _merge(doc[row], mark[row], at + first[row], at + last[row] + LENGTH)
    through = t.filter(pc.is_valid(t.column("low"))).select(["doc", "mark", "low", "high"]).cast(_RANGES)
    del whole, around, order, low, again, first, last, row, at
    give_back()
    return pa.concat_tables([pa.Table.from_arrays(_lists(*merged), schema=_RANGES), through])


def _merge(doc, mark, low, high):
    """Union of overlapping ranges within each text."""
    order = np.lexsort((low, mark, doc))
    doc, mark, low, high = doc[order], mark[order], low[order], high[order]
    if not len(doc):
        return doc, mark, low, high
    base = np.concatenate(([0], np.cumsum((doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])))) << 40
    top = np.maximum.accumulate(high + base)
    first = np.flatnonzero(np.concatenate(([True], low[1:] + base[1:] > top[:-1])))
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], mark[first], low[first], (top - base)[last]


def _cut(text: bytes, low: list[int], high: list[int]) -> tuple[int, list[bytes]]:
    """Number of maximal removed runs, and what is left."""
    left, at, spans = [], 0, 0
    for a, b in sorted(zip(low, high, strict=True)):
        if a > at or not spans:
            spans += 1
            left.append(text[at:a])
        at = max(at, b)
    return spans, [*left, text[at:]]


def _results(batches):
    for batch in _slices(batches):
        out = []
        for t, low, high in zip(_inflated(batch.column("text")), batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True):
            spans, left = _cut(t, low or [], high or [])
            kept = b"".join(left)
            out.append((len(t), len(t) - len(kept), spans, sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))],
                                         names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs id_col, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left), kept (these as text, without broken characters).

    Removes each byte covered by a LENGTH-byte string that also starts in a row with a smaller id. Texts are judged as they come
    in, as UTF-8; null is empty. Rows with equal ids don't count against each other. A null id is larger than all. Texts shorter than LENGTH stay
    whole. Other columns are ignored; an empty table gives no rows. Equal strings are told by 64-bit hashes."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), text_of(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    size = base.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0  # one row
    n, m = max(1, size // BUCKET_BYTES), max(1, size // STRING_BUCKET_BYTES)
    flat = base.select("doc", "mark", "text")
    bins = max(1, size // BIN_BYTES)

    def found(df, of, *names):
        packed = df.groupBy("bucket").applyInArrow(_binned(of, bins), _binned_ddl(len(names)))
        return packed.groupBy("bin").applyInArrow(_unbinned(*names), "_d bigint, _m bigint" + "".join(f", {n} array<int>" for n in names))

    there = found(flat.mapInArrow(_send_places(n), _PLACES_DDL), _shared_places, "at")
    # both joins take the same columns of this, none of them null, so that Spark shuffles the texts once and uses that twice
    sent = base.mapInArrow(_deflate, f"id {kind}, doc bigint NOT NULL, text binary, mark bigint NOT NULL")
    met = sent.join(there, (F.col("doc") == F.col("_d")) & (F.col("mark") == F.col("_m"))).select("id", "doc", "mark", "text", "at")
    cuts = found(met.mapInArrow(_send_strings(m), _STRINGS_DDL), _repeated, "low", "high")
    whole = sent.join(cuts, (F.col("doc") == F.col("_d")) & (F.col("mark") == F.col("_m")), "left").select("id", "text", "low", "high")
    out = whole.mapInArrow(_results, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string")
    return out.withColumnRenamed("id", id_col)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op6_repeats": op6_repeats}
ORACLES: dict[str, str] = {}
