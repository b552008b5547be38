"""SentencePiece encoding and decoding on a relational lattice.

Spaces of a text turn into U+2581 and one more is put in front; then the text is cut before each run of these marks, and
between letters and such punctuation as no piece of the model joins to them. So the best path of a text is that of its words. For each
distinct word of the corpus, the bounded-length substrings of every place are exploded, joined by equality to the piece table, grouped
by word as lattice edges, and folded by Spark's higher-order aggregate into the best path (Viterbi, the longest last piece
on ties). A character that is no piece is an edge of its own and comes out as byte pieces. Pieces that a better path over
their own characters beats can't be on any best path and are left out of the table.

The piece table is bounded by the model. Of words, the most common (at most `frequent`, of at most COMMON_CHARS characters) go to all tasks in a table
of that bounded size; which these are changes the cost only. Other words are looked up by a shuffle of (text, word) pairs. Texts travel as
compressed numbers of their words to where the ids of these arrive, and are put together and decoded there, a row each. Tasks cut texts on whole
arrays of bytes and know words by 64-bit hashes; should two words have one hash, round_trip is false for the texts concerned.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from hashlib import md5
from importlib.util import find_spec
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, text_of
from .textbytes import Chunk, chunks, give_back, utf8

SPACE_MARK = "▁"
FREQUENT = 1_048_576
COMMON_CHARS = 64
UNKNOWN_PENALTY = 10.0
FEW_JOINED = 3
BLOCK = 128  # places of a word that are folded together
HELD = 1_000_000  # different words that a task holds at once
PLACES = 400_000  # places of words that a task puts together


def default_model() -> str:
    """The public model beside its package; an error where that isn't installed and no model is named."""
    found = find_spec("public_tokenizers")
    if found is None or not found.origin:
        raise FileNotFoundError("the package public_tokenizers isn't installed: name a model file")
    return str(Path(found.origin).with_name("piece_bpe_32k.model"))


class Pieces:
    """The piece table of a model file, small and read on the driver: text, id, score; ids of bytes; the longest piece."""

    def __init__(self, model_file: str | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file or default_model())
        ids = range(model.get_piece_size())
        self.rows = [(model.id_to_piece(i), i, float(model.get_score(i))) for i in ids
                     if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.unknown_id = model.unk_id()
        self.unknown_score = min(s for _, _, s in self.rows) - UNKNOWN_PENALTY
        pairs = {(a, b) for p, _, _ in self.rows for a, b in zip(p, p[1:], strict=False)}
        if any(b == SPACE_MARK != a for a, b in pairs):
            raise ValueError("the model has pieces that cross word borders")
        plain = lambda c: unicodedata.category(c)[0] in "LN"
        met = {chr(n): {y for a, b in pairs for x, y in ((a, b), (b, a)) if x == chr(n) and plain(y)} for n in range(128) if not chr(n).isalnum()}
        #: ASCII characters that pieces join to few letters and digits or none, and those few: words are cut between the former and all other letters and digits.
        self.apart = {c for c, others in met.items() if len(others) <= FEW_JOINED}
        self.joined = {y for c in self.apart for y in met[c]}
        self.useful = self._useful()
        self.longest = max(len(p) for p, _, _ in self.useful)

    def _useful(self) -> list[tuple[str, int, float]]:
        """Without the pieces that score less than the best way to spell them with others."""
        score = {p: s for p, _, s in self.rows}
        longest, kept = max(map(len, score)), []
        for piece, i, own in self.rows:
            best = [0.0] + [-math.inf] * len(piece)
            for e in range(1, len(piece) + 1):
                for s in range(max(0, e - longest), e):
                    if e - s < len(piece):
                        w = score.get(piece[s:e], self.unknown_score if e - s == 1 else -math.inf)
                        best[e] = max(best[e], best[s] + w)
            if len(piece) == 1 or own >= best[-1]:
                kept.append((piece, i, own))
        return kept

    def by_size(self, spark: SparkSession, size: int) -> DataFrame:
        return spark.createDataFrame([r for r in self.useful if len(r[0]) == size] or [("", -1, 0.0)], f"_t{size} string, _p{size} int, _w{size} double")

    def longer(self, spark: SparkSession) -> DataFrame:
        """Pieces of four characters and more, by their last four."""
        by: dict[str, list] = {}
        for p, i, s in self.useful:
            if len(p) >= 4:
                by.setdefault(p[-4:], []).append((len(p), i, s, p))
        return spark.createDataFrame(list(by.items()) or [("", [])], "_t4 string, _more array<struct<n:int,p:int,w:double,t:string>>")

    def spelling(self) -> Spelling:
        return Spelling({i: p.replace(SPACE_MARK, " ").encode() for p, i, _ in self.rows} | {i: bytes([b]) for b, i in self.byte_ids.items()})


_MARK = SPACE_MARK.encode()


def marked(column) -> list[bytes]:
    """Texts of a column with spaces for marks and one in front; empty ones stay empty."""
    return [b" " + t.replace(_MARK, b" ") if t else b"" for t in utf8(column)]


class Cutter:
    """Cuts chunks of marked texts into words: before each run of marks, and between the signs of pieces.apart and letters and digits of one or two bytes (up to U+00FF)."""

    def __init__(self, pieces: Pieces):
        self.sign, self.plain = np.zeros(256, bool), np.zeros((3, 256), bool)  # one byte, after C2, after C3
        self.sign[[ord(c) for c in pieces.apart if c != " "]] = True
        for n in range(256):
            if chr(n).isalnum() and chr(n) not in pieces.joined:
                code = chr(n).encode()
                self.plain[code[0] - 0xC1 if len(code) > 1 else 0, code[-1]] = True

    def __call__(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of the words in order the text's number, the hash, the place among all spans, and these spans as an array, which also has the ends of texts."""
        d = c.data
        opens = self.plain[0][d]
        closes = opens.copy()
        lead = np.flatnonzero((d == 0xC2) | (d == 0xC3))
        lead = lead[self.plain[d[lead] - np.uint8(0xC1), d[lead + 1]]]
        opens[lead] = closes[lead + 1] = True
        sign, other = self.sign[d], d != 32
        cut = np.ones(len(d), bool)
        cut[1:] = (other[:-1] & ~other[1:]) | (sign[:-1] & opens[1:]) | (closes[:-1] & sign[1:])
        cut[c.end] = True
        at = np.flatnonzero(cut)
        offsets = np.append(at, len(d))
        is_end = np.zeros(len(d), bool)
        is_end[c.end] = True
        place = np.flatnonzero(~is_end[at])
        begin, end = at[place], offsets[place + 1]
        spans = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(d)])
        return np.searchsorted(c.begin, begin, "right") - 1, c.hashes(c.sums(), begin, end), place, spans


def keys_of(words: list[bytes]) -> np.ndarray:
    """Hashes of words, given with spaces for marks, as Cutter has them."""
    return np.concatenate([np.empty(0, np.uint64), *(c.hashes(c.sums(), c.begin, c.end) for c in chunks(words))])


def _slices(batches, rows: int = 256):
    """Smaller batches: texts as Python strings take more room than in Arrow. They are copies, so that none keeps the whole batch while the next one is read."""
    for batch in batches:
        n = batch.num_rows
        for at in range(0, n, rows):
            yield batch.take(pa.array(np.arange(at, min(at + rows, n))))
        del batch
        give_back()
    give_back()


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    keys, first, where = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    return keys, np.bincount(where, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64), pa.concat_arrays([p[2] for p in parts]).take(pa.array(first))


def _counter(cut: Cutter):
    """The different words of what a task has read, HELD at a time, with their counts; in order, so that they compress well."""
    def run(batches):
        held, size = [], 0

        def close():
            _, n, words = _merged(held)
            order = pc.sort_indices(words)
            words = pc.replace_substring(words.take(order).cast(pa.string()), " ", SPACE_MARK)
            yield pa.RecordBatch.from_arrays([words, pa.array(n).take(order)], names=["_word", "_count"])

        for batch in _slices(batches):
            for c in chunks(marked(batch.column("_text"))):
                _, keys, place, spans = cut(c)
                keys, first, n = np.unique(keys, return_index=True, return_counts=True)
                held.append((keys, n, spans.take(pa.array(place[first]))))
                size += len(keys)
                if size > HELD:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from close()
                        held, size = [], 0
        if size:
            yield from close()
    return run


def _keyed(batches):
    for batch in batches:
        words = [w.replace(_MARK, b" ") for w in utf8(batch.column("_word"))]
        yield pa.RecordBatch.from_arrays([pa.array(keys_of(words).view(np.int64)), batch.column("_word"), batch.column("_count")], names=["_key", "_word", "_count"])


_NODE = "STRUCT<w: DOUBLE, path: ARRAY<INT>, land: INT>"
_BEST = ("greatest(named_struct('w', a[size(a) - 1].w + x.w1, 'n', 1, 'p', -1), IF(x.p2 IS NULL, NULL, named_struct('w', a[size(a) - 2].w + x.w2, 'n', 2, 'p', x.p2)),"
         " IF(x.p3 IS NULL, NULL, named_struct('w', a[size(a) - 3].w + x.w3, 'n', 3, 'p', x.p3)),"
         " IF(x.more IS NULL, NULL, array_max(transform(x.more, m -> named_struct('w', a[size(a) - m.n].w + m.w, 'n', m.n, 'p', m.p)))))")


def _fold(start: str, places: str) -> str:
    """SQL: best nodes of the places in order, appended to those of start; node size(a) - n is n characters back."""
    return (f"aggregate({places}, {start}, (a, x) -> concat(a, transform(array({_BEST}), b -> named_struct('w', b.w,"
            " 'path', concat(a[size(a) - b.n].path, IF(b.n > 1, array(b.p), IF(x.p1 IS NOT NULL, array(x.p1), SPELLED))), 'land', a[size(a) - b.n].land))))")


def _best_path(longest: int) -> str:
    """SQL: the ids of the best path of _places. Long words go a block at a time, so that no long array is copied for each place: a
    node's path begins where it enters its block, and land says from which place of the block before."""
    end = f"CAST(array(named_struct('w', 0D, 'path', CAST(array() AS ARRAY<INT>), 'land', 0)) AS ARRAY<{_NODE}>)"
    short = f"element_at({_fold(end, '_places')}, -1).path"
    step = (f"transform(array({_fold('s.tail', 'xs')}), a -> transform(array(slice(a, greatest(1, size(a) - {longest - 1}), {longest})), f -> named_struct("
            "'tail', transform(f, (v, j) -> named_struct('w', v.w, 'path', CAST(array() AS ARRAY<INT>), 'land', size(f) - 1 - j)), 'outs', concat(s.outs, array(f))))[0])[0]")
    blocks = f"transform(sequence(0, (size(_places) - 1) div {BLOCK}), k -> slice(_places, CAST(k AS INT) * {BLOCK} + 1, {BLOCK}))"
    outs = f"aggregate({blocks}, named_struct('tail', {end}, 'outs', CAST(array() AS ARRAY<ARRAY<{_NODE}>>)), (s, xs) -> {step}).outs"
    long = (f"aggregate(reverse({outs}), named_struct('at', 0, 'parts', CAST(array() AS ARRAY<ARRAY<INT>>)), (s, f) -> named_struct('at', f[size(f) - 1 - s.at].land,"
            " 'parts', concat(s.parts, array(f[size(f) - 1 - s.at].path))), s -> flatten(reverse(s.parts)))")
    return f"CASE WHEN size(_places) <= {BLOCK} THEN {short} ELSE {long} END"


def best_paths(words: DataFrame, pieces: Pieces) -> DataFrame:
    """words: distinct _word, partitioned by _key, a hash of the word. Returns _key, _word, _ids, the pieces of the best path.

    Nothing is shuffled; rows of the lattice carry two numbers for the word, and its text once a block."""
    if pieces.longest > BLOCK:
        raise ValueError(f"pieces of more than {BLOCK} characters")
    spark = words.sparkSession
    rows = words.withColumn("_row", F.monotonically_increasing_id()).withColumn("_size", F.char_length("_word"))
    rows = rows.select("_key", "_row", "_word", "_size", F.explode(F.expr(f"sequence(0, (_size - 1) div {BLOCK})")).alias("_k"))
    back = F.when(F.col("_k") > 0, F.lit(pieces.longest - 1)).otherwise(F.lit(0))  # characters of the block before
    rows = rows.select("_key", "_row", F.col("_k").cast("int").alias("_k"), back.alias("_back"), F.substring("_word", (F.col("_k") * BLOCK + 1 - back).cast("int"), BLOCK + back).alias("_part"),
                       F.least(F.lit(BLOCK), F.col("_size") - F.col("_k") * BLOCK).cast("int").alias("_here"))
    at = rows.select("_key", "_row", "_k", "_part", "_back", F.explode(F.expr("sequence(1 + _back, _here + _back)")).alias("_i")).withColumn("_j", F.col("_i") - F.col("_back")).drop("_back")
    until = lambda n: F.when(F.col("_i") >= n, F.substring("_part", F.col("_i") - (n - 1), F.lit(n)))  # noqa: E731  the last n characters up to the place
    at = at.withColumn("_c", until(1))
    for n in (1, 2, 3):
        at = at.join(F.broadcast(pieces.by_size(spark, n)), until(n) == F.col(f"_t{n}"), "left").drop(f"_t{n}")
    at = at.join(F.broadcast(pieces.longer(spark)), until(4) == F.col("_t4"), "left")
    # the bytes of a character that is no piece
    ids = "array(" + ",".join(str(pieces.byte_ids.get(b, pieces.unknown_id)) for b in range(256)) + ")"
    spelled = f"transform(sequence(1, octet_length(x.c)), k -> {ids}[CAST(conv(substring(hex(encode(x.c, 'UTF-8')), 2 * k - 1, 2), 16, 10) AS INT)])"
    more = F.expr("filter(_more, m -> m.n <= _i AND substring(_part, _i - m.n + 1, m.n) = m.t)")
    place = F.struct((F.col("_k") * BLOCK + F.col("_j")).alias("i"), F.coalesce("_w1", F.lit(pieces.unknown_score)).alias("w1"), F.col("_p1").alias("p1"), F.when(F.col("_p1").isNull(), F.col("_c")).alias("c"),
                     F.col("_w2").alias("w2"), F.col("_p2").alias("p2"), F.col("_w3").alias("w3"), F.col("_p3").alias("p3"),
                     F.when(F.col("_more").isNotNull(), F.transform(more, lambda m: F.struct(m["n"].alias("n"), m["p"].alias("p"), m["w"].alias("w")))).alias("more"),
                     F.when(F.col("_j") == 1, F.substring("_part", F.col("_i"), F.lit(BLOCK))).alias("t"))
    lattice = at.groupBy("_key", "_row").agg(F.sort_array(F.collect_list(place)).alias("_places"))
    word = F.array_join(F.transform(F.filter("_places", lambda x: x["t"].isNotNull()), lambda x: x["t"]), "")
    return lattice.select("_key", word.alias("_word"), F.expr(_best_path(pieces.longest).replace("SPELLED", spelled)).alias("_ids"))


def vocabulary(words: DataFrame, pieces: Pieces) -> DataFrame:
    """words: _word; or distinct ones, staged, with a hash as _key. Each distinct one with its _key and _ids; staged.

    A task gets about PLACES places of the lattice, which it sorts in memory, however many words there are."""
    distinct = words if "_key" in words.columns else stage(words.select("_word").distinct().withColumn("_key", F.xxhash64("_word")), "piece-words")
    places = distinct.agg(F.sum(F.char_length("_word").cast("long"))).collect()[0][0] or 0  # one number
    parts = max(-(-places // PLACES), distinct.sparkSession.sparkContext.defaultParallelism)
    return stage(best_paths(distinct.select("_key", "_word").repartition(parts, "_key"), pieces).drop(*["_word"] * ("_key" in words.columns)), "piece-vocabulary")


def counted_words(docs: DataFrame, text_col: str, pieces: Pieces, frequent: int) -> tuple[DataFrame, DataFrame]:
    """All words with hash and count, staged: _key, _word, _count; at most `frequent` short ones of the highest counts, by a limit from a histogram of 512 bins at most, and the rest."""
    texts = docs.select(F.col(text_col).cast("string").alias("_text"))
    counts = texts.mapInArrow(_counter(Cutter(pieces)), "_word string, _count bigint").groupBy("_word").agg(F.sum("_count").alias("_count"))
    counts = stage(counts.mapInArrow(_keyed, "_key bigint, _word string, _count bigint"), "piece-counts")
    step = F.when(F.char_length("_word") > COMMON_CHARS, -1).otherwise(F.floor(F.log2(F.col("_count").cast("double")) * 8).cast("int"))
    least, n = 0x7FFFFFFF, 0
    for b in sorted(counts.where(step >= 0).groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["b"]):
        n += b["n"]
        if n > frequent:
            break
        least = b["b"]
    return counts.where(step >= least), counts.where(step < least)


class Common:
    """The common words, by count: hashes in order with the number of each, and the ids by number."""

    def __init__(self, counts: pa.Table, coded: pa.Table):
        key, n = (counts.column(c).to_numpy() for c in ("_key", "_count"))
        coded = coded.take(pc.sort_indices(coded.column("_key"))).combine_chunks()
        ranks = np.lexsort((key, -n))
        known, key = coded.column("_key").to_numpy(), key[ranks]
        ids = coded.column("_ids").combine_chunks() if len(known) else pa.array([], pa.list_(pa.int32()))
        ids = ids.take(pa.array(np.searchsorted(known, key)))
        self.starts, self.values = ids.offsets.to_numpy()[:-1], ids.values.to_numpy().astype(np.int32)
        self.sizes = np.diff(ids.offsets.to_numpy())
        order = np.argsort(key.view(np.uint64))
        self.keys, self.numbers = key.view(np.uint64)[order], order.astype(np.uint32)

    def __len__(self):
        return len(self.keys)


class _Coder:
    """The numbers of the words of a chunk: common ones by the table, others by their place among the text's own other words, by hash."""

    def __init__(self, common: Common, cut: Cutter):
        self.common, self.cut = common, cut

    def __call__(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all words the text and the number; of the different other words of each text the text, the place and the hash."""
        text, keys, _, _ = self.cut(c)
        known, where = np.unique(keys, return_inverse=True)
        table = self.common.keys
        at = np.minimum(np.searchsorted(table, known), max(0, len(table) - 1))
        found = table[at] == known if len(table) else np.zeros(len(known), bool)
        number = np.zeros(len(known), np.uint32)
        number[found] = self.common.numbers[at[found]]
        numbers, rare = number[where], np.flatnonzero(~found[where])
        order = rare[np.lexsort((keys[rare], text[rare]))]
        t, k = text[order], keys[order]
        new = np.ones(len(order), bool)
        new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
        group = np.cumsum(new) - 1
        place = (group - np.searchsorted(t[new], t)).astype(np.uint32)
        numbers[order] = place + np.uint32(len(table))
        return text, numbers, t[new], place[new], k[new]


def _askers(packed, cut: Cutter):
    def run(batches):
        coder = _Coder(packed.value, cut)
        for batch in _slices(batches):
            for c in chunks(marked(batch.column("_text"))):
                _, _, text, place, keys = coder(c)
                take = pa.array(text + c.first)
                yield pa.RecordBatch.from_arrays([batch.column("_id").take(take), batch.column("_hash").take(take), pa.array(place.astype(np.int32)), pa.array(keys.view(np.int64))], names=["_id", "_hash", "_at", "_key"])
    return run


def packed_numbers(numbers: np.ndarray) -> bytes:
    """Numbers as how many half bytes each has, compressed, and these half bytes, two in a byte."""
    size = np.ones(len(numbers), np.uint8)
    for k in range(1, 8):
        size += numbers >= np.uint32(1 << 4 * k)
    ends = np.cumsum(size, dtype=np.int64)
    halves = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        halves[ends[has] - 1 - k] = (numbers[has] >> np.uint32(4 * k)) & np.uint32(15)
    head = zlib.compress(size.tobytes(), 6)
    return len(head).to_bytes(4, "little") + head + (halves[: len(halves) // 2 * 2 : 2] << 4 | halves[1::2]).tobytes()


def unpacked_numbers(blob: bytes) -> np.ndarray:
    n = 4 + int.from_bytes(blob[:4], "little")
    size, both = np.frombuffer(zlib.decompress(blob[4:n]), np.uint8), np.frombuffer(blob, np.uint8, offset=n)
    halves = np.empty(2 * len(both), np.uint8)
    halves[::2], halves[1::2] = both >> 4, both & 15
    ends, out = np.cumsum(size, dtype=np.int64), np.zeros(len(size), np.int64)
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        out[has] += halves[ends[has] - 1 - k].astype(np.int64) << 4 * k
    return out


def _pack(packed, cut: Cutter):
    """Numbers of each text's words, and a digest of the text."""
    def run(batches):
        coder = _Coder(packed.value, cut)
        for batch in _slices(batches):
            blobs = []
            for c in chunks(marked(batch.column("_text"))):
                text, numbers = coder(c)[:2]
                ends = np.searchsorted(text, np.arange(len(c.begin)), "right")
                blobs += [packed_numbers(numbers[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            digests = [md5(t).digest() for t in utf8(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_hash"), pa.array(blobs, pa.binary()), pa.array(digests, pa.binary())], names=["_id", "_hash", "_packed", "_digest"])
    return run


class Spelling:
    """The bytes of each id, as one table; no entry for ids that name no piece."""

    def __init__(self, texts: dict[int, bytes]):
        parts = [texts.get(i, b"") for i in range(max(texts) + 1)]
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.parts = pa.array(parts, pa.large_binary())

    def text(self, ids: np.ndarray) -> bytes | None:
        """The bytes of a text's ids without the mark in front; null where one of them names no piece."""
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.sizes) or not (sizes := self.sizes[ids]).all():
            return None
        out = self.parts.take(pa.array(ids)).buffers()[2].to_pybytes()[: int(sizes.sum())]
        return out[1:] if out[:1] == b" " else out


def _gathered(starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values[start : start + size] of all, one after the other."""
    return values[np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)]


def _assembler(packed, spelling: Spelling, byte_ids):
    def run(batches):
        common = packed.value
        n = len(common)
        is_byte = np.zeros(len(spelling.sizes) + 1, np.int64)
        is_byte[list(byte_ids)] = 1
        for batch in _slices(batches):
            sizes, ids, spelled, same = [0], [np.empty(0, np.int32)], [], []
            for blob, digest, found in zip(batch.column("_packed").to_pylist(), batch.column("_digest").to_pylist(), batch.column("_found").to_pylist(), strict=True):
                numbers = unpacked_numbers(blob)
                if found:  # repeated rows bring their words again; a word's place names it
                    others = {x["at"]: x["ids"] for x in found}
                    own_sizes = np.array([len(others[i]) for i in range(len(others))])
                    own = np.concatenate([np.array(others[i], np.int32) for i in range(len(others))])
                    rare = numbers >= n
                    at = np.where(rare, numbers - n, 0)
                    size = np.where(rare, own_sizes[at], common.sizes[np.where(rare, 0, numbers)] if n else 0)
                    out, ends = np.empty(int(size.sum()), np.int32), np.cumsum(size)
                    of_rare = np.repeat(rare, size)
                    out[of_rare] = _gathered((np.cumsum(own_sizes) - own_sizes)[at[rare]], own_sizes[at[rare]], own)
                    out[~of_rare] = _gathered(common.starts[numbers[~rare]], common.sizes[numbers[~rare]], common.values) if len(ends) else out
                else:
                    out = _gathered(common.starts[numbers], common.sizes[numbers], common.values)
                sizes.append(len(out)), ids.append(out), spelled.append(int(is_byte[out].sum()))
                back = spelling.text(out)
                same.append(back is not None and md5(back).digest() == digest)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_hash"), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(np.concatenate(ids))),
                                              pa.array(spelled, pa.int64()), pa.array(same, pa.bool_())], names=["_id", "_hash", "ids", "n_bytes", "round_trip"])
    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """For each row of docs id_col, text_hash, ids (the pieces of the whole text in order), n_bytes (how many of them are byte pieces), round_trip.

    round_trip says that decoding the ids gives the text back. Null and empty texts have no pieces and round-trip. A
    text that holds U+2581 itself comes back with spaces there, as with any such model. Rows that repeat an id, or
    id and text, get a row each, null ids too. Words may be of any length. Other columns are ignored; an empty table gives no rows."""
    spark, pieces = docs.sparkSession, Pieces(model_file)
    cut = Cutter(pieces)
    common, rest = counted_words(docs, text_col, pieces, frequent)
    # at most `frequent` short words, the most common with the smallest numbers
    packed = spark.sparkContext.broadcast(Common(common.select("_key", "_count").toArrow(), vocabulary(common, pieces).toArrow()))
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_hash"), F.col(text_col).cast("string").alias("_text"))
    kind = texts.schema["_id"].dataType.simpleString()
    asked = texts.mapInArrow(_askers(packed, cut), f"_id {kind}, _hash bigint, _at int, _key bigint")
    told = asked.join(vocabulary(rest, pieces).select(F.col("_key").alias("_known"), "_ids"), F.col("_key") == F.col("_known")).groupBy("_id", "_hash").agg(F.collect_list(F.struct(F.col("_at").alias("at"), F.col("_ids").alias("ids"))).alias("_found"))
    told = told.withColumnRenamed("_id", "_tid").withColumnRenamed("_hash", "_thash")
    whole = texts.mapInArrow(_pack(packed, cut), f"_id {kind}, _hash bigint, _packed binary, _digest binary")
    met = whole.join(told, F.col("_id").eqNullSafe(F.col("_tid")) & (F.col("_hash") == F.col("_thash")), "left").select("_id", "_hash", "_packed", "_digest", "_found")
    out = met.mapInArrow(_assembler(packed, pieces.spelling(), list(pieces.byte_ids.values())), f"_id {kind}, _hash bigint, ids array<int>, n_bytes bigint, round_trip boolean")
    return out.withColumnRenamed("_id", id_col).withColumnRenamed("_hash", "text_hash")


def _utf8(text: bytes) -> str | None:
    try:
        return text.decode()
    except UnicodeDecodeError:
        return None


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_file: str | None = None) -> DataFrame:
    """id_col and text: the inverse of encode, a row each; null where the ids are no UTF-8 or name no piece. Null ids are an empty text."""
    spelling = Pieces(model_file).spelling()

    def run(batches):
        for batch in batches:
            found = [spelling.text(np.array(x or (), np.int64)) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([None if t is None else _utf8(t) for t in found], pa.string())], names=["_id", "text"])
    rows = coded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, text string").withColumnRenamed("_id", id_col)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "n_bytes", "round_trip", "ids")


QUERIES = {"op10_sentencepiece": op10_sentencepiece}
ORACLES: dict[str, str] = {}
