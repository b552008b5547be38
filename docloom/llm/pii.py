"""Personal data: patterns for direct identifiers, and information-theoretic sanitisation of what gives them away.

The protected entities are the values that the patterns find. In how many documents a term and an entity occur, and
in how many both, over the whole corpus and whole texts, estimate the pointwise mutual information of the two. As a share of the entity's own information this is how much of it the term
discloses: from `least` on the term is generalised, from REMOVE on it is removed, wherever it stands in the documents that
hold the entity. All words of a text are judged with all entities of it, at any distance. Entities that stand in the same texts are one class, and so are
terms that do and are equally common, so that a list of many identifiers, copied with changes, gives a few pairs of classes and not all of its pairs; those that an exact bound
rules out are dropped before both are counted together.
"""

from __future__ import annotations

import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, stage, table, text_of

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
SUPPORT = 2  # different texts that a term must share with an entity: in one, every rare word would disclose all
GENERALISE, REMOVE = 0.8, 0.95

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = re.compile(r"^[^\w]+|[^\w]+$")
_LOWER = {c: c + 32 for c in range(65, 91)}


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start. Linear in the text's length."""
    found = []
    done = 0
    at = text.find("@")
    while at >= 0:  # an address is its sign with what touches it on the left, back to the last match
        if m := _DOMAIN.match(text, at):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append(("email", start, m.end()))
                done = m.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def _core(m: re.Match) -> tuple[str, int, int]:
    """A word without punctuation at its ends, in lower case of A-Z, and its place."""
    word = m[0]
    left = _EDGES.match(word)
    begin = left.end() if left and left.start() == 0 else 0
    right = _EDGES.search(word, begin)
    end = right.start() if right else len(word)
    return word[begin:end].translate(_LOWER), m.start() + begin, m.start() + end


def _clear(words: list[tuple[str, int, int]], spans: list) -> list[tuple[str, int, int]]:
    """The words that touch none of the spans; both are walked once, from the left."""
    taken: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    out, k = [], 0
    for word in words:
        while k < len(taken) and taken[k][1] <= word[1]:
            k += 1
        if k == len(taken) or word[2] <= taken[k][0]:
            out.append(word)
    return out


_FOUND = pa.struct([("_id", pa.int64()), ("_hash", pa.binary()), ("base", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
                    ("entities", pa.list_(pa.string())), ("words", pa.list_(pa.string())), ("_held", pa.string())])
_DDL = "_id bigint, _hash binary, base array<struct<kind:string,start:bigint,end:bigint>>, entities array<string>, words array<string>, _held string"


def _digest(text: str) -> bytes:
    return sha256(text.encode()).digest()[:16]


def _scan(batches):
    for batch in batches:
        rows = []
        for i, t in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist(), strict=True):
            spans = base_spans(t) if t else []
            rows.append({"_id": i, "_hash": _digest(t or ""), "base": [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans],
                         "entities": sorted({f"{k}:{t[a:b].translate(_LOWER)}" for k, a, b in spans}),
                         "words": sorted({w[0] for w in _clear([_core(m) for m in _WORD.finditer(t)], spans)} - {""}) if spans else [], "_held": t if spans else None})
        yield pa.RecordBatch.from_struct_array(pa.array(rows, _FOUND))


_HITS = pa.struct([("_hhash", pa.binary()), ("terms", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("disclosed", pa.float64())])))])


def _mark(batches):
    """Every place of the told terms in the text that touches no identifier."""
    for batch in batches:
        rows = []
        for h, t, told in zip(*(batch.column(c).to_pylist() for c in ("_hash", "_text", "_told")), strict=True):
            disclosed = {x["term"]: x["disclosed"] for x in told}
            words = [w for w in map(_core, _WORD.finditer(t)) if w[0] in disclosed]
            rows.append({"_hhash": h, "terms": [{"start": a, "end": b, "disclosed": disclosed[w]} for w, a, b in _clear(words, base_spans(t))]})
        yield pa.RecordBatch.from_struct_array(pa.array(rows, _HITS))


def _classes(held: DataFrame, name: str, support: int, first: str) -> DataFrame:
    """For each value of column `name` in at least `support` texts: how many rows hold it, and two 64-bit marks of the set of texts that do."""
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "_hash")).alias(f"{first}{k}") for k in (1, 2)]
    return held.groupBy(name).agg(F.count(F.lit(1)).alias("_texts"), F.sum("_copies").alias("_d" + first[1:]), *marks).where(F.col("_texts") >= support).drop("_texts")


def disclosures(found: DataFrame, docs: DataFrame, text_col: str = "text", support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """For each text that holds disclosing terms, by its hash _h: _told, its terms and how much of an entity of it each discloses at most, from `least` on. found: rows of the scan of docs."""
    every = float(docs.count())
    texts = stage(found.where(F.size("entities") > 0).groupBy("_hash").agg(F.count(F.lit(1)).alias("_copies"), F.first("entities").alias("entities"), F.first("words").alias("words")), "pii-texts")
    named = texts.select("_hash", "_copies", F.explode("entities").alias("_entity"))
    entities = stage(_classes(named, "_entity", support, "_e").where(F.col("_de") < every), "pii-entities")
    # a text's classes of entities; only texts that have any go on
    held = stage(named.join(entities, "_entity").select("_hash", "_copies", "_de", "_e1", "_e2").distinct(), "pii-held")
    used = texts.join(held.select("_hash").distinct(), "_hash", "left_semi").select("_hash", "_copies", F.explode("words").alias("_term"))
    terms = stage(_classes(used, "_term", support, "_t").drop("_dt"), "pii-terms")
    core = lambda w: F.regexp_replace(w, r"(?U)^[^\w]+|[^\w]+$", "")
    words = docs.select(F.explode(F.array_distinct(F.transform(F.split(ascii_lower(text_of(text_col)), SPACE), core))).alias("_term"))
    # counted before the join, so that what is shuffled is the vocabulary and not the texts
    terms = stage(words.groupBy("_term").agg(F.count(F.lit(1)).alias("_dt")).join(terms, "_term"), "pii-spread")
    own = F.log2(F.lit(every) / F.col("_de"))
    share = lambda both: F.log2(both * F.lit(every) / (F.col("_de") * F.col("_dt"))) / own
    uses = stage(used.join(terms, "_term").select("_hash", "_term", "_dt", "_t1", "_t2"), "pii-uses")
    pairs = held.join(uses.drop("_term").distinct(), "_hash").where(share(F.least("_de", "_dt")) >= least)
    both = pairs.groupBy("_de", "_e1", "_e2", "_dt", "_t1", "_t2").agg(F.sum("_copies").alias("_both"), F.count(F.lit(1)).alias("_texts"))
    told = stage(both.where(F.col("_texts") >= support).withColumn("disclosed", share(F.col("_both"))).where(F.col("disclosed") >= least).drop("_both", "_texts"), "pii-disclosures")
    most = held.join(told, ["_de", "_e1", "_e2"]).groupBy("_hash", "_dt", "_t1", "_t2").agg(F.max("disclosed").alias("disclosed"))
    most = uses.join(most, ["_hash", "_dt", "_t1", "_t2"]).groupBy(F.col("_hash").alias("_h"))
    return stage(most.agg(F.collect_list(F.struct(F.col("_term").alias("term"), "disclosed")).alias("_told")), "pii-told")


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """For each row of docs: id_col, text_key (16 bytes of its text's SHA-256), base (kind, start, end of direct identifiers), terms (start, end, disclosed).

    Offsets are code points, ends exclusive. Null text is empty and has no spans. A document without direct
    identifiers has no terms either, so clean documents stay as they are. A term that shares fewer than `support` different texts with an entity
    isn't judged; copies of one text count once. Repeated rows each get their row; a null id is kept as it is; other columns are ignored; an empty table gives no rows."""
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    found = stage(texts.mapInArrow(_scan, _DDL), "pii-found")
    told = disclosures(found, docs, text_col, support, least)
    # only texts with identifiers have terms told; the scan has put these aside, so that no other text is read or moved again
    again = found.where("_held IS NOT NULL").join(told, F.col("_hash") == F.col("_h")).groupBy("_hash").agg(F.first("_held").alias("_text"), F.first("_told").alias("_told"))
    hits = again.mapInArrow(_mark, "_hhash binary, terms array<struct<start:bigint,end:bigint,disclosed:double>>")
    by = stage(hits.groupBy("_hhash").agg(F.first("terms").alias("terms")), "pii-hits")  # copies have the same
    out = found.join(by, F.col("_hash") == F.col("_hhash"), "left")
    return out.select(F.col("_id").alias(id_col), F.col("_hash").alias("text_key"), "base", F.coalesce("terms", F.array().cast("array<struct<start:bigint,end:bigint,disclosed:double>>")).alias("terms"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with text_col cleaned: identifiers become <EMAIL>, <IP>, <CARD> or <PHONE>, disclosing terms <WORD> or <NUMBER>, and those
    that disclose REMOVE or more go. Rows are joined by id and text, so repeated ids and null ids keep their rows."""
    marks = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("r"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), F.when(s["disclosed"] >= REMOVE, "").otherwise("<TERM>").alias("r"))))
    spans = private_spans(docs, id_col, text_col, **options).where((F.size("base") > 0) | (F.size("terms") > 0))
    spans = spans.select(F.col(id_col).alias("_sid"), F.col("text_key").alias("_skey"), F.array_sort(marks).alias("_marks")).dropDuplicates(["_sid", "_skey"])
    text = text_of(text_col)
    key = F.unhex(F.substring(F.sha2(text, 256), 1, 32))
    joined = docs.join(spans, F.col(id_col).cast("long").eqNullSafe(F.col("_sid")) & (key == F.col("_skey")), "left")
    cut = F.aggregate("_marks", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), lambda a, m: F.when(m["s"] < a["at"], a).otherwise(F.struct(
        m["e"].alias("at"), F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (m["s"] - a["at"]).cast("int")),
                                     F.when(m["r"] != "<TERM>", m["r"]).when(F.substring(text, (m["s"] + 1).cast("int"), (m["e"] - m["s"]).cast("int")).rlike("^[0-9.,]+$"), "<NUMBER>").otherwise("<WORD>")).alias("out"))))
    clean = F.when(F.col("_marks").isNull(), F.col(text_col)).otherwise(F.concat(cut["out"], F.substring(text, (cut["at"] + 1).cast("int"), F.char_length(text))))
    return joined.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    named = F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    terms = F.transform("terms", lambda s: F.concat_ws(":", F.lit(TERM), s["start"], s["end"]))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(F.array_join(named, ","), 256).alias("base_sha256"),
                        F.array_join(F.concat(named, terms), ",").alias("spans"), F.size("terms").cast("long").alias("n_terms"))


QUERIES = {"op2_pii": op2_pii}
ORACLES: dict[str, str] = {}
