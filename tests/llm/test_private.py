"""Personal data, licences and archives on small tables."""

import base64
import hashlib
import heapq
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.llm import licenses, pii, warc

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def plain_spans(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub(r"\D", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits)
                    or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(2)
    pieces = ["a.b@c.de", "@", "x@y", "a@b.c@d.e", "é@x.org", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "+55 (81) 99999-1234", "+1", "++12 345 678 90",
              "0", " ", "-", ".", "_", "7" * 21, "\n", "ä", "000.0.0.0", "5500005555555559"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("1" * 100_000 + " " + "a" * 100_000 + "1 " * 50_000) is not None


def test_disclosing_terms(spark):
    rows = [(i, f"note {i} secretplan ask boss@corp.com soon about thing{i}") for i in range(5)] + [(10 + i, f"plain text {i} about soon ask") for i in range(60)] + [(90, None), (91, ""), (92, "write to lone@corp.com unique words here")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in pii.private_spans(docs).collect()}
    text = dict(rows)
    assert {text[0][t.start : t.end] for t in got[0].terms} == {"note", "secretplan"}
    # against plain counts
    whole = {i: set(re.findall(r"\w+", (t or "").lower())) for i, t in rows}
    for term in ("note", "secretplan", "ask", "soon", "about"):
        both, dt = sum("boss@" in (text[i] or "") and term in w for i, w in whole.items()), sum(term in w for w in whole.values())
        share = math.log2(both * len(rows) / (5 * dt)) / math.log2(len(rows) / 5)
        assert (share >= pii.GENERALISE) == (term in ("note", "secretplan"))
        assert all(t.disclosed == pytest.approx(share) for t in got[0].terms if text[0][t.start : t.end] == term)
    assert all(not got[i].terms and not got[i].base for i in (10, 40, 90, 91)) and not got[92].terms
    clean = dict(pii.sanitised(docs.drop("base")).select("doc_id", "text").collect())
    assert clean[0] == " 0  ask <EMAIL> soon about thing0" and clean[10] == text[10]
    assert pii.private_spans(docs.limit(0)).count() == 0


def test_terms_far_from_an_identifier_and_lists_of_both(spark):
    common = "so many words that all texts hold " * 40
    people = " ".join(f"p{i}@corp.com" for i in range(60)) + " " + " ".join(f"secret{i}" for i in range(60))
    rows = [(i, f"a@b.cd {common} zebra {i}") for i in range(2)] + [(10 + i, f"{people} {common} v{i}") for i in range(2)] + [(12, f"{people} {common} v0")]
    rows += [(20 + i, f"{common} x{i}") for i in range(80)] + [(200, "z@y.xw alone")] * 2
    got = {r.doc_id: r for r in pii.private_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = {i: [dict(rows)[i][t.start : t.end] for t in got[i].terms] for i in got}
    assert words[0] == words[1] == ["zebra"] and words[10] == words[11] == words[12] == [f"secret{i}" for i in range(60)]
    assert not words[200] and not words[20] and all(t.disclosed == 1 for i in (0, 10) for t in got[i].terms)


def test_repeated_rows_keep_their_own_spans(spark):
    docs = spark.createDataFrame([(1, "a@b.cd"), (1, "a@b.cd"), (None, "1.1.1.1")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in pii.sanitised(docs).collect()) == [(0, "<IP>"), (1, "<EMAIL>"), (1, "<EMAIL>")]
    far = [(i, f"call a@b.cd, (falcon)! {'word ' * 30} falcon. {i}") for i in range(3)] + [(9 + i, "other text") for i in range(50)]
    got = {r.doc_id: r for r in pii.private_spans(spark.createDataFrame(far, "doc_id long, text string")).collect()}
    assert [far[0][1][t.start : t.end] for t in got[0].terms] == ["call", "falcon", *["word"] * 30, "falcon"] and not got[9].terms
    assert sorted((r.doc_id or 0, len(r.base)) for r in pii.private_spans(docs).collect()) == [(0, 1), (1, 1), (1, 1)]


def test_license_units(spark):
    mit = licenses.LICENSES["MIT"]
    rows = [(1, mit.upper()), (2, "prose\nLicensed under the Apache License, Version 2.0.\nmore prose"), (3, "no licence at all in here"), (4, None), (5, ""), (6, "one"), (7, "Licensed under   the apache license version 2.0!"),
            (8, mit.replace("Permission", "Leave").replace("granted", "given")), (2, "prose\nLicensed under the Apache License, Version 2.0.\nmore prose")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, line int")
    got = {(r.doc_id, r.line, r.license) for r in licenses.license_scan(docs).where("best").collect()}
    assert (1, None, "MIT") in got and (8, None, "MIT") in got and (2, 1, "Apache-2.0/line") in got and (7, None, "Apache-2.0/line") in got
    assert not {i for i, _, _ in got} & {3, 4, 5, 6}
    for r in licenses.license_scan(docs).collect():
        text = dict(rows)[r.doc_id]
        unit = licenses._words(text if r.line is None else text.split("\n")[r.line])
        other = licenses._words(licenses.LICENSES[r.license])
        count = lambda w: [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        a, b = count(unit), count(other)
        common = sum(min(a.count(x), b.count(x)) for x in set(a))
        assert r.dice == pytest.approx(2 * common / (len(a) + len(b))) and r.dice >= 0.8


def test_loser_tree_merges_in_order():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(20), r, i) for i in range(rng.randrange(6))) for r in range(k)]
        assert list(warc.loser_tree([iter([(x, x) for x in r]) for r in runs])) == [(x, x) for x in heapq.merge(*runs)]


def test_archives_round_trip(spark, tmp_path):
    rows = [(i, f"http://WWW.Site{i % 3}.org:80/p{i % 2}#f", f"<p>page {i % 4}</p>") for i in range(20)] + [(50, None, None), (51, "http://a b/\n", ""), (52, "x", "é" * 5000)]
    pages = spark.createDataFrame([(i, u, h, "z") for i, u, h in rows], "page_id long, url string, html string, digest string").repartition(4)
    runs = warc.write_archives(pages, str(tmp_path / "warc"))
    merged = warc.merge_runs(runs, range_rows=5).orderBy("history_at").collect()
    keys = [(r.url_key, r.stamp, r.page_id) for r in merged]
    assert keys == sorted(keys) and [r.history_at for r in merged] == list(range(len(rows)))
    assert warc.url_key("https://user@www.Example.com:443/A?b#c") == "com,example)/a?b"
    got = {r.page_id: r for r in warc.read_archives(runs.select("archive").distinct(), str(tmp_path / "warc")).collect()}
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    for i, _, h in rows:
        payload, r = (h or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
    assert warc.write_archives(pages.limit(0), str(tmp_path / "none")).count() == 0


def test_small_payloads_are_no_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    runs = warc.write_archives(pages, str(tmp_path / "w"), min_payload=3)
    assert dict(runs.select("page_id", "record_type").collect()) == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert runs.where(F.col("length") <= 0).count() == 0


def test_archives_of_any_ids_and_many_runs(spark, tmp_path, monkeypatch):
    rows = [(10**12, "http://a.b/", "x"), (-(10**12), "http://a.b/", "x"), (2**62, None, None), (None, "http://c.d/e", "y"), (7, "http://a.b/", "z" * 300_000), (7, "http://a.b/", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "archives")
    runs = warc.write_archives(pages.repartition(6), folder)
    found = warc.read_archives(runs.select("archive").distinct(), folder).collect()
    assert sorted((r.page_id or 0, r.payload_bytes) for r in found) == sorted((i or 0, len(h or "")) for i, _, h in rows)
    history = sorted(warc.merge_runs(runs).collect(), key=lambda r: r.history_at)
    keys = [(r.url_key, r.stamp, -1 if r.page_id is None else r.page_id) for r in history]
    assert keys == sorted(keys) and [r.history_at for r in history] == list(range(len(rows)))
    # passes over more files than are merged at once
    lines = [{"url_key": f"k{i % 7}", "stamp": "0", "page_id": i, "archive": "a", "offset": i, "length": 1, "digest": "d", "record_type": "response"} for i in range(400)]
    monkeypatch.setattr(warc, "MANY_RUNS", 3)
    monkeypatch.setattr(warc.TaskContext, "get", staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0, "taskAttemptId": lambda self: 0})()))
    runs = [sorted(lines[r::11], key=lambda x: (x["url_key"], x["stamp"], x["page_id"])) for r in range(11)]
    batch = warc.pa.RecordBatch.from_pylist([x | {"run": f"r{i:02d}", "seq": j} for i, run in enumerate(runs) for j, x in enumerate(run)], warc._INDEX)
    got = [r for b in warc._merger(str(tmp_path / "merge"))([batch]) for r in b.to_pylist()]
    assert [(r["url_key"], r["page_id"]) for r in got] == sorted((x["url_key"], x["page_id"]) for x in lines)
