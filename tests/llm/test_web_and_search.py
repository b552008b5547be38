"""Source divergence, ranked search and main texts of pages against brute force and texts known by construction."""

import html
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import divergence, search, wrappers

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = ["uma", "casa", "The", "blue", "sky", "É", "naïve", "x1", "dog's", "ÀB", " ", "日本", "a_b", "7"]


def documents(n=120, seed=3):
    rng = random.Random(seed)
    rows = [(i * 2, " ".join(rng.choices(VOCABULARY, weights=range(1, len(VOCABULARY) + 1), k=rng.randrange(40))), rng.choice(["en", "pt", None]), rng.choice(["hot"] * 5 + ["a", "b", "é", None, ""])) for i in range(n)]
    return rows + [(7, None, "en", "silent"), (9, "", "xx", "a"), (9, "", "xx", "b"), rows[0], rows[0], (None, "blue blue Sky", "en", "a"), (11, "word " * 30000, "pt", "long")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "h") for r in rows], "doc_id long, text string, lang string, source string, term int, n string").repartition(3)


def test_source_divergence(spark):
    rows = documents()
    words = [[w.translate(LOW) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")] for _, t, _, _ in rows]
    seen, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for (_, _, lang, source), w in zip(rows, words, strict=True):
        seen[lang or ""].update(set(w))
        count[lang or "", source or ""].update(w)
        groups[lang or ""].add(source or "")
    want = set()
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= 3]
        total = Counter()
        for s in sources:
            total += Counter({t: count[lang, s][t] for t in kept})

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: share(count[lang, s]) for s in sources}, share(total)
        for s in sources:
            pair = sorted((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s)
            term = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])
            for part, found in (("pair", pair), ("term", term[:4])):
                want |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)}
    got = divergence.source_divergence(frame(spark, rows), top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == want
    assert ("xx", "a", "pair", "b", 0, 1) in want


def test_source_divergence_of_nothing(spark):
    assert divergence.source_divergence(frame(spark, []).limit(0)).count() == 0


def ranked(docs, items, top):
    terms = lambda t: [w.translate(LOW) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n, size = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 25 + 75 * b.total() * n // max(size, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if b[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return out


@pytest.mark.parametrize(("shard", "run", "block"), [(16 << 20, 4096, 8 << 20), (300, 4, 60)])
def test_ranked_search(spark, monkeypatch, shard, run, block):
    monkeypatch.setattr(search, "RUN", run)
    rows = documents()
    items = [(1, "blue sky blue"), (2, None), (3, ""), (4, "absent words only"), (5, "the dog's house, 日本 7"), (5, "naïve É"), (None, "casa"), (6, " ".join(VOCABULARY * 5))]
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    got = search.search(frame(spark, rows), asked, top=3, block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(ranked([(i, t) for i, t, _, _ in rows], items, 3), key=key)


def test_search_of_nothing(spark):
    asked = spark.createDataFrame([(1, "blue")], "item_id long, text string")
    assert search.search(frame(spark, []).limit(0), asked).count() == 0
    assert search.search(frame(spark, documents()), asked.limit(0)).collect() == []


def test_shards_hold_what_was_put_in():
    import pyarrow as pa

    values = np.array([0, 1, 127, 128, 16383, 16384, 2**40, 2**63 - 1], np.int64)
    assert search.unpack(search.pack(values)).tolist() == values.tolist()
    assert search.unpack(search.pack(values[:0])).tolist() == []
    batch = pa.record_batch({"id": pa.array([5, -(2**62), None, 2**62]), "text": ["b a b", "a", "a b", None]})
    row = next(search._index([b"a", b"b", b"c"])([batch])).to_pylist()[0]
    shard = search.Shard.read(row, 3, 6)
    assert shard.ids.tolist() == [-(2**62), 5, search.NO_ID] and row["n_docs"] == 3 and row["n_terms"] == 6
    assert {t: shard.places[b:e].tolist() for t, (b, e) in shard.lists.items()} == {0: [0, 1, 2], 1: [1, 2]}


def _page(rng, host, k):
    """A page of one of three templates, and its main text."""
    word = lambda n: " ".join(rng.choice(VOCABULARY[:6]) + str(rng.randrange(99)) for _ in range(n))
    blocks = [word(5), *(word(rng.randrange(15, 40)) for _ in range(rng.randrange(2, 6)))]
    nav = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in word(4).split())
    if host == 0:
        body = f"""<header class=top>Site</header><nav><ul>{nav}</ul></nav><main><div class='cookie-notice'>We use cookies</div><article class="post has-comments">
          <h1>{blocks[0]} &amp; more</h1>""" + "\n".join(f"<p>{b[:4]}<b>{b[4:9]}</b>{b[9:]}" for b in blocks[1:]) + f"""<form>Vote <input></form><aside>{word(9)}</aside><div class="ad-box">{word(9)}</div></article>
          <section id="comments"><article class="comment"><p>{word(30)}</article></section></main><footer>&copy; all</footer>"""
        want = [blocks[0] + " & more", *blocks[1:]]
    elif host == 1:  # nothing is named; a notice is part of the template
        body = f"<div id=x1><ul>{nav}</ul></div><div class='q7'><h2>{blocks[0]}</h2><div>{'</div><div>'.join(blocks[1:])}</div><div class=note><em>All opinions are those of the author.</em></div></div><div class='w'><a href='/'>{word(6)}</a></div>"
        want = blocks
    else:
        body = f"<div class=menu>{word(5)}</div><div id='main-content'><table><tr><td>{'<td>'.join(blocks)}</table>" + (f"<ul><li>{'<li>'.join(blocks)}</ul>" if k % 2 else "") + f"<script>if (a < b) document.write('<p>no</p>')</script><!-- <p>no</p> --><div style='display: none'>no</div></div><div class=sidebar>{word(8)}</div>"
        want = blocks + (blocks if k % 2 else [])
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}" + "</body></html>" * (k % 2), " ".join(" ".join(html.unescape(b).split()) for b in want)


def test_main_text(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(90):
        page, want[k] = _page(rng, k % 3, k)
        rows.append((k, f"https://user@Host{k % 3}.example:80/p{k}?x#y", page))
    deep = "<div>" * 5000 + "a &lt;b&gt; c" + "</div>" * 5000
    long = "<article>" + "<p>some words here" * 20000 + "</article>"
    odd = {100: None, 101: "", 102: "plain text only", 103: deep, 104: long, 105: "<article></article><div>rest of it</div>", 106: "<p title='unclosed", 107: "<article>x &am y &amp z&nbsp;<br>w</article>", 108: "<article>twice</article>", 109: "<b>"}
    want |= {100: "", 101: "", 102: "plain text only", 103: "a <b> c", 104: " ".join(["some words here"] * 20000), 105: "", 107: "x &am y & z w", 108: "twice", 109: ""}
    rows += [(k, None if k % 2 else f"http://odd{k}.example/", t) for k, t in odd.items()] + [(108, "http://odd108.example/", odd[108])]
    pages = spark.createDataFrame([(*r, 1, "s") for r in rows], "page_id long, url string, html string, host int, slot string").repartition(4)
    got = wrappers.main_text(pages)
    assert got.columns == ["page_id", "url", "text"]
    found = [tuple(r) for r in got.collect()]
    assert sorted((i, u or "") for i, u, _ in found) == sorted((i, u or "") for i, u, _ in rows)
    for i, _, text in found:
        assert i == 106 or text == want[i], i
    assert wrappers.main_text(pages.limit(0)).count() == 0


def test_wrappers_are_union_free_expressions():
    sk = lambda s: wrappers.skeleton(wrappers.parse(s))
    shape = lambda items: " ".join((x[1] if x[0] == "e" else f"({shape(x[3])})") + ("*" if m and o else "+" if m else "?" if o else "") for x in items for m, o in [wrappers._flags(x)])
    assert shape(sk("<h1>a</h1><p>b</p><p>c</p>")) == "h1 p+"
    assert shape(sk("<h2>a</h2><p>b</p><h2>a</h2><p>b</p><h2>a</h2><p>b</p><p>b</p>")) == "(h2 p+)+"
    both = wrappers.align(sk("<h1>a</h1><p>b</p>"), sk("<h1>a</h1><ul><li>x</ul><p>b</p><p>c</p>"))
    assert shape(both) == "h1 ul? p+"
    reader = wrappers.Wrapper(both)
    assert [s for s, _, _ in reader.slots(wrappers.parse("<h1>t</h1><p>b</p><p>c</p>"))] == ["/h1#1", "/p#4", "/p#4"]
    mixed = sk("".join(f"<{t}>x</{t}>" for t in random.Random(1).choices(["p", "h2", "ul", "pre", "table"], k=400)))
    assert len(mixed) == 1 and shape(mixed).endswith(")*")
    assert all(not s.endswith("#-1") for s, _, _ in wrappers.Wrapper(mixed).slots(wrappers.parse("<p>x</p><pre>x</pre><h2>x</h2><p>x</p>")))


def test_wrappers_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN_IN", 4)
    rng = random.Random(2)
    rows = [("h", "".join(f"<{t}>x</{t}>" for t in rng.choices(["p", "h2", "ul", "div"], k=rng.randrange(1, 9)))) for _ in range(60)]
    made = {wrappers.wrappers(spark.createDataFrame(rows, "host string, html string").repartition(n)).collect()[0].wrapper for n in (1, 3, 7)}
    assert len(made) == 1
