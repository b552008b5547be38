"""Exact and near duplicates, and repeated passages, against brute force on small tables."""

import hashlib
import random
import re
import subprocess
import sys

import numpy as np
import pytest

from docloom.llm import near_dedup, substring_dedup
from docloom.llm.exact_dedup import exact_dedup
from docloom.llm.textbytes import chunks, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho", "sigma", "tau", "phi", "É", "naïve"]) + str(rng.randrange(40)) for _ in range(n))


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([3, 8, 40, 120])) for _ in range(40)]
    base = prose(rng, 150)
    texts += [edited(rng, base, rng.randrange(6)) for _ in range(40)] + [base.upper(), base, base + " ", "", None, "  \n", "one two", "One Two", "a\tb c d e f"]
    texts += [texts[i] for i in (0, 1, 1, 45, 45)]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    """The texts with columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, i, "x", "y") for i, t in rows], "doc_id long, text string, _id long, _text string, keep_id string").repartition(3)


def test_exact_dedup(spark, corpus):
    for hash_all in (False, True):
        got = {r.doc_id: r for r in exact_dedup(frame(spark, corpus), hash_all=hash_all).collect()}
        groups = {}
        for i, t in corpus:
            groups.setdefault((t or "").translate(LOW), []).append(i)
        assert len(got) == len(corpus)
        for text, ids in groups.items():
            for i in ids:
                assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
                if hash_all:
                    assert bytes(got[i].full_hash) == hashlib.sha256(text.encode()).digest()


def test_exact_dedup_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "A"), (None, "z"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup(rows).collect())
    assert got == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (3, 4, 2, False), (4, 4, 2, True)]
    assert exact_dedup(rows.limit(0)).count() == 0


def shingles(text):
    words = WORD.findall((text or "").translate(LOW))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


@pytest.mark.parametrize("percent", [85, 60])
def test_near_duplicates(spark, corpus, percent):
    sets = {i: shingles(t) for i, t in corpus}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r for r in near_dedup.near_duplicates(frame(spark, corpus), percent=percent, rows=4 if percent > 80 else 2).collect()}
    assert len(got) == len(corpus)
    for i in ids:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i)


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(odd).collect()) == [(0, 2, 0, True), (2, 0, 2, True)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7)]
    got = dict(near_dedup.components(spark.createDataFrame(chain, "_a long, _b long")).collect())
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)}


def test_superminhash_estimates():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 2**63, 300).astype(np.uint64)
    for common in (30, 150, 270):
        two = np.concatenate([one[:common], rng.integers(0, 2**63, 300 - common).astype(np.uint64)])
        same = np.mean(near_dedup.superminhash(one, 256) == near_dedup.superminhash(two, 256))
        assert abs(same - common / (600 - common)) < 0.12
    few = near_dedup.superminhash(one[:3], 64)
    assert np.isfinite(few).all() and few.max() < 64


def test_word_hashes():
    texts = [b"", b"one two", b" two  one\n", b"x" * 3000, b"one"]
    hashes = {}
    for limit in (1, 1 << 20):
        for c in chunks(texts, limit):
            begin, end, owner = c.words()
            for b, e, o, h in zip(begin, end, owner, c.hashes(c.sums(), begin, end), strict=True):
                word = bytes(c.data[b:e])
                assert word in texts[c.first + o] and hashes.setdefault(word, h) == h
    assert len(set(hashes.values())) == 3
    assert len(windows(np.arange(4, dtype=np.uint64), np.zeros(4, int), 5)[0]) == 0


def brute_repeats(rows):
    seen, out = {}, {}
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    for i, t in ordered:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            seen.setdefault(b[p : p + 50], i)
    for i, t in ordered:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] != i:
                cover[p : p + 50] = b"\1" * 50
        runs = re.findall(rb"\x01+", bytes(cover))
        out[i] = (len(b), sum(cover), len(runs), hashlib.sha256(bytes(c for c, m in zip(b, cover, strict=True) if not m)).hexdigest())
    return out


def test_repeated_passages(spark):
    rng = random.Random(11)
    passages = [prose(rng, n)[:size] for n, size in ((20, 50), (20, 49), (30, 120), (60, 300))]
    rows = [(i, " ".join(rng.choice([prose(rng, rng.randrange(1, 30)), *passages]) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "é" * 60), (103, "é" * 60 + "x"), (104, "ab" * 200), (105, "b" + "ab" * 100), (106, ""), (107, None), (108, "q" * 50), (109, "q" * 49), (110, "q" * 51)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute_repeats(rows)


def test_repeats_in_odd_rows(spark):
    text = "the same passage of more than fifty bytes stands in both of these rows"
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "short")], "doc_id long, text string")
    got = sorted((r.doc_id or 99, r.n_removed) for r in substring_dedup.remove_repeats(rows).collect())
    assert got == [(1, 0), (1, 0), (2, 0), (99, len(text))]
    assert substring_dedup.remove_repeats(rows.limit(0)).count() == 0


def test_repeats_in_a_new_worker():
    """What a worker runs first on an executor that has just started: only its own module's imports are there."""
    script = """
import numpy as np, pyarrow as pa
from docloom.llm import substring_dedup as m
empty = lambda schema: pa.table({f.name: pa.array([], f.type) for f in schema}, schema=schema)
assert m._repeated(empty(m._STRINGS)).num_rows == 0 and m._shared_places(empty(m._PLACES)).num_rows == 0
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
