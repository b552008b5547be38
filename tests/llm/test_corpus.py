"""Mixing, quality, language-model scores, subword encoding and the pipeline on small tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import lm_score, mixing, quality, sentencepiece

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=200, seed=1):
    rng = random.Random(seed)
    sources = ["a", "b", "é", None, "big"]
    return [(i, " ".join(rng.choice(["uma", "casa", "the", "blue", "Sky", "é", "x1"]) for _ in range(rng.randrange(0, 60))), "en", rng.choice(sources) if i % 3 else "big") for i in range(n)] + [(n, None, None, "a"), (n + 1, "", "en", None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "h") for r in rows], "doc_id long, text string, lang string, source string, _size int, _h string").repartition(3)


def water_filling(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("options", [{}, {"max_blocks": 4, "shard_words": 300}, {"max_blocks": 16, "shard_words": 50}])
def test_mix_meets_its_targets(spark, options):
    rows = corpus()
    size = {i: len(WORD.findall(t or "")) for i, t, _, _ in rows}
    sizes = defaultdict(int)
    for i, _, _, s in rows:
        sizes[s] += size[i]
    target = water_filling(sizes)
    mixed = mixing.mix(frame(spark, rows), **options)
    got = [r.asDict() for r in mixed.collect()]
    assert mixed.columns == ["doc_id", "text", "lang", "source", "_size", "_h", "mix_shard", "mix_epoch", "mix_words", "mix_key"]
    taken, by = Counter(), defaultdict(int)
    for r in got:
        taken[r["doc_id"]] += r["mix_words"]
        by[r["source"]] += r["mix_words"]
        assert len(WORD.findall(r["text"])) == r["mix_words"] > 0
    for s, t in target.items():
        assert abs(by[s] - t) <= 0.5 + 1e-9
    assert all(taken[i] <= 3 * size[i] for i in size)
    assert len({(r["doc_id"], r["mix_epoch"]) for r in got}) == len(got)
    again = mixing.mix(frame(spark, rows).repartition(5), **options)
    assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in again.collect())


def test_tree_keeps_every_quota(spark):
    quotas = {1: 100, 2: 7, 3: 0, 4: 1000}
    df = spark.createDataFrame(list(quotas.items()), "_s int, _draws long")
    for shards in (1, 2, 5, 8):
        got = mixing.split_quotas(df, shards).collect()
        by, shard = Counter(), Counter()
        for r in got:
            by[r._s] += r._quota
            shard[r._shard] += r._quota
        assert {s: by[s] for s in quotas} == quotas
        assert len(shard) == shards and max(shard.values()) - min(shard.values()) <= math.ceil(math.log2(shards + 1))


def test_hypergeometric_draws_have_the_right_mean(spark):
    df = spark.range(2000).select(((F.col("id") + 0.5) / 2000).alias("u"), F.lit(50).cast("long").alias("t"), F.lit(20).cast("long").alias("g"), F.lit(15).cast("long").alias("d"))
    got = np.array([r[0] for r in df.select(F.expr(mixing.hypergeometric("t", "g", "d", "u"))).collect()])
    assert abs(got.mean() - 6) < 0.02 and abs(got.var() - 15 * 0.4 * 0.6 * 35 / 49) < 0.1


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, corpus()).limit(0)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).count() == 0


def plain_statistics(text):
    words = WORD.findall(text or "")
    spans = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {j for i in range(len(words) - 4) if spans[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_statistics(spark):
    rng = random.Random(3)
    parts = ["a b c d e", "one", "é#", "\n", " ", "\t", "line one\n", "line one\n", "* $ %", "ação &|", "\x0b", " "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))), "en", "s") for i in range(150)] + [(999, None, None, None), (1000, "x " * 4000, "en", "s")]
    got = {r.doc_id: r for r in quality.quality_rules(frame(spark, rows)).collect()}
    for i, t, _, _ in rows:
        n, chars, symbols, lines, repeats = plain_statistics(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n) and (not r.kept or not r.base_failed)


def plain_mcd(x, floors, low=()):
    """Starts and concentration steps in numpy, with the same fixed bins for the median distance."""
    q = np.percentile(x, [10, 25, 50, 75], axis=0, method="inverted_cdf")
    starts = [(x.mean(axis=0), np.cov(x.T, bias=True))]
    for j in (1, 2):
        mid = np.array([q[0 if j == 2 and i in low else 2, i] for i in range(x.shape[1])])
        starts.append((mid, np.diag(((q[3] - q[1]) / 1.349) ** 2)))
    found = []
    for j, (mean, cov) in enumerate(starts):
        scale, last, step = 1.0, math.inf, 0
        while True:
            cov = cov * scale + np.diag(np.square(floors))
            d = x - mean
            dist = np.einsum("ij,ij->i", d @ np.linalg.inv(cov), d)
            det = np.linalg.slogdet(cov)[1] / 2
            if step:
                found.append((det, step, j, dist))
                if det >= last - quality.SETTLED:
                    break
                last = det
            b = np.floor(np.log(np.clip(dist, 1e-3, 1e6)) * quality._BINS).astype(int)
            use = x[b <= np.sort(b)[-(-len(x) // 2) - 1]]
            mean, cov, scale, step = use.mean(axis=0), np.cov(use.T, bias=True), quality._half_scale(x.shape[1]), step + 1
    return min(found, key=lambda f: f[:3])[3]


@pytest.mark.parametrize("junk", [0.1, 0.4])
def test_robust_distances(spark, junk):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2)) @ np.array([[1.0, 0.4], [0.0, 0.7]])
    many = int(400 * junk)
    x[:many] += 9
    rows = [(i, float(a), float(b), "g") for i, (a, b) in enumerate(x)]
    features = {"_x1": ("a", 0.2), "_x2": ("b", 0.1)}
    far = lambda rows: {r.i: r.distance2 for r in quality.robust_distance(spark.createDataFrame(rows, "i int, a double, b double, g string"), F.lit("x"), F.col("g"), features).collect()}
    got, want = far(rows), plain_mcd(x, [0.2, 0.1])
    assert np.allclose([got[i] for i in range(400)], want, rtol=1e-6)
    limit = quality.chi2_quantile(1 - quality.TAIL, 2)
    assert min(want[:many]) > limit > max(want[many:])
    if junk == 0.1:  # small sources share an estimate; a handful of rows has none
        tiny = [(500 + i, float(i % 3), float(i % 2), f"tiny{i}") for i in range(20)]
        assert all(d is not None for d in far(rows + tiny).values()) and all(d is None for d in far(tiny[:10]).values())


def test_odd_texts_are_rejected_and_clean_ones_stay(spark):
    rng = random.Random(12)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    clean = [(i, "\n".join(say(rng.randrange(6, 14)) for _ in range(rng.randrange(2, 30))), "en", f"s{i % 2}") for i in range(300)]
    symbols = [(1000 + i, " ".join("#*$%&|<>"[rng.randrange(8)] * rng.randrange(2, 9) for _ in range(80)), "en", "s1") for i in range(20)]
    lines = [(2000 + i, "\n".join([say(14) for _ in range(40)] + ["menu home next"] * 25), "en", "s0") for i in range(20)]
    same = [clean[0], (None, None, None, None), (None, clean[1][1], "en", None)]
    got = quality.quality_rules(frame(spark, clean + symbols + lines + same)).collect()
    kept = lambda low, high: [r.kept for r in got if r.doc_id is not None and low <= r.doc_id < high]
    assert len(got) == 343 and all(kept(0, 1000)) and not any(kept(1000, 2000)) and not any(kept(2000, 3000))
    assert quality.quality_rules(frame(spark, clean).limit(0)).count() == 0


def test_language_model_scores(spark):
    rows = corpus(120) + [(3, "uma casa", "en", "a")]
    got = sorted((r.doc_id, r.n_tokens, r.held_out, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_score.score_texts(frame(spark, rows)).collect())
    tokens = sorted((i, [w.lower() if w.isascii() else w for w in WORD.findall(t or "")] + [None]) for i, t, _, _ in rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((i, len(ws), held(i), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and -1e6 < g[6] < 0


def test_windows_score_each_token_once():
    rng = np.random.default_rng(1)
    classes = lm_score.Classes(rng.integers(0, 30, 50).astype(float), 10, 4)
    p = lm_score.start_parameters(classes, 8, 12)
    texts = [rng.integers(0, 50, n) for n in (1, 5, 12, 13, 40)]
    got = lm_score.score_ids(p, classes, texts, window=12, step=5, at_once=3)
    for ids, g in zip(texts, got, strict=True):
        c = classes.of[ids].astype(int)
        x, total = np.concatenate(([classes.total], c[:-1])), 0.0
        for t in range(len(ids)):
            start = 0 if t < 12 else -(-(t + 1 - 12) // 5) * 5
            h, _ = lm_score.attend(p, x[None, start : t + 1])
            total += lm_score.log_probabilities(h[0, -1] @ p["u"] + p["b"])[c[t]] / math.log(10) + classes.within[ids[t]]
        assert g == pytest.approx(total, rel=1e-4)


def test_gradient_and_learning():
    rng = np.random.default_rng(0)
    classes = lm_score.Classes(rng.integers(0, 50, 300).astype(float), 20, 5)
    p = {k: v.astype(np.float64) for k, v in lm_score.start_parameters(classes, 8, 6).items()}
    x, y = rng.integers(0, classes.total, (3, 6)), rng.integers(-1, classes.total, (3, 6))
    _, g = lm_score.gradient(p, x, y)
    for k in p:
        at = (x[0, 2], 1) if k == "e" else tuple(0 for _ in p[k].shape)
        kept, e = p[k][at], 1e-5
        p[k][at] = kept + e
        up = lm_score.gradient(p, x, y)[0]
        p[k][at] = kept - e
        down = lm_score.gradient(p, x, y)[0]
        p[k][at] = kept
        assert g[k][at] == pytest.approx((up - down) / 2 / e, rel=1e-3, abs=1e-7)
    adam, first = lm_score.Adam(p), lm_score.gradient(p, x, y)[0]
    for _ in range(200):
        adam.step(lm_score.gradient(p, x, y)[1])
    assert lm_score.gradient(p, x, y)[0] < first / 2


def test_training_sees_every_token():
    import pyarrow as pa

    path = lm_score.default_ranks()
    encoder, end = lm_score._encoder(path)
    classes = lm_score.Classes(np.ones(end + 1), 20, 5)
    texts = ["one", None, "", "two Words", "casa mesa rio " * 70, "a\u00a0 b\tc " * 3000]
    batch = pa.RecordBatch.from_pydict({"_id": list(range(len(texts))), "_text": texts})
    train = lm_score._trainer(path, classes, lm_score.start_parameters(classes), least_steps=0)
    out = next(train(iter([batch])))
    ids = [encoder.encode_ordinary("".join(" " + w.lower() for w in WORD.findall(t or ""))) + [end] for t in texts]
    assert out.column("_weight")[0].as_py() == sum(map(len, ids))
    for t, want in zip(texts, ids, strict=True):
        found = list(lm_score.training_windows(t, encoder, end, classes))
        x, y = (np.concatenate([part[k].ravel() for part in found]) for k in (0, 1))
        assert list(y[y >= 0]) == list(classes.of[want]) and list(x[y >= 0]) == [classes.total, *classes.of[want[:-1]]]


TEXTS = ["Hello  world, it's (no) e-mail: a.b@c.de...\n\n- x_1/2 'quoted', \"é,\"", " lead", "línea\nnova ① ﬁ", "", None, "a" * 300, "tab\tend ", "▁x", "word word", "onerenth edonre. a². b.²c, d³.e", "日本語 text"]


def library():
    """The library on the same pieces and scores, set to its best-path mode."""
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(sentencepiece.default_model(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    return sp.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_encoding_is_the_librarys_best_path_and_decodes(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = dict(sentencepiece.encode(docs).select("doc_id", "ids").collect())
    other = library()
    for i, t in enumerate(TEXTS):
        assert list(got[i]) == other.encode(t or ""), t
    back = dict(sentencepiece.decode(sentencepiece.encode(docs, frequent=3)).collect())
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(TEXTS))


def test_encoding_of_repeated_null_and_long(spark):
    rng = random.Random(2)
    long = "".join(rng.choice(["the", "on", "ion", "x", "é", "日", "q"]) for _ in range(100_000))
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (0, TEXTS[0]), (0, "other"), (None, "null id"), (None, None), (50, long[:700]), (51, long[:129] + " " + long[:128])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    other = library()
    for frequent in (0, 1000):
        found = sentencepiece.encode(docs, frequent=frequent).collect()
        assert len(found) == len(rows)
        key = lambda i, ids: (-1 if i is None else i, list(ids))
        assert sorted(key(r.doc_id, r.ids) for r in found) == sorted(key(i, other.encode(t or "")) for i, t in rows)
        assert all(r.round_trip == ("▁" not in (dict(enumerate(TEXTS)).get(r.doc_id) or "")) for r in found)
    assert sentencepiece.encode(docs.limit(0)).count() == 0 and sentencepiece.encode(docs.limit(0)).columns == ["doc_id", "text_hash", "ids", "n_bytes", "round_trip"]
    one = sentencepiece.encode(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()[0]
    assert len(long) > 150_000 and one.round_trip
    # of equal score, so no worse than the library's path, which may differ in ties
    score = {i: s for _, i, s in sentencepiece.Pieces().rows}
    total = lambda ids: sum(score.get(i, 0.0) for i in ids)
    assert total(one.ids) == pytest.approx(total(other.encode(long)))


def test_tasks_of_the_lattice_stay_small(spark, monkeypatch):
    monkeypatch.setattr(sentencepiece, "PLACES", 100)
    given = []

    def paths(words, pieces):
        given.append(words)
        return words.select("_word", F.lit(None).cast("array<int>").alias("_ids"))

    monkeypatch.setattr(sentencepiece, "best_paths", paths)
    words = spark.range(1000).selectExpr("concat('w', 1000 + id % 500) AS _word")
    assert sentencepiece.vocabulary(words, None).count() == 500
    sizes = given[0].groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 20 and max(r["count"] for r in sizes) < 60  # 2,500 places, 25 tasks


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(6)
    say = lambda n: " ".join(f"{rng.choice(['casa', 'mesa', 'rio', 'sol'])}{rng.randrange(300)}" for _ in range(n))
    rows = [(i, say(rng.randrange(20, 80)), "en", f"s{i % 4}") for i in range(120)]
    rows += [(200, rows[5][1].upper(), "en", "s1"), (201, rows[6][1] + " end", "en", "s2"), (202, "short", "en", "s1"), (203, None, None, None), (204, "same five words here again " * 20, "en", "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    step = {name: f for name, f in corpus_pipeline.STAGES}
    assert list(step) == ["quality rules", "exact dedup", "near dedup", "mixing", "sentencepiece"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    one = step["quality rules"](spark, docs, "").cache()
    assert ids(docs) - ids(one) == {202, 203, 204} and one.columns == docs.columns
    two = step["exact dedup"](spark, one, "").cache()
    assert ids(one) - ids(two) == {5}
    three = step["near dedup"](spark, two, "").cache()
    assert ids(two) - ids(three) == {201} and three.columns == docs.columns
    four = step["mixing"](spark, three, "").cache()
    assert ids(four) <= ids(three) and four.columns == docs.columns
    five = step["sentencepiece"](spark, four, "")
    assert five.count() == four.count() and five.where("NOT round_trip").count() == 0
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == five.count()


def test_few_texts_are_shuffled_to_the_rejects(spark, monkeypatch):
    rows = [(i, f"text {i}") for i in range(3000)] + [(7, "other"), (8, "text 8"), (None, "no id"), (None, None), (9999, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    verdicts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), (F.coalesce(F.col("doc_id") % 10 == 8, F.col("text").isNull())).alias("_bad")).select("doc_id", "text_hash", (~F.col("_bad")).alias("kept"))
    key = lambda r: (-1 if r[0] is None else r[0], r[1] or "")
    want = sorted(key(r) for r in rows if not (r[0] % 10 == 8 if r[0] is not None else r[1] is None))
    for few, most in ((4096, 1 << 27), (0, 1 << 27), (0, 64)):
        monkeypatch.setattr(corpus_pipeline, "FEW", few)
        monkeypatch.setattr(corpus_pipeline, "MOST_BITS", most)
        got = corpus_pipeline._without_rejects(docs, verdicts, "rejects-test")
        assert sorted(map(key, got.collect())) == want and got.columns == docs.columns
    monkeypatch.setattr(corpus_pipeline, "MOST_BITS", 1 << 27)
    rejects = verdicts.where("NOT kept").select(F.col("doc_id").alias("_rid"), F.col("text_hash").alias("_rhash"))
    clear, marked = corpus_pipeline._bitmap_sides(docs, rejects, rejects.count())
    n = rejects.count()
    assert clear.count() + marked.count() == len(rows) and n <= marked.count() < n + 200


def test_cut_words_and_packed_numbers():
    from docloom.llm.textbytes import chunks

    pieces = sentencepiece.Pieces()
    cut, rng = sentencepiece.Cutter(pieces), random.Random(3)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(" ▁a9é²×日.,_\n\tß") for _ in range(rng.randrange(40))) for _ in range(300)]
    found = [[] for _ in texts]
    for c in chunks([b" " + t.replace("▁", " ").encode() if t else b"" for t in texts], 500):
        text, keys, place, spans = cut(c)
        words = spans.take(place).to_pylist()
        assert list(sentencepiece.keys_of(words)) == list(keys)
        for i, w in zip(text, words, strict=True):
            found[c.first + i].append(w.decode().replace(" ", "▁"))
    assert ["".join(ws) for ws in found] == ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
    borders = {a[-1] + b[0] for ws in found for a, b in zip(ws, ws[1:], strict=False)}  # no piece crosses one
    assert not any(x in p for x in borders for p, _, _ in pieces.rows if x[1] != "▁") and "a." in borders
    ranks = np.minimum(np.random.default_rng(1).zipf(1.3, 5000), 2**31).astype(np.uint32)
    for numbers in (ranks, ranks[:1], ranks[:0], np.array([2**32 - 1, 0, 16, 15], np.uint32)):
        assert list(sentencepiece.unpacked_numbers(sentencepiece.packed_numbers(numbers))) == list(numbers)
    planes = zlib.compress(ranks.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
    assert len(sentencepiece.packed_numbers(ranks)) < len(planes)


def test_adam_keeps_parameters_in_one_vector():
    p = {k: np.ones(n, np.float32) for k, n in (("b", 3), ("a", 2))}
    adam = lm_score.Adam(p)
    adam.step({"a": np.full(2, 5.0, np.float32), "b": np.zeros(3, np.float32)})
    assert np.shares_memory(p["a"], adam.values) and p["a"] == pytest.approx(1 - 0.01 / (1 + 1 / 400)) and list(p["b"]) == [1, 1, 1]
    assert [w.decode() for w in lm_score._words("A\tb\u00a0C\x0b\x1cÉ\n")] == ["a", "b\u00a0c", "\x1cÉ"]


def test_texts_are_encoded_once(spark):
    import pyarrow as pa

    encoder, end = lm_score._encoder(lm_score.default_ranks())
    read = lm_score._reader(lm_score.default_ranks(), spark.sparkContext.broadcast(([b"uma"], [3])))
    texts = ["Uma casa", None, "", "a\u00a0 b\tc " * 3000]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lm_score, "TaskContext", type("", (), {"get": staticmethod(lambda: type("", (), {"partitionId": lambda self: 1})())}))
        out = next(read(iter([pa.RecordBatch.from_pydict({"_id": [4, 4, None, 1], "_text": texts})])))
    assert [r["_row"] - (1 << 33) for r in out.to_pylist()] == [0, 1, 2, 3] and out.column("_rest")[0].as_py() == ["casa"] and out.column("_known").to_pylist() == [1, 0, 0, 0]
    classes = lm_score.Classes(np.ones(end + 1), 20, 5)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lm_score, "encoded", None)  # what is kept isn't encoded again
        kept = list(lm_score._parts(out, lm_score.default_ranks()))
    for text, parts in zip(texts, kept, strict=True):
        for got, want in zip(lm_score.windows_of(parts, end, classes), lm_score.training_windows(text, encoder, end, classes), strict=True):
            assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_rare_and_long_words_count_in_the_base(spark):
    rows = corpus(60) + [(100 + i, " ".join(["L" * 200, f"r{i % 7}", "the", f"u{i}"]), "en", "a") for i in range(40)]
    plan = lambda n: sorted((r.doc_id, r.n_known, round(r.base_score, 8), round(r.score, 2)) for r in lm_score.score_texts(frame(spark, rows), frequent=n).collect())
    assert plan(0) == plan(3) == plan(1000)
