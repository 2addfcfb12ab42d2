import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from leafmill.llm import fingerprints, scoring, sentencepieces, toxicity

RNG = random.Random(11)
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ROWS = [
    (1, "Hello, world! The quick brown fox."), (2, None), (3, ""), (4, "  a\n\nb  c "), (5, "ab<s>▁x \x00é̈ ﬁ ｆ 　🙂"), (6, "x" * 500 + " " + "日本" * 80),
    (None, "same text"), (7, "same text"), (7, "same text"), (8, "the " * 5000), (9, "tion, the... don't (x) 1,234.5%%% a$$$"), (10, " "), (11, "\n"),
]


def table(spark, rows=ROWS):
    path = spark.conf.get("spark.checkpoint.dir") + "/t" + hashlib.md5(repr(rows).encode()).hexdigest()
    spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, score string").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


def test_pieces_are_the_library_s(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = table(spark, ROWS + [(100 + i, "".join(RNG.choice(" ab.,é▁\nthe%1_tion") for _ in range(60))) for i in range(120)])
    coded = sentencepieces.sentencepiece_encode(docs, PIECES)
    rows = coded.collect()
    want = Counter((r.doc_id, tuple(sp.encode(r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    assert all(r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    assert all(r.decoded_md5 == hashlib.md5(sp.decode(r.ids).encode()).hexdigest() for r in rows)
    back = sentencepieces.sentencepiece_decode(coded, PIECES).collect()
    assert all(r.text == sp.decode(r.ids) for r in back)
    assert sentencepieces.sentencepiece_encode(table(spark, [(1, "a")]).limit(0), PIECES).count() == 0


def _proto(field, raw):
    return bytes([field << 3 | 2]) + bytes([len(raw)]) + raw if len(raw) < 128 else bytes([field << 3 | 2, len(raw) & 127 | 128, len(raw) >> 7]) + raw


def unigram_model(path):
    """A unigram model file written by hand: no training."""
    import struct

    pieces = [("<unk>", 0.0, 2)] + [(p, s, 1) for p, s in [("▁", -3.0), ("a", -4.0), ("b", -4.1), ("c", -4.2), ("ab", -5.0), ("bc", -4.9), ("abc", -9.5), ("▁a", -5.5), ("▁ab", -6.9), ("ca", -5.2), ("cab", -8.0)]]
    raw = b"".join(_proto(1, _proto(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([0x18, k])) for p, s, k in pieces)
    raw += _proto(2, bytes([0x18, 1]))  # model type: unigram
    raw += _proto(3, bytes([0x18, 1, 0x20, 0, 0x28, 1]))  # dummy prefix, no removal of spaces, escape
    path.write_bytes(raw)
    return str(path)


LONG = ["https://x.io/" + "".join(RNG.choice("abcdefXYZ0123456789+/=") for _ in range(400)), "日本語の文章" * 60, "a" * 900, "=" * 300 + " " + "the" * 200, "ab " * 50 + "tionationation" * 20, "x  y   " + "-" * 90]


def test_units_end_where_no_piece_can_cross():
    m = sentencepieces.model(PIECES)
    texts = [m.normal(t) for t in [*LONG, *(t for _, t in ROWS if t)]]
    units, counts = m.cut(texts)
    assert "".join(units) == "".join(texts) and counts.sum() == len(units)
    pairs = {p[k : k + 2] for p in m.pieces for k in range(len(p) - 1)}
    at = 0
    for n in counts:
        own = units[at : at + n]
        assert all(a[-1] + b[0] not in pairs for a, b in zip(own, own[1:])) and all(u[k : k + 2] in pairs for u in own for k in range(len(u) - 1))
        at += n
    assert max(map(len, m.cut([m.normal(LONG[0]), m.normal(LONG[1])])[0])) <= sentencepieces.UNIT_CHARS  # these go through the lattice


@pytest.mark.parametrize("settings", [(1, 0, 1), (1, 1, 1), (0, 1, 1), (0, 0, 1)])
def test_models_that_normalise_and_long_units(spark, tmp_path, settings):
    """The same pieces with a dummy prefix or none, and with spaces taken away or kept."""
    dummy, remove, escape = settings
    norm = bytes([3 << 3, dummy, 4 << 3, remove, 5 << 3, escape])
    path = str(tmp_path / "m.model")
    with open(path, "wb") as f:
        f.write(open(PIECES, "rb").read() + _proto(3, norm))
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*LONG, *(t for _, t in ROWS if t), "  two  words  ", " a", "a "]
    got = {r.doc_id: r for r in sentencepieces.sentencepiece_encode(table(spark, list(enumerate(texts))), path).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == sp.encode(t), (t, settings)
        assert got[i].decoded_md5 == hashlib.md5(sp.decode(got[i].ids).encode()).hexdigest(), (t, settings)


def test_viterbi_fold_of_a_unigram_model(spark, tmp_path):
    path = unigram_model(tmp_path / "u.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["abc cab", "abcabc", "cabbage", "a b c", "xaby", ""] + ["".join(RNG.choice("abc ") for _ in range(25)) for _ in range(40)]
    got = {r.doc_id: r.ids for r in sentencepieces.sentencepiece_encode(table(spark, list(enumerate(texts))), path).collect()}
    score = lambda ids: sum(sp.get_score(i) for i in ids)
    for i, t in enumerate(texts):
        want = sp.encode(t)
        assert sp.decode(got[i]) == sp.decode(want) and (got[i] == want or math.isclose(score(got[i]), score(want), abs_tol=1e-4)), t


def test_scores_against_brute_force(spark):
    rng = random.Random(21)  # its own: what a false positive moves must not hang on the order of tests
    rows = ROWS + [(200 + i, " ".join(rng.choice("A b c the\tThe É \x0b x,".split(" ")) for _ in range(30))) for i in range(60)]
    docs = table(spark, rows)
    toks = [(i, t, scoring.tokens(t)) for i, t in rows]
    counts = Counter(w for i, _, ws in toks if scoring.trained(i) for w in [*ws, None])
    pairs = Counter(p for i, _, ws in toks if scoring.trained(i) for p in zip([0, *ws], [*ws, None]))
    n, v, ends = sum(counts.values()), len(counts), counts[None]
    share = 1 - sum(c == 1 for c in pairs.values()) / sum(pairs.values())
    steps = [math.ceil(2 ** (k / 2)) for k in range(60)]
    q = lambda c: max((x for x in steps if x <= c), default=0)
    rest = 1 - share * sum(map(q, pairs.values())) / sum(pairs.values())
    want = []
    for i, _, ws in toks:
        base = [(counts[w] + 0.5) / (n + 0.5 * (v + 1)) for w in [*ws, None]]
        model = 0.0
        for p, (a, b) in zip(base, zip([0, *ws], [*ws, None])):
            h = ends if a == 0 else counts[a]
            model += math.log10(share * min(q(pairs[a, b]), h) / h + rest * p if h else p)
        want.append((i, zlib.crc32(str(i).encode()) % 5 == 1 if i is not None else False, len(ws) + 1, sum(counts[w] > 0 for w in [*ws, None]), n, sum(map(math.log10, base)), model))
    both = [sorted((tuple(r) for r in scoring.lm_scores(docs, broadcast_bytes=most).collect()), key=key) for most in (192 << 20, 0)]
    assert both[0] == both[1]  # the filter broadcast, and asked range by range
    # a bigram that the filter takes for one it holds, or for a commoner one, moves a score a little: few may move
    same = 0
    for g, w in zip(both[0], sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9)
        assert w[6] - 1e-6 <= g[6] <= w[6] + 1.5
        same += math.isclose(g[6], w[6], rel_tol=1e-9, abs_tol=1e-9)
    assert same >= 0.8 * len(want)  # few words, so that one false positive is in many texts
    assert scoring.lm_scores(table(spark, [(1, "a")]).limit(0)).count() == 0
    held = [r for r in want if not r[1]]
    assert all(isinstance(r.id, str) for r in scoring.lm_scores(docs.selectExpr("string(coalesce(doc_id, 0)) as id", "text"), id_col="id").collect()) and held


def test_probabilities_of_a_history_add_up():
    """What quantising takes from seen bigrams goes to the base: summed over histories nothing is lost."""
    counts = np.array([RNG.choice([1, 1, 2, 3, 5, 7, 11, 100]) for _ in range(500)])
    kept = scoring.least(scoring.quantise(counts))
    share, total = 0.7, counts.sum()
    rest = 1 - share * kept.sum() / total
    assert math.isclose(share * kept.sum() / total + rest, 1.0) and (kept <= counts).all() and (kept > counts / 1.5).all()


def test_filter_holds_quantised_counts():
    keys = scoring._mix(np.arange(1, 5001, dtype=np.uint64))
    counts = np.array([RNG.choice([1, 2, 3, 7, 100]) for _ in keys])
    size, data = scoring.segment(keys, counts)
    f = scoring.Filter(1, [(0, size, data)])
    assert (f.counts(keys) >= scoring.least(scoring.quantise(counts))).all()  # never less
    assert (f.counts(keys) > counts).mean() < 0.01
    other = scoring._mix(np.arange(10_000, 30_000, dtype=np.uint64))
    assert (f.counts(other) > 0).mean() < 0.01


def test_fingerprints(spark):
    text = lambda n: " ".join(RNG.choice(["alpha", "beta", "gamma", "Delta9", "x!", "Øre"]) + str(RNG.randrange(9999)) for _ in range(n))
    rows = [(5, text(300)), (4, text(250)), (3, ""), (2, None), (1, "tiny"), (9, text(3000)), (None, "null id"), (4, "second of four")]
    got = fingerprints.fingerprint_documents(table(spark, rows)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    assert len(got) == len(rows)
    have = {(r.doc_id, r.n_chars, r.edited_sha256) for r in got}
    want = set()
    for k, (i, t) in enumerate(order):
        nxt, half = order[(k + 1) % len(order)][1], len(t) // 2
        want.add((i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert have == want
    by = {r.doc_id: r for r in got}
    assert 0.1 < by[9].near_edited < 1 and by[9].near_next < 0.1 and by[3].fingerprint == "" and by[1].fingerprint
    assert fingerprints.fingerprint_documents(table(spark, [(1, "only one document of its kind")])).first().near_next == 1.0
    assert fingerprints.fingerprint_documents(table(spark, rows).limit(0)).count() == 0


def test_square_sums_and_batches():
    b = np.frombuffer(bytes(RNG.randrange(97, 103) for _ in range(500)), np.uint8)
    want = [sum(c * c for c in Counter(b[i : i + 64].tolist()).values()) for i in range(500 - 63)]
    assert fingerprints.square_sums(b).tolist() == want
    texts = [bytes(RNG.randrange(32, 127) for _ in range(RNG.choice([0, 5, 63, 64, 65, 127, 128, 900]))) for _ in range(60)]
    assert fingerprints.fingerprints(texts) == [fingerprints.fingerprints([t])[0] for t in texts]  # whatever stands beside it
    assert fingerprints.likeness(*fingerprints.fingerprints([texts[0]] * 2)) == 1.0 and fingerprints.likeness("", "A") == 0.0


def examples(n=500, words=40):
    """Random labelled examples as the index takes them; words of skewed frequency."""
    names = scoring._mix(np.arange(1, words + 1, dtype=np.uint64))
    out = []
    for i in range(n):
        own = np.unique(np.minimum((words * np.array([RNG.random() ** 3 for _ in range(RNG.randrange(0, 12))])).astype(int), words - 1)) if i % 9 else np.zeros(0, int)
        out.append((i, RNG.randrange(2), names[own], np.array([RNG.randrange(1, 4) for _ in own], np.int64)))
    return out


def dense_cosines(index, ex, queries):
    """Weights by the formula of the docstring, each vector as a whole row: cosines to rows in the index's order."""
    n, pos = len(ex), sum(e[1] for e in ex)
    at = {h: k for k, h in enumerate(sorted({int(h) for e in ex for h in e[2]}))}
    df, bad = np.zeros(len(at)), np.zeros(len(at))
    for _, label, hs, _ in ex:
        for h in hs:
            df[at[int(h)]] += 1
            bad[at[int(h)]] += label
    weight = []
    for d, x in zip(df, bad):
        table = np.array([[x, pos - x], [d - x, n - pos - d + x]])
        want = table.sum(1)[:, None] * table.sum(0)[None, :] / n
        chi = ((table - want) ** 2 / want).sum() if d < n else 0.0
        weight.append((math.log((1 + n) / (1 + d)) + 1) * (toxicity.LEAST + (1 - toxicity.LEAST) * chi / (chi + toxicity.HALF_CHI)))

    def row(hs, cs):
        v = np.zeros(len(at))
        for h, c in zip(hs, cs):
            if int(h) in at:
                v[at[int(h)]] = (1 + math.log(c)) * weight[at[int(h)]]
        return v / (np.linalg.norm(v) or 1)

    of = {e[0]: row(e[2], e[3]) for e in ex}
    return [[(float(row(*q) @ of[i]), k) for k, i in enumerate(index.ids.tolist())] for q in queries]


def test_nearest_are_exact():
    ex = examples()
    index = toxicity.Index(ex, (1.0, 1.0))
    queries = [(e[2], e[3]) for e in examples(80)] + [(np.array([1], np.uint64), np.array([1]))]
    got = index.nearest([index.vector(*q) for q in queries])
    scored = index.score(queries, 1.5, -0.25)
    for (rows, sims), cosines, (p, ids, _) in zip(got, dense_cosines(index, ex, queries), scored):
        brute = sorted(((-c, k) for c, k in cosines if c > 1e-9))[: toxicity.NEAREST]
        assert np.allclose(sims, [-c for c, _ in brute]) and len(rows) == len(brute)
        # the score is that of the votes, by hand
        if brute:
            yes = sum(s for s, k in zip(sims, rows) if index.labels[k])
            raw = (yes + 0.5 * index.prior) / (sims.sum() + 0.5)
            assert math.isclose(p, 1 / (1 + math.exp(-1.5 * math.log(raw / (1 - raw)) + 0.25)), rel_tol=1e-9) and ids == index.ids[rows[:3]].tolist()
        else:
            assert p == index.blank
    out = index.nearest([index.vector(ex[5][2], ex[5][3])], but=[index.ids.tolist().index(5)])[0][0]
    assert 5 not in index.ids[out]


def test_every_word_of_the_sample_counts():
    ex = examples()
    index = toxicity.Index(ex, (1.0, 1.0))
    assert set(index.names.tolist()) == {int(h) for e in ex for h in e[2]} and (index.idf > 0).all()


def test_toxic_words_are_learned(spark):
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        w = [f"w{RNG.randrange(300)}" for _ in range(40)] + ([RNG.choice(["vile", "scum", "rot"]) for _ in range(4)] if toxic else [])
        RNG.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(700, None), (701, ""), (None, "scum vile"), (702, "scum " * 3000)]
    train = spark.createDataFrame(labels[:400] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = table(spark, rows)
    index = toxicity.fit(docs, train)
    got = {r.doc_id: r for r in toxicity.score(docs, index, keep=["score"]).toDF("doc_id", "kept", "score", "predicted", "ids", "cos").collect()}
    right = sum(got[i].predicted == t for i, t in labels[400:])
    assert right >= 195 and got[None].predicted == 1 and got[702].predicted == 1 and got[700].score == got[701].score == index.index.prior
    assert got[702].ids and all(0 <= r.score <= 1 for r in got.values())
    empty = toxicity.fit(docs, train.limit(0))
    assert all(r.score < 0.5 for r in toxicity.score(docs, empty).collect())
    assert toxicity.score(docs.limit(0), index).count() == 0


def test_rare_toxic_words_count_in_large_samples(spark):
    """300 words, each in 12 of 1,000 toxic examples and in none of 2,000 others."""
    bad = [[f"bad{i}" for i in range(300) if (j - 3 * i) % 1000 < 12] for j in range(1000)]
    plain = lambda: " ".join(f"w{RNG.randrange(300)}" for _ in range(10))
    rows = [(j, " ".join([plain(), *words])) for j, words in enumerate(bad)] + [(j, plain()) for j in range(1000, 3000)]
    labels = spark.createDataFrame([(j, int(j < 1000)) for j in range(3000)], "doc_id long, toxic int")
    new = [(5000 + i, f"bad{i} {plain()}") for i in range(300)] + [(6000 + i, plain()) for i in range(50)]
    docs = spark.createDataFrame(rows + new, "doc_id long, text string")
    index = toxicity.fit(docs, labels)
    assert set(toxicity.Terms()(" ".join(f"bad{i}" for i in range(300)))[0].tolist()) <= set(index.index.names.tolist())
    got = {r.doc_id: r.predicted for r in toxicity.score(docs.where("doc_id >= 5000"), index).collect()}
    assert all(got[5000 + i] == 1 for i in range(300)) and not any(got[6000 + i] for i in range(50))


def test_index_comes_to_the_driver_in_pieces(spark, monkeypatch):
    """An index of more bytes than the driver takes as the results of one job."""
    rng = random.Random(5)
    rows = [(j, " ".join(f"w{rng.randrange(30000)}" for _ in range(100)) + " bad" * (j % 2)) for j in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(j, j % 2) for j in range(2000)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "PIECE", 64 << 10)
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "1m")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        model = toxicity.fit(docs, labels)
    finally:
        conf.remove("spark.driver.maxResultSize")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    packed = model.shared.value
    assert len(packed) > 1 << 20 and len(zlib.decompress(packed)) > len(packed)
    terms = toxicity.Terms()
    whole = toxicity.Index([(j, j % 2, *terms(t)) for j, t in rows], model.index.weight)
    assert all(np.array_equal(getattr(model.index, k), getattr(whole, k)) for k in ("names", "idf", "ids", "labels", "dense", "rows", "values"))


@pytest.mark.parametrize("count,level", [(1, 1), (2, 3), (3, 4), (4, 5), (5, 5), (6, 6), (8, 7)])
def test_quantised_levels(count, level):
    assert scoring.quantise(np.array([count])).tolist() == [level] and scoring.least(np.array([level]))[0] <= count


def test_token_hashes_are_those_of_the_join(spark):
    words = [w.encode() for w in ["", "a", "the", "日本語", "x" * 100]]
    got = spark.createDataFrame([(w,) for w in words], "w binary").selectExpr("xxhash64(w) as h").collect()
    import xxhash

    assert [r.h & (1 << 64) - 1 for r in got] == [xxhash.xxh64_intdigest(w, scoring.SEED) for w in words]
