import random
from collections import defaultdict

import numpy as np

from leafmill.llm import jaccard_join as J
from leafmill.llm.components import components
from leafmill.llm.line_dedup import line_dedup

RNG = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def brute_classes(rows):
    shingles = J.Shingler()
    sets = {i: set(shingles(t).tolist()) for i, t in rows}
    link = defaultdict(set)
    ids = list(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                link[a].add(b)
                link[b].add(a)
    root = {}
    for i in sorted(ids):
        if i in root:
            continue
        stack = [i]
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = i
                stack += link[x]
    return {i: (root[i], len(link[i])) for i in ids}


def near_rows():
    rows = []
    for g in range(6):
        base = prose(150).split()
        for k in range(5):
            w = list(base)
            for _ in range(k):
                w[RNG.randrange(len(w))] = "x" + str(RNG.randrange(999))
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, prose(30)) for k in range(20)]
    rows += [(100, rows[0][1]), (101, rows[0][1].upper()), (102, ""), (103, None), (104, "one two"), (105, "One, two!"), (106, "..."), (107, prose(20_000))]
    return rows


def test_join_against_brute_force(spark, monkeypatch):
    rows = near_rows()
    want = brute_classes(rows)
    for tile, small in ((1024, 64), (2, 2)):  # whole groups, then tiles of very few and deep recursion
        monkeypatch.setattr(J, "TILE", tile)
        monkeypatch.setattr(J, "SMALL", small)
        docs = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(None, "a b c d e f", 1)], "doc_id long, text string, size int")
        got = {r.doc_id: (r.class_id, r.n_links) for r in J.jaccard_join(docs).collect()}
        assert got.pop(None) == (None, 0)
        assert got == want
    assert J.jaccard_join(docs.limit(0)).count() == 0


def test_runs_reach_the_recall():
    assert J.runs_for(0.999) > J.runs_for(0.9) >= 1
    found, tries = 0, 200
    rng = np.random.default_rng(3)
    runs = J.runs_for(0.999)
    for _ in range(tries):
        a = rng.integers(0, 2**63, 450, dtype=np.int64).astype(np.uint64)
        b = np.concatenate([a[:400], rng.integers(0, 2**63, 50, dtype=np.int64).astype(np.uint64)])  # similarity 0.8
        last = [{int(x) for x in J.paths(s, runs)[:, 2] if x} for s in (a, b)]
        found += bool(last[0] & last[1])
    assert found / tries > 0.97


def test_exact_pairs():
    toks = [np.unique(np.array([RNG.randrange(30) for _ in range(12)], np.uint64)) for _ in range(40)]
    a, b = J.exact_pairs(toks, 0.5)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if len(set(toks[i]) & set(toks[j])) >= 0.5 * len(set(toks[i]) | set(toks[j]))}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(200, 100), (100, 150), (7, 7)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_chunks_go_and_the_rest_stays(spark):
    passage = [prose(15) for _ in range(8)]
    rows = [(i, "\n".join([prose(14), prose(13), *passage, prose(16), prose(15)])) for i in range(12)]
    long = prose(60)
    rows += [(20 + i, "\n".join([prose(9), long, prose(9)])) for i in range(3)]
    clean = [(40, "\n".join(prose(12) for _ in range(9))), (41, ""), (42, None), (43, "\n\n\n"), (None, "a\nb"), (44, "short\nlines\nshort\nlines"), (45, prose(5000))]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows + clean] + [(40, clean[0][1], 7, "x")], "doc_id long, text string, n_lines int, `odd name` string")
    out = line_dedup(docs)
    assert out.columns == ["doc_id", "text", "odd name", "n_lines", "n_removed"]
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r)
    for i, t in clean:
        assert all((r.text, r.n_removed) == (t, 0) for r in got[i])
    assert len(got[40]) == 2  # repeated rows are one document
    seen = defaultdict(int)
    for i, t in rows:
        (r,) = got[i]
        kept, whole = r.text.split("\n"), t.split("\n")
        it = iter(whole)
        assert all(k in it for k in kept if k) and r.n_lines == len(whole)  # kept lines keep their order
        for line in kept:
            seen[line] += 1
        for line in whole:
            assert line in passage or line == long or line in kept  # lines of one document alone stay
    assert seen[long] == 1
    assert all(seen[p] >= 1 for p in passage) and sum(seen[p] for p in passage[1:-1]) < 0.35 * 12 * 6
    assert line_dedup(docs.limit(0)).count() == 0


def test_every_repeated_run_goes(spark):
    """Against all runs of 12 words on two lines, or 20 words, by brute force."""
    pool = [prose(n) for n in (1, 2, 3, 5, 7, 9, 11, 13, 16, 19, 22)] + ["", " "]
    passages = [[prose(n) for _ in range(k)] for k, n in ((3, 19), (4, 19), (6, 10), (18, 3), (60, 1))]
    passages += [["\t".join(prose(12).split()) for _ in range(5)], ["".join(chr(0x4E00 + RNG.randrange(5000)) for _ in range(30)) for _ in range(8)], [prose(30), "", "", prose(14), "", prose(8), ""]]
    texts = [[prose(9), *p, prose(8)] for p in passages for _ in range(3)] + [[RNG.choice(pool) for _ in range(RNG.randrange(1, 14))] for _ in range(60)]
    dense = lambda line: sum(c >= "\u4e00" for c in line)
    count = lambda line: -(-dense(line) // 2) if dense(line) else len(line.split())
    seen, want = set(), []
    for lines in texts:
        n, gone = [count(x) for x in lines], set()
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if sum(n[s:e]) >= 20 or sum(n[s:e]) >= 12 and e - s >= 2:
                    run = tuple(lines[s:e])
                    if run in seen:
                        gone |= set(range(s, e))
                    seen.add(run)
        want.append(gone)
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup(docs).collect()}
    for i, (lines, gone) in enumerate(zip(texts, want)):
        with_words = [k for k in range(len(lines)) if lines[k].strip()]
        kept = [lines[k] for k in with_words if k not in gone]
        assert [x for x in got[i].text.split("\n") if x.strip()] == kept
    for k, p in enumerate(passages):
        assert all(got[3 * k + c].n_removed == len(p) for c in (1, 2))


def test_stashed_tables_are_released(spark):
    import glob

    from leafmill.llm.common import release, shared_dir, stash

    assert stash(spark.range(3), "some").count() == 3
    there = lambda: glob.glob(shared_dir(spark).removeprefix("file://") + "/leafmill/some-*")
    assert there()
    release(spark)
    assert not there()


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "a b\nc d")], "doc_id long, text string")
    plan = line_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_shuffled_chunks_give_the_same(spark, monkeypatch):
    """More repeated chunks than a broadcast takes: hashes meet first, texts travel once."""
    rng = random.Random(9)
    shared = ["\n".join(" ".join(f"w{rng.randrange(900)}" for _ in range(9)) for _ in range(4)) for _ in range(6)]
    rows = [(i if i % 7 else None, "\n".join([f"own {i} " + " ".join(f"x{rng.randrange(9**6)}" for _ in range(25)), rng.choice(shared), f"end {i}"])) for i in range(60)] + [(3, None), (4, ""), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from leafmill.llm import line_dedup as L

    got = []
    for most in (L.BROADCAST_HASHES, 0):
        monkeypatch.setattr(L, "BROADCAST_HASHES", most)
        got.append(sorted(map(str, L.line_dedup(docs).collect())))
    assert got[0] == got[1] and sum("n_removed=0" not in r for r in got[0]) > 40
