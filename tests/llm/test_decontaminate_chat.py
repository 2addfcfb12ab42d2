import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import chat, decontaminate
from leafmill.llm.common import words


def brute(text, items, window):
    w = words(text)
    hit, seen = set(), set()
    for item, t in items:
        iw = words(t)
        m = min(window, len(iw))
        for i in range(len(iw) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == iw[i : i + m]:
                    hit |= set(range(j, j + m))
                    seen.add(item)
    return len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit)


def test_windows_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("a b c É dd 7".split()) for _ in range(n))
    items = [(str(i), text(rng.choice([1, 2, 3, 5, 9]))) for i in range(30)] + [("x", None), ("y", " .,"), ("0", text(4))]
    rows = [(i, text(rng.choice([0, 3, 40])), "k") for i in range(60)] + [(60, None, "k"), (61, "", None), (None, "A, b;C", "k"), (None, "A, b;C", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items + [(None, "a a")], "item_id string, text string")
    want = sorted((str(i), *brute(t, items, 3)) for i, t, _ in rows)
    for size in (1 << 20, 40):  # one pass, several passes
        monkeypatch.setattr(decontaminate, "PASS_BYTES", size)
        assert sorted((str(r[0]), *r[1:]) for r in decontaminate.contamination(docs, bench, 3).collect()) == want
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())
    assert decontaminate.contamination(docs, bench, keep=["n_hit"]).columns.count("n_hit") == 2


@given(st.text(alphabet="<\\|ab\n", max_size=30), st.text(alphabet="<\\|n\n", max_size=10))
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible(text, role):
    shown, spans = chat.render([[role, text], ["assistant", text]])
    assert chat.read_back(shown) == [(role, text), ("assistant", text)]
    assert shown.count("<|") == 4 and chat.unescape(shown[slice(*spans[-1])]) == text


def test_log_is_folded(spark):
    log = [
        (1, 1, "open", 0, "user", "hi"), (1, 2, "open", 1, "assistant", None), (1, 3, "delta", 1, None, "bad"), (1, 4, "redo", 1, None, None),
        (1, 5, "delta", 1, None, "go"), (1, 6, "delta", 1, None, "od"), (1, 7, "open", 2, "user", "later"), (1, 8, "edit", 0, None, "<|end|> hey"),
        (1, 9, "delta", 2, None, "lost"), (1, 10, "open", 3, "assistant", "yes"), (None, 1, "open", 0, None, None),
    ]
    random.Random(1).shuffle(log)
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, slot long, role string, text string")
    got = {r.conv_id: chat.read_back(r.formatted) for r in chat.chat(events).collect()}
    assert got == {1: [("user", "<|end|> hey"), ("assistant", "yes")], None: [("", "")]}
    assert chat.chat(events.limit(0)).count() == 0


def test_tables_become_logs(spark):
    rows = [(1, 1, "assistant", "x" * 1300), (1, 0, "user", None), (2, 5, None, "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: chat.read_back(r.formatted) for r in chat.chat(chat.as_events(turns)).collect()}
    assert got == {1: [("user", ""), ("assistant", "x" * 1300)], 2: [("", "")]}


def test_rows_that_share_a_turn_stay_apart(spark):
    long = ["a" * 1300, "b" * 1300]
    rows = [(1, 0, "user", long[1]), (1, 0, "assistant", long[0]), (1, 1, "user", "x"), (1, 1, "user", "x"), (2, None, "user", long[1]), (2, None, "user", long[0]), (2, 0, None, "z"), (None, 3, "user", "p"), (None, 3, "user", "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.chat(chat.as_events(turns))
    got = {r.conv_id: chat.read_back(r.formatted) for r in made.collect()}
    assert got == {1: [("assistant", long[0]), ("user", long[1]), ("user", "x"), ("user", "x")], 2: [("user", long[0]), ("user", long[1]), ("", "z")], None: [("user", "p"), ("user", "q")]}
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(made).collect()} == {1: (4, 1300), 2: (3, 0), None: (2, 0)}


def brute_fold(events):
    """Messages by a list that is edited in place, the last one of a slot first."""
    out = []
    for kind, slot, role, text in events:
        hit = [k for k, m in enumerate(out) if m[2] == slot]
        if kind == "open":
            out = out[: hit[-1]] if hit else out
            out.append([role or "", text or "", slot])
        elif hit and kind == "delta":
            out[hit[-1]][1] += text or ""
        elif hit and kind in ("edit", "redo"):
            out[hit[-1]][1] = (text or "") if kind == "edit" else ""
            out = out[: hit[-1] + 1]
    return [(r, t) for r, t, _ in out]


def test_large_ids_nulls_and_unknown_kinds(spark):
    """Ids that a double can't hold beside null ones; kinds that don't exist; a fold of its own to compare with."""
    rng, log = random.Random(5), []
    for conv in (None, 2**60 + 1, 2**60 + 2, -(2**63), 7):
        for seq in range(60):
            log.append((conv, seq, rng.choice(["open", "delta", "delta", "delta", "edit", "redo", "nonsense", None]), rng.choice([0, 1, 2, 2**60 + 1, None]), rng.choice(["user", None, "assistant"]), rng.choice(["a", "<|b", None, "c\n"])))
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, slot long, role string, text string")
    made = chat.chat(events)
    got = {r.conv_id: chat.read_back(r.formatted) for r in made.collect()}
    assert got == {c: brute_fold([e[2:] for e in log if e[0] == c]) for c in {e[0] for e in log}}
    assert {r.conv_id: r.n_turns for r in chat.digests(made).collect()} == {c: len(m) for c, m in got.items()}
    text = chat.chat(events.selectExpr("string(conv_id) as conv_id", "seq", "kind", "slot", "role", "text"))
    assert {r.conv_id for r in text.collect()} == {None if e[0] is None else str(e[0]) for e in log}
