from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm.spans import anchors, components, gram_hashes, shared_share, shared_spans, sharing_pairs

import numpy as np

SCHEMA = "chunk_id string, text string"


def brute_pairs(rows, length):
    texts = {}
    for i, t in rows:
        if i is not None and t is not None and len(t) >= length:
            texts.setdefault(i, set()).add(t)
    grams = {i: {t[k : k + length] for t in ts for k in range(len(t) - length + 1)} for i, ts in texts.items()}
    ids = sorted(grams)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if grams[a] & grams[b]}


def brute_share(rows, length):
    """By id and text: characters in runs that also stand under another id or in another text."""
    out = {}
    rows = {(i, t) for i, t in rows if i is not None and t is not None and len(t) >= length}
    for i, t in rows:
        other = {u[k : k + length] for j, u in rows if u != t for k in range(len(u) - length + 1)}
        covered = set()
        for k in range(len(t) - length + 1):
            if t[k : k + length] in other:
                covered |= set(range(k, k + length))
        out[i, t] = len(t) if any(u == t and j != i for j, u in rows) else len(covered)
    return out


def made(seed, n=40, length=30):
    rng = random.Random(seed)
    letters = "abcdé𝒳 "
    parts = ["".join(rng.choices(letters, k=rng.randint(20, 60))) for _ in range(6)] + ["ab" * 40, "a" * 70]
    rows = [(f"c{k:02d}", "".join(rng.choice(parts)[rng.randint(0, 5) :] + "".join(rng.choices(letters, k=rng.randint(0, 9))) for _ in range(rng.randint(0, 4)))) for k in range(n)]
    return rows + [rows[0], ("copy", rows[3][1]), ("null", None), (None, "x" * 50), ("empty", "")]


def check(spark, rows, length, gram, hot):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sharing_pairs(frame, length=length, gram=gram, hot=hot)
    pairs = [(r["id_a"], r["id_b"]) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute_pairs(rows, length)


def test_pairs_equal_brute_force(spark):
    check(spark, made(1), 30, 15, 64)


def test_pairs_equal_brute_force_with_hot_anchors(spark):
    check(spark, made(2), 30, 15, 3)


def test_share_equals_brute_force(spark):
    for hot in (64, 3):
        rows = made(3)
        got = {(r["id"], r["chars"]): r["shared_chars"] for r in shared_share(spark.createDataFrame(rows, SCHEMA), length=30, gram=15, hot=hot).collect()}
        assert got == {(i, len(t)): n for (i, t), n in brute_share(rows, 30).items()}


def brute_runs(rows, length):
    """Per pair of texts the longest common runs, by their diagonals."""
    texts = sorted({t for i, t in rows if i is not None and t is not None and len(t) >= length})
    out = set()
    for x in texts:
        for y in texts:
            if x < y:
                for shift in range(-len(y), len(x)):
                    n = 0
                    for k in range(max(0, -shift), min(len(y), len(x) - shift) + 1):
                        if k < len(y) and k + shift < len(x) and x[k + shift] == y[k]:
                            n += 1
                        else:
                            if n >= length:
                                out.add(frozenset([(x, k + shift - n, n), (y, k - n, n)]))
                            n = 0
    return out


def test_spans_are_the_longest_runs_whatever_counts_as_hot(spark):
    rows = made(5, n=25)
    frame = spark.createDataFrame(rows, SCHEMA)
    keys = {r[0]: r[1] for r in frame.filter("text is not null").selectExpr("xxhash64(0, text)", "text").collect()}
    for hot in (8192, 3):
        got = [frozenset([(keys[r["text_a"]], r["start_a"], r["span"]), (keys[r["text_b"]], r["start_b"], r["span"])]) for r in shared_spans(frame, length=30, gram=15, hot=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_runs(rows, 30)


def noticed(n, seed=6):
    rng = random.Random(seed)
    notice = "".join(rng.choices("abcdefgh ", k=600))
    return [(f"c{k:04d}", "".join(rng.choices("ijklmnop ", k=rng.randint(50, 300))) + notice + "".join(rng.choices("qrstuvw ", k=100))) for k in range(n)]


def test_a_notice_in_many_texts_gives_one_run_for_each_pair(spark):
    for n, hot in ((70, 8192), (70, 8)):
        frame = spark.createDataFrame(noticed(n), SCHEMA)
        spans = shared_spans(frame, hot=hot).collect()
        assert len(spans) == n * (n - 1) // 2 and all(600 <= r["span"] < 610 for r in spans)
        told = shared_share(frame, hot=hot).collect()
        assert len(told) == n and all(600 <= r["shared_chars"] < 610 for r in told) and {r["class_id"] for r in told} == {"c0000"}
    assert sharing_pairs(spark.createDataFrame(noticed(400), SCHEMA)).count() == 400 * 399 // 2


def test_a_notice_one_character_too_short_gives_nothing(spark):
    rows = [(f"c{k}", chr(65 + k % 50) * (k + 1) + "".join(random.Random(9).choices("abcdefgh ", k=239)) + chr(300 + k)) for k in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sharing_pairs(frame).count() == 0 and sharing_pairs(frame, hot=4).count() == 0


def test_copies_of_one_text_under_many_ids_leave_its_runs_whole(spark):
    long = "".join(random.Random(7).choices("abcdefgh ", k=600))
    rows = [(f"a{k:02d}", long) for k in range(71)] + [("b", "x" * 50 + long), ("c", long + "y" * 50)]
    spans = shared_spans(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(spans) == 3 and all(r["span"] == 600 for r in spans)


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 102), (102, 101)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in (100, 101, 102)}


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sharing_pairs(empty).count() == 0
    rows = [("a", "q" * 10 + "z" * 300, 1, 2), ("b", "z" * 300, 3, 4)]
    frame = spark.createDataFrame(rows, "chunk_id string, text string, text_key int, id int")
    assert [tuple(r) for r in sharing_pairs(frame).collect()] == [("a", "b")]


def test_very_long_text(spark):
    rng = random.Random(4)
    long = "".join(rng.choices("abcdefgh", k=5_000_000))
    rows = [("long", long), ("part", "x" * 100 + long[4_400_000:4_400_240] + "y" * 100), ("less", "x" * 100 + long[100:339] + "y" * 100)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sharing_pairs(frame).collect()
    assert [tuple(r) for r in got] == [("long", "part")]


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=20, max_size=80), st.integers(0, 50), st.text("xyz", max_size=30), st.text("xyz", max_size=30))
def test_a_shared_window_shares_an_anchor(text, cut, before, after):
    gram, window = 6, 10
    span = text[cut % (len(text) - 15 + 1) :][: gram + window - 1]
    if len(span) < gram + window - 1:
        return

    def marks(t):
        codes = np.array([ord(c) for c in t], np.uint32)
        at, hashed = anchors(codes, np.array([0]), np.array([len(codes)]), gram, window)
        assert (gram_hashes(codes, gram)[at] == hashed).all()
        return set(hashed.tolist())

    assert marks(text) & marks(before + span + after)
