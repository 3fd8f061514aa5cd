from __future__ import annotations

import random
import re
import unicodedata
from collections import defaultdict

from granary.llm import leakage
from granary.llm.leakage import leaked_documents, leaked_passages, without_leaked

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def words(text):
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text).lower())


def brute(docs, items, n):
    grams = defaultdict(set)
    for i, t in items:
        w = words(t) if t is not None and i is not None else []
        for k in range(len(w) - n + 1):
            grams[tuple(w[k : k + n])].add(i)
    return {(d, i) for d, t in docs if t is not None and d is not None for w in [words(t)] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(8)] + ["Été", "ﬁn", "１２", "a_b", "x-y"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", ". "]) for _ in range(n))

    items = [(k, text(rng.randint(0, 30))) for k in range(20)]
    docs = [(k, text(rng.randint(0, 40)) + (rng.choice(items)[1][:60] if k % 2 else "")) for k in range(60)]
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, "nothing " + items[1][1])]
    return docs, items + [(97, None), (98, ""), (None, text(20)), (3, text(15)), items[0]]


def test_pairs_equal_brute_force(spark):
    for seed, n in ((1, 5), (2, 4)):
        docs, items = made(seed)
        found = leaked_documents(leaked_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), words=n))
        assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == brute(docs, items, n) != set()


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = made(3)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    whole = {tuple(r) for r in leaked_passages(d, i, words=5).collect()}
    monkeypatch.setattr(leakage, "_BLOCK_WORDS", 60)
    assert {tuple(r) for r in leaked_passages(d, i, words=5).collect()} == whole
    monkeypatch.setattr(leakage, "_BLOCKS_AT_ONCE", 2)  # several passes over words that are told apart once
    assert {tuple(r) for r in leaked_passages(d, i, words=5).collect()} == whole


def test_longest_matches_and_places(spark):
    item = " ".join(f"i{k}" for k in range(20))
    docs = [(1, "zero " + " ".join(f"I{k}" for k in range(2, 18)) + " end"), (2, " ".join(f"i{k}" for k in range(12)))]
    got = leaked_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, item)], ITEMS)).collect()
    assert [tuple(r) for r in got] == [(1, 7, 2, 1, 16)]
    frame = spark.createDataFrame([*docs, (None, "x")], DOCS)
    assert {r["doc_id"] for r in without_leaked(frame, leaked_passages(frame, spark.createDataFrame([(7, item)], ITEMS))).collect()} == {2, None}


def test_empty_tables_and_long_text(spark):
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    item = " ".join(f"i{k}" for k in range(13))
    some = spark.createDataFrame([(1, item)], ITEMS)
    assert leaked_passages(no_docs, some).count() == 0
    assert leaked_passages(spark.createDataFrame([(1, item)], DOCS), no_items).count() == 0
    long = "pad word " * 500_000 + item
    assert leaked_passages(spark.createDataFrame([(1, long)], DOCS), some).collect()[0]["doc_word"] == 1_000_000
