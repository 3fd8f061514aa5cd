from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

from granary.operators.balanced import by_field, hot_keys, numbered_by_key, per_key_summary

SCHEMA = "k string, at timestamp_ntz, id string, n int, g string"


def made(seed, size=900):
    rng = random.Random(seed)
    start = datetime(2020, 1, 1)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None, "rare"]), rng.choice([None, *[start + timedelta(seconds=rng.randint(0, 10**6))] * 9]), f"i{rng.randint(0, 300):03d}", rng.choice([None, 1, 5]), rng.choice(["x", "y", None])) for _ in range(size)]
    return rows + [("hot", start, "same", 2, "x")] * 300


def key(r):
    return (r[1] is not None, r[1] or datetime.min, r[2], r[4] is not None, r[4] or "")


def test_numbers_are_exact_whatever_the_chunks(spark):
    rows = made(1)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for size in (13, 100_000):
        got = numbered_by_key(frame, ["k"], ["at", "id"], chunk_rows=size, weight="n").collect()
        groups = defaultdict(list)
        for r in got:
            groups[r["k"]].append(r)
        assert len(got) == len(rows) and set(groups) == {r[0] for r in rows}
        for g in groups.values():
            g.sort(key=lambda r: r["row_no"])
            assert [r["row_no"] for r in g] == list(range(len(g))) and all(r["chunk_no"] == r["row_no"] // size for r in g)
            order = [(r["at"] is not None, r["at"] or datetime.min, r["id"]) for r in g]
            assert order == sorted(order)
            total = 0
            for r in g:
                assert r["weight_before"] == total
                total += r["n"] or 0


def test_summary_equals_plain_python(spark):
    rows = made(2)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["k"]: r for r in per_key_summary(frame, ["k"], "at", ["id", "g"], "n", "g", chunk_rows=17).collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    assert set(got) == set(groups)
    for k, g in groups.items():
        g.sort(key=key)
        gaps = [(b[1] - a[1]).total_seconds() for a, b in zip(g, g[1:], strict=False) if a[1] and b[1]]
        assert got[k]["n_rows"] == len(g) and got[k]["total"] == sum(r[3] or 0 for r in g) and got[k]["max_gap_s"] == max(gaps)
        assert got[k]["n_changes"] == sum(a[4] != b[4] for a, b in zip(g, g[1:], strict=False))
        assert got[k]["last_at"] == max(r[1] for r in g if r[1])


def test_hot_keys_by_normal_form(spark):
    rows = [(f"c{i}", " Leaf  Blast" if i % 2 else "leaf blast", None if i < 10 else "") for i in range(95)] + [(f"d{i}", f"x{i}", "Org") for i in range(5)]
    frame = spark.createDataFrame([(*r, 0, None, 1, "t") for r in rows], "chunk_id string, disease_name string, organization string, row_no int, ingested_at timestamp_ntz, word_count int, document_type string")
    summary = per_key_summary(by_field(frame, ["disease_name", "organization"]), ["field_name", "key_value"], "ingested_at", ["chunk_id"], "word_count", "document_type")
    assert {(r["field_name"], r["key_value"], r["n_rows"]) for r in hot_keys(summary).collect()} == {("disease_name", "leaf blast", 95), ("organization", "(none)", 95), ("organization", "org", 5)}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert numbered_by_key(empty, ["k"], ["at"], weight="n").count() == 0
    assert per_key_summary(empty, ["k"], "at", ["id"], "n", "g").count() == 0


def test_one_key_is_spread_over_tasks(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([("hot", i) for i in range(4000)], "k string, i int")
    sizes = numbered_by_key(frame, ["k"], ["i"], chunk_rows=500).groupBy("k", "chunk_no").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in sizes) == [500] * 8
