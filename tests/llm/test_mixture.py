from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm.mixture import mix_sources, shard_order, split_quotas, token_count

DOCS, TARGETS = "doc_id bigint, source string, text string", "source string, target_share double, max_repeats int"


def made(spark, extra=()):
    docs = [(k, "big", "w " * (5 + k % 7)) for k in range(600)] + [(1000 + k, "small", "w " * 10) for k in range(20)] + [(2000 + k, "mid", "w " * 9) for k in range(150)] + [(3000, None, "w w"), (3001, "unlisted", "w"), (3002, "mid", None), (3003, "mid", "")]
    targets = [("big", 0.5, 1), ("small", 0.3, 3), ("mid", 0.15, 2), ("absent", 0.05, 4), (None, 0.1, 1), *extra]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)


def test_shares_repeats_and_report(spark):
    docs, targets = made(spark)
    mixed = mix_sources(docs, targets, shards=4, block_docs=8)
    report = {r["source"]: r for r in mixed.report.collect()}
    whole = sum(r["tokens"] for r in report.values())
    assert set(report) == {"big", "small", "mid", "absent"}
    assert {s for s, r in report.items() if not r["reachable"]} == {"small", "absent"}
    assert all(r["reached"] == r["reachable"] for r in report.values())
    assert report["small"]["drawn_tokens"] == 600 and report["absent"]["drawn_tokens"] == 0
    for s in ("big", "mid"):
        assert 0 <= report[s]["drawn_tokens"] - report[s]["target_share"] * whole < 12
    drawn = mixed.draws.collect()
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1)
    assert sum(r["n_tokens"] for r in drawn) == sum(r["drawn_tokens"] for r in report.values())
    uses = mixed.draws.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("c")).collect()
    assert all(r["n"] == r["c"] <= 3 for r in uses) and {r["shard"] for r in drawn} == {0, 1, 2, 3}
    assert [tuple(r) for r in mix_sources(docs, targets, shards=4, block_docs=8).draws.orderBy("id", "copy").collect()] == [tuple(r) for r in mixed.draws.orderBy("id", "copy").collect()]
    assert shard_order(mixed.draws, 4).count() == len(drawn)


def test_targets_with_nulls_and_repeats(spark):
    docs, targets = made(spark, [("big", 0.5, 1), ("odd", None, None)])
    report = {r["source"]: r for r in mix_sources(docs, targets, shards=2).report.collect()}
    assert report["odd"]["target_share"] == 0 and report["odd"]["max_repeats"] == 1 and report["odd"]["reachable"]


def test_empty_tables(spark):
    docs, targets = made(spark)
    nothing = mix_sources(docs.limit(0), targets)
    assert nothing.draws.count() == 0 and {r["actual_share"] for r in nothing.report.collect()} == {0.0}
    assert mix_sources(docs, targets.limit(0)).report.count() == 0


def test_quotas_are_exact():
    units = np.array([1000, 0, 17, 3])
    out = split_quotas(units, 7, np.random.default_rng(1))
    assert (out.sum(1) == units).all() and np.ptp(out.sum(0)) <= 2 and (out >= 0).all()


def test_tokenizer_counts(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    pytest.importorskip("tokenizers")
    frame = spark.createDataFrame([("hello world",), ("",), (None,)], "text string")
    assert [r["n"] for r in token_count(frame, "text", path, "n").collect()] == [2, 0, 0]
