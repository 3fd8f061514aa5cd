from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from granary.operators import reports as P


def test_rankings_and_samples(spark):
    documents = spark.createDataFrame([("a", [1]), ("b", []), ("c", [1, 2])], "filename string, thin_pages array<int>")
    assert [r["filename"] for r in P.thinnest(documents).collect()] == ["c", "a"] and P.thinnest(documents, 1).count() == 1
    audited = spark.createDataFrame([("a", 2, ["d", "e", "f"]), ("a", 1, ["b"]), ("a", 3, ["g", "h"])], "filename string, page int, captions array<string>")
    assert P.samples(audited).first()["samples"] == ["b", "d", "e", "g", "h"]
    found = spark.createDataFrame([(0, 1, 0.5), (0, 0, 0.5), (1, 2, 0.1)], "image_index int, det_id int, score double")
    assert {tuple(r)[:2] for r in P.top_detection(found, ["image_index"]).collect()} == {(0, 0), (1, 2)}
    assert P.any_rows(found) and not P.any_rows(found.limit(0))


def test_labels_and_forms(spark):
    rows = spark.createDataFrame([(0.85, "x", ["p"]), (0.65, "", []), (0.1, "y" * 4001, None), (None, None, None)], "c double, m string, d array<string>")
    out = rows.select(P.confidence_label(F.col("c")).alias("l"), P.message_error(F.col("m")).alias("e"), P.targets(F.col("d"), F.lit("q")).alias("t")).collect()
    assert [tuple(r) for r in out] == [("high", None, ["p"]), ("medium", "empty_message", ["q"]), ("low", "message_too_long", ["q"]), (None, "empty_message", ["q"])]
    one = rows.limit(1).select(P.joined_blocks(F.lit("a"), F.lit(""), F.lit(None).cast("string"), F.lit("b")).alias("j"), P.log_record(level=F.lit("INFO"), none=F.lit(None).cast("string")).alias("r")).first()
    assert one["j"] == "a\n\nb" and json.loads(one["r"]) == {"level": "INFO"}
    assert P.wire_names(spark.createDataFrame([(1, 2)], "image_index int, mask_area_px int")).columns == ["imageIndex", "maskAreaPx"]


def test_encoder_is_pluggable(spark):
    rows = spark.createDataFrame([("ab",), ("abcd",)], "t string")
    load = lambda: lambda texts: [[float(len(t)), 0.0] for t in texts]
    assert {tuple(r["vector"]) for r in P.encoded(rows, F.col("t"), load, 2).collect()} == {(1.0, 0.0)}
    with pytest.raises(Exception, match="another length"):
        P.encoded(rows, F.col("t"), load, 3).collect()
