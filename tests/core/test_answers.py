from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from granary.config import settings_from
from granary.operators import answers as A
from granary.operators import duplicates, layout, retrieval
from granary.operators import detections as D
from granary.sources import files
from granary.storage import release, released, stored


def test_states_and_contexts(spark):
    rows = [(1, ["b", "a"], "a", 0.3, "LOW", 2), (2, [], "a", 0.9, "HIGH", 1), (3, None, None, None, None, 0), (4, ["a"], "a", 0.0, None, None)]
    told = A.with_state(spark.createDataFrame(rows, "id int, diseases array<string>, disease_name string, confidence double, severity string, lesion_count int")).withColumn("context", A.vision_context())
    out = {r["id"]: r for r in told.collect()}
    assert out[1]["is_coinfection"] and out[1]["is_low_confidence"] and not out[1]["is_healthy"]
    assert out[2]["targets"] == ["a"] and out[2]["is_healthy"] and out[2]["has_diagnosis"]
    assert out[3]["targets"] == [] and not out[3]["has_diagnosis"] and out[3]["context"] == A.Wording().nothing
    assert out[1]["context"].split("\n")[:3] == ["Current photo analysis:", "- Disease: a", "- Also detected on the same sample: b"]
    assert out[4]["context"] == "Current photo analysis:\n- Disease: a\n- Lesions detected: 0\n" + A.Wording().unsure


def test_labels_errors_and_files(spark):
    rows = spark.createDataFrame([("Narrow_Brown", "image_too_large"), ("Other_One", "odd"), (None, None)], "name string, code string")
    out = rows.select(A.class_label(F.col("name")).alias("a"), A.scientific_name(F.col("name")).alias("b"), A.status(F.col("code")).alias("c")).collect()
    assert [tuple(r) for r in out] == [("Narrow Brown Leaf Spot", "Cercospora janseana", 413), ("Other One", None, 500), (None, None, None)]
    offered = spark.createDataFrame([("image/png", 5, 0), ("image/gif", 5, 0), (None, 5, 0), ("image/png", 9 << 20, 0), ("image/png", 5, 3)], "kind string, size bigint, held int")
    assert [r[0] for r in offered.select(A.file_error(F.col("kind"), F.col("size"), F.col("held"), F.lit(1))).collect()] == [None, "unsupported_format", "unsupported_format", "image_too_large", "too_many_images"]


def test_requests_without_results_are_not_grounded(spark):
    fields = "request_id int, rank int, text string, source_document string, document_title string, organization string, page_start int, disease_name string, dosage string, active_ingredient string"
    found = spark.createDataFrame([(1, 1, "t", "d", None, None, 2, None, None, None)], fields)
    asked = spark.createDataFrame([(1,), (2,)], "request_id int")
    out = {r["request_id"]: r for r in A.grounded_contexts(asked, found).collect()}
    assert out[1]["grounded"] and out[1]["sources"] == "- d (unknown source), p. 2"
    assert not out[2]["grounded"] and out[2]["context"] == retrieval.NO_PASSAGES and out[2]["n_passages"] == 0


def test_a_failed_question_is_told_as_text(spark):
    fields = "chunk_id string, vector array<float>, document_type string, is_inoculation_protocol boolean, disease_name string, text string, source_document string, document_title string, organization string, page_start int, dosage string, active_ingredient string"
    chunks = spark.createDataFrame([("c", [1.0, 0.0], "bulletin", False, "Brown_Spot", "spray", "d", "T", "O", None, None, None)], fields)
    assert retrieval.tool_reply(chunks, [1.0, 0.0], disease="none such").first()["text"].startswith("retrieval failed")
    assert tuple(retrieval.tool_reply(chunks, [1.0, 0.0], disease="Leaf_Blast").first()) == (retrieval.NO_PASSAGES, 0)
    assert tuple(retrieval.tool_reply(chunks, [1.0, 0.0]).first()) == ("[1] T (O) | Brown_Spot\nspray", 1)


def test_settings_come_from_a_configuration():
    told = settings_from({"granary.retrieval.default_k": "7", "granary.retrieval.classes": "a, b", "granary.chunks.share": "0.5", "spark.x": "1"})
    assert told.retrieval.default_k == 7 and told.retrieval.classes == ("a", "b") and told.chunks.share == 0.5
    with pytest.raises(ValueError):
        settings_from({"granary.retrieval.nothing": "1"})


def test_sizes_of_pictures_from_their_headers(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xc2\x00\x11\x08" + (300).to_bytes(2, "big") + (200).to_bytes(2, "big") + b"\x03rest"
    rows = spark.createDataFrame([(png,), (jpeg,), (b"text",), (b"",), (None,)], "content binary")
    assert [tuple(r[0]) for r in rows.select(files.image_size(F.col("content"))).collect()] == [(640, 480), (200, 300), (None, None), (None, None), (None, None)]


def test_images_are_numbered_within_each_request(spark):
    parts = spark.createDataFrame([("a", "image_2"), ("a", "image_10"), ("b", "image_1"), ("b", "note")], "request_id string, field string")
    out = {(r["request_id"], r["field"]): r["image_index"] for r in files.request_images(parts).collect()}
    assert out == {("a", "image_10"): 0, ("a", "image_2"): 1, ("b", "image_1"): 0}


def test_nested_pages_become_lines(spark):
    from granary.schemas import NESTED_PAGES

    pages = [("f", 1, 600.0, 800.0, [{"lines": [{"bbox": [1.0, 2.0, 3.0, 4.0], "spans": [{"text": "a ", "size": 9.0}, {"text": "b", "size": 11.0}]}]}, {"lines": None}, {"lines": [{"bbox": [1.0, 9.0, 3.0, 10.0], "spans": []}]}])]
    out = layout.lines_of_pages(spark.createDataFrame(pages, NESTED_PAGES)).collect()
    assert [(r["line_no"], r["y0"], r["size"], r["text"]) for r in out] == [(0, 2.0, 11.0, "a b"), (1, 9.0, None, "")]


def test_near_copies_equal_brute_force(spark):
    import random
    import re

    rng = random.Random(3)
    base = [" ".join(rng.choices("abcdefgh", k=30)) for _ in range(4)]
    rows = [(k, re.sub(r"\b\w\b", lambda m: m[0] if rng.random() > 0.02 else "zz", rng.choice(base))) for k in range(30)]
    rows += [(100, "short one"), (101, "Short, one"), (102, ""), (103, None), (104, rows[0][1]), (105, "é ü"), (106, "é-ü")]

    def grams(text):
        w = re.findall(r"[^\W_]+", text.lower())
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    texts = {}
    for i, t in rows:
        if t is not None and grams(t):
            texts.setdefault(t, i)
    found = {(i, j) for a, i in texts.items() for b, j in texts.items() if i < j and len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b))}
    got = [(r["id_a"], r["id_b"]) for r in duplicates.near_copies(spark.createDataFrame(rows, "id int, text string"), "id").collect()]
    assert len(got) == len(set(got)) and set(got) == found and {(100, 101), (105, 106)} <= found


def test_suppression_in_many_small_groups(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(int(g), int(g % 3) if g % 5 else None, k, float(rng.random()), (float(x), float(y), float(x + 20), float(y + 20))) for k, (g, x, y) in enumerate(zip(rng.integers(0, 40, 900), rng.integers(0, 60, 900), rng.integers(0, 60, 900), strict=True))]
    frame = spark.createDataFrame(rows, "image_index int, class_id int, anchor_id int, score double, box struct<x1:double,y1:double,x2:double,y2:double>")
    kept = {(r["image_index"], r["class_id"], r["anchor_id"]) for r in D.suppressed(frame, ["image_index", "class_id"]).collect()}
    expected = set()
    for key in {(g, c) for g, c, *_ in rows}:
        boxes = sorted((r for r in rows if (r[0], r[1]) == key), key=lambda r: (-r[3], r[2]))
        held = []
        for r in boxes:
            def iou(a, b):
                both = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
                return both / (800 - both)
            if all(iou(r[4], h[4]) < 0.45 for h in held):
                held.append(r)
        expected |= {(*key, r[2]) for r in held}
    assert kept == expected


def test_searches_in_several_blocks_give_the_same(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(k, rng.standard_normal(8).tolist(), str(k % 3)) for k in range(300)], "vec_id bigint, embedding array<double>, label string").repartition(3)
    asked = rows.filter("vec_id % 10 = 0").selectExpr("vec_id as query_id", "embedding as q", "label")
    whole = sorted(map(tuple, retrieval.query_results(asked, rows, 4).collect()))
    monkeypatch.setattr(retrieval, "_REQUEST_BLOCK", 4)
    monkeypatch.setattr(retrieval, "_BLOCKS_AT_ONCE", 3)
    assert sorted(map(tuple, retrieval.query_results(asked, rows, 4).collect())) == whole and len(whole) == 120


def test_written_tables_can_be_released(spark):
    outer = stored(spark.range(3))
    with released():
        inner = stored(spark.range(5))
        files_of = inner.inputFiles()
        assert inner.count() == 5
    assert outer.count() == 3 and not files.exists(spark, files_of[0])
    assert release.__defaults__ == (0,)
