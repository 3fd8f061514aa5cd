from __future__ import annotations

import importlib
import json
import struct
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from granary import schemas
from granary.sources import files
from granary.streaming.ingest import arrivals, deliveries, start_ingest

ROOT = Path(__file__).resolve().parents[2]


def test_json_artifacts_and_manifest(spark, tmp_path):
    assert files.read_json(spark, str(tmp_path / "none.json"), schemas.SECTIONS).count() == 0
    (tmp_path / "s.json").write_text(json.dumps([{"filename": "a", "section_index": 0, "extra": 1}]))
    assert files.read_json(spark, str(tmp_path / "s.json"), schemas.SECTIONS).first()["heading"] is None
    (tmp_path / "m.json").write_text(json.dumps({"overrides": {"a": {"verified_title": "T"}, "b": {"parent_work": None}, "c": {"parent_work": "p"}}, "parent_works": {"p": {"organization": "O"}}, "default_parent_work": "p"}))
    over, parents, default = files.read_manifest(spark, str(tmp_path / "m.json"))
    assert {(r["filename"], r["has_parent_work"], r["parent_work"]) for r in over.collect()} == {("a", False, None), ("b", True, None), ("c", True, "p")}
    assert parents.first()["organization"] == "O" and default == "p"
    assert files.read_manifest(spark, str(tmp_path / "x.json"))[2] is None


def test_binary_files_and_images(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 40, 20) + b"\x08"
    for label in ("healthy", "unhealthy"):
        (tmp_path / label).mkdir()
        for k in range(30):
            (tmp_path / label / f"{k}.png").write_bytes(png)
    seen = files.binary_files(spark, str(tmp_path), "*.png").withColumn("s", files.image_size(F.col("content")))
    assert seen.count() == 60 and tuple(seen.first()["s"]) == (40, 20)
    assert seen.filter(files.image_error(F.col("length"), F.col("s.width"), F.col("s.height")) == "image_too_small").count() == 60
    split = files.labelled_images(spark, str(tmp_path))
    assert {r["label"] for r in split.select("label").distinct().collect()} == {"healthy", "unhealthy"} and {tuple(r) for r in split.select("path", "split").collect()} == {tuple(r) for r in split.select("path", "split").collect()}
    parts = spark.createDataFrame([("image_10", b"x"), ("image_2", b"y"), ("other", b"z")], "field string, content binary")
    assert [r["field"] for r in files.request_images(parts).orderBy("image_index").collect()] == ["image_10", "image_2"]
    assert parts.select(files.data_uri(F.col("content")).alias("u")).first()["u"] == "data:image/jpeg;base64,eA=="


def test_collection_and_quarantine(spark, tmp_path):
    rows = [("a", "text", False, "narrative", 1), ("b", " ", False, "narrative", 1), ("c", "t", True, "treatment_record", 1), ("d", "t", False, "narrative", 1), ("e", "t", False, "narrative", 1)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, is_inoculation_protocol boolean, chunk_type string, odd int")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [1.0, 0.0]), ("d", [0.0, 0.0])], schemas.CHUNK_VECTORS)
    good, bad = files.to_collection(chunks, vectors, dim=2)
    assert "odd" not in good.columns and [r["chunk_id"] for r in good.collect()] == ["a"]
    assert {r["chunk_id"]: r["reason"] for r in bad.collect()} == {"b": "no text", "c": "unsafe", "d": "unusable vector", "e": "no vector"}
    files.create_collection(good.drop("vector"), "made_once")
    with pytest.raises(ValueError):
        files.create_collection(good, "made_once")
    spark.sql("drop table made_once")
    files.write_artifact(good, str(tmp_path / "out.parquet"), json=True)
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == 1


def test_stream_keeps_the_latest_of_each_chunk(spark, tmp_path):
    schema = "chunk_id string, ingested_at timestamp, document_type string, text string"
    incoming, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(incoming)
        start_ingest(deliveries(spark, incoming, schema), target, state).awaitTermination()
        return {(r["chunk_id"], r["text"]) for r in spark.read.parquet(target).collect()}

    assert deliver([("a", datetime(2024, 1, 1), "x", "old"), ("b", datetime(2024, 1, 2), "x", "b")]) == {("a", "old"), ("b", "b")}
    assert deliver([("a", datetime(2024, 2, 1), "x", "new"), ("b", datetime(2023, 1, 1), "x", "late")]) == {("a", "new"), ("b", "b")}
    query = arrivals(deliveries(spark, incoming, schema)).writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("select sum(n) from arrived").first()[0] == 4


def test_package_imports_without_session_and_without_the_optional_part(tmp_path):
    code = "import sys; sys.modules['granary.llm'] = None\nimport __spark_entry__ as e\nq, s = e.queries(), e.oracle_sql()\nassert 'p5_found' in q and 'request_topk' in q and set(s) <= set(q), set(s) - set(q)\nassert not [n for n in q if n.startswith('p') and n.endswith('_found') and n != 'p5_found']"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_outside_imports_the_optional_part():
    for path in (ROOT / "granary").rglob("*.py"):
        if "llm" not in path.parts:
            assert "granary.llm" not in path.read_text() and "import llm" not in path.read_text(), path
    assert importlib.import_module("granary.plans.catalogue").queries()
