from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from granary.config import ChunkLimits
from granary.operators import chunking as C


def plain_pack(text: str, limit: int, overlap: int, least: int) -> list[str]:
    """The packing rule by hand."""
    if len(text.split()) <= limit:
        return [text]
    units = []
    for s in re.split(r"(?<=[.!?])\s+(?=[A-Z(])", text):
        w = s.split()
        units += [w[i : i + limit] for i in range(0, len(w), limit)]
    out, held = [], []
    for unit in units:
        if held and sum(map(len, held)) + len(unit) > limit:
            out.append(held)
            tail = []
            for u in reversed(held):
                if sum(map(len, tail)) + len(u) > overlap:
                    break
                tail.insert(0, u)
            held = tail
        held = [*held, unit]
    told = [" ".join(w for u in g for w in u) for g in out]
    rest = " ".join(w for u in held for w in u)
    if told and rest and len(rest.split()) < least:
        told[-1] += " " + rest
    elif rest:
        told.append(rest)
    return told


def test_packing_equals_plain_python(spark):
    rng = random.Random(5)
    texts = ["", " ", "One. Two."]
    for _ in range(60):
        texts.append(" ".join(" ".join(rng.choice(["w", "Word", "(x)"]) for _ in range(rng.choice([3, 8, 30, 70]))).capitalize() + rng.choice([".", "!", "", "?"]) for _ in range(rng.randint(1, 12))))
    limits = ChunkLimits(target_words=40, overlap_words=10, least_words=8)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.packed(F.col("t"), limits).alias("p")).collect()
    for r in rows:
        assert r["p"] == plain_pack(r["t"], 40, 10, 8), r["t"]
        assert all(len(p.split()) <= 10 + 40 + 7 for p in r["p"])
    assert spark.range(1).select(C.packed(F.lit(None).cast("string")).alias("p")).first()["p"] is None


def label(spark, text, **kw):
    return tuple(spark.range(1).select(C.dominant_class(F.lit(text), {"A": "aaa", "B": "bbb"}, {"N": "nnn"}, **kw).alias("d")).first()["d"])


def test_dominant_class_boundaries(spark):
    assert label(spark, "aaa") == (None, False) and label(spark, "aaa", least=1) == ("A", True)
    assert label(spark, "aaa aaa aaa bbb bbb") == ("A", True)
    assert label(spark, "aaa aaa bbb bbb") == (None, False) and label(spark, "aaa aaa bbb bbb", share=0.5) == ("A", True)
    assert label(spark, "nnn nnn") == ("N", False) and label(spark, "") == (None, False)
    assert tuple(spark.range(1).select(C.dominant_class(F.lit(None).cast("string")).alias("d")).first()["d"]) == (None, False)


def test_chunk_types_and_safety(spark):
    rows = [("Management", "apply now", False), (None, "apply now", False), (None, "spray, drain and avoid", False), ("Control", "nothing", False), ("Management", "apply spray drain", True), (None, None, None)]
    frame = spark.createDataFrame(rows, "s string, t string, i boolean").select(C.chunk_type(F.col("s"), F.col("t"), F.col("i")).alias("k"))
    assert [r["k"] for r in frame.collect()] == ["treatment_record", "narrative", "treatment_record", "narrative", "narrative", "narrative"]
    flags = spark.createDataFrame([("screening_manual", "spore suspension"), ("other", "spore suspension"), (None, "inoculum"), ("screening_manual", None)], "d string, t string")
    assert [r["f"] for r in flags.select(C.inoculation_flag(F.col("d"), F.col("t")).alias("f")).collect()] == [True, False, False, False]


def test_sections_to_chunks(spark):
    long = " ".join(f"Sheath blight spreads in plot {i}." for i in range(60))
    sections = spark.createDataFrame([("A b.pdf", 0, "Sheath blight", long, 360, 1, 2), ("A b.pdf", 1, None, "too short", 2, 3, 3)], "filename string, section_index int, heading string, text string, word_count int, page_start int, page_end int")
    documents = spark.createDataFrame([("A b.pdf", "T", None, None, "bulletin", False)], "filename string, document_title string, organization string, source_url string, document_type string, ocr_derived boolean")
    chunks = C.narrative_chunks(sections, documents).orderBy("chunk_index").collect()
    assert [c["chunk_id"] for c in chunks] == ["a-b-pdf:0:0", "a-b-pdf:0:1"] and {c["disease_name"] for c in chunks} == {"Sheath_Blight"} and {c["organization"] for c in chunks} == {"unknown"}
    captions = spark.createDataFrame([("A b.pdf", 0, 4, "Fig. 1 Brown spot")], "filename string, caption_index int, page int, text string")
    both = C.narrative_chunks(sections, documents).unionByName(C.caption_chunks(captions, documents))
    assert both.count() == 3
    report = C.chunk_report(both).first()
    assert report["n_chunks"] == 3 and report["unlabelled"] == 0


def test_upper_median(spark):
    frame = spark.createDataFrame([(x,) for x in (1, 2, 3, 10)], "n int")
    assert frame.agg(C.upper_median("n").alias("m")).first()["m"] == 3
    assert frame.filter("n < 4").agg(C.upper_median("n").alias("m")).first()["m"] == 2
