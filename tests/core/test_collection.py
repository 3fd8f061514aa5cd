from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from granary import schemas
from granary.operators import cleaning, detections as D, duplicates, provenance, quality, records, retrieval as R
from granary.functions import geometry as G


def test_manifest_three_valued_parent(spark):
    rows = spark.createDataFrame([(x,) for x in ("absent", "missing", "null", "unknown", "own", "twice")], "filename string")
    over = [("missing", "T", None, None, False, None, None, None, None), ("null", None, "", None, True, None, None, "text by OCR", True), ("unknown", None, None, None, True, "zz", None, None, None), ("own", None, "Org", None, True, "q", None, None, None), ("twice", "b", None, None, False, None, None, None, None), ("twice", "a", None, None, False, None, None, None, None)]
    parents = spark.createDataFrame([("p", "Parent", None), ("q", "Q", "u")], schemas.MANIFEST_PARENTS)
    got = {r["filename"]: r for r in provenance.overlaid(rows, spark.createDataFrame(over, schemas.MANIFEST_OVERRIDES), parents, "p").collect()}
    assert len(got) == 6
    assert got["absent"]["parent_work"] == "p" == got["missing"]["parent_work"] and got["null"]["parent_work"] is None and got["unknown"]["manifest_organization"] is None
    assert (got["own"]["manifest_organization"], got["own"]["organization_evidence"], got["own"]["source_url"]) == ("Org", "manifest_override", "u")
    assert got["missing"]["organization_evidence"] == "manifest_parent_work" and got["null"]["ocr_derived"] and not got["absent"]["title_rejected"] and got["twice"]["verified_title"] == "a"


def test_front_matter(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    assert one(provenance.verified_title(F.lit("untitled"), F.lit("1\nshort\nRice blast in the delta\n"))) == "Rice blast in the delta"
    assert one(provenance.verified_title(F.lit("A real title"), F.lit("x"))) == "A real title" and one(provenance.verified_title(F.lit(None).cast("string"), F.lit("1"))) == ""
    assert tuple(one(provenance.publisher(F.lit("© 2001 FAO"), F.lit(None).cast("string"), F.lit("")))) == ("FAO", "imprint")
    assert tuple(one(provenance.publisher(F.lit("as FAO said"), F.lit(""), F.lit("LSU")))) == ("LSU AgCenter", "publisher_name_in_frontmatter")
    assert tuple(one(provenance.publisher(F.lit(""), F.lit(""), F.lit(""))))[0] == "undetermined"
    assert one(provenance.document_type(F.lit("T"), F.lit("abstract x references"), F.lit(0), F.lit(90))) == "research_paper"
    assert one(provenance.document_type(F.lit("T"), F.lit("x"), F.lit(1), F.lit(40))) == "bulletin" and one(provenance.document_type(F.lit("T"), F.lit("x"), F.lit(1), F.lit(41))) == "other"
    assert one(provenance.is_initialism(F.lit("RBSD_x"), F.lit("Rice black streaked dwarf"))) and not one(provenance.is_initialism(F.lit("abc"), F.lit("Rice blast")))
    assert "disagrees" in one(provenance.name_mismatch(F.lit("tungro-report"), F.lit("Sheath blight guide"), F.lit("sheath sheath blight")))
    assert one(provenance.name_mismatch(F.lit("blight-report"), F.lit("Sheath blight guide"), F.lit("x"))) is None
    assert one(provenance.language(F.lit("the rice and the leaf of the plant is " * 8))) == "en" and one(provenance.language(F.lit("the"))) == "unknown"


def test_hyphens_by_evidence_and_guard(spark):
    texts = [(1, "the leaf- blast and Echinochloa crus- galli here"), (2, "a well-known fact, well- known too"), (3, None), (4, "")]
    frame = spark.createDataFrame(texts, "id int, text string")
    out = {r["id"]: r for r in cleaning.dehyphenated(frame, cleaning.inline_hyphens(frame), ["id"]).collect()}
    assert out[2]["text"] == "a well-known fact, well-known too" and out[2]["hyphens_kept"] == 1 and out[3]["text"] is None and len(out) == 4
    assert "crus-galli" in out[1]["text"] and out[1]["hyphens_joined"] + out[1]["hyphens_kept"] == 2
    joined = cleaning.words_rejoined(spark.createDataFrame([("d uring and d uring " + "x" * 60 + " Oryza d uring",), (None,)], "text string")).collect()
    assert joined[0]["repairs"] == 2 and joined[0]["repairs_skipped"] == 1 and joined[1]["text"] is None
    assert cleaning.cleaning_report(cleaning.words_rejoined(frame)).first()["repairs"] == 0


def test_headers_are_stripped(spark):
    texts = spark.createDataFrame([("d", "Body The Big Header more"), ("e", "The Big Header")], "filename string, text string")
    headers = spark.createDataFrame([("d", "The  Big Header"), ("d", "The Big")], "filename string, text string")
    out = {r["filename"]: r for r in cleaning.without_headers(texts, headers).collect()}
    assert out["d"]["text"] == "Body more" and out["d"]["header_words"] == 3 and out["e"]["text"] == "The Big Header"


def brute_near(rows, k, least, overlap):
    import re

    sets = {}
    for text in {t for _, t in rows if t is not None}:
        w = re.findall("[a-z]+", text.lower())
        if len(w) >= least:
            sets[min(i for i, t in rows if t == text)] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    ids = sorted(sets)
    return {(a, b, len(sets[a] & sets[b])) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) >= overlap}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    parts = [" ".join(rng.choices("abcdefgh", k=rng.randint(3, 12))) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))) for i in range(80)] + [(90, None), (91, "")]
    rows.append((92, rows[0][1]))
    for overlap in (0.3, 0.75):
        got = {(r["id_a"], r["id_b"], r["shared"]) for r in duplicates.near_duplicates(spark.createDataFrame(rows, "id int, text string"), "id", k=3, least_words=6, overlap=overlap).collect()}
        assert got == brute_near(rows, 3, 6, overlap) != set()


def test_near_duplicates_store_no_pairs(spark, monkeypatch):
    rng = random.Random(4)
    parts = [" ".join(rng.choices("abcdefgh", k=9)) for _ in range(20)]
    rows = [(f"d{i}", " ".join([parts[0], *(rng.choice(parts) for _ in range(rng.randint(2, 5)))])) for i in range(120)] + [("d200", None), ("d201", " ")]
    held, stored = [], duplicates.stored

    def counted(df):
        held.append(stored(df))
        return held[-1]

    monkeypatch.setattr(duplicates, "stored", counted)
    monkeypatch.setattr(duplicates, "_BLOCK_SHINGLES", 300, raising=False)
    monkeypatch.setattr(duplicates, "_SAMPLE_TEXTS", 20, raising=False)
    for overlap in (0.4, 0.7):
        frame = spark.createDataFrame(rows + rows[:3], "id string, text string").repartition(3)
        got = [(r["id_a"], r["id_b"], r["shared"]) for r in duplicates.near_duplicates(frame, "id", k=3, least_words=6, overlap=overlap).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_near(rows, 3, 6, overlap) != set()
        assert max(h.count() for h in held[:-1]) <= len(rows) + 3  # the last are the pairs found
        held.clear()


def test_exact_duplicates_and_latest(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (2, "a")], "id int, text string")
    assert {tuple(r) for r in duplicates.exact_duplicates(frame, "id").collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 1)}
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", None, "z"), ("b", None, "q")], "k string, t int, v string")
    assert {(r["k"], r["v"]) for r in duplicates.latest_rows(rows, "k", "t").collect()} == {("a", "y"), ("b", "q")}


def test_records_and_verification(spark):
    rec = lambda **kw: tuple(kw.get(f) for f in schemas.VERIFIED_RECORD.fieldNames())
    tables = spark.createDataFrame([("Table 1", 3, "Fungicides.", "Sheath_Blight", [rec(fungicide="Quad", active_ingredient="azo + pro", rate_per_acre="9 fl oz", source_disease_label="Blight (sheath)"), rec(cultivar_reaction="S", percent_positive_stops="35", comments="late", disease_name="Kernel Smut"), rec(fungicide="None such")])], schemas.VERIFIED_TABLES)
    chunks = records.treatment_chunks(tables, {"document": "h.pdf", "document_title": "H", "organization": "O"}).orderBy("chunk_index").collect()
    assert chunks[0]["text"] == "Fungicides. For Blight (sheath): apply Quad (active ingredient azo + pro) at 9 fl oz per acre." and chunks[0]["disease_name_is_canonical"]
    assert "threshold is 35% positive stops and n/a% infected tillers. late" in chunks[1]["text"] and chunks[1]["crop_stage"] == "late" and not chunks[1]["disease_name_is_canonical"]
    pages = spark.createDataFrame([(3, "Quad azo +\npro 9 fl oz Blight S 35")], "page int, text string")
    checked = records.verified(tables, pages)
    assert [r["value"] for r in checked.filter("not found").collect()] == ["None such"]
    assert records.verification_report(checked).first()["failed"] == 1
    assert records.verified(tables, pages.limit(0)).filter("found").count() == 0


def boxes(spark, seed):
    rng = random.Random(seed)
    rows = [(g, i, rng.choice([0.5, 0.6, 0.9, round(rng.random(), 2)]), (float(x := rng.randint(0, 40)), float(y := rng.randint(0, 40)), float(x + rng.randint(0, 20)), float(y + rng.randint(1, 20)))) for g in range(6) for i in range(25)]
    return rows, spark.createDataFrame(rows, "g int, anchor_id int, score double, box struct<x1:double,y1:double,x2:double,y2:double>")


def plain_iou(a, b):
    w, h = max(min(a[2], b[2]) - max(a[0], b[0]), 0), max(min(a[3], b[3]) - max(a[1], b[1]), 0)
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / u if u > 0 else 0.0


def test_suppression_equals_plain_python(spark):
    rows, frame = boxes(spark, 8)
    expected = set()
    for g in range(6):
        kept = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            if all(plain_iou(r[3], k[3]) < 0.45 for k in kept):
                kept.append(r)
        expected |= {(g, k[1]) for k in kept}
    assert {(r["g"], r["anchor_id"]) for r in D.suppressed(frame, ["g"]).collect()} == expected


def test_detection_chain(spark):
    anchors = [(0, 0, 100.0, 100.0, 20.0, 20.0, [0.25, 0.1, 0.0, 0.0, 0.0, 0.0], [0.0]), (0, 1, 101.0, 100.0, 20.0, 20.0, [0.26, 0.26, 0.0, 0.0, 0.0, 0.0], [0.0]), (0, 2, 300.0, 300.0, 20.0, 20.0, [0.0] * 4 + [0.29, 0.0], [0.0])]
    images = spark.createDataFrame([(0, "a", 320, 640, 1.0, 160.0, 0.0)], schemas.IMAGES)
    got = D.detect(spark.createDataFrame(anchors, schemas.ANCHORS), images).collect()
    assert [(r["anchor_id"], r["class_id"]) for r in got] == [(1, 0)] and got[0]["box"]["x1"] == 0.0


def test_masks(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    grids = [rng.random((5, 7)) > 0.5 for _ in range(6)] + [np.zeros((5, 7), bool), np.ones((5, 7), bool)]
    rows = []
    for i, g in enumerate(grids):
        coded = D.rle_encode(g)
        assert (D.rle_decode(coded["size"], coded["counts"]) == g).all() and (coded["counts"][0] == 0) == bool(g[0, 0])
        rows.append((i // 3, i, "c", coded["size"], coded["counts"]))
    frame = spark.createDataFrame(rows, schemas.MASKS)
    assert [r["a"] for r in frame.orderBy("det_id").select(D.mask_area(F.col("counts")).alias("a")).collect()] == [int(g.sum()) for g in grids]
    union = {r["image_index"]: r["pixels"] for r in D.union_area(frame, ["image_index"]).collect()}
    assert union == {k: int(np.any(grids[3 * k : 3 * k + 3], axis=0).sum()) for k in range(3)}
    for r in D.mask_overlap(frame).collect():
        a, b = grids[r["det_a"]], grids[r["det_b"]]
        assert math.isclose(r["iou"], (a & b).sum() / (a | b).sum())
    images = spark.createDataFrame([(k, "f", 7, 5, 1.0, 0.0, 0.0) for k in range(4)], schemas.IMAGES)
    scores = frame.select("image_index", "det_id", "class_name", F.lit(0.5).alias("score"))
    found = D.findings(frame, scores, images).first()
    assert found["affected_pixels"] == sum(union.values()) and math.isclose(found["affected_ratio"], sum(union.values()) / 140) and found["image_indices"] == [0, 1, 2]
    nothing = D.overall_area(frame.limit(0), images).first()
    assert (nothing["affected_ratio"], nothing["severity"]) == (0.0, "LOW")


def test_mask_overlap_moves_masks_and_no_pairs(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.randrange(4), rng.randrange(15), [rng.randrange(6) for _ in range(rng.randrange(9))]) for _ in range(90)] + [(None, 1, [0, 9]), (1, None, [0, 9]), (1, 99, None), (1, 98, [0, 3, None, 9])]
    pixels = {}
    for picture, det, counts in rows:
        if None not in (picture, det, counts):
            known = counts[: counts.index(None)] if None in counts else counts
            at = [sum(known[:i]) for i in range(len(known) + 1)]
            pixels.setdefault((picture, det), set()).update(p for i in range(1, len(known), 2) for p in range(at[i], at[i + 1]))
    true = {(p, a, b): len(x & y) / len(x | y) for (p, a), x in pixels.items() for (q, b), y in pixels.items() if p == q and a < b and x & y}
    frame = spark.createDataFrame(rows, "image_index int, det_id bigint, counts array<int>")
    for at_once, least in ((1, 0.0), (40, 0.0), (1 << 16, 0.5)):
        monkeypatch.setattr(D, "_RUN_PAIRS_AT_ONCE", at_once)
        found = D.mask_overlap(frame, least=least)
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len({r[:3] for r in got}) and {r[:3]: r[3] for r in got} == {k: v for k, v in true.items() if v >= least} != {}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Repartition") == 1


def test_built_mask_is_cut_to_its_box(spark):
    detections = spark.createDataFrame([(0, 0, "c", [10.0], 0.0, 0.0, 8, 8, (2.0, 1.0, 6.0, 5.0))], "image_index int, det_id int, class_name string, coeffs array<float>, pad_x double, pad_y double, orig_w int, orig_h int, box struct<x1:double,y1:double,x2:double,y2:double>")
    protos = spark.createDataFrame([(0, [1.0] * 16, 1, 4)], "image_index int, protos array<float>, n int, side int")
    row = D.build_masks(detections, protos).first()
    mask = D.rle_decode(row["size"], row["counts"])
    assert mask.sum() == 16 and mask[1:5, 2:6].all()


@pytest.mark.parametrize(("ratio", "band"), [(0.0299, "LOW"), (0.03, "MODERATE"), (0.0999, "MODERATE"), (0.10, "HIGH"), (0.1799, "HIGH"), (0.18, "CRITICAL"), (None, None)])
def test_severity(spark, ratio, band):
    assert spark.createDataFrame([(ratio,)], "r double").select(G.severity(F.col("r")).alias("s")).first()["s"] == band


def test_verdicts(spark):
    rows = [("r", 0, None, 0.5), ("r", 1, "b", 0.4), ("s", 0, "c", 0.61), ("s", 1, "d", 0.2)]
    told = {(r["request_id"], r["image_index"]): (r["label"], r["uncertain"]) for r in D.panicle_verdicts(spark.createDataFrame(rows, schemas.SPIKE_SCORES)).collect()}
    assert told[("r", 0)] == ("healthy", True) and told[("s", 0)] == ("unhealthy", False)
    assert {r["request_id"]: r["overall"] for r in D.worst_case(D.panicle_verdicts(spark.createDataFrame(rows, schemas.SPIKE_SCORES))).collect()} == {"r": "healthy", "s": "unhealthy"}


def searchable(spark):
    rows = [("a", "Leaf_Blast", "bulletin", False, [1.0, 0.0]), ("b", "Leaf_Blast", "bulletin", True, [1.0, 0.0]), ("c", "Leaf_Blast", "screening_manual", False, [1.0, 0.0]), ("d", None, None, None, [1.0, 0.1]), ("e", "Leaf_Blast", "bulletin", False, [1.0, 0.0]), ("z", "Leaf_Blast", "bulletin", False, [0.0, 0.0])]
    return spark.createDataFrame(rows, "chunk_id string, disease_name string, document_type string, is_inoculation_protocol boolean, vector array<double>")


def test_filtered_search(spark):
    chunks = searchable(spark)
    assert [r["chunk_id"] for r in R.top_k(chunks, [1.0, 0.0], 2, "Leaf_Blast", "treatment").collect()] == ["a", "e"]
    assert [r["chunk_id"] for r in R.top_k(chunks, [1.0, 0.0], 20).orderBy("chunk_id").collect()] == ["a", "d", "e"]
    assert R.top_k(chunks, [1.0, 0.0], -1, None, "unfiltered").count() == 1 and R.top_k(chunks, [1.0, 0.0], 0, None, "unfiltered").count() == 5
    with pytest.raises(ValueError):
        R.metadata_filter("Blight", "treatment")
    with pytest.raises(ValueError):
        R.metadata_filter(None, "any")
    assert R.safety_violations(chunks).count() == 2


def test_requests_equal_single_searches(spark, monkeypatch):
    from granary.config import RetrievalLimits

    limits = RetrievalLimits(dim=2)
    rows = [("q1", [1.0, 0.0], "Leaf_Blast", "treatment", 1), ("q2", [1.0, 0.0], "", "unfiltered", None), ("q3", [0.0, 0.0], None, None, 3), ("q4", [1.0, 0.0], "none such", "reference", 3), ("q5", [0.0, 1.0], None, None, 99), ("q6", None, None, None, 3)]
    requests = spark.createDataFrame(rows, schemas.RETRIEVAL_REQUESTS)

    def run():
        got = {}
        for r in R.request_results(requests, searchable(spark), limits).orderBy("request_id", "rank").collect():
            got.setdefault(r["request_id"], []).append(r["chunk_id"])
        return got

    expected = {"q1": ["a"], "q2": ["a", "b", "c", "e", "d"], "q5": ["d", "a", "e"]}
    assert run() == expected
    monkeypatch.setattr(R, "_REQUEST_BLOCK", 2)
    assert run() == expected


def test_merging(spark):
    rows = [("r", 0, 1, "a", 0.1), ("r", 0, 2, "b", 0.5), ("r", 1, 1, "a", 0.9), ("r", 1, 2, "c", None)]
    frame = spark.createDataFrame(rows, "k string, q int, rank int, chunk_id string, score double")
    assert [r["chunk_id"] for r in R.merged_first_wins(frame, ["k"], ["q", "rank"]).orderBy("q", "rank").collect()] == ["a", "b", "c"]
    assert [(r["chunk_id"], r["score"]) for r in R.merged_by_score(frame, ["k"], ["q", "rank"], 2).orderBy("place").collect()] == [("b", 0.5), ("a", 0.1)]


def test_citations_and_context(spark):
    rows = [("r", 1, "doc", None, "", 0, "x", " body ", None, None), ("r", 2, "doc", "T", "O", 3, None, "b", "2 g", "azo")]
    frame = spark.createDataFrame(rows, "k string, rank int, source_document string, document_title string, organization string, page_start int, disease_name string, text string, dosage string, active_ingredient string")
    out = R.context(frame, ["k"]).first()
    assert out["context"] == "[1] doc (unknown source) | x\nbody\n\n[2] T (O), p. 3\nb\nDosage as printed: 2 g | Active ingredient: azo"
    assert out["sources"] == "- doc (unknown source)" and out["n_passages"] == 2


def test_history_keeps_the_last(spark):
    rows = [(1, t, "system" if t == 30 else "user", str(t)) for t in range(62)]
    messages = R.history(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).first()["messages"]
    assert len(messages) == 60 and messages[0]["turn"] == 1 and messages[-1]["turn"] == 61


def test_quality_checks(spark):
    rows = [("a", "Leaf_Blast", True, "treatment_record", True), ("a", "Odd", True, "narrative", None), (None, None, None, None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, disease_name string, disease_name_is_canonical boolean, chunk_type string, is_inoculation_protocol boolean")
    assert tuple(quality.key_report(chunks, "chunk_id").first()) == (3, 1, 1, False)
    assert quality.unsafe_chunks(chunks).count() == 1 and [r[0] for r in quality.unexpected_classes(chunks).collect()] == ["Odd"]
    assert quality.label_sets(chunks).filter("in_data and canonical").count() == 1
    assert quality.schema_gaps(["chunk_id", "extra"])[0] == ["extra"]
    assert tuple(quality.reconciled(chunks, chunks.limit(0), "chunk_id").first()) == (3, 0, 2, 0)


def test_every_hundredth_vector_asks(spark, tmp_path):
    from granary.plans import search

    rows = [(i, [math.cos(i), math.sin(i)], i % 2) for i in range(2150)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    near = search.filtered_topk_whole(spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in near} == set(range(0, 2150, 100)) and len(near) == 22 * 5
    assert all(r["vec_id"] % 2 == 0 and r["vec_id"] != r["query_id"] for r in near)
    merged = search.fanout_topk_merge_whole(spark, str(tmp_path)).collect()
    assert sorted((r["request_id"], r["place"]) for r in merged) == [(r, p) for r in range(3) for p in range(1, (8 if r < 2 else 7))]
    first = search.fanout_first_wins_whole(spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in first} == set(range(0, 2150, 100)) and len({(r["request_id"], r["chunk_id"]) for r in first}) == len(first)


def test_queries_in_blocks_equal_queries_at_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(300)], "vec_id bigint, embedding array<float>")
    asked = rows.filter("vec_id < 7").selectExpr("vec_id as query_id", "embedding as q")
    whole = sorted(R.query_results(asked, rows, 4).collect())
    monkeypatch.setattr(R, "_REQUEST_BLOCK", 3)
    assert sorted(R.query_results(asked, rows, 4).collect()) == whole and len(whole) == 28
