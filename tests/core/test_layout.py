from __future__ import annotations

from pyspark.sql import functions as F

from granary import schemas
from granary.operators import layout, sections, tables


def line(page, n, x0, x1, y0, text, size=10.0, name="d.pdf", width=600.0):
    return (name, page, width, 800.0, n, float(x0), float(y0), float(x1), float(y0) + 10, size, text)


def lines(spark, rows):
    return spark.createDataFrame(rows, schemas.LAYOUT_LINES)


def kind(spark, rows):
    return layout.page_layout(lines(spark, rows)).first()["layout"]


def test_page_layout_boundaries(spark):
    wide = [line(1, n, 50, 550, 20 * n, "text") for n in range(12)]
    assert kind(spark, wide) == "single_column" and kind(spark, wide[:11]) == "sparse"
    two = [line(1, n, 40 if n % 2 else 320, 280 if n % 2 else 560, 20 * n, "text") for n in range(14)]
    assert kind(spark, two) == "two_column"
    assert kind(spark, [line(1, n, 50, 50 + 30, 20 * n, "x") for n in range(20)]) == "sparse"  # fragments of 5 %
    uneven = [line(1, n, 40, 280, 20 * n, "text") for n in range(12)] + [line(1, 12, 320, 560, 300, "t")]
    assert kind(spark, uneven) == "single_column"


def test_table_page_gaps(spark):
    def page(gap, rows):
        return [("d", 1, r * 10 + k, float(k * (30 + gap)), float(r * 30), float(k * (30 + gap) + 30), float(r * 30 + 8), "w") for r in range(rows) for k in range(3)]

    def found(words):
        return layout.table_pages(spark.createDataFrame(words, schemas.LAYOUT_WORDS)).first()

    assert not found(page(21, 3))["is_table"]  # wide, but so is the typical gap
    close = [("d", 1, 100 + k, float(k * 34), 500.0 + 30 * (k // 15), float(k * 34 + 30), 508.0, "w") for k in range(15)]
    assert found(page(21, 3) + close)["is_table"] and not found(page(20, 3) + close)["is_table"] and not found(page(21, 2) + close)["is_table"]


def test_reading_order(spark):
    rows = [line(1, 0, 320, 560, 10, "r1"), line(1, 1, 40, 280, 20, "l1"), line(1, 2, 40, 280, 40, "l2"), line(1, 3, 320, 560, 30, "r2")]
    two = spark.createDataFrame([("d.pdf", True)], "filename string, two_column boolean")
    assert [r["text"] for r in layout.reading_order(lines(spark, rows), two).orderBy("place").collect()] == ["l1", "l2", "r1", "r2"]
    assert [r["text"] for r in layout.reading_order(lines(spark, rows)).orderBy("place").collect()] == ["r1", "l1", "r2", "l2"]


def test_running_lines_boundaries(spark):
    def found(pages, repeats):
        rows = [line(p, 0, 50, 300, 10, "A running header" if p <= repeats else f"own {p}") for p in range(1, pages + 1)]
        heights = spark.createDataFrame([("d.pdf", p, 800.0) for p in range(1, pages + 1)], "filename string, page int, height double")
        return layout.running_lines(lines(spark, rows), heights).count()

    assert found(6, 4) == 1 and found(6, 3) == 0 and found(5, 5) == 0 and found(20, 5) == 1 and found(20, 4) == 0


def test_body_size_takes_the_first_of_equals(spark):
    long = "one two three four five six"
    rows = [line(1, 0, 0, 100, 0, long, 12.0), line(1, 1, 0, 100, 20, long, 9.0), line(1, 2, 0, 100, 40, "short", 30.0)]
    assert layout.body_font_size(lines(spark, rows)).first()["body_size"] == 12.0
    assert layout.body_font_size(lines(spark, rows[2:])).first()["body_size"] == 11.0


def test_captions_absorb_wrapped_lines_and_bands_end_at_prose(spark):
    prose = " ".join(["word"] * 13)
    rows = [line(1, 0, 50, 300, 100, "Table 4. Reaction of cultivars to"), line(1, 1, 50, 200, 112, "leaf blast."), line(1, 2, 50, 100, 130, "IR8"), line(1, 3, 200, 240, 130, "S")]
    rows += [line(1, 4, 50, 100, 145, "IR64"), line(1, 5, 200, 240, 145, "R"), line(1, 6, 50, 550, 200, prose), line(1, 7, 50, 550, 215, prose)]
    rows += [line(1, 8, 50, 300, 400, "Table 5. for details see the annex")]
    caps = tables.table_captions(lines(spark, rows)).collect()
    assert [(c["table_id"], c["caption_marker"], c["y_bottom"]) for c in caps] == [("Table 4", "Table 4. Reaction of cultivars to leaf blast.", 122.0)]
    pages = spark.createDataFrame([("d.pdf", 1, 800.0)], "filename string, page int, height double")
    regions = tables.table_regions(lines(spark, rows), pages)
    assert [(r["drop_y_start"], r["drop_y_end"]) for r in regions.collect()] == [(122.0, 200.0)]
    left = layout.lines_outside(lines(spark, rows), regions).collect()
    assert {r["line_no"] for r in left} == {0, 1, 6, 7, 8}
    assert tables.table_regions(lines(spark, rows), pages, skip=("d.pdf",)).count() == 0
    assert tables.region_totals(regions).first()["regions"] == 1


def test_heading_gate(spark):
    good = ["Disease cycle", "1.2 Symptoms", "Control (chemical)", "3. Methods and materials of study"]
    bad = ["ab", "", "   ", "123", "Figure 3 Blast", "Table 2", "lowercase start", "Ends with and", "A sentence.", "1992. Nucleotide sequence", "....", "AAAA", "1. Stunting - short plants", " ".join(["W"] * 15), None, "Ends, with,"]
    frame = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", sections.plausible_heading(F.col("t")).alias("ok")).collect()
    assert [r["t"] for r in frame if r["ok"]] == good


def test_sections_carry_headings(spark):
    raw = [("d", 0, None, "a b c d e f", 6, 1, 1), ("d", 1, "H1", "x", 1, 1, 1), ("d", 2, "H2", "one two three four five", 5, 2, 2), ("d", 3, "H3", "", 0, 3, 3), ("e", 0, "only", "", 0, 1, 1), ("f", 0, None, "w", 1, 1, 1), ("f", 1, "References", "a b c d e", 5, 1, 1)]
    frame = spark.createDataFrame(raw, "filename string, raw_index int, heading string, text string, word_count int, page_start int, page_end int")
    got = {(r["filename"], r["section_index"]): r["heading"] for r in sections.merge_short(frame).collect()}
    assert got == {("d", 0): None, ("d", 1): "H1 / H2 / H3", ("f", 0): "References"}
    kept, cited = sections.without_bibliography(sections.merge_short(frame))
    assert kept.count() == 2 and cited.count() == 1
    stats = sections.section_statistics(kept, cited).first()
    assert stats["n_sections"] == 2 and stats["bibliography_words"] == 5 and stats["headless"] == 1


def test_lines_to_sections_and_slides(spark):
    body = "one two three four five six seven"
    rows = [line(1, 0, 0, 100, 0, "Disease cycle", 14.0), line(1, 1, 0, 100, 20, body), line(1, 2, 0, 100, 40, "Fig. 2 leaf", 9.0), line(2, 0, 0, 100, 0, body), line(2, 1, 0, 100, 20, "2.1 Spread"), line(2, 2, 0, 100, 40, body)]
    ordered = layout.reading_order(lines(spark, rows))
    got = [(r["heading"], r["word_count"], r["page_start"], r["page_end"]) for r in sections.sections(ordered).orderBy("section_index").collect()]
    assert got == [("Disease cycle", 14, 1, 2), ("2.1 Spread", 7, 2, 2)]
    assert sections.figure_captions(ordered, layout.body_font_size(lines(spark, rows))).collect()[0]["text"] == "Fig. 2 leaf"
    deck = spark.createDataFrame([("d.pdf", True)], "filename string, is_deck boolean")
    slides = [(r["heading"], r["page_start"]) for r in sections.sections(ordered, deck).orderBy("section_index").collect()]
    assert slides == [("Disease cycle", 1), (None, 2)]
    documents = spark.createDataFrame([("a", 1, "Microsoft PowerPoint", None, None), ("b", 1, None, None, None)], schemas.DOCUMENTS)
    sizes = spark.createDataFrame([("a", 10.0), ("b", 18.0)], "filename string, body_size double")
    assert sections.slide_decks(documents, sizes).filter("is_deck").count() == 2


def test_audit_of_empty_and_thin_pages(spark):
    pages = spark.createDataFrame([("d.pdf", 1, 600.0, 800.0, "x" * 99, 1), ("d.pdf", 2, 600.0, 800.0, "x" * 100, 2), ("d.pdf", 3, 600.0, 800.0, None, None)], schemas.PAGES)
    audited = layout.page_audit(pages, lines(spark, []), spark.createDataFrame([], schemas.LAYOUT_WORDS))
    row = layout.document_audit(audited).first()
    assert row["thin_pages"] == [1, 3] and row["images"] == 3 and row["sparse_pages"] == 3 and row["route"] == "plain" and row["thin_ratio"] == 0.667
