"""From ordered lines to sections: headings, slides, empty sections, bibliographies, captions of figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.text import SPACES, collapsed, matches, word_count
from granary.operators.layout import body_font_size
from granary.storage import stored

# Shapes of headings and of lines that are none.
NUMBERED = r"^\d+(\.\d+){0,3}\.?\s+[A-Z(]"
FIGURE = r"^\s*([A-Z][A-Za-z]{0,5}\s+)?(Fig(ure)?|Photo|Plate)\s*\.?\s*\d+"
REFERENCE = r"^[A-Z][a-z]+,?\s+[A-Z]\.\s*[A-Z]?\.?\s*\d{4}[.,]|^\d+:\d+[-‒–]\d+"
YEAR_FIRST = r"^(1[89]|20)\d{2}\s*[.,]"
NO_HEADING = r"^(Table|Source|Note|continued)\b"
OPEN_END = r"[,;]$|\b(and|or|of|the|in|with|for|to)$"
BIBLIOGRAPHY = r"^\s*(references|bibliography|literature cited|further reading|acknowledge)"

_WORDS, _CHARS, _LARGER, _SLIDE_SIZE, _LEAST_WORDS = 14, 3, 0.9, 18.0, 5


def plausible_heading(text: Column) -> Column:
    """Whether a line may be a heading: short, with letters, no number, figure, citation, note or part of a sentence."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    numbered = matches(t, NUMBERED, any_case=False)
    kinds = F.size(F.array_distinct(F.split(F.replace(F.lower(t), F.lit(" "), F.lit("")), "")))
    bad = (
        (F.length(t) < _CHARS)
        | (word_count(t) > _WORDS)
        | ~matches(t, r"\p{L}", any_case=False)
        | matches(t, r"^\s*\d{1,4}\s*$")
        | matches(t, FIGURE)
        | matches(t, REFERENCE, any_case=False)
        | matches(t, YEAR_FIRST, any_case=False)
        | matches(t, NO_HEADING)
        | (kinds < 3)
        | (matches(t, r"^\p{Ll}", any_case=False) & ~numbered)
        | matches(t, OPEN_END)
        | (t.endswith(".") & ~numbered)
        | (numbered & matches(t, r"\s[–—-]\s", any_case=False))
    )
    return F.coalesce(~bad, F.lit(False))


def slide_decks(documents: DataFrame, sizes: DataFrame) -> DataFrame:
    """(filename, is_deck): made by a slide program, or with an implausibly large body size."""
    deck = F.lower(F.coalesce("producer", F.lit(""))).contains("powerpoint") | (F.coalesce("body_size", F.lit(0.0)) >= _SLIDE_SIZE)
    return documents.join(sizes, "filename", "left").select("filename", deck.alias("is_deck"))


def figure_captions(ordered: DataFrame, sizes: DataFrame) -> DataFrame:
    """``schemas.FIGURE_CAPTIONS`` among lines of body size or smaller."""
    found = ordered.join(sizes, "filename").filter(matches(F.col("text"), FIGURE) & (F.col("size") <= F.col("body_size")))
    index = Window.partitionBy("filename").orderBy("page", "place")
    return found.select("filename", (F.row_number().over(index) - 1).alias("caption_index"), "page", "text")


def sections(ordered: DataFrame, decks: DataFrame | None = None) -> DataFrame:
    """``schemas.SECTIONS`` of documents whose lines are in reading order (``place`` on each page).

    A heading opens a section, lines after it are its body, and lines before any heading form a section
    without one. In slide decks each page is a section, headed by its first line if that may be a heading.
    Sections without heading and with fewer than five words vanish; headings of short sections pass to the
    next long one, or to the last; documents without a long section vanish.
    """
    # Read for sizes and for lines; what patterns tell of a line is told once, where the lines lie in many partitions.
    told = {"gate": plausible_heading(F.col("text")), "numbered": matches(F.col("text"), NUMBERED, any_case=False), "figure": matches(F.col("text"), FIGURE)}
    ordered = stored(ordered.select("filename", "page", "place", "line_no", "size", "text").withColumns(told))
    sizes = body_font_size(ordered)
    lines = ordered.join(sizes, "filename")
    lines = lines.withColumn("is_deck", F.lit(False)) if decks is None else lines.join(decks, "filename", "left").fillna(False, ["is_deck"])
    heading = F.col("gate") & (F.col("numbered") | (F.col("size") >= F.col("body_size") + _LARGER))
    figure = ~F.col("is_deck") & F.col("figure") & (F.col("size") <= F.col("body_size"))
    lines = lines.filter(~figure)
    first = F.row_number().over(Window.partitionBy("filename", "page").orderBy("place")) == 1
    lines = lines.withColumn("first", first)
    lines = lines.withColumns({
        "opens": F.when(F.col("is_deck"), F.col("first")).otherwise(heading),
        "heads": F.when(F.col("is_deck"), F.col("first") & F.col("gate")).otherwise(heading),
    })
    flow = Window.partitionBy("filename").orderBy("page", "place")
    numbered = lines.withColumn("raw_index", F.sum(F.col("opens").cast("int")).over(flow))
    parts = F.sort_array(F.collect_list(F.when(~F.col("heads"), F.struct("page", "place", "text"))))
    raw = numbered.groupBy("filename", "raw_index").agg(
        F.max(F.when(F.col("heads"), F.col("text"))).alias("heading"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("body"),
        F.min("page").alias("page_start"), F.max("page").alias("page_end"),
    )
    flat = F.col("flat")
    body = F.when(F.contains(flat, F.lit("­")), F.regexp_replace(flat, f"(?U)(\\w)­{SPACES[:-1]}*(\\w)", "$1$2")).otherwise(flat)
    raw = stored(raw.withColumn("flat", collapsed(F.col("body"))).withColumn("text", body).drop("body", "flat"))  # the long texts are formed once
    return merge_short(raw.withColumn("word_count", word_count(F.col("text"))))


def merge_short(raw: DataFrame) -> DataFrame:
    """The carry of headings over short sections. ``raw``: filename, raw_index, heading, text, word_count, pages."""
    raw = raw.filter((F.col("word_count") >= _LEAST_WORDS) | F.col("heading").isNotNull())
    kept = F.col("word_count") >= _LEAST_WORDS
    flow = Window.partitionBy("filename").orderBy("raw_index")
    marked = raw.withColumns({
        "before": F.coalesce(F.sum(kept.cast("int")).over(flow.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "total": F.sum(kept.cast("int")).over(Window.partitionBy("filename")),
    })
    trailing = ~kept & (F.col("before") == F.col("total"))
    marked = marked.withColumns({"section_index": F.when(trailing, F.col("total") - 1).otherwise(F.col("before")), "kept": kept, "trailing": trailing}).filter(F.col("total") > 0)
    told = F.struct("raw_index", "heading")
    listed = marked.groupBy("filename", "section_index").agg(
        F.sort_array(F.collect_list(F.when(~F.col("trailing") & F.col("heading").isNotNull(), told))).alias("own"),
        F.sort_array(F.collect_list(F.when(F.col("trailing"), told))).alias("late"),
        *(F.max(F.when(F.col("kept"), F.col(c))).alias(c) for c in ("text", "word_count", "page_start", "page_end")),
    )
    own = F.array_join(F.transform("own", lambda h: h["heading"]), " / ")
    late = F.concat(F.lit(" / "), F.array_join(F.transform("late", lambda h: h["heading"]), " / "))
    whole = F.when(F.size("late") > 0, F.concat(own, late)).when(F.size("own") > 0, own)
    return listed.select("filename", F.col("section_index").cast("int").alias("section_index"), whole.alias("heading"), "text", "word_count", "page_start", "page_end")


def is_bibliography(heading: Column) -> Column:
    return matches(heading, BIBLIOGRAPHY)


def without_bibliography(all_sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(narrative, bibliography), which together are the input."""
    return all_sections.filter(~is_bibliography(F.col("heading"))), all_sections.filter(is_bibliography(F.col("heading")))


def section_statistics(narrative: DataFrame, bibliography: DataFrame) -> DataFrame:
    """One row: sections, words, median (interpolated), mean and largest section, headless ones, share of bibliography."""
    stats = narrative.agg(
        F.count("*").alias("n_sections"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"), F.percentile("word_count", 0.5).alias("median_words"),
        F.avg("word_count").alias("mean_words"), F.max("word_count").alias("most_words"), F.count_if(F.col("heading").isNull()).alias("headless"),
    )
    cited = bibliography.agg(F.coalesce(F.sum("word_count"), F.lit(0)).alias("bibliography_words"))
    both = stats.withColumn("bibliography_words", cited.scalar())
    return both.withColumn("bibliography_share", F.try_divide("bibliography_words", F.col("words") + F.col("bibliography_words")))
