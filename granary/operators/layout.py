"""Pages and lines: layout, tables by word gaps, reading order, audit of documents.

Lines are rows of ``schemas.LAYOUT_LINES``, words of ``LAYOUT_WORDS``, pages of ``PAGES``. A page is known by
(filename, page) everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.config import LayoutLimits
from granary.functions.text import collapsed, matches, word_count

PAGE = ("filename", "page")
# What a caption and a page number look like.
CAPTION = r"^\s*(fig(?:ure)?|plate|photo|table)\s*\.?\s*\d+"
PAGE_NUMBER = r"^\s*\d{1,4}\s*$"


def lines_of_pages(pages: DataFrame) -> DataFrame:
    """``schemas.LAYOUT_LINES`` of ``NESTED_PAGES``: a line's text is that of its spans, its size the largest of them; lines
    are numbered through their page, and blocks without lines (pictures) are passed over."""
    none = F.array().cast(pages.schema["blocks"].dataType.elementType["lines"].dataType)
    listed = F.flatten(F.transform("blocks", lambda b: F.coalesce(b["lines"], none)))
    rows = pages.select("filename", "page", "page_width", "page_height", F.posexplode(listed).alias("line_no", "line"))
    box = [F.get("line.bbox", F.lit(n)).alias(name) for n, name in enumerate(("x0", "y0", "x1", "y1"))]
    text = F.array_join(F.transform("line.spans", lambda s: s["text"]), "")
    return rows.select("filename", "page", "page_width", "page_height", "line_no", *box, F.array_max(F.transform("line.spans", lambda s: s["size"])).alias("size"), text.alias("text"))


def solid_lines(lines: DataFrame, limits: LayoutLimits = LayoutLimits()) -> DataFrame:
    """Lines that are no stray fragments."""
    return lines.filter(F.col("x1") - F.col("x0") > F.col("page_width") * limits.fragment_width)


def readable_lines(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor a page number, trimmed."""
    text = F.trim(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    return lines.withColumn("text", text).filter((F.col("text") != "") & ~matches(F.col("text"), PAGE_NUMBER))


def page_layout(lines: DataFrame, limits: LayoutLimits = LayoutLimits()) -> DataFrame:
    """(filename, page, layout): sparse, single_column or two_column, of each page that has a line."""
    width, left, right = F.col("page_width"), F.col("x0"), F.col("x1")
    solid = right - left > width * limits.fragment_width
    counted = lines.groupBy(*PAGE).agg(
        F.count_if(solid).alias("n"),
        F.count_if(solid & (right - left > width * limits.full_width)).alias("full"),
        F.count_if(solid & (right < width / 2 + width * limits.gutter)).alias("l"),
        F.count_if(solid & (left > width / 2 - width * limits.gutter)).alias("r"),
    )
    n = F.greatest("n", F.lit(1))
    balance = F.least("l", "r") / F.greatest("l", "r", F.lit(1))
    two = (F.col("full") / n <= limits.full_share) & ((F.col("l") + F.col("r")) / n > limits.one_sided_share) & (balance > limits.side_balance)
    layout = F.when(F.col("n") < limits.sparse_lines, "sparse").when(two, "two_column").otherwise("single_column")
    return counted.select(*PAGE, layout.alias("layout"))


def table_pages(words: DataFrame, limits: LayoutLimits = LayoutLimits()) -> DataFrame:
    """(filename, page, tabular_lines, typical_gap, is_table) from the gaps between the words of each visual line.

    Words belong to one line if their tops, over 3 and rounded half to even, agree."""
    words = words.withColumn("band", F.rint(F.col("y0") / 3))
    line = Window.partitionBy(*PAGE, "band")
    gaps = words.withColumns({"gap": F.lead("x0").over(line.orderBy("x0", "x1", "word")) - F.col("x1"), "n": F.count("*").over(line)})
    gaps = gaps.filter((F.col("n") >= limits.table_words) & F.col("gap").isNotNull())
    wide = gaps.groupBy(*PAGE, "band").agg((F.count_if(F.col("gap") > limits.wide_gap) >= limits.wide_gaps).alias("tabular"))
    lines = wide.groupBy(*PAGE).agg(F.count_if("tabular").alias("tabular_lines"))
    typical = gaps.groupBy(*PAGE).agg(F.percentile("gap", 0.5).alias("typical_gap"))
    found = words.select(*PAGE).distinct().join(lines, [*PAGE], "left").join(typical, [*PAGE], "left").fillna(0, ["tabular_lines"])
    is_table = (F.col("tabular_lines") >= limits.table_lines) & (F.col("typical_gap") < limits.typical_gap)
    return found.withColumn("is_table", F.coalesce(is_table, F.lit(False)))


def reading_order(lines: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """``lines`` with ``place`` (from 1 on each page): by top, then left; on pages whose ``layout`` row (filename,
    two_column) says so the left half comes before the right."""
    if layout is None:
        lines = lines.withColumn("two_column", F.lit(False))
    else:
        lines = lines.join(layout.select("filename", "two_column"), "filename", "left").fillna(False, ["two_column"])
    half = F.when(F.col("two_column") & ((F.col("x0") + F.col("x1")) / 2 >= F.col("page_width") / 2), 1).otherwise(0)
    order = Window.partitionBy(*PAGE).orderBy(half, F.bround("y0", 1), "x0", "line_no")
    return lines.withColumn("place", F.row_number().over(order)).drop("two_column")


def page_audit(pages: DataFrame, lines: DataFrame, words: DataFrame, limits: LayoutLimits = LayoutLimits()) -> DataFrame:
    """One row per page: chars, images, captions, layout, table_candidate, thin."""
    text = F.coalesce("text", F.lit(""))
    caption = F.filter(F.split(text, "\n"), lambda x: x.rlike("(?iU)" + CAPTION) & (F.length(F.trim(x)) > 12))
    base = pages.select(*PAGE, F.length(F.trim(text)).alias("chars"), F.coalesce("image_count", F.lit(0)).alias("images"), F.transform(caption, lambda x: F.trim(x)).alias("captions"))
    base = base.join(page_layout(lines, limits), [*PAGE], "left").join(table_pages(words, limits).select(*PAGE, "is_table"), [*PAGE], "left")
    return base.select(*PAGE, "chars", "images", "captions", F.coalesce("layout", F.lit("sparse")).alias("layout"), F.coalesce("is_table", F.lit(False)).alias("table_candidate"), (F.col("chars") < limits.thin_page_chars).alias("thin"))


def document_audit(audited: DataFrame, limits: LayoutLimits = LayoutLimits()) -> DataFrame:
    """Pages rolled up to documents: sums, page lists, layout counts, ratios, and the way to extract each."""

    def listed(condition: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(condition, F.col("page"))))

    two, single = F.count_if(F.col("layout") == "two_column"), F.count_if(F.col("layout") == "single_column")
    rolled = audited.groupBy("filename").agg(
        F.count("*").alias("page_count"), F.sum("chars").alias("chars"), F.sum("images").alias("images"), F.sum(F.size("captions")).alias("captions"),
        listed(F.col("thin")).alias("thin_pages"), listed(F.col("table_candidate")).alias("table_pages"),
        two.alias("two_column_pages"), single.alias("single_column_pages"), F.count_if(F.col("layout") == "sparse").alias("sparse_pages"),
    )
    pages = F.greatest("page_count", F.lit(1))
    rolled = rolled.withColumns({
        "chars_per_page": F.bround(F.col("chars") / pages, 1),
        "table_ratio": F.bround(F.size("table_pages") / pages, 3),
        "thin_ratio": F.bround(F.size("thin_pages") / pages, 3),
        "layout_dominant": F.when(F.col("two_column_pages") > F.col("single_column_pages"), "two_column").otherwise("single_column"),
    })
    return rolled.withColumn("route", extraction_route(F.col("table_ratio"), F.col("layout_dominant"), limits))


def extraction_route(table_ratio: Column, layout: Column, limits: LayoutLimits = LayoutLimits()) -> Column:
    return F.when(table_ratio >= limits.table_ratio, "table_aware").when(layout == "two_column", "two_column").otherwise("plain")


def running_lines(lines: DataFrame, pages: DataFrame, limits: LayoutLimits = LayoutLimits()) -> DataFrame:
    """(filename, text, n_lines): lines in the top or bottom band that recur on a large share of a document's pages.

    ``pages`` has (filename, page, height); lines are counted, not the pages they are on."""
    counts = pages.groupBy("filename").agg(F.count_distinct("page").alias("n_pages")).filter(F.col("n_pages") >= limits.header_pages)
    placed = lines.select(*PAGE, "y0", F.trim("text").alias("text")).join(pages.select(*PAGE, "height"), [*PAGE])
    outer = (F.col("y0") < F.col("height") * limits.header_band) | (F.col("y0") > F.col("height") * (1 - limits.header_band))
    seen = placed.filter(outer & (F.col("text") != "") & ~F.col("text").rlike(r"(?U)^\d+$")).groupBy("filename", "text").agg(F.count("*").alias("n_lines"))
    often = seen.join(counts, "filename").filter(F.col("n_lines") >= F.greatest(F.lit(limits.header_least), F.col("n_pages") * limits.header_ratio))
    return often.filter(F.length("text") > limits.header_chars).select("filename", "text", "n_lines")


def body_font_size(lines: DataFrame, default: float = 11.0) -> DataFrame:
    """(filename, body_size): the size most common among lines of 6 words or more; of equals the one seen first."""
    long = lines.withColumn("size", F.bround("size", 1)).filter(word_count(F.col("text")) >= 6)
    sizes = long.groupBy("filename", "size").agg(F.count("*").alias("n"), F.min(F.struct("page", "line_no")).alias("first"))
    best = sizes.groupBy("filename").agg(F.max(F.struct("n", (-F.col("first.page")).alias("p"), (-F.col("first.line_no")).alias("l"), "size")).alias("best"))
    return lines.select("filename").distinct().join(best, "filename", "left").select("filename", F.coalesce("best.size", F.lit(default)).alias("body_size"))


def page_text(lines: DataFrame) -> DataFrame:
    """(filename, page, text): the lines of each page in their order, joined by line breaks."""
    parts = F.sort_array(F.collect_list(F.struct("line_no", F.coalesce("text", F.lit("")).alias("t"))))
    return lines.groupBy(*PAGE).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"))


def lines_outside(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """``lines`` that lie in none of their page's table bands."""
    bands = regions.select(F.col("filename").alias("__f"), F.col("page").alias("__p"), "drop_y_start", "drop_y_end")
    held = (F.col("filename") == F.col("__f")) & (F.col("page") == F.col("__p")) & (F.col("drop_y_start") <= F.col("y0")) & (F.col("y1") <= F.col("drop_y_end"))
    return lines.join(bands, held, "left_anti")


def captions(lines: DataFrame) -> DataFrame:
    """Lines that are captions of figures, plates, photos or tables."""
    return lines.filter(matches(F.col("text"), CAPTION) & (F.length(collapsed(F.col("text"))) > 12))
