"""Tables on pages: captions with their continuation, the band that each table takes, confirmation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from granary.functions.text import word_count
from granary.operators.layout import PAGE

# What the caption of a table looks like, and a sentence that only refers to one.
TABLE_CAPTION = r"^\s*([A-Z][A-Za-z]{0,5}\s+)?Table\s+(\d+(?:-\d+)?)\s*[.．]\s+(\S.{6,})"
CROSS_REFERENCE = r"(?iU)^(for|in|and|or|of|to|shows?|lists?)\b"

_FOLLOWING, _SIBLING, _SHIFT = 3, 2.0, 0.02
_PROSE_WIDTH, _PROSE_WORDS, _LEAST_HEIGHT, _LEAST_LINES, _SHORT_SHARE = 0.55, 12, 8.0, 3, 0.6


def _sorted_lines(lines: DataFrame) -> DataFrame:
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "x1", "y1", "line_no")
    return lines.withColumn("text", text).filter("text <> ''").withColumn("place", F.row_number().over(order))


def table_captions(lines: DataFrame) -> DataFrame:
    """(filename, page, place, table_id, caption_marker, y_top, y_bottom) of every caption, with up to three wrapped lines.

    A following line continues a caption if it stands alone at its height, is aligned with it, is no
    caption itself, and the text so far doesn't end in a period or colon.
    """
    ordered = _sorted_lines(lines)
    is_caption = F.col("text").rlike("(?U)" + TABLE_CAPTION)
    near = F.expr(f"count(*) over (partition by filename, page order by y0 range between {_SIBLING}D preceding and {_SIBLING}D following)")
    marked = ordered.withColumns({"caption": is_caption, "alone": near <= 1})
    after = Window.partitionBy(*PAGE).orderBy("place").rowsBetween(1, _FOLLOWING)
    marked = marked.withColumn("next", F.collect_list(F.struct("text", "x0", "y1", "caption", "alone")).over(after))
    found = marked.filter(is_caption & ~F.regexp_extract("text", "(?U)" + TABLE_CAPTION, 3).rlike(CROSS_REFERENCE))
    zero = F.struct(F.col("text").alias("text"), F.col("y1").alias("bottom"), F.lit(True).alias("open"))

    def absorb(state: Column, line: Column) -> Column:
        ended = F.rtrim(state["text"]).rlike("[.:]$") | line["caption"] | ~line["alone"] | (F.abs(line["x0"] - F.col("x0")) > F.col("page_width") * _SHIFT)
        going = state["open"] & ~ended
        return F.struct(
            F.when(going, F.concat_ws(" ", state["text"], line["text"])).otherwise(state["text"]).alias("text"),
            F.when(going, line["y1"]).otherwise(state["bottom"]).alias("bottom"), going.alias("open"),
        )

    whole = F.aggregate("next", zero, absorb)
    name = F.trim(F.concat(F.regexp_extract("text", "(?U)" + TABLE_CAPTION, 1), F.lit(" Table "), F.regexp_extract("text", "(?U)" + TABLE_CAPTION, 2)))
    name = F.regexp_replace(name, r"\s+", " ")
    found = found.withColumn("whole", whole)
    return found.select(*PAGE, "place", name.alias("table_id"), F.col("whole.text").alias("caption_marker"), F.bround("y0", 1).alias("y_top"), F.bround("whole.bottom", 1).alias("y_bottom"))


def table_regions(lines: DataFrame, pages: DataFrame, *, skip: tuple[str, ...] = ()) -> DataFrame:
    """``schemas.TABLE_REGIONS``: below each caption the band to the first of two prose lines in a row, or the page's end.

    Bands lower than 8 or that don't look tabular (three lines or more, 60 % of them short) are left out.
    ``pages`` has (filename, page, height); documents in ``skip`` aren't scanned.
    """
    if skip:
        lines = lines.filter(~F.col("filename").isin(*skip))
    ordered = _sorted_lines(lines).withColumn("prose", (F.col("x1") - F.col("x0") > F.col("page_width") * _PROSE_WIDTH) & (word_count(F.col("text")) > _PROSE_WORDS))
    caps = table_captions(lines).select(*PAGE, "table_id", "caption_marker", "y_bottom", F.col("place").alias("cap"))
    below = caps.join(ordered.select(*PAGE, "place", "y0", "prose"), [*PAGE]).filter(F.col("y0") > F.col("y_bottom") + 1)
    step = Window.partitionBy(*PAGE, "cap").orderBy("place")
    turned = below.withColumns({"second": F.lead("prose").over(step), "before": F.lag("prose").over(step)})
    first_prose = F.min(F.when(F.col("prose") & F.coalesce("second", F.lit(False)) & ~F.coalesce("before", F.lit(False)), F.struct("place", "y0")))
    ends = turned.groupBy(*PAGE, "cap").agg(first_prose.alias("stop"))
    banded = caps.join(ends, [*PAGE, "cap"], "left").join(pages.select(*PAGE, "height"), [*PAGE]).withColumn("y_end", F.coalesce("stop.y0", "height"))
    banded = banded.filter(F.col("y_end") - F.col("y_bottom") >= _LEAST_HEIGHT)
    inside = banded.join(ordered.select(*PAGE, "y0", "prose"), [*PAGE]).filter((F.col("y0") > F.col("y_bottom")) & (F.col("y0") < F.col("y_end")))
    tabular = inside.groupBy(*PAGE, "cap").agg(F.count("*").alias("n"), F.avg(F.when(F.col("prose"), 0.0).otherwise(1.0)).alias("short"))
    tabular = tabular.filter((F.col("n") >= _LEAST_LINES) & (F.col("short") >= _SHORT_SHARE)).select(*PAGE, "cap")
    kept = banded.join(tabular, [*PAGE, "cap"])
    return kept.select("filename", F.col("page").cast(T.IntegerType()).alias("page"), "table_id", "caption_marker", F.col("y_bottom").alias("drop_y_start"), F.bround("y_end", 1).alias("drop_y_end"))


def region_totals(regions: DataFrame) -> DataFrame:
    """(filename, regions, pages) for each document with a region."""
    return regions.groupBy("filename").agg(F.count("*").alias("regions"), F.count_distinct("page").alias("pages"))
