"""Lines repeated across one source's documents: find them and take them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import WHITE
from granary.storage import stored

#: Frequent lines that may be sent to every executor (16 bytes each); more are joined in so many parts each.
_LINES_TO_SEND = 500_000
_PARTS = 64
_OTHER = WHITE.replace("\\t-\\r ", "\\t\\u000b-\\r")


def line_forms(text: Column) -> Column:
    """The text with every line in the form in which lines are compared, but for blanks at their ends: each run of white
    space within a line as one space, lower case, each run of digits as ``#``. Runs that are one space already, and line
    breaks, are passed over."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, f" *[{_OTHER}][{_OTHER} ]*| {{2,}}", " ")), r"\p{Nd}+", "#")


def _lines(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, doc, source_key, h1, h2, text_key, text_check, line_no) of each line that isn't blank: hashes of the id, the source,
    source and line form, and source and text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("source").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumns({"text_key": F.xxhash64("source", "text"), "text_check": F.xxhash64("text", "source"), "doc": F.xxhash64("id"), "source_key": F.xxhash64("source")})
    lines = rows.select("id", "doc", "source", "source_key", "text_key", "text_check", F.posexplode(F.split(line_forms(F.col("text")), "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("form", F.trim("line")).filter("form <> ''")
    return lines.select("id", "doc", "source_key", F.xxhash64("source", "form").alias("h1"), F.xxhash64(F.lit(1), "form", "source").alias("h2"), "text_key", "text_check", F.col("line_no").cast("bigint").alias("line_no"))


def _frequent(docs: DataFrame, id_col: str, text_col: str, source_col: str, min_docs: int, min_share: float) -> DataFrame:
    """The rows of ``_lines`` whose line is frequent in its source."""
    lines = stored(_lines(docs, id_col, text_col, source_col))  # read twice, normalised once
    # Distinct documents first: this spreads a line that is everywhere over all tasks before it is counted.
    seen = lines.select("source_key", "h1", "h2", "doc").distinct()
    often = seen.groupBy("source_key", "h1", "h2").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    if min_share > 0:
        named = docs.select(F.xxhash64(F.col(f"`{source_col}`")).alias("source_key"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").alias("id"))
        sizes = named.filter("source is not null and id is not null").distinct().groupBy("source_key").agg(F.count("*").alias("of"))
        often = often.join(sizes, "source_key").filter(F.col("docs") >= min_share * F.col("of"))
    often = stored(often.select("h1", "h2"))
    if often.count() <= _LINES_TO_SEND:
        return lines.join(F.broadcast(often), ["h1", "h2"], "left_semi")
    parts = often.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
    return lines.withColumn("part", F.pmod("doc", F.lit(_PARTS)).cast("int")).join(parts, ["h1", "h2", "part"], "left_semi").drop("part")


def frequent_lines(docs: DataFrame, id_col: str = "chunk_id", text_col: str = "text", source_col: str = "source_document", *, min_docs: int = 5, min_share: float = 0.0) -> DataFrame:
    """(id, line_no) of the lines that stand in at least ``min_docs`` different documents of their source, and
    in at least ``min_share`` of that source's documents. Line numbers count from 0, between ``\\n``.

    Documents are told apart by id: an id delivered again counts once, and lines of all its deliveries are
    judged. Rows with a null id, text or source, and blank lines, are never a case. A line that occurs twice
    in one document counts once, and both of its places come out. A source has as many documents as it has ids,
    those without text among them. Other columns are not read.
    """
    return _frequent(docs, id_col, text_col, source_col, min_docs, min_share).select("id", "line_no").distinct()


def without_frequent_lines(docs: DataFrame, id_col: str = "chunk_id", text_col: str = "text", source_col: str = "source_document", *, min_docs: int = 5, min_share: float = 0.0) -> DataFrame:
    """``docs`` with ``clean_text`` and ``lines_removed`` added: each text without its frequent lines.

    Rows and other columns stay as they are (a column named ``clean_text`` or ``lines_removed`` is replaced). An id that
    came with several texts has each cleaned of its own lines. Null texts stay null with 0 lines removed, texts without
    source or id stay as they are; a text of nothing but frequent lines becomes empty.
    """
    # Which lines go depends on source and text alone.
    found = _frequent(docs, id_col, text_col, source_col, min_docs, min_share).select(F.col("text_key").alias("__key"), F.col("text_check").alias("__check"), "line_no").distinct()
    dropped = found.groupBy("__key", "__check").agg(F.collect_set("line_no").alias("__drop"))
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    kept = docs.drop("clean_text", "lines_removed", "__key", "__check", "__drop")
    same = (F.xxhash64(source, text) == F.col("__key")) & (F.xxhash64(text, source) == F.col("__check"))
    kept = kept.join(dropped, same & text.isNotNull() & source.isNotNull() & F.col(f"`{id_col}`").isNotNull(), "left")
    stays = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("__drop", i.cast("bigint")))
    cut = F.col("__drop").isNotNull()
    kept = kept.withColumn("clean_text", F.when(cut, F.array_join(stays, "\n")).otherwise(text))
    return kept.withColumn("lines_removed", F.when(cut, F.size("__drop")).otherwise(0)).drop("__key", "__check", "__drop")
