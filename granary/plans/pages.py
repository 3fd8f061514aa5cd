"""Queries of layout, tables and sections, over pages made of the documents: each document is a page of a file of its source,
each of its lines a positioned line, each word a positioned word. SQL makes the same pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import words
from granary.operators import layout, sections, tables
from granary.plans.common import WHITE_SQL, collapsed_sql, spread, table, words_sql


def file_name() -> Column:
    """Files of bounded size: the documents of a source among four hundred neighbouring ones."""
    return F.expr("concat(coalesce(source, 'none'), ' ', cast(doc_id div 400 as string))").alias("filename")


def made_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "documents")).select(file_name(), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    n = F.length("text")
    rows = rows.withColumns({"page_width": F.lit(600.0), "x0": (40 + n * 7 % 30 + F.when(n % 5 == 0, 260).otherwise(0)).cast("double"), "y0": (20.0 + 30.0 * F.col("line_no")), "size": F.when(n % 4 == 0, 12.0).otherwise(10.0)})
    return rows.withColumns({"x1": F.col("x0") + F.least(n * 3, F.lit(250)) + F.when(n > 300, 150).otherwise(0), "y1": F.col("y0") + 12})


_LINES = """
    lines as (
        select filename, page, line_no, text, 600.0::double as page_width, cast(40 + length(text) * 7 % 30 + case when length(text) % 5 = 0 then 260 else 0 end as double) as x0,
            20.0::double + 30.0::double * line_no as y0, case when length(text) % 4 = 0 then 12.0::double else 10.0::double end as size
        from (select coalesce(source, 'none') || ' ' || (doc_id // 400) as filename, doc_id as page, unnest(range(len(string_split(text, chr(10))))) as line_no, unnest(string_split(text, chr(10))) as text from documents)),
    placed as (select *, x0 + least(length(text) * 3, 250) + case when length(text) > 300 then 150 else 0 end as x1, y0 + 12 as y1 from lines)"""


def made_words(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "documents")).select(file_name(), F.col("doc_id").alias("page"), F.posexplode(words(F.col("text"))).alias("word_no", "word"))
    n, at = F.length("word"), F.col("word_no")
    x0 = 40.0 + 60.0 * (at % 8)
    return rows.withColumns({"x0": x0, "x1": x0 + F.least(n * 6, F.lit(58)), "y0": 20.0 + 12.0 * F.floor(at / 8)})


_WORDS = f"""
    w as (select coalesce(source, 'none') || ' ' || (doc_id // 400) as filename, doc_id as page, list_filter(regexp_split_to_array(text, '{WHITE_SQL}'), lambda x: x <> '') as ws from documents where text is not null),
    words as (select filename, page, unnest(range(len(ws))) as k, unnest(ws) as word from w),
    put as (select *, 40.0::double + 60.0::double * (k % 8) as x0, 40.0::double + 60.0::double * (k % 8) + least(length(word) * 6, 58) as x1, 20.0::double + 12.0::double * (k // 8) as y0 from words)"""


def page_layout(spark: SparkSession, folder: str) -> DataFrame:
    from granary.config import LayoutLimits

    return layout.page_layout(made_lines(spark, folder), LayoutLimits(sparse_lines=2))


def table_pages(spark: SparkSession, folder: str) -> DataFrame:
    return layout.table_pages(made_words(spark, folder)).select("filename", "page", "tabular_lines", F.round("typical_gap", 6).alias("typical_gap"), "is_table")


def reading_order(spark: SparkSession, folder: str) -> DataFrame:
    lines = made_lines(spark, folder)
    decided = lines.select("filename").distinct().withColumn("two_column", F.length("filename") % 2 == 0)
    return layout.reading_order(lines, decided).select("filename", "page", "line_no", "place")


def body_font_size(spark: SparkSession, folder: str) -> DataFrame:
    return layout.body_font_size(made_lines(spark, folder))


def running_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = made_lines(spark, folder)
    pages = lines.select("filename", "page").distinct().withColumn("height", F.lit(1000.0))
    from granary.config import LayoutLimits

    return layout.running_lines(lines, pages, LayoutLimits(header_ratio=0.0, header_least=2))


def document_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents"))
    pages = docs.select(file_name(), F.col("doc_id").alias("page"), "text", (F.col("doc_id") % 3).cast("int").alias("image_count"))
    audited = layout.page_audit(pages, made_lines(spark, folder), made_words(spark, folder))
    rolled = layout.document_audit(audited)
    return rolled.select("filename", "page_count", "chars", "images", F.size("thin_pages").alias("thin"), F.size("table_pages").alias("tabular"), "sparse_pages", "chars_per_page", "table_ratio", "layout_dominant", "route")


def made_table_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pages with a table: every third has a caption of six words, then come short lines of five words and, from
    the tenth on, prose of twenty."""
    rows = spread(table(spark, folder, "documents")).filter("text is not null").select(file_name(), F.col("doc_id").alias("page"), words(F.col("text")).alias("w"))
    caption = F.concat(F.lit("Table "), (F.col("page") % 40 + 1).cast("string"), F.lit(". "), F.array_join(F.slice("w", 1, 6), " "))
    first = F.when(F.col("page") % 3 == 0, caption).otherwise(F.array_join(F.slice("w", 1, 6), " "))
    short = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.array_join(F.slice("w", k * 5 + 7, 5), " "))
    long = F.transform(F.sequence(F.lit(0), F.greatest(F.expr("(size(w) - 52) div 20"), F.lit(0))), lambda k: F.array_join(F.slice("w", k * 20 + 52, 20), " "))
    rows = rows.select("filename", "page", F.posexplode(F.concat(F.array(first), short, long)).alias("line_no", "text")).filter("text <> ''")
    return rows.withColumns({"page_width": F.lit(600.0), "x0": F.lit(40.0), "x1": F.when(F.col("line_no") < 10, 240.0).otherwise(560.0), "y0": 20.0 + 14.0 * F.col("line_no"), "y1": 30.0 + 14.0 * F.col("line_no"), "size": F.lit(10.0)})


_TABLE_LINES = f"""
    tw as (select coalesce(source, 'none') || ' ' || (doc_id // 400) as filename, doc_id as page, list_filter(regexp_split_to_array(text, '{WHITE_SQL}'), lambda x: x <> '') as w from documents where text is not null),
    tl as (select filename, page, list_concat([case when page % 3 = 0 then 'Table ' || (page % 40 + 1) || '. ' else '' end || array_to_string(list_slice(w, 1, 6), ' ')],
        list_concat(list_transform(range(0, 9), lambda k: array_to_string(list_slice(w, k * 5 + 7, k * 5 + 11), ' ')), list_transform(range(0, greatest((len(w) - 52) // 20, 0) + 1), lambda k: array_to_string(list_slice(w, k * 20 + 52, k * 20 + 71), ' ')))) as l from tw),
    tlines as (select filename, page, i - 1 as line_no, l[i] as text, 40.0::double as x0, case when i <= 10 then 240.0::double else 560.0::double end as x1, 20.0::double + 14.0::double * (i - 1) as y0, 30.0::double + 14.0::double * (i - 1) as y1
        from (select filename, page, l, unnest(range(1, len(l) + 1)) as i from tl) where l[i] <> '')"""


def table_regions(spark: SparkSession, folder: str) -> DataFrame:
    lines = made_table_lines(spark, folder)
    pages = lines.select("filename", "page").distinct().withColumn("height", F.lit(1000.0))
    return tables.table_regions(lines, pages)


def table_captions(spark: SparkSession, folder: str) -> DataFrame:
    return tables.table_captions(made_table_lines(spark, folder)).drop("place")


def caption_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that are captions of figures, plates, photos or tables."""
    return layout.captions(made_table_lines(spark, folder)).select("filename", "page", "line_no", "text")


def region_totals(spark: SparkSession, folder: str) -> DataFrame:
    return tables.region_totals(table_regions(spark, folder))


def slide_decks(spark: SparkSession, folder: str) -> DataFrame:
    """Sources as documents, every third made by a slide program, with their body sizes doubled where the name is even."""
    sizes = layout.body_font_size(made_lines(spark, folder)).withColumn("body_size", F.col("body_size") * F.when(F.length("filename") % 2 == 0, 2).otherwise(1))
    docs = sizes.select("filename", F.when(F.length("filename") % 3 == 0, "Microsoft PowerPoint").otherwise("writer").alias("producer"))
    return sections.slide_decks(docs, sizes)


def nested_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as nested pages: a block for each line of text, its words as spans; flattened."""
    rows = spread(table(spark, folder, "documents")).filter("text is not null")

    def spans(x: Column) -> Column:
        return F.transform(words(x), lambda w: F.struct(F.concat(w, F.lit(" ")).alias("text"), (F.length(w) % 5 + 8).cast("double").alias("size")))

    def block(x: Column, k: Column) -> Column:
        return F.struct(F.array(F.struct(F.array(F.lit(40.0), k * 12.0, F.lit(500.0), k * 12.0 + 10).alias("bbox"), spans(x).alias("spans"))).alias("lines"))

    pages = rows.select(file_name(), F.col("doc_id").alias("page"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"), F.transform(F.split("text", "\n", -1), block).alias("blocks"))
    return layout.lines_of_pages(pages).select("filename", "page", "line_no", "y0", "y1", "size", "text")


def page_text(spark: SparkSession, folder: str) -> DataFrame:
    return layout.page_text(made_lines(spark, folder))


def lines_outside(spark: SparkSession, folder: str) -> DataFrame:
    """Lines left when the band from 45 to 105 of every even page is a table."""
    lines = made_lines(spark, folder)
    regions = lines.filter("page % 2 = 0").select("filename", "page").distinct().withColumns({"drop_y_start": F.lit(45.0), "drop_y_end": F.lit(105.0)})
    return layout.lines_outside(lines, regions).select("filename", "page", "line_no")


def document_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of every source; each document a page."""
    return sections.sections(layout.reading_order(layout.readable_lines(made_lines(spark, folder))))


def short_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The carry of headings over short sections, on lines of chunks as sections."""
    rows = table(spark, folder, "chunks").filter("chunk_index is not null").dropDuplicates(["chunk_id"])
    from granary.functions.text import word_count

    raw = rows.select(F.col("source_document").alias("filename"), F.row_number().over(_by_chunk()).alias("raw_index"), F.col("section").alias("heading"), "text", F.when(F.length("text") % 3 == 0, 3).otherwise(word_count(F.col("text"))).alias("word_count"), "page_start", "page_end")
    return sections.merge_short(raw).select("filename", "section_index", "heading", "word_count", "page_start")


def _by_chunk():  # noqa: ANN202
    from pyspark.sql.window import Window

    return Window.partitionBy("source_document").orderBy("chunk_id")


def bibliography_share(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of chunks as sections, with what stands under a heading of references apart."""
    rows = table(spark, folder, "chunks").select("chunk_id", F.col("section").alias("heading"), F.coalesce("word_count", F.lit(0)).alias("word_count")).distinct()
    stats = sections.section_statistics(*sections.without_bibliography(rows))
    return stats.withColumns({"mean_words": F.round("mean_words", 6), "bibliography_share": F.round("bibliography_share", 6)})


QUERIES = {
    f.__name__: f
    for f in (page_layout, table_pages, reading_order, body_font_size, running_lines, document_audit, table_regions, table_captions, caption_lines, region_totals, slide_decks, nested_lines, page_text, lines_outside, document_sections, short_sections, bibliography_share)
}

_LAYOUT = """
    counted as (select filename, page, count(*) filter (where solid) as n, count(*) filter (where solid and x1 - x0 > 330) as full_lines,
        count(*) filter (where solid and x1 < 318) as l, count(*) filter (where solid and x0 > 282) as r from (select *, x1 - x0 > 30 as solid from placed) group by all),
    layouts as (select filename, page, case when n < {0} then 'sparse' when full_lines / n <= 0.25 and (l + r) / n > 0.85 and least(l, r) / greatest(l, r, 1) > 0.3 then 'two_column' else 'single_column' end as layout from counted)"""
_TABLES = """
    gapped as (select *, lead(x0) over line - x1 as gap, count(*) over (partition by filename, page, round_even(y0 / 3, 0)) as n, round_even(y0 / 3, 0) as band from put
        window line as (partition by filename, page, round_even(y0 / 3, 0) order by x0, x1, word)),
    used as (select * from gapped where n >= 3 and gap is not null),
    wide as (select filename, page, band, count(*) filter (where gap > 20) >= 2 as tabular from used group by all),
    per as (select filename, page, count(*) filter (where tabular) as tabular_lines from wide group by all),
    mid as (select filename, page, quantile_cont(gap, 0.5) as typical_gap from used group by all),
    tabled as (select filename, page, coalesce(tabular_lines, 0) as tabular_lines, typical_gap, coalesce(coalesce(tabular_lines, 0) >= 3 and typical_gap < 12, false) as is_table
        from (select distinct filename, page from put) left join per using (filename, page) left join mid using (filename, page))"""

# Three wrapped lines may follow a caption, each if the text so far goes on.
_REGIONS = r"""
    tn as (select *, row_number() over l as place, trim(text) as t, regexp_matches(text, '^\s*([A-Z][A-Za-z]{0,5}\s+)?Table\s+(\d+(?:-\d+)?)\s*[.．]\s+(\S.{6,})') as cap,
        x1 - x0 > 330 and len(string_split(text, ' ')) > 12 as prose from tlines window l as (partition by filename, page order by y0, x0, x1, y1, line_no)),
    tm as (select *, lead(t, 1) over l as t1, lead(t, 2) over l as t2, lead(t, 3) over l as t3, lead(y1, 1) over l as b1, lead(y1, 2) over l as b2, lead(y1, 3) over l as b3,
        lead(cap, 1) over l as c1, lead(cap, 2) over l as c2, lead(cap, 3) over l as c3 from tn window l as (partition by filename, page order by place)),
    tc as (select *, t1 is not null and not c1 and not regexp_matches(rtrim(t), '[.:]$') as g1 from tm
        where cap and not regexp_matches(regexp_extract(text, '^\s*([A-Z][A-Za-z]{0,5}\s+)?Table\s+(\d+(?:-\d+)?)\s*[.．]\s+(\S.{6,})', 3), '(?i)^(for|in|and|or|of|to|shows?|lists?)\b')),
    td as (select *, g1 and t2 is not null and not c2 and not regexp_matches(rtrim(t1), '[.:]$') as g2 from tc),
    te as (select *, g2 and t3 is not null and not c3 and not regexp_matches(rtrim(t2), '[.:]$') as g3 from td),
    caps as (select filename, page, place, 'Table ' || regexp_extract(text, 'Table\s+(\d+(?:-\d+)?)', 1) as table_id, t || case when g1 then ' ' || t1 else '' end || case when g2 then ' ' || t2 else '' end || case when g3 then ' ' || t3 else '' end as caption_marker,
        y0 as y_top, case when g3 then b3 when g2 then b2 when g1 then b1 else y1 end as y_bottom from te),
    below as (select c.filename, c.page, c.place as cap, l.place, l.y0, l.prose, lead(l.prose) over w as second, lag(l.prose) over w as before from caps c join tn l on c.filename = l.filename and c.page = l.page and l.y0 > c.y_bottom + 1
        window w as (partition by c.filename, c.page, c.place order by l.place)),
    stops as (select filename, page, cap, min(y0) as y from below where prose and coalesce(second, false) and not coalesce(before, false) group by all),
    bands as (select c.*, coalesce(s.y, 1000.0::double) as y_end from caps c left join stops s on c.filename = s.filename and c.page = s.page and c.place = s.cap),
    inside as (select b.filename, b.page, b.place, count(*) as n, avg(case when l.prose then 0.0::double else 1.0::double end) as short from bands b join tn l on b.filename = l.filename and b.page = l.page and l.y0 > b.y_bottom and l.y0 < b.y_end group by all),
    regions as (select filename, cast(page as integer) as page, table_id, caption_marker, y_bottom as drop_y_start, y_end as drop_y_end from bands join inside using (filename, page, place) where n >= 3 and short >= 0.6 and y_end - y_bottom >= 8)"""



def _like(x: str, pattern: str, *, any_case: bool = True) -> str:
    """A pattern whose classes are Unicode's."""
    told = pattern.replace("\\s", WHITE_SQL[:-1]).replace("\\d", "\\p{Nd}").replace("'", "''")
    return f"coalesce(regexp_matches({x}, '{'(?i)' if any_case else ''}{told}'), false)"


_GATE = f"""not (length(t) < 3 or {words_sql('t')} > 14 or not {_like('t', r'\p{L}')} or {_like('t', r'^\d{1,4}$')} or {_like('t', sections.FIGURE)} or {_like('t', sections.REFERENCE, any_case=False)}
    or {_like('t', sections.YEAR_FIRST, any_case=False)} or {_like('t', sections.NO_HEADING)} or len(list_distinct(string_split(replace(lower(t), ' ', ''), ''))) < 3 or ({_like('t', r'^\p{Ll}', any_case=False)} and not numbered)
    or {_like('t', sections.OPEN_END)} or (t[-1] = '.' and not numbered) or (numbered and {_like('t', r'\s[–—-]\s', any_case=False)}))"""
_MERGED = """
    f as (select * from raw where wc >= 5 or heading is not null),
    m as (select *, wc >= 5 as kept, coalesce(sum(case when wc >= 5 then 1 else 0 end) over (partition by filename order by i rows between unbounded preceding and 1 preceding), 0) as before,
        sum(case when wc >= 5 then 1 else 0 end) over (partition by filename) as total from f),
    g as (select *, not kept and before = total as late_one, case when not kept and before = total then total - 1 else before end as k from m where total > 0),
    a as (select filename, k, string_agg(heading, ' / ' order by i) filter (where not late_one) as own, string_agg(heading, ' / ' order by i) filter (where late_one) as late,
        max(wc) filter (where kept) as word_count, max(page_start) filter (where kept) as page_start, max(page_end) filter (where kept) as page_end, max(text) filter (where kept) as text from g group by all)"""

SQL = {
    "nested_lines": f"""
        with l as (select coalesce(source, 'none') || ' ' || (doc_id // 400) as filename, doc_id as page, string_split(text, chr(10)) as l from documents where text is not null), k as (select filename, page, l, unnest(range(1, len(l) + 1)) as i from l),
        w as (select filename, page, i, list_filter(regexp_split_to_array(l[i], '{WHITE_SQL}'), lambda x: x <> '') as w from k)
        select filename, page, cast(i - 1 as integer) as line_no, 12.0::double * (i - 1) as y0, 12.0::double * (i - 1) + 10 as y1, list_max(list_transform(w, lambda x: length(x) % 5 + 8))::double as size,
            array_to_string(list_transform(w, lambda x: x || ' '), '') as text from w""",
    "document_sections": f"""
        with {_LINES}, ends as (select *, regexp_replace(text, '^{WHITE_SQL}|{WHITE_SQL}$', '', 'g') as t from placed),
        r as (select filename, page, line_no, size, t, row_number() over (partition by filename, page order by round_even(y0, 1), x0, line_no) as place from ends where t <> '' and not {_like('t', r'^\d{1,4}$')}),
        sz as (select filename, size, count(*) as n, min((page, line_no)) as first from r where {words_sql('t')} >= 6 group by all),
        bs as (select filename, size as body_size from (select *, row_number() over (partition by filename order by n desc, first) as k from sz) where k = 1),
        n as (select r.*, coalesce(body_size, 11.0) as body_size, {_like('t', sections.NUMBERED, any_case=False)} as numbered from r left join bs using (filename)),
        h as (select *, {_GATE} and (numbered or size >= body_size + 0.9) as heads from n where not ({_like('t', sections.FIGURE)} and size <= body_size)),
        w as (select *, sum(heads::int) over (partition by filename order by page, place) as i from h),
        b as (select filename, i, max(t) filter (where heads) as heading, coalesce(string_agg(t, ' ' order by page, place) filter (where not heads), '') as body, min(page) as page_start, max(page) as page_end from w group by all),
        c as (select *, regexp_replace({collapsed_sql('body')}, '([\\p{{L}}\\p{{N}}_])\\x{{ad}} *([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g') as text from b),
        raw as (select *, {words_sql('text')} as wc from c), {_MERGED}
        select filename, cast(k as integer) as section_index, case when late is not null then coalesce(own, '') || ' / ' || late else own end as heading, text, cast(word_count as integer) as word_count, page_start, page_end from a""",
    "table_regions": f"with {_TABLE_LINES}, {_REGIONS} select * from regions",
    "table_captions": f"with {_TABLE_LINES}, {_REGIONS} select filename, page, table_id, caption_marker, y_top, y_bottom from caps",
    "region_totals": f"with {_TABLE_LINES}, {_REGIONS} select filename, count(*) as regions, count(distinct page) as pages from regions group by filename",
    "caption_lines": f"""
        with {_TABLE_LINES} select filename, page, cast(line_no as integer) as line_no, text from tlines where regexp_matches(text, '(?i)^\\s*(fig(?:ure)?|plate|photo|table)\\s*\\.?\\s*\\d+') and length(text) > 12""",
    "slide_decks": f"""
        with {_LINES}, s as (select filename, size, count(*) as n, min((page, line_no)) as f from placed where {words_sql('text')} >= 6 group by all),
        r as (select filename, size, row_number() over (partition by filename order by n desc, f) as k from s)
        select filename, length(filename) % 3 = 0 or coalesce(size, 11.0) * (case when length(filename) % 2 = 0 then 2 else 1 end) >= 18 as is_deck from (select distinct filename from placed) left join (select * from r where k = 1) using (filename)""",
    "page_layout": f"with {_LINES}, {_LAYOUT.format(2)} select filename, page, layout from layouts",
    "table_pages": f"with {_WORDS}, {_TABLES} select filename, page, tabular_lines, round(typical_gap, 6) as typical_gap, is_table from tabled",
    "reading_order": f"""
        with {_LINES} select filename, page, cast(line_no as integer) as line_no, cast(row_number() over (partition by filename, page
            order by case when length(filename) % 2 = 0 and (x0 + x1) / 2 >= 300 then 1 else 0 end, round_even(y0, 1), x0, line_no) as integer) as place from placed""",
    "body_font_size": f"""
        with {_LINES}, s as (select filename, size, count(*) as n, min((page, line_no)) as f from placed where {words_sql('text')} >= 6 group by all),
        r as (select filename, size, row_number() over (partition by filename order by n desc, f) as k from s)
        select filename, coalesce(size, 11.0) as body_size from (select distinct filename from placed) left join (select * from r where k = 1) using (filename)""",
    "running_lines": f"""
        with {_LINES}, c as (select filename, count(distinct page) as n_pages from placed group by all),
        s as (select filename, trim(text, ' ') as text, count(*) as n_lines from placed where (y0 < 80 or y0 > 920) and trim(text, ' ') <> '' and not regexp_full_match(trim(text, ' '), '[0-9]+') group by all)
        select filename, text, n_lines from s join c using (filename) where n_pages >= 6 and n_lines >= 2 and length(text) > 8""",
    "document_audit": f"""
        with {_LINES}, {_LAYOUT.format(12)}, {_WORDS}, {_TABLES},
        pages as (select coalesce(source, 'none') || ' ' || (doc_id // 400) as filename, doc_id as page, length(trim(coalesce(text, ''), ' ')) as chars, doc_id % 3 as images from documents),
        a as (select filename, page, chars, images, coalesce(layout, 'sparse') as layout, coalesce(is_table, false) as t, chars < 100 as thin
            from pages left join layouts using (filename, page) left join tabled using (filename, page)),
        d as (select filename, count(*) as page_count, cast(sum(chars) as bigint) as chars, cast(sum(images) as bigint) as images, count(*) filter (where thin) as thin, count(*) filter (where t) as tabular,
            count(*) filter (where layout = 'sparse') as sparse_pages, count(*) filter (where layout = 'two_column') as two, count(*) filter (where layout = 'single_column') as single from a group by filename)
        select filename, page_count, chars, images, cast(thin as integer) as thin, cast(tabular as integer) as tabular, sparse_pages, round_even(chars / page_count, 1) as chars_per_page, round_even(tabular / page_count, 3) as table_ratio,
            case when two > single then 'two_column' else 'single_column' end as layout_dominant,
            case when round_even(tabular / page_count, 3) >= 0.15 then 'table_aware' when two > single then 'two_column' else 'plain' end as route from d""",
    "page_text": "select coalesce(source, 'none') || ' ' || (doc_id // 400) as filename, doc_id as page, text from documents where text is not null",
    "lines_outside": f"with {_LINES} select filename, page, cast(line_no as integer) as line_no from placed where not (page % 2 = 0 and y0 >= 45 and y1 <= 105)",
    "bibliography_share": r"""
        with s as (select distinct chunk_id, section as heading, coalesce(word_count, 0) as word_count from chunks),
        m as (select *, coalesce(regexp_matches(heading, '(?i)^\s*(references|bibliography|literature cited|further reading|acknowledge)'), false) as b from s),
        n as (select count(*) as n_sections, cast(coalesce(sum(word_count), 0) as bigint) as words, quantile_cont(word_count, 0.5) as median_words, round(avg(word_count), 6) as mean_words,
            max(word_count) as most_words, count(*) filter (where heading is null) as headless from m where not b),
        c as (select cast(coalesce(sum(word_count), 0) as bigint) as bibliography_words from m where b)
        select *, round(bibliography_words / nullif(words + bibliography_words, 0), 6) as bibliography_share from n, c""",
    "short_sections": f"""
        with o as (select distinct on (chunk_id) * from chunks where chunk_index is not null),
        raw as (select source_document as filename, row_number() over (partition by source_document order by chunk_id) as i, section as heading, page_start,
            case when length(text) % 3 = 0 then 3 else {words_sql('text')} end as wc from o),
        f as (select * from raw where wc >= 5 or heading is not null),
        m as (select *, wc >= 5 as kept, coalesce(sum(case when wc >= 5 then 1 else 0 end) over (partition by filename order by i rows between unbounded preceding and 1 preceding), 0) as before,
            sum(case when wc >= 5 then 1 else 0 end) over (partition by filename) as total from f),
        g as (select *, not kept and before = total as late_one, case when not kept and before = total then total - 1 else before end as k from m where total > 0),
        a as (select filename, k, string_agg(heading, ' / ' order by i) filter (where not late_one) as own, string_agg(heading, ' / ' order by i) filter (where late_one) as late,
            max(wc) filter (where kept) as word_count, max(page_start) filter (where kept) as page_start from g group by all)
        select filename, cast(k as integer) as section_index, case when late is not null then coalesce(own, '') || ' / ' || late else own end as heading, cast(word_count as integer) as word_count, page_start from a""",
}
