"""Queries of texts: counts, classes, chunks, copies, cleaning, languages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import config
from granary.functions import text as X
from granary.operators import chunking, cleaning, duplicates, provenance
from granary.plans.common import WHITE_SQL, collapsed_sql, hits_sql, spread, table, words_sql

def word_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents by language: sum, interpolated median, mean, most."""
    rows = spread(table(spark, folder, "documents")).select("lang", X.word_count(F.col("text")).alias("n"))
    return rows.groupBy("lang").agg(F.count("*").alias("texts"), F.sum("n").alias("words"), F.percentile("n", 0.5).alias("median_words"), F.round(F.avg("n"), 6).alias("mean_words"), F.max("n").alias("most_words"))


def class_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions of each class in each document that has any."""
    rows = spread(table(spark, folder, "documents")).select("doc_id", F.explode(chunking.class_hits(F.col("text"), config.CHUNK_LEXICON | config.OTHER_LEXICON)).alias("c"))
    return rows.filter("c.n > 0").select("doc_id", F.col("c.name").alias("class_name"), F.col("c.n").cast("bigint").alias("n"))


def dominant_class(spark: SparkSession, folder: str) -> DataFrame:
    """The dominant class of each chunk text, canonical classes first."""
    rows = spread(table(spark, folder, "chunks")).select("chunk_id", F.inline(F.array(chunking.dominant_class(F.col("text")))))  # told once a row
    return rows.withColumnRenamed("name", "class_name").distinct()


def label_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Class, type and inoculation flag of every chunk by the full lexicons and rules."""
    rows = spread(table(spark, folder, "chunks")).dropDuplicates(["chunk_id"])
    rows = rows.withColumn("inoculation", chunking.inoculation_flag(F.col("document_type"), F.col("text"))).withColumn("d", chunking.dominant_class(F.col("text")))
    return rows.select("chunk_id", F.col("d.name").alias("class_name"), F.col("d.canonical").alias("canonical"), "inoculation", chunking.chunk_type(F.col("section"), F.col("text"), F.col("inoculation")).alias("type"))


def class_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as a page of its source: mentions and pages of each class, and the sources with most mentions."""
    pages = spread(table(spark, folder, "documents")).select(F.coalesce("source", F.lit("")).alias("filename"), "text")
    told = F.array_join(F.transform(F.map_entries("documents"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|")
    return chunking.class_coverage(pages).withColumn("documents", told)


def packed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document packed to chunks."""
    rows = spread(table(spark, folder, "documents")).select("doc_id", chunking.packed(F.col("text")).alias("parts"))
    rows = rows.select("doc_id", F.size("parts").alias("chunk_total"), F.posexplode("parts").alias("chunk_index", "chunk_text"))
    return rows.withColumn("word_count", X.word_count(F.col("chunk_text")))


def _metadata(rows: DataFrame) -> DataFrame:
    """Made metadata of most of the sources."""
    n = F.length("filename")
    docs = rows.select("filename").distinct().filter(n % 7 > 0)
    kind = F.when(n % 4 == 0, config.SCREENING_TYPE).otherwise("bulletin")
    return docs.select("filename", F.upper("filename").alias("document_title"), F.concat(F.lit("Org "), n.cast("string")).alias("organization"), F.lit(None).cast("string").alias("source_url"), kind.alias("document_type"), F.lit(False).alias("ocr_derived"))


def narrative_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as sections of their sources, to labelled and typed chunks."""
    rows = spread(table(spark, folder, "documents")).select(F.coalesce("source", F.lit("none")).alias("filename"), F.col("doc_id").alias("section_index"), F.col("title").alias("heading"), "text", F.col("doc_id").alias("page_start"), F.col("doc_id").alias("page_end"))
    made = chunking.narrative_chunks(rows, _metadata(rows))
    return made.select("chunk_id", "text", "organization", "document_type", "chunk_type", "disease_name", "disease_name_is_canonical", "section", "word_count", "chunk_total", "is_inoculation_protocol")


def caption_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and first characters of documents as captions, to chunks."""
    told = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring("text", 1, 200))
    rows = table(spark, folder, "documents").filter("text is not null").select(F.coalesce("source", F.lit("none")).alias("filename"), F.col("doc_id").alias("caption_index"), F.col("doc_id").alias("page"), told.alias("text"))
    return chunking.caption_chunks(rows, _metadata(rows)).select("chunk_id", "text", "disease_name", "disease_name_is_canonical", "word_count")


def stripped_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of every second source without two running lines."""
    rows = table(spark, folder, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("filename"), "text")
    headers = rows.select("filename").distinct().filter(F.length("filename") % 2 == 0).select("filename", F.explode(F.array(F.lit("near"), F.lit("the"))).alias("text"))
    return cleaning.without_headers(rows, headers).select("doc_id", "text", "header_words")


def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.exact_duplicates(table(spark, folder, "documents"), "doc_id").withColumnRenamed("id", "doc_id")


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.near_duplicates(table(spark, folder, "documents"), "doc_id").select("id_a", "id_b", F.col("shared").cast("bigint").alias("shared"), F.round("overlap", 6).alias("overlap"))


def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different documents with five-word shingles in common to at least 0.8."""
    return duplicates.near_copies(spread(table(spark, folder, "documents")), "doc_id").select("id_a", "id_b", F.col("shared").cast("bigint").alias("shared"), F.round("similarity", 6).alias("similarity"))


def latest_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Of every chunk the latest delivery."""
    return duplicates.latest_rows(table(spark, folder, "chunks"), "chunk_id", "ingested_at", "created_at").select("chunk_id", "ingested_at")


def first_events(spark: SparkSession, folder: str) -> DataFrame:
    """Of every user and type the first event."""
    return duplicates.first_wins(table(spark, folder, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def inline_hyphens(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.inline_hyphens(table(spark, folder, "documents"))


def cleaned_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Normal form, hyphens by evidence, split words."""
    rows = cleaning.normalised(spread(table(spark, folder, "chunks")).select("chunk_id", "text").distinct())
    joined = cleaning.dehyphenated(rows, cleaning.inline_hyphens(rows), ["chunk_id"])
    return cleaning.words_rejoined(joined)


def languages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", provenance.language(F.col("text")).alias("told"))


def redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines made of events, with secrets in three shapes masked."""
    line = F.concat(F.lit("user "), F.col("user_id"), F.lit(" token="), F.col("event_id"), F.lit(" Authorization: Bearer abcdef"), F.lpad(F.col("event_id").cast("string"), 8, "0"), F.lit(" "), F.col("event_type"))
    return table(spark, folder, "events").select("event_id", X.without_secrets(line).alias("line"))


def slugs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("source_document", X.slug(F.col("source_document")).alias("slug")).distinct()


def list_items(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of chunk texts as list items: bullets off, headings and scraps out."""
    rows = table(spark, folder, "chunks").select("chunk_id", "text").distinct()
    return rows.select("chunk_id", F.posexplode(X.list_lines(F.col("text"))).alias("item_no", "item"))


def json_props(spark: SparkSession, folder: str) -> DataFrame:
    """A field of JSON text, summed by type of event."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


QUERIES = {
    f.__name__: f
    for f in (word_stats, class_counts, dominant_class, label_chunks, class_coverage, packed_documents, narrative_chunks, caption_chunks, stripped_headers, exact_duplicates, near_duplicates, near_copies, latest_chunks, first_events,
              inline_hyphens, cleaned_chunks, languages, redacted, slugs, list_items, json_props)
}


def _hits(text: str, pattern: str) -> str:
    """Matches of a lexicon's pattern. SQL has no look-ahead: the alternatives that have one are counted without it, less
    their matches that what must not follow follows."""
    plain = re.sub(r"\(\?!.*?\)(?:\))?(?=\||$)", "", pattern)
    counted = hits_sql(text, plain)
    for alternative, barred in re.findall(r"(\\b\w+\\b)\(\?!((?:[^()]|\([^()]*\))*)\)", pattern):
        counted += f" - {hits_sql(text, alternative + barred)}"
    return f"({counted})"


def _counts(lexicon: dict[str, str], text: str) -> str:
    return "[" + ", ".join(f"{{'n': {_hits(text, p)}, 'place': {i}, 'name': '{name}'}}" for i, (name, p) in enumerate(lexicon.items())) + "]"


def _best(counts: str) -> str:
    return f"list_reduce({counts}, lambda p, q: case when q.n > p.n then q else p end)"


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_VOTES = ", ".join(f"len(list_filter(t, lambda w: list_contains([{', '.join(repr(w) for w in words)}], w))) as n_{code}" for code, words in provenance.STOP_WORDS.items())
_SHINGLES = "list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(list_slice(w, i, i + 7), ' ')))"

_DOMINANT = f"""
    d as (select distinct chunk_id, text from chunks),
    c as (select chunk_id, text, {_counts(config.CHUNK_LEXICON, 'text')} as a, {_counts(config.OTHER_LEXICON, 'text')} as b from d),
    s as (select chunk_id, text, {_best('a')} as x, {_best('b')} as y, list_sum(list_transform(list_concat(a, b), lambda z: z.n)) as total from c),
    w as (select chunk_id, text, x.n >= 2 and x.n / greatest(total, 1) >= 0.6 as one, y.n >= 2 and y.n / greatest(total, 1) >= 0.6 as two, x.name as xn, y.name as yn from s),
    dominant as (select chunk_id, text, case when one then xn when two then yn end as class_name, one as canonical from w)"""
_WORD_LIST = f"list_filter(regexp_split_to_array(p, '{WHITE_SQL}'), lambda v: v <> '')"
_TAIL = "list_slice(x.now, list_filter(range(1, len(x.now) + 2), lambda j: coalesce(list_sum(list_transform(list_slice(x.now, j, len(x.now)), lambda t: t.n)), 0) <= 60)[1], len(x.now))"
_PACKED = f"""
    d as (select doc_id, text, {words_sql('text')} as words, list_filter(string_split(regexp_replace(text, '([.!?]){WHITE_SQL}([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: x <> '') as parts from documents where text is not null),
        w as (select doc_id, text, words, flatten(list_transform(parts, lambda p: list_transform(range(0, cast(ceil(len({_WORD_LIST}) / 280) as bigint)), lambda i: list_slice({_WORD_LIST}, i * 280 + 1, i * 280 + 280)))) as runs from d),
        e as (select doc_id, text, words, list_transform(runs, lambda r: {{'done': []::varchar[], 'now': [{{'s': array_to_string(r, ' '), 'n': len(r)}}], 'n': len(r)}}) as els from w),
        r as (select doc_id, text, words, case when words > 280 then list_reduce(els, lambda x, y: case when x.n + y.n > 280 then
                {{'done': list_append(x.done, array_to_string(list_transform(x.now, lambda t: t.s), ' ')), 'now': list_concat({_TAIL}, y.now), 'n': cast(coalesce(list_sum(list_transform({_TAIL}, lambda t: t.n)), 0) + y.n as bigint)}}
            else {{'done': x.done, 'now': list_concat(x.now, y.now), 'n': x.n + y.n}} end) end as s from e),
        f as (select doc_id, case when words <= 280 then [text] when len(s.done) > 0 and s.n < 40 then list_append(list_slice(s.done, 1, len(s.done) - 1), s.done[-1] || ' ' || array_to_string(list_transform(s.now, lambda t: t.s), ' '))
            else list_append(s.done, array_to_string(list_transform(s.now, lambda t: t.s), ' ')) end as chunks from r),
    packs as (select doc_id, cast(len(chunks) as integer) as chunk_total, cast(i - 1 as integer) as chunk_index, chunks[i] as chunk_text, cast({words_sql('chunks[i]')} as integer) as word_count from (select doc_id, chunks, unnest(range(1, len(chunks) + 1)) as i from f))"""


def _labelled(prefix: str, source: str, key: str, text: str, share: float, least: int) -> str:
    """CTE ``{prefix}``: (key, name, canonical) of the dominant class of each text of ``source``."""
    return f"""
    {prefix}_c as (select {key}, {_counts(config.CHUNK_LEXICON, text)} as a, {_counts(config.OTHER_LEXICON, text)} as b from {source}),
    {prefix}_s as (select {key}, {_best('a')} as x, {_best('b')} as y, list_sum(list_transform(list_concat(a, b), lambda z: z.n)) as total from {prefix}_c),
    {prefix}_w as (select {key}, x.n >= {least} and x.n / greatest(total, 1) >= {share} as one, y.n >= {least} and y.n / greatest(total, 1) >= {share} as two, x.name as xn, y.name as yn from {prefix}_s),
    {prefix} as (select {key}, case when one then xn when two then yn end as name, one as canonical from {prefix}_w)"""


_META = "case when length(filename) % 7 = 0 then null when length(filename) % 4 = 0 then 'screening_manual' else 'bulletin' end"
_SLUG = "regexp_replace(left(regexp_replace(lower(filename), '[^a-z0-9]+', '-', 'g'), 40), '^-+|-+$', '', 'g')"

SQL = {
    "narrative_chunks": f"""
        with {_PACKED}, docs as (select doc_id, coalesce(source, 'none') as filename, title as heading, text, concat_ws(' ', coalesce(title, ''), text) as whole from documents),
        chosen as (select p.*, filename, heading, {_META} as document_type, doc_id || ':' || chunk_index as part from packs p join docs using (doc_id) where p.word_count >= 40 or p.chunk_total > 1),
        {_labelled('own', 'chosen', 'part', 'chunk_text', 0.6, 2)}, {_labelled('parent', 'docs', 'doc_id', 'whole', 0.5, 1)},
        marked as (select *, coalesce(document_type, '') = '{config.SCREENING_TYPE}' and coalesce(regexp_matches(chunk_text, '(?i){config.INOCULATION}'), false) as inoculation, {hits_sql('chunk_text', config.ACTIONABLE)} as actions,
            coalesce(regexp_matches(heading, '(?i){config.MANAGEMENT_HEADING}'), false) or coalesce(regexp_matches(chunk_text, '(?i){config.MANAGEMENT_MARKER}'), false) as signposted from chosen)
        select {_SLUG} || ':' || m.doc_id || ':' || chunk_index as chunk_id, chunk_text as text, case when document_type is null then 'unknown' else 'Org ' || length(filename) end as organization, document_type,
            case when not inoculation and ((signposted and actions >= 1) or actions >= 3) then 'treatment_record' else 'narrative' end as chunk_type, coalesce(own.name, parent.name) as disease_name,
            case when own.name is not null then own.canonical else parent.canonical end as disease_name_is_canonical, heading as section, word_count, chunk_total, inoculation as is_inoculation_protocol
        from marked m join own using (part) join parent on m.doc_id = parent.doc_id""",
    "caption_chunks": f"""
        with caps as (select doc_id, coalesce(source, 'none') as filename, coalesce(title, '') || ' ' || left(text, 200) as told from documents where text is not null), {_labelled('l', 'caps', 'doc_id', 'told', 0.5, 1)}
        select {_SLUG} || ':fig:' || doc_id as chunk_id, told as text, name as disease_name, canonical as disease_name_is_canonical, cast({words_sql('told')} as integer) as word_count from caps join l using (doc_id)""",
    "stripped_headers": f"""
        with t as (select doc_id, coalesce(source, 'none') as filename, text from documents), b as (select *, replace(replace(text, 'near', ' '), 'the', ' ') as cut, length(filename) % 2 = 0 as has from t),
        c as (select doc_id, text, case when has then {collapsed_sql('cut')} else text end as bare from b)
        select doc_id, bare as text, cast(len(string_split(coalesce(text, ''), ' ')) - len(string_split(coalesce(bare, ''), ' ')) as integer) as header_words from c""",
    "word_stats": f"""
        with n as (select lang, {words_sql('text')} as n from documents)
        select lang, count(*) as texts, cast(sum(n) as bigint) as words, quantile_cont(n, 0.5) as median_words, round(avg(n), 6) as mean_words, cast(max(n) as integer) as most_words from n group by lang""",
    "class_counts": f"""
        with c as (select doc_id, unnest({_counts(config.CHUNK_LEXICON | config.OTHER_LEXICON, 'text')}) as c from documents)
        select doc_id, c.name as class_name, cast(c.n as bigint) as n from c where c.n > 0""",
    "dominant_class": f"with {_DOMINANT} select distinct chunk_id, class_name, canonical from dominant",
    "label_chunks": f"""
        with {_DOMINANT}, one as (select distinct chunk_id, text, section, document_type from chunks),
        marked as (select chunk_id, text, section, class_name, canonical, coalesce(document_type, '') = '{config.SCREENING_TYPE}' and coalesce(regexp_matches(text, '(?i){config.INOCULATION}'), false) as inoculation,
            {hits_sql('text', config.ACTIONABLE)} as actions, coalesce(regexp_matches(section, '(?i){config.MANAGEMENT_HEADING}'), false) or coalesce(regexp_matches(text, '(?i){config.MANAGEMENT_MARKER}'), false) as signposted
            from one join dominant using (chunk_id, text))
        select distinct on (chunk_id) chunk_id, class_name, canonical, inoculation, case when not inoculation and ((signposted and actions >= 1) or actions >= 3) then 'treatment_record' else 'narrative' end as type from marked""",
    "class_coverage": f"""
        with c as (select filename, text, unnest(counts) as c, list_sum(list_transform(counts, lambda z: z.n)) as total from (select coalesce(source, '') as filename, text, {_counts(config.COVERAGE_LEXICON, 'text')} as counts from documents)),
        f as (select filename, c.name as class_name, c.n as n, c.n / total >= 0.6 as prime, regexp_matches(text, '(?i){config.COVERAGE_TREATMENT}') as treat, regexp_matches(text, '(?i){config.COVERAGE_INOCULATION}') as inoc from c where c.n > 0),
        s as (select class_name, cast(sum(n) as bigint) as mentions, count(*) as pages, count(*) filter (where prime) as primary_pages, count(*) filter (where prime and treat) as treatment_pages,
            count(*) filter (where prime and inoc and not treat) as inoculation_only_pages from f group by all),
        p as (select class_name, filename, cast(sum(n) as bigint) as n from f group by all), t as (select *, row_number() over (partition by class_name order by n desc, filename) as k from p)
        select s.*, d.documents from s join (select class_name, string_agg(filename || '=' || n, '|' order by filename) as documents from t where k <= 3 group by all) d using (class_name)""",
    "packed_documents": f"with {_PACKED} select * from packs",
    "list_items": r"""
        with t as (select chunk_id, regexp_split_to_array(text, '\r?\n') as raw from (select distinct chunk_id, text from chunks where text is not null)),
        p as (select chunk_id, list_filter(list_transform(raw, lambda x: {'raw': x, 'item': trim(regexp_replace(trim(regexp_replace(trim(x, ' '), '^[-*•\d.)\s\x0b]+', ''), ' '), '\*\*(.+?)\*\*', '\1', 'g'), ' ')}),
            lambda q: not regexp_matches(q.raw, '^[\s\x0b]*(#|\||```)') and length(q.item) > 2) as kept from t)
        select chunk_id, cast(i - 1 as integer) as item_no, kept[i].item as item from (select chunk_id, kept, unnest(range(1, len(kept) + 1)) as i from p)""",
    "exact_duplicates": "select doc_id, min(doc_id) over (partition by coalesce(text, doc_id::varchar)) as class_id, count(*) over (partition by coalesce(text, doc_id::varchar)) as copies from documents",
    "near_duplicates": f"""
        with u as (select min(doc_id) as id, text from documents where text is not null group by text),
        w as (select id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') as w from u),
        s as (select id, {_SHINGLES} as g from w where len(w) >= 60),
        e as (select id, len(g) as n, unnest(g) as g from s),
        p as (select a.id as id_a, b.id as id_b, count(*) as shared, min(least(a.n, b.n)) as small from e a join e b on a.g = b.g and a.id < b.id group by all)
        select id_a, id_b, shared, round(shared / small, 6) as overlap from p where shared / small >= 0.3""",
    "near_copies": r"""
        with u as (select min(doc_id) as id, text from documents where text is not null group by text),
        w as (select id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from u),
        s as (select id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) as g from w where len(w) > 0),
        e as (select id, len(g) as n, unnest(g) as g from s),
        p as (select a.id as id_a, b.id as id_b, count(*) as shared, any_value(a.n + b.n) as sizes from e a join e b on a.g = b.g and a.id < b.id group by all)
        select id_a, id_b, shared, round(shared / (sizes - shared), 6) as similarity from p where shared / (sizes - shared) >= 0.8""",
    "latest_chunks": "select chunk_id, max(ingested_at) as ingested_at from chunks group by chunk_id",
    "first_events": "select distinct on (user_id, event_type) user_id, event_type, event_id from events order by user_id, event_type, ts, event_id",
    "inline_hyphens": r"""
        with p as (select unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+-[\p{L}\p{N}_]+')) as p from documents), h as (select string_split(lower(p), '-') as h from p)
        select h[1] as "left", h[2] as "right", count(*) as n from h group by all""",
    "languages": f"""
        with t as (select doc_id, text, {_TOKENS} as t from documents), v as (select doc_id, text, {_VOTES} from t)
        select doc_id, case when length(text) < 200 or text is null or greatest(n_en, n_es, n_fr, n_id) = 0 then 'unknown'
            when n_en >= greatest(n_es, n_fr, n_id) then 'en' when n_es >= greatest(n_fr, n_id) then 'es' when n_fr >= n_id then 'fr' else 'id' end as told from v""",
    "redacted": r"select event_id, 'user ' || user_id || ' token=[REDACTED] Authorization: Bearer [REDACTED] ' || event_type as line from events",
    "slugs": "select distinct source_document, regexp_replace(substring(regexp_replace(lower(source_document), '[^a-z0-9]+', '-', 'g'), 1, 40), '^-+|-+$', '', 'g') as slug from chunks",
    "json_props": """
        select event_type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as total, max(cast(json_extract_string(props, '$.k') as bigint)) as most from events group by event_type""",
}
