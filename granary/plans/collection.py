"""Queries of the chunk collection: provenance, checks, reports, labels; and of dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary import config
from granary.operators import answers, chunking, provenance, quality, records, reports
from granary.plans.common import collapsed_sql, table, words_sql
from granary.sources.files import to_collection

DEFAULT_PARENT = "default"


def manifest_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Every source document with the manifest's title, organization, evidence and parent."""
    docs = table(spark, folder, "chunks").select(F.col("source_document").alias("filename")).distinct()
    parents = table(spark, folder, "manifest_parents")
    default = parents.agg(F.min("parent_work")).first()[0]
    laid = provenance.overlaid(docs, table(spark, folder, "manifest_overrides"), parents, default)
    return laid.select("filename", "verified_title", "manifest_organization", "organization_evidence", "parent_work", "source_url", "ocr_derived", "title_rejected")


def key_report(spark: SparkSession, folder: str) -> DataFrame:
    return quality.key_report(table(spark, folder, "chunks"), "chunk_id")


def class_report(spark: SparkSession, folder: str) -> DataFrame:
    return quality.class_report(table(spark, folder, "chunks"))


def chunk_report(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_report(table(spark, folder, "chunks"))


def unsafe_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """How many chunks break the safety rule, by source."""
    return quality.unsafe_chunks(table(spark, folder, "chunks")).groupBy("source_document").agg(F.count("*").alias("n"))


def unexpected_classes(spark: SparkSession, folder: str) -> DataFrame:
    return quality.unexpected_classes(table(spark, folder, "chunks"))


def label_sets(spark: SparkSession, folder: str) -> DataFrame:
    return quality.label_sets(table(spark, folder, "chunks"))


def reconciled(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks against vectors."""
    return quality.reconciled(table(spark, folder, "chunks"), table(spark, folder, "chunk_vectors"), "chunk_id")


def quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Why chunks can't be loaded, and how many."""
    vectors = table(spark, folder, "chunk_vectors").groupBy("chunk_id").agg(F.min("vector").alias("vector"))
    _, bad = to_collection(table(spark, folder, "chunks"), vectors)
    return bad.groupBy("reason").agg(F.count_distinct("chunk_id").alias("n"))


def union_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of three kinds put together, counted by kind and organization."""
    rows = table(spark, folder, "chunks")
    parts = [rows.filter(F.col("chunk_type") == kind) for kind in ("narrative", "treatment_record", "figure_caption")]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("chunk_type", "organization").agg(F.count("*").alias("n"), F.sum("word_count").alias("words"))


def densest_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The three sources with most chunks of each class."""
    n = table(spark, folder, "chunks").groupBy("disease_name", "source_document").agg(F.count("*").alias("n"))
    order = Window.partitionBy("disease_name").orderBy(F.desc("n"), "source_document")
    return n.withColumn("place", F.row_number().over(order)).filter("place <= 3").select("disease_name", "source_document", "n", "place")


def distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by language, type and source: counts and characters."""
    return table(spark, folder, "documents").groupBy("lang", "document_type", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def dimension_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers with nation and region; a name with fallback."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    joined = table(spark, folder, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("r_name", F.lit("unknown")).alias("region"))


def event_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Time from each event of a user to the next, in seconds."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.timestamp_diff("MICROSECOND", F.col("ts"), F.lead("ts").over(order)) / 1e6
    return table(spark, folder, "events").select("event_id", "user_id", F.round(at, 3).alias("gap_s"))


def sectionized_events(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of a user's events, each opened by a signup."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, folder, "events").withColumn("section", F.sum((F.col("event_type") == "signup").cast("int")).over(order))
    return rows.groupBy("user_id", "section").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


def name_checks(spark: SparkSession, folder: str) -> DataFrame:
    """File names that don't fit their title, with what the texts of all their chunks support."""
    chunks = table(spark, folder, "chunks").select("chunk_id", "source_document", "document_title", "text").dropDuplicates(["chunk_id"])
    titles = chunks.groupBy("source_document").agg(F.min("document_title").alias("title"))
    stem = F.regexp_replace("source_document", r"\.\w+$", "")
    rows = chunks.join(titles, "source_document").select("source_document", "title", provenance.topic_support(F.translate(stem, "-_", "  "), F.col("text")).alias("a"), provenance.topic_support(F.col("title"), F.col("text")).alias("b"))
    rows = rows.groupBy("source_document", "title").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return rows.select("source_document", provenance.name_finding(stem, F.col("title"), F.col("a"), F.col("b")).alias("finding"))


def front_matter(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files whose text is the front matter: title, publisher and type."""
    rows = table(spark, folder, "documents").withColumn("author", F.when(F.col("doc_id") % 9 == 0, "Louisiana State University").when(F.col("doc_id") % 10 == 0, "Copyright by IRRI"))
    meta = F.when(F.col("doc_id") % 4 == 0, "Microsoft Word").otherwise(F.col("title"))
    told = rows.select("doc_id", "text", "author", provenance.verified_title(meta, F.col("text")).alias("title"))
    told = told.withColumn("p", provenance.publisher(F.col("text"), F.col("author"), F.col("title")))
    kind = provenance.document_type(F.col("title"), F.col("text"), F.col("doc_id") % 2, F.col("doc_id") % 60)
    return told.select("doc_id", "title", "p.organization", "p.evidence", kind.alias("type"))


def producer_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by producer, which their number makes."""
    made = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 5 == 1, " ").otherwise(F.concat(F.lit("writer "), (F.col("doc_id") % 5).cast("string")))
    return answers.clusters(table(spark, folder, "documents").select(made.alias("producer")), "producer")


def treatment_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Treatment chunks as nested tables of one record each, made chunks again."""
    return records.treatment_chunks(_record_tables(spark, folder), {"document": "handbook.pdf", "document_title": "Handbook", "organization": "Station"}).select("chunk_id", "text", "disease_name", "disease_name_is_canonical", "section", "word_count", "recommended_treatment", "active_ingredient", "dosage", "crop_stage")


def _record_tables(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks").filter("chunk_type = 'treatment_record'").dropDuplicates(["chunk_id"])
    none = F.lit(None).cast("string")
    record = F.struct(
        F.nullif("recommended_treatment", F.lit("")).alias("fungicide"), "active_ingredient", F.col("dosage").alias("rate_per_acre"), F.col("crop_stage").alias("cultivar_reaction"), none.alias("percent_positive_stops"),
        F.col("page_start").cast("string").alias("percent_infected_tillers"), F.col("symptom").alias("comments"), none.alias("disease_name"), "source_disease_label",
    )
    return rows.select(F.col("chunk_id").alias("table_id"), F.coalesce("page_start", F.lit(0)).alias("page"), F.coalesce("section", F.lit("")).alias("caption"), "disease_name", F.array(record).alias("records"))


def thinnest_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The six sources with most short chunks, then without those that have none."""
    short = F.sort_array(F.collect_set(F.when(F.col("word_count") < 60, F.col("page_start"))))
    rows = table(spark, folder, "chunks").groupBy(F.col("source_document").alias("filename")).agg(short.alias("thin_pages"))
    return reports.thinnest(rows).select("filename", F.size("thin_pages").alias("n"))


def caption_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Of every source the first five caption chunks, at most two of a page."""
    rows = table(spark, folder, "chunks").filter("chunk_type = 'figure_caption' and page_start is not null")
    pages = rows.groupBy(F.col("source_document").alias("filename"), F.col("page_start").alias("page")).agg(F.sort_array(F.collect_set("chunk_id")).alias("captions"))
    return reports.samples(pages).select("filename", F.array_join("samples", "|").alias("samples"))


def top_line_items(spark: SparkSession, folder: str) -> DataFrame:
    """Of every part the line of largest price: the top of each key."""
    rows = table(spark, folder, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("score"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("det_id"))
    return reports.top_detection(rows, ["l_partkey"])


def confidence_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(reports.confidence_label(F.col("event_id") % 101 / 100).alias("label"), reports.message_error(F.col("event_type")).alias("error"))
    return rows.groupBy("label", "error").agg(F.count("*").alias("n"))


def record_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Treatment chunks as verified records: which printed values stand on the page that they cite."""
    rows = table(spark, folder, "chunks").filter("chunk_type = 'treatment_record'").dropDuplicates(["chunk_id"])
    none = F.lit(None).cast("string")
    record = F.struct(
        F.col("recommended_treatment").alias("fungicide"), "active_ingredient", F.col("dosage").alias("rate_per_acre"), none.alias("cultivar_reaction"), none.alias("percent_positive_stops"),
        none.alias("percent_infected_tillers"), none.alias("comments"), "disease_name", "source_disease_label",
    )
    # Each chunk is a table of one record on a page of its own, known by the chunk's hash.
    page = F.xxhash64("chunk_id")
    tables = rows.select(F.col("chunk_id").alias("table_id"), page.alias("page"), F.col("section").alias("caption"), "disease_name", F.array(record).alias("records"))
    return records.verified(tables, rows.select(page.alias("page"), "text")).select(F.col("table_id").alias("chunk_id"), "field", "value", "found")


def verification_report(spark: SparkSession, folder: str) -> DataFrame:
    return records.verification_report(record_checks(spark, folder))


def publisher_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document names a publisher."""
    told = F.map_entries(provenance.mentions(F.col("text"), {"IRRI": r"\bIRRI\b", "rice": "rice", "station": "station"}))
    return table(spark, folder, "documents").select("doc_id", F.explode(told).alias("e")).select("doc_id", F.col("e.key").alias("name"), F.col("e.value").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (thinnest_sources, caption_samples, top_line_items, confidence_labels, record_checks, manifest_overlay, key_report, class_report, chunk_report, unsafe_chunks, unexpected_classes, label_sets, reconciled, quarantine, union_chunks, verification_report, publisher_mentions, front_matter, producer_clusters, treatment_chunks, densest_sources, distribution,
              dimension_overlay, event_gaps, sectionized_events, name_checks)
}

_IMPRINT = "case " + " ".join(f"when regexp_matches(blob, '(?i){p}') then ['{n}', 'imprint']" for n, p in provenance.IMPRINTS.items()) + " " + " ".join(f"when regexp_matches(named, '(?i){p}') then ['{n}', 'publisher_name_in_frontmatter']" for n, p in provenance.PUBLISHERS.items()) + " else ['undetermined', 'none_in_frontmatter'] end"
_TOPICS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z]+'), lambda w: length(w) > 3))"
_SUPPORT = r"list_sum(list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda b: len(list_filter({0}, lambda w: starts_with(b, w)))))"
_CANON = ", ".join(f"'{c}'" for c in config.CANONICAL_CLASSES)
def _checking(x: str) -> str:
    return f"lower({collapsed_sql(f"translate(replace({x}, chr(173), ''), '–—’', '--' || chr(39))")})"


# The words of v one after another in t: the place behind the last one found, the first one's place.
_FOUND = "instr(substr(t, x.at), y.w)"
_ORDERED = f"""list_reduce(list_concat([{{'w': '', 'at': 1, 'start': 0, 'ok': true}}], list_transform(string_split(v, ' '), lambda w: {{'w': w, 'at': 1, 'start': 0, 'ok': true}})),
    lambda x, y: {{'w': '', 'at': cast(case when x.ok and {_FOUND} > 0 then x.at + {_FOUND} - 1 + length(y.w) else x.at end as integer),
        'start': cast(case when x.ok and {_FOUND} > 0 and x.start = 0 then x.at + {_FOUND} - 1 else x.start end as integer), 'ok': x.ok and {_FOUND} > 0}})"""

_RECORDS = f"""
        with o as (select distinct on (chunk_id) * from chunks where chunk_type = 'treatment_record'),
        a as (select chunk_id, text, unnest(['fungicide', 'active_ingredient', 'rate_per_acre', 'source_disease_label']) as field, unnest([recommended_treatment, active_ingredient, dosage, trim(string_split(source_disease_label, '(')[1], ' ')]) as value from o),
        f as (select *, {_checking('value')} as v, {_checking('text')} as t from a where coalesce(value, '') <> '' and value <> '{records.EXEMPT[0]}'),
        r as (select *, {_ORDERED} as s from f)
        select chunk_id, field, value, coalesce(contains(t, v) or (s.ok and s.at - s.start < length(v) + 120), false) as found from r"""

SQL = {
    "record_checks": _RECORDS,
    "verification_report": f"select count(*) as checked, count(*) filter (where found) as confirmed, count(*) filter (where not found) as failed from ({_RECORDS})",
    "publisher_mentions": r"""
        with m as (select doc_id, unnest(['IRRI', 'rice', 'station']) as name, unnest([len(regexp_extract_all(coalesce(text, ''), '(?i)\bIRRI\b')), len(regexp_extract_all(coalesce(text, ''), '(?i)rice')), len(regexp_extract_all(coalesce(text, ''), '(?i)station'))]) as n from documents)
        select doc_id, name, cast(n as integer) as n from m""",
    "name_checks": f"""
        with c as (select distinct on (chunk_id) chunk_id, source_document, document_title, text from chunks), t as (select source_document, min(document_title) as title, regexp_replace(source_document, '\\.\\w+$', '') as stem from c group by all),
        w as (select *, {_TOPICS.format("translate(stem, '-_', '  ')")} as wn, {_TOPICS.format('title')} as wt from t),
        n as (select w.source_document, sum(coalesce({_SUPPORT.format('wn')}, 0)) as a, sum(coalesce({_SUPPORT.format('wt')}, 0)) as b from c join w using (source_document) where text is not null group by all),
        f as (select *, length(title) < 5 or len(list_filter(regexp_extract_all(stem, '[A-Za-z]{{2,}}'), lambda x: contains(lower(array_to_string(list_transform(regexp_extract_all(title, '[A-Za-z]+'), lambda y: left(y, 1)), '')), lower(x)))) > 0
            or len(wn) = 0 or len(wt) = 0 or list_has_any(wn, wt) as fine from w join n using (source_document))
        select source_document, case when not coalesce(fine, true) then case when a >= b then printf('file name ''%s'' agrees with the text (%d), title ''%s'' doesn''t (%d)', stem, a::bigint, title, b::bigint)
            else printf('file name ''%s'' disagrees with the text (%d), title ''%s'' agrees (%d)', stem, a::bigint, title, b::bigint) end end as finding from f""",
    "front_matter": f"""
        with d as (select doc_id, text, case when doc_id % 9 = 0 then 'Louisiana State University' when doc_id % 10 = 0 then 'Copyright by IRRI' end as author, trim(coalesce(case when doc_id % 4 = 0 then 'Microsoft Word' else title end, ''), ' ') as meta from documents),
        t as (select *, left(case when regexp_matches(meta, '(?i){provenance.TITLE_JUNK}') or length(meta) < 5 then coalesce(list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(x, ' ')), lambda x: length(x) >= 12 and regexp_matches(x, '\\p{{L}}'))[1], '') else meta end, 200) as title from d),
        b as (select *, concat_ws(' ', left(text, 3000), author) as blob, concat_ws(' ', left(text, 3000), author, title) as named, lower(concat_ws(' ', title, text)) as body from t),
        p as (select *, {_IMPRINT} as p from b)
        select doc_id, title, p[1] as organization, p[2] as evidence, case when regexp_matches(body, '(?i){provenance.TYPES[0][1].replace('.{0,4000}', '.*')}') then 'research_paper' when regexp_matches(body, '(?i){provenance.TYPES[1][1]}') then 'field_guide'
            when doc_id % 60 <= 40 and (doc_id % 2 > 0 or regexp_matches(body, '(?i){provenance.TYPES[2][1]}')) then 'bulletin' else 'other' end as type from p""",
    "producer_clusters": "select case when doc_id % 5 < 2 then 'unknown' else 'writer ' || (doc_id % 5) end as producer, count(*) as n from documents group by 1",
    "treatment_chunks": f"""
        with o as (select distinct on (chunk_id) *, coalesce(section, '') as caption, nullif(recommended_treatment, '') as product, nullif(disease_name, '') as label from chunks where chunk_type = 'treatment_record'),
        t as (select *, trim(case when product is not null then caption || ' For ' || coalesce(source_disease_label, label, 'None') || ': apply ' || product || ' (active ingredient ' || coalesce(active_ingredient, '') || ') at ' || coalesce(dosage, '') || ' per acre. ' || coalesce(symptom, '')
            else caption || ' For a cultivar rated ' || coalesce(crop_stage, '') || ', the treatment threshold is n/a% positive stops and ' || coalesce(page_start::varchar, 'n/a') || '% infected tillers. ' || coalesce(symptom, '') end, ' ') as told from o)
        select 'records:' || replace(chunk_id, ' ', '-') || ':0' as chunk_id, told as text, label as disease_name, coalesce(label in ({_CANON}), false) as disease_name_is_canonical, chunk_id as section, cast({words_sql('told')} as integer) as word_count,
            product as recommended_treatment, case when product is not null then active_ingredient end as active_ingredient, case when product is not null then dosage end as dosage, case when product is null then symptom end as crop_stage from t""",
    "thinnest_sources": """
        with n as (select source_document as filename, count(distinct page_start) filter (where word_count < 60) as n from chunks group by all), t as (select * from n order by n desc, filename limit 6)
        select filename, cast(n as integer) as n from t where n > 0""",
    "caption_samples": """
        with d as (select distinct source_document as filename, page_start as page, chunk_id from chunks where chunk_type = 'figure_caption' and page_start is not null),
        p as (select *, row_number() over (partition by filename, page order by chunk_id) as k from d), q as (select *, row_number() over (partition by filename order by page, chunk_id) as m from p where k <= 2)
        select filename, string_agg(chunk_id, '|' order by m) as samples from q where m <= 5 group by filename""",
    "top_line_items": "select distinct on (l_partkey) l_partkey, l_extendedprice as score, l_orderkey * 8 + l_linenumber as det_id from lineitem order by l_partkey, l_extendedprice desc, l_orderkey * 8 + l_linenumber",
    "confidence_labels": """
        with e as (select case when event_id % 101 / 100 >= 0.85 then 'high' when event_id % 101 / 100 >= 0.65 then 'medium' else 'low' end as label,
            case when length(coalesce(event_type, '')) = 0 then 'empty_message' when length(event_type) > 4000 then 'message_too_long' end as error from events)
        select label, error, count(*) as n from e group by all""",
    "manifest_overlay": """
        with d as (select distinct source_document as filename from chunks), k as (select min(parent_work) as def from manifest_parents),
        o as (select distinct on (filename) * from manifest_overrides order by filename, verified_title nulls first, organization nulls first, document_type nulls first, has_parent_work nulls first,
            parent_work nulls first, source_url nulls first, warning nulls first, ignore_embedded_metadata_title nulls first),
        j as (select d.filename, o.verified_title, nullif(o.organization, '') as own, case when coalesce(o.has_parent_work, false) then o.parent_work else k.def end as parent_work, o.warning,
            coalesce(o.ignore_embedded_metadata_title, false) as title_rejected from d cross join k left join o using (filename)),
        p as (select distinct on (parent_work) parent_work as pw, organization as porg, source_url from manifest_parents order by parent_work, organization nulls first, source_url nulls first)
        select filename, verified_title, coalesce(own, nullif(porg, '')) as manifest_organization,
            case when own is not null then 'manifest_override' when nullif(porg, '') is not null then 'manifest_parent_work' end as organization_evidence,
            parent_work, source_url, coalesce(contains(warning, 'OCR'), false) as ocr_derived, case when j.title_rejected is null then null else title_rejected end as title_rejected
        from j left join p on parent_work = pw""",
    "key_report": "select count(*) as n_rows, count(distinct chunk_id) as n_keys, count(*) filter (where chunk_id is null) as n_null, count(*) = count(distinct chunk_id) as is_unique from chunks",
    "class_report": "select disease_name, count(*) as n_chunks, count(*) filter (where chunk_type = 'treatment_record') as n_treatment from chunks group by disease_name",
    "chunk_report": """
        select count(*) as n_chunks, cast(coalesce(sum(word_count), 0) as bigint) as words, min(word_count) as least_words, cast(list_sort(list(word_count) filter (where word_count is not null))[count(word_count) // 2 + 1] as double) as middle_words,
            max(word_count) as most_words, count(*) filter (where chunk_type = 'treatment_record') as treatment_records, count(*) filter (where disease_name is null) as unlabelled from chunks""",
    "unsafe_chunks": "select source_document, count(*) as n from chunks where coalesce(is_inoculation_protocol, false) and chunk_type = 'treatment_record' group by source_document",
    "unexpected_classes": f"select distinct disease_name from chunks where coalesce(disease_name_is_canonical, false) and disease_name not in ({_CANON})",
    "label_sets": f"""
        with l as (select disease_name as label, true as d, false as c from chunks where disease_name is not null union all select unnest([{_CANON}]), false, true)
        select label, bool_or(d) as in_data, bool_or(c) as canonical from l group by label""",
    "reconciled": """
        select (select count(*) from chunks) as source_rows, (select count(*) from chunk_vectors) as loaded_rows,
            (select count(*) from (select distinct chunk_id from chunks) where chunk_id not in (select chunk_id from chunk_vectors where chunk_id is not null)) as missing,
            (select count(*) from (select distinct chunk_id from chunk_vectors) where chunk_id not in (select chunk_id from chunks where chunk_id is not null)) as extra""",
    "quarantine": """
        with v as (select chunk_id, min(vector) as vector from chunk_vectors group by chunk_id),
        m as (select c.chunk_id, case when c.chunk_id is null then 'no chunk_id' when coalesce(trim(text), '') = '' then 'no text' when vector is null then 'no vector'
            when len(vector) <> 64 or len(list_filter(vector, lambda x: x <> 0)) = 0 then 'unusable vector'
            when coalesce(is_inoculation_protocol, false) and chunk_type = 'treatment_record' then 'unsafe' end as reason from chunks c left join v using (chunk_id))
        select reason, count(distinct chunk_id) as n from m where reason is not null group by reason""",
    "union_chunks": "select chunk_type, organization, count(*) as n, cast(sum(word_count) as bigint) as words from chunks where chunk_type in ('narrative', 'treatment_record', 'figure_caption') group by all",
    "densest_sources": """
        with n as (select disease_name, source_document, count(*) as n from chunks group by all), r as (select *, row_number() over (partition by disease_name order by n desc, source_document) as place from n)
        select disease_name, source_document, n, cast(place as integer) as place from r where place <= 3""",
    "distribution": "select lang, document_type, source, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by all",
    "dimension_overlay": """
        select s_suppkey, coalesce(n_name, 'unknown') as nation, coalesce(r_name, 'unknown') as region from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""",
    "event_gaps": """
        select event_id, user_id, round((epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts)) / 1e6, 3) as gap_s from events""",
    "sectionized_events": """
        with s as (select user_id, ts, cast(sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id) as bigint) as section from events)
        select user_id, section, count(*) as n, min(ts) as first_ts from s group by all""",
}
