"""Queries of what is told of results: states, contexts, verdicts, questions, labels, errors, grounded answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import geometry as G
from granary.operators import answers as A
from granary.operators import detections as D
from granary.plans.common import table
from granary.plans.search import CITATION_SQL, PASSAGE_SQL
from granary.plans.vision import MASKS_SQL, made_masks

_NAMES = {"click": "Brown_Spot", "error": "Leaf_Blast", "purchase": "Sheath_Blight", "signup": "Unlisted_Class"}


def made_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Users as analysed requests: classes of their events, confidence and affected share made of their number."""
    name = A.looked_up(F.col("event_type"), _NAMES)
    rows = table(spark, folder, "events").groupBy("user_id").agg(F.sort_array(F.collect_set(name)).alias("found"), F.count("*").cast("int").alias("lesion_count"))
    ratio = F.col("user_id") % 250 / 1000
    rows = rows.withColumns({"diseases": F.when(F.col("user_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("found")), "ratio": ratio, "severity": G.severity(ratio)})
    return rows.select("user_id", "diseases", F.when(F.col("user_id") % 5 > 0, F.get("found", F.lit(0))).alias("disease_name"), F.when(F.col("user_id") % 11 > 0, F.col("user_id") % 101 / 100).alias("confidence"), "severity", "lesion_count", "ratio")


def diagnosis_states(spark: SparkSession, folder: str) -> DataFrame:
    rows = A.with_state(made_findings(spark, folder))
    return rows.select("user_id", F.array_join("targets", "|").alias("targets"), "has_diagnosis", "is_healthy", "is_coinfection", "is_low_confidence")


def vision_contexts(spark: SparkSession, folder: str) -> DataFrame:
    return A.with_state(made_findings(spark, folder)).select("user_id", A.vision_context().alias("context"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    rows = made_findings(spark, folder).filter("disease_name is not null")
    return rows.select("user_id", A.question(F.col("disease_name"), F.col("diseases"), F.col("severity"), F.col("ratio")).alias("question"))


def panicle_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Users' first six events as pictures."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, folder, "events").withColumn("image_index", F.row_number().over(order) - 1).filter("image_index < 6")
    rows = rows.select(F.col("user_id").alias("request_id"), "image_index", F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("p"), F.col("event_id").cast("string"), F.lit(".jpg"))).alias("filename"), (F.col("event_id") % 101 / 100).alias("score"))
    return A.panicle_reports(D.panicle_verdicts(rows))


def class_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label and scientific name of every class of the chunks, with fallback."""
    rows = table(spark, folder, "chunks").select("disease_name").distinct()
    return rows.select("disease_name", A.class_label(F.col("disease_name")).alias("label"), A.scientific_name(F.col("disease_name")).alias("scientific_name"))


def file_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Events as files offered by a sender, by why they aren't taken."""
    kind = A.looked_up(F.col("event_type"), {"click": "image/png", "view": "image/jpeg", "error": "image/gif"})
    code = A.file_error(kind, F.col("event_id") % 100 * 131_072, F.expr("cast(event_id % 4 as int)"), F.lit(1))
    rows = A.failures(table(spark, folder, "events"), code, F.concat(F.lit("file "), F.col("event_id").cast("string")))
    return rows.groupBy("error_code", "error_status").agg(F.count("*").alias("n"), F.min("error_message").alias("one"))


def grounded_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of each source document's treatment records, and a marker for those that have none."""
    chunks = table(spark, folder, "chunks")
    rows = chunks.filter("chunk_type = 'treatment_record'").dropDuplicates(["chunk_id"])
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source_document").orderBy("chunk_id")))
    return A.grounded_contexts(chunks.select("source_document"), rows, "source_document")


def image_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Sorted names of the classes in each picture."""
    return D.classes_per_image(made_masks(spark, folder)).select("image_index", "lesions", F.array_join("classes", "|").alias("classes"))


def first_images(spark: SparkSession, folder: str) -> DataFrame:
    """The first three events of each user: a sender's quota."""
    return A.first_per_key(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


def sample_row(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of the first chunk, values cut at 80 characters."""
    rows = table(spark, folder, "chunks").select("chunk_id", "ingested_at", "text", "source_document", "chunk_type", "word_count", "section")
    return A.sample_values(rows, ["chunk_id", "ingested_at"]).filter("field <> 'ingested_at'")


def request_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of every request of three pictures, each over its own pictures."""
    masks = made_masks(spark, folder)
    images = masks.select("image_index").distinct().withColumns({"orig_w": F.lit(30), "orig_h": F.lit(20), "request_id": F.expr("image_index div 3")})
    scores = masks.select("image_index", "det_id", "class_name", (F.col("det_id") % 100 / 100).alias("score"))
    found = D.findings(masks, scores, images, ("request_id",))
    return found.select("request_id", "class_name", "confidence", "lesions", "affected_pixels", F.round("affected_ratio", 9).alias("affected_ratio"), "severity", F.array_join("image_indices", "|").alias("images"))


QUERIES = {f.__name__: f for f in (diagnosis_states, vision_contexts, questions, panicle_reports, class_labels, file_errors, grounded_answers, image_classes, first_images, sample_row, request_findings)}


def _case(x: str, names: dict[str, object]) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then {v!r}" for k, v in names.items()) + " end"


_WORDS = A.Wording()
_FINDINGS = f"""
    e as (select user_id, coalesce(list_sort(list(distinct n) filter (where n is not null)), []) as found, cast(count(*) as integer) as lesion_count from (select user_id, {_case('event_type', _NAMES)} as n from events) group by user_id),
    f as (select user_id, case when user_id % 7 = 0 then [] else found end as diseases, case when user_id % 5 > 0 then found[1] end as disease_name, case when user_id % 11 > 0 then user_id % 101 / 100 end as confidence,
        lesion_count, user_id % 250 / 1000 as ratio, case when user_id % 250 / 1000 < 0.03 then 'LOW' when user_id % 250 / 1000 < 0.10 then 'MODERATE' when user_id % 250 / 1000 < 0.18 then 'HIGH' else 'CRITICAL' end as severity from e),
    s as (select *, case when len(diseases) > 0 then diseases when disease_name is not null then [disease_name] else [] end as targets from f)"""
_BAND = "case when r < 0.03 then 'LOW' when r < 0.10 then 'MODERATE' when r < 0.18 then 'HIGH' else 'CRITICAL' end"


def _percent(x: str) -> str:
    return f"printf('%.1f%%', round_even({x} * 100, 1))"


SQL = {
    "diagnosis_states": f"""
        with {_FINDINGS} select user_id, array_to_string(targets, '|') as targets, disease_name is not null as has_diagnosis, len(diseases) = 0 as is_healthy, len(targets) > 1 as is_coinfection,
            coalesce(confidence < 0.45, false) as is_low_confidence from s""",
    "vision_contexts": f"""
        with {_FINDINGS} select user_id, case when disease_name is null then '{_WORDS.nothing.replace("'", "''")}' else array_to_string(list_filter([
            'Current photo analysis:', '- Disease: ' || disease_name,
            case when len(targets) > 1 then '- Also detected on the same sample: ' || array_to_string(list_filter(targets, lambda t: t <> disease_name), ', ') end,
            case when confidence <> 0 then '- Confidence: ' || {_percent('confidence')} end, '- Severity: ' || severity, '- Lesions detected: ' || lesion_count,
            case when len(targets) > 1 then '{_WORDS.several}' end, case when confidence < 0.45 then '{_WORDS.unsure}' end], lambda t: t is not null), chr(10)) end as context from s""",
    "questions": f"""
        with {_FINDINGS}, o as (select *, array_to_string(list_filter(diseases, lambda t: t <> disease_name), ', ') as others from s where disease_name is not null)
        select user_id, 'The photo shows ' || disease_name || case when others <> '' then ', and also ' || others else '' end || '. Severity ' || severity || ', ' || {_percent('ratio')}
            || ' of the image shows lesions. {_WORDS.ask}' as question from o""",
    "panicle_reports": f"""
        with p as (select user_id as request_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as image_index, event_id % 101 / 100 as score from events),
        v as (select *, score > 0.5 as bad, case when score > 0.5 then score else 1 - score end as c, case when event_id % 3 > 0 then 'p' || event_id || '.jpg' else 'image ' || (image_index + 1) end as name from p where image_index < 6),
        l as (select *, '- ' || name || ': ' || case when bad then 'unhealthy' else 'healthy' end || ' at ' || {_percent('c')} || ' confidence' || case when abs(score - 0.5) < 0.10 then ' (borderline, near the decision threshold)' else '' end as line from v)
        select request_id, case when count(*) filter (where bad) > 0 then count(*) filter (where bad) || ' of ' || count(*) || ' panicles classified UNHEALTHY' else 'Good news! All ' || count(*) || ' panicle(s) classified HEALTHY' end as verdict,
            string_agg(line, chr(10) order by image_index) as per_image from l group by request_id""",
    "class_labels": f"""
        select distinct disease_name, coalesce({_case('disease_name', A.CLASS_LABELS)}, replace(disease_name, '_', ' ')) as label, {_case('disease_name', A.SCIENTIFIC_NAMES)} as scientific_name from chunks""",
    "file_errors": """
        with k as (select event_id, case event_type when 'click' then 'image/png' when 'view' then 'image/jpeg' when 'error' then 'image/gif' end as kind from events),
        c as (select event_id, case when event_id % 4 + 1 > 3 then 'too_many_images' when coalesce(kind, '') not in ('image/jpeg', 'image/jpg', 'image/png', 'image/webp') then 'unsupported_format' when event_id % 100 * 131072 > 8388608 then 'image_too_large' end as error_code from k)
        select error_code, case error_code when 'too_many_images' then 400 when 'image_too_large' then 413 when 'unsupported_format' then 500 end as error_status, count(*) as n,
            min(case when error_code is not null then 'file ' || event_id end) as one from c group by all""",
    "grounded_answers": f"""
        with t as (select distinct on (chunk_id) * from chunks where chunk_type = 'treatment_record'),
        r as (select *, row_number() over (partition by source_document order by chunk_id) as rank from t),
        p as (select source_document, rank, {PASSAGE_SQL} as p, {CITATION_SQL} as c from r),
        g as (select source_document, string_agg(p, chr(10) || chr(10) order by rank) as context, min_by('- ' || c, rank) as sources, count(*) as n from p group by source_document)
        select source_document, coalesce(context, 'No passages found.') as context, coalesce(sources, '') as sources, coalesce(n, 0) as n_passages, coalesce(n, 0) > 0 as grounded
        from (select distinct source_document from chunks) left join g using (source_document)""",
    "image_classes": "select cast(l_orderkey // 40 as integer) as image_index, count(*) as lesions, string_agg(distinct 'c' || (l_linenumber % 3), '|' order by 'c' || (l_linenumber % 3)) as classes from lineitem group by 1",
    "first_images": "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as k from events) where k <= 3",
    "sample_row": """
        with f as (select * from chunks order by chunk_id, ingested_at limit 1)
        select unnest(['chunk_id', 'text', 'source_document', 'chunk_type', 'word_count', 'section']) as field,
            unnest([left(chunk_id, 80), left(text, 80), left(source_document, 80), left(chunk_type, 80), left(word_count::varchar, 80), left(section, 80)]) as value from f""",
    "request_findings": f"""
        with {MASKS_SQL}, u as (select image_index // 3 as request_id, class_name, count(*) as px from (select distinct image_index, class_name, p from pixels) group by all),
        t as (select image_index // 3 as request_id, count(distinct image_index) * 600 as whole from masks group by all),
        s as (select image_index // 3 as request_id, class_name, max(det_id % 100 / 100) as confidence, count(*) as lesions, array_to_string(list_sort(list(distinct image_index)), '|') as images from masks group by all)
        select request_id, class_name, confidence, lesions, px as affected_pixels, round(px / whole, 9) as affected_ratio, {_BAND.replace('r <', 'px / whole <')} as severity, images from s join u using (request_id, class_name) join t using (request_id)""",
}
