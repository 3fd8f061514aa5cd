"""What is told of a result: contexts for a model, verdicts, questions, labels, error codes, grounded answers.

Every function gives columns or rows; wording is a parameter with the shapes below as defaults.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.text import filled
from granary.operators.reports import LOW_CONFIDENCE, targets
from granary.operators.retrieval import NO_PASSAGES, context

# Names shown for the classes, and their scientific names.
CLASS_LABELS = {
    "Bacterial_Leaf_Blight": "Bacterial Leaf Blight", "Brown_Spot": "Brown Spot", "Leaf_Blast": "Leaf Blast",
    "Narrow_Brown": "Narrow Brown Leaf Spot", "Rice_Tungro": "Rice Tungro", "Sheath_Blight": "Sheath Blight",
}
SCIENTIFIC_NAMES = {
    "Bacterial_Leaf_Blight": "Xanthomonas oryzae pv. oryzae", "Brown_Spot": "Bipolaris oryzae", "Leaf_Blast": "Magnaporthe oryzae",
    "Narrow_Brown": "Cercospora janseana", "Rice_Tungro": "Rice tungro bacilliform/spherical virus", "Sheath_Blight": "Rhizoctonia solani",
}
SEVERITY_LABELS = {"LOW": "Low", "MODERATE": "Moderate", "HIGH": "High", "CRITICAL": "Critical"}
# Error codes and their status.
ERRORS = {
    "internal_error": 500, "invalid_image": 400, "image_too_large": 413, "too_many_images": 400, "model_not_loaded": 503, "inference_failed": 500, "no_detection": 422,
    "unknown_disease_class": 400, "retrieval_failed": 503, "embedding_failed": 503, "agent_failed": 502, "unsafe_content": 500,
}
# Kinds of files that are taken, most bytes, most files.
ACCEPTED_KINDS = ("image/jpeg", "image/jpg", "image/png", "image/webp")
MOST_BYTES, MOST_FILES = 8 << 20, 3


@dataclass(frozen=True)
class Wording:
    """Sentences around the facts."""

    nothing: str = "No picture has been analysed in this conversation; name no class as the sender's own."
    several: str = "- Several classes were found: give the steps for each of them apart."
    unsure: str = "- Confidence is low: call the finding provisional and say what would confirm it."
    ask: str = "Give practical management steps."


def percent(x: Column, digits: int = 1) -> Column:
    """A share as a percentage, halves rounded to even."""
    return F.format_string(f"%.{digits}f%%", F.bround(x * 100, digits))


def looked_up(key: Column, names: dict[str, str], otherwise: Column | None = None) -> Column:
    """The entry of a key in a small fixed table, or ``otherwise`` (null if not given)."""
    held = F.create_map(*(F.lit(x) for entry in names.items() for x in entry))
    return F.coalesce(F.try_element_at(held, key), F.lit(None).cast("string") if otherwise is None else otherwise)


def class_label(name: Column) -> Column:
    """The label of a class; of an unknown one its name with spaces for underscores."""
    return looked_up(name, CLASS_LABELS, F.replace(name, F.lit("_"), F.lit(" ")))


def scientific_name(name: Column) -> Column:
    return looked_up(name, SCIENTIFIC_NAMES)


def severity_label(level: Column) -> Column:
    return looked_up(level, SEVERITY_LABELS, level)


def with_state(rows: DataFrame) -> DataFrame:
    """``rows`` (diseases array<string>, disease_name, confidence) with ``targets``, ``has_diagnosis``, ``is_healthy`` (no
    class found), ``is_coinfection`` (more than one target) and ``is_low_confidence``; a null confidence isn't low."""
    told = targets(F.col("diseases"), F.col("disease_name"))
    return rows.withColumns({
        "targets": told, "has_diagnosis": F.col("disease_name").isNotNull(), "is_healthy": F.coalesce(F.size("diseases"), F.lit(0)) <= 0,
        "is_coinfection": F.size(told) > 1, "is_low_confidence": F.coalesce(F.col("confidence") < LOW_CONFIDENCE, F.lit(False)),
    })


def vision_context(words: Wording = Wording()) -> Column:
    """The facts of a row of ``with_state`` (with severity and lesion_count), a line each; facts that are null or, for the
    confidence, 0 are left out."""
    others = F.array_join(F.filter("targets", lambda x: x != F.col("disease_name")), ", ")
    lines = F.array(
        F.lit("Current photo analysis:"), F.concat(F.lit("- Disease: "), "disease_name"),
        F.when(F.col("is_coinfection"), F.concat(F.lit("- Also detected on the same sample: "), others)),
        F.when(F.col("confidence") != 0, F.concat(F.lit("- Confidence: "), percent(F.col("confidence")))), F.concat(F.lit("- Severity: "), "severity"),
        F.concat(F.lit("- Lesions detected: "), F.coalesce("lesion_count", F.lit(0)).cast("string")),
        F.when(F.col("is_coinfection"), F.lit(words.several)), F.when(F.col("is_low_confidence"), F.lit(words.unsure)),
    )
    return F.when(F.col("has_diagnosis"), F.array_join(F.array_compact(lines), "\n")).otherwise(F.lit(words.nothing))


def question(primary: Column, classes: Column, severity: Column, ratio: Column, words: Wording = Wording()) -> Column:
    """What is asked of a finding: the primary class, the others, severity and the share affected; null without a class."""
    others = F.array_join(F.array_except(classes, F.array(primary)), ", ")
    also = F.when(others != "", F.concat(F.lit(", and also "), others)).otherwise("")
    return F.concat(F.lit("The photo shows "), primary, also, F.lit(". Severity "), severity, F.lit(", "), percent(ratio), F.lit(" of the image shows lesions. "), F.lit(words.ask))


def panicle_reports(verdicts: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, verdict, per_image): how many pictures are unhealthy, and a line for each in their order. ``verdicts`` are rows
    of ``panicle_verdicts`` with ``filename``; a picture without name has its number, from 1."""
    name = F.coalesce(filled(F.col("filename")), F.concat(F.lit("image "), (F.col("image_index") + 1).cast("string")))
    note = F.when(F.col("uncertain"), " (borderline, near the decision threshold)").otherwise("")
    line = F.concat(F.lit("- "), name, F.lit(": "), F.col("label"), F.lit(" at "), percent(F.col("confidence")), F.lit(" confidence"), note)
    told = verdicts.withColumn("__line", line).groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("label") == "unhealthy").alias("bad"), F.sort_array(F.collect_list(F.struct("image_index", "__line"))).alias("lines"))
    verdict = F.when(F.col("bad") > 0, F.format_string("%d of %d panicles classified UNHEALTHY", "bad", "n")).otherwise(F.format_string("Good news! All %d panicle(s) classified HEALTHY", "n"))
    return told.select(key, verdict.alias("verdict"), F.array_join(F.transform("lines", lambda x: x["__line"]), "\n").alias("per_image"))


def grounded_contexts(requests: DataFrame, results: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, context, sources, n_passages, grounded) of every request: those without results are not grounded, and their
    context says so. One request's lack of results takes nothing from the others."""
    told = context(results, [key])
    rows = requests.select(key).distinct().join(told, key, "left").fillna(0, ["n_passages"])
    return rows.select(key, F.coalesce("context", F.lit(NO_PASSAGES)).alias("context"), F.coalesce("sources", F.lit("")).alias("sources"), "n_passages", (F.col("n_passages") > 0).alias("grounded"))


def merged_outcomes(requests: DataFrame, outcomes: list[DataFrame], key: str) -> DataFrame:
    """``requests`` with whatever each table of outcomes (key, value, ...) has for them, nulls where one has nothing: what
    fails in one is not lost in another."""
    for one in outcomes:
        requests = requests.join(one, key, "left")
    return requests


def status(code: Column) -> Column:
    """The status of an error code; null for none, 500 for an unknown one."""
    held = F.create_map(*(F.lit(x) for entry in ERRORS.items() for x in entry))
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(held, code), F.lit(500)))


def failures(rows: DataFrame, code: Column, message: Column) -> DataFrame:
    """``rows`` with ``error_code``, ``error_status`` and ``error_message``, null where nothing failed."""
    return rows.withColumns({"error_code": code, "error_status": status(code), "error_message": F.when(code.isNotNull(), message)})


def file_error(kind: Column, n_bytes: Column, held: Column, incoming: Column, most: int = MOST_FILES) -> Column:
    """Why a sender's file isn't taken, or null: too many with those already held, another kind, too large."""
    return F.when(held + incoming > most, "too_many_images").when(~F.coalesce(kind.isin(*ACCEPTED_KINDS), F.lit(False)), "unsupported_format").when(n_bytes > MOST_BYTES, "image_too_large")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str], n: int = MOST_FILES) -> DataFrame:
    """The first ``n`` rows of each key: a sender's quota."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")


def sample_values(rows: DataFrame, order: list[str], n: int = 1, chars: int = 80) -> DataFrame:
    """(field, value): the columns of the first ``n`` rows with their values as text, cut at ``chars``."""
    first = rows.orderBy(*order).limit(n)
    entries = [F.struct(F.lit(c).alias("field"), F.substring(F.col(c).cast("string"), 1, chars).alias("value")) for c in rows.columns]
    return first.select(F.explode(F.array(*entries)).alias("e")).select("e.field", "e.value")


def clusters(rows: DataFrame, column: str) -> DataFrame:
    """(column, n): how many rows share each value, null and empty as ``unknown``."""
    return rows.groupBy(F.coalesce(filled(F.trim(column)), F.lit("unknown")).alias(column)).agg(F.count("*").alias("n"))
