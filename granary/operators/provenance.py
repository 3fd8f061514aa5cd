"""Where documents come from: manifest overlay, front matter, types, names that don't fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import filled, matches, once

# Titles that are none, publishers in imprints and by name, types of documents.
TITLE_JUNK = r"^(untitled|microsoft word|doc\d*|print|\s*)$"
IMPRINTS = {
    "IRRI": r"(?s)(International Rice Research Institute|\bIRRI\b)[^.\n]{0,60}(Los Ba[nñ]os|Philippines|©|copyright|publish)|(©|copyright|published by)[^.\n]{0,60}(International Rice Research Institute|\bIRRI\b)",
    "FAO": r"(?s)(©|copyright|published by)[^.\n]{0,60}(Food and Agriculture Organization|\bFAO\b)",
    "FEDEArroz": r"FEDEARROZ|Federaci[oó]n Nacional de Arroceros",
}
PUBLISHERS = {"University of Arkansas": r"University of Arkansas|Arkansas Rice Production Handbook", "LSU AgCenter": r"LSU|Louisiana State University|AgCenter"}
TYPES = (
    ("research_paper", r"(?s)\babstract\b.{0,4000}\breferences\b"),
    ("field_guide", r"field guide|identification guide|handbook"),
    ("bulletin", r"bulletin|extension|fact ?sheet"),
)
OCR_MARK = "OCR"
# Frequent words by which a language is told.
STOP_WORDS = {
    "en": ("the", "and", "of", "in", "is", "to", "that", "was", "for", "with"),
    "es": ("el", "la", "de", "que", "los", "las", "una", "por", "con", "para"),
    "fr": ("le", "les", "des", "est", "une", "dans", "que", "pour", "sur", "du"),
    "id": ("yang", "dan", "di", "dengan", "untuk", "pada", "dari", "ini", "tidak", "oleh"),
}


def overlaid(rows: DataFrame, overrides: DataFrame, parents: DataFrame, default_parent: str | None, *, name_col: str = "filename") -> DataFrame:
    """``rows`` with verified_title, manifest_organization, organization_evidence, parent_work, source_url, warning,
    ocr_derived and manifest_type from the manifest.

    A missing file, or one without parent entry, has the default parent; an explicit null has none; an unknown
    parent gives nothing. The override's organization goes before the parent's; empty ones count as missing.
    A file listed more than once counts with its smallest row.
    """
    one = overrides.groupBy("filename").agg(F.min(F.struct(*(c for c in overrides.columns if c != "filename"))).alias("o")).select(F.col("filename").alias("__file"), "o.*")
    held = one.select(
        "__file", F.col("verified_title"), F.col("organization").alias("__org"), F.col("document_type").alias("manifest_type"), F.col("has_parent_work").alias("__has"), F.col("parent_work").alias("__parent"),
        "warning", F.col("ignore_embedded_metadata_title").alias("title_rejected"),
    )
    known = parents.groupBy("parent_work").agg(F.min(F.struct("organization", "source_url")).alias("p")).select(F.col("parent_work").alias("__key"), F.col("p.organization").alias("__parent_org"), F.col("p.source_url").alias("source_url"))
    joined = rows.drop("source_url").join(held, F.col(name_col) == F.col("__file"), "left")
    joined = joined.withColumn("parent_work", F.when(F.coalesce("__has", F.lit(False)), F.col("__parent")).otherwise(F.lit(default_parent)))
    joined = joined.join(known, F.col("parent_work") == F.col("__key"), "left")
    own, parent = filled(F.col("__org")), filled(F.col("__parent_org"))
    evidence = F.when(own.isNotNull(), "manifest_override").when(parent.isNotNull(), "manifest_parent_work")
    joined = joined.withColumns({"manifest_organization": F.coalesce(own, parent), "organization_evidence": evidence, "ocr_derived": F.coalesce(F.contains("warning", F.lit(OCR_MARK)), F.lit(False)), "title_rejected": F.coalesce("title_rejected", F.lit(False))})
    return joined.drop("__file", "__org", "__has", "__parent", "__key", "__parent_org")


def first_substantial_line(head: Column) -> Column:
    """The first line of at least 12 characters with a letter; empty if there is none."""
    lines = F.filter(F.transform(F.split(head, "\r?\n"), F.trim), lambda x: (F.length(x) >= 12) & x.rlike(r"\p{L}"))
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def verified_title(meta_title: Column, head: Column) -> Column:
    title = F.trim(F.coalesce(meta_title, F.lit("")))
    return F.substring(F.when(matches(title, TITLE_JUNK) | (F.length(title) < 5), first_substantial_line(head)).otherwise(title), 1, 200)


def publisher(head: Column, author: Column, title: Column) -> Column:
    """Struct (organization, evidence): an imprint first, then a publisher's name in the front matter."""
    blob = F.concat_ws(" ", F.substring(head, 1, 3000), author)
    named = F.concat_ws(" ", blob, title)
    out = None
    for patterns, text, why in ((IMPRINTS, blob, "imprint"), (PUBLISHERS, named, "publisher_name_in_frontmatter")):
        for name, pattern in patterns.items():
            value = F.struct(F.lit(name).alias("organization"), F.lit(why).alias("evidence"))
            out = F.when(matches(text, pattern), value) if out is None else out.when(matches(text, pattern), value)
    return out.otherwise(F.struct(F.lit("undetermined").alias("organization"), F.lit("none_in_frontmatter").alias("evidence")))


def document_type(title: Column, sample: Column, table_pages: Column, page_count: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", title, sample))
    (paper, p1), (guide, p2), (bulletin, p3) = TYPES
    short = (page_count <= 40) & ((table_pages > 0) | matches(blob, p3))
    return F.when(matches(blob, p1), paper).when(matches(blob, p2), guide).when(short, bulletin).otherwise("other")


def language(text: Column, least_chars: int = 200) -> Column:
    """The language whose frequent words occur most; of equals the first. ``unknown`` for short texts or none."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

    def votes_for(code: str, place: int) -> Column:
        n = F.size(F.filter(tokens, lambda w: w.isin(*STOP_WORDS[code])))
        return F.struct(n.alias("n"), F.lit(-place).alias("p"), F.lit(code).alias("lang"))

    votes = F.array(*(votes_for(code, i) for i, code in enumerate(STOP_WORDS)))
    best = F.array_max(votes)
    return F.when((F.length(text) >= least_chars) & (best["n"] > 0), best["lang"]).otherwise("unknown")


def is_initialism(stem: Column, title: Column) -> Column:
    """Whether a part of the file name of two letters or more stands among the initials of the title's words."""
    initials = F.lower(F.array_join(F.transform(F.regexp_extract_all(title, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.substring(w, 1, 1)), ""))
    return F.coalesce(F.exists(F.regexp_extract_all(stem, F.lit("[A-Za-z]{2,}"), F.lit(0)), lambda w: F.contains(initials, F.lower(w))), F.lit(False))


def name_mismatch(stem: Column, title: Column, sample: Column) -> Column:
    """What is wrong if file name and title share no longer word: which of them the text supports. Null if fine."""
    return name_finding(stem, title, topic_support(F.translate(stem, "-_", "  "), sample), topic_support(title, sample))


def _topics(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 3))


def topic_support(name: Column, text: Column) -> Column:
    """How many words of a text begin with a longer word of a name. The counts of a document's parts add up."""
    body = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return once(_topics(name), lambda topics: F.aggregate(body, F.lit(0), lambda s, b: s + F.size(F.filter(topics, lambda w: F.startswith(b, w)))))


def name_finding(stem: Column, title: Column, name_hits: Column, title_hits: Column) -> Column:
    """``name_mismatch`` from the support of the file name's and the title's words in the whole document."""
    by_name, by_title = _topics(F.translate(stem, "-_", "  ")), _topics(title)
    fine = (F.length(title) < 5) | is_initialism(stem, title) | (F.size(by_name) == 0) | (F.size(by_title) == 0) | F.arrays_overlap(by_name, by_title)
    agrees = F.format_string("file name '%s' agrees with the text (%d), title '%s' doesn't (%d)", stem, name_hits, title, title_hits)
    differs = F.format_string("file name '%s' disagrees with the text (%d), title '%s' agrees (%d)", stem, name_hits, title, title_hits)
    return F.when(~F.coalesce(fine, F.lit(True)), F.when(name_hits >= title_hits, agrees).otherwise(differs))


def mentions(text: Column, patterns: dict[str, str]) -> Column:
    """Map of name to number of matches."""
    from granary.functions.text import hits

    return F.create_map(*(x for name, pattern in patterns.items() for x in (F.lit(name), hits(text, pattern))))
