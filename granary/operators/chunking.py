"""Sections to labelled chunks: packing sentences with overlap, dominant class, chunk type, the safety rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary import config
from granary.config import ChunkLimits
from granary.functions.text import matches, once, quick_hits, sentences, slug, word_count, words


def packed(text: Column, limits: ChunkLimits = ChunkLimits()) -> Column:
    """Array of chunk texts: sentences packed up to the target, each chunk starting with the last sentences of the
    one before that fit the overlap, a short tail folded into the last chunk.

    Longer sentences are first cut at word boundaries. A text within the target is its own only chunk; one
    without words gives an empty array if it is longer than nothing. Null gives null.
    """
    target, overlap, least = limits.target_words, limits.overlap_words, limits.least_words

    def runs(w: Column) -> Column:
        count = F.ceil(F.size(w) / target).cast("int")
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.slice(w, i * target + 1, target))).otherwise(F.array().cast("array<array<string>>"))

    def sized(w: Column) -> Column:
        return F.struct(F.array_join(w, " ").alias("s"), F.size(w).alias("n"))

    listed = F.transform(F.flatten(F.transform(F.transform(sentences(text), words), runs)), sized)
    none = F.array().cast("array<struct<s:string,n:int>>")
    zero = F.struct(F.array().cast("array<string>").alias("done"), none.alias("now"), F.lit(0).alias("n"))

    def tail_of(now: Column) -> Column:
        start = F.struct(none.alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("open"))

        def take(state: Column, s: Column) -> Column:
            fits = state["open"] & (state["n"] + s["n"] <= overlap)
            return F.struct(
                F.when(fits, F.concat(F.array(s), state["kept"])).otherwise(state["kept"]).alias("kept"),
                F.when(fits, state["n"] + s["n"]).otherwise(state["n"]).alias("n"), fits.alias("open"),
            )

        return F.aggregate(F.reverse(now), start, take)

    def joined(now: Column) -> Column:
        return F.array_join(F.transform(now, lambda s: s["s"]), " ")

    def step(state: Column, s: Column) -> Column:
        full = (F.size(state["now"]) > 0) & (state["n"] + s["n"] > target)
        longer = F.struct(state["done"].alias("done"), F.array_append(state["now"], s).alias("now"), (state["n"] + s["n"]).alias("n"))
        return F.when(full, once(tail_of(state["now"]), lambda back: opened(state, s, back))).otherwise(longer)

    def opened(state: Column, s: Column, back: Column) -> Column:
        done = F.array_append(state["done"], joined(state["now"]))
        return F.struct(done.alias("done"), F.array_append(back["kept"], s).alias("now"), (back["n"] + s["n"]).alias("n"))

    def finish(state: Column) -> Column:
        tail, done = joined(state["now"]), state["done"]
        fold = (F.size(done) > 0) & (state["n"] < least)
        last = F.concat(F.element_at(done, -1), F.lit(" "), tail)
        folded = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(last))
        return F.when(state["n"] == 0, done).when(fold, folded).otherwise(F.concat(done, F.array(tail)))

    return F.when(word_count(text) <= target, F.array(text)).when(text.isNotNull(), F.aggregate(listed, zero, step, finish))


def class_hits(text: Column, lexicon: dict[str, str]) -> Column:
    """Array of struct (n, neg_place, name): matches of each class, in the lexicon's order."""

    def counted(lower: Column) -> Column:
        return F.array(*(F.struct(quick_hits(text, lower, p).alias("n"), F.lit(-i).alias("neg_place"), F.lit(name).alias("name")) for i, (name, p) in enumerate(lexicon.items())))

    return once(F.lower(text), counted)


def dominant_class(text: Column, canonical: dict[str, str] | None = None, other: dict[str, str] | None = None, *, share: float = 0.6, least: int = 2) -> Column:
    """Struct (name, canonical) of the class with enough hits and a large enough share of all; (null, false) if none.

    Canonical classes are asked first; of equals the first of the lexicon counts.
    """
    counted = F.struct(class_hits(text, canonical or config.CHUNK_LEXICON).alias("a"), class_hits(text, other or config.OTHER_LEXICON).alias("b"))
    return once(counted, lambda c: dominant_of(c["a"], c["b"], share, least))


def dominant_of(a: Column, b: Column, share: float, least: int) -> Column:
    total = F.aggregate(F.concat(a, b), F.lit(0), lambda s, x: s + x["n"])
    counted = F.struct(F.array_max(a).alias("first"), F.array_max(b).alias("second"), total.alias("total"))
    return once(counted, lambda c: _dominant(c["first"], c["second"], c["total"], share, least))


def _dominant(first: Column, second: Column, total: Column, share: float, least: int) -> Column:
    def enough(best: Column) -> Column:
        return (best["n"] >= least) & (best["n"] / F.greatest(total, F.lit(1)) >= share)

    none = F.struct(F.lit(None).cast("string").alias("name"), F.lit(False).alias("canonical"))
    return (
        F.when(enough(first), F.struct(first["name"].alias("name"), F.lit(True).alias("canonical")))
        .when(enough(second), F.struct(second["name"].alias("name"), F.lit(False).alias("canonical")))
        .otherwise(none)
    )


def inoculation_flag(document_type: Column, text: Column) -> Column:
    return document_type.eqNullSafe(F.lit(config.SCREENING_TYPE)) & matches(text, config.INOCULATION)


def chunk_type(section: Column, text: Column, inoculation: Column, limits: ChunkLimits = ChunkLimits()) -> Column:
    """treatment_record if management is signposted and acted on, or acted on often; never for inoculation."""
    actions = once(F.lower(text), lambda lower: quick_hits(text, lower, config.ACTIONABLE))
    signposted = matches(section, config.MANAGEMENT_HEADING) | matches(text, config.MANAGEMENT_MARKER)
    managed = (signposted & (actions >= limits.actionable_signposted)) | (actions >= limits.actionable_plain)
    return F.when(managed & ~F.coalesce(inoculation, F.lit(False)), "treatment_record").otherwise("narrative")


def narrative_chunks(sections: DataFrame, documents: DataFrame, limits: ChunkLimits = ChunkLimits()) -> DataFrame:
    """``schemas.CHUNKS`` of sections. ``documents`` gives each filename document_title, organization, source_url,
    document_type and ocr_derived; sections of files that it lacks keep their chunks, with nulls there. Sections of one
    short part vanish; a chunk without class of its own has that of its heading and section."""
    whole = F.concat_ws(" ", F.coalesce("heading", F.lit("")), "text")
    rows = sections.join(documents, "filename", "left").withColumn("parent", dominant_class(whole, share=limits.parent_share, least=limits.parent_hits))
    rows = rows.withColumn("parts", packed(F.col("text"), limits)).withColumn("chunk_total", F.size("parts"))
    rows = rows.select(*(c for c in rows.columns if c not in ("text", "word_count")), F.posexplode("parts").alias("chunk_index", "text"))
    rows = rows.withColumn("word_count", word_count(F.col("text"))).filter((F.col("word_count") >= limits.least_words) | (F.col("chunk_total") > 1))
    rows = rows.withColumn("own", dominant_class(F.col("text"), share=limits.share, least=limits.hits))
    rows = rows.withColumn("label", F.when(F.col("own.name").isNotNull(), F.col("own")).otherwise(F.col("parent")))
    rows = rows.withColumn("is_inoculation_protocol", inoculation_flag(F.col("document_type"), F.col("text")))
    text_null = F.lit(None).cast("string")
    return rows.select(
        F.concat_ws(":", slug(F.col("filename")), F.col("section_index").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "text",
        F.col("filename").alias("source_document"), "document_title", F.coalesce("organization", F.lit("unknown")).alias("organization"), "source_url", "document_type", "ocr_derived",
        chunk_type(F.col("heading"), F.col("text"), F.col("is_inoculation_protocol"), limits).alias("chunk_type"),
        F.col("label.name").alias("disease_name"), F.col("label.canonical").alias("disease_name_is_canonical"), text_null.alias("source_disease_label"), F.col("heading").alias("section"),
        "page_start", "page_end", "word_count", "chunk_index", "chunk_total", "is_inoculation_protocol",
        *(text_null.alias(c) for c in ("symptom", "recommended_treatment", "active_ingredient", "dosage", "crop_stage")),
    )


def caption_chunks(captions: DataFrame, documents: DataFrame, limits: ChunkLimits = ChunkLimits()) -> DataFrame:
    """``schemas.CHUNKS`` of captions of figures."""
    rows = captions.join(documents, "filename", "left").withColumn("label", dominant_class(F.col("text"), share=limits.parent_share, least=limits.parent_hits))
    text_null = F.lit(None).cast("string")
    return rows.select(
        F.concat_ws(":", slug(F.col("filename")), F.lit("fig"), F.col("caption_index").cast("string")).alias("chunk_id"), "text", F.col("filename").alias("source_document"), "document_title",
        F.coalesce("organization", F.lit("unknown")).alias("organization"), "source_url", "document_type", "ocr_derived", F.lit("figure_caption").alias("chunk_type"),
        F.col("label.name").alias("disease_name"), F.col("label.canonical").alias("disease_name_is_canonical"), text_null.alias("source_disease_label"), text_null.alias("section"),
        F.col("page").alias("page_start"), F.col("page").alias("page_end"), word_count(F.col("text")).alias("word_count"), F.lit(0).alias("chunk_index"), F.lit(1).alias("chunk_total"), F.lit(False).alias("is_inoculation_protocol"),
        *(text_null.alias(c) for c in ("symptom", "recommended_treatment", "active_ingredient", "dosage", "crop_stage")),
    )


def class_coverage(pages: DataFrame, lexicon: dict[str, str] | None = None, *, share: float = 0.6) -> DataFrame:
    """(class_name, mentions, pages, primary_pages, treatment_pages, inoculation_only_pages, documents) over page texts
    (filename, text); ``documents`` maps file to mentions for its three largest."""
    from pyspark.sql.window import Window


    def with_total(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0), lambda s, x: s + x["n"])
        return F.transform(found, lambda c: F.struct(c["n"].alias("n"), c["name"].alias("name"), total.alias("total")))

    counted = pages.select("filename", "text", F.explode(once(class_hits(F.col("text"), lexicon or config.COVERAGE_LEXICON), with_total)).alias("c")).withColumn("total", F.col("c.total"))
    treat, inoc = matches(F.col("text"), config.COVERAGE_TREATMENT), matches(F.col("text"), config.COVERAGE_INOCULATION)
    found = counted.filter("c.n > 0").select("filename", F.col("c.name").alias("class_name"), F.col("c.n").alias("n"), (F.col("c.n") / F.col("total") >= share).alias("primary"), treat.alias("treat"), inoc.alias("inoc"))
    stats = found.groupBy("class_name").agg(
        F.sum("n").cast("bigint").alias("mentions"), F.count("*").alias("pages"), F.count_if("primary").alias("primary_pages"), F.count_if(F.col("primary") & F.col("treat")).alias("treatment_pages"),
        F.count_if(F.col("primary") & F.col("inoc") & ~F.col("treat")).alias("inoculation_only_pages"),
    )
    per = found.groupBy("class_name", "filename").agg(F.sum("n").cast("bigint").alias("n"))
    top = per.withColumn("place", F.row_number().over(Window.partitionBy("class_name").orderBy(F.desc("n"), "filename"))).filter("place <= 3")
    top = top.groupBy("class_name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("filename", "n")))).alias("documents"))
    return stats.join(top, "class_name")


def chunk_report(chunks: DataFrame) -> DataFrame:
    """One row: chunks, words, least, upper median and most words, treatment records, chunks without a class."""
    return chunks.agg(
        F.count("*").alias("n_chunks"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"), F.min("word_count").alias("least_words"),
        upper_median("word_count").alias("middle_words"),
        F.max("word_count").alias("most_words"), F.count_if(F.col("chunk_type") == "treatment_record").alias("treatment_records"), F.count_if(F.col("disease_name").isNull()).alias("unlabelled"),
    )


def upper_median(column: str) -> Column:
    """The element in place n // 2 of the sorted values, from a table of counts and not a list of all values."""
    return F.expr(f"-(percentile_disc(0.5) within group (order by -`{column}`))")
