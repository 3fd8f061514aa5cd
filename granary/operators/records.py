"""Verified table records: exploding, sentences, checking against the page they were copied from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary import config
from granary.functions.text import contains_in_order, decomposed, filled, for_checking, word_count

# Fields that must stand on the page, and the own words that are exempt.
CHECKED = ("fungicide", "active_ingredient", "rate_per_acre", "cultivar_reaction", "percent_positive_stops", "percent_infected_tillers")
EXEMPT = ("See shared guidance for Table 11-4: twice-applied, late boot and 50%-75% heading.",)


def table_records(tables: DataFrame) -> DataFrame:
    """Rows of nested tables: table columns, ``record_index``, ``record_total`` and the record's fields."""
    rows = tables.select("table_id", "page", "caption", F.col("disease_name").alias("table_disease"), F.size("records").alias("record_total"), F.posexplode("records").alias("record_index", "r"))
    label = filled(F.col("r.disease_name"), F.col("table_disease"))
    return rows.select("table_id", "page", "caption", "record_index", "record_total", label.alias("disease_name"), "r.source_disease_label", *(f"r.{c}" for c in (*CHECKED, "comments")))


def record_text(caption: Column) -> Column:
    """The sentence of a record of ``table_records``: one shape for a product, one for a threshold."""
    comments = F.coalesce("comments", F.lit(""))

    def or_na(name: str) -> Column:
        return F.coalesce(filled(F.col(name)), F.lit("n/a"))

    product = F.concat(
        caption, F.lit(" For "), F.coalesce("source_disease_label", "disease_name", F.lit("None")), F.lit(": apply "), F.col("fungicide"), F.lit(" (active ingredient "),
        F.coalesce("active_ingredient", F.lit("")), F.lit(") at "), F.coalesce("rate_per_acre", F.lit("")), F.lit(" per acre. "), comments,
    )
    threshold = F.concat(
        caption, F.lit(" For a cultivar rated "), F.coalesce("cultivar_reaction", F.lit("")), F.lit(", the treatment threshold is "), or_na("percent_positive_stops"),
        F.lit("% positive stops and "), or_na("percent_infected_tillers"), F.lit("% infected tillers. "), comments,
    )
    return F.trim(F.when(F.col("fungicide").isNotNull(), product).otherwise(threshold))


def treatment_chunks(tables: DataFrame, source: dict[str, str], prefix: str = "records") -> DataFrame:
    """``schemas.CHUNKS`` of all records; ``source`` has document, document_title and organization."""
    rows = table_records(tables).withColumn("text", record_text(F.col("caption")))
    product = F.col("fungicide").isNotNull()
    none = F.lit(None).cast("string")
    return rows.select(
        F.concat_ws(":", F.lit(prefix), F.replace("table_id", F.lit(" "), F.lit("-")), F.col("record_index").cast("string")).alias("chunk_id"), "text",
        F.lit(source["document"]).alias("source_document"), F.lit(source["document_title"]).alias("document_title"), F.lit(source["organization"]).alias("organization"), none.alias("source_url"),
        F.lit("bulletin").alias("document_type"), F.lit(True).alias("ocr_derived"), F.lit("treatment_record").alias("chunk_type"), "disease_name",
        F.coalesce(F.col("disease_name").isin(*config.CHUNK_LEXICON), F.lit(False)).alias("disease_name_is_canonical"), "source_disease_label", F.col("table_id").alias("section"),
        F.col("page").alias("page_start"), F.col("page").alias("page_end"), word_count(F.col("text")).alias("word_count"), F.col("record_index").alias("chunk_index"), F.col("record_total").alias("chunk_total"),
        F.lit(False).alias("is_inoculation_protocol"), none.alias("symptom"), F.when(product, F.col("fungicide")).alias("recommended_treatment"), F.when(product, F.col("active_ingredient")).alias("active_ingredient"),
        F.when(product, F.col("rate_per_acre")).alias("dosage"), F.when(~product, F.col("comments")).alias("crop_stage"),
    )


def verified(tables: DataFrame, pages: DataFrame) -> DataFrame:
    """(table_id, page, record_index, field, value, found): every checked value with whether its page holds it.

    Labels are cut at the first bracket. Empty and exempt values aren't checked; a missing page holds nothing."""
    rows = table_records(tables).withColumn("label", F.trim(F.substring_index("source_disease_label", "(", 1)))
    values = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in CHECKED), F.struct(F.lit("source_disease_label").alias("field"), F.col("label").alias("value")))
    asked = rows.select("table_id", "page", "record_index", F.explode(values).alias("v")).select("table_id", "page", "record_index", "v.field", "v.value")
    asked = asked.filter((F.coalesce("value", F.lit("")) != "") & ~F.col("value").isin(*EXEMPT)).withColumn("__v", for_checking(decomposed(F.col("value"))))
    texts = pages.select(F.col("page").alias("__p"), for_checking(decomposed(F.col("text"))).alias("__t"))
    joined = asked.join(texts, F.col("page") == F.col("__p"), "left")
    return joined.withColumn("found", F.coalesce(contains_in_order(F.col("__v"), F.col("__t")), F.lit(False))).drop("__v", "__t", "__p")


def verification_report(checked: DataFrame) -> DataFrame:
    """One row: values checked, found, failed."""
    return checked.agg(F.count("*").alias("checked"), F.count_if("found").alias("confirmed"), F.count_if(~F.col("found")).alias("failed"))
