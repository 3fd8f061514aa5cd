"""Queries of keys that hold most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import balanced


def _summary(spark: SparkSession, folder: str, chunk_rows: int = 100_000) -> DataFrame:
    chunks = spark.read.parquet(f"{folder}/chunks.parquet").select("chunk_id", "disease_name", "organization", "ingested_at", "word_count", "document_type")
    rows = balanced.by_field(chunks, ["disease_name", "organization"])
    return balanced.per_key_summary(rows, ["field_name", "key_value"], "ingested_at", ["chunk_id", "document_type"], "word_count", "document_type", chunk_rows=chunk_rows)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return balanced.hot_keys(_summary(spark, folder)).select("field_name", "key_value")


def p5_key_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _summary(spark, folder).withColumn("max_gap_s", F.round("max_gap_s", 3))


def p5_small_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The same in chunks of 50 rows, so that states are merged over many boundaries even in small tables."""
    return _summary(spark, folder, 50).withColumn("max_gap_s", F.round("max_gap_s", 3))


QUERIES = {"p5_found": p5_found, "p5_key_summary": p5_key_summary, "p5_small_chunks": p5_small_chunks}

_LABEL = "coalesce(nullif(lower(trim(regexp_replace({0}, '[\\t-\\r \\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))), ''), '(none)')"
_KEYED = " union all ".join(f"select '{f}' as field_name, {_LABEL.format(f)} as key_value, chunk_id, ingested_at, word_count, document_type from chunks" for f in ("disease_name", "organization"))

SQL = {
    "p5_found": f"""
        select field_name, key_value from ({_KEYED}) group by field_name, key_value
        having count(*) >= 0.05 * (select count(*) from chunks)""",
    "p5_key_summary": f"""
        with keyed as ({_KEYED}),
        ordered as (
            select *, row_number() over w as place, lag(ingested_at) over w as before_at, lag(document_type) over w as before_type
            from keyed window w as (partition by field_name, key_value order by ingested_at nulls first, chunk_id nulls first, document_type nulls first))
        select field_name, key_value, count(*) as n_rows, cast(sum(word_count) as bigint) as total,
            min(ingested_at) as first_at, max(ingested_at) as last_at,
            round(max(epoch_us(ingested_at) - epoch_us(before_at)) / 1e6, 3) as max_gap_s,
            cast(sum(case when place > 1 and before_type is distinct from document_type then 1 else 0 end) as bigint) as n_changes
        from ordered group by field_name, key_value""",
}
SQL["p5_small_chunks"] = SQL["p5_key_summary"]
