"""What the queries share: tables, and text in SQL as in ``functions.text``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Bytes per core below which a table is dealt out before work that takes far longer than reading it.
_SPREAD_BYTES = 32 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of a small table dealt to all cores: a file of one row group is one task however many cores wait. Tables of
    more bytes than ``_SPREAD_BYTES`` a core have row groups enough and stay as they are. Columns that aren't used and rows
    that are filtered later don't take part."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < _SPREAD_BYTES * cores else rows


WHITE_SQL = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def collapsed_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WHITE_SQL}', ' ', 'g'))"


def words_sql(x: str) -> str:
    """Number of words."""
    return f"(case when {collapsed_sql(x)} = '' then 0 else len(string_split({collapsed_sql(x)}, ' ')) end)"


def hits_sql(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '(?i){pattern}'))"
