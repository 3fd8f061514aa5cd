"""Checks of the chunk collection before and after it is loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary import config, schemas


def key_report(rows: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, null keys, whether the key is unique."""
    n, distinct = F.count("*"), F.count_distinct(key)
    return rows.agg(n.alias("n_rows"), distinct.alias("n_keys"), F.count_if(F.col(key).isNull()).alias("n_null"), (n == distinct).alias("is_unique"))


def class_report(chunks: DataFrame) -> DataFrame:
    """(disease_name, n_chunks, n_treatment) with the null class."""
    return chunks.groupBy("disease_name").agg(F.count("*").alias("n_chunks"), F.count_if(F.col("chunk_type") == "treatment_record").alias("n_treatment"))


def unsafe_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks that break the safety rule: an inoculation protocol typed as treatment."""
    return chunks.filter(F.coalesce("is_inoculation_protocol", F.lit(False)) & F.col("chunk_type").eqNullSafe(F.lit("treatment_record")))


def unexpected_classes(chunks: DataFrame, classes: tuple[str, ...] = config.CANONICAL_CLASSES) -> DataFrame:
    """Class names flagged canonical that aren't among ``classes``."""
    return chunks.filter(F.coalesce("disease_name_is_canonical", F.lit(False)) & ~F.col("disease_name").isin(*classes)).select("disease_name").distinct()


def label_sets(chunks: DataFrame, classes: tuple[str, ...] = config.CANONICAL_CLASSES) -> DataFrame:
    """(label, in_data, canonical): the labels of the data and the canonical ones, each once."""
    here = chunks.filter("disease_name is not null").select(F.col("disease_name").alias("label"), F.lit(True).alias("in_data"), F.lit(False).alias("canonical"))
    known = chunks.sparkSession.createDataFrame([(c, False, True) for c in classes], "label string, in_data boolean, canonical boolean")
    return here.distinct().unionByName(known).groupBy("label").agg(F.max("in_data").alias("in_data"), F.max("canonical").alias("canonical"))


def schema_gaps(columns: list[str]) -> tuple[list[str], list[str]]:
    """(columns the schema lacks, fields the rows lack)."""
    known = schemas.CHUNKS.fieldNames()
    return [c for c in columns if c not in known], [c for c in known if c not in columns]


def reconciled(source: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """One row: rows of both, keys missing from the loaded, keys not in the source."""
    one, two = source.select(key).distinct(), loaded.select(key).distinct()
    missing, extra = one.join(two, key, "left_anti").agg(F.count("*").alias("n")), two.join(one, key, "left_anti").agg(F.count("*").alias("n"))
    loaded_rows = loaded.agg(F.count("*").alias("n"))
    return source.agg(F.count("*").alias("source_rows")).withColumns({"loaded_rows": loaded_rows.scalar(), "missing": missing.scalar(), "extra": extra.scalar()})
