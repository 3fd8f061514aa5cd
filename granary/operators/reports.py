"""Small reports and forms over results: samples, rankings, labels, log records, names on the wire."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.text import filled

# Lower bounds of the labels of a confidence, and the longest message.
CONFIDENCE = ((0.85, "high"), (0.65, "medium"))
LOW_CONFIDENCE = 0.45
MOST_CHARS = 4000


def top_per_key(rows: DataFrame, keys: list[str], by: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in the order ``by``, with ``place``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return rows.withColumn("place", place).filter(F.col("place") <= n)


def thinnest(documents: DataFrame, n: int = 6) -> DataFrame:
    """The ``n`` documents with most thin pages, and only then without those that have none."""
    return documents.orderBy(F.size("thin_pages").desc(), "filename").limit(n).filter(F.size("thin_pages") > 0)


def samples(audited: DataFrame, per_page: int = 2, per_document: int = 5) -> DataFrame:
    """(filename, samples): captions, at most so many of a page and of a document, in page order."""
    first = F.sort_array(F.collect_list(F.struct("page", F.slice("captions", 1, per_page).alias("c"))))
    return audited.groupBy("filename").agg(F.slice(F.flatten(F.transform(first, lambda x: x["c"])), 1, per_document).alias("samples"))


def top_detection(detections: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the detection of largest score, ties by det_id."""
    return top_per_key(detections, keys, [F.desc("score"), F.col("det_id")], 1).drop("place")


def any_rows(rows: DataFrame) -> bool:
    """Whether there is a row; reads no more than it takes to know."""
    return not rows.limit(1).isEmpty()


def confidence_label(x: Column) -> Column:
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for bound, name in CONFIDENCE:
        out = out.when(x >= bound, name)
    return out.otherwise("low")


def targets(diseases: Column, single: Column) -> Column:
    """The diseases of a request: the list, or the single one if the list is empty."""
    return F.when(F.coalesce(F.size(diseases), F.lit(0)) > 0, diseases).when(filled(single).isNotNull(), F.array(single)).otherwise(F.array().cast("array<string>"))


def message_error(message: Column) -> Column:
    """Why a message is refused, or null: it must have 1 to 4000 characters."""
    return F.when(F.coalesce(F.length(message), F.lit(0)) == 0, "empty_message").when(F.length(message) > MOST_CHARS, "message_too_long")


def joined_blocks(*blocks: Column) -> Column:
    """The blocks that are neither null nor empty, with a blank line between."""
    return F.concat_ws("\n\n", *(filled(b) for b in blocks))


def wire_names(rows: DataFrame) -> DataFrame:
    """Columns from snake_case to camelCase."""
    return rows.toDF(*(re.sub(r"_([a-z0-9])", lambda m: m[1].upper(), c) for c in rows.columns))


def log_record(**fields: Column) -> Column:
    """A JSON record; null fields are left out."""
    return F.to_json(F.struct(*(c.alias(name) for name, c in fields.items())))


def encoded(rows: DataFrame, text: Column, load: Callable[[], Callable[[list[str]], list[list[float]]]], dim: int, into: str = "vector") -> DataFrame:
    """``rows`` with unit vectors of ``text`` in ``into``, null for a zero vector. ``load`` makes the encoder, once per
    task; vectors of another length than ``dim`` are an error."""

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = load()
        for batch in batches:
            made = coder(batch.tolist())
            if any(len(v) != dim for v in made):
                raise ValueError(f"encoder gave vectors of another length than {dim}")
            values = np.array(made, np.float64).reshape(-1, dim)
            lengths = np.linalg.norm(values, axis=1, keepdims=True)
            yield pd.Series([row if length else None for row, length in zip((values / np.where(lengths > 0, lengths, 1)).tolist(), lengths[:, 0] > 0, strict=True)])

    return rows.withColumn(into, F.pandas_udf(encode, "array<float>")(text))
