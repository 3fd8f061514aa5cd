"""Reading and writing: JSON artifacts, binary files, chunk collections."""

from __future__ import annotations

from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary import schemas


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array or lines under an explicit schema; no rows if the file is missing."""
    return spark.read.schema(schema).json(path, multiLine=True) if exists(spark, path) else spark.createDataFrame([], schema)


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str | None]:
    """(overrides, parents, default parent) of a manifest file. A missing parent entry and an explicit null one are
    told apart by ``has_parent_work``; a missing file gives empty tables."""
    text = spark.read.text(path, wholetext=True) if exists(spark, path) else spark.createDataFrame([], "value string")
    fields = "struct<verified_title:string,organization:string,document_type:string,parent_work:string,source_url:string,warning:string,ignore_embedded_metadata_title:boolean>"
    shape = f"overrides map<string,{fields}>, parent_works map<string,struct<organization:string,source_url:string>>, default_parent_work string"
    parsed = text.select(F.from_json("value", shape).alias("m"), F.from_json(F.get_json_object("value", "$.overrides"), "map<string,string>").alias("raw"))
    over = parsed.select("raw", F.explode("m.overrides").alias("filename", "o"))
    keys = F.json_object_keys(F.element_at("raw", F.col("filename")))
    over = over.select("filename", "o.verified_title", "o.organization", "o.document_type", F.coalesce(F.array_contains(keys, "parent_work"), F.lit(False)).alias("has_parent_work"), "o.parent_work", "o.source_url", "o.warning", "o.ignore_embedded_metadata_title")
    parents = parsed.select(F.explode("m.parent_works").alias("parent_work", "p")).select("parent_work", "p.organization", "p.source_url")
    row = parsed.select("m.default_parent_work").first()
    return over, parents, row[0] if row else None


def binary_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(filename, path, length, content) of matching files; order by filename where it matters."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "length", "content")


def labelled_images(spark: SparkSession, folder: str, *, validation: float = 0.16, seed: int = 123) -> DataFrame:
    """(path, label, split, content): the label is the file's folder; the split is by hash and thus repeatable."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    part = F.pmod(F.xxhash64(F.lit(seed), "path"), F.lit(10_000)) < int(validation * 10_000)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("label"), F.when(part, "validation").otherwise("training").alias("split"), "content")


def request_images(parts: DataFrame, keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """Parts (keys, field, content) of requests whose field begins with ``image_``, numbered within each request by name as
    text: image_10 before image_2. Without a column of ``keys`` the parts are those of one request. The numbers are made
    of the names alone; the pictures' bytes are not sorted with them."""
    from pyspark.sql.window import Window

    keys = tuple(k for k in keys if k in parts.columns)
    kept = parts.filter(F.col("field").startswith("image_"))
    listed = kept.groupBy(*keys).agg(F.sort_array(F.collect_list("field")).alias("__fields"))
    joined = kept.join(listed, [*keys]) if keys else kept.withColumn("__fields", listed.select("__fields").scalar())
    same = F.row_number().over(Window.partitionBy(*keys, "field").orderBy("field")) if keys else F.lit(1)  # a field that came twice
    return joined.withColumn("image_index", (F.array_position("__fields", F.col("field")) + same - 2).cast("int")).drop("__fields")


def image_error(length: Column, width: Column, height: Column, *, most_bytes: int = 8 << 20, least_side: int = 32, most_side: int = 4096) -> Column:
    """Why a picture is refused, or null."""
    return (
        F.when(F.coalesce(length, F.lit(0)) == 0, "empty_image").when(length > most_bytes, "image_too_large")
        .when(width.isNull() | height.isNull(), "not_an_image").when((F.least(width, height) < least_side), "image_too_small").when(F.greatest(width, height) > most_side, "image_too_large")
    )


def header_size(content: bytes | None) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, or of a JPEG's first frame; None for other content."""
    if content is None:
        return None
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")
    at = 2 if content[:2] == b"\xff\xd8" else len(content)
    while at + 9 < len(content) and content[at] == 0xFF:
        kind = content[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame: precision, height, width
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        at += 2 if kind == 0xFF or 0xD0 <= kind <= 0xD9 else 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    return None


def image_size(content: Column) -> Column:
    """Struct (width, height) from the header of a PNG or JPEG; nulls for other content."""

    def sizes(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([header_size(v) or (None, None) for v in values], columns=["width", "height"]).astype("Int32")

    return F.pandas_udf(sizes, "width int, height int")(content)


def data_uri(content: Column, kind: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def write_artifact(df: DataFrame, path: str, *, json: bool = False) -> None:
    """Parquet, and a JSON export beside it if asked for."""
    df.write.mode("overwrite").parquet(path)
    if json:
        df.write.mode("overwrite").json(str(PurePosixPath(path).with_suffix("")) + "_json")


def to_collection(chunks: DataFrame, vectors: DataFrame, *, dim: int = 64) -> tuple[DataFrame, DataFrame]:
    """(rows for the collection, quarantine with reason): fields of the schema only, each chunk with its vector."""
    from granary.functions.vectors import usable

    fields = [c for c in schemas.CHUNKS.fieldNames() if c in chunks.columns]
    joined = chunks.select(*fields).join(vectors.select("chunk_id", "vector"), "chunk_id", "left")
    reason = (
        F.when(F.col("chunk_id").isNull(), "no chunk_id").when(F.coalesce(F.trim("text"), F.lit("")) == "", "no text").when(F.col("vector").isNull(), "no vector")
        .when(~usable(F.col("vector"), dim), "unusable vector").when(F.coalesce("is_inoculation_protocol", F.lit(False)) & (F.col("chunk_type") == "treatment_record"), "unsafe")
    )
    marked = joined.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def create_collection(rows: DataFrame, table: str, *, partition_by: str | None = None) -> None:
    """Create the table; an existing one is an error and stays as it is."""
    if rows.sparkSession.catalog.tableExists(table):
        raise ValueError(f"collection {table} exists")
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).saveAsTable(table)
