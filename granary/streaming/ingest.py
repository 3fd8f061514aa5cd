"""Incremental ingest: a stream of chunk deliveries into a collection that has each chunk once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.sources.files import exists


def deliveries(spark: SparkSession, folder: str, schema: str, **options: str) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(folder)


#: Most folders that a collection may have; a batch lists those it touches.
_MOST_BUCKETS = 65_536


def merge_batch(target: str, key: str, at: str, buckets: int = 16):  # noqa: ANN201
    """A ``foreachBatch`` function: of each key the latest delivery stays, whichever batch brought it.

    The collection lies in ``buckets`` folders by hash of the key, and a batch rewrites only those it touches; choose so
    many that a folder holds about 128 MB, and far more than a batch has keys if most of it should stay untouched. A
    collection keeps the number it was made with. A repeated batch gives the same collection, so that a restart does no
    harm; what is written between goes when the batch is in.
    """
    if not 0 < buckets <= _MOST_BUCKETS:
        raise ValueError(f"buckets must be between 1 and {_MOST_BUCKETS}")

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        if exists(spark, target):
            held = spark.read.schema(rows.schema).parquet(target).filter(F.col("bucket").isin(touched))
            rows = rows.unionByName(held)
        everything = F.struct(F.col(at).alias("__at"), *(c for c in rows.columns if c != at))
        latest = rows.groupBy(key).agg(F.max(everything).alias("r")).select(F.col("r.__at").alias(at), *(f"r.{c}" for c in rows.columns if c != at))
        from granary.storage import released, stored

        with released():
            stored(latest.select(*rows.columns)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").option("partitionOverwriteMode", "dynamic").parquet(target)

    return merge


def start_ingest(stream: DataFrame, target: str, checkpoint: str, *, key: str = "chunk_id", at: str = "ingested_at", buckets: int = 16) -> StreamingQuery:
    """Run over everything that has arrived, then end; start it again for what came later."""
    return stream.writeStream.foreachBatch(merge_batch(target, key, at, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, at: str = "ingested_at", *, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Deliveries and distinct-free counts per window of arrival; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), "document_type").agg(F.count("*").alias("n")).select("w.start", "w.end", "document_type", "n")
