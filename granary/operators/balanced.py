"""Per-key results when a few keys hold most records.

Rows are ranged by key and order, so a hot key spreads over many partitions. The keys of each partition are
counted, prefix sums over the partitions give every run of a key its offset, and with it each row its number
within its key. Equal chunks of consecutive numbers are then processed apart, and the states at their
boundaries are merged in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.text import label_key
from granary.storage import stored

#: Runs (partition, key) that may be sent to every executor; about 100 bytes each.
_RUNS_TO_SEND = 200_000


def numbered_by_key(rows: DataFrame, keys: list[str], order: list[str], *, chunk_rows: int = 100_000, weight: str | None = None) -> DataFrame:
    """``rows`` with ``row_no`` (from 0 within the key, in ``order``) and ``chunk_no`` (``row_no`` div
    ``chunk_rows``) added, and with ``weight`` also ``weight_before``, the exact sum of it over the key's
    earlier rows (nulls count 0).

    Null keys form a key of their own; null order values come first; rows equal in ``order`` are numbered in
    input order. No rows are dropped and no key is gathered in one task. Columns of these names are replaced.
    """
    rows = rows.drop("row_no", "chunk_no", "weight_before", "__part", "__seq", "__tie").withColumn("__tie", F.monotonically_increasing_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *keys, *order, "__tie").sortWithinPartitions(*keys, *order, "__tie").drop("__tie")
    ranged = stored(ranged.withColumns({"__part": F.spark_partition_id(), "__seq": F.monotonically_increasing_id()}))
    runs = ranged.groupBy("__part", *keys).agg(F.count("*").alias("__rows"), F.min("__seq").alias("__from"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__offset", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    runs = stored(runs.select(F.col("__part").alias("__p"), *(F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)), "__from", "__offset"))
    if runs.count() <= _RUNS_TO_SEND:
        runs = F.broadcast(runs)
    same = F.col("__part") == F.col("__p")
    for n, key in enumerate(keys):
        same &= F.col(key).eqNullSafe(F.col(f"__k{n}"))
    numbered = ranged.join(runs, same).withColumn("row_no", F.col("__offset") + F.col("__seq") - F.col("__from"))
    numbered = numbered.withColumn("chunk_no", F.expr(f"row_no div {int(chunk_rows)}"))
    numbered = numbered.drop("__part", "__seq", "__p", "__from", "__offset", *(f"__k{n}" for n in range(len(keys))))
    return numbered if weight is None else _with_weight_before(numbered, keys, weight)


def _with_weight_before(numbered: DataFrame, keys: list[str], weight: str) -> DataFrame:
    worth = F.coalesce(F.col(weight), F.lit(0))
    inside = Window.partitionBy(*keys, "chunk_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    sums = numbered.groupBy(*keys, "chunk_no").agg(F.sum(worth).alias("__sum"))
    sums = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
    sums = sums.select(*(F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)), F.col("chunk_no").alias("__c"), "__base")
    same = F.col("chunk_no") == F.col("__c")
    for n, key in enumerate(keys):
        same &= F.col(key).eqNullSafe(F.col(f"__k{n}"))
    local = numbered.withColumn("__in", F.coalesce(F.sum(worth).over(inside), F.lit(0)))
    summed = local.join(sums, same).withColumn("weight_before", F.col("__in") + F.col("__base"))
    return summed.drop("__in", "__base", "__c", *(f"__k{n}" for n in range(len(keys))))


def per_key_summary(rows: DataFrame, keys: list[str], at: str, order: list[str], value: str, group: str, *, chunk_rows: int = 100_000) -> DataFrame:
    """One row per key over its rows in the order (``at``, ``order``): n_rows, total (of ``value``), first_at,
    last_at, max_gap_s (largest time between neighbours, null for fewer than two) and n_changes (neighbours
    whose ``group`` differs; null equals null).

    ``at`` is a timestamp; rows where it is null come first, count everywhere but make no gap. Null values
    add nothing; a key of null values alone has a null total.
    """
    needed = rows.select(*dict.fromkeys([*keys, at, *order, value, group]))
    numbered = numbered_by_key(needed, keys, [at, *order], chunk_rows=chunk_rows)
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.timestamp_diff("MICROSECOND", start, F.col(at).cast("timestamp_ntz")) / F.lit(1_000_000)
    step = Window.partitionBy(*keys, "chunk_no").orderBy("row_no")
    stepped = numbered.withColumns({"__s": seconds, "__b": F.lag(F.struct(seconds.alias("s"), F.col(group).alias("g"))).over(step)})
    stepped = stepped.withColumns({
        "__gap": F.col("__s") - F.col("__b.s"),
        "__turn": (F.col("__b").isNotNull() & ~F.col("__b.g").eqNullSafe(F.col(group))).cast("bigint"),
        "__here": F.struct(F.col("row_no"), F.col("__s").alias("s"), F.col(group).alias("g")),
    })
    states = stepped.groupBy(*keys, "chunk_no").agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min(at).alias("first_at"), F.max(at).alias("last_at"),
        F.max("__gap").alias("gap"), F.sum("__turn").alias("turns"), F.min("__here").alias("head"), F.max("__here").alias("tail"),
    )
    merged = states.withColumn("__b", F.lag("tail").over(Window.partitionBy(*keys).orderBy("chunk_no")))
    across = (F.col("__b").isNotNull() & ~F.col("__b.g").eqNullSafe(F.col("head.g"))).cast("bigint")
    merged = merged.withColumns({"gap": F.greatest("gap", F.col("head.s") - F.col("__b.s")), "turns": F.col("turns") + across})
    return merged.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.sum("total").alias("total"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
        F.max("gap").alias("max_gap_s"), F.sum("turns").alias("n_changes"),
    )


def by_field(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Each row once for each field: ``field_name``, ``key_value`` (its normal form) before the row's columns."""
    entries = [F.struct(F.lit(f).alias("field_name"), label_key(F.col(f)).alias("key_value")) for f in fields]
    kept = rows.drop("field_name", "key_value")
    return kept.select(F.explode(F.array(*entries)).alias("__f"), "*").select("__f.field_name", "__f.key_value", *(c for c in kept.columns))


def hot_keys(summary: DataFrame, share: Column | float = 0.05) -> DataFrame:
    """The keys of ``per_key_summary`` over ``by_field`` that have at least ``share`` of their field's rows."""
    of = summary.groupBy("field_name").agg(F.sum("n_rows").alias("__of"))
    kept = summary.join(of, "field_name").filter(F.col("n_rows") >= share * F.col("__of"))
    return kept.select("field_name", "key_value", "n_rows", (F.col("n_rows") / F.col("__of")).alias("share"))
