"""Mixing sources to target weights.

Documents of a source are put in a permuted order and cut into blocks. A source's quota of blocks, every
repetition counted, is divided among the output shards by a tree: each node halves its shards and draws from
the multivariate hypergeometric distribution what goes left. Shards then take disjoint runs of the permuted
blocks and are shuffled locally.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import word_count
from granary.operators.balanced import numbered_by_key
from granary.storage import stored

#: Sources times shards of the quota table, which the driver makes and every executor receives.
_MOST_QUOTAS = 4_000_000


@lru_cache(4)
def _tokenizer(path: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


def token_count(docs: DataFrame, text_col: str, tokenizer: str | None, into: str) -> DataFrame:
    """``docs`` with the size of each text: words if ``tokenizer`` is None, else tokens of the tokenizer file at
    that path. Null texts have 0."""
    if tokenizer is None:
        return docs.withColumn(into, F.coalesce(word_count(F.col(f"`{text_col}`")), F.lit(0)).cast("bigint"))
    kept = docs.drop(into)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(tokenizer)
        for batch in batches:
            sizes: list[int] = []
            for first in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch[text_col].slice(first, 256).to_pylist()]
                sizes += [len(e.ids) for e in coder.encode_batch(texts, add_special_tokens=False)]
            yield batch.append_column(into, pa.array(sizes, pa.int64()))

    return kept.mapInArrow(count, T.StructType([*kept.schema.fields, T.StructField(into, T.LongType())]))


def split_quotas(units: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(sources x shards) shares of ``units``: shards of equal size, to one unit, drawn without replacement."""
    if units.sum() >= 1_000_000_000:
        raise ValueError("a billion blocks or more; use a larger block_docs")
    out = np.zeros((len(units), shards), np.int64)
    waiting = [(0, shards, units.astype(np.int64))]
    while waiting:
        first, last, here = waiting.pop()
        if last - first == 1:
            out[:, first] = here
            continue
        half = (first + last) // 2
        size = round(int(here.sum()) * (half - first) / (last - first))
        left = rng.multivariate_hypergeometric(here, size, method="marginals") if here.sum() else here
        waiting += [(first, half, left), (half, last, here - left)]
    return out


class Mixture:
    """The drawn mix: ``draws`` and ``report``. See ``mix_sources``."""

    def __init__(self, draws: DataFrame, report: DataFrame) -> None:
        self.draws, self.report = draws, report


def mix_sources(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    *, tokenizer: str | None = None, total_tokens: int | None = None, shards: int = 16, block_docs: int = 64, seed: int = 11,
) -> Mixture:
    """Draw a mix in which every source of ``targets`` (source, target_share, max_repeats) has its share.

    ``total_tokens`` is the size aimed at, by default the tokens of all documents of listed sources. A source
    gives ``target_share`` of it, to the document in which it is reached, or ``max_repeats`` times all it has,
    if that is less.

    ``draws`` (id, source, n_tokens, copy, block, shard, shuffle_key): one row per use of a document; a shard
    in the order of ``shuffle_key`` is shuffled. ``report`` (source, n_docs, tokens, target_share,
    max_repeats, wanted_tokens, most_tokens, reachable, drawn_tokens, reached, actual_share): one row per target;
    ``reachable`` is told from the sizes, ``reached`` from what the shards drew, and both agree.

    Documents of null or unlisted sources are not drawn; null and empty texts have no tokens and are drawn with
    their block. Null ids are kept as they are; repeated rows are drawn each. Of targets, rows of null source
    are left out, equal rows count once, of different rows for a source the largest values hold, a null share
    is 0 and a null number of repeats 1. Without documents nothing is drawn and shares are 0.
    """
    spark = docs.sparkSession
    goals = targets.select(F.col("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("bigint")).filter("source is not null")
    goals = goals.groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
    goals = stored(goals)
    if goals.count() * shards > _MOST_QUOTAS:
        raise ValueError("too many sources times shards for one quota table; use fewer shards")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.join(F.broadcast(goals.select("source")), "source", "left_semi")
    sized = token_count(rows, "text", tokenizer, "n_tokens").select("id", "source", "n_tokens")
    sized = sized.withColumn("turn", F.xxhash64(F.lit(seed), "source", F.col("id").cast("string")))
    sized = stored(sized)  # ranging samples its input first; texts are read and measured once
    placed = stored(numbered_by_key(sized, ["source"], ["turn", "id"], chunk_rows=block_docs, weight="n_tokens"))

    totals = placed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"), (F.max("chunk_no") + 1).alias("blocks"))
    plan = goals.join(F.broadcast(totals), "source", "left").fillna(0, ["n_docs", "tokens", "blocks"])
    whole = F.lit(total_tokens) if total_tokens is not None else F.lit(placed.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])
    plan = plan.withColumns({"wanted_tokens": F.col("target_share") * whole, "most_tokens": F.col("tokens") * F.col("max_repeats")})
    plan = stored(plan.withColumn("reachable", F.col("most_tokens") >= F.col("wanted_tokens")))

    quota = F.least(F.col("wanted_tokens"), F.col("most_tokens").cast("double"))
    copies = F.when(F.col("tokens") > 0, F.ceil((quota - F.col("weight_before")) / F.col("tokens"))).otherwise(0)
    copies = F.least(F.greatest(copies, F.lit(0)), F.col("max_repeats"))
    used = placed.join(F.broadcast(plan.select("source", "tokens", "blocks", "max_repeats", "wanted_tokens", "most_tokens")), "source")
    used = used.withColumn("copies", copies).filter("copies > 0")
    used = used.select("id", "source", "n_tokens", F.col("chunk_no").alias("block"), "blocks", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"))
    used = stored(used.withColumn("unit", F.col("copy") * F.col("blocks") + F.col("block")).drop("blocks"))

    units = {r["source"]: r["units"] for r in used.groupBy("source").agg((F.max("unit") + 1).alias("units")).collect()}  # one row per target
    names = sorted(units)
    bounds = np.cumsum(split_quotas(np.array([units[n] for n in names], np.int64), shards, np.random.default_rng(seed)), axis=1)
    told = spark.sparkContext.broadcast({n: bounds[i] for i, n in enumerate(names)})

    @F.pandas_udf("int")
    def shard_of(source: pd.Series, unit: pd.Series) -> pd.Series:
        out = np.zeros(len(unit), np.int32)
        for name, at in source.groupby(source).indices.items():
            out[at] = np.searchsorted(told.value[name], unit.to_numpy()[at], side="right")
        return pd.Series(out)

    draws = used.withColumn("shard", shard_of("source", "unit")).drop("unit")
    draws = draws.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "source", F.col("id").cast("string"), "copy"))
    drawn = stored(draws.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens")))  # one row per target
    report = plan.join(F.broadcast(drawn), "source", "left").fillna(0, ["drawn_tokens"]).drop("blocks")
    report = report.withColumn("reached", F.col("drawn_tokens") >= F.col("wanted_tokens"))
    every = F.lit(drawn.agg(F.coalesce(F.sum("drawn_tokens"), F.lit(0))).first()[0])
    return Mixture(draws, report.withColumn("actual_share", F.when(every > 0, F.col("drawn_tokens") / every).otherwise(0.0)))


def shard_order(draws: DataFrame, shards: Column | int = 16) -> DataFrame:
    """``draws`` with each shard in one partition, locally shuffled: ready to be written."""
    return draws.repartition(shards, "shard").sortWithinPartitions("shard", "shuffle_key")
