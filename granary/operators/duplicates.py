"""Texts that repeat: exact copies, and pairs that share many word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import shingles
from granary.functions.text import shingle_hashes
from granary.storage import stored


def exact_duplicates(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, class_id, copies): every id with the smallest id of its text and the number of ids that have it.

    Null texts are no copies of each other and come with class_id = id."""
    rows = texts.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit(1), text_col).alias("h2"), F.col(text_col).isNull().alias("none")).distinct()
    classes = rows.filter("not none").groupBy("h1", "h2").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    known = rows.filter("not none").join(classes, ["h1", "h2"]).select("id", "class_id", "copies")
    return known.unionByName(rows.filter("none").select("id", F.col("id").alias("class_id"), F.lit(1).cast("bigint").alias("copies")))


def latest_rows(rows: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """Of each key the row with the latest ``at``, then the largest ``ties``; null times count as oldest."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(at), *(F.desc_nulls_last(t) for t in ties))
    return rows.withColumn("__place", F.row_number().over(order)).filter("__place = 1").drop("__place")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the first row in ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")


def _distinct_texts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): of identical texts the one with the smallest id."""
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    return rows.groupBy(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")).agg(F.min_by("text", "id").alias("text"), F.min("id").alias("id")).select("id", "text")


def near_copies(texts: DataFrame, id_col: str, text_col: str = "text", *, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_a < id_b, shared, similarity): different texts whose sets of ``k``-word shingles have a Jaccard similarity of at
    least ``similarity``. Words are runs of letters and digits in lower case; a text of fewer than ``k`` is one shingle, one
    without words takes no part.

    The pairs are those of representatives: identical texts are one, the smallest id, and ``exact_duplicates`` gives the
    class of every id. Both texts of such a pair have a shingle in common among their first ``size - ceil(similarity x size)
    + 1`` from rare to common, and neither is shorter than ``similarity`` of the other: only such texts meet, and no pair is
    lost.
    """
    sets = _distinct_texts(texts, id_col, text_col).select("id", shingle_hashes(F.col("text"), k, between=r"[^\p{L}\p{N}]+", short=True).alias("grams"))
    sets = stored(sets.filter("size(grams) > 0").withColumn("size", F.size("grams")))
    grams = sets.select("id", "size", F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("docs")).filter("docs > 1")
    met = stored(grams.join(often, "gram"))  # shingles of one text alone come first in its order and meet no other
    alone = met.groupBy("id").agg(F.count("*").alias("common"))
    ranked = met.join(alone, "id").withColumn("place", F.col("size") - F.col("common") + F.row_number().over(Window.partitionBy("id").orderBy("docs", "gram")))
    first = ranked.filter(F.col("place") <= F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9) + 1).select("id", "size", "gram")
    other = first.select("gram", F.col("id").alias("id_b"), F.col("size").alias("size_b"))
    alike = (F.col("size") >= F.lit(similarity) * F.col("size_b") - 1e-9) & (F.col("size_b") >= F.lit(similarity) * F.col("size") - 1e-9)
    pairs = first.join(other, "gram").filter((F.col("id") < F.col("id_b")) & alike).select(F.col("id").alias("id_a"), "id_b").distinct()
    left = sets.select(F.col("id").alias("id_a"), F.col("grams").alias("a"))
    right = sets.select(F.col("id").alias("id_b"), F.col("grams").alias("b"))
    scored = pairs.join(left, "id_a").join(right, "id_b").withColumn("shared", F.size(F.array_intersect("a", "b")))
    scored = scored.withColumn("similarity", F.col("shared") / (F.size("a") + F.size("b") - F.col("shared")))
    return scored.filter(F.col("similarity") >= similarity).select("id_a", "id_b", "shared", "similarity")


#: Texts at most that tell which shingles are common; copies of texts at most that are broadcast; shingles of a
#: block, and texts that are told apart at once.
_SAMPLE_TEXTS, _MOST_COPIES, _BLOCK_SHINGLES, _TEXTS_AT_ONCE = 4_096, 1_000_000, 3 << 18, 2_000


def _without_copies(texts: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(id, text) without texts that a smaller id has, and about how many these are; only hashes move, texts stay where they
    are read."""
    hashes = (F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null").select("id", "text", *hashes)
    keys = stored(rows.select("id", "h1", "h2"))
    first = keys.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = stored(keys.join(first, ["h1", "h2"]).filter("id > first").select("id", "h1", "h2").distinct())
    known = copies.count()
    return rows.join(F.broadcast(copies) if known <= _MOST_COPIES else copies, ["id", "h1", "h2"], "left_anti").select("id", "text"), keys.count() - known


def near_duplicates(texts: DataFrame, id_col: str, text_col: str = "text", *, k: int = 8, least_words: int = 60, overlap: float = 0.30) -> DataFrame:
    """(id_a < id_b, shared, overlap): texts of ``least_words`` or more words of a-z of which at least ``overlap`` of
    the smaller one's ``k``-word shingles stand in the other.

    Identical texts are compared once, through the one with the smallest id, and count as one text; their ids are
    in ``exact_duplicates``. The sets of shingles are stored once, in blocks of many texts, and every block meets every
    block in a task of its own: no pair is stored or shuffled but those of the result. Prefix filtering keeps common
    shingles from making pairs (``shingles.in_common``); a sample of the texts only tells which shingles are common, thus
    the order, and any order loses no pair.
    """
    rows, total = _without_copies(texts, id_col, text_col)
    lower = rows.select("id", F.lower("text").cast("binary").alias("text"))
    spark = texts.sparkSession

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, _TEXTS_AT_ONCE) for b in batches for i in range(0, b.num_rows, _TEXTS_AT_ONCE)):
            yield pa.RecordBatch.from_arrays([pa.array(shingles.shingles(b["text"], k, least_words)[1].view(np.int64))], ["gram"])

    some = lower.filter(F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(max(1, total // _SAMPLE_TEXTS))) == 0)
    often = some.mapInArrow(listed, "gram bigint").groupBy("gram").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "gram").limit(1 << 20).toPandas().sort_values("gram")
    common = spark.sparkContext.broadcast((often["gram"].to_numpy(np.int64), often["n"].to_numpy(np.int64)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, ns = common.value
        ids, sizes, sets, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            made = pa.concat_arrays(ids)
            listed = pa.ListArray.from_arrays(pa.array([0, len(made)], pa.int32()), made)
            return pa.RecordBatch.from_arrays([listed, pa.array([np.concatenate(sizes).astype(np.int32).tobytes()]), pa.array([np.concatenate(sets).tobytes()])], ["ids", "sizes", "grams"])

        for b in (b.slice(i, _TEXTS_AT_ONCE) for b in batches for i in range(0, b.num_rows, _TEXTS_AT_ONCE)):
            text, gram = shingles.shingles(b["text"], k, least_words)
            if not len(text):
                continue
            signed = gram.view(np.int64)
            at = np.minimum(np.searchsorted(grams, signed), max(len(grams) - 1, 0))
            rank = np.where(grams[at] == signed, ns[at], 0) if len(grams) else np.zeros(len(gram), np.int64)
            order = shingles.in_order(np.minimum(rank, 65_535))
            order = order[shingles.in_order(text[order])]  # by text, rank and hash
            size = np.bincount(text, minlength=b.num_rows)
            ids.append(b["id"].filter(pa.array(size > 0)))
            sizes.append(size[size > 0])
            sets.append(gram[order])
            held += len(gram)
            if held >= _BLOCK_SHINGLES:
                yield row()
                ids, sizes, sets, held = [], [], [], 0
        if held:
            yield row()

    kind = dict(rows.dtypes)["id"]
    blocks = stored(lower.mapInArrow(packed, f"ids array<{kind}>, sizes binary, grams binary").withColumn("block", F.monotonically_increasing_id()))
    few = blocks.coalesce(max(1, (blocks.count() + 1) // 2))
    left, right = (few.select(*(F.col(c).alias(f"{c}_{x}") for c in ("block", "ids", "sizes", "grams"))) for x in "ab")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, shingles.Block] = {}

        def of(r: pa.RecordBatch, x: str, i: int) -> shingles.Block:
            name = r[f"block_{x}"][i].as_py()
            if name not in known:
                while len(known) > 2:
                    del known[next(iter(known))]
                known[name] = shingles.Block(np.frombuffer(r[f"grams_{x}"][i].as_buffer(), np.uint64), np.frombuffer(r[f"sizes_{x}"][i].as_buffer(), np.int32), overlap)
            return known[name]

        for r in batches:
            for i in range(r.num_rows):
                a, b, same = of(r, "a", i), of(r, "b", i), r["block_a"][i].equals(r["block_b"][i])
                ids_a, ids_b = r["ids_a"][i].values, r["ids_b"][i].values
                for x, y, ids_x, ids_y, ties in ((a, b, ids_a, ids_b, True), *([] if same else [(b, a, ids_b, ids_a, False)])):
                    for s, t, shared in shingles.in_common(x, y, overlap, same=same, ties=ties):
                        part = shared / x.size[s]
                        yield pa.RecordBatch.from_arrays([ids_x.take(pa.array(s)), ids_y.take(pa.array(t)), pa.array(shared.astype(np.int32)), pa.array(part)], ["s", "l", "shared", "overlap"])

    with _rows_a_batch(spark, 1):  # a row holds two blocks
        found = stored(left.join(right, F.col("block_a") <= F.col("block_b")).mapInArrow(meet, f"s {kind}, l {kind}, shared int, overlap double"))
    return found.select(F.least("s", "l").alias("id_a"), F.greatest("s", "l").alias("id_b"), "shared", "overlap").filter("id_a < id_b").distinct()


@contextmanager
def _rows_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
