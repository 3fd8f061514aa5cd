"""Filtered vector search for one or many requests, merging of results, citations and passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary import config
from granary.config import RetrievalLimits
from granary.functions.text import filled
from granary.functions.vectors import cosine, usable
from granary.storage import stored

INTENTS = ("treatment", "reference", "unfiltered")
NO_PASSAGES = "No passages found."
#: Requests that are sent to every executor at once (64 floats each: about 6 MB); more go in blocks.
_REQUEST_BLOCK = 20_000
#: Blocks that one pass over the rows holds.
_BLOCKS_AT_ONCE = 8


def clamped_k(k: Column, limits: RetrievalLimits = RetrievalLimits()) -> Column:
    """Null and 0 mean the default; others are brought within 1 and the maximum."""
    asked = F.when(k.isNull() | (k == 0), limits.default_k).otherwise(k)
    return F.least(F.greatest(asked, F.lit(1)), F.lit(limits.most_k))


def safe(document_type: Column, flag: Column) -> Column:
    """What may be shown for treatment or reference: no inoculation protocol, no screening manual. Null flags are false."""
    return ~F.coalesce(flag, F.lit(False)) & ~document_type.eqNullSafe(F.lit(config.SCREENING_TYPE))


def metadata_filter(disease: str | None, intent: str, limits: RetrievalLimits = RetrievalLimits()) -> tuple[Column, list[str]]:
    """(condition, readable clauses). An unknown intent or class is an error; an equality never matches null."""
    if intent not in INTENTS:
        raise ValueError(f"unknown intent {intent!r}")
    if disease is not None and disease not in limits.classes:
        raise ValueError(f"unknown class {disease!r}")
    condition, clauses = F.lit(True), []
    if intent != "unfiltered":
        condition &= safe(F.col("document_type"), F.col("is_inoculation_protocol"))
        clauses += ["is_inoculation_protocol == False", f"document_type != {config.SCREENING_TYPE}"]
    if disease is not None:
        condition &= F.col("disease_name") == disease
        clauses.append(f"disease_name == {disease}")
    return condition, clauses


def top_k(chunks: DataFrame, query: list[float], k: int | None = None, disease: str | None = None, intent: str = "reference", limits: RetrievalLimits = RetrievalLimits()) -> DataFrame:
    """The ``k`` chunks (with ``vector``) of largest cosine that pass the filter, with ``score``; ties by chunk_id."""
    condition, _ = metadata_filter(disease, intent, limits)
    k = min(max(k or limits.default_k, 1), limits.most_k)
    asked = F.array(*(F.lit(float(x)) for x in query))
    scored = chunks.filter(condition & usable(F.col("vector"), len(query))).withColumn("score", cosine(F.col("vector"), asked))
    return scored.filter("score is not null").orderBy(F.desc("score"), "chunk_id").limit(k)


class _Best:
    """The ``k`` best (score, name) of each of ``n`` queries; of equal scores the smallest names."""

    def __init__(self, n: int, k: int, names: np.dtype) -> None:
        self.score, self.name = np.full((n, k), -np.inf), np.zeros((n, k), names)

    def offer(self, row: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        k = self.score.shape[1]
        who = np.unique(row)
        if name.dtype.itemsize > self.name.dtype.itemsize:
            self.name = self.name.astype(name.dtype)
        r = np.concatenate([row, np.repeat(who, k)])
        s = np.concatenate([score, self.score[who].ravel()])
        n = np.concatenate([name, self.name[who].ravel()])
        order = np.lexsort((n, -s, r))
        r, s, n = r[order], s[order], n[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        kept = place < k
        self.score[r[kept], place[kept]], self.name[r[kept], place[kept]] = s[kept], n[kept]

    def candidates(self, some: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``scores`` (of the queries ``some``) that may be among the best."""
        top = min(self.score.shape[1], scores.shape[1])
        cut = np.maximum(-np.partition(-scores, top - 1, axis=1)[:, top - 1], self.score[some, -1])
        return np.nonzero((scores >= cut[:, None]) & (scores > -np.inf))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = np.nonzero(self.score > -np.inf)
        return r, self.name[r, c], self.score[r, c]


def _query_blocks(queries: DataFrame, key: str) -> list[list[pa.Table]]:
    """The queries in blocks of about ``_REQUEST_BLOCK``, several for one pass over the rows that are searched."""
    queries = stored(queries)
    n = max(1, -(-queries.count() // _REQUEST_BLOCK))
    told = (queries.filter(F.pmod(F.xxhash64(key), F.lit(n)) == block).toArrow() for block in range(n))
    tables = [t for t in told if t.num_rows]
    return [tables[i : i + _BLOCKS_AT_ONCE] for i in range(0, len(tables), _BLOCKS_AT_ONCE)]


def request_results(requests: DataFrame, chunks: DataFrame, limits: RetrievalLimits = RetrievalLimits()) -> DataFrame:
    """(request_id, rank, chunk_id, score) of all requests against all chunks (chunk_id, disease_name, document_type,
    is_inoculation_protocol, vector), chunk ids once each.

    Null and empty diseases mean any; unknown ones match nothing; a null or unknown intent is reference. Requests
    and chunks without a usable vector get or give nothing. Requests go in blocks of bounded size, several in one
    pass over the chunks: matrix products score each batch of chunks against them, and a task keeps the best of every
    request over all it reads, so that at most ``most_k`` rows per request and task are shuffled.
    """
    dim, most = limits.dim, limits.most_k
    asked = requests.filter(usable(F.col("query_vector"), dim) & F.col("request_id").isNotNull()).select(
        "request_id", F.col("query_vector").alias("q"), filled(F.trim("disease_name")).alias("disease"), F.coalesce(F.col("intent") == "unfiltered", F.lit(False)).alias("open"), clamped_k(F.col("top_k"), limits).alias("k"))
    rows = chunks.filter(usable(F.col("vector"), dim) & F.col("chunk_id").isNotNull()).select("chunk_id", "vector", "disease_name", safe(F.col("document_type"), F.col("is_inoculation_protocol")).alias("ok"))
    spark = requests.sparkSession
    passes = _query_blocks(asked, "request_id")
    rows = stored(rows) if len(passes) > 1 else rows
    schema = "request_id string, chunk_id string, score double, k int"
    found = spark.createDataFrame([], schema)
    for blocks in passes:
        shared = [spark.sparkContext.broadcast(_Requests(told, dim)) for told in blocks]

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            best = [_Best(len(b.value.ids), most, np.dtype("S1")) for b in shared]
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = batch["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                ok = batch["ok"].to_numpy(zero_copy_only=False).astype(bool)
                label = np.array(batch["disease_name"].to_pylist(), object)
                name = np.array([x.encode() for x in batch["chunk_id"].to_pylist()])
                for b, kept in zip(shared, best, strict=True):
                    b.value.offer(v, label, ok, name, kept)
            for b, kept in zip(shared, best, strict=True):
                r, name, score = kept.rows()
                columns = [pa.array(b.value.ids[r], pa.string()), pa.array([x.decode() for x in name.tolist()], pa.string()), pa.array(score), pa.array(b.value.k[r].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["request_id", "chunk_id", "score", "k"])

        found = found.unionByName(rows.mapInArrow(search, schema))
    found = found.withColumn("score", F.round("score", 12)).dropDuplicates(["request_id", "chunk_id"])
    best = Window.partitionBy("request_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(best)).filter((F.col("rank") <= most) & (F.col("rank") <= F.col("k"))).select("request_id", "rank", "chunk_id", "score")


class _Requests:
    """A block of requests: unit vectors, and which of them ask for which class."""

    def __init__(self, told: pa.Table, dim: int) -> None:
        self.ids = np.array(told["request_id"].to_pylist(), object)
        self.q = told["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        self.q /= np.linalg.norm(self.q, axis=1, keepdims=True)
        self.free, self.k = told["open"].to_numpy(zero_copy_only=False).astype(bool), told["k"].to_numpy()
        disease = np.array(told["disease"].to_pylist(), object)
        self.anyone = np.flatnonzero([d is None for d in disease])
        self.wanted = {d: np.flatnonzero(disease == d) for d in {x for x in disease if x is not None}}

    def offer(self, v: np.ndarray, label: np.ndarray, ok: np.ndarray, name: np.ndarray, kept: _Best) -> None:
        told: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for asking, held in [(self.anyone, np.arange(len(v)))] + [(at, np.flatnonzero(label == d)) for d, at in self.wanted.items()]:
            for use, who in ((held[ok[held]], asking[~self.free[asking]]), (held, asking[self.free[asking]])):
                for start in range(0, len(who) if len(use) else 0, 512):
                    some = who[start : start + 512]
                    scores = np.round(self.q[some] @ v[use].T, 12)
                    i, j = kept.candidates(some, scores)
                    told.append((some[i], scores[i, j], name[use[j]]))
        if told:
            kept.offer(*(np.concatenate(x) for x in zip(*told, strict=True)))


def query_results(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of all queries (query_id, q and, where only rows of one label may come, label)
    against all rows (vec_id, embedding, label): the ``k`` largest inner products, rounded to 9 places, ties by vec_id.

    A row is no result of the query of its own id. Queries go in blocks of bounded size, as in ``request_results``.
    """
    labelled = "label" in queries.columns
    spark = rows.sparkSession
    asked = queries.filter("query_id is not null and q is not null").withColumn("q", F.col("q").cast("array<double>")).select("query_id", "q", *([F.col("label").cast("string")] if labelled else []))
    searched = rows.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"), *([F.col("label").cast("string")] if labelled else []))
    schema = "query_id bigint, vec_id bigint, score double"
    found = spark.createDataFrame([], schema)
    for blocks in _query_blocks(asked, "query_id"):
        shared = [
            spark.sparkContext.broadcast((t["query_id"].to_numpy().astype(np.int64), np.array(t["q"].to_pylist(), np.float64), np.array(t["label"].to_pylist(), object) if labelled else None)) for t in blocks
        ]

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            best = [_Best(len(b.value[0]), k, np.dtype(np.int64)) for b in shared]
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = batch["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                name = batch["vec_id"].to_numpy()
                held = np.array(batch["label"].to_pylist(), object) if labelled else None
                for b, kept in zip(shared, best, strict=True):
                    ids, q, label = b.value
                    for start in range(0, len(q), 256):
                        some = np.arange(start, min(start + 256, len(q)))
                        scores = np.round(q[some] @ v.T, 9)
                        scores[ids[some][:, None] == name] = -np.inf
                        if labelled:
                            scores[label[some][:, None] != held] = -np.inf
                        i, j = kept.candidates(some, scores)
                        kept.offer(some[i], scores[i, j], name[j])
            for b, kept in zip(shared, best, strict=True):
                r, name, score = kept.rows()
                yield pa.RecordBatch.from_arrays([pa.array(b.value[0][r]), pa.array(name), pa.array(score)], names=["query_id", "vec_id", "score"])

        found = found.unionByName(searched.mapInArrow(search, schema))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def merged_first_wins(results: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of chunks that several searches found, the first in ``order`` (search, then rank); not sorted again."""
    place = F.row_number().over(Window.partitionBy(*keys, "chunk_id").orderBy(*order))
    return results.withColumn("__n", place).filter("__n = 1").drop("__n")


def merged_by_score(results: DataFrame, keys: list[str], order: list[str], keep: int) -> DataFrame:
    """First-wins, then the ``keep`` best scores per key (null counts 0), with their ``place``."""
    merged = merged_first_wins(results, keys, order)
    best = Window.partitionBy(*keys).orderBy(F.coalesce("score", F.lit(0.0)).desc(), *order, "chunk_id")
    return merged.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= keep)


def safety_violations(results: DataFrame) -> DataFrame:
    """Rows that should never have come through the filter."""
    return results.filter(~safe(F.col("document_type"), F.col("is_inoculation_protocol")))


def citation() -> Column:
    """Title (organization), with the page if it has one; page 0 counts as none."""
    base = F.concat(F.coalesce(filled(F.col("document_title")), F.col("source_document")), F.lit(" ("), F.coalesce(filled(F.col("organization")), F.lit("unknown source")), F.lit(")"))
    return F.when(F.coalesce("page_start", F.lit(0)) != 0, F.concat(base, F.lit(", p. "), F.col("page_start").cast("string"))).otherwise(base)


def passage(number: Column) -> Column:
    """A numbered passage: header with citation and class, text, dosage as printed with its ingredient."""
    head = F.concat(F.lit("["), number.cast("string"), F.lit("] "), citation(), F.coalesce(F.concat(F.lit(" | "), filled(F.col("disease_name"))), F.lit("")))
    dose = F.concat(F.lit("\nDosage as printed: "), filled(F.col("dosage")), F.coalesce(F.concat(F.lit(" | Active ingredient: "), filled(F.col("active_ingredient"))), F.lit("")))
    return F.concat(head, F.lit("\n"), F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), F.coalesce(dose, F.lit("")))


def context(results: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """(keys, context, sources, n_passages): passages in rank order, and a line for each source document."""
    told = results.withColumn("__p", passage(F.col(rank))).withColumn("__c", citation())
    first = F.row_number().over(Window.partitionBy(*keys, "source_document").orderBy(rank)) == 1
    told = told.withColumn("__first", first)
    listed = F.sort_array(F.collect_list(F.struct(rank, F.col("__p").alias("p"))))
    cited = F.sort_array(F.collect_list(F.when(F.col("__first"), F.struct(rank, F.col("__c").alias("c")))))
    return told.groupBy(*keys).agg(
        F.array_join(F.transform(listed, lambda x: x["p"]), "\n\n").alias("context"),
        F.array_join(F.transform(cited, lambda x: F.concat(F.lit("- "), x["c"])), "\n").alias("sources"), F.count("*").alias("n_passages"),
    )


def tool_reply(chunks: DataFrame, query: list[float], k: int | None = None, disease: str | None = None, limits: RetrievalLimits = RetrievalLimits()) -> DataFrame:
    """One row (text, n_passages) as a model's tool gives it: the passages of what may be shown for treatment, a marker if
    there are none, or what was wrong with the question."""
    try:
        found = top_k(chunks, query, k, disease, "treatment", limits)
    except ValueError as wrong:
        return chunks.sparkSession.createDataFrame([(f"retrieval failed: {wrong}", 0)], "text string, n_passages bigint")
    told = context(found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))), [])  # at most most_k rows
    rows = chunks.sparkSession.createDataFrame([(NO_PASSAGES, 0)], "marker string, none bigint").join(told.filter("n_passages > 0"), F.lit(True), "left")
    return rows.select(F.coalesce("context", "marker").alias("text"), F.coalesce("n_passages", "none").alias("n_passages"))


def chunks_with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each chunk id once, with its vector; repeated rows and chunks without vector left out."""
    one = vectors.groupBy("chunk_id").agg(F.min("vector").alias("vector"))
    return chunks.dropDuplicates(["chunk_id"]).join(one, "chunk_id")


def passage_prefixed(text: Column) -> Column:
    """What is embedded of a stored text; empty texts are refused."""
    return F.concat(F.lit("passage: "), F.when(F.trim(text) != "", F.trim(text)).otherwise(F.raise_error(F.lit("empty text")).cast("string")))


def query_prefixed(text: Column) -> Column:
    return F.concat(F.lit("query: "), F.when(F.trim(text) != "", F.trim(text)).otherwise(F.raise_error(F.lit("empty text")).cast("string")))


def history(turns: DataFrame, keep: int = 60) -> DataFrame:
    """(conv_id, messages): the last ``keep`` user and assistant turns in order; system turns dropped."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = turns.filter(F.col("role").isin("user", "assistant")).withColumn("__n", F.row_number().over(last)).filter(F.col("__n") <= keep)
    return kept.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
