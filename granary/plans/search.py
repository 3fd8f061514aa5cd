"""Queries of vector search, merging, citations and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import config
from granary.functions import vectors as V
from granary.operators import retrieval
from granary.plans.common import table


def request_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Every request against every chunk: filter by class and safety, best k."""
    chunks = retrieval.chunks_with_vectors(table(spark, folder, "chunks").select("chunk_id", "disease_name", "document_type", "is_inoculation_protocol"), table(spark, folder, "chunk_vectors"))
    found = retrieval.request_results(table(spark, folder, "retrieval_requests"), chunks)
    return found.withColumn("score", F.round("score", 6))


def filtered_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of one label to vector 0."""
    rows = table(spark, folder, "embeddings")
    query = rows.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = rows.filter("label = 3 and vec_id <> 0").withColumn("q", query.scalar()).withColumn("score", V.dot(F.col("embedding"), F.col("q")))
    return scored.orderBy(F.desc("score"), "vec_id").limit(5).select("vec_id", "label", F.round("score", 6).alias("score"))


def _fanned(spark: SparkSession, folder: str, queries: int, each: int) -> DataFrame:
    from pyspark.sql.window import Window

    rows = table(spark, folder, "embeddings")
    asked = rows.filter(F.col("vec_id") < queries).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    scored = rows.join(F.broadcast(asked), F.col("vec_id") != F.col("query_id")).withColumn("score", F.round(V.dot(F.col("embedding"), F.col("q")), 9))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= each)
    return ranked.select("query_id", "rank", F.col("vec_id").alias("chunk_id"), "score", F.lit("all").alias("request_id"))


def fanout_topk_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Six queries, three results each, first wins, the seven best."""
    merged = retrieval.merged_by_score(_fanned(spark, folder, 6, 3), ["request_id"], ["query_id", "rank"], 7)
    return merged.select("place", "query_id", "chunk_id", F.round("score", 6).alias("score"))


def fanout_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Forty queries, six results each, every chunk where it came first."""
    merged = retrieval.merged_first_wins(_fanned(spark, folder, 40, 6), ["request_id"], ["query_id", "rank"])
    return merged.select("query_id", "rank", "chunk_id")


def _hundredths(spark: SparkSession, folder: str) -> DataFrame:
    """The query set: every vector whose id is divisible by 100."""
    return table(spark, folder, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")


def _fanned_whole(spark: SparkSession, folder: str, each: int) -> DataFrame:
    """The whole query set against all rows; ten neighbouring queries are one request."""
    found = retrieval.query_results(_hundredths(spark, folder).drop("label"), table(spark, folder, "embeddings"), each)
    return found.select("query_id", "rank", F.col("vec_id").alias("chunk_id"), "score", F.floor(F.col("query_id") / 1000).alias("request_id"))


def filtered_topk_whole(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of its own label to every vector whose id is divisible by 100."""
    found = retrieval.query_results(_hundredths(spark, folder), table(spark, folder, "embeddings"), 5)
    return found.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def fanout_topk_merge_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of ten queries, three results each, first wins, the seven best of each request."""
    merged = retrieval.merged_by_score(_fanned_whole(spark, folder, 3), ["request_id"], ["query_id", "rank"], 7)
    return merged.select("request_id", "place", "query_id", "chunk_id", F.round("score", 6).alias("score"))


def fanout_first_wins_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of ten queries, six results each, every chunk of a request where it came first."""
    merged = retrieval.merged_first_wins(_fanned_whole(spark, folder, 6), ["request_id"], ["query_id", "rank"])
    return merged.select("request_id", "query_id", "rank", "chunk_id")


_WHOLE = """
    select query_id, chunk_id, score, rank, query_id // 1000 as request_id from (
        select a.vec_id as query_id, b.vec_id as chunk_id, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 9) as score,
            row_number() over (partition by a.vec_id order by round(list_inner_product(a.embedding::double[], b.embedding::double[]), 9) desc, b.vec_id) as rank
        from embeddings a join embeddings b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id {0}) where rank <= {1}"""
_FANNED = """
    select a.vec_id as query_id, b.vec_id as chunk_id, score, rank from (
        select a.vec_id, b.vec_id as other, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 9) as score,
            row_number() over (partition by a.vec_id order by round(list_inner_product(a.embedding::double[], b.embedding::double[]), 9) desc, b.vec_id) as rank
        from embeddings a join embeddings b on a.vec_id < {0} and a.vec_id <> b.vec_id) a join embeddings b on b.vec_id = a.other where rank <= {1}"""


def unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Length of every chunk vector, and of its unit vector; null for zero vectors."""
    v = F.col("vector")
    rows = table(spark, folder, "chunk_vectors").filter("vector is not null")
    return rows.select("chunk_id", F.size(v).alias("dim"), F.round(V.norm(v), 5).alias("length"), F.round(V.norm(V.unit(v)), 5).alias("unit_length"))


def citations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("chunk_id", retrieval.citation().alias("citation")).distinct()


def passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of each source document's treatment records, in page order, as one context."""
    from pyspark.sql.window import Window

    rows = table(spark, folder, "chunks").filter("chunk_type = 'treatment_record'").dropDuplicates(["chunk_id"])
    order = Window.partitionBy("source_document").orderBy("chunk_id")
    rows = rows.withColumn("rank", F.row_number().over(order))
    return retrieval.context(rows, ["source_document"])


CITATION_SQL = """coalesce(nullif(document_title, ''), source_document) || ' (' || coalesce(nullif(organization, ''), 'unknown source') || ')'
    || case when coalesce(page_start, 0) <> 0 then ', p. ' || page_start else '' end"""
PASSAGE_SQL = f"""'[' || rank || '] ' || {CITATION_SQL} || coalesce(' | ' || nullif(disease_name, ''), '') || chr(10)
    || regexp_replace(text, '^[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\v]+|[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\v]+$', '', 'g')
    || coalesce(chr(10) || 'Dosage as printed: ' || nullif(dosage, '') || coalesce(' | Active ingredient: ' || nullif(active_ingredient, ''), ''), '')"""


def safe_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """What the safety filter lets through, by type of document."""
    condition, _ = retrieval.metadata_filter(None, "treatment")
    rows = table(spark, folder, "chunks").filter(condition)
    return rows.groupBy("document_type").agg(F.count("*").alias("n_rows"), F.count_distinct("chunk_id").alias("n_chunks"))


def safety_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that the filter keeps out."""
    return retrieval.safety_violations(table(spark, folder, "chunks")).select("chunk_id", "document_type").distinct()


def turn_history(spark: SparkSession, folder: str) -> DataFrame:
    """Events as turns of a conversation per user: the last 60, system turns dropped."""
    role = F.when(F.col("event_type").isin("view", "purchase"), "user").when(F.col("event_type") == "error", "system").otherwise("assistant")
    turns = table(spark, folder, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), role.alias("role"), F.col("event_type").alias("text"))
    told = retrieval.history(turns)
    return told.select("conv_id", F.size("messages").alias("n"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "|").alias("told"))


QUERIES = {f.__name__: f for f in (request_topk, filtered_topk, filtered_topk_whole, fanout_topk_merge, fanout_topk_merge_whole, fanout_first_wins, fanout_first_wins_whole, unit_vectors, citations, passages, safe_chunks, safety_violations, turn_history)}

_SCREEN = f"coalesce(document_type, '') = '{config.SCREENING_TYPE}'"
SQL = {
    "request_topk": f"""
        with one as (select chunk_id, min(vector) as v from chunk_vectors
                where len(vector) = 64 and len(list_filter(vector, lambda x: x is not null and x <> 0)) > 0 group by chunk_id),
        c as (select distinct on (chunk_id) chunk_id, disease_name, coalesce(is_inoculation_protocol, false) or {_SCREEN} as unsafe, v::double[] as v from chunks join one using (chunk_id)),
        r as (select request_id, query_vector::double[] as q, nullif(trim(disease_name), '') as d, coalesce(intent = 'unfiltered', false) as open,
                least(greatest(case when top_k is null or top_k = 0 then 5 else top_k end, 1), 20) as k from retrieval_requests
                where len(query_vector) = 64 and len(list_filter(query_vector, lambda x: x <> 0)) > 0),
        s as (select request_id, chunk_id, k, round(list_cosine_similarity(q, v), 12) as score from r join c on (d is null or d = disease_name) and (open or not unsafe)),
        o as (select *, row_number() over (partition by request_id order by score desc, chunk_id) as rank from s)
        select request_id, cast(rank as integer) as rank, chunk_id, round(score, 6) as score from o where rank <= k""",
    "filtered_topk": """
        select b.vec_id, b.label, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6) as score
        from embeddings a join embeddings b on a.vec_id = 0 and b.vec_id <> 0 and b.label = 3
        order by list_inner_product(a.embedding::double[], b.embedding::double[]) desc, b.vec_id limit 5""",
    "fanout_topk_merge": f"""
        with f as ({_FANNED.format(6, 3)}),
        w as (select *, row_number() over (partition by chunk_id order by query_id, rank) as n from f),
        p as (select *, row_number() over (order by score desc, query_id, rank, chunk_id) as place from w where n = 1)
        select cast(place as integer) as place, query_id, chunk_id, round(score, 6) as score from p where place <= 7""",
    "fanout_first_wins": f"""
        with f as ({_FANNED.format(40, 6)}), w as (select *, row_number() over (partition by chunk_id order by query_id, rank) as n from f)
        select query_id, cast(rank as integer) as rank, chunk_id from w where n = 1""",
    "filtered_topk_whole": f"select query_id, cast(rank as integer) as rank, chunk_id as vec_id, round(score, 6) as score from ({_WHOLE.format('and a.label = b.label', 5)})",
    "fanout_topk_merge_whole": f"""
        with f as ({_WHOLE.format('', 3)}),
        w as (select *, row_number() over (partition by request_id, chunk_id order by query_id, rank) as n from f),
        p as (select *, row_number() over (partition by request_id order by score desc, query_id, rank, chunk_id) as place from w where n = 1)
        select request_id, cast(place as integer) as place, query_id, chunk_id, round(score, 6) as score from p where place <= 7""",
    "fanout_first_wins_whole": f"""
        with f as ({_WHOLE.format('', 6)}), w as (select *, row_number() over (partition by request_id, chunk_id order by query_id, rank) as n from f)
        select request_id, query_id, cast(rank as integer) as rank, chunk_id from w where n = 1""",
    "unit_vectors": """
        with n as (select chunk_id, vector, len(vector) as dim, sqrt(list_sum(list_transform(vector, lambda x: x::double * x::double))) as l from chunk_vectors where vector is not null)
        select chunk_id, cast(dim as integer) as dim, round(l, 5) as length, case when l > 0 then round(sqrt(list_sum(list_transform(vector, lambda x: (x / l) * (x / l)))), 5) end as unit_length from n""",
    "citations": f"select distinct chunk_id, {CITATION_SQL} as citation from chunks",
    "passages": f"""
        with t as (select distinct on (chunk_id) * from chunks where chunk_type = 'treatment_record'),
        r as (select *, row_number() over (partition by source_document order by chunk_id) as rank from t),
        p as (select source_document, rank, {PASSAGE_SQL} as p, {CITATION_SQL} as c from r)
        select source_document, string_agg(p, chr(10) || chr(10) order by rank) as context, min_by('- ' || c, rank) as sources, count(*) as n_passages from p group by source_document""",
    "safe_chunks": f"""
        select document_type, count(*) as n_rows, count(distinct chunk_id) as n_chunks from chunks
        where not coalesce(is_inoculation_protocol, false) and not {_SCREEN} group by document_type""",
    "safety_violations": f"select distinct chunk_id, document_type from chunks where coalesce(is_inoculation_protocol, false) or {_SCREEN}",
    "turn_history": """
        with t as (select user_id as conv_id, event_id as turn, event_type as text,
                case when event_type in ('view', 'purchase') then 'user' when event_type = 'error' then 'system' else 'assistant' end as role from events),
        k as (select *, row_number() over (partition by conv_id order by turn desc) as n from t where role <> 'system')
        select conv_id, cast(count(*) as integer) as n, string_agg(role || ':' || text, '|' order by turn) as told from k where n <= 60 group by conv_id""",
}
