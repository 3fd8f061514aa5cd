"""The queries of the operators for training data, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.text import words
from granary.llm import boilerplate, canonical, leakage, mixture, neighbours, spans, splitting
from granary.storage import stored

#: Where the tokenizer of p7_report and p7_draws lies: a parameter of these queries.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    near = neighbours.similar_vectors(_table(spark, folder, "chunk_vectors"), k=5, floor=0.90)
    return neighbours.similar_pairs(near).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The query set of about every hundredth chunk (ids aren't numbers: the number that the first 28 bits of their MD5
    make is divisible by 100) against all chunks."""
    asked = F.conv(F.substring(F.md5("chunk_id"), 1, 7), 16, 10).cast("bigint") % 100 == 0
    near = neighbours.similar_vectors(_table(spark, folder, "chunk_vectors"), k=5, queries=asked, leaf_rows=1024, probes=160)
    return near.select(F.col("id").alias("chunk_id"), "neighbour_id", F.round("cosine", 6).alias("cosine"), "rank")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.frequent_lines(_table(spark, folder, "chunks")).withColumnRenamed("id", "chunk_id")


def p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = boilerplate.without_frequent_lines(_table(spark, folder, "chunks"))
    return cleaned.select("chunk_id", "clean_text", "lines_removed").distinct()


def p2_share(spark: SparkSession, folder: str) -> DataFrame:
    """Lines in at least a tenth of a source's chunks, and in five."""
    return boilerplate.frequent_lines(_table(spark, folder, "chunks"), min_share=0.1).withColumnRenamed("id", "chunk_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    split = splitting.split_oversized(_table(spark, folder, "chunks").select("chunk_id", "text"))
    cut = split.filter("cut_kind <> 'end' or piece_no > 0").groupBy("chunk_id").agg(F.max(F.col("cut_kind") == "forced").alias("forced"))
    return cut.select("chunk_id", F.when(F.col("forced"), "forced").otherwise("natural").alias("cut_kind"))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _table(spark, folder, "chunks").select("chunk_id", "text", "section").dropDuplicates(["chunk_id", "text"])
    return splitting.split_oversized(chunks.withColumn("text_id", F.xxhash64("text"))).drop("text")


def p3_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the pieces of each text: words without overlap, none over the limit, overlap within its bound, the
    first words of each piece the last of the one before."""
    rows = p3_pieces(spark, folder).filter("piece_text is not null")
    order = Window.partitionBy("chunk_id", "text_id").orderBy("piece_no")
    listed = words(F.col("piece_text"))
    before = F.lag(F.slice(listed, F.greatest(F.size(listed) - 59, F.lit(1)), 60)).over(order)
    back = F.col("overlap_words")
    joins = (back == 0) | (F.slice(listed, 1, F.greatest(back, F.lit(1))) == F.slice("before", F.size("before") - back + 1, F.greatest(back, F.lit(1))))
    rows = rows.withColumn("before", before).withColumn("joins", F.coalesce(joins, F.lit(True)))
    return rows.groupBy("chunk_id", "text_id").agg(
        F.sum(F.col("piece_words") - back).alias("words"), (F.max("piece_words") <= 280).alias("within"), (F.max(back) <= 60).alias("overlaps"), F.min("joins").alias("joins"),
        (F.count("*") >= F.ceil(F.sum(F.col("piece_words") - back) / 280)).alias("enough"),
    ).drop("text_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = spans.sharing_pairs(_table(spark, folder, "chunks"))
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p4_shared(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_share(_table(spark, folder, "chunks")).withColumnRenamed("id", "chunk_id")


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_passages(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_documents(_passages(spark, folder)).select("doc_id", "item_id")


def p6_passages(spark: SparkSession, folder: str) -> DataFrame:
    return _passages(spark, folder)


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "source", "text")
    return leakage.without_leaked(docs, _passages(spark, folder)).select("doc_id", "source")


def _mixed(spark: SparkSession, folder: str, tokenizer: str | None) -> mixture.Mixture:
    return mixture.mix_sources(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"), tokenizer=tokenizer)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of which the shards' draws, by white-space separated words, fall short."""
    return _mixed(spark, folder, None).report.filter("not reached").select("source")


def p7_report(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return _mixed(spark, folder, tokenizer).report


def p7_draws(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return _mixed(spark, folder, tokenizer).draws.withColumnRenamed("id", "doc_id")


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the draws by words: size of each source, least and most that may be drawn, no use beyond the
    repeats, no document twice in one copy, shards of equal numbers of blocks."""
    mixed = _mixed(spark, folder, None)
    draws = stored(mixed.draws)
    uses = draws.groupBy("source", "id").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("c"), F.max("n_tokens").alias("size"))
    uses = uses.groupBy("source").agg(F.max("n").alias("most"), F.min(F.col("n") == F.col("c")).alias("once"), F.max("size").alias("largest"))
    blocks = draws.select("source", "copy", "block", "shard").distinct().groupBy("shard").agg(F.count("*").alias("n")).agg((F.max("n") - F.min("n") <= 4).alias("even"))
    goal = F.least(F.col("wanted_tokens"), F.col("most_tokens").cast("double"))
    rows = mixed.report.join(uses, "source", "left").join(F.broadcast(blocks), F.lit(True), "left")
    within = (F.col("drawn_tokens") >= goal) & (F.col("drawn_tokens") - goal < F.coalesce("largest", F.lit(1)))
    kept = (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")) & F.coalesce("once", F.lit(True))
    return rows.select("source", "n_docs", "tokens", "most_tokens", "reached", within.alias("within"), kept.alias("kept"), "even")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = canonical.look_alike_pairs(canonical.look_alike_classes(_table(spark, folder, "documents")))
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_canonical(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return canonical.with_canonical_text(docs).select("doc_id", "canonical_text", (~F.col("text").eqNullSafe(F.col("canonical_text"))).alias("changed"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_clean, p2_share, p3_found, p3_pieces, p3_check, p4_found, p4_shared, p6_found, p6_passages, p6_clean, p7_found, p7_report, p7_draws, p7_check, p8_found, p8_canonical)}


_WHITE = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def _words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{_WHITE}'), lambda w: w <> ''))"


_LINES = f"""
    lines as (select chunk_id, source_document, unnest(range(len(string_split(text, chr(10))))) as line_no, unnest(string_split(text, chr(10))) as line
        from (select distinct chunk_id, source_document, text from chunks where text is not null and source_document is not null and chunk_id is not null)),
    formed as (select *, regexp_replace(lower(trim(regexp_replace(line, '{_WHITE}', ' ', 'g'))), '\\p{{Nd}}+', '#', 'g') as form from lines),
    often as (select source_document, form from formed where form <> '' group by all having count(distinct chunk_id) >= 5)"""
# As NFKC in the characters that SQL's tables hold: full-width forms by rule, spaces, ligatures; marks by nfc_normalize.
_WIDE, _NARROW = "".join(chr(0xFF01 + k) for k in range(94)), "".join(chr(0x21 + k) for k in range(94))
_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "…": "..."}


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _plain(x: str, more: dict[str, str]) -> str:
    told = dict(zip(_WIDE + _SPACES, _NARROW + " " * len(_SPACES), strict=True)) | more
    out = f"translate({x}, {_sql_text(''.join(told))}, {_sql_text(''.join(told.values()))})"
    for one, many in _LIGATURES.items():
        out = f"replace({out}, '{one}', '{many}')"
    return f"nfc_normalize({out})"


_GRAMS = f"""
    dw as (select doc_id, regexp_extract_all(lower({_plain('text', {})}), '[\\p{{L}}\\p{{N}}]+') as w from documents where text is not null),
    iw as (select item_id, regexp_extract_all(lower({_plain('text', {})}), '[\\p{{L}}\\p{{N}}]+') as w from eval_items where text is not null),
    dg as (select doc_id, array_to_string(list_slice(w, i, i + 12), ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from dw where len(w) >= 13)),
    ig as (select distinct item_id, array_to_string(list_slice(w, i, i + 12), ' ') as g from (select item_id, w, unnest(range(1, len(w) - 11)) as i from iw where len(w) >= 13)),
    leaked as (select distinct doc_id, item_id from dg join ig using (g))"""
_INVISIBLE = r"[\p{Cf}\x{34f}\x{115f}\x{1160}\x{3164}\x{ffa0}\x{fe00}-\x{fe0f}]"
_CANON = _plain(f"regexp_replace(text, '{_INVISIBLE}', '', 'g')", canonical.LOOK_ALIKES)
_WINDOWS = """
    texts as (select distinct chunk_id, text from chunks where chunk_id is not null and length(text) >= 240),
    windows as (select chunk_id, hash(text) as k, i, md5_number(substr(text, i, 240)) as g from (select chunk_id, text, unnest(range(1, length(text) - 238)) as i from texts)),
    common as (select g from windows group by g having min(k) < max(k)),
    held as (select chunk_id, k, i, g from windows semi join common using (g))"""
_MIX = f"""
    tokens as (select source, sum({_words('text')}) as n from documents where text is not null group by source),
    targets as (select source, max(target_share) as share, max(max_repeats) as repeats from mix_targets where source is not null group by source),
    held as (select source, share, repeats, coalesce(n, 0) as n from targets left join tokens using (source))"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express over whole tables."""
    return {
        "p1_found": """
            with v as (select chunk_id, min(vector)::double[] as v from chunk_vectors where len(vector) = 64 and len(list_filter(vector, lambda x: x <> 0)) > 0 group by chunk_id),
            s as (select a.chunk_id as a, b.chunk_id as b, list_cosine_similarity(a.v, b.v) as c from v a join v b on a.chunk_id <> b.chunk_id),
            r as (select *, row_number() over (partition by a order by c desc, b) as place from s where c >= 0.9)
            select distinct least(a, b) as chunk_id_a, greatest(a, b) as chunk_id_b from r where place <= 5""",
        "p1_neighbours": """
            with v as (select chunk_id, min(vector)::double[] as v from chunk_vectors where len(vector) = 64 and len(list_filter(vector, lambda x: x <> 0)) > 0 group by chunk_id),
            s as (select a.chunk_id as a, b.chunk_id as b, list_cosine_similarity(a.v, b.v) as c from v a join v b on a.chunk_id <> b.chunk_id and ('0x' || substr(md5(a.chunk_id), 1, 7))::bigint % 100 = 0),
            r as (select *, row_number() over (partition by a order by c desc, b) as place from s)
            select a as chunk_id, b as neighbour_id, round(c, 6) as cosine, cast(place as integer) as rank from r where place <= 5""",
        "p2_found": f"with {_LINES} select distinct chunk_id, cast(line_no as bigint) as line_no from formed join often using (source_document, form)",
        "p2_clean": f"""
            with {_LINES}, dropped as (select distinct chunk_id, source_document, line_no from formed join often using (source_document, form)),
            kept as (select l.chunk_id, l.source_document, string_agg(l.line, chr(10) order by l.line_no) filter (where d.line_no is null) as t, count(d.line_no) as n
                from lines l left join dropped d using (chunk_id, source_document, line_no) group by all)
            select chunk_id, coalesce(t, '') as clean_text, cast(n as integer) as lines_removed from kept""",
        "p2_share": f"""
            with {_LINES}, sizes as (select source_document, count(distinct chunk_id) as of from chunks where source_document is not null and chunk_id is not null group by all),
            held as (select source_document, form, count(distinct chunk_id) as n from formed where form <> '' group by all),
            most as (select source_document, form from held join sizes using (source_document) where n >= 5 and n >= 0.1::double * of)
            select distinct chunk_id, cast(line_no as bigint) as line_no from formed join most using (source_document, form)""",
        "p3_check": f"""
            select chunk_id, cast({_words('text')} as bigint) as words, true as "within", true as overlaps, true as joins, true as enough
            from (select distinct chunk_id, text from chunks where text is not null)""",
        "p4_found": f"""
            with {_WINDOWS}, pairs as (select distinct a.chunk_id as a, b.chunk_id as b from held a join held b on a.g = b.g and a.chunk_id < b.chunk_id
                union select a.chunk_id, b.chunk_id from texts a join texts b on a.text = b.text and a.chunk_id < b.chunk_id)
            select a as chunk_id_a, b as chunk_id_b from pairs""",
        "p4_shared": f"""
            with recursive {_WINDOWS},
            steps as (select chunk_id, k, least(240, i - lag(i, 1, i - 240) over (partition by chunk_id, k order by i)) as fresh from held),
            covered as (select chunk_id, k, sum(fresh) as n from steps group by all),
            copied as (select text from texts group by text having count(*) > 1),
            firsts as (select g, min(chunk_id) as f from held group by g),
            edges as (select distinct f as a, chunk_id as b from held join firsts using (g)
                union select min(chunk_id) over (partition by text), chunk_id from texts),
            both_ways as (select a, b from edges union select b, a from edges),
            reached(node, root) as (select chunk_id, chunk_id from texts union select e.b, r.root from reached r join both_ways e on r.node = e.a where r.root < e.b),
            classes as (select node as chunk_id, min(root) as class_id from reached group by node)
            select t.chunk_id, q.class_id, cast(length(t.text) as integer) as chars, cast(case when p.text is not null then length(t.text) else coalesce(n, 0) end as integer) as shared_chars
            from texts t left join covered c on t.chunk_id = c.chunk_id and hash(t.text) = c.k left join copied p on t.text = p.text join classes q on t.chunk_id = q.chunk_id""",
        "p6_found": f"with {_GRAMS} select doc_id, item_id from leaked",
        "p6_clean": f"with {_GRAMS} select doc_id, source from documents where doc_id is null or doc_id not in (select doc_id from leaked)",
        "p7_check": f"""
            with {_MIX}, docs as (select source, count(*) as d from documents group by source)
            select source, cast(coalesce(d, 0) as bigint) as n_docs, cast(n as bigint) as tokens, cast(n * repeats as bigint) as most_tokens,
                n * repeats >= share * (select sum(n) from held) as reached, true as "within", true as kept, true as even from held left join docs using (source)""",
        "p8_canonical": f"select doc_id, {_CANON} as canonical_text, text is distinct from {_CANON} as changed from documents",
        "p8_found": f"""
            with c as (select distinct doc_id, text, {_CANON} as form from documents where text is not null and doc_id is not null)
            select distinct least(a.doc_id, b.doc_id) as doc_id_a, greatest(a.doc_id, b.doc_id) as doc_id_b from c a join c b on a.form = b.form and a.text <> b.text and a.doc_id <> b.doc_id""",
        "p3_found": f"""
            with c as (select distinct chunk_id, text from chunks where text is not null),
            w as (select chunk_id, {_words('text')} as n, list_max(list_transform(string_split(regexp_replace(text, '([.!?]){_WHITE}([A-Z(])', '\\1' || chr(10) || '\\2', 'g'), chr(10)),
                lambda p: {_words('p')})) as stretch from c)
            select chunk_id, case when stretch > 280 then 'forced' else 'natural' end as cut_kind from w where n > 280""",
        "p7_found": f"with {_MIX} select source from held where n * repeats < share * (select sum(n) from held)",
    }
