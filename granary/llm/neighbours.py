"""Most similar vectors for every vector.

A forest of random-projection trees is fitted on a bounded sample; every row is then filed in one leaf of
each tree. A query visits the leaves of all trees in the order of one shared priority queue, the priority
of a leaf being the smallest signed margin on its path. Rows that meet in a leaf are compared as one
matrix product over 8-bit copies of the vectors, and the surviving candidates are ranked again exactly, in
double precision, over the original vectors. A row with many rows near it in one leaf lies in a bundle that
spreads over more leaves than it visits; such rows are compared with all rows, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from granary.storage import stored

_MET = "q1 bigint, q2 bigint, m1 bigint, m2 bigint, near float, error float"
RESULT = "id string, neighbour_id string, cosine double, rank int"
#: Bytes of float32 that one routing step may gather at once, and scores that one product may make.
_GATHER_FLOATS = 2_000_000
_SCORES = 2_000_000
#: Bound of the rounding of a float32 product of unit vectors, per element.
_ROUNDING = 2.0**-22
#: A row is crowded if more than so many rows of one leaf come within this cosine of the floor (or of 0.90 without one), or
#: if the 8-bit cosines leave open which ``k`` of more than so many rows of one leaf are the nearest.
_CROWD = 32
_CROWD_WITHIN = 0.15
#: Crowded rows that are sent to every executor at once (64 floats each: about 8 MB); more go in blocks.
_CROWD_BLOCK = 32_768
#: Rows of the sample that bounds the k-th cosine from below where every row asks; where few ask it is the forest's.
_BOUND_ROWS = 4_096
#: Rows of one leaf, and rows that look into it, that one task compares; more are dealt to several tasks.
_LEAF_TASK_ROWS = 65_536


@dataclass(frozen=True)
class Forest:
    """Inner nodes of all trees in one table; a child below zero is leaf ``-child``."""

    normals: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    roots: np.ndarray
    leaves: int


def fit_forest(sample: np.ndarray, trees: int, leaf_rows: float, seed: int) -> Forest:
    """Trees over unit vectors: each node cuts at the median along the line between two moving centres."""
    rng = np.random.default_rng(seed)
    normals: list[np.ndarray] = []
    cuts: list[float] = []
    children: list[list[int]] = []
    roots: list[int] = []
    leaves = 0
    for _ in range(trees):
        pending: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]
        while pending:
            rows, parent, side = pending.pop()
            if len(rows) <= max(leaf_rows, 2):
                leaves += 1
                name = -leaves
            else:
                name = len(normals)
                normal = _direction(sample, rows, rng)
                along = sample[rows] @ normal
                cut = float(np.median(along))
                low = along <= cut
                if low.all():  # copies of one direction: any halves will do
                    low = np.arange(len(rows)) % 2 == 0
                normals.append(normal)
                cuts.append(cut)
                children.append([0, 0])
                pending += [(rows[low], name, 0), (rows[~low], name, 1)]
            if parent < 0:
                roots.append(name)
            else:
                children[parent][side] = name
    width = sample.shape[1]
    return Forest(
        np.array(normals, np.float32).reshape(-1, width),
        np.array(cuts, np.float32),
        np.array(children, np.int32).reshape(-1, 2),
        np.array(roots, np.int32),
        leaves,
    )


def _direction(sample: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    one, two = sample[rng.choice(rows, 2, replace=False)]
    for _ in range(3):
        some = sample[rng.choice(rows, min(len(rows), 256))]
        near = some @ (one - two) > (one + two) @ (one - two) / 2
        if near.any() and not near.all():
            one, two = some[near].mean(0), some[~near].mean(0)
    line = one - two
    length = np.linalg.norm(line)
    if length < 1e-9:
        line = rng.standard_normal(sample.shape[1]).astype(np.float32)
        length = np.linalg.norm(line)
    return line / length


def search_leaves(forest: Forest, rows: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the best ``probes`` leaves of the shared queue (0: none), and which of them are its own.

    All trees go down together. A child's priority never exceeds its parent's and one child of every node
    keeps it, so holding the best ``probes`` nodes of a level loses none of the best leaves.
    """
    trees = len(forest.roots)
    keep = max(probes, trees)
    step = max(1, _GATHER_FLOATS // (2 * keep * max(1, rows.shape[1])))
    found = np.zeros((len(rows), keep), np.int32)
    home = np.zeros((len(rows), keep), bool)
    for start in range(0, len(rows), step):
        x = rows[start : start + step]
        node = np.tile(forest.roots, (len(x), 1)).astype(np.int64)
        order = np.full(node.shape, np.inf, np.float32)
        own = np.ones(node.shape, bool)
        while (inner := node >= 0).any():
            at = np.where(inner, node, 0)
            margin = np.einsum("bd,bnd->bn", x, forest.normals[at]) - forest.cuts[at]
            left, right = forest.children[at, 0], forest.children[at, 1]
            node = np.concatenate([np.where(inner, left, node), np.where(inner, right, 0)], 1)
            stays = np.concatenate([np.where(inner, np.minimum(order, -margin), order), np.where(inner, np.minimum(order, margin), -np.inf)], 1)
            own = np.concatenate([own & (~inner | (margin <= 0)), own & inner & (margin > 0)], 1)
            order = stays
            live = np.concatenate([np.ones(inner.shape, bool), inner], 1)
            rank = np.where(own, np.float32(np.inf), np.where(live, order, np.float32(-np.inf)))
            if node.shape[1] > keep:
                best = np.argpartition(-rank, keep - 1, axis=1)[:, :keep]
                node, order, own, live = (np.take_along_axis(a, best, 1) for a in (node, order, own, live))
            node = np.where(live, node, -(forest.leaves + 1))
        leaf = np.where(node < -forest.leaves, 0, -node)
        found[start : start + step, : leaf.shape[1]] = leaf
        home[start : start + step, : leaf.shape[1]] = own & (leaf > 0)
    return found, home


def _routes(forest: Forest, units: np.ndarray, asks: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """``search_leaves``, but rows that ask nothing only go to their own leaves."""
    keep = max(probes, len(forest.roots))
    leaf, home = np.zeros((len(units), keep), np.int32), np.zeros((len(units), keep), bool)
    for who, wide in ((np.flatnonzero(asks), probes), (np.flatnonzero(~asks), len(forest.roots))):
        if len(who):
            found, own = search_leaves(forest, units[who], wide)
            leaf[who, : found.shape[1]], home[who, : own.shape[1]] = found, own
    return leaf, home


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _wide_units(rows: np.ndarray) -> np.ndarray:
    """Directions in float64; scaling by the largest element first keeps tiny and huge vectors finite."""
    wide = rows.astype(np.float64)
    wide = wide / np.abs(wide).max(1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _units(rows: np.ndarray) -> np.ndarray:
    return _wide_units(rows).astype(np.float32)


def _codes(units: np.ndarray) -> np.ndarray:
    return np.rint(units * (127 / np.abs(units).max(1, keepdims=True))).astype(np.int8)


def _code_errors(units: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Distance of each unit vector from the direction of its code, rounded up. Two cosines differ by no more than the sum."""
    near = codes / np.linalg.norm(codes.astype(np.float64), axis=1, keepdims=True)
    return np.nextafter(np.linalg.norm(units - near, axis=1).astype(np.float16), np.float16(np.inf))


def _bytes_of(codes: np.ndarray) -> pa.Array:
    n, width = codes.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(codes))])


def similar_vectors(
    vectors: DataFrame,
    id_col: str = "chunk_id",
    vector_col: str = "vector",
    *,
    dim: int = 64,
    k: int = 5,
    floor: float | None = None,
    queries: Column | None = None,
    trees: int = 4,
    leaf_rows: int = 512,
    probes: int = 8,
    sample_rows: int = 32_768,
    seed: int = 7,
) -> DataFrame:
    """The ``k`` most similar other ids of every id: (id, neighbour_id, cosine, rank from 1).

    ``floor`` drops neighbours of smaller cosine. ``queries`` is a condition on ``id_col`` that picks the
    ids that are asked for; all rows are searched in any case. The forest is fitted on at most
    ``sample_rows`` rows; every row is indexed. ``probes`` leaves are visited of all trees together, at
    least one of each; recall grows with it (README gives measured figures). Rows of crowded surroundings are
    compared with all rows instead, so that in a bundle of near copies of any size no neighbour is missed; that
    costs the number of such rows times the number of all.

    Rows with a null id, a vector that is null, of another length than ``dim``, with a null, infinite or NaN
    element, or all zero take no part. An id that occurs again with the same vector counts once; of
    different vectors under one id the one with the smallest hash counts. Ids with identical vectors are
    each other's neighbours at cosine 1. Equal cosines rank by neighbour id. An empty table gives no rows;
    other columns are not read.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{vector_col}`").cast("array<float>").alias("v"))
    raw = raw.filter(F.col("id").isNotNull() & (F.size("v") == dim))
    raw = raw.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    total = raw.count()
    if not total:
        return spark.createDataFrame([], RESULT)
    share = min(1.0, sample_rows / total)
    drawn = raw.filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = _matrix(drawn.select("v").limit(sample_rows).toArrow()["v"], dim) if total else np.zeros((0, dim))
    if not len(sample):
        sample = _matrix(raw.select("v").limit(sample_rows).toArrow()["v"], dim)
    forest = fit_forest(_units(sample), trees, leaf_rows * len(sample) / total, seed)
    shared = spark.sparkContext.broadcast(forest)
    dense = (0.90 if floor is None else floor) - _CROWD_WITHIN

    # One row per distinct vector (its class) besides the table of the ids in each class.
    raw = raw.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    ids = raw.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2")
    ids = ids.withColumn("asks", F.lit(True)) if queries is None else _asking(ids, id_col, queries)
    ids = stored(ids)
    used = ids.groupBy("h1", "h2").agg(F.max("asks").alias("asks"), F.count("*").alias("n"))
    classes = stored(raw.groupBy("h1", "h2").agg(F.first("v").alias("v")).join(used, ["h1", "h2"]))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks = batch["asks"].to_numpy(zero_copy_only=False).astype(bool)
            leaf, home = _routes(shared.value, _units(_matrix(batch["v"], dim)), asks, probes) if batch.num_rows else (np.zeros((0, 1), np.int64),) * 2
            own, asked = (np.bincount(leaf[f & (leaf > 0)], minlength=shared.value.leaves + 1) for f in (home.astype(bool), np.broadcast_to(asks[:, None], leaf.shape)))
            seen = np.flatnonzero(own + asked)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(own[seen]), pa.array(asked[seen])], names=["leaf", "own", "asked"])

    # Without a floor every row that asks is compared with a sample of the distinct vectors first: its k nearest there are
    # candidates, and the k-th nearest of all can't fall short of theirs, so that what is farther stays in its leaf.
    known, near_known = None, None
    if floor is None:
        wanted = min(sample_rows, _BOUND_ROWS) if queries is None else sample_rows
        part = F.pmod(F.col("h1"), F.lit(1 << 20)) < int(min(1.0, wanted / total) * (1 << 20)) + 1
        told = classes.filter(part).select("h1", "h2", "v").limit(wanted).toArrow()
        known = spark.sparkContext.broadcast((told["h1"].to_numpy(), told["h2"].to_numpy(), _units(_matrix(told["v"], dim)) if told.num_rows else np.zeros((0, dim), np.float32)))
        near_known = classes.filter("asks").mapInArrow(lambda batches: _nearest_known(batches, known.value, dim, k), _MET)

    def least_of(units: np.ndarray) -> np.ndarray:
        rows = known.value[2]
        out = np.full(len(units), -2, np.float32)
        step = max(1, _SCORES // max(1, len(rows)))
        for start in range(0, len(units) if len(rows) > k else 0, step):  # one of the sample may be the row itself
            out[start : start + step] = -np.partition(-(units[start : start + step] @ rows.T), k, axis=1)[:, k]
        return out - np.float32(2 * dim * _ROUNDING)

    # How many tasks share each leaf's rows and those that look into it: one number a leaf, as many leaves as the sample makes.
    dealt = np.ones((2, forest.leaves + 1), np.int64)
    counted = classes.mapInArrow(visits, "leaf int, own bigint, asked bigint").groupBy("leaf").agg(F.sum("own").alias("own"), F.sum("asked").alias("asked"))
    for r in counted.filter((F.col("own") > _LEAF_TASK_ROWS) | (F.col("asked") > _LEAF_TASK_ROWS)).collect():
        dealt[:, r["leaf"]] = max(1, -(-r["own"] // _LEAF_TASK_ROWS)), max(1, -(-r["asked"] // _LEAF_TASK_ROWS))
    most = dealt.max(1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _units(_matrix(batch["v"], dim))
            codes = _codes(units)
            codes = np.concatenate([codes, _code_errors(units, codes)[:, None].view(np.int8)], 1)
            asks = batch["asks"].to_numpy(zero_copy_only=False).astype(bool)
            least = np.full(len(units), -2, np.float32)
            if known is not None:
                least[asks] = least_of(units[asks])
            leaf, home = _routes(shared.value, units, asks, probes)
            row, slot = np.nonzero((leaf > 0) & (home | asks[:, None]))
            own = home[row, slot]
            h1, h2 = (batch[c].to_numpy() for c in ("h1", "h2"))
            parts, lots = dealt[:, leaf[row, slot]]
            part, lot = (h[row] % n for h, n in ((h1, parts), (h2, lots)))
            for p in range(most[0]):
                for q in range(most[1]):
                    mine, asking = own & (part == p) & (q < lots), asks[row] & (lot == q) & (p < parts)
                    take = mine | asking
                    r = row[take]
                    cell = (leaf[row, slot][take].astype(np.int64) * most[0] + p) * most[1] + q
                    role = (mine[take] + 2 * asking[take]).astype(np.int8)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(role), pa.array(h1[r]), pa.array(h2[r]), pa.array(least[r]), _bytes_of(codes[r])], names=["leaf", "role", "h1", "h2", "least", "code"])

    def meet(table: pa.Table) -> pa.Table:
        sent = np.frombuffer(b"".join(table["code"].to_pylist()), np.int8).reshape(-1, dim + 2)
        error = sent[:, dim:].copy().view(np.float16).ravel().astype(np.float32) + np.float32(dim * _ROUNDING)
        codes = sent[:, :dim].astype(np.float32)
        codes /= np.linalg.norm(codes, axis=1, keepdims=True)
        role, h1, h2, least = (table[c].to_numpy() for c in ("role", "h1", "h2", "least"))
        member, asker = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        against = codes[member].T.copy()
        column = np.full(len(role), -1)
        column[member] = np.arange(len(member))
        widest = error[member].max(initial=0)
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        crowd = [np.zeros(0, np.int64)]
        for start in range(0, len(asker) if len(member) else 0, max(1, _SCORES // max(1, len(member)))):
            who = asker[start : start + max(1, _SCORES // len(member))]
            score = codes[who] @ against
            here = np.flatnonzero(column[who] >= 0)
            score[here, column[who[here]]] = -2  # a row is no neighbour of its own
            crowded = (score >= dense).sum(1) > _CROWD
            # No row below the cut can be among the k nearest of this leaf, or reach the floor.
            reach = error[who] + widest
            cut = np.full(len(who), -1.5, np.float32) if floor is None else floor - reach
            if floor is None and len(member) > k:
                cut = np.maximum(cut, -np.partition(-score, k - 1, axis=1)[:, k - 1] - 2 * reach)
            cut = np.maximum(cut, least[who] - reach)
            i, j = np.nonzero(score >= cut[:, None])
            s, e = score[i, j], error[who[i]] + error[member[j]]
            by = np.lexsort((e - s, i))
            i, j, s, e = i[by], j[by], s[by], e[by]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            sure = least[who].copy()
            kth = place == k - 1
            sure[i[kth]] = np.maximum(sure[i[kth]], (s - e)[kth])
            open_ = s + e >= (sure[i] if floor is None else np.maximum(sure[i], floor))
            i, j, s, e = i[open_], j[open_], s[open_], e[open_]
            crowded |= np.bincount(i, minlength=len(who)) > max(_CROWD, 2 * k)
            crowd.append(who[crowded])
            pairs.append((who[i], member[j], s, e))
        q, m, s, e = (np.concatenate([p[n] for p in pairs]) if pairs else np.zeros(0, np.int64 if n < 2 else np.float32) for n in range(4))
        lost = np.concatenate(crowd)  # told as rows that are near themselves
        kept = ~np.isin(q, lost)
        q, m = np.concatenate([q[kept], lost]), np.concatenate([m[kept], lost])
        s, e = (np.concatenate([x[kept], np.ones(len(lost), np.float32)]) for x in (s, e))
        return pa.table({"q1": h1[q], "q2": h2[q], "m1": h1[m], "m2": h2[m], "near": pa.array(s, pa.float32()), "error": pa.array(e, pa.float32())})

    filed = classes.mapInArrow(route, "leaf bigint, role tinyint, h1 bigint, h2 bigint, least float, code binary")
    met = filed.groupBy("leaf").applyInArrow(meet, _MET)
    met = met if near_known is None else met.unionByName(near_known)
    met = met.groupBy("q1", "q2", "m1", "m2").agg(F.max("near").alias("near"), F.max("error").alias("error"))
    # Of all leaves those stay that may be nearer than the k-th is for certain.
    asker = Window.partitionBy("q1", "q2")
    itself = (F.col("q1") == F.col("m1")) & (F.col("q2") == F.col("m2"))
    met = met.withColumn("place", F.row_number().over(asker.orderBy((F.col("near") - F.col("error")).desc(), "m1", "m2")))
    met = met.withColumns({"sure": F.max(F.when(F.col("place") == k, F.col("near") - F.col("error"))).over(asker), "crowded": F.max(itself).over(asker)})
    open_ = F.col("sure").isNull() | (F.col("near") + F.col("error") >= F.col("sure"))
    met = stored(met.filter(itself | (~F.col("crowded") & open_)).select("q1", "q2", "m1", "m2", "crowded"))

    sides = classes.select("h1", "h2", "v")
    crowded = met.filter("crowded").select(F.col("q1").alias("h1"), F.col("q2").alias("h2"))
    met = met.filter("not crowded").drop("crowded")
    both = met.join(sides.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("v").alias("a")), ["q1", "q2"])
    both = both.join(sides.select(F.col("h1").alias("m1"), F.col("h2").alias("m2"), F.col("v").alias("b")), ["m1", "m2"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_matrix(batch[c], dim).astype(np.float64) for c in ("a", "b"))
                a, b = (x / np.abs(x).max(1, keepdims=True) for x in (a, b))
                cosine = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("q1", "q2", "m1", "m2")), pa.array(np.minimum(cosine, 1.0))], names=["q1", "q2", "m1", "m2", "cosine"])

    ranked = both.mapInArrow(exact, "q1 bigint, q2 bigint, m1 bigint, m2 bigint, cosine double")
    n_crowded = crowded.count()
    if n_crowded:
        ranked = ranked.unionByName(_against_all(stored(crowded.join(sides, ["h1", "h2"])), n_crowded, sides, dim, k))
    if floor is not None:
        ranked = ranked.filter(F.col("cosine") >= floor)
    copies = used.filter((F.col("n") > 1) & F.col("asks"))
    ranked = ranked.unionByName(copies.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("h1").alias("m1"), F.col("h2").alias("m2"), F.lit(1.0).alias("cosine")))
    return _for_ids(ranked, ids, k)


def _nearest_known(batches: Iterator[pa.RecordBatch], known: tuple[np.ndarray, np.ndarray, np.ndarray], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` + 1 nearest of a sample to each row, but for the row itself."""
    h1, h2, rows = known
    top = min(k + 1, len(rows))
    for batch in batches:
        if not batch.num_rows or not top:
            continue
        units = _units(_matrix(batch["v"], dim))
        q1, q2 = (batch[c].to_numpy() for c in ("h1", "h2"))
        for start in range(0, len(units), step := max(1, _SCORES // len(rows))):
            score = units[start : start + step] @ rows.T
            j = np.argpartition(-score, top - 1, axis=1)[:, :top].ravel()
            i = np.repeat(np.arange(len(score)), top)
            other = (q1[start + i] != h1[j]) | (q2[start + i] != h2[j])
            i, j = i[other], j[other]
            columns = [q1[start + i], q2[start + i], h1[j], h2[j], score[i, j].astype(np.float32), np.full(len(i), dim * _ROUNDING, np.float32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q1", "q2", "m1", "m2", "near", "error"])


def _against_all(asked: DataFrame, n_asked: int, rows: DataFrame, dim: int, k: int) -> DataFrame:
    """(q1, q2, m1, m2, cosine): for every asked (h1, h2, v) the ``k`` nearest other rows of all, in double precision.

    The asked rows go in blocks of bounded size; every task keeps the best of each over the rows it reads.
    """
    spark = rows.sparkSession
    schema = "q1 bigint, q2 bigint, m1 bigint, m2 bigint, cosine double"
    blocks = -(-n_asked // _CROWD_BLOCK)
    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        told = asked.filter(F.pmod(F.xxhash64(F.lit(2), "h1", "h2"), F.lit(blocks)) == block).toArrow()
        if not told.num_rows:
            continue
        shared = spark.sparkContext.broadcast((told["h1"].to_numpy(), told["h2"].to_numpy(), _matrix(told["v"], dim)))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            h1, h2, v = shared.value
            q = _wide_units(v)
            best = np.full((len(q), k), -np.inf)
            names = np.zeros((len(q), k, 2), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _wide_units(_matrix(batch["v"], dim))
                m = np.stack([batch[c].to_numpy() for c in ("h1", "h2")], 1)
                step = max(1, _SCORES // len(x))
                for start in range(0, len(q), step):
                    at = slice(start, start + step)
                    score = q[at] @ x.T
                    cut = best[at, -1]
                    some = score[:, :512]
                    if some.shape[1] > k + 1:  # one of these may be the row itself
                        cut = np.maximum(cut, np.partition(some, -k - 1, axis=1)[:, -k - 1])
                    i, j = np.nonzero(score >= cut[:, None])
                    other = (m[j, 0] != h1[at][i]) | (m[j, 1] != h2[at][i])
                    i, j = i[other], j[other]
                    who = np.unique(i)
                    r = np.concatenate([i, np.repeat(who, k)])
                    s = np.concatenate([score[i, j], best[at][who].ravel()])
                    n = np.concatenate([m[j], names[at][who].reshape(-1, 2)])
                    order = np.lexsort((n[:, 1], n[:, 0], -s, r))
                    r, s, n = r[order], s[order], n[order]
                    place = np.arange(len(r)) - np.searchsorted(r, r)
                    first = place < k
                    best[start + r[first], place[first]] = s[first]
                    names[start + r[first], place[first]] = n[first]
            r, c = np.nonzero(best > -np.inf)
            columns = [h1[r], h2[r], names[r, c, 0], names[r, c, 1], np.minimum(best[r, c], 1.0)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["q1", "q2", "m1", "m2", "cosine"])

        found = found.unionByName(rows.mapInArrow(scan, schema))
    return found


def _asking(ids: DataFrame, id_col: str, queries: Column) -> DataFrame:
    return ids.withColumnRenamed("id", id_col).withColumn("asks", F.coalesce(queries.cast("boolean"), F.lit(False))).withColumnRenamed(id_col, "id")


def _for_ids(ranked: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """From classes of identical vectors to ids. A class offers its k + 1 smallest ids, found by dealt
    partial rankings, so that a class of any size is never gathered."""
    dealt = Window.partitionBy("h1", "h2", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    whole = Window.partitionBy("h1", "h2").orderBy("id")
    first = ids.withColumn("place", F.row_number().over(dealt)).filter(F.col("place") <= k + 1)
    first = first.withColumn("place", F.row_number().over(whole)).filter(F.col("place") <= k + 1)
    offered = first.select(F.col("h1").alias("m1"), F.col("h2").alias("m2"), F.col("id").alias("neighbour_id"))
    near = Window.partitionBy("q1", "q2").orderBy(F.desc("cosine"), "neighbour_id")
    lists = ranked.join(offered, ["m1", "m2"]).withColumn("place", F.row_number().over(near)).filter(F.col("place") <= k + 1)
    lists = lists.groupBy(F.col("q1").alias("h1"), F.col("q2").alias("h2")).agg(F.sort_array(F.collect_list(F.struct("place", "neighbour_id", "cosine"))).alias("near"))
    told = ids.filter("asks").join(lists, ["h1", "h2"]).select("id", F.slice(F.filter("near", lambda x: x["neighbour_id"] != F.col("id")), 1, k).alias("near"))
    told = told.select("id", F.posexplode("near").alias("at", "x"))
    return told.select("id", "x.neighbour_id", "x.cosine", (F.col("at") + 1).cast(T.IntegerType()).alias("rank"))


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """Pairs (id_a < id_b, cosine) of which at least one is listed as a neighbour of the other; each once."""
    pair = neighbours.select(F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b"), "cosine")
    return pair.groupBy("id_a", "id_b").agg(F.max("cosine").alias("cosine"))
