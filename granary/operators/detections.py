"""Detections and masks: thresholds, suppression, mask areas, findings per class."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary import config
from granary.functions.geometry import from_centre, severity, share, sure_of, uncertain, unletterbox
from granary.functions.vectors import first_largest


def scored_anchors(anchors: DataFrame) -> DataFrame:
    """``schemas.ANCHORS`` with box, class_id (the first of equals) and score."""
    return anchors.withColumns({"box": from_centre(*(F.col(c).cast("double") for c in ("cx", "cy", "w", "h"))), "class_id": first_largest(F.col("class_scores")).cast("int"), "score": F.array_max("class_scores")})


def above_threshold(scored: DataFrame, thresholds: tuple[float, ...] = config.DETECTION_THRESHOLDS, floor: float = config.DETECTION_FLOOR) -> DataFrame:
    """Rows whose score reaches the larger of the floor and their class's threshold; compared in single precision."""
    limits = F.array(*(F.lit(t).cast("float") for t in thresholds))
    least = F.greatest(F.get(limits, F.col("class_id")), F.lit(floor).cast("float"))
    return scored.filter(F.col("score").cast("float") >= least)


#: Boxes that one step suppresses at least, whole groups together.
_BOXES_AT_ONCE = 8_192


def suppressed(detections: DataFrame, keys: list[str], *, limit: float = 0.45, id_col: str = "anchor_id") -> DataFrame:
    """Greedy suppression in each group of ``keys`` (picture and class): from the best score down (ties by ``id_col``), a
    box stays if its overlap with every box kept before is below ``limit``. Other columns stay. Groups are as large as
    one picture's boxes and lie together in one partition, where batches of many groups are worked through in order;
    rows with a null score or box vanish."""
    held = detections.filter("score is not null and box is not null")
    code = F.xxhash64(*(F.col(k).cast("string") for k in keys))
    ordered = held.withColumn("__group", code).repartition("__group").sortWithinPartitions("__group", *keys, F.desc("score"), id_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            coded = np.stack([pc.dictionary_encode(table[k].combine_chunks(), null_encoding="encode").indices.to_numpy() for k in keys])
            turns = np.flatnonzero(np.concatenate([[True], (coded[:, 1:] != coded[:, :-1]).any(0)]))
            box = table["box"].combine_chunks()
            corners = [box.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x1", "y1", "x2", "y2")]
            names = np.arange(table.num_rows)
            kept = [greedy(*(c[at:to] for c in corners), limit, names[at:to]) for at, to in zip(turns, np.append(turns[1:], table.num_rows), strict=True)]
            yield from table.drop_columns("__group").take(pa.array(np.concatenate(kept))).combine_chunks().to_batches()

    return ordered.mapInArrow(keep, held.schema)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about ``_BOXES_AT_ONCE`` rows, no ``__group`` in two of them."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) < _BOXES_AT_ONCE:
            continue
        table = pa.Table.from_batches(waiting).combine_chunks()
        group = table["__group"].to_numpy()
        cut = int((group != group[-1]).sum())
        if cut:
            yield table.slice(0, cut)
        waiting = table.slice(cut).to_batches()
    if sum(b.num_rows for b in waiting):
        yield pa.Table.from_batches(waiting).combine_chunks()


def greedy(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, limit: float, names: np.ndarray) -> np.ndarray:
    """Of boxes from best to worst the ``names`` of those that stay."""
    areas = np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0)
    free = np.ones(len(names), bool)
    for i in range(len(names)):
        if free[i]:
            rest = i + 1 + np.flatnonzero(free[i + 1 :])
            both = np.maximum(np.minimum(x2[i], x2[rest]) - np.maximum(x1[i], x1[rest]), 0) * np.maximum(np.minimum(y2[i], y2[rest]) - np.maximum(y1[i], y1[rest]), 0)
            union = areas[i] + areas[rest] - both
            free[rest[np.where(union > 0, both / np.where(union > 0, union, 1), 0.0) >= limit]] = False
    return names[free]


def in_picture(detections: DataFrame, images: DataFrame) -> DataFrame:
    """Boxes of the square back in their pictures, ``box`` replaced."""
    joined = detections.join(images.select("image_index", "orig_w", "orig_h", "scale", "pad_x", "pad_y"), "image_index")
    back = unletterbox(F.col("box"), F.col("scale"), F.col("pad_x"), F.col("pad_y"), F.col("orig_w"), F.col("orig_h"))
    return joined.withColumn("box", back).drop("scale", "pad_x", "pad_y")


def detect(anchors: DataFrame, images: DataFrame) -> DataFrame:
    """Anchors to detections: threshold, suppression per picture and class, boxes in the picture."""
    return in_picture(suppressed(above_threshold(scored_anchors(anchors)), ["image_index", "class_id"]), images)


def rle_encode(mask: np.ndarray) -> dict[str, list[int]]:
    """Runs of a mask read down its columns, beginning with zeros (a first run of 0 if the first pixel is set)."""
    flat = np.asarray(mask, bool).ravel(order="F")
    if not flat.size:
        return {"size": list(mask.shape), "counts": []}
    edges = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    counts = np.diff(np.concatenate([[0], edges, [flat.size]])).tolist()
    return {"size": list(mask.shape), "counts": [0, *counts] if flat[0] else counts}


def rle_decode(size: list[int], counts: list[int]) -> np.ndarray:
    flat = np.repeat(np.arange(len(counts)) % 2 == 1, counts)
    return flat.reshape(size, order="F")


def mask_area(counts: Column) -> Column:
    """Set pixels of a run-length mask: its odd runs."""
    return F.aggregate(F.transform(counts, lambda c, i: F.when(i % 2 == 1, c).otherwise(0)), F.lit(0), lambda s, x: s + x)


def mask_runs(masks: DataFrame) -> DataFrame:
    """(image_index, class_name, det_id, start, stop): the set runs of each mask, as places down the columns. One fold over
    the counts of a mask."""
    none = "cast(array() as array<struct<start:int,stop:int>>)"
    runs = F.expr(
        f"aggregate(counts, named_struct('at', 0, 'odd', false, 'runs', {none}), "
        "(s, c) -> named_struct('at', s.at + c, 'odd', not s.odd, 'runs', if(s.odd and c > 0, array_append(s.runs, named_struct('start', s.at, 'stop', s.at + c)), s.runs)), s -> s.runs)"
    )
    return masks.select("image_index", "class_name", "det_id", F.explode(runs).alias("r")).select("image_index", "class_name", "det_id", "r.start", "r.stop")


def union_area(masks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pixels): pixels that at least one mask of the group sets, from the union of runs."""
    runs = mask_runs(masks).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("bigint").alias("covered"))

    def cover(state: Column, run: Column) -> Column:
        fresh = F.greatest(run["stop"] - F.greatest(run["start"], state["reach"]), F.lit(0))
        return F.struct(F.greatest(state["reach"], run["stop"]).alias("reach"), (state["covered"] + fresh).alias("covered"))

    return runs.select(*keys, F.aggregate("runs", zero, cover, lambda s: s["covered"]).alias("pixels"))


#: Run pairs at most that one step of ``mask_overlap`` meets, unless one mask alone has more.
_RUN_PAIRS_AT_ONCE = 1 << 16


def mask_overlap(masks: DataFrame, *, least: float = 0.0) -> DataFrame:
    """(image_index, det_a < det_b, iou) of masks of one picture that share a pixel and overlap by ``least`` or more; masks
    of one det_id count as one. Every mask travels once, to the partition of its picture; there the runs that meet are
    found in their order and summed up pair by pair, in steps of a bounded number of runs. No pair is stored."""
    held = masks.filter("image_index is not null and det_id is not null and counts is not null").select("image_index", "det_id", "counts")
    ordered = held.withColumn("__group", F.xxhash64(F.col("image_index").cast("string"))).repartition("__group").sortWithinPartitions("__group", "image_index", "det_id")
    kinds = dict(held.dtypes)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            picture, det = (table[c].combine_chunks() for c in ("image_index", "det_id"))
            codes = [pc.dictionary_encode(x).indices.to_numpy() for x in (picture, det)]
            turns = [np.concatenate([[False], c[1:] != c[:-1]]) for c in codes]
            mask = np.cumsum(turns[0] | turns[1])  # by picture and det_id, in their order
            first = np.flatnonzero(np.concatenate([[True], mask[1:] != mask[:-1]]))
            for a, b, iou in _overlaps(*_apart(table["counts"].combine_chunks(), mask), codes[0][first], least, _RUN_PAIRS_AT_ONCE):
                a, b = pa.array(first[a]), pa.array(first[b])
                yield pa.RecordBatch.from_arrays([picture.take(a), det.take(a), det.take(b), pa.array(iou)], ["image_index", "det_a", "det_b", "iou"])

    return ordered.mapInArrow(meet, f"image_index {kinds['image_index']}, det_a {kinds['det_id']}, det_b {kinds['det_id']}, iou double")


def _apart(counts: pa.ListArray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, number of the mask) of the set runs, which don't touch within a mask though several rows have its
    number. What follows a null count is unknown and sets nothing."""
    lengths, flat = pc.list_value_length(counts).to_numpy(), counts.flatten()
    row = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.cumsum(lengths, dtype=np.int64) - lengths
    count = pc.fill_null(flat, 0).to_numpy().astype(np.int64)
    if flat.null_count:
        nulls = np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))
        count[nulls > np.concatenate([[0], nulls])[begin][row]] = 0
    reach = np.concatenate([[0], np.cumsum(count)])
    stop = reach[1:] - reach[begin][row]
    held = np.flatnonzero(((np.arange(len(count)) - begin[row]) % 2 == 1) & (count > 0))
    start, stop, number = stop[held] - count[held], stop[held], mask[row[held]]
    wide = int(stop.max(initial=0)) + 1  # masks one after another on one line
    order = np.argsort(start + number * wide, kind="stable")
    start, stop, number = start[order] + number[order] * wide, stop[order] + number[order] * wide, number[order]
    far = np.maximum.accumulate(stop)
    fresh = np.flatnonzero(np.concatenate([[True], start[1:] > far[:-1]])) if len(start) else order
    ends = far[np.append(fresh[1:], len(start)) - 1] if len(start) else order
    number = number[fresh]
    return start[fresh] - number * wide, ends - number * wide, number


def _overlaps(start: np.ndarray, stop: np.ndarray, number: np.ndarray, picture: np.ndarray, least: float, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, iou) of the numbers of masks of one picture that share a place, a < b, from runs in the order of ``number``;
    ``picture`` tells the picture of each mask, pictures one after another."""
    total = len(picture)
    area = np.bincount(number, stop - start, total)
    last = np.append(np.flatnonzero(picture[1:] != picture[:-1]) + 1, total)
    end = last[np.searchsorted(last, np.arange(total), "right")]  # of the mask's picture
    runs = np.searchsorted(number, np.arange(total + 1))
    at = np.arange(total)
    most = (end - at - 1) * (runs[at + 1] - runs[at]) + runs[end] - runs[at + 1]  # two masks meet in fewer runs than both have
    wide = int(stop.max(initial=0)) + 1
    line = np.searchsorted(last, at, "right") * wide  # pictures one after another on one line
    start, stop = start + line[number], stop + line[number]
    upto, low = np.cumsum(most), 0
    while low < total:
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + at_once, "right")))
        part = slice(runs[low], runs[end[high - 1]])  # these masks and the later ones of the last picture
        order = np.argsort(start[part], kind="stable") + part.start
        s, e, m = start[order], stop[order], number[order]
        inner, n = m < high, np.arange(len(m))
        own, before = np.flatnonzero(inner), np.concatenate([[0], np.cumsum(inner)])
        to = np.searchsorted(s, e)
        many = np.where(inner, to - n - 1, before[to] - before[n + 1])  # an inner run meets all that begin in it, another one the inner ones
        x = np.repeat(n, many)
        y = np.arange(len(x)) + np.repeat(np.where(inner, n + 1, before[n + 1]) - (np.cumsum(many) - many), many)
        if len(own) < len(m):
            outer = ~inner[x]
            y[outer] = own[y[outer]]
        both = np.minimum(e[x], e[y]) - s[y]
        a, b = np.minimum(m[x], m[y]), np.maximum(m[x], m[y])
        width = end[low:high] - at[low:high] - 1
        slot = np.cumsum(width) - width
        shared = np.bincount(slot[a - low] + b - a - 1, both)
        found = np.flatnonzero(shared)
        a = np.searchsorted(slot, found, "right") - 1
        b = found - slot[a] + a + low + 1
        a += low
        iou = shared[found] / (area[a] + area[b] - shared[found])
        kept = iou >= least
        yield a[kept], b[kept], iou[kept]
        low = high


def build_masks(detections: DataFrame, prototypes: DataFrame, *, threshold: float = 0.5, square: int = 640) -> DataFrame:
    """Run-length masks of detections (coeffs, box in the picture, pad_x, pad_y, orig_w, orig_h, class_name) from their
    picture's prototypes (image_index, protos array<float>, n, side): products through a sigmoid, the letterbox's
    border cut off, bilinear to the picture's size, thresholded, cut to the box. A picture's prototypes meet all its
    detections at once. Detections without prototypes have no mask."""

    def build(one: pd.DataFrame, protos: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for p in protos.head(1).itertuples(index=False):
            basis = np.asarray(p.protos, np.float32).reshape(p.n, -1)
            fields = np.stack(one["coeffs"].to_list()).astype(np.float32) @ basis if len(one) else np.zeros((0, p.side**2), np.float32)
            for r, field in zip(one.itertuples(index=False), 1 / (1 + np.exp(-fields)), strict=True):
                grid = field.reshape(p.side, p.side)
                left, top = round(r.pad_x * p.side / square), round(r.pad_y * p.side / square)
                grid = grid[top : max(p.side - top, top + 1), left : max(p.side - left, left + 1)]
                mask = bilinear(grid, r.orig_h, r.orig_w) > threshold
                inside = np.zeros_like(mask)
                inside[max(int(r.y1), 0) : int(r.y2), max(int(r.x1), 0) : int(r.x2)] = True
                coded = rle_encode(mask & inside)
                rows.append((r.image_index, r.det_id, r.class_name, coded["size"], coded["counts"]))
        return pd.DataFrame(rows, columns=["image_index", "det_id", "class_name", "size", "counts"])

    asked = detections.select("image_index", "det_id", "class_name", "coeffs", "pad_x", "pad_y", "orig_w", "orig_h", "box.x1", "box.y1", "box.x2", "box.y2")
    schema = "image_index int, det_id int, class_name string, size array<int>, counts array<int>"
    return asked.groupBy("image_index").cogroup(prototypes.select("image_index", "protos", "n", "side").groupBy("image_index")).applyInPandas(build, schema)


def bilinear(grid: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resize with pixel centres aligned and edges repeated."""

    def places(n: int, of: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * of / n - 0.5, 0, of - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, of - 1), at - low

    y0, y1, fy = places(height, grid.shape[0])
    x0, x1, fx = places(width, grid.shape[1])
    upper = grid[y0][:, x0] * (1 - fx) + grid[y0][:, x1] * fx
    lower = grid[y1][:, x0] * (1 - fx) + grid[y1][:, x1] * fx
    return upper * (1 - fy)[:, None] + lower * fy[:, None]


def findings(masks: DataFrame, scores: DataFrame, images: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, class_name, confidence, lesions, affected_pixels, affected_ratio, severity, n_images, image_indices), largest
    ratio first.

    ``scores``: image_index, det_id, class_name, score. With ``keys`` (of ``images``, such as a request) each of them has
    findings of its own, and ``image_indices`` are its pictures; over a whole table select ``n_images`` instead, and no
    pictures are listed. The ratio is over the pixels of all its pictures, those without a detection among them."""
    sizes = images.select("image_index", *keys, (F.col("orig_w").cast("bigint") * F.col("orig_h")).alias("px"))
    pixels = sizes.groupBy(*keys).agg(F.coalesce(F.sum("px"), F.lit(0)).alias("__all"))
    areas, seen = union_area(masks, ["image_index", "class_name"]), scores
    if keys:
        of = sizes.drop("px")
        areas, seen = areas.join(of, "image_index"), seen.join(of, "image_index")
    areas = areas.groupBy(*keys, "class_name").agg(F.sum("pixels").alias("affected_pixels"))
    seen = seen.groupBy(*keys, "class_name").agg(F.max("score").alias("confidence"), F.count("*").alias("lesions"), F.count_distinct("image_index").alias("n_images"), F.sort_array(F.collect_set("image_index")).alias("image_indices"))
    joined = seen.join(areas, [*keys, "class_name"], "left").fillna(0, ["affected_pixels"])
    joined = joined.join(pixels, [*keys]) if keys else joined.withColumn("__all", pixels.scalar())
    ratio = share(F.col("affected_pixels"), F.col("__all"))
    found = joined.select(*keys, "class_name", "confidence", "lesions", "affected_pixels", ratio.alias("affected_ratio"), severity(ratio).alias("severity"), "n_images", "image_indices")
    return found.orderBy(*keys, F.desc("affected_ratio"), "class_name")


def classes_per_image(detections: DataFrame) -> DataFrame:
    """(image_index, lesions, classes): detections of each picture and the sorted names of their classes."""
    return detections.groupBy("image_index").agg(F.count("*").alias("lesions"), F.sort_array(F.collect_set("class_name")).alias("classes"))


def overall_area(masks: DataFrame, images: DataFrame) -> DataFrame:
    """One row: pixels that any mask sets, their share of all, severity, masks. Without masks the share is 0 and LOW."""
    pixels = images.agg(F.coalesce(F.sum(F.col("orig_w").cast("bigint") * F.col("orig_h")), F.lit(0)).alias("__all"))
    covered = union_area(masks, ["image_index"]).agg(F.coalesce(F.sum("pixels"), F.lit(0)).alias("affected_pixels"))
    counted = masks.agg(F.count("*").alias("lesions"))
    ratio = share(F.col("affected_pixels"), F.col("__all"))
    return covered.withColumns({"lesions": counted.scalar(), "__all": pixels.scalar()}).select("affected_pixels", "lesions", ratio.alias("affected_ratio"), severity(ratio).alias("severity"))


def panicle_verdicts(scores: DataFrame, threshold: float = 0.5, margin: float = 0.10) -> DataFrame:
    """``schemas.SPIKE_SCORES`` with label, confidence and uncertain."""
    return scores.withColumns({"label": F.when(F.col("score") > threshold, "unhealthy").otherwise("healthy"), "confidence": sure_of(F.col("score"), threshold), "uncertain": uncertain(F.col("score"), threshold, margin)})


def worst_case(verdicts: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, overall, n_unhealthy, n_healthy, n_uncertain): unhealthy if any picture is."""
    bad = F.count_if(F.col("label") == "unhealthy")
    return verdicts.groupBy(key).agg(F.when(bad > 0, "unhealthy").otherwise("healthy").alias("overall"), bad.alias("n_unhealthy"), F.count_if(F.col("label") == "healthy").alias("n_healthy"), F.count_if("uncertain").alias("n_uncertain"))
