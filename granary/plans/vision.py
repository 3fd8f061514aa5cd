"""Queries of boxes, masks, severity and verdicts, over boxes and masks made of line items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import geometry as G
from granary.operators import detections as D
from granary.operators import pictures as P
from granary.plans.common import spread, table


def made_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as scored boxes: pictures of some forty boxes."""
    rows = spread(table(spark, folder, "lineitem"))
    x, y = (F.col("l_partkey") % 97).cast("double"), (F.col("l_suppkey") % 89).cast("double")
    return rows.select(
        F.expr("l_orderkey div 40").alias("image_index"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("det_id"), F.expr("l_linenumber % 3").alias("class_id"),
        (F.col("l_extendedprice") % 1000 / 1000).alias("score"), G.box(x, y, x + F.col("l_quantity"), y + 20).alias("box"),
    )


_BOXES = """
    boxes as (select l_orderkey // 40 as image_index, l_orderkey * 8 + l_linenumber as det_id, l_linenumber % 3 as class_id, l_extendedprice % 1000 / 1000 as score,
        (l_partkey % 97)::double as x1, (l_suppkey % 89)::double as y1, (l_partkey % 97)::double + l_quantity as x2, (l_suppkey % 89)::double + 20 as y2 from lineitem)"""


def suppressed_boxes(spark: SparkSession, folder: str) -> DataFrame:
    kept = D.suppressed(made_boxes(spark, folder), ["image_index", "class_id"], id_col="det_id")
    return kept.select("image_index", "class_id", "det_id")


def box_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps of at least a half between boxes of a picture and class."""
    rows = made_boxes(spark, folder)
    other = rows.select("image_index", "class_id", F.col("det_id").alias("det_b"), F.col("box").alias("b"))
    met = rows.join(other, ["image_index", "class_id"]).filter("det_id < det_b").withColumn("iou", G.iou(F.col("box"), F.col("b")))
    return met.filter("iou >= 0.5").select("image_index", F.col("det_id").alias("det_a"), "det_b", F.round("iou", 6).alias("iou"))


def letterboxes(spark: SparkSession, folder: str) -> DataFrame:
    """Geometry of pictures whose sides are made of parts."""
    rows = table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") % 911 + 32).cast("double").alias("w"), (F.col("p_size") * 37 + 40).cast("double").alias("h"))
    g = rows.withColumn("g", G.letterbox(F.col("w"), F.col("h")))
    return g.select("p_partkey", F.round("g.scale", 9).alias("scale"), "g.new_w", "g.new_h", "g.pad_x", "g.pad_y")


def severity_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by the band of a share from 0 to 0.25."""
    ratio = F.col("o_orderkey") % 250 / 1000
    return table(spark, folder, "orders").select(G.severity(ratio).alias("severity"), ratio.alias("r")).groupBy("severity").agg(F.count("*").alias("n"), F.round(F.max("r"), 6).alias("most"))


def made_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as masks of two runs in pictures of 20 x 30."""
    first = (F.col("l_partkey") % 200).cast("int")
    one, gap, two = F.col("l_quantity").cast("int"), (F.col("l_suppkey") % 50).cast("int") + 1, F.lit(30)
    counts = F.array(first, one, gap, two, F.lit(600) - first - one - gap - two)
    return spread(table(spark, folder, "lineitem")).select(
        F.expr("l_orderkey div 40").cast("int").alias("image_index"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("det_id"),
        F.concat(F.lit("c"), F.expr("l_linenumber % 3")).alias("class_name"), F.array(F.lit(20), F.lit(30)).alias("size"), counts.alias("counts"),
    )


MASKS_SQL = """
    masks as (select l_orderkey // 40 as image_index, l_orderkey * 8 + l_linenumber as det_id, 'c' || (l_linenumber % 3) as class_name,
        l_partkey % 200 as a, l_quantity::int as one, l_suppkey % 50 + 1 as gap from lineitem),
    pixels as (select image_index, det_id, class_name, unnest(list_concat(range(a, a + one), range(a + one + gap, a + one + gap + 30))) as p from masks)"""


def mask_areas(spark: SparkSession, folder: str) -> DataFrame:
    return made_masks(spark, folder).select("image_index", "det_id", D.mask_area(F.col("counts")).alias("area"))


def union_areas(spark: SparkSession, folder: str) -> DataFrame:
    return D.union_area(made_masks(spark, folder), ["image_index", "class_name"])


def class_findings(spark: SparkSession, folder: str) -> DataFrame:
    masks = made_masks(spark, folder)
    images = masks.select("image_index").distinct().withColumns({"orig_w": F.lit(30), "orig_h": F.lit(20)})
    scores = masks.select("image_index", "det_id", "class_name", (F.col("det_id") % 100 / 100).alias("score"))
    found = D.findings(masks, scores, images)
    return found.select("class_name", "confidence", "lesions", "affected_pixels", F.round("affected_ratio", 9).alias("affected_ratio"), "severity", "n_images")


def mask_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of masks of one picture that share at least half of their pixels."""
    met = D.mask_overlap(made_masks(spark, folder), least=0.5)
    return met.select("image_index", "det_a", "det_b", F.round("iou", 6).alias("iou"))


def made_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as anchors of a detector with six classes, in a square of 640."""
    rows = spread(table(spark, folder, "lineitem"))
    scores = F.array(*(F.when(F.col("l_linenumber") % 6 == c, F.col("l_extendedprice") % 1000 / 1000).otherwise(0.05).cast("float") for c in range(6)))
    return rows.select(
        F.expr("l_orderkey div 40").cast("int").alias("image_index"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("anchor_id"), (F.col("l_partkey") % 97 * 5 + 30).cast("float").alias("cx"),
        (F.col("l_suppkey") % 89 * 6 + 30).cast("float").alias("cy"), (F.col("l_quantity") * 2).cast("float").alias("w"), F.lit(40.0).cast("float").alias("h"), scores.alias("class_scores"),
    )


def detected(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors through thresholds, suppression and back into pictures of 1280 x 960."""
    anchors = made_anchors(spark, folder)
    images = anchors.select("image_index").distinct().withColumns({"orig_w": F.lit(1280), "orig_h": F.lit(960), "scale": F.lit(0.5), "pad_x": F.lit(0.0), "pad_y": F.lit(80.0)})
    return D.detect(anchors, images).select("image_index", "anchor_id", "class_id", F.round(F.col("score").cast("double"), 6).alias("score"), "box.x1", "box.y1", "box.x2", "box.y2")


def tensor_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as pictures of one colour in eight sizes, as letterboxed tensors of 16 x 16: the sum of each."""
    rows = table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") % 4 + 1).cast("int").alias("width"), (F.col("p_partkey") % 7 + 1).cast("int").alias("height"), F.format_string("%02X%02X%02X", F.col("p_partkey") % 256, F.col("p_partkey") % 77, F.col("p_size")).alias("colour"))
    images = rows.withColumn("pixels", F.unhex(F.call_function("repeat", F.col("colour"), F.col("width") * F.col("height"))))
    made = P.tensors(images, lambda p: P.detector_tensor(p, 16), "p_partkey")
    return made.select("p_partkey", F.array_join("shape", "x").alias("shape"), F.round(F.aggregate("tensor", F.lit(0.0), lambda s, x: s + x), 2).alias("total"))


def overall_area(spark: SparkSession, folder: str) -> DataFrame:
    masks = made_masks(spark, folder)
    images = masks.select("image_index").distinct().withColumns({"orig_w": F.lit(30), "orig_h": F.lit(20)})
    return D.overall_area(masks, images).withColumn("affected_ratio", F.round("affected_ratio", 9))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("image_index"), (F.col("event_id") % 101 / 100).alias("score"))


def panicle_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    told = D.panicle_verdicts(_scores(spark, folder))
    return told.select("image_index", "label", F.round("confidence", 6).alias("confidence"), "uncertain")


def worst_case(spark: SparkSession, folder: str) -> DataFrame:
    return D.worst_case(D.panicle_verdicts(_scores(spark, folder)))


def thresholded(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes that reach the threshold of their class, counted."""
    kept = D.above_threshold(made_boxes(spark, folder))
    return kept.groupBy("class_id").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (suppressed_boxes, box_overlaps, letterboxes, severity_bands, mask_areas, union_areas, mask_overlaps, detected, tensor_sums, class_findings, overall_area, panicle_verdicts, worst_case, thresholded)
}

_IOU = "greatest(least(k.x2, y.kept[1].x2) - greatest(k.x1, y.kept[1].x1), 0) * greatest(least(k.y2, y.kept[1].y2) - greatest(k.y1, y.kept[1].y1), 0)"
_AREAS = "(k.x2 - k.x1) * (k.y2 - k.y1) + (y.kept[1].x2 - y.kept[1].x1) * (y.kept[1].y2 - y.kept[1].y1)"

SQL = {
    "tensor_sums": """
        with p as (select p_partkey, p_partkey % 4 + 1 as w, p_partkey % 7 + 1 as h, p_partkey % 256 + p_partkey % 77 + p_size as c from part), s as (select *, least(16.0::double / w, 16.0::double / h) as f from p),
        n as (select *, greatest(round_even(w * f, 0), 1) * greatest(round_even(h * f, 0), 1) as area from s)
        select p_partkey, '3x16x16' as shape, round((area * c + (256 - area) * 3 * 114) / 255.0::double, 2) as total from n""",
    "mask_overlaps": f"""
        with {MASKS_SQL}, d as (select distinct image_index, det_id, p from pixels), b as (select x.image_index, x.det_id as det_a, y.det_id as det_b, count(*) as n from d x join d y on x.image_index = y.image_index and x.p = y.p and x.det_id < y.det_id group by all),
        a as (select det_id, count(*) as area from d group by det_id)
        select cast(b.image_index as integer) as image_index, det_a, det_b, round(n / (p.area + q.area - n), 6) as iou from b join a p on p.det_id = det_a join a q on q.det_id = det_b where n / (p.area + q.area - n) >= 0.5""",
    "detected": f"""
        with r as (select cast(l_orderkey // 40 as integer) as image_index, l_orderkey * 8 + l_linenumber as anchor_id, l_linenumber % 6 as c, (l_extendedprice % 1000 / 1000)::float as s, (l_partkey % 97 * 5 + 30)::double as cx,
            (l_suppkey % 89 * 6 + 30)::double as cy, (l_quantity * 2)::double as w from lineitem),
        m as (select *, case when s >= 0.05::float then c when c = 0 then 1 else 0 end as class_id, greatest(s, 0.05::float) as score from r),
        k as (select *, cx - w / 2 as x1, cy - 20 as y1, cx + w / 2 as x2, cy + 20 as y2 from m where score >= case class_id when 0 then 0.25::float when 4 then 0.30::float when 5 then 0.30::float else 0.15::float end),
        l as (select image_index, class_id, list({{'kept': [{{'id': anchor_id, 'score': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}]}} order by score desc, anchor_id) as boxes from k group by all),
        n as (select image_index, class_id, list_reduce(boxes, lambda x, y: case when len(list_filter(x.kept, lambda k: {_IOU} >= 0.45 * ({_AREAS} - {_IOU}) and {_AREAS} - {_IOU} > 0)) > 0 then x
            else {{'kept': list_concat(x.kept, y.kept)}} end) as s from l),
        u as (select image_index, class_id, unnest(s.kept) as b from n)
        select image_index, b.id as anchor_id, cast(class_id as integer) as class_id, round(b.score::double, 6) as score, least(greatest(b.x1 / 0.5, 0), 1280)::double as x1, least(greatest((b.y1 - 80) / 0.5, 0), 960)::double as y1,
            least(greatest(b.x2 / 0.5, 0), 1280)::double as x2, least(greatest((b.y2 - 80) / 0.5, 0), 960)::double as y2 from u""",
    "suppressed_boxes": f"""
        with {_BOXES}, l as (select image_index, class_id, list({{'kept': [{{'id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}]}} order by score desc, det_id) as boxes from boxes group by all),
        r as (select image_index, class_id, list_reduce(boxes, lambda x, y: case when len(list_filter(x.kept, lambda k: {_IOU} >= 0.45 * ({_AREAS} - {_IOU}) and {_AREAS} - {_IOU} > 0)) > 0 then x
            else {{'kept': list_concat(x.kept, y.kept)}} end) as s from l)
        select image_index, class_id, unnest(list_transform(s.kept, lambda k: k.id)) as det_id from r""",
    "box_overlaps": f"""
        with {_BOXES}, p as (select a.image_index, a.det_id as det_a, b.det_id as det_b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) as shared_area,
            (a.x2 - a.x1) * (a.y2 - a.y1) as aa, (b.x2 - b.x1) * (b.y2 - b.y1) as ab from boxes a join boxes b on a.image_index = b.image_index and a.class_id = b.class_id and a.det_id < b.det_id)
        select image_index, det_a, det_b, round(shared_area / (aa + ab - shared_area), 6) as iou from p where aa + ab - shared_area > 0 and shared_area / (aa + ab - shared_area) >= 0.5""",
    "letterboxes": """
        with p as (select p_partkey, (p_partkey % 911 + 32)::double as w, (p_size * 37 + 40)::double as h from part), s as (select *, least(640.0::double / w, 640.0::double / h) as scale from p),
        n as (select *, round_even(w * scale, 0) as nw, round_even(h * scale, 0) as nh from s)
        select p_partkey, round(scale, 9) as scale, nw::int as new_w, nh::int as new_h, (640 - nw) / 2 as pad_x, (640 - nh) / 2 as pad_y from n""",
    "severity_bands": """
        with r as (select o_orderkey % 250 / 1000 as r from orders)
        select case when r < 0.03 then 'LOW' when r < 0.10 then 'MODERATE' when r < 0.18 then 'HIGH' else 'CRITICAL' end as severity, count(*) as n, round(max(r), 6) as most from r group by 1""",
    "mask_areas": "select cast(l_orderkey // 40 as integer) as image_index, l_orderkey * 8 + l_linenumber as det_id, l_quantity::int + 30 as area from lineitem",
    "union_areas": f"with {MASKS_SQL} select cast(image_index as integer) as image_index, class_name, count(distinct p) as pixels from pixels group by all",
    "class_findings": f"""
        with {MASKS_SQL}, u as (select class_name, count(*) as px from (select distinct image_index, class_name, p from pixels) group by all),
        t as (select count(distinct image_index) * 600 as whole from masks),
        s as (select class_name, max(det_id % 100 / 100) as confidence, count(*) as lesions, count(distinct image_index) as n_images from masks group by all)
        select class_name, confidence, lesions, px as affected_pixels, round(px / whole, 9) as affected_ratio,
            case when px / whole < 0.03 then 'LOW' when px / whole < 0.10 then 'MODERATE' when px / whole < 0.18 then 'HIGH' else 'CRITICAL' end as severity, n_images
        from s join u using (class_name), t""",
    "overall_area": f"""
        with {MASKS_SQL}, u as (select count(*) as px from (select distinct image_index, p from pixels)), t as (select count(distinct image_index) * 600 as whole, count(*) as lesions from masks)
        select px as affected_pixels, lesions, round(px / whole, 9) as affected_ratio, case when px / whole < 0.03 then 'LOW' when px / whole < 0.10 then 'MODERATE' when px / whole < 0.18 then 'HIGH' else 'CRITICAL' end as severity from u, t""",
    "panicle_verdicts": """
        with s as (select event_id as image_index, event_id % 101 / 100 as score from events)
        select image_index, case when score > 0.5 then 'unhealthy' else 'healthy' end as label, round(case when score > 0.5 then score else 1 - score end, 6) as confidence, abs(score - 0.5) < 0.10 as uncertain from s""",
    "worst_case": """
        with s as (select user_id as request_id, event_id % 101 / 100 as score from events)
        select request_id, case when max(score) > 0.5 then 'unhealthy' else 'healthy' end as overall, count(*) filter (where score > 0.5) as n_unhealthy, count(*) filter (where score <= 0.5) as n_healthy,
            count(*) filter (where abs(score - 0.5) < 0.10) as n_uncertain from s group by request_id""",
    "thresholded": f"""
        with {_BOXES} select class_id, count(*) as n from boxes where score::float >= case class_id when 0 then 0.25::float else 0.15::float end group by class_id""",
}
