"""Queries around a detector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import detector as d
from ..operators import metrics as m
from .catalogue import register
from .fixtures import Fixtures
from .queries_metrics import _RANKED

_RAW = "SELECT l_orderkey % 200 AS image_id, rn AS anchor_no, l_partkey % 900 + 0.5 AS cx, l_suppkey % 700 + 0.25 AS cy, 20 + rn % 60 AS w, 30 + rn % 50 AS h, CAST((rn * 31) % 1009 AS DOUBLE) / CAST(1009 AS DOUBLE) AS obj, CAST((rn * 17) % 997 AS DOUBLE) / CAST(997 AS DOUBLE) AS c0, CAST((rn * 23) % 991 AS DOUBLE) / CAST(991 AS DOUBLE) AS c1, CAST((rn * 29) % 983 AS DOUBLE) / CAST(983 AS DOUBLE) AS c2 FROM "


def _raw(fx: Fixtures) -> DataFrame:
    return fx.spark.sql(_RAW + "{base}", base=fx.base).withColumn("cls", F.array("c0", "c1", "c2"))


_BOXED = "image_id, anchor_no, cls_no, round(score, 9) AS score, cx - w / 2.0::DOUBLE AS x1, cy - h / 2.0::DOUBLE AS y1, cx + w / 2.0::DOUBLE AS x2, cy + h / 2.0::DOUBLE AS y2"


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("image_id", "anchor_no", F.col("cls_no").cast("long"), F.round("score", 9).alias("score"), *(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")))


@register(f"""WITH r AS ({_RAW} fx_base), s AS (SELECT *, greatest(c0 * obj, c1 * obj, c2 * obj) AS score, CASE WHEN c0 * obj >= c1 * obj AND c0 * obj >= c2 * obj THEN 0 WHEN c1 * obj >= c2 * obj THEN 1 ELSE 2 END::BIGINT AS cls_no FROM r WHERE obj > 0.25),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, anchor_no, cls_no) AS n FROM s WHERE score > 0.25) SELECT {_BOXED} FROM k WHERE n <= 10""")
def candidates_conf(fx: Fixtures) -> DataFrame:
    return _shown(d.candidates(_raw(fx), most=10))


@register(f"""WITH r AS ({_RAW} fx_base), s AS (SELECT *, unnest([c0 * obj, c1 * obj, c2 * obj]) AS score, unnest([0, 1, 2])::BIGINT AS cls_no FROM r WHERE obj > 0.25),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, anchor_no, cls_no) AS n FROM s WHERE score > 0.25 AND cls_no IN (0, 2)) SELECT {_BOXED} FROM k WHERE n <= 10""")
def candidates_multi_label(fx: Fixtures) -> DataFrame:
    return _shown(d.candidates(_raw(fx), multi_label=True, classes=(0, 2), most=10))


_S = "(1 / (1 + exp(-{})))"


@register(f"""WITH r AS (SELECT l_orderkey % 200 AS image_id, rn AS anchor_no, l_discount * 10 - 0.5 AS tx, l_tax * 10 AS ty, l_discount AS tw, l_tax AS th, l_partkey % 80 AS gx, l_suppkey % 80 AS gy FROM fx_base)
SELECT image_id, anchor_no, round(({_S.format('tx')} * 2 + gx - 0.5) * 8, 6) AS cx, round(({_S.format('ty')} * 2 + gy - 0.5) * 8, 6) AS cy, round(pow({_S.format('tw')} * 2, 2) * 10, 6) AS w, round(pow({_S.format('th')} * 2, 2) * 13, 6) AS h FROM r""")
def decode_head(fx: Fixtures) -> DataFrame:
    r = fx.base.selectExpr("l_orderkey % 200 AS image_id", "rn AS anchor_no", "l_discount * 10 - 0.5D AS tx", "l_tax * 10 AS ty", "l_discount AS tw", "l_tax AS th", "l_partkey % 80 AS gx", "l_suppkey % 80 AS gy", "10 AS aw", "13 AS ah")
    return d.decode_head(r, 8).select("image_id", "anchor_no", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")))


@register(f"WITH r AS ({_RAW} fx_base) SELECT anchor_no, round(1000 - cx / 0.83::DOUBLE, 6) AS cx, round(cy / 0.83::DOUBLE, 6) AS cy, round(w / 0.83::DOUBLE, 6) AS w, round(h / 0.83::DOUBLE, 6) AS h FROM r")
def tta_descale(fx: Fixtures) -> DataFrame:
    return d.descale(_raw(fx), 0.83, "lr", 1000, 800).select("anchor_no", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")))


@register("""WITH l AS (SELECT node_id AS label_id, (x1 + x2) / 4000.0::DOUBLE * 40 AS x, (y1 + y2) / 4000.0::DOUBLE * 40 AS y, (x2 - x1) / 2000.0::DOUBLE * 40 AS w, (y2 - y1) / 2000.0::DOUBLE * 40 AS h FROM fx_boxes),
a AS (SELECT l.*, k AS anchor_no FROM l, (VALUES (0, 1.25::DOUBLE, 1.625::DOUBLE), (1, 4.0::DOUBLE, 0.3::DOUBLE), (2, 2.0::DOUBLE, 3.0::DOUBLE)) v(k, aw, ah) WHERE greatest(w / aw, aw / w, h / ah, ah / h) < 4),
o AS (SELECT *, 0.0::DOUBLE AS dx, 0.0::DOUBLE AS dy FROM a UNION ALL SELECT *, 0.5, 0 FROM a WHERE x - floor(x) < 0.5 AND x > 1 UNION ALL SELECT *, 0, 0.5 FROM a WHERE y - floor(y) < 0.5 AND y > 1
 UNION ALL SELECT *, -0.5, 0 FROM a WHERE (40 - x) - floor(40 - x) < 0.5 AND 40 - x > 1 UNION ALL SELECT *, 0, -0.5 FROM a WHERE (40 - y) - floor(40 - y) < 0.5 AND 40 - y > 1)
SELECT label_id, anchor_no, CAST(least(greatest(floor(x - dx), 0), 39) AS INT) AS gi, CAST(least(greatest(floor(y - dy), 0), 39) AS INT) AS gj FROM o""")
def build_targets(fx: Fixtures) -> DataFrame:
    labels = fx.boxes.selectExpr("node_id AS label_id", "(x1 + x2) / 4000.0D AS x", "(y1 + y2) / 4000.0D AS y", "(x2 - x1) / 2000.0D AS w", "(y2 - y1) / 2000.0D AS h")
    return d.build_targets(labels, ((1.25, 1.625), (4.0, 0.3), (2.0, 3.0)), 40)


@register("SELECT seg_id, least(x1, x2, x1 + 5) AS bx1, least(y1, y2, y2 + 9) AS by1, greatest(x1, x2, x1 + 5) AS bx2, greatest(y1, y2, y2 + 9) AS by2, round(x1 + (x2 - x1) * 0.75::DOUBLE, 6) AS mx FROM fx_segments")
def segments2boxes(fx: Fixtures) -> DataFrame:
    """Triangles; the second of five points at even steps is three quarters along the first side."""
    pts = F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")), (F.col("x1") + 5, F.col("y2") + 9))))
    b = d.box_of_points(pts)
    return fx.segments.select("seg_id", *(b[k].cast("long").alias(f"b{k}") for k in b), F.round(F.get(d.resampled(pts, 5), F.lit(1))["x"], 6).alias("mx"))


@register("SELECT node_id, round(list_sum(list_transform(range(0, 32), lambda i: ((node_id >> i) & 1) * ((x1 * 40503 >> i) & 1))) / (bit_count(node_id % 4294967296) + bit_count((x1 * 40503) % 4294967296) - list_sum(list_transform(range(0, 32), lambda i: ((node_id >> i) & 1) * ((x1 * 40503 >> i) & 1))) + 1e-7::DOUBLE), 6) AS iou FROM fx_boxes")
def mask_iou(fx: Fixtures) -> DataFrame:
    bits = lambda c: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftright", c.cast("long"), i).bitwiseAND(1).cast("double"))
    return fx.boxes.select("node_id", F.round(d.mask_iou(bits(F.col("node_id")), bits(F.col("x1") * 40503)), 6).alias("iou"))


_M = (0.9, 0.2, -50.0, -0.1, 1.1, 20.0)
_XS = ", ".join(f"{x} * 0.9::DOUBLE + {y} * 0.2::DOUBLE - 50" for x in ("x1", "x2") for y in ("y1", "y2"))
_YS = ", ".join(f"{x} * -0.1::DOUBLE + {y} * 1.1::DOUBLE + 20" for x in ("x1", "x2") for y in ("y1", "y2"))


@register(f"""WITH t AS (SELECT node_id, (x2 - x1) * (y2 - y1) AS area, least(greatest(least({_XS}), 0), 1500) AS a1, least(greatest(least({_YS}), 0), 900) AS b1, least(greatest(greatest({_XS}), 0), 1500) AS a2, least(greatest(greatest({_YS}), 0), 900) AS b2 FROM fx_boxes)
SELECT node_id, round(a1, 4) AS x1, round(b1, 4) AS y1, round(a2, 4) AS x2, round(b2, 4) AS y2, a2 - a1 > 2 AND b2 - b1 > 2 AND (a2 - a1) * (b2 - b1) / (area + 1e-16) > 0.1 AND greatest((a2 - a1) / (b2 - b1 + 1e-16), (b2 - b1) / (a2 - a1 + 1e-16)) < 100 AS keep FROM t""")
def random_perspective_boxes(fx: Fixtures) -> DataFrame:
    b = g.Box.of()
    made = d.transformed_box(b, _M, 1500, 900)
    return fx.boxes.select("node_id", *(F.round(c, 4).alias(k) for k, c in made.items()), d.worth_keeping(b, made).alias("keep"))


@register("SELECT node_id, pid_id FROM (SELECT *, count(*) OVER (PARTITION BY pid_id) AS n FROM fx_boxes WHERE symbol_class IN ('vessel', 'gate_valve')) WHERE n >= 30")
def include_class_min_items(fx: Fixtures) -> DataFrame:
    return d.of_images(fx.boxes, 30, ("vessel", "gate_valve")).select("node_id", "pid_id")


@register("SELECT count(*) AS n, count(*) FILTER (x2 - x1 < 65 OR y2 - y1 < 65) AS small, count(*) FILTER (x2 - x1 >= 62 AND y2 - y1 >= 62) AS used FROM fx_boxes")
def small_object_report(fx: Fixtures) -> DataFrame:
    return d.small_objects(fx.boxes, 65, 62)


@register("SELECT part, pid_id, (row_number() OVER (PARTITION BY part ORDER BY height / width::DOUBLE, pid_id) - 1) // 16 AS batch FROM (SELECT p_size % 3 AS part, p_partkey AS pid_id, 600 + p_size * 50 AS width, 500 + p_partkey % 400 AS height FROM part)")
def sort_aspect(fx: Fixtures) -> DataFrame:
    return d.batches_by_shape(fx.part.selectExpr("p_size % 3 AS part", "p_partkey AS pid_id", "600 + p_size * 50 AS width", "500 + p_partkey % 400 AS height"), 16)


@register("SELECT target, round(avg(CASE WHEN r1 = target THEN 1.0::DOUBLE ELSE 0 END), 6) AS top1, round(avg(CASE WHEN target IN (r1, r2, r3) THEN 1.0::DOUBLE ELSE 0 END), 6) AS topk FROM (SELECT l_partkey % 7 AS target, l_suppkey % 7 AS r1, (l_suppkey + 1) % 7 AS r2, (l_suppkey + 3) % 7 AS r3 FROM lineitem) GROUP BY ROLLUP(target)")
def topk_accuracy(fx: Fixtures) -> DataFrame:
    return d.top_k_accuracy(fx.lineitem.selectExpr("l_partkey % 7 AS target", "array(l_suppkey % 7, (l_suppkey + 1) % 7, (l_suppkey + 3) % 7) AS ranked"), 3)


@register(f"""WITH {_RANKED}, c AS (SELECT rk.*, b.confidence, tp / (tp + fp)::DOUBLE AS p, tp / n_labels::DOUBLE AS r FROM rk JOIN fx_boxes b ON rk.node_id = b.node_id), f AS (SELECT *, round(2 * p * r / (p + r + 1e-16), 9) AS f1 FROM c)
SELECT symbol_class, f1, tp::BIGINT AS tp, fp::BIGINT AS fp FROM (SELECT *, row_number() OVER (PARTITION BY symbol_class ORDER BY f1 DESC, confidence DESC, node_id) AS n FROM f) WHERE n = 1""")
def best_f1_threshold(fx: Fixtures) -> DataFrame:
    return d.best_f1(m.ranked(fx.boxes, fx.truth))


@register("""WITH p AS (SELECT p_size % 5 AS run, p_partkey AS epoch, p_retailprice AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY p_size % 5) AS n, sum(p_retailprice) OVER (PARTITION BY p_size % 5 ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s,
 first_value(p_retailprice) OVER (PARTITION BY p_size % 5 ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a, last_value(p_retailprice) OVER (PARTITION BY p_size % 5 ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM part WINDOW w AS (PARTITION BY p_size % 5 ORDER BY p_partkey))
SELECT run, epoch, round((s + greatest(3 - i, 0) * a + greatest(i + 2 - n, 0) * z) / 5, 4) AS value FROM p""")
def smooth_box(fx: Fixtures) -> DataFrame:
    return d.smoothed(fx.part.selectExpr("p_size % 5 AS run", "p_partkey AS epoch", "p_retailprice AS value"), "run", "epoch", "value", 2).withColumn("value", F.round("value", 4))


@register("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def best_generation(fx: Fixtures) -> DataFrame:
    return d.best_generation(fx.part.select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey")


@register("SELECT event_type AS stage, round(avg(value), 6) AS ms FROM events GROUP BY event_type")
def speed_stats(fx: Fixtures) -> DataFrame:
    return d.stage_speed(fx.events.selectExpr("event_type AS stage", "value AS ms"))


@register("SELECT b.node_id FROM fx_boxes b JOIN fx_truth t ON b.node_id = t.gt_id WHERE CASE WHEN t.gt_id % 2 = 0 THEN t.symbol_class ELSE 'vessel' END = b.symbol_class")
def second_stage_agree(fx: Fixtures) -> DataFrame:
    again = fx.truth.selectExpr("gt_id AS node_id", "CASE WHEN gt_id % 2 = 0 THEN symbol_class ELSE 'vessel' END AS symbol_class")
    return d.second_stage(fx.boxes, again).select("node_id")
