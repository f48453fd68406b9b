"""Queries over boxes, labels and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import tags as t
from ..functions.dims import SOURCE_PRIORITY, sql_case
from ..operators import spatial as s
from .catalogue import register
from .fixtures import Fixtures

_INTER = "greatest(0, least({p}.x2, {q}.x2) - greatest({p}.x1, {q}.x1)) * greatest(0, least({p}.y2, {q}.y2) - greatest({p}.y1, {q}.y1))"


def _inter(p: str, q: str) -> str:
    return _INTER.format(p=p, q=q)


def _area(p: str) -> str:
    return f"({p}.x2 - {p}.x1) * ({p}.y2 - {p}.y1)"


def _union(p: str, q: str) -> str:
    return f"({_area(p)} + {_area(q)} - {_inter(p, q)})"


def _fold_sql(rows: str, by: str, order: str, fields: str, clash: str, out: str) -> str:
    """Greedy selection in DuckDB: one recursion step per rank, all groups at once."""
    struct = "{" + ", ".join(f"'{x}': d.{x}" for x in fields.split()) + "}"
    empty = "[]::STRUCT(" + ", ".join(f"{x} BIGINT" for x in fields.split()) + ")[]"
    keys = [k.strip() for k in by.split(",")]
    on = " AND ".join(f"d.{k} = f.{k}" for k in keys)
    return f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS k FROM {rows}),
f AS (SELECT {by}, 0::BIGINT AS k, {empty} AS acc FROM (SELECT DISTINCT {by} FROM o)
  UNION ALL
  SELECT {', '.join('d.' + k for k in keys)}, d.k, CASE WHEN len(list_filter(f.acc, lambda p: {clash})) > 0 THEN f.acc ELSE list_append(f.acc, {struct}) END
  FROM f JOIN o d ON {on} AND d.k = f.k + 1),
l AS (SELECT {by}, arg_max(acc, k) AS acc FROM f GROUP BY {by}),
u AS (SELECT {by}, unnest(acc) AS e FROM l)
SELECT {by}, {out} FROM u"""


_FIELDS = "node_id x1 y1 x2 y2"


def _nms_sql(by: str, op: str) -> str:
    clash = f"{_inter('p', 'd')} * 100 {op} {_union('p', 'd')} * 50"
    return _fold_sql("fx_boxes", by, "confidence DESC, node_id", _FIELDS, clash, "e.node_id AS node_id")


@register("SELECT node_id, x2 - x1 AS width, y2 - y1 AS height, (x2 - x1) * (y2 - y1) AS area, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy, greatest(0, x1 - 5) AS ex1, y2 + 5 AS ey2 FROM fx_boxes")
def box_props(fx: Fixtures) -> DataFrame:
    b = g.Box.of()
    grown = g.expanded(b, 5)
    return fx.boxes.select("node_id", b.width.alias("width"), b.height.alias("height"), b.area.alias("area"), b.cx.alias("cx"), b.cy.alias("cy"), grown.x1.alias("ex1"), grown.y2.alias("ey2"))


@register("SELECT seg_id, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6) AS length, (x1 + x2) / 2.0::DOUBLE AS mx, (y1 + y2) / 2.0::DOUBLE AS my FROM fx_segments")
def seg_props(fx: Fixtures) -> DataFrame:
    b = g.Box.of()
    return fx.segments.select("seg_id", F.round(g.distance(b.x1, b.y1, b.x2, b.y2), 6).alias("length"), b.cx.alias("mx"), b.cy.alias("my"))


@register(f"SELECT a.pid_id, a.node_id AS a, b.node_id AS b, round(({_inter('a', 'b')}) / {_union('a', 'b')}::DOUBLE, 6) AS iou FROM fx_boxes a JOIN fx_boxes b ON a.pid_id = b.pid_id AND a.symbol_class = b.symbol_class AND a.node_id < b.node_id WHERE {_inter('a', 'b')} * 100 >= {_union('a', 'b')} * 50")
def boxes_iou_pairs(fx: Fixtures) -> DataFrame:
    return s.pairs(fx.boxes)


_VARIANTS = """
WITH b AS (SELECT p.node_id, p.x1 AS ax1, p.y1 AS ay1, p.x2 AS ax2, p.y2 AS ay2, q.x1 AS bx1, q.y1 AS by1, q.x2 AS bx2, q.y2 AS by2, 1e-7::DOUBLE AS eps
  FROM fx_boxes p JOIN fx_truth q ON p.pid_id = q.pid_id AND p.node_id = q.gt_id),
i AS (SELECT *, greatest(0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0, least(ay2, by2) - greatest(ay1, by1)) AS inter, ay2 - ay1 + eps AS h1, by2 - by1 + eps AS h2,
  greatest(ax2, bx2) - least(ax1, bx1) AS cw, greatest(ay2, by2) - least(ay1, by1) AS ch FROM b),
u AS (SELECT *, (ax2 - ax1) * h1 + (bx2 - bx1) * h2 - inter + eps AS uni, cw * ch + eps AS hull, cw * cw + ch * ch + eps AS diag,
  ((bx1 + bx2 - ax1 - ax2) * (bx1 + bx2 - ax1 - ax2) + (by1 + by2 - ay1 - ay2) * (by1 + by2 - ay1 - ay2)) / 4.0::DOUBLE AS apart,
  4 / (pi() * pi()) * pow(atan((bx2 - bx1) / h2) - atan((ax2 - ax1) / h1), 2) AS v FROM i),
w AS (SELECT *, inter / uni AS iou FROM u)
SELECT node_id, round(iou, 5) AS iou, round(iou - (hull - uni) / hull, 5) AS giou, round(iou - apart / diag, 5) AS diou, round(iou - (apart / diag + v * (v / (v - iou + 1 + eps))), 5) AS ciou FROM w"""


@register(_VARIANTS)
def iou_variants(fx: Fixtures) -> DataFrame:
    q = fx.truth.select(F.col("pid_id").alias("p"), "gt_id", *(F.col(c).alias(f"g{c}") for c in ("x1", "y1", "x2", "y2")))
    both = fx.boxes.join(q, (F.col("pid_id") == F.col("p")) & (F.col("node_id") == F.col("gt_id")))
    return both.select("node_id", *(F.round(c, 5).alias(k) for k, c in g.generalised_iou(g.Box.of(), g.Box.of("g")).items()))


@register(f"SELECT a.node_id, round({_inter('a', 'b')} / ({_area('b')} + 1e-7::DOUBLE), 6) AS ioa, round(least(a.x2 - a.x1, 70) * least(a.y2 - a.y1, 65) / ((a.x2 - a.x1) * (a.y2 - a.y1) + 70 * 65 - least(a.x2 - a.x1, 70) * least(a.y2 - a.y1, 65) + 1e-7::DOUBLE), 6) AS wh_iou FROM fx_boxes a JOIN fx_truth b ON a.pid_id = b.pid_id AND a.node_id = b.gt_id")
def bbox_ioa(fx: Fixtures) -> DataFrame:
    q = fx.truth.select(F.col("pid_id").alias("p"), "gt_id", *(F.col(c).alias(f"g{c}") for c in ("x1", "y1", "x2", "y2")))
    both = fx.boxes.join(q, (F.col("pid_id") == F.col("p")) & (F.col("node_id") == F.col("gt_id")))
    a, b = g.Box.of(), g.Box.of("g")
    return both.select("node_id", F.round(g.ioa(a, b), 6).alias("ioa"), F.round(g.wh_iou(a.width, a.height, F.lit(70), F.lit(65)), 6).alias("wh_iou"))


@register(_nms_sql("pid_id, symbol_class", ">="))
def nms_by_class(fx: Fixtures) -> DataFrame:
    return s.suppress(fx.boxes).select("pid_id", "symbol_class", "node_id")


@register(_nms_sql("pid_id, symbol_class", ">"))
def nms_strict(fx: Fixtures) -> DataFrame:
    return s.suppress(fx.boxes, strict=True).select("pid_id", "symbol_class", "node_id")


@register(_nms_sql("pid_id", ">"))
def nms_agnostic(fx: Fixtures) -> DataFrame:
    return s.suppress(fx.boxes, strict=True, by_class=False).select("pid_id", "node_id")


@register(_nms_sql("pid_id, symbol_class", ">=").replace("SELECT pid_id, symbol_class, e.node_id AS node_id FROM u", "SELECT pid_id, symbol_class, count(*) AS n FROM u GROUP BY pid_id, symbol_class"))
def nms_counts_by_class(fx: Fixtures) -> DataFrame:
    return s.per_class(s.suppress(fx.boxes))


_PRIORITY = sql_case(SOURCE_PRIORITY, "source", "2")


@register(_fold_sql("fx_boxes", "pid_id", f"{_PRIORITY}, confidence DESC, node_id", _FIELDS, "(p.x1 + p.x2 - d.x1 - d.x2) * (p.x1 + p.x2 - d.x1 - d.x2) + (p.y1 + p.y2 - d.y1 - d.y2) * (p.y1 + p.y2 - d.y1 - d.y2) < 6400", "e.node_id AS node_id"))
def dedup_proximity(fx: Fixtures) -> DataFrame:
    return s.dedup_proximity(fx.boxes).select("pid_id", "node_id")


_TAG = r"'\b([A-Z]{1,4})[_\-\s]?(\d{1,5}[A-Z]?)\b'"
TAGGED = f"(SELECT *, regexp_extract(upper(trim(text)), {_TAG}, 1) || '-' || regexp_extract(upper(trim(text)), {_TAG}, 2) AS tag FROM fx_texts WHERE regexp_matches(upper(trim(text)), {_TAG}))"


def tagged_texts(fx: Fixtures) -> DataFrame:
    return fx.texts.withColumn("tag", t.drawing_tag(F.col("text"))["tag"]).where("tag is not null")


@register(f"""
WITH r AS {TAGGED},
c AS (SELECT b.pid_id, b.node_id, r.tag, r.region_id, r.confidence, (b.x1 + b.x2 - 2 * r.cx) * (b.x1 + b.x2 - 2 * r.cx) + (b.y1 + b.y2 - 2 * r.cy) * (b.y1 + b.y2 - 2 * r.cy) AS d4
  FROM fx_boxes b JOIN r ON b.pid_id = r.pid_id),
k AS (SELECT *, row_number() OVER (PARTITION BY pid_id, node_id ORDER BY d4, confidence DESC, region_id) AS n FROM c WHERE d4 <= 25600)
SELECT b.pid_id, b.node_id, k.tag AS isa_tag, k.region_id, k.d4 FROM fx_boxes b LEFT JOIN k ON b.node_id = k.node_id AND k.n = 1""")
def label_nearest(fx: Fixtures) -> DataFrame:
    return s.nearest_label(fx.boxes, tagged_texts(fx))


_GAP = f"""
WITH r AS {TAGGED},
m AS (SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM fx_boxes b WHERE b.pid_id = r.pid_id
  AND (b.x1 + b.x2 - 2 * r.cx) * (b.x1 + b.x2 - 2 * r.cx) + (b.y1 + b.y2 - 2 * r.cy) * (b.y1 + b.y2 - 2 * r.cy) < 14400))
SELECT pid_id, region_id, tag FROM m"""


@register(_GAP)
def ocr_gap(fx: Fixtures) -> DataFrame:
    return s.labels_without_box(tagged_texts(fx), fx.boxes).select("pid_id", "region_id", "tag")


@register(
    _fold_sql(
        f"(SELECT pid_id, region_id, cx, cy, greatest(0, cx - 25) AS x1, greatest(0, cy - 50) AS y1, cx + 25 AS x2, cy AS y2 FROM {TAGGED} r WHERE NOT EXISTS (SELECT 1 FROM fx_boxes b WHERE b.pid_id = r.pid_id AND (b.x1 + b.x2 - 2 * r.cx) * (b.x1 + b.x2 - 2 * r.cx) + (b.y1 + b.y2 - 2 * r.cy) * (b.y1 + b.y2 - 2 * r.cy) < 14400))",
        "pid_id", "region_id", "region_id x1 y1 x2 y2",
        "(2 * d.cx - p.x1 - p.x2) * (2 * d.cx - p.x1 - p.x2) + (2 * d.cy - p.y1 - p.y2) * (2 * d.cy - p.y1 - p.y2) < 14400",
        "e.region_id AS region_id, e.x1 AS x1, e.y1 AS y1, e.x2 AS x2, e.y2 AS y2",
    )
)
def ocr_gap_fill(fx: Fixtures) -> DataFrame:
    return s.inject_boxes(s.labels_without_box(tagged_texts(fx), fx.boxes)).drop("tag")


@register("""
WITH e AS (SELECT pid_id, seg_id, 1 AS side, x1 AS px, y1 AS py FROM fx_segments UNION ALL SELECT pid_id, seg_id, 2, x2, y2 FROM fx_segments),
c AS (SELECT e.seg_id, e.side, b.node_id, greatest(b.x1 - px, 0, px - b.x2) AS dx, greatest(b.y1 - py, 0, py - b.y2) AS dy FROM e JOIN fx_boxes b ON e.pid_id = b.pid_id),
k AS (SELECT seg_id, side, node_id, dx * dx + dy * dy AS d2, row_number() OVER (PARTITION BY seg_id, side ORDER BY dx * dx + dy * dy, node_id) AS n FROM c WHERE dx * dx + dy * dy <= 5625),
p AS (SELECT seg_id, max(CASE WHEN side = 1 THEN node_id END) AS a, max(CASE WHEN side = 2 THEN node_id END) AS b, min(d2) AS low FROM k WHERE n = 1 GROUP BY seg_id)
SELECT seg_id, a, b FROM p WHERE low <= 2500""")
def snap_endpoints(fx: Fixtures) -> DataFrame:
    return s.snap_ends(fx.segments, fx.boxes)


_LINES = """
WITH l AS (SELECT pid_id, seg_id, abs(x2 - x1) >= abs(y2 - y1) AS flat, x1, y1, x2, y2 FROM fx_segments),
h AS (SELECT pid_id, seg_id, flat, CASE WHEN flat THEN y1 + y2 ELSE x1 + x2 END AS at2, CASE WHEN flat THEN least(x1, x2) ELSE least(y1, y2) END AS lo,
  CASE WHEN flat THEN greatest(x1, x2) ELSE greatest(y1, y2) END AS hi FROM l),
q AS (SELECT h.pid_id, h.seg_id, b.node_id FROM h JOIN fx_boxes b ON h.pid_id = b.pid_id
  WHERE abs(CASE WHEN flat THEN b.y1 + b.y2 ELSE b.x1 + b.x2 END - at2) <= 160 AND CASE WHEN flat THEN b.x1 + b.x2 ELSE b.y1 + b.y2 END BETWEEN 2 * lo - 40 AND 2 * hi + 40)
"""


@register(_LINES + "SELECT pid_id, seg_id, node_id FROM q")
def line_equipment(fx: Fixtures) -> DataFrame:
    return s.line_equipment(fx.segments, fx.boxes)


@register(_LINES + "SELECT DISTINCT a.pid_id, a.node_id AS a, b.node_id AS b FROM q a JOIN q b ON a.seg_id = b.seg_id AND a.node_id < b.node_id")
def line_equipment_pairs(fx: Fixtures) -> DataFrame:
    return s.line_pairs(s.line_equipment(fx.segments, fx.boxes))


def _points(fx: Fixtures) -> DataFrame:
    return fx.segments.select("pid_id", F.col("seg_id").alias("junc_id"), F.col("x2").alias("x"), F.col("y2").alias("y"))


@register("""
WITH p AS (SELECT pid_id, seg_id AS junc_id, x2 AS x, y2 AS y FROM fx_segments),
e AS (SELECT pid_id, seg_id, x1 AS ex, y1 AS ey FROM fx_segments UNION ALL SELECT pid_id, seg_id, x2, y2 FROM fx_segments)
SELECT p.pid_id, p.junc_id, string_agg(DISTINCT CAST(e.seg_id AS VARCHAR), ',' ORDER BY CAST(e.seg_id AS VARCHAR)) AS segs, count(DISTINCT e.seg_id) AS n FROM p JOIN e ON p.pid_id = e.pid_id
WHERE (x - ex) * (x - ex) + (y - ey) * (y - ey) <= 784 GROUP BY p.pid_id, p.junc_id""")
def junction_segments(fx: Fixtures) -> DataFrame:
    found = s.junction_segments(_points(fx), fx.segments)
    text = F.array_join(F.array_sort(F.transform("seg_ids", lambda x: x.cast("string"))), ",")
    return found.select("pid_id", "junc_id", text.alias("segs"), F.size("seg_ids").cast("long").alias("n"))


@register("""
WITH RECURSIVE pts AS (SELECT pid_id, seg_id AS junc_id, x2 AS x, y2 AS y FROM fx_segments),
o AS (SELECT *, row_number() OVER (PARTITION BY pid_id ORDER BY junc_id, x, y) AS k FROM pts),
f AS (SELECT pid_id, 0::BIGINT AS k, []::STRUCT(junc_id BIGINT, x BIGINT, y BIGINT)[] AS acc FROM (SELECT DISTINCT pid_id FROM o)
  UNION ALL SELECT d.pid_id, d.k, CASE WHEN len(list_filter(f.acc, lambda p: (p.x - d.x) * (p.x - d.x) + (p.y - d.y) * (p.y - d.y) <= 400)) > 0 THEN f.acc
    ELSE list_append(f.acc, {'junc_id': d.junc_id, 'x': d.x, 'y': d.y}) END FROM f JOIN o d ON d.pid_id = f.pid_id AND d.k = f.k + 1),
l AS (SELECT pid_id, arg_max(acc, k) AS acc FROM f GROUP BY pid_id),
m AS (SELECT o.pid_id, o.x, o.y, list_filter(l.acc, lambda p: (p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y) <= 400)[1].junc_id AS head FROM o JOIN l ON o.pid_id = l.pid_id)
SELECT pid_id, head AS junc_id, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y, count(*) AS n FROM m GROUP BY pid_id, head""")
def junction_cluster(fx: Fixtures) -> DataFrame:
    return s.merge_points(_points(fx))


@register("""
WITH l AS (SELECT pid_id, seg_id AS a, seg_id + 1 AS b, x1 + 3 AS ax, y1 + 4 AS ay, x2 + 5 AS bx, y2 + 2 AS b_y FROM fx_segments),
c AS (SELECT l.a, l.b, s.seg_id, round(least(sqrt((ax - x1) * (ax - x1) + (ay - y1) * (ay - y1)) + sqrt((bx - x2) * (bx - x2) + (b_y - y2) * (b_y - y2)),
  sqrt((ax - x2) * (ax - x2) + (ay - y2) * (ay - y2)) + sqrt((bx - x1) * (bx - x1) + (b_y - y1) * (b_y - y1))), 6) AS score FROM l JOIN fx_segments s ON l.pid_id = s.pid_id)
SELECT l.a, l.b, m.seg_id, m.score FROM l LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score, seg_id) AS n FROM c WHERE score < 200) m ON l.a = m.a AND l.b = m.b AND m.n = 1""")
def edge_segment(fx: Fixtures) -> DataFrame:
    """Links without a segment near them have nulls."""
    links = fx.segments.selectExpr("pid_id", "seg_id AS a", "seg_id + 1 AS b", "x1 + 3 AS ax", "y1 + 4 AS ay", "x2 + 5 AS bx", "y2 + 2 AS by")
    return s.nearest_segment(links, fx.segments)


_ANGLE = "abs(degrees(atan2(y2 - y1, x2 - x1)))"


@register(f"SELECT pid_id, seg_id FROM fx_segments WHERE {_ANGLE} <= 5 OR abs({_ANGLE} - 90) <= 5 OR abs({_ANGLE} - 180) <= 5")
def segment_filter_hv(fx: Fixtures) -> DataFrame:
    return s.near_axis(fx.segments).select("pid_id", "seg_id")


_AT = "((d.{0} - p.x1) * (p.x2 - p.x1) + (d.{1} - p.y1) * (p.y2 - p.y1)) / (((p.x2 - p.x1) * (p.x2 - p.x1) + (p.y2 - p.y1) * (p.y2 - p.y1)))::DOUBLE"
_T1, _T2 = _AT.format("x1", "y1"), _AT.format("x2", "y2")


@register(_fold_sql("fx_segments", "pid_id", "(x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) DESC, seg_id", "seg_id x1 y1 x2 y2", f"(p.x2 <> p.x1 OR p.y2 <> p.y1) AND least(greatest({_T1}, {_T2}), 1) - greatest(least({_T1}, {_T2}), 0) >= 0.6::DOUBLE", "e.seg_id AS seg_id"))
def segment_nms(fx: Fixtures) -> DataFrame:
    return s.segment_suppress(fx.segments).select("pid_id", "seg_id")


@register("""
WITH RECURSIVE r AS (SELECT pid_id, seg_id, abs(x2 - x1) >= abs(y2 - y1) AS flat, x1, y1, x2, y2 FROM fx_segments),
h AS (SELECT pid_id, seg_id, flat, CASE WHEN flat THEN y1 + y2 ELSE x1 + x2 END AS at2, CASE WHEN flat THEN least(x1, x2) ELSE least(y1, y2) END AS lo,
  CASE WHEN flat THEN greatest(x1, x2) ELSE greatest(y1, y2) END AS hi FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY pid_id, flat ORDER BY floor((at2 + 6) / 12.0), lo, seg_id) AS k FROM h),
f AS (SELECT pid_id, flat, 0::BIGINT AS k, []::STRUCT(seg_id BIGINT, at2 BIGINT)[] AS acc FROM (SELECT DISTINCT pid_id, flat FROM o)
  UNION ALL SELECT d.pid_id, d.flat, d.k, CASE WHEN len(list_filter(f.acc, lambda p: abs(p.at2 - d.at2) <= 12)) > 0 THEN f.acc ELSE list_append(f.acc, {'seg_id': d.seg_id, 'at2': d.at2}) END
  FROM f JOIN o d ON d.pid_id = f.pid_id AND d.flat = f.flat AND d.k = f.k + 1),
l AS (SELECT pid_id, flat, arg_max(acc, k) AS acc FROM f GROUP BY pid_id, flat),
m AS (SELECT o.*, list_filter(l.acc, lambda p: abs(p.at2 - o.at2) <= 12)[1].seg_id AS head FROM o JOIN l ON o.pid_id = l.pid_id AND o.flat = l.flat)
SELECT pid_id, flat, head AS first, round(sum(at2) / count(*) / 2, 6) AS at, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM m GROUP BY pid_id, flat, head""")
def collinear_spans(fx: Fixtures) -> DataFrame:
    return s.collinear_spans(fx.segments)


@register("""
WITH im AS (SELECT p_partkey AS pid_id, 600 + p_size * 50 AS width, 500 + p_size * 37 AS height FROM part),
x AS (SELECT *, unnest(generate_series(0, greatest(0, CAST(ceil((width - 640) / 512.0) AS BIGINT) * 512), 512)) AS x FROM im),
y AS (SELECT *, unnest(generate_series(0, greatest(0, CAST(ceil((height - 640) / 512.0) AS BIGINT) * 512), 512)) AS y FROM x)
SELECT pid_id, x, y, least(640, width - x) AS w, least(640, height - y) AS h FROM y""")
def src_tiles(fx: Fixtures) -> DataFrame:
    return s.tiles(fx.part.selectExpr("p_partkey AS pid_id", "600 + p_size * 50 AS width", "500 + p_size * 37 AS height"))


@register("SELECT b.l_suppkey AS tile_id, b.rn AS node_id, b.l_linenumber + s.s_nationkey * 100 AS x1, b.l_linenumber + 7 + s.s_nationkey * 50 AS y1, b.l_linenumber + 30 + s.s_nationkey * 100 AS x2, b.l_linenumber + 40 + s.s_nationkey * 50 AS y2 FROM fx_base b JOIN supplier s ON b.l_suppkey = s.s_suppkey")
def tile_to_global(fx: Fixtures) -> DataFrame:
    d = fx.base.selectExpr("l_suppkey AS tile_id", "rn AS node_id", "l_linenumber AS x1", "l_linenumber + 7 AS y1", "l_linenumber + 30 AS x2", "l_linenumber + 40 AS y2")
    return s.to_global(d, fx.supplier.selectExpr("s_suppkey AS tile_id", "s_nationkey * 100 AS ox", "s_nationkey * 50 AS oy"))


@register("SELECT pid_id, symbol_class, count(*) AS n FROM fx_boxes GROUP BY pid_id, symbol_class")
def det_per_class(fx: Fixtures) -> DataFrame:
    return s.per_class(fx.boxes)


@register("SELECT symbol_class, count(*) AS n FROM fx_boxes GROUP BY symbol_class ORDER BY n DESC, symbol_class LIMIT 5")
def top_classes(fx: Fixtures) -> DataFrame:
    return s.top_classes(fx.boxes)


@register("SELECT pid_id, node_id, rank FROM (SELECT pid_id, node_id, row_number() OVER (PARTITION BY pid_id ORDER BY confidence DESC, node_id) AS rank FROM fx_boxes) WHERE rank <= 3")
def nms_topk(fx: Fixtures) -> DataFrame:
    return s.top_per_drawing(fx.boxes)


@register("""
WITH c AS (SELECT node_id, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy, (x2 - x1) * 1.02::DOUBLE + 10 AS w, (y2 - y1) * 1.02::DOUBLE + 10 AS h FROM fx_boxes)
SELECT node_id, CAST(trunc(least(greatest(cx - w / 2, 0), 1900)) AS INT) AS x1, CAST(trunc(least(greatest(cy - h / 2, 0), 1000)) AS INT) AS y1,
  CAST(trunc(least(greatest(cx + w / 2, 0), 1900)) AS INT) AS x2, CAST(trunc(least(greatest(cy + h / 2, 0), 1000)) AS INT) AS y2 FROM c""")
def crop_box(fx: Fixtures) -> DataFrame:
    return fx.boxes.select("node_id", *(c.alias(k) for k, c in g.crop(g.Box.of(), 1900, 1000)._asdict().items()))


@register("SELECT node_id, round((x1 + x2) / 2.0::DOUBLE / 2000, 6) AS x, round((y1 + y2) / 2.0::DOUBLE / 1500, 6) AS y, round((x2 - x1) / 2000.0::DOUBLE, 6) AS w, round((y2 - y1) / 1500.0::DOUBLE, 6) AS h FROM fx_boxes")
def box_convert(fx: Fixtures) -> DataFrame:
    return fx.boxes.select("node_id", *(F.round(c, 6).alias(k) for k, c in g.normalised_xywh(g.Box.of(), 2000, 1500).items()))


@register("""
WITH i AS (SELECT p_partkey AS pid_id, 601 + p_size * 50 AS width, 503 + p_size * 37 AS height FROM part), q AS (SELECT *, least(640.0::DOUBLE / height, 640.0::DOUBLE / width) AS gain FROM i)
SELECT pid_id, round(gain, 6) AS gain, (640 - round(width * gain)) / 2 AS pad_x, (640 - round(height * gain)) / 2 AS pad_y FROM q""")
def letterbox_params(fx: Fixtures) -> DataFrame:
    made = g.letterbox(F.col("width"), F.col("height"))
    images = fx.part.selectExpr("p_partkey AS pid_id", "601 + p_size * 50 AS width", "503 + p_size * 37 AS height")
    return images.select("pid_id", F.round(made["gain"], 6).alias("gain"), made["pad_x"].alias("pad_x"), made["pad_y"].alias("pad_y"))


@register("SELECT seg_id, CASE WHEN l < 40 THEN 'signal' WHEN l < 100 THEN 'instrument' ELSE 'main_process' END AS line_type FROM (SELECT seg_id, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS l FROM fx_segments)")
def line_types(fx: Fixtures) -> DataFrame:
    b = g.Box.of()
    return fx.segments.select("seg_id", g.line_type(g.distance(b.x1, b.y1, b.x2, b.y2), F.lit(2)).alias("line_type"))


@register("SELECT count(*) AS n, count(*) FILTER (confidence >= 0.4 AND x2 - x1 >= 3 AND y2 - y1 >= 3) AS kept, count(*) FILTER ((x2 - x1) / (y2 - y1)::DOUBLE BETWEEN 0.125 AND 8) AS shaped FROM fx_boxes")
def filter_conf(fx: Fixtures) -> DataFrame:
    b = g.Box.of()
    return fx.boxes.agg(
        F.count("*").alias("n"),
        F.count_if((F.col("confidence") >= 0.4) & (b.width >= 3) & (b.height >= 3)).alias("kept"),
        F.count_if((b.width / b.height).between(0.125, 8)).alias("shaped"),
    )


@register("SELECT pid_id, region_id FROM (SELECT *, row_number() OVER (PARTITION BY pid_id, cx // 4, cy // 4 ORDER BY region_id) AS n FROM fx_texts) WHERE n = 1 AND confidence >= 0.5")
def heuristic_text(fx: Fixtures) -> DataFrame:
    """A cell of four pixels keeps its first region, and only then regions are filtered."""
    first = fx.texts.groupBy("pid_id", F.floor(F.col("cx") / 4).alias("kx"), F.floor(F.col("cy") / 4).alias("ky")).agg(F.min_by(F.struct("region_id", "confidence"), "region_id").alias("m"))
    return first.where("m.confidence >= 0.5").select("pid_id", F.col("m.region_id").alias("region_id"))


@register()
def merge_collinear(fx: Fixtures) -> DataFrame:
    """Merges depend on their order, which SQL can't express; tested against a plain restart loop."""
    from ..operators.merging import merge_collinear as merge

    return merge(fx.segments)


@register("""
WITH RECURSIVE s AS (SELECT pid_id, seg_id, x1, y1, x2, y2, (x1 + x2) / 2.0::DOUBLE AS mx, (y1 + y2) / 2.0::DOUBLE AS my,
  round(CASE WHEN atan2(y2 - y1, x2 - x1) < 0 THEN atan2(y2 - y1, x2 - x1) + pi() ELSE CASE WHEN atan2(y2 - y1, x2 - x1) >= pi() THEN 0 ELSE atan2(y2 - y1, x2 - x1) END END * 100, 6) AS a
  FROM fx_segments WHERE (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) <= 16900),
p AS (SELECT l.seg_id AS a, r.seg_id AS b FROM s l JOIN s r ON l.pid_id = r.pid_id AND l.seg_id <> r.seg_id
  WHERE (l.mx - r.mx) * (l.mx - r.mx) + (l.my - r.my) * (l.my - r.my) + (l.a - r.a) * (l.a - r.a) <= 225),
w(n, r) AS (SELECT seg_id, seg_id FROM s UNION SELECT p.b, w.r FROM w JOIN p ON p.a = w.n),
c AS (SELECT n, min(r) AS cluster FROM w GROUP BY n)
SELECT pid_id, cluster, min(least(x1, x2)) AS x1, min(least(y1, y2)) AS y1, max(greatest(x1, x2)) AS x2, max(greatest(y1, y2)) AS y2, count(*) AS n FROM s JOIN c ON s.seg_id = c.n GROUP BY pid_id, cluster""")
def dashed_clusters(fx: Fixtures) -> DataFrame:
    from ..operators.merging import dashed_clusters as cluster

    return cluster(fx.segments, most_length=130)
