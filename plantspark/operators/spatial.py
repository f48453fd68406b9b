"""Boxes, labels and segments against each other, per drawing.

Distance joins use a grid: one side is put in its cell, the other in its cell and the eight
around it, so that equal (drawing, cell) pairs hold all candidates and no nested loop over a
drawing is needed. Sequential operators (suppression, clustering) fold a sorted array with
higher-order functions; their groups are one drawing, or one class of a drawing.

Nulls in coordinates match nothing. Ties are broken by the order column that each operator
names. Empty inputs give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.dims import SOURCE_PRIORITY, lookup

Box = g.Box


def pairs(boxes: DataFrame, percent: int = 50) -> DataFrame:
    """(pid_id, a, b, iou): boxes of one class and drawing with an IoU of at least percent / 100, a < b."""
    a, b = boxes.alias("a"), boxes.alias("b")
    on = (F.col("a.pid_id") == F.col("b.pid_id")) & (F.col("a.symbol_class") == F.col("b.symbol_class")) & (F.col("a.node_id") < F.col("b.node_id"))
    p, q = Box.of(alias="a"), Box.of(alias="b")
    return a.join(b, on & g.iou_at_least(p, q, percent)).select(
        F.col("a.pid_id").alias("pid_id"), F.col("a.node_id").alias("a"), F.col("b.node_id").alias("b"), F.round(g.iou(p, q), 6).alias("iou")
    )


def fold_keep(rows: DataFrame, by: list[str], order: list[Column], keep: list[str], clash: Callable[[Column, Column], Column]) -> DataFrame:
    """Per group in ascending order: a row stays if it clashes with none that stayed before."""
    item = F.struct(*(c.alias(f"_{k}") for k, c in enumerate(order)), *keep)
    grouped = rows.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("a"))
    kept = F.aggregate(
        "a",
        F.slice("a", 1, 0),
        lambda acc, d: F.when(F.exists(acc, lambda p: clash(p, d)), acc).otherwise(F.concat(acc, F.array(d))),
    )
    return grouped.select(*by, F.explode(kept).alias("d")).select(*by, *(f"d.{c}" for c in keep))


_BOX = ["node_id", "x1", "y1", "x2", "y2"]


def suppress(boxes: DataFrame, percent: int = 50, strict: bool = False, by_class: bool = True) -> DataFrame:
    """Non-maximum suppression by confidence, ties by node_id.

    ``strict``: an IoU must be above the threshold to suppress, else at least it.
    """
    by = ["pid_id", "symbol_class"] if by_class else ["pid_id"]
    above = g.iou_above if strict else g.iou_at_least
    return fold_keep(boxes, by, [-F.col("confidence"), F.col("node_id")], _BOX, lambda p, d: above(Box.field(p), Box.field(d), percent))


def dedup_proximity(boxes: DataFrame, radius: int = 40) -> DataFrame:
    """Across classes: by source priority, then confidence, drop centres closer than the radius to one that stays."""
    priority = F.coalesce(lookup(SOURCE_PRIORITY, F.col("source")), F.lit(2))

    def near(p: Column, d: Column) -> Column:
        a, b = Box.field(p), Box.field(d)
        dx, dy = a.x1 + a.x2 - b.x1 - b.x2, a.y1 + a.y2 - b.y1 - b.y2
        return dx * dx + dy * dy < 4 * radius * radius

    return fold_keep(boxes, ["pid_id"], [priority, -F.col("confidence"), F.col("node_id")], _BOX, near)


def _cell(x: Column, size: int) -> Column:
    return F.floor(x / size).cast("long")


def grid_join(left: DataFrame, right: DataFrame, lx: Column, ly: Column, rx: Column, ry: Column, radius: int, how: str = "inner") -> DataFrame:
    """Rows of one drawing whose points are in the same or in neighbouring cells of ``radius`` pixels.

    All pairs within the radius are among them. The left side gets the column ``_l``, the right side all its own
    with the prefix ``r_``. With how = "left" rows without a candidate stay.
    """
    around = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    l = left.withColumn("_cx", _cell(lx, radius)).withColumn("_cy", _cell(ly, radius))  # noqa: E741
    r = right.withColumn("_rx", F.explode(F.transform(around, lambda k: _cell(rx, radius) + k)))
    r = r.withColumn("_ry", F.explode(F.transform(around, lambda k: _cell(ry, radius) + k)))
    r = r.select(*(F.col(c).alias(f"r_{c}") for c in r.columns))
    on = (F.col("pid_id") == F.col("r_pid_id")) & (F.col("_cx") == F.col("r__rx")) & (F.col("_cy") == F.col("r__ry"))
    return l.join(r, on, how).drop("_cx", "_cy", "r__rx", "r__ry", "r_pid_id")


def nearest_label(boxes: DataFrame, labels: DataFrame, radius: int = 80) -> DataFrame:
    """Per box the nearest label within the radius (inclusive), then the more confident, then the first; null without one."""
    cx2, cy2 = F.col("x1") + F.col("x2"), F.col("y1") + F.col("y2")
    found = grid_join(boxes, labels, cx2 / 2, cy2 / 2, F.col("cx"), F.col("cy"), radius)
    dx, dy = cx2 - 2 * F.col("r_cx"), cy2 - 2 * F.col("r_cy")
    d4 = dx * dx + dy * dy
    best = (
        found.where(d4 <= 4 * radius * radius)
        .groupBy("pid_id", "node_id")
        .agg(F.min_by(F.struct("r_tag", "r_region_id"), F.struct(d4, -F.col("r_confidence"), F.col("r_region_id"))).alias("m"), F.min(d4).alias("d4"))
        .select(F.col("node_id").alias("n"), F.col("m.r_tag").alias("isa_tag"), F.col("m.r_region_id").alias("region_id"), "d4")
    )
    return boxes.join(best, F.col("node_id") == F.col("n"), "left").select("pid_id", "node_id", "isa_tag", "region_id", "d4")


def labels_without_box(labels: DataFrame, boxes: DataFrame, radius: int = 60) -> DataFrame:
    """Labels with no box centre closer than the radius."""
    b = boxes.withColumn("bx", F.col("x1") + F.col("x2")).withColumn("by", F.col("y1") + F.col("y2"))
    near = grid_join(labels, b, F.col("cx"), F.col("cy"), F.col("bx") / 2, F.col("by") / 2, radius)
    dx, dy = 2 * F.col("cx") - F.col("r_bx"), 2 * F.col("cy") - F.col("r_by")
    hit = near.where(dx * dx + dy * dy < 4 * radius * radius).select(F.col("region_id").alias("hit")).distinct()
    return labels.join(hit, F.col("region_id") == F.col("hit"), "left_anti")


def inject_boxes(labels: DataFrame, size: int = 50, gap: int = 60) -> DataFrame:
    """Boxes above labels, taken in order, that are not closer than ``gap`` to a box injected before.

    The label's centre is compared with the centres of injected boxes.
    """
    half = size // 2
    made = labels.select(
        "pid_id", "region_id", "tag", "cx", "cy",
        F.greatest(F.lit(0), F.col("cx") - half).alias("x1"), F.greatest(F.lit(0), F.col("cy") - size).alias("y1"),
        (F.col("cx") + half).alias("x2"), F.col("cy").alias("y2"),
    )

    def near(p: Column, d: Column) -> Column:
        dx, dy = 2 * d["cx"] - p["x1"] - p["x2"], 2 * d["cy"] - p["y1"] - p["y2"]
        return dx * dx + dy * dy < 4 * gap * gap

    kept = fold_keep(made, ["pid_id"], [F.col("region_id")], ["region_id", "tag", "cx", "cy", "x1", "y1", "x2", "y2"], near)
    return kept.drop("cx", "cy")


def snap_ends(segments: DataFrame, boxes: DataFrame, radius: int = 50, wide: int = 75) -> DataFrame:
    """Each segment's ends to their nearest boxes, ties by node_id.

    An end snaps within the radius; if only one end does, the other may snap within the wider one.
    Returns seg_id, a, b with nulls for ends that don't snap.
    """
    ends = segments.select("pid_id", "seg_id", F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(f"x{k}").alias("px"), F.col(f"y{k}").alias("py")) for k in (1, 2)))).alias("e"))
    ends = ends.select("pid_id", "seg_id", "e.side", "e.px", "e.py")
    b = boxes.select("pid_id", "node_id", *_BOX[1:])
    near = ends.join(b, "pid_id")
    dx = F.greatest(F.col("x1") - F.col("px"), F.lit(0), F.col("px") - F.col("x2"))
    dy = F.greatest(F.col("y1") - F.col("py"), F.lit(0), F.col("py") - F.col("y2"))
    d2 = dx * dx + dy * dy
    best = near.where(d2 <= wide * wide).groupBy("seg_id", "side").agg(F.min(F.struct(d2.alias("d2"), F.col("node_id"))).alias("m"))
    sides = best.groupBy("seg_id").agg(*(F.max(F.when(F.col("side") == k, F.col("m"))).alias(f"m{k}") for k in (1, 2)))
    ok = {k: F.coalesce(F.col(f"m{k}.d2") <= radius * radius, F.lit(False)) for k in (1, 2)}
    return sides.where(ok[1] | ok[2]).select("seg_id", F.col("m1.node_id").alias("a"), F.col("m2.node_id").alias("b"))


def line_equipment(segments: DataFrame, boxes: DataFrame, across: int = 80, along: int = 20) -> DataFrame:
    """(pid_id, seg_id, node_id): boxes whose centre is beside an axis-parallel line; band join on the perpendicular axis."""
    flat = F.abs(F.col("x2") - F.col("x1")) >= F.abs(F.col("y2") - F.col("y1"))
    lines = segments.select(
        "pid_id", "seg_id", flat.alias("flat"),
        F.when(flat, F.col("y1") + F.col("y2")).otherwise(F.col("x1") + F.col("x2")).alias("at2"),
        F.when(flat, F.least("x1", "x2")).otherwise(F.least("y1", "y2")).alias("lo"),
        F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest("y1", "y2")).alias("hi"),
    )
    lines = lines.withColumn("bin", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col("at2") / (2 * across)) + k)))
    c = boxes.select("pid_id", "node_id", (F.col("x1") + F.col("x2")).alias("bx"), (F.col("y1") + F.col("y2")).alias("by"))
    c = c.withColumn("axis", F.explode(F.array(F.lit(True), F.lit(False))))
    c = c.withColumn("cross2", F.when(F.col("axis"), F.col("by")).otherwise(F.col("bx"))).withColumn("pos2", F.when(F.col("axis"), F.col("bx")).otherwise(F.col("by")))
    c = c.withColumn("cbin", F.floor(F.col("cross2") / (2 * across))).withColumnRenamed("pid_id", "p")
    on = (F.col("pid_id") == F.col("p")) & (F.col("flat") == F.col("axis")) & (F.col("bin") == F.col("cbin"))
    inside = (F.abs(F.col("cross2") - F.col("at2")) <= 2 * across) & F.col("pos2").between(2 * F.col("lo") - 2 * along, 2 * F.col("hi") + 2 * along)
    return lines.join(c, on).where(inside).select("pid_id", "seg_id", "node_id")


def line_pairs(equipment: DataFrame) -> DataFrame:
    """(pid_id, a, b): every two boxes of one line, a < b, each pair once."""
    left = equipment.select("pid_id", "seg_id", F.col("node_id").alias("a"))
    right = equipment.select("seg_id", F.col("node_id").alias("b"))
    return left.join(right, "seg_id").where("a < b").select("pid_id", "a", "b").distinct()


def junction_segments(points: DataFrame, segments: DataFrame, radius: int = 28) -> DataFrame:
    """(pid_id, junc_id, seg_ids): segments with an end within the radius (inclusive) of a point, each once, in order."""
    ends = segments.select("pid_id", "seg_id", F.explode(F.array(F.struct("x1", "y1"), F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1")))).alias("e"))
    ends = ends.select("pid_id", "seg_id", F.col("e.x1").alias("ex"), F.col("e.y1").alias("ey"))
    near = grid_join(points, ends, F.col("x"), F.col("y"), F.col("ex"), F.col("ey"), radius)
    hit = near.where(g.squared(F.col("x"), F.col("y"), F.col("r_ex"), F.col("r_ey")) <= radius * radius)
    return hit.groupBy("pid_id", "junc_id").agg(F.array_sort(F.collect_set("r_seg_id")).alias("seg_ids"))


def merge_points(points: DataFrame, radius: int = 20) -> DataFrame:
    """Greedy clusters around the first point that isn't in one: (pid_id, junc_id, x, y, n), centres truncated to integers."""
    item = F.struct("junc_id", "x", "y")
    grouped = points.groupBy("pid_id").agg(F.sort_array(F.collect_list(item)).alias("a"))
    near = lambda p, d: g.squared(p["x"], p["y"], d["x"], d["y"]) <= radius * radius
    heads = F.aggregate("a", F.slice("a", 1, 0), lambda acc, d: F.when(F.exists(acc, lambda p: near(p, d)), acc).otherwise(F.concat(acc, F.array(d))))
    # A point belongs to the first head that it is near to.
    rows = grouped.select("pid_id", F.explode("a").alias("d"), heads.alias("h")).select("pid_id", "d", F.element_at(F.filter("h", lambda p: near(p, F.col("d"))), 1).alias("head"))
    mean = lambda c: F.floor(F.sum(f"d.{c}") / F.count("*")).cast("long")
    return rows.groupBy("pid_id", F.col("head.junc_id").alias("junc_id")).agg(mean("x").alias("x"), mean("y").alias("y"), F.count("*").alias("n"))


#: Pairs of links and segments that are compared at once, and how much worse than the best a score may seem and still be compared exactly.
PAIRS, SLACK = 1 << 18, 1e-5


def nearest_segment(links: DataFrame, segments: DataFrame, below: int = 200) -> DataFrame:
    """For each link (pid_id, a, b, ax, ay, bx, by) the segment whose ends are nearest to the link's, in either direction.

    The score is the sum of both distances and must be below the bound, else segment and score are null; ties go to
    the first segment. Middles of a link and a segment with such a score are less than half the bound apart, so
    only segments of the cells around a link's middle are compared. A drawing's rows meet in one task; no pair is
    shuffled. Repeated links give a row each.
    """
    ends = dict(zip(_BOX[1:], ("ax", "ay", "bx", "by")))
    l = links.select("pid_id", F.lit(True).alias("link"), "a", "b", *(F.col(v).alias(k) for k, v in ends.items()))  # noqa: E741
    s = segments.select("pid_id", F.lit(False).alias("link"), "seg_id", *ends)
    rows = l.unionByName(s, allowMissingColumns=True).repartition("pid_id").sortWithinPartitions("pid_id", "seg_id")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    near = ", ".join(f"{c}:{kinds[c]}" for c in ("seg_id", *ends))
    ddl = ", ".join(f"{c} {kinds[c]}" for c in ("a", "b", *ends)) + f", near array<struct<{near}>>"
    found = rows.select("pid_id", "link", "a", "b", "seg_id", *ends).mapInArrow(lambda batches: _near_links(batches, below), ddl)

    def score(m: Column) -> Column:
        d = lambda p, q: g.distance(F.col(f"x{p}"), F.col(f"y{p}"), m[f"x{q}"], m[f"y{q}"])
        return F.round(F.least(d(1, 1) + d(2, 2), d(1, 2) + d(2, 1)), 6)

    scored = F.transform("near", lambda m: F.struct(score(m).alias("score"), m["seg_id"].alias("seg_id")))
    best = found.select("a", "b", F.array_min(F.filter(scored, lambda m: m["score"] < below)).alias("m"))
    return best.select("a", "b", F.col("m.seg_id").alias("seg_id"), F.col("m.score").alias("score"))


def _near_links(batches: Iterator[pa.RecordBatch], below: float) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of pid_id and seg_id the links, with the segments that may be nearest; holds the rows of a drawing until all are there."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        pids = batch.column(0)
        cut = _last_start(pids)
        if cut or (held and held[-1].column(0)[-1].as_py() != pids[0].as_py()):
            yield from _near_segments(pa.Table.from_batches([*held, batch.slice(0, cut)]), below)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from _near_segments(pa.Table.from_batches(held), below)


def _last_start(pids: pa.Array) -> int:
    """Where the last run of equal values starts."""
    codes = pids.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    other = np.flatnonzero(codes != codes[-1])
    return int(other[-1]) + 1 if len(other) else 0


def _dense(cells: np.ndarray) -> np.ndarray:
    """Small numbers from 1 in the order of whole numbers; neighbours, and only they, stay neighbours."""
    values, places = np.unique(cells, return_inverse=True)
    return np.concatenate([[1], 1 + np.cumsum(np.minimum(np.diff(values), 2))]).astype(np.int64)[places.reshape(-1)]


def _near_segments(rows: pa.Table, below: float) -> Iterator[pa.RecordBatch]:
    """The links of whole drawings, each with its candidates: the segments whose score seems best, one of those with equal scores."""
    rows = rows.combine_chunks()
    link = rows["link"].to_numpy().astype(bool)
    pid = rows["pid_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    x1, y1, x2, y2 = (rows[c].cast(pa.float64()).to_numpy() for c in _BOX[1:])
    mx, my = (x1 + x2) / 2, (y1 + y2) / 2
    usable = np.isfinite(mx) & np.isfinite(my) & (pid >= 0)
    links = np.flatnonzero(link)
    ranges, key = np.zeros((len(links), 3, 2), np.int64), np.zeros(len(link), np.int64)
    segs = np.flatnonzero(~link & usable)
    if len(segs) and usable[links].any():
        size = below / 2 * 1.001
        cx, cy = _dense(np.floor(mx[usable] / size)), _dense(np.floor(my[usable] / size))
        high = int(cy.max()) + 2
        key[usable] = (pid[usable].astype(np.int64) * (int(cx.max()) + 2) + cx) * high + cy
        segs = segs[np.argsort(key[segs], kind="stable")]
        for k in range(3):
            around = key[links] + (k - 1) * high
            ranges[:, k, 0] = np.searchsorted(key[segs], around - 1, "left")
            ranges[:, k, 1] = np.searchsorted(key[segs], around + 1, "right")
        ranges[~usable[links]] = 0
    counts = (ranges[:, :, 1] - ranges[:, :, 0]).sum(axis=1)
    until = np.cumsum(counts)
    at = 0
    while at < len(links):
        end = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + PAIRS, "right")))
        each = ranges[at:end].reshape(-1, 2)
        n = each[:, 1] - each[:, 0]
        one = np.repeat(np.arange(end - at), counts[at:end])
        two = segs[np.repeat(each[:, 0] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        own = links[at:end][one]
        d = lambda p, q: np.sqrt((p[0][own] - q[0][two]) ** 2 + (p[1][own] - q[1][two]) ** 2)
        a, b = (x1, y1), (x2, y2)
        score = np.minimum(d(a, a) + d(b, b), d(a, b) + d(b, a))
        best = np.full(end - at, np.inf)
        some = np.flatnonzero(counts[at:end])
        if len(some):
            best[some] = np.fmin.reduceat(score, (np.cumsum(counts[at:end]) - counts[at:end])[some])
        keep = np.flatnonzero((score <= best[one] + SLACK) & (score < below + SLACK))
        # Rows come in the order of seg_id, so of equal scores the first row stays.
        keep = keep[np.lexsort((two[keep], score[keep], one[keep]))]
        first = np.ones(len(keep), bool)
        first[1:] = (one[keep][1:] != one[keep][:-1]) | (score[keep][1:] != score[keep][:-1])
        keep = keep[first]
        chosen = rows.select(["seg_id", *_BOX[1:]]).take(pa.array(two[keep])).combine_chunks()
        offsets = np.concatenate([[0], np.cumsum(np.bincount(one[keep], minlength=end - at))]).astype(np.int32)
        near = pa.StructArray.from_arrays([_flat(chosen[c]) for c in chosen.column_names], names=chosen.column_names)
        out = rows.select(["a", "b", *_BOX[1:]]).take(pa.array(links[at:end]))
        yield pa.RecordBatch.from_arrays([*(_flat(out[c]) for c in out.column_names), pa.ListArray.from_arrays(pa.array(offsets), near)], names=[*out.column_names, "near"])
        at = end


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def segment_suppress(segments: DataFrame, overlap: float = 0.6) -> DataFrame:
    """Longest first: a segment goes if its projection covers at least ``overlap`` of a longer one that stays."""
    length2 = g.squared(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))

    def covered(p: Column, d: Column) -> Column:
        vx, vy = p["x2"] - p["x1"], p["y2"] - p["y1"]
        l2 = vx * vx + vy * vy
        at = lambda x, y: ((x - p["x1"]) * vx + (y - p["y1"]) * vy) / l2
        t1, t2 = at(d["x1"], d["y1"]), at(d["x2"], d["y2"])
        shared = F.least(F.greatest(t1, t2), F.lit(1.0)) - F.greatest(F.least(t1, t2), F.lit(0.0))
        return (l2 > 0) & (shared >= overlap)

    return fold_keep(segments, ["pid_id"], [-length2, F.col("seg_id")], ["seg_id", "x1", "y1", "x2", "y2"], covered)


def near_axis(segments: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Segments within the tolerance of horizontal or vertical."""
    return segments.where(g.is_axis_parallel(g.angle_degrees(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), tolerance))


def collinear_spans(segments: DataFrame, gap: int = 6) -> DataFrame:
    """One span per run of axis-parallel segments of nearly one coordinate: (pid_id, flat, first, at, lo, hi, n).

    Segments come by coordinate rounded to multiples of ``gap``, then by start; one joins the group of the first
    member whose coordinate is at most ``gap`` away, else it opens a group.
    """
    flat = F.abs(F.col("x2") - F.col("x1")) >= F.abs(F.col("y2") - F.col("y1"))
    rows = segments.select(
        "pid_id", "seg_id", flat.alias("flat"),
        F.when(flat, F.col("y1") + F.col("y2")).otherwise(F.col("x1") + F.col("x2")).alias("at2"),
        F.when(flat, F.least("x1", "x2")).otherwise(F.least("y1", "y2")).alias("lo"),
        F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest("y1", "y2")).alias("hi"),
    )
    order = F.struct(F.floor((F.col("at2") + gap) / (2 * gap)).alias("k"), "lo", "seg_id", "at2", "hi")
    grouped = rows.groupBy("pid_id", "flat").agg(F.sort_array(F.collect_list(order)).alias("a"))
    near = lambda p, d: F.abs(p["at2"] - d["at2"]) <= 2 * gap
    heads = F.aggregate("a", F.slice("a", 1, 0), lambda acc, d: F.when(F.exists(acc, lambda p: near(p, d)), acc).otherwise(F.concat(acc, F.array(d))))
    member = grouped.select("pid_id", "flat", F.explode("a").alias("d"), heads.alias("h")).select(
        "pid_id", "flat", "d", F.element_at(F.filter("h", lambda p: near(p, F.col("d"))), 1).alias("head")
    )
    return member.groupBy("pid_id", "flat", F.col("head.seg_id").alias("first")).agg(
        F.round(F.sum("d.at2") / F.count("*") / 2, 6).alias("at"), F.min("d.lo").alias("lo"), F.max("d.hi").alias("hi"), F.count("*").alias("n")
    )


def tiles(images: DataFrame, size: int = 640, overlap: float = 0.2) -> DataFrame:
    """(pid_id, x, y, w, h) of overlapping tiles; a row or column of tiles ends with the one that reaches the edge."""
    step = int(size * (1 - overlap))
    starts = lambda n: F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step).cast("long") * step), F.lit(step))
    rows = images.withColumn("x", F.explode(starts(F.col("width").cast("long")))).withColumn("y", F.explode(starts(F.col("height").cast("long"))))
    return rows.select("pid_id", "x", "y", F.least(F.lit(size), F.col("width") - F.col("x")).alias("w"), F.least(F.lit(size), F.col("height") - F.col("y")).alias("h"))


def to_global(detections: DataFrame, origin: DataFrame) -> DataFrame:
    """Boxes of tiles shifted by their tile's origin (tile_id, ox, oy)."""
    return detections.join(origin, "tile_id").select(
        "tile_id", "node_id", *((F.col(c) + F.col("ox" if c[0] == "x" else "oy")).alias(c) for c in _BOX[1:])
    )


def per_class(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("pid_id", "symbol_class").agg(F.count("*").alias("n"))


def top_classes(boxes: DataFrame, k: int = 5) -> DataFrame:
    return boxes.groupBy("symbol_class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol_class").limit(k)


def top_per_drawing(boxes: DataFrame, k: int = 3) -> DataFrame:
    """The k most confident boxes of each drawing."""
    w = Window.partitionBy("pid_id").orderBy(F.desc("confidence"), "node_id")
    return boxes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("pid_id", "node_id", "rank")
