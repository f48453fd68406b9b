"""Hand-checked cases and brute force for what SQL doesn't cover."""

import difflib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plantspark.functions import geometry as g
from plantspark.functions import raster
from plantspark.functions import tags as t
from plantspark.operators import exports, graphs, merging, metrics, procedures, retrieval, spatial, store, xref

BOX = "pid_id long, node_id long, symbol_class string, x1 int, y1 int, x2 int, y2 int, confidence double, source string"


def one(spark, expression, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(expression.alias("r")).first()["r"]


def test_iou_by_hand(spark):
    boxes = [F.lit(v) for v in (0, 0, 10, 10)], [F.lit(v) for v in (1, 1, 11, 11)], [F.lit(v) for v in (50, 50, 60, 60)]
    a, b, c = (g.Box(*x) for x in boxes)
    assert one(spark, g.iou(a, b)) == pytest.approx(81 / 119)
    assert one(spark, g.iou(a, c)) == 0.0
    assert one(spark, g.iou(g.Box(*[F.lit(1)] * 4), g.Box(*[F.lit(1)] * 4))) == 0.0
    assert one(spark, g.point_to_box(F.lit(0), F.lit(0), g.Box(*(F.lit(v) for v in (3, 4, 10, 10))))) == 5
    assert one(spark, g.point_to_box(F.lit(5), F.lit(5), a)) == 0


def test_suppression_by_hand(spark):
    rows = [(1, 1, "v", 0, 0, 10, 10, 0.9, "s"), (1, 2, "v", 1, 1, 11, 11, 0.8, "s"), (1, 3, "v", 50, 50, 60, 60, 0.7, "s"), (None, 4, "v", 0, 0, 10, 10, 0.9, None)]
    boxes = spark.createDataFrame(rows, BOX)
    assert sorted(r["node_id"] for r in spatial.suppress(boxes).collect()) == [1, 3, 4]
    # At exactly the threshold: gone if at least suffices, kept if it has to be above.
    two = spark.createDataFrame([(1, 1, "v", 0, 0, 10, 10, 0.9, "s"), (1, 2, "v", 0, 0, 10, 5, 0.8, "s")], BOX)
    assert spatial.suppress(two).count() == 1 and spatial.suppress(two, strict=True).count() == 2
    assert spatial.suppress(boxes.limit(0)).count() == 0


def test_proximity_by_hand(spark):
    def kept(apart):
        rows = [(1, 1, "v", 0, 0, 10, 10, 0.3, "yolov5"), (1, 2, "w", apart, 0, 10 + apart, 10, 0.9, "classical")]
        return sorted(r["node_id"] for r in spatial.dedup_proximity(spark.createDataFrame(rows, BOX)).collect())

    assert kept(39) == [1] and kept(40) == [1, 2]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(1, 40), st.integers(1, 40)), min_size=1, max_size=12))
def test_suppression_properties(spark, sizes):
    rows = [(1, i, "v", x, y, x + w, y + h, 1.0 / (i + 1), "s") for i, (x, y, w, h) in enumerate(sizes)]
    boxes = spark.createDataFrame(rows, BOX).coalesce(1)
    kept = [r["node_id"] for r in spatial.suppress(boxes).collect()]

    def iou(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        i = max(0, w) * max(0, h)
        return i / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - i)

    for i, a in enumerate(rows):
        clash = any(iou(rows[k], a) >= 0.5 for k in kept if k < i)
        assert (i in kept) != clash


def test_tags_by_hand(spark):
    def parsed(text):
        p = t.drawing_tag(F.col("x"))
        return one(spark, F.struct(*(p[k] for k in ("prefix", "number", "tag"))), x=text)

    assert tuple(parsed("FCV-101A")) == ("FCV", "101A", "FCV-101A")
    assert tuple(parsed("TE_3B")) == ("TE", "3B", "TE-3B")
    assert tuple(parsed("abc")) == (None, None, None)
    assert one(spark, t.procedure_tags(F.col("x")), x="FCV-101 PT_203A P101 lt-9 T 12") == ["FCV-101", "PT-203A", "P-101"]
    hints = {"FCV": "flow_controller", "PT": "pressure_transmitter", "V": "unknown", "P": "pressure", "XV": "unclassified_control_valve"}
    assert {k: one(spark, t.component_hint(F.col("x")), x=k) for k in hints} == hints
    classes = {"PSV": "relief_valve", "LT": "level_transmitter", "ZI": "position_indicator", "QQ": "instrument"}
    assert {k: one(spark, t.prefix_class(F.col("x")), x=k) for k in classes} == classes
    for prefix, symbol, ok in (("FCV", "control_valve", True), ("PDT", "vessel", False), ("ZZ", "x", True)):
        assert one(spark, t.compatible(F.lit(prefix), F.lit(symbol))) is ok


def test_valves_and_parameters_by_hand(spark):
    states = lambda x: [tuple(r) for r in one(spark, t.valve_states(F.col("x")), x=x)]
    assert states("Open: FCV-101. Close XV-200") == [("FCV-101", "open"), ("XV-200", "closed")]
    assert states("open valve FCV-101") == []
    text = "3 bar then 5 BAR, 80 °C"
    assert one(spark, t.parameter(F.col("x"), "pressure"), x=text) == "5 bar"
    assert one(spark, t.parameter(F.col("x"), "temperature"), x=text) == "80 °c"
    assert one(spark, t.parameter(F.col("x"), "flow"), x=text) is None
    assert one(spark, t.unfenced(F.col("x")), x="a ```json\n{}\n``` b") == "{}"
    assert one(spark, t.plain_xml(F.col("x")), x="<w:p a='1'><w:t>a &amp; b</w:t></w:p>") == "\na='1'>a & b"


def test_sections_by_hand(spark):
    lines = [(1, i, x) for i, x in enumerate(["STARTUP STEPS", "a", "", "SHUTDOWN STEPS", "FINAL STEPS", " b ", None])]
    found = procedures.sections(spark.createDataFrame(lines, "sop_id long, line_no long, text string")).orderBy("step_no").collect()
    assert [(r["heading"], r["text"]) for r in found] == [("STARTUP STEPS", "a"), ("FINAL STEPS", "b")]


def test_similar_names_against_brute_force(spark):
    r = random.Random(1)
    made = lambda: "".join(r.choice("ABCV") for _ in range(r.randint(1, 4))) + f"-{r.randint(10, 150)}"
    wanted, there = {made() for _ in range(60)}, sorted({made() for _ in range(60)})
    left = spark.createDataFrame([(1, q) for q in wanted], "sop_id long, q string")
    right = spark.createDataFrame([(1, n, k % 2) for k, n in enumerate(there)], "sop_id long, name string, is_tag int")
    found = {x["q"]: (x["name"], round(x["score"], 9)) for x in xref.best_similar(left, right).collect()}
    exact = {}
    for q in wanted:
        scored = [(difflib.SequenceMatcher(None, q, n).ratio(), k % 2, n) for k, n in enumerate(there)]
        best = max(x for x in scored)
        if best[0] >= xref.SIMILAR:
            exact[q] = (best[2], round(best[0], 9))
    assert found == exact


def test_discrepancies_by_hand(spark):
    lines = [(1, 1, "START SECTION"), (1, 2, "Open: XV-200 and FCV-101"), (1, 3, "check PT-303 and LT-4444")]
    plant = [
        (1, "n1", 1, "XV-200", "", "gate_valve", "closed"), (1, "n2", 2, "FCV-101", "", "vessel", ""),
        (1, "n3", 3, "PT-3O3", "", "pressure_transmitter", ""), (1, "n4", 4, "K-900", "", "compressor", ""), (1, "n5", 5, "", "", "tee", ""),
    ]
    steps = procedures.steps(spark.createDataFrame(lines, "sop_id long, line_no long, text string"))
    nodes = spark.createDataFrame(plant, "sop_id long, node_id string, ord long, isa_tag string, label string, symbol_class string, state string")
    rows = xref.discrepancies(steps, nodes).orderBy("disc_id").collect()
    assert [(r["disc_id"], r["disc_type"], r["sop_tag"], r["graph_tag"]) for r in rows] == [
        ("DISC-001", "type_mismatch", "FCV-101", "n2"),
        ("DISC-002", "label_mismatch", "PT-303", "PT-3O3"),
        ("DISC-003", "missing_component", "LT-4444", None),
        ("DISC-004", "wrong_valve_state", "XV-200", "n1"),
        ("DISC-005", "extra_component", None, "K-900"),
    ]
    s = xref.summary(steps, nodes).first()
    assert (s["total_tags"], s["matched_tags"], s["missing_tags"], s["coverage_pct"], s["n_critical"], s["n_warning"], s["n_info"]) == (4, 3, 1, 75.0, 2, 2, 1)


def test_merge_against_plain_restart(spark):
    r = random.Random(3)
    rows = [(p, i, *(r.randint(0, 300) for _ in range(4))) for p in range(6) for i in range(14)]
    found = merging.merge_collinear(spark.createDataFrame(rows, "pid_id long, seg_id long, x1 int, y1 int, x2 int, y2 int"))
    for p in range(6):
        own = [tuple(map(float, x[2:])) for x in rows if x[0] == p]
        while True:
            pair = next(((i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if merging.connectable(own[i], own[j], 12, 45)), None)
            if not pair:
                break
            own[pair[0]] = merging.joined(own[pair[0]], own.pop(pair[1]))
        assert [tuple(x)[2:] for x in found.where(F.col("pid_id") == p).orderBy("place").collect()] == own


def test_graph_by_hand(spark):
    nodes = [(1, "symbol"), (2, "junction"), (3, "junction"), (4, "symbol"), (5, "symbol")]
    n = spark.createDataFrame([(i, k, "x", "", "", 0.4, i * 100, 0) for i, k in nodes], "node_id long, node_type string, symbol_class string, isa_tag string, label string, confidence double, x int, y int")
    e = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    assert sorted(r["node_id"] for r in graphs.prune_leaves(n, e).collect()) == [1, 2, 4, 5]
    assert sorted(r["node_id"] for r in graphs.prune_isolated(n, e).collect()) == [1, 2, 3]
    assert {r["node_id"]: r["component"] for r in graphs.components(n, e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    s = graphs.summary(n, e).first()
    assert (s["nodes"], s["edges"], s["components"], s["avg_degree"]) == (5, 2, 3, 0.8)
    assert graphs.components(n.limit(0), e.limit(0)).count() == 0 and graphs.summary(n.limit(0), e.limit(0)).first()["nodes"] == 0
    links = spark.createDataFrame([(2, 1), (1, 2), (1, 1), (1, 9)], "a long, b long")
    assert [tuple(r) for r in graphs.build(n, links).collect()] == [(1, 2, 100.0, "main_process")]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_against_union_find(spark, pairs):
    root = list(range(31))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    nodes = spark.range(31).withColumnRenamed("id", "node_id")
    edges = spark.createDataFrame(pairs, "src long, dst long")
    assert {r["node_id"]: r["component"] for r in graphs.components(nodes, edges).collect()} == {i: find(i) for i in range(31)}


def test_matching_by_hand(spark):
    pred = spark.createDataFrame([(1, 1, "a", 50, 50, 200, 200, 0.9, "s"), (1, 2, "b", 30, 30, 150, 150, 0.7, "s")], BOX)
    truth = spark.createDataFrame([(1, 1, "a", 50, 50, 200, 200)], "pid_id long, gt_id long, symbol_class string, x1 int, y1 int, x2 int, y2 int")
    found = metrics.match(pred, truth).collect()
    assert sorted(r["percent"] for r in found) == list(range(50, 100, 5)) and {r["node_id"] for r in found} == {1}
    ap = metrics.average_precision(metrics.ranked(pred, truth)).collect()
    assert [(r["symbol_class"], round(r["ap"], 3)) for r in ap] == [("a", 0.995)]
    assert metrics.confusion(pred.limit(0), truth).collect()[0]["n"] == 1


def test_search_and_store(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["distance"]) for r in retrieval.search(v, [2.0, 0.0], 9).collect()] == [(0, 0.0), (2, 0.292893), (1, 1.0)]
    assert retrieval.vector_of(v, 77) == []
    old = spark.createDataFrame([(1, 5, "old"), (2, 9, "old")], "k long, at long, v string")
    new = spark.createDataFrame([(1, 5, "new"), (2, 8, "new"), (3, 1, "new")], "k long, at long, v string")
    assert {r["k"]: r["v"] for r in store.upsert(old, new, "k", "at").collect()} == {1: "new", 2: "old", 3: "new"}
    box = spark.createDataFrame([(7, 1, "v", 100, 50, 200, 150, 0.5, "s")], BOX)
    assert '"bbox":[100,50,100,100]' in exports.coco_rows(box).first()["json"]


def test_grid_join_equals_all_pairs(spark):
    r = random.Random(5)
    left = [(r.randint(1, 2), i, r.randint(-200, 200), r.randint(-200, 200)) for i in range(80)]
    right = [(r.randint(1, 2), i, r.randint(-200, 200), r.randint(-200, 200)) for i in range(80)]
    a = spark.createDataFrame(left, "pid_id long, i long, x int, y int")
    b = spark.createDataFrame(right, "pid_id long, j long, x int, y int")
    near = spatial.grid_join(a, b, F.col("x"), F.col("y"), F.col("x"), F.col("y"), 37).where(g.squared(F.col("x"), F.col("y"), F.col("r_x"), F.col("r_y")) <= 37 * 37)
    exact = sorted((i, j) for p, i, x, y in left for q, j, u, v in right if p == q and (x - u) ** 2 + (y - v) ** 2 <= 37 * 37)
    assert sorted((x["i"], x["r_j"]) for x in near.collect()) == exact


def page():
    image = np.full((60, 80), 255, np.uint8)
    image[10, 5:75] = 0
    image[5:55, 40] = 0
    image[45:52, 60:70] = 0
    return image


def test_raster_kernels():
    ink = raster.binarise(page())
    assert ink.sum() == (page() == 0).sum()
    assert raster.components(ink) == [(5, 5, 70, 50, 119), (60, 45, 10, 7, 70)]
    assert raster.runs(ink, 60) == [(10, 5, 75)]
    thin = raster.skeleton(ink)
    assert thin.sum() <= ink.sum() and not (thin & ~ink).any()
    assert any(abs(x - 40) <= 1 and abs(y - 10) <= 1 for x, y in raster.line_points(thin)[0])
    assert (raster.opened(ink, 20, 1).sum(), raster.opened(ink, 1, 20).sum()) == (70, 50)
    assert raster.otsu(np.array([[10, 12, 200, 210]], np.uint8)) in range(12, 200)
    assert np.allclose(raster.box_mean(np.full((5, 5), 7, np.uint8), 3), 7)


def test_raster_rows(spark):
    p = page()
    images = spark.createDataFrame([("a", 60, 80, bytearray(p.tobytes())), ("b", None, None, None)], "path string, height int, width int, pixels binary")
    assert [tuple(r) for r in raster.line_segments(images).orderBy("x1").collect()][0][1:] == (5, 10, 74, 10)
    assert raster.symbol_candidates(images).count() == 2
    assert raster.branch_points(images).count() >= 1
