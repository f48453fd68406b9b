"""Links and points of all segments, against brute force."""

import math
from types import SimpleNamespace

from plantspark.operators import spatial
from plantspark.plans import catalogue

SEGMENT = "pid_id long, seg_id long, x1 long, y1 long, x2 long, y2 long"
#: Two of them are multiples of 7, two are 1 modulo 3.
ROWS = [(40, k, 100 * (k % 4), 30 * k, 100 * (k % 4) + 10 * k, 30 * k + 5 * (k % 2)) for k in range(4, 16)] + [(80, 21, 0, 0, 9, 9)]


def run(spark, name):
    catalogue._load()
    return catalogue._QUERIES[name](SimpleNamespace(segments=spark.createDataFrame(ROWS, SEGMENT))).collect()


def test_edge_segment_of_all(spark):
    exact = {}
    for pid, a, x1, y1, x2, y2 in ROWS:
        p, q = (x1 + 3, y1 + 4), (x2 + 5, y2 + 2)
        scores = []
        for other, seg, u1, v1, u2, v2 in ROWS:
            if other == pid:
                u, v = (u1, v1), (u2, v2)
                scores.append((round(min(math.dist(p, u) + math.dist(q, v), math.dist(p, v) + math.dist(q, u)), 6), seg))
        exact[a] = min(x for x in scores if x[0] < 200)
    found = {r["a"]: (r["score"], r["seg_id"]) for r in run(spark, "edge_segment")}
    assert found == exact and len(found) == len(ROWS)


def test_links_without_a_segment_stay(spark):
    links = spark.createDataFrame([(40, 1, 2, 0, 0, 9, 9), (40, 3, 4, 900, 900, 990, 990), (99, 5, 6, 0, 0, 9, 9)], "pid_id long, a long, b long, ax long, ay long, bx long, by long")
    segments = spark.createDataFrame([(40, 8, 0, 0, 9, 9)], SEGMENT)
    assert sorted(tuple(r) for r in spatial.nearest_segment(links, segments).collect()) == [(1, 2, 8, 0.0), (3, 4, None, None), (5, 6, None, None)]


def test_junctions_of_all(spark):
    exact = {}
    for pid, junc, _, _, x, y in ROWS:
        near = [s for p, s, *e in ROWS if p == pid and min(math.dist((x, y), e[:2]), math.dist((x, y), e[2:])) <= 28]
        exact[junc] = ",".join(sorted(map(str, near)))
    assert {r["junc_id"]: r["segs"] for r in run(spark, "junction_segments")} == exact

    heads = {}
    for pid, junc, _, _, x, y in sorted(ROWS):
        own = next((h for h in heads if h[0] == pid and math.dist(h[2:], (x, y)) <= 20), (pid, junc, x, y))
        heads.setdefault(own, []).append((x, y))
    found = {(r["pid_id"], r["junc_id"]): (r["x"], r["y"], r["n"]) for r in run(spark, "junction_cluster")}
    assert found == {h[:2]: (sum(x for x, _ in v) // len(v), sum(y for _, y in v) // len(v), len(v)) for h, v in heads.items()}
