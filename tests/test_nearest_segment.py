"""Nearest segments against brute force, and without a shuffle of pairs."""

import math
import random

import pyarrow as pa
from plantspark.operators import spatial

LINK = "pid_id long, a long, b long, ax double, ay double, bx double, by double"
SEGMENT = "pid_id long, seg_id long, x1 double, y1 double, x2 double, y2 double"


def made(seed):
    """Drawings with crowded and far points, ties, copies, and rows without a drawing or a coordinate."""
    r = random.Random(seed)
    at = lambda: float(r.choice([r.randrange(-300, 300), r.randrange(-5, 5), r.randrange(10**6)]))
    segments = [(r.choice([40, 80, 120, None]), k, at(), at(), at(), at()) for k in range(400)]
    segments += [(p, 1000 + k, *e) for k, (p, _, *e) in enumerate(segments[:60])] + [(40, 2000, None, 0.0, 1.0, 1.0), (40, 2001, math.inf, 0.0, 1.0, 1.0)]
    links = [(r.choice([40, 80, 120, 160, None]), k, k + 1, at(), at(), at(), at()) for k in range(300)] + [(40, 900, 901, None, 0.0, 1.0, 1.0)]
    r.shuffle(segments)
    return links, segments


def brute(links, segments):
    out = {}
    for pid, a, _, *p in links:
        scores = []
        for other, seg, *q in segments:
            if pid is not None and pid == other and None not in p + q:
                d = [[math.dist(p[i : i + 2], q[j : j + 2]) for j in (0, 2)] for i in (0, 2)]
                scores.append((round(min(d[0][0] + d[1][1], d[0][1] + d[1][0]), 6), seg))
        out[a] = min((x for x in scores if x[0] < 200), default=(None, None))
    return out


def test_nearest_equals_brute_force(spark):
    links, segments = made(1)
    exact = brute(links, segments)
    found = spatial.nearest_segment(spark.createDataFrame(links, LINK).repartition(3), spark.createDataFrame(segments, SEGMENT).repartition(3)).collect()
    assert len(found) == len(links) and {r["a"]: (r["score"], r["seg_id"]) for r in found} == exact
    assert 20 < sum(s is not None for s, _ in exact.values()) < len(links)


def test_small_batches_and_blocks(monkeypatch):
    monkeypatch.setattr(spatial, "PAIRS", 7)
    links, segments = made(2)
    rows = [(p, True, a, b, None, *e) for p, a, b, *e in links] + [(p, False, None, None, s, *e) for p, s, *e in segments]
    rows.sort(key=lambda r: (-1 if r[0] is None else r[0], -1 if r[4] is None else r[4]))
    names = ["pid_id", "link", "a", "b", "seg_id", "x1", "y1", "x2", "y2"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 4]
    whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    for size in (1, 13, 10_000):
        found = {}
        for batch in spatial._near_links(iter([whole.slice(k, size) for k in range(0, len(rows), size)]), 200):
            for r in batch.to_pylist():
                found[r["a"]] = {m["seg_id"] for m in r["near"]}
        exact = brute(links, segments)
        assert set(found) == set(exact) and all(seg is None or seg in found[a] for a, (_, seg) in exact.items())


def test_no_pair_is_shuffled(spark):
    links, segments = made(3)
    df = spatial.nearest_segment(spark.createDataFrame(links, LINK), spark.createDataFrame(segments, SEGMENT))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
