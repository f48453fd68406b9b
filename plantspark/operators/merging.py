"""Segments merged over whole drawings: dashes into lines, and near collinear pairs to a fixpoint."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graphs
from .spatial import grid_join


def dashed_clusters(segments: DataFrame, most_length: int = 25, eps: int = 15) -> DataFrame:
    """(pid_id, cluster, x1, y1, x2, y2, n): short segments chained by midpoint and direction, with their span.

    Two segments are near if midpoint and 100 times the angle (modulo a half turn) are within ``eps`` together.
    A cluster needs two segments, so clusters are the components of the near pairs; others stay alone.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    short = segments.where(dx * dx + dy * dy <= most_length * most_length)
    angle = F.pmod(F.atan2(dy.cast("double"), dx.cast("double")), F.lit(math.pi)) * 100
    s = short.select("pid_id", F.col("seg_id").alias("node_id"), "x1", "y1", "x2", "y2", ((F.col("x1") + F.col("x2")) / 2).alias("mx"), ((F.col("y1") + F.col("y2")) / 2).alias("my"), F.round(angle, 6).alias("a"))
    p = grid_join(s, s, F.col("mx"), F.col("my"), F.col("mx"), F.col("my"), eps).where(F.col("node_id") < F.col("r_node_id"))
    square = lambda x: x * x
    near = p.where(square(F.col("mx") - F.col("r_mx")) + square(F.col("my") - F.col("r_my")) + square(F.col("a") - F.col("r_a")) <= eps * eps)
    c = graphs.components(s.select("node_id"), near.select(F.col("node_id").alias("src"), F.col("r_node_id").alias("dst")).distinct()).withColumnRenamed("node_id", "id")
    return s.join(c, F.col("node_id") == F.col("id")).groupBy("pid_id", F.col("component").alias("cluster")).agg(
        F.min(F.least("x1", "x2")).alias("x1"), F.min(F.least("y1", "y2")).alias("y1"), F.max(F.greatest("x1", "x2")).alias("x2"), F.max(F.greatest("y1", "y2")).alias("y2"), F.count("*").alias("n")
    )


Segment = tuple[float, float, float, float]


def place_on(line: Segment, x: float, y: float) -> tuple[float, float]:
    """Position along a line (0 at its start, 1 at its end) and distance from the endless line."""
    vx, vy = line[2] - line[0], line[3] - line[1]
    square = vx * vx + vy * vy
    if not square:
        return 0.0, math.hypot(x - line[0], y - line[1])
    t = ((x - line[0]) * vx + (y - line[1]) * vy) / square
    return t, math.hypot(x - line[0] - t * vx, y - line[1] - t * vy)


def connectable(a: Segment, b: Segment, degrees: float, gap: float) -> bool:
    """Directions within ``degrees`` (directed) and an end of one within ``gap`` of the other's endless line."""
    turn = abs(math.atan2(a[3] - a[1], a[2] - a[0]) - math.atan2(b[3] - b[1], b[2] - b[0])) % (2 * math.pi)
    if min(turn, 2 * math.pi - turn) > math.radians(degrees):
        return False
    return any(place_on(p, *q[k : k + 2])[1] <= gap for p, q in ((a, b), (b, a)) for k in (0, 2))


def joined(a: Segment, b: Segment) -> Segment:
    """The outermost of four ends along the first segment."""
    ends = sorted((place_on(a, *s[k : k + 2])[0], s[k], s[k + 1]) for s in (a, b) for k in (0, 2))
    return (*ends[0][1:], *ends[-1][1:])


def merge_collinear(segments: DataFrame, degrees: float = 12, gap: float = 45) -> DataFrame:
    """(pid_id, place, x1, y1, x2, y2): the first connectable pair is merged, again and again, until none is left.

    The order of merges matters, so a drawing is one group. A merged segment takes the first one's place.
    """

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[Segment] = list(pdf.sort_values("seg_id")[["x1", "y1", "x2", "y2"]].astype(float).itertuples(index=False, name=None))
        # All pairs before (i, j) are known not to be connectable until a merge changes row i.
        i = 0
        while i < len(rows):
            j = next((j for j in range(i + 1, len(rows)) if connectable(rows[i], rows[j], degrees, gap)), None)
            if j is None:
                i += 1
                continue
            rows[i] = joined(rows[i], rows.pop(j))
            i = next((k for k in range(i) if connectable(rows[k], rows[i], degrees, gap)), i)
        out = pd.DataFrame(rows, columns=["x1", "y1", "x2", "y2"])
        out.insert(0, "place", range(len(rows)))
        out.insert(0, "pid_id", pdf["pid_id"].iloc[0])
        return out

    return segments.select("pid_id", "seg_id", "x1", "y1", "x2", "y2").groupBy("pid_id").applyInPandas(merged, "pid_id long, place long, x1 double, y1 double, x2 double, y2 double")
