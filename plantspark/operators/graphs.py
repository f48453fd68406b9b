"""Plant graphs as two tables: nodes (node_id, …) and undirected edges (src, dst) with src < dst.

Iterative operators write each round to the shared folder, so a lost executor costs a task and
not the lineage, and stop when nothing changes. Null ends never match; an empty graph gives
empty results, or zeros in summaries.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """The rows as a table in the folder that ``spark.checkpoint.dir`` names (in tests: a temporary one)."""
    spark: SparkSession = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/plantspark-{os.getpid()}"
    path = f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) in either direction."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, degree), 0 for isolated nodes."""
    n = both_ways(edges).groupBy("a").agg(F.count("*").alias("n"))
    return nodes.join(n, F.col("node_id") == F.col("a"), "left").select("node_id", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select(F.col("node_id").alias("id"))
    return edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")


def distinct_pairs(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected edges of links: one per pair, without loops."""
    return links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def build(nodes: DataFrame, links: DataFrame, shortest: int = 10) -> DataFrame:
    """Edges of a plant graph: ends must exist, one edge per pair, at least ``shortest`` pixels between the centres.

    Returns src, dst, length_px, line_type.
    """
    from ..functions import geometry as g

    e = inside(distinct_pairs(links), nodes)
    at = lambda k: nodes.select(F.col("node_id").alias(f"id{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    d = e.join(at(1), F.col("src") == F.col("id1")).join(at(2), F.col("dst") == F.col("id2"))
    length = g.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return d.withColumn("length_px", F.round(length, 2)).where(F.col("length_px") >= shortest).select("src", "dst", "length_px", g.line_type(F.col("length_px"), F.lit(2)).alias("line_type"))


def prune_leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without the junctions of degree 1, in a single pass."""
    leaves = degree(nodes.where("node_type = 'junction'"), edges).where("degree = 1").select(F.col("node_id").alias("leaf"))
    return nodes.join(leaves, F.col("node_id") == F.col("leaf"), "left_anti")


def prune_isolated(nodes: DataFrame, edges: DataFrame, below: float = 0.5) -> DataFrame:
    """Nodes without those of no edge, no tag and little confidence; nodes whose ``source``, if there is one, is ``ocr_injected`` stay."""
    alone = degree(nodes, inside(edges, nodes)).where("degree = 0").select(F.col("node_id").alias("alone"))
    injected = F.coalesce(F.col("source") == "ocr_injected", F.lit(False)) if "source" in nodes.columns else F.lit(False)
    bad = nodes.where((F.col("isa_tag") == "") & (F.col("confidence") < below) & ~injected).select("node_id").join(alone, F.col("node_id") == F.col("alone"), "left_semi")
    return nodes.join(bad.select(F.col("node_id").alias("bad")), F.col("node_id") == F.col("bad"), "left_anti")


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node_id, component): the least node reachable. Labels take their neighbours' least, then jump to its label."""
    both = kept(both_ways(edges))
    state = kept(nodes.select("node_id", F.col("node_id").alias("component"), F.lit(True).alias("moved")))
    for _ in range(most_rounds):
        near = both.join(state, F.col("b") == F.col("node_id")).groupBy("a").agg(F.min("component").alias("near"))
        low = state.join(near, F.col("node_id") == F.col("a"), "left").select("node_id", "component", F.least("component", "near").alias("low"))
        to = low.select(F.col("node_id").alias("to_id"), F.col("low").alias("to_low"))
        jumped = low.join(to, F.col("low") == F.col("to_id"), "left").select("node_id", F.least("low", "to_low").alias("component"), (F.least("low", "to_low") != F.col("component")).alias("moved"))
        state = kept(jumped)
        if state.where("moved").isEmpty():
            return state.select("node_id", "component")
    raise RuntimeError("components didn't settle")


def neighbourhood(edges: DataFrame, start: Column, hops: int = 2) -> DataFrame:
    """(node_id): nodes within ``hops`` edges of the nodes that ``start`` selects, these included."""
    both = both_ways(edges)
    found = both.where(start).select(F.col("a").alias("node_id")).distinct()
    for _ in range(hops):
        found = found.unionByName(both.join(found, F.col("a") == F.col("node_id"), "left_semi").select(F.col("b").alias("node_id"))).distinct()
    return found


def reachable(edges: DataFrame, start: Column, most_rounds: int = 1000) -> DataFrame:
    """(node_id): nodes downstream of the start along src → dst, without the start unless a cycle leads back."""
    found = kept(edges.where(start).select(F.col("dst").alias("node_id")).distinct())
    frontier = found
    for _ in range(most_rounds):
        step = edges.join(frontier, F.col("src") == F.col("node_id"), "left_semi").select(F.col("dst").alias("node_id")).distinct()
        frontier = kept(step.join(found, "node_id", "left_anti"))
        if frontier.isEmpty():
            return found
        found = kept(found.unionByName(frontier))
    raise RuntimeError("reachability didn't settle")


def simple_paths(edges: DataFrame, ends: DataFrame, cutoff: int = 10) -> DataFrame:
    """(path): all simple paths of at most ``cutoff`` edges from source to target of each row of ``ends``, as arrays. Exponential in a dense graph.

    Each length is a table of its own, so it is computed once.
    """
    both = kept(both_ways(edges))
    last = F.element_at("path", -1)
    paths = kept(both.join(ends, F.col("a") == F.col("source")).select(F.array("a", "b").alias("path"), "target"))
    done = paths.where(last == F.col("target"))
    for _ in range(cutoff - 1):
        going = paths.where(last != F.col("target")).join(both, last == F.col("a")).where(~F.array_contains("path", F.col("b")))
        paths = kept(going.select(F.concat("path", F.array("b")).alias("path"), "target"))
        if paths.isEmpty():
            break
        done = done.unionByName(paths.where(last == F.col("target")))
    return done.select("path")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, labelled and tagged nodes, average degree, density."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("label") != "").alias("labelled"), F.count_if(F.col("isa_tag") != "").alias("tagged"))
    e = edges.agg(F.count("*").alias("edges"))
    c = components(nodes, edges).agg(F.count_distinct("component").alias("components"))
    one = n.join(e, F.lit(True)).join(c, F.lit(True))
    return one.select(
        "nodes", "edges", "components", "labelled", "tagged",
        F.round(F.col("edges") * 2 / F.greatest("nodes", F.lit(1)), 2).alias("avg_degree"),
        F.when(F.col("nodes") > 1, F.round(F.col("edges") * 2 / (F.col("nodes") * (F.col("nodes") - 1)), 6)).otherwise(0.0).alias("density"),
    )


def induced(nodes: DataFrame, edges: DataFrame, condition: Column) -> DataFrame:
    """Edges among the nodes that fulfil the condition."""
    return inside(edges, nodes.where(condition))


def grid_layout(nodes: DataFrame, by: str) -> DataFrame:
    """Positions in three columns, per group ``by`` in order of node_id."""
    i = F.row_number().over(Window.partitionBy(by).orderBy("node_id")) - 1
    return nodes.withColumn("i", i).select(by, "node_id", ((F.col("i") % 3) * 280 + 50).cast("long").alias("px"), (F.floor(F.col("i") / 3) * 160 + 50).cast("long").alias("py"))
