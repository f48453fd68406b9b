"""What requests need around the rule engine: search texts, chunks for a model, guards, answers, highlights.

No model is called. ``guarded`` tells which validations may run; ``issues`` gives the rule engine's rows in the shape
of a model's answer, and ``parsed_answers`` reads such answers from text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import unfenced
from .store import issue_type

ISSUE = "struct<type:string,component:string,description:string,severity:string,relatedNodes:array<string>>"
#: How much of a graph and of a procedure a model is shown.
MOST_NODES, MOST_EDGES, MOST_CHARS = 200, 300, 8000


def search_text(components: Column, text: Column, most: int = 3000) -> Column:
    """The components, and the first characters of the procedure."""
    return F.concat_ws(" ", F.concat_ws(" ", components), F.substring(text, 1, most))


def node_chunk(node_id: Column, kind: Column, label: Column, attributes: Column) -> Column:
    """'Node id: type=…, label=…' and up to five attributes."""
    pairs = F.transform(F.slice(F.map_entries(attributes), 1, 5), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    head = F.concat(F.lit("Node "), node_id, F.lit(": type="), kind, F.lit(", label="), label)
    return F.concat_ws(", ", head, F.nullif(F.array_join(pairs, ", "), F.lit("")))


def edge_chunk(source: Column, target: Column) -> Column:
    return F.concat(F.lit("Edge: "), source, F.lit(" -> "), target)


def guarded(rows: DataFrame, has_key: bool) -> DataFrame:
    """Adds ``decision``: 'validation_skipped' without a key, then 'no issues' without a procedure, else 'run'."""
    empty = F.length(F.trim(F.coalesce("sop_text", F.lit("")))) == 0
    return rows.withColumn("decision", F.when(F.lit(not has_key), "validation_skipped").when(empty, "no issues").otherwise("run"))


def issues(found: DataFrame) -> DataFrame:
    """Discrepancies as issues: types and severities of the API."""
    severity = F.when(F.col("severity") == "CRITICAL", "error").when(F.col("severity") == "WARNING", "warning").otherwise("info")
    return found.select("sop_id", issue_type(F.col("disc_type")).alias("type"), F.coalesce("sop_tag", "graph_tag").alias("component"), severity.alias("severity"))


def parsed_answers(rows: DataFrame, answer: str) -> DataFrame:
    """Adds ``issues`` from JSON text: a list, or an object with a list under issues, result or discrepancies; null if it is neither."""
    text = unfenced(F.col(answer))
    listed = F.from_json(text, f"array<{ISSUE}>")
    held = F.from_json(text, f"struct<issues:array<{ISSUE}>,result:array<{ISSUE}>,discrepancies:array<{ISSUE}>>")
    found = F.when(F.startswith(text, F.lit("[")), listed).when(F.startswith(text, F.lit("{")), F.coalesce(held["issues"], held["result"], held["discrepancies"]))
    typed = F.transform(found, lambda i: i.withField("type", issue_type(i["type"])).withField("severity", F.coalesce(i["severity"], F.lit("error"))))
    return rows.withColumn("issues", typed)


def related_nodes(answers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node_id, label) of the nodes that issues name; null labels for nodes that aren't there."""
    named = answers.select("key", F.explode("issues").alias("i")).select("key", F.explode("i.relatedNodes").alias("node_id"))
    return named.join(nodes.select(F.col("node_id").alias("n"), "label"), F.col("node_id") == F.col("n"), "left").select("key", "node_id", "label")


def highlighted(nodes: DataFrame, edges: DataFrame, chosen: Column) -> DataFrame:
    """Edges with whether both ends are chosen."""
    picked = nodes.where(chosen).select(F.col("node_id").alias("id"))
    a, b = picked.withColumnRenamed("id", "ia"), picked.withColumnRenamed("id", "ib")
    both = edges.join(a, F.col("src") == F.col("ia"), "left").join(b, F.col("dst") == F.col("ib"), "left")
    return both.select("src", "dst", (F.col("ia").isNotNull() & F.col("ib").isNotNull()).alias("highlighted"))


def in_margins(x: Column, y: Column, width: int, height: int) -> Column:
    """Whether a point is in the title block (bottom 40 %, right half) or the header (top 12 %, middle third)."""
    title = (y >= height * 0.6) & (x >= width * 0.5)
    header = (y <= height * 0.12) & (x >= width / 3) & (x <= width * 2 / 3)
    return title | header


#: Guesses by shape, the first that applies: class, confidence, least circularity, most solidity, aspect above and below.
SHAPES = (
    ("pressure_indicator", 0.60, 0.70, None, 0.7, 1.4),
    ("flow_indicator", 0.55, 0.55, None, None, None),
    ("gate_valve", 0.50, None, 0.50, None, None),
    ("centrifugal_pump", 0.45, None, None, 1.5, 4.0),
    ("unknown", 0.35, None, None, None, None),
)


def component_class(area: Column, perimeter: Column, hull: Column, width: Column, height: Column) -> Column:
    """(symbol_class, confidence) from the shape of a component of ink."""
    circularity = F.when(perimeter > 0, F.lit(4 * math.pi) * area / (perimeter * perimeter)).otherwise(0.0)
    solidity, aspect = area / F.greatest(hull, F.lit(1)), width / height
    guesses = []
    for name, confidence, least_round, most_solid, above, below in SHAPES:
        rules = F.lit(True)
        for bound, rule in ((least_round, circularity > F.lit(least_round)), (most_solid, solidity < F.lit(most_solid)), (above, aspect > F.lit(above)), (below, aspect < F.lit(below))):
            rules = rules & rule if bound is not None else rules
        guesses.append(F.when(rules, F.struct(F.lit(name).alias("symbol_class"), F.lit(confidence).alias("confidence"))))
    return F.coalesce(*guesses)
