"""The rule engine that holds procedures against plant graphs.

A plant is a table (sop_id, node_id, ord, isa_tag, label, symbol_class, state), a procedure the steps
of ``procedures.steps``. Tags compare in upper case. A tag's node is the last by ``ord`` with that
tag, else the last with that label. Tags without a node are compared with all tags and labels of
their plant by similarity; equal strings and strings whose lengths alone rule the similarity out are
never compared. Null tags and labels count as empty and name nothing.

Scale: everything joins on (sop_id, tag). Only the tags left without a node meet the names of their own
plant, and a plant is one drawing set.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import tags as t
from ..functions.dims import SEVERITY_RANK, lookup

SIMILAR = 0.82


@F.pandas_udf(DoubleType())
def similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratio of matching characters of two strings in upper case, as difflib gives it."""
    from difflib import SequenceMatcher

    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x.upper(), y.upper()).ratio() for x, y in zip(a, b)], dtype="float64")


def names(plant: DataFrame) -> DataFrame:
    """(sop_id, name, node_id, symbol_class, state): what each tag or label stands for."""
    n = plant.select("sop_id", "node_id", "ord", "symbol_class", "state", F.upper("isa_tag").alias("tag"), F.upper("label").alias("label"))
    both = n.withColumn("x", F.explode(F.array(F.struct(F.col("tag").alias("name"), F.lit(1).alias("is_tag")), F.struct(F.col("label").alias("name"), F.lit(0).alias("is_tag")))))
    picked = (
        both.where(F.length("x.name") > 0)
        .groupBy("sop_id", F.col("x.name").alias("name"))
        .agg(F.max_by(F.struct("node_id", "symbol_class", "state", "x.is_tag"), F.struct("x.is_tag", "ord")).alias("m"))
    )
    return picked.select("sop_id", "name", "m.node_id", "m.symbol_class", "m.state", "m.is_tag")


def best_similar(left: DataFrame, names_of: DataFrame, least: float = SIMILAR) -> DataFrame:
    """For each (sop_id, q) the most similar name at or above ``least``; ties go to tags, then by name."""
    a, b = left.select("sop_id", "q").distinct(), names_of.select("sop_id", "name", "is_tag")
    la, lb = F.length("q"), F.length("name")
    # The ratio is at most twice the shorter length over the sum of both.
    possible = F.least(la, lb) * 2 >= (la + lb) * F.lit(least)
    scored = a.join(b, "sop_id").where(possible).withColumn("score", similarity("q", "name")).where(F.col("score") >= least)
    return scored.groupBy("sop_id", "q").agg(F.max_by(F.struct("name", "score"), F.struct("score", "is_tag", "name")).alias("m")).select("sop_id", "q", "m.name", "m.score")


def tagged(made: DataFrame, plant: DataFrame) -> DataFrame:
    """Each step's tags with their node: sop_id, step_no, pos, tag, node_id, symbol_class (null without one)."""
    from .procedures import step_tags

    n = names(plant).select(F.col("sop_id").alias("s"), "name", "node_id", "symbol_class")
    s = step_tags(made)
    return s.join(n, (F.col("sop_id") == F.col("s")) & (F.upper("tag") == F.col("name")), "left").drop("s", "name")


def _row(kind: str, severity: str, step: Column, phase: int, place: Column, sop_tag: Column, graph_tag: Column) -> list[Column]:
    return [
        F.col("sop_id"), F.lit(kind).alias("disc_type"), F.lit(severity).alias("severity"), step.alias("step_no"), F.lit(phase).alias("phase"),
        place.alias("pos"), sop_tag.alias("sop_tag"), graph_tag.alias("graph_tag"),
    ]


def type_mismatches(made: DataFrame, plant: DataFrame) -> DataFrame:
    prefix = F.substring_index(F.upper("tag"), "-", 1)
    bad = tagged(made, plant).where("node_id is not null and symbol_class <> 'unknown'").where(~t.compatible(prefix, F.col("symbol_class")))
    return bad.select(*_row("type_mismatch", "CRITICAL", F.col("step_no"), 0, F.col("pos"), F.col("tag"), F.col("node_id")))


def unmatched(made: DataFrame, plant: DataFrame, fuzzy: bool = True) -> DataFrame:
    """missing_component and, with ``fuzzy``, label_mismatch rows."""
    left = tagged(made, plant).where("node_id is null")
    missing = lambda d: d.select(*_row("missing_component", "CRITICAL", F.col("step_no"), 0, F.col("pos"), F.col("tag"), F.lit(None).cast("string")))
    if not fuzzy:
        return missing(left)
    similar = best_similar(left.select("sop_id", F.upper("tag").alias("q")), names(plant)).withColumnsRenamed({"sop_id": "s"})
    both = left.join(similar, (F.col("sop_id") == F.col("s")) & (F.upper("tag") == F.col("q")), "left")
    near = both.where("name is not null").select(*_row("label_mismatch", "WARNING", F.col("step_no"), 0, F.col("pos"), F.col("tag"), F.col("name")))
    return missing(both.where("name is null")).unionByName(near)


def valve_conflicts(made: DataFrame, plant: DataFrame) -> DataFrame:
    from .procedures import step_valves

    n = names(plant).select(F.col("sop_id").alias("s"), "name", "node_id", F.col("state").alias("found"))
    v = step_valves(made).join(n, (F.col("sop_id") == F.col("s")) & (F.upper("tag") == F.col("name")))
    bad = v.where((F.length("found") > 0) & (F.lower("found") != F.lower("state")))
    return bad.select(*_row("wrong_valve_state", "WARNING", F.col("step_no"), 1, F.col("pos"), F.col("tag"), F.col("node_id")))


def extra_components(made: DataFrame, plant: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Named nodes that no step of their procedure mentions, by tag or by label."""
    from .procedures import step_tags

    wanted = step_tags(made).select(F.col("sop_id").alias("s"), F.upper("tag").alias("w")).distinct()
    n = plant.select("sop_id", "node_id", "ord", F.upper("isa_tag").alias("tag"), F.upper("label").alias("label")).where("tag <> '' or label <> ''")
    mentioned = n.withColumn("x", F.explode(F.array("tag", "label"))).join(wanted, (F.col("sop_id") == F.col("s")) & (F.col("x") == F.col("w")), "left_semi")
    hit = mentioned.select(F.col("sop_id").alias("s"), F.col("node_id").alias("hit")).distinct()
    left = n.join(hit, (F.col("sop_id") == F.col("s")) & (F.col("node_id") == F.col("hit")), "left_anti").withColumn("q", F.when(F.col("tag") != "", F.col("tag")).otherwise(F.col("label")))
    if fuzzy:
        similar = best_similar(left, wanted.select(F.col("s").alias("sop_id"), F.col("w").alias("name"), F.lit(1).alias("is_tag")))
        left = left.join(similar.select("sop_id", "q"), ["sop_id", "q"], "left_anti")
    return left.select(*_row("extra_component", "INFO", F.lit(None).cast("long"), 2, F.col("ord"), F.lit(None).cast("string"), F.col("q")))


def discrepancies(made: DataFrame, plant: DataFrame, fuzzy: bool = True) -> DataFrame:
    """All rules' rows, numbered per procedure: by step its tags, then its valves; at the end what is extra."""
    found = [unmatched(made, plant, fuzzy), type_mismatches(made, plant), valve_conflicts(made, plant), extra_components(made, plant, fuzzy)]
    rows = found[0]
    for x in found[1:]:
        rows = rows.unionByName(x)
    order = Window.partitionBy("sop_id").orderBy(F.col("step_no").asc_nulls_last(), "phase", "pos", "disc_type", "sop_tag", "graph_tag")
    number = F.row_number().over(order)
    return rows.select(
        "sop_id", F.format_string("DISC-%03d", number).alias("disc_id"), "severity", "disc_type",
        F.when(F.col("step_no").isNotNull(), F.format_string("step_%04d", "step_no")).alias("sop_reference"), "sop_tag", "graph_tag",
    )


def summary(made: DataFrame, plant: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Per procedure: distinct tags, matched ones, occurrences without a node, coverage, and rows by severity."""
    tags_of = tagged(made, plant).withColumn("ok", F.col("node_id").isNotNull())
    if fuzzy:
        similar = best_similar(tags_of.where(~F.col("ok")).select("sop_id", F.upper("tag").alias("q")), names(plant)).select(F.col("sop_id").alias("s"), "q")
        tags_of = tags_of.join(similar, (F.col("sop_id") == F.col("s")) & (F.upper("tag") == F.col("q")), "left").withColumn("ok", F.col("ok") | F.col("q").isNotNull())
    counts = tags_of.groupBy("sop_id").agg(
        F.count_distinct(F.upper("tag")).alias("total_tags"),
        F.count_distinct(F.when(F.col("ok"), F.upper("tag"))).alias("matched_tags"),
        F.count_if(~F.col("ok")).alias("missing_tags"),
    )
    d = discrepancies(made, plant, fuzzy).groupBy(F.col("sop_id").alias("s")).agg(*(F.count_if(F.col("severity") == x).alias(f"n_{x.lower()}") for x in SEVERITY_RANK))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return counts.join(d, F.col("sop_id") == F.col("s"), "left").select(
        "sop_id", "total_tags", "matched_tags", "missing_tags",
        F.round(F.col("matched_tags") * 100 / F.greatest("total_tags", F.lit(1)), 1).alias("coverage_pct"),
        *(zero(f"n_{x.lower()}") for x in SEVERITY_RANK),
    )


def top_discrepancies(found: DataFrame, k: int = 5) -> DataFrame:
    """The k worst rows of each procedure."""
    w = Window.partitionBy("sop_id").orderBy(lookup(SEVERITY_RANK, F.col("severity")), "disc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def has_critical(found: DataFrame) -> DataFrame:
    """(sop_id, exit_code): 1 if any row is critical."""
    return found.groupBy("sop_id").agg(F.max(F.when(F.col("severity") == "CRITICAL", 1).otherwise(0)).alias("exit_code"))
