"""Procedure texts: sections, steps, tags, valve states and parameters.

A line is (sop_id, line_no, text), ordered by line_no within a procedure. Blank lines are dropped.
A heading opens a section; sections without a body go, and lines before the first heading are
a section without one. Null texts count as blank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags as t


def marked_lines(lines: DataFrame) -> DataFrame:
    """Trimmed lines that aren't blank, with ``style``: 'Heading 1' for capitals."""
    rows = lines.withColumn("text", F.trim("text")).where(F.length("text") > 0)
    return rows.withColumn("style", F.when(t.is_upper(F.col("text")), "Heading 1").otherwise("Normal"))


def sections(lines: DataFrame) -> DataFrame:
    """(sop_id, step_no, heading, text): bodies joined by blanks, numbered from 0 per procedure."""
    rows = marked_lines(lines).withColumn("head", t.is_heading(F.col("text"), F.col("style")))
    along = Window.partitionBy("sop_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.sum(F.col("head").cast("int")).over(along))
    body = F.filter(F.sort_array(F.collect_list(F.struct("line_no", "head", "text"))), lambda x: ~x["head"])
    made = rows.groupBy("sop_id", "section").agg(
        F.coalesce(F.max(F.when(F.col("head"), F.col("text"))), F.lit("")).alias("heading"), F.transform(body, lambda x: x["text"]).alias("lines")
    )
    number = F.row_number().over(Window.partitionBy("sop_id").orderBy("section")) - 1
    return made.where(F.size("lines") > 0).select("sop_id", number.cast("long").alias("step_no"), "heading", F.array_join("lines", " ").alias("text"))


def steps(lines: DataFrame) -> DataFrame:
    """Sections with their tags (heading included), valve states in order of assignment, and parameters."""
    s = sections(lines)
    return s.select(
        "sop_id", "step_no", F.format_string("step_%04d", "step_no").alias("step_id"), "heading", "text",
        t.procedure_tags(F.concat_ws(" ", "heading", "text")).alias("required_tags"),
        t.valve_states(F.col("text")).alias("valve_states"),
        *(t.parameter(F.col("text"), name).alias(name) for name in t.PARAMETERS),
    )


def step_tags(made: DataFrame) -> DataFrame:
    """(sop_id, step_no, pos, tag)."""
    return made.select("sop_id", "step_no", F.posexplode("required_tags").alias("pos", "tag"))


def all_tags(made: DataFrame) -> DataFrame:
    """(sop_id, tag, first_step): distinct tags by first appearance."""
    return step_tags(made).groupBy("sop_id", "tag").agg(F.min("step_no").alias("first_step"))


def step_valves(made: DataFrame) -> DataFrame:
    """(sop_id, step_no, tag, state, pos): the last assignment of a step wins, at the place of the first."""
    rows = made.select("sop_id", "step_no", F.posexplode("valve_states").alias("pos", "v")).select("sop_id", "step_no", "pos", "v.tag", "v.state")
    return rows.groupBy("sop_id", "step_no", "tag").agg(F.max_by("state", "pos").alias("state"), F.min("pos").alias("pos"))


def final_valves(made: DataFrame) -> DataFrame:
    """(sop_id, tag, state): later steps override earlier ones."""
    return step_valves(made).groupBy("sop_id", "tag").agg(F.max_by("state", "step_no").alias("state"))
