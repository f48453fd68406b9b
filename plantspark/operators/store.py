"""Queries over stored documents, procedures and validation runs.

Newest-per-key queries rank with a window per key, ties by the greater run_id; lists filter and
sort, so limits become a top-k per task. Null timestamps come last. Empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import ISSUE_TYPES, lookup


def list_documents(docs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest completed documents, by descending key; 1 to 200 of them."""
    return docs.where("status = 'completed'").orderBy(F.desc("pid_id")).limit(max(1, min(200, limit))).select("pid_id", "file_name", "status")


def by_batch(docs: DataFrame) -> DataFrame:
    """Completed pages numbered within their batch by page, pages without a number last."""
    w = Window.partitionBy("upload_batch_id").orderBy(F.col("page_num").asc_nulls_last(), "pid_id")
    return docs.where("status = 'completed'").select("upload_batch_id", "pid_id", "page_num", F.row_number().over(w).alias("place"))


def newest(runs: DataFrame, key: str) -> DataFrame:
    """The newest run of each key."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last("created_at"), F.desc("run_id"))
    return runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def documents_with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Each completed document with its newest run's status and issues, or 'graph_ready' and 0."""
    last = newest(runs, "pid_id").select(F.col("pid_id").alias("p"), F.col("status").alias("run_status"), "n_issues")
    d = docs.where("status = 'completed'").join(last, F.col("pid_id") == F.col("p"), "left")
    return d.select(
        "pid_id", F.coalesce("file_name", F.lit("P&ID")).alias("name"),
        F.coalesce("run_status", F.lit("graph_ready")).alias("status"), F.coalesce("n_issues", F.lit(0)).cast("long").alias("issue_count"),
    )


def runs_of_procedure(runs: DataFrame, docs: DataFrame) -> DataFrame:
    """Per procedure the newest run of each of its documents, the documents' names with them."""
    w = Window.partitionBy("sop_id", "pid_id").orderBy(F.desc_nulls_last("created_at"), F.desc("run_id"))
    d = docs.select(F.col("pid_id").alias("p"), "file_name")
    return runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").join(d, F.col("pid_id") == F.col("p")).select("sop_id", "pid_id", "run_id", "file_name")


def graph_guard(docs: DataFrame) -> DataFrame:
    """What a request for a document's graph would answer: 200, 404 or 409."""
    code = F.when(F.col("status").isNull(), 404).when(F.col("status") != "completed", 409).otherwise(200)
    return docs.select("pid_id", code.alias("code"))


def recent(docs: DataFrame, runs: DataFrame, limit: int = 100) -> DataFrame:
    """Documents and runs in one list, newest first; documents go by their newest run's time."""
    last = newest(runs, "pid_id").select(F.col("pid_id").alias("p"), "created_at")
    d = docs.join(last, F.col("pid_id") == F.col("p")).select(F.lit("pid").alias("kind"), F.col("pid_id").alias("id"), "created_at", "file_name")
    s = runs.select(F.lit("run").alias("kind"), F.col("run_id").alias("id"), "created_at")
    return d.unionByName(s, allowMissingColumns=True).orderBy(F.desc("created_at"), "kind", "id").limit(limit)


def issues_by_severity(runs: DataFrame) -> DataFrame:
    """Runs and issues by severity; no severity counts as an error."""
    return runs.groupBy(F.coalesce("severity", F.lit("error")).alias("severity")).agg(F.count("*").alias("runs"), F.sum("n_issues").alias("issues"))


def same_name(docs: DataFrame) -> DataFrame:
    """Display names: with the page number where several documents of a batch share a status."""
    n = F.count("*").over(Window.partitionBy("upload_batch_id", "status"))
    label = F.when((n > 1) & F.col("page_num").isNotNull(), F.concat("file_name", F.lit(" (page "), F.col("page_num").cast("string"), F.lit(")"))).otherwise(F.col("file_name"))
    return docs.select("pid_id", label.alias("label"), n.alias("n"))


def issue_type(raw: Column) -> Column:
    return F.coalesce(lookup(ISSUE_TYPES, raw), F.lit("attribute_mismatch"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins: rows of both tables, per key the one of greatest ``order``; new rows win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(order), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def pages_per_file(docs: DataFrame) -> DataFrame:
    """Pages of a batch; one for files without numbered pages."""
    return docs.groupBy("upload_batch_id").agg(F.greatest(F.count("page_num"), F.lit(1)).alias("pages"))
