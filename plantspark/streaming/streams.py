"""Streams over folders of Parquet files.

State is bounded where it can be: windows drop their state behind the watermark, frames keep one
row per source, runs one row per document. Rows with a null key or time are left out of state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def files(spark: SparkSession, folder: str, schema: StructType | str, per_batch: int = 8) -> DataFrame:
    """New files of a folder as a stream, a few per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def ingest(uploads: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """Uploads with a status: 'completed' for known suffixes, else 'failed' with the reason."""
    ok = F.lower(F.regexp_extract("file_name", "\\.([^.]+)$", 1)).isin(*suffixes)
    return uploads.withColumn("status", F.when(ok, "completed").otherwise("failed")).withColumn("error_message", F.when(~ok, F.concat(F.lit("unsupported file: "), F.col("file_name"))))


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows."""
    return _counted(_timed(events, late), F.window("ts", width))


def sliding_windows(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return _counted(_timed(events, late), F.window("ts", width, step))


def _counted(events: DataFrame, window) -> DataFrame:
    return events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): events of a user without a longer gap."""
    w = F.session_window("ts", gap)
    return _timed(events, late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def newest_runs(runs: DataFrame) -> DataFrame:
    """(pid_id, run_id, created_at): the newest run of each document; write in update or complete mode."""
    newest = F.max(F.struct("created_at", "run_id")).alias("m")
    return runs.where("pid_id is not null and created_at is not null").groupBy("pid_id").agg(newest).select("pid_id", "m.run_id", "m.created_at")


def distinct_uploads(uploads: DataFrame, late: str = "1 day") -> DataFrame:
    """Uploads without those whose id came before, within the watermark."""
    return uploads.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["pid_id"])


_LATEST = "source string, frame_no long, n_seen long"


def _keep_latest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    frame, seen = state.get if state.exists else (-1, 0)
    for pdf in batches:
        seen += len(pdf)
        frame = max(frame, int(pdf["frame_no"].max()))
    state.update((frame, seen))
    yield pd.DataFrame({"source": [key[0]], "frame_no": [frame], "n_seen": [seen]})


def latest_frames(frames: DataFrame, stride: int = 1) -> DataFrame:
    """(source, frame_no, n_seen): per source the latest of every ``stride``-th frame; write in update mode."""
    rows = frames.where((F.col("frame_no") % stride == 0) & F.col("source").isNotNull())
    return rows.groupBy("source").applyInPandasWithState(_keep_latest, _LATEST, "frame_no long, n_seen long", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there into a table in memory, and returns that table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
