"""Writers. All go through Spark's committers, so a retried task leaves no second copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import exports
from ..operators.store import upsert


def append_rows(rows: DataFrame, path: str) -> None:
    """Documents, procedures or runs as Parquet; new columns are merged by readers with mergeSchema."""
    rows.write.mode("append").parquet(path)


def upsert_rows(rows: DataFrame, path: str, key: str, order: str) -> str:
    """Writes the last version of each key to a new folder beside the old one and returns its path."""
    spark = rows.sparkSession
    merged = upsert(spark.read.parquet(path), rows, key, order)
    new = f"{path.rstrip('/')}.next"
    merged.write.mode("overwrite").parquet(new)
    return new


def predictions_csv(boxes: DataFrame, path: str) -> None:
    """Image, class and confidence with two decimals."""
    boxes.select(F.col("pid_id").alias("Image Name"), F.col("symbol_class").alias("Prediction"), F.format_string("%.2f", "confidence").alias("Confidence")).write.mode("append").option("header", "true").csv(path)


def predictions_text(boxes: DataFrame, path: str, size: int = 2000) -> None:
    exports.prediction_lines(boxes, size).select("line").write.mode("append").text(path)


def coco_json(boxes: DataFrame, path: str) -> None:
    exports.coco_rows(boxes).select("json").write.mode("append").text(path)


def graph_json(nodes: DataFrame, edges: DataFrame, by, path: str) -> None:
    exports.graph_json(nodes, edges, by).select("graph").write.mode("append").text(path)


def metrics_csv(epochs: DataFrame, path: str) -> None:
    epochs.write.mode("append").option("header", "true").csv(path)


def html_report(summary: dict, nodes: DataFrame, discrepancies: DataFrame, most_nodes: int = 200, most_classes: int = 15) -> str:
    """A page with counts, the most frequent classes, the first nodes and all kinds of discrepancies. The limits are the report's."""
    from html import escape

    def rows(df: DataFrame) -> str:
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape(str('' if v is None else v))}</td>" for v in r) + "</tr>" for r in df.collect())
        return f"<table><tr>{head}</tr>{body}</table>"

    classes = nodes.groupBy("symbol_class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol_class").limit(most_classes)
    kinds = discrepancies.groupBy("severity", "disc_type").agg(F.count("*").alias("n")).orderBy("severity", "disc_type")
    first = nodes.orderBy("node_id").limit(most_nodes)
    cards = "".join(f"<p>{escape(str(k))}: {escape(str(v))}</p>" for k, v in summary.items())
    return f"<html><body>{cards}<h2>Classes</h2>{rows(classes)}<h2>Discrepancies</h2>{rows(kinds)}<h2>Nodes</h2>{rows(first)}</body></html>"


def json_report(parts: dict[str, DataFrame]) -> DataFrame:
    """One row: each table as an array in one JSON object. For reports, whose tables are aggregates."""
    spark = next(iter(parts.values())).sparkSession
    out = spark.range(1)
    for name, df in parts.items():
        own = df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
        out = out.join(own, F.lit(True))
    return out.select(F.to_json(F.struct(*parts)).alias("report"))
