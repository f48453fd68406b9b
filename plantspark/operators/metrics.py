"""Detection quality: matching predictions to ground truth, confusion counts, average precision, dataset statistics.

Predictions are (pid_id, node_id, symbol_class, x1, y1, x2, y2, confidence), ground truth the same with gt_id.
Matching joins on drawing and class; its windows hold one prediction's or one label's candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

#: IoU thresholds in percent.
THRESHOLDS = tuple(range(50, 100, 5))


def _candidates(pred: DataFrame, truth: DataFrame, same_class: bool) -> DataFrame:
    a, b = pred.alias("a"), truth.alias("b")
    on = F.col("a.pid_id") == F.col("b.pid_id")
    if same_class:
        on = on & (F.col("a.symbol_class") == F.col("b.symbol_class"))
    p, q = g.Box.of(alias="a"), g.Box.of(alias="b")
    return a.join(b, on).select(
        F.col("a.pid_id").alias("pid_id"), "a.node_id", "b.gt_id", F.col("a.symbol_class").alias("pred_class"), F.col("b.symbol_class").alias("gt_class"),
        g.intersection(p, q).alias("inter"), g.union_area(p, q).alias("uni"),
    ).where("inter > 0")


def match(pred: DataFrame, truth: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """(percent, pid_id, node_id, gt_id): true positives at each IoU threshold.

    A prediction keeps its best label, then a label keeps the first prediction in detection order (node_id).
    """
    c = _candidates(pred, truth, True).withColumn("percent", F.explode(F.array(*map(F.lit, thresholds)))).where("inter * 100 >= uni * percent")
    c = c.withColumn("iou", F.round(F.col("inter") / F.col("uni"), 9))
    best = Window.partitionBy("percent", "pid_id", "node_id").orderBy(F.desc("iou"), "gt_id")
    first = Window.partitionBy("percent", "pid_id", "gt_id").orderBy("node_id")
    c = c.withColumn("k", F.row_number().over(best)).where("k = 1").withColumn("k", F.row_number().over(first)).where("k = 1")
    return c.select("percent", "pid_id", "node_id", "gt_id")


def match_confusion(pred: DataFrame, truth: DataFrame, percent: int = 45) -> DataFrame:
    """(pid_id, node_id, gt_id, pred_class, gt_class): matches of any class above the threshold; a label keeps its best prediction."""
    c = _candidates(pred, truth, False).where(F.col("inter") * 100 > F.col("uni") * percent).withColumn("iou", F.round(F.col("inter") / F.col("uni"), 9))
    by_det = Window.partitionBy("pid_id", "node_id").orderBy(F.desc("iou"), "gt_id")
    by_gt = Window.partitionBy("pid_id", "gt_id").orderBy(F.desc("iou"), "node_id")
    c = c.withColumn("k", F.row_number().over(by_det)).where("k = 1").withColumn("k", F.row_number().over(by_gt)).where("k = 1")
    return c.select("pid_id", "node_id", "gt_id", "pred_class", "gt_class")


def confusion(pred: DataFrame, truth: DataFrame, percent: int = 45) -> DataFrame:
    """(pred_class, gt_class, n) with 'background' for what is unmatched.

    Unmatched predictions count only in drawings with a match.
    """
    m = match_confusion(pred, truth, percent)
    hit_p, hit_g = m.select(F.col("node_id").alias("h")), m.select(F.col("gt_id").alias("h"))
    drawings = m.select(F.col("pid_id").alias("d")).distinct()
    missed = truth.join(hit_g, F.col("gt_id") == F.col("h"), "left_anti").select(F.lit("background").alias("pred_class"), F.col("symbol_class").alias("gt_class"))
    false = pred.join(hit_p, F.col("node_id") == F.col("h"), "left_anti").join(drawings, F.col("pid_id") == F.col("d"), "left_semi")
    false = false.select(F.col("symbol_class").alias("pred_class"), F.lit("background").alias("gt_class"))
    rows = m.select("pred_class", "gt_class").unionByName(missed).unionByName(false)
    return rows.groupBy("pred_class", "gt_class").agg(F.count("*").alias("n"))


def normalised(counts: DataFrame) -> DataFrame:
    """Confusion counts as shares of their true class."""
    return counts.select("pred_class", "gt_class", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("gt_class")), 6).alias("share"))


def true_false(counts: DataFrame) -> DataFrame:
    """(symbol_class, tp, fp) from confusion counts."""
    c = counts.where("pred_class <> 'background'")
    tp = F.sum(F.when(F.col("pred_class") == F.col("gt_class"), F.col("n")).otherwise(0))
    return c.groupBy(F.col("pred_class").alias("symbol_class")).agg(tp.alias("tp"), (F.sum("n") - tp).alias("fp"))


def ranked(pred: DataFrame, truth: DataFrame, percent: int = 50) -> DataFrame:
    """Predictions by class and descending confidence with running tp and fp, and the class's labels."""
    m = match(pred, truth, (percent,)).select(F.col("node_id").alias("m"))
    n = truth.groupBy(F.col("symbol_class").alias("c")).agg(F.count("*").alias("n_labels"))
    rows = pred.join(m, F.col("node_id") == F.col("m"), "left").withColumn("hit", F.col("m").isNotNull().cast("long"))
    along = Window.partitionBy("symbol_class").orderBy(F.desc("confidence"), "node_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("tp", F.sum("hit").over(along)).withColumn("fp", F.count("*").over(along) - F.col("tp"))
    return rows.join(n, F.col("symbol_class") == F.col("c")).select("symbol_class", "node_id", "confidence", "tp", "fp", "n_labels")


def average_precision(rows: DataFrame, points: int = 101) -> DataFrame:
    """(symbol_class, ap): the precision envelope at ``points`` recalls, by the trapezoid rule.

    Precision goes to 0 at recall 1 beyond the last prediction and from 1 at recall 0.
    """
    r = rows.select("symbol_class", (F.col("tp") / (F.col("n_labels") + F.lit(1e-16))).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") + F.col("fp")).alias("rank"))
    ends = r.select("symbol_class").distinct()
    r = r.unionByName(ends.select("symbol_class", F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"), F.lit(0).cast("long").alias("rank")))
    r = r.unionByName(ends.select("symbol_class", F.lit(1.0).alias("recall"), F.lit(0.0).alias("precision"), F.lit((1 << 62)).alias("rank")))
    back = Window.partitionBy("symbol_class").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    env = r.withColumn("env", F.max("precision").over(back))
    after = Window.partitionBy("symbol_class").orderBy("rank")
    env = env.withColumn("r2", F.lead("recall").over(after)).withColumn("e2", F.lead("env").over(after))
    # Each recall point lies in the last segment that starts at or before it.
    step = points - 1
    spans = env.where("r2 is not null").withColumn("k1", F.ceil(F.col("recall") * step)).withColumn("k2", F.floor(F.col("r2") * step))
    at = spans.where("k1 <= k2").withColumn("k", F.explode(F.sequence("k1", "k2")))
    x = F.col("k") / F.lit(float(step))
    y = F.when(F.col("r2") > F.col("recall"), F.col("env") + (F.col("e2") - F.col("env")) * (x - F.col("recall")) / (F.col("r2") - F.col("recall"))).otherwise(F.col("env"))
    # At recall 1 the closing point counts.
    y = F.when(F.col("k") == step, 0.0).otherwise(y)
    value = at.withColumn("y", y).groupBy("symbol_class", "k").agg(F.max_by("y", F.struct("rank")).alias("y"))
    w = F.when((F.col("k") == 0) | (F.col("k") == step), 0.5).otherwise(1.0)
    return value.groupBy("symbol_class").agg(F.round(F.sum(F.col("y") * w) / step, 6).alias("ap"))


def class_weights(boxes: DataFrame) -> DataFrame:
    """Inverse frequencies that sum to 1."""
    n = boxes.groupBy("symbol_class").agg(F.count("*").alias("n")).withColumn("inv", 1 / F.greatest(F.col("n"), F.lit(1)))
    total = n.agg(F.sum("inv").alias("s"))
    return n.join(F.broadcast(total)).select("symbol_class", F.round(F.col("inv") / F.col("s"), 6).alias("weight"))


def image_weights(boxes: DataFrame) -> DataFrame:
    """Per drawing the sum of its boxes' class weights."""
    w = class_weights(boxes).withColumnRenamed("symbol_class", "c")
    return boxes.join(w, F.col("symbol_class") == F.col("c")).groupBy("pid_id").agg(F.round(F.sum("weight"), 6).alias("weight"))


def dataset_stats(boxes: DataFrame) -> DataFrame:
    """Instances and drawings by class, with totals in the row of class null."""
    return boxes.rollup("symbol_class").agg(F.count("*").alias("instances"), F.count_distinct("pid_id").alias("drawings"))


def legal_labels(rows: DataFrame, size: int = 2000) -> DataFrame:
    """(node_id, reason): normalised boxes that aren't legal, with why; legal ones have no row."""
    b = g.normalised_xywh(g.Box.of(), size, size)
    reason = (
        F.when(F.greatest(*b.values()) > 1, "beyond the image").when(F.least(*b.values()) < 0, "negative").when((F.col("x2") - F.col("x1") < 62), "narrow")
    )
    return rows.select("node_id", reason.alias("reason")).where("reason is not null")


def histogram(boxes: DataFrame, bins: int = 20, high: int = 100) -> DataFrame:
    """(bx, by, n): sizes by width and height."""
    k = lambda c: F.least(F.floor(c * bins / high), F.lit(bins - 1)).cast("long")
    b = g.Box.of()
    return boxes.groupBy(k(b.width).alias("bx"), k(b.height).alias("by")).agg(F.count("*").alias("n"))


def anchor_fit(boxes: DataFrame, anchors: tuple[tuple[int, int], ...], ratio: float = 4.0) -> DataFrame:
    """One row: share of boxes with a fitting anchor, and anchors above the threshold per box."""
    b = g.Box.of()
    fit = lambda w, h: F.least(F.least(b.width / w, F.lit(w) / b.width), F.least(b.height / h, F.lit(h) / b.height))
    fits = F.array(*(fit(float(w), float(h)) for w, h in anchors))
    rows = boxes.select(F.array_max(fits).alias("best"), F.size(F.filter(fits, lambda x: x > 1 / ratio)).alias("n"))
    return rows.agg(F.round(F.avg((F.col("best") > 1 / ratio).cast("double")), 6).alias("bpr"), F.round(F.avg("n"), 6).alias("aat"))


def fitness(p: str, r: str, map50: str, map_all: str):
    """The weighted score of a run's precision, recall and two mean precisions."""
    return F.col(p) * 0.0 + F.col(r) * 0.0 + F.col(map50) * 0.1 + F.col(map_all) * 0.9


def autosplit(keys: DataFrame, key: str, shares: tuple[int, int, int] = (90, 5, 5)) -> DataFrame:
    """A stable split by hash of the key: train, val or test."""
    h = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(100))
    return keys.select(key, F.when(h < shares[0], "train").when(h < shares[0] + shares[1], "val").otherwise("test").alias("split"))


def running_best(epochs: DataFrame, patience: int = 10) -> DataFrame:
    """(run, epoch, value) with the best value so far, epochs since it, and whether to stop."""
    along = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    rows = epochs.withColumn("best", F.max("value").over(along))
    rows = rows.withColumn("best_epoch", F.max(F.when(F.col("value") >= F.col("best"), F.col("epoch"))).over(along))
    return rows.select("run", "epoch", "best", (F.col("epoch") - F.col("best_epoch")).alias("since"), (F.col("epoch") - F.col("best_epoch") >= patience).alias("stop"))
