"""Mixing sources to target weights by Pareto order sampling.

Each source has a share of the mix: shares go by weight, no source's target passes
``most`` times its own size, and what is cut off there is shared anew by weight. A source
whose target is r times its size gives each document floor(r) certain whole copies. The rest
of the target is drawn without replacement: every document has an inclusion probability, the
same within a source and different between sources, and a random number u from a hash of its
key; documents come in ascending order of the Pareto ranking odds(u) / odds(inclusion), and
those whose running size stays within the rest of the target are taken once more. Of the
others, the one whose size comes nearest to what is then left closes the gap.
The order is deterministic, so reruns agree.

Scale: sizes are summed per source before any shuffle of rows. The running size is found in
two levels, so that no task ever holds a source's documents: first over ``cells`` ranges of
u per source (counts and sums only), then among the documents of the one range in which the
target is reached.

Nulls: a null text has size 0; a null source is a source of its own, the last in order; a
null key has the random number of an empty key. Documents of size 0 are never taken. Repeated
keys get the same random number and are ordered by size, then by a hash of the text. An empty table gives an
empty result; if all sizes are 0, all targets are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

#: Random numbers are multiples of 2**-52.
_DIGITS = 13
_RANGE = 1 << 52


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """From (source, source_size): weight, target. One row per source; sorted by one task, as sources are few.

    Sources are capped in ascending order of size by weight for as long as the share that is left
    by weight passes the cap.
    """
    everything = Window.partitionBy()
    before = Window.partitionBy().orderBy(F.col("by_weight"), F.col("place")).rowsBetween(Window.unboundedPreceding, -1)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*(F.lit(x).cast("long") for x in weights))
    ranked = (
        sizes.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("weight", F.get(w, (F.col("place") % len(weights)).cast("int")))
        .withColumn("by_weight", F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("left_size", F.col("total") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("capped", F.col("left_size") * F.col("weight") >= most * F.col("source_size") * F.col("left_weight"))
    )
    # The first that isn't capped, and all after it, share what is left there.
    first = F.min(F.when(~F.col("capped"), F.struct("by_weight", "place", "left_size", "left_weight"))).over(everything)
    return ranked.withColumn("first", first).select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("first").isNull() | (F.struct("by_weight", "place") < F.struct("first.by_weight", "first.place")), (most * F.col("source_size")).cast("double"))
        .otherwise(F.col("first.left_size") * F.col("weight") / F.col("first.left_weight"))
        .alias("target"),
    )


def mix(
    documents: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    most: int = 3,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: str = "mix",
    cells: int = 4096,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per row: key, source, size, source_size, target, copies, and taken = copies * size; then the columns of ``carry``."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")), 1, _DIGITS)
    rows = documents.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.conv(digits, 16, 10).cast("long").alias("u"),
        F.xxhash64(F.col(text)).alias("tie"),
        F.monotonically_increasing_id().alias("id"),
        *(F.col(c).alias(f"carried{k}") for k, c in enumerate(carry)),
    )
    # The texts are read once; what follows reads a few numbers per document.
    rows = written(rows, "mix")

    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = targets.withColumn("inclusion", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(F.lit(0.0)))

    # A row per source, as a table: it is read at several places of the plan.
    targets = written(targets, "mix-targets")

    same = lambda other: F.col("source").eqNullSafe(other["s"])
    t = targets.withColumnRenamed("source", "s")
    u = (F.col("u") + F.lit(0.5)) / F.lit(float(_RANGE))
    rank = (u / (1 - u)) / (F.col("inclusion") / (1 - F.col("inclusion")))
    ranked = rows.join(t, same(t)).drop("s").withColumn("rank", F.when(F.col("inclusion") > 0, rank))
    ranked = ranked.withColumn("cell", F.floor(F.col("rank") / (1 + F.col("rank")) * cells).cast("int"))

    by_cell = ranked.where("cell is not null").groupBy("source", "cell", "rest").agg(F.sum("size").alias("cell_size"))
    so_far = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    reached = (
        by_cell.withColumn("until", F.sum("cell_size").over(so_far))
        .where(F.col("until") > F.col("rest"))
        .groupBy("source")
        .agg(F.min(F.struct("cell", (F.col("until") - F.col("cell_size")).alias("below"))).alias("edge"))
        .select(F.col("source").alias("s"), F.col("edge.cell").alias("edge"), F.col("edge.below").alias("below"))
    )
    reached = written(reached, "mix-edges")
    placed = ranked.join(reached, same(reached), "left").drop("s")
    within = F.coalesce(F.col("cell") == F.col("edge"), F.lit(False))
    inner = placed.where(~within)
    inner = inner.withColumn("more", F.when(F.col("cell").isNotNull() & F.coalesce(F.col("cell") < F.col("edge"), F.lit(True)), 1).otherwise(0))
    along = Window.partitionBy("source").orderBy("rank", "size", "tie", "id").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where(within).withColumn("until", F.col("below") + F.sum("size").over(along))
    gaps = edge.groupBy("source").agg((F.first("rest") - F.max(F.when(F.col("until") <= F.col("rest"), F.col("until")).otherwise(F.col("below")))).alias("gap"))
    edge = edge.withColumn("more", F.when(F.col("until") <= F.col("rest"), 1).otherwise(0)).drop("until")
    both = inner.unionByName(edge)
    # One more document per source closes what is left of the target, if that comes nearer to it.
    g = gaps.withColumnRenamed("source", "s")
    off = F.abs(F.col("size") - F.col("gap"))
    closing = (
        both.where("more = 0 and size > 0 and cell is not null").join(g, same(g)).where(off < F.col("gap"))
        .groupBy("s").agg(F.min(F.struct(off.alias("off"), "rank", "size", "tie", "id")).alias("c")).select(F.col("c.id").alias("closes"))
    )
    both = both.join(closing, F.col("id") == F.col("closes"), "left")
    both = both.withColumn("more", F.when(F.col("closes").isNotNull(), 1).otherwise(F.col("more")))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(0)
    return both.select(
        F.col("key").alias(key),
        F.col("source").alias(source),
        "size",
        "source_size",
        "target",
        copies.cast("long").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
        *(F.col(f"carried{k}").alias(c) for k, c in enumerate(carry)),
    )
