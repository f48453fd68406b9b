"""Groups of near duplicates by exact likeness, with no pair lost.

A text is the set of its five-word shingles (A-Z lowered, words joined by single blanks, XXH64
with seed 42); fewer words are one shingle, no words none. Two texts are near duplicates if the
Jaccard similarity of their sets is at least 0.8, and groups are the components of these pairs.

SimHash can't find these pairs: at 0.8 fingerprints of 64 bits differ by 2 to 18 bits, which no
covering code reaches. Instead all sets are put in one order of shingles. Two sets of n and m
shingles that are that alike share one of the first n - ceil(0.8 n) + 1 of the one and of the
first m - ceil(0.8 m) + 1 of the other (prefix filter), whatever the order is. Rare shingles
come first, by counts over all texts in ``CELLS`` cells that shingles share by hash; the order
changes the time, never the pairs.

Equal sets are one before anything else. Then, in rounds, one set of each group is compared with
one of another group, chosen by the shingles that they share, until a round joins no groups: this
takes few comparisons for large groups. What is then still in different groups is compared pair
by pair. A shingle shared by many groups that aren't alike costs the square of their number.

Repeated rows are one row. A null key is the last of its group. Texts without words are one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_arrow, written
from .simhash import _FOLD, SEED, components

SHINGLE = 5
#: Cells of shingle counts (4 bytes each are broadcast), of hashes of wanted rows (a bit each), and how many counts or bytes a row of them has.
CELLS, WANTED_CELLS, BLOCK = 1 << 20, 1 << 25, 1 << 16
#: Most rounds of joining groups. The comparison of pairs that follows is exact after any number of rounds.
ROUNDS = 4
#: A round that joins fewer groups than this share of the places of shingles is the last.
LEAST_GAIN = 0.001
#: Least number of shared shingles that a round takes for a likely pair, as a share of both sizes; other pairs wait for the comparison of pairs.
LEAST_SHARE = 0.02
#: Pairs of two groups that are compared before all the others.
LIKELIEST = 64


def shingles(text: str | None) -> np.ndarray:
    """The set of a text's shingles as sorted hashes."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not tokens:
        return np.array([], np.int64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    ends = ends[min(SHINGLE, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    found = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(ends))
    return np.unique(found.view(np.int64))


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) for x in values]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.array([], np.int64), pa.int64()))


def _id(own: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64))


def _counts(rows: DataFrame, cells: int, numbers: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """How many of the numbers of a column's values are in each cell: each task counts, then blocks of cells are summed."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(cells, np.int64)
        for batch in batches:
            own += np.bincount(numbers(batch.column(0)) & cells - 1, minlength=cells)
        yield from _blocks({k: own[at : at + BLOCK] for k, at in enumerate(range(0, cells, BLOCK))})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1)):
                own[k] = own.get(k, 0) + np.frombuffer(n.as_py(), "<i4").astype(np.int64)
        yield from _blocks(own)

    ddl = "block int, n binary"
    blocks = map_arrow(map_arrow(rows, counted, ddl).repartition("block"), summed, ddl).collect()
    counts = np.zeros(cells, np.int32)
    for r in blocks:
        counts[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["n"], "<i4")
    return counts


def _bits(rows: DataFrame, cells: int) -> np.ndarray:
    """A bit per cell, eight in a byte, that is set if a hash of the first column is in the cell."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(cells // 8, np.uint8)
        for batch in batches:
            at = _of_hashes(batch.column(0)) & cells - 1
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield from packed({k: own[at : at + BLOCK] for k, at in enumerate(range(0, len(own), BLOCK))})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, bits in zip(batch.column(0).to_pylist(), batch.column(1)):
                own[k] = own.get(k, 0) | np.frombuffer(bits.as_py(), np.uint8)
        yield from packed(own)

    def packed(blocks: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, bits in blocks.items():
            if bits.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["block", "bits"])

    ddl = "block int, bits binary"
    out = np.zeros(cells // 8, np.uint8)
    for r in map_arrow(map_arrow(rows, marked, ddl).repartition("block"), merged, ddl).collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["bits"], np.uint8)
    return out


def _of_texts(column: pa.Array) -> np.ndarray:
    return np.concatenate([shingles(x.as_py()) for x in column]) if len(column) else np.zeros(0, np.int64)


def _of_hashes(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _blocks(counts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each block that isn't all zero."""
    for k, n in counts.items():
        if not n.any():
            continue
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n.clip(max=(1 << 31) - 1).astype("<i4").tobytes()], pa.binary())], names=["block", "n"])


def prefix(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order, as many as its prefix has."""
    return own[np.lexsort((own, counts[own & len(counts) - 1]))][: len(own) - (4 * len(own) + 4) // 5 + 1]


def _likely(shared: DataFrame) -> DataFrame:
    """(a, b, ra, rb, likely) of rows (a, na, ra, b, nb, rb), one per shingle of both prefixes, whose numbers allow a similarity of 0.8.

    Sizes must be in proportion. And where the prefix that ends first in the order has p of its set's n shingles, all
    it shares is in the other prefix too; the set lacks at most n less the shared shingles needed, (4 na + 4 nb) / 9.
    """
    sized = shared.where("a <> b and 5 * least(na, nb) >= 4 * greatest(na, nb)")
    counted = sized.groupBy("a", "b").agg(F.count("*").alias("o"), *(F.first(x).alias(x) for x in ("na", "nb", "ra", "rb")))
    counted = counted.where("9 * (o - 1 + (4 * greatest(na, nb) + 4) div 5) >= 4 * (na + nb)")
    return counted.select("a", "b", "ra", "rb", (F.col("o") / (F.col("na") + F.col("nb"))).alias("likely"))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of exact similarity 0.8 or more; texts, which take less room than their sets, are (sid, text)."""
    left, right = texts.select(F.col("sid").alias("a"), F.col("text").alias("x")), texts.select(F.col("sid").alias("b"), F.col("text").alias("y"))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come in the order of b: its set is made once for all its pairs.
        at, other = None, None
        for batch in batches:
            same = []
            for x, b, y in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                own = shingles(x.as_py())
                if b != at:
                    at, other = b, shingles(y.as_py())
                shared = len(np.intersect1d(own, other, assume_unique=True))
                same.append(9 * shared >= 4 * (len(own) + len(other)))
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    both = pairs.hint("merge").join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return map_arrow(both.select("a", "x", "b", "y"), alike, "a long, b long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (sid, n, token) in the order of token and sid, once each, those whose token another sid has too."""
    held, joined = np.zeros((0, 3), np.int64), False
    for batch in batches:
        now = np.concatenate([held, np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)])
        if not len(now):
            continue
        now = now[np.concatenate([[True], (now[1:, [0, 2]] != now[:-1, [0, 2]]).any(axis=1)])]
        same = now[1:, 2] == now[:-1, 2]
        shares = np.concatenate([[joined], same]) | np.concatenate([same, [False]])
        yield _places(now[:-1][shares[:-1]])
        held, joined = now[-1:], bool(shares[-1])
    if joined:
        yield _places(held)


def _places(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=["sid", "n", "token"])


def first_rows(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(h1, h2): hashes (see ``row_hashes``) of the row of least key of each group."""
    spark = documents.sparkSession
    h1, h2 = row_hashes(documents)
    rows = documents.select(F.col(key).alias("key"), h1.alias("h1"), h2.alias("h2"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(_counts(rows.select("text"), CELLS, _of_texts))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task gives the prefix of a set once, so copies cost a row of a task.
        counts, met = sent.value, set()
        for batch in batches:
            ids, sizes, prefixes = [], [], []
            for x in batch.column(3):
                own = shingles(x.as_py())
                ids.append(_id(own))
                sizes.append(len(own))
                prefixes.append(own[:0] if ids[-1] in met else prefix(own, counts))
                met.add(ids[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), _lists(prefixes)], names=["key", "h1", "h2", "sid", "n", "prefix"]
            )

    prints = written(map_arrow(rows, printed, f"key {kind}, h1 long, h2 long, sid long, n long, prefix array<long>"), "near")
    sent.destroy()
    order = F.struct(F.col("key").isNull().alias("none"), "key", "h1", "h2")
    each = prints.groupBy("sid").agg(F.min(order).alias("least"))
    # Places are dealt by shingle once; those that are shared are found in the order of shingles.
    places = prints.select("sid", "n", F.explode("prefix").alias("token")).repartition("token").sortWithinPartitions("token", "sid")
    places = written(map_arrow(places, _shared, "sid long, n long, token long"), "near-places")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs of exact similarity 0.8 or more. Their texts come from a second scan, which passes over most others by a bit map."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = written(each.join(ids.hint("merge"), F.col("sid") == F.col("id"), "left_semi").select(F.col("least.h1").alias("w1"), F.col("least.h2").alias("w2"), F.col("sid").alias("wsid")), "near-wanted")
        there = spark.sparkContext.broadcast(_bits(wanted.select("w1"), WANTED_CELLS))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met = set()
            for batch in batches:
                at = _of_hashes(batch.column(0)) & WANTED_CELLS - 1
                batch = batch.filter(pa.array((there.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
                # Equal rows of a task are one.
                hashes = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                new = [not (x in met or met.add(x)) for x in hashes]
                batch = batch.filter(pa.array(new, pa.bool_()))
                ids = [_id(shingles(x.as_py())) for x in batch.column(2)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(2)], names=["sid", "text"])

        chosen = map_arrow(rows.select("h1", "h2", "text"), whole, "sid long, text string")
        texts = chosen.groupBy("sid").agg(F.first("text").alias("text"))
        found = written(_confirmed(pairs, texts), "near-links")
        there.destroy()
        discard(wanted)
        return found

    links = tested = spark.createDataFrame([], "a long, b long")
    rooted = places.withColumn("root", F.col("sid"))
    for k in range(ROUNDS):
        # Of all sets with a shingle one is drawn, by a hash that is another in each round. So sets that share many shingles
        # meet the same set by most of them. Groups meet by the pair of them that shares most for its size.
        # One exchange serves both sides, as both have the same filter.
        dealt = rooted.dropna().repartition("token")
        drawn = dealt.groupBy(F.col("token").alias("t")).agg(
            F.min(F.struct(F.xxhash64("sid", F.lit(k)).alias("draw"), "n", "sid", "root")).alias("m"), F.min("root").alias("r1"), F.max("root").alias("r2")
        )
        met = dealt.join(drawn.where("r1 <> r2").hint("merge"), F.col("token") == F.col("t")).where("root <> m.root and 5 * least(n, m.n) >= 4 * greatest(n, m.n)")
        shared = met.groupBy("root", F.col("m.root").alias("other"), F.col("sid").alias("a"), F.col("m.sid").alias("b")).agg((F.count("*") / F.first(F.col("n") + F.col("m.n"))).alias("o"))
        best = shared.where(F.col("o") >= LEAST_SHARE).groupBy("root", *["other"] * (k > 0)).agg(F.max(F.struct("o", "a", "b")).alias("p")).select("p.a", "p.b")
        # Those with most pairs are b: its text isn't carried along.
        best = written(best, "near-pairs")
        new = linked(best)
        links, tested = links.unionByName(new), tested.unionByName(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        roots = components(links).select(F.col("node").alias("member"), F.col("root").alias("to"))
        joined = places.join(roots.hint("merge"), F.col("sid") == F.col("member"), "left")
        before, rooted = rooted, written(joined.select("sid", "n", "token", F.coalesce("to", "sid").alias("root")), "near-rooted")
        if k:
            discard(before)
        if new.count() < LEAST_GAIN * places.count():
            break
    dealt = rooted.dropna().repartition("token")
    one = dealt.select("token", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    two = dealt.select("token", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    likely = _likely(one.join(two.hint("merge"), "token").where("a < b and ra <> rb"))
    pairs = written(likely.join(tested.distinct().hint("merge"), ["a", "b"], "left_anti"), "near-likely")
    discard(rooted, places)
    # Of each two groups the likeliest pairs first; then all pairs of those that these haven't joined.
    pairs = pairs.select("a", "b", "likely", F.least("ra", "rb").alias("low"), F.greatest("ra", "rb").alias("high"))
    place = F.row_number().over(Window.partitionBy("low", "high").orderBy(F.desc("likely"), "a", "b"))
    met = written(pairs.withColumn("place", place).where(F.col("place") <= LIKELIEST), "near-met")
    new = linked(met.select("a", "b"))
    known = met.join(new.withColumnsRenamed({"a": "x", "b": "y"}).hint("merge"), (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_semi")
    now = components(known.select(F.col("low").alias("a"), F.col("high").alias("b"))).select(F.col("node").alias("member"), F.col("root").alias("to")).hint("merge")
    high = now.toDF("member2", "to2")
    still = met.select("low", "high").distinct().join(now, F.col("low") == F.col("member"), "left").join(high.hint("merge"), F.col("high") == F.col("member2"), "left")
    still = still.where(F.coalesce("to", "low") != F.coalesce("to2", "high")).select("low", "high").hint("merge")
    rest = pairs.join(still, ["low", "high"], "left_semi").join(met.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
    links = links.unionByName(new).unionByName(linked(rest.select("a", "b")))

    found = components(links).select(F.col("node").alias("sid"), "root")
    grouped = each.join(found.hint("merge"), "sid", "left").groupBy(F.coalesce("root", "sid").alias("group")).agg(F.min("least").alias("least"))
    return grouped.select("least.h1", "least.h2")


def row_hashes(documents: DataFrame) -> tuple:
    """Two hashes over all columns: equal rows have equal ones."""
    return tuple(F.xxhash64(F.lit(k), *(F.col(f"`{c}`") for c in documents.columns)) for k in (1, 2))
