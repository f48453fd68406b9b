"""SimHash fingerprints, and near-duplicate components by anchor points of a covering code.

Fingerprints: A-Z are lowered, shingles of three words (repeats included) are hashed with
XXH64 (seed 42), and a bit is 1 if it is set in more than half of the hashes. Fewer words are
one shingle; a text without words (null, empty, blanks) has fingerprint zero.

Links: two fingerprints at most three bits apart differ in at most one bit of their lowest 31
bits or of the next 31. On 31 bits the Hamming code of 2**26 words is a perfect covering code
of radius 1: every value is at most one bit from one code word, its home. If x and y differ in
one bit, y is at most two bits from x's home. So each fingerprint goes, for either half, to
every anchor (code word) within covering radius plus threshold of the half, 1 + 1 bits: one
or sixteen of them. Fingerprints are compared per anchor, those at home with all.

Equal fingerprints are one before anything is replicated, so groups of copies cost one row.
An anchor emits a spanning forest of its links, not all pairs. An anchor with more than
``block`` rows is cut in chunks by hash and each pair of chunks is compared by a task of its
own, so that no task holds more than two chunks; no link is lost. Components come from the
forests by repeated least-neighbour steps with pointer jumping over tables in the shared
folder; no links are collected.

Repeated rows and ties share a fingerprint and so a component. A null key is no candidate
for a component's number; if all keys of a component are null, its number is null. An empty
table gives an empty result. Columns of the input besides key and text are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, written

SHINGLE = 3
SEED = 42
DISTANCE = 3
HALF = 31
#: Rows of an anchor that are compared at once.
BLOCK = 4096
#: Most edges that a task holds to turn them into stars, but for the rows of one batch.
PIECE = 1 << 20

_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def simhash(text: str | None) -> int:
    """The fingerprint of one text, unsigned."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not tokens:
        return 0
    # Offsets into the joined words, so that a shingle is a slice.
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - SHINGLE + 1)
    ends = ends[min(SHINGLE, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65_536].tolist(), ends[at : at + 65_536].tolist())][: n - at], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, fingerprint) with the fingerprint's bits as a signed long, then the columns of ``carry`` as carry0, carry1 and so on."""
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), *(F.col(c).alias(f"carry{k}") for k, c in enumerate(carry)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name != "text"}
    ddl = ", ".join(f"{name} {kind}" for name, kind in ({"key": kinds.pop("key"), "fingerprint": "long"} | kinds).items())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((simhash(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]], names=["key", "fingerprint", *kinds])

    return map_arrow(rows, hashed, ddl)


def _syndrome(half: Column) -> Column:
    """Exclusive or of the numbers (from 1) of the bits that are set; 0 for code words."""
    out = F.lit(0)
    for k in range(HALF.bit_length()):
        mask = sum(1 << i for i in range(HALF) if (i + 1) >> k & 1)
        out = out + (F.bit_count(half.bitwiseAND(F.lit(mask))) % 2) * (1 << k)
    return out.cast("int")


def _masks() -> Column:
    """For each syndrome s, 16 masks in a row that lead to a code word: the flip of bit s first,
    then the flips of two bits whose numbers have s as exclusive or. For s = 0 only the first counts."""
    out = []
    for s in range(HALF + 1):
        out += [1 << s - 1 if s else 0]
        out += [1 << i - 1 | 1 << (i ^ s) - 1 for i in range(1, HALF + 1) if i ^ s > i] if s else [0] * (HALF // 2)
    return F.split(F.lit(",".join(map(str, out))), ",").cast("array<bigint>")


def anchored(prints: DataFrame) -> DataFrame:
    """(anchor, home, fingerprint): each fingerprint at its anchors of both halves."""
    halves = F.array(
        *(
            F.struct(F.lit(side).alias("side"), F.shiftrightunsigned("fingerprint", side * HALF).bitwiseAND((1 << HALF) - 1).alias("bits"))
            for side in (0, 1)
        )
    )
    rows = prints.select("fingerprint", F.explode(halves).alias("h")).select("fingerprint", "h.side", "h.bits")
    rows = rows.withColumn("s", _syndrome(F.col("bits")))
    per = HALF // 2 + 1
    masks = F.slice(_masks(), F.col("s") * per + 1, F.when(F.col("s") == 0, 1).otherwise(per))
    return rows.select("fingerprint", "side", "bits", F.posexplode(masks).alias("k", "mask")).select(
        (F.col("bits").bitwiseXOR(F.col("mask")) * 2 + F.col("side")).alias("anchor"), (F.col("k") == 0).alias("home"), "fingerprint"
    )


def _forest(homes: np.ndarray, others: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between homes and others."""
    if len(homes) * len(others) <= 16:
        pairs = [(h, o) for h in homes.tolist() for o in others.tolist() if h != o]
        return [(h, o) for h, o in pairs if ((h ^ o) & (1 << 64) - 1).bit_count() <= DISTANCE]
    nodes = np.unique(np.concatenate([homes, others]))
    label = np.arange(len(nodes))
    values, at = nodes.view(np.uint64), np.searchsorted(nodes, others)
    out = []
    for me in np.searchsorted(nodes, homes).tolist():
        near = at[np.bitwise_count(values[at] ^ values[me]) <= DISTANCE]
        own = label[me]
        found, first = np.unique(label[near], return_index=True)
        for other, k in zip(found.tolist(), first.tolist()):
            if other != own:
                out.append((int(nodes[me]), int(nodes[near[k]])))
                label[label == other] = own
    return out


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints that join each component of them."""
    rows = anchored(prints)
    # Anchors with one row, or without a row at home, have nothing to compare.
    counts = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("n_home")).where("n > 1 and n_home > 0")
    busy = rows.join(counts.select("anchor", "n").hint("merge"), "anchor")
    chunks = F.ceil(F.col("n") / block).cast("int")
    chunk = F.pmod(F.xxhash64("fingerprint"), chunks).cast("int")
    # A row at home meets all chunks, any row meets the homes of all chunks: tasks (i, j).
    as_other = F.transform(F.sequence(F.lit(0), chunks - 1), lambda i: F.struct(i.alias("i"), F.col("chunk").alias("j"), F.lit(False).alias("probe")))
    as_home = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.struct(F.col("chunk").alias("i"), j.alias("j"), F.lit(True).alias("probe")))
    dealt = (
        busy.withColumn("chunk", chunk)
        .withColumn("t", F.explode(F.when(F.col("home"), F.concat(as_other, as_home)).otherwise(as_other)))
        .select("anchor", "t.i", "t.j", "t.probe", "fingerprint")
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come ordered by (anchor, i, j); a group may go over the end of a batch.
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        rest = None
        for batch in batches:
            now = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)], axis=1)
            now = now if rest is None else np.concatenate([rest, now])
            cuts = np.flatnonzero((now[1:, :3] != now[:-1, :3]).any(axis=1)) + 1
            if not len(cuts):
                rest = now
                continue
            yield from forests(now[: cuts[-1]], cuts[:-1], schema)
            rest = now[cuts[-1] :]
        if rest is not None and len(rest):
            yield from forests(rest, np.array([], dtype=int), schema)

    def forests(rows: np.ndarray, cuts: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        edges = []
        bounds = [0, *cuts.tolist(), len(rows)]
        for a, b in zip(bounds, bounds[1:]):
            if b - a < 2:
                continue
            probe = rows[a:b, 3] == 1
            homes, others = np.unique(rows[a:b, 4][probe]), np.unique(rows[a:b, 4])
            if len(homes) and len(others) > 1:
                edges += _forest(homes, others)
        if edges:
            e = np.array(edges, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], schema=schema)

    ordered = dealt.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return map_arrow(ordered, compared, "a long, b long").distinct()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that join the same nodes: of each ``PIECE`` edges of a task, one from every node to the least that it reaches by them."""
    held, size = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)], axis=1))
        size += len(held[-1])
        if size >= PIECE:
            yield _star(np.concatenate(held))
            held, size = [], 0
    if size:
        yield _star(np.concatenate(held))


def _star(edges: np.ndarray) -> pa.RecordBatch:
    nodes, places = np.unique(edges, return_inverse=True)
    a, b = places.reshape(edges.shape).T
    low = np.arange(len(nodes))
    while (low[a] != low[b]).any():
        # The greater root of an edge hooks onto the lesser one, then all nodes go up to their roots.
        one, two = low[a], low[b]
        np.minimum.at(low, np.maximum(one, two), np.minimum(one, two))
        while (low[low] != low).any():
            low = low[low]
    own = low != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[low[own]]), pa.array(nodes[own])], names=["a", "b"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable, for every node of an edge (a, b).

    Each task first turns its own edges into stars. Then each round gives every node the least root among its
    neighbours' roots and jumps to that root's root. Rounds end when no root changes; each is a table in the
    shared folder. No side of a join is broadcast, as all of them grow with the edges.
    """
    kept = lambda df: written(df, "components")
    own = edges.where("a <> b").select("a", "b").distinct()
    stars = map_arrow(own, _stars, "a long, b long")
    both = kept(stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = kept(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node").withColumn("moved", F.lit(True)))
    for _ in range(most_rounds):
        roots = state.select("node", "root")
        near = both.join(roots.hint("merge"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        # A root learns the least root that its members see, so trees hook onto each other.
        seen = roots.join(near.hint("merge"), F.col("node") == F.col("a")).select("node", "root", F.least("root", "near").alias("new"))
        hooks = seen.groupBy(F.col("root").alias("hook")).agg(F.min("new").alias("low"))
        lifted = seen.join(hooks.hint("merge"), F.col("new") == F.col("hook"), "left").select("node", "root", F.least("new", "low").alias("to"))
        before, state = state, kept(lifted.select("node", F.col("to").alias("root"), (F.col("to") != F.col("root")).alias("moved")))
        discard(before)
        if not state.where("moved").limit(1).count():
            discard(both)
            return state.select("node", "root")
    raise RuntimeError("components didn't settle")


def _rooted(prints: DataFrame, least: Column, block: int) -> DataFrame:
    """(fingerprint, least, root): each distinct fingerprint with the least of its rows and its component's root."""
    distinct = written(prints.groupBy("fingerprint").agg(F.min(least).alias("least")), "simhash-distinct")
    found = components(links(distinct.select("fingerprint"), block))
    # Both sides grow with the documents, so none is broadcast.
    return distinct.join(found.hint("merge"), F.col("fingerprint") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fingerprint"))


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: key, fingerprint (16 hexadecimal digits), component_id (least key reachable)."""
    prints = written(fingerprints(documents, key, text), "simhash")
    rooted = _rooted(prints, F.col("key"), block)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least.hint("merge"), "root").select(F.col("fingerprint").alias("f"), "component_id")
    return prints.join(classes.hint("merge"), F.col("fingerprint") == F.col("f")).select(
        F.col("key").alias(key),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def first_rows(documents: DataFrame, carry: tuple[str, ...], key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The columns of ``carry``, which tell rows apart, of the row of least key of each component; rows without a key are last, ties go by ``carry``."""
    prints = written(fingerprints(documents, key, text, carry), "simhash")
    order = F.struct(F.col("key").isNull().alias("none"), "key", *(f"carry{k}" for k in range(len(carry))))
    least = _rooted(prints, order, block).groupBy("root").agg(F.min("least").alias("least"))
    return least.select(*(F.col(f"least.carry{k}").alias(c) for k, c in enumerate(carry)))
