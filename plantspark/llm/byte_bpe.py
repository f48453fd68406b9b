"""Byte-level BPE encoding and decoding, with merges folded by Spark higher-order functions.

A text is split by the vocabulary's pattern; each piece is a byte array whose ranked merges
are folded: the adjacent pair of lowest rank (the leftmost of equals) becomes one token,
until no adjacent pair has a rank. Ranks are a literal map of the plan, laid out as integer
arrays by row displacement, so that a lookup takes constant time (a Spark map is
searched from its start). Decoding concatenates the bytes of each id.

Each row passes three steps in one task, without a shuffle: an Arrow step splits its text,
replaces its pieces by numbers and gives the bytes of those that the task hasn't met before with
the ranks of their pairs; higher-order functions fold these; an Arrow step, which gets the same rows in the same order, numbers their ids alike and
puts them in order. A bounded dictionary, filled first, holds the pieces that are frequent in a
bounded sample of texts, folded by the same functions. It decides only which pieces are folded
beforehand: each piece has the same ids either way. A task remembers ``REMEMBERED`` pieces, then
starts anew.

An empty or null text has no ids; its digests are those of no bytes. Rows are kept as they
are, so repeated rows and ties stay. Columns of the input besides key and text are dropped.
The fold of one piece takes time in the square of its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPLIT_PATTERN, let, map_arrow, parts, whole_text

#: Most pieces of the dictionary, and texts read to find them.
DICTIONARY_PIECES = 1 << 17
SAMPLE_TEXTS = 12_000
#: Most other pieces that a task keeps at a time.
REMEMBERED = 200_000

_LOW = 1 << 16
#: The rank of pairs that don't merge, and the place of ranks in a token's number.
_UNRANKED, _RANK_AT = _LOW - 1, 47
#: An empty cell of the table.
_NONE = 1 << 40
#: More than any array's length.
_NONE_LEFT = 1 << 30


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by id, and the rank of each mergeable pair by row displacement.

    The pair (a, b) merges to r where ``table[offset[a] + b] == a << 16 | r``. The id
    ``len(tokens)`` stands at either end of a piece and is in no pair. ``pairs[257 * x + y]`` is
    the number (see ``fold_all``) of the byte x before the byte y, 256 being none.
    """

    tokens: tuple[bytes, ...]
    pairs: np.ndarray
    offset: np.ndarray
    table: np.ndarray


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Reads a file of base64 tokens and ranks (driver only; its size is the vocabulary's)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = len(ranks)
    if size >= _LOW or set(ranks.values()) != set(range(size)):
        raise ValueError("ranks must run from 0 without gaps, 65534 at most")
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                rows.setdefault(a, []).append((b, rank))
    cells = 2 * max(1024, sum(map(len, rows.values())))
    while (made := _displaced(rows, size, cells)) is None:
        cells *= 2
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    pairs = np.full((256, 257), _UNRANKED, np.int64)
    for token, rank in ranks.items():
        if len(token) == 2:
            pairs[token[0], token[1]] = rank
    pairs = (pairs << _RANK_AT) + np.array([[ranks[bytes([i])]] for i in range(256)])
    return Vocabulary(tuple(tokens), pairs.ravel(), *made)


def _displaced(rows: dict[int, list[tuple[int, int]]], size: int, cells: int):
    """Offsets at random, longest row first, so that no two pairs share a cell; None if that fails."""
    r = np.random.default_rng(cells)
    used = np.zeros(cells + size + 1, dtype=bool)
    offset = np.zeros(size + 1, dtype=np.int64)
    table = np.full(cells + size + 1, _NONE, dtype=np.int64)
    for a in sorted(rows, key=lambda x: -len(rows[x])):
        columns, found = np.array([x for x, _ in rows[a]]), np.array([x for _, x in rows[a]])
        for _ in range(2000):
            tries = r.integers(0, cells, 16)
            free = np.flatnonzero(~used[tries[:, None] + columns].any(axis=1))
            if len(free):
                break
        else:
            return None
        at = int(tries[free[0]])
        used[at + columns], offset[a] = True, at
        table[at + columns] = a << 16 | found
    return offset, table


def rank_map(spark: SparkSession, vocab: Vocabulary) -> dict[str, Column]:
    """The rank map as constants of a plan (table, offsets).

    They are subqueries over one row of the driver, so Spark puts their values into the tasks as
    literals, but not into the texts of plans, of which the driver keeps many.
    """
    columns = {"table": vocab.table, "offset": vocab.offset}
    row = pa.table({k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, pa.int64())) for k, v in columns.items()})
    frame = spark.createDataFrame(row)
    return {k: frame.select(k).scalar() for k in columns}


def fold_all(rows: DataFrame, pieces: str, ranks: dict[str, Column]) -> DataFrame:
    """The rows with the ids of each piece of an array ``pieces`` of states (see ``_states_of``), as ``folds``.

    A piece's state is one array with a number per token: the rank of its pair with the next token,
    its place in the array and its id, from high bits to low. So the least number is the leftmost
    of the pairs of lowest rank, and says where it stands (Spark's ``array_position`` leaves its loop
    by an exception, ``let`` copies arrays, ``concat`` makes lazy lists: all dear at each merge).
    """
    place, unranked = (1 << _RANK_AT) - 1, F.lit(_UNRANKED).cast("bigint")

    def fold(piece: Column, table: Column, offset: Column) -> Column:
        own = lambda state: state.bitwiseAND(_LOW - 1)
        # A cell of another left token differs from it in high bits, an empty one is large: both end as _UNRANKED.
        rank = lambda a, b: F.shiftleft(F.least(F.get(table, F.get(offset, a) + b).bitwiseXOR(F.shiftleft(a, 16)), unranked), _RANK_AT)

        def merged(states: Column, least: Column) -> Column:
            made = F.shiftright(least, _RANK_AT)

            def at_place(states: Column, at: Column) -> Column:
                before = F.get(states, at - 1)
                two = F.array(
                    rank(own(before), made).bitwiseOR(before.bitwiseAND(place)),
                    rank(made, own(F.get(states, at + 2))).bitwiseOR(least.bitwiseAND(place - _LOW + 1)).bitwiseOR(made),
                )
                after = F.transform(F.slice(states, at + 3, F.lit(_NONE_LEFT)), lambda x: x - _LOW)
                return F.flatten(F.array(F.slice(states, F.lit(1), at - 1), two, after))

            return F.aggregate(F.array(F.shiftright(least.bitwiseAND(place), 16).cast("int")), states, at_place)

        # An aggregate over one element binds it to a name.
        step = lambda states, _: F.aggregate(
            F.array(F.array_min(states)), states, lambda now, least: F.when(least < _UNRANKED << _RANK_AT, merged(now, least)).otherwise(now)
        )
        ids = lambda states: F.transform(F.slice(states, F.lit(2), F.size(states) - 2), lambda x: own(x).cast("int"))
        return F.aggregate(F.slice(piece, F.lit(2), F.greatest(F.size(piece) - 3, F.lit(0))), piece, step, ids)

    # Bound once per row; the optimizer puts the subqueries where their columns are used.
    folds = let(F.col("table"), lambda t: let(F.col("offset"), lambda o: F.transform(pieces, lambda x: fold(x, t, o))))
    return rows.withColumns(ranks).select(*rows.columns, F.when(F.size(pieces) > 0, folds).alias("folds"))


def _states_of(texts: pa.Array, pairs: np.ndarray, edge: int) -> pa.ListArray:
    """The state of each piece before its first merge (see ``fold_all``): its bytes between two tokens ``edge`` that are in no pair."""
    texts = pa.concat_arrays([texts]) if texts.offset == 0 else pa.array(texts.to_pylist(), pa.string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, "<i4")[: len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[: ends[-1]].astype(np.int64) if ends[-1] else np.zeros(0, np.int64)
    sizes, after = np.diff(ends), np.append(flat[1:], 256)
    after[ends[1:][sizes > 0] - 1] = 256
    piece, at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat))
    out = np.full(len(flat) + 2 * len(sizes), (_UNRANKED << _RANK_AT) + edge, np.int64)
    out[at + 2 * piece + 1] = pairs[flat * 257 + after[: len(flat)]] + (at - ends[piece] + 1 << 16)
    out[ends[1:] + 2 * np.arange(len(sizes)) + 1] += sizes + 1 << 16
    return pa.ListArray.from_arrays(pa.array(ends + 2 * np.arange(len(ends)), pa.int32()), pa.array(out))


def _dictionary(texts: DataFrame, text: str, pattern: str, ranks: dict[str, Column], begun: Callable) -> tuple[list[str], list[bytes]]:
    """Frequent pieces of about SAMPLE_TEXTS texts, chosen by hash, and the ids of each; DICTIONARY_PIECES at most."""
    share = min(1.0, SAMPLE_TEXTS / max(1, texts.count()))
    some = texts.select(text).where(F.pmod(F.xxhash64(text), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    pieces = F.regexp_extract_all(whole_text(F.col(text)), F.lit("(?U)" + pattern), F.lit(0))
    counts = some.select(F.explode(pieces).alias("piece")).groupBy("piece").count()
    top = counts.where("length(piece) <= 64").orderBy(F.desc("count"), "piece").limit(DICTIONARY_PIECES)
    lists = top.groupBy(F.pmod(F.xxhash64("piece"), F.lit(64)).alias("part")).agg(F.collect_list("piece").alias("pieces"))

    def as_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column(0):
                both = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (own.values, begun(own.values))]
                yield pa.RecordBatch.from_arrays(both, names=["pieces", "states"])

    listed = map_arrow(lists.select("pieces"), as_states, "pieces array<string>, states array<array<bigint>>")
    table = fold_all(listed, "states", ranks).select("pieces", "folds").toArrow()
    names, found = [], []
    for own, ids in zip(table.column("pieces"), table.column("folds")):
        names += own.as_py()
        found += _cut(ids.values)
    return names, found


def _cut(lists: pa.ListArray) -> list[bytes]:
    """Each list of ids as little-endian unsigned 32-bit integers."""
    cuts = (lists.offsets.to_numpy() * 4).tolist() if len(lists) else [0]
    flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
    return [flat[a:b] for a, b in zip(cuts, cuts[1:])]


def _encoded(documents: DataFrame, path: str, pattern: str, key: str, text: str, finish: Callable, ddl: str) -> DataFrame:
    """Encodes each row and gives its key and ids (little-endian, 4 bytes each) to ``finish``."""
    vocab, context = vocabulary(path), documents.sparkSession.sparkContext
    ranks, pairs, edge = rank_map(documents.sparkSession, vocab), context.broadcast(vocab.pairs), len(vocab.tokens)
    begun = lambda texts: _states_of(texts, pairs.value, edge)
    # Either Arrow step gets only its half of the dictionary.
    names, ids_of = map(context.broadcast, _dictionary(documents, text, pattern, ranks, begun))
    rows = documents.select(F.col(key).alias("key"), whole_text(F.col(text)).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pieces = regex.compile(pattern).findall
        known = {p: i.to_bytes(4, "little") for i, p in enumerate(names.value)}
        quick = pattern == SPLIT_PATTERN
        # A part that is a piece of the dictionary is that piece.
        n, own, of_part = len(known), {}, dict(known)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                codes, rare, anew = [], [], []
                for text in part.column(1).to_pylist():
                    if restart := len(own) > REMEMBERED or len(of_part) > REMEMBERED + n:
                        own, of_part = {}, dict(known)
                    new: list[str] = []

                    def numbered(piece: str, own=own, new=new) -> bytes:
                        c = known.get(piece) or own.get(piece)
                        if c is None:
                            c = own[piece] = (n + len(own)).to_bytes(4, "little")
                            new.append(piece)
                        return c

                    if quick and (found := parts(text)):
                        for x in set(found).difference(of_part):
                            of_part[x] = b"".join(map(numbered, pieces(x)))
                        codes.append(b"".join(map(of_part.__getitem__, found)))
                    else:
                        codes.append(b"".join(map(numbered, pieces(text))))
                    rare.append(new)
                    anew.append(restart)
                ends = np.cumsum([0, *map(len, rare)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), begun(pa.array([x for new in rare for x in new], pa.string())))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes, pa.binary()), lists, pa.array(anew)], names=["key", "codes", "rare", "anew"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = list(ids_of.value)
        n = len(ids)
        for batch in batches:
            # Null lists are of no length; all offsets count from the buffers' start.
            outer, inner = batch.column(2).offsets.to_pylist(), _cut(batch.column(2).values)
            anew = batch.column(3).to_pylist()
            for at in range(0, batch.num_rows, 64):
                part, made = batch.slice(at, 64), []
                for k, code in enumerate(part.column(1), at):
                    if anew[k]:
                        del ids[n:]
                    ids += inner[outer[k] : outer[k + 1]]
                    made.append(b"".join(map(ids.__getitem__, np.frombuffer(code.as_py(), "<i4").tolist())))
                yield finish(part.column(0), made)

    folded = fold_all(map_arrow(rows, split, f"key {kind}, codes binary, rare array<array<bigint>>, anew boolean"), "rare", ranks).select("key", "codes", "folds", "anew")
    return map_arrow(folded, joined, f"`{key}` {kind}, {ddl}")


def encode_documents(documents: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key and the ids of the text."""

    def finish(keys: pa.Array, made: list[bytes]) -> pa.RecordBatch:
        ids = pa.array([np.frombuffer(x, "<i4") for x in made], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([keys, ids], names=[key, "ids"])

    return _encoded(documents, path, pattern, key, text, finish, "ids array<int>")


def decode(ids: bytes, tokens: tuple[bytes, ...]) -> bytes:
    """The bytes of ids (little-endian unsigned 32-bit integers): their pieces, one after the other."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row of ``encode_documents``: the key and the decoded bytes (none for null)."""
    tokens = encoded.sparkSession.sparkContext.broadcast(vocabulary(path).tokens)
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [decode(np.array(x.as_py() or [], "<u4").tobytes(), tokens.value) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=[key, "bytes"])

    return map_arrow(rows, decoded, f"`{key}` {kind}, bytes binary")


def round_trip(documents: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, the number of ids, the digest of the ids and that of the bytes they decode to."""
    tokens = documents.sparkSession.sparkContext.broadcast(vocabulary(path).tokens)

    def finish(keys: pa.Array, made: list[bytes]) -> pa.RecordBatch:
        digest = lambda x: hashlib.sha256(x).hexdigest()
        columns = [[len(x) // 4 for x in made], [digest(x) for x in made], [digest(decode(x, tokens.value)) for x in made]]
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(columns[0], pa.int64()), *(pa.array(x, pa.string()) for x in columns[1:])], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"]
        )

    return _encoded(documents, path, pattern, key, text, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string")
