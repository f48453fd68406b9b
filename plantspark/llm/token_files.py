"""Token ids in files of byte planes, with a chunk index, and their way back.

Documents are put in ascending key order by a range partitioning, encoded, and closed with
an end id. A part's ids run through its documents without gaps and are cut in blocks of
``BLOCK`` ids. A block is transposed to the four byte planes of little-endian unsigned 32-bit
integers, and each plane is compressed with zstandard by itself. The container is Parquet,
so Spark's committer writes it to any store and a lost task is simply run again; one row
is one block with its index: the part, the block's place in it, and for each document in the
block its key and number of ids, with the ids that the first of them has in earlier blocks.

Readers take blocks one by one, whatever file or split they are in. A document's start is the
ids of earlier parts (one number per part, from the index) plus those before it in its part.
The digests of a document's segments are combined without bringing its ids together, so
neither writing nor reading holds more than a block and a batch of texts.

Null texts are empty: the end id alone. Null keys come first; equal keys come in order of a
hash of their text. An empty table gives an empty folder. Columns besides key and text are
dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, marked

BLOCK = 1 << 16
PLANES = 4
LEVEL = 3
#: Characters that are encoded at a time (or one text), and words remembered by a worker (in each of two generations).
BATCH = 1 << 22
REMEMBERED = 500_000


class WordEncoder:
    """Encodes texts with a byte-level BPE tokenizer of the tokenizers library, word by word.

    The library splits texts by the pattern that ``common.parts`` is proven for, so the parts have the
    same ids alone as in their text; each is encoded once and remembered. Texts that can't be cut that
    way, or that hold one of the tokenizer's added tokens, go to the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.old: dict[str, bytes] = {}
        self.young: dict[str, bytes] = self._first()

    def _first(self) -> dict[str, bytes]:
        return {"\n": np.array(self.feed, "<u4").tobytes()}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words without line feeds: as lines of one text, cut where a line feed's id is."""
        if len(self.feed) != 1:
            return self._whole(words)
        ids = np.array(self._lines(words), "<u4")
        cuts = np.flatnonzero(ids == self.feed[0])
        if len(cuts) != len(words) - 1:
            return self._whole(words)
        data, ends = ids.tobytes(), [*(cuts * 4).tolist(), len(ids) * 4]
        return [data[a:b] for a, b in zip([0, *(x + 4 for x in ends)], ends)]

    def _lines(self, words: list[str]) -> list[int]:
        return self.tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids

    def _remembered(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, from memory where they are there."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, self._first()
        young, old = self.young, self.old
        found = list(map(young.get, words))
        if None in found:
            missing = []
            for w, ids in zip(words, found):
                if ids is None:
                    if (known := old.get(w)) is None:
                        missing.append(w)
                    else:
                        young[w] = known
            if missing:
                young.update(zip(missing, self._words(missing)))
            found = list(map(young.__getitem__, words))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out = [b""] * len(texts)
        cut = [None if any(a in x for a in self.added) else marked(x) for x in texts]
        quick = [i for i, x in enumerate(cut) if x is not None]
        whole = [i for i, x in enumerate(cut) if x is None and texts[i]]
        if quick:
            lists = pc.split_pattern(pa.array([cut[i] for i in quick], pa.large_string()), "\0")
            coded = lists.values.dictionary_encode()
            words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
            bounds = lists.offsets.to_numpy()
            # White space that doesn't stand alone leaves an empty word or a blank: such texts go whole.
            odd = np.isin(codes, [k for k, w in enumerate(words) if w in ("", " ")])
            ids = self._remembered([w if w not in ("", " ") else "\n" for w in words])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
            each = sizes[codes]
            ends = np.cumsum(each)
            made = flat[np.repeat(starts[codes] - ends + each, each) + np.arange(len(codes) and ends[-1])]
            at = np.concatenate([[0], ends])[bounds]
            bad = np.add.reduceat(odd, bounds[:-1]) > 0
            for k, i in enumerate(quick):
                if bad[k]:
                    whole.append(i)
                else:
                    out[i] = made[at[k] : at[k + 1]].tobytes()
        for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def to_planes(ids: bytes) -> list[bytes]:
    """Compressed byte planes of ids, lowest byte first."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    matrix = np.frombuffer(ids, np.uint8).reshape(-1, PLANES).T
    return [squeeze.compress(np.ascontiguousarray(p).tobytes()) for p in matrix]


def from_planes(planes: list[bytes]) -> bytes:
    """The ids of compressed byte planes."""
    import zstandard

    expand = zstandard.ZstdDecompressor()
    return np.stack([np.frombuffer(expand.decompress(p), np.uint8) for p in planes], axis=1).tobytes()


_SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int64()),
        ("first", pa.int64()),
        ("n_ids", pa.int32()),
        ("keys", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int32())),
        ("before", pa.int64()),
        ("planes", pa.list_(pa.binary())),
    ]
)
_DDL = "part int, block long, first long, n_ids int, keys array<long>, counts array<int>, before long, planes array<binary>"


def write(documents: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Writes the ids of all documents below ``folder``."""
    rows = documents.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"))
    end = end_id.to_bytes(4, "little")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = word_encoder(path)
        waiting, size = [], 0  # (key, ids, ids before these) not yet in a block; their ids
        n_blocks = done = 0

        def cut(n: int) -> pa.RecordBatch:
            nonlocal waiting, size, n_blocks, done
            keys, counts, data, before, left = [], [], [], waiting[0][2], n
            while left:
                k, ids, prior = waiting.pop(0)
                own = min(left, len(ids) // 4)
                if own < len(ids) // 4:
                    waiting.insert(0, (k, ids[4 * own :], prior + own))
                    ids = ids[: 4 * own]
                keys.append(k)
                counts.append(own)
                data.append(ids)
                left -= own
            row = [[part], [n_blocks], [done], [n], [keys], [counts], [before], [to_planes(b"".join(data))]]
            size, n_blocks, done = size - n, n_blocks + 1, done + n
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(row, _SCHEMA)], schema=_SCHEMA)

        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(sizes // BATCH)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for at, to in zip(cuts, cuts[1:]):
                piece = batch.slice(at, to - at)
                for k, ids in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist())):
                    waiting.append((k, ids + end, 0))
                    size += len(ids) // 4 + 1
                while size >= BLOCK:
                    yield cut(BLOCK)
        if size:
            yield cut(size)

    map_arrow(rows, blocks, _DDL).write.parquet(folder)


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of crc32, both with the highest power in the lowest bit."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


@lru_cache(maxsize=4096)
def _shifted(n_bytes: int) -> int:
    """x to the power 8 * n_bytes."""
    out, square = 1 << 31, 1 << 23
    while n_bytes:
        if n_bytes & 1:
            out = _times(out, square)
        square = _times(square, square)
        n_bytes >>= 1
    return out


def joined_crc32(first: int, second: int, second_bytes: int) -> int:
    """crc32 of two byte strings in a row, from that of each."""
    return _times(_shifted(second_bytes), first) ^ second


def read(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """Per document of the files: key, start, n_tokens, ids_crc32, in no order of rows."""
    blocks = spark.read.schema(_DDL).parquet(folder)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, total = {}, 0
    for r in parts:
        starts[r["part"]], total = total, total + r["n"]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = from_planes(row["planes"])
                counts = np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                at = (ends - counts) * 4
                crcs = [zlib.crc32(data[a : a + 4 * n]) for a, n in zip(at.tolist(), counts.tolist())]
                before = np.zeros(len(counts), np.int64)
                before[0] = row["before"]
                start = starts[row["part"]] + row["first"] + ends - counts - before
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"], pa.int64()), pa.array(start), pa.array(before), pa.array(counts), pa.array(crcs, pa.int64())],
                    names=["key", "start", "before", "n", "crc"],
                )

    found = map_arrow(blocks, segments, "key long, start long, before long, n long, crc long")
    grouped = found.groupBy("start", "key").agg(F.sort_array(F.collect_list(F.struct("before", "n", "crc"))).alias("s"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, sizes = [], []
            for s in batch.column(2).to_pylist():
                crc = s[0]["crc"]
                for x in s[1:]:
                    crc = joined_crc32(crc, x["crc"], 4 * x["n"])
                crcs.append(crc)
                sizes.append(sum(x["n"] for x in s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"]
            )

    return map_arrow(grouped, joined, f"`{key}` long, start long, n_tokens long, ids_crc32 long")
