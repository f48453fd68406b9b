"""Token counts of whole texts, exact for huge ones too, by overlap resynchronisation.

A text of up to ``CHUNK`` characters is encoded at once. A longer one is encoded in chunks that
overlap; two neighbours are spliced at a boundary that both encodings have in the overlap and
that is proven stable: one before a word mark after a character that is none. No piece of
the vocabulary goes over such a place (``stable`` checks that when the vocabulary is
loaded), so merges on either side don't depend on the other side, and counts add up. If the
overlap has no such place, it is widened, at last to the whole rest of the text.

Null and empty texts have no tokens. Rows stay as they are; columns of the input besides key
and text are dropped. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

CHUNK = 1 << 17
OVERLAP = 1 << 10
LIMIT = 4096
#: Texts that are encoded at a time.
BATCH = 256

MARK = "▁"


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def stable(path: str) -> bool:
    """Whether no piece has a word mark after another character."""
    p = processor(path)
    return not any(MARK in p.id_to_piece(i).lstrip(MARK) for i in range(p.get_piece_size()))


def _cuts(text: str, spans: list[tuple[int, int]], low: int, high: int) -> dict[int, int]:
    """Proven stable boundaries between ``low`` and ``high``, each with the number of tokens before it."""
    return {a: k for k, (a, _) in enumerate(spans) if low <= a < high and text[a] == " " and a > 0 and text[a - 1] not in (" ", MARK)}


def count_long(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of a text, from overlapping chunks."""
    p = processor(path)
    if len(text) <= chunk or not stable(path):
        return len(p.encode(text))

    def spans(a: int, b: int) -> list[tuple[int, int]]:
        part = text[a:b]
        points = np.frombuffer(part.encode("utf-32-le"), "<u4")
        # The library's offsets are in UTF-8 bytes.
        starts = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
        found = np.array([(x.begin, x.end) for x in p.encode(part, out_type="proto").pieces])
        return [(a + x, a + y) for x, y in np.searchsorted(starts, found, side="right").tolist()]

    total, start, skip = 0, 0, 0
    while True:
        width = overlap
        end = start + chunk
        left = spans(start, min(len(text), end + width))
        if end + width >= len(text):
            return total + len(left) - skip
        while True:
            right = spans(end, min(len(text), end + chunk))
            # Far enough from the ends of both encodings that the place isn't the edge of a cut.
            here, there = _cuts(text, left, end + 1, end + width), _cuts(text, right, end + 1, end + width)
            both = here.keys() & there.keys()
            if both:
                break
            width *= 2
            if end + width >= len(text):
                return total + len(spans(start, len(text))) - skip
            left = spans(start, end + width)
            if width > chunk:
                chunk = 2 * width
        place = min(both)
        total += here[place] - skip
        start, skip = end, there[place]
        if end + chunk >= len(text):
            return total + len(right) - skip


def token_counts(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: key, n_bytes, n_tokens, over_limit."""
    rows = documents.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = processor(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = part.column(1).to_pylist()
                short = [x if len(x) <= CHUNK else "" for x in texts]
                counts = [len(x) for x in p.encode(short, num_threads=1)]
                counts = [n if len(x) <= CHUNK else count_long(x, path) for n, x in zip(counts, texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(counts, pa.int64())], names=[key, "n_bytes", "n_tokens"])

    made = map_arrow(rows, counted, f"`{key}` {rows.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long")
    return made.withColumn("over_limit", F.col("n_tokens") > limit)
