"""Language identification by bit-sliced Bloom filters of n-grams.

One Bloom filter per language, stored bit-sliced: slot i of the table holds, as a bit mask,
the languages whose filter has bit i set. The bitwise AND of an n-gram's slots are all
languages whose filter contains it. Per language, the n-grams of a text that its filter
contains are counted (population counts per bit), the count is corrected for the filter's
rate of false positives, and the language with the most wins; the score is its corrected
share of the text's n-grams.

N-grams are runs of ``GRAM`` bytes of the normalised text: lower-cased letters, everything
else one blank, with a blank at either end. The whole text counts; texts are cut in pieces of
bounded size that overlap by GRAM - 1 bytes, so memory stays bounded and no n-gram is lost.

A language's filter holds the ``GRAMS`` n-grams that are most frequent in it, whether other
languages have them or not; n-grams that several have count for each of them.
Learning reads at most about ``ROWS`` texts of each language (all, if there are fewer),
chosen by a hash of the text; counting is distributed, and the driver gets
at most GRAMS n-grams per language. A slot has one word of the mask for each ``WORD_BITS``
languages, so there may be any number of them.

A text that is null or has no letter is ``und`` with score 0. Ties go to the first language
by name. Null languages teach nothing. If there is nothing to learn from, all is ``und``. Repeated
rows get equal answers. Columns of the input besides key and text are dropped by ``predict``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

GRAM = 5
GRAMS = 20_000
ROWS = 1500
HASHES = 3
SLOTS = 1 << 19
WORD_BITS = 64
#: Characters that are handled at a time.
PIECE = 1 << 20
#: Least score with which ``accept`` keeps a document.
LEAST_SCORE = 0.05

_OTHER = re.compile(r"[\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def normalise(text: str) -> bytes:
    return (" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-8", "ignore")


def grams(data: bytes) -> np.ndarray:
    """The n-grams of normalised bytes as numbers, one per place; GRAM is 8 at most."""
    b = np.frombuffer(data, np.uint8)
    n = len(b) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out <<= np.uint64(8)
        out |= b[k : k + n]
    return out


def slots(values: np.ndarray) -> Iterator[np.ndarray]:
    """The HASHES slots of each n-gram."""
    shift = np.uint64(64 - (SLOTS - 1).bit_length())
    for mix in _MIX[:HASHES]:
        yield (((values * _BASE) ^ (values >> np.uint64(17))) * mix) >> shift


def pieces(text: str) -> Iterator[bytes]:
    """Normalised pieces of a text that share GRAM - 1 bytes with the next, so every n-gram is in one."""
    if len(text) <= PIECE:
        yield normalise(text)
        return
    tail = b""
    for at in range(0, len(text), PIECE):
        data = _OTHER.sub(" ", text[at : at + PIECE].lower()).encode("utf-8", "ignore")
        data = tail + (data[1:] if tail.endswith(b" ") and data.startswith(b" ") else data if tail else b" " + data.lstrip(b" "))
        if at + PIECE >= len(text):
            data = data.rstrip(b" ") + b" "
        yield data
        tail = data[-(GRAM - 1) :]


@dataclass(frozen=True)
class Model:
    """The languages in order, the sliced table (one per word of the mask), and each filter's rate of false positives."""

    languages: tuple[str, ...]
    tables: tuple[np.ndarray, ...]
    false_rate: np.ndarray

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Per language the n-grams that its filter contains, and the number of all n-grams."""
        hits, total = np.zeros(len(self.languages), dtype=np.int64), 0
        for data in pieces(text):
            g = grams(data)
            total += len(g)
            at = list(slots(g))
            for word, table in enumerate(self.tables):
                masks = table[at[0]]
                for s in at[1:]:
                    masks &= table[s]
                for k in range(word * WORD_BITS, min(len(hits), (word + 1) * WORD_BITS)):
                    hits[k] += np.count_nonzero(masks & table.dtype.type(1 << k % WORD_BITS))
        return hits, total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        hits, total = self.counts(text)
        if not total:
            return self.languages[0], 0.0
        rate = (hits / total - self.false_rate) / (1 - self.false_rate)
        best = int(np.argmax(rate))
        return self.languages[best], float(min(1.0, max(0.0, rate[best])))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learns from (text, lang). See the module for what is read."""
    known = rows.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), (), np.zeros(0))
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, ROWS / sizes[k]))))
    chosen = known.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in sorted(set(names)):
                g = [x for t, n in zip(texts, names) if n == name for p in pieces(t) for x in [grams(p)]]
                value, count = np.unique(np.concatenate(g), return_counts=True)
                # A short n-gram of padding only has no letter and says nothing.
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(value), pa.string()), pa.array(value.view(np.int64)), pa.array(count.astype(np.int64))], names=["lang", "gram", "n"]
                )

    grown = map_arrow(chosen.select("text", "lang"), counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    from pyspark.sql import Window

    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # Each task keeps GRAMS rows of a language before they meet.
    top = grown.withColumn("r", F.row_number().over(best)).where(F.col("r") <= GRAMS).select("lang", "gram").toPandas()
    return sliced({name: own.to_numpy(np.int64).view(np.uint64) for name, own in top.groupby("lang")["gram"]}, languages)


def sliced(grams_of: dict[str, np.ndarray], languages: tuple[str, ...]) -> Model:
    """The model whose filters hold the given n-grams of each language."""
    tables, fill = [], []
    for at in range(0, len(languages), WORD_BITS):
        own = languages[at : at + WORD_BITS]
        kind = np.dtype(f"u{max(1, 1 << max(0, (len(own) - 1).bit_length() - 3))}")
        table = np.zeros(SLOTS, kind)
        for k, name in enumerate(own):
            for s in slots(grams_of.get(name, np.zeros(0, np.uint64))):
                table[s] |= kind.type(1 << k)
        fill += [np.count_nonzero(table & kind.type(1 << k)) / SLOTS for k in range(len(own))]
        tables.append(table)
    return Model(languages, tuple(tables), np.array(fill) ** HASHES)


def predict(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, lang_pred, score."""
    rows = documents.select(F.col(key), F.col(text).alias("text"))
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            out = [own.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], names=[key, "lang_pred", "score"]
            )

    return map_arrow(rows, predicted, f"`{key}` {rows.schema[0].dataType.simpleString()}, lang_pred string, score double")


def accept(documents: DataFrame, model: Model, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows, all columns as they are, whose text has a language with a score of at least ``least``."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            answers = (own.predict(x.as_py()) for x in batch.column(place))
            yield batch.filter(pa.array([name != "und" and score >= least for name, score in answers], pa.bool_()))

    return map_arrow(documents, kept, documents.schema)
