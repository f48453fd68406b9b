"""A byte-level convolutional network in numpy that scores the quality of whole texts.

Learned filters of ``WIDTH`` bytes go over the bytes of the text, ``STRIDE`` bytes at a time, in
overlapping chunks of ``CHUNK`` bytes that cover the document and share WIDTH - STRIDE bytes;
each filter's responses are max-pooled over a chunk, the chunks' maxima are max-pooled over
the document, and a linear layer with a logistic link combines them into one probability.
A response is a sum of WIDTH table entries, one per byte, so a filter is one learned weight
per place and byte value; its gradient goes to the place of its maximum.

Learning reads whole texts, chunk by chunk as scoring does: of each label the ``ROWS`` distinct
texts of least salted hash, as far as they have ``TRAIN_BYTES`` bytes together. Copies of a text
with one label are one, so the sample is bounded however often a text repeats. A single text
longer than TRAIN_BYTES isn't learned from. Scores always cover whole texts.
The seed is fixed and sums are in a fixed order, so equal inputs give equal scores.

Null and empty texts are padded like any short text and get a score as well. Rows with a null
label teach nothing; without rows of both labels every score is the share of label 1 (0.5
without any). Columns of the input besides key and text are dropped by ``predict``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow

WIDTH = 8
STRIDE = 2
FILTERS = 16
CHUNK = 1 << 16
ROWS = 1500
TRAIN_BYTES = 1 << 23
EPOCHS = 8
BATCH = 32
RATE = 0.05
THRESHOLD = 0.7
SEED = 7


def chunks(data: bytes) -> Iterator[np.ndarray]:
    """The windows' bytes: overlapping chunks that cover all bytes; the end is padded with zeros."""
    step = CHUNK - CHUNK % STRIDE
    # A chunk begins where a window does that isn't in the one before.
    for at in range(0, max(len(data) - WIDTH + STRIDE, 1), step):
        piece = data[at : at + step + WIDTH - STRIDE]
        short = max(WIDTH - len(piece), -(len(piece) - WIDTH) % STRIDE)
        yield np.frombuffer(piece + b"\0" * short, np.uint8)


@dataclass
class Model:
    """Filter weights by place and byte, their biases, and the output layer."""

    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def responses(self, b: np.ndarray) -> np.ndarray:
        """Filter responses at each place of a chunk."""
        n = (len(b) - WIDTH) // STRIDE + 1
        total = self.filters[0][b[0 : n * STRIDE : STRIDE]]
        for k in range(1, WIDTH):
            total += self.filters[k][b[k : k + (n - 1) * STRIDE + 1 : STRIDE]]
        return total

    def pooled(self, data: bytes) -> np.ndarray:
        best = None
        for b in chunks(data):
            own = self.responses(b).max(axis=0)
            best = own if best is None else np.maximum(best, own)
        return best

    def strongest(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The maxima of ``pooled``, and the bytes under each: one row of WIDTH bytes per filter."""
        best, under = None, None
        for b in chunks(data):
            own = self.responses(b)
            place = own.argmax(axis=0)
            own = own[place, np.arange(FILTERS)]
            bytes_there = b[place[:, None] * STRIDE + np.arange(WIDTH)]
            if best is None:
                best, under = own, bytes_there
            else:
                more = own > best
                best, under = np.where(more, own, best), np.where(more[:, None], bytes_there, under)
        return best, under

    def score(self, data: bytes) -> float:
        hidden = np.maximum(self.pooled(data) + self.bias, 0)
        return float(1 / (1 + np.exp(-np.clip(np.float64(hidden @ self.out) + self.out_bias, -30, 30))))


def train(texts: list[bytes], labels: list[int]) -> Model:
    """Adagrad on the log loss, the rarer label weighted up by the square root of its rarity."""
    r = np.random.default_rng(SEED)
    y = np.array(labels, dtype=np.float64)
    share = float(y.mean()) if len(y) else 0.5
    model = Model(
        (r.normal(0, 0.1, (WIDTH, 256, FILTERS))).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        (np.where(np.arange(FILTERS) % 4 == 0, 0.3, -0.3)).astype(np.float32),
        0.0,
    )
    if share in (0.0, 1.0) or not len(y):
        model.out[:] = 0
        model.out_bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return model
    weight = np.where(y == 1, share**-0.5, (1 - share) ** -0.5) * 0.5
    squares = [np.full_like(model.filters, 1e-6), np.full_like(model.bias, 1e-6), np.full_like(model.out, 1e-6)]
    bias_square = 1e-6
    for epoch in range(EPOCHS):
        order = r.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            g_filters, g_bias, g_out, g_last = np.zeros_like(model.filters), np.zeros_like(model.bias), np.zeros_like(model.out), 0.0
            for i in rows:
                found, under = model.strongest(texts[i])
                hidden = found + model.bias
                active = hidden > 0
                hidden = np.where(active, hidden, 0)
                p = 1 / (1 + np.exp(-np.clip(float(hidden @ model.out) + model.out_bias, -30, 30)))
                d = float(weight[i] * (p - y[i])) / len(rows)
                g_out += d * hidden
                g_last += d
                back = np.where(active, d * model.out, 0).astype(np.float32)
                g_bias += back
                for k in range(WIDTH):
                    np.add.at(g_filters[k], (under[:, k], np.arange(FILTERS)), back)
            for value, g, s in ((model.filters, g_filters, squares[0]), (model.bias, g_bias, squares[1]), (model.out, g_out, squares[2])):
                s += g * g
                value -= (RATE * g / np.sqrt(s)).astype(np.float32)
            bias_square += g_last * g_last
            model.out_bias -= RATE * g_last / float(np.sqrt(bias_square))
    return model


def choose(rows: DataFrame) -> list[tuple[int, int]]:
    """(h, label) of the texts to learn from, of rows (h, label, n_bytes), h being a hash of the text."""
    distinct = rows.where("label in (0, 1)").groupBy("label", "h").agg(F.max("n_bytes").alias("n_bytes")).where(F.col("n_bytes") <= TRAIN_BYTES)
    order = Window.partitionBy("label").orderBy(F.xxhash64("h", F.lit(SEED)), "h")
    # Each task keeps ROWS rows of a label before they meet.
    first = distinct.withColumn("place", F.row_number().over(order)).where(F.col("place") <= ROWS).orderBy("label", "place").collect()
    left, out = {0: TRAIN_BYTES, 1: TRAIN_BYTES}, []
    for r in first:
        left[r["label"]] -= r["n_bytes"]
        if left[r["label"]] >= 0:
            out.append((r["h"], r["label"]))
    return out


def learn(documents: DataFrame, known: DataFrame, text: str = "text") -> Model:
    """Learns from the texts of documents whose hash is in ``known``, rows of (h, label 0 or 1, n_bytes).

    Only hashes meet the labels; the few that are chosen then pick one copy of each text from a second scan.
    """
    chosen = choose(known)
    few = F.broadcast(documents.sparkSession.createDataFrame(sorted({(h,) for h, _ in chosen}), "chosen long"))
    own = documents.select(F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h")).where("text is not null")
    found = own.join(few, F.col("h") == F.col("chosen"), "left_semi").groupBy("h").agg(F.first("text").alias("text"))
    texts = {r["h"]: r["text"].encode() for r in found.collect()}
    return train([texts[h] for h, _ in chosen], [k for _, k in chosen])


def fit(rows: DataFrame, text: str = "text", label: str = "label") -> Model:
    """Learns from rows that have their label (0 or 1) with them."""
    known = rows.where(F.col(text).isNotNull())
    return learn(rows, known.select(F.xxhash64(F.col(text)).alias("h"), F.col(label).cast("int").alias("label"), F.octet_length(F.col(text)).alias("n_bytes")), text)


def predict(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, score, predicted."""
    rows = documents.select(F.col(key), F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8").alias("text"))
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            out = [own.score(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.float64()), pa.array([int(x >= THRESHOLD) for x in out], pa.int32())], names=[key, "score", "predicted"]
            )

    return map_arrow(rows, scored, f"`{key}` {rows.schema[0].dataType.simpleString()}, score double, predicted int")


def accept(documents: DataFrame, model: Model, text: str = "text", least: float = THRESHOLD) -> DataFrame:
    """The rows, all columns as they are, whose text has a score of at least ``least``."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            yield batch.filter(pa.array([own.score((x.as_py() or "").encode()) >= least for x in batch.column(place)], pa.bool_()))

    return map_arrow(documents, kept, documents.schema)
