"""Quality classifier: supervised embeddings of hashed words and character n-grams.

A text's features are its words, its pairs of neighbouring words (a word followed by
itself is one feature of its own) and its runs of four bytes, each hashed to a row of one
table of learned vectors. The vectors of a text are averaged, a linear layer and a softmax
give the label's probability, and plain stochastic gradient descent in numpy learns both.

Fitting is bounded: it takes at most `most` labelled rows, those with the smallest hash of
their id, whose features come to the driver. Scoring covers every whole text, in the task
that reads it: as the model is linear behind the average, one number per table row is enough.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starcell.llm.shared import _BYTE_KEYS, MIX_A, gram_hashes, mixed, row_blocks, run_hashes, text_bytes, words_of

ROWS = 1 << 18
WIDTH = 16
BYTES = 4
MOST_LABELLED = 4000
EPOCHS = 8
RATE = 2.0

_SAME = mixed(np.array([77], np.uint64))[0]
_PAIR, _RUN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x2545F4914F6CDD1D)


def features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all features of consecutive texts, and the text each belongs to."""
    first, last, owner = words_of(data, starts)
    words = run_hashes(data, first, last)
    pairs = gram_hashes(words, 2)
    pairs = np.where(words[:-1] == words[1:], _SAME, pairs ^ _PAIR) if len(pairs) else pairs
    inside = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) else owner
    runs = gram_hashes(_BYTE_KEYS[data], BYTES) ^ _RUN
    text_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    whole = np.flatnonzero(text_of[:len(runs)] == text_of[BYTES - 1:]) if len(runs) else np.zeros(0, int)
    keys = np.concatenate((words, pairs[inside], runs[whole]))
    return ((keys * MIX_A) >> np.uint64(64 - 18)).astype(np.int64), \
        np.concatenate((owner, owner[inside], text_of[whole]))


@dataclass
class Model:
    vectors: np.ndarray     # ROWS x WIDTH
    layer: np.ndarray       # 2 x WIDTH
    bias: np.ndarray        # 2

    def row_values(self) -> np.ndarray:
        return self.vectors @ (self.layer[1] - self.layer[0])

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, vectors=self.vectors, layer=self.layer, bias=self.bias)
        return out.getvalue()

    @staticmethod
    def from_bytes(held: bytes) -> Model:
        with np.load(io.BytesIO(held)) as parts:
            return Model(parts["vectors"], parts["layer"], parts["bias"])


def descend(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS,
            rate: float = RATE, seed: int = 0) -> Model:
    """Learn from texts, each its distinct table rows and their shares, by one text per step."""
    random = np.random.default_rng(seed)
    model = Model((random.random((ROWS, WIDTH), np.float32) - 0.5) / WIDTH,
                  np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32))
    # A text without features teaches the bias alone: what is known of all texts.
    steps, total = 0, max(1, epochs * len(texts))
    for _ in range(epochs):
        for i in random.permutation(len(texts)):
            rows, shares = texts[i]
            pace = rate * (1 - steps / total)
            steps += 1
            held = model.vectors[rows]
            mean = shares @ held
            z = model.layer @ mean + model.bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[labels[i]] -= 1
            back = error @ model.layer
            model.layer -= pace * np.outer(error, mean)
            model.bias -= 0.01 * pace * error
            model.vectors[rows] = held - pace * len(rows) ** 0.5 * shares[:, None] * back
    return model


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = text_bytes(batch.column("text"))
        out_rows, out_shares = [], []
        for i in range(len(starts) - 1):
            rows, _ = features(data[starts[i]:starts[i + 1]], np.array([0, starts[i + 1] - starts[i]]))
            rows, counts = np.unique(rows, return_counts=True)
            out_rows.append(rows.astype("<u4").tobytes())
            out_shares.append((counts / max(1, counts.sum())).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array(out_rows, pa.binary()), pa.array(out_shares, pa.binary())],
            ["label", "rows", "shares"])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, epochs: int = EPOCHS,
        rate: float = RATE) -> Model:
    """A model from `docs` (doc_id, text) and `labels` (doc_id, label 0 or 1).

    Labels of one id are averaged; null ids and labels are left out. At most `most` ids are
    used, which bounds the broadcast and what comes to the driver. Without labelled
    documents the model gives 0.5 for every text.
    """
    chosen = (labels.where("doc_id is not null and label is not null")
              .groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    held = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
            .mapInArrow(lambda b: _text_rows(b), "label int, rows binary, shares binary"))
    found = sorted(held.toPandas().itertuples(index=False), key=lambda r: (r.label, r.rows))
    return descend([(np.frombuffer(r.rows, "<u4").astype(np.int64), np.frombuffer(r.shares, "<f4"))
                    for r in found], np.array([r.label for r in found], int), epochs, rate)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Adds `score` (0 to 1, of label 1) and `predicted` (1 from `threshold` on) to rows with a `text`.

    A null or empty text has no features; its score is that of the bias. Rows are scored
    one by one, so repeated rows score alike and an empty table gives an empty one; columns
    of the input with the added names are replaced, and no other column is looked at.
    """
    values = model.row_values().astype(np.float64)
    bias = float(model.bias[1] - model.bias[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            z = [np.zeros(0)]
            for i, j in row_blocks(starts):
                rows, owner = features(data[starts[i]:starts[j]], starts[i:j + 1] - starts[i])
                sums = np.bincount(owner, values[rows], j - i) if len(rows) else np.zeros(j - i)
                z.append(sums / np.maximum(1, np.bincount(owner, minlength=j - i)) + bias)
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(z), -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                [*batch.schema.names, "score", "predicted"])

    docs = docs.drop("score", "predicted")
    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add("score", "double").add("predicted", "integer"))
