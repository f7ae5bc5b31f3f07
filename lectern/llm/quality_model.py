"""A quality classifier on supervised subword embeddings.

Words, pairs of words and character n-grams are hashed into one table of learned vectors; a document is the average of
its features' vectors, a softmax layer turns the average into class probabilities, and both are trained by stochastic gradient
descent in numpy. A word equal to the one before it also counts as a repetition feature, whatever the word. Features are computed
over bytes by polynomial hashes, vectorised, and over whole texts. As the layer is linear, a trained table folds into one number
a bucket, and a document's score is an average of these numbers.

It is trained on a bounded sample of labelled rows: the SAMPLE rows with the smallest hash of their id, in one task; what is broadcast is the folded table,
of a fixed size. Only text is an input of a score.

Results: a null text counts as empty; a text without features scores by the bias alone, which is the share of label 1 in the sample. If no labelled row can be
learned from, every score is 0.5. Unlabelled rows and null labels teach nothing; a row labelled twice teaches twice. Rows with equal ids are scored each for
itself, very long texts in whole; no ties arise, and an empty table gives an empty one; other columns are ignored or pass through keep_good.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, fold, labelled, prepare

#: Labelled rows that are learned from at most, buckets of the table, length of a vector, rounds over the sample, step.
SAMPLE, BUCKETS_LOG2, DIM, EPOCHS, STEP = 4000, 18, 8, 6, 4.0

GRAMS = (2, 3, 4)
MULTIPLIER = np.uint32(0x9E3779B1)
_BASE = np.uint32(0x01000193)
_POWERS = np.cumprod(np.full(64, _BASE, np.uint32), dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True


def features(raw: bytes, log2: int = BUCKETS_LOG2) -> np.ndarray:
    """The buckets of all features of a text, with repeats."""
    b = np.frombuffer(b" " + raw + b" ", np.uint8)
    blank = _SPACE[b]
    b = np.where(blank, np.uint8(32), b).astype(np.uint32)
    out = []
    h = b
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * _BASE + b[n - 1 :]
        if n in GRAMS:
            out.append(h + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF))
    begins = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    if len(begins):
        run = np.arange(len(b)) - np.repeat(np.append(0, begins), np.diff(np.concatenate(([0], begins, [len(b)]))))
        value = np.where(blank, np.uint32(0), (b + np.uint32(1)) * _POWERS[run & 63])
        w = np.add.reduceat(value, begins, dtype=np.uint32)
        out += [w * np.uint32(0xC2B2AE35), w[:-1] * np.uint32(0x27D4EB2F) + w[1:], np.full(int((w[1:] == w[:-1]).sum()), 0x51ED270B, np.uint32)]
    return (np.concatenate(out) * MULTIPLIER) >> np.uint32(32 - log2)


def train(examples: list[tuple[bytes, int]], log2: int = BUCKETS_LOG2, dim: int = DIM, epochs: int = EPOCHS, step: float = STEP, seed: int = 7) -> tuple[np.ndarray, float]:
    """The folded table and the bias: a text's log odds of label 1 are the bias plus the table's average over its features."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << log2, dim)).astype(np.float32)
    layer = rng.uniform(-0.5, 0.5, (2, dim)).astype(np.float32)
    rows = []
    for raw, label in examples:
        at, n = np.unique(features(raw, log2), return_counts=True)
        rows.append((at, (n / max(1, n.sum())).astype(np.float32), int(label)))
    share = (sum(r[2] for r in rows) + 1) / (len(rows) + 2)
    bias = float(np.log(share / (1 - share)))
    total, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, weight, label = rows[k]
            own = vectors[at]
            hidden = weight @ own
            logits = layer @ hidden + np.array([0, bias], np.float32)
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            rate = np.float32(step * (1 - done / total))
            back = layer.T @ p
            layer -= rate * 0.1 * np.outer(p, hidden)
            vectors[at] = own - np.outer(rate * weight * min(400.0, len(at)), back)
            done += 1
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), bias


def score(raw: bytes, table: np.ndarray, bias: float) -> float:
    at = features(raw, len(table).bit_length() - 1)
    z = bias + (float(table[at].mean(dtype=np.float64)) if len(at) else 0.0)
    return float(1 / (1 + np.exp(-max(-60.0, min(60.0, z)))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", usable=lambda doc_id: fold(doc_id, 5) != 0, sample: int = SAMPLE) -> tuple[np.ndarray, float] | None:
    """Trains in one task on at most sample rows and returns the model, of a fixed size."""
    prepare(docs.sparkSession)

    def run(batches):
        rows = [(("" if t is None else t).encode(), y) for batch in batches for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        if rows:
            table, bias = train(rows)
            yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()]), pa.array([bias])], schema=arrow_schema("weights binary, bias double"))

    found = labelled(docs, labels, label, usable, sample).select("text", "label").repartition(1).mapInArrow(run, "weights binary, bias double").collect()
    return (np.frombuffer(bytes(found[0][0]), np.float32), found[0][1]) if found else None


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def apply_model(docs: DataFrame, model, threshold: float = 0.3) -> DataFrame:
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        schema, model = arrow_schema(SCORED), sent.value
        for batch in batches:
            scores = [score((x or "").encode(), *model) if model else 0.5 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")).mapInArrow(run, SCORED)


def keep_good(docs: DataFrame, model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores at least the threshold, all columns unchanged."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            yield batch.filter(pa.array([model is None or score((x or "").encode(), *model) >= threshold for x in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
