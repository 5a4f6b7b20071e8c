"""Toxicity scores: logistic regression on hashed word n-grams and skip-grams, learned with FTRL-proximal.

A text's features are its distinct words, pairs of neighbours and pairs that skip one or two words,
hashed into 2**BITS places.  Words are runs of letters and digits with A-Z in lower case; everything
else ASCII separates.  FTRL-proximal keeps a learning rate for each place and an L1 term that leaves
most weights at zero, so the model is a short list that every task can hold.

The classifier is fitted on at most ``sample`` labelled rows, those with the smallest hash of the
id; all other work is on all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import lean, mix, row_slices, strings, words

BITS = 20
#: Labelled rows the classifier is fitted on, at most.
SAMPLE = 16_000
#: Distances of the second word of a pair.
GAPS = (1, 2, 3)

_BYTES = np.full(256, 32, np.uint8)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _BYTES[_low:_high] = np.arange(_low, _high)
_BYTES[65:91] += 32


@dataclass(frozen=True)
class Model:
    """Places with a weight, their weights and the intercept."""

    places: np.ndarray
    weights: np.ndarray
    intercept: float


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each feature of some rows, repeats included."""
    _, _, hashes, first = words(_BYTES[data], offsets)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rows, places = [row], [hashes]
    for gap in GAPS:
        if len(hashes) > gap:
            same = row[gap:] == row[:-gap]
            pair = mix(hashes[:-gap][same] * np.uint64(0x9E3779B97F4A7C15) + hashes[gap:][same] + np.uint64(gap))
            rows.append(row[:-gap][same])
            places.append(pair)
    return np.concatenate(rows), (np.concatenate(places) >> np.uint64(64 - BITS)).astype(np.int64)


@lean
def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("order", pa.int64()), ("label", pa.int32()), ("places", pa.binary())])
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        for a, b in row_slices(offsets):
            row, place = features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            packed = np.unique((row << BITS) | place)
            bounds = np.searchsorted(packed, np.arange(b - a + 1) << BITS)
            places = (packed & ((1 << BITS) - 1)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([
                batch.column("order").slice(a, b - a), batch.column("label").slice(a, b - a).cast(pa.int32()),
                pa.array([places[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])], pa.binary())], schema=schema)


def fit_ftrl(examples: list[tuple[np.ndarray, int]], alpha: float = 0.5, beta: float = 1.0, l1: float = 8.0,
             l2: float = 0.1, epochs: int = 4) -> Model:
    """FTRL-proximal over examples (distinct places, label); the intercept is not penalised.

    The penalty is the same at every size; held out, 8 was as good as or better than 1.5 to 12 from 300 to 7,000 examples.
    """
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    z0 = n0 = 0.0

    def weight(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for places, label in examples:
            zi, ni = z[places], n[places]
            w = weight(zi, ni, l1)
            w0 = -z0 / ((beta + np.sqrt(n0)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -30, 30)))
            g = p - label
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[places] = zi + g - step * w
            n[places] = ni + g * g
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / alpha * w0
            n0 += g * g
    weights = weight(z, n, l1)
    places = np.flatnonzero(weights)
    return Model(places, weights[places], float(-z0 / ((beta + np.sqrt(n0)) / alpha)))


@lean
def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples = [(np.frombuffer(p.as_buffer(), np.uint32).astype(np.int64), label)
                for batch in batches for p, label in zip(batch.column("places"), batch.column("label").to_pylist())]
    model = fit_ftrl(examples)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(model.places, -1)), pa.array(np.append(model.weights, model.intercept))], ["place", "weight"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc: str = "doc_id", text: str = "text",
          label: str = "toxic") -> Model:
    """A model of ``label`` from the labelled texts.

    Labels that are null and labels without a document are left out; a document with several labels
    counts with the highest.  Without any example every score is 0.5.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull()).groupBy(F.col(doc).cast("long").alias("doc")).agg(
        F.max(label).cast("int").alias("label"))
    ids = docs.select(F.col(doc).cast("long").alias("doc"))
    chosen = known.join(ids, "doc", "semi").select(F.xxhash64("doc").alias("order"), "doc", "label").orderBy(
        "order", "doc").limit(sample)
    texts = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    # At most ``sample`` rows of three numbers.
    rows = texts.join(F.broadcast(chosen), "doc").select("order", "label", "text").mapInArrow(
        _examples, "order long, label int, places binary")
    found = rows.repartition(1).sortWithinPartitions("order", "label").mapInArrow(_fit, "place long, weight double").collect()
    places, weights = np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found])
    real = places >= 0
    return Model(places[real], weights[real], float(weights[~real][0]) if len(places) else 0.0)


def score(docs: DataFrame, model: Model, column: str = "score", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and their scores from 0 to 1 in ``column``; a null text counts as empty.

    A column of that name is replaced.
    """
    docs = docs.drop(column)
    # The model has at most 2**BITS places.
    shared = docs.sparkSession.sparkContext.broadcast((model.places, model.weights, model.intercept))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, weights, intercept = shared.value
        dense = np.zeros(1 << BITS)
        dense[places] = weights
        for batch in batches:
            data, offsets = strings(batch.column(at))
            scores = []
            for a, b in row_slices(offsets):
                row, place = features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                used = dense[place] != 0
                packed = np.unique((row[used] << BITS) | place[used])
                total = np.bincount(packed >> BITS, dense[packed & ((1 << BITS) - 1)], b - a) + intercept
                scores.append(1 / (1 + np.exp(-np.clip(total, -700, 700))))
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, column])

    schema = ", ".join([f"`{c}` {kind}" for c, kind in docs.dtypes] + [f"`{column}` double"])
    return docs.mapInArrow(lean(run), schema)


def held_out(doc: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(doc).cast("string")) % 4 == 2


def scored_documents(docs: DataFrame, labels: DataFrame, column: str = "score") -> DataFrame:
    """Scores of ``docs`` by a model of the labels outside the held-out rows."""
    return score(docs, train(docs, labels.where(~held_out())), column)


THRESHOLD = 0.3


def op8_toxicity(spark, folder: str) -> DataFrame:
    """Toxicity of all documents; rows with a held-out id take no part in learning."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return scored_documents(docs.select("doc_id", "text"), labels).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
