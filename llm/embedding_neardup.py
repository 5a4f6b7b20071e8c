"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation learned on a bounded sample turns directions into balanced binary codes (principal
axes, then alternating between the nearest signs and the best rotation).  A code is cut into
chunks, each the key of one table; a chunk has about as many bits as the number of vectors needs, so
buckets do not grow.  Every vector is entered under its chunk and under all chunks one bit away, so
two vectors meet when some chunk differs in at most two bits.  Longer chunks differ more, so they come
with more tables: as many as two vectors at the threshold need to meet with a chance of ``RECALL``.  Where
vectors have too few components for that, chunks are shorter.  Those whose codes are close enough are
compared by their original vectors in double precision, and only pairs that reach the threshold link.

Equal vectors are one class from the start and are not expanded.  All vectors are indexed; the
search is approximate, with its recall measured in the tests.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import components, saved

#: Least number of tables, and the least chance that vectors at the threshold meet in one.
TABLES, RECALL = 4, 0.95
#: Bits of a code that are compared before the vectors are.
COMPARED = 128
#: Vectors the rotation is learned on, at most.
SAMPLE = 8192
ITERATIONS = 40
#: Standard deviations above the expected distance of codes at the threshold that are still compared.
SLACK = 2.5


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(1).cast(pa.list_(pa.float64()))
        values, sizes = [], column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(sizes)
        for end, size in zip(ends, sizes):
            vector = flat[end - size:end]
            # Trailing zeros say nothing: a shorter vector counts as one that zeros fill up.
            vector = vector[:np.flatnonzero(vector)[-1] + 1] if vector.any() else vector[:0]
            peak = np.abs(vector).max() if len(vector) else 0.0
            fine = len(vector) and np.isfinite(vector).all()
            # Scaled by a power of two, which is exact, so that no square overflows.
            values.append((vector * 2.0 ** -np.frexp(peak)[1]).tobytes() if fine else None)
        digests = [hashlib.blake2b(v, digest_size=16).digest() if v is not None else None for v in values]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary()), pa.array(digests, pa.binary())],
                                         ["id", "vector", "class"])


def learn_rotation(vectors: np.ndarray, bits: int, iterations: int = ITERATIONS) -> np.ndarray:
    """A matrix from unit vectors to ``bits`` numbers whose signs are the code.

    Directions are compared from the origin, so vectors are not centred.
    """
    _, axes = np.linalg.eigh(vectors.T @ vectors)
    axes = axes[:, ::-1][:, :bits]
    projected = vectors @ axes
    rotation = np.linalg.qr(np.random.default_rng(7).normal(size=(axes.shape[1], axes.shape[1])))[0]
    for _ in range(iterations):
        signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(projected.T @ signs)
        rotation = u @ v
    return axes @ rotation


def chance(chunk: int, tables: int, threshold: float) -> float:
    """The chance that vectors at the threshold have at most two different bits in some chunk; each bit
    differs as often as the angle's share of the half circle."""
    apart = math.acos(threshold) / math.pi
    one = sum(math.comb(chunk, k) * apart**k * (1 - apart) ** (chunk - k) for k in range(3))
    return 1 - (1 - min(one, 1.0)) ** tables


def allocate(total: int, width: int, threshold: float, chunk: int | None = None) -> tuple[int, int]:
    """Bits of a chunk and number of tables for so many vectors of so many components."""
    wanted = chunk or max(8, math.ceil(math.log2(max(2, total))))
    for chunk in range(min(wanted, width, 32), 1, -1):
        tables = min(TABLES, width // chunk)
        while chance(chunk, tables, threshold) < RECALL and tables * chunk <= width:
            tables += 1
        if tables * chunk <= width:
            return chunk, tables
    return 1, max(1, min(TABLES, width))


def _unit(blobs: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(blobs), width))
    for row, blob in zip(out, blobs):
        vector = np.frombuffer(blob)[:width]
        row[:len(vector)] = vector
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def _entries(matrix: np.ndarray, chunk: int, tables: int):
    schema = pa.schema([("place", pa.int64()), ("node", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])
    flips = np.concatenate([[0], 1 << np.arange(chunk)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4000):
                part = batch.slice(a, 4000)
                node = part.column("node").to_numpy()
                signs = (_unit(part.column("vector").to_pylist(), len(matrix)) @ matrix >= 0)[:, :tables * chunk]
                chunks = signs.reshape(len(node), tables, chunk) @ (1 << np.arange(chunk))
                halves = np.zeros((len(node), COMPARED), np.int64)
                halves[:, :min(COMPARED, signs.shape[1])] = signs[:, :COMPARED]
                weights = np.array([1 << k for k in range(63)] + [-(1 << 63)], np.int64)
                low, high = halves[:, :64] @ weights, halves[:, 64:] @ weights
                place = ((np.arange(tables) << chunk) | chunks)[:, :, None] ^ flips
                per = tables * len(flips)
                yield pa.RecordBatch.from_arrays([pa.array(place.ravel()), pa.array(np.repeat(node, per)),
                                                  pa.array(np.repeat(high, per)), pa.array(np.repeat(low, per))],
                                                 schema=schema)

    return run


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = []
            for a in range(0, batch.num_rows, 4000):
                part = batch.slice(a, 4000)
                pairs = list(zip(part.column("va").to_pylist(), part.column("vb").to_pylist()))
                width = max((len(x) // 8 for pair in pairs for x in pair), default=0)
                x, y = np.zeros((len(pairs), width)), np.zeros((len(pairs), width))
                for k, (one, two) in enumerate(pairs):
                    x[k, :len(one) // 8], y[k, :len(two) // 8] = np.frombuffer(one), np.frombuffer(two)
                cosine = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
                close.append(cosine >= threshold)
            keep = pa.array(np.concatenate(close) if close else np.zeros(0, bool))
            yield batch.select(["a", "b"]).filter(keep)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", column: str = "embedding",
                    sample: int = SAMPLE, chunk: int | None = None) -> DataFrame:
    """(key, n_links, component_id, kept) for every vector.

    n_links counts the other vectors at a cosine of at least ``threshold``, component_id is the
    smallest key reachable by links, kept says whether that is the vector's own.  Vectors that are
    null, zero or hold null or non-finite components link with nothing; shorter vectors count as
    filled up with zeros.  Rows without a key are left out, keys are taken to be unique, other
    columns are ignored.  ``chunk`` is the number of bits of a chunk, by default from the number of vectors.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v")).where("id is not null")
    rows = saved(rows.mapInArrow(_vectors, "id long, vector binary, class binary"), "itq-vectors")
    classes = saved(rows.where("class is not null").groupBy("class").agg(
        F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")), "itq-classes")
    total = classes.count()
    # At most ``sample`` vectors come to the driver.
    chosen = [bytes(r[0]) for r in classes.select("vector", "node").orderBy(F.xxhash64("node"), "node").limit(sample).collect()]
    width = max((len(v) // 8 for v in chosen), default=1)
    chunk, tables = allocate(total, width, threshold, chunk)
    matrix = learn_rotation(_unit(chosen, width), tables * chunk) if chosen else np.zeros((1, tables * chunk))
    bits = min(COMPARED, tables * chunk)
    apart = np.arccos(threshold) / np.pi
    limit = int(np.ceil(bits * apart + SLACK * np.sqrt(bits * apart * (1 - apart))))
    entries = saved(classes.select("node", "vector").mapInArrow(
        _entries(matrix, chunk, tables), "place long, node long, high long, low long"), "itq-entries")
    one = entries.select("place", F.col("node").alias("a"), F.col("high").alias("ha"), F.col("low").alias("la"))
    two = entries.select("place", F.col("node").alias("b"), F.col("high").alias("hb"), F.col("low").alias("lb"))
    near = F.expr(f"bit_count(la ^ lb) + bit_count(ha ^ hb) <= {limit}")
    pairs = one.join(two, "place").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    left = classes.select(F.col("node").alias("a"), F.col("vector").alias("va"))
    right = classes.select(F.col("node").alias("b"), F.col("vector").alias("vb"))
    links = saved(pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(
        _similar(threshold), "a long, b long"), "itq-links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(classes.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(
        F.sum("copies").alias("others"))
    found = classes.select("class", "node", "copies").join(degree, "node", "left").join(
        components(links, "itq-components"), "node", "left").select(
        "class", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"))
    return rows.select("id", "class").join(found, "class", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        (F.coalesce("component_id", "id") == F.col("id")).alias("kept"))


def op6_embedding_neardup(spark, folder: str) -> DataFrame:
    """Near-duplicate classes of all embeddings at a cosine of 0.9."""
    return near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"))
