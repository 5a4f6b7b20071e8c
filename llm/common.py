"""Helpers of the operators: the shared folder, vectorised words and hashes, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word rules: space and the controls 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: The same as a character class for Spark's regular expressions.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"

#: Text is hashed in chunks of about so many bytes, which bounds a task's memory.
CHUNK_BYTES = 2 << 20

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = {"byte": 0x9E3779B97F4A7C55, "word": 0xD1342543DE82EF95}
_LOCAL: dict[str, str] = {}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master without that setting gets a temporary folder of its own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="llm-shared-")
        _LOCAL[spark.sparkContext.applicationId] = where
    return where.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(frame: DataFrame, name: str) -> DataFrame:
    """The rows of ``frame`` as a table in the shared folder: cuts lineage and survives lost executors."""
    folder = fresh_folder(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def lean(run: Callable) -> Callable:
    """``run`` of mapInArrow, after which freed memory goes back to the system.

    Workers live on between tasks and stages; otherwise each would keep the most that any of its tasks took.
    """

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def _powers(kind: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if kind not in _POWERS or len(_POWERS[kind][0]) < size:
        base = _BASE[kind]
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[:1] = down[:1] = 1
        _POWERS[kind] = np.cumprod(up), np.cumprod(down)
    return _POWERS[kind][0][:size], _POWERS[kind][1][:size]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def _sums(values: np.ndarray, kind: str) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(kind, len(values))[0], out=sums[1:])
    return sums


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str = "word") -> np.ndarray:
    """A hash of each run values[start:end], equal for equal runs wherever they stand."""
    sums, inverse = _sums(values, kind), _powers(kind, len(values) + 1)[1]
    raw = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n values from each position on; n - 1 fewer than values."""
    starts = np.arange(max(0, len(values) - n + 1))
    return ranges_hash(values, starts, starts + n)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = CHUNK_BYTES, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, or of one row; of at most ``rows`` rows if given."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = max(first + 1, min(last, len(offsets) - 1, first + (rows or len(offsets))))
        yield first, last
        first = last


def _scan(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~SPACE[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, ranges_hash(_BYTE[data], starts, ends, "byte")


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and hashes of the words of some rows, and each row's first word (one more at the end).

    A row longer than the chunk is hashed in pieces that end in white space, with the same hashes.
    """
    if len(data) <= 2 * CHUNK_BYTES:
        found = [_scan(data, offsets)] if len(data) else []
    else:
        found, at = [], 0
        blanks = np.flatnonzero(SPACE[data])
        while at < len(data):
            stop = at + CHUNK_BYTES
            if stop < len(data):
                k = np.searchsorted(blanks, stop)
                stop = int(blanks[k]) + 1 if k < len(blanks) else len(data)
            stop = min(stop, len(data))
            starts, ends, hashes = _scan(data[at:stop], offsets[(offsets > at) & (offsets < stop)] - at)
            found.append((starts + at, ends + at, hashes))
            at = stop
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends, hashes = (np.concatenate(x) for x in zip(*found))
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def as_signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of an undirected graph given as rows (a, b); component is the smallest node reachable.

    Large-star and small-star steps alternate until the edges no longer change.  All steps
    aggregate and join by node; a node with very many edges is an aggregate that combines
    before the shuffle and a join that adaptive execution splits.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = saved(edges, name), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = saved(edges, name)
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
