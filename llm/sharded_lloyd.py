"""Centroid clustering of vectors cut by dimensions: Lloyd's rounds over column blocks.

Vectors become integers and are written once, each block of ``BLOCK`` components as a table of its own.
In a round the tasks of a block add up the exact squared differences between their slice of a vector and
the same slice of every centroid; the blocks' partial distances are added by vector, which gives the
nearest centroid, and each block joins that choice to its own slices and takes the means of its own
components.  Only sums over clusters (clusters x components numbers) come to the driver; no task sees
whole vectors.

All arithmetic is on integers and exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import fresh_folder, saved

#: Components of a block.
BLOCK = 16
#: Integers from here on are refused: squares of differences of 64 such components still fit 64 bits.
LARGEST = 1 << 27


def _integers(width: int, scale: float, block: int):
    """Rows (row, vec, digest, block, x0, x1, ...) of the vectors that are kept; the last block may be narrower."""
    names = ["row", "vec", "digest", "block", *(f"x{k}" for k in range(block))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            column = batch.column(1).cast(pa.list_(pa.float64()))
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            take = np.flatnonzero(sizes == width)
            flat = column.take(pa.array(take)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(flat * scale)
                fine = (np.isfinite(flat) & (np.abs(scaled) < LARGEST)).all(1)
            take, whole = take[fine], scaled[fine].astype(np.int32)
            row = base + seen + np.arange(len(take))
            seen += len(take)
            vec = batch.column(0).take(pa.array(take)).cast(pa.int64())
            digest = pa.array([int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8).digest(), "big", signed=True) for v in whole],
                              pa.int64())
            for k in range(0, width, block):
                part = whole[:, k:k + block]
                slices = [pa.array(part[:, j]) if j < part.shape[1] else pa.nulls(len(part), pa.int32()) for j in range(block)]
                yield pa.RecordBatch.from_arrays([pa.array(row), vec, digest, pa.array(np.full(len(part), k // block, np.int32)), *slices],
                                                 names)

    return run


def shards(vectors: DataFrame, width: int, scale: float, block: int, key: str, column: str) -> list[DataFrame]:
    """A table (row, vec, digest, x0, ...) for each block of components; row is unique."""
    spark, folder = vectors.sparkSession, fresh_folder(vectors.sparkSession, "lloyd-shards")
    schema = "row long, vec long, digest long, block int, " + ", ".join(f"x{k} int" for k in range(block))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v")).where("id is not null")
    rows.mapInArrow(_integers(width, scale, block), schema).write.partitionBy("block").parquet(folder)
    whole = spark.read.schema(schema).parquet(folder)
    return [whole.where(F.col("block") == k).select("row", "vec", "digest", *(f"x{j}" for j in range(min(block, width - k * block))))
            for k in range(-(-width // block))]


def _partial(slices: np.ndarray):
    """Squared distances between a block's slices and the centroids' slices."""
    names = ["row", "vec", *(f"d{k}" for k in range(len(slices)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.stack([batch.column(j).to_numpy() for j in range(2, batch.num_columns)], 1).astype(np.int64)
            sums = [((own - centroid) ** 2).sum(1) for centroid in slices]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, sums)], names)

    return run


def assign(blocks: list[DataFrame], centroids: np.ndarray, block: int) -> DataFrame:
    """(row, vec, cluster, distance) for every vector: the nearest centroid, the smaller number among equals."""
    distances = [f"d{k}" for k in range(len(centroids))]
    schema = ", ".join(["row long", "vec long", *(f"{d} long" for d in distances)])
    parts = [b.drop("digest").mapInArrow(_partial(centroids[:, k * block:(k + 1) * block]), schema) for k, b in enumerate(blocks)]
    sums = reduce(DataFrame.unionByName, parts).groupBy("row", "vec").agg(*(F.sum(d).alias(d) for d in distances))
    least = F.least(*distances) if len(distances) > 1 else F.col("d0")
    return sums.select("row", "vec", least.alias("distance"), F.array(*distances).alias("all")).select(
        "row", "vec", (F.array_position("all", F.col("distance")) - 1).cast("int").alias("cluster"), "distance")


def update(blocks: list[DataFrame], assigned: DataFrame, centroids: np.ndarray, block: int) -> np.ndarray:
    """Centroids moved to the floored means of their vectors, block by block; a centroid without vectors stays."""
    parts = []
    for k, slices in enumerate(blocks):
        own = slices.columns[3:]
        sums = slices.join(assigned.select("row", "cluster"), "row").groupBy("cluster").agg(
            F.count(F.lit(1)).alias("n"), F.array(*(F.sum(x) for x in own)).alias("sums"))
        parts.append(sums.select(F.lit(k).alias("block"), "cluster", "n", "sums"))
    moved = centroids.copy()
    # A row for each block and cluster.
    for k, cluster, n, sums in reduce(DataFrame.unionByName, parts).collect():
        moved[cluster, k * block:k * block + len(sums)] = [s // n for s in sums]
    return moved


def first_centroids(blocks: list[DataFrame], clusters: int, seed: str) -> np.ndarray:
    """The vectors with the smallest SHA-256 of the seed and the id; equal ids are ordered by a hash of the vector."""
    chosen = blocks[0].select("row", "digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec").cast("string")), 256).alias("order"))
    rows = [r[0] for r in chosen.orderBy("order", "digest", "row").limit(clusters).collect()]
    # As many rows as clusters from each block.
    found = [{r[0]: r[3:] for r in b.where(F.col("row").isin(rows)).collect()} for b in blocks] if rows else []
    return np.array([[x for part in found for x in part[r]] for r in rows], np.int64)


def lloyd(vectors: DataFrame, width: int = 64, clusters: int = 16, rounds: int = 3, scale: float = 64.0, seed: str = "1",
          block: int = BLOCK, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(row, vec, cluster, distance) for every vector that is kept, and the centroids.

    Vectors with another number of components than ``width``, with null or non-finite components or with
    components of 2**27 / scale or more are left out, as are rows without a key; other columns are
    ignored.  Equal rows count one by one.  With fewer vectors than clusters each vector starts one;
    without any there are no rows.
    """
    spark = vectors.sparkSession
    blocks = shards(vectors, width, scale, block, key, column)
    centroids = first_centroids(blocks, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], "row long, vec long, cluster int, distance long"), np.zeros((0, width), np.int64)
    for _ in range(rounds):
        assigned = saved(assign(blocks, centroids, block), "lloyd-assigned")
        centroids = update(blocks, assigned, centroids, block)
    return saved(assign(blocks, centroids, block), "lloyd-assigned"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray, key: str = "vec_id") -> DataFrame:
    """(key, cluster, distance) with the inertia of the cluster and of all, and the checksum of the centroid."""
    sums = {r[0]: r[1] for r in assigned.groupBy("cluster").agg(F.sum("distance")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(k, sums[k], sum(sums.values()), names[k]) for k in sums]
    # A row for each cluster.
    clusters = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(clusters), "cluster").select(
        F.col("vec").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_sharded_lloyd(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters, distances and inertia of all embeddings of 64 components after three rounds from 16 centroids."""
    return with_inertia(*lloyd(spark.read.parquet(f"{folder}/embeddings.parquet")))


def oracle(rounds: int = 3) -> str:
    """The same in DuckDB."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT row, cluster, distance FROM (
            SELECT row, cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance FROM v JOIN c{k} c USING (dim) GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT c.cluster, c.dim, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (
                SELECT cluster, dim, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
                FROM v JOIN a{k} USING (row) GROUP BY ALL) m ON c.cluster = m.cluster AND c.dim = m.dim)""")
    return f"""WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, embedding FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) = 64
          AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE) AND abs(floor(64 * x::DOUBLE)) < {LARGEST})) = 64),
      v AS MATERIALIZED (SELECT row, unnest(range(64)) AS dim, floor(64 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM e),
      s AS MATERIALIZED (SELECT row, (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INTEGER AS cluster FROM e
        QUALIFY cluster < 16),
      c0 AS MATERIALIZED (SELECT cluster, dim, x FROM s JOIN v USING (row)),
      {", ".join(steps)},
      h AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
      SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
        (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
      FROM a{rounds} JOIN e USING (row) JOIN h USING (cluster)"""
