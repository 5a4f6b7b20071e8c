"""Clusters of vectors against whole-vector rounds in plain integers."""

import hashlib
import math
import random

import duckdb
import pytest
from llm import sharded_lloyd
from llm.sharded_lloyd import lloyd, op13_sharded_lloyd, with_inertia


def plainly(rows, width, clusters, rounds, scale=64, seed="1"):
    """{(id, vector): [(cluster, distance)]} of all kept rows, and the centroids."""
    kept = []
    for vec, values in rows:
        if vec is not None and values is not None and len(values) == width and all(
                v is not None and math.isfinite(v) and abs(math.floor(v * scale)) < sharded_lloyd.LARGEST for v in values):
            kept.append((vec, tuple(math.floor(v * scale) for v in values)))
    order = sorted({(hashlib.sha256(f"{seed}:{vec}".encode()).hexdigest(), vec, x) for vec, x in kept})
    centroids = [list(x) for _, _, x in order[:clusters]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centroids))[::-1]

    for _ in range(rounds):
        chosen = [nearest(x)[0] for _, x in kept]
        for k in range(len(centroids)):
            own = [x for (_, x), c in zip(kept, chosen) if c == k]
            if own:
                centroids[k] = [sum(v) // len(own) for v in zip(*own)]
    return sorted((vec, *nearest(x)) for vec, x in kept), centroids


@pytest.mark.parametrize("width, clusters, block", [(10, 4, 4), (7, 1, 16), (5, 30, 2)])
def test_rounds_equal_plain_integers(spark, width, clusters, block):
    r = random.Random(width)
    rows = [(k, [r.choice([-1, 1, 3]) * r.random() for _ in range(width)], "x") for k in range(25)]
    rows += [(100 + k, [0.5] * width, "x") for k in range(12)]  # ties
    rows += [(200, None, "x"), (201, [], "x"), (202, [1.0] * (width + 1), "x"), (203, [1.0] * (width - 1) + [None], "x"),
             (204, [math.nan] * width, "x"), (205, [math.inf] + [0.0] * (width - 1), "x"), (206, [1e300] * width, "x"),
             (207, [2e6] * width, "x"), (None, [0.1] * width, "x"), (208, [-0.01] * width, "x")]
    rows += [rows[0]] * 2  # equal rows count one by one
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string").repartition(5)
    assigned, centroids = lloyd(frame, width=width, clusters=clusters, block=block)
    got = [tuple(x) for x in with_inertia(assigned, centroids).collect()]
    # the chosen are rows, so equal rows may start two clusters
    want, means = plainly([x[:2] for x in rows], width, clusters, 3)
    if clusters < 30:
        assert centroids.tolist() == means
        assert sorted(x[:3] for x in got) == want
    assert len(got) == len(want) and sum(x[2] for x in got) == got[0][4]
    for _, cluster, _, inertia, _, name in got:
        assert inertia == sum(x[2] for x in got if x[1] == cluster)
        assert name == hashlib.sha256(",".join(map(str, centroids[cluster].tolist())).encode()).hexdigest()


def test_no_vectors(spark):
    frame = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    for rows in (frame, frame.limit(0)):
        found = with_inertia(*lloyd(rows))
        assert found.count() == 0 and found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_all_embeddings_equal_sql_and_plain_rounds(spark, folder):
    got = sorted(map(tuple, op13_sharded_lloyd(spark, folder).collect()))
    connection = duckdb.connect()
    connection.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    assert got == sorted(connection.execute(sharded_lloyd.oracle()).fetchall())
    rows = [(x["vec_id"], x["embedding"]) for x in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert [x[:3] for x in got] == plainly(rows, 64, 16, 3)[0]
