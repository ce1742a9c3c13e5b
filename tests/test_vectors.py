"""Tiles give what the scalar form and a plain loop give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.operators import clustering as cl


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(0, 1, (260, 5)), 2)
    x[200:] = x[:60]
    labels = np.concatenate([rng.integers(0, 11, 258), [50, 51]])
    df = spark.createDataFrame([(i, [float(a) for a in v], int(c)) for i, (v, c) in enumerate(zip(x, labels))],
                               "vec_id long, embedding array<float>, label int").repartition(4)
    return df, x.astype(np.float32).astype(float), labels


def test_nearest(vectors):
    df, x, labels = vectors
    cents = cl.centroids(df)
    one = {r.vec_id: (r.nearest, round(r.distance, 9)) for r in cl.assign_nearest(df, cents).collect()}
    for size in (40, 130, 400):
        tiled = cl.assign_nearest(df, cents, tile_bytes=size)
        assert tiled.columns == ["vec_id", "embedding", "label", "nearest", "distance"]
        assert {r.vec_id: (r.nearest, round(r.distance, 9)) for r in tiled.collect()} == one


def test_nearest_of_twenty_thousand(spark):
    """More centroids than fit one row: every vector finds its own, ties go to the smallest label."""
    cents = spark.range(20_000).select((F.col("id") * 3).cast("int").alias("label"), F.array(
        (F.col("id") % 200).cast("double"), F.floor(F.col("id") / 200).cast("double"), *(F.lit(0.0),) * 40).alias("v"))
    flat = cents.select("label", F.posexplode("v").alias("pos", "value"))
    df = cents.where("label % 30 = 0").select(F.col("label").alias("want"), F.transform("v", lambda x, i: F.when(i == 0, x + 0.5).otherwise(x)).alias("embedding"))
    got = cl.assign_nearest(df, flat).collect()
    assert len(got) == 2000 and all(r.nearest == r.want and r.distance == 0.5 for r in got)


def test_squared_silhouette(vectors):
    df, _, _ = vectors
    one = {r.vec_id: round(r.silhouette, 9) for r in cl.silhouette_rows(df).collect()}
    for size in (40, 200):
        assert {r.vec_id: round(r.silhouette, 9) for r in cl.silhouette_rows(df, tile_bytes=size).collect()} == one


@pytest.mark.parametrize("size", [4 << 20, 100])
def test_euclidean_silhouette(vectors, size):
    from ticketloom.operators.vectors import euclidean_silhouettes

    df, x, labels = vectors
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    got = {r.vec_id: r.silhouette for r in euclidean_silhouettes(df, "vec_id", "label", "embedding", F.col("vec_id") % 10 >= 8, size).collect()}
    assert set(got) == {i for i in range(260) if i % 10 >= 8}
    for i, s in got.items():
        mean = {c: d[i, labels == c].sum() / max((labels == c).sum() - (c == labels[i]), 1) for c in set(labels.tolist())}
        a, b = mean.pop(labels[i]), min(mean.values())
        want = 0.0 if (labels == labels[i]).sum() == 1 else (b - a) / max(a, b)
        assert s == pytest.approx(want, abs=1e-7)
