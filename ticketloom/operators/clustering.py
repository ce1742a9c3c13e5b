"""K-Means and arithmetic on clusters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame, Window, functions as F

from ticketloom.config import Config
from ticketloom.operators import kmeans as km
from ticketloom.operators.ranking import top_n
from ticketloom.operators.vectors import TILE_BYTES, euclidean_silhouettes, nearest_by_tiles, silhouettes_by_tiles
from ticketloom.session import materialize


def choose_k(n: int, cfg: Config = Config()) -> int:
    """Clusters by number of tickets."""
    most = min(cfg.max_clusters, n // cfg.min_cluster_size)
    if most < 2:
        return 2
    wanted = 25 if n > 3000 else 15 if n > 1000 else 10
    return min(wanted, most)


def initial_k(n: int, most: int = 30, min_size: int = 20) -> int:
    """Clusters the analyzer starts from; never below two."""
    return max(2, min(most, n // min_size))


def fit_kmeans(
    features: DataFrame, k: int, seed: int = 42, restarts: int = 10, max_iter: int = 300
) -> KMeansModel | km.Start:
    """K-Means of least cost over several seeds; the first of equals.

    One start is Spark's own estimator, which reads ``features`` once per iteration. Several
    starts advance together, in as many readings as the slowest of them needs.
    """
    if restarts == 1:
        return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features").fit(features)
    _, starts, _ = km.fit(features, [k], range(seed, seed + restarts), max_iter)
    return min(starts, key=lambda s: s.cost)


def sweep_k(
    features: DataFrame, ks: Iterable[int], seed: int = 42, restarts: int = 10, max_iter: int = 300
) -> DataFrame:
    """Cost and silhouette of the best start for each k; all starts of all k share their readings."""
    rows, starts, _ = km.fit(features, list(ks), range(seed, seed + restarts), max_iter)
    best = [min(starts[i:i + restarts], key=lambda s: s.cost) for i in range(0, len(starts), restarts)]
    table = [(k, float(s.cost), x) for k, s, x in zip(ks, best, km.silhouettes(rows, best))]
    return features.sparkSession.createDataFrame(table, "k int, inertia double, silhouette double")


def sweep_range(n: int, cfg: Config = Config()) -> range:
    """The k values a sweep covers: 2 to the largest k, at most 29."""
    most = min(cfg.max_clusters, n // cfg.min_cluster_size)
    return range(2, min(most + 1, 30))


def silhouette(predicted: DataFrame) -> float:
    """Silhouette on squared distances, zero when there is one cluster."""
    if predicted.select("prediction").distinct().limit(2).count() < 2:
        return 0.0
    return ClusteringEvaluator(featuresCol="features", predictionCol="prediction").evaluate(predicted)


def cluster_sizes(df: DataFrame, cluster: str = "prediction") -> DataFrame:
    """Tickets per cluster."""
    return df.groupBy(cluster).agg(F.count("*").alias("size"))


def size_summary(df: DataFrame, cluster: str = "prediction") -> DataFrame:
    """Number of clusters and largest size."""
    return cluster_sizes(df, cluster).agg(
        F.count("*").alias("n_clusters"), F.max("size").alias("largest_cluster_size")
    )


# -- dense vectors as arrays ---------------------------------------------------

def centroids(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean of each position per cluster: (label, pos, value).

    Partial sums are made per task, so a hot cluster shuffles as little as a small one.
    """
    flat = df.select(F.col(label).alias("label"), F.posexplode(vector).alias("pos", "x"))
    return flat.groupBy("label", "pos").agg(F.avg("x").alias("value"))


def term_centroids(weights: DataFrame, clusters: DataFrame, doc: str, cluster: str = "cluster") -> DataFrame:
    """Mean weight per cluster and term from the long table: (label, term, value).

    Documents that lack the term count as zero.  Weights that carry the cluster are not
    joined.
    """
    sizes = clusters.groupBy(cluster).agg(F.count("*").alias("_n"))
    if cluster not in weights.columns:
        weights = weights.join(clusters, doc)
    sums = weights.groupBy(cluster, "term").agg(F.sum("weight").alias("_s"))
    return sums.join(sizes, cluster).select(
        F.col(cluster).alias("label"), "term", (F.col("_s") / F.col("_n")).alias("value")
    )


def centroid_top_terms(cents: DataFrame, n: int = 15) -> DataFrame:
    """Heaviest terms per centroid, with their share of the heaviest."""
    ranked = top_n(cents, ["label"], [F.desc("value"), F.asc("term")], n)
    top = F.max("value").over(Window.partitionBy("label"))
    return ranked.select("label", "rank", "term", "value", (F.col("value") / top).alias("share"))


def centroid_distances(cents: DataFrame) -> DataFrame:
    """Distance of each pair of centroids.

    Pairs meet on the position, and there are at most as many as cluster pairs.
    """
    a = cents.select(F.col("label").alias("a"), "pos", F.col("value").alias("va"))
    b = cents.select(F.col("label").alias("b"), "pos", F.col("value").alias("vb"))
    d = F.col("va") - F.col("vb")
    return (
        a.join(b, (a["pos"] == b["pos"]) & (F.col("a") < F.col("b")))
        .groupBy("a", "b")
        .agg(F.sqrt(F.sum(d * d)).alias("distance"))
    )


def distance_summary(distances: DataFrame) -> DataFrame:
    """Nearest and farthest pair and the mean distance."""
    pair = F.concat_ws("-", "a", "b")
    return distances.agg(
        F.min_by(pair, F.struct("distance", "a", "b")).alias("nearest"),
        F.min("distance").alias("min_distance"),
        F.min_by(pair, F.struct(-F.col("distance"), "a", "b")).alias("farthest"),
        F.max("distance").alias("max_distance"),
        F.avg("distance").alias("mean_distance"),
    )


def centroid_stats(cents: DataFrame) -> DataFrame:
    """Length and share of non-zero positions of each centroid."""
    v = F.col("value")
    return cents.groupBy("label").agg(
        F.sqrt(F.sum(v * v)).alias("norm"), F.avg((v != 0).cast("double")).alias("density")
    )


def _per_label(cents: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return cents.groupBy("label").agg(F.transform(ordered, lambda x: x["value"]).alias("mean"))


def _bytes(means: DataFrame) -> int:
    """Bytes of the vectors of a written table."""
    return means.agg(F.coalesce(F.sum(F.size("mean") * 8), F.lit(0))).first()[0]


def silhouette_euclidean(
    df: DataFrame, queries: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """Silhouette on plain distances of the rows that ``queries`` names, against all rows."""
    return euclidean_silhouettes(df, key, label, vector, queries)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def assign_nearest(
    df: DataFrame, cents: DataFrame, vector: str = "embedding", out: str = "nearest",
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """Nearest centroid of each vector, ties to the smallest label.

    Centroids of up to ``tile_bytes`` come as one scalar value, so each row is handled where
    it lies: no join, no shuffle. More are compared tile by tile; both ways give the same rows.
    """
    means = materialize(_per_label(cents), "means")
    if _bytes(means) > tile_bytes:
        return nearest_by_tiles(df, means, vector, out, tile_bytes)
    rows = means.agg(F.array_sort(F.collect_list(F.struct("label", "mean"))).alias("c"))

    def distance(mean: Column) -> Column:
        squares = F.zip_with(
            F.col("_v"), mean, lambda x, y: (x - y) * (x - y)
        )
        return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)

    ranked = F.transform(
        "_c", lambda c: F.struct(distance(c["mean"]).alias("d"), c["label"].alias("l"))
    )
    return (
        df.withColumns({"_v": F.col(vector).cast("array<double>"), "_c": rows.scalar()})
        .withColumn("_best", F.array_min(ranked))
        .withColumns({out: F.col("_best.l"), "distance": F.sqrt("_best.d")})
        .drop("_v", "_c", "_best")
    )


def silhouette_rows(
    df: DataFrame, label: str = "label", vector: str = "embedding", tile_bytes: int = TILE_BYTES
) -> DataFrame:
    """Silhouette of each row on squared distances, without comparing rows.

    The mean squared distance of x to a cluster is |x|^2 + mean|y|^2 - 2 x.mean(y), so
    one small table of cluster means is all a row needs; a table of more than ``tile_bytes``
    is compared tile by tile. The plain Euclidean silhouette is another figure, see
    ``silhouette_euclidean``: the two are not comparable.
    """
    v = df.withColumn("_v", F.col(vector).cast("array<double>"))
    squares = v.groupBy(F.col(label).alias("label")).agg(
        F.count("*").alias("n"), F.avg(_dot(F.col("_v"), F.col("_v"))).alias("sq")
    )
    table = materialize(squares.join(_per_label(centroids(df, label, vector)), "label"), "clusters")
    if _bytes(table) > tile_bytes:
        return silhouettes_by_tiles(df, table, label, vector, tile_bytes)
    rows = table.agg(F.array_sort(F.collect_list(F.struct("label", "n", "sq", "mean"))).alias("c"))
    spread = F.transform(
        "_c",
        lambda c: F.struct(
            c["label"].alias("label"), c["n"].alias("n"),
            (F.col("_x2") + c["sq"] - 2 * _dot(F.col("_v"), c["mean"])).alias("d"),
        ),
    )
    d = v.withColumns({"_x2": _dot(F.col("_v"), F.col("_v")), "_c": rows.scalar()}).withColumn(
        "_d", spread
    )
    own = F.filter("_d", lambda c: c["label"] == F.col(label))[0]
    other = F.array_min(
        F.transform(F.filter("_d", lambda c: c["label"] != F.col(label)), lambda c: c["d"])
    )
    ab = d.withColumn("_n", own["n"]).withColumn("_b", other).withColumn(
        "_a", own["d"] * F.col("_n") / F.greatest(F.col("_n") - 1, F.lit(1))
    )
    s = F.when(F.col("_n") == 1, F.lit(0.0)).otherwise(
        (F.col("_b") - F.col("_a")) / F.greatest("_a", "_b")
    )
    return ab.withColumn("silhouette", s).drop("_v", "_x2", "_c", "_d", "_n", "_a", "_b")
