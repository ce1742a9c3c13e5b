"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from ticketloom.checks import QUERIES  # noqa: E402
from ticketloom.config import Config  # noqa: E402
from ticketloom.operators import clustering as cl, evaluation as ev, features as ft, model as md  # noqa: E402

HEADLINES = (
    "m11_rule_summary", "f7_explain", "f9_rules_large", "c7_preprocess", "d8_extract_entities",
    "b5_analysis_text", "g1_vocabulary", "g4_tf_idf", "i22_profile_clusters",
    "i22_semantic_profile", "k2_merge_categories", "m12_name_results", "l2_stratified_split",
    "h6_silhouette", "h11_assign_nearest", "n2_weekly_accuracy", "n6_mix_drift", "f9_rules_many",
)


def fits(spark: SparkSession, sf: str) -> dict[str, float]:
    """Seconds of one K-Means fit and one forest fit on prepared features."""
    from ticketloom.checks.model_queries import terms_of

    t = terms_of(spark, sf)
    vec = ft.vectorizer(ft.fit_vocabulary(t, max_features=2000), 2000)
    feats = vec.transform(t).select("ticket_id", "cluster", "features").cache()
    n = feats.count()
    out = {}
    start = time.time()
    cl.fit_kmeans(feats, cl.choose_k(n), restarts=1, max_iter=30)
    out["kmeans_fit"] = time.time() - start
    _, encoded = md.encode_labels(feats)
    split = ev.stratified_split(encoded, "cluster").cache()
    split.count()
    start = time.time()
    forest = md.train_forest(split.where("not is_test"), Config(trees=20, max_depth=10))
    ev.accuracy(forest.transform(split.where("is_test"))).collect()
    out["forest_fit"] = time.time() - start
    return out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/documents.parquet").count()
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = time.time() - start
    seconds.update(fits(spark, sf))
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of headline queries",
        "value": round(sum(seconds.values()), 2),
        "unit": "sec",
        "queries": {k: round(v, 2) for k, v in seconds.items()},
        "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
