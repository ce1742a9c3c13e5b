"""Splits and quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ticketloom.operators.ranking import broadcast_if_small, hash_order, spread_rank


def holdout(df: DataFrame, n: int = 100, seed: int = 42, key: str = "ticket_id"):
    """Exactly n random rows for testing, and the rest.

    The n smallest hashes are found by a top-n (n rows per task); both parts are then
    a filter against the largest of them.  Nothing else is shuffled.
    """
    order = F.struct(hash_order(key, seed).alias("h"), F.col(key).alias("k"))
    last = df.select(order.alias("o")).orderBy("o").limit(n).agg(F.max("o").alias("o"))
    is_test = order <= last.scalar()
    return df.where(~is_test), df.where(is_test)


def test_sizes(df: DataFrame, label: str, fraction: float) -> DataFrame:
    """Test rows per label: proportional, with the remainder to the largest fractions.

    The total is the fraction of all rows, rounded up.  One row per label.
    """
    per = df.groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()
    total = F.sum("n").over(everything)
    goal = F.ceil(total * F.lit(fraction)).cast("long")
    share = per.withColumn("_goal", goal).withColumn(
        "_exact", F.col("n") * F.col("_goal") / total
    )
    floors = share.withColumn("_floor", F.floor("_exact").cast("long")).withColumn(
        "_missing", F.col("_goal") - F.sum("_floor").over(everything)
    )
    by_rest = everything.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), label)
    extra = (F.row_number().over(by_rest) <= F.col("_missing")).cast("long")
    return floors.select(label, "n", (F.col("_floor") + extra).alias("n_test"))


def stratified_split(
    df: DataFrame, label: str, fraction: float = 0.2, seed: int = 42, key: str = "ticket_id"
) -> DataFrame:
    """Add ``is_test``: an exact share of every label, repeatable.

    Ranks are exact also for a label that holds most rows; see ``spread_rank``.
    """
    sizes = test_sizes(df, label, fraction).select(F.col(label).alias("_label"), "n_test")
    ranked = spread_rank(df, label, key, seed, out="_rank")
    same = F.col(label).eqNullSafe(F.col("_label"))
    return (
        ranked.join(sizes, same)
        .withColumn("is_test", F.col("_rank") <= F.col("n_test"))
        .drop("_rank", "_label", "n_test")
    )


def split_points(
    df: DataFrame, label: str, fraction: float = 0.2, seed: int = 42, key: str = "ticket_id"
) -> DataFrame:
    """Last test row of each label in hash order: label, point. One row per label."""
    sizes = test_sizes(df, label, fraction).select(F.col(label).alias("_label"), "n_test")
    ranked = spread_rank(df.select(label, key), label, key, seed, out="_rank")
    same = F.col(label).eqNullSafe(F.col("_label")) & (F.col("_rank") == F.col("n_test"))
    point = F.struct(hash_order(key, seed).alias("h"), F.col(key).alias("k"))
    return ranked.join(sizes, same).select(label, point.alias("point"))


def split_by_points(
    df: DataFrame, points: DataFrame, label: str, seed: int = 42, key: str = "ticket_id"
) -> DataFrame:
    """Add ``is_test`` against the points of ``split_points``; the rows stay where they are.

    Rows of one key fall on the same side.
    """
    small = broadcast_if_small(points.select(F.col(label).alias("_label"), "point"), 100_000)
    here = F.struct(hash_order(key, seed).alias("h"), F.col(key).alias("k"))
    joined = df.join(small, df[label].eqNullSafe(F.col("_label")), "left")
    return joined.withColumn("is_test", F.coalesce(here <= F.col("point"), F.lit(False))).drop("_label", "point")


def fold_of(key: Column | str, k: int = 5, seed: int = 42) -> Column:
    """Cross-validation fold 0..k-1 of a row, from its hash alone."""
    return (F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("long") % k).cast("int")


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of equal labels, and rows."""
    same = (F.col(label) == F.col(prediction)).cast("double")
    return df.agg(F.count("*").alias("n"), F.avg(same).alias("accuracy"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Count of each pair of label and prediction."""
    return df.groupBy(label, prediction).agg(F.count("*").alias("n"))


def class_accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows, hits, share of hits per label, and how often it is predicted."""
    pairs = confusion(df, label, prediction)
    hit = F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0)
    recall = pairs.groupBy(F.col(label).alias("class")).agg(
        F.sum("n").alias("n"), F.sum(hit).alias("hits")
    )
    predicted = pairs.groupBy(F.col(prediction).alias("_class")).agg(F.sum("n").alias("predicted"))
    return recall.join(predicted, F.col("class") == F.col("_class"), "left").select(
        "class", "n", "hits", F.coalesce("predicted", F.lit(0)).alias("predicted"),
        (F.col("hits") / F.col("n")).alias("accuracy"),
    )


def baselines(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Random and majority baselines and the uplift over them in points."""
    per = df.groupBy(label).agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == F.col(prediction)).alias("hits")
    )
    one = per.agg(
        F.count("*").alias("classes"),
        (F.sum("hits") / F.sum("n")).alias("accuracy"),
        (F.lit(1.0) / F.count("*")).alias("random"),
        (F.max("n") / F.sum("n")).alias("majority"),
    )
    return one.select(
        "*",
        ((F.col("accuracy") - F.col("random")) * 100.0).alias("uplift_random"),
        ((F.col("accuracy") - F.col("majority")) * 100.0).alias("uplift_majority"),
    )


def accuracy_ci(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy with its 95% interval (normal approximation)."""
    half = F.lit(1.96) * F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("n"))
    return accuracy(df, label, prediction).select(
        "n", "accuracy", (F.col("accuracy") - half).alias("low"),
        (F.col("accuracy") + half).alias("high"),
    )
