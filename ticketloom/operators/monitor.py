"""Weekly monitoring of a running classifier (batch form).

Everything is counted per week first; comparisons between weeks then run on one row
per week.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ticketloom.operators.summary import confidence_band

from ticketloom.operators.ranking import bounded_list


def week_of(ts: Column | str) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", F.col(ts) if isinstance(ts, str) else ts).cast("date")


def weekly_accuracy(
    df: DataFrame, ts: str = "created_at", label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Rows and accuracy per week."""
    same = (F.col(label) == F.col(prediction)).cast("double")
    return df.groupBy(week_of(ts).alias("week")).agg(
        F.count("*").alias("n"), F.avg(same).alias("accuracy")
    )


def threshold_alerts(weekly: DataFrame, review: float = 0.85, target: float = 0.88) -> DataFrame:
    """State of each week: review below 0.85, on target above 0.88."""
    a = F.col("accuracy")
    state = F.when(a < review, "review").when(a > target, "on_target").otherwise("watch")
    return weekly.select("week", "accuracy", state.alias("state"))


def retrain_trigger(weekly: DataFrame, limit: float = 0.87, weeks: int = 2) -> DataFrame:
    """Weeks that end a run of at least ``weeks`` weeks below the limit.

    A week without rows breaks the run.
    """
    low = weekly.where(F.col("accuracy") < limit)
    order = Window.orderBy("week")
    earlier = F.lag("week", weeks - 1).over(order)
    due = F.datediff("week", earlier) == 7 * (weeks - 1)
    return low.withColumn("retrain", F.coalesce(due, F.lit(False))).select(
        "week", "accuracy", "retrain"
    )


def weekly_confidence(df: DataFrame, ts: str = "created_at", confidence: str = "confidence") -> DataFrame:
    """Tickets per week and confidence band, with the share of the week."""
    counts = (
        df.where(F.col(confidence) > 0)
        .groupBy(week_of(ts).alias("week"), confidence_band(confidence).alias("band"))
        .agg(F.count("*").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("week"))
    return counts.withColumn("share", F.col("n") / total)


def _weekly_kinds(df: DataFrame, kind: str, ts: str, baseline_until: str) -> tuple[DataFrame, DataFrame]:
    """Counts by week and kind from a date on, and the share of each kind before it."""
    counts = df.groupBy(week_of(ts).alias("week"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    cut = F.lit(baseline_until).cast("date")
    base = counts.where(F.col("week") < cut).groupBy("kind").agg(F.sum("n").alias("n"))
    total = base.agg(F.sum("n").alias("n")).scalar()
    return counts.where(F.col("week") >= cut), base.select("kind", (F.col("n") / total).alias("base_share"))


def mix_drift_seen(df: DataFrame, kind: str, ts: str, baseline_until: str) -> DataFrame:
    """Weekly share of each kind minus its share before a date, for any number of kinds.

    One row for each kind seen in a week, and one for all kinds of the baseline that it
    lacks together: ``seen`` is false there, kind null, and delta minus their share. The
    total variation comes from sums, so weeks and kinds are never paired up.
    """
    late, base = _weekly_kinds(df, kind, ts, baseline_until)
    weeks = late.groupBy("week").agg(F.sum("n").alias("week_n"))
    seen = late.join(weeks, "week").join(
        base.withColumnRenamed("kind", "_kind"), F.col("kind").eqNullSafe(F.col("_kind")), "left").drop("_kind")
    share = F.coalesce("base_share", F.lit(0.0))
    rows = seen.select("week", "kind", (F.col("n") / F.col("week_n") - share).alias("delta"), share.alias("base_share"))
    every = base.agg(F.coalesce(F.sum("base_share"), F.lit(0.0)).alias("s")).scalar()
    sums = rows.groupBy("week").agg(F.sum(F.abs("delta")).alias("moved"), F.sum("base_share").alias("kept"))
    sums = sums.select("week", (every - F.col("kept")).alias("lost"), ((F.col("moved") + every - F.col("kept")) / 2).alias("total_variation"))
    lacking = sums.where("lost > 1e-12").select(
        "week", F.lit(None).cast(late.schema["kind"].dataType).alias("kind"), F.lit(False).alias("seen"), (-F.col("lost")).alias("delta"),
        "total_variation")
    return rows.join(sums, "week").select("week", "kind", F.lit(True).alias("seen"), "delta", "total_variation").unionByName(lacking)


def mix_drift(df: DataFrame, kind: str, ts: str, baseline_until: str) -> DataFrame:
    """Weekly share of each kind minus its share before a date, and total variation.

    Kinds seen on one side only count with share zero on the other, and every kind has a row
    in every week: for few kinds (see ``bounded_list``). ``mix_drift_seen`` is for many.
    """
    late, base = _weekly_kinds(df, kind, ts, baseline_until)
    weeks = late.groupBy("week").agg(F.sum("n").alias("week_n"))
    # Kinds of the baseline that a week lacks: expected pairs minus those seen.
    kinds = bounded_list(F.col("kind"))  # one row per kind in base; too many are an error
    expected = weeks.select("week", F.explode(base.agg(kinds).scalar()).alias("kind"))
    pairs = expected.unionByName(late.select("week", "kind")).distinct()
    joined = (
        pairs.join(weeks, "week").join(late, ["week", "kind"], "left").join(base, "kind", "left")
    )
    delta = F.coalesce(F.col("n"), F.lit(0)) / F.col("week_n") - F.coalesce("base_share", F.lit(0.0))
    out = joined.select("week", "kind", delta.alias("delta"))
    tv = F.sum(F.abs("delta")).over(Window.partitionBy("week")) / 2
    return out.withColumn("total_variation", tv)


def unbalanced_clusters(df: DataFrame, cluster: str = "cluster", limit: float = 0.25) -> DataFrame:
    """Clusters whose share of all tickets is above the limit."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return sizes.withColumn("share", F.col("n") / total).where(F.col("share") > limit)
