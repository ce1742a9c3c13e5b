"""Ranking that holds when one group has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


# What one row, and the driver, may hold; a guard with an error, not a cut.
MOST_IN_A_ROW = 5000


def bounded_list(entry: Column, most: int = MOST_IN_A_ROW) -> Column:
    """Aggregate of all rows as one sorted list; an error when there are more than ``most``.

    The guard is part of the plan: nothing is computed beforehand to count.
    """
    n = F.count(F.lit(1))
    return F.when(n <= most, F.array_sort(F.collect_list(entry))).otherwise(
        F.raise_error(F.format_string("%d rows, more than %d", n, F.lit(most))))


def broadcast_if_small(df: DataFrame, most: int) -> DataFrame:
    """Broadcast hint when a table has at most ``most`` rows, else the table as it is.

    Reading stops after ``most`` + 1 rows.
    """
    rows = df.select(F.lit(1)).limit(most + 1).count()
    return F.broadcast(df) if rows <= most else df


def top_n(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First n rows per group.

    The limit on ``row_number`` is applied in each partition before the shuffle, so a
    hot group sends at most n rows per task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def ranked_list(df: DataFrame, by: str, value: str, out: str, rank: str = "rank") -> DataFrame:
    """Values of a ``top_n`` result as one array per group, in rank order."""
    pairs = F.array_sort(F.collect_list(F.struct(rank, value)))
    return df.groupBy(by).agg(F.transform(pairs, lambda x: x[value]).alias(out))


def hash_order(key: Column | str, seed: int = 42) -> Column:
    """Repeatable random order of a key."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", k.cast("string"), F.lit(str(seed))))


def spread_rank(df: DataFrame, group: str, key: str, seed: int = 42, out: str = "rank") -> DataFrame:
    """Exact rank of each row within its group by hash order.

    A window over the group alone would sort a hot group in one task.  Rows are first
    split by the leading three digits of the hash: 4,096 parts per group, in hash
    order.  The rank is the rank in the part plus the rows of earlier parts, which
    come from a small table of counts.
    """
    h = df.withColumn("_hash", hash_order(key, seed)).withColumn(
        "_part", F.substring("_hash", 1, 3)
    )
    sizes = h.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        F.col(group).alias("_group"),
        F.col("_part").alias("_offset_part"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy(group, "_part").orderBy("_hash", key)
    ranked = h.withColumn("_inside", F.row_number().over(inside))
    same = (F.col(group).eqNullSafe(F.col("_group"))) & (F.col("_part") == F.col("_offset_part"))
    return (
        ranked.join(offsets, same)
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_hash", "_part", "_inside", "_group", "_offset_part", "_offset")
    )
