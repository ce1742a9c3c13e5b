"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ticketloom.session import materialize, scratch_path

#: The six characters that end a word, as a Java pattern and as text.
SPACE = "[\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Rows up to which a side of a join is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table once nothing reads it any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back: cuts the lineage, survives lost executors."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pinned(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """Columns computed once per row, however often they are read afterwards."""
    made = F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return df.select(*keep, made)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Maximal runs of characters other than the six of SPACE; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, f"{SPACE}+", -1)
    )


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table of at most so many rows; leave a larger one to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows whose key is not in the one column of a written table; null equals null."""
    name = "gone"
    while name in df.columns:
        name += "_"
    return df.join(small_side(gone.toDF(name)), df[key].eqNullSafe(F.col(name)), "left_anti")


__all__ = [
    "BROADCAST_ROWS", "SPACE", "SPACE_CHARS", "let", "materialize", "pinned", "remove",
    "scratch_path", "small_side", "table", "without", "words", "written",
]
