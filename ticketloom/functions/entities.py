"""Entity extraction from the combined text of a ticket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ticketloom import lexicons as lx
from ticketloom.functions.text import _col, whole_words

ENTITY_TYPES = tuple(n for n, _ in lx.ENTITY_PATTERNS) + tuple(n for n, _ in lx.ENTITY_TERMS)


def entity_pattern(name: str) -> str:
    """Regular expression of one entity type; a digit is one of any script."""
    patterns = dict(lx.ENTITY_PATTERNS)
    return patterns[name].replace(r"\d", r"\p{Nd}") if name in patterns else whole_words(dict(lx.ENTITY_TERMS)[name])


def extract_entity(c: Column | str, name: str) -> Column:
    """Distinct matches of one type in lower case, sorted."""
    text = F.lower(F.coalesce(_col(c), F.lit("")))
    return F.array_sort(
        F.array_distinct(F.regexp_extract_all(text, F.lit(entity_pattern(name)), F.lit(0)))
    )


def extract_entities(c: Column | str, names: Sequence[str] = ENTITY_TYPES) -> Column:
    """Map of entity type to its matches; a null text gives empty lists."""
    pairs = [x for n in names for x in (F.lit(n), extract_entity(c, n))]
    return F.create_map(*pairs)


def with_entities(df: DataFrame, text: str, names: Sequence[str] = ENTITY_TYPES) -> DataFrame:
    """Add ``entities`` and one ``has_<type>`` flag per type."""
    out = df.withColumn("entities", extract_entities(text, names))
    return out.withColumns({f"has_{n}": F.size(F.col("entities")[n]) > 0 for n in names})


def entity_counts(df: DataFrame, text: str, names: Sequence[str] = ENTITY_TYPES) -> DataFrame:
    """Per type: tickets that hold it and distinct matches summed over tickets.

    One pass with one global aggregate: nothing but seven numbers is shuffled.
    """
    sizes = df.select(*[F.size(extract_entity(text, n)).alias(n) for n in names])
    one = sizes.agg(
        *[F.count_if(F.col(n) > 0).alias(f"t_{n}") for n in names],
        *[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(f"m_{n}") for n in names],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("entity"),
                F.col(f"t_{n}").alias("tickets"),
                F.col(f"m_{n}").alias("matches"),
            )
            for n in names
        ]
    )
    return one.select(F.inline(rows))


def entity_value_counts(df: DataFrame, text: str, name: str) -> DataFrame:
    """Frequency of each value of one entity type, in tickets."""
    return (
        df.select(F.explode(extract_entity(text, name)).alias("value"))
        .groupBy("value")
        .agg(F.count("*").alias("tickets"))
    )
