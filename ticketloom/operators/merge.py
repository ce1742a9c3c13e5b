"""Merge of similar categories, on a table of category summaries.

The merge is sequential by nature: each round changes the table the next one looks at.
It runs over category summaries (words, causes, flags), never over tickets; its result
is a map from old to new cluster that is joined back to the tickets.

One implementation scores pairs, ``Summaries.scores``: the table of pairs asks for it row by
row in tasks, the merge on the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

from ticketloom.operators.ranking import MOST_IN_A_ROW as MOST_CATEGORIES, broadcast_if_small, ranked_list, top_n

FIELDS = ("cluster", "top_words", "top_causes", "num_incidencias", "avg_text_length",
          "has_technical_terms", "urgency_indicators")
WORDS, CAUSES = 8, 3


class _Sets:
    """A set of names for each category, as rows of numbers; 0 fills what a row has left."""

    def __init__(self, lists: Sequence[Sequence[str]], least: int):
        self.number: dict[str, int] = {}
        for names in lists:
            for name in names:
                self.number.setdefault(name, len(self.number) + 1)
        self.rows = np.zeros((len(lists), max([least, *(len(set(x)) for x in lists)])), np.int32)
        self.sizes = np.zeros(len(lists), np.int32)
        self.marked = np.zeros(len(self.number) + 1, bool)
        for i, names in enumerate(lists):
            self.put(i, names)

    def put(self, i: int, names: Sequence[str]) -> None:
        mine = {self.number[x] for x in names}
        self.rows[i] = 0
        self.rows[i, :len(mine)] = sorted(mine)
        self.sizes[i] = len(mine)

    def overlap(self, i: int) -> np.ndarray:
        """Share of common names of category i and each other one (0 where both have none)."""
        mine = self.rows[i, :self.sizes[i]]
        self.marked[mine] = True
        both = self.marked[self.rows].sum(axis=1)
        self.marked[mine] = False
        either = self.sizes + self.sizes[i] - both
        return both / np.maximum(either, 1)


class Summaries:
    """Category summaries in order of their clusters; a merge changes them in place."""

    def __init__(self, rows: Sequence[Row]):
        rows = sorted(rows, key=lambda r: r["cluster"])
        self.clusters = [r["cluster"] for r in rows]
        self.words = [tuple(r["top_words"] or ()) for r in rows]
        self.causes = [tuple(r["top_causes"] or ()) for r in rows]
        self.tickets = [r["num_incidencias"] for r in rows]
        self.length = [r["avg_text_length"] for r in rows]
        self.technical = np.array([r["has_technical_terms"] for r in rows], bool)
        self.urgency = np.array([r["urgency_indicators"] for r in rows], np.int64)
        self.word_sets, self.cause_sets = _Sets(self.words, WORDS), _Sets(self.causes, CAUSES)

    def scores(self, i: int) -> np.ndarray:
        """Similarity of category i and each other one.

        0.4 words and 0.4 causes (Jaccard), 0.2 features: half for the same technical
        flag, half for urgency counts within one of each other.
        """
        same = 0.5 * (self.technical == self.technical[i])
        near = 0.5 * (np.abs(self.urgency - self.urgency[i]) <= 1)
        return 0.4 * self.word_sets.overlap(i) + 0.4 * self.cause_sets.overlap(i) + 0.2 * (same + near)

    def join(self, keep: int, drop: int) -> None:
        """Most frequent words and causes of both lists, first seen first on ties; sums of the counts."""
        self.words[keep] = tuple(w for w, _ in Counter(self.words[keep] + self.words[drop]).most_common(WORDS))
        self.causes[keep] = tuple(c for c, _ in Counter(self.causes[keep] + self.causes[drop]).most_common(CAUSES))
        self.word_sets.put(keep, self.words[keep])
        self.cause_sets.put(keep, self.causes[keep])
        self.tickets[keep] += self.tickets[drop]
        self.length[keep] = (self.length[keep] + self.length[drop]) / 2
        self.technical[keep] |= self.technical[drop]
        self.urgency[keep] += self.urgency[drop]


def _summaries(categories: DataFrame, most: int) -> Summaries:
    """The summaries on the driver; more than ``most`` are an error."""
    rows = categories.select(*FIELDS).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} categories")
    return Summaries(rows)


def category_similarity(categories: DataFrame, most: int = MOST_CATEGORIES) -> DataFrame:
    """Similarity of each pair of categories: (a, b, similarity), a < b.

    Tasks take the categories one by one and score each against all later ones, which come as
    one bounded table of numbers: nothing is joined, and no row carries the others.
    """
    table = _summaries(categories, most)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters = np.array(table.clusters)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                later = clusters[i + 1:]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(later), clusters[i])), pa.array(later), pa.array(table.scores(i)[i + 1:])],
                    names=["a", "b", "similarity"])

    ids = categories.sparkSession.range(len(table.clusters))
    return ids.mapInArrow(pairs, "a long, b long, similarity double").select(
        F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "similarity")


def greedy_merge(table: Summaries, max_categories: int, min_similarity: float) -> list[int]:
    """Merge the most similar pair until few enough remain; the place each category ends in.

    Each category has one entry on a heap: its best partner among the later ones. After a merge
    only pairs of the changed category are scored again. An entry whose partner went or changed
    is an upper bound of what its category can reach, so it is put right when it comes up.
    """
    n = len(table.clusters)
    alive, version, stamp = np.ones(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    score, partner, parent = np.full(n, -1.0), np.zeros(n, np.int64), list(range(n))

    def look(i: int, row: np.ndarray | None = None) -> tuple:
        """The entry of category i: its first best partner behind it."""
        later = np.where(alive[i + 1:], (table.scores(i) if row is None else row)[i + 1:], -1.0)
        k = int(later.argmax()) if len(later) else -1
        score[i], partner[i] = (later[k], i + 1 + k) if k >= 0 else (-1.0, i)
        return entry(i)

    def entry(i: int) -> tuple:
        stamp[i] += 1
        return -score[i], i, int(partner[i]), int(stamp[i]), int(version[partner[i]])

    heap = [look(i) for i in range(n)]
    heapify(heap)
    left = n
    while left > max_categories and heap:
        cost, a, b, at, seen = heappop(heap)
        if not alive[a] or at != stamp[a] or cost > 0:
            continue
        if not alive[b] or seen != version[b]:
            heappush(heap, look(a))
            continue
        if -cost <= min_similarity:
            break
        table.join(a, b)
        alive[b], parent[b], left = False, a, left - 1
        version[a] += 1
        row = table.scores(a)
        heappush(heap, look(a, row))
        better = (row[:a] > score[:a]) | ((row[:a] == score[:a]) & (a < partner[:a]))
        for i in np.flatnonzero(better & alive[:a]).tolist():
            score[i], partner[i] = row[i], a
            heappush(heap, entry(i))
    for i in range(n):
        parent[i] = parent[parent[i]]  # a category only ever goes to an earlier one, which is settled
    return parent


def merge_categories(
    categories: DataFrame, max_categories: int = 20, min_similarity: float = 0.1,
    most: int = MOST_CATEGORIES,
) -> tuple[DataFrame, DataFrame]:
    """Greedy merge of the most similar pair until few enough remain.

    Returns the map (old, new) and the merged summaries.  Of equal pairs the first in
    order of the clusters is taken.
    """
    table = _summaries(categories, most)
    parent = greedy_merge(table, max_categories, min_similarity)
    name = table.clusters
    spark = categories.sparkSession
    mapping = spark.createDataFrame([(name[i], name[p]) for i, p in enumerate(parent)], "old int, new int")
    merged = spark.createDataFrame(
        [(name[i], list(table.words[i]), list(table.causes[i]), table.tickets[i], table.length[i],
          bool(table.technical[i]), int(table.urgency[i])) for i, p in enumerate(parent) if p == i],
        "cluster int, top_words array<string>, top_causes array<string>, num_incidencias long, "
        "avg_text_length double, has_technical_terms boolean, urgency_indicators long",
    )
    return mapping, merged


def apply_mapping(df: DataFrame, mapping: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Replace old clusters by new ones.

    A map of so many rows as a merge may give is broadcast: the tickets stay where
    they are.
    """
    small = broadcast_if_small(mapping, MOST_CATEGORIES)
    out = df.join(small, F.col(cluster) == F.col("old"), "left")
    return out.withColumn(cluster, F.coalesce("new", cluster)).drop("old", "new")


def merge_profile(parts: DataFrame, mapping: DataFrame, dims: bool = False) -> DataFrame:
    """Profile of merged categories by grouping, for a map of one round.

    Words and causes by frequency over the lists, first seen first on ties; sizes and
    urgency summed, flags combined, length averaged without weights.  With ``dims`` the
    ``center`` arrays are averaged as well. A cluster that the map does not name stays.
    """
    j = parts.join(mapping, F.col("cluster") == F.col("old"), "left").withColumn("new", F.coalesce("new", "cluster"))

    def merged_list(col: str, n: int) -> DataFrame:
        seen = j.select("new", "cluster", F.posexplode(col).alias("pos", "value"))
        counts = seen.groupBy("new", "value").agg(
            F.count("*").alias("n"), F.min(F.struct("cluster", "pos")).alias("at")
        )
        ranked = top_n(counts, ["new"], [F.desc("n"), F.asc("at")], n)
        return ranked_list(ranked, "new", "value", col)

    out = j.groupBy("new").agg(
        F.sum("num_incidencias").alias("num_incidencias"),
        F.avg("avg_text_length").alias("avg_text_length"),
        F.bool_or("has_technical_terms").alias("has_technical_terms"),
        F.sum("urgency_indicators").alias("urgency_indicators"),
    )
    for col, n in (("top_words", 8), ("top_causes", 3)):
        out = out.join(merged_list(col, n), "new", "left")
    if dims:
        flat = j.select("new", F.posexplode("center").alias("pos", "x"))
        means = flat.groupBy("new", "pos").agg(F.avg("x").alias("value"))
        ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
        center = means.groupBy("new").agg(F.transform(ordered, lambda x: x["value"]).alias("center"))
        out = out.join(center, "new", "left")
    return out.withColumnRenamed("new", "cluster")
