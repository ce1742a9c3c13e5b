"""Search for user rule tables of any size, inside the row.

Tasks hold the phrases as one search tree (Aho-Corasick) and read every text once, whatever
the number of phrases; a text never leaves its row, and nothing is exploded or joined. A
tree is bounded: a table with more than ``RULE_BYTES`` of phrases is searched part by part,
each part in a reading of its own, and only hits, without texts, meet by ticket. Of such a
table, phrases of one word that are sought as whole words meet the words of the texts in a
join instead: one reading, however many they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window, functions as F

from ticketloom.session import materialize

#: Bytes of phrases in one tree, 48 for each phrase included; the tree takes some 20 times as much.
RULE_BYTES = 16 << 20

BEST = "predicted_type string, score int, rule_matched string"
HITS = "row long, category string, category_order int, keyword string, keyword_order int"


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Tree:
    """The phrases of some rules, ready to be found."""

    def __init__(self, rules: list[tuple], match: str):
        import ahocorasick

        self.rules, self.match, self.tree = rules, match, ahocorasick.Automaton()
        places: dict[str, list[int]] = {}
        for i, (_, _, keyword, _) in enumerate(rules):
            places.setdefault(keyword, []).append(i)
        for keyword, mine in places.items():
            self.tree.add_word(keyword, (len(keyword), mine))
        self.tree.make_automaton()

    def found(self, text: str | None) -> list[tuple]:
        """Rules whose phrase stands in the text, each once."""
        seen: set[int] = set()
        for end, (size, mine) in self.tree.iter(text) if text else ():
            if mine[0] in seen:
                continue
            if self.match == "word" and (end + 1 < len(text) and _word(text[end + 1]) or end >= size and _word(text[end - size])):
                continue
            seen.update(mine)
        return [self.rules[i] for i in seen]


def _first(x) -> tuple:
    """Sorts as Spark does: nulls first."""
    return (x is not None, x if x is not None else 0)


def best_of(hits: list[tuple]) -> tuple[str, int, str]:
    """Category of most phrases (then order, then name), its number of phrases, and its first two."""
    (category, order), score = min(
        Counter((c, o) for c, o, _, _ in hits).items(), key=lambda x: (-x[1], _first(x[0][1]), x[0][0]))
    mine = sorted(((_first(k), w) for c, o, w, k in hits if (c, o) == (category, order)))
    return category, score, ", ".join(w for _, w in mine[:2])


_TREES: dict[tuple, Tree] = {}


def _tree(sent, match: str) -> Tree:
    """The tree of a broadcast table; a worker keeps the last one."""
    key = (sent.value[0], match)
    if key not in _TREES:
        _TREES.clear()
        _TREES[key] = Tree(sent.value[1], match)
    return _TREES[key]


def _searched(df: DataFrame, part: list[Row], match: str, schema: str, body: Callable) -> DataFrame:
    """``body(tree, first column, texts)`` of each batch, in tasks that share the phrases."""
    import uuid

    sent = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in part]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _tree(sent, match)
        for batch in batches:
            yield from body(tree, batch.column(0), batch.column(1).to_pylist())

    return df.mapInArrow(run, schema)


#: Phrases of one word, for Python's ``\w`` as well (``_word``).
ONE_WORD = r"^[\p{L}\p{Nd}_]+$"


def _words(texts: DataFrame) -> DataFrame:
    """(row, keyword): the different words of each text (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                some = [(r, w) for r, t in zip(*(c.slice(a, 64).to_pylist() for c in batch.columns)) for w in set(re.findall(r"\w+", t or ""))]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in some], pa.int64()), pa.array([w for _, w in some], pa.string())],
                                                 names=["row", "keyword"])

    return texts.mapInArrow(run, "row long, keyword string")


def _parts(fields: DataFrame, rule_bytes: int) -> Iterator[list[Row]]:
    """The prepared rules in bounded parts; a phrase's rules stay together."""
    total = fields.agg(F.coalesce(F.sum(F.octet_length("keyword") + 48), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / rule_bytes))
    for i in range(n):
        yield fields.where(F.pmod(F.xxhash64("keyword"), F.lit(n)) == i).collect()


def best_rules(df: DataFrame, key: str, text: str, rules: DataFrame, match: str = "substring",
               rule_bytes: int = RULE_BYTES) -> DataFrame:
    """Winning category of each row with a hit: key, predicted_type, score, rule_matched."""
    kind = df.schema[key].dataType.simpleString()
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rules = materialize(rules.select("category", "category_order", "keyword", "keyword_order"), "rules")
    parts = _parts(rules, rule_bytes)
    first, second = next(parts), next(parts, None)
    if second is None:
        def winners(tree, keys, texts):
            hits = [tree.found(t) for t in texts]
            at = [i for i, h in enumerate(hits) if h]
            best = [best_of(hits[i]) for i in at]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(at, pa.int64())), *(pa.array([b[k] for b in best], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string())))],
                names=["key", "predicted_type", "score", "rule_matched"])

        return _searched(texts, first, match, f"key {kind}, {BEST}", winners).withColumnRenamed("key", key)

    def every(tree, rows, texts):
        hits = [(r, *h) for r, t in zip(rows.to_pylist(), texts) for h in tree.found(t)]
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], t) for k, t in enumerate(kinds)],
                                         names=["row", "category", "category_order", "keyword", "keyword_order"])

    # rows are numbered in a written table: a repeated task finds the same numbers
    numbered = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "rule-texts")
    hits, left = None, (first, second)
    if match == "word":
        one = F.col("keyword").rlike(ONE_WORD)
        hits = materialize(_words(numbered.select("row", "text")).join(rules.where(one), "keyword").select(
            "row", "category", "category_order", "keyword", "keyword_order"), "rule-hits")
        left, parts = (), _parts(rules.where(~one), rule_bytes)
    for part in (*left, *parts):
        if not part:
            continue
        some = materialize(_searched(numbered.select("row", "text"), part, match, HITS, every), "rule-hits")
        hits = some if hits is None else hits.unionByName(some)
    ranked = F.array_sort(F.collect_list(F.struct("keyword_order", "keyword")), lambda a, b: F.when(
        a["keyword_order"].eqNullSafe(b["keyword_order"]), F.when(a["keyword"] < b["keyword"], -1).when(
            a["keyword"] > b["keyword"], 1).otherwise(0)).when(a["keyword_order"].isNull(), -1).when(
        b["keyword_order"].isNull(), 1).when(a["keyword_order"] < b["keyword_order"], -1).otherwise(1))
    per_category = hits.groupBy("row", "category", "category_order").agg(
        F.count("*").cast("int").alias("score"),
        F.array_join(F.transform(F.slice(ranked, 1, 2), lambda x: x["keyword"]), ", ").alias("rule_matched"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_first("category_order"), F.asc("category"))
    best = per_category.withColumn("n", F.row_number().over(order)).where("n = 1")
    return numbered.select("row", "key").join(best, "row").select(
        F.col("key").alias(key), F.col("category").alias("predicted_type"), "score", "rule_matched")
