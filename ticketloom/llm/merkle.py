"""Merkle manifest of a dataset: a proof for every document, by butterfly exchange.

Each document is a leaf; the leaves of a language, in order of doc_id, form a tree of
fanout 8, and the roots of the languages form the tree above. A manifest row holds the
siblings of its document level by level up to the root, so that one document can be
checked against the root without any other.

1. Leaves are hashed while the texts are read; from there on only digests move.
2. The order is a range partitioning by (language, doc_id): places come from counts by
   (language, partition), a small table. Eight to the third consecutive leaves of a language
   are one partition of the tree, kept as one row. It hashes its own three levels.
3. Partitions then swap roots, round by round: in round r those meet whose numbers differ in
   the r-th digit to the base 8 alone. Each receives the subtree roots of its at most seven
   partners, notes them in its proof, and hashes the common ancestor itself; so every
   ancestor is hashed by each partition below it, and at the end every partition holds its
   proof up to the top. Nothing travels back down. Where the last subtree of a level has
   fewer partitions than its siblings, its partitions send to the digits that it lacks too.
4. The languages' roots go through the same exchange.
5. A partition's row meets its upper proof once, and gives out its documents.

A round shuffles one short row a partition, and there are as many rounds as levels above
the partitions; a group of the exchange has at most eight partitions, whatever the size of
a language. The one uneven load is the last subtree of a level, which may be small and then
sends a row to each partition of its siblings' digits.

A null is hashed as ``-``. A null language is a language of its own, and the first; null
ids come first in their language. Documents of equal id stand in order of their digest;
equal rows are leaves of their own. Empty and very long texts are hashed like others; an
empty table has an empty manifest. Only the named columns are read, so names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ticketloom.llm.common import pinned, scratch_path, small_side, written

FANOUT = 8
#: Levels inside one partition of the tree: its row holds FANOUT ** HEIGHT leaves at most.
HEIGHT = 3
#: Rows of digests in a task of the sort.
SORT_ROWS = 100_000
#: Partitions up to which their proofs (a few kB each) are broadcast; beyond, the join shuffles.
BROADCAST_PROOFS = 4_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """How a value enters its leaf: length in bytes and text, so that no two rows look alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _placed(df: DataFrame, *order: str) -> DataFrame:
    """Every row of a written table with its place in its tree, and the tree's number of rows.

    ``order`` must be a total order behind ``tree``.
    """
    spark = df.sparkSession
    parts = max(1, math.ceil(df.count() / SORT_ROWS))
    sorted_ = written(df.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order).withColumn(
        "at", F.monotonically_increasing_id()), scratch_path(spark, "merkle-order"))
    part = F.shiftright("at", 33).alias("part")
    ahead = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(sorted_.groupBy("tree", part).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low")).select(
        "tree", "part", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("low")).alias("shift"),
        F.sum("n").over(Window.partitionBy("tree")).alias("size")), scratch_path(spark, "merkle-counts"))
    return sorted_.withColumn("part", part).join(small_side(counts), ["tree", "part"]).withColumn(
        "place", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _above(digests: Column, fanout: int) -> Column:
    """Parents of a row of digests: each hashes up to ``fanout`` of them."""
    starts = F.sequence(F.lit(1), F.size(digests), F.lit(fanout))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(digests, i, F.lit(fanout)), ""), 256))


def _siblings(digests: Column, i: Column, fanout: int) -> Column:
    """What stands before and behind place i (from 0) in its run."""
    run = F.floor(i / fanout) * fanout
    return F.struct(
        F.array_join(F.slice(digests, (run + 1).cast("int"), (i - run).cast("int")), "").alias("before"),
        F.array_join(F.slice(digests, (i + 2).cast("int"), (run + fanout - i - 1).cast("int")), "").alias("after"))


STEP = "array<struct<before:string,after:string>>"


def exchange(parts: DataFrame, most: int, fanout: int = FANOUT) -> DataFrame:
    """Rows tree, index, digest (the tree's root), proof, from the parts' roots.

    ``parts`` has tree, index (from 0, without gaps), size (parts of the tree) and digest;
    ``most`` is the greatest size.
    """
    state = parts.select("tree", "index", "size", "digest", F.array().cast(STEP).alias("proof"))
    width = 1
    while width < most:
        # whole numbers throughout: v the subtree's number, inside: the part's place in it
        v, inside = F.expr(f"index div {width}"), F.expr(f"index % {width}")
        last = F.expr(f"(size - 1) div {width}")
        held = F.col("size") - last * width
        alone = (last % fanout == 0)
        digits = F.when((v == last) & ~alone & (held < width), F.sequence(inside, F.lit(width - 1).cast("bigint"), held)).otherwise(F.array(inside))
        goes_on = F.col("size") > width
        sent = state.withColumn("v", v).withColumn("own", inside).withColumn("goes_on", goes_on).withColumn(
            "digit", F.explode(F.when(goes_on, digits).otherwise(F.array(F.col("index")))))
        met = sent.groupBy("tree", F.when(F.col("goes_on"), F.expr(f"v div {fanout}")).otherwise(F.col("index")).alias("meeting"), "digit").agg(
            F.sort_array(F.collect_list(F.struct("v", "digest"))).alias("roots"),
            F.collect_list(F.when(~F.col("goes_on") | (F.col("digit") == F.col("own")), F.struct(
                "index", "size", "digest", "proof", "v", "goes_on"))).alias("members"))
        row = met.select("tree", "roots", F.inline("members"))
        joined = lambda test: F.array_join(F.transform(
            F.filter("roots", lambda x: test(x["v"])), lambda x: x["digest"]), "")
        step = F.struct(joined(lambda x: x < F.col("v")).alias("before"), joined(lambda x: x > F.col("v")).alias("after"))
        # written after each round: a row depends on eight, and those on eight more
        state = written(row.select(
            "tree", "index", "size",
            F.when(F.col("goes_on"), F.sha2(joined(lambda x: F.lit(True)), 256)).otherwise(F.col("digest")).alias("digest"),
            F.when(F.col("goes_on"), F.concat("proof", F.array(step))).otherwise(F.col("proof")).alias("proof")),
            scratch_path(parts.sparkSession, "merkle-round"))
        width *= fanout
    return state.select("tree", "index", "digest", "proof")


def manifest(docs: DataFrame, seen: Column | None = None, fields: Sequence[str] = FIELDS, key: str = "doc_id",
             group: str = "lang", fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """One row per document: key, group, place, leaf, found, subroot, root, proof.

    ``proof`` has a (before, after) pair of joined digests for each level from the leaf to
    the root. ``seen`` is a text to be checked in the place of ``text``; ``found`` is the
    leaf with that text, else the leaf itself.
    """
    spark = docs.sparkSession
    value = F.col(group).cast("string")
    own = leaf([F.col(f) for f in fields])
    found = F.lit(None).cast("string") if seen is None else leaf([seen if f == "text" else F.col(f) for f in fields])
    hashed = written(docs.select(
        F.coalesce(F.concat(F.lit("="), value), F.lit("")).alias("tree"), F.col(key).alias("key"), own.alias("leaf"),
        found.alias("found"), F.monotonically_increasing_id().alias("tie")), scratch_path(spark, "merkle-leaves"))

    block = fanout ** height
    rows = _placed(hashed, "key", "leaf", "tie").groupBy("tree", F.expr(f"place div {block}").alias("index")).agg(
        F.first("size").alias("leaves"), F.sort_array(F.collect_list(F.struct("place", "key", "leaf", "found"))).alias("rows"))
    rows = written(rows, scratch_path(spark, "merkle-blocks"))

    digests, level = {"l0": F.transform("rows", lambda x: x["leaf"])}, rows
    for h in range(height + 1):
        level = pinned(level, *level.columns, **{f"l{h}": digests["l0"] if h == 0 else F.when(
            F.col("leaves") > fanout ** (h - 1), _above(F.col(f"l{h - 1}"), fanout)).otherwise(F.col(f"l{h - 1}"))})
    size = F.expr(f"(leaves - 1) div {block} + 1").alias("size")
    most, trees = rows.agg(F.coalesce(F.max(size), F.lit(0)), F.count_distinct("tree")).first()
    blocks = written(level.select("tree", "index", size, F.col(f"l{height}")[0].alias("digest")), scratch_path(spark, "merkle-roots"))
    below = exchange(blocks, most, fanout)

    roots = written(below.where("index = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"),
                    scratch_path(spark, "merkle-subroots"))
    tops = _placed(roots, "name").select("tree", "name", F.col("place").alias("index"), "size", "digest")
    tops = written(tops, scratch_path(spark, "merkle-tops"))
    top = exchange(tops, trees, fanout).withColumnRenamed("digest", "root").withColumnRenamed("proof", "top")
    top = tops.select(F.col("name").alias("tree"), "index").join(top.drop("tree"), "index").drop("index")
    upper = below.withColumnRenamed("digest", "subroot").join(small_side(written(top, scratch_path(spark, "merkle-top")), BROADCAST_PROOFS), "tree")
    upper = written(upper.select("tree", "index", "subroot", "root", F.concat("proof", "top").alias("upper")), scratch_path(spark, "merkle-upper"))

    def steps(i: Column) -> Column:
        inner = [F.when(F.col("leaves") > fanout ** h, _siblings(F.col(f"l{h}"), F.floor(i / fanout ** h), fanout)) for h in range(height)]
        return F.concat(F.filter(F.array(*inner), lambda x: x.isNotNull()), F.col("upper"))

    out = level.join(small_side(upper, BROADCAST_PROOFS), ["tree", "index"])
    made = F.transform("rows", lambda x, i: F.struct(
        x["key"].alias(key), x["place"].alias("place"), x["leaf"].alias("leaf"), F.coalesce(x["found"], x["leaf"]).alias("found"),
        steps(i).alias("proof")))
    return out.select(F.inline(made), F.when(F.col("tree") != "", F.expr("substr(tree, 2)")).alias(group), "subroot", "root")


def folded(leaf_: Column | str, proof: Column | str) -> Column:
    """The root that a leaf and the siblings of a proof give."""
    first = F.col(leaf_) if isinstance(leaf_, str) else leaf_
    return F.aggregate(proof, first, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The manifest, checked against documents of which a third has its text lower-cased."""
    changed = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    seen = F.when(changed, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    proof = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    rows = manifest(docs, seen).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded("found", "proof").alias("folded_root"), "lang", "place")
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
