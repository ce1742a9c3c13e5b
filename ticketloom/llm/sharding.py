"""Two-pass external shuffle into shards.

Pass one scatters every record with seeded hashes: its shard is the one of highest hash
of (doc_id, shard), so that one more shard takes rows only into itself; inside the shard
a second hash, of id and text, picks a bucket of bounded size. Pass two shuffles each bucket by
Fisher-Yates, with swaps drawn from hashes of (bucket, step), and writes it; slots count
on from bucket to bucket. Seeds decide everything: a task that is run again gives the
same order.

Null text has size 1 and checksum 0. A null doc_id is a value of its own; equal rows
land in one bucket and keep their number; what ties the order of a bucket is a hash of id and
text. A very long text is a record like others, in a bucket that counts its bytes. Columns
are packed before the work, so names cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ticketloom.llm.common import let, scratch_path

SHARDS = 16
SEED = 20
#: Mean bytes of text in a bucket: what one task holds and shuffles at a time.
BUCKET_BYTES = 1 << 20
#: Mean rows in a bucket at most, so that swaps stay cheap where rows are short.
BUCKET_ROWS = 512


def highest_hash(key: Column, shards: int, seed: int) -> Column:
    """The shard of highest hash for a key (rendezvous hashing)."""
    votes = (F.struct(F.xxhash64(key, F.lit(seed), F.lit(s)).alias("vote"), F.lit(s).alias("shard"))
             for s in range(shards))
    return F.array_max(F.array(*votes))["shard"]


def fisher_yates(items: Column, *key: Column) -> Column:
    """The array in the order that Fisher-Yates swaps give, from the last place down."""
    n = F.size(items)

    def swapped(a: Column, i: Column) -> Column:
        def put(j: Column) -> Column:
            return F.when(i == j, a).otherwise(F.concat(
                F.slice(a, F.lit(1), j - 1), F.array(F.element_at(a, i)),
                F.slice(a, j + 1, i - j - 1), F.array(F.element_at(a, j)),
                F.slice(a, i + 1, F.size(a) - i)))

        return let((F.pmod(F.xxhash64(*key, i), i) + 1).cast("int"), put)

    start = F.sequence(F.lit(1), n)
    order = F.when(n < 2, start).otherwise(
        F.aggregate(F.sequence(n, F.lit(2), F.lit(-1)), start, swapped))
    return F.transform(order, lambda p: F.element_at(items, p))


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
             bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows doc (all columns), shard, bucket, slot, in shuffled order inside each bucket."""
    size = F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(1)
    shard = highest_hash(F.col("doc_id"), shards, seed)
    sums = docs.groupBy(shard.alias("shard")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    total = sum(r["bytes"] for r in sums)
    # a shard that equal ids fill has more buckets, none larger than others
    needed = {r["shard"]: max(1, math.ceil(r["bytes"] / bucket_bytes), math.ceil(r["rows"] / bucket_rows)) for r in sums}
    buckets = F.element_at(F.array(*(F.lit(needed.get(s, 1)) for s in range(shards))), shard + 1)
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), "doc_id", "text"), buckets).cast("int")

    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = docs.select(shard.alias("shard"), bucket.alias("bucket")).groupBy("shard", "bucket").agg(
        F.count(F.lit(1)).alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    scattered = docs.select(shard.alias("shard"), bucket.alias("bucket"), F.struct(
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("tie"), F.struct("*").alias("doc")).alias("record"))
    parts = max(1, math.ceil(total / (32 * bucket_bytes)))
    packed = scattered.repartition(parts, "shard", "bucket").groupBy("shard", "bucket").agg(
        F.array_sort(F.collect_list("record"), lambda a, b: F.when(a["tie"] < b["tie"], -1).when(
            a["tie"] > b["tie"], 1).otherwise(0)).alias("records"))
    dealt = packed.select("shard", "bucket", F.posexplode(
        fisher_yates(F.col("records"), F.lit(seed), F.col("shard"), F.col("bucket"))).alias("i", "record"))
    return dealt.join(counts, ["shard", "bucket"]).select(
        "record.doc", "shard", "bucket", (F.col("first") + F.col("i")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, **limits) -> StructType:
    """Write the shuffled records as Parquet, one folder for each shard, in slot order; their schema."""
    out = shuffled(docs, shards, seed, **limits)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return out.schema


def shard_digest(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Write the shards, read them back, and describe each record and its place."""
    spark = docs.sparkSession
    path = scratch_path(spark, "shards")
    schema = write_shards(docs, path, shards, seed)
    text = F.coalesce("doc.text", F.lit(""))
    return spark.read.schema(schema).parquet(path).select(
        "doc.doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"),
        highest_hash(F.col("doc.doc_id"), shards + 1, seed).alias("grown_shard"), "bucket")
