import zlib
from collections import Counter

from pyspark.sql import functions as F

from ticketloom.llm import sharding


def test_digest(docs, odd, empty):
    rows = sharding.shard_digest(docs).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = {}
    for r in rows:
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16) and r.law == "key"
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(str, rows)) == sorted(map(str, sharding.shard_digest(docs).collect()))
    assert sharding.shard_digest(empty).count() == 0
    assert sharding.shard_digest(odd).count() == len(rows)


def test_files_keep_columns_and_order(spark, odd, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(odd, path)
    back = spark.read.parquet(path)
    assert back.select("doc.*").columns == odd.columns and back.count() == odd.count()


def test_fisher_yates_is_a_permutation_and_mixes(spark):
    df = spark.range(400).select("id", F.sequence(F.lit(0), F.lit(5)).alias("x"))
    got = [r.y for r in df.select(sharding.fisher_yates(F.col("x"), F.col("id")).alias("y")).collect()]
    assert all(sorted(y) == list(range(6)) for y in got)
    first = Counter(y[0] for y in got)
    assert all(35 <= first[k] <= 105 for k in range(6))
    assert spark.range(1).select(sharding.fisher_yates(F.array(F.lit(7)), F.lit(1)).alias("y")).first().y == [7]


def test_buckets_are_bounded(docs):
    n = sharding.shuffled(docs, shards=4, bucket_rows=2).groupBy("shard", "bucket").count().count()
    assert n > 8


def plain_shuffle(items, *key):
    """Fisher-Yates from the last place down, with the same draws, on a list."""
    a = list(items)
    for i in range(len(a), 1, -1):
        j = draw(*key, i) % i
        a[i - 1], a[j] = a[j], a[i - 1]
    return a


def test_order_is_that_of_a_plain_fisher_yates(spark):
    global draw
    n = 23
    draws = {(k, i): v for k, i, v in spark.range(5).select("id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i")).select(
        "id", "i", F.xxhash64("id", F.col("i").cast("int"))).collect()}
    draw = lambda k, i: draws[k, i]
    got = spark.range(5).select("id", sharding.fisher_yates(F.sequence(F.lit(0), F.lit(n - 1)), F.col("id")).alias("y")).collect()
    for r in got:
        assert r.y == plain_shuffle(range(n), r.id)


def test_null_ids_do_not_share_a_bucket(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    sizes = sorted(r["count"] for r in sharding.shuffled(df, bucket_rows=100).groupBy("shard", "bucket").count().collect())
    assert sum(sizes) == 4000 and sizes[-1] <= 2 * max(1, sizes[len(sizes) // 2])
