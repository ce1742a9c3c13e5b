"""Feature queries over rows of their own."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ticketloom.checks.registry import QUERIES
from ticketloom.operators import features as ft, term_counts as tc
from ticketloom.checks import model_queries as mq


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tickets"))
    words = ["alta", "contador", "lectura", "cambio", "tarifa", "aviso"]
    rows = [(i, " ".join(words[(i * j) % 6] for j in range(1, 2 + i % 9)) if i % 11 else None) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_norms_read_entries_only(spark, folder):
    done = QUERIES["g4_feature_norms"](spark, folder)
    t = mq.terms_of(spark, folder)
    long = ft.tf_idf(t, ft.fit_vocabulary(t), "ticket_id").groupBy("ticket_id").count().collect()
    got = {r["ticket_id"]: r for r in done.collect()}
    assert {k: r["terms"] for k, r in got.items()} == {r["ticket_id"]: r["count"] for r in long} and len(got) > 40
    assert all(r["norm"] == 1.0 for r in got.values())
    # no dense copy of a vector as long as the vocabulary
    assert "vector_to_array" not in done._jdf.queryExecution().analyzed().toString()
    assert ".features" not in done._jdf.queryExecution().analyzed().toString()
    assert "UDF(features" not in done._jdf.queryExecution().analyzed().toString()


def test_pairs_are_counted_only_where_their_words_are_frequent(spark, monkeypatch):
    """The pruned counts give the vocabulary of all terms, with ties, repeats, empty and null rows."""
    texts = ["a1 b1 a1 b1 c1", "b1 a1 b1 d1", "", None, "x%d y%d a1 b1", "c1 c1 c1 b1", "rare words here a1"] * 6
    rows = [(i, t.replace("%d", str(i)) if t else t) for i, t in enumerate(texts)]
    t = ft.with_terms(spark.createDataFrame(rows, "i int, text string"), "text").withColumn("fold", F.col("i") % 3)
    nulled = t.withColumn("terms", F.when(F.col("i") != 9, F.col("terms")))
    sizes = {f: 14 for f in range(3)}

    def kept(df):
        return sorted(map(tuple, df.collect()), key=str)

    for most, min_df, max_df in ((5, 2, 0.9), (9, 1, 1.0), (500, 2, 0.5), (500, 100, 0.5)):
        for frequent in (tc.FREQUENT, 3):
            monkeypatch.setattr(tc, "FREQUENT", frequent)
            monkeypatch.setattr(tc, "PIECE", 20)
            limits = "terms", most, min_df, max_df
            assert kept(ft.fit_vocabulary(nulled, *limits, pairs=True)) == kept(ft.fit_vocabulary(nulled, *limits))
            folds = ft.fold_stats(nulled, "fold", "terms", sizes, *limits[1:])
            assert kept(ft.fold_vocabularies(folds, sizes, *limits[1:])) == kept(
                ft.fold_vocabularies(ft.fold_stats(nulled, "fold"), sizes, *limits[1:]))
    # words that no frequent pair is made of leave no pair behind
    monkeypatch.setattr(tc, "FREQUENT", 1 << 18)
    stats = ft.fold_stats(t, "fold", "terms", sizes, 5, 2, 0.9)
    assert stats.where("term like '% %'").select("term").distinct().count() < t.select(
        F.explode("terms").alias("term")).where("term like '% %'").distinct().count()


def test_words_are_written_in_small_pieces(spark):
    """F13 to F21: a task that writes words holds a few megabytes of them, not a hundred pieces of 16 MB."""
    words = F.transform(F.sequence(F.lit(1), F.lit(599_999)), lambda i: F.pmod(F.hash(i, "id"), F.lit(9000)).cast("string"))
    df = spark.range(0, 40, 1, 1).select(words.alias("terms"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    pieces = tc.written_words(df, "terms", F.lit(0))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    got = pieces.select(F.sum("n").alias("n"), F.max(F.octet_length("codes")).alias("longest"), F.sum(F.octet_length("codes")).alias("all")).first()
    assert got["n"] == 40 and got["all"] == 4 * 40 * 300_000 and got["longest"] <= 4 * max(tc.PIECE, 300_000)
    (file,) = [f.removeprefix("file:") for f in pieces.inputFiles()]
    meta = pq.ParquetFile(Path(file)).metadata
    assert meta.num_row_groups > 1
    stats = tc.term_pair_stats(pieces, lambda w: 10 ** 9, 1)
    assert "MapInArrow" not in stats._jdf.queryExecution().optimizedPlan().toString()  # counted already, in small batches
    stats = stats.agg(F.count("*").alias("n"), F.sum("cf").alias("cf")).first()
    assert stats["n"] == 9000 and stats["cf"] == 40 * 300_000
