"""Streams that are restarted, and tickets that come late or twice."""

import datetime as dt

from pyspark.sql import functions as F

from ticketloom.operators import monitor as mo
from ticketloom.sources.tickets import TICKET_SCHEMA
from ticketloom.streaming import tickets as st

SCHEMA = "ticket_id string, created_at timestamp, label int, prediction int"


def rows(days, tag, wrong=3):
    return [(f"{tag}{d}", dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=3), 1, int(d % wrong != 0)) for d in days]


def feed(spark, inbox, batch):
    spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)


def test_stream_and_late_table_are_the_batch_result(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    batches = [rows(range(0, 20), "a"), rows(range(5, 30), "b"), rows([1, 2, 27, 28], "c") + [("n", None, 1, 1)], rows(range(30, 33), "d")]
    for batch in batches:  # every start goes on where the last one ended
        feed(spark, inbox, batch)
        stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).parquet(inbox)
        st.accuracy_and_late(stream, out, mark).awaitTermination()
    every = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    late = st.late_tickets(spark, out, every.schema)
    ids = sorted(r.ticket_id for r in late.collect())
    assert ids == sorted([f"b{d}" for d in range(5, 17)] + ["c1", "c2", "n"])
    want = sorted(map(tuple, mo.weekly_accuracy(every.where("created_at is not null")).collect()))
    got = sorted(map(tuple, st.weekly_from_stream(spark, out, late).collect()))
    assert [(w, n, round(a, 9)) for w, n, a in got] == [(w, n, round(a, 9)) for w, n, a in want]
    alone = st.weekly_from_stream(spark, out).agg(F.sum("n")).first()[0]
    assert alone == every.count() - len(ids)


def test_a_batch_run_again_counts_once(spark, tmp_path):
    """The checkpoint forgets its last commit: the batch comes again and takes its own place."""
    inbox, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = spark.createDataFrame([], SCHEMA).schema
    for k, batch in enumerate((rows(range(9), "a"), rows(range(9, 15), "b"))):
        feed(spark, inbox, batch)
        for sink, where in ((st.accuracy_and_late, "acc"), (st.each_batch_once, "rows")):
            sink(spark.readStream.schema(schema).parquet(inbox), f"{out}/{where}", f"{mark}/{where}").awaitTermination()
    for where in ("acc", "rows"):
        for name in ("1", ".1.crc"):
            (tmp_path / "mark" / where / "commits" / name).unlink()
    for sink, where in ((st.accuracy_and_late, "acc"), (st.each_batch_once, "rows")):
        sink(spark.readStream.schema(schema).parquet(inbox), f"{out}/{where}", f"{mark}/{where}").awaitTermination()
    assert st.weekly_from_stream(spark, f"{out}/acc").agg(F.sum("n")).first()[0] == 15
    assert sorted(r.ticket_id for r in spark.read.parquet(f"{out}/rows").collect()) == sorted(
        r[0] for r in rows(range(9), "a") + rows(range(9, 15), "b"))


def test_drift_of_many_kinds(spark):
    """A hundred thousand kinds: rows grow with what is seen, and both forms have one total variation."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 28).cast("int")).cast("timestamp")
    df = spark.range(300_000).select(day.alias("ts"), (F.col("id") * 7919 % 100_003).alias("kind"))
    d = mo.mix_drift_seen(df, "kind", "ts", "2024-01-15")
    seen = df.where("ts >= '2024-01-15'").select(mo.week_of("ts").alias("week"), "kind").distinct().count()
    assert d.count() == seen + d.where("not seen").count() <= seen + 2
    few = df.withColumn("kind", F.when(F.col("kind") % 9 == 0, F.lit(None)).otherwise(F.col("kind") % 40))
    few = few.where("kind is not null and not (kind = 3 and ts >= '2024-01-15')")
    one = {r.week: round(r.total_variation, 9) for r in mo.mix_drift(few, "kind", "ts", "2024-01-15").select("week", "total_variation").distinct().collect()}
    two = mo.mix_drift_seen(few, "kind", "ts", "2024-01-15").cache()
    assert {r.week: round(r.total_variation, 9) for r in two.select("week", "total_variation").distinct().collect()} == one
    assert two.where("not seen").count() == 2
    total = {r.week: r.s for r in two.groupBy("week").agg(F.sum("delta").alias("s")).collect()}
    assert all(abs(x) < 1e-9 for x in total.values())


def test_one_file_is_classified_by_several_tasks(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    tickets = [(f"t{i}", f"Error de factura {i}", "nota", "PETICION", None, None, "Alta", None) for i in range(400)]
    spark.createDataFrame(tickets + tickets[:1], TICKET_SCHEMA).coalesce(1).write.parquet(inbox)
    st.classify_stream(st.ticket_stream(spark, inbox, files_per_batch=1), out, mark).awaitTermination()
    back = spark.read.parquet(out)
    assert sorted(r.ticket_id for r in back.collect()) == sorted([t[0] for t in tickets] + ["t0"])
    assert back.select(F.input_file_name()).distinct().count() == spark.sparkContext.defaultParallelism
