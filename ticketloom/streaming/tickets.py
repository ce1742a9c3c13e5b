"""Classification of arriving tickets and accuracy on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ticketloom.operators.monitor import week_of
from ticketloom.plans.classify import TicketModel, classify
from ticketloom.sources.tickets import TICKET_SCHEMA


def ticket_stream(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = TICKET_SCHEMA,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Files that arrive in a folder, with a fixed schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def classify_stream(
    tickets: DataFrame, path: str, checkpoint: str, model: TicketModel | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Classify arriving tickets and append them to a parquet table.

    ``trigger`` is Spark's, such as ``{"processingTime": "1 minute"}``; by default everything
    available is classified. Classification keeps no state, so a batch is as large as its files.
    Its tickets are dealt over the cores, however few files it has.
    """
    cores = tickets.sparkSession.sparkContext.defaultParallelism
    return (
        classify(tickets.repartition(cores), model)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def each_batch_once(
    df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write each batch to a partition of its own, ``batch=<id>``.

    A batch that is run again after a failure overwrites its own partition, so a reader finds
    every row once, whatever the sink's file system promises.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


WEEK_PARTS = "week date, n long, hits long"


def accuracy_and_late(
    labelled: DataFrame, path: str, checkpoint: str, ts: str = "created_at", label: str = "label",
    prediction: str = "prediction", late: str = "2 days", trigger: dict | None = None,
) -> StreamingQuery:
    """Weekly counts of a stream, with the tickets behind the watermark in a table of their own.

    The watermark of a batch is the latest time of the batches before it less ``late``. A
    batch writes three partitions below ``path``: its latest time, its counts by week, and
    its late tickets whole. Each is overwritten when the batch is run again, so counts and
    late tickets together are those of a batch job over the same tickets, also after a
    restart. A ticket without a time counts for no week and is kept with the late ones.
    """
    kept = labelled.schema

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        marks = f"{path}/marks"
        batch.agg(F.max(ts).cast("timestamp").alias("latest")).withColumn("batch", F.lit(number).cast("long")).write.mode(
            "overwrite").parquet(f"{marks}/part={number}")
        before = spark.read.schema("latest timestamp, batch long").parquet(marks).where(F.col("batch") < number)
        mark = before.agg((F.max("latest") - F.expr(f"interval {late}")).alias("mark")).first()["mark"]
        time = F.col(ts).cast("timestamp")
        behind = time.isNull() if mark is None else time.isNull() | (time < F.lit(mark))
        hit = (F.col(label) == F.col(prediction)).cast("long")
        batch.where(~behind).groupBy(week_of(ts).alias("week")).agg(
            F.count("*").alias("n"), F.coalesce(F.sum(hit), F.lit(0)).alias("hits")).write.mode("overwrite").parquet(f"{path}/weeks/part={number}")
        batch.where(behind).select(*kept.names).write.mode("overwrite").parquet(f"{path}/late/part={number}")
        batch.unpersist()

    return labelled.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def late_tickets(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The tickets that ``accuracy_and_late`` found behind the watermark."""
    return spark.read.schema(schema).parquet(f"{path}/late").select(*schema.names)


def weekly_from_stream(spark: SparkSession, path: str, late: DataFrame | None = None, ts: str = "created_at",
                       label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows and accuracy per week of the stream so far; with ``late`` these tickets count, too."""
    parts = spark.read.schema(WEEK_PARTS).parquet(f"{path}/weeks").select("week", "n", "hits")
    if late is not None:
        hit = (F.col(label) == F.col(prediction)).cast("long")
        parts = parts.unionByName(late.where(F.col(ts).isNotNull()).groupBy(week_of(ts).alias("week")).agg(
            F.count("*").alias("n"), F.coalesce(F.sum(hit), F.lit(0)).alias("hits")))
    return parts.groupBy("week").agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("accuracy"))


def windowed_accuracy(
    labelled: DataFrame, ts: str = "created_at", label: str = "label",
    prediction: str = "prediction", late: str = "2 days", width: str = "1 week",
) -> DataFrame:
    """Rows and accuracy per window; tickets later than ``late`` are left out.

    The watermark bounds the state: a window is dropped once it can no longer change.
    Weeks start on Monday, as in the batch form.
    """
    same = (F.col(label) == F.col(prediction)).cast("double")
    zone = F.current_timezone()
    # Windows are cut in UTC: move the wall-clock time there and back.
    timed = labelled.withColumn("_ts", F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone))
    return (
        timed.withWatermark("_ts", late)
        .groupBy(F.window("_ts", width, startTime="4 days").alias("w"))
        .agg(F.count("*").alias("n"), F.avg(same).alias("accuracy"))
        .select(F.to_utc_timestamp("w.start", zone).cast("date").alias("week"), "n", "accuracy")
    )


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over all that is available, appending to a parquet table."""
    q = (
        df.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
