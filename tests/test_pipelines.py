import json
from pathlib import Path

from pyspark.sql import functions as F

from ticketloom.config import AnalyzerConfig, Config
from ticketloom.operators import rules as ru
from ticketloom.plans import train as tr
from ticketloom.plans.classify import TicketModel, classify
from ticketloom.sources.tickets import TICKET_SCHEMA
from ticketloom.streaming import tickets as st

LIGHT = Config(max_features=300, restarts=1, max_iter=10, trees=5, max_depth=5)


def test_train_save_load_classify(spark, tickets, tmp_path):
    out = str(tmp_path / "out")
    run = tr.train_pipeline(tickets, LIGHT, out)
    m = run.metrics.first()
    assert m["num_clusters"] <= 10 and 0 <= m["model_accuracy"] <= 1 and m["model_cv_score"] is None
    assert run.sizes.agg(F.sum("size")).first()[0] == tickets.count()
    loaded = TicketModel.load(spark, f"{out}/models")
    a = classify(tickets, run.model).select("ticket_id", "predicted_type", F.round("confidence", 9))
    b = classify(tickets, loaded).select("ticket_id", "predicted_type", F.round("confidence", 9))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.count() == tickets.count()
    assert a.where("predicted_type IS NULL").count() == 0
    (file,) = Path(out, "data/analisis").glob("part-*.json")
    doc = json.loads(file.read_text())
    assert set(doc) == {"metadata", "tipos_de_incidencia", "metricas_modelo", "cluster_info"}
    assert sum(v["num_incidencias"] for v in doc["tipos_de_incidencia"].values()) == tickets.count()
    assert sum(doc["cluster_info"]["cluster_sizes"].values()) == tickets.count()


def test_training_keeps_tickets_without_or_with_repeated_ids(spark, tickets, tmp_path):
    odd = tickets.withColumn("ticket_id", F.when(F.col("doc_id") < 5, F.lit(None)).when(F.col("doc_id") < 9, F.lit("T")).otherwise(F.col("ticket_id")))
    run = tr.train_pipeline(odd, LIGHT, str(tmp_path / "o"), cv_folds=2)
    assert run.sizes.agg(F.sum("size")).first()[0] == odd.count() == run.clustered.count()
    assert 0 <= run.metrics.first()["model_cv_score"] <= 1
    assert "entities" in run.clustered.columns
    for name in ("categorias", "resumen_ejecutivo", "principales"):
        assert list(Path(tmp_path, "o/reports", name).glob("part-*.json"))


def test_cascade_gives_the_model_only_open_tickets(spark, tickets):
    run = tr.train_pipeline(tickets, LIGHT)
    open_ids = {r[0] for r in ru.classify_rules(tickets).where("predicted_type IS NULL").select("ticket_id").collect()}
    by_model = {r[0] for r in classify(tickets, run.model).where("source = 'model'").select("ticket_id").collect()}
    assert by_model == open_ids


def test_analyzer_merges_and_writes(spark, tickets, tmp_path):
    cfg = AnalyzerConfig(max_features=300, restarts=1, max_iter=10, max_categories=4)
    cats, final = tr.analyze_incidents(tickets, cfg, str(tmp_path / "a"))
    known = tickets.where("causa_raiz IS NOT NULL").count()
    assert final.count() == known
    assert cats.agg(F.sum("num_incidencias")).first()[0] == known
    (file,) = Path(tmp_path, "a/estadisticas").glob("part-*.json")
    doc = json.loads(file.read_text())
    assert set(doc) == {"resumen_ejecutivo", "estadisticas_clustering", "distribuciones", "recomendaciones"}


def test_holdout_harness(spark, tickets, tmp_path):
    results, _ = tr.holdout_test(tickets, 20, LIGHT, str(tmp_path / "h"), n_train=100)
    assert results.count() == 20
    assert results.where("nombre_categoria IS NULL").count() == 0
    assert spark.read.parquet(str(tmp_path / "h/data/casos_prueba_original")).count() == 20


def test_stream_equals_batch(spark, tickets, tmp_path):
    t = tickets.select(*TICKET_SCHEMA.names)
    t.repartition(4).write.parquet(str(tmp_path / "in"))
    run = tr.train_pipeline(tickets, LIGHT)
    stream = st.ticket_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    st.classify_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), run.model).awaitTermination()
    cols = ["ticket_id", "predicted_type", "score", "source"]
    got = spark.read.parquet(str(tmp_path / "out")).select(*cols).collect()
    want = classify(t, run.model).select(*cols).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_late_tickets_are_left_out(spark, tmp_path):
    """A row far behind the watermark does not reopen a closed week."""
    def write(rows, name):
        df = spark.createDataFrame(rows, "s string, label int, prediction int")
        df = df.select(F.col("s").cast("timestamp_ntz").alias("created_at"), "label", "prediction")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return df.schema

    schema = write([("2024-01-02", 1, 1), ("2024-01-20", 1, 0)], "a")

    def run():
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        st.run_available(st.windowed_accuracy(s), str(tmp_path / "out"), str(tmp_path / "cp"))

    run()
    write([("2024-01-03", 1, 1), ("2024-02-20", 1, 1)], "b")
    run()
    rows = {str(r["week"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {"2024-01-01": 1, "2024-01-15": 1}
