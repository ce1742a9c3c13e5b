import pytest
from pyspark.sql import functions as F

from ticketloom.operators import rules as ru
from ticketloom.plans.classify import classify


def classified(spark, *texts, **kw):
    df = spark.createDataFrame(
        [(str(i), t, None, None) for i, t in enumerate(texts)],
        "ticket_id string, resumen string, notas string, tipo_ticket string")
    return ru.classify_rules(df, **kw).orderBy("ticket_id").collect()


@pytest.mark.parametrize("text,category,score,confidence", [
    ("alta cups", "gestion_cups", 2, 0.80),
    ("solicito listado de clientes", "errores_calculo_facturacion", 1, 0.75),
    ("consulta", "extracciones_informes", 1, 0.75),
    ("fail batch job decmd040p", "batch_procesos_automaticos", 3, 0.85),
    ("bono social vulnerable vulnerabilidad renovación bono social", "bono_social_vulnerabilidad", 5, 0.95),
])
def test_winner(spark, text, category, score, confidence):
    r = classified(spark, text)[0]
    assert (r["predicted_type"], r["score"]) == (category, score)
    assert r["confidence"] == pytest.approx(confidence)
    assert r["source"] == "rule"


def test_no_match_is_null(spark):
    r = classified(spark, "xyz")[0]
    assert r["predicted_type"] is None and r["confidence"] is None and r["nombre"] is None


def test_word_mode_does_not_hit_inside_words(spark):
    r = classified(spark, "solicito listado de clientes", match="word")[0]
    assert r["predicted_type"] == "extracciones_informes"


def test_explanation(spark):
    r = classified(spark, "alta cups y baja cups, regularizar cups")[0]
    assert r["palabras_clave"] == ["alta cups", "baja cups", "regularizar cups", "clasificación automática"]
    assert r["rule_matched"] == "alta cups, baja cups"


def test_filter_on_result_does_not_copy_the_search(spark, tickets):
    """A later filter must not bring the phrase search into the plan a second time."""
    df = ru.classify_rules(tickets).where("predicted_type IS NOT NULL").select("ticket_id", "predicted_type")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert "Join" not in plan and "Aggregate" not in plan


def test_small_and_large_rule_tables_agree(spark):
    df = spark.createDataFrame(
        [("a", "el proceso oc y la colada"), ("b", "social y bono social"), ("c", "nada"), ("d", "o c")],
        "ticket_id string, processed_text string")
    rows = [("x", 0, "oc", 0), ("x", 0, "cola", 1), ("y", 1, "bono social", 0), ("y", 1, "Social", 1),
            ("z", 2, "o", 0)]
    rules = spark.createDataFrame(rows, "category string, category_order int, keyword string, keyword_order int")
    small = ru.classify_with_rules(df, rules)
    large = ru.classify_with_rules(df, rules, limit=0)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    got = {r["ticket_id"]: (r["predicted_type"], r["score"], r["rule_matched"]) for r in small.collect()}
    assert got == {"a": ("x", 2, "oc, cola"), "b": ("y", 2, "bono social, social"), "d": ("z", 1, "o")}


def test_triage_keeps_unrouted(spark, tickets):
    routing = spark.createDataFrame([("gestion_cups", "Contratación")], "category string, grupo string")
    out = ru.triage(ru.classify_rules(tickets), routing)
    assert out.count() == tickets.count()
    groups = {r[0] for r in out.select("suggested_group").distinct().collect()}
    assert groups == {"Contratación", "Sin asignar"}


def test_safe_classify_error_rows(spark):
    df = spark.createDataFrame([("1", None, "batch", None), ("2", "batch", None, None)],
                               "ticket_id string, resumen string, notas string, tipo_ticket string")
    out = {r["ticket_id"]: r for r in ru.safe_classify(df).collect()}
    assert out["1"]["predicted_type"] == "ERROR" and out["1"]["confidence"] == 0.0
    assert out["2"]["predicted_type"] == "batch_procesos_automaticos"


def test_classify_without_model_keeps_all_rows(spark, tickets):
    out = classify(tickets)
    assert out.count() == tickets.count()
    levels = out.where(F.col("confidence").isNotNull()).agg(F.min("confidence"), F.max("confidence")).first()
    assert levels[0] >= 0.75 and levels[1] <= 0.95
