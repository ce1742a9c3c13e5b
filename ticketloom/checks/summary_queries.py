"""Checked queries: summaries, reports, monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom.checks import profile_queries as pq, rule_queries as rq, sql as s
from ticketloom.checks.registry import query
from ticketloom.operators import evaluation as ev, monitor as mo, rules as ru, summary as sm
from ticketloom.sources.tickets import load_tickets

K = "ticket_id"


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


# -- category table ----------------------------------------------------------------

@query("a6_category_report", pq.sql(
    "select row_number() over (order by num_incidencias desc, cluster) as orden, cluster, "
    "upper(nombre) as titulo, num_incidencias, nivel_criticidad as criticidad, descripcion, "
    "array_to_string(ks[1:5], ', ') as palabras_clave, array_to_string(patrones, ', ') as patrones, "
    "array_to_string(ts[1:3], ', ') as tipos_principales, ejemplos from cats"))
def a6(spark, sf):
    return sm.category_report(pq.cats(spark, sf))


@query("m1_executive_summary", pq.sql(
    "select cast(sum(num_incidencias) as bigint) as total_incidencias, count(*) as "
    "categorias_identificadas, count(*) filter (nivel_criticidad = 'Alta') as "
    "categorias_alta_criticidad, format('{:.1f}%', count(*) / 20.0 * 100.0) as cobertura_analisis, "
    "(select nombre from cats order by num_incidencias desc, cluster limit 1) as "
    "categoria_mas_frecuente, cast(null as double) as precision_modelo from cats"))
def m1(spark, sf):
    return sm.executive_summary(pq.cats(spark, sf))


@query("m2_top_categories", pq.sql(
    "select cluster, nombre, num_incidencias from cats order by num_incidencias desc, cluster limit 5"))
def m2(spark, sf):
    return sm.top_categories(pq.cats(spark, sf))


@query("m3_size_stats", pq.sql(
    "select round(avg(num_incidencias), 6) as tamano_promedio_categoria, median(num_incidencias) as "
    "tamano_mediano_categoria, max(num_incidencias) as categoria_mas_grande, min(num_incidencias) as "
    "categoria_mas_pequena, round(stddev_pop(num_incidencias), 6) as desviacion_estandar from cats"))
def m3(spark, sf):
    return rounded(sm.size_stats(pq.cats(spark, sf)), "tamano_promedio_categoria", "desviacion_estandar")


@query("m4_by_criticality", pq.sql(
    "select nivel_criticidad as criticidad, count(*) as categorias from cats group by all"))
def m4(spark, sf):
    return sm.by_criticality(pq.cats(spark, sf))


_BANDS = ("select band as banda, count(num_incidencias) as categorias from (values "
          + ", ".join(f"({s.q(b)})" for b in sm.SIZE_BANDS) + ") b(band) left join cats on band = "
          f"case when num_incidencias < 20 then {s.q(sm.SIZE_BANDS[0])} when num_incidencias <= 50 "
          f"then {s.q(sm.SIZE_BANDS[1])} else {s.q(sm.SIZE_BANDS[2])} end group by band")


@query("m5_by_size_band", pq.sql(_BANDS))
def m5(spark, sf):
    return sm.by_size_band(pq.cats(spark, sf))


@query("m6_coverage", pq.sql("select format('{:.1f}%', count(*) / 20.0 * 100.0) as cobertura from cats"))
def m6(spark, sf):
    return pq.cats(spark, sf).agg(sm.coverage(F.count("*")).alias("cobertura"))


@query("m7_recommendations", pq.sql(
    "select row_number() over (order by o) - 1 as orden, t as recomendacion from (select 1 as o, "
    "'Priorizar atención a ' || count(*) || ' categorías de alta criticidad' as t from cats where "
    "nivel_criticidad = 'Alta' having count(*) > 0 union all select 2, 'Implementar automatización en ' "
    "|| count(*) || ' categorías de alto volumen' from cats where num_incidencias > 50 having "
    "count(*) > 0 union all select * from (values "
    + ", ".join(f"({i + 3}, {s.q(t)})" for i, t in enumerate(sm.GENERAL_RECOMMENDATIONS)) + "))"))
def m7(spark, sf):
    return sm.recommendations(pq.cats(spark, sf))


# -- classified tickets ---------------------------------------------------------------

# Tickets without notes stand in for failed ones, as in m13.
RESULTS_SQL = (
    "results as (select ticket_id, " + pq.cut("resumen", 200) + " as resumen_original, "
    "coalesce(tipo_ticket, 'No especificado') as tipo_ticket_original, "
    "case when notas is null then 'ERROR' else coalesce(predicted_type, 'tipo_' || "
    "lpad(cast(cluster as varchar), 2, '0')) end as categoria_predicha, "
    "round(case when notas is null then 0.0 else coalesce(confidence, 0.0) end, 3) as confianza, "
    "predicted_type, cluster, nombre, descripcion, nivel_criticidad, palabras_clave, notas from ruled)"
)
NAMED_SQL = (
    "final as (select r.*, case when r.notas is null then 'Error en clasificación' else "
    "coalesce(r.nombre, c.nombre) end as nombre_categoria, case when r.notas is null then "
    "'Error: resumen ausente' else coalesce(r.descripcion, c.descripcion) end as "
    "descripcion_categoria, case when r.notas is null then 'No evaluada' else "
    "coalesce(r.nivel_criticidad, c.nivel_criticidad) end as criticidad, "
    "case when r.notas is null then [] else coalesce(r.palabras_clave, c.ks[1:10])[1:5] end as "
    "palabras from results r left join cats c on c.cluster = r.cluster)"
)


def rsql(body: str) -> str:
    return s.with_tickets(body, *rq.RULE_CTES, *pq.PROFILE_CTES, RESULTS_SQL, NAMED_SQL)


def results(spark, sf):
    """Named results: rules first, else the planted cluster of the ticket."""
    t = load_tickets(spark, sf)
    done = ru.classify_rules(t)
    done = done.withColumn(
        "predicted_type",
        F.coalesce("predicted_type", F.format_string("tipo_%02d", "cluster")))
    failed = done.withColumn("_keep", F.col("resumen")).withColumn(
        "resumen", F.when(F.col("notas").isNotNull(), F.col("resumen")))
    safe = ru.safe_classify(failed, failed).withColumn("resumen", F.col("_keep")).drop("_keep")
    from ticketloom.operators.profiles import profile_clusters

    return ru.name_results(safe, profile_clusters(t))


@query("m12_name_results", rsql(
    "select ticket_id, resumen_original, tipo_ticket_original, categoria_predicha, confianza, "
    "nombre_categoria, descripcion_categoria, criticidad, array_to_string(palabras, ',') as "
    "palabras_clave from final"))
def m12(spark, sf):
    return results(spark, sf).withColumn("palabras_clave", F.array_join("palabras_clave", ","))


@query("m8_holdout_totals", rsql(
    "select count(*) as total, count(*) filter (categoria_predicha <> 'ERROR') as exitosos, "
    "count(*) filter (categoria_predicha = 'ERROR') as con_error from final"))
def m8(spark, sf):
    return sm.holdout_totals(results(spark, sf))


@query("m9_confidence_stats", rsql(
    "select round(avg(confianza), 6) as promedio, min(confianza) as minima, max(confianza) as maxima, "
    "count(*) filter (confianza > 0.8) as alta_confianza from final where confianza > 0"))
def m9(spark, sf):
    return rounded(sm.confidence_stats(results(spark, sf)), "promedio")


@query("m10_confidence_bands", rsql(
    "select case when confianza > 0.8 then 'alta_confianza' when confianza >= 0.5 then "
    "'media_confianza' else 'baja_confianza' end as banda, count(*) as casos from final "
    "where confianza > 0 group by all"))
def m10(spark, sf):
    return sm.confidence_bands(results(spark, sf))


@query("m11_category_distribution", rsql(
    "select nombre_categoria, count(*) as casos, round(count(*) * 100.0 / sum(count(*)) over (), 6) "
    "as porcentaje from final group by nombre_categoria"))
def m11(spark, sf):
    return rounded(sm.category_distribution(results(spark, sf)), "porcentaje")


@query("m11_rule_summary", rq.sql(
    "select predicted_type, count(*) as tickets, round(avg(confidence), 6) as mean_confidence, "
    "round(avg(score), 6) as mean_score from ruled group by predicted_type"))
def flagship(spark, sf):
    """Flagship: tickets, mean confidence and mean score per rule category."""
    out = sm.rule_summary(ru.classify_rules(load_tickets(spark, sf)))
    return rounded(out, "mean_confidence", "mean_score")


# -- monitoring ------------------------------------------------------------------------

LABELLED = ("lab as (select t.created_at, quality as label, toxic as prediction, doc_id "
            "from tickets t join labels using (doc_id))",
            "wk as (select cast(date_trunc('week', created_at) as date) as week, count(*) as n, "
            "avg(cast(label <> prediction as int)) as accuracy from lab group by 1)")


def labelled(spark, sf):
    """Labels with a time; the second rater is turned round so that most rows agree."""
    t = load_tickets(spark, sf).select("doc_id", "created_at")
    lab = spark.read.parquet(f"{sf}/labels.parquet").select(
        "doc_id", F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction"))
    return t.join(lab, "doc_id")


def _weekly(spark, sf):
    return mo.weekly_accuracy(labelled(spark, sf))


def _day(df):
    return df.withColumn("week", F.col("week").cast("string"))


@query("n2_weekly_accuracy", s.with_tickets(
    "select cast(week as varchar) as week, n, round(accuracy, 6) as accuracy from wk", *LABELLED))
def n2(spark, sf):
    return _day(rounded(_weekly(spark, sf), "accuracy"))


@query("n3_threshold_alerts", s.with_tickets(
    "select cast(week as varchar) as week, round(accuracy, 6) as accuracy, case when accuracy < 0.85 "
    "then 'review' when accuracy > 0.88 then 'on_target' else 'watch' end as state from wk", *LABELLED))
def n3(spark, sf):
    return _day(rounded(mo.threshold_alerts(_weekly(spark, sf)), "accuracy"))


@query("n4_retrain_trigger", s.with_tickets(
    "select cast(week as varchar) as week, round(accuracy, 6) as accuracy, exists (select 1 from wk b "
    "where b.week = a.week - 7 and b.accuracy < 0.87) as retrain from wk a where accuracy < 0.87",
    *LABELLED))
def n4(spark, sf):
    return _day(rounded(mo.retrain_trigger(_weekly(spark, sf)), "accuracy"))


@query("n5_weekly_confidence", rq.sql(
    "select cast(cast(date_trunc('week', created_at) as date) as varchar) as week, case when "
    "confidence > 0.8 then 'alta_confianza' when confidence >= 0.5 then 'media_confianza' else "
    "'baja_confianza' end as band, count(*) as n, round(count(*) / sum(count(*)) over (partition by "
    "date_trunc('week', created_at)), 6) as share from ruled where confidence > 0 group by "
    "date_trunc('week', created_at), band"))
def n5(spark, sf):
    done = rounded(ru.classify_rules(load_tickets(spark, sf)).select("created_at", "confidence"),
                   "confidence")
    return _day(rounded(mo.weekly_confidence(done), "share"))


@query("n6_mix_drift", (
    "with c as (select cast(date_trunc('week', ts) as date) as week, event_type as kind, count(*) as n "
    "from events group by all), b as (select kind, sum(n) / (select sum(n) from c where week < date "
    "'2024-01-15') as s from c where week < date '2024-01-15' group by kind), w as (select week, "
    "sum(n) as wn from c where week >= date '2024-01-15' group by week), k as (select week, kind from "
    "w, b union select week, kind from c where week >= date '2024-01-15'), d as (select week, kind, "
    "coalesce(c.n, 0) / wn - coalesce(s, 0) as delta from k join w using (week) left join c using "
    "(week, kind) left join b using (kind)) select cast(week as varchar) as week, kind, "
    "round(delta, 6) as delta, round(sum(abs(delta)) over (partition by week) / 2, 6) as "
    "total_variation from d"))
def n6(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type")
    d = mo.mix_drift(events, "event_type", "ts", "2024-01-15")
    return _day(rounded(d, "delta", "total_variation"))


# Every URL-like kind there is: type and user together, thousands of kinds.
@query("n6_mix_drift_seen", (
    "with e as (select ts, event_type || '-' || cast(user_id as varchar) as kind from events), "
    "c as (select cast(date_trunc('week', ts) as date) as week, kind, count(*) as n "
    "from e group by all), b as (select kind, sum(n) / (select sum(n) from c where week < date "
    "'2024-01-15') as s from c where week < date '2024-01-15' group by kind), w as (select week, "
    "sum(n) as wn from c where week >= date '2024-01-15' group by week), d as (select week, kind, "
    "n / wn - coalesce(s, 0) as delta, coalesce(s, 0) as s from c join w using (week) left join b using (kind)), "
    "t as (select week, (select coalesce(sum(s), 0) from b) - sum(s) as lost, sum(abs(delta)) as moved from d group by week) "
    "select cast(week as varchar) as week, kind, true as seen, round(delta, 6) as delta, "
    "round((moved + lost) / 2, 6) as total_variation from d join t using (week) union all "
    "select cast(week as varchar), null, false, round(-lost, 6), round((moved + lost) / 2, 6) from t where lost > 1e-12"))
def n6_seen(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        "ts", F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("kind"))
    d = mo.mix_drift_seen(events, "kind", "ts", "2024-01-15")
    return _day(rounded(d, "delta", "total_variation"))


@query("n7_unbalanced_clusters", s.with_tickets(
    "select cluster, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from tickets "
    "group by cluster qualify count(*) / sum(count(*)) over () > 0.25"))
def n7(spark, sf):
    return rounded(mo.unbalanced_clusters(load_tickets(spark, sf)), "share")
