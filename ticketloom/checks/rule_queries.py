"""Checked queries: rule classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom import lexicons as lx
from ticketloom.checks import sql as s
from ticketloom.checks.registry import query
from ticketloom.functions.text import WORD
from ticketloom.operators import rules as ru
from ticketloom.sources.tickets import load_tickets

K = "ticket_id"

# Fixed values of the test recipe: routing of categories to groups.
ROUTES = (
    ("gestion_cups", "Contratación"), ("montaje_desmontaje_equipos", "Campo"),
    ("errores_calculo_facturacion", "Facturación"),
    ("estados_calculo_facturacion", "Facturación"), ("cobros_pagos", "Cobros"),
    ("batch_procesos_automaticos", "Explotación"), ("extracciones_informes", "Datos"),
)

_RULE_ROWS = ", ".join(
    f"({i}, {s.q(c)}, {j}, {s.q(k)})"
    for i, (c, kws) in enumerate(lx.RULES) for j, k in enumerate(kws))
_INFO_ROWS = ", ".join(f"({s.q(a)}, {s.q(b)}, {s.q(c)}, {s.q(d)})" for a, b, c, d in lx.CATEGORY_INFO)
RULE_CTES = (
    f"rules(co, category, ko, keyword) as (values {_RULE_ROWS})",
    f"info(category, nombre, descripcion, criticidad) as (values {_INFO_ROWS})",
    f"texts as (select *, {s.RULE_TEXT} as processed_text from tickets)",
    "hits as (select ticket_id, category, co, ko, keyword from texts, rules "
    "where contains(processed_text, keyword))",
    "scores as (select ticket_id, category, co, count(*) as score, "
    "list(keyword order by ko) as ks from hits group by ticket_id, category, co)",
    "best as (select * from scores qualify "
    "row_number() over (partition by ticket_id order by score desc, co) = 1)",
    "ruled as (select t.*, b.category as predicted_type, i.nombre, i.descripcion, "
    "i.criticidad as nivel_criticidad, cast(b.score as integer) as score, "
    "case when b.score is not null then least(cast(0.95 as double), cast(0.7 as double) "
    "+ b.score * cast(0.05 as double)) end as confidence, case when b.score is not null then list_append(b.ks[1:3], 'clasificación automática') end "
    "as palabras_clave, "
    "array_to_string(b.ks[1:2], ', ') as rule_matched, "
    "case when b.category is not null then 'rule' end as source "
    "from texts t left join best b using (ticket_id) left join info i using (category))",
)


def sql(body: str, *more: str) -> str:
    return s.with_tickets(body, *RULE_CTES, *more)


@query("f1_rule_table", (
    f"with r(co, category, ko, keyword) as (values {_RULE_ROWS}), d as (select text from "
    "documents) select category, count(*) as keywords, cast(sum((select count(*) from d where "
    "contains(lower(text), keyword))) as bigint) as documents from r group by category"))
def f1(spark, sf):
    """Size of each category's lexicon and how often its phrases occur in documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.lower("text").alias("t"))
    found = ru.rule_scores(docs, "t").groupBy("category").agg(F.sum("score").alias("n"))
    table = spark.createDataFrame([(c, len(k)) for c, k in lx.RULES], "category string, keywords long")
    return table.join(found, "category", "left").select(
        "category", "keywords", F.coalesce("n", F.lit(0)).alias("documents"))


@query("f2_category_info", sql(
    "select ticket_id, nombre, descripcion, nivel_criticidad from ruled"))
def f2(spark, sf):
    return ru.classify_rules(load_tickets(spark, sf)).select(
        K, "nombre", "descripcion", "nivel_criticidad")


@query("f3_rule_hits", sql(
    "select ticket_id, category, array_to_string(ks, ',') as hits from scores"))
def f3(spark, sf):
    t = ru.with_rule_text(load_tickets(spark, sf)).select(K, "processed_text")
    return ru.rule_scores(t, "processed_text").select(
        K, "category", F.array_join("hits", ",").alias("hits"))


@query("f4_rule_scores", sql("select ticket_id, category, co, score from scores"))
def f4(spark, sf):
    t = ru.with_rule_text(load_tickets(spark, sf)).select(K, "processed_text")
    return ru.rule_scores(t, "processed_text").select(
        K, "category", F.col("category_order").alias("co"), "score")


@query("f5_rule_classify", sql("select ticket_id, predicted_type, score from ruled"))
def f5(spark, sf):
    return ru.classify_rules(load_tickets(spark, sf)).select(K, "predicted_type", "score")


@query("f6_confidence", sql(
    "select ticket_id, round(confidence, 6) as confidence from ruled"))
def f6(spark, sf):
    return ru.classify_rules(load_tickets(spark, sf)).select(
        K, F.round("confidence", 6).alias("confidence"))


@query("f7_explain", sql(
    "select ticket_id, array_to_string(palabras_clave, ',') as palabras_clave, rule_matched, "
    "source from ruled"))
def f7(spark, sf):
    return ru.classify_rules(load_tickets(spark, sf)).select(
        K, F.array_join("palabras_clave", ",").alias("palabras_clave"), "rule_matched", "source")


# Word boundaries for the SQL side: a mark around every sign and at both ends.
def _marked(x: str) -> str:
    return f"(chr(1) || regexp_replace({x}, '([^{s.W}])', chr(1) || '\\1' || chr(1), 'g') || chr(1))"


_WORD_SQL = s.with_tickets(
    "select ticket_id, category, array_to_string(list(keyword order by ko), ',') as hits "
    "from marked_texts, marked_rules where contains(mt, mk) group by ticket_id, category",
    *RULE_CTES[:3],
    f"marked_texts as materialized (select ticket_id, {_marked('processed_text')} as mt from texts)",
    f"marked_rules as materialized (select *, {_marked('keyword')} as mk from rules)",
)


@query("f3_rule_hits_word", _WORD_SQL)
def f3w(spark, sf):
    """Keywords as whole words instead of substrings."""
    t = ru.with_rule_text(load_tickets(spark, sf)).select(K, "processed_text")
    return ru.rule_scores(t, "processed_text", match="word").select(
        K, "category", F.array_join("hits", ",").alias("hits"))


def rules_table(spark):
    """The rule lexicon as a table a user could supply: phrases repeated in other case,
    empty and null ones among them."""
    rows = [(c, i, k, j) for i, (c, ks) in enumerate(lx.RULES) for j, k in enumerate(ks)]
    rows += [(c, i, k.upper(), j + 1000) for c, i, k, j in rows]
    rows += [(c, i, k, 2000) for i, (c, _) in enumerate(lx.RULES) for k in ("", None)]
    return spark.createDataFrame(
        rows, "category string, category_order int, keyword string, keyword_order int")


_F9 = sql(
    "select ticket_id, predicted_type, score, round(confidence, 6) as confidence, rule_matched "
    "from ruled, (values (1), (2)) twice(n) where predicted_type is not null")


def _twice(spark, sf):
    """Every ticket twice: identifiers need not be unique."""
    t = ru.with_rule_text(load_tickets(spark, sf))
    return t.unionAll(t)


def _rounded(df):
    return df.withColumn("confidence", F.round("confidence", 6))


@query("f9_rules_small", _F9)
def f9(spark, sf):
    return _rounded(ru.classify_with_rules(_twice(spark, sf), rules_table(spark)))


@query("f9_rules_large", _F9)
def f9_large(spark, sf):
    """The search tree, forced by a limit of zero phrases."""
    return _rounded(ru.classify_with_rules(_twice(spark, sf), rules_table(spark), limit=0))


# Every word of four letters and more in half of the tickets, categories by its length.
_RUN = f"[{s.W}]+"
_WORD_RULES = (
    f"texts as (select ticket_id, doc_id, list_distinct(regexp_extract_all({s.RULE_TEXT}, '{_RUN}')) as ws from tickets)",
    "rules as (select distinct w as keyword, length(w) % 40 as co from (select unnest(ws) as w from texts "
    "where doc_id % 2 = 0) where length(w) >= 4)",
    "scores as (select ticket_id, co, cast(count(*) as integer) as score, list(keyword order by keyword)[1:2] as ks "
    "from (select ticket_id, unnest(ws) as keyword from texts) join rules using (keyword) group by ticket_id, co)",
)


@query("f9_rules_many", s.with_tickets(
    "select ticket_id, 'c' || co as predicted_type, score, array_to_string(ks, ', ') as rule_matched, "
    "'palabras de ' || co as nombre, case when co % 2 = 0 then 'Alta' end as nivel_criticidad from scores "
    "qualify row_number() over (partition by ticket_id order by score desc, co) = 1", *_WORD_RULES))
def f9_many(spark, sf):
    """A rule table that grows with the tickets, matched as whole words, with texts of its categories."""
    t = ru.with_rule_text(load_tickets(spark, sf)).select(K, "doc_id", "processed_text")
    word = F.explode(F.regexp_extract_all("processed_text", F.lit(f"[{WORD}]+"), F.lit(0))).alias("keyword")
    order = (F.length("keyword") % 40).alias("category_order")
    rules = t.where("doc_id % 2 = 0").select(word).where("length(keyword) >= 4").distinct().select(
        F.concat(F.lit("c"), (F.length("keyword") % 40).cast("string")).alias("category"), order, "keyword",
        F.lit(0).alias("keyword_order"))
    info = spark.range(40).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("category"),
        F.concat(F.lit("palabras de "), F.col("id").cast("string")).alias("nombre"),
        F.lit(None).cast("string").alias("descripcion"), F.when(F.col("id") % 2 == 0, "Alta").alias("nivel_criticidad"))
    done = ru.classify_with_rules(t, rules, limit=0, match="word", info=info)
    return done.select(K, "predicted_type", "score", "rule_matched", "nombre", "nivel_criticidad")


@query("f10_triage", sql(
    "select ticket_id, coalesce(predicted_type, 'sin_clasificar') as incident_type, "
    "coalesce(grupo, 'Sin asignar') as suggested_group, "
    "coalesce(nivel_criticidad, 'No evaluada') as priority, "
    "round(coalesce(confidence, 0), 6) as confidence "
    "from ruled left join routes on predicted_type = category",
    "routes(category, grupo) as (values "
    + ", ".join(f"({s.q(a)}, {s.q(b)})" for a, b in ROUTES) + ")"))
def f10(spark, sf):
    routing = spark.createDataFrame(list(ROUTES), "category string, grupo string")
    return _rounded(ru.triage(ru.classify_rules(load_tickets(spark, sf)), routing))


@query("m13_safe_classify", sql(
    "select ticket_id, case when notas is null then 'ERROR' else predicted_type end as "
    "predicted_type, round(case when notas is null then 0.0 else confidence end, 6) as confidence, "
    "case when notas is null then 'Error en clasificación' else nombre end as nombre, "
    "case when notas is null then 'error' else source end as source from ruled"))
def m13(spark, sf):
    """Tickets without notes stand in for tickets without a summary."""
    t = ru.classify_rules(load_tickets(spark, sf))
    t = t.withColumn("resumen", F.when(F.col("notas").isNotNull(), F.col("resumen")))
    return _rounded(ru.safe_classify(t, t)).select(
        K, "predicted_type", "confidence", "nombre", "source")
