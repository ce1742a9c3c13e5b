"""Rule classification: ordered keyword categories, highest score wins."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame, functions as F

from ticketloom import lexicons as lx
from ticketloom.functions.phrases import phrases_in
from ticketloom.functions.text import default_text, ellipsize, literals, rule_text
from ticketloom.operators.ranking import broadcast_if_small
from ticketloom.operators.rule_search import RULE_BYTES, best_rules

Rules = Sequence[tuple[str, Sequence[str]]]
Info = Sequence[tuple[str, str, str, str]]

AUTOMATIC = "clasificación automática"
FEW_RULES = 2000
BROADCAST_ROUTES = 10_000
ENTITY_MAP = "map<string,array<string>>"


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters cannot copy.

    A filter on anything derived from a plain projected column is pushed below the
    projection and evaluates the column's expression again, once per use.  It is not
    pushed below a one-row ``explode``.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _lowered(rules: Rules) -> list[tuple[str, list[str]]]:
    return [(c, [k.lower() for k in kws]) for c, kws in rules]


def with_phrases(
    df: DataFrame, text: str, rules: Rules = lx.RULES, match: str = "substring",
    out: str = "phrases",
) -> DataFrame:
    """Add the distinct rule phrases present in the text."""
    every = [k for _, kws in _lowered(rules) for k in kws]
    return _once(df, out, phrases_in(text, every, match))


def rule_hits(phrases: Column | str, keywords: Sequence[str]) -> Column:
    """Keywords of one category that are present, in lexicon order."""
    p = F.col(phrases) if isinstance(phrases, str) else phrases
    return F.array_intersect(literals([k.lower() for k in keywords]), p)


def rule_scores(
    df: DataFrame, text: str, rules: Rules = lx.RULES, match: str = "substring"
) -> DataFrame:
    """One row per ticket and category with a score above zero.

    Row-local: the categories are literals, so nothing is joined or shuffled.
    """
    hits = with_phrases(df, text, rules, match)
    scored = F.array(
        *[
            F.struct(
                F.lit(c).alias("category"),
                F.lit(i).alias("category_order"),
                rule_hits("phrases", kws).alias("hits"),
            )
            for i, (c, kws) in enumerate(_lowered(rules))
        ]
    )
    return (
        hits.withColumn("_all", F.when(F.size("phrases") > 0, scored))
        .withColumn("_hit", F.explode(F.filter("_all", lambda x: F.size(x["hits"]) > 0)))
        .select(*df.columns, "_hit.*", F.size("_hit.hits").alias("score"))
    )


def confidence(score: Column | str) -> Column:
    """0.70 plus 0.05 per keyword, at most 0.95."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s.isNotNull(), F.least(F.lit(0.95), F.lit(0.70) + s * F.lit(0.05)))


def _pick(values: Sequence[str], position: Column) -> Column:
    # The guard matters: element_at of a literal array is typed as never null, so a
    # null position would otherwise read an arbitrary element.
    return F.when(position.isNotNull(), F.element_at(literals(values), position))


def category_fields(category_position: Column, rules: Rules, info: Info) -> dict[str, Column]:
    """Category id, name, description and criticality by 1-based position."""
    by_id = {i[0]: i for i in info}
    rows = [by_id.get(c, (c, c, None, None)) for c, _ in rules]
    p = category_position
    return {
        "predicted_type": _pick([r[0] for r in rows], p),
        "nombre": _pick([r[1] for r in rows], p),
        "descripcion": _pick([r[2] for r in rows], p),
        "nivel_criticidad": _pick([r[3] for r in rows], p),
    }


def best_rule(
    df: DataFrame, text: str, rules: Rules = lx.RULES, info: Info = lx.CATEGORY_INFO,
    match: str = "substring",
) -> DataFrame:
    """Add the winning category; columns stay null where no rule matches.

    The highest score wins; of equal scores the earliest category does.
    """
    ordered = _lowered(rules)
    hits = with_phrases(df, text, ordered, match, out="_phrases")
    counts = F.array(*[F.size(rule_hits("_phrases", kws)) for _, kws in ordered])
    scored = _once(hits, "_scores", F.when(F.size("_phrases") > 0, counts))
    best = scored.withColumn("_score", F.array_max("_scores")).withColumn(
        "_pos", F.array_position("_scores", F.col("_score")).cast("int")
    )
    lists = F.array(*[literals(kws) for _, kws in ordered])
    won = F.when(F.col("_pos").isNotNull(), F.element_at(lists, F.col("_pos")))
    named = best.withColumn("_hits", F.array_intersect(won, "_phrases"))
    fields = category_fields(F.col("_pos"), ordered, info)
    out = named.withColumns(
        {
            **fields,
            "confidence": confidence("_score"),
            "palabras_clave": F.concat(F.slice("_hits", 1, 3), F.array(F.lit(AUTOMATIC))),
            "rule_matched": F.when(
                F.col("_pos").isNotNull(), F.array_join(F.slice("_hits", 1, 2), ", ")
            ),
            "score": F.col("_score"),
        }
    )
    return out.drop("_phrases", "_scores", "_score", "_pos", "_hits")


def with_rule_text(df: DataFrame, out: str = "processed_text") -> DataFrame:
    """Rule text of a ticket: summary, notes and ticket type."""
    return df.withColumn(out, rule_text("resumen", "notas", "tipo_ticket"))


def classify_rules(
    df: DataFrame, rules: Rules = lx.RULES, info: Info = lx.CATEGORY_INFO,
    match: str = "substring",
) -> DataFrame:
    """Classify tickets by rules alone: a narrow projection, no shuffle.

    Tickets without a match keep their row with a null type, for the model.
    """
    out = best_rule(with_rule_text(df), "processed_text", rules, info, match)
    matched = F.col("predicted_type").isNotNull()
    return out.withColumns(
        {
            "extracted_entities": F.when(matched, F.create_map().cast(ENTITY_MAP)),
            "source": F.when(matched, F.lit("rule")),
        }
    )


def safe_classify(df: DataFrame, classified: DataFrame | None = None) -> DataFrame:
    """Keep tickets without a summary as ``ERROR`` rows with confidence zero.

    Expressions never throw on a row, so a missing summary is the one way a ticket
    can fail.
    """
    out = classify_rules(df) if classified is None else classified
    bad = F.col("resumen").isNull()
    none = F.array().cast("array<string>")
    return out.withColumns(
        {
            "predicted_type": F.when(bad, F.lit("ERROR")).otherwise(F.col("predicted_type")),
            "confidence": F.when(bad, F.lit(0.0)).otherwise(F.col("confidence")),
            "nombre": F.when(bad, F.lit("Error en clasificación")).otherwise(F.col("nombre")),
            "descripcion": F.when(bad, F.lit("Error: resumen ausente")).otherwise(
                F.col("descripcion")
            ),
            "nivel_criticidad": F.when(bad, F.lit("No evaluada")).otherwise(
                F.col("nivel_criticidad")
            ),
            "palabras_clave": F.when(bad, none).otherwise(F.col("palabras_clave")),
            "rule_matched": F.when(~bad, F.col("rule_matched")),
            "score": F.when(~bad, F.col("score")),
            "source": F.when(bad, F.lit("error")).otherwise(F.col("source")),
        }
    )


# -- user-supplied rule tables ----------------------------------------------

def prepared_rules(rules_df: DataFrame) -> DataFrame:
    """A rule table as both forms use it: lower case, no null or empty phrase, each phrase
    of a category once, at its first place."""
    return (
        rules_df.select("category", "category_order", F.lower("keyword").alias("keyword"), "keyword_order")
        .where("category is not null and keyword <> ''")
        .groupBy("category", "category_order", "keyword")
        .agg(F.min("keyword_order").alias("keyword_order"))
    )


def few_rules(rules: DataFrame, limit: int = FEW_RULES) -> list[tuple[str, list[str]]] | None:
    """A prepared rule table as a list when it has at most ``limit`` phrases, else None."""
    rows = rules.limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    out: dict[tuple[int, str], list[tuple[int, str]]] = {}
    for r in rows:
        out.setdefault((r["category_order"], r["category"]), []).append((r["keyword_order"], r["keyword"]))
    return [(c, [k for _, k in sorted(kws)]) for (_, c), kws in sorted(out.items())]


def with_category_texts(df: DataFrame, info: DataFrame | None) -> DataFrame:
    """Add name, description and criticality of ``predicted_type``; its id where the table has no row.

    ``info``: category, nombre, descripcion, nivel_criticidad; of several rows of a category
    the first by its fields counts.
    """
    fields = ("nombre", "descripcion", "nivel_criticidad")
    if info is None:
        return df
    one = info.groupBy(F.col("category").alias("predicted_type")).agg(F.min(F.struct(*fields)).alias("_texts"))
    named = df.join(broadcast_if_small(one, BROADCAST_ROUTES), "predicted_type", "left")
    texts = {f: F.col(f"_texts.{f}") for f in fields}
    for f in fields[:2]:
        texts[f] = F.coalesce(texts[f], "predicted_type")
    return named.select(*df.columns, *(c.alias(f) for f, c in texts.items()))


def classify_with_rules(
    df: DataFrame, rules_df: DataFrame, key: str = "ticket_id", text: str = "processed_text",
    limit: int = FEW_RULES, match: str = "substring", info: DataFrame | None = None,
    rule_bytes: int = RULE_BYTES,
) -> DataFrame:
    """Winning category per ticket under a user's rule table; tickets without one are left out.

    ``rules_df``: category, category_order, keyword, keyword_order. Up to ``limit``
    phrases become literals of one projection. Larger tables are searched as a tree in
    tasks. Both ways use the same prepared table and give the same rows, one for each row of
    ``df``, and both match substrings or whole words. ``info`` adds the category's texts.
    """
    rules = prepared_rules(rules_df)
    small = few_rules(rules, max(limit, 0))
    if small == []:
        names = (("predicted_type", "string"), ("score", "int"), ("confidence", "double"), ("rule_matched", "string"))
        won = df.select(key, *(F.lit(None).cast(t).alias(n) for n, t in names)).where("false")
    elif small is not None:
        won = best_rule(df, text, small, [], match).where("predicted_type IS NOT NULL")
    else:
        won = best_rules(df, key, text, rules, match, rule_bytes).withColumn("confidence", confidence("score"))
    return with_category_texts(won.select(key, "predicted_type", "score", "confidence", "rule_matched"), info)


# -- triage and result names -------------------------------------------------

def triage(classified: DataFrame, routing_df: DataFrame) -> DataFrame:
    """Auto-triage record: group, priority and confidence of each ticket.

    ``routing_df``: category, grupo; of several groups of a category the first by name
    counts.  The join is left, so a ticket without a route keeps its record under
    ``Sin asignar``.
    """
    routes = routing_df.groupBy(F.col("category").alias("predicted_type")).agg(F.min("grupo").alias("grupo"))
    routed = classified.join(
        broadcast_if_small(routes, BROADCAST_ROUTES), "predicted_type", "left"
    )
    return routed.select(
        "ticket_id",
        default_text("predicted_type", "sin_clasificar").alias("incident_type"),
        default_text("grupo", "Sin asignar").alias("suggested_group"),
        default_text("nivel_criticidad", "No evaluada").alias("priority"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def name_results(classified: DataFrame, categories: DataFrame) -> DataFrame:
    """Hold-out records: rule name, else name of the mapped cluster, else raw type.

    ``categories``: cluster, nombre, descripcion, nivel_criticidad, palabras_clave.
    """
    cats = categories.select(
        F.format_string("tipo_%02d", F.col("cluster").cast("int")).alias("predicted_type"),
        F.col("nombre").alias("_nombre"),
        F.col("descripcion").alias("_descripcion"),
        F.col("nivel_criticidad").alias("_criticidad"),
        F.col("palabras_clave").alias("_palabras"),
    )
    j = classified.join(cats, "predicted_type", "left")
    return j.select(
        "ticket_id",
        ellipsize("resumen", 200).alias("resumen_original"),
        default_text("tipo_ticket", "No especificado").alias("tipo_ticket_original"),
        F.col("predicted_type").alias("categoria_predicha"),
        F.round(F.coalesce("confidence", F.lit(0.0)), 3).alias("confianza"),
        F.coalesce("nombre", "_nombre", "predicted_type").alias("nombre_categoria"),
        F.coalesce("descripcion", "_descripcion", F.lit("Sin descripción disponible")).alias(
            "descripcion_categoria"
        ),
        F.coalesce("nivel_criticidad", "_criticidad", F.lit("No evaluada")).alias("criticidad"),
        F.slice(
            F.coalesce("palabras_clave", "_palabras", F.array().cast("array<string>")), 1, 5
        ).alias("palabras_clave"),
    )

