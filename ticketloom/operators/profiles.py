"""What a cluster of tickets is about: keywords, names, descriptions, criticality.

Texts of a cluster are never put together.  Each ticket yields flags and counts, which
are combined per cluster (``bool_or``, ``sum``); names and descriptions are then made
on one row per cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ticketloom import lexicons as lx
from ticketloom.functions.text import (
    analysis_text,
    ascii_tokens,
    combined_text,
    contains_any,
    count_subs,
    default_text,
    drop_stopwords,
    ellipsize,
    meaningful_words,
    slug_key,
    slug_merged,
    title_case,
)
from ticketloom.operators.ranking import ranked_list, top_n

C = "cluster"


# -- top values ------------------------------------------------------------------

def _top_counts(pairs: DataFrame, value: str, n: int, least: int = 1) -> DataFrame:
    counts = pairs.groupBy(C, value).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return top_n(counts, [C], [F.desc("n"), F.asc(value)], n)


def top_lists(df: DataFrame, **parts: tuple[Column, int, int]) -> DataFrame:
    """Most frequent values of several kinds per cluster, one list column for each kind.

    A part is (array of values, length of the list, least count). All kinds are counted in
    one tagged table (cluster, kind, value): one reading, one shuffle of combined counts.
    Clusters without any value have no row; a list without values is null.
    """
    names = list(parts)

    def tag(k: int):
        return lambda x: F.struct(F.lit(k).alias("kind"), x.alias("value"))

    tagged = F.concat(*(F.transform(F.coalesce(values, F.array().cast("array<string>")), tag(k))
                        for k, (values, _, _) in enumerate(parts.values())))
    kind = F.col("kind")

    def by_kind(i: int) -> Column:
        return F.element_at(F.array(*(F.lit(p[i]) for p in parts.values())), kind + 1)

    counts = df.select(C, F.inline(tagged)).where("value is not null").groupBy(C, "kind", "value").agg(F.count("*").alias("n"))
    most = max(p[1] for p in parts.values())
    ranked = top_n(counts.where(F.col("n") >= by_kind(2)), [C, "kind"], [F.desc("n"), F.asc("value")], most)
    pairs = {n: F.collect_list(F.when(kind == k, F.struct("rank", "value"))) for k, n in enumerate(names)}
    lists = ranked.where(F.col("rank") <= by_kind(1)).groupBy(C).agg(*(
        F.transform(F.array_sort(x), lambda p: p["value"]).alias(n) for n, x in pairs.items()))
    return lists.select(C, *(F.when(F.size(n) > 0, F.col(n)).alias(n) for n in names))


def _one(col: str) -> Column:
    return F.array(F.col(col))


def _keywords(text: str = "resumen", stop: Sequence[str] = lx.KEYWORD_STOPWORDS) -> Column:
    return drop_stopwords(ascii_tokens(text), stop)


def _words() -> Column:
    return meaningful_words(analysis_text("resumen", "notas", "causa_raiz"))


def top_keywords(
    df: DataFrame, n: int = 15, stop: Sequence[str] = lx.KEYWORD_STOPWORDS, text: str = "resumen"
) -> DataFrame:
    """Most frequent keywords of the summaries per cluster."""
    return _top_counts(df.select(C, F.explode(_keywords(text, stop)).alias("term")), "term", n)


def top_words(df: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent analyzer words per cluster, those that occur more than once."""
    return _top_counts(df.select(C, F.explode(_words()).alias("term")), "term", n, least=2)


def top_values(df: DataFrame, col: str, n: int) -> DataFrame:
    """Most frequent values of a column per cluster, nulls left out."""
    pairs = df.where(F.col(col).isNotNull()).select(C, F.col(col).alias("value"))
    return _top_counts(pairs, "value", n)


def examples(df: DataFrame, n: int = 3, cut: int = 150) -> DataFrame:
    """First n tickets per cluster by id, with cut summary.

    Columns are cut before ranking, so the rows sorted are short; each task passes on
    n rows per cluster.
    """
    rows = df.select(
        C,
        F.col("ticket_id").alias("id"),
        ellipsize("resumen", cut).alias("resumen"),
        default_text("tipo_ticket", "").alias("tipo_ticket"),
        default_text("causa_raiz", "").alias("causa_raiz"),
        default_text("prioridad", "No especificada").alias("prioridad"),
    )
    return top_n(rows, [C], [F.asc("id")], n)


# -- signals -------------------------------------------------------------------

def _any(text: str, words: Sequence[str]) -> Column:
    return F.coalesce(F.bool_or(contains_any(F.col(text), words)), F.lit(False))


def _lowered(df: DataFrame) -> DataFrame:
    """Lower-case summary and lower-case text of summary, cause and notes."""
    return df.select(
        C,
        F.lower(F.coalesce("resumen", F.lit(""))).alias("_resumen"),
        F.lower(combined_text("resumen", "causa_raiz", "notas")).alias("_texto"),
        F.length(F.coalesce("resumen", F.lit(""))).alias("_largo"),
    )


def cluster_signals(df: DataFrame) -> DataFrame:
    """One row per cluster with every count and flag the profile needs, in one pass."""
    counts = [
        F.sum(count_subs("_texto", kws)).alias(f"pattern_{i}")
        for i, (_, kws) in enumerate(lx.NAME_PATTERNS)
    ]
    subtypes = [_any("_texto", ws).alias(f"subtype_{i}") for i, (_, ws) in enumerate(lx.NAME_SUBTYPES)]
    flags = [_any("_resumen", ws).alias(f"flag_{i}") for i, (_, ws) in enumerate(lx.PATTERN_FLAGS)]
    indicators = [
        F.bool_or(F.col("_resumen").contains(w)).alias(f"indicator_{i}")
        for i, w in enumerate(_INDICATORS)
    ]
    return _lowered(df).groupBy(C).agg(
        F.count("*").alias("num_incidencias"), *counts, *subtypes, *flags, *indicators
    )


_INDICATORS = lx.HIGH_INDICATORS + lx.MEDIUM_INDICATORS + lx.LOW_INDICATORS


def pattern_flags(signals: DataFrame, out: str = "patrones_identificados") -> DataFrame:
    """Labels of the patterns present."""
    labels = [F.when(F.col(f"flag_{i}"), F.lit(l)) for i, (l, _) in enumerate(lx.PATTERN_FLAGS)]
    return signals.withColumn(out, F.array_compact(F.array(*labels)))


def criticality(signals: DataFrame, out: str = "nivel_criticidad") -> DataFrame:
    """Alta with any high indicator; Media when more medium than low; else Baja."""

    def present(words: Sequence[str]) -> Column:
        cols = [F.col(f"indicator_{_INDICATORS.index(w)}").cast("int") for w in words]
        return sum(cols[1:], cols[0])

    level = (
        F.when(present(lx.HIGH_INDICATORS) > 0, "Alta")
        .when(present(lx.MEDIUM_INDICATORS) > present(lx.LOW_INDICATORS), "Media")
        .otherwise("Baja")
    )
    return signals.withColumn(out, level)


def _first_best(scores: Sequence[tuple[Column, str]], above: int) -> Column:
    """Name of the highest score above a limit; ties to the earliest."""
    ranked = F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("n"))
                       for i, (s, n) in enumerate(scores)])
    best = F.array_max(ranked)
    return F.when(best["s"] > above, best["n"])


def main_pattern(signals: DataFrame, out: str = "patron") -> DataFrame:
    """Base name of the technical pattern with most occurrences, null when none."""
    scores = [(F.col(f"pattern_{i}"), base) for i, (base, _) in enumerate(lx.NAME_PATTERNS)]
    return signals.withColumn(out, _first_best(scores, 0))


def _first_true(pairs: Sequence[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(F.col(c), F.lit(n)) for c, n in pairs])


def subtype(signals: DataFrame, out: str = "subtipo") -> DataFrame:
    """First subtype with any of its words."""
    pairs = [(f"subtype_{i}", n) for i, (n, _) in enumerate(lx.NAME_SUBTYPES)]
    return signals.withColumn(out, _first_true(pairs))


def size_modifier(n: Column | str) -> Column:
    """Frecuentes above 100 tickets, Específicas below 10."""
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n > 100, "Frecuentes").when(n < 10, "Específicas")


def fallback_name(keywords: Column | str) -> Column:
    """Base name from the first two keywords longer than two characters."""
    k = F.col(keywords) if isinstance(keywords, str) else keywords
    words = F.filter(F.slice(F.coalesce(k, F.array().cast("array<string>")), 1, 2), lambda w: F.length(w) > 2)
    titled = F.transform(words, title_case)
    return (
        F.when(F.size(F.coalesce(k, F.array().cast("array<string>"))) == 0, "Categoria_Tecnica")
        .when(F.size(words) >= 2, F.array_join(titled, "_"))
        .when(F.size(words) == 1, F.concat(F.lit("Incidencias_"), F.array_join(titled, "")))
        .otherwise("Categoria_Generica")
    )


def category_name(df: DataFrame, out: str = "nombre") -> DataFrame:
    """Base name, subtype and size; expects patron, subtipo, palabras_clave, size."""
    base = F.coalesce("patron", fallback_name("palabras_clave"))
    parts = F.concat_ws("_", base, F.col("subtipo"), size_modifier("num_incidencias"))
    return df.withColumn(out, F.replace(parts, F.lit("_"), F.lit(" ")))


def describe(df: DataFrame, causes: str = "causas", out: str = "descripcion") -> DataFrame:
    """Description from name, size and up to two causes."""
    name = F.col("nombre")
    sentence = F.lit(lx.NAME_SENTENCE_DEFAULT)
    for word, text in reversed(lx.NAME_SENTENCES):
        sentence = F.when(name.contains(word), F.lit(text)).otherwise(sentence)
    c = F.coalesce(F.col(causes), F.array().cast("array<string>"))
    main, second, end = map(F.lit, lx.DESCRIPTION_CAUSE)
    cause = F.when(
        F.size(c) >= 2,
        F.concat(main, F.get(c, F.lit(0)), second, F.get(c, F.lit(1)), end),
    ).when(
        F.size(c) == 1,
        F.concat(main, F.get(c, F.lit(0)), end),
    ).otherwise("")
    start, groups, tickets = map(F.lit, lx.DESCRIPTION_START)
    text = F.concat(start, name, groups, F.col("num_incidencias"), tickets, sentence, cause)
    return df.withColumn(out, text)


def _example_list(df: DataFrame, n: int, cut: int, fields: Sequence[str], ids: int = 0) -> DataFrame:
    """Examples as one list per cluster, and the first ``ids`` ticket ids from the same reading."""
    rows = examples(df, max(n, ids), cut).select(C, "rank", F.struct(*fields).alias("ejemplo"), "id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "ejemplo", "id")))
    out = rows.groupBy(C).agg(ordered.alias("_rows")).select(
        C, F.transform(F.slice("_rows", 1, n), lambda x: x["ejemplo"]).alias("ejemplos"),
        F.transform(F.slice("_rows", 1, max(ids, 1)), lambda x: x["id"]).alias("incident_ids"))
    return out if ids else out.drop("incident_ids")


def _filled(df: DataFrame, names: Sequence[str]) -> DataFrame:
    empty = F.array().cast("array<string>")
    return df.withColumns({n: F.coalesce(F.col(n), empty) for n in names})


def profile_clusters(df: DataFrame) -> DataFrame:
    """Category table: one row per cluster; clusters of equal name are all kept.

    The tables joined have one row per cluster.
    """
    lists = top_lists(df, _palabras=(_keywords(), 15, 1), tipos_principales=(_one("tipo_ticket"), 3, 1),
                      causas=(_one("causa_raiz"), 2, 1))
    rows = _example_list(df, 3, 150, ("id", "resumen", "tipo_ticket"))
    out = cluster_signals(df).join(lists, C, "left").join(rows, C, "left")
    out = _filled(out, ("_palabras", "tipos_principales", "causas"))
    out = out.withColumn("palabras_clave", F.slice("_palabras", 1, 10))
    out = describe(category_name(subtype(main_pattern(criticality(pattern_flags(out))))))
    return out.select(
        C, "nombre", slug_key("nombre").alias("clave"), "descripcion", "num_incidencias",
        "palabras_clave", "tipos_principales", "ejemplos", "patrones_identificados",
        "nivel_criticidad",
    )


# -- analyzer --------------------------------------------------------------------

def semantic_signals(df: DataFrame) -> DataFrame:
    """Counts and flags of the analyzer, one row per cluster, in one pass."""
    counts = [
        F.sum(count_subs("_texto", kws)).alias(f"functional_{i}")
        for i, (_, kws, _) in enumerate(lx.FUNCTIONAL_PATTERNS)
    ]
    context = [_any("_texto", ws).alias(f"context_{i}") for i, (_, ws) in enumerate(lx.CONTEXT_MODIFIERS)]
    return _lowered(df).groupBy(C).agg(
        F.count("*").alias("num_incidencias"),
        *counts,
        *context,
        F.avg("_largo").alias("avg_text_length"),
        _any("_resumen", lx.TECHNICAL_TERMS).alias("has_technical_terms"),
        F.sum(count_subs("_resumen", lx.URGENCY_TERMS)).alias("urgency_indicators"),
    )


def semantic_features(df: DataFrame) -> DataFrame:
    """Mean summary length, any technical term, urgency words."""
    return semantic_signals(df).select(
        C, "avg_text_length", "has_technical_terms", "urgency_indicators"
    )


def functional_pattern(df: DataFrame, out: str = "patron") -> DataFrame:
    """Base name of the functional pattern with the highest score above two.

    Two per keyword occurrence, three per top word in the keywords, five per pair of
    top cause and pattern cause inside it.  Expects top_words and top_causes.
    """
    scores = []
    for i, (base, kws, causes) in enumerate(lx.FUNCTIONAL_PATTERNS):
        words = _matching(F.col("top_words"), kws)
        held = [F.size(F.filter("top_causes", _holds(c))) for c in causes]
        score = F.col(f"functional_{i}") * 2 + words * 3 + sum(held[1:], held[0]) * 5
        scores.append((score, base))
    return df.withColumn(out, _first_best(scores, 2))


def _matching(words: Column, kws: Sequence[str]) -> Column:
    return F.size(F.filter(words, lambda w: F.lower(w).isin(*kws)))


def _holds(text: str):
    return lambda c: F.lower(c).contains(text)


def context_modifier(df: DataFrame, out: str = "contexto") -> DataFrame:
    """First context with any of its words."""
    pairs = [(f"context_{i}", n) for i, (n, _) in enumerate(lx.CONTEXT_MODIFIERS)]
    return df.withColumn(out, _first_true(pairs))


def size_spec(n: Column | str) -> Column:
    """Alta Frecuencia above 100, Frecuencia Media above 50, Casos Específicos below 10."""
    n = F.col(n) if isinstance(n, str) else n
    return (
        F.when(n > 100, "Alta Frecuencia").when(n > 50, "Frecuencia Media")
        .when(n < 10, "Casos Específicos")
    )


def semantic_fallback(words: Column | str, causes: Column | str) -> Column:
    """Name from the main cause (cut at 30), else from words longer than three."""
    w = F.col(words) if isinstance(words, str) else words
    c = F.col(causes) if isinstance(causes, str) else causes
    long = F.filter(F.slice(w, 1, 3), lambda x: F.length(x) > 3)
    first, second = F.get(long, F.lit(0)), F.get(long, F.lit(1))
    return (
        F.when(F.size(c) > 0, ellipsize(F.get(c, F.lit(0)), 30))
        .when(F.size(long) >= 2, F.concat(F.lit("Incidencias "), title_case(first), F.lit(" y "),
                                          title_case(second)))
        .when(F.size(long) == 1, F.concat(F.lit("Incidencias de "), title_case(first)))
        .otherwise("Categoría Técnica Específica")
    )


def semantic_name(df: DataFrame, out: str = "nombre") -> DataFrame:
    """Base name, context and size; expects patron, contexto, top_words, top_causes."""
    base = F.coalesce("patron", semantic_fallback("top_words", "top_causes"))
    named = F.concat_ws(" ", base, F.col("contexto"))
    return df.withColumn(out, F.concat_ws(" - ", named, size_spec("num_incidencias")))


def urgency_level(n: Column | str) -> Column:
    """Alta above five urgency words, Media above two, else Baja."""
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n > 5, "Alta").when(n > 2, "Media").otherwise("Baja")


def semantic_describe(df: DataFrame, out: str = "descripcion") -> DataFrame:
    """Analyzer description from features, causes and words."""
    causes, words = F.col("top_causes"), F.col("top_words")
    tech = F.filter(words, lambda w: F.length(w) > 4)
    start, groups, tickets = map(F.lit, lx.ANALYZER_START)

    def between(parts: Sequence[str], value: Column) -> Column:
        return F.concat(F.lit(parts[0]), value, F.lit(parts[1]))

    def only(condition: Column, value: Column) -> Column:
        return F.when(condition, value).otherwise("")

    text = F.concat(
        start, F.col("nombre"), groups, F.col("num_incidencias"), tickets,
        only(F.col("has_technical_terms"), F.lit(lx.ANALYZER_TECHNICAL)),
        only(F.col("urgency_indicators") > 0, F.lit(lx.ANALYZER_URGENT)),
        only(F.size(causes) > 0, between(lx.ANALYZER_CAUSE, F.get(causes, F.lit(0)))),
        only(F.size(causes) > 1, between(lx.ANALYZER_SECOND_CAUSE, F.get(causes, F.lit(1)))),
        only(F.size(tech) > 0, between(lx.ANALYZER_TERMS, F.array_join(F.slice(tech, 1, 4), ", "))),
    )
    return df.withColumn(out, text)


def share(df: DataFrame, n: str = "num_incidencias", out: str = "porcentaje_total") -> DataFrame:
    """Percentage of all tickets, two decimals; one row per cluster comes in."""
    total = F.sum(n).over(Window.partitionBy())
    return df.withColumn(out, F.round(F.col(n) * 100.0 / total, 2))


def first_ids(df: DataFrame, n: int = 10) -> DataFrame:
    """First n ticket ids per cluster."""
    ids = top_n(df.select(C, "ticket_id"), [C], [F.asc("ticket_id")], n)
    return ranked_list(ids, C, "ticket_id", "incident_ids")


def semantic_inputs(df: DataFrame) -> DataFrame:
    """Preliminary category per cluster: words, causes, features, pattern counts."""
    lists = top_lists(df, top_words=(_words(), 8, 2), top_causes=(_one("causa_raiz"), 3, 1))
    out = semantic_signals(df).join(lists, C, "left")
    return _filled(out, ("top_words", "top_causes"))


def semantic_profile(df: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """Analyzer category table, one row per cluster.

    ``inputs`` replaces the words, causes and features, for merged categories.
    """
    base = semantic_inputs(df) if inputs is None else inputs
    rows = _example_list(df, 5, 120, ("id", "resumen", "causa_raiz", "prioridad"), ids=10)
    out = base.join(rows, C, "left")
    out = share(semantic_describe(semantic_name(context_modifier(functional_pattern(out)))))
    return out.select(
        C, "nombre", slug_merged("nombre").alias("clave"), "descripcion", "num_incidencias",
        F.col("top_words").alias("palabras_clave"),
        F.col("top_causes").alias("causas_principales"),
        urgency_level("urgency_indicators").alias("nivel_criticidad"),
        F.struct("avg_text_length", "has_technical_terms", "urgency_indicators").alias(
            "caracteristicas"
        ),
        "porcentaje_total", "incident_ids", "ejemplos",
    )
