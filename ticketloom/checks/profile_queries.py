"""Checked queries: cluster profiles and category merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom import lexicons as lx
from ticketloom.checks import sql as s
from ticketloom.checks.registry import query
from ticketloom.checks.text_queries import ANALYSIS_CTES, sql_ascii_tokens, sql_drop, sql_words
from ticketloom.operators import merge as mg, profiles as pr
from ticketloom.sources.tickets import load_tickets

C = "cluster"


def _top_cte(name: str, values: str, n: int, least: int = 1) -> str:
    return (
        f"{name} as (select *, row_number() over (partition by cluster order by n desc, v) as rank "
        f"from (select cluster, v, count(*) as n from ({values}) group by cluster, v "
        f"having count(*) >= {least}) qualify rank <= {n})"
    )


def _list_cte(name: str, ranked: str, where: str = "true") -> str:
    return (f"{name} as (select cluster, list(v order by rank) as vs from {ranked} "
            f"where {where} group by cluster)")


KEYWORDS = _top_cte(
    "kw", "select cluster, unnest("
    + sql_drop(sql_ascii_tokens("resumen"), lx.KEYWORD_STOPWORDS) + ") as v from tickets", 15)
WORDS = _top_cte("words", f"select cluster, unnest({sql_words('analysis_text')}) as v from analysis",
                 10, least=2)


def _values(name: str, col: str, n: int) -> str:
    return _top_cte(name, f"select cluster, {col} as v from tickets where {col} is not null", n)


TEXT_CTE = ("low as (select *, lower(resumen) as r, lower(concat_ws(' ', resumen, causa_raiz, notas))"
            " as t from tickets)")


def _count_words(x: str, words) -> str:
    return "(" + " + ".join(f"cast(bool_or(contains({x}, {s.q(w)})) as int)" for w in words) + ")"


SIGNALS = (
    "signals as (select cluster, count(*) as num_incidencias, "
    + ", ".join(f"cast(sum({s.counts('t', kws)}) as bigint) as p{i}"
                for i, (_, kws) in enumerate(lx.NAME_PATTERNS)) + ", "
    + ", ".join(f"bool_or({s.any_of('t', ws)}) as st{i}"
                for i, (_, ws) in enumerate(lx.NAME_SUBTYPES)) + ", "
    + ", ".join(f"bool_or({s.any_of('r', ws)}) as fl{i}"
                for i, (_, ws) in enumerate(lx.PATTERN_FLAGS)) + ", "
    + f"{_count_words('r', lx.HIGH_INDICATORS)} as hi, "
    + f"{_count_words('r', lx.MEDIUM_INDICATORS)} as mi, "
    + f"{_count_words('r', lx.LOW_INDICATORS)} as lo from low group by cluster)"
)
CRITICALITY = "case when hi > 0 then 'Alta' when mi > lo then 'Media' else 'Baja' end"
_GREATEST = "greatest(" + ", ".join(f"p{i}" for i in range(len(lx.NAME_PATTERNS))) + ")"
PATTERN = (f"case when {_GREATEST} <= 0 then null "
           + " ".join(f"when p{i} = {_GREATEST} then {s.q(b)}"
                      for i, (b, _) in enumerate(lx.NAME_PATTERNS)) + " end")
SUBTYPE = "case " + " ".join(f"when st{i} then {s.q(n)}"
                             for i, (n, _) in enumerate(lx.NAME_SUBTYPES)) + " end"
SIZE = "case when num_incidencias > 100 then 'Frecuentes' when num_incidencias < 10 then 'Específicas' end"
FLAGS = ("list_filter([" + ", ".join(f"case when fl{i} then {s.q(n)} end"
                                     for i, (n, _) in enumerate(lx.PATTERN_FLAGS))
         + "], lambda z: z is not null)")
FALLBACK = (
    "case when coalesce(len(ks), 0) = 0 then 'Categoria_Tecnica' "
    "when len(list_filter(ks[1:2], lambda z: length(z) > 2)) = 2 then "
    "upper(left(ks[1], 1)) || substr(ks[1], 2) || '_' || upper(left(ks[2], 1)) || substr(ks[2], 2) "
    "when len(list_filter(ks[1:2], lambda z: length(z) > 2)) = 1 then 'Incidencias_' || "
    "upper(left(ks[1], 1)) || substr(ks[1], 2) else 'Categoria_Generica' end"
)
_SENTENCE = ("case " + " ".join(f"when contains(nombre, {s.q(w)}) then {s.q(t)}"
                                for w, t in lx.NAME_SENTENCES)
             + f" else {s.q(lx.NAME_SENTENCE_DEFAULT)} end")
_CAUSE = (
    "case when len(cs) >= 2 then ' La causa principal identificada es: ''' || cs[1] || "
    "''', seguida de ''' || cs[2] || '''.' when len(cs) = 1 then "
    "' La causa principal identificada es: ''' || cs[1] || '''.' else '' end"
)


def cut(x: str, n: int) -> str:
    return f"case when length({x}) > {n} then substr({x}, 1, {n}) || '...' else {x} end"


EXAMPLES = (
    "ex as (select *, row_number() over (partition by cluster order by ticket_id) as rank "
    "from tickets qualify rank <= 10)"
)
PROFILE_CTES = (
    TEXT_CTE, KEYWORDS, _values("tipos", "tipo_ticket", 3), _values("causas2", "causa_raiz", 2),
    SIGNALS, EXAMPLES, _list_cte("kwl", "kw"), _list_cte("tiposl", "tipos"),
    _list_cte("causasl", "causas2"),
    "exl as (select cluster, string_agg('[' || ticket_id || '] ' || " + cut("resumen", 150)
    + ", chr(10) order by rank) as ejemplos from ex where rank <= 3 group by cluster)",
    f"joined as (select g.*, {CRITICALITY} as nivel_criticidad, {PATTERN} as patron, "
    f"{SUBTYPE} as subtipo, {SIZE} as tam, {FLAGS} as patrones, k.vs as ks, "
    "coalesce(ti.vs, []) as ts, coalesce(ca.vs, []) as cs, e.ejemplos from signals g "
    "left join kwl k using (cluster) left join tiposl ti using (cluster) "
    "left join causasl ca using (cluster) left join exl e using (cluster))",
    f"named as (select *, replace(concat_ws('_', coalesce(patron, {FALLBACK}), subtipo, tam), '_', "
    "' ') as nombre from joined)",
    f"cats as (select *, 'Categoría ''' || nombre || ''' que agrupa ' || num_incidencias || "
    f"' incidencias ' || {_SENTENCE} || {_CAUSE} as descripcion, "
    f"lower(replace(regexp_replace(nombre, '[^{s.W}\\s-]', '', 'g'), ' ', '_')) as clave from named)",
)


def sql(body: str) -> str:
    return s.with_tickets(body, *PROFILE_CTES)


def cats(spark, sf):
    return pr.profile_clusters(load_tickets(spark, sf))


_TOP = "select cluster, rank, n, v as {} from {}"


@query("i1_top_keywords", s.with_tickets(_TOP.format("term", "kw"), KEYWORDS))
def i1(spark, sf):
    return pr.top_keywords(load_tickets(spark, sf))


@query("i2_top_words", s.with_tickets(_TOP.format("term", "words"), *ANALYSIS_CTES, WORDS))
def i2(spark, sf):
    return pr.top_words(load_tickets(spark, sf))


@query("i3_top_types", s.with_tickets(_TOP.format("value", "x"), _values("x", "tipo_ticket", 3)))
def i3(spark, sf):
    return pr.top_values(load_tickets(spark, sf), "tipo_ticket", 3)


@query("i4_top_causes", s.with_tickets(_TOP.format("value", "x"), _values("x", "causa_raiz", 3)))
def i4(spark, sf):
    return pr.top_values(load_tickets(spark, sf), "causa_raiz", 3)


@query("i5_examples", s.with_tickets(
    f"select cluster, rank, ticket_id as id, {cut('resumen', 120)} as resumen, "
    "tipo_ticket, coalesce(causa_raiz, '') as causa_raiz, "
    "coalesce(prioridad, 'No especificada') as prioridad from ex where rank <= 5", EXAMPLES))
def i5(spark, sf):
    return pr.examples(load_tickets(spark, sf), 5, 120)


@query("i6_pattern_flags", sql(
    "select cluster, array_to_string(patrones, '; ') as patrones from joined"))
def i6(spark, sf):
    g = pr.pattern_flags(pr.cluster_signals(load_tickets(spark, sf)), "p")
    return g.select(C, F.array_join("p", "; ").alias("patrones"))


@query("i7_criticality", sql("select cluster, nivel_criticidad from joined"))
def i7(spark, sf):
    return pr.criticality(pr.cluster_signals(load_tickets(spark, sf))).select(C, "nivel_criticidad")


@query("i8_main_pattern", sql("select cluster, patron, p0, p1, p2, p3, p4, p5, p6, p7 from joined"))
def i8(spark, sf):
    g = pr.main_pattern(pr.cluster_signals(load_tickets(spark, sf)))
    return g.select(C, "patron", *[F.col(f"pattern_{i}").alias(f"p{i}") for i in range(8)])


@query("i9_subtype", sql("select cluster, subtipo from joined"))
def i9(spark, sf):
    return pr.subtype(pr.cluster_signals(load_tickets(spark, sf))).select(C, "subtipo")


@query("i10_size_modifier", sql("select cluster, num_incidencias, tam from joined"))
def i10(spark, sf):
    g = load_tickets(spark, sf).groupBy(C).agg(F.count("*").alias("num_incidencias"))
    return g.withColumn("tam", pr.size_modifier("num_incidencias"))


@query("i11_category_name", sql("select cluster, nombre, clave from cats"))
def i11(spark, sf):
    return cats(spark, sf).select(C, "nombre", "clave")


@query("i12_fallback_name", sql(f"select cluster, {FALLBACK} as nombre from joined"))
def i12(spark, sf):
    return cats(spark, sf).select(C, pr.fallback_name("palabras_clave").alias("nombre"))


@query("i13_describe", sql("select cluster, descripcion from cats"))
def i13(spark, sf):
    return cats(spark, sf).select(C, "descripcion")


@query("i22_profile_clusters", sql(
    "select cluster, nombre, clave, descripcion, num_incidencias, nivel_criticidad, "
    "array_to_string(ks[1:10], ',') as palabras, array_to_string(ts, ',') as tipos, "
    "array_to_string(patrones, ',') as patrones, ejemplos from cats"))
def i22(spark, sf):
    return cats(spark, sf).select(
        C, "nombre", "clave", "descripcion", "num_incidencias", "nivel_criticidad",
        F.array_join("palabras_clave", ",").alias("palabras"),
        F.array_join("tipos_principales", ",").alias("tipos"),
        F.array_join("patrones_identificados", ",").alias("patrones"),
        F.array_join(F.transform("ejemplos", lambda e: F.concat(
            F.lit("["), e["id"], F.lit("] "), e["resumen"])), "\n").alias("ejemplos"),
    )


# -- analyzer --------------------------------------------------------------------

_CAUSES3 = (_values("causas3", "causa_raiz", 3), _list_cte("causas3l", "causas3"))
SEMANTIC_SIGNALS = (
    "ssig as (select cluster, count(*) as num_incidencias, "
    + ", ".join(f"cast(sum({s.counts('t', kws)}) as bigint) as f{i}"
                for i, (_, kws, _) in enumerate(lx.FUNCTIONAL_PATTERNS)) + ", "
    + ", ".join(f"bool_or({s.any_of('t', ws)}) as cx{i}"
                for i, (_, ws) in enumerate(lx.CONTEXT_MODIFIERS)) + ", "
    + "avg(length(resumen)) as avg_text_length, "
    + f"bool_or({s.any_of('r', lx.TECHNICAL_TERMS)}) as has_technical_terms, "
    + f"cast(sum({s.counts('r', lx.URGENCY_TERMS)}) as bigint) as urgency_indicators "
    + "from low group by cluster)"
)


def _functional(i: int, kws, causes) -> str:
    held = " + ".join(
        f"len(list_filter(top_causes, lambda z: contains(lower(z), {s.q(c)})))" for c in causes)
    return (f"(f{i} * 2 + 3 * len(list_filter(top_words, lambda z: z in {s.lst(kws)})) "
            f"+ 5 * ({held})) as s{i}")


_N = len(lx.FUNCTIONAL_PATTERNS)
_SMAX = "greatest(" + ", ".join(f"s{i}" for i in range(_N)) + ")"
_SPATTERN = (f"case when {_SMAX} <= 2 then null " + " ".join(
    f"when s{i} = {_SMAX} then {s.q(b)}" for i, (b, _, _) in enumerate(lx.FUNCTIONAL_PATTERNS))
    + " end")
_CONTEXT = "case " + " ".join(
    f"when cx{i} then {s.q(n)}" for i, (n, _) in enumerate(lx.CONTEXT_MODIFIERS)) + " end"
_SPEC = ("case when num_incidencias > 100 then 'Alta Frecuencia' when num_incidencias > 50 then "
         "'Frecuencia Media' when num_incidencias < 10 then 'Casos Específicos' end")


def _title(x: str) -> str:
    return f"upper(left({x}, 1)) || substr({x}, 2)"


_LONG = "list_filter(top_words[1:3], lambda z: length(z) > 3)"
_SFALLBACK = (
    f"case when len(top_causes) > 0 then {cut('top_causes[1]', 30)} "
    f"when len({_LONG}) >= 2 then 'Incidencias ' || {_title(f'({_LONG})[1]')} || ' y ' || "
    f"{_title(f'({_LONG})[2]')} when len({_LONG}) = 1 then 'Incidencias de ' || "
    f"{_title(f'({_LONG})[1]')} else 'Categoría Técnica Específica' end"
)
_URGENCY = ("case when urgency_indicators > 5 then 'Alta' when urgency_indicators > 2 then 'Media' "
            "else 'Baja' end")
_TECH = "list_filter(top_words, lambda z: length(z) > 4)"
_SDESC = (
    "'Categoría ''' || nombre || ''' que engloba ' || num_incidencias || ' incidencias técnicas ' "
    "|| case when has_technical_terms then 'de naturaleza técnica especializada, ' else '' end "
    "|| case when urgency_indicators > 0 then 'que requieren atención prioritaria, ' else '' end "
    "|| case when len(top_causes) > 0 then 'principalmente relacionadas con ''' || top_causes[1] "
    "|| '''. ' else '' end || case when len(top_causes) > 1 then 'Causas secundarias incluyen: ' "
    "|| top_causes[2] || '. ' else '' end || case when len(" + _TECH + ") > 0 then "
    "'Términos técnicos frecuentes: ' || array_to_string((" + _TECH + ")[1:4], ', ') || '.' "
    "else '' end"
)
INPUT_CTES = (
    *ANALYSIS_CTES, TEXT_CTE, WORDS, _list_cte("wordsl", "words", "rank <= 8"), *_CAUSES3,
    SEMANTIC_SIGNALS,
    "inputs as (select g.*, coalesce(w.vs, []) as top_words, coalesce(c.vs, []) as top_causes "
    "from ssig g left join wordsl w using (cluster) left join causas3l c using (cluster))",
)
SEMANTIC_CTES = (
    *INPUT_CTES, EXAMPLES,
    "scored as (select *, "
    + ", ".join(_functional(i, k, c) for i, (_, k, c) in enumerate(lx.FUNCTIONAL_PATTERNS))
    + " from inputs)",
    f"snamed as (select *, {_SPATTERN} as patron, {_CONTEXT} as contexto, {_SPEC} as spec, "
    f"concat_ws(' - ', concat_ws(' ', coalesce({_SPATTERN}, {_SFALLBACK}), {_CONTEXT}), {_SPEC}) "
    "as nombre from scored)",
    f"scats as (select *, {_SDESC} as descripcion, {_URGENCY} as nivel_criticidad, "
    "round(num_incidencias * 100.0 / sum(num_incidencias) over (), 2) as porcentaje_total, "
    f"regexp_replace(regexp_replace(lower(nombre), '[^{s.W}\\s-]', '', 'g'), '[\\s-]+', '_', 'g') "
    "as clave from snamed)",
    "sids as (select cluster, string_agg(ticket_id, ',' order by rank) as ids, "
    "string_agg(ticket_id || ' ' || " + cut("resumen", 120) + " || ' ' || coalesce(causa_raiz, '') "
    "|| ' ' || prioridad, chr(10) order by rank) filter (rank <= 5) as ejemplos from ex "
    "group by cluster)",
)


def ssql(body: str) -> str:
    return s.with_tickets(body, *SEMANTIC_CTES)


@query("i14_functional_pattern", ssql("select cluster, patron from snamed"))
def i14(spark, sf):
    return pr.functional_pattern(pr.semantic_inputs(load_tickets(spark, sf))).select(C, "patron")


@query("i15_context_modifier", ssql("select cluster, contexto from snamed"))
def i15(spark, sf):
    return pr.context_modifier(pr.semantic_signals(load_tickets(spark, sf))).select(C, "contexto")


@query("i16_size_spec", ssql("select cluster, spec from snamed"))
def i16(spark, sf):
    g = load_tickets(spark, sf).groupBy(C).agg(F.count("*").alias("n"))
    return g.select(C, pr.size_spec("n").alias("spec"))


@query("i17_semantic_name", ssql(f"select cluster, nombre, clave, {_SFALLBACK} as respaldo from scats"))
def i17(spark, sf):
    return pr.semantic_profile(load_tickets(spark, sf)).select(
        C, "nombre", "clave",
        pr.semantic_fallback("palabras_clave", "causas_principales").alias("respaldo"))


@query("i18_semantic_features", ssql(
    "select cluster, round(avg_text_length, 6) as avg_text_length, has_technical_terms, "
    "urgency_indicators from ssig"))
def i18(spark, sf):
    return pr.semantic_features(load_tickets(spark, sf)).withColumn(
        "avg_text_length", F.round("avg_text_length", 6))


@query("i19_urgency_level", ssql("select cluster, nivel_criticidad from scats"))
def i19(spark, sf):
    g = pr.semantic_features(load_tickets(spark, sf))
    return g.select(C, pr.urgency_level("urgency_indicators").alias("nivel_criticidad"))


@query("i20_semantic_describe", ssql("select cluster, descripcion from scats"))
def i20(spark, sf):
    return pr.semantic_profile(load_tickets(spark, sf)).select(C, "descripcion")


@query("i21_share_ids", ssql(
    "select cluster, porcentaje_total, ids, ejemplos from scats join sids using (cluster)"))
def i21(spark, sf):
    return pr.semantic_profile(load_tickets(spark, sf)).select(
        C, "porcentaje_total", F.array_join("incident_ids", ",").alias("ids"),
        F.array_join(F.transform("ejemplos", lambda e: F.concat_ws(
            " ", e["id"], e["resumen"], e["causa_raiz"], e["prioridad"])), "\n").alias("ejemplos"))


@query("i22_semantic_profile", ssql(
    "select cluster, nombre, num_incidencias, nivel_criticidad, porcentaje_total, "
    "array_to_string(top_words, ',') as palabras, array_to_string(top_causes, ',') as causas "
    "from scats"))
def i22s(spark, sf):
    return pr.semantic_profile(load_tickets(spark, sf)).select(
        C, "nombre", "num_incidencias", "nivel_criticidad", "porcentaje_total",
        F.array_join("palabras_clave", ",").alias("palabras"),
        F.array_join("causas_principales", ",").alias("causas"))


# -- merge -------------------------------------------------------------------------

def _jac(x: str, y: str) -> str:
    inter, union = f"len(list_intersect({x}, {y}))", f"len(list_distinct(list_concat({x}, {y})))"
    return f"case when {union} > 0 then cast({inter} as double) / {union} else 0 end"


def _pairs(table: str) -> str:
    return (
        "select a.cluster as a, b.cluster as b, cast(0.4 as double) * "
        + _jac("a.top_words", "b.top_words") + " + cast(0.4 as double) * "
        + _jac("a.top_causes", "b.top_causes")
        + " + cast(0.2 as double) * (cast(0.5 as double) * "
        "cast(a.has_technical_terms = b.has_technical_terms as int) + cast(0.5 as double) * "
        "cast(abs(a.urgency_indicators - b.urgency_indicators) <= 1 as int)) as similarity "
        f"from {table} a, {table} b where a.cluster < b.cluster"
    )


@query("k1_category_similarity", s.with_tickets(
    f"select a, b, round(similarity, 6) as similarity from ({_pairs('inputs')})", *INPUT_CTES))
def k1(spark, sf):
    return mg.category_similarity(pr.semantic_inputs(load_tickets(spark, sf))).withColumn(
        "similarity", F.round("similarity", 6))


def _top_list(col: str, n: int, a: str, b: str) -> str:
    """First n of both lists by frequency, first seen first on ties."""
    both = f"list_concat({a}.{col}, {b}.{col})"
    return (
        f"(select list(v order by c desc, p) from (select v, count(*) as c, min(i) as p from "
        f"(select unnest({both}) as v, unnest(range(len({both}))) as i) group by v "
        f"order by c desc, p limit {n}))"
    )


def _round_ctes(i: int, max_n: int) -> tuple[str, ...]:
    """One round of the greedy merge: table m{i} becomes m{i+1}."""
    return (
        f"b{i} as (select * from ({_pairs(f'm{i}')}) where similarity > 0.1 and "
        f"(select count(*) from m{i}) > {max_n} "
        "order by round(similarity, 12) desc, a, b limit 1)",
        f"m{i + 1} as (select m.cluster, m.top_words, m.top_causes, m.num_incidencias, "
        f"m.avg_text_length, m.has_technical_terms, m.urgency_indicators from m{i} m "
        f"where not exists (select 1 from b{i} where cluster in (a, b)) union all "
        f"select x.cluster, {_top_list('top_words', 8, 'x', 'y')}, "
        f"{_top_list('top_causes', 3, 'x', 'y')}, x.num_incidencias + y.num_incidencias, "
        "(x.avg_text_length + y.avg_text_length) / 2, x.has_technical_terms or y.has_technical_terms, "
        f"x.urgency_indicators + y.urgency_indicators from b{i} join m{i} x on x.cluster = a "
        f"join m{i} y on y.cluster = b)",
    )


MERGE_TO = 14
_ROUNDS = 4
MERGE_CTES = (
    *INPUT_CTES,
    "m0 as (select cluster, top_words, top_causes, num_incidencias, avg_text_length, "
    "has_technical_terms, urgency_indicators from inputs)",
    *[c for i in range(_ROUNDS) for c in _round_ctes(i, MERGE_TO)],
)
_MERGED = ("cluster, array_to_string(top_words, ',') as palabras, "
           "array_to_string(top_causes, ',') as causas, num_incidencias, "
           "round(avg_text_length, 6) as avg_text_length, has_technical_terms, urgency_indicators")


def _merged_text(df):
    return df.select(
        C, F.array_join("top_words", ",").alias("palabras"),
        F.array_join("top_causes", ",").alias("causas"), "num_incidencias",
        F.round("avg_text_length", 6).alias("avg_text_length"), "has_technical_terms",
        "urgency_indicators")


@query("k2_merge_categories", s.with_tickets(f"select {_MERGED} from m{_ROUNDS}", *MERGE_CTES))
def k2(spark, sf):
    _, merged = mg.merge_categories(pr.semantic_inputs(load_tickets(spark, sf)), MERGE_TO)
    return _merged_text(merged)


@query("k2_merged_tickets", s.with_tickets(
    "select cluster, num_incidencias as tickets from " + f"m{_ROUNDS}", *MERGE_CTES))
def k2_tickets(spark, sf):
    """The map joined back to the tickets gives the same sizes."""
    t = load_tickets(spark, sf)
    mapping, _ = mg.merge_categories(pr.semantic_inputs(t), MERGE_TO)
    return mg.apply_mapping(t.select(C), mapping).groupBy(C).agg(F.count("*").alias("tickets"))


@query("k3_merge_profile", s.with_tickets(
    f"select {_MERGED} from (select cluster // 2 * 2 as cluster, "
    "(select list(v order by c desc, p) from (select v, count(*) as c, min(i) as p from "
    "(select unnest(ws) as v, unnest(range(len(ws))) as i) group by v order by c desc, p limit 8)) "
    "as top_words, (select list(v order by c desc, p) from (select v, count(*) as c, min(i) as p "
    "from (select unnest(qs) as v, unnest(range(len(qs))) as i) group by v order by c desc, p "
    "limit 3)) as top_causes, num_incidencias, avg_text_length, has_technical_terms, "
    "urgency_indicators from (select min(cluster) as cluster, "
    "flatten(list(top_words order by cluster)) as ws, flatten(list(top_causes order by cluster)) "
    "as qs, cast(sum(num_incidencias) as bigint) as num_incidencias, avg(avg_text_length) as "
    "avg_text_length, bool_or(has_technical_terms) as has_technical_terms, "
    "cast(sum(urgency_indicators) as bigint) as urgency_indicators from inputs group by "
    "cluster // 2))", *INPUT_CTES))
def k3(spark, sf):
    """Neighbouring clusters merged two by two."""
    parts = pr.semantic_inputs(load_tickets(spark, sf))
    mapping = parts.select(F.col(C).alias("old"), (F.floor(F.col(C) / 2) * 2).cast("int").alias("new"))
    return _merged_text(mg.merge_profile(parts, mapping))
