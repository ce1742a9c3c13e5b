"""Checked queries: sources, projections, text functions, entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom import lexicons as lx
from ticketloom.checks import sql as s
from ticketloom.checks.registry import query
from ticketloom.functions import entities as en, text as tx
from ticketloom.session import scratch_path
from ticketloom.sources import tickets as src
from ticketloom.sources.tickets import load_tickets

K = "ticket_id"


def _joined(arr):
    return F.array_join(arr, ",")


# -- sources -----------------------------------------------------------------

_CSV_SQL = s.with_tickets(
    "select ticket_id, regexp_replace(resumen, '[^\\x{00}-\\x{ff}]', '?', 'g') as resumen,"
    " nullif(regexp_replace(notas, '[^\\x{00}-\\x{ff}]', '?', 'g'), '') as notas, tipo_ticket, causa_raiz,"
    " cast(null as varchar) as prioridad, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at"
    " from tickets"
)
# Headings out of order, with a variant, one column missing and one that is not ours.
_SHUFFLED = (("Resumen", "resumen"), ("Causa Raiz", "causa_raiz"), ("Equipo", "cluster"), ("ticket id", "ticket_id"),
             ("created_at", "created_at"), ("Notas", "notas"), ("Tipo de ticket", "tipo_ticket"))


def _read_back(df):
    return df.select(
        K, "resumen", "notas", "tipo_ticket", "causa_raiz", "prioridad",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("a1_read_csv", _CSV_SQL)
def a1(spark, sf):
    """Tickets written as an ISO-8859-1 file with ``;`` and read back by heading."""
    path = scratch_path(spark, "tickets-csv")
    cols = [F.col(n).alias(h) for h, n in _SHUFFLED]
    (
        load_tickets(spark, sf).select(*cols).write.option("sep", ";").option("header", True)
        .option("encoding", "ISO-8859-1").option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return _read_back(src.read_tickets_csv(spark, path))


@query("a2_read_json", s.with_tickets(
    "select ticket_id, resumen, notas, tipo_ticket, causa_raiz, cast(null as varchar) as prioridad,"
    " strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at from tickets"))
def a2(spark, sf):
    """Tickets written as JSON lines under the file's headings and read back by name."""
    path = scratch_path(spark, "tickets-json")
    load_tickets(spark, sf).select(*(F.col(n).alias(h) for h, n in _SHUFFLED if h != "ticket id"),
                                   F.col(K).alias("Ticket ID")).write.json(path)
    return _read_back(src.read_tickets(spark, path, "json"))


@query("a3_require_columns", s.with_tickets(
    "select 3 as present, count(*) as tickets from tickets"))
def a3(spark, sf):
    t = load_tickets(spark, sf)
    found = src.require_columns(t)
    return t.agg(F.lit(len(found)).alias("present"), F.count("*").alias("tickets"))


@query("fixture_tickets", s.with_tickets(
    "select ticket_id, resumen, notas, tipo_ticket, causa_raiz, resolucion, prioridad,"
    " strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at, cluster, doc_id from tickets"))
def fixture(spark, sf):
    t = load_tickets(spark, sf)
    return t.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


# -- projections and predicates ----------------------------------------------

@query("b1_select", s.with_tickets("select ticket_id, resumen, notas, causa_raiz from tickets"))
def b1(spark, sf):
    return load_tickets(spark, sf).select(K, "resumen", "notas", "causa_raiz")


@query("b2_known_cause", s.with_tickets(
    "select ticket_id, causa_raiz from tickets where causa_raiz is not null"))
def b2(spark, sf):
    return src.with_known_cause(load_tickets(spark, sf)).select(K, "causa_raiz")


@query("b3_valid_tickets", s.with_tickets(
    "select ticket_id, notas from tickets where notas is not null and notas <> ''"))
def b3(spark, sf):
    """The summaries here are never empty, so the rule is shown on the notes."""
    t = load_tickets(spark, sf).withColumn("resumen", F.col("notas"))
    return src.valid_tickets(t).select(K, "notas")


@query("b4_combined_text", s.with_tickets(
    f"select ticket_id, {s.COMBINED} as combined_text from tickets"))
def b4(spark, sf):
    return load_tickets(spark, sf).select(K, tx.combined_text().alias("combined_text"))


def _tech(x: str) -> str:
    parts = [
        f"list_transform(list_filter({x}, lambda z: z in {s.lst(ws)}), lambda z: '{c}_' || z)"
        for c, ws in lx.TECHNICAL_CLASSES
    ]
    expr = parts[0]
    for p in parts[1:]:
        expr = f"list_concat({expr}, {p})"
    return f"array_to_string({expr}, ' ')"


FULL_CTE = (
    "cleaned as (select *, concat_ws(' ', case when resumen is not null then "
    f"{s.clean_es('resumen')} end, case when notas is not null then {s.clean_es('notas')} end, "
    f"case when causa_raiz is not null then {s.clean_es('causa_raiz')} end) as full_text "
    "from tickets)"
)
ANALYSIS_CTES = (
    FULL_CTE,
    f"runs as (select *, {s.tokens('full_text')} as r from cleaned)",
    f"analysis as (select *, full_text || ' ' || {_tech('r')} as analysis_text from runs)",
)


@query("b5_analysis_text", s.with_tickets(
    "select ticket_id, analysis_text from analysis", *ANALYSIS_CTES))
def b5(spark, sf):
    return load_tickets(spark, sf).select(
        K, tx.analysis_text("resumen", "notas", "causa_raiz").alias("analysis_text"))


@query("b6_rule_text", s.with_tickets(
    f"select ticket_id, {s.RULE_TEXT} as rule_text from tickets"))
def b6(spark, sf):
    return load_tickets(spark, sf).select(
        K, tx.rule_text("resumen", "notas", "tipo_ticket").alias("rule_text"))


def _cut(n: int) -> str:
    return (f"case when length(resumen) > {n} then substr(resumen, 1, {n}) || '...' "
            "else resumen end")


@query("b7_ellipsize", s.with_tickets(
    f"select ticket_id, {_cut(150)} as c150, {_cut(120)} as c120, {_cut(200)} as c200 "
    "from tickets"))
def b7(spark, sf):
    return load_tickets(spark, sf).select(
        K, *[tx.ellipsize("resumen", n).alias(f"c{n}") for n in (150, 120, 200)])


@query("b8_default_text", s.with_tickets(
    "select coalesce(ticket_id, 'idx_' || doc_id) as id,"
    " coalesce(causa_raiz, 'No especificada') as causa,"
    " coalesce(resolucion, 'No especificado') as resolucion from tickets"))
def b8(spark, sf):
    return load_tickets(spark, sf).select(
        tx.default_text(K, F.concat(F.lit("idx_"), "doc_id")).alias("id"),
        tx.default_text("causa_raiz", "No especificada").alias("causa"),
        tx.default_text("resolucion", "No especificado").alias("resolucion"),
    )


@query("b9_require_rows", s.with_tickets(
    "select count(*) as tickets, count(*) >= 600 as enough from tickets"))
def b9(spark, sf):
    """The guard of the hold-out test: 100 tickets to test and 500 to train."""
    t = load_tickets(spark, sf)
    try:
        src.require_rows(t)
        enough = True
    except ValueError:
        enough = False
    return t.agg(F.count("*").alias("tickets"), F.lit(enough).alias("enough"))


# -- text functions -----------------------------------------------------------

_DOC = "select doc_id, {} as out from documents"


def _docs(spark, sf, expr):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", expr.alias("out"))


@query("c1_lower", _DOC.format("lower(text)"))
def c1(spark, sf):
    return _docs(spark, sf, F.lower("text"))


@query("c2_strip_punct", _DOC.format(s.strip_punct("lower(text)")))
def c2(spark, sf):
    return _docs(spark, sf, tx.strip_punct(F.lower("text")))


@query("c3_squash", _DOC.format(s.squash(s.strip_punct("lower(text)"))))
def c3(spark, sf):
    return _docs(spark, sf, tx.squash(tx.strip_punct(F.lower("text"))))


_PHRASE_PAIRS = [(p, " ") for p in lx.COURTESY_PHRASES]


@query("c4_remove_phrases", s.with_tickets(
    f"select ticket_id, {s.replaces('lower(' + s.COMBINED + ')', _PHRASE_PAIRS)} as out "
    "from tickets"))
def c4(spark, sf):
    return load_tickets(spark, sf).select(
        K, tx.remove_phrases(F.lower(tx.combined_text())).alias("out"))


@query("c5_normalize_synonyms", s.with_tickets(
    f"select ticket_id, {s.replaces('lower(' + s.COMBINED + ')', lx.SYNONYMS)} as out "
    "from tickets"))
def c5(spark, sf):
    return load_tickets(spark, sf).select(
        K, tx.normalize_synonyms(F.lower(tx.combined_text())).alias("out"))


@query("c6_clean_es", _DOC.format(s.clean_es("text")))
def c6(spark, sf):
    return _docs(spark, sf, tx.clean_es("text"))


PROCESSED = s.squash(s.replaces(
    f"regexp_replace({s.strip_punct('lower(' + s.COMBINED + ')')}, '[{s.SP}]+', ' ', 'g')",
    [*_PHRASE_PAIRS, *lx.SYNONYMS]))
PROCESSED_CTE = f"processed as (select *, {PROCESSED} as processed_text from tickets)"


@query("c7_preprocess", s.with_tickets(
    "select ticket_id, processed_text from processed", PROCESSED_CTE))
def c7(spark, sf):
    return load_tickets(spark, sf).select(
        K, tx.preprocess(tx.combined_text()).alias("processed_text"))


def _arr(x: str) -> str:
    return f"array_to_string({x}, ',')"


def sql_ascii_tokens(x: str) -> str:
    return (f"list_filter({s.tokens(x)}, "
            "lambda z: regexp_full_match(z, '[a-z0-9]{3,}'))")


def sql_word_tokens(x: str) -> str:
    return f"list_filter({s.tokens(x)}, lambda z: length(z) >= 2)"


def sql_drop(x: str, stop) -> str:
    return f"list_filter({x}, lambda z: z not in {s.lst(stop)})"


def sql_words(x: str) -> str:
    return (f"list_filter(string_split({s.squash('lower(' + x + ')')}, ' '), "
            "lambda z: length(z) > 3 and regexp_matches(z, '\\p{L}') "
            f"and z not in {s.lst(lx.ANALYZER_STOPWORDS)})")


@query("c8_ascii_tokens", _DOC.format(_arr(sql_ascii_tokens("text"))))
def c8(spark, sf):
    return _docs(spark, sf, _joined(tx.ascii_tokens("text")))


@query("c9_meaningful_words", s.with_tickets(
    f"select ticket_id, {_arr(sql_words('analysis_text'))} as words from analysis",
    *ANALYSIS_CTES))
def c9(spark, sf):
    return load_tickets(spark, sf).select(
        K,
        _joined(tx.meaningful_words(tx.analysis_text("resumen", "notas", "causa_raiz"))).alias(
            "words"),
    )


@query("c10_word_tokens", _DOC.format(_arr(sql_word_tokens("text"))))
def c10(spark, sf):
    return _docs(spark, sf, _joined(tx.word_tokens("text")))


@query("c11_ngrams", (
    f"with t as (select doc_id, {sql_word_tokens('text')} as t from documents) "
    "select doc_id, array_to_string(list_concat(t, list_transform(range(1, len(t)), "
    "lambda i: t[i] || ' ' || t[i + 1])), ',') as out from t"))
def c11(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", tx.word_tokens("text").alias("t"))
    return df.select("doc_id", _joined(tx.ngrams_1_2("t")).alias("out"))


@query("c12_drop_stopwords", s.with_tickets(
    f"select ticket_id, {_arr(sql_drop(sql_ascii_tokens(s.COMBINED), lx.KEYWORD_STOPWORDS))}"
    " as out from tickets"))
def c12(spark, sf):
    return load_tickets(spark, sf).select(
        K,
        _joined(tx.drop_stopwords(tx.ascii_tokens(tx.combined_text()), lx.KEYWORD_STOPWORDS))
        .alias("out"),
    )


@query("c13_contains_any", s.with_tickets(
    f"select ticket_id, {s.any_of(f'lower({s.COMBINED})', lx.URGENCY_TERMS)} as out "
    "from tickets"))
def c13(spark, sf):
    return load_tickets(spark, sf).select(
        K, tx.contains_any(F.lower(tx.combined_text()), lx.URGENCY_TERMS).alias("out"))


@query("c14_count_sub", s.with_tickets(
    f"select ticket_id, {s.counts(f'lower({s.COMBINED})', lx.NAME_PATTERNS[0][1])} as red, "
    f"{s.count(f'lower({s.COMBINED})', 'error')} as error from tickets"))
def c14(spark, sf):
    low = F.lower(tx.combined_text())
    return load_tickets(spark, sf).select(
        K,
        tx.count_subs(low, lx.NAME_PATTERNS[0][1]).alias("red"),
        tx.count_sub(low, "error").alias("error"),
    )


@query("c15_length", "select doc_id, length(text) as out from documents")
def c15(spark, sf):
    return _docs(spark, sf, F.length("text"))


@query("c16_title_upper", s.with_tickets(
    f"select ticket_id, {s.initcap('causa_raiz')} as title, upper(causa_raiz) as upper "
    "from tickets"))
def c16(spark, sf):
    return load_tickets(spark, sf).select(
        K, tx.title_case("causa_raiz").alias("title"), F.upper("causa_raiz").alias("upper"))


@query("c17_slug", s.with_tickets(
    f"select ticket_id, lower(replace(regexp_replace({s.COMBINED}, '[^{s.W}\\s-]', '', 'g'), ' ', "
    f"'_')) as key, regexp_replace(regexp_replace(lower({s.COMBINED}), "
    f"'[^{s.W}\\s-]', '', 'g'), '[\\s-]+', '_', 'g') as merged from tickets"))
def c17(spark, sf):
    """Over the whole text of a ticket."""
    return load_tickets(spark, sf).select(
        K, tx.slug_key(tx.combined_text()).alias("key"), tx.slug_merged(tx.combined_text()).alias("merged"))


@query("c18_join_first", s.with_tickets(
    f"select ticket_id, array_to_string(({sql_ascii_tokens(s.COMBINED)})[1:5], ', ') as out "
    "from tickets"))
def c18(spark, sf):
    """Of the words of the whole text of a ticket."""
    return load_tickets(spark, sf).select(
        K, tx.join_first(tx.ascii_tokens(tx.combined_text()), 5).alias("out"))


@query("c19_format_number", s.with_tickets(
    "select ticket_id, format('{:.1f}%', ((doc_id % 8) / 8.0) * 100.0) as pct,"
    " format('{:.3f}', cast((doc_id % 8) / 8.0 as double)) as dec,"
    " 'tipo_' || lpad(cast(cluster as varchar), 2, '0') as tipo from tickets"))
def c19(spark, sf):
    share = (F.col("doc_id") % 8) / F.lit(8.0)
    return load_tickets(spark, sf).select(
        K, tx.format_percent(share).alias("pct"), tx.format_decimals(share).alias("dec"),
        tx.type_id("cluster").alias("tipo"))


# -- entities -------------------------------------------------------------------

def sql_entity(name: str, x: str) -> str:
    patterns = dict(lx.ENTITY_PATTERNS)
    if name in patterns:
        return f"list_sort(list_distinct(regexp_extract_all({x}, '{patterns[name]}')))"
    terms = dict(lx.ENTITY_TERMS)[name]
    cases = ", ".join(
        f"case when regexp_matches({x}, '(^|[^{s.W}]){t}([^{s.W}]|$)') then '{t}' end"
        for t in terms)
    return f"list_sort(list_filter([{cases}], lambda z: z is not null))"


LOW_CTE = f"low as (select ticket_id, lower({s.COMBINED}) as t from tickets)"


def _entity_query(number: int, name: str) -> None:
    sql = s.with_tickets(
        f"select ticket_id, array_to_string({sql_entity(name, 't')}, ',') as found from low",
        LOW_CTE)

    @query(f"d{number}_{name}", sql)
    def run(spark, sf):
        return load_tickets(spark, sf).select(
            K, _joined(en.extract_entity(tx.combined_text(), name)).alias("found"))


for _i, _name in enumerate(en.ENTITY_TYPES, 1):
    _entity_query(_i, _name)


@query("d8_extract_entities", s.with_tickets(
    "select ticket_id, " + " || ' ' || ".join(
        f"'{n}=' || array_to_string({sql_entity(n, 't')}, ',')" for n in en.ENTITY_TYPES)
    + " as entities from low", LOW_CTE))
def d8(spark, sf):
    df = load_tickets(spark, sf).select(K, en.extract_entities(tx.combined_text()).alias("m"))
    return df.select(
        K,
        F.concat_ws(" ", *[
            F.concat(F.lit(f"{n}="), _joined(F.col("m")[n])) for n in en.ENTITY_TYPES
        ]).alias("entities"))


@query("d9_entity_counts", s.with_tickets(
    " union all ".join(
        f"select '{n}' as entity, count(*) filter (len({sql_entity(n, 't')}) > 0) as tickets, "
        f"cast(sum(len({sql_entity(n, 't')})) as bigint) as matches from low"
        for n in en.ENTITY_TYPES), LOW_CTE))
def d9(spark, sf):
    t = load_tickets(spark, sf).select(tx.combined_text().alias("t"))
    return en.entity_counts(t, "t")


@query("d9_entity_flags", s.with_tickets(
    "select ticket_id, " + ", ".join(
        f"len({sql_entity(n, 't')}) > 0 as has_{n}" for n in en.ENTITY_TYPES) + " from low",
    LOW_CTE))
def d9f(spark, sf):
    t = load_tickets(spark, sf).select(K, tx.combined_text().alias("t"))
    return en.with_entities(t, "t").select(K, *[f"has_{n}" for n in en.ENTITY_TYPES])


@query("d9_entity_values", s.with_tickets(
    " union all ".join(
        f"select '{n}' as entity, v as value, count(*) as tickets from (select unnest({sql_entity(n, 't')})"
        " as v from low) group by v" for n in en.ENTITY_TYPES), LOW_CTE))
def d9v(spark, sf):
    """Values of all seven types."""
    t = load_tickets(spark, sf).select(tx.combined_text().alias("t"))
    parts = [en.entity_value_counts(t, "t", n).withColumn("entity", F.lit(n)) for n in en.ENTITY_TYPES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("d10_technical_keywords", s.with_tickets(
    f"select ticket_id, {_tech('r')} as keywords from runs",
    FULL_CTE, f"runs as (select *, {s.tokens('full_text')} as r from cleaned)"))
def d10(spark, sf):
    t = load_tickets(spark, sf)
    full = F.concat_ws(" ", *[
        F.when(F.col(c).isNotNull(), tx.clean_es(c)) for c in ("resumen", "notas", "causa_raiz")])
    return t.select(K, tx.technical_keywords(full).alias("keywords"))
