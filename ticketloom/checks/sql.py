"""Building blocks of the DuckDB side.

The SQL is written apart from the Spark code: it repeats the meaning with DuckDB's
own functions, and shares only the fixed values.
"""

from __future__ import annotations

from collections.abc import Sequence

from ticketloom.sources import tickets as src

W = r"\p{L}\p{N}_"
SP = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def lst(values: Sequence[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def nth(values: Sequence[str], expr: str) -> str:
    return f"({lst(values)})[cast({expr} as int) + 1]"


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SP}]+', ' ', 'g'))"


def strip_punct(x: str) -> str:
    return f"regexp_replace({x}, '[^{W}\\s]', ' ', 'g')"


def clean_es(x: str) -> str:
    kept = f"regexp_replace(lower(coalesce({x}, '')), '[^a-záéíóúñü0-9\\s\\-_]', ' ', 'g')"
    return squash(kept)


def replaces(x: str, pairs: Sequence[tuple[str, str]]) -> str:
    for a, b in pairs:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^{W}]+'), lambda z: z <> '')"


def count(x: str, word: str) -> str:
    return f"((length({x}) - length(replace({x}, {q(word)}, ''))) // {len(word)})"


def counts(x: str, words: Sequence[str]) -> str:
    return "(" + " + ".join(count(x, w) for w in words) + ")"


def any_of(x: str, words: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def initcap(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split(lower({x}), ' '), "
        "lambda z: upper(left(z, 1)) || substr(z, 2)), ' ')"
    )


TICKETS = f"""
sq as (select doc_id, {squash('text')} as sq from documents),
tickets as (
  select 'T' || lpad(cast(doc_id as varchar), 8, '0') as ticket_id,
    replace(replace(replace({nth(src.PHRASES, 'doc_id % 24')},
      '{{cups}}', 'ES' || lpad(cast(doc_id as varchar), 16, '0') || 'ZZ1P'),
      '{{n}}', cast(1000 + doc_id as varchar)),
      '{{fecha}}', cast(1 + doc_id % 28 as varchar) || '/' || cast(1 + doc_id % 12 as varchar)
        || '/2024')
      || ' ' || case when doc_id % 10 = 0 then sq else substr(sq, 1, {src.SUMMARY_CHARS}) end
      as resumen,
    case when doc_id % 10 <> 0 then substr(sq, {src.SUMMARY_CHARS + 1}) end as notas,
    {nth(src.TYPES, '(doc_id % 5) % 3')} as tipo_ticket,
    case when doc_id % 7 <> 0 then {nth(src.CAUSES, '(doc_id % 11) % 6')} end as causa_raiz,
    case when doc_id % 5 = 0 then 'Anulación y corregir, favor revisar' end as resolucion,
    {nth(src.PRIORITIES, '(doc_id % 13) % 4')} as prioridad,
    timestamp '2024-01-01 00:00:00' + to_hours(cast(doc_id % 2000 as integer)) as created_at,
    cast(case when doc_id < 8 then 90 when doc_id % 24 >= 17 then 17
      when doc_id % 24 in (15, 16) then 15 else doc_id % 24 end as integer) as cluster,
    doc_id
  from sq)"""

COMBINED = "concat_ws(' ', resumen, notas, tipo_ticket, causa_raiz, resolucion)"
RULE_TEXT = "concat_ws(' ', lower(resumen), nullif(lower(notas), ''), lower(tipo_ticket))"


def with_tickets(body: str, *ctes: str) -> str:
    """SQL over the tickets view, with further common tables."""
    return "with " + ",\n".join([TICKETS.strip(), *ctes]) + "\n" + body
