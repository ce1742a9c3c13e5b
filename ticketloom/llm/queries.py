"""Registered queries of the corpus operators; each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ticketloom.llm import (
    bin_completion, decontaminate, merkle, near_dedup, packing, periodic_runs, pii, quality, sharding, suffix_dedup, token_files, toxicity, warc)
from ticketloom.llm.common import table
from ticketloom.llm.sql import MANIFEST, TRANSACTIONS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op10_warc_transactions": TRANSACTIONS, "op11_butterfly_manifest": MANIFEST}


#: SQL for the quality rules: the same counts over lines and words laid out as rows.
ORACLES["op8_quality_rules"] = f"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (select doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws from d),
li as (select doc_id, source, unnest(string_split(t, chr(10))) as raw, unnest(range(len(string_split(t, chr(10))))) as i from d),
ln as (select *, nullif(trim(regexp_replace(regexp_replace(lower(raw), '[0-9]+', '0', 'g'), '[ \\t\\x0B\\f\\r]+', ' ', 'g'), ' '), '') as nl,
  len(regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+')) as lw from li),
h as (select ln.source, nl, count(distinct t) as many from ln join d using (doc_id) where nl is not null group by ln.source, nl),
sz as (select source, count(distinct t) as size from d group by source),
bad as (select h.source, h.nl from h join sz on h.source is not distinct from sz.source
  where many >= {quality.LINE_DOCUMENTS} and many >= {quality.LINE_SHARE} * size),
lost as (select doc_id, sum(lw) as lost_words from ln join bad on ln.source is not distinct from bad.source and ln.nl = bad.nl group by doc_id),
dup as (select doc_id, count(*) - count(distinct raw) as n_dup_lines from ln where lw > 0 group by doc_id),
wi as (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3),
wc as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as c from wi),
cov as (select doc_id, count(distinct k) as n_repeat_words from (
  select doc_id, i as k from wc where c > 1 union all select doc_id, i + 1 from wc where c > 1
  union all select doc_id, i + 2 from wc where c > 1) group by doc_id),
r as (select d.doc_id, cast(len(w.ws) as bigint) as n_words, cast(len(array_to_string(w.ws, '')) as bigint) as word_chars,
  cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols, cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
  cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, cast(coalesce(lost_words, 0) as bigint) as lost_words
  from d join w using (doc_id) left join dup using (doc_id) left join cov using (doc_id) left join lost using (doc_id))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 2 * lost_words <= n_words as kept from r
"""


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"), shingle=2, similarity=0.8)


@_query
def op2_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op3_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


@_query
def op4_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(table(spark, sf_dir, "documents"))


@_query
def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


@_query
def op7_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(table(spark, sf_dir, "documents"))


@_query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


@_query
def op9_induced_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_digest(table(spark, sf_dir, "documents"))


@_query
def op10_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(table(spark, sf_dir, "pages"))


@_query
def op11_butterfly_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_digest(table(spark, sf_dir, "documents"))


@_query
def op12_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.pack_digest(table(spark, sf_dir, "documents"))


@_query
def op13_maximal_pair_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digest(table(spark, sf_dir, "documents"))
