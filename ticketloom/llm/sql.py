"""DuckDB SQL that gives the rows of corpus queries, where SQL can express them."""

from __future__ import annotations


def _field(c: str) -> str:
    return f"coalesce(cast(strlen(cast({c} as varchar)) as varchar) || ':' || cast({c} as varchar), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC-32 of the decimal doc_id: a fold over its characters, eight steps each.
_STEP = ("list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: "
         "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)")
CRC_ID = ("xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform("
          f"string_split(cast(doc_id as varchar), ''), lambda z: cast(ascii(z) as bigint))), lambda c, b: {_STEP}))")
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Trees level by level, the siblings of every leaf, and the fold from the leaf to the root.
MANIFEST = f"""
with recursive d as (select *, coalesce('=' || lang, '') as tree, {CRC_ID} % 3 = 0 as changed from documents),
h as (select doc_id, tree, {_leaf('text')} as leaf, case when changed then {_leaf(_LOWERED)}
  else {_leaf('text')} end as found from d),
p as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by tree) as size from h),
lower_(tree, level, place, size, digest) as (select tree, 0, place, size, leaf from p union all
  select tree, level + 1, place // 8, (size - 1) // 8 + 1, sha256(string_agg(digest, '' order by place)) from lower_ where size > 1
  group by tree, level, place // 8, size),
roots as (select tree, level as height, digest, row_number() over (order by tree) - 1 as place, count(*) over () as size from lower_ where size = 1),
upper_(level, place, size, digest) as (select 0, place, size, digest from roots union all
  select level + 1, place // 8, (size - 1) // 8 + 1, sha256(string_agg(digest, '' order by place)) from upper_ where size > 1
  group by level, place // 8, size),
sib as (select p.doc_id, p.leaf, p.tree, p.place as spot, l.level, l.place, l.digest, l.place < p.place // cast(pow(8, l.level) as bigint) as before
  from p join lower_ l on l.tree = p.tree and l.size > 1 and l.place // 8 = p.place // cast(pow(8, l.level + 1) as bigint)
  and l.place <> p.place // cast(pow(8, l.level) as bigint)
  union all select p.doc_id, p.leaf, p.tree, p.place, r.height + u.level, u.place, u.digest, u.place < r.place // cast(pow(8, u.level) as bigint)
  from p join roots r using (tree) join upper_ u on u.size > 1 and u.place // 8 = r.place // cast(pow(8, u.level + 1) as bigint)
  and u.place <> r.place // cast(pow(8, u.level) as bigint)),
lev as (select tree, spot, level, coalesce(string_agg(digest, '' order by place) filter (before), '') as b,
  coalesce(string_agg(digest, '' order by place) filter (not before), '') as a from sib group by tree, spot, level),
alone as (select p.tree, p.place as spot, l.level from p join (select distinct tree, level, size from lower_ where size > 1) l using (tree)
  union all select p.tree, p.place, r.height + u.level from p join roots r using (tree), (select distinct level from upper_ where size > 1) u),
steps as (select tree, spot, list({{'b': coalesce(b, ''), 'a': coalesce(a, '')}} order by level) as path,
  coalesce(string_agg(coalesce(b, '') || coalesce(a, ''), '' order by level), '') as proof from alone left join lev using (tree, spot, level) group by tree, spot),
r as (select digest as root from upper_ where size = 1),
o as (select p.doc_id, p.leaf, p.found, roots.digest as subroot, root, sha256(coalesce(proof, '')) as proof_sha256,
  list_reduce(list_prepend({{'b': p.found, 'a': ''}}, coalesce(path, [])), lambda x, y: {{'b': sha256(y.b || x.b || y.a), 'a': ''}}).b as folded_root,
  substr(p.tree, 2) as lang_, p.tree, p.place
  from p join roots using (tree), r left join steps on steps.tree = p.tree and steps.spot = p.place)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, case when tree <> '' then lang_ end as lang, place, folded_root = root as verified from o
"""

#: Base 32 of a SHA-1 in hex: five hex digits are four characters.
_BASE32 = ("array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
           "cast((cast('0x' || substr(h, cast(i // 4 * 5 + 1 as bigint), 5) as bigint) >> cast(15 - i % 4 * 5 as bigint)) & 31 as bigint) + 1, 1)), '')")

#: Payloads by digest: the largest page_id is the response, others revisit it.
TRANSACTIONS = f"""
with p as (select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
c as (select *, max(page_id) over (partition by h) as chief from p)
select page_id, payload_bytes, {_BASE32} as payload_digest,
  case when page_id = chief then 'response' else 'revisit' end as record_type,
  case when page_id <> chief then chief end as refers_to, true as has_request from c
"""
