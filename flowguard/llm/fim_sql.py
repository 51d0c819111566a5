"""The fill-in-the-middle query as DuckDB SQL: the units as a list, the parts as its slices."""

MIDDLE_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
         sha256(concat('42:', coalesce(doc_id::varchar, 'null'))) as h from documents
), d as (
  select doc_id, text, u, len(u)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
         ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t
), f as (
  select *, case when text = '' or regexp_matches(text, '<[PSM]>') or h3 % 100 >= 50 then 'plain'
                 when h4 % 100 < 80 then 'spm' else 'psm' end as form,
         least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from d
), p as (
  select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:], '') as suf from f
)
select doc_id, n, form, case when form <> 'plain' then length(pre) end::bigint as prefix_chars,
       case when form <> 'plain' then length(mid) end::bigint as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then concat('<P>', pre, '<S>', suf, '<M>', mid)
                        else concat('<S>', suf, '<P>', pre, '<M>', mid) end) as output_sha256,
       sha256(text) as restored_sha256
from p
"""
