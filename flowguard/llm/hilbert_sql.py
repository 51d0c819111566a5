"""The Hilbert shards as DuckDB SQL, one step of the curve per subquery."""

from __future__ import annotations

from flowguard.llm.hilbert import BITS, HEADER_BYTES, SHARDS


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


def shard_sql(shards: int = SHARDS) -> str:
    n, last = 3, (1 << BITS) - 1
    step = lambda c: f"('0x' || substr(md5(coalesce({c}, '')), 1, 2))::int % {1 << BITS}"
    crc = ("xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint), "
           f"lambda a, b: xor(list_extract({_crc_table()}, (xor(a, b) & 255) + 1), a >> 8), 4294967295::bigint), 4294967295)")
    ctes = [f"""t0 as (select doc_id, strlen(coalesce(text, ''))::bigint + {HEADER_BYTES} as size, {crc}::bigint as text_crc32,
        {step('source')} as x0, {step('lang')} as x1 from documents)""",
            f"t as (select *, greatest(0, least({last}, floor(log2(size))::int - 3)) as x2 from t0)"]
    prev = "t"

    def put(**cols):
        nonlocal prev
        name = f"s{len(ctes)}"
        body = ", ".join(f"{v} as {k}" for k, v in cols.items())
        ctes.append(f"{name} as (select * replace ({body}) from {prev})")
        prev = name

    for b in range(BITS - 1, 0, -1):
        q = 1 << b
        for i in range(n):
            own, swap = f"x{i}", f"(xor(x0, x{i}) & {q - 1})"
            first = f"case when {own} & {q} <> 0 then xor(x0, {q - 1}) else {'x0' if i == 0 else f'xor(x0, {swap})'} end"
            put(x0=first, **({} if i == 0 else {f"x{i}": f"case when {own} & {q} <> 0 then {own} else xor({own}, {swap}) end"}))
    put(x1="xor(x1, x0)")
    put(x2="xor(x2, x1)")
    flips = "0"
    for b in range(BITS - 1, 0, -1):
        flips = f"xor({flips}, case when x2 & {1 << b} <> 0 then {(1 << b) - 1} else 0 end)"
    ctes.append(f"f as (select *, {flips} as flips from {prev})")
    bits = [f"((xor(x{i}, flips) >> {b}) & 1)" for b in range(BITS - 1, -1, -1) for i in range(n)]
    curve = " + ".join(f"{x} * {1 << len(bits) - 1 - k}" for k, x in enumerate(bits))
    ctes.append(f"c as (select doc_id, size, text_crc32, {curve} as curve from f)")
    ctes.append("""r as (select *, row_number() over (order by curve, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 3))::int % 256,
        doc_id nulls first, text_crc32, size) - 1 as p, count(*) over () as n from c)""")
    return "with " + ",\n".join(ctes) + f"""
select doc_id, size, text_crc32, 'rows' as law, (p * {shards} // n)::int as shard,
       (p - (p * {shards} // n * n + {shards - 1}) // {shards})::bigint as slot, null::int as grown_shard from r"""
