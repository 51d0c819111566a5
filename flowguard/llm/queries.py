"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.llm import decontam, hilbert, hostwords, jaccard_join, langid, merkle, middle, mixing, packing, repeats, toxicity, warc, winnow
from flowguard.llm.fim_sql import MIDDLE_SQL
from flowguard.llm.hilbert_sql import shard_sql
from flowguard.llm.merkle_sql import manifest_sql
from flowguard.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


#: md5 order and the partial pass in SQL; the tree only deals the same draws to shards.
MIX_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n from documents
), blocks as (
  select doc_id, source, b, least(64, n - b * 64)::bigint as size, concat(coalesce(doc_id::varchar, 'null'), '-', b) as k
  from sized, unnest(range(0, greatest(ceil(n / 64.0)::bigint, 1))) as u(b)
), src as (
  select source, sum(size)::bigint as source_size from blocks group by source
), listed as (
  select *, [3, 1, 2][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as w,
         row_number() over (order by source is null, source) - 1 as i from src
), levels as (
  select *, (1.5::double * sum(source_size) over () - 2 * coalesce(sum(source_size) over o, 0))
            / (sum(w) over () - coalesce(sum(w) over o, 0)) as lvl
  from listed window o as (order by source_size / w, i rows between unbounded preceding and 1 preceding)
), targets as (
  select source, source_size,
         least(coalesce(max(case when lvl <= 2 * source_size / w then lvl end) over () * w, 2.0::double * source_size),
               2.0::double * source_size) as target
  from levels
), placed as (
  select b.*, t.source_size, t.target,
         coalesce(sum(size) over (partition by b.source order by md5(k), k rows between unbounded preceding and 1 preceding), 0) as before,
         case when t.source_size > 0 then floor(t.target / t.source_size) else 1 end::bigint as passes
  from blocks b join targets t on b.source is not distinct from t.source
)
select doc_id, sum(size)::bigint as size, source_size, target,
       sum(size * (passes + case when before + size / 2 <= target - passes * source_size then 1 else 0 end))::bigint as taken
from placed group by doc_id, source, source_size, target
"""


@query("op9_source_mix", MIX_SQL)
def op9_source_mix(spark, folder):
    return mixing.document_shares(table(spark, folder, "documents"))


@query("op8_hilbert_shards", shard_sql())
def op8_hilbert_shards(spark, folder):
    return hilbert.shard_documents(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op4_warc_revisits", r"""
with p as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as h from pages
), d as (
  select page_id, payload_bytes, translate(concat(
    """ + ", ".join(f"lpad(to_base(('0x' || substr(h, {1 + 5 * i}, 5))::bigint, 32), 4, '0')" for i in range(8)) + r"""
  ), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest from p
)
select page_id, payload_bytes, payload_digest,
       case when page_id = max(page_id) over w then 'response' else 'revisit' end as record_type,
       case when page_id <> max(page_id) over w then max(page_id) over w end as refers_to
from d window w as (partition by payload_digest)
""")
def op4_warc_revisits(spark, folder):
    return warc.archive_round_trip(spark, table(spark, folder, "pages"))


@query("op10_packed_tokens")
def op10_packed_tokens(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"))


@query("op2_benchmark_leaks")
def op2_benchmark_leaks(spark, folder):
    return decontam.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_jaccard_components", r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
         else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words
), tokens as (select doc_id, len(s) as n, unnest(s) as t from sets
), links as (
  select a.doc_id as a, b.doc_id as b from tokens a join tokens b on a.t = b.t and a.doc_id <> b.doc_id
  group by 1, 2, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach as (
  select doc_id as d, doc_id as r from documents union select links.b, reach.r from reach join links on links.a = reach.d
)
select s.doc_id, len(s)::bigint as n_shingles, (select min(r) from reach where d = s.doc_id) as component_id from sets s
""")
def op3_jaccard_components(spark, folder):
    return jaccard_join.near_duplicates(table(spark, folder, "documents"))


@query("op6_toxicity_votes")
def op6_toxicity_votes(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, folder, "labels")))
    return toxicity.score(docs, model).select(
        "doc_id", (toxicity.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= toxicity.CUTOFF).cast("int").alias("predicted"), "evidence")


@query("op1_byte_language")
def op1_byte_language(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    net, languages = langid.fit(docs.filter(toxicity.fold(F.col("doc_id"), 3) != 1))
    return langid.predict(docs, net, languages).select(
        "doc_id", (toxicity.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


@query("op5_winnowed_fingerprints")
def op5_winnowed_fingerprints(spark, folder):
    return winnow.edited_likeness(table(spark, folder, "documents"))


@query("op7_repeated_strings")
def op7_repeated_strings(spark, folder):
    return repeats.remove_repeats(table(spark, folder, "documents")).drop("kept")


@query("op13_middle_cuts", MIDDLE_SQL)
def op13_middle_cuts(spark, folder):
    return middle.digests(middle.transform(table(spark, folder, "documents")))


@query("op12_merkle_manifest", manifest_sql())
def op12_merkle_manifest(spark, folder):
    return merkle.verify(merkle.manifest(table(spark, folder, "documents")))


@query("op11_host_words")
def op11_host_words(spark, folder):
    return hostwords.judge(table(spark, folder, "pages"))
