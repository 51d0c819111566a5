"""Queries for neighbour search and oversampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.operators import balance, neighbours
from flowguard.plans.fixture_sql import EVENT_FLOWS, VEC_ROWS, scatter_sql, with_views
from flowguard.plans.registry import query
from flowguard.sources.tables import VEC_FEATURES, event_flows, vec_rows

_D2 = " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in VEC_FEATURES)


@query("class_neighbours", with_views(VEC_ROWS) + f"""
, d as (select a.vec_id as id, b.vec_id as neighbour, {_D2} as d2 from vec_rows a join vec_rows b on a.vec_id <> b.vec_id
  where a."binary" = 1 and b."binary" = 1),
r as (select *, row_number() over (partition by id order by d2, neighbour) as rank from d)
select id, rank::int as rank, neighbour, round(d2, 6) as d2 from r where rank <= 5""")
def class_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest_neighbours(vec_rows(spark, d).where("`binary` = 1"), "vec_id", VEC_FEATURES, 5)
    return near.withColumn("d2", F.round("d2", 6))


@query("flow_neighbours", with_views(EVENT_FLOWS) + """
, a as (select flow_id, n_events::double as x, n_types::double as y, duration_s as z from event_flows where label = 'DDoS'),
d as (select a.flow_id as id, b.flow_id as neighbour, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) as d2
  from a join a b on a.flow_id <> b.flow_id),
r as (select *, row_number() over (partition by id order by d2, neighbour) as rank from d)
select id, rank::int as rank, neighbour, round(d2, 4) as d2 from r where rank <= 3""")
def flow_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Flows of one class; a large share of them are exact copies of each other."""
    flows = event_flows(spark, d).where("label = 'DDoS'").select("flow_id", "n_events", "n_types", "duration_s")
    near = neighbours.nearest_neighbours(flows, "flow_id", ["n_events", "n_types", "duration_s"], 3, block_rows=200)
    return near.withColumn("d2", F.round("d2", 4))


def _oversample_sql(label: str, k: int) -> str:
    mix = ", ".join(f"round(b.{f} + u * (o.{f} - b.{f}), 6) as {f}" for f in VEC_FEATURES)
    plain = ", ".join(f"round({f}, 6) as {f}" for f in VEC_FEATURES)
    seed = 42
    return with_views(VEC_ROWS) + f"""
, v as (select *, {label} as cls from vec_rows),
cnt as (select cls, count(*) as n, max(count(*)) over () as most from v group by cls),
d as (select a.vec_id as id, b.vec_id as neighbour, {_D2} as d2 from v a join v b on a.cls = b.cls and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by id order by d2, neighbour) as rank from d),
todo as (select vec_id, cls, (most - n) // n + case when row_number() over (partition by cls order by {scatter_sql('vec_id', seed)}, vec_id)
    <= (most - n) % n then 1 else 0 end as m from v join cnt using (cls)),
copies as (select vec_id, cls, unnest(range(m)) as copy from todo),
tagged as (select *, {scatter_sql('(vec_id + copy * 7919)', seed + 1)} % {k} + 1 as rank,
    {scatter_sql('(vec_id * 31 + copy)', seed + 2)} / 4294967296.0::double as u from copies)
select b.vec_id, t.copy::int as copy, t.cls::int as "{label.strip('"')}", {mix}
from tagged t join v b on b.vec_id = t.vec_id join r on r.id = t.vec_id and r.rank = t.rank join v o on o.vec_id = r.neighbour
union all select vec_id, null, cls, {plain} from v"""


@query("oversampled_binary", _oversample_sql('"binary"', 5))
def oversampled_binary(spark: SparkSession, d: str) -> DataFrame:
    out = balance.oversample(vec_rows(spark, d), "binary", "vec_id", VEC_FEATURES)
    return out.select("vec_id", "copy", "binary", *[F.round(f, 6).alias(f) for f in VEC_FEATURES])


@query("oversampled_classes", _oversample_sql("label", 5))
def oversampled_classes(spark: SparkSession, d: str) -> DataFrame:
    out = balance.oversample(vec_rows(spark, d), "label", "vec_id", VEC_FEATURES)
    return out.select("vec_id", "copy", "label", *[F.round(f, 6).alias(f) for f in VEC_FEATURES])
