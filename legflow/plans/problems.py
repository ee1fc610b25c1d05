"""Queries p1, p3, p4, p5 and p6: the general data problems over their whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legflow.operators import changes, drift, history, spatial, spikes
from legflow.tables import table

Query = Callable[[SparkSession, str], DataFrame]
STATIONS = ("dim_ch", "dim_de", "dim_at")
NEAR_M = 300.0


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.union, (table(spark, sf_dir, t).select("bpuic", "lon", "lat") for t in STATIONS))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.calls_with_actuals(table(spark, sf_dir, "gb_sched"), table(spark, sf_dir, "gb_act"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.near_pairs(stations(spark, sf_dir), "bpuic", NEAR_M)


def p3_hub_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations within the quadrilateral of the four outer interchanges, by crossing parity (borders included)."""
    ring = F.array_sort(F.collect_list(F.struct("turn", "lon", "lat")))
    hubs = table(spark, sf_dir, "hub_stations").crossJoin(F.broadcast(table(spark, sf_dir, "hub_stations").agg(F.avg("lon").alias("x"), F.avg("lat").alias("y"))))
    turned = hubs.select(F.atan2(F.col("lat") - F.col("y"), F.col("lon") - F.col("x")).alias("turn"), (F.col("x") + (F.col("lon") - F.col("x")) * 4).alias("lon"), (F.col("y") + (F.col("lat") - F.col("y")) * 4).alias("lat"))
    area = turned.agg(F.transform(ring, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("ring")).withColumn("area", F.lit("hubs"))
    return spatial.points_in_regions(stations(spark, sf_dir), "bpuic", area, "area", "ring", strip_deg=0.5)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(table(spark, sf_dir, "raw_lines"))


def p4_table_be(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.unified(table(spark, sf_dir, "raw_lines"), "be")[0]


def p4_table_ist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.unified(table(spark, sf_dir, "raw_lines"), "ist")[0]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history.station_history(table(spark, sf_dir, "raw_stops"))
    return h.select("bpuic", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))


def p5_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history.station_history(table(spark, sf_dir, "raw_stops"))
    return h.withColumns({c: F.col(c).cast("double") for c in ("lat", "lon")})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible_legs(table(spark, sf_dir, "fct_legs")).select("leg_id").distinct()


def p6_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible_legs(table(spark, sf_dir, "fct_legs"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p3_found, p3_hub_area, p4_found, p4_table_be, p4_table_ist, p5_found, p5_history, p6_found, p6_faults)}

_INSTANT = "(epoch_us(regexp_replace({0}, '\\.[0-9]+', '')::timestamptz), rpad(regexp_extract({0}, '\\.([0-9]+)', 1), 9, '0'))"
_SPOKEN = """
 select rid, tpl, wta, wtd, wtp, arg_max(case when {0}_removed = 'True' then '' else at_{0} end, t) as at_{0}
 from a where at_{0} is not null or {0}_removed = 'True' group by all"""
_ON = "rid, tpl, coalesce(wta, '~'), coalesce(wtd, '~'), coalesce(wtp, '~')"
_STATIONS = " union ".join(f"select bpuic, lon, lat from {t}" for t in STATIONS)
_FAULTS = """
with l as (select distinct leg_id, route_id, t_dep, dur, delay::int as delay from fct_legs where flags % 2 = 0),
r as (select unnest([{'c': 'dur', 'v': dur}, {'c': 'delay', 'v': delay}], recursive := true), leg_id, route_id, t_dep from l),
g as (select *, row_number() over (partition by route_id, c order by t_dep, leg_id) - row_number() over (partition by route_id, c, v order by t_dep, leg_id) as g from r),
k as (select *, count(*) over (partition by route_id, c, v, g) >= 8 as stuck, v not between (case c when 'dur' then 1 else -10799 end) and (case c when 'dur' then 3600 else 10799 end) as bad from g),
s0 as (select route_id, c, median(v) as m, mad(v) as d, avg(v) as a from k where not stuck and not bad group by all),
e0 as (select route_id, c, any_value(m) as m, case when any_value(d) > 0 then any_value(d) * 1.4826 else greatest(1.0, avg(abs(v - m)) * 1.2533) end as s from k join s0 using (route_id, c) where not stuck and not bad group by all),
s1 as (select route_id, c, median(v) as m1, mad(v) as d1 from k join e0 using (route_id, c) where not stuck and not bad and abs(v - m) <= 10 * s group by all),
e1 as (select route_id, c, any_value(m1) as m1, case when any_value(d1) > 0 then any_value(d1) * 1.4826 else greatest(1.0, avg(abs(v - m1)) * 1.2533) end as s1 from k join e0 using (route_id, c) join s1 using (route_id, c) where not stuck and not bad and abs(v - m) <= 10 * s group by all)
select distinct leg_id, c as reading, fault from (
 select leg_id, c, 'impossible' as fault from k where bad
 union all select leg_id, c, 'stuck' from k where stuck
 union all select leg_id, c, 'spike' from k join e1 using (route_id, c) where not bad and abs(v - m1) > 10 * s1)"""
_SNAPS = """
with r0 as (select snap, regexp_extract(trim(stop_id), '^(?:Parent)?([0-9]+)', 1) as num, trim(stop_id) as sid, trim(regexp_replace(stop_name, '[\\s ]+', ' ', 'g')) as name,
  try_cast(trim(stop_lat) as decimal(20,13)) as lat, try_cast(trim(stop_lon) as decimal(20,13)) as lon, location_type from raw_stops),
r as (select distinct snap, try_cast(num as bigint) as bpuic, sid, name, lat, lon,
  case when regexp_matches(sid, '^[0-9]+$') then 1 when regexp_matches(sid, '^Parent[0-9]+$') then 2 when trim(location_type) = '1' then 3 else 4 end as kind
  from r0 where num <> '' and lat between -90 and 90 and lon between -180 and 180),
b as (select *, min(kind) over (partition by snap, bpuic) as best from r),
u as (select snap, bpuic, min(name) as name, round(sum(lat)::decimal(38,13) / count(*)::decimal(6,0), 5) as lat, round(sum(lon)::decimal(38,13) / count(*)::decimal(6,0), 5) as lon from b where kind = best group by all),
c as (select *, row_number() over w = 1 or (name, lat, lon) is distinct from (lag(name) over w, lag(lat) over w, lag(lon) over w) as new from u window w as (partition by bpuic order by snap)),
p as (select *, coalesce(lead(snap) over (partition by bpuic order by snap) - interval 1 day, date '9999-12-31')::date as valid_to from c where new)
"""

SQL: dict[str, str] = {
    "p1_found": f"""
with s as (select distinct rid, tpl, wta, wtd, wtp, can, deleted, {_INSTANT.format('ts')} as t from gb_sched),
c as (select distinct rid, tpl, wta, wtd, wtp from (select *, max(t) over (partition by rid) as last from s) where t = last and deleted <> 'True' and can <> 'True'),
a as (select *, {_INSTANT.format('ts')} as t from gb_act),
x as ({_SPOKEN.format('arr')}), y as ({_SPOKEN.format('dep')}),
z as (select c.*, coalesce(x.at_arr, '') as at_arr, coalesce(y.at_dep, '') as at_dep from c
 left join x on (c.rid, c.tpl, coalesce(c.wta, '~'), coalesce(c.wtd, '~'), coalesce(c.wtp, '~')) = (x.rid, x.tpl, coalesce(x.wta, '~'), coalesce(x.wtd, '~'), coalesce(x.wtp, '~'))
 left join y on (c.rid, c.tpl, coalesce(c.wta, '~'), coalesce(c.wtd, '~'), coalesce(c.wtp, '~')) = (y.rid, y.tpl, coalesce(y.wta, '~'), coalesce(y.wtd, '~'), coalesce(y.wtp, '~')))
select distinct rid, tpl, coalesce(wta, wtd, wtp) as wt, at_arr, at_dep from z where at_arr <> '' or at_dep <> ''""",
    "p3_found": f"""
with d as (select * from ({_STATIONS}) where lon is not null and lat is not null and not (lon = 0 and lat = 0) and lon between -180 and 180 and lat between -90 and 90),
c as (select *, floor(lat / 0.003)::int as band from d), n as (select *, unnest([band - 1, band, band + 1]) as b from c)
select distinct a.bpuic as bpuic_a, b.bpuic as bpuic_b from c as a join n as b on a.band = b.b and a.bpuic < b.bpuic
where 2 * 6371000.0 * asin(sqrt(least(1.0, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) <= {NEAR_M}""",
    "p3_hub_area": f"""
with m as (select avg(lon) as x, avg(lat) as y from hub_stations),
h as (select atan2(lat - y, lon - x) as turn, x + (lon - x) * 4 as lon, y + (lat - y) * 4 as lat from hub_stations, m),
e as (select lon as x0, lat as y0, coalesce(lead(lon) over w, first(lon) over (order by turn)) as x1, coalesce(lead(lat) over w, first(lat) over (order by turn)) as y1 from h window w as (order by turn)),
d as (select * from ({_STATIONS}) where lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0))
select distinct bpuic, 'hubs' as area from (select bpuic, lon, lat from d, e where least(y0, y1) <= lat and lat < greatest(y0, y1) and x0 + (lat - y0) / (y1 - y0) * (x1 - x0) > lon group by all having count(*) % 2 = 1)""",
    "p5_found": _SNAPS + "select bpuic, snap::varchar as valid_from, valid_to::varchar as valid_to from p",
    "p5_history": _SNAPS + "select bpuic, name, lat::double as lat, lon::double as lon, snap as valid_from, valid_to from p",
    "p6_found": f"select distinct leg_id from ({_FAULTS})",
    "p6_faults": _FAULTS,
}
