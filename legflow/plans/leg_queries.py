"""Queries of the leg builder: hops, verdicts, registries, pieces, days, journeys, and the staging rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legflow.operators import legs as L
from legflow.operators import staging as S
from legflow.plans import feeds as D
from legflow.tables import table

AREA = L.Area(5.9, 45.8, 10.5, 47.9)
CLIP = L.Area(5.9, 45.8, 10.5, 47.9, ("A", "ASIA", "AMERICA"))
RUN = ["service_day", "trip_id"]


def _e_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.coalesce("sched_dep", "sched_arr").asc_nulls_last(), F.col("station").asc_nulls_last(), F.col("seq")]
    return L.hops(D.event_stops(spark, sf_dir), order, RUN)


def _l_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.hops(D.order_stops(spark, sf_dir), [F.col(c) for c in ("stop_seq", "l_partkey", "l_suppkey", "l_extendedprice")], RUN, generic=True)


def leg01a_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _e_hops(spark, sf_dir)


def leg01b_hops_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _l_hops(spark, sf_dir)


def _e_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tagged(_e_hops(spark, sf_dir), D.supplier_stations(spark, sf_dir), AREA)


def _l_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tagged(_l_hops(spark, sf_dir), D.supplier_stations(spark, sf_dir), CLIP)


def leg02a_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _e_tags(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("dur").alias("dur"))


def leg02b_verdicts_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _l_tags(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("dur").alias("dur"))


def leg02_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.quarantine(_l_tags(spark, sf_dir)).select(*RUN, "from_station", "to_station", "t_dep", "dur", F.col("verdict").alias("reason"))


def leg03_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the order feed appended to the pairs of the event feed."""
    key = ["from_station", "to_station"]
    none = spark.createDataFrame([], "from_station bigint, to_station bigint, route_id bigint")
    first = L.registry(none, _e_tags(spark, sf_dir).filter("verdict = 'ok'"), key, "route_id", 10_000_000)
    return L.registry(first, _l_tags(spark, sf_dir).filter("verdict = 'ok'"), key, "route_id", 10_000_000)


def leg04_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.split(_e_tags(spark, sf_dir).filter("verdict = 'ok'"))


def leg06_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.legs(spark, sf_dir).groupBy(L.departure_day().alias("dep_day")).agg(F.count(F.lit(1)).alias("legs"), F.count_if(F.col("service_day") != L.departure_day()).alias("other_service_day"))


def leg07_journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.journeys(D.legs(spark, sf_dir))


def snk01_wire_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.wire(D.legs(spark, sf_dir))


def flt15_wire_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.unwire(L.wire(D.legs(spark, sf_dir))).groupBy("dep_day", "route_id", "route_start", "route_end").agg(F.count(F.lit(1)).alias("n"), F.sum("t_dep").alias("t"))


def stg08_push_port_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.push_port_stops(table(spark, sf_dir, "gb_sched"), table(spark, sf_dir, "gb_act"))


def leg01b_push_port_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = L.hops(stg08_push_port_stops(spark, sf_dir), [F.col("stop_seq"), F.col("station")], RUN, generic=True)
    return h.groupBy("service_day", "measured").agg(F.count(F.lit(1)).alias("n"), F.sum("dur").alias("dur"), F.sum("delay").alias("delay"), F.count_if(F.col("dur") < 0).alias("negative"))


def _one_clock(c: str) -> F.Column:
    return F.when(F.abs(c) > 100_000_000_000, F.floor(F.col(c) / 1000)).otherwise(F.col(c))


def _number(c: str) -> F.Column:
    return F.ltrim(F.regexp_extract(c, r"([0-9]+)[^0-9]*$", 1), F.lit("0"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "at_runs").distinct().select("rid", _number("num").alias("key"), *[_one_clock(c).alias(c) for c in ("t_a", "a_a", "t_b", "a_b")])


def stg07_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir).filter("t_a <= t_b").select("key", F.col("rid").cast("string").alias("id"), F.col("t_a").alias("start"), F.col("t_b").alias("end"))
    trips = table(spark, sf_dir, "at_trips").distinct().filter("t_first <= t_last").select(_number("num").alias("key"), F.col("trip_id").alias("id"), F.col("t_first").alias("start"), F.col("t_last").alias("end"))
    return S.paired_by_overlap(runs, trips)


def stg06_delay_halfway(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid = F.floor((F.col("t_a") + F.col("t_b")) / 2)
    d = S.interpolated_delay(mid, F.col("t_a"), F.col("a_a") - F.col("t_a"), F.col("t_b"), F.col("a_b") - F.col("t_b"))
    return _runs(spark, sf_dir).filter("t_a IS NOT NULL AND t_b IS NOT NULL").select("rid", d.alias("delay"))


def stg01_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines by flag as alternating rows: a run is an order, O leaves, F arrives."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("p"), "l_linestatus", F.col("l_returnflag").alias("station"))
    s = S.slots(rows, "l_orderkey", "p", "l_linestatus", "station", "O", "F")
    return s.select("l_orderkey", "slot", "station", F.col("arr_pos.l_partkey").alias("arr_part"), F.col("dep_pos.l_partkey").alias("dep_part"))


def stg02_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.order_stops(spark, sf_dir).withColumn("p", F.struct("stop_seq", "l_partkey", "l_suppkey", "l_extendedprice"))
    return S.malformed(rows, ["trip_id"], "p", "act_arr", "station")


def jn07_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose (part, supplier) lines are all lines of another order."""
    sig = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("id")).distinct()
    return S.contained(sig, ["l_partkey", "l_suppkey"], "id")


def stg04_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "gb_sched").filter("can <> 'True'").select("rid", "ts", F.col("idx").cast("bigint").alias("idx")).distinct()
    return s.withColumn("gap", S.bridged_gaps(s, ["rid", "ts"], "idx")).groupBy("rid").agg(F.count_if("gap").alias("gaps"))


def stg05_gap_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gap_hours(D.legs(spark, sf_dir).select(F.timestamp_seconds("t_dep").alias("t")), "t", 0.8).select(F.unix_seconds("hour").alias("hour"), "n")


def wn07_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "at_trips").distinct()
    return t.select("trip_id", "service_day", S.labels(t, ["service_day"], "label", ["t_first", "trip_id"]).alias("label"))


QUERIES = {
    f.__name__: f
    for f in (leg01a_hops, leg01b_hops_generic, leg02a_verdicts, leg02b_verdicts_generic, leg02_quarantine, leg03_registry, leg04_split, leg06_day_counts, leg07_journeys, snk01_wire_days, flt15_wire_decoded, stg08_push_port_stops, leg01b_push_port_legs, stg07_pairs, stg06_delay_halfway, stg01_slots, stg02_malformed, jn07_contained, stg04_gaps, stg05_gap_hours, wn07_labels)
}

_HOPS = """hops as (select service_day, trip_id, station as from_station, to_station, case when measured then act_dep else sched_dep end as t_dep,
 case when measured then aa - act_dep else sa - sched_dep end as dur, case when dep_measured and sched_dep is not null then act_dep - sched_dep end as delay, measured, category, line{runs} from
 (select *, lead(station) over w as to_station, lead(sched_arr) over w as sa, lead(act_arr) over w as aa, dep_measured and lead(arr_measured) over w as measured, row_number() over w = count(*) over (partition by service_day, trip_id) as last from stops
  window w as (partition by service_day, trip_id order by {order})) where not last)"""
_E_HOPS = f"with {D.EVENT_STOPS}, " + _HOPS.format(runs="", order="coalesce(sched_dep, sched_arr) nulls last, station nulls last, seq")
_L_HOPS = f"with {D.ORDER_STOPS}, " + _HOPS.format(runs=", coalesce(sched_dep, act_dep) is not null and coalesce(sa, aa) is not null as runs", order="stop_seq, l_partkey, l_suppkey, l_extendedprice")
_TAGS = f""", {D.STATIONS}, tags as (select h.*, case {{first}} when t_dep is null or dur is null then 'missing_time' when dur < 0 then 'negative_duration' when dur = 0 then 'zero_duration' when dur > 86400 then 'absurd_duration'
 when f.station is null or t.station is null then 'unmatched_station' when f.lon not between 5.9 and 10.5 or f.lat not between 45.8 and 47.9 or t.lon not between 5.9 and 10.5 or t.lat not between 45.8 and 47.9 then 'outside_bbox' {{last}} else 'ok' end as verdict
 from hops h left join dim f on f.station = from_station left join dim t on t.station = to_station)"""
_E_TAGS = _E_HOPS + _TAGS.format(first="", last="")
_L_TAGS = _L_HOPS + _TAGS.format(first="when not runs then 'not_run'", last="when f.country not in ('A', 'ASIA', 'AMERICA') or t.country not in ('A', 'ASIA', 'AMERICA') then 'outside_country'")
_JOURNEYS = f"""{D.LEGS}, d as (select *, (date '1970-01-01' + (t_dep // 86400)::int)::date as dep_day from legs),
 j as (select dep_day, service_day, trip_id, (row_number() over (partition by dep_day order by service_day, trip_id) - 1)::bigint as journey_id, line
  from (select dep_day, service_day, trip_id, first(line order by t_dep, route_id, from_bpuic, to_bpuic, leg_id) as line from d group by all))"""
_WIRE = f"""{_JOURNEYS}, w as (select dep_day, case when route_start = 0 and route_end = 255 then route_id::bigint else route_id::bigint | (route_start::bigint << 16) | (route_end::bigint << 24) end as route_id, journey_id, t_dep, dur::bigint as dur, type_id::bigint as type_id, delay::bigint as delay,
 (flags::int | case when route_start = 0 and route_end = 255 then 0 else 4 end)::bigint as flags from d join j using (dep_day, service_day, trip_id))"""
_SECS = "(split_part({0}, ':', 1)::bigint * 3600 + split_part({0}, ':', 2)::bigint * 60 + coalesce(nullif(split_part({0}, ':', 3), '')::bigint, 0))"
_NEAR = "({0} + 86400 * round((({1}) - ({0})) / 86400.0)::bigint)"
_TS = "(epoch_us(regexp_replace(ts, '\\.[0-9]+', '')::timestamptz), rpad(regexp_extract(ts, '\\.([0-9]+)', 1), 9, '0'))"
_BASE37 = " + ".join(f"(case when ascii(substr(c, {i}, 1)) between 65 and 90 then ascii(substr(c, {i}, 1)) - 64 when ascii(substr(c, {i}, 1)) between 48 and 57 then ascii(substr(c, {i}, 1)) - 21 else 0 end)::bigint * {37 ** (7 - i)}" for i in range(1, 8))
_NULLSAFE = " and ".join(f"s.{k} is not distinct from a.{k}" for k in ("rid", "tpl", "wta", "wtd", "wtp"))
_PORT = f"""with m as (select *, {_TS} as t from gb_sched), s0 as (select distinct rid, tpl, wta, wtd, wtp, ssd, toc, train_id, train_cat, idx::bigint as idx, can from (select *, max(t) over (partition by rid) as mt from m) where t = mt and deleted <> 'True'),
s1 as (select *, coalesce({_SECS.format('wtd')}, {_SECS.format('wta')}, {_SECS.format('wtp')}) as w from s0),
s2 as (select *, case when w < lag(w) over (partition by rid order by idx, tpl) - 43200 then 1 else 0 end as wrap from s1),
s3 as (select *, sum(wrap) over (partition by rid order by idx, tpl)::bigint * 86400 + epoch(ssd::date)::bigint as day from s2),
s as (select *, case when wta is not null then {_NEAR.format(_SECS.format('wta') + ' + day', 'w + day')} end as sched_arr, case when wtd is not null then {_NEAR.format(_SECS.format('wtd') + ' + day', 'w + day')} end as sched_dep from s3 where can <> 'True' and (wta is not null or wtd is not null)),
a0 as (select *, {_TS} as t from gb_act),
a1 as (select rid, tpl, wta, wtd, wtp, 'arr' as side, at_arr as v, coalesce(arr_removed, '') = 'True' as gone, t from a0 union all select rid, tpl, wta, wtd, wtp, 'dep', at_dep, coalesce(dep_removed, '') = 'True', t from a0),
a2 as (select rid, tpl, wta, wtd, wtp, side, arg_max({{'v': v, 'gone': gone}}, (t, coalesce(v, ''))) as x from a1 where v is not null or gone group by all),
a as (select rid, tpl, wta, wtd, wtp, max({_SECS.format('x.v')}) filter (side = 'arr') as ta, max({_SECS.format('x.v')}) filter (side = 'dep') as td from a2 where not x.gone group by all),
p as (select s.*, case when ta is not null then {_NEAR.format('ta', 'coalesce(sched_arr, sched_dep)')} end as act_arr, case when td is not null then {_NEAR.format('td', 'coalesce(sched_dep, sched_arr)')} end as act_dep from s left join a on {_NULLSAFE}),
stops as (select ssd::date as service_day, rid as trip_id, toc as operator, train_id as train_number, train_cat as category, {_BASE37} as station, idx as stop_seq, sched_arr, sched_dep, act_arr, act_dep, act_arr is not null as arr_measured, act_dep is not null as dep_measured from (select *, rpad(upper(tpl), 7, ' ') as c from p))"""
_RUNS = """r as (select distinct rid, ltrim(regexp_extract(num, '([0-9]+)[^0-9]*$', 1), '0') as key, case when t_a > 100000000000 then t_a // 1000 else t_a end as t_a, case when a_a > 100000000000 then a_a // 1000 else a_a end as a_a,
 case when t_b > 100000000000 then t_b // 1000 else t_b end as t_b, case when a_b > 100000000000 then a_b // 1000 else a_b end as a_b from (select distinct * from at_runs))"""
_OK = "case when {0} between -1200 and 43200 then {0} end"
_SPLIT = """, n as (select *, ceil(dur / 3600.0)::bigint as n from tags where verdict = 'ok'), x as (select *, unnest(generate_series(0, n - 1)) as i from n)"""

SQL = {
    "leg01a_hops": _E_HOPS + " select * from hops",
    "leg01b_hops_generic": _L_HOPS + " select * from hops",
    "leg02a_verdicts": _E_TAGS + " select verdict, count(*) as n, sum(dur)::bigint as dur from tags group by 1",
    "leg02b_verdicts_generic": _L_TAGS + " select verdict, count(*) as n, sum(dur)::bigint as dur from tags group by 1",
    "leg02_quarantine": _L_TAGS + " select service_day, trip_id, from_station, to_station, t_dep, dur, verdict as reason from tags where verdict not in ('ok', 'outside_bbox', 'outside_country', 'not_run')",
    "leg03_registry": _E_TAGS + ", e as (select distinct from_station, to_station from tags where verdict = 'ok'), " + _L_TAGS[5:].replace("stops as", "stops_l as", 1).replace("from stops\n", "from stops_l\n").replace("from stops ", "from stops_l ").replace("hops as (select", "hops_l as (select", 1).replace("from hops h", "from hops_l h").replace("tags as (select", "tags_l as (select").replace("dim as (select", "dim_l as (select").replace("left join dim ", "left join dim_l ")
    + """, l as (select distinct from_station, to_station from tags_l where verdict = 'ok'), r1 as (select *, row_number() over (order by from_station, to_station) - 1 as route_id from e)
 select from_station, to_station, route_id::bigint as route_id from r1 union all select from_station, to_station, (row_number() over (order by from_station, to_station) + (select coalesce(max(route_id), -1) from r1))::bigint from (select * from l except select from_station, to_station from r1)""",
    "leg04_split": _E_TAGS + _SPLIT + """ select service_day, trip_id, from_station, to_station, category, line, t_dep + 3600 * i as t_dep, least(3600, dur - 3600 * i) as dur, least(32767, greatest(-32768, coalesce(delay, 0)))::bigint as delay,
 (case when measured then 0 else 1 end | case when dur > 3600 then 6 else 0 end)::bigint as flags, case when dur > 3600 then greatest(i, least(255 - (n - i), round(3600 * i * 255 / dur::double)::bigint)) else 0 end as route_start,
 case when dur > 3600 then greatest(i + 1, least(255 - (n - i - 1), round(least(dur, 3600 * (i + 1)) * 255 / dur::double)::bigint)) else 255 end as route_end from x""",
    "leg06_day_counts": f"with {D.LEGS} select dep_day, count(*) as legs, count(*) filter (service_day <> dep_day) as other_service_day from (select *, (date '1970-01-01' + (t_dep // 86400)::int)::date as dep_day from legs) group by 1",
    "leg07_journeys": f"with {_JOURNEYS} select * from j",
    "snk01_wire_days": f"with {_WIRE} select * from w",
    "flt15_wire_decoded": f"with {_WIRE} select dep_day, case when flags & 4 <> 0 then route_id & 65535 else route_id end as route_id, case when flags & 4 <> 0 then (route_id >> 16) & 255 else 0 end as route_start, case when flags & 4 <> 0 then (route_id >> 24) & 255 else 255 end as route_end, count(*) as n, sum(t_dep)::bigint as t from w group by 1, 2, 3, 4",
    "stg08_push_port_stops": _PORT + " select * from stops",
    "leg01b_push_port_legs": _PORT + ", " + _HOPS.format(runs="", order="stop_seq, station").replace(", category, line from", " from") + " select service_day, measured, count(*) as n, sum(dur)::bigint as dur, sum(delay)::bigint as delay, count(*) filter (dur < 0) as negative from hops group by 1, 2",
    "stg07_pairs": f"""with {_RUNS}, t as (select distinct trip_id, ltrim(regexp_extract(num, '([0-9]+)[^0-9]*$', 1), '0') as key, t_first, t_last from at_trips where t_first <= t_last),
 x as (select rid::varchar as left_id, trip_id as right_id, least(t_b, t_last) - greatest(t_a, t_first) as overlap from r join t using (key) where t_a <= t_b),
 y as (select *, row_number() over (partition by left_id order by overlap desc, right_id) as l, row_number() over (partition by right_id order by overlap desc, left_id) as r from x where overlap >= -900) select left_id, right_id, overlap from y where l = 1 and r = 1""",
    "stg06_delay_halfway": f"""with {_RUNS}, d as (select *, (t_a + t_b) // 2 as s, {_OK.format('(a_a - t_a)')} as da, {_OK.format('(a_b - t_b)')} as db from r where t_a is not null and t_b is not null),
 e as (select *, coalesce(da, db) as x, coalesce(db, da) as y from d) select rid, (case when s <= t_a or t_a = t_b then x when s >= t_b then y else round(x + (y - x) * (s - t_a) / (t_b - t_a)::double) end)::bigint as delay from e""",
    "stg01_slots": """with r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as i from lineitem), s as (select *, (i + 1) // 2 as slot from r),
 bad as (select l_orderkey from s where l_linestatus <> case when i % 2 = 0 then 'O' else 'F' end union select l_orderkey from s group by l_orderkey, slot having count(distinct l_returnflag) > 1)
 select l_orderkey, slot, min(l_returnflag) as station, min(l_partkey) filter (l_linestatus = 'F') as arr_part, min(l_partkey) filter (l_linestatus = 'O') as dep_part from s where l_orderkey not in (select l_orderkey from bad) group by 1, 2""",
    "stg02_malformed": f"with {D.ORDER_STOPS} select trip_id from (select trip_id, station, act_arr < lag(act_arr) over (partition by trip_id order by stop_seq, l_partkey, l_suppkey, l_extendedprice) as back from stops) group by 1 having coalesce(bool_or(back), false) or count(*) > count(distinct station)",
    "jn07_contained": """with s as (select distinct l_partkey, l_suppkey, l_orderkey as id from lineitem),
 z as (select id, count(*) as n from s group by 1), c as (select a.id as a, b.id as b, count(*) as n from s a join s b using (l_partkey, l_suppkey) where a.id <> b.id group by 1, 2)
 select distinct a as id from c join z x on x.id = a join z y on y.id = b where c.n = x.n and (y.n > x.n or (y.n = x.n and b < a))""",
    "stg04_gaps": "select rid, count(*) filter (gap) as gaps from (select rid, coalesce(lead(idx) over (partition by rid, ts order by idx) - idx > 1, false) as gap from (select distinct rid, ts, idx from gb_sched where can <> 'True')) group by 1",
    "stg05_gap_hours": f"""with {D.LEGS}, h as (select t_dep // 3600 * 3600 as hour, count(*) as n from legs group by 1), s as (select unnest(generate_series((select min(hour) from h), (select max(hour) from h), 3600)) as hour),
 a as (select hour, coalesce(n, 0) as n from s left join h using (hour)) select hour, n from (select *, median(n) over (partition by dayofweek(to_timestamp(hour) at time zone 'UTC'), hour(to_timestamp(hour) at time zone 'UTC')) as m from a) where n < 0.8 * m""",
    "wn07_labels": "select trip_id, service_day, case when k = 1 then label else label || ' #' || k end as label from (select *, row_number() over (partition by service_day, label order by t_first, trip_id) as k from (select distinct * from at_trips))",
}
