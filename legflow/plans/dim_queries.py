"""Queries of dimensions, publishing, archives and profiles, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legflow.operators import dims as M
from legflow.operators import legs as L
from legflow.operators import publish as P
from legflow.operators import quality as Q
from legflow.operators import spatial as X
from legflow.operators import staging as S
from legflow.plans import feeds as D
from legflow.plans.board_queries import _CIRCLE, _DAY, _LINES as _ROUTES_SQL, _routes
from legflow.plans.stage_queries import _LINES, _lines
from legflow.sources import files
from legflow.tables import table

def _k() -> F.Column:
    return F.col("s_suppkey")


def _lon() -> F.Column:
    return 5.9 + F.pmod(_k() * 37, F.lit(460)) / 100


def _lat() -> F.Column:
    return 45.8 + F.pmod(_k() * 53, F.lit(215)) / 100


_SUP = "s as (select s_suppkey as k, s_name, 5.9 + (s_suppkey * 37 % 460) / 100.0 as lon, 45.8 + (s_suppkey * 53 % 215) / 100.0 as lat, s_acctbal from supplier)"
_ALWAYS = "date '1900-01-01' as valid_from, date '9999-12-31' as valid_to"


def dim03_fi_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return M.fi_stations(s.select(F.when(_k() % 5 == 0, "SE").otherwise("FI").alias("countryCode"), _k().cast("bigint").alias("stationUICCode"), F.col("s_name").alias("stationName"), F.concat(F.lit("C"), _k().cast("string")).alias("stationShortCode"), _lon().alias("longitude"), _lat().alias("latitude"), (_k() % 7 != 0).alias("passengerTraffic")))


def dim04_nl_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    text = lambda c: c.cast("string")
    return M.nl_stations(s.select(text(_k()).alias("uic"), F.col("s_name").alias("name_long"), F.concat(F.lit("C"), text(_k())).alias("code"), text(_lon()).alias("geo_lng"), text(_lat()).alias("geo_lat"), F.when(_k() % 3 == 0, "D").otherwise("NL").alias("country")))


def dim04_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.repeated_keys(table(spark, sf_dir, "dim_de"), "bpuic", "code")


def dim05_be_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    name = F.col("s_name")
    rows = s.select(
        _k().cast("string").alias("ptcarid"), name.alias("commerciallongnamefrench"), F.when(_k() % 4 == 0, F.concat(name, F.lit(" NL"))).when(_k() % 4 != 1, name).alias("commerciallongnamedutch"), F.concat(F.lit("F"), _k().cast("string")).alias("symbolicname"),
        F.when(_k() % 13 != 0, F.concat_ws(", ", _lat().cast("string"), _lon().cast("string"))).alias("geo_point_2d"), F.when(_k() % 3 == 0, "Junction").when(_k() % 3 == 1, "Station").otherwise("Stop in open track").alias("class_en"),
    )
    closed = spark.createDataFrame([(13, "Closed", "X13", 4.4, 50.6), (14, "Open still", "X14", 4.4, 50.6)], "bpuic bigint, name string, code string, lon double, lat double")
    return M.be_stations(rows, closed)


def dim07_at_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _lines(spark, sf_dir)
    place = F.concat(F.when(F.col("supp") % 10 == 0, "x").otherwise(F.concat(F.lit("at:"), (F.col("supp") % 9).cast("string"), F.lit(":"), F.col("supp").cast("string"))))
    rows = x.filter("supp % 10 <> 0").select(F.concat(F.when((F.col("k") == 1) & (F.col("supp") % 3 == 0), "P").otherwise(""), place, F.when(F.col("k") > 1, F.concat(F.lit(":0:"), F.col("k").cast("string"))).otherwise("")).alias("stop_id"), F.concat(F.lit("N"), F.lpad((F.col("part") % 50).cast("string"), 2, "0")).alias("stop_name"), (5 + F.col("part") % 8 / 8).cast("string").alias("stop_lon"), (45 + F.col("part") % 16 / 16).cast("string").alias("stop_lat"), F.when((F.col("k") == 1) & (F.col("supp") % 3 == 0), "1").otherwise("0").alias("location_type"))
    a = M.at_stations(rows)
    return a.select("bpuic", "ifopt", "name", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "country")


def dim08_gb_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German stations in the shape of the British list; a seventh has a grid reference only."""
    d = table(spark, sf_dir, "dim_de").filter(X.has_position()).groupBy("bpuic").agg(F.min(F.struct("name", "lon", "lat")).alias("p"))
    b = F.col("bpuic")
    grid = lambda c, m: F.round(F.col(f"p.{c}") * m).cast("bigint").cast("string")
    here = lambda c: F.when(b % 7 != 0, F.col(f"p.{c}").cast("string"))
    rows = d.select(F.concat(F.lit("9100"), F.substring(b.cast("string"), 4, 7)).alias("ATCOCode"), F.concat("p.name", F.lit(" Rail Station")).alias("CommonName"), F.when(b % 11 == 0, "BCT").otherwise("RLY").alias("StopType"), grid("lon", 71000).alias("Easting"), grid("lat", 111320).alias("Northing"), here("lon").alias("Longitude"), here("lat").alias("Latitude"))
    s = M.gb_stations(rows, {}, {})
    return s.select("bpuic", "name", "code", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "country")


def leg03b_seed_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part numbers as ids of brands against those of another numbering."""
    p = table(spark, sf_dir, "part")
    known = p.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("id"))
    published = p.groupBy("p_brand", "p_type").agg(F.max("p_partkey").alias("id"))
    return L.seed_conflicts(known, published, ["p_brand", "p_type"], "id").select(F.col("key").alias("pair"), "id", "known")


def leg03b_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").cast("bigint").alias("id"))
    return L.seeded(p.filter("id % 3 <> 0"), p.filter("id % 2 = 0"), ["p_brand", "p_type"], "id")


def leg10_publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thin days of the legs and what the source says of them; a day whose number divides by 3 it cancelled."""
    legs = D.legs(spark, sf_dir)
    counts = Q.filled_days(legs, 900)
    attested = counts.select(F.col("dep_day").alias("service_day"), F.lit(10).alias("trains"), F.when(F.dayofmonth("dep_day") % 3 == 0, 6).otherwise(1).alias("cancelled"))
    return Q.thin_days(counts, attested)


def snk05_current_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.current_stations(table(spark, sf_dir, "dim_de"), L.Area(5.0, 46.0, 10.0, 53.0), True)


def snk06_carried_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """January is built anew, the rest is carried over."""
    d = Q.filled_days(D.legs(spark, sf_dir)).filter("legs > 0").select("dep_day", "legs")
    old = d.filter(F.dayofmonth("dep_day") % 4 != 0).select("dep_day", (F.col("legs") + 1).alias("legs"), F.lit(P.SCHEMA).alias("schema"))
    return P.carried_days(d.filter("dep_day < date'2018-01-20'"), old)


def snk06_missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.missing_days(snk06_carried_days(spark, sf_dir), "2017-12-25", "2018-03-01")


def snk10_bridge_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.when(_k() % 2 == 0, "a").otherwise("b").alias("dataset"), _k().cast("bigint").alias("id"), F.col("s_name").alias("name"), _lon().alias("lon"), _lat().alias("lat"))
    pairs = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 = 2").select(_k().alias("route_id"), F.lit("a").alias("from_dataset"), _k().cast("bigint").alias("from_station"), F.lit("b").alias("to_dataset"), (_k() + 1).cast("bigint").alias("to_station"))
    routes, dim = P.bridge_inputs(pairs, s, {"a": 3, "b": 7})
    return routes.join(dim.select(F.col("bpuic").alias("from_bpuic"), "name"), "from_bpuic", "left").select(F.col("route_id").cast("bigint").alias("route_id"), "from_bpuic", "to_bpuic", "name")


def ag21_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.quality_report(D.legs(spark, sf_dir))


def ag22_length_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("line")[0], F.col("line")[1]
    return P.length_report(_routes(spark, sf_dir).select(F.round(X.great_circle_m(a["lon"], a["lat"], b["lon"], b["lat"]), 3).alias("metres")))


def ag23_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.floor("o_totalprice").alias("bytes"))
    return Q.census(f, 400_000)


def ag24_punctuality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By month and hour of the day."""
    legs = D.legs(spark, sf_dir)
    x = Q.punctuality(legs, [F.trunc(L.departure_day(), "month"), F.floor(F.pmod("t_dep", F.lit(86_400)) / 3600)])
    return x.withColumnsRenamed({"g0": "month", "g1": "hour"})


def ag24_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty pairs of stations, of twenty measured legs or more, with the greatest 90th percentile of delay."""
    x = Q.punctuality(D.legs(spark, sf_dir), [F.col("from_bpuic"), F.col("to_bpuic")]).filter("n >= 20")
    return x.orderBy(F.desc("p90"), "g0", "g1").limit(20).select(F.col("g0").alias("from_bpuic"), F.col("g1").alias("to_bpuic"), "n", "p50", "p90")


def wn14_merged_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _lines(spark, sf_dir).select("sid", "k", (F.col("supp") % 4).alias("place"), "s", (F.col("s") + 60).alias("leave"))
    return S.merged_calls(x, ["sid"], "k", "place", ["leave"]).select("sid", "k", "place", "s", "leave", F.col("seq").cast("bigint").alias("seq"))


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's day and an hour as a file that is missing; the days of the clock changes are among them."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.pmod(F.col("o_orderkey") * 7, F.lit(24)).alias("hour"))
    change = spark.createDataFrame([(d, h) for d in ("2025-10-26", "2025-03-30") for h in range(5)], "day string, hour bigint")
    return o.unionByName(change.withColumn("day", F.col("day").cast("date"))).distinct()


def stg05b_missing_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.missing_hours(_missing(spark, sf_dir), "Europe/London")


def stg05b_lost_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lost_days(_missing(spark, sf_dir))


def ops06_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.column_profile(table(spark, sf_dir, "gb_sched"), ["train_cat", "status", "is_passenger", "deleted", "kind", "act", "can"])


def ops07_status_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.status_months(table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate")), "day", "o_orderstatus")


def src14_largest_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat(F.col("source"), F.when(F.col("doc_id") % 9 == 0, "/").otherwise("")).alias("name"), F.col("n_chars").cast("bigint").alias("size"), F.concat(F.lit("p"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"))
    return files.largest_members(d)


def src18_rail_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs as ways between stations: the nodes the railway ones need."""
    w = D.legs(spark, sf_dir).select(F.col("route_id").alias("id"), F.when(F.col("type_id") % 2 == 0, "rail").otherwise("abandoned").alias("railway"), F.array("from_bpuic", "to_bpuic").alias("nodes"))
    w = w.groupBy("id").agg(F.max(F.struct("railway", "nodes")).alias("m")).select("id", "m.railway", "m.nodes")
    return files.merged_extracts(D.places(spark, sf_dir).select(F.col("bpuic").alias("id"), "lon", "lat"), w.union(w))[0]


def jn14_has_cancelled_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services and whether a call of theirs is cancelled: a semi join as a flag, not a count."""
    s = table(spark, sf_dir, "gb_sched").select("rid", "can")
    hit = s.filter("can = 'True'").select("rid").distinct().withColumn("part_cancelled", F.lit(True))
    return s.select("rid").distinct().join(hit, "rid", "left").select("rid", F.coalesce("part_cancelled", F.lit(False)).alias("part_cancelled"))


def jn20_journey_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and trips of one number on one day, within the hour: the pairs themselves."""
    num = lambda c: F.ltrim(F.regexp_extract(c, r"([0-9]+)[^0-9]*$", 1), F.lit("0"))
    a = table(spark, sf_dir, "at_runs").filter("t_a < 100000000000").select("rid", "service_day", num("num").alias("n"), "t_a").distinct()
    b = table(spark, sf_dir, "at_trips").select("trip_id", "service_day", num("num").alias("n"), "t_first").distinct()
    a = a.withColumn("h", F.explode(F.array(*[F.floor(F.col("t_a") / 3600) + i for i in (-1, 0, 1)])))
    x = a.join(b.withColumn("h", F.floor(F.col("t_first") / 3600)), ["service_day", "n", "h"]).filter(F.abs(F.col("t_a") - F.col("t_first")) <= 3600)
    return x.select("rid", "trip_id", "service_day").distinct()


def jn26_nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 32 stations of dim_ch within 300 m of each of dim_de and dim_at."""
    p = table(spark, sf_dir, "dim_de").select("bpuic", "lon", "lat").unionByName(table(spark, sf_dir, "dim_at").select("bpuic", "lon", "lat"))
    return X.nearest_within(p, "bpuic", table(spark, sf_dir, "dim_ch").select(F.col("bpuic").alias("near"), "lon", "lat"), "near", 300.0, 32).select("bpuic", "near", F.col("k").cast("bigint").alias("k"), F.round("metres", 3).alias("metres"))


QUERIES = {
    f.__name__: f
    for f in (
        dim03_fi_stations, dim04_nl_stations, dim04_repeated_keys, dim05_be_stations, dim07_at_stations, dim08_gb_stations, leg03b_seed_conflicts, leg03b_seeded, leg10_publishable, snk05_current_stations, snk06_carried_days, snk06_missing_days, snk10_bridge_inputs, ag21_quality_report, ag22_length_report,
        ag23_census, ag24_punctuality, ag24_corridors, wn14_merged_calls, stg05b_missing_hours, stg05b_lost_days, ops06_profile, ops07_status_months, src14_largest_members, src18_rail_cut, jn14_has_cancelled_call, jn20_journey_pairs, jn26_nearest_within,
    )
}

_B37 = " + ".join(f"(case when ascii(substr(c, {i}, 1)) between 65 and 90 then ascii(substr(c, {i}, 1)) - 64 when ascii(substr(c, {i}, 1)) between 48 and 57 then ascii(substr(c, {i}, 1)) - 21 else 0 end)::bigint * {37 ** (7 - i)}" for i in range(1, 8))
_DAYS = f"{D.LEGS}, d as (select {_DAY} as dep_day, count(*) as legs from legs group by 1)"
_CARRIED = _DAYS + ", c as (select dep_day, legs from d where dep_day < date '2018-01-20' union all select dep_day, legs + 1 from d where dep_day >= date '2018-01-20' and day(dep_day) % 4 <> 0)"
_MISSING = "m as (select o_orderdate::date as day, (o_orderkey * 7 % 24)::bigint as hour from orders union select d, h from (select unnest([date '2025-10-26', date '2025-03-30']) as d), (select unnest(generate_series(0, 4)) as h))"
_LATE = "quantile_cont(delay, 0.5) as p50, quantile_cont(delay, 0.9) as p90"

SQL = {
    "dim03_fi_stations": f"with {_SUP} select case when k % 5 = 0 then 1905000000 + k else k end::bigint as bpuic, s_name as name, 'C' || k as code, lon::double as lon, lat::double as lat, k % 7 <> 0 as passenger, case when k % 5 = 0 then 'SE' else 'FI' end as country, {_ALWAYS} from s",
    "dim04_nl_stations": f"with {_SUP} select k::bigint as bpuic, s_name as name, 'C' || k as code, lon::double as lon, lat::double as lat, true as passenger, case when k % 3 = 0 then 'D' else 'NL' end as country, {_ALWAYS} from s",
    "dim04_repeated_keys": "select 'bpuic' as key, bpuic::varchar as value, count(*) as n from dim_de group by bpuic having count(*) > 1 union all select 'code', code, count(*) from dim_de group by code having count(*) > 1",
    "dim05_be_stations": f"with {_SUP} select k::bigint as bpuic, case when k % 4 = 0 then s_name || ' / ' || s_name || ' NL' else s_name end as name, 'F' || k as code, lon::double as lon, lat::double as lat, k % 3 <> 0 as passenger, 'BE' as country, {_ALWAYS} from s where k % 13 <> 0 union all select b, n, c, 4.4, 50.6, true, 'BE', {_ALWAYS} from (values (13, 'Closed', 'X13'), (14, 'Open still', 'X14')) v(b, n, c) where b not in (select k from s where k % 13 <> 0)",
    "dim07_at_stations": f"""with {_LINES}, x as (select supp, 'N' || lpad((part % 50)::varchar, 2, '0') as nm, 5 + part % 8 / 8.0 as lon, 45 + part % 16 / 16.0 as lat, k = 1 and supp % 3 = 0 as own from lines where supp % 10 <> 0)
 select ((supp % 9) * 100000 + supp)::bigint as bpuic, 'at:' || (supp % 9) || ':' || supp as ifopt, coalesce(min(nm) filter (own), min(nm)) as name, round(coalesce(avg(lon) filter (own), avg(lon)), 9)::double as lon, round(coalesce(avg(lat) filter (own), avg(lat)), 9)::double as lat, 'AT' as country from x group by supp""",
    "dim08_gb_stations": f"""with d as (select bpuic, min({{'name': name, 'lon': lon, 'lat': lat}}) as p from dim_de where lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0) group by 1),
 n as (select substr(bpuic::varchar, 4, 7) as code, p.name as name, round(p.lon * 71000)::bigint::double as e, round(p.lat * 111320)::bigint::double as n, case when bpuic % 7 <> 0 then p.lon end as lon, case when bpuic % 7 <> 0 then p.lat end as lat from d where bpuic % 11 <> 0),
 s as (select code, name, lon, lat from n where lon is not null union all select m.code, m.name, arg_min(r.lon + (m.e - r.e) / (111320 * cos(radians(r.lat))), (pow(m.e - r.e, 2) + pow(m.n - r.n, 2), r.code)), arg_min(r.lat + (m.n - r.n) / 111320, (pow(m.e - r.e, 2) + pow(m.n - r.n, 2), r.code)) from n m, n r where m.lon is null and r.lon is not null group by 1, 2)
 select {_B37} as bpuic, name, trim(c) as code, round(lon, 6) as lon, round(lat, 6) as lat, 'GB' as country from (select *, rpad(upper(code), 7, ' ') as c from s)""",
    "leg03b_seed_conflicts": """with k as (select p_brand || ',' || p_type as pair, min(p_partkey) as a, max(p_partkey) as b from part group by 1)
 select pair, b::bigint as id, 'id ' || a as known from k where a <> b union select p.pair, p.b::bigint, 'key ' || k.pair from k p join k on p.b = k.a and p.pair <> k.pair""",
    "leg03b_seeded": "select p_brand, p_type, min(p_partkey)::bigint as id from part group by 1, 2 having min(p_partkey) % 3 <> 0 or min(p_partkey) % 2 = 0",
    "leg10_publishable": f"with {_DAYS}, s as (select unnest(generate_series((select min(dep_day) from d), (select max(dep_day) from d), interval 1 day))::date as dep_day) select dep_day, coalesce(legs, 0) as legs, case when day(dep_day) % 3 = 0 then 'explained' else 'unexplained' end as verdict from s left join d using (dep_day) where coalesce(legs, 0) < 900",
    "snk05_current_stations": "select distinct bpuic, name, lon, lat from dim_de where valid_to = date '9999-12-31' and lon between 5 and 10 and lat between 46 and 53 and passenger",
    "snk06_carried_days": f"with {_CARRIED} select * from c",
    "snk06_missing_days": f"with {_CARRIED} select d::date as dep_day from (select unnest(generate_series(date '2017-12-25', date '2018-03-01', interval 1 day)) as d) where d::date not in (select dep_day from c)",
    "snk10_bridge_inputs": "select s_suppkey::bigint as route_id, 3000000000 + s_suppkey as from_bpuic, 7000000000 + s_suppkey + 1 as to_bpuic, s_name as name from supplier where s_suppkey % 4 = 2",
    "ag21_quality_report": f"with {D.LEGS} select count(*) as legs, count(*) filter (flags & 1 <> 0) as planned, count(*) filter (flags & 2 <> 0) as pieces, min({_DAY}) as first, max({_DAY}) as last, count(distinct ({_DAY}, service_day, trip_id)) as journeys, count(distinct route_id) as routes from legs",
    "ag22_length_report": f"""with {_ROUTES_SQL}, m as (select round(round({_CIRCLE.format(a='pa.lon', b='pa.lat', c='pb.lon', d='pb.lat')}, 3) * 100)::bigint as v from routes) select quantile_cont(v, 0.5) / 100 as p50, quantile_cont(v, 0.95) / 100 as p95, quantile_cont(v, 0.99) / 100 as p99, max(v) / 100 as longest, count(*) as routes from m""",
    "ag23_census": """with d as (select o_orderdate::date as day, max(floor(o_totalprice))::bigint as bytes from orders group by 1), s as (select unnest(generate_series((select min(day) from d), (select max(day) from d), interval 1 day))::date as day)
 select date_trunc('month', day)::date as month, count(*) filter (bytes >= 400000) as usable, count(*) filter (bytes < 400000) as stub, count(*) filter (bytes is null) as absent from s left join d using (day) group by 1""",
    "ag24_punctuality": f"with {D.LEGS} select date_trunc('month', {_DAY})::date as month, t_dep % 86400 // 3600 as hour, count(delay) as n, {_LATE}, round(count(*) filter (delay < 180) / count(delay), 6) as punctual from legs where flags & 1 = 0 group by 1, 2",
    "ag24_corridors": f"with {D.LEGS} select from_bpuic, to_bpuic, count(*) as n, {_LATE} from legs where flags & 1 = 0 group by 1, 2 having count(*) >= 20 order by p90 desc, 1, 2 limit 20",
    "wn14_merged_calls": f"""with {_LINES}, x as (select sid, k, supp % 4 as place, s, lag(supp % 4) over w as p, lead(supp % 4) over w as q, lead(s) over w as t from lines window w as (partition by sid order by k))
 select sid, k, place, s, case when q = place then t else s end + 60 as leave, row_number() over (partition by sid order by k) as seq from x where p is null or p <> place""",
    "stg05b_missing_hours": f"""with {_MISSING}, l as (select day + hour::int * interval 1 hour as local from m), t as (select local, unnest([timezone('Europe/London', local) - interval 1 hour, timezone('Europe/London', local), timezone('Europe/London', local) + interval 1 hour]) as u from l)
 select distinct epoch(u)::bigint // 3600 as hour from t where timezone('Europe/London', u) = local""",
    "stg05b_lost_days": f"with {_MISSING} select distinct day from m where hour in (2, 3)",
    "ops06_profile": " union all ".join(f"select '{c}' as \"column\", {c} as value, count(*) as n from gb_sched group by {c}" for c in ("train_cat", "status", "is_passenger", "deleted", "kind", "act", "can")),
    "ops07_status_months": "select date_trunc('month', o_orderdate)::date as month, o_orderstatus as status, count(*) as n, min(o_orderdate)::date as first from orders group by 1, 2",
    "src14_largest_members": "select name, m.size as size, m.path as path from (select name, max({'size': size, 'path': path}) as m from (select source as name, n_chars::bigint as size, 'p' || lpad(doc_id::varchar, 9, '0') as path from documents where doc_id % 9 <> 0) where size > 0 and name is not null and not ends_with(name, '/') group by 1)",
    "src18_rail_cut": f"""with {D.LEGS}, {D.PLACES}, w as (select route_id, max({{'r': case when type_id % 2 = 0 then 'rail' else 'abandoned' end, 'n': [from_bpuic, to_bpuic]}}) as m from legs group by 1),
 n as (select distinct unnest(m.n) as id from w where m.r = 'rail') select id, p.lon as lon, p.lat as lat from (select bpuic as id, min({{'lon': lon, 'lat': lat}}) as p from places group by 1) semi join n using (id)""",
    "jn14_has_cancelled_call": "select rid, bool_or(coalesce(can, '') = 'True') as part_cancelled from gb_sched group by 1",
    "jn20_journey_pairs": "with a as (select distinct rid, service_day, ltrim(regexp_extract(num, '([0-9]+)[^0-9]*$', 1), '0') as n, t_a from at_runs where t_a < 100000000000), b as (select distinct trip_id, service_day, ltrim(regexp_extract(num, '([0-9]+)[^0-9]*$', 1), '0') as n, t_first from at_trips) select distinct rid, trip_id, service_day from a join b using (service_day, n) where abs(t_a - t_first) <= 3600",
    "jn26_nearest_within": f"""with p as (select distinct bpuic, lon, lat from (select bpuic, lon, lat from dim_de union all select bpuic, lon, lat from dim_at) where lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0)), q as (select distinct bpuic as near, lon as x, lat as y from dim_ch where lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0)),
 d as (select bpuic, near, min({_CIRCLE.format(a='lon', b='lat', c='x', d='y')}) as m from p join q on abs(lat - y) < 0.003 group by 1, 2), r as (select *, row_number() over (partition by bpuic order by m, near) as k from d where m <= 300) select bpuic, near, k, round(m, 3) as metres from r where k <= 32""",
}
