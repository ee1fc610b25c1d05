"""Queries of the interactive kind, across datasets and along routes, with SQL where SQL can say it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legflow.operators import board as B
from legflow.operators import geometry as G
from legflow.operators import legs as L
from legflow.operators import links as K
from legflow.operators.spatial import great_circle_m, has_position
from legflow.plans import feeds as D
from legflow.runtime import broadcast_checked
from legflow.tables import table

AT = 1_515_571_200  # 2018-01-10 08:00 UTC
HUB = 8_599_000_001
BOX = (2.0, 43.0, 15.0, 53.0)


def q01_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.window(D.legs(spark, sf_dir), AT)


def q02_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.search(D.legs(spark, sf_dir), " S 1", AT)


def q02_search_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three datasets by train type: the best of each, then of all."""
    legs = D.legs(spark, sf_dir).withColumn("dataset", F.pmod("type_id", F.lit(3)).cast("bigint"))
    return B.search(legs, "IC", AT, by=("dataset",))


def so04_board_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 36 departures of long-distance types from anywhere in the window."""
    x = B.window(D.legs(spark, sf_dir), AT).filter("type_id IN (0, 1, 2)")
    return x.orderBy("t_dep", "leg_id").limit(36).select("leg_id", "t_dep")


def so05_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two datasets' windows as one list by departure, with its places."""
    legs = D.legs(spark, sf_dir)
    a, b = (B.window(legs.filter(F.col("flags").bitwiseAND(1) == f), AT).select("leg_id", "t_dep", F.lit(f).cast("bigint").alias("dataset")) for f in (0, 1))
    from pyspark.sql import Window

    return a.unionByName(b).withColumn("place", F.row_number().over(Window.orderBy("t_dep", "dataset", "leg_id")).cast("bigint"))  # a window: thousands of legs


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with departures of three datasets; each lacks some."""
    d = D.legs(spark, sf_dir).select(F.pmod("type_id", F.lit(3)).alias("k"), L.departure_day().alias("day")).groupBy("k", "day").agg(F.count(F.lit(1)).alias("legs"))
    d = d.filter(F.pmod(F.unix_date("day"), F.col("k") + 3) != 0)
    return d.select(F.concat(F.lit("d"), F.col("k").cast("string")).alias("dataset"), "day", "legs")


def q07_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said at every sixth hour of January and February."""
    days = _days(spark, sf_dir)
    ends = days.groupBy("dataset").agg(F.min("day").alias("start"), F.max("day").alias("end")).withColumn("pos", F.substring("dataset", 2, 1).cast("bigint"))
    off = days.filter("legs % 5 = 0").select("dataset", "day")
    gaps = days.filter("legs % 3 = 0").select("dataset", (F.unix_date("day") * 24 + 6).cast("bigint").alias("hour"))
    at = spark.range(0, 240).select((F.lit(1_514_764_800) + F.col("id") * 21_600).alias("at"))
    return B.coverage_notices(at, ends, days.select("dataset", "day"), off, gaps)


def q09_initial_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.initial_day(_days(spark, sf_dir), "d0", "2018-01-15", 500)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from journeys of dataset a to those of b: legs that follow each other on a route within a day."""
    from pyspark.sql import Window

    w = Window.partitionBy("route_id", L.departure_day()).orderBy("t_dep", "leg_id")
    x = D.legs(spark, sf_dir).withColumn("to_journey", F.lead("leg_id").over(w)).filter("to_journey IS NOT NULL")
    return x.select(L.departure_day().alias("day"), F.lit("a").alias("from_dataset"), F.col("leg_id").alias("from_journey"), F.lit("b").alias("to_dataset"), "to_journey", F.when(F.col("flags").bitwiseAND(1) == 1, "bridge").otherwise("handover").alias("kind"), "t_dep", "dur", "type_id", "delay")


def q11_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = D.legs(spark, sf_dir).select(F.lit("a").alias("dataset"), F.col("leg_id").alias("journey"), F.col("t_dep").alias("start"))
    return B.linked(j, _links(spark, sf_dir), "from")


def lnk08_bridge_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _links(spark, sf_dir).filter("kind = 'bridge'").select(F.col("from_dataset").alias("dataset"), F.col("from_journey").alias("journey"), F.col("from_journey").alias("route"), "t_dep", "dur", "type_id", "delay")
    return K.bridge_legs(b, AT - 86_400, AT + 86_400).select("dataset", *[F.col(c).cast("bigint").alias(c) for c in ("route_id", "journey_id", "route_start", "route_end", "t_dep", "dur", "type_id", "delay", "flags")])


def lnk08_linked_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.linked_ends(_links(spark, sf_dir), ["a", "b"])


def flt13_shown_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = D.legs(spark, sf_dir).withColumn("dataset", F.lit("ch"))
    g = table(spark, sf_dir, "train_types").select(F.lit("ch").alias("dataset"), "type_id", F.when(F.col("type_id") < 3, "fast").when(F.col("type_id") < 6, "local").alias("group")).filter("group IS NOT NULL")
    return B.of_groups(legs, g, ["fast", "other"]).groupBy("type_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("type_id").cast("bigint").alias("type_id"), "n")


def lnk06b_edge_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every station of each dataset, as the end of a bridge, to the nearest of the next."""
    s = _stations(spark, sf_dir).filter(has_position()).groupBy("dataset", "id").agg(F.min(F.struct("lon", "lat")).alias("p")).select("dataset", "id", "p.lon", "p.lat")
    nxt = F.when(F.col("dataset") == "at", "ch").when(F.col("dataset") == "ch", "de").otherwise("at")
    a = s.select(F.col("dataset").alias("from_dataset"), F.col("id").alias("from_station"), nxt.alias("to_dataset"))
    pick = s.groupBy(F.col("dataset").alias("to_dataset")).agg(F.min("id").alias("to_station"))
    return K.edge_distances(a.join(pick, "to_dataset"), s).select("dataset", "station", "other", F.round("metres", 2).alias("metres"))


def q03_journey_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.journey_spans(D.legs(spark, sf_dir))


def q04_journey_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.journey_routes(D.legs(spark, sf_dir))


def q05_station_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.station_board(D.legs(spark, sf_dir), HUB, AT)


def q08_covered_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.covered_day(D.legs(spark, sf_dir).select(L.departure_day().alias("day")), "2018-02-14")


def pos01_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.positioned(D.legs(spark, sf_dir), AT)


def pos02_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.active(D.legs(spark, sf_dir), AT).select("leg_id", "t_dep", F.col("dur").cast("bigint").alias("dur"))


def pos03_delay_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.known_delay()
    return D.legs(spark, sf_dir).select(F.floor(B.delay_step(d) * 20 + 1e-9).alias("step")).groupBy("step").agg(F.count(F.lit(1)).alias("n"))


def ag20_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.running(D.legs(spark, sf_dir))


def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, f"dim_{d}").select(F.lit(d).alias("dataset"), F.col("bpuic").alias("id"), "name", "lon", "lat").distinct() for d in ("at", "ch", "de")])


def lnk01_crosswalk_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.crosswalk_pairs(_stations(spark, sf_dir))


def _crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are unique within a dataset only: a node is both."""
    node = lambda x: F.struct(F.col(f"{x}_dataset").alias("dataset"), F.col(f"{x}_id").alias("id")).alias(x)
    c = K.components(K.crosswalk_pairs(_stations(spark, sf_dir)).select(node("a"), node("b")), "a", "b")
    return c.select("node.dataset", "node.id", F.col("component.dataset").alias("root_dataset"), F.col("component.id").alias("root_id"))


def lnk01_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crosswalk(spark, sf_dir)


def lnk02_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = K.visits(D.legs(spark, sf_dir))
    return v.groupBy("side", "station", K.train_number(F.col("trip_id")).alias("number")).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


def _datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The legs as those of three datasets: by train type, which also ranks them."""
    return D.legs(spark, sf_dir).select(F.col("leg_id").alias("id"), F.concat_ws(">", "from_bpuic", "to_bpuic").alias("place"), F.pmod("type_id", F.lit(3)).cast("bigint").alias("dataset"), F.pmod("type_id", F.lit(3)).cast("bigint").alias("rank"), "t_dep")


def lnk07_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.hidden_copies(_datasets(spark, sf_dir))


def _bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.legs(spark, sf_dir).select(L.departure_day().alias("day"), F.col("from_bpuic").alias("from_station"), F.col("to_bpuic").alias("to_station"), F.concat_ws("|", "trip_id").alias("number"), F.col("dur").cast("bigint").alias("dur"))


def lnk06_bridge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.bridge_pairs(_bridges(spark, sf_dir))


def lnk05_one_per_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and trips of one number within an hour of each other as links between journeys."""
    num = lambda c: F.coalesce(F.nullif(F.ltrim(F.regexp_extract(c, r"([0-9]+)[^0-9]*$", 1), F.lit("0")), F.lit("")), F.lit("0"))
    sec = lambda c: F.when(F.col(c) > 100_000_000_000, F.floor(F.col(c) / 1000)).otherwise(F.col(c)).cast("bigint")
    hour = F.floor(F.col("t") / 3600)
    # a run without its first time is compared by its last, as in p7_found
    by_end = F.col("t_a").isNull()
    a = table(spark, sf_dir, "at_runs").filter("num RLIKE '[0-9]'").select(num("num").alias("n"), F.col("rid").cast("string").alias("journey_a"), by_end.alias("by_end"), F.coalesce(sec("t_a"), sec("t_b")).alias("t")).filter("t IS NOT NULL").distinct()
    b = table(spark, sf_dir, "at_trips").filter("num RLIKE '[0-9]'").select(num("num").alias("n"), F.col("trip_id").alias("journey_b"), F.explode(F.array(F.struct(F.lit(False).alias("by_end"), sec("t_first").alias("t")), F.struct(F.lit(True).alias("by_end"), sec("t_last").alias("t")))).alias("e")).select("n", "journey_b", "e.*").filter("t IS NOT NULL").distinct()
    a = a.withColumn("h", F.explode(F.array(hour - 1, hour, hour + 1)))
    b = b.withColumn("h", hour).withColumnRenamed("t", "u")
    x = a.join(b, ["n", "by_end", "h"]).filter(F.abs(F.col("t") - F.col("u")) <= 3600)
    x = x.select(F.date_from_unix_date(F.floor(F.col("t") / 86400).cast("int")).alias("day"), "journey_a", "journey_b", F.lit("bridge").alias("kind"), F.abs(F.col("t") - F.col("u")).alias("dur"))
    return K.one_per_end(x)


def _calls(spark: SparkSession, sf_dir: str, flags: int) -> DataFrame:
    from pyspark.sql import Window

    p = D.places(spark, sf_dir).groupBy("bpuic").agg(F.max("lon").alias("lon"), F.max("lat").alias("lat"))
    # few trains of one number run twice a day here: modulo 400 they meet
    # by journey from the start: repeated rows, order and itineraries then follow from this one shuffle
    l = table(spark, sf_dir, "fct_legs").filter(F.col("flags").bitwiseAND(1) == flags).repartition("service_day", "trip_id").distinct()
    v = K.visits(l).withColumn("number", F.pmod(K.train_number(F.col("trip_id")).cast("bigint"), F.lit(400))).filter("number IS NOT NULL")
    key = ["service_day", "trip_id"]
    w = Window.partitionBy(*key).orderBy("t", "side", "station")
    v = v.withColumn("pos", F.row_number().over(w) - 1).withColumn("last", F.count(F.lit(1)).over(Window.partitionBy(*key)) - 1)
    small = broadcast_checked(p, 1_000_000)  # three numbers a station; a join by station would shuffle every call
    v = v.join(p if small is None else small, F.col("station") == F.col("bpuic"), "left")
    return v.select(F.col("service_day").alias("day"), "number", F.col("trip_id").alias("journey"), "pos", "last", "side", F.when(F.pmod("station", F.lit(3)) == 0, F.col("station")).alias("station"), F.lit("XX").alias("country"), "lon", "lat", "t")


def lnk03_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured and planned legs as two datasets that share every third station."""
    return K.judged(_calls(spark, sf_dir, 0), _calls(spark, sf_dir, 1), ("XX", "XX"), spark.createDataFrame([(-1,)], "station bigint"))


def lnk04_linked_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _calls(spark, sf_dir, 0), _calls(spark, sf_dir, 1)
    return K.linked_days(a, b, ("XX", "XX"), True).select("from_side", "day", "number", "journey_a", "journey_b", "kind", "dur")


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each route as the straight line between its stations."""
    p = D.places(spark, sf_dir).filter("lon IS NOT NULL AND lat IS NOT NULL AND NOT (lon = 0 AND lat = 0)").groupBy("bpuic").agg(F.max(F.struct("lon", "lat")).alias("p"))
    r = D.legs(spark, sf_dir).groupBy(F.col("route_id").cast("bigint").alias("route_id")).agg(F.min(F.struct("from_bpuic", "to_bpuic")).alias("e"))
    a, b = p.select(F.col("bpuic").alias("fa"), F.col("p").alias("pa")), p.select(F.col("bpuic").alias("fb"), F.col("p").alias("pb"))
    x = r.join(a, F.col("e.from_bpuic") == F.col("fa")).join(b, F.col("e.to_bpuic") == F.col("fb"))
    return x.select("route_id", F.array("pa", "pb").alias("line"))


def geo01_fitted_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fitted_box(D.places(spark, sf_dir).filter("lon <> 0 OR lat <> 0"))


def geo02_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _routes(spark, sf_dir)
    a, b = F.col("line")[0], F.col("line")[1]
    return r.select("route_id", F.round(G.flat_metres(a["lon"], a["lat"], b["lon"], b["lat"], 47.0), 3).alias("flat_m"), F.round(great_circle_m(a["lon"], a["lat"], b["lon"], b["lat"]), 3).alias("circle_m"))


def geo08_quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _routes(spark, sf_dir).select("route_id", F.posexplode(G.quantized(F.col("line"), BOX)).alias("i", "p"))
    return r.select("route_id", F.col("i").cast("bigint").alias("i"), F.col("p.x").cast("bigint").alias("x"), F.col("p.y").cast("bigint").alias("y"))


def geo09_train_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the trains under way are: their fraction of the route along its line."""
    on = B.positioned(D.legs(spark, sf_dir), AT).filter("state = 'moving'")
    s = on.join(D.legs(spark, sf_dir).select("leg_id", F.col("route_id").cast("bigint").alias("route_id")), "leg_id").select("route_id", "leg_id", "fraction")
    p = G.along(_routes(spark, sf_dir), s)
    return p.select("leg_id", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"))


def geo06_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every route over a graph whose nodes are the stations and whose edges are the routes themselves."""
    p = D.places(spark, sf_dir).filter(has_position()).groupBy("bpuic").agg(F.max(F.struct("lon", "lat")).alias("p")).select(F.col("bpuic").alias("station"), "p.lon", "p.lat")
    r = D.legs(spark, sf_dir).groupBy(F.col("route_id").cast("bigint").alias("route_id")).agg(F.min(F.struct("from_bpuic", "to_bpuic")).alias("e")).select("route_id", F.col("e.from_bpuic").alias("from_station"), F.col("e.to_bpuic").alias("to_station"))
    have = p.select("station")
    r = r.join(have.withColumnRenamed("station", "from_station"), "from_station", "left_semi").join(have.withColumnRenamed("station", "to_station"), "to_station", "left_semi")
    out = G.routed(r, p, p.withColumnRenamed("station", "node"), r.select(F.col("from_station").alias("u"), F.col("to_station").alias("v")).distinct())
    return out.select("route_id", F.round("metres", 1).alias("metres"), "reason")


def geo10_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = G.network(_routes(spark, sf_dir).select("route_id", G.quantized(F.col("line"), BOX).alias("grid")))
    return n.select(*[F.col(c).cast("bigint").alias(c) for c in n.columns])


QUERIES = {
    f.__name__: f
    for f in (q01_window, q02_search, q02_search_datasets, so04_board_head, so05_merged, q07_coverage, q09_initial_day, q11_linked, lnk08_bridge_legs, lnk08_linked_ends, flt13_shown_groups, lnk06b_edge_distances, q03_journey_spans, q04_journey_routes, q05_station_board, q08_covered_day, pos01_positions, pos02_active, pos03_delay_steps, ag20_running, lnk01_crosswalk_pairs, lnk01_crosswalk, lnk02_visits, lnk03_judged, lnk04_linked_days, lnk05_one_per_end, lnk06_bridge_pairs, lnk07_hidden, geo01_fitted_box, geo02_lengths, geo08_quantized, geo09_train_points, geo06_routed, geo10_network)
}

_DAY = "(date '1970-01-01' + (t_dep // 86400)::int)::date"
_POS = f"""with {D.LEGS}, x as (select * from legs where t_dep between {AT} - 86400 and {AT} + 86400),
 g as (select service_day, trip_id, arg_max({{'leg_id': leg_id, 't_dep': t_dep, 'dur': dur, 'a': route_start, 'b': route_end}}, (t_dep, -leg_id)) filter (t_dep <= {AT}) as c, arg_min({{'leg_id': leg_id, 't_dep': t_dep, 'a': route_start}}, (t_dep, leg_id)) filter (t_dep > {AT}) as n from x group by 1, 2),
 s as (select *, case when c.t_dep + c.dur >= {AT} then 'moving' when c is not null and n is not null then 'dwelling' when c.t_dep + c.dur + 900 >= {AT} then 'arriving' when c is null and n.t_dep - 900 <= {AT} then 'waiting' end as state from g),
 p as (select service_day, trip_id, state, coalesce(c.leg_id, n.leg_id) as leg_id, round(case when state = 'moving' then (c.a + ({AT} - c.t_dep) / c.dur::double * (c.b - c.a)) / 255 when state = 'waiting' then n.a / 255 else c.b / 255 end, 6) as fraction,
  round(case when state = 'arriving' then 1 - ({AT} - c.t_dep - c.dur) / 900 when state = 'waiting' then 1 - (n.t_dep - {AT}) / 900 else 1.0 end, 6)::double as opacity from s where state is not null)"""
_SQUASH = f"trim(regexp_replace(regexp_replace(translate(lower(name), '{K.MARKED}', '{K.PLAIN}'), '\\p{{M}}+', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_WORDS = f"list_distinct(string_split({_SQUASH}, ' '))"
_TELLING = f"list_filter({_WORDS}, lambda x: not list_contains({list(K.NOISE)!r}, x))"
_CIRCLE = "2 * 6371000.0 * asin(sqrt(least(1.0, power(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * power(sin(radians({c} - {a}) / 2), 2))))"
_GRID = "least(65535, greatest(0, round_even(({v} - {lo}) / ({hi} - {lo}) * 65535, 0)))::bigint"
_LINES = f"""{D.LEGS}, {D.PLACES}, p as (select bpuic, max({{'lon': lon, 'lat': lat}}) as p from places where lon is not null and lat is not null and not (lon = 0 and lat = 0) group by 1),
 r as (select route_id::bigint as route_id, min({{'f': from_bpuic, 't': to_bpuic}}) as e from legs group by 1), routes as (select route_id, a.p as pa, b.p as pb from r join p a on a.bpuic = e.f join p b on b.bpuic = e.t)"""
_QUANT = f"""with {_LINES}, q0 as (select route_id, {_GRID.format(v='pa.lon', lo=BOX[0], hi=BOX[2])} as ax, {_GRID.format(v='pa.lat', lo=BOX[1], hi=BOX[3])} as ay, {_GRID.format(v='pb.lon', lo=BOX[0], hi=BOX[2])} as bx, {_GRID.format(v='pb.lat', lo=BOX[1], hi=BOX[3])} as b_y from routes)"""
_VISITS = "v as (select service_day, trip_id, 'dep' as side, from_bpuic as station, t_dep as t from {0} where route_start = 0 union all select service_day, trip_id, 'arr', to_bpuic, t_dep + dur from {0} where route_end = 255)"
_TRAIN = "case when regexp_matches(split_part(list_extract(string_split(trip_id, ':'), -1), '-', 1), '^[0-9]+$') then ltrim(split_part(list_extract(string_split(trip_id, ':'), -1), '-', 1), '0') end"

_AB = f"""a as (select {_DAY} as day, 'd' || (type_id % 3) as dataset, type_id % 3 as k, count(*) as legs from legs group by all), days as (select dataset, day, legs from a where (day - date '1970-01-01') % (k + 3) <> 0)"""
_LINKED = f"""links as (select {_DAY} as day, 'a' as from_dataset, leg_id as from_journey, 'b' as to_dataset, to_journey, case when flags % 2 = 1 then 'bridge' else 'handover' end as kind, t_dep, dur, type_id, delay from (select *, lead(leg_id) over (partition by route_id, t_dep // 86400 order by t_dep, leg_id) as to_journey from legs) where to_journey is not null)"""
_CALLS = "c{0} as (select service_day as day, {1}::bigint % 400 as number, trip_id as journey, (row_number() over w - 1) as pos, (count(*) over (partition by service_day, trip_id) - 1) as last, side, case when station % 3 = 0 then station end as station, lon, lat, t from v{0} left join q on bpuic = station where {1} is not null window w as (partition by service_day, trip_id order by t, side, station))"
_SPOT = "{'t': t, 'side': side, 'lon': lon, 'lat': lat, 'station': station}"


def _judged_sql(a: str, b: str, out: str, seen: str = "") -> str:
    ends = "e{0} as (with h as (select day, number, journey, arg_min(SPOT, pos) as s, arg_max(SPOT, pos) as e from {0} group by all) select h.*, arg_min(SPOT, pos) filter ({0}.lon is distinct from s.lon or {0}.lat is distinct from s.lat) as after, arg_max(SPOT, pos) filter ({0}.lon is distinct from e.lon or {0}.lat is distinct from e.lat) as before from h join {0} using (day, number, journey) group by all)"  # noqa: E501
    way = lambda p, q: f"degrees(atan2(({q}.lon - {p}.lon) * cos(radians({p}.lat)), {q}.lat - {p}.lat))"
    turn = lambda x, y: f"abs((({y}) - ({x}) + 540) % 360 - 180)"
    return f"""{ends.format(a).replace('e' + a + ' as', out + 'a as').replace('SPOT', _SPOT)}, {ends.format(b).replace('e' + b + ' as', out + 'b as').replace('SPOT', _SPOT)},
 {out}p as (select x.day, x.number, x.journey as journey_a, y.journey as journey_b, x.e as e, x.before as bf, y.s as s, y.e as ye, y.after as af from {out}a x join {out}b y using (day, number) where y.s.t >= x.s.t),
 {out}m as (select x.day, x.number, x.journey as journey_a, y.journey as journey_b, arg_min({{'pa': x.pos, 'la': x.last, 'pb': y.pos}}, (x.pos, y.pos)) as m from {a} x join {b} y using (day, number, station) where abs(x.t - y.t) <= 600 group by all),
 {out}d as (select *, s.t - e.t as gap, {_CIRCLE.format(a='e.lon', b='e.lat', c='s.lon', d='s.lat')} as dist, {turn(way('bf', 'e'), way('e', 's'))} as t1, {turn(way('e', 's'), way('s', 'af'))} as t2 from {out}p left join {out}m using (day, number, journey_a, journey_b)),
 {out} as (select day, number, journey_a, journey_b, e.t as t_dep, gap, case when m is not null and ye.t <= e.t then null when m is not null and m.pa = m.la and m.pb = 0 then 'handover' when m is not null then 'overlap'
  when e.side = 'arr' and s.side = 'dep' and gap between 60 and 5400 and dist <= 100000 and dist / gap between 4 and 70 and (bf is null or af is null or greatest(t1, t2) <= 135){seen} then 'bridge' end as kind from {out}d)"""


_UNSEEN = " and coalesce(e.station not in (select station from sh), true) and coalesce(s.station not in (select station from sh), true)"
_PAIRS = f"""with {D.LEGS}, {D.PLACES}, q as (select bpuic, max(lon) as lon, max(lat) as lat from places group by 1), l0 as (select * from legs where flags % 2 = 0), l1 as (select * from legs where flags % 2 = 1), {_VISITS.format('l0').replace('v as', 'v0 as')}, {_VISITS.format('l1').replace('v as', 'v1 as')}, {_CALLS.format(0, _TRAIN)}, {_CALLS.format(1, _TRAIN)}"""

SQL = {
    "q02_search_datasets": f"""with {D.LEGS}, x as (select *, type_id % 3 as dataset, replace(lower(coalesce(line, '')), ' ', '') as l, replace(lower(trip_id), ' ', '') as i from legs where t_dep between {AT // 86400 * 86400} and {AT // 86400 * 86400 + 86399}),
 g as (select dataset::bigint as dataset, service_day, trip_id, min(case when l = 'ic' then 0 when i = 'ic' then 1 else 2 end)::bigint as rank, min(t_dep) as start, max(t_dep + dur) as "end", arg_min(route_id, (t_dep, leg_id))::bigint as route_id, first(line order by t_dep, leg_id) as line from x where contains(l, 'ic') or contains(i, 'ic') group by 1, 2, 3),
 h as (select *, row_number() over (partition by dataset order by rank, start, service_day, trip_id) as n from g) select * exclude (n) from h where n <= 24 order by rank, start, dataset, service_day, trip_id limit 24""",
    "so04_board_head": f"with {D.LEGS} select leg_id, t_dep from legs where t_dep between {AT} - 3600 and {AT} + 3000 and type_id in (0, 1, 2) order by t_dep, leg_id limit 36",
    "so05_merged": f"with {D.LEGS} select leg_id, t_dep, (flags % 2)::bigint as dataset, row_number() over (order by t_dep, flags % 2, leg_id) as place from legs where t_dep between {AT} - 3600 and {AT} + 3000",
    "q07_coverage": f"""with {D.LEGS}, {_AB}, i as (select 1514764800 + unnest(generate_series(0, 239)) * 21600 as "at"), e as (select dataset, min(day) as lo, max(day) as hi from days group by 1),
 x as (select "at", (date '1970-01-01' + ("at" // 86400)::int)::date as day, "at" // 3600 as hour, e.* from i, e), y as (select x.*, d.legs from x left join days d on d.dataset = x.dataset and d.day = x.day),
 z as (select "at", dataset, case when legs % 5 = 0 then 'cancelled' when legs % 3 = 0 and hour % 24 = 6 then 'gap_hour' when legs is not null then null when day between lo and hi then 'source_gap' else 'outside' end as notice from y)
 select "at"::bigint as "at", arg_min(dataset, dataset) as dataset, arg_min(notice, dataset) as notice from z where notice is not null group by 1""",
    "q09_initial_day": f"""with {D.LEGS}, {_AB}, n as (select count(distinct dataset) as n from days), s as (select min(day) as d from (select day from days group by 1 having count(*) = (select n from n) and (select n from n) > 1))
 select coalesce((select d from s), (select max(day) from days where dataset = 'd0' and day = date '2018-01-15'), (select max(day) from days where dataset = 'd0' and legs >= 500), (select max(day) from days where dataset = 'd0')) as day""",
    "q11_linked": f"with {D.LEGS}, {_LINKED} select 'a' as dataset, leg_id as journey, legs.t_dep as start, 'b' as other_dataset, to_journey as other_journey, kind from legs join links on from_journey = leg_id and day = {_DAY.replace('t_dep', 'legs.t_dep')}",
    "lnk08_bridge_legs": f"with {D.LEGS}, {_LINKED} select from_dataset as dataset, from_journey + 65536 as route_id, from_journey as journey_id, 0::bigint as route_start, 1::bigint as route_end, t_dep, dur::bigint as dur, type_id::bigint as type_id, delay::bigint as delay, 128::bigint as flags from links where kind = 'bridge' and t_dep between {AT} - 86400 and {AT} + 86400",
    "lnk08_linked_ends": f"with {D.LEGS}, {_LINKED} select day, from_dataset as dataset, from_journey as journey, 'end' as side from links union select day, to_dataset, to_journey, 'start' from links",
    "flt13_shown_groups": f"with {D.LEGS} select l.type_id::bigint as type_id, count(*) as n from legs l left join train_types t using (type_id) where t.type_id is null or t.type_id < 3 or t.type_id >= 6 group by 1",
    "lnk06b_edge_distances": f"""with s as (select dataset, bpuic as id, min({{'lon': lon, 'lat': lat}}) as p from (select 'at' as dataset, bpuic, lon, lat from dim_at union all select 'ch', bpuic, lon, lat from dim_ch union all select 'de', bpuic, lon, lat from dim_de) where lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0) group by 1, 2),
 nx as (select unnest(['at', 'ch', 'de']) as f, unnest(['ch', 'de', 'at']) as t), e as (select s.dataset, s.id, nx.t as other, p from s join nx on f = s.dataset union select s.dataset, s.id, nx.f, p from nx join s on s.dataset = nx.t where s.id = (select min(id) from s s2 where s2.dataset = nx.t)),
 d as (select e.dataset, e.id, other, min({_CIRCLE.format(a='e.p.lon', b='e.p.lat', c='s.p.lon', d='s.p.lat')}) as m from e join s on s.dataset = other group by 1, 2, 3) select dataset, id as station, other, round(m, 2) as metres from d""",
    "geo06_routed": f"""with {D.LEGS}, {D.PLACES}, p as (select bpuic, max({{'lon': lon, 'lat': lat}}) as p from places where lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0) group by 1), m as (select avg(p.lat) as lat0 from p),
 r as (select route_id::bigint as route_id, min({{'f': from_bpuic, 't': to_bpuic}}) as e from legs group by 1), k as (select radians(1) * 6371000.0 as k)
 select route_id, round(sqrt(pow((b.p.lon - a.p.lon) * k * cos(radians(lat0)), 2) + pow((b.p.lat - a.p.lat) * k, 2)), 1) as metres, null::varchar as reason from r join p a on a.bpuic = e.f join p b on b.bpuic = e.t, m, k""",
    "lnk03_judged": _PAIRS + ", " + _judged_sql("c0", "c1", "j") + " select day, number, journey_a, journey_b, kind, case when kind = 'bridge' then gap end as dur, case when kind = 'bridge' then t_dep end as t_dep from j where kind is not null",
    "lnk04_linked_days": _PAIRS + ", sh as (select station from c0 where station is not null intersect select station from c1), " + _judged_sql("c0", "c1", "j", _UNSEEN) + ", " + _judged_sql("c1", "c0", "k", _UNSEEN)
    + f""", u as (select 'a' as from_side, * from j union all select 'b', * from k) select from_side, day, number, journey_a, journey_b, kind, case when kind = 'bridge' then gap end as dur from u where kind is not null and (kind <> 'bridge' or {_DAY} = day)""",
    "q01_window": f"with {D.LEGS} select * from legs where t_dep between {AT} - 3600 and {AT} + 3000",
    "q02_search": f"""with {D.LEGS}, x as (select *, replace(lower(coalesce(line, '')), ' ', '') as l from legs where t_dep between {AT // 86400 * 86400} and {AT // 86400 * 86400 + 86399})
 select service_day, trip_id, min(case when l = 's1' then 0 when replace(lower(trip_id), ' ', '') = 's1' then 1 else 2 end)::bigint as rank, min(t_dep) as start, max(t_dep + dur) as "end", arg_min(route_id, (t_dep, leg_id))::bigint as route_id, first(line order by t_dep, leg_id) as line
 from x where l like '%s1%' or replace(lower(trip_id), ' ', '') like '%s1%' group by 1, 2 order by rank, start, service_day, trip_id limit 24""",
    "q03_journey_spans": f"with {D.LEGS} select {_DAY} as dep_day, service_day, trip_id, min(t_dep) as start, max(t_dep + dur) as \"end\", arg_min(route_id, (t_dep, leg_id))::bigint as route_id, count(*) as legs from legs group by 1, 2, 3",
    "q04_journey_routes": f"with {D.LEGS}, x as (select {_DAY} as dep_day, *, lag(route_id) over w as p from legs window w as (partition by {_DAY}, service_day, trip_id order by t_dep, leg_id)) select dep_day, service_day, trip_id, row_number() over (partition by dep_day, service_day, trip_id order by t_dep, leg_id) as pos, route_id::bigint as route_id from x where route_id is distinct from p",
    "q05_station_board": f"""with {D.LEGS}, h as (select *, {_DAY} as dep_day from legs where from_bpuic = {HUB} and t_dep between {AT} - 900 and {AT} + 7200 and route_start = 0),
 r as (select h.leg_id as at_leg, l.t_dep, l.leg_id, l.to_bpuic, lag(l.to_bpuic) over (partition by h.leg_id order by l.t_dep, l.leg_id) as p from h join legs l on {_DAY.replace('t_dep', 'l.t_dep')} = h.dep_day and l.service_day = h.service_day and l.trip_id = h.trip_id and l.t_dep >= h.t_dep),
 c as (select at_leg, string_agg(to_bpuic::varchar, '>' order by t_dep, leg_id) as calls from r where to_bpuic is distinct from p group by 1) select h.leg_id, service_day, trip_id, line, t_dep as leaves, delay::bigint as delay, calls from h join c on at_leg = h.leg_id""",
    "q08_covered_day": f"with {D.LEGS} select arg_min(d, (abs(date_diff('day', d, date '2018-02-14')), -epoch(d))) as day from (select distinct {_DAY} as d from legs)",
    "pos01_positions": _POS + " select * from p",
    "pos02_active": f"with {D.LEGS} select leg_id, t_dep, dur::bigint as dur from legs where t_dep <= {AT} and t_dep >= {AT} - 3600 and t_dep + dur >= {AT}",
    "pos03_delay_steps": f"""with {D.LEGS}, d as (select case when abs(delay::int) < 10800 and flags % 2 = 0 then greatest(delay, 0)::double end as d from legs)
 select floor((case when d >= 1800 then 3.0 when d >= 600 then 2 + (d - 600) / 1200 when d >= 180 then 1 + (d - 180) / 420 when d >= 0 then d / 180 end) * 20 + 1e-9)::bigint as step, count(*) as n from d group by 1""",
    "ag20_running": f"""with {D.LEGS}, m as (select ceil(t_dep / 300.0)::bigint * 300 as mark, 1 as d from legs where dur >= 0 union all select ((t_dep + dur) // 300 + 1) * 300, -1 from legs where dur >= 0),
 s as (select mark, sum(d)::bigint as d from m group by 1) select mark, sum(d) over (order by mark)::bigint as trains from s""",
    "lnk01_crosswalk_pairs": f"""with s as (select *, {_SQUASH} as n, case when len({_TELLING}) > 0 then {_TELLING} else {_WORDS} end as w from (select distinct 'at' as dataset, bpuic as id, name, lon, lat from dim_at union all select distinct 'ch', bpuic, name, lon, lat from dim_ch union all select distinct 'de', bpuic, name, lon, lat from dim_de) where lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0)),
 x as (select a.dataset as a_dataset, a.id as a_id, b.dataset as b_dataset, b.id as b_id, a.n as an, b.n as bn, a.w as aw, b.w as bw, {_CIRCLE.format(a='a.lon', b='a.lat', c='b.lon', d='b.lat')} as d from s a join s b on a.dataset < b.dataset and abs(a.lat - b.lat) < 0.01),
 y as (select *, case when d <= 400 and (len(list_intersect(aw, bw)) = len(aw) or len(list_intersect(aw, bw)) = len(bw) or len(list_intersect(aw, bw)) * 2 >= len(list_distinct(aw || bw))) then 0 when d <= 1000 and an = bn then 1 when d <= 60 then 2 end as rank from x where d <= 1000)
 select a_dataset, a_id, b_dataset, b_id, rank::bigint as rank, round(d, 3) as d from (select *, row_number() over (partition by a_dataset, a_id, b_dataset order by rank, d, b_id) as k from y where rank is not null) where k = 1""",
    "lnk02_visits": f"with {D.LEGS}, {_VISITS.format('legs')} select side, station, {_TRAIN} as number, count(*) as n, min(t) as first, max(t) as last from v group by all",
    "lnk06_bridge_pairs": f"""with {D.LEGS}, b as (select {_DAY} as day, from_bpuic as from_station, to_bpuic as to_station, trip_id as number, dur::bigint as dur from legs), s as (select from_station, to_station, count(distinct day) as days, count(distinct number) as numbers, count(*) as n, median(dur) as median from b group by 1, 2),
 c as (select from_station, to_station, avg((abs(dur - median) <= greatest(300.0, 0.3 * median))::int) as consistent from b join s using (from_station, to_station) group by 1, 2),
 x as (select s.*, s.n / s.days::double as per_day, consistent, coalesce(r.days >= 3, false) as both_ways from s join c using (from_station, to_station) left join s r on r.from_station = s.to_station and r.to_station = s.from_station)
 select from_station, to_station, days, numbers, round(per_day, 6) as per_day, median, round(consistent, 6) as consistent, both_ways, days >= 3 and (both_ways or per_day >= 2) and numbers >= (case when both_ways then 5 else 8 end) and consistent >= 0.6 as accepted from x""",
    "lnk07_hidden": f"""with {D.LEGS}, l as (select leg_id as id, from_bpuic || '>' || to_bpuic as place, type_id % 3 as rank, t_dep from legs), h1 as (select distinct b.id from l a join l b on a.place = b.place and a.rank = 0 and b.rank = 1 and abs(a.t_dep - b.t_dep) <= 180),
 shown as (select * from l where rank < 2 and id not in (select id from h1)), h2 as (select distinct b.id from shown a join l b on a.place = b.place and b.rank = 2 and abs(a.t_dep - b.t_dep) <= 180) select id, id in (select id from h1 union all select id from h2) as hidden from l""",
    "geo01_fitted_box": f"with {D.PLACES} select min(lon) - 0.1 as west, min(lat) - 0.1 as south, max(lon) + 0.1 as east, max(lat) + 0.1 as north from places where lon <> 0 or lat <> 0",
    "geo02_lengths": f"with {_LINES} select route_id, round(sqrt(power((pb.lon - pa.lon) * (radians(1) * 6371000.0 * cos(radians(47.0))), 2) + power((pb.lat - pa.lat) * radians(1) * 6371000.0, 2)), 3) as flat_m, round({_CIRCLE.format(a='pa.lon', b='pa.lat', c='pb.lon', d='pb.lat')}, 3) as circle_m from routes",
    "geo08_quantized": _QUANT + " select route_id, 0::bigint as i, ax as x, ay as y from q0 union all select route_id, 1, bx, b_y from q0 where ax <> bx or ay <> b_y",
    "geo09_train_points": _POS + f", {_LINES.replace(D.LEGS + ', ', '').replace('p as (select bpuic', 'pp as (select bpuic').replace('join p a', 'join pp a').replace('join p b', 'join pp b')} select p.leg_id, round(pa.lon + fraction * (pb.lon - pa.lon), 5) as lon, round(pa.lat + fraction * (pb.lat - pa.lat), 5) as lat from p join legs using (leg_id) join routes on routes.route_id = legs.route_id where state = 'moving'",
    "geo10_network": _QUANT + ", s as (select distinct route_id, least({'x': ax, 'y': ay}, {'x': bx, 'y': b_y}) as a, greatest({'x': ax, 'y': ay}, {'x': bx, 'y': b_y}) as b from q0 where ax <> bx or ay <> b_y) select a.x as ax, a.y as ay, b.x as bx, b.y as \"by\", count(*) as routes from s group by 1, 2, 3, 4",
}
SQL["lnk01_crosswalk"] = f"""with recursive p as ({SQL['lnk01_crosswalk_pairs']}), e as (select {{'dataset': a_dataset, 'id': a_id}} as u, {{'dataset': b_dataset, 'id': b_id}} as v from p union select {{'dataset': b_dataset, 'id': b_id}}, {{'dataset': a_dataset, 'id': a_id}} from p),
 r as (select u as node, u as root from e union select e.v, r.root from r join e on e.u = r.node) select node.dataset as dataset, node.id as id, min(root).dataset as root_dataset, min(root).id as root_id from r group by node"""
