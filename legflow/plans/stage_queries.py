"""Feeds of every style made from the test tables, staged into stop events; and the same in SQL, from the numbers behind the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legflow.operators import stages as G
from legflow.plans import feeds as D
from legflow.plans.leg_queries import _RUNS, _runs
from legflow.tables import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as calls: the k-th of n of a run sid, at the epoch second s."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sid"), F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status"))
    w = Window.partitionBy("sid")
    l = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "sid")
    l = l.withColumn("k", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("bigint")).withColumn("n", F.count(F.lit(1)).over(w))
    s = F.unix_date("day").cast("bigint") * 86_400 + 18_000 + 600 * F.col("k") + F.pmod("l_partkey", F.lit(700))
    return l.join(o, "sid").select("sid", "cust", "day", "status", "k", "n", F.col("l_suppkey").alias("supp"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"), s.alias("s"))


_LINES = """l0 as (select l_orderkey as sid, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)::bigint as k, count(*) over (partition by l_orderkey)::bigint as n, l_suppkey as supp, l_partkey as part, l_quantity as qty, l_returnflag as rf, l_linestatus as ls from lineitem),
 lines as (select l0.*, o_custkey as cust, o_orderdate::date as day, o_orderstatus as status, epoch(o_orderdate::date)::bigint + 18000 + 600 * k + part % 700 as s from l0 join orders on o_orderkey = sid)"""


def _iso(s: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def _if(c: object, v: object) -> Column:
    return F.when(c, v)


def _local(s: Column, zone: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(s), zone)


_BACK = "epoch(timezone('{1}', timezone('{1}', to_timestamp({0}))))::bigint"  # what is left of an instant written as local time


def flt01_ist_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, z = D.legs(spark, sf_dir), "Europe/Zurich"
    t = F.col("t_dep")
    text = lambda s, f: F.date_format(_local(s, z), f)
    i = F.col("leg_id")
    rows = l.select(
        F.date_format("service_day", "dd.MM.yyyy").alias("BETRIEBSTAG"), F.concat("trip_id", F.lit("/"), i.cast("string")).alias("FAHRT_BEZEICHNER"), F.lit("SBB").alias("BETREIBER_ABK"), F.when(i % 4 == 0, "Bus").when(i % 4 == 1, "ZUG").otherwise("Zug").alias("PRODUKT_ID"),
        F.concat(F.lit("T"), "type_id").alias("VERKEHRSMITTEL_TEXT"), F.when(i % 13 == 0, "true").when(i % 7 != 0, "false").alias("FAELLT_AUS_TF"), F.when(i % 19 == 0, "x").otherwise(F.col("from_bpuic").cast("string")).alias("BPUIC"), F.lit(None).cast("string").alias("ANKUNFTSZEIT"), text(t, "dd.MM.yyyy HH:mm").alias("ABFAHRTSZEIT"),
        F.lit("").alias("AN_PROGNOSE"), F.lit("REAL").alias("AN_PROGNOSE_STATUS"), F.when(i % 11 != 0, text(t + F.col("delay"), "dd.MM.yyyy HH:mm:ss")).alias("AB_PROGNOSE"), F.when(i % 5 == 0, "PROGNOSE").when(i % 5 == 1, "GESCHAETZT").when(i % 5 != 2, "REAL").alias("AB_PROGNOSE_STATUS"), F.coalesce("line", F.lit(" ")).alias("LINIEN_TEXT"),
    )
    return G.ist_rows(rows, z).drop("train_number", "stop_seq", "sched_arr", "act_arr")


def flt02_ist_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flt01_ist_rows(spark, sf_dir).groupBy("service_day", "category", "dep_measured").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("act_dep") - F.col("sched_dep")).alias("late"))


def stg01_fi_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _lines(spark, sf_dir)
    row = lambda kind, n, s, a: F.struct(
        F.col("k"), F.lit(n).alias("o"), F.when((F.col("sid") % 17 == 0) & (F.col("k") == 1), "ARRIVAL").otherwise(kind).alias("type"), ((F.col("rf") == "R") & (F.col("k") % 3 == n)).alias("cancelled"), _iso(s).alias("scheduledTime"), F.when(F.col("qty") >= 10, _iso(a)).alias("actualTime"),
        (F.col("qty") >= 3).alias("commercialStop"), F.lit(True).alias("trainStopping"), F.col("supp").cast("bigint").alias("stationUICCode"), F.when(F.col("supp") % 5 == 0, "SE").otherwise("FI").alias("countryCode"),
    )
    both = F.array_compact(F.array(F.when(F.col("k") > 1, row("ARRIVAL", 0, F.col("s"), F.col("s") + F.col("part") % 300)), F.when(F.col("k") < F.col("n"), row("DEPARTURE", 1, F.col("s") + 60, F.col("s") + 60 + F.col("part") % 240))))
    t = x.groupBy("sid", "cust", "day", "status").agg(F.array_sort(F.flatten(F.collect_list(both))).alias("timeTableRows"))
    trains = t.select(
        F.col("day").alias("departureDate"), F.col("sid").cast("bigint").alias("trainNumber"), F.when(F.col("status") == "F", "IC").when(F.col("status") == "O", "S").otherwise("HV").alias("trainType"), F.when(F.col("status") == "F", "Long-distance").when(F.col("status") == "O", "Commuter").otherwise("Cargo").alias("trainCategory"),
        F.when(F.col("cust") % 3 == 0, "Z").when(F.col("cust") % 3 == 1, " ").alias("commuterLineID"), F.lit("vr").alias("operatorShortCode"), _if(F.col("cust") % 11 == 0, True).alias("cancelled"), "timeTableRows",
    )
    return G.fi_stops(trains)


def stg02_nl_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _lines(spark, sf_dir)
    text = lambda c: c.cast("string")
    yes = lambda c: F.when(c, "true").otherwise("false")
    rows = x.select(
        text(F.col("sid")).alias("Service:RDT-ID"), text(F.col("day")).alias("Service:Date"), F.when(F.col("status") == "F", "Intercity").when(F.col("status") == "O", "Sprinter").otherwise("Snelbus i.p.v. trein").alias("Service:Type"), F.lit("NS").alias("Service:Company"), text(F.col("sid") % 97).alias("Service:Train number"),
        yes(F.col("cust") % 11 == 0).alias("Service:Completely cancelled"), text(F.col("k")).alias("Stop:RDT-ID"), F.concat(F.lit("S"), "supp").alias("Stop:Station code"), F.when(F.col("k") > 1, _iso(F.col("s"))).alias("Stop:Arrival time"), F.when(F.col("qty") >= 10, text(F.col("part") % 7)).alias("Stop:Arrival delay"), yes(F.col("rf") == "R").alias("Stop:Arrival cancelled"),
        F.when(F.col("k") < F.col("n"), _iso(F.col("s") + 60)).alias("Stop:Departure time"), F.when(F.col("qty") >= 5, text(F.col("part") % 5)).alias("Stop:Departure delay"), yes((F.col("rf") == "A") & (F.col("ls") == "O")).alias("Stop:Departure cancelled"),
    )
    known = table(spark, sf_dir, "supplier").filter("s_suppkey % 9 <> 0").select(F.concat(F.lit("S"), "s_suppkey").alias("code"), F.col("s_suppkey").cast("bigint").alias("bpuic"))
    return _known(G.nl_stops(rows, known))


def _known(stops: DataFrame) -> DataFrame:
    """Stations no list has as -1: their stand-ins are hashes."""
    return stops.withColumn("station", F.greatest("station", F.lit(-1)))


def stg03_be_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, z = _lines(spark, sf_dir), "Europe/Brussels"
    day = lambda s: F.upper(F.date_format(_local(s, z), "ddMMMyyyy"))
    clock = lambda s: F.date_format(_local(s, z), "H:mm:ss")
    s, part, qty = F.col("s"), F.col("part"), F.col("qty")
    sides = {("PLANNED", "ARR"): (F.col("k") > 1, s), ("PLANNED", "DEP"): (F.col("k") < F.col("n"), s + 60), ("REAL", "ARR"): ((F.col("k") > 1) & (qty >= 10), s + part % 300), ("REAL", "DEP"): ((F.col("k") < F.col("n")) & (qty >= 5), s + 60 + part % 240)}
    cust = F.col("cust") % 4
    rows = x.select(
        F.upper(F.date_format("day", "ddMMMyyyy")).alias("DATDEP"), F.col("sid").cast("string").alias("TRAIN_NO"), F.when(cust == 0, "IC 03").when(cust == 1, "L B1-1").when(cust == 2, "EURST 9").alias("RELATION"), F.lit("SNCB").alias("TRAIN_SERV"), F.col("supp").cast("string").alias("PTCAR_NO"),
        F.when(part % 10 == 0, "D").when(part % 10 == 1, "P").when(part % 10 != 2, "A").alias("THOP1_COD"), *[f for (kind, side), (ok, at) in sides.items() for f in (_if(ok, day(at)).alias(f"{kind}_DATE_{side}"), _if(ok, clock(at)).alias(f"{kind}_TIME_{side}"))],
    )
    points = table(spark, sf_dir, "supplier").filter("s_suppkey % 9 <> 0").select(F.col("s_suppkey").cast("bigint").alias("bpuic"), (F.col("s_suppkey") % 7 != 0).alias("passenger"))
    return G.be_stops(rows, points, z)


def _de_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, z = _lines(spark, sf_dir), "Europe/Berlin"
    at = lambda s: _local(s, z).cast("timestamp_ntz")
    s, part, qty, cust = F.col("s"), F.col("part"), F.col("qty"), F.col("cust")
    return x.select(
        F.when(part % 50 == 0, "x").otherwise(F.concat_ws("-", "sid", F.concat(F.date_format("day", "yyMMdd"), F.lit("0500")), "k")).alias("id"), F.col("supp").cast("bigint").alias("eva"), (F.col("sid") % 61).cast("string").alias("train_number"),
        F.when(cust % 5 == 0, "ag").when(cust % 5 == 1, "ICE").when(cust % 5 == 2, "rex").when(cust % 5 == 3, "Bus").alias("train_type"), F.when(cust % 7 == 0, "RB23").when(cust % 7 == 1, "5").when(cust % 7 == 2, "SEV4").when(cust % 7 == 3, "S 1").alias("line_number"),
        _if(F.col("k") > 1, at(s)).alias("arrival_planned_time"), _if((F.col("k") > 1) & (qty >= 10), at(s + part % 300)).alias("arrival_change_time"), _if(F.col("k") < F.col("n"), at(s + 60)).alias("departure_planned_time"), _if((F.col("k") < F.col("n")) & (qty >= 5), at(s + 60 + part % 240)).alias("departure_change_time"),
        (F.col("rf") == "R").alias("arrival_is_canceled"), _if(F.col("rf") != "N", F.col("ls") == "O").alias("departure_is_canceled"), _if(part % 40 == 1, True).alias("is_additional_stop"),
    )


def stg04_de_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.de_stops(_de_feed(spark, sf_dir))


def wn19_open_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops without an onward leg that are not their run's last, by day."""
    s = stg04_de_stops(spark, sf_dir)
    top = F.max("stop_seq").over(Window.partitionBy("service_day", "trip_id"))
    return s.withColumn("top", top).groupBy("service_day").agg(F.count_if(F.col("sched_dep").isNull() & F.col("act_dep").isNull() & (F.col("stop_seq") < F.col("top"))).alias("open"), F.count(F.lit(1)).alias("stops"))


def jn05_service_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as services: bits of their number are weekdays; their orders as exceptions."""
    c = F.col("c_custkey")
    cal = table(spark, sf_dir, "customer").select(
        c.alias("service_id"), F.date_add(F.lit("1996-01-01").cast("date"), F.pmod(c * 7, F.lit(300)).cast("int")).alias("start"), F.date_add(F.lit("1996-02-01").cast("date"), F.pmod(c * 11, F.lit(400)).cast("int")).alias("end"), F.array(*[F.shiftright(c, i) % 2 == 1 for i in range(7)]).alias("weekdays")
    )
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("service_id"), F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("type"))
    return G.active_days(cal, o, "1996-06-01", "1996-12-31")


def stg07_at_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "at_runs").select("rid", "service_day").groupBy("rid").agg(F.min("service_day").alias("service_day"))
    r = _runs(spark, sf_dir).groupBy("rid").agg(F.min("key").alias("num"), *[F.min(c).alias(c) for c in ("t_a", "a_a", "t_b", "a_b")]).join(runs, "rid")
    t = table(spark, sf_dir, "at_trips").groupBy("trip_id", "service_day").agg(*[F.min(c).alias(c) for c in ("num", "label", "agency_name", "t_first")])
    trips = t.select("trip_id", "service_day", F.ltrim(F.regexp_extract("num", r"([0-9]+)[^0-9]*$", 1), F.lit("0")).alias("num"), "label", F.nullif(F.regexp_extract("label", "^([A-Za-z]+)", 1), F.lit("")).alias("prefix"), F.col("agency_name").alias("operator"), F.col("t_first").alias("t0"))
    step, seq = (F.length("trip_id") % 3 + 1) * 300, F.col("seq")
    times = t.select("trip_id").distinct().withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(4)))).select(
        "trip_id", "seq", F.concat(F.lit("at:44:"), F.pmod(F.length("trip_id") * 7 + seq * 11, F.lit(40)).cast("string"), F.lit(":0:"), seq.cast("string")).alias("stop_id"), (step * (seq - 1)).cast("bigint").alias("arr_s"), (step * (seq - 1) + F.when(seq < 4, 20).otherwise(0)).cast("bigint").alias("dep_s"), ((seq == 2) & (F.length("trip_id") % 2 == 0)).alias("passing")
    )
    places = spark.range(30).select(F.concat(F.lit("at:44:"), "id").alias("ifopt"), (F.col("id") + 4_400_000).alias("bpuic"))
    return G.at_stops(r, trips, times, places)


def _it_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _lines(spark, sf_dir)
    mark = lambda m, a: F.when(F.col("part") % m == 0, "N").when(F.col("part") % m == 1, "S").when(F.col("part") % m == 2, "n.d.").when(F.col("supp") % 10 == 4, "0").otherwise((F.col("part") % a - 5).cast("string"))
    return x.select(F.col("day").alias("service_day"), F.col("sid").alias("tidx"), F.col("k").alias("seq"), F.concat(F.lit("S"), "supp").alias("name"), F.when(F.col("k") > 1, F.col("s")).otherwise(0).alias("s_arr"), F.when(F.col("k") < F.col("n"), F.col("s") + 60).otherwise(0).alias("s_dep"), mark(13, 40).alias("ra"), mark(17, 30).alias("rp"))


def stg10_zero_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.zero_stations(_it_calls(spark, sf_dir), 20)


def _it_trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust, sid = F.col("cust"), F.col("sid")
    t = _lines(spark, sf_dir).groupBy("sid", "cust", "day").agg(F.count(F.lit(1)).alias("n"))
    op = F.unix_date("day").cast("bigint") * 86_400 + 18_000 + sid % 4 * 3600
    return t.select(
        F.col("day").alias("service_day"), sid.alias("tidx"), (cust % 200).cast("string").alias("source_id"), (cust % 50).cast("string").alias("number"), F.when(cust % 4 == 0, "").when(cust % 4 == 1, "ES*").when(cust % 4 == 2, "REG").alias("c"), F.when(sid % 3 == 0, "FR").alias("sub"),
        F.when(cust % 9 == 0, "X").otherwise("0").alias("rp"), F.lit("0").alias("ra"), op.alias("op"), (op + 7200).alias("oa"), F.when(sid % 5 == 0, "12,AA;13,BB").alias("cn"), F.col("n").alias("n_stops"),
    )


def stg09_it_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _it_calls(spark, sf_dir)
    names = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 <> 3").select(F.concat(F.lit("S"), "s_suppkey").alias("name"), F.col("s_suppkey").cast("bigint").alias("station"), (F.col("s_suppkey") % 9 == 0).alias("operational"))
    return _known(G.it_stops(_it_trains(spark, sf_dir), calls, names, G.zero_stations(calls, 20)))


def ag17_it_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.it_trains(_it_trains(spark, sf_dir)).groupBy("service_day").agg(F.count(F.lit(1)).alias("trains"), F.count_if("cancelled").alias("cancelled"))


QUERIES = {f.__name__: f for f in (flt01_ist_rows, flt02_ist_counts, stg01_fi_stops, stg02_nl_stops, stg03_be_stops, stg04_de_stops, wn19_open_ends, jn05_service_days, stg07_at_stops, stg10_zero_stations, stg09_it_stops, ag17_it_days)}

_ZRH = _BACK.format("{0}", "Europe/Zurich")
_IST = f"""with {D.LEGS}, i as (select service_day, trip_id || '/' || leg_id as trip_id, 'SBB' as operator, 'T' || type_id as category, nullif(trim(line), '') as line, case when leg_id % 19 <> 0 then from_bpuic end as station, {_ZRH.format('t_dep // 60 * 60')} as sched_dep,
 case when leg_id % 11 <> 0 then {_ZRH.format('t_dep + delay')} end as act_dep, false as arr_measured, leg_id % 5 in (1, 3, 4) and leg_id % 11 <> 0 as dep_measured from legs where leg_id % 4 <> 0 and leg_id % 13 <> 0)"""
_OUT = "service_day, trip_id, operator, train_number, category, line, station, stop_seq, sched_arr, sched_dep, act_arr, act_dep, arr_measured, dep_measured"
_DE = f"""with {_LINES}, a as (select sid || '-' || strftime(day, '%y%m%d') || '0500' as ride, k as pos, day, supp as eva, (sid % 61)::varchar as number, ['ag', 'ICE', 'rex', 'Bus', null][(cust % 5 + 1)::int] as kind, ['RB23', '5', 'SEV4', 'S 1', null, null, null][(cust % 7 + 1)::int] as ln,
  case when k > 1 then s end as sa, case when k > 1 and qty >= 10 then s + part % 300 end as ca, case when k < n then s + 60 end as sd, case when k < n and qty >= 5 then s + 60 + part % 240 end as cd, rf <> 'R' as arr_ok, not (rf <> 'N' and ls = 'O') as dep_ok from lines
  where part % 50 <> 0 and part % 40 <> 1 and cust % 5 <> 3 and cust % 7 <> 2),
 bad as (select distinct ride from (select ride, sa < lag(coalesce(sd, sa)) over (partition by ride order by pos) as b from a) where b),
 b as (select *, coalesce(sa is not null and arr_ok, false) as on_a, coalesce(sd is not null and dep_ok, false) as on_d from a where ride not in (select ride from bad)),
 c as (select *, on_d and not coalesce(lead(pos) over (partition by ride order by pos) - pos > 1, false) as go from b where on_a or on_d),
 r0 as (select ride, any_value(day) as day, any_value(kind) as kind, any_value(number) as number, any_value(ln) as ln, min(coalesce(sd, sa)) as t0 from c group by 1),
 r1 as (select *, case when kind = 'ICE' then 'ICE' when kind = 'rex' then 'RE' when ln = 'RB23' then 'RB' when ln = 'S 1' then 'S' when ln is not null then 'RB' else coalesce(upper(kind), 'TRAIN') end as category from r0),
 r2 as (select *, category || ' ' || number as label, row_number() over (partition by day, category || ' ' || number order by t0, ride) as i from r1),
 stops as (select day as service_day, case when i = 1 then label else label || ' #' || i end as trip_id, r2.kind as operator, r2.number as train_number, category, coalesce(r2.ln, label) as line, eva::bigint as station, pos as stop_seq, case when on_a then sa end as sched_arr, case when go then sd end as sched_dep,
  case when on_a then ca end as act_arr, case when go then cd end as act_dep, on_a and ca is not null as arr_measured, go and cd is not null as dep_measured from (select ride, pos, eva, sa, ca, sd, cd, on_a, go from c) join r2 using (ride))"""
_SEEN = "case part % {m} when 0 then 'N' when 1 then 'S' when 2 then 'n.d.' else case when supp % 10 = 4 then '0' else (part % {a} - 5)::varchar end end"
_IT = f"""with {_LINES}, calls as (select day, sid as tidx, k as seq, 'S' || supp as name, supp, case when k > 1 then s end as s_arr, case when k < n then s + 60 end as s_dep, {_SEEN.format(m=13, a=40)} as ra, {_SEEN.format(m=17, a=30)} as rp from lines),
 zero as (select name from (select name, unnest([ra, rp]) as d from calls) where regexp_full_match(d, '-?[0-9]+') group by 1 having count(*) >= 20 and count(*) filter (d = '0') >= 0.99 * count(*)),
 t0 as (select sid as tidx, day, (cust % 200)::varchar as src, (cust % 50)::varchar as number, case cust % 4 when 0 then '' when 1 then 'ES*' when 2 then 'REG' end as c, case when sid % 3 = 0 then 'FR' end as sub, cust % 9 = 0 as off, sid % 4 as slot, case when sid % 5 = 0 then '/12/13' else '' end as cn, max(n) as n from lines group by all),
 t1 as (select *, case when coalesce(c, '') in ('', 'ES*') and sub is not null then sub when coalesce(c, '') = '' then 'NC' else c end as category from t0 qualify row_number() over (partition by day, src order by n desc, tidx) = 1),
 t2 as (select * from t1 a where not (off and exists (select 1 from t1 b where b.day = a.day and b.number = a.number and b.slot = a.slot and not b.off))),
 t as (select *, category || ' ' || number as label, row_number() over (partition by day, category, number order by slot, tidx) as i from t2)"""

SQL = {
    "flt01_ist_rows": _IST + " select * from i",
    "flt02_ist_counts": _IST + " select service_day, category, dep_measured, count(*) as n, sum(act_dep - sched_dep)::bigint as late from i group by 1, 2, 3",
    "stg01_fi_stops": f"""with {_LINES}, e as (select *, case status when 'F' then 'IC' else 'S' end as kind from lines where status in ('F', 'O') and cust % 11 <> 0 and sid % 17 <> 0 and n > 1),
 f as (select *, k > 1 and not (rf = 'R' and k % 3 = 0) as on_a, k < n and not (rf = 'R' and k % 3 = 1) as on_d from e)
 select day as service_day, kind || ' ' || sid as trip_id, 'vr' as operator, sid::varchar as train_number, kind as category, case when cust % 3 = 0 then 'Z' else kind || ' ' || sid end as line, case when supp % 5 = 0 then 1905 * 1000000 + supp else supp end::bigint as station, k - 1 as stop_seq,
 case when on_a then s end as sched_arr, case when on_d then s + 60 end as sched_dep, case when on_a and qty >= 10 then s + part % 300 end as act_arr, case when on_d and qty >= 10 then s + 60 + part % 240 end as act_dep, on_a and qty >= 10 as arr_measured, on_d and qty >= 10 as dep_measured from f where qty >= 3 and (on_a or on_d)""",
    "stg02_nl_stops": f"""with {_LINES}, x as (select sid, day, case status when 'F' then 'IC' else 'SPR' end as category, (sid % 97)::varchar as number, cust % 11 = 0 as off, k, supp, case when k > 1 then s end as sa, case when qty >= 10 then part % 7 end as da, rf = 'R' as no_a, case when k < n then s + 60 end as sd, case when qty >= 5 then part % 5 end as dd, rf = 'A' and ls = 'O' as no_d from lines where status <> 'P'),
 tm as (select * from x where sa is not null or sd is not null), bad as (select sid from (select sid, supp, coalesce(sa, sd) < lag(coalesce(sd, sa)) over (partition by sid order by k) as b from tm) group by 1 having bool_or(coalesce(b, false)) or count(*) > count(distinct supp)),
 sig as (select distinct day, supp, coalesce(sd, sa) as t, sid from tm), big as (select sid, count(*) as n from sig group by 1), meet as (select p.sid as a, q.sid as b, count(*) as m from sig p join sig q using (day, supp, t) where p.sid <> q.sid group by 1, 2),
 again as (select a from meet join big u on u.sid = a join big v on v.sid = b where m = u.n and (v.n > u.n or (v.n = u.n and b < a))),
 live as (select *, sa is not null and not no_a as on_a, sd is not null and not no_d as on_d from x where not off and sid not in (select sid from bad) and sid not in (select a from again)),
 r as (select sid, category || ' ' || number as label, row_number() over (partition by day, category || ' ' || number order by sid) as i from (select distinct sid, day, category, number from live))
 select day as service_day, case when i = 1 then label else label || ' #' || i end as trip_id, 'NS' as operator, number as train_number, category, label as line, (case when supp % 9 <> 0 then supp else -1 end)::bigint as station, row_number() over (partition by sid order by k) as stop_seq, case when on_a then sa end as sched_arr, case when on_d then sd end as sched_dep,
 case when on_a then sa + 60 * da end as act_arr, case when on_d then sd + 60 * dd end as act_dep, on_a and da is not null as arr_measured, on_d and dd is not null as dep_measured from live join r using (sid) where on_a or on_d""",
    "stg03_be_stops": f"""with {_LINES}, x as (select day, sid, cust, supp, case when k > 1 then s end as sa, case when k < n then s + 60 end as sd, case when k > 1 and qty >= 10 then s + part % 300 end as aa, case when k < n and qty >= 5 then s + 60 + part % 240 end as ad, ['IC 03', 'L B1-1', 'EURST 9', null][(cust % 4 + 1)::int] as rel from lines where part % 10 > 1 and (supp % 9 = 0 or supp % 7 <> 0)),
 y as (select *, row_number() over (partition by sid order by coalesce(sd, sa) nulls last, coalesce(sa, sd) nulls last, coalesce(aa, ad) nulls last, supp) as seq from x),
 bad as (select sid from (select sid, supp, sa < lag(coalesce(sd, sa)) over (partition by sid order by seq) as b from y) group by 1 having bool_or(coalesce(b, false)) or count(*) > count(distinct supp)),
 z as (select *, case cust % 4 when 0 then 'IC' when 1 then 'S' when 2 then 'EST' else 'TRAIN' end as category from y where sid not in (select sid from bad))
 select day as service_day, category || ' ' || sid as trip_id, 'SNCB' as operator, sid::varchar as train_number, category, rel as line, supp::bigint as station, seq as stop_seq, sa as sched_arr, sd as sched_dep, aa as act_arr, ad as act_dep, sa is not null and aa is not null as arr_measured, sd is not null and ad is not null as dep_measured from z""",
    "stg04_de_stops": _DE + " select * from stops",
    "wn19_open_ends": _DE + " select service_day, count(*) filter (sched_dep is null and act_dep is null and stop_seq < top) as open, count(*) as stops from (select *, max(stop_seq) over (partition by service_day, trip_id) as top from stops) group by 1",
    "jn05_service_days": """with c as (select c_custkey as id, date '1996-01-01' + (c_custkey * 7 % 300)::int as a, date '1996-02-01' + (c_custkey * 11 % 400)::int as b from customer), d as (select unnest(generate_series(date '1996-06-01', date '1996-12-31', interval 1 day))::date as day),
 x as (select o_custkey as id, o_orderdate::date as day, o_orderstatus = 'F' as off from orders where o_orderdate >= date '1996-06-01' and o_orderdate < date '1997-01-01')
 select id as service_id, day from (select id, day from c, d where day between a and b and (id >> (isodow(day) - 1)::int) % 2 = 1 except select id, day from x where off union select id, day from x where not off)""",
    "stg07_at_stops": f"""with {_RUNS}, q as (select rid, min(key) as num, min(t_a) as t_a, min(a_a) as a_a, min(t_b) as t_b, min(a_b) as a_b from r group by 1), p as (select rid, min(service_day) as service_day from at_runs group by 1),
 t as (select trip_id, service_day, ltrim(regexp_extract(min(num), '([0-9]+)[^0-9]*$', 1), '0') as num, min(label) as label, min(agency_name) as operator, min(t_first) as t0, (length(trip_id) % 3 + 1) * 300 as step from at_trips group by trip_id, service_day),
 cand as (select rid, trip_id, t.service_day, least(t0 + 3 * step, coalesce(t_b, t_a)) - greatest(t0 + 20, coalesce(t_a, t_b)) as o from q join p using (rid) join t on t.num = q.num and t.service_day = p.service_day where coalesce(t_a, t_b) is not null),
 best as (select rid, trip_id, service_day from (select *, row_number() over (partition by rid order by o desc, service_day, trip_id) as i, row_number() over (partition by service_day, trip_id order by o desc, rid) as j from cand where o >= -900) where i = 1 and j = 1),
 obs as (select trip_id, best.service_day, t_a, t_b, {'case when a_a - t_a between -1200 and 43200 then a_a - t_a end'} as da, case when a_b - t_b between -1200 and 43200 then a_b - t_b end as db from best join q using (rid)),
 one as (select t.*, t_a, t_b, coalesce(da, db) as x, coalesce(db, da) as y, row_number() over (partition by t.service_day, label order by t0, trip_id) as i from t join obs using (trip_id, service_day) where da is not null or db is not null),
 st as (select *, row_number() over w as pos, count(*) over (partition by service_day, trip_id) as n, t0 + step * (seq - 1) as sa, t0 + step * (seq - 1) + case when seq < 4 then 20 else 0 end as sd from one, (select unnest([1, 2, 3, 4]) as seq) where not (seq = 2 and length(trip_id) % 2 = 0) window w as (partition by service_day, trip_id order by seq)),
 d as (select *, sa + {'case when sa <= t_a or t_a = t_b then x when sa >= t_b then y else round(x + (y - x) * (sa - t_a) / (t_b - t_a)::double) end'} as la, sd + case when sd <= t_a or t_a = t_b then x when sd >= t_b then y else round(x + (y - x) * (sd - t_a) / (t_b - t_a)::double) end as ld, (length(trip_id) * 7 + seq * 11) % 40 as place from st)
 select service_day, case when i = 1 then label else label || ' #' || i end as trip_id, operator, num as train_number, coalesce(nullif(regexp_extract(label, '^([A-Za-z]+)', 1), ''), 'OTHER') as category, label as line, (case when place < 30 then 4400000 + place else -1 end)::bigint as station, pos as stop_seq,
 case when pos > 1 then sa end::bigint as sched_arr, case when pos < n then sd end::bigint as sched_dep, case when pos > 1 then la end::bigint as act_arr, case when pos < n then greatest(ld, case when pos > 1 then la end) end::bigint as act_dep, pos > 1 as arr_measured, pos < n as dep_measured from d""",
    "stg10_zero_stations": _IT + " select name from zero",
    "stg09_it_stops": _IT
    + f""", s as (select calls.*, case when ra not in ('N', 'S') then s_arr end as sa, case when rp not in ('N', 'S') then s_dep end as sd, case when name not in (select name from zero) and try_cast(ra as int) between -30 and 720 then try_cast(ra as int) end as da, case when name not in (select name from zero) and try_cast(rp as int) between -30 and 720 then try_cast(rp as int) end as dd from calls where supp % 10 = 3 or supp % 9 <> 0),
 j as (select s.*, label, i, number, category, cn, sa + 60 * coalesce(da, 0) as aa, sd + 60 * coalesce(dd, 0) as ad, sa is not null and da is not null as ma, sd is not null and dd is not null as md from s join t using (day, tidx) where not off),
 z as (select *, coalesce(ma and lag(md) over w and aa <= lag(ad) over w, false) as wrong from j window w as (partition by day, tidx order by seq))
 select day as service_day, case when i = 1 then label else label || ' #' || i end as trip_id, null::varchar as operator, number as train_number, category, label || cn as line, (case when supp % 10 = 3 then -1 else supp end)::bigint as station, seq as stop_seq, sa as sched_arr, sd as sched_dep, aa as act_arr, ad as act_dep, ma and not wrong as arr_measured, md as dep_measured from z""",
    "ag17_it_days": _IT + " select day as service_day, count(*) as trains, count(*) filter (off) as cancelled from t group by 1",
}
