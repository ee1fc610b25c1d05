"""Stop events, stations and legs out of the test tables, each as a DataFrame and as the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legflow.tables import table

# Fixed values of these feeds: the five kinds of events as stations.
KINDS = ("click", "error", "purchase", "signup", "view")


def event_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stops: a user's day is a run, the kind of event a station; late values have no departure."""
    e = table(spark, sf_dir, "events")
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type"))
    return e.select(
        F.to_date("ts").alias("service_day"), F.col("user_id").cast("string").alias("trip_id"), kind.cast("bigint").alias("station"), F.col("event_id").alias("seq"),
        F.when(F.col("value") >= 1, s).alias("sched_arr"), F.when(F.col("value") < 150, s).alias("sched_dep"),
        (s + F.pmod(F.col("event_id") * 37, F.lit(900)) - 120).alias("act_arr"), (s + F.pmod(F.col("event_id") * 53, F.lit(1200)) - 60).alias("act_dep"),
        (F.col("value") >= 10).alias("arr_measured"), (F.col("value") >= 5).alias("dep_measured"), F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("line"),
    )


EVENT_STOPS = f"""stops as (select ts::date as service_day, user_id::varchar as trip_id, list_position({list(KINDS)!r}, event_type)::bigint as station, event_id as seq,
 case when value >= 1 then s end as sched_arr, case when value < 150 then s end as sched_dep, s + (event_id * 37) % 900 - 120 as act_arr, s + (event_id * 53) % 1200 - 60 as act_dep,
 value >= 10 as arr_measured, value >= 5 as dep_measured, event_type as category, user_id::varchar as line from (select *, epoch(date_trunc('second', ts))::bigint as s from events))"""


def order_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as stops in sequence; returned lines have no departure at all."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    s = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + 600 * F.col("l_linenumber") + F.pmod("l_partkey", F.lit(1200))
    late = F.pmod(F.col("l_partkey") * 7, F.lit(600)) - 120
    gone = F.col("l_returnflag") == "R"
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.to_date("o_orderdate").alias("service_day"), F.col("l_orderkey").cast("string").alias("trip_id"), (F.col("l_suppkey") + 10).alias("station"), F.col("l_linenumber").cast("bigint").alias("stop_seq"), "l_partkey", "l_suppkey", "l_extendedprice",
        s.alias("sched_arr"), F.when(~gone, s + 60).alias("sched_dep"), (s + late).alias("act_arr"), F.when(~gone, s + 60 + late).alias("act_dep"),
        (F.col("l_quantity") >= 10).alias("arr_measured"), ((F.col("l_quantity") >= 10) & ~gone).alias("dep_measured"), F.col("o_orderpriority").alias("category"), F.col("l_linestatus").alias("line"),
    )


ORDER_STOPS = """stops as (select o_orderdate::date as service_day, l_orderkey::varchar as trip_id, l_suppkey + 10 as station, l_linenumber::bigint as stop_seq, l_partkey, l_suppkey, l_extendedprice,
 s as sched_arr, case when not gone then s + 60 end as sched_dep, s + late as act_arr, case when not gone then s + 60 + late end as act_dep, q as arr_measured, q and not gone as dep_measured, o_orderpriority as category, l_linestatus as line
 from (select *, epoch(o_orderdate)::bigint + 600 * l_linenumber + l_partkey % 1200 as s, (l_partkey * 7) % 600 - 120 as late, l_returnflag = 'R' as gone, l_quantity >= 10 as q from lineitem join orders on l_orderkey = o_orderkey))"""


def supplier_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and four fixed places as stations with coordinates, country and validity."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey")
    d = s.filter(F.col("s_acctbal") >= 0).select((k + 10).alias("station"), (5.9 + F.pmod(k * 37, F.lit(460)) / 100).alias("lon"), (45.8 + F.pmod(k * 53, F.lit(215)) / 100).alias("lat"), F.when(F.col("r_name") != "EUROPE", F.col("r_name")).alias("country"))
    fixed = spark.createDataFrame([(1, 8.0, 47.0, "A"), (2, 8.5, 47.2, "A"), (3, 7.4, 46.9, "B"), (4, 11.5, 47.0, None)], "station bigint, lon double, lat double, country string")
    return d.unionByName(fixed).select("*", F.lit("1900-01-01").cast("date").alias("valid_from"), F.lit("9999-12-31").cast("date").alias("valid_to"))


STATIONS = """dim as (select s_suppkey + 10 as station, 5.9::double + ((s_suppkey * 37) % 460) / 100::double as lon, 45.8::double + ((s_suppkey * 53) % 215) / 100::double as lat, case when r_name <> 'EUROPE' then r_name end as country
 from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where s_acctbal >= 0
 union all values (1, 8.0, 47.0, 'A'), (2, 8.5, 47.2, 'A'), (3, 7.4, 46.9, 'B'), (4, 11.5, 47.0, null))"""


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs, repeated rows once."""
    return table(spark, sf_dir, "fct_legs").distinct()


LEGS = "legs as (select distinct * from fct_legs)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations legs name: those of dim_ch and the interchanges, once per key."""
    cols = ["bpuic", "name", "lon", "lat", "valid_from", "valid_to"]
    return table(spark, sf_dir, "dim_ch").select(cols).unionByName(table(spark, sf_dir, "hub_stations").select(cols)).distinct()


PLACES = "places as (select bpuic, name, lon, lat, valid_from, valid_to from dim_ch union select bpuic, name, lon, lat, valid_from, valid_to from hub_stations)"
