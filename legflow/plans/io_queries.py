"""Readers and writers by round trip: a table is written in a source's format to the shared folder and read from there; the
SQL says what must come out, from the table itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legflow.operators import geometry as G
from legflow.operators import legs as L
from legflow.operators import publish as P
from legflow.plans import feeds as D
from legflow.plans.board_queries import BOX, SQL as _BOARD_SQL, _LINKED, _links, _routes
from legflow.plans.leg_queries import SQL as _LEG_SQL
from legflow.runtime import scratch
from legflow.sources import files
from legflow.tables import table

AS_IS = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}  # a CSV writer takes blanks off otherwise
TRIP = ("trip_id", "service_day", "num", "label")


def _listed(spark: SparkSession, folder: str) -> list[str]:
    """The data files under a folder."""
    P_ = spark._jvm.org.apache.hadoop.fs.Path
    p = P_(folder)
    it = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    out = []
    while it.hasNext():
        f = it.next().getPath()
        if f.getName().startswith("part-"):
            out.append(f.toString())
    return sorted(out)


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "at_trips").select(*[F.col(c).cast("string").alias(c) for c in TRIP]).distinct()


def src01_csv_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exports of the trips by halves: other order of columns, another column; the lacking one is null."""
    t, at = _trips(spark, sf_dir), scratch(spark, "csv")
    first = F.col("trip_id") < "08"
    t.filter(first).coalesce(2).write.options(**AS_IS).option("sep", ";").csv(f"{at}/a")
    t.filter(~first).select("label", F.lit("x").alias("extra"), "trip_id", "service_day").coalesce(2).write.options(**AS_IS).option("sep", ";").csv(f"{at}/b")
    return files.csv_by_name(spark, _listed(spark, at), TRIP, sep=";").drop("_file").distinct()


def src02_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in two encodings, each file read in its own."""
    s, at = table(spark, sf_dir, "dim_ch").select("bpuic", "name").filter("name IS NOT NULL AND name RLIKE '^[ -~äöüÄÖÜéèêàâïîôçëûùÉÈñÑåÅ]+$'").distinct(), scratch(spark, "enc")
    for e, part in (("UTF-8", F.col("bpuic") % 2 == 0), ("ISO-8859-1", F.col("bpuic") % 2 == 1)):
        s.filter(part).coalesce(1).write.options(**AS_IS).option("encoding", e).csv(f"{at}/{e}")
    return files.csv_by_name(spark, _listed(spark, at), ("bpuic", "name")).drop("_file").distinct()


def src03_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop listings as compressed files with the day in their folder's name, as a glob."""
    at = scratch(spark, "snaps")
    x = table(spark, sf_dir, "raw_stops").filter("stop_id RLIKE '^[0-9]+$'").select("snap", "stop_id", F.trim("stop_lat").alias("stop_lat")).filter("stop_lat RLIKE '^[0-9.]+$'").distinct()
    x.withColumn("day", F.col("snap")).repartition("day").write.partitionBy("day").options(**AS_IS).option("compression", "gzip").csv(f"{at}/d")
    P_ = spark._jvm.org.apache.hadoop.fs.Path
    fs = P_(at).getFileSystem(spark._jsc.hadoopConfiguration())
    for i, f in enumerate(_listed(spark, at)):  # the day goes into the file's name
        day = f.split("day=")[1][:10]
        fs.rename(P_(f), P_(f"{at}/stops-{day}.{i}.csv.gz"))
    return files.snapshots(spark, f"{at}/stops-*.csv.gz", ("stop_id", "stop_lat")).distinct()


def src04_gtfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trips.txt.gz of a timetable export."""
    at = scratch(spark, "gtfs")
    _trips(spark, sf_dir).coalesce(1).write.options(**AS_IS).option("compression", "gzip").csv(f"{at}/w")
    P_ = spark._jvm.org.apache.hadoop.fs.Path
    P_(at).getFileSystem(spark._jsc.hadoopConfiguration()).rename(P_(_listed(spark, at)[0]), P_(f"{at}/trips.txt.gz"))
    return files.gtfs(spark, at, "trips", ("trip_id", "label", "num")).drop("_file")


def src05_json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a day as one array of objects with their lines, a file a day."""
    at = scratch(spark, "json")
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    o.groupBy((F.col("l_orderkey") % 4).alias("p")).agg(F.to_json(F.collect_list(F.struct("l_orderkey", "lines"))).alias("value")).repartition(4, "p").write.partitionBy("p").text(f"{at}/d")
    x = files.json_arrays(spark, _listed(spark, at), "l_orderkey bigint, lines array<struct<l_linenumber: bigint, l_partkey: bigint>>")
    return x.select("l_orderkey", F.inline("lines"))


def src08_month_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order files by month; the ninth to the thirtieth of June 1996 need July's too."""
    at = scratch(spark, "months")
    o = table(spark, sf_dir, "orders").filter("o_orderdate >= timestamp'1996-05-01' AND o_orderdate < timestamp'1996-08-01'").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    for m in ("1996-05", "1996-06", "1996-07"):
        o.filter(F.date_format("day", "yyyy-MM") == m).write.parquet(f"{at}/{m}.parquet")
    return files.month_files(spark, at, "1996-06-09", "1996-06-30").groupBy("day").agg(F.count(F.lit(1)).alias("n"))


def src10_extracted_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedule rows kept by day, in two goes: days that are there are not written twice."""
    at = scratch(spark, "extract")
    s = table(spark, sf_dir, "gb_sched").select("rid", "tpl", F.to_date("ssd").alias("day")).distinct()
    files.extracted_days(s.filter("dayofmonth(day) <= 10"), "day", at)
    return files.extracted_days(s, "day", at).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


def src11_italian_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of trains with calls, a file a month that stands for a day; the calls that come out."""
    at = scratch(spark, "it")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.trunc("o_orderdate", "month").alias("day"))
    l = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    call = F.struct(F.concat(F.lit("S"), "l_suppkey").alias("n"), F.when(F.col("l_returnflag") == "R", "S").otherwise((F.col("l_partkey") % 9).cast("string")).alias("ra"), F.lit("n.d.").alias("rp"), (F.col("l_linenumber") * 60).cast("string").alias("oa"))
    t = l.groupBy("day", "o_orderkey").agg(F.array_sort(F.collect_list(call)).alias("fr")).select("day", F.struct(F.col("o_orderkey").cast("string").alias("_id"), F.lit("7").alias("n"), F.lit("0").alias("rp"), F.lit("0").alias("ra"), "fr").alias("t"))
    d = t.groupBy("day").agg(F.collect_list("t").alias("treni")).select(F.to_json(F.struct(F.col("day").cast("string").alias("giorno"), "treni")).alias("value"), "day")
    d.repartition("day").write.partitionBy("day").text(f"{at}/d")
    trains, calls = files.italian_day(spark, _listed(spark, at))
    return calls.join(trains.select("service_day", "tidx", "source_id", "n_stops"), ["service_day", "tidx"]).select("service_day", F.col("source_id").cast("bigint").alias("o_orderkey"), F.col("n_stops").cast("bigint").alias("n_stops"), "name", "ra", "rp", "s_arr")


def src12_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route pairs as a JSON dictionary, written and read."""
    at = scratch(spark, "dict")
    r = D.legs(spark, sf_dir).groupBy("route_id").agg(F.min(F.struct("from_bpuic", "to_bpuic")).alias("e")).select("route_id", "e.*")
    P.write_dictionary(r, "route_id", ["from_bpuic", "to_bpuic"], f"{at}/route_pairs.json")
    d = files.dictionary(spark, f"{at}/route_pairs.json", "route_id", "pair").withColumn("p", F.from_json("pair", "array<bigint>"))
    return d.select(F.col("route_id").cast("bigint").alias("route_id"), F.col("p")[0].alias("from_bpuic"), F.col("p")[1].alias("to_bpuic"))


def src15_latest_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "raw_stops").select(F.concat(F.lit("x/stops_"), F.date_format("snap", "yyyy_MM_dd"), F.lit("-"), F.col("location_type"), F.lit(".zip")).alias("url"), F.col("loaded_at").alias("published")).filter("url IS NOT NULL")
    return files.latest_per_day(t)


def src19_route_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes written as a binary pack and read back as grid points."""
    at = scratch(spark, "pack")
    P.write_pack(_routes(spark, sf_dir).withColumn("flag", F.lit(0)), BOX, f"{at}/routes.brts")
    x = G.read_packs(spark.read.format("binaryFile").load(f"{at}/routes.brts"))
    return x.select("route_id", F.posexplode("grid").alias("i", "p")).select("route_id", F.col("i").cast("bigint").alias("i"), F.col("p.x").cast("bigint").alias("x"), F.col("p.y").cast("bigint").alias("y"))


def snk01_day_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day files written twice, the second time one month only, and read back."""
    at = scratch(spark, "days")
    w = L.wire(D.legs(spark, sf_dir))
    L.write_days(w, f"{at}/a")
    L.write_days(spark.read.parquet(f"{at}/a").filter("month(dep_day) = 1").select(*w.columns), f"{at}/b")
    return spark.read.parquet(f"{at}/a").withColumn("dep_day", F.col("dep_day").cast("date")).select(*w.columns)


def snk02_journey_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "journeys")
    P.write_journeys(D.legs(spark, sf_dir), at)
    x = spark.read.parquet(at)
    return x.select(F.col("dep_day").cast("date").alias("dep_day"), "service_day", "trip_id", "line", "journey_id")


def snk05_stations_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "stations")
    P.write_stations(table(spark, sf_dir, "dim_at"), f"{at}/stations.json")
    x = spark.read.option("multiLine", True).schema("id bigint, name string, lon double, lat double").json(f"{at}/stations.json")
    return x.select(F.col("id").alias("bpuic"), "name", "lon", "lat").distinct()


def snk09_link_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "links")
    l = _links(spark, sf_dir)
    P.write_links(l, at)
    return spark.read.schema(l.schema).json(at).groupBy("day", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("to_journey").alias("to"))


def leg05_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of facts written, then half of them again with other delays: the others stay."""
    at = scratch(spark, "facts")
    x = D.legs(spark, sf_dir).select("leg_id", F.col("delay").cast("bigint").alias("delay"), L.departure_day().alias("dep_day"))
    P.replaced(x, at, "dep_day")
    P.replaced(spark.read.schema(x.schema).parquet(at).filter("dayofmonth(dep_day) % 2 = 0").withColumn("delay", F.col("delay") + 1).select(*x.columns), at, "dep_day")
    return spark.read.schema(x.schema).parquet(at).groupBy("dep_day").agg(F.count(F.lit(1)).alias("n"), F.sum("delay").alias("delay"))


def snk07_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a dataset and the catalog that names it, as rows."""
    from legflow.operators.quality import filled_days

    d = filled_days(D.legs(spark, sf_dir)).filter("legs > 0").select("dep_day", "legs")
    m = P.dataset_manifest("ch", d, ("2017-12-20", "2018-12-31"))
    c = P.catalog({"ch": m}, {"datasets": {"de": {"path": "de"}}})
    rows = [("days", len(m["days"])), ("legs", sum(v["legs"] for v in m["days"].values())), ("missing", len(m["missing_days"])), ("datasets", len(c["datasets"]))]
    return spark.createDataFrame(rows, "what string, n bigint")


QUERIES = {f.__name__: f for f in (src01_csv_by_name, src02_encodings, src03_snapshots, src04_gtfs, src05_json_arrays, src08_month_files, src10_extracted_days, src11_italian_day, src12_dictionary, src15_latest_listing, src19_route_packs, snk01_day_files, snk02_journey_files, snk05_stations_json, snk09_link_files, leg05_replaced, snk07_manifest)}

_D = "(date '1970-01-01' + (t_dep // 86400)::int)::date"
SQL = {
    "src01_csv_by_name": "select distinct trip_id, service_day::varchar as service_day, case when trip_id < '08' then num end as num, label from at_trips",
    "src02_encodings": "select distinct bpuic::varchar as bpuic, name from dim_ch where regexp_full_match(name, '[ -~äöüÄÖÜéèêàâïîôçëûùÉÈñÑåÅ]+')",
    "src03_snapshots": "select distinct stop_id, trim(stop_lat) as stop_lat, snap from raw_stops where regexp_full_match(stop_id, '[0-9]+') and regexp_full_match(trim(stop_lat), '[0-9.]+')",
    "src04_gtfs": "select trip_id, label, num from (select distinct trip_id, service_day, num, label from at_trips)",
    "src05_json_arrays": "select l_orderkey::bigint as l_orderkey, l_linenumber::bigint as l_linenumber, l_partkey::bigint as l_partkey from lineitem",
    "src08_month_files": "select o_orderdate::date as day, count(*) as n from orders where o_orderdate >= date '1996-06-01' and o_orderdate < date '1996-08-01' group by 1",
    "src10_extracted_days": "select day, count(*) as n from (select distinct rid, tpl, ssd::date as day from gb_sched) group by 1",
    "src11_italian_day": "select date_trunc('month', o_orderdate)::date as service_day, l_orderkey::bigint as o_orderkey, count(*) over (partition by l_orderkey) as n_stops, 'S' || l_suppkey as name, case when l_returnflag = 'R' then 'S' else (l_partkey % 9)::varchar end as ra, 'n.d.' as rp, l_linenumber::bigint * 60 as s_arr from lineitem join orders on l_orderkey = o_orderkey",
    "src12_dictionary": f"with {D.LEGS} select route_id::bigint as route_id, e.f as from_bpuic, e.t as to_bpuic from (select route_id, min({{'f': from_bpuic, 't': to_bpuic}}) as e from legs group by 1)",
    "src15_latest_listing": "select snap as day, max({'p': loaded_at, 'u': 'x/stops_' || strftime(snap, '%Y_%m_%d') || '-' || location_type || '.zip'}).u as url from raw_stops where location_type is not null group by 1",
    "src19_route_packs": _BOARD_SQL["geo08_quantized"],
    "snk01_day_files": _LEG_SQL["snk01_wire_days"],
    "snk02_journey_files": _LEG_SQL["leg07_journeys"],
    "snk05_stations_json": "select distinct bpuic, name, lon, lat from dim_at where valid_to = date '9999-12-31'",
    "snk09_link_files": f"with {D.LEGS}, {_LINKED} select day, kind, count(*) as n, sum(to_journey)::bigint as \"to\" from links group by 1, 2",
    "leg05_replaced": f"with {D.LEGS} select {_D} as dep_day, count(*) as n, (sum(delay) + case when day({_D}) % 2 = 0 then count(*) else 0 end)::bigint as delay from legs group by 1",
    "snk07_manifest": f"with {D.LEGS}, d as (select {_D} as day, count(*) as n from legs group by 1) select 'days' as what, count(*) as n from d union all select 'legs', sum(n)::bigint from d union all select 'missing', date_diff('day', date '2017-12-20', date '2018-12-31') + 1 - count(*) from d union all select 'datasets', 2",
}
