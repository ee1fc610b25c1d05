"""The joins, aggregates, windows, filters and set operations the pipeline consists of, each over its whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legflow.operators import legs as L
from legflow.operators import quality as Q
from legflow.operators import staging as S
from legflow.operators.changes import instant_ns
from legflow.operators.spatial import great_circle_m
from legflow.plans import feeds as D
from legflow.tables import table


def flt02_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.legs(spark, sf_dir).agg(F.count(F.lit(1)).alias("legs"), F.count_if(F.col("flags").bitwiseAND(1) == 0).alias("measured"), F.count_if(F.col("line").isNull()).alias("no_line"))


def flt04_side_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with a live side only, road kinds left out by pattern, the cancelled ones' times dropped."""
    s = table(spark, sf_dir, "gb_sched").distinct()
    live = lambda c: F.when(F.col("can") != "True", F.col(c))
    x = s.filter(~F.lower("train_cat").rlike("bus|bs|br")).select("rid", "ts", "idx", live("wta").alias("wta"), live("wtd").alias("wtd"))
    return x.filter("wta IS NOT NULL OR wtd IS NOT NULL").groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.count("wta").alias("arr"), F.count("wtd").alias("dep"))


def flt10_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations in a box and not abroad; an unknown country is not clipped."""
    d = table(spark, sf_dir, "dim_de").unionByName(table(spark, sf_dir, "dim_at")).distinct()
    return d.filter(F.col("lon").between(5.9, 10.5) & F.col("lat").between(45.8, 47.9) & (F.col("country").isNull() | F.col("country").isin("CH", "DE"))).select("bpuic", "name", "country")


def flt11_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.legs(spark, sf_dir).filter(F.col("t_dep").between(1_515_571_200, 1_515_657_599)).select("leg_id", "t_dep")


def jn01_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs with the version of their stations on their service day."""
    p = D.places(spark, sf_dir)
    side = lambda x: p.select(*[F.col(c).alias(f"{x}_{c}") for c in p.columns])
    on = lambda x: (F.col(f"{x}_bpuic") == F.col("from_bpuic" if x == "f" else "to_bpuic")) & F.col("service_day").between(F.col(f"{x}_valid_from"), F.col(f"{x}_valid_to"))
    j = D.legs(spark, sf_dir).join(side("f"), on("f"), "left").join(side("t"), on("t"), "left")
    return j.groupBy("from_bpuic", "to_bpuic").agg(F.count(F.lit(1)).alias("n"), F.min("f_name").alias("f_name"), F.min("t_name").alias("t_name"), F.count_if(F.col("f_bpuic").isNull() | F.col("t_bpuic").isNull()).alias("unmatched"))


def jn02_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "train_types").select(F.col("type_id").alias("t"), "category")
    return D.legs(spark, sf_dir).join(F.broadcast(t), F.col("type_id") == F.col("t"), "left").groupBy("type_id", "category").agg(F.count(F.lit(1)).alias("n")).select(F.col("type_id").cast("bigint").alias("type_id"), "category", "n")


def jn05_active_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips a number runs: every day from its first to its last, less those without, by spine and anti join."""
    t = table(spark, sf_dir, "at_trips").distinct()
    span = t.groupBy("num").agg(F.min("service_day").alias("a"), F.max("service_day").alias("b")).select("num", F.explode(F.sequence("a", "b")).alias("service_day"))
    return span.join(t.select("num", "service_day").distinct(), ["num", "service_day"], "left_anti")


def jn08_double_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services of one train number and day that run under two rids."""
    s = table(spark, sf_dir, "gb_sched").select("ssd", "train_id", "rid").filter("train_id IS NOT NULL").distinct()
    o = s.select("ssd", "train_id", F.col("rid").alias("other"))
    return s.join(o, ["ssd", "train_id"]).filter("rid < other").select("ssd", "train_id", "rid", "other")


def jn09_latest_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of each customer's last day of orders: the greatest date joins back, ties and all."""
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    last = o.groupBy("o_custkey").agg(F.max("d").alias("d"))
    return o.join(last, ["o_custkey", "d"]).select("o_custkey", "o_orderkey", "d")


def jn10_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["rid", "tpl", "wta", "wtd", "wtp"]
    s = table(spark, sf_dir, "gb_sched").select(*key).distinct()
    a = table(spark, sf_dir, "gb_act").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(*[F.col(k).alias(f"a_{k}") for k in key], "n")
    j = s.join(a, reduce(lambda x, y: x & y, (s[k].eqNullSafe(a[f"a_{k}"]) for k in key)), "left")
    return j.groupBy("rid").agg(F.count(F.lit(1)).alias("calls"), F.count("n").alias("seen"), F.sum(F.coalesce("n", F.lit(0))).alias("messages"))


def jn11_nearest_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest interchange of every station; there are five, fixed, so they go to each row."""
    h = table(spark, sf_dir, "hub_stations").select(F.col("bpuic").alias("hub"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    p = table(spark, sf_dir, "dim_ch").filter("lon IS NOT NULL AND lat IS NOT NULL").select("bpuic", "lon", "lat").distinct()
    hubs = h.agg(F.collect_list(F.struct("hub", "x", "y")).alias("h"))
    d = lambda v: (v["x"] - F.col("lon")) * (v["x"] - F.col("lon")) + (v["y"] - F.col("lat")) * (v["y"] - F.col("lat"))
    near = F.array_min(F.transform("h", lambda v: F.struct(d(v).alias("d"), v["hub"].alias("hub"))))
    return p.crossJoin(F.broadcast(hubs)).select("bpuic", "lon", "lat", near["hub"].alias("hub"))


def jn12_unknown_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "gb_sched").select("tpl").distinct()
    a = table(spark, sf_dir, "gb_act").filter("at_dep IS NOT NULL").select("tpl").distinct()
    return s.join(a, "tpl", "left_anti")


def jn13_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    hubs = table(spark, sf_dir, "hub_stations").select("bpuic")
    x = D.legs(spark, sf_dir).join(F.broadcast(hubs), F.col("from_bpuic") == F.col("bpuic"), "left_semi")
    return x.groupBy("from_bpuic").agg(F.count(F.lit(1)).alias("n"))


def jn14_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "gb_sched").groupBy("rid").agg(F.bool_or(F.col("can") == "True").alias("part_cancelled"), F.bool_and(F.col("can") == "True").alias("cancelled"))
    return s


def jn15_split_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of a trip id joined another way."""
    t = D.legs(spark, sf_dir).select("trip_id").distinct()
    f = F.split("trip_id", ":")
    return t.select("trip_id", F.array_join(F.filter(f, lambda v: v != ""), "/").alias("path"), F.try_element_at(f, F.lit(-2)).alias("kind"))


def jn20_same_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    num = lambda c: F.ltrim(F.regexp_extract(c, r"([0-9]+)[^0-9]*$", 1), F.lit("0"))
    a = table(spark, sf_dir, "at_runs").distinct().groupBy("service_day", num("num").alias("n")).agg(F.count(F.lit(1)).alias("runs"))
    b = table(spark, sf_dir, "at_trips").distinct().groupBy("service_day", num("num").alias("n")).agg(F.count(F.lit(1)).alias("trips"))
    return a.join(b, ["service_day", "n"])


def jn21_overlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of datasets whose boxes overlap: three rows on either side."""
    box = lambda t: table(spark, sf_dir, t).filter("lon <> 0 OR lat <> 0").agg(F.lit(t).alias("d"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    b = reduce(DataFrame.unionByName, map(box, ("dim_at", "dim_ch", "dim_de")))
    o = b.select(*[F.col(c).alias(f"o_{c}") for c in b.columns])
    return b.join(o, (F.col("d") < F.col("o_d")) & (F.col("w") <= F.col("o_e")) & (F.col("o_w") <= F.col("e")) & (F.col("s") <= F.col("o_n")) & (F.col("o_s") <= F.col("n"))).select(F.col("d").alias("a"), F.col("o_d").alias("b"))


def jn22_filled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.filled_days(D.legs(spark, sf_dir), 900)


def jn23_corrected_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals before the previous departure take that departure's time, in one window."""
    s = D.order_stops(spark, sf_dir)
    w = Window.partitionBy("trip_id").orderBy("stop_seq", "l_partkey", "l_suppkey", "l_extendedprice")
    prev = F.lag("sched_dep").over(w)
    return s.select("trip_id", "stop_seq", "l_partkey", F.when(F.col("sched_arr") < prev, prev).otherwise(F.col("sched_arr")).alias("arr"))


def jn24_current_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each station's last listing, one row."""
    x = table(spark, sf_dir, "raw_stops").distinct()
    n = F.row_number().over(Window.partitionBy("stop_id").orderBy(F.desc("snap"), F.asc_nulls_last("stop_name"), F.asc_nulls_last("stop_lat"), F.asc_nulls_last("stop_lon"), F.asc_nulls_last("location_type"), "loaded_at"))
    return x.filter("stop_id IS NOT NULL").withColumn("n", n).filter("n = 1").select("stop_id", "snap", "stop_name")


def jn26_hub_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest stations of each interchange: five fixed places, a top-k."""
    h = table(spark, sf_dir, "hub_stations").select(F.col("bpuic").alias("hub"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    p = table(spark, sf_dir, "dim_ch").filter("(lon <> 0 OR lat <> 0)").select("bpuic", "lon", "lat").distinct()
    d = p.join(F.broadcast(h)).withColumn("d", great_circle_m(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")))
    n = F.row_number().over(Window.partitionBy("hub").orderBy("d", "bpuic"))
    return d.withColumn("k", n).filter("k <= 8").select("hub", F.col("k").cast("bigint").alias("k"), "bpuic")


def ag01_distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = D.legs(spark, sf_dir).select("from_bpuic", "to_bpuic", "line").distinct()
    return x.agg(F.count(F.lit(1)).alias("triples"), F.count_if(F.col("line").isNull()).alias("without_line"))


def ag02_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay quantiles by type from value counts: exact, and a hot type costs as many rows as it has distinct delays."""
    h = D.legs(spark, sf_dir).groupBy("type_id", "delay").agg(F.count(F.lit(1)).alias("n"))
    return h.groupBy(F.col("type_id").cast("bigint").alias("type_id")).agg(F.percentile("delay", 0.5, F.col("n")).alias("p50"), F.round(F.percentile("delay", 0.99, F.col("n")), 6).alias("p99"))


def ag03_month_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.month_summary(D.legs(spark, sf_dir))


def ag04_verdict_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(~F.col("dur").between(1, 3600), "bad_duration").when(F.abs(F.col("delay").cast("int")) >= 10_800, "bad_delay").otherwise("ok")
    x = D.legs(spark, sf_dir)
    return x.groupBy(v.alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(x.agg(F.lit("legs").alias("what"), F.count(F.lit(1)).alias("n")))


def ag05_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c: F.struct(c, "leg_id")
    return D.legs(spark, sf_dir).groupBy(F.col("route_id").cast("bigint").alias("route_id")).agg(F.min_by("leg_id", key("t_dep")).alias("first_leg"), F.max_by("leg_id", key("t_dep")).alias("last_leg"), F.max_by("leg_id", key("dur")).alias("longest_leg"))


def ag07_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of a station number: the mean of its location_type 1 rows, else of all its rows."""
    x = table(spark, sf_dir, "raw_stops").distinct().select(F.regexp_extract("stop_id", "^(?:Parent)?([0-9]+)", 1).alias("num"), F.col("stop_lat").try_cast("decimal(20,13)").alias("lat"), "location_type").filter("num <> '' AND lat IS NOT NULL")
    one = F.when(F.col("location_type") == "1", F.col("lat"))
    return x.groupBy("num").agg(F.round(F.coalesce(F.avg(one), F.avg("lat")), 4).cast("double").alias("lat"), F.count(F.lit(1)).alias("n"))


def ag08_bools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.legs(spark, sf_dir).groupBy("service_day", "trip_id").agg(F.bool_and(F.col("flags").bitwiseAND(1) == 0).alias("all_measured"), F.bool_or(F.col("flags").bitwiseAND(2) != 0).alias("any_piece"))


def ag10_ordered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = F.array_sort(F.collect_list(F.struct("t_dep", "leg_id", "to_bpuic")))
    return D.legs(spark, sf_dir).groupBy("service_day", "trip_id").agg(F.array_join(F.transform(l, lambda s: s["to_bpuic"].cast("string")), ",").alias("calls"))


def ag13_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = D.legs(spark, sf_dir).groupBy(F.col("route_id").cast("bigint").alias("route_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.pmod("delay", F.lit(60)) == 0).alias("whole"))
    return x.filter((F.col("n") >= 20) & (F.col("whole") >= 0.9 * F.col("n")))


def ag14_usual_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = D.legs(spark, sf_dir).groupBy(F.floor(F.col("t_dep") / 3600).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return h.select((F.col("h") * 3600).alias("hour"), "n", F.median("n").over(Window.partitionBy(F.pmod("h", F.lit(168)))).alias("usual"))


def ag16_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.violations(D.legs(spark, sf_dir))


def ag17_source_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "gb_sched").filter("ssd IS NOT NULL").select(F.to_date("ssd").alias("service_day"), F.col("rid").alias("trip_id"), ((F.col("can") == "True") | (F.col("deleted") == "True")).alias("cancelled"))
    return Q.source_days(s)


def leg08_thin_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.thin_days(Q.filled_days(D.legs(spark, sf_dir), 900), ag17_source_days(spark, sf_dir), 0.05)


def ag18_trip_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.legs(spark, sf_dir).groupBy(L.departure_day().alias("dep_day")).agg(F.min("t_dep").alias("first"), F.max(F.col("t_dep") + F.col("dur")).alias("last"), F.sum("dur").alias("seconds"))


def ag23_gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.gap_runs(table(spark, sf_dir, "raw_stops").select(F.col("snap").alias("day")))


def ag24_delay_by_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.when((F.abs(F.col("delay").cast("int")) < 10_800) & (F.col("flags").bitwiseAND(1) == 0), F.col("delay").cast("int"))
    x = D.legs(spark, sf_dir).select("from_bpuic", ok.alias("d")).groupBy("from_bpuic").agg(F.count("d").alias("n"), F.sum("d").alias("total"), F.count_if(F.col("d") <= 180).alias("punctual"))
    return x.filter("n >= 10").orderBy(F.desc("total"), "from_bpuic").limit(20)


def wn03_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal line status in each order's lines."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x = table(spark, sf_dir, "lineitem").withColumn("new", F.when(~F.col("l_linestatus").eqNullSafe(F.lag("l_linestatus").over(w)) | (F.row_number().over(w) == 1), 1).otherwise(0))
    x = x.withColumn("island", F.sum("new").over(w))
    return x.groupBy("l_orderkey", "island").agg(F.min("l_linestatus").alias("status"), F.count(F.lit(1)).alias("n"))


def wn04_next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "raw_stops").select("stop_id", "snap").filter("stop_id IS NOT NULL").distinct()
    nxt = F.lead("snap").over(Window.partitionBy("stop_id").orderBy("snap"))
    return s.select("stop_id", F.col("snap").alias("valid_from"), F.coalesce(F.date_sub(nxt, 1), F.lit("9999-12-31").cast("date")).alias("valid_to"))


def wn05_best_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "raw_stops").distinct().filter("stop_id IS NOT NULL").withColumn("num", F.regexp_extract("stop_id", "([0-9]+)", 1)).withColumn("k", F.length("stop_id"))
    return x.withColumn("b", F.min("k").over(Window.partitionBy("snap", "num"))).filter("k = b").groupBy("snap").agg(F.count(F.lit(1)).alias("n"))


def wn06_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.overlaps(D.places(spark, sf_dir), "bpuic")


def wn12_past_midnight(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "gb_sched").select("rid", "ts", F.col("idx").cast("bigint").alias("idx"), S.clock_seconds(F.coalesce("wtd", "wta", "wtp")).alias("w")).distinct()
    w = Window.partitionBy("rid", "ts").orderBy("idx", "w")
    s = s.withColumn("wrap", F.when(F.col("w") < F.lag("w").over(w) - 43_200, 1).otherwise(0))
    return s.groupBy("rid", "ts").agg(F.sum("wrap").alias("wraps"), F.count(F.lit(1)).alias("n"))


def wn13_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "gb_act").filter("at_dep IS NOT NULL").select("rid", "tpl", "at_dep", instant_ns(F.col("ts")).alias("t"))
    return a.groupBy("rid", "tpl").agg(F.max_by("at_dep", F.struct("t", "at_dep")).alias("at_dep"))


def wn15_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last order of every customer."""
    p = Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(p.orderBy("o_orderdate", "o_orderkey"))).withColumn("n", F.count(F.lit(1)).over(p))
    return o.filter("k = 1 OR k = n").select("o_custkey", "o_orderkey", F.col("k").cast("bigint").alias("k"), "n")


def wn17_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each train and day the service with the most calls."""
    s = table(spark, sf_dir, "gb_sched").select("ssd", "train_id", "rid", "tpl").distinct().groupBy("ssd", "train_id", "rid").agg(F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(Window.partitionBy("ssd", "train_id").orderBy(F.desc("n"), "rid"))
    return s.withColumn("k", k).filter("k = 1").select("ssd", "train_id", "rid", "n")


def wn18_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often one kind of event stands between two others of its user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.lag("event_type").over(w).alias("before"), F.col("event_type").alias("here"), F.lead("event_type").over(w).alias("after"))
    return e.groupBy("before", "here", "after").agg(F.count(F.lit(1)).alias("n"))


def wn20_snapshot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "raw_stops").select("snap").distinct()
    return s.select("snap", F.row_number().over(Window.orderBy("snap")).cast("bigint").alias("i"))


def so07_top_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.legs(spark, sf_dir).groupBy(F.col("route_id").cast("bigint").alias("route_id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "route_id").limit(5)


def st02_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dim_de").select("country").union(table(spark, sf_dir, "dim_at").select("country")).distinct()


def st03_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = D.legs(spark, sf_dir)
    named = l.select(F.col("from_bpuic").alias("bpuic")).union(l.select("to_bpuic")).distinct()
    return D.places(spark, sf_dir).select("bpuic").distinct().join(named, "bpuic", "left_anti")


def st04_shared_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = D.legs(spark, sf_dir).select(L.departure_day().alias("day")).distinct()
    b = table(spark, sf_dir, "at_trips").select(F.col("service_day").alias("day")).distinct()
    return a.join(b, "day")


def dim06_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "raw_stops").distinct().filter("stop_id RLIKE '^[0-9]+$'")
    v = F.struct("snap", F.coalesce("stop_name", F.lit("")).alias("name"), F.coalesce("stop_lat", F.lit("")).alias("lat"))
    return x.groupBy("stop_id").agg(F.max(v).alias("v")).select("stop_id", "v.snap", "v.name", "v.lat")


def dim07_checksum_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers for places without one: from a checksum, which any engine computes alike."""
    t = table(spark, sf_dir, "gb_sched").select("tpl").distinct()
    return t.select("tpl", S.code_number(F.col("tpl")).alias("base37"), F.crc32(F.col("tpl").cast("binary")).alias("crc"))


def snk06_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.manifest(D.legs(spark, sf_dir))


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[:2] in ("fl", "jn", "ag", "wn", "so", "st", "di", "sn", "le") and n[-1] != "_" and getattr(f, "__module__", "") == __name__}

_D = D.LEGS
_DAY = "(date '1970-01-01' + (t_dep // 86400)::int)::date"
_NUM = "ltrim(regexp_extract(num, '([0-9]+)[^0-9]*$', 1), '0')"
_TS = "(epoch_us(regexp_replace(ts, '\\.[0-9]+', '')::timestamptz), rpad(regexp_extract(ts, '\\.([0-9]+)', 1), 9, '0'))"
_W = "coalesce(wtd, wta, wtp)"
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_SOURCE = "d as (select service_day, count(*) as trains, count(*) filter (gone) as cancelled from (select ssd::date as service_day, rid, bool_and(can = 'True' or deleted = 'True') as gone from gb_sched where ssd is not null group by 1, 2) group by 1)"
_FILLED = f"n as (select {_DAY} as dep_day, count(*) as legs from legs group by 1), f as (select s.d::date as dep_day, coalesce(legs, 0) as legs, coalesce(legs, 0) < 900 as thin from (select unnest(generate_series((select min(dep_day) from n), (select max(dep_day) from n), interval 1 day)) as d) s left join n on dep_day = s.d::date)"
_CIRCLE = "2 * 6371000.0 * asin(sqrt(least(1.0, power(sin(radians(y - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * power(sin(radians(x - lon) / 2), 2))))"

SQL = {
    "flt02_counts": f"with {_D} select count(*) as legs, count(*) filter (flags % 2 = 0) as measured, count(*) filter (line is null) as no_line from legs",
    "flt04_side_nulls": "with s as (select distinct * from gb_sched), x as (select rid, case when can <> 'True' then wta end as wta, case when can <> 'True' then wtd end as wtd from s where not regexp_matches(lower(train_cat), 'bus|bs|br')) select rid, count(*) as n, count(wta) as arr, count(wtd) as dep from x where wta is not null or wtd is not null group by 1",
    "flt10_clip": "select bpuic, name, country from (select * from dim_de union select * from dim_at) where lon between 5.9 and 10.5 and lat between 45.8 and 47.9 and (country is null or country in ('CH', 'DE'))",
    "flt11_range": f"with {_D} select leg_id, t_dep from legs where t_dep between 1515571200 and 1515657599",
    "jn01_validity": f"with {_D}, {D.PLACES} select from_bpuic, to_bpuic, count(*) as n, min(f.name) as f_name, min(t.name) as t_name, count(*) filter (f.bpuic is null or t.bpuic is null) as unmatched from legs left join places f on f.bpuic = from_bpuic and service_day between f.valid_from and f.valid_to left join places t on t.bpuic = to_bpuic and service_day between t.valid_from and t.valid_to group by 1, 2",
    "jn02_categories": f"with {_D} select l.type_id::bigint as type_id, category, count(*) as n from legs l left join train_types t on l.type_id = t.type_id group by 1, 2",
    "jn05_active_days": "with t as (select distinct num, service_day from at_trips), s as (select num, unnest(generate_series(min(service_day), max(service_day), interval 1 day))::date as service_day from t group by 1) select num, service_day from s anti join t using (num, service_day)",
    "jn08_double_numbers": "with s as (select distinct ssd, train_id, rid from gb_sched where train_id is not null) select a.ssd, a.train_id, a.rid, b.rid as other from s a join s b using (ssd, train_id) where a.rid < b.rid",
    "jn09_latest_messages": "select o_custkey, o_orderkey, o_orderdate::date as d from orders join (select o_custkey, max(o_orderdate::date) as m from orders group by 1) using (o_custkey) where o_orderdate::date = m",
    "jn10_null_safe": "with s as (select distinct rid, tpl, wta, wtd, wtp from gb_sched), a as (select rid, tpl, wta, wtd, wtp, count(*) as n from gb_act group by all) select s.rid, count(*) as calls, count(n) as seen, sum(coalesce(n, 0))::bigint as messages from s left join a on s.rid = a.rid and s.tpl = a.tpl and s.wta is not distinct from a.wta and s.wtd is not distinct from a.wtd and s.wtp is not distinct from a.wtp group by 1",
    "jn11_nearest_hub": "select bpuic, p.lon as lon, p.lat as lat, arg_min(hub, ((x - lon) * (x - lon) + (y - lat) * (y - lat), hub)) as hub from (select distinct bpuic, lon, lat from dim_ch where lon is not null and lat is not null) p, (select bpuic as hub, lon as x, lat as y from hub_stations) h group by 1, 2, 3",
    "jn12_unknown_places": "select distinct tpl from gb_sched where tpl not in (select tpl from gb_act where at_dep is not null and tpl is not null)",
    "jn13_semi": f"with {_D} select from_bpuic, count(*) as n from legs where from_bpuic in (select bpuic from hub_stations) group by 1",
    "jn14_exists": "select rid, bool_or(can = 'True') as part_cancelled, bool_and(can = 'True') as cancelled from gb_sched group by 1",
    "jn15_split_fields": f"with {_D} select distinct trip_id, array_to_string(list_filter(string_split(trip_id, ':'), lambda v: v <> ''), '/') as path, list_extract(string_split(trip_id, ':'), -2) as kind from legs",
    "jn20_same_number": f"select * from (select service_day, {_NUM} as n, count(*) as runs from (select distinct * from at_runs) group by 1, 2) join (select service_day, {_NUM} as n, count(*) as trips from (select distinct * from at_trips) group by 1, 2) using (service_day, n)",
    "jn21_overlapping_boxes": "with b as (select 'dim_at' as d, min(lon) as w, max(lon) as e, min(lat) as s, max(lat) as n from dim_at where lon <> 0 or lat <> 0 union all select 'dim_ch', min(lon), max(lon), min(lat), max(lat) from dim_ch where lon <> 0 or lat <> 0 union all select 'dim_de', min(lon), max(lon), min(lat), max(lat) from dim_de where lon <> 0 or lat <> 0) select x.d as a, y.d as b from b x join b y on x.d < y.d and x.w <= y.e and y.w <= x.e and x.s <= y.n and y.s <= x.n",
    "jn22_filled_days": f"with {_D}, {_FILLED} select * from f",
    "jn23_corrected_arrivals": f"with {D.ORDER_STOPS} select trip_id, stop_seq, l_partkey, case when sched_arr < lag(sched_dep) over w then lag(sched_dep) over w else sched_arr end as arr from stops window w as (partition by trip_id order by stop_seq, l_partkey, l_suppkey, l_extendedprice)",
    "jn24_current_rows": "select stop_id, snap, stop_name from (select *, row_number() over (partition by stop_id order by snap desc, stop_name nulls last, stop_lat nulls last, stop_lon nulls last, location_type nulls last, loaded_at) as n from (select distinct * from raw_stops) where stop_id is not null) where n = 1",
    "jn26_hub_neighbours": f"select hub, k, bpuic from (select hub, bpuic, row_number() over (partition by hub order by {_CIRCLE}, bpuic) as k from (select distinct bpuic, lon, lat from dim_ch where lon <> 0 or lat <> 0), (select bpuic as hub, lon as x, lat as y from hub_stations)) where k <= 8",
    "ag01_distinct_pairs": f"with {_D} select count(*) as triples, count(*) filter (line is null) as without_line from (select distinct from_bpuic, to_bpuic, line from legs)",
    "ag02_quantiles": f"with {_D} select type_id::bigint as type_id, quantile_cont(delay::double, 0.5) as p50, round(quantile_cont(delay::double, 0.99), 6) as p99 from legs group by 1",
    "ag03_month_summary": f"with {_D} select date_trunc('month', {_DAY})::date as month, count(*) as legs, round(100 * avg((flags % 2 = 0)::int), 6) as measured_pct, count(*) filter (flags & 2 <> 0) as pieces, quantile_cont(dur::double, 0.5) as p50, quantile_cont(dur::double, 0.99) as p99, max(dur)::bigint as longest, count(distinct {_DAY}) as days, count(distinct (from_bpuic, to_bpuic)) as pairs, count(distinct (service_day, trip_id)) as journeys from legs group by 1",
    "ag04_verdict_union": f"with {_D} select case when dur not between 1 and 3600 then 'bad_duration' when abs(delay::int) >= 10800 then 'bad_delay' else 'ok' end as what, count(*) as n from legs group by 1 union all select 'legs', count(*) from legs",
    "ag05_extremes": f"with {_D} select route_id::bigint as route_id, arg_min(leg_id, (t_dep, leg_id)) as first_leg, arg_max(leg_id, (t_dep, leg_id)) as last_leg, arg_max(leg_id, (dur, leg_id)) as longest_leg from legs group by 1",
    "ag07_filtered": "with x as (select regexp_extract(stop_id, '^(?:Parent)?([0-9]+)', 1) as num, try_cast(stop_lat as decimal(20,13)) as lat, location_type from (select distinct * from raw_stops)) select num, round(coalesce(sum(lat) filter (location_type = '1')::decimal(38,13) / nullif(count(*) filter (location_type = '1'), 0)::decimal(9,0), sum(lat)::decimal(38,13) / count(*)::decimal(9,0)), 4)::double as lat, count(*) as n from x where num <> '' and lat is not null group by 1",
    "ag08_bools": f"with {_D} select service_day, trip_id, bool_and(flags % 2 = 0) as all_measured, bool_or(flags & 2 <> 0) as any_piece from legs group by 1, 2",
    "ag10_ordered_lists": f"with {_D} select service_day, trip_id, string_agg(to_bpuic::varchar, ',' order by t_dep, leg_id) as calls from legs group by 1, 2",
    "ag13_shares": f"with {_D} select route_id::bigint as route_id, count(*) as n, count(*) filter (delay % 60 = 0) as whole from legs group by 1 having count(*) >= 20 and count(*) filter (delay % 60 = 0) >= 0.9 * count(*)",
    "ag14_usual_hours": f"with {_D}, h as (select t_dep // 3600 as h, count(*) as n from legs group by 1) select h * 3600 as hour, n, median(n) over (partition by h % 168) as usual from h",
    "ag16_violations": f"with {_D} select count(*) filter (dur not between 1 and 3600) as bad_duration, count(*) filter (flags & 248 <> 0) as bad_flags, count(*) filter (route_id is null or t_dep is null or trip_id is null) as nulls, count(*) filter (not (route_start between 0 and 254 and route_end between 1 and 255 and route_start < route_end)) as bad_share from legs",
    "ag17_source_days": f"with {_SOURCE} select * from d",
    "leg08_thin_days": f"with {_D}, {_FILLED}, {_SOURCE} select dep_day, legs, case when cancelled / nullif(trains, 0)::double >= 0.05 then 'explained' else 'unexplained' end as verdict from f left join d on dep_day = service_day where thin",
    "ag18_trip_spans": f"with {_D} select {_DAY} as dep_day, min(t_dep) as first, max(t_dep + dur) as last, sum(dur)::bigint as seconds from legs group by 1",
    "ag23_gap_runs": "select snap + 1 as first, nxt - 1 as last, (nxt - snap - 1)::bigint as days from (select snap, lead(snap) over (order by snap) as nxt from (select distinct snap from raw_stops)) where nxt - snap > 1",
    "ag24_delay_by_station": f"with {_D}, d as (select from_bpuic, case when abs(delay::int) < 10800 and flags % 2 = 0 then delay::int end as d from legs) select from_bpuic, count(d) as n, sum(d)::bigint as total, count(*) filter (d <= 180) as punctual from d group by 1 having count(d) >= 10 order by total desc nulls last, from_bpuic limit 20",
    "wn03_islands": f"with x as (select *, row_number() over (partition by l_orderkey order by {_ORDER}) as r, lag(l_linestatus) over (partition by l_orderkey order by {_ORDER}) as p from lineitem), y as (select *, sum((r = 1 or l_linestatus is distinct from p)::int) over (partition by l_orderkey order by {_ORDER}) as island from x) select l_orderkey, island::bigint as island, min(l_linestatus) as status, count(*) as n from y group by 1, 2",
    "wn04_next_version": "select stop_id, snap as valid_from, coalesce(lead(snap) over (partition by stop_id order by snap) - 1, date '9999-12-31') as valid_to from (select distinct stop_id, snap from raw_stops where stop_id is not null)",
    "wn05_best_kind": "with x as (select *, regexp_extract(stop_id, '([0-9]+)', 1) as num, length(stop_id) as k from (select distinct * from raw_stops) where stop_id is not null), y as (select *, min(k) over (partition by snap, num) as b from x) select snap, count(*) as n from y where k = b group by 1",
    "wn06_overlaps": f"with {D.PLACES} select bpuic, valid_from, valid_to, nxt as next from (select *, lead(valid_from) over (partition by bpuic order by valid_from, valid_to) as nxt from places) where valid_to >= nxt",
    "wn12_past_midnight": f"with s as (select distinct rid, ts, idx::bigint as idx, split_part({_W}, ':', 1)::bigint * 3600 + split_part({_W}, ':', 2)::bigint * 60 + coalesce(nullif(split_part({_W}, ':', 3), '')::bigint, 0) as w from gb_sched), x as (select *, case when w < lag(w) over (partition by rid, ts order by idx, w) - 43200 then 1 else 0 end as wrap from s) select rid, ts, sum(wrap)::bigint as wraps, count(*) as n from x group by 1, 2",
    "wn13_latest": f"select rid, tpl, arg_max(at_dep, ({_TS}, at_dep)) as at_dep from gb_act where at_dep is not null group by 1, 2",
    "wn15_positions": "select o_custkey, o_orderkey, k, n from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k, count(*) over (partition by o_custkey) as n from orders) where k = 1 or k = n",
    "wn17_dedupe": "with s as (select ssd, train_id, rid, count(distinct coalesce(tpl, '~')) as n from gb_sched group by 1, 2, 3) select ssd, train_id, rid, n from (select *, row_number() over (partition by ssd, train_id order by n desc, rid) as k from s) where k = 1",
    "wn18_contexts": "select before, here, after, count(*) as n from (select lag(event_type) over w as before, event_type as here, lead(event_type) over w as after from events window w as (partition by user_id order by ts, event_id)) group by all",
    "wn20_snapshot_index": "select snap, row_number() over (order by snap) as i from (select distinct snap from raw_stops)",
    "so07_top_routes": f"with {_D} select route_id::bigint as route_id, count(*) as n from legs group by 1 order by n desc, route_id limit 5",
    "st02_union": "select country from dim_de union select country from dim_at",
    "st03_difference": f"with {_D}, {D.PLACES} select distinct bpuic from places where bpuic not in (select from_bpuic from legs union select to_bpuic from legs)",
    "st04_shared_days": f"with {_D} select distinct {_DAY} as day from legs intersect select service_day from at_trips",
    "dim06_latest": "select stop_id, v.snap as snap, v.name as name, v.lat as lat from (select stop_id, max({'snap': snap, 'name': coalesce(stop_name, ''), 'lat': coalesce(stop_lat, '')}) as v from raw_stops where regexp_matches(stop_id, '^[0-9]+$') group by 1)",
    "snk06_manifest": f"with {_D} select {_DAY} as dep_day, count(*) as legs, count(distinct (service_day, trip_id)) as journeys, min(t_dep) as first, max(t_dep) as last from legs group by 1",
}
