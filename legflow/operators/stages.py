"""From a feed as it is read (all text) to stop events, one function a feed.

Every stage returns: service_day, trip_id, operator, train_number, category, line, station, stop_seq, sched_arr, sched_dep,
act_arr, act_dep (epoch seconds), arr_measured, dep_measured (never null). A run that contradicts itself is left out whole.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legflow.functions.zones import to_epoch
from legflow.operators.changes import instant_ns
from legflow.operators.staging import contained, interpolated_delay, malformed, paired_by_overlap, slots
from legflow.runtime import join_null_safe

STOP = ("service_day", "trip_id", "operator", "train_number", "category", "line", "station", "stop_seq", "sched_arr", "sched_dep", "act_arr", "act_dep", "arr_measured", "dep_measured")

# What marks measured times, trains among other vehicles, stops among other points.
MEASURED = ("REAL", "GESCHAETZT")
FI_PASSENGER = ("Commuter", "Long-distance")
NL_NO_TRAIN = r"bus|ipv|i\.p\.v\."
BE_PASSING = ("D", "P")
DE_ROAD_TYPES = ("BUS", "SEV", "BSV", "BEV", "BBUS", "BS", "TAXI", "EV")
DE_ROAD_LINES = ("SEV", "EV", "EVS", "SV", "EVRT", "BUS")
IT_DELAY_MIN, IT_BLIND_UNTIL = (-30, 720), datetime.date(2023, 11, 4)

# Categories of the feeds and the codes they stand for.
NL_CATEGORIES = {
    "sprinter": "SPR", "stoptrein": "ST", "sneltrein": "SNT", "intercity": "IC", "intercity direct": "ICD", "eurocity": "EC", "eurocity direct": "ECD", "ice international": "ICE", "ice": "ICE",
    "thalys": "THA", "eurostar": "EST", "int. trein": "INT", "nightjet": "NJ", "european sleeper": "ES", "nachttrein": "NT", "extra trein": "EXTRA", "speciale trein": "SPEC", "stoomtrein": "STOOM",
}
BE_CATEGORIES = {"EURST": "EST", "THAL": "THA"}  # other prefixes are their own code
BE_SUBURBAN = r"^(L [ABCGL][0-9]|S[0-9])"
DE_PRODUCTS = ("ICE", "IC", "EC", "ECE", "RJ", "RJX", "TGV", "EST", "FLX", "WB", "NJ", "EN", "ES", "D", "IR", "IRE", "RE", "RB", "S", "MEX", "RS", "FEX", "R", "OS")
DE_LINES = {"S": "S", "RE": "RE", "RB": "RB", "IRE": "IRE", "MEX": "MEX", "RS": "RS", "FEX": "FEX", "HBX": "RE", "REX": "RE"}


def coded(c: Column, codes: dict[str, str], other: Column) -> Column:
    """The code of a category by a dictionary, else `other`."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), c), other) if codes else other


def says_yes(c: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(f"`{c}`"))) == "true", F.lit(False))


def seconds(c: str) -> Column:
    """Epoch seconds of an ISO text with offset."""
    return F.floor(instant_ns(F.col(f"`{c}`")) / 1_000_000_000)


def unknown_station(code: Column) -> Column:
    """A negative stand-in for a code no station has, the same on every run."""
    return -F.pmod(F.crc32(code), F.lit(1_000_000_000)) - 1


def _staged(x: DataFrame, **cols: Column) -> DataFrame:
    as_ = {"service_day": "date", "station": "bigint", "stop_seq": "bigint", "sched_arr": "bigint", "sched_dep": "bigint", "act_arr": "bigint", "act_dep": "bigint"}
    return x.select(*[(cols[c].cast(as_[c]) if c in as_ else cols[c]).alias(c) for c in STOP])


def _numbered(runs: DataFrame, label: Column, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Runs with `label` and `trip_id`: the k-th run of a day with one label is `label #k` from the second on."""
    x = runs.withColumn("label", label)
    k = F.row_number().over(Window.partitionBy("service_day", *(by or ["label"])).orderBy(*order))
    return x.withColumn("trip_id", F.when(k == 1, F.col("label")).otherwise(F.concat(F.col("label"), F.lit(" #"), k.cast("string"))))


def ist_rows(rows: DataFrame, zone: str = "Europe/Zurich") -> DataFrame:
    """Day files with German column names as stop events, plus umlauf_id, is_extra, passing; stop_seq is null (order by time).

    Trains that are not cancelled; times in two notations; a time is measured if its status says so and it can be read.
    """
    at = lambda c: to_epoch(F.coalesce(F.try_to_timestamp(F.col(c), F.lit("d.M.yyyy H:mm:ss")), F.try_to_timestamp(F.col(c), F.lit("d.M.yyyy H:mm"))), zone)
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    ok = lambda status, t: F.coalesce(F.col(status).isin(*MEASURED), F.lit(False)) & at(t).isNotNull()
    x = rows.filter((F.upper("PRODUKT_ID") == "ZUG") & ~says_yes("FAELLT_AUS_TF"))
    s = _staged(
        x.withColumn("_r", F.struct(*x.columns)), service_day=F.to_date(F.try_to_timestamp("BETRIEBSTAG", F.lit("d.M.yyyy"))), trip_id=F.col("FAHRT_BEZEICHNER"), operator=F.col("BETREIBER_ABK"), train_number=F.lit(None).cast("string"), category=F.col("VERKEHRSMITTEL_TEXT"), line=blank("LINIEN_TEXT"),
        station=F.col("BPUIC").try_cast("bigint"), stop_seq=F.lit(None), sched_arr=at("ANKUNFTSZEIT"), sched_dep=at("ABFAHRTSZEIT"), act_arr=at("AN_PROGNOSE"), act_dep=at("AB_PROGNOSE"), arr_measured=ok("AN_PROGNOSE_STATUS", "AN_PROGNOSE"), dep_measured=ok("AB_PROGNOSE_STATUS", "AB_PROGNOSE"),
    )
    return s


def fi_stops(trains: DataFrame) -> DataFrame:
    """Nested trains (departureDate, trainNumber, trainType, trainCategory, commuterLineID, operatorShortCode, cancelled,
    timeTableRows of type, cancelled, scheduledTime, actualTime, commercialStop, trainStopping, stationUICCode, countryCode).

    Rows alternate departure and arrival; row i belongs to stop (i + 1) div 2. Cancelled trains and rows drop, stops that
    are not commercial too.
    """
    run = ["departureDate", "trainNumber"]
    t = trains.filter(F.col("trainCategory").isin(*FI_PASSENGER) & ~F.coalesce(F.col("cancelled"), F.lit(False)))
    r = t.select(*run, "trainType", "commuterLineID", "operatorShortCode", F.posexplode("timeTableRows").alias("i", "r"))
    r = r.withColumn("slot", F.floor((F.col("i") + 1) / 2)).withColumn("place", F.struct("r.countryCode", "r.stationUICCode"))
    wrong = F.col("r.type") != F.when(F.col("i") % 2 == 0, "DEPARTURE").otherwise("ARRIVAL")
    bad = r.groupBy(*run, "slot").agg(F.max(wrong).alias("w"), F.countDistinct("place").alias("n")).filter("w OR n > 1").select(*run).distinct()
    live = r.join(bad, run, "left_anti").filter(~F.coalesce(F.col("r.cancelled"), F.lit(False)))
    at = lambda kind, c: F.max(F.when(F.col("r.type") == kind, F.floor(instant_ns(F.col(f"r.{c}")) / 1_000_000_000)))
    s = live.groupBy(*run, "slot", "trainType", "commuterLineID", "operatorShortCode").agg(
        F.max(local_station(F.col("r.countryCode"), F.col("r.stationUICCode"))).alias("station"), F.max(F.coalesce(F.col("r.trainStopping") & F.col("r.commercialStop"), F.lit(False))).alias("commercial"),
        at("ARRIVAL", "scheduledTime").alias("sa"), at("ARRIVAL", "actualTime").alias("aa"), at("DEPARTURE", "scheduledTime").alias("sd"), at("DEPARTURE", "actualTime").alias("ad"),
    ).filter("commercial")
    name = F.concat_ws(" ", "trainType", "trainNumber")
    return _staged(
        s, service_day=F.col("departureDate"), trip_id=name, operator=F.col("operatorShortCode"), train_number=F.col("trainNumber").cast("string"), category=F.col("trainType"), line=F.coalesce(F.nullif(F.trim("commuterLineID"), F.lit("")), name), station=F.col("station"),
        stop_seq=F.col("slot"), sched_arr=F.col("sa"), sched_dep=F.col("sd"), act_arr=F.col("aa"), act_dep=F.col("ad"), arr_measured=F.col("aa").isNotNull(), dep_measured=F.col("ad").isNotNull(),
    )


def local_station(country: Column, uic: Column) -> Column:
    """A station number that is unique over countries: Finland's own as they are, others above them by country."""
    letter = lambda i: F.ascii(F.substring(F.upper(country), i, 1)) - 64
    return F.when(country == "FI", uic).otherwise((letter(1) * 100 + letter(2)) * 1_000_000 + uic).cast("bigint")


def nl_stops(rows: DataFrame, stations: DataFrame) -> DataFrame:
    """Monthly rows of services and stops (columns `Service:...`, `Stop:...`), stations (code, bpuic).

    No buses. A service whose times go back or that repeats a station is malformed; one that another service holds whole
    (larger, or as large and of lesser id) is redundant. Actual is scheduled plus whole minutes of delay.
    """
    c = lambda n: F.col(f"`{n}`")
    x = rows.filter(~F.lower(c("Service:Type")).rlike(NL_NO_TRAIN)).select(
        c("Service:RDT-ID").try_cast("bigint").alias("sid"), c("Service:Date").try_cast("date").alias("service_day"), F.trim(c("Service:Type")).alias("kind"), c("Service:Company").alias("company"), c("Service:Train number").alias("number"), says_yes("Service:Completely cancelled").alias("off"),
        c("Stop:RDT-ID").try_cast("bigint").alias("pos"), c("Stop:Station code").alias("code"), *[f for side, k in (("Arrival", "arr"), ("Departure", "dep")) for f in (seconds(f"Stop:{side} time").alias(k), c(f"Stop:{side} delay").try_cast("int").alias(f"{k}_delay"), says_yes(f"Stop:{side} cancelled").alias(f"{k}_off"))],
    )
    timed = x.filter("arr IS NOT NULL OR dep IS NOT NULL").withColumn("t_in", F.coalesce("arr", "dep")).withColumn("t", F.coalesce("dep", "arr"))
    bad = malformed(timed, ["sid"], "pos", "t_in", "code", "t")
    again = contained(timed.select("service_day", "code", "t", "sid").distinct(), ["service_day", "code", "t"], "sid")
    live = x.filter("NOT off").join(bad, "sid", "left_anti").join(again, "sid", "left_anti").withColumn("arr_on", F.col("arr").isNotNull() & ~F.col("arr_off")).withColumn("dep_on", F.col("dep").isNotNull() & ~F.col("dep_off"))
    svc = live.groupBy("sid").agg(F.min("service_day").alias("service_day"), F.min_by("number", "pos").alias("number"), F.min("company").alias("company"), F.min("kind").alias("kind"))
    svc = svc.withColumn("category", coded(F.lower("kind"), NL_CATEGORIES, F.col("kind")))
    svc = _numbered(svc, F.concat_ws(" ", "category", "number"), ["sid"]).drop("kind")
    seq = F.row_number().over(Window.partitionBy("sid").orderBy("pos"))
    s = live.filter("arr_on OR dep_on").withColumn("seq", seq).select("sid", "seq", "code", "arr", "dep", "arr_delay", "dep_delay", "arr_on", "dep_on").join(svc, "sid").join(stations.select("code", "bpuic"), "code", "left")
    on = lambda k, v: F.when(F.col(f"{k}_on"), v)
    act = lambda k: on(k, F.col(k) + 60 * F.col(f"{k}_delay"))
    return _staged(
        s, service_day=F.col("service_day"), trip_id=F.col("trip_id"), operator=F.col("company"), train_number=F.col("number"), category=F.col("category"), line=F.col("label"), station=F.coalesce("bpuic", unknown_station(F.col("code"))), stop_seq=F.col("seq"),
        sched_arr=on("arr", F.col("arr")), sched_dep=on("dep", F.col("dep")), act_arr=act("arr"), act_dep=act("dep"), arr_measured=F.col("arr_on") & F.col("arr_delay").isNotNull(), dep_measured=F.col("dep_on") & F.col("dep_delay").isNotNull(),
    )


def be_stops(rows: DataFrame, points: DataFrame, zone: str = "Europe/Brussels") -> DataFrame:
    """Punctuality rows (DATDEP, TRAIN_NO, RELATION, TRAIN_SERV, PTCAR_NO, THOP1_COD and date and time of each side, planned
    and real), points (bpuic, passenger). Passing points drop, operational ones too; unknown points stay.

    Stops are in the order of planned times, then the others', then real ones, then the point.
    """
    at = lambda kind, side: to_epoch(F.try_to_timestamp(F.concat_ws(" ", F.initcap(F.lower(F.regexp_replace(F.col(f"{kind}_DATE_{side}"), "([0-9]+)([A-Za-z]+)([0-9]+)", "$1-$2-$3"))), F.col(f"{kind}_TIME_{side}")), F.lit("d-MMM-yyyy H:mm:ss")), zone)
    day = F.to_date(F.try_to_timestamp(F.initcap(F.lower(F.regexp_replace("DATDEP", "([0-9]+)([A-Za-z]+)([0-9]+)", "$1-$2-$3"))), F.lit("d-MMM-yyyy")))
    x = rows.filter(F.col("THOP1_COD").isNull() | ~F.col("THOP1_COD").isin(*BE_PASSING)).select(
        day.alias("service_day"), F.col("TRAIN_NO").alias("number"), F.col("RELATION").alias("relation"), F.col("TRAIN_SERV").alias("operator"), F.col("PTCAR_NO").try_cast("bigint").alias("ptcar"),
        at("PLANNED", "ARR").alias("sa"), at("PLANNED", "DEP").alias("sd"), at("REAL", "ARR").alias("aa"), at("REAL", "DEP").alias("ad"),
    )
    p = points.select(F.col("bpuic").alias("ptcar"), F.col("passenger").alias("_on"))
    x = x.join(p, "ptcar", "left").filter(F.coalesce(F.col("_on"), F.lit(True)))
    run = ["service_day", "number"]
    order = [F.coalesce("sd", "sa").asc_nulls_last(), F.coalesce("sa", "sd").asc_nulls_last(), F.coalesce("aa", "ad").asc_nulls_last(), F.col("ptcar").asc_nulls_last()]
    x = x.withColumn("seq", F.row_number().over(Window.partitionBy(*run).orderBy(*order))).withColumn("t", F.coalesce("sd", "sa"))
    good = join_null_safe(x, malformed(x, run, "seq", "sa", "ptcar", "t"), run, "left_anti")
    svc = x.groupBy(*run).agg(F.min("operator").alias("operator"), F.min_by("relation", "seq").alias("relation"))
    s = join_null_safe(good.drop("operator", "relation"), svc, run)
    r = F.coalesce(F.nullif(F.trim("relation"), F.lit("")), F.lit("TRAIN"))
    prefix = F.upper(F.get(F.split(r, " "), 0))
    category = F.when(r.rlike(BE_SUBURBAN), "S").otherwise(coded(prefix, BE_CATEGORIES, prefix))
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    return _staged(
        s, service_day=F.col("service_day"), trip_id=F.concat_ws(" ", category, "number"), operator=F.col("operator"), train_number=F.col("number"), category=category, line=F.col("relation"), station=F.col("ptcar"), stop_seq=F.col("seq"),
        sched_arr=F.col("sa"), sched_dep=F.col("sd"), act_arr=F.col("aa"), act_dep=F.col("ad"), arr_measured=both("sa", "aa"), dep_measured=both("sd", "ad"),
    )


def de_rows(rows: DataFrame) -> DataFrame:
    """Rows with ride, pos, service_day out of their id `hash-yymmddHHMM-pos`, and `road`; other ids drop."""
    p = r"^(-?[0-9]+)-([0-9]{10})-([0-9]+)$"
    part = lambda i: F.regexp_extract("id", p, i)
    line = F.upper(F.regexp_extract(F.coalesce("line_number", F.lit("")), "^([A-Za-z]+)", 1))
    road = F.upper(F.coalesce("train_type", F.lit(""))).isin(*DE_ROAD_TYPES) | line.isin(*DE_ROAD_LINES)
    century = F.when(F.substring(part(2), 1, 2) >= "69", "19").otherwise("20")
    day = F.to_date(F.concat(century, F.substring(part(2), 1, 6)), "yyyyMMdd")
    return rows.filter(F.col("id").rlike(p)).select("*", F.concat_ws("-", part(1), part(2)).alias("ride"), part(3).cast("int").alias("pos"), day.alias("service_day"), road.alias("road"))


def de_stops(rows: DataFrame, zone: str = "Europe/Berlin") -> DataFrame:
    """Monthly rows a stop (eva, train_number, line_number, train_type, id, planned and changed local times, cancelled sides,
    is_additional_stop). No road replacement, no additional stops; a ride whose times go back is left out; the departure
    before a gap in the positions of the stops that are left is none, so no leg bridges it."""
    off = lambda c: F.coalesce(F.col(c), F.lit(False))
    x = de_rows(rows).filter(~F.col("road") & ~off("is_additional_stop"))
    for n, c in (("sa", "arrival_planned_time"), ("ca", "arrival_change_time"), ("sd", "departure_planned_time"), ("cd", "departure_change_time")):
        x = x.withColumn(n, to_epoch(F.col(c).cast("timestamp_ltz"), zone))
    w = Window.partitionBy("ride").orderBy("pos")
    bad = x.withColumn("_b", F.col("sa") < F.lag(F.coalesce("sd", "sa")).over(w)).filter("_b").select("ride").distinct()
    x = x.join(bad, "ride", "left_anti").withColumn("arr_on", F.col("sa").isNotNull() & ~off("arrival_is_canceled")).withColumn("dep_on", F.col("sd").isNotNull() & ~off("departure_is_canceled")).filter("arr_on OR dep_on")
    x = x.withColumn("go", F.col("dep_on") & ~F.coalesce(F.lead("pos").over(w) - F.col("pos") > 1, F.lit(False)))
    ride = x.groupBy("ride").agg(F.min("service_day").alias("service_day"), F.min("train_type").alias("kind"), F.min("train_number").alias("number"), F.min_by("line_number", F.when(F.col("line_number").isNotNull(), F.col("pos"))).alias("line"), F.min(F.coalesce("sd", "sa")).alias("t0"))
    kind, prefix = F.upper("kind"), F.upper(F.regexp_extract(F.coalesce("line", F.lit("")), "^([A-Za-z]+)", 1))
    category = F.when(kind.isin(*DE_PRODUCTS), kind).when(kind == "REX", "RE").otherwise(coded(prefix, DE_LINES, F.when(F.nullif(F.trim("line"), F.lit("")).isNotNull(), "RB").otherwise(F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.lit("TRAIN")))))
    ride = _numbered(ride.withColumn("category", category), F.concat_ws(" ", "category", "number"), ["t0", "ride"])
    s = x.select("ride", "pos", "eva", "sa", "ca", "sd", "cd", "arr_on", "go").join(ride, "ride")
    return _staged(
        s, service_day=F.col("service_day"), trip_id=F.col("trip_id"), operator=F.col("kind"), train_number=F.col("number"), category=F.col("category"), line=F.coalesce("line", "label"), station=F.col("eva"), stop_seq=F.col("pos"),
        sched_arr=F.when(F.col("arr_on"), F.col("sa")), sched_dep=F.when(F.col("go"), F.col("sd")), act_arr=F.when(F.col("arr_on"), F.col("ca")), act_dep=F.when(F.col("go"), F.col("cd")), arr_measured=F.col("arr_on") & F.col("ca").isNotNull(), dep_measured=F.col("go") & F.col("cd").isNotNull(),
    )


def active_days(calendar: DataFrame, exceptions: DataFrame, first: str, last: str) -> DataFrame:
    """service_id, day on which a service runs: the days of its period with their weekday's flag, less exceptions of type 2,
    with those of type 1. calendar: service_id, start, end (dates), weekdays (array of seven booleans, Monday first);
    exceptions: service_id, day, type. Days are made per service, bounded by [first, last]: no join of days with services."""
    lo, hi = F.greatest(F.col("start"), F.lit(first).cast("date")), F.least(F.col("end"), F.lit(last).cast("date"))
    days = F.when(lo <= hi, F.sequence(lo, hi))
    base = calendar.select("service_id", "weekdays", F.explode(days).alias("day")).filter(F.element_at("weekdays", F.weekday("day") + 1)).select("service_id", "day")
    off = exceptions.filter("type = 2").select("service_id", "day")
    on = exceptions.filter(F.col("type") == 1).filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select("service_id", "day")
    return base.join(off, ["service_id", "day"], "left_anti").unionByName(on).distinct()


def at_stops(runs: DataFrame, trips: DataFrame, stop_times: DataFrame, stations: DataFrame) -> DataFrame:
    """Observed runs laid over the timetable: runs (rid, num, service_day, t_a, a_a, t_b, a_b), trips (trip_id, service_day, num,
    label, prefix, operator, t0: the day's origin), stop_times (trip_id, seq, stop_id, arr_s, dep_s, passing), stations (ifopt,
    bpuic).

    Run and trip pair one to one by scheduled overlap; the delay observed at the ends is interpolated between them; a pair
    without a believable observation is not published. A departure is never before its arrival.
    """
    span = stop_times.groupBy("trip_id").agg(F.min("dep_s").alias("lo"), F.max("arr_s").alias("hi"))
    t = trips.join(span, "trip_id").withColumn("t_first", F.col("t0") + F.col("lo")).withColumn("t_last", F.col("t0") + F.col("hi"))
    key = lambda d: F.struct(d["num"], d["service_day"])
    left = runs.select(key(runs).alias("key"), F.col("rid").alias("id"), F.coalesce("t_a", "t_b").alias("start"), F.coalesce("t_b", "t_a").alias("end")).filter("start IS NOT NULL")
    right = t.select(key(t).alias("key"), F.struct("service_day", "trip_id").alias("id"), F.col("t_first").alias("start"), F.col("t_last").alias("end"))
    pairs = paired_by_overlap(left, right).select(F.col("left_id").alias("rid"), "right_id.service_day", "right_id.trip_id")
    obs = pairs.join(runs.select("rid", "t_a", (F.col("a_a") - F.col("t_a")).alias("d_a"), "t_b", (F.col("a_b") - F.col("t_b")).alias("d_b")), "rid").drop("rid")
    fine = lambda c: F.coalesce(F.col(c).between(-1200, 43_200), F.lit(False))
    one = _numbered(t.join(obs.filter(fine("d_a") | fine("d_b")), ["service_day", "trip_id"]).withColumnRenamed("trip_id", "tid"), F.col("label"), ["t_first", "tid"])
    st = one.join(stop_times.filter("NOT passing").withColumnRenamed("trip_id", "tid"), "tid")
    by = Window.partitionBy("service_day", "tid")
    st = st.withColumn("pos", F.row_number().over(by.orderBy("seq"))).withColumn("n", F.count(F.lit(1)).over(by)).withColumn("sa", F.col("t0") + F.col("arr_s")).withColumn("sd", F.col("t0") + F.col("dep_s"))
    late = lambda s: F.col(s) + interpolated_delay(F.col(s), F.col("t_a"), F.col("d_a"), F.col("t_b"), F.col("d_b"))
    place = F.coalesce(F.nullif(F.regexp_extract("stop_id", r"^([a-z]+:\d+:\d+)", 1), F.lit("")), F.col("stop_id"))
    st = st.withColumn("ifopt", place).join(stations.select("ifopt", "bpuic"), "ifopt", "left")
    inner, outer = F.col("pos") > 1, F.col("pos") < F.col("n")
    return _staged(
        st, service_day=F.col("service_day"), trip_id=F.col("trip_id"), operator=F.col("operator"), train_number=F.col("num"), category=F.coalesce("prefix", F.lit("OTHER")), line=F.col("label"), station=F.coalesce("bpuic", F.lit(-1)), stop_seq=F.col("pos"),
        sched_arr=F.when(inner, F.col("sa")), sched_dep=F.when(outer, F.col("sd")), act_arr=F.when(inner, late("sa")), act_dep=F.when(outer, F.greatest(late("sd"), F.when(inner, late("sa")))), arr_measured=inner, dep_measured=outer,
    )


def zero_stations(stops: DataFrame, least: int = 100, share: float = 0.99) -> DataFrame:
    """name of stations nearly all of whose delays (ra, rp, whole minutes) are 0: they do not measure."""
    d = stops.select("name", F.explode(F.array("ra", "rp")).alias("d")).filter(F.col("d").rlike("^-?[0-9]+$"))
    g = d.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") == "0").alias("z"))
    return g.filter((F.col("n") >= least) & (F.col("z") >= share * F.col("n"))).select("name")


def it_trains(trains: DataFrame) -> DataFrame:
    """Trains of a day, once each, with category, cancelled, trip_id and label; a cancelled copy of a number with another's
    very times is that source's error and no train.

    trains: service_day, tidx, source_id, number, c, sub, rp, ra, op, oa (epoch), cn, n_stops. Of equal source ids the one with
    more stops counts.
    """
    c = F.coalesce("c", F.lit(""))
    category = F.when(c.isin("", "ES*") & F.col("sub").isNotNull(), F.col("sub")).when(c == "", "NC").otherwise(F.col("c"))
    x = trains.withColumn("category", category).withColumn("cancelled", F.coalesce((F.col("rp") == "X") | (F.col("ra") == "X"), F.lit(False)))
    x = x.withColumn("_k", F.row_number().over(Window.partitionBy("service_day", "source_id").orderBy(F.desc("n_stops"), "tidx"))).filter("_k = 1").drop("_k")
    # another train of the number with the same times runs: no join of a number's trains with each other
    ran = F.max(~F.col("cancelled")).over(Window.partitionBy("service_day", "number", "op", "oa"))
    known = F.col("number").isNotNull() & F.col("op").isNotNull() & F.col("oa").isNotNull()
    x = x.withColumn("_ran", ran).filter(~(F.col("cancelled") & F.col("_ran") & known)).drop("_ran")
    return _numbered(x, F.concat_ws(" ", "category", "number"), ["op", "tidx"], ["category", "number"])


def it_stops(trains: DataFrame, stops: DataFrame, names: DataFrame, blind: DataFrame) -> DataFrame:
    """trains: see it_trains(); stops: service_day, tidx, seq, name, s_arr, s_dep (epoch, 0 for none), ra, rp (minutes of delay, N,
    S or n.d.); names: name, station, operational; blind: names that do not measure before IT_BLIND_UNTIL.

    Operational points drop and are joined across. A side exists unless marked N or S; its delay counts within IT_DELAY_MIN.
    An arrival at or before the departure from the stop before is not believed. A change of number shows in the line.
    """
    place = names.select("name", "station", "operational")
    no = blind.select("name", F.lit(True).alias("_blind"))
    s = stops.join(place, "name", "left").filter(~F.coalesce(F.col("operational"), F.lit(False))).join(no, "name", "left")
    old = F.coalesce("_blind", F.lit(False)) & (F.col("service_day") < F.lit(IT_BLIND_UNTIL))
    for k, d in (("arr", "ra"), ("dep", "rp")):
        t = F.nullif(F.col(f"s_{k}"), F.lit(0))
        s = s.withColumn(k, F.when(~F.col(d).isin("N", "S"), t)).withColumn(f"{k}_d", F.when(F.col(d).try_cast("int").between(*IT_DELAY_MIN) & ~old, F.col(d).try_cast("int")))
    # the whole train is cancelled: none of its stops counts
    t = it_trains(trains).filter("NOT cancelled").select("service_day", "tidx", "trip_id", "label", "number", "category", "cn")
    j = s.join(t, ["service_day", "tidx"])
    act = lambda k: F.col(k) + 60 * F.coalesce(F.col(f"{k}_d"), F.lit(0))
    ok = lambda k: F.col(k).isNotNull() & F.col(f"{k}_d").isNotNull()
    w = Window.partitionBy("service_day", "trip_id").orderBy("seq")
    wrong = F.coalesce(ok("arr") & F.lag(ok("dep")).over(w) & (act("arr") <= F.lag(act("dep")).over(w)), F.lit(False))
    j = j.withColumn("_wrong", wrong)
    also = F.array_join(F.transform(F.split("cn", ";"), lambda p: F.get(F.split(p, ","), 0)), "/")
    line = F.concat(F.col("label"), F.coalesce(F.concat(F.lit("/"), also), F.lit("")))
    return _staged(
        j, service_day=F.col("service_day"), trip_id=F.col("trip_id"), operator=F.lit(None).cast("string"), train_number=F.col("number"), category=F.col("category"), line=line, station=F.coalesce("station", unknown_station(F.col("name"))), stop_seq=F.col("seq"),
        sched_arr=F.col("arr"), sched_dep=F.col("dep"), act_arr=act("arr"), act_dep=act("dep"), arr_measured=ok("arr") & ~F.col("_wrong"), dep_measured=ok("dep"),
    )
