"""Stages, links, dimensions and publishing on small literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from legflow.operators import board, dims, legs, links, publish, staging
from legflow.operators import stages as G
from legflow.sources import files


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_swiss_rows_in_two_notations(spark):
    names = "BETRIEBSTAG FAHRT_BEZEICHNER BETREIBER_ABK PRODUKT_ID VERKEHRSMITTEL_TEXT FAELLT_AUS_TF BPUIC ANKUNFTSZEIT ABFAHRTSZEIT AN_PROGNOSE AN_PROGNOSE_STATUS AB_PROGNOSE AB_PROGNOSE_STATUS LINIEN_TEXT".split()
    row = lambda **k: tuple({"BETRIEBSTAG": "03.05.2018", "FAHRT_BEZEICHNER": "t", "PRODUKT_ID": "Zug", "BPUIC": "1"}.get(n) if n not in k else k[n] for n in names)
    data = [row(ABFAHRTSZEIT="03.05.2018 08:00", AB_PROGNOSE="03.05.2018 08:01:30", AB_PROGNOSE_STATUS="REAL"), row(FAHRT_BEZEICHNER="g", ABFAHRTSZEIT="3.5.2018 8:00", AB_PROGNOSE="x", AB_PROGNOSE_STATUS="GESCHAETZT", LINIEN_TEXT=" "), row(PRODUKT_ID="Bus"), row(FAELLT_AUS_TF="TRUE"), row(PRODUKT_ID=None)]
    got = rows(G.ist_rows(spark.createDataFrame(data, ", ".join(f"{n} string" for n in names))), "trip_id", "sched_dep", "act_dep", "dep_measured", "line")
    assert got == [("g", 1525327200, None, False, None), ("t", 1525327200, 1525327290, True, None)]


def test_dutch_services(spark):
    names = [f"Service:{n}" for n in ("RDT-ID", "Date", "Type", "Company", "Train number", "Completely cancelled")] + [f"Stop:{n}" for n in ("RDT-ID", "Station code", "Arrival time", "Arrival delay", "Arrival cancelled", "Departure time", "Departure delay", "Departure cancelled")]
    t = lambda m: f"2023-03-01T10:{m:02d}:00+01:00"
    svc = lambda i, no, stops, kind="Intercity", off="false": [(str(i), "2023-03-01", kind, "NS", no, off, str(i * 10 + k), c, *x) for k, (c, *x) in enumerate(stops)]
    mid = [("A", None, None, "false", t(0), "2", "false"), ("B", t(10), "1", "true", t(11), "0", "true"), ("C", t(20), None, "false", None, None, "false")]
    data = svc(1, "5", mid) + svc(2, "5", mid)  # the second is a copy
    data += svc(3, "5", [("X", None, None, "false", t(1), "0", "false"), ("Y", t(9), "4", "false", None, None, "false")])
    data += svc(4, "6", [("A", None, None, "false", t(30), "0", "false"), ("B", t(20), "0", "false", None, None, "false")])  # back in time
    data += svc(5, "7", mid, "Snelbus i.p.v. trein") + svc(6, "8", [("Q", None, None, "false", t(40), "0", "false"), ("R", t(50), "0", "false", None, None, "false")], off="true")
    df = spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names))
    stops = G.nl_stops(df, spark.createDataFrame([("A", 1), ("C", 3), ("X", 7), ("Y", 8)], "code string, bpuic bigint"))
    base = 1677661200
    assert rows(stops, "trip_id", "station", "sched_arr", "act_arr", "sched_dep", "act_dep", "arr_measured") == [
        ("IC 5 #2", 7, None, None, base + 60, base + 60, False), ("IC 5 #2", 8, base + 540, base + 780, None, None, True), ("IC 5", 1, None, None, base, base + 120, False), ("IC 5", 3, base + 1200, None, None, None, False),
    ]
    assert G.nl_stops(df.limit(0), spark.createDataFrame([], "code string, bpuic bigint")).count() == 0


def test_timetable_days(spark):
    cal = spark.createDataFrame([(1, "2024-01-01", "2024-01-10", [True] * 5 + [False] * 2), (2, "2024-01-05", "2024-01-01", [True] * 7)], "service_id int, start string, end string, weekdays array<boolean>").withColumn("start", F.col("start").cast("date")).withColumn("end", F.col("end").cast("date"))
    ex = spark.createDataFrame([(1, "2024-01-02", 2), (1, "2024-01-06", 1), (9, "2024-01-03", 1), (9, "2024-05-03", 1), (1, "2024-01-03", 1)], "service_id int, day string, type int").withColumn("day", F.col("day").cast("date"))
    got = [(r.service_id, r.day.day) for r in G.active_days(cal, ex, "2024-01-01", "2024-01-07").orderBy("service_id", "day").collect()]
    assert got == [(1, 1), (1, 3), (1, 4), (1, 5), (1, 6), (9, 3)]


def test_long_intervals_cost_only_their_ranges(spark):
    s = "key string, id string, start long, end long"
    left = spark.createDataFrame([("a", "l1", 0, 10**6), ("c", "l2", 5000, 6000), ("b", "l3", 100, 50)], s)
    right = spark.createDataFrame([("a", "r1", 400_000, 900_000), ("c", "r2", 6500, 7000), ("b", "r3", 800, 900)], s)
    assert rows(staging.paired_by_overlap(left, right), "left_id", "right_id", "overlap") == [("l1", "r1", 500_000), ("l2", "r2", -500), ("l3", "r3", -750)]


def calls(spark, *journeys):
    out = []
    for day, number, j, country, stops in journeys:
        out += [(day, number, j, i, len(stops) - 1, side, st, country, lon, 47.0, t) for i, (side, st, lon, t) in enumerate(stops)]
    return spark.createDataFrame(out, "day string, number string, journey string, pos int, last int, side string, station long, country string, lon double, lat double, t long").withColumn("day", F.col("day").cast("date"))


def test_links_of_journeys(spark):
    d, t = "1970-01-02", 86_400
    one = lambda n, j, c, *s: (d, n, j, c, list(s))
    first = calls(spark, *[one(n, f"a{n}", "DE", ("dep", None, 7.0, t), ("arr", g, 7.5, t + 1200)) for n, g in (("1", None), ("2", 50), ("3", None), ("4", None), ("5", 60))])
    go = lambda lon0, lon1, start, g=None: (("dep", g, lon0, t + start), ("arr", None, lon1, t + start + 900))
    second = calls(spark, one("1", "b1", "CH", *go(7.7, 8.0, 2400)), one("2", "b2", "CH", *go(7.5, 8.0, 1500, 50)), one("3", "b3", "CH", *go(7.7, 7.3, 2400)), one("4", "b4", "FR", *go(7.7, 8.0, 2400)), one("5", "b5", "CH", *go(7.7, 8.0, 2400)))
    seen = spark.createDataFrame([(60,)], "station long")
    got = rows(links.judged(first, second, ("DE", "CH"), seen), "number", "kind", "dur")
    assert got == [("1", "bridge", 1200), ("2", "handover", None)]  # 3 turns back, 4 starts in another country, 5 ends where the other side stops too
    both = rows(links.linked_days(first, second, ("DE", "CH")), "from_side", "number", "kind")
    assert both == [("a", "1", "bridge"), ("a", "2", "handover"), ("a", "5", "bridge")]


def test_nearest_goes_on_to_wider_cells(spark):
    p = spark.createDataFrame([(1, 0.1, 0.1), (2, 179.9, 10.0), (3, 20.0, 89.9)], "id int, lon double, lat double")
    t = spark.createDataFrame([(0.1, 0.2), (-179.9, 10.0), (100.0, 60.0)], "lon double, lat double")
    got = {r.id: r.metres for r in links.nearest_of(p, t, 2000.0).collect()}
    assert abs(got[1] - 11_119.5) < 1 and abs(got[2] - 21_900) < 30 and 3.2e6 < got[3] < 3.4e6
    assert links.nearest_of(p.limit(0), t).count() == 0


def test_names_give_up_the_worst_position_first(spark):
    a = spark.createDataFrame([("A", 1, 8.0, 47.0), ("B", 1, 30.0, 60.0), ("B", 2, 8.1, 47.0), ("C", 1, 8.2, 47.0), ("D", 1, 8.3, 47.0), ("E", 1, None, 47.0)], "name string, layer int, lon double, lat double")
    c = spark.createDataFrame([("A", "B", "C", 5), ("B", "C", "D", 5), (None, "A", "B", 5), ("C", "D", None, 5)], "before string, name string, after string, n int")
    best, gone = dims.resolved_names(a, c)
    assert rows(best, "name", "layer") == [("A", 1), ("B", 2), ("C", 1), ("D", 1)] and rows(gone, "name", "layer") == [("B", 1)]


def test_keys_and_ids(spark):
    with pytest.raises(ValueError, match="code x stands 2 times"):
        dims.checked(spark.createDataFrame([(1, "x"), (2, "x")], "k int, code string"), "k", "code")
    r = spark.createDataFrame([("at:44:49",), ("de:1:2",), ("at:1:200000",)], "i string").select("i", dims.place_number(F.col("i")).alias("n")).collect()
    assert r[0].n == 4_400_049 and r[1].n > 10**10 and r[2].n > 10**10
    known = spark.createDataFrame([("a", "b", 1), ("a", "c", 2)], "f string, t string, id long")
    ok = legs.seeded(known, spark.createDataFrame([("a", "b", 1), ("x", "y", 7)], "f string, t string, id long"), ["f", "t"], "id")
    assert rows(ok, "f", "t", "id") == [("a", "b", 1), ("a", "c", 2), ("x", "y", 7)]
    for bad in (("a", "b", 5), ("q", "r", 2)):
        with pytest.raises(ValueError):
            legs.seeded(known, spark.createDataFrame([bad], "f string, t string, id long"), ["f", "t"], "id")


LEG = "leg_id long, service_day date, trip_id string, route_id int, from_bpuic long, to_bpuic long, t_dep long, dur int, type_id int, delay int, flags int, route_start int, route_end int, line string"


def leg(spark, *xs):
    import datetime

    return spark.createDataFrame([(i, datetime.date(1970, 1, 1 + t // 86_400), f"t{i}", r, 1, 2, t, 60, 1, 0, 0, a, b, None) for i, (t, r, a, b) in enumerate(xs)], LEG)


def test_wire_ids_that_do_not_fit_raise(spark):
    assert legs.wire(leg(spark, (5, 70_000, 0, 255))).collect()[0].route_id == 70_000
    with pytest.raises(Exception, match="passes 65535"):
        legs.wire(leg(spark, (5, 70_000, 0, 102))).collect()


def test_publishing(spark, tmp_path):
    x = leg(spark, *[(86_400 * d + k, 3, 0, 255) for d, n in ((0, 5), (1, 2), (2, 5)) for k in range(n)])
    said = spark.createDataFrame([("1970-01-02", 10, 6)], "service_day string, trains int, cancelled int").withColumn("service_day", F.col("service_day").cast("date"))
    thin = publish.publish_days(x, said, str(tmp_path / "p"), floor=4)
    assert rows(thin, "legs", "verdict") == [(2, "explained")]
    assert spark.read.parquet(str(tmp_path / "p/legs")).count() == 12 and spark.read.parquet(str(tmp_path / "p/journeys")).count() == 12
    with pytest.raises(ValueError, match="1970-01-02"):
        publish.publish_days(x, said.limit(0), str(tmp_path / "q"), floor=4)
    assert not (tmp_path / "q").exists()
    days = spark.createDataFrame([("1970-01-01", 5)], "dep_day string, legs long").withColumn("dep_day", F.col("dep_day").cast("date"))
    m = publish.dataset_manifest("ch", days, ("1970-01-01", "1970-01-03"))
    assert m["missing_days"] == ["1970-01-02", "1970-01-03"]
    with pytest.raises(ValueError, match="outside"):
        publish.dataset_manifest("ch", days, ("1970-01-02", "1970-01-03"))
    assert list(publish.catalog({"ch": m}, {"datasets": {"de": 1}, "links": 2})["datasets"]) == ["ch", "de"]
    with pytest.raises(ValueError, match="another schema"):
        publish.carried_days(days, spark.createDataFrame([("1970-02-01", 5, 1)], "dep_day string, legs long, schema int").withColumn("dep_day", F.col("dep_day").cast("date")))
    publish.write_dictionary(spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string"), "k", ["v"], str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == {"1": "a", "2": "b"}


def test_a_failed_replacement_leaves_the_old_rows(spark, tmp_path):
    at = str(tmp_path / "f")
    publish.replaced(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), at, "p")
    bad = spark.createDataFrame([(0, "a")], "v int, p string").withColumn("v", F.when(F.col("v") == 0, F.raise_error(F.lit("no"))).otherwise(F.col("v")).cast("int"))
    with pytest.raises(Exception, match="no"):
        publish.replaced(bad, at, "p")
    publish.replaced(spark.createDataFrame([(9, "b")], "v int, p string"), at, "p")
    assert rows(spark.read.parquet(at), "v", "p") == [(1, "a"), (9, "b")]


def test_strict_day_files(spark, tmp_path):
    f = tmp_path / "d.json"
    day = {"giorno": "2023-05-01", "treni": [{"_id": "1", "n": "9", "rp": "0", "ra": "X", "fr": [{"n": "Roma", "ra": "n.d.", "rp": "-3", "op": 5}]}, {"_id": "2", "n": "8"}]}
    f.write_text(json.dumps(day, indent=1))
    trains, got = files.italian_day(spark, [str(f)])
    assert rows(trains, "source_id", "ra", "n_stops") == [("1", "X", 1), ("2", None, 0)] and rows(got, "name", "ra", "s_dep") == [("Roma", "n.d.", 5)]
    for k, v in (("zz", "1"), ("ra", "soon")):
        f.write_text(json.dumps({**day, "treni": [{"_id": "1", k: v}]}))
        with pytest.raises(Exception, match="unknown"):
            files.italian_day(spark, [str(f)])[0].collect()


def test_small_readers(spark, tmp_path):
    assert files.months_for("2024-01-01", "2024-01-30") == ["2023-12", "2024-01", "2024-02"]
    with pytest.raises(FileNotFoundError):
        files.gtfs(spark, str(tmp_path), "trips", ["a"])
    m = spark.createDataFrame([("a/", 9, "x"), ("f", 0, "x"), ("f", 5, "y"), ("f", 7, "z")], "name string, size long, path string")
    assert rows(files.largest_members(m), "name", "path") == [("f", "z")]


def test_an_empty_search_finds_nothing_and_blanks_do_not_matter(spark):
    x = leg(spark, (5, 3, 0, 255)).withColumn("trip_id", F.lit("RJX 20"))
    assert board.search(x, "  ", 5).count() == 0
    assert [r["rank"] for r in board.search(x, "rjx20", 5).collect()] == [1]


def test_repeated_calls_are_one(spark):
    x = spark.createDataFrame([(1, 0, "A", 5), (1, 1, "A", 9), (1, 2, "B", 12), (1, 3, None, 13), (1, 4, None, 14)], "r int, i int, tpl string, dep int")
    assert rows(staging.merged_calls(x, ["r"], "i", "tpl", ["dep"]), "seq", "tpl", "dep") == [(1, "A", 9), (2, "B", 12), (3, None, 13)]
