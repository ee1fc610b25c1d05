import math
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from legflow.functions.zones import to_epoch
from legflow.operators import board as B
from legflow.operators import geometry as G
from legflow.operators import legs as L
from legflow.operators import links as K
from legflow.operators import staging as S

STOP = "service_day date, trip_id string, station long, seq int, sched_arr long, sched_dep long, act_arr long, act_dep long, arr_measured boolean, dep_measured boolean, category string, line string"
D = date(2018, 5, 3)


def hop(spark, dep, arr, **k):
    rows = [(D, "t", 1, 1, None, *dep, "c", None), (D, "t", 2, 2, *arr, "c", None)]
    rows = [(D, "t", 1, 1, None, dep[0], None, dep[1], False, dep[2], "c", None), (D, "t", 2, 2, arr[0], None, arr[1], None, arr[2], False, "c", None)]
    return L.hops(spark.createDataFrame(rows, STOP), [F.col("seq")], ["service_day", "trip_id"], **k)


def test_one_clock_per_leg(spark):
    measured = hop(spark, (28_800, 28_890, True), (30_600, 30_660, True)).first()
    assert (measured.t_dep, measured.dur, measured.delay, measured.measured) == (28_890, 1770, 90, True)
    planned = hop(spark, (28_800, 28_890, True), (30_600, 30_660, False)).first()
    assert (planned.t_dep, planned.dur, planned.delay, planned.measured) == (28_800, 1800, 90, False)


@pytest.mark.parametrize("dur, pieces", [(9000, [(3600, 0, 102), (3600, 102, 204), (1800, 204, 255)]), (3601, [(3600, 0, 254), (1, 254, 255)]), (3600, [(3600, 0, 255)])])
def test_long_hops_in_pieces(spark, dur, pieces):
    x = spark.createDataFrame([("t", 0, dur, None, True)], "trip_id string, t_dep long, dur long, delay long, measured boolean")
    got = L.split(x).orderBy("t_dep").collect()
    assert [(r.dur, r.route_start, r.route_end) for r in got] == pieces
    assert {r.flags for r in got} == ({6} if dur > 3600 else {0})


def test_verdicts_in_order(spark):
    dim = spark.createDataFrame([(1, 8.0, 47.0, "A", date(1900, 1, 1), date(9999, 12, 31)), (2, 8.0, 47.0, None, date(2020, 1, 1), date(9999, 12, 31)), (3, 12.0, 47.0, "A", date(1900, 1, 1), date(9999, 12, 31)), (4, 8.0, 47.0, "Z", date(1900, 1, 1), date(9999, 12, 31))], "station long, lon double, lat double, country string, valid_from date, valid_to date")
    rows = [(D, 1, 4, 0, 9, False), (D, 1, 1, None, 9, True), (D, 1, 1, 0, -1, True), (D, 1, 1, 0, 0, True), (D, 1, 9, 0, 90_000, True), (D, 1, 2, 0, 9, True), (D, 1, 3, 0, 9, True), (D, 1, 4, 0, 9, True), (D, 1, 1, 0, 9, True), (date(2021, 1, 1), 1, 2, 0, 9, True)]
    h = spark.createDataFrame(rows, "service_day date, from_station long, to_station long, t_dep long, dur long, runs boolean")
    got = [r.verdict for r in L.tagged(h.coalesce(1).withColumn("i", F.monotonically_increasing_id()), dim, L.Area(5.9, 45.8, 10.5, 47.9, ("A",))).orderBy("i").collect()]
    assert got == ["not_run", "missing_time", "negative_duration", "zero_duration", "absurd_duration", "unmatched_station", "outside_bbox", "outside_country", "ok", "ok"]


def test_registry_only_appends(spark):
    known = spark.createDataFrame([("b", 7)], "k string, id long")
    got = L.registry(known, spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string"), ["k"], "id", 20)
    assert {(r.k, r.id) for r in got.collect()} == {("b", 7), ("a", 8), ("c", 9), (None, 10)}
    with pytest.raises(ValueError):
        L.registry(known, spark.createDataFrame([("a",), ("c",)], "k string"), ["k"], "id", 8)


LEG = "leg_id long, service_day date, trip_id string, route_id int, from_bpuic long, to_bpuic long, t_dep long, dur int, type_id short, delay short, flags byte, route_start short, route_end short, line string"


def test_wire_round_trip_and_day_files(spark, tmp_path):
    rows = [(1, D, "a", 5, 1, 2, 86_390, 60, 3, -5, 0, 0, 255, "S 1"), (2, D, "a", 65_535, 2, 3, 86_460, 60, 3, 9, 3, 204, 255, "S 1"), (3, D, "b", 5, 1, 2, 86_400, 60, 255, 0, 1, 0, 102, None)]
    legs = spark.createDataFrame(rows, LEG)
    L.write_days(L.wire(legs), str(tmp_path / "d"))
    L.write_days(L.wire(legs.filter("leg_id > 1")), str(tmp_path / "d"))
    got = {(str(r.dep_day), r.journey_id, r.route_id, r.route_start, r.route_end, r.flags) for r in L.unwire(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got == {("1970-01-01", 0, 5, 0, 255, 0), ("1970-01-02", 0, 65_535, 204, 255, 7), ("1970-01-02", 1, 5, 0, 102, 5)}


def test_pairs_of_journeys_meet_in_narrow_ranges_of_time(spark):
    """Many journeys with one number on one day: only those near in time are put together, not each with each."""
    c = "day date, number string, journey string, pos int, last int, side string, station long, country string, lon double, lat double, t long"
    n = 60
    calls = lambda x, off: spark.createDataFrame([(D, "1", f"{x}{i:03d}", k, 1, ("dep", "arr")[k], None if i % 2 else 10 * i + k, "XX", 7.0 + 0.1 * k + 0.01 * off, 47.0, 6000 * i + 1200 * k + off) for i in range(n) for k in (0, 1)], c)
    got = K.linked_days(calls("a", 0), calls("b", 60))
    assert sorted({r.kind for r in got.select("kind").distinct().collect()}) == ["overlap"] and got.count() == n // 2
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert joins and all("_h" in x for x in joins)


def test_a_day_of_more_journeys_than_two_bytes_number(spark, tmp_path):
    n = 65_540
    cols = {"leg_id": F.col("id"), "service_day": F.lit(D), "trip_id": F.lpad(F.col("id").cast("string"), 6, "0"), "route_id": F.lit(5), "from_bpuic": F.lit(1), "to_bpuic": F.lit(2), "t_dep": F.lit(86_400) + F.col("id"), "dur": F.lit(60), "type_id": F.lit(3), "delay": F.lit(0), "flags": F.lit(0), "route_start": F.lit(0), "route_end": F.lit(255), "line": F.lit(None).cast("string")}
    legs = spark.range(n).select(*[c.alias(k) for k, c in cols.items()])
    L.write_days(L.wire(legs), str(tmp_path / "d"))
    x = spark.read.parquet(str(tmp_path / "d"))
    assert x.filter(F.col("journey_id") != F.col("t_dep") - 86_400).count() == 0 and x.agg(F.countDistinct("journey_id")).first()[0] == n


def test_positions(spark):
    rows = [(1, D, "a", 5, 1, 2, 1000, 100, 0, 0, 0, 0, 255, None), (2, D, "a", 6, 2, 3, 1200, 100, 0, 0, 0, 0, 255, None)]
    legs = spark.createDataFrame(rows, LEG)
    at = lambda t: [(r.state, r.leg_id, r.fraction, r.opacity) for r in B.positioned(legs, t).collect()]
    assert at(1050) == [("moving", 1, 0.5, 1.0)] and at(1150) == [("dwelling", 1, 1.0, 1.0)]
    assert at(1300) == [("moving", 2, 1.0, 1.0)] and at(1750) == [("arriving", 2, 1.0, 0.5)] and at(2300) == []
    assert at(550) == [("waiting", 1, 0.0, 0.5)] and at(50) == []


def test_clock_rules(spark):
    rows = [("2025-10-26 02:30:00", 1_761_442_200), ("2025-03-30 02:30:00", 1_743_298_200), ("2025-07-01 12:00:00", 1_751_364_000)]
    got = [r[0] for r in spark.createDataFrame(rows, "l string, e long").select(to_epoch(F.col("l").cast("timestamp"), "Europe/Zurich")).collect()]
    assert got == [e for _, e in rows]


def test_delay_between_two_ends(spark):
    x = spark.createDataFrame([(150, 100, 60, 200, 180), (50, 100, 60, 200, 180), (150, 100, -9000, 200, 180), (150, 100, None, 200, None), (101, 100, 0, 104, 2)], "s long, ta long, da long, tb long, db long")
    assert [r[0] for r in x.select(S.interpolated_delay(*map(F.col, ("s", "ta", "da", "tb", "db")))).collect()] == [120, 60, 180, None, 1]


def test_mutual_first_choice(spark):
    k = "key string, id string, start long, end long"
    got = S.paired_by_overlap(spark.createDataFrame([("1", "r1", 0, 100), ("1", "r2", 10, 100), ("2", "r3", 0, 10)], k), spark.createDataFrame([("1", "t1", 0, 100), ("2", "t2", 900, 950), ("3", "t3", 0, 9)], k))
    assert {tuple(r) for r in got.collect()} == {("r1", "t1", 100), ("r3", "t2", -890)}


def test_components_and_greedy_ends(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)]
    top = {}
    find = lambda x: x if top.setdefault(x, x) == x else find(top[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    got = {t.node: t.component for t in K.components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {n: find(n) for e in edges for n in e}
    links = [(D, f"a{r.randrange(12)}", f"b{r.randrange(12)}", r.choice(K.ORDER), r.randrange(5)) for _ in range(60)]
    taken, ua, ub = set(), set(), set()
    for x in sorted(set(links), key=lambda x: (K.ORDER.index(x[3]), x[4], x[1], x[2])):
        if x[1] not in ua and x[2] not in ub:
            taken.add(x)
            ua.add(x[1])
            ub.add(x[2])
    out = K.one_per_end(spark.createDataFrame(links, "day date, journey_a string, journey_b string, kind string, dur int"))
    assert {tuple(x) for x in out.collect()} == taken


def test_judged_pairs(spark):
    c = "day date, number string, journey string, pos int, last int, side string, station string, country string, lon double, lat double, t long"
    call = lambda n, j, p, last, side, st, lon, t: (D, n, j, p, last, side, st, "X", lon, 47.0, t)
    a = [call("1", "a1", 0, 1, "dep", None, 7.0, 0), call("1", "a1", 1, 1, "arr", "S", 7.5, 1000), call("2", "a2", 0, 1, "dep", None, 7.0, 0), call("2", "a2", 1, 1, "arr", None, 7.5, 1000), call("3", "a3", 0, 1, "dep", "S", 7.0, 0), call("3", "a3", 1, 1, "arr", "U", 7.5, 1000)]
    b = [call("1", "b1", 0, 1, "dep", "S", 7.5, 1200), call("1", "b1", 1, 1, "arr", None, 8.0, 2000), call("2", "b2", 0, 1, "dep", None, 7.8, 2500), call("2", "b2", 1, 1, "arr", None, 8.0, 3000), call("3", "b3", 0, 1, "dep", "S", 7.0, 10), call("3", "b3", 1, 1, "arr", None, 8.0, 1500)]
    got = {(r.journey_a, r.kind, r.dur) for r in K.judged(spark.createDataFrame(a, c), spark.createDataFrame(b, c)).collect()}
    assert got == {("a1", "handover", None), ("a2", "bridge", 1500), ("a3", "overlap", None)}


def test_routes_over_a_small_graph(spark):
    nodes = [(1, 8.0, 47.0), (2, 8.1, 47.0), (3, 8.1, 47.1), (4, 8.2, 47.1), (9, 9.0, 48.0)]
    st = [(10, 8.0, 47.0005), (11, 8.2, 47.1), (12, 9.0, 48.0), (13, 3.0, 40.0)]
    got = {r.route_id: r for r in G.routed(spark.createDataFrame([(1, 10, 11), (2, 10, 12), (3, 13, 10), (4, 11, 10)], "route_id long, from_station long, to_station long"), spark.createDataFrame(st, "station long, lon double, lat double"), spark.createDataFrame(nodes, "node long, lon double, lat double"), spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "u long, v long")).collect()}
    assert got[1].reason is None and len(got[1].line) == 5 and abs(got[1].metres - got[4].metres) < 1e-6
    assert (got[2].reason, got[3].reason) == ("unreachable", "unsnappable") and len(got[2].line) == 2
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]), (2, [(5.0, 5.0)])], "route_id long, line array<struct<lon: double, lat: double>>")
    p = {(r.route_id, r.fraction): (round(r.lon, 3), round(r.lat, 3), r.bearing and round(r.bearing)) for r in G.along(lines, spark.createDataFrame([(1, 0.0), (1, 0.25), (1, 1.0), (1, 2.0), (2, 0.5)], "route_id long, fraction double")).collect()}
    assert p[1, 0.25] == (0.5, 0.0, 90) and p[1, 1.0] == (1.0, 1.0, 0) == p[1, 2.0] and p[2, 0.5] == (5.0, 5.0, None)
    zig = np.array([(x, 20 * (x % 2)) for x in range(0, 100)], dtype=float)
    assert len(G.simplified(zig, 25.0)) == 2 and len(G.simplified(zig, 1.0)) == 100 and math.isclose(1, 1)


def test_runs_and_trips_within_an_hour(spark, tmp_path):
    from legflow.plans.board_queries import lnk05_one_per_end

    at = 1_515_571_200  # a full hour
    runs = [(1, "R 07", at - 60, None), (2, "8", (at - 60) * 1000, None), (3, "9", None, at + 60), (4, "10", at - 60, None), (5, "11", at - 1800, None), (6, "x", at, at)]
    trips = [("a", "7", at + 60, at + 9000), ("b", "8", at + 60, at + 9000), ("c", "9", at - 9000, at - 60), ("d", "10", at + 3541, at + 9000), ("e", "11", at + 1800, None), ("f", "y", at, at)]
    spark.createDataFrame(runs, "rid long, num string, t_a long, t_b long").write.parquet(f"{tmp_path}/at_runs.parquet")
    spark.createDataFrame(trips, "trip_id string, num string, t_first long, t_last long").write.parquet(f"{tmp_path}/at_trips.parquet")
    got = {(x.journey_a, x.journey_b, x.dur) for x in lnk05_one_per_end(spark, str(tmp_path)).collect()}
    assert got == {("1", "a", 120), ("2", "b", 120), ("3", "c", 120), ("5", "e", 3600)}
