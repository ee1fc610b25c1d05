import math
import random

from pyspark.sql import functions as F

from legflow.operators.spatial import near_pairs, points_in_regions

P = "id long, lon double, lat double, ring string, _s int"


def metres(a, b):
    la, lb = math.radians(a[2]), math.radians(b[2])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


def test_near_pairs_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for lon0, lat0 in ((8.0, 47.0), (179.999, 10.0), (20.0, 79.9), (20.0, 85.0), (0.0, 89.9985), (-70.0, -89.999), (0.0, 0.0), (12.0, -33.0)):
        k = 0.02 / max(0.02, math.cos(math.radians(lat0)))
        for _ in range(40):
            lon = (lon0 + r.uniform(-k, k) + 180) % 360 - 180
            rows.append((len(rows), lon, max(-90.0, min(90.0, lat0 + r.uniform(-0.01, 0.01)))))
    rows += [(900 + i, x, 89.9995) for i, x in enumerate((-170.0, -60.0, 10.0, 95.0, 179.0))]
    rows += [(1000, 0.0, 0.0), (1001, None, 5.0), (1002, float("nan"), 5.0), (None, 8.0, 47.0), (rows[0][0], rows[0][1], rows[0][2]), (1003, rows[0][1], rows[0][2])]
    got = {tuple(x) for x in near_pairs(spark.createDataFrame([(*x, "z", 1) for x in rows], P), "id", 300.0).collect()}
    ok = [x for x in rows if x[0] is not None and x[1] is not None and not math.isnan(x[1]) and not (x[1] == 0 and x[2] == 0)]
    want = {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(ok) for b in ok[:i] if a[0] != b[0] and metres(a, b) <= 300}
    assert got == want and len(want) > 100


def test_crossing_parity_with_holes_corners_and_edges(spark):
    ring = lambda *p: [{"lon": float(x), "lat": float(y)} for x, y in p]
    regions = spark.createDataFrame([("star", ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))), ("hole", ring((10, 0), (20, 0), (20, 10), (10, 10))), ("hole", ring((13, 3), (17, 3), (17, 7), (13, 7))), ("date", ring((178, -2), (184, -2), (184, 2), (178, 2))), ("thin", ring((0, 0), (1, 1)))], "name string, g array<struct<lon: double, lat: double>>")
    pts = [(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 2.0, 1.0), (4, 4.0, 2.0), (5, 15.0, 5.0), (6, 11.0, 5.0), (7, 11.0, 3.0), (8, -177.0, 0.0), (9, 179.0, 0.0), (10, -175.0, 0.0), (11, 0.5, 0.0), (12, None, 1.0)]
    p = spark.createDataFrame([(*x, "z", 0) for x in pts], P)
    got = {tuple(x) for x in points_in_regions(p, "id", regions, "name", "g", 1.0).collect()}
    assert got == {(1, "star"), (3, "star"), (4, "star"), (11, "star"), (6, "hole"), (7, "hole"), (8, "date"), (9, "date")}
    outside = {tuple(x) for x in points_in_regions(p, "id", regions, "name", "g", 1.0, boundary=False).collect()}
    assert got - outside == {(3, "star"), (4, "star"), (11, "star")}


def test_empty(spark):
    assert near_pairs(spark.createDataFrame([], P), "id", 300.0).count() == 0
    assert near_pairs(spark.createDataFrame([(1, None, None, "", 0)], P).withColumn("x", F.lit(1)), "id", 300.0).count() == 0


def test_points_written_on_an_edge_are_on_it(spark):
    """Corners and points in tenths: a float division would take many of them as off the edge."""
    r = random.Random(9)
    tri, pts = [], []
    for k in range(40):
        a, b = [(r.randint(-300, 300), r.randint(-300, 300)) for _ in range(2)]
        n = r.randint(2, 9)
        b = (a[0] + n * (b[0] // 10), a[1] + n * (b[1] // 10 or 1))
        on = (a[0] + (b[0] - a[0]) // n, a[1] + (b[1] - a[1]) // n)
        tri.append((f"t{k}", [{"lon": x / 10, "lat": y / 10} for x, y in (a, b, (a[0] + 701, a[1]))]))
        pts.append((k, on[0] / 10, on[1] / 10, "z", 0))
    regions = spark.createDataFrame(tri, "name string, g array<struct<lon: double, lat: double>>").filter("true")
    p = spark.createDataFrame([x for x in pts if (x[1], x[2]) != (0, 0)], P)
    pairs = lambda **k: {tuple(x) for x in points_in_regions(p, "id", regions, "name", "g", 5.0, **k).collect()}
    both, inner = pairs(), pairs(boundary=False)
    for k, x, y, *_ in pts:
        if (x, y) != (0, 0):
            assert (k, f"t{k}") in both and (k, f"t{k}") not in inner


def test_large_circles_near_the_pole_lose_no_pair(spark):
    r = random.Random(2)
    for lat0, radius in ((70.0, 500_000.0), (79.9, 200_000.0), (50.0, 4_900.0)):
        deg = 1.5 * radius / 111_195
        rows = [(i, (20 + r.uniform(-deg, deg) / math.cos(math.radians(lat0)) + 180) % 360 - 180, min(90.0, lat0 + r.uniform(-deg, deg))) for i in range(60)]
        got = {tuple(x) for x in near_pairs(spark.createDataFrame([(*x, "z", 1) for x in rows], P), "id", radius).collect()}
        assert got == {(b[0], a[0]) for i, a in enumerate(rows) for b in rows[:i] if metres(a, b) <= radius}
