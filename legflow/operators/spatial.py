"""Points in regions by crossing parity in SQL, and points near points through it.

Polygon edges are binned into latitude strips (and, within a strip, into longitude bins), candidate points join by bin, and
the edges a ray from the point to the east crosses are counted per point and region: an odd count is inside.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
M_PER_DEG = math.radians(1) * EARTH_M
POLYGON_M, POLYGON_LAT = 5_000.0, 70.0  # circles up to this size and latitude fit into a polygon drawn 2 % too large


def great_circle_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in metres (haversine)."""
    s = lambda a: F.pow(F.sin(F.radians(a) / 2), F.lit(2))
    h = s(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s(lon2 - lon1)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def _strip(lat: Column, h: float) -> Column:
    return F.floor((lat + 90) / h).cast("int")


def _bin(lon: Column, strip: Column, h: float) -> Column:
    """Longitude bin in a strip; bins are as wide in metres as strips are high, so they widen towards the poles."""
    mid = F.least(F.abs(strip * h - 90), F.abs((strip + 1) * h - 90))
    width = F.least(F.lit(360.0), h / F.greatest(F.cos(F.radians(mid)), F.lit(1e-9)))
    return F.floor((lon + 540) / width).cast("int")


def has_position(lon: str = "lon", lat: str = "lat") -> Column:
    """True where a row has a usable position: not null, not NaN, in range, not 0/0."""
    x, y = F.col(lon), F.col(lat)
    return F.coalesce(x.between(-180, 180) & y.between(-90, 90) & ~((x == 0) & (y == 0)) & ~F.isnan(x) & ~F.isnan(y), F.lit(False))


def ring_edges(regions: DataFrame, region: str, ring: str) -> DataFrame:
    """Edges of rings: region, _copy, x0, y0, x1, y1, xmin.

    ring: array<struct<lon, lat>>, closed or not; longitudes may run past ±180 (a ring over the antimeridian). Such a ring
    gets a copy turned by 360° so that points are met on either side. Holes are further rows of the same region: parity
    leaves them out. Rings with under three corners or a null corner have no inside and give no edges.
    """
    r = regions.select(F.col(region).alias("_r"), F.col(ring).alias("_g")).filter((F.size("_g") >= 3) & ~F.exists("_g", lambda p: p["lon"].isNull() | p["lat"].isNull()))
    lons = F.transform("_g", lambda p: p["lon"])
    turns = F.filter(F.array(F.lit(0), F.when(F.array_max(lons) > 180, -360), F.when(F.array_min(lons) < -180, 360)), lambda x: x.isNotNull())
    nxt = F.concat(F.slice("_g", 2, F.greatest(F.size("_g") - 1, F.lit(1))), F.slice("_g", 1, 1))
    r = r.select("_r", F.explode(turns).alias("_copy"), F.array_min(lons).alias("_x"), F.arrays_zip(F.col("_g").alias("a"), nxt.alias("b")).alias("_e"))
    e = r.select("_r", "_copy", (F.col("_x") + F.col("_copy")).alias("xmin"), F.explode("_e").alias("e"))
    c = F.col("_copy")
    return e.select("_r", "_copy", "xmin", (F.col("e.a.lon") + c).alias("x0"), F.col("e.a.lat").alias("y0"), (F.col("e.b.lon") + c).alias("x1"), F.col("e.b.lat").alias("y1"))


def _side(x0: Column, y0: Column, x1: Column, y1: Column, x: Column, y: Column) -> Column:
    """1, 0 or -1: a point is to the left of the line from (x0, y0) to (x1, y1), on it, or to its right.

    The cross product in floating point decides where it is further from 0 than its rounding error; else it is worked out
    again in decimals of 14 places, so that coordinates that are written on a line are on it.
    """
    a, b = (x1 - x0) * (y - y0), (x - x0) * (y1 - y0)
    dec = lambda c: c.cast("decimal(17,14)")
    exact = (dec(x1) - dec(x0)) * (dec(y) - dec(y0)) - (dec(x) - dec(x0)) * (dec(y1) - dec(y0))
    sure = F.abs(a - b) > 1e-11 * (1 + F.abs(a) + F.abs(b))
    return F.when(sure, F.signum(a - b)).otherwise(F.signum(exact.cast("double"))).cast("int")


def points_in_regions(
    points: DataFrame, point: str, regions: DataFrame, region: str, ring: str, strip_deg: float, boundary: bool = True, lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """Distinct (point, region) pairs where the point lies in the region.

    strip_deg should be about the height of the smaller regions: an edge is copied to each strip it spans and each bin from
    its region's west end to its own east end. Corners: an edge holds its lower end and not its upper one, so a ray through
    a corner crosses once. Points on an edge are inside if `boundary`, else outside. Points without position are left out.
    """
    e = ring_edges(regions, region, ring)
    lo, hi = _strip(F.least("y0", "y1"), strip_deg), _strip(F.greatest("y0", "y1"), strip_deg)
    e = e.withColumn("_s", F.explode(F.sequence(lo, hi)))
    west, east = _bin(F.col("xmin"), F.col("_s"), strip_deg), _bin(F.greatest("x0", "x1"), F.col("_s"), strip_deg)
    e = e.withColumn("_b", F.explode(F.sequence(west, east)))
    p = points.filter(has_position(lon, lat)).select(F.col(point).alias("_p"), F.col(lon).cast("double").alias("_x"), F.col(lat).cast("double").alias("_y"))
    p = p.withColumn("_s", _strip(F.col("_y"), strip_deg)).withColumn("_b", _bin(F.col("_x"), F.col("_s"), strip_deg))
    x, y, x0, y0, x1, y1 = map(F.col, ("_x", "_y", "x0", "y0", "x1", "y1"))
    spans = (F.least(y0, y1) <= y) & (y < F.greatest(y0, y1))
    side = _side(x0, y0, x1, y1, x, y)
    up = F.when(y1 > y0, 1).otherwise(-1)
    on = (side == 0) & x.between(F.least(x0, x1), F.greatest(x0, x1)) & y.between(F.least(y0, y1), F.greatest(y0, y1))
    cross = spans & (side * up > 0)  # the edge lies to the east
    hits = p.join(e, ["_s", "_b"]).select("_p", "_r", "_copy", F.coalesce(cross, F.lit(False)).alias("c"), F.coalesce(on, F.lit(False)).alias("o")).filter("c OR o")
    g = hits.groupBy("_p", "_r", "_copy").agg(F.sum(F.col("c").cast("int")).alias("n"), F.max("o").alias("o"))
    inside = (F.col("n") % 2 == 1) & ~F.col("o")
    return g.filter(inside | F.col("o") if boundary else inside).select(F.col("_p").alias(point), F.col("_r").alias(region)).distinct()


def circle_ring(lon: Column, lat: Column, radius_m: float, corners: int = 6) -> Column:
    """Ring around the great circle of a point: no edge cuts the circle.

    Edges are straight in degrees and great circles are not, the more the larger and the nearer to a pole, so the polygon,
    drawn 2 % too large, serves circles under POLYGON_M below POLYGON_LAT; for others the ring is the band between the
    circle's latitudes over its longitudes, or over all of them when it holds a pole.
    """
    d = radius_m / math.cos(math.pi / corners) * 1.02 / EARTH_M
    la, lo = F.radians(lat), F.radians(lon)
    deg = math.degrees(d)
    half = F.when(F.abs(lat) + deg >= 89.999, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(d) / F.greatest(F.cos(la), F.lit(1e-12))))))
    top = F.when(half == 180, F.least(lat + deg, F.lit(90.0001))).otherwise(lat + deg)
    bottom = F.when(half == 180, F.greatest(lat - deg, F.lit(-90.0001))).otherwise(lat - deg)
    mid = F.when(half == 180, F.lit(0.0)).otherwise(lon)
    corner = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    band = F.array(corner(mid - half, bottom), corner(mid + half, bottom), corner(mid + half, top), corner(mid - half, top))
    if radius_m > POLYGON_M:
        return band
    ring = []
    for k in range(corners):
        b = 2 * math.pi * k / corners
        y = F.asin(F.sin(la) * math.cos(d) + F.cos(la) * math.sin(d) * math.cos(b))
        dx = F.atan2(math.sin(b) * math.sin(d) * F.cos(la), math.cos(d) - F.sin(la) * F.sin(y))
        ring.append(corner(F.degrees(lo + dx), F.degrees(y)))
    return F.when(F.abs(lat) > POLYGON_LAT, band).otherwise(F.array(*ring))


def near_pairs(points: DataFrame, key: str, radius_m: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Distinct pairs (key_a < key_b) of points at most radius_m apart.

    Each *position* (equal coordinates count once, so a heap of points at one place costs one) gets a ring around its
    circle; positions inside it come by crossing parity, the great-circle distance decides, and the members are joined
    back. Points without position and null keys are left out; a key with several positions pairs by any of them.
    """
    at = points.filter(has_position(lon, lat) & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat")).distinct()
    place = at.select(F.struct("lon", "lat").alias("_q"), "lon", "lat").distinct()
    rings = place.select(F.col("_q").alias("_c"), circle_ring(F.col("lon"), F.col("lat"), radius_m).alias("_ring"))
    h = 2.4 * radius_m / M_PER_DEG
    pairs = points_in_regions(place, "_q", rings, "_c", "_ring", h)
    pairs = pairs.filter((F.col("_q") <= F.col("_c")) & (great_circle_m(F.col("_q.lon"), F.col("_q.lat"), F.col("_c.lon"), F.col("_c.lat")) <= radius_m))
    m = at.select("_k", F.struct("lon", "lat").alias("_q"))
    both = pairs.join(m.withColumnRenamed("_k", "a"), "_q").join(m.select(F.col("_k").alias("b"), F.col("_q").alias("_c")), "_c")
    return both.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b")).distinct()


def nearest_within(points: DataFrame, key: str, targets: DataFrame, target: str, radius_m: float, most: int) -> DataFrame:
    """key, target, k, metres: each point's `most` nearest targets within radius_m (of equal distances the lesser first).

    Both have lon, lat. Cells a radius wide; a point looks into the nine around it. Only those within the radius are ranked.
    """
    cell = radius_m / M_PER_DEG
    wide = lambda r: cell / F.greatest(F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(r * cell), F.abs((r + 1) * cell))))), F.lit(1e-6))
    at = lambda d, k: d.filter(has_position() & F.col(k).isNotNull()).select(F.col(k).alias("_k"), "lon", "lat").distinct().withColumn("r", F.floor(F.col("lat") / cell))
    a = at(points, key).withColumn("r", F.explode(F.array(F.col("r") - 1, F.col("r"), F.col("r") + 1)))
    columns = F.greatest(F.lit(1), F.floor(360.0 / wide(F.col("r"))))
    own = F.floor(F.pmod(F.col("lon") + 180, F.lit(360.0)) / 360 * columns)
    a = a.withColumn("c", F.explode(F.array_distinct(F.array(*[F.pmod(own + i, columns) for i in (-1, 0, 1)]))))
    b = at(targets, target).withColumn("c", F.pmod(own, columns)).select(F.col("_k").alias("_t"), F.col("lon").alias("x"), F.col("lat").alias("y"), "r", "c")
    d = great_circle_m(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))
    x = a.join(b, ["r", "c"]).withColumn("metres", d).filter(F.col("metres") <= radius_m).groupBy("_k", "_t").agg(F.min("metres").alias("metres"))
    k = F.row_number().over(Window.partitionBy("_k").orderBy("metres", "_t"))
    return x.withColumn("k", k).filter(F.col("k") <= most).select(F.col("_k").alias(key), F.col("_t").alias(target), "k", "metres")
