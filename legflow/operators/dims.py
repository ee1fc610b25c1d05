"""Station dimensions of several sources in one shape: bpuic, name, code, lon, lat, passenger, country, valid_from, valid_to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legflow.operators.spatial import M_PER_DEG, great_circle_m, has_position
from legflow.operators.stages import local_station
from legflow.operators.staging import code_number
from legflow.runtime import cut

DIM = ("bpuic", "name", "code", "lon", "lat", "passenger", "country", "valid_from", "valid_to")
BE_BOARDING = ("Station", "Stop in open track")  # fixed values: classes of points where passengers board


def always(rows: DataFrame) -> DataFrame:
    """Rows valid for all time, in the dimension's shape; columns they lack are null."""
    have = {"valid_from": F.lit("1900-01-01").cast("date"), "valid_to": F.lit("9999-12-31").cast("date"), "passenger": F.lit(True)} | {c: F.col(c) for c in rows.columns}
    kinds = {"bpuic": "bigint", "lon": "double", "lat": "double", "passenger": "boolean", "valid_from": "date", "valid_to": "date"}
    return rows.select(*[have.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in DIM])


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """key, value, n of values that stand more than once in a key column: a list that is no key."""
    out = None
    for k in keys:
        x = rows.groupBy(F.col(k).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(k).alias("key"), "value", "n")
        out = x if out is None else out.unionByName(x)
    return out


def checked(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows; raises if one of the columns is no key of them."""
    bad = repeated_keys(rows, *keys).first()
    if bad is not None:
        raise ValueError(f"{bad.key} {bad.value} stands {bad.n} times")
    return rows


def fi_stations(meta: DataFrame) -> DataFrame:
    """Metadata (countryCode, stationUICCode, stationName, stationShortCode, longitude, latitude, passengerTraffic)."""
    return always(checked(meta.select(
        local_station(F.col("countryCode"), F.col("stationUICCode")).alias("bpuic"), F.col("stationName").alias("name"), F.col("stationShortCode").alias("code"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), F.col("passengerTraffic").alias("passenger"), F.col("countryCode").alias("country"),
    ), "bpuic"))


def nl_stations(rows: DataFrame) -> DataFrame:
    """A station list (uic, name_long, code, geo_lng, geo_lat, country, all text), one to one by uic and by code."""
    x = rows.select(F.col("uic").cast("bigint").alias("bpuic"), F.col("name_long").alias("name"), "code", F.col("geo_lng").cast("double").alias("lon"), F.col("geo_lat").cast("double").alias("lat"), "country")
    return always(checked(x, "bpuic", "code"))


def be_stations(rows: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """Points (ptcarid, commerciallongnamefrench, commerciallongnamedutch, symbolicname, geo_point_2d, class_en) with both names
    where they differ; closed: bpuic, name, code, lon, lat of stops the list no longer has."""
    fr, nl, at = F.col("commerciallongnamefrench"), F.col("commerciallongnamedutch"), F.split("geo_point_2d", ",")
    x = rows.filter("geo_point_2d IS NOT NULL").select(
        F.col("ptcarid").cast("bigint").alias("bpuic"), F.when((fr == nl) | nl.isNull(), fr).otherwise(F.concat(fr, F.lit(" / "), nl)).alias("name"), F.col("symbolicname").alias("code"),
        F.trim(F.get(at, 1)).cast("double").alias("lon"), F.trim(F.get(at, 0)).cast("double").alias("lat"), F.col("class_en").isin(*BE_BOARDING).alias("passenger"), F.lit("BE").alias("country"),
    )
    if closed is not None:
        old = closed.join(x, "bpuic", "left_anti").select("bpuic", "name", "code", "lon", "lat", F.lit(True).alias("passenger"), F.lit("BE").alias("country"))
        x = x.unionByName(old)
    return always(checked(x, "bpuic"))


def stop_place(stop_id: Column) -> Column:
    """The stop place of a stop id: its first three parts, a `P` before them apart; other ids as they are."""
    s = F.regexp_replace(stop_id, "^P", "")
    return F.coalesce(F.nullif(F.regexp_extract(s, r"^([a-z]+:\d+:\d+)", 1), F.lit("")), s)


def place_number(ifopt: Column) -> Column:
    """A stop place's number: region and number of Austrian ones, a checksum above all of them for others."""
    p = r"^at:(\d+):(\d+)$"
    n = F.regexp_extract(ifopt, p, 2).try_cast("bigint")
    own = F.regexp_extract(ifopt, p, 1).try_cast("bigint") * 100_000 + n
    return F.when(ifopt.rlike(p) & (n < 100_000), own).otherwise(F.lit(10_000_000_000) + F.crc32(ifopt.cast("binary")))


def at_stations(stops: DataFrame) -> DataFrame:
    """Stop rows (stop_id, stop_name, stop_lon, stop_lat, location_type, all text) as stop places; a parent row's own name and
    position count before the mean of the others. Also has `ifopt`."""
    x = stops.withColumn("ifopt", stop_place(F.col("stop_id"))).withColumn("_p", F.coalesce(F.col("location_type") == "1", F.lit(False)))
    own = lambda f, c: F.coalesce(f(F.when(F.col("_p"), c)), f(c))
    g = x.groupBy("ifopt").agg(own(F.min, F.col("stop_name")).alias("name"), own(F.avg, F.col("stop_lon").try_cast("double")).alias("lon"), own(F.avg, F.col("stop_lat").try_cast("double")).alias("lat"))
    g = g.withColumn("bpuic", place_number(F.col("ifopt"))).withColumn("country", F.upper(F.get(F.split("ifopt", ":"), 0)))
    checked(g, "bpuic")
    return always(g).join(g.select("bpuic", "ifopt"), "bpuic")


def gb_stations(points: DataFrame, aliases: dict[str, str], moved: dict[str, tuple[float, float]], reach_m: float = 20_000.0) -> DataFrame:
    """Rail points (ATCOCode, CommonName, StopType, Easting, Northing, Longitude, Latitude, all text) by location code.

    A point without longitude is placed from the nearest one with both, by the offset of their grid references. aliases:
    codes that are copies of another's station; moved: positions measured elsewhere. Points meet in cells of the grid, in
    wider ones where nothing is near.
    """
    x = points.filter((F.col("StopType") == "RLY") & F.col("ATCOCode").startswith("9100"))
    num = lambda c: F.col(c).try_cast("double")
    x = cut(x.select(F.substring("ATCOCode", 5, 100).alias("code"), F.regexp_replace("CommonName", " Rail Station$", "").alias("name"), num("Easting").alias("e"), num("Northing").alias("n"), num("Longitude").alias("lon"), num("Latitude").alias("lat")))
    known, left, placed = x.filter("lon IS NOT NULL AND lat IS NOT NULL"), cut(x.filter("(lon IS NULL OR lat IS NULL) AND e IS NOT NULL AND n IS NOT NULL")), None
    width = reach_m
    while not left.isEmpty():
        cell = lambda c: F.floor(F.col(c) / width)
        three = lambda c: F.explode(F.array(cell(c) - 1, cell(c), cell(c) + 1))
        a = left.select("code", "name", "e", "n", three("e").alias("i")).withColumn("j", three("n"))
        b = known.filter("e IS NOT NULL AND n IS NOT NULL").select(cell("e").alias("i"), cell("n").alias("j"), F.col("e").alias("re"), F.col("n").alias("rn"), F.col("lon").alias("rl"), F.col("lat").alias("rt"), F.col("code").alias("rc"))
        d2 = F.pow(F.col("e") - F.col("re"), F.lit(2)) + F.pow(F.col("n") - F.col("rn"), F.lit(2))
        best = F.min(F.struct(d2.alias("d"), "rc", "re", "rn", "rl", "rt")).alias("r")
        near = a.join(b, ["i", "j"]).groupBy("code", "name", "e", "n").agg(best)
        near = cut(near if width > 4e6 else near.filter(F.col("r.d") <= width * width))
        here = near.select("code", "name", (F.col("r.rl") + (F.col("e") - F.col("r.re")) / (111_320 * F.cos(F.radians("r.rt")))).alias("lon"), (F.col("r.rt") + (F.col("n") - F.col("r.rn")) / 111_320).alias("lat"))
        placed = here if placed is None else placed.unionByName(here)
        if width > 4e6:
            break
        left, width = cut(left.join(near.select("code"), "code", "left_anti")), width * 8
    s = known.select("code", "name", "lon", "lat")
    s = s.unionByName(placed) if placed is not None else s
    spark = points.sparkSession
    if aliases:
        a = spark.createDataFrame(sorted(aliases.items()), "alias string, code string")
        s = s.unionByName(s.join(F.broadcast(a), "code").select(F.col("alias").alias("code"), "name", "lon", "lat"))
    if moved:
        m = spark.createDataFrame([(k, *v) for k, v in sorted(moved.items())], "code string, x double, y double")
        s = s.join(F.broadcast(m), "code", "left").select("code", "name", F.coalesce("x", "lon").alias("lon"), F.coalesce("y", "lat").alias("lat"))
    return always(checked(s, "code").withColumn("bpuic", code_number(F.col("code"))).withColumn("country", F.lit("GB")))


AGREE_M, DETOUR, DETOUR_EXTRA_M, ALONE_M = 3_000.0, 1.5, 20_000.0, 120_000.0  # fixed values: when positions of a name are believed


def resolved_names(answers: DataFrame, contexts: DataFrame, rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """(positions, rejected): name, layer, lon, lat a name resolves to; name, layer, lon, lat of answers given up.

    answers: name, layer (1 is best), lon, lat from sources of falling trust; one that lies within AGREE_M of a better one
    adds nothing. contexts: before, name, after, n: how often a name stands between two others. An answer must fit its
    neighbours: the way over it at most DETOUR times the direct way and DETOUR_EXTRA_M more, or ALONE_M from an only
    neighbour. Of the names that do not fit, the one that offends most among its neighbours gives up its answer for its
    next one, round after round, because a wrong position makes its neighbours look wrong too.
    """
    a = answers.filter(has_position() & F.col("name").isNotNull()).distinct()
    live = cut(a.withColumn("_k", F.row_number().over(Window.partitionBy("name").orderBy("layer", "lon", "lat"))))
    gone = None
    for _ in range(rounds):
        now = live.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("_k"))).filter("_n = 1").select("name", "layer", "lon", "lat", "_k")
        at = lambda x: now.select(F.col("name").alias(x), F.struct("lon", "lat").alias(f"_{x}"))
        c = contexts.join(at("name"), "name").join(at("before"), "before", "left").join(at("after"), "after", "left")
        d = lambda x, y: great_circle_m(F.col(f"_{x}.lon"), F.col(f"_{x}.lat"), F.col(f"_{y}.lon"), F.col(f"_{y}.lat"))
        over, straight = d("before", "name") + d("name", "after"), d("before", "after")
        excess = F.when(over.isNotNull(), over - (DETOUR * straight + DETOUR_EXTRA_M)).otherwise(F.coalesce(d("before", "name"), d("name", "after")) - ALONE_M)
        off = c.withColumn("x", F.greatest(excess, F.lit(0.0)) * F.col("n"))
        off = cut(off.groupBy("name").agg(F.sum("x").alias("x"), F.collect_set("before").alias("bs"), F.collect_set("after").alias("as_")).filter("x > 0"))
        if off.isEmpty():
            break
        # the worst of its neighbourhood goes: nobody beside it offends more
        near = off.select("name", "x", F.explode(F.array_union("bs", "as_")).alias("other"))
        o = off.select(F.col("name").alias("other"), F.col("x").alias("ox"))
        beaten = near.join(o, "other").filter((F.col("ox") > F.col("x")) | ((F.col("ox") == F.col("x")) & (F.col("other") < F.col("name")))).select("name").distinct()
        worst = off.join(beaten, "name", "left_anti").select("name")
        drop = cut(now.join(worst, "name"))
        gone = drop if gone is None else gone.unionByName(drop)
        live = cut(live.join(drop.select("name", "_k"), ["name", "_k"], "left_anti"))
    else:
        raise ArithmeticError(f"names still offend after {rounds} rounds")
    best = live.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("_k"))).filter("_n = 1").select("name", "layer", "lon", "lat")
    return best, (gone if gone is not None else now.limit(0)).select("name", "layer", "lon", "lat")
