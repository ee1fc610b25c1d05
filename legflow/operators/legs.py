"""From stop events to legs: hops, verdicts, registries, bounded pieces, departure days, journeys and their wire form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
# Leg flags, unknown type, longest leg.
SCHEDULED, SYNTHETIC, FRACTION = 1, 2, 4
UNKNOWN_TYPE = 255
MAX_LEG = 3600
WIRE_ID = 65_535
NOT_QUARANTINED = ("ok", "outside_bbox", "outside_country", "not_run")


@dataclass(frozen=True)
class Area:
    west: float
    south: float
    east: float
    north: float
    countries: tuple[str, ...] = ()


def hops(stops: DataFrame, order: list[Column], run: list[str], generic: bool = False) -> DataFrame:
    """A leg candidate from each stop to the next of its run, on one clock.

    stops: run columns, station, sched_arr, sched_dep, act_arr, act_dep (epoch seconds), arr_measured, dep_measured (not
    null), further columns. A hop is measured if both its ends are: then both times are actual, else both scheduled;
    bases are never mixed. delay is that of the departure by itself. generic adds `runs`: both ends have a time of their
    side. One shuffle by run; a run is as long as a train's stops.
    """
    w = Window.partitionBy(*run).orderBy(*order)
    nxt = lambda c: F.lead(c).over(w)
    x = (
        stops.withColumn("to_station", nxt("station"))
        .withColumn("_sa", nxt("sched_arr"))
        .withColumn("_aa", nxt("act_arr"))
        .withColumn("measured", F.col("dep_measured") & nxt("arr_measured"))
        .withColumn("_last", F.row_number().over(w) == F.count(F.lit(1)).over(Window.partitionBy(*run)))
        .filter(~F.col("_last"))
    )
    dep = F.when(F.col("measured"), F.col("act_dep")).otherwise(F.col("sched_dep"))
    arr = F.when(F.col("measured"), F.col("_aa")).otherwise(F.col("_sa"))
    delay = F.when(F.col("dep_measured") & F.col("sched_dep").isNotNull(), F.col("act_dep") - F.col("sched_dep"))
    runs = F.coalesce("sched_dep", "act_dep").isNotNull() & F.coalesce("_sa", "_aa").isNotNull()
    x = x.select(*run, F.col("station").alias("from_station"), "to_station", dep.alias("t_dep"), (arr - dep).alias("dur"), delay.alias("delay"), "measured", *[c for c in ("category", "line") if c in stops.columns], runs.alias("runs"))
    return x if generic else x.drop("runs")


def at_day(dim: DataFrame, prefix: str) -> DataFrame:
    return dim.select(*[F.col(c).alias(f"{prefix}_{c}") for c in dim.columns])


def tagged(hops_: DataFrame, dim: DataFrame, area: Area, day: str = "service_day") -> DataFrame:
    """Hops with exactly one verdict; the first that applies.

    dim: station, lon, lat, valid_from, valid_to and optionally country; equi-join on the station with the validity as residual,
    so the plan is a hash or merge join whatever the number of versions. A null country is not clipped.
    """
    f, t = at_day(dim, "f"), at_day(dim, "t")
    day_in = lambda p: F.col(day).between(F.col(f"{p}_valid_from"), F.col(f"{p}_valid_to"))
    x = hops_.join(f, (F.col("from_station") == F.col("f_station")) & day_in("f"), "left")
    x = x.join(t, (F.col("to_station") == F.col("t_station")) & day_in("t"), "left")
    out = lambda p: ~(F.col(f"{p}_lon").between(area.west, area.east) & F.col(f"{p}_lat").between(area.south, area.north))
    v = F.when(~F.col("runs"), "not_run") if "runs" in hops_.columns else None
    rule = lambda c, name: F.when(c, name) if v is None else v.when(c, name)
    for c, name in (
        (F.col("t_dep").isNull() | F.col("dur").isNull(), "missing_time"),
        (F.col("dur") < 0, "negative_duration"),
        (F.col("dur") == 0, "zero_duration"),
        (F.col("dur") > DAY, "absurd_duration"),
        (F.col("f_station").isNull() | F.col("t_station").isNull(), "unmatched_station"),
        (out("f") | out("t"), "outside_bbox"),
    ):
        v = rule(c, name)
    if area.countries:
        v = v.when(~F.col("f_country").isin(*area.countries) | ~F.col("t_country").isin(*area.countries), "outside_country")
    return x.select(*hops_.columns, v.otherwise("ok").alias("verdict"))


def quarantine(tags: DataFrame) -> DataFrame:
    return tags.filter(~F.col("verdict").isin(*NOT_QUARANTINED))


def registry(known: DataFrame, keys: DataFrame, key: list[str], id_: str, most: int) -> DataFrame:
    """Append-only ids: known rows unchanged, unseen keys numbered on in key order from the highest id.

    Raises where ids would pass `most`. The numbering sorts the unseen keys in one task: they are a vocabulary (pairs of
    stations, categories), and `most` bounds them.
    """
    new = keys.select(*key).distinct()
    same = [new[k].eqNullSafe(known[k]) for k in key]
    new = new.join(known, same, "left_anti")
    top = known.agg(F.max(id_)).first()[0]
    start = -1 if top is None else top
    if start + new.limit(most + 2).count() > most:
        raise ValueError(f"ids of {id_} would pass {most}")
    n = F.row_number().over(Window.orderBy(*[F.col(k).asc_nulls_last() for k in key]))
    return known.select(*key, id_).unionByName(new.select(*key, (n + start).cast("bigint").alias(id_)))


def seeded(known: DataFrame, published: DataFrame, key: list[str], id_: str) -> DataFrame:
    """Known ids with the published ones among them; raises where a key has another id or an id another key."""
    k = known.select(F.struct(*key).alias("k"), F.col(id_).alias("a"))
    p = published.select(F.struct(*key).alias("p"), F.col(id_).alias("b")).distinct()
    wrong = seed_conflicts(known, published, key, id_).first()
    if wrong is not None:
        raise ValueError(f"published {wrong.key} has id {wrong.id}, known is {wrong.known}")
    fresh = p.join(k, F.col("p") == F.col("k"), "left_anti").select("p.*", F.col("b").alias(id_))
    return known.select(*key, id_).unionByName(fresh)


def seed_conflicts(known: DataFrame, published: DataFrame, key: list[str], id_: str) -> DataFrame:
    """key, id, known (as text) of published ids that contradict the known ones, in either direction."""
    text = lambda c: F.concat_ws(",", *[F.col(x).cast("string") for x in c])
    k = known.select(text(key).alias("kk"), F.col(id_).cast("bigint").alias("ki"))
    p = published.select(text(key).alias("key"), F.col(id_).cast("bigint").alias("id")).distinct()
    other_id = p.join(k, (F.col("key") == F.col("kk")) & (F.col("id") != F.col("ki"))).select("key", "id", F.concat(F.lit("id "), F.col("ki").cast("string")).alias("known"))
    other_key = p.join(k, (F.col("id") == F.col("ki")) & (F.col("key") != F.col("kk"))).select("key", "id", F.concat(F.lit("key "), "kk").alias("known"))
    return other_id.unionByName(other_key).distinct()


def split(ok: DataFrame) -> DataFrame:
    """Legs of at most MAX_LEG seconds: longer ones in n pieces with their share of the route in 255ths."""
    dur, n = F.col("dur"), F.ceil(F.col("dur") / MAX_LEG).cast("bigint")
    x = ok.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(n, F.lit(1)) - 1)))
    i, n = F.col("_i"), F.col("_n")
    part = lambda s: F.round(s * 255 / dur).cast("bigint")
    long = dur > MAX_LEG
    start = F.greatest(i, F.least(255 - (n - i), part(MAX_LEG * i)))
    end = F.greatest(i + 1, F.least(255 - (n - i - 1), part(F.least(dur, MAX_LEG * (i + 1)))))
    flags = F.when(F.col("measured"), 0).otherwise(SCHEDULED).bitwiseOR(F.when(long, SYNTHETIC | FRACTION).otherwise(0))
    keep = [c for c in ok.columns if c not in ("dur", "t_dep", "delay", "measured", "verdict", "runs")]
    return x.select(
        *keep,
        (F.col("t_dep") + MAX_LEG * i).cast("bigint").alias("t_dep"),
        F.least(F.lit(MAX_LEG), dur - MAX_LEG * i).cast("bigint").alias("dur"),
        F.least(F.lit(32767), F.greatest(F.lit(-32768), F.coalesce("delay", F.lit(0)))).cast("bigint").alias("delay"),
        flags.cast("bigint").alias("flags"),
        F.when(long, start).otherwise(0).cast("bigint").alias("route_start"),
        F.when(long, end).otherwise(255).cast("bigint").alias("route_end"),
    )


def departure_day(t: str = "t_dep") -> Column:
    """UTC date of departure: the day a leg is filed under, whatever its service day."""
    return F.date_from_unix_date(F.floor(F.col(t) / DAY).cast("int"))


def journeys(legs: DataFrame) -> DataFrame:
    """dep_day, service_day, trip_id, journey_id, line: ids of a departure day's journeys, from 0 in key order.

    Journeys are reduced to one row each before they are numbered, so the window sorts a day's journeys, not its legs.
    """
    key = ["dep_day", "service_day", "trip_id"]
    one = legs.withColumn("dep_day", departure_day()).groupBy(*key).agg(F.min_by("line", F.struct("t_dep", "route_id", "from_bpuic", "to_bpuic", "leg_id")).alias("line"))
    n = F.row_number().over(Window.partitionBy("dep_day").orderBy("service_day", "trip_id")) - 1
    return one.withColumn("journey_id", n.cast("bigint"))


def wire(legs: DataFrame) -> DataFrame:
    """Legs as they are stored: journey_id for its key, route id and share of it packed into one number. Raises where a packed
    route id is over WIRE_ID; a journey's id is a column by itself and takes any number of journeys a day."""
    whole = (F.col("route_start") == 0) & (F.col("route_end") == 255)
    r = F.col("route_id").cast("bigint")
    packed = F.when(whole, r).otherwise(r.bitwiseOR(F.shiftleft(F.col("route_start").cast("bigint"), 16)).bitwiseOR(F.shiftleft(F.col("route_end").cast("bigint"), 24)))
    flags = F.col("flags").cast("int").bitwiseOR(F.when(whole, 0).otherwise(FRACTION))
    # a number that does not fit would read back as another route
    packed = F.when(whole | (r <= WIRE_ID), packed).otherwise(F.raise_error(F.concat(F.lit(f"route_id of a part passes {WIRE_ID}: "), r.cast("string"))))
    j = journeys(legs).select("dep_day", "service_day", "trip_id", "journey_id")
    x = legs.withColumn("dep_day", departure_day()).join(j, ["dep_day", "service_day", "trip_id"])
    return x.select("dep_day", packed.alias("route_id"), "journey_id", "t_dep", F.col("dur").cast("bigint").alias("dur"), F.col("type_id").cast("bigint").alias("type_id"), F.col("delay").cast("bigint").alias("delay"), flags.cast("bigint").alias("flags"))


def unwire(rows: DataFrame) -> DataFrame:
    """The stored form back: route_id, route_start, route_end (0..255)."""
    part = F.col("flags").bitwiseAND(FRACTION) != 0
    r = F.col("route_id")
    return rows.select(
        *[c for c in rows.columns if c != "route_id"],
        F.when(part, r.bitwiseAND(0xFFFF)).otherwise(r).alias("route_id"),
        F.when(part, F.shiftrightunsigned(r, 16).bitwiseAND(0xFF)).otherwise(0).cast("bigint").alias("route_start"),
        F.when(part, F.shiftrightunsigned(r, 24).bitwiseAND(0xFF)).otherwise(255).cast("bigint").alias("route_end"),
    )


def write_days(rows: DataFrame, path: str, row_group: int = 8192, level: int = 9) -> None:
    """Stored legs as one sorted file a departure day (small row groups, zstd): rewriting a day replaces that day only.

    Sorting within the day lets readers skip row groups by t_dep. A day is one task: it is the unit readers fetch, of a
    known size; set maxRecordsPerFile for larger ones.
    """
    order = ["dep_day", "t_dep", "journey_id", "route_id"]
    w = rows.repartition("dep_day").sortWithinPartitions(*order).write.mode("overwrite").partitionBy("dep_day")
    w.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).option("parquet.block.row.count.limit", str(row_group)).parquet(path)
