"""Validity periods of changing attributes by tree reduction of unit intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN = "9999-12-31"


def _joined(left: Column, right: Column) -> Column:
    """Two neighbouring interval runs as one: the touching intervals merge where their payloads are equal."""
    a, b = F.element_at(left, -1), right[0]
    one = F.array(F.struct(a["first"].alias("first"), b["last"].alias("last"), a["p"].alias("p")))
    merged = F.concat(F.slice(left, F.lit(1), F.size(left) - 1), one, F.slice(right, F.lit(2), F.size(right)))
    return F.when(a["p"].eqNullSafe(b["p"]), merged).otherwise(F.concat(left, right))


def coalesce_history(units: DataFrame, entity: str, day: str, payload: list[str], days: DataFrame | None = None) -> DataFrame:
    """Periods of unchanged payload: entity, payload columns, valid_from, valid_to (dates).

    units: at most one row per (entity, day), day of type date; more than one raises no error, the rows of a day then
    follow each other in payload order. Every unit is an interval of its own; in round r the runs of the days with equal
    `day >> r` are merged pairwise, so after log2(days) rounds one run list per entity is left. All rounds follow from one
    partitioning by entity (an entity has no more rows than there are days, which bounds the list). A missing day is no
    change. A period ends the day before the entity's next one, the last is open. Rows with null entity or day are left
    out; null payload values are values.
    """
    u = units.filter(F.col(entity).isNotNull() & F.col(day).isNotNull())
    # of the days alone, which the source's own column gives where the caller names it: no part of the plan runs twice
    lo, hi = (u if days is None else days.select(F.col(day))).agg(F.min(F.unix_date(day)), F.max(F.unix_date(day))).first()
    rounds = 0 if lo is None else int(hi - lo).bit_length()
    p = F.struct(*[F.col(c).alias(c) for c in payload])
    x = u.repartition(F.col(entity)).select(
        F.col(entity).alias("_e"),
        (F.unix_date(day) - F.lit(lo or 0)).alias("_b"),
        F.struct(F.col(day).alias("first"), F.col(day).alias("last"), p.alias("p")).alias("_u"),
    )
    x = x.groupBy("_e", "_b").agg(F.array_sort(F.collect_list("_u")).alias("_r"))
    for _ in range(rounds):
        pair = F.array_sort(F.collect_list(F.struct("_b", "_r")))
        x = x.groupBy("_e", F.shiftright("_b", 1).alias("_h")).agg(pair.alias("_p"))
        l, r = F.col("_p")[0]["_r"], F.col("_p")[1]["_r"]
        x = x.select("_e", F.col("_h").alias("_b"), F.when(F.size("_p") == 1, l).otherwise(_joined(l, r)).alias("_r"))
    nxt = lambda i: F.get(F.col("_r"), i + 1)["first"]
    runs = F.transform("_r", lambda v, i: F.struct(v["first"].alias("valid_from"), F.coalesce(F.date_sub(nxt(i), 1), F.lit(OPEN).cast("date")).alias("valid_to"), v["p"].alias("p")))
    return x.select(F.col("_e").alias(entity), F.inline(runs)).select(entity, *[F.col("p")[c].alias(c) for c in payload], "valid_from", "valid_to")


def stations_of_snapshots(stops: DataFrame) -> DataFrame:
    """One row per (snap, station): bpuic, name, lat, lon, of listings as read (all text).

    Of a station's rows in a snap the bare number counts, else its `Parent` row, else another row with location_type 1,
    else the mean of the rest. Rows without leading number or with an unreadable position are ignored, repeated rows count
    once; two different rows of the deciding kind give the least name and the mean position. Positions are averaged as
    decimals, so the result does not depend on the order of addition.
    """
    sid = F.trim(F.col("stop_id"))
    num = F.regexp_extract(sid, r"^(?:Parent)?([0-9]+)", 1)
    # blanks of any kind: a name may hold tabs or no-break spaces
    name = F.trim(F.regexp_replace(F.col("stop_name"), r"[\s ]+", " "))
    pos = lambda c: F.trim(F.col(c)).try_cast("decimal(20,13)")
    kind = (
        F.when(sid.rlike(r"^[0-9]+$"), 1)
        .when(sid.rlike(r"^Parent[0-9]+$"), 2)
        .when(F.trim(F.col("location_type")) == "1", 3)
        .otherwise(4)
    )
    rows = (
        stops.filter((num != "") & F.col("snap").isNotNull())
        .select("snap", num.try_cast("bigint").alias("bpuic"), sid.alias("stop_id"), kind.alias("kind"), name.alias("name"), pos("stop_lat").alias("lat"), pos("stop_lon").alias("lon"))
        .filter(F.col("bpuic").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
        .distinct()
    )
    # per kind partial sums, then the best kind: map-side combined, so a station with many rows costs one row a task
    sums = rows.groupBy("snap", "bpuic", "kind").agg(F.min("name").alias("name"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    best = sums.groupBy("snap", "bpuic").agg(F.min_by(F.struct("name", "lat", "lon"), "kind").alias("s"))
    return best.select("snap", "bpuic", "s.name", F.round("s.lat", 5).alias("lat"), F.round("s.lon", 5).alias("lon"))


def station_history(stops: DataFrame) -> DataFrame:
    """bpuic, name, lat, lon, valid_from, valid_to of station listings; see the two functions above."""
    return coalesce_history(stations_of_snapshots(stops), "bpuic", "snap", ["name", "lat", "lon"], stops)
