"""What is written for readers outside: day files and their sidecars, dictionaries, manifests, catalog; and when it counts.

Order is the commit rule: facts first, what names them last. A reader that goes by the manifest never sees half a day.
"""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from legflow.operators import geometry as G
from legflow.operators import legs as L
from legflow.operators import links as K
from legflow.operators import quality as Q
from legflow.runtime import cut

SCHEMA = 3  # version of the stored legs that a manifest names
OFFSET = 1_000_000_000  # station ids of a dataset fit below its prefix


def _file(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, whole or not at all: written beside and renamed."""
    P = spark._jvm.org.apache.hadoop.fs.Path
    p, q = P(path), P(f"{path}.part")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(q, True)
    out.write(text.encode())
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(q, p):
        raise OSError(f"{path} could not be written")


def _few(rows: DataFrame, most: int, what: str) -> list:
    """Rows of a vocabulary on the driver; more than `most` are an error, not a cut."""
    out = rows.limit(most + 1).collect()
    if len(out) > most:
        raise ValueError(f"over {most} {what}: not a dictionary")
    return out


def write_journeys(legs: DataFrame, path: str) -> None:
    """The sidecar of the day files: one row a journey, sorted by its id, a file a departure day; days are replaced singly."""
    j = L.journeys(legs)
    j.repartition("dep_day").sortWithinPartitions("dep_day", "journey_id").write.mode("overwrite").partitionBy("dep_day").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path)


def write_dictionary(rows: DataFrame, key: str, values: list[str], path: str, most: int = 1_000_000) -> None:
    """{key: value} or {key: [values]} as JSON, in the order of keys: route pairs, train types."""
    got = sorted(_few(rows.select(key, *values).distinct(), most, path))
    _file(rows.sparkSession, path, json.dumps({str(r[0]): r[1] if len(values) == 1 else list(r[1:]) for r in got}, ensure_ascii=False))


def write_stations(dim: DataFrame, path: str, area: L.Area | None = None, passenger_only: bool = False) -> None:
    """Today's stations as a JSON list; see current_stations()."""
    got = _few(current_stations(dim, area, passenger_only).orderBy("bpuic"), 1_000_000, "stations")
    _file(dim.sparkSession, path, json.dumps([{"id": r.bpuic, "name": r.name, "lon": r.lon, "lat": r.lat} for r in got], ensure_ascii=False))


def current_stations(dim: DataFrame, area: L.Area | None = None, passenger_only: bool = False) -> DataFrame:
    """bpuic, name, lon, lat of the versions that are open, within an area."""
    x = dim.filter(F.col("valid_to") == F.lit("9999-12-31").cast("date"))
    if area:
        x = x.filter(F.col("lon").between(area.west, area.east) & F.col("lat").between(area.south, area.north))
    if passenger_only:
        x = x.filter(F.coalesce("passenger", F.lit(False)))
    return x.select("bpuic", "name", "lon", "lat").distinct()


def write_pack(routes: DataFrame, box: tuple[float, float, float, float], path: str, most: int = 1_000_000) -> None:
    """Routes (route_id, flag, line) as one binary pack, quantised in the cluster; the pack is one file by its format."""
    q = routes.select("route_id", "flag", G.quantized(F.col("line"), box).alias("g")).orderBy("route_id")
    got = _few(q, most, "routes")
    data = G.pack([(r.route_id, r.flag, [(p["x"], p["y"]) for p in r.g]) for r in got], box)
    P = routes.sparkSession._jvm.org.apache.hadoop.fs.Path
    p = P(path)
    out = p.getFileSystem(routes.sparkSession._jsc.hadoopConfiguration()).create(p, True)
    out.write(data)
    out.close()


def carried_days(built: DataFrame, published: DataFrame, version: int = SCHEMA) -> DataFrame:
    """dep_day, legs: days of this build and, for others, those already published; raises if a carried day has another schema.

    built: dep_day, legs; published: dep_day, legs, schema. A build of one month must not make the other years vanish.
    """
    rest = published.join(built.select("dep_day"), "dep_day", "left_anti")
    old = rest.filter(F.col("schema") != version).agg(F.count(F.lit(1)).alias("n")).first().n
    if old:
        raise ValueError(f"{old} carried days have another schema than {version}: rebuild them")
    return built.select("dep_day", "legs").unionByName(rest.select("dep_day", "legs"))


def missing_days(days: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """dep_day of every day without a file from the first to the last (or within the given coverage)."""
    at = lambda given, f: F.lit(given).cast("date") if given else f("dep_day")
    spine = days.agg(at(start, F.min).alias("a"), at(end, F.max).alias("b")).filter("a <= b").select(F.explode(F.sequence("a", "b")).alias("dep_day"))
    return spine.join(days.select("dep_day"), "dep_day", "left_anti")


def dataset_manifest(name: str, days: DataFrame, coverage: tuple[str, str | None], cancelled: list[str] = (), gap_hours: list[str] = ()) -> dict:
    """The manifest of a dataset: days and their legs, coverage, the days and hours it lacks. Raises for days outside coverage."""
    rows = {str(r.dep_day): r.legs for r in _few(days.select("dep_day", "legs"), 100_000, "days")}
    end = coverage[1] or max(rows, default=coverage[0])
    outside = sorted(d for d in rows if not coverage[0] <= d <= end)
    if outside:
        raise ValueError(f"{name}: days outside coverage: {outside[:3]}")
    first, last = datetime.date.fromisoformat(coverage[0]), datetime.date.fromisoformat(end)
    all_ = [str(first + datetime.timedelta(n)) for n in range((last - first).days + 1)]
    return {"dataset": name, "schema_version": SCHEMA, "max_leg_duration_s": L.MAX_LEG, "start": coverage[0], "end": end, "days": {d: {"legs": rows[d]} for d in sorted(rows)}, "missing_days": [d for d in all_ if d not in rows], "source_cancelled_days": list(cancelled), "source_gap_hours": list(gap_hours)}


def catalog(published: dict[str, dict], existing: dict | None = None) -> dict:
    """The catalog: entries of the datasets just published, the others' as they were; a dataset enters with its manifest."""
    entries = dict((existing or {}).get("datasets", {}))
    for name, m in published.items():
        entries[name] = {"path": name, "coverage": [{"start": m["start"], "end": m["end"]}]}
    return {"catalog_schema_version": 1, "datasets": dict(sorted(entries.items()))} | ({"links": existing["links"]} if existing and "links" in existing else {})


def write_links(links: DataFrame, path: str) -> None:
    """Links as JSON lines, a folder a day; days are replaced singly."""
    links.repartition("day").sortWithinPartitions("day", "from_dataset", "from_journey").write.mode("overwrite").partitionBy("day").option("partitionOverwriteMode", "dynamic").json(path)


def geometry_id(prefix: Column, station: Column) -> Column:
    """A station id that is unique over datasets; raises where one does not fit under its prefix."""
    return F.when(station.between(0, OFFSET - 1), prefix * OFFSET + station).otherwise(F.raise_error(F.concat(F.lit("no room for station "), station.cast("string"))))


def bridge_inputs(pairs: DataFrame, stations: DataFrame, prefixes: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(route_id, from_bpuic, to_bpuic of accepted bridges; the dimension of their stations), with ids over all datasets.

    pairs: route_id, from_dataset, from_station, to_dataset, to_station; stations: dataset, id, name, lon, lat.
    """
    p = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    gid = lambda d, s: geometry_id(F.element_at(p, F.col(d)).cast("bigint"), F.col(s))
    routes = pairs.select("route_id", gid("from_dataset", "from_station").alias("from_bpuic"), gid("to_dataset", "to_station").alias("to_bpuic"))
    used = pairs.select(F.col("from_dataset").alias("dataset"), F.col("from_station").alias("id")).union(pairs.select("to_dataset", "to_station")).distinct()
    day = lambda d: F.lit(d).cast("date")
    return routes, stations.join(used, ["dataset", "id"]).select(gid("dataset", "id").alias("bpuic"), "name", "lon", "lat", day("1900-01-01").alias("valid_from"), day("9999-12-31").alias("valid_to"))


def replaced(rows: DataFrame, path: str, by: str) -> None:
    """Write rows in place of the partitions of `by` they belong to, and of no others.

    The rows are worked out in full to the shared folder first: an error on the way leaves every old partition as it was,
    and what is overwritten may be read by the plan of `rows` itself.
    """
    cut(rows).write.mode("overwrite").partitionBy(by).option("partitionOverwriteMode", "dynamic").parquet(path)


def publish_days(legs: DataFrame, attested: DataFrame, path: str, floor: int = Q.FLOOR, skip: list[str] = (), quiet: list[str] = ()) -> DataFrame:
    """Write the day files, their sidecars and last the manifest rows; dep_day, legs, verdict of thin days.

    A day under the floor is published only if the source explains it by cancelling (or it is named in quiet); days in skip
    are not published. An unexplained thin day raises before anything is written.
    """
    skip_, quiet_ = (F.col("dep_day").cast("string").isin(*d) if d else F.lit(False) for d in (skip, quiet))
    thin = cut(Q.thin_days(Q.filled_days(legs, floor).filter(~skip_), attested).withColumn("verdict", F.when(quiet_, "quiet").otherwise(F.col("verdict"))))
    bad = [str(r.dep_day) for r in thin.filter("verdict = 'unexplained' AND legs > 0").limit(5).collect()]
    if bad:
        raise ValueError(f"thin days without a reason: {bad}")
    kept = legs.filter(~F.coalesce(L.departure_day().cast("string").isin(*skip), F.lit(False))) if skip else legs
    L.write_days(L.wire(kept), f"{path}/legs")
    write_journeys(kept, f"{path}/journeys")
    Q.manifest(kept).write.mode("overwrite").parquet(f"{path}/manifest")
    return thin


def quality_report(legs: DataFrame) -> DataFrame:
    """One row: legs, planned ones, split pieces, journeys, routes, first and last departure day."""
    j = legs.select(L.departure_day().alias("d"), "service_day", "trip_id").distinct().agg(F.count(F.lit(1)).alias("journeys"))
    day = L.departure_day()
    x = legs.agg(F.count(F.lit(1)).alias("legs"), F.count_if(F.col("flags").bitwiseAND(L.SCHEDULED) != 0).alias("planned"), F.count_if(F.col("flags").bitwiseAND(L.SYNTHETIC) != 0).alias("pieces"), F.min(day).alias("first"), F.max(day).alias("last"))
    routes = legs.select("route_id").distinct().agg(F.count(F.lit(1)).alias("routes"))
    parts = x.unionByName(j, True).unionByName(routes, True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])  # each part has its own columns


def length_report(lines: DataFrame, metres: str = "metres") -> DataFrame:
    """p50, p95, p99, longest of lengths, exactly, from a histogram of centimetres."""
    h = lines.groupBy(F.round(F.col(metres) * 100).cast("bigint").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    p = lambda q: (F.percentile("v", q, F.col("n")) / 100).alias(f"p{round(q * 100)}")
    return h.agg(p(0.5), p(0.95), p(0.99), (F.max("v") / 100).alias("longest"), F.sum("n").alias("routes"))
