"""What a dataset's days and months attest: coverage, thin days, invariants, summaries, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legflow.operators.legs import SCHEDULED, SYNTHETIC, departure_day

FLOOR = 10_000


def source_days(stops: DataFrame, cancelled: str = "cancelled") -> DataFrame:
    """service_day, trains, cancelled: runs a source attests; a run is cancelled if all its stops are."""
    runs = stops.groupBy("service_day", "trip_id").agg(F.bool_and(cancelled).alias("gone"))
    return runs.groupBy("service_day").agg(F.count(F.lit(1)).alias("trains"), F.count_if("gone").alias("cancelled"))


def filled_days(legs: DataFrame, floor: int = FLOOR) -> DataFrame:
    """dep_day, legs, thin: every day from the first to the last departure, missing ones with 0."""
    n = legs.groupBy(departure_day().alias("dep_day")).agg(F.count(F.lit(1)).alias("legs"))
    spine = n.agg(F.min("dep_day").alias("a"), F.max("dep_day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("dep_day"))
    x = spine.join(n, "dep_day", "left").withColumn("legs", F.coalesce("legs", F.lit(0)))
    return x.withColumn("thin", F.col("legs") < floor)


def thin_days(counts: DataFrame, attested: DataFrame, share: float = 0.5) -> DataFrame:
    """dep_day, legs, verdict of thin days: explained where the source itself cancelled `share` of its trains, else unexplained."""
    x = counts.filter("thin").join(attested, F.col("dep_day") == F.col("service_day"), "left")
    ok = F.coalesce(F.col("cancelled") / F.nullif(F.col("trains"), F.lit(0)) >= share, F.lit(False))
    return x.select("dep_day", "legs", F.when(ok, "explained").otherwise("unexplained").alias("verdict"))


def month_summary(legs: DataFrame) -> DataFrame:
    """Per UTC month: legs, days, pairs, measured share, split pieces, longest, median and 99th percentile duration, journeys.

    Exact percentiles come from the histogram of durations (bounded by MAX_LEG values), distinct counts from one row per
    distinct value: no task holds a month.
    """
    m = legs.withColumn("month", F.date_trunc("month", departure_day()).cast("date"))
    hist = m.groupBy("month", "dur").agg(F.count(F.lit(1)).alias("n")).groupBy("month").agg(F.percentile("dur", 0.5, F.col("n")).alias("p50"), F.percentile("dur", 0.99, F.col("n")).alias("p99"), F.max("dur").cast("bigint").alias("longest"))
    base = m.groupBy("month").agg(F.count(F.lit(1)).alias("legs"), F.round(100 * F.avg((F.col("flags").bitwiseAND(SCHEDULED) == 0).cast("double")), 6).alias("measured_pct"), F.count_if(F.col("flags").bitwiseAND(SYNTHETIC) != 0).alias("pieces"))
    each = lambda name, *c: m.select("month", *c).distinct().groupBy("month").agg(F.count(F.lit(1)).alias(name))
    out = base.join(hist, "month")
    for x in (each("days", departure_day().alias("d")), each("pairs", "from_bpuic", "to_bpuic"), each("journeys", "service_day", "trip_id")):
        out = out.join(x, "month")
    return out


def violations(legs: DataFrame) -> DataFrame:
    """One row of counts that must all be 0: bad durations, unknown flag bits, nulls, impossible shares."""
    bad = F.count_if
    return legs.agg(
        bad(~F.col("dur").between(1, 3600)).alias("bad_duration"), bad(F.col("flags").bitwiseAND(248) != 0).alias("bad_flags"), bad(F.col("route_id").isNull() | F.col("t_dep").isNull() | F.col("trip_id").isNull()).alias("nulls"),
        bad(~(F.col("route_start").between(0, 254) & F.col("route_end").between(1, 255) & (F.col("route_start") < F.col("route_end")))).alias("bad_share"),
    )


def gap_runs(days: DataFrame) -> DataFrame:
    """first, last, days: stretches of consecutive missing days between the first and the last day there is."""
    d = days.select("day").filter("day IS NOT NULL").distinct()
    # days of a calendar: few rows whatever the data behind them
    x = d.withColumn("next", F.lead("day").over(Window.orderBy("day"))).filter(F.datediff("next", "day") > 1)
    return x.select(F.date_add("day", 1).alias("first"), F.date_sub("next", 1).alias("last"), (F.datediff("next", "day") - 1).cast("bigint").alias("days"))


def overlaps(dim: DataFrame, key: str) -> DataFrame:
    """Versions whose period reaches into the next one of their key: none in a sound dimension."""
    nxt = F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from", "valid_to"))
    return dim.withColumn("next", nxt).filter(F.col("valid_to") >= F.col("next")).select(key, "valid_from", "valid_to", "next")


def manifest(legs: DataFrame) -> DataFrame:
    """dep_day, legs, journeys, first, last of each published day, for the catalog written after the days themselves."""
    d = legs.withColumn("dep_day", departure_day())
    j = d.select("dep_day", "service_day", "trip_id").distinct().groupBy("dep_day").agg(F.count(F.lit(1)).alias("journeys"))
    return d.groupBy("dep_day").agg(F.count(F.lit(1)).alias("legs"), F.min("t_dep").alias("first"), F.max("t_dep").alias("last")).join(j, "dep_day")


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n: how often each value of the columns stands, null as null; one pass, pre-aggregated."""
    x = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))
    return x.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def status_months(rows: DataFrame, day: str, status: str) -> DataFrame:
    """month, status, n, first: which values of a status each month has, and since when, to see where a source changes its words."""
    return rows.groupBy(F.trunc(day, "month").alias("month"), F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first"))


def census(files: DataFrame, stub_below: int) -> DataFrame:
    """month, usable, stub, absent of an archive's days (day, bytes): absent from its first to its last day."""
    d = files.groupBy("day").agg(F.max("bytes").alias("bytes"))
    spine = d.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day"))
    x = spine.join(d, "day", "left").groupBy(F.trunc("day", "month").alias("month"))
    return x.agg(F.count_if(F.col("bytes") >= stub_below).alias("usable"), F.count_if(F.col("bytes") < stub_below).alias("stub"), F.count_if(F.col("bytes").isNull()).alias("absent"))


def punctuality(legs: DataFrame, by: list[Column], late_s: int = 180) -> DataFrame:
    """The groups' n, p50, p90 of delay and share of measured legs less than late_s late, exactly, from histograms of delay."""
    m = legs.filter(F.col("flags").bitwiseAND(SCHEDULED) == 0)
    names = [f"g{i}" for i in range(len(by))]
    h = m.groupBy(*[c.alias(n) for c, n in zip(by, names)], F.col("delay").cast("bigint").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    p = lambda q: F.percentile("v", q, F.col("k")).alias(f"p{round(q * 100)}")
    return h.groupBy(*names).agg(F.sum("k").alias("n"), p(0.5), p(0.9), F.round(F.sum(F.when(F.col("v") < late_s, F.col("k")).otherwise(0)) / F.sum("k"), 6).alias("punctual"))
