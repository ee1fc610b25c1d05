"""Rules that turn feeds of different styles into stop events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legflow.operators.changes import instant_ns


def clock_seconds(c: Column) -> Column:
    """Seconds of the day of HH:MM or HH:MM:SS; null where it is neither."""
    p = F.split(c, ":")
    ok = c.rlike(r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$")
    return F.when(ok, F.get(p, 0).cast("bigint") * 3600 + F.get(p, 1).cast("bigint") * 60 + F.coalesce(F.get(p, 2).cast("bigint"), F.lit(0)))


def near(t: Column, ref: Column) -> Column:
    """The instant of clock time t on the day that brings it nearest to ref."""
    return t + 86_400 * F.round((ref - t) / 86_400).cast("bigint")


def code_number(c: Column, length: int = 7) -> Column:
    """A letter-digit code as a number in base 37: 0 for nothing, 1..26 letters, 27..36 digits."""
    s = F.rpad(F.upper(c), length, " ")
    total = F.lit(0).cast("bigint")
    for i in range(1, length + 1):
        a = F.ascii(F.substring(s, i, 1))
        digit = F.when(a.between(65, 90), a - 64).when(a.between(48, 57), a - 21).otherwise(0)
        total = total * 37 + digit
    return total


def push_port_stops(sched: DataFrame, act: DataFrame) -> DataFrame:
    """Stop events of schedule and movement messages.

    The rows of a service's latest schedule message count (of one instant all of them); cancelled calls and passing points
    drop. Clock times run past midnight: a call that lies more than half a day before its predecessor begins the next day.
    An actual joins on rid, place and the three working times (null equals null); its latest message per side counts, a
    removed side has none; it lies on the day nearest to its schedule.
    """
    s = sched.withColumn("_t", instant_ns(F.col("ts")))
    last = s.groupBy("rid").agg(F.max("_t").alias("_t"))
    s = s.join(last, ["rid", "_t"]).filter((F.col("deleted") != "True"))
    key = ["rid", "tpl", "wta", "wtd", "wtp"]
    s = s.select(*key, "ssd", "toc", "train_id", "train_cat", F.col("idx").cast("bigint").alias("idx"), "can").distinct()
    w0 = F.coalesce(clock_seconds(F.col("wtd")), clock_seconds(F.col("wta")), clock_seconds(F.col("wtp")))
    by = Window.partitionBy("rid").orderBy("idx", "tpl")
    s = s.withColumn("_w", w0).withColumn("_wrap", F.when(F.col("_w") < F.lag("_w").over(by) - 43_200, 1).otherwise(0))
    s = s.withColumn("_day", F.sum("_wrap").over(by) * 86_400 + F.unix_date(F.to_date("ssd")).cast("bigint") * 86_400)
    s = s.filter((F.col("can") != "True") & (F.col("wta").isNotNull() | F.col("wtd").isNotNull()))
    # an arrival just before midnight belongs to the day of its own clock time
    own = lambda c: near(clock_seconds(F.col(c)) + F.col("_day"), F.col("_w") + F.col("_day"))
    s = s.withColumn("sched_arr", own("wta")).withColumn("sched_dep", own("wtd"))
    at = F.array(*[F.struct(F.lit(x).alias("side"), F.col(f"at_{x}").alias("at"), (F.coalesce(F.col(f"{x}_removed"), F.lit("")) == "True").alias("gone")) for x in ("arr", "dep")])
    a = act.select(*key, instant_ns(F.col("ts")).alias("_t"), F.inline(at)).filter(F.col("at").isNotNull() | F.col("gone"))
    a = a.groupBy(*key, "side").agg(F.max_by(F.struct("at", "gone"), F.struct("_t", "at")).alias("x"))
    times = a.filter(~F.col("x.gone")).groupBy(*key).agg(*[F.max(F.when(F.col("side") == x, clock_seconds(F.col("x.at")))).alias(f"_{x}") for x in ("arr", "dep")])
    times = times.select(*[F.col(k).alias(f"k_{k}") for k in key], "_arr", "_dep")
    on = F.lit(True)
    for k in key:
        on = on & s[k].eqNullSafe(times[f"k_{k}"])
    j = s.join(times, on, "left")
    ref = lambda side: F.coalesce(F.col(f"sched_{side}"), F.col("sched_dep"), F.col("sched_arr"))
    j = j.withColumn("act_arr", near(F.col("_arr"), ref("arr"))).withColumn("act_dep", near(F.col("_dep"), ref("dep")))
    return j.select(
        F.to_date("ssd").alias("service_day"), F.col("rid").alias("trip_id"), F.col("toc").alias("operator"), F.col("train_id").alias("train_number"), F.col("train_cat").alias("category"), code_number(F.col("tpl")).alias("station"),
        F.col("idx").alias("stop_seq"), "sched_arr", "sched_dep", "act_arr", "act_dep", F.col("act_arr").isNotNull().alias("arr_measured"), F.col("act_dep").isNotNull().alias("dep_measured"),
    )


def interpolated_delay(s: Column, t_a: Column, d_a: Column, t_b: Column, d_b: Column) -> Column:
    """Delay at scheduled time s between two observed ends: their own beyond them, linear between; one end lends to both.

    Observations outside [-1200, 43200] s are none. Rounds half away from zero.
    """
    ok = lambda d: F.when(d.between(-1200, 43_200), d)
    a, b = F.coalesce(ok(d_a), ok(d_b)), F.coalesce(ok(d_b), ok(d_a))
    return F.when((s <= t_a) | (t_a == t_b), a).when(s >= t_b, b).otherwise(F.round(a + (b - a) * (s - t_a) / (t_b - t_a))).cast("bigint")


def paired_by_overlap(left: DataFrame, right: DataFrame, least: int = -900, width: int = 7200) -> DataFrame:
    """left_id, right_id, overlap of mutual first choices: same key, greatest overlap of [start, end].

    left, right: key, id, start, end (not null). overlap = least end - greatest start. A record whose best partner prefers
    another stays alone. To keep hot keys from all-pairs joins both sides are laid over ranges of `width` seconds, each over
    all it covers with the tolerance; a pair counts in the first range it shares. A long interval costs its own ranges only.
    """
    slack = max(0, -least)
    cover = lambda lo, hi: F.sequence(F.floor(lo / width), F.floor(F.greatest(lo, hi) / width))
    l = left.select("key", F.col("id").alias("left_id"), F.col("start").alias("ls"), F.col("end").alias("le"), F.explode(cover(F.col("start") - slack, F.greatest("start", "end") + slack)).alias("b"))
    r = right.select("key", F.col("id").alias("right_id"), F.col("start").alias("rs"), F.col("end").alias("re"), F.explode(cover(F.col("start"), F.col("end"))).alias("b"))
    x = l.join(r, ["key", "b"]).filter(F.col("b") == F.greatest(F.floor((F.col("ls") - slack) / width), F.floor(F.col("rs") / width)))
    x = x.withColumn("overlap", F.least("le", "re") - F.greatest("ls", "rs")).filter(F.col("overlap") >= least)
    first = lambda of, other: F.row_number().over(Window.partitionBy(of).orderBy(F.desc("overlap"), other))
    x = x.withColumn("_l", first("left_id", "right_id")).withColumn("_r", first("right_id", "left_id"))
    return x.filter("_l = 1 AND _r = 1").select("left_id", "right_id", F.col("overlap").cast("bigint").alias("overlap"))


def slots(rows: DataFrame, run: str, pos: str, kind: str, station: str, first: str = "DEPARTURE", then: str = "ARRIVAL") -> DataFrame:
    """Alternating departure and arrival rows as stops: run, slot, station, dep_pos, arr_pos.

    Row i (from 0) belongs to slot (i + 1) div 2. A run whose kinds do not alternate from `first`, or with two stations in
    a slot, is left out whole.
    """
    x = rows.withColumn("_i", F.row_number().over(Window.partitionBy(run).orderBy(pos)) - 1).withColumn("slot", F.floor((F.col("_i") + 1) / 2))
    wrong = F.col(kind) != F.when(F.col("_i") % 2 == 0, first).otherwise(then)
    bad = x.filter(wrong).select(run).unionByName(x.groupBy(run, "slot").agg(F.countDistinct(station).alias("n")).filter("n > 1").select(run)).distinct()
    good = x.join(bad, run, "left_anti")
    at = lambda k: F.min(F.when(F.col(kind) == k, F.col(pos)))
    return good.groupBy(run, "slot").agg(F.min(station).alias("station"), at(then).alias("arr_pos"), at(first).alias("dep_pos"))


def malformed(rows: DataFrame, run: list[str], pos: str, time: str, station: str, left: str | None = None) -> DataFrame:
    """Runs whose time goes back or that call at a station twice; left: the time to compare with, of the stop before."""
    back = F.col(time) < F.lag(left or time).over(Window.partitionBy(*run).orderBy(pos))
    x = rows.withColumn("_b", back)
    return x.groupBy(*run).agg(F.max(F.coalesce(F.col("_b"), F.lit(False))).alias("_b"), F.count(F.lit(1)).alias("_n"), F.countDistinct(station).alias("_d")).filter(F.col("_b") | (F.col("_n") > F.col("_d"))).select(*run)


def contained(signatures: DataFrame, within: list[str], id_: str) -> DataFrame:
    """Ids whose whole signature is held by another id's that is larger, or equal with a lesser id.

    signatures: distinct rows of (within..., id). Only ids with a row in common meet, and a row many ids share costs no
    pairs by itself: an id is joined through its rarest row alone, then its other rows are checked.
    """
    size = signatures.groupBy(id_).agg(F.count(F.lit(1)).alias("_size"))
    often = signatures.groupBy(*within).agg(F.count(F.lit(1)).alias("_often"))
    ranked = signatures.join(often, within).withColumn("_r", F.row_number().over(Window.partitionBy(id_).orderBy("_often", *within)))
    rare = ranked.filter("_r = 1").select(*within, F.col(id_).alias("_a"))
    meet = rare.join(signatures.select(*within, F.col(id_).alias("_b")), within).filter("_a <> _b").select("_a", "_b")
    sa, sb = size.select(F.col(id_).alias("_a"), F.col("_size").alias("_sa")), size.select(F.col(id_).alias("_b"), F.col("_size").alias("_sb"))
    meet = meet.join(sa, "_a").join(sb, "_b").filter("_sb > _sa OR (_sb = _sa AND _b < _a)")
    rows_a = signatures.select(F.col(id_).alias("_a"), *within)
    rows_b = signatures.select(F.col(id_).alias("_b"), *within)
    common = meet.join(rows_a, "_a").join(rows_b, ["_b", *within]).groupBy("_a", "_b", "_sa").agg(F.count(F.lit(1)).alias("_n"))
    return common.filter("_n = _sa").select(F.col("_a").alias(id_)).distinct()


def bridged_gaps(rows: DataFrame, run: list[str], pos: str) -> Column:
    """True where the next stop's position is not the next number: the departure must not bridge the gap."""
    return F.coalesce(F.lead(pos).over(Window.partitionBy(*run).orderBy(pos)) - F.col(pos) > 1, F.lit(False))


def gap_hours(events: DataFrame, time: str, share: float = 0.25) -> DataFrame:
    """hour, n: hours (from the first to the last, missing ones with 0) under `share` of the median of their weekday and hour."""
    per = events.groupBy(F.date_trunc("hour", F.col(time)).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    ends = per.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    spine = ends.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("hour"))
    all_ = spine.join(per, "hour", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    usual = F.median("n").over(Window.partitionBy(F.dayofweek("hour"), F.hour("hour")))
    return all_.withColumn("_m", usual).filter(F.col("n") < share * F.col("_m")).select("hour", "n")


def labels(rows: DataFrame, by: list[str], label: str, order: list[str]) -> Column:
    """A label made unique within its group: the k-th bearer gets ` #k` from the second on."""
    k = F.row_number().over(Window.partitionBy(*by, label).orderBy(*order))
    return F.when(k == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit(" #"), k.cast("string")))


def merged_calls(rows: DataFrame, run: list[str], pos: str, place: str, from_next: list[str]) -> DataFrame:
    """Calls of a run in order without immediate repeats of a place: the first of two stays, with the next one's `from_next`
    columns (a train that turns or divides arrives once and leaves once)."""
    w = Window.partitionBy(*run).orderBy(pos)
    again, twice = F.lag(place).over(w).eqNullSafe(F.col(place)) & (F.row_number().over(w) > 1), F.lead(place).over(w) == F.col(place)
    x = rows.select("*", again.alias("_again"), F.coalesce(twice, F.lit(False)).alias("_twice"), *[F.lead(c).over(w).alias(f"_n_{c}") for c in from_next])
    kept = x.filter("NOT _again")
    return kept.select(*[F.when(F.col("_twice"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in from_next else F.col(c) for c in rows.columns], F.row_number().over(w).alias("seq"))


def missing_hours(missing: DataFrame, zone: str) -> DataFrame:
    """hour (epoch hours, UTC) whose file is missing, of (day, hour) named by local time: an hour that comes twice in autumn is
    two, one that spring leaves out is none."""
    local = F.timestamp_seconds(F.unix_date("day").cast("bigint") * 86_400 + F.col("hour") * 3600)
    u = F.unix_seconds(F.to_utc_timestamp(local, zone))
    tries = F.explode(F.array(u - 3600, u, u + 3600)).alias("t")
    x = missing.select(local.alias("local"), tries)
    return x.filter(F.from_utc_timestamp(F.timestamp_seconds("t"), zone) == F.col("local")).select(F.floor(F.col("t") / 3600).alias("hour")).distinct()


def lost_days(missing: DataFrame, load_hours: tuple[int, ...] = (2, 3)) -> DataFrame:
    """day whose timetable load (the files of these local hours) is missing."""
    return missing.filter(F.col("hour").isin(*load_hours)).select("day").distinct()
