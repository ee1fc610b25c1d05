"""Questions over stored legs: windows, search, journeys, departure boards, positions, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legflow.operators.legs import DAY, MAX_LEG, SCHEDULED, departure_day

# What a delay may be, how long a train shows before and after, the steps of the delay scale.
DELAY_LIMIT, FADE, STEPS = 10_800, 900, (0, 180, 600, 1800)
LISTED, BOARD_BACK = 24, 900


def window(legs: DataFrame, at: int, ahead: int = 3000) -> DataFrame:
    """Legs that can matter at `at` and for `ahead` seconds: none is longer than MAX_LEG, so the lower bound is exact."""
    return legs.filter(F.col("t_dep").between(at - MAX_LEG, at + ahead)).orderBy("t_dep", "leg_id")


def active(legs: DataFrame, at: int) -> DataFrame:
    """Legs under way at `at`, both ends included."""
    return legs.filter(F.col("t_dep").between(at - MAX_LEG, at) & (F.col("t_dep") + F.col("dur") >= at))


def known_delay(delay: str = "delay", flags: str = "flags") -> Column:
    """The delay where it is measured and believable, else null."""
    ok = (F.abs(F.col(delay).cast("int")) < DELAY_LIMIT) & (F.col(flags).bitwiseAND(SCHEDULED) == 0)
    return F.when(ok, F.col(delay).cast("int"))


def delay_step(delay: Column) -> Column:
    """Position on the delay scale, 0..3: linear between its steps; early counts as on time, unknown is null."""
    d = F.greatest(delay.cast("double"), F.lit(0.0))
    out = F.when(d >= STEPS[3], F.lit(3.0))
    for i in (2, 1, 0):
        out = out.when(d >= STEPS[i], i + (d - STEPS[i]) / (STEPS[i + 1] - STEPS[i]))
    return F.when(delay.isNotNull(), out)


def search(legs: DataFrame, text: str, at: int, most: int = LISTED, by: tuple[str, ...] = ()) -> DataFrame:
    """Journeys of the UTC day of `at` whose line or trip holds the text (blanks and case aside); wildcards act as such.

    rank 0: the line itself, 1: the trip itself, 2: either holds it. Sorted by rank, start, journey; at most `most` of each
    dataset (the columns `by`, if legs of several come together), then of all. An empty text finds nothing.
    """
    needle = text.strip().lower().replace(" ", "")
    day = at // DAY * DAY
    x = legs.filter(F.col("t_dep").between(day, day + DAY - 1) & F.lit(needle != ""))
    bare = lambda c: F.replace(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(" "), F.lit(""))
    x = x.filter(bare("line").like(f"%{needle}%") | bare("trip_id").like(f"%{needle}%"))
    rank = F.when(bare("line") == needle, 0).when(bare("trip_id") == needle, 1).otherwise(2)
    first = F.struct("t_dep", "leg_id")
    g = x.groupBy(*by, "service_day", "trip_id").agg(
        F.min(rank).cast("bigint").alias("rank"), F.min("t_dep").alias("start"), F.max(F.col("t_dep") + F.col("dur")).alias("end"), F.min_by("route_id", first).cast("bigint").alias("route_id"), F.min_by("line", first).alias("line")
    )
    order = ["rank", "start", *by, "service_day", "trip_id"]
    if by:
        g = g.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")
    return g.orderBy(*order).limit(most)


def initial_day(days: DataFrame, main: str, default: str, floor: int = 10_000) -> DataFrame:
    """day to begin with: the first that every dataset has; else `default` if the main dataset has it; else its last day with
    `floor` legs or more; else its last. days: dataset, day, legs."""
    k = days.groupBy("day").agg(F.countDistinct("dataset").alias("k"))
    # a day that all have is one that as many have as there are: few datasets, so their number comes from the driver
    n = days.select("dataset").distinct().count()
    shared = k.filter((F.col("k") == n) & F.lit(n > 1)).agg(F.min("day").alias("shared"))
    d = F.lit(default).cast("date")
    own = days.filter(F.col("dataset") == main).agg(F.max(F.when(F.col("day") == d, d)).alias("d"), F.max(F.when(F.col("legs") >= floor, F.col("day"))).alias("full"), F.max("day").alias("last"))
    return shared.unionByName(own, True).agg(F.coalesce(F.max("shared"), F.max("d"), F.max("full"), F.max("last")).alias("day"))


def coverage_notices(instants: DataFrame, datasets: DataFrame, days: DataFrame, cancelled: DataFrame, gaps: DataFrame) -> DataFrame:
    """at, dataset, notice of instants (at: epoch seconds) that a dataset does not cover: the first dataset in order that says
    so, by cancelled day, gap hour, source gap (a missing day within its coverage) or outside.

    datasets: dataset, pos, start, end; days, cancelled: dataset, day; gaps: dataset, hour (epoch hours). Catalog tables,
    few rows each; instants are as many as asked for.
    """
    x = instants.select("at", F.date_from_unix_date(F.floor(F.col("at") / DAY).cast("int")).alias("day"), F.floor(F.col("at") / 3600).alias("hour")).distinct()
    x = x.select("*", F.explode(F.lit([r.dataset for r in datasets.select("dataset").distinct().collect()])).alias("dataset")).join(datasets, "dataset")
    mark = lambda d, n: d.distinct().withColumn(n, F.lit(True))
    x = x.join(mark(cancelled, "_c"), ["dataset", "day"], "left").join(mark(gaps, "_g"), ["dataset", "hour"], "left").join(mark(days, "_d"), ["dataset", "day"], "left")
    notice = F.when(F.col("_c"), "cancelled").when(F.col("_g"), "gap_hour").when(F.col("_d"), None).when(F.col("day").between(F.col("start"), F.col("end")), "source_gap").otherwise("outside")
    x = x.withColumn("notice", notice).filter("notice IS NOT NULL")
    return x.groupBy("at").agg(F.min(F.struct("pos", "dataset", "notice")).alias("m")).select("at", "m.dataset", "m.notice")


def linked(journeys: DataFrame, links: DataFrame, side: str) -> DataFrame:
    """dataset, journey, start, other_dataset, other_journey, kind: where a journey goes on (side 'from') or came from ('to').

    links: day, kind, from_dataset, from_journey, to_dataset, to_journey; the day is that of the journey's departure.
    """
    other = "to" if side == "from" else "from"
    l = links.select(F.col("day").alias("_day"), F.col(f"{side}_dataset").alias("dataset"), F.col(f"{side}_journey").alias("journey"), F.col(f"{other}_dataset").alias("other_dataset"), F.col(f"{other}_journey").alias("other_journey"), "kind")
    return journeys.withColumn("_day", departure_day("start")).join(l, ["dataset", "journey", "_day"]).select("dataset", "journey", "start", "other_dataset", "other_journey", "kind")


def of_groups(legs: DataFrame, groups: DataFrame, shown: list[str]) -> DataFrame:
    """Legs whose (dataset, type) belongs to a shown group; groups: dataset, type_id, group. Without an entry: 'other'."""
    g = groups.select("dataset", "type_id", F.col("group").alias("_g"))
    return legs.join(F.broadcast(g), ["dataset", "type_id"], "left").filter(F.coalesce("_g", F.lit("other")).isin(*shown)).drop("_g")


def journey_spans(legs: DataFrame) -> DataFrame:
    """start, end, first route and number of legs of every journey of every departure day."""
    first = F.struct("t_dep", "leg_id")
    return legs.groupBy(departure_day().alias("dep_day"), "service_day", "trip_id").agg(F.min("t_dep").alias("start"), F.max(F.col("t_dep") + F.col("dur")).alias("end"), F.min_by("route_id", first).cast("bigint").alias("route_id"), F.count(F.lit(1)).alias("legs"))


def journey_routes(legs: DataFrame) -> DataFrame:
    """Each journey's routes in order without immediate repeats: dep_day, service_day, trip_id, pos, route_id."""
    key = ["dep_day", "service_day", "trip_id"]
    w = Window.partitionBy(*key).orderBy("t_dep", "leg_id")
    x = legs.withColumn("dep_day", departure_day()).withColumn("_p", F.lag("route_id").over(w)).filter(~F.col("route_id").eqNullSafe(F.col("_p")))
    return x.select(*key, F.row_number().over(w).cast("bigint").alias("pos"), F.col("route_id").cast("bigint").alias("route_id"))


def station_board(legs: DataFrame, station: int, at: int, ahead: int = 7200) -> DataFrame:
    """Departures from a station from BOARD_BACK before `at` to `ahead` after it, with where each journey still goes that day.

    First pieces only. `calls`: the stations from here on, in order, without immediate repeats.
    """
    here = legs.filter((F.col("from_bpuic") == station) & F.col("t_dep").between(at - BOARD_BACK, at + ahead) & (F.col("route_start") == 0))
    here = here.select(departure_day().alias("dep_day"), "service_day", "trip_id", F.col("t_dep").alias("leaves"), F.col("leg_id").alias("at_leg"), "line", "delay")
    key = ["dep_day", "service_day", "trip_id"]
    days = legs.filter(F.col("t_dep").between((at - BOARD_BACK) // DAY * DAY, (at + ahead) // DAY * DAY + DAY - 1)).withColumn("dep_day", departure_day())
    rest = days.join(F.broadcast(here.select(*key, "leaves", "at_leg")), key).filter(F.col("t_dep") >= F.col("leaves"))
    calls = rest.groupBy("at_leg").agg(F.transform(F.array_sort(F.collect_list(F.struct("t_dep", "leg_id", "to_bpuic"))), lambda s: s["to_bpuic"]).alias("c"))
    calls = calls.select("at_leg", F.array_join(F.filter("c", lambda v, i: (i == 0) | ~v.eqNullSafe(F.get("c", i - 1))).cast("array<string>"), ">").alias("calls"))
    return here.join(calls, "at_leg").select(F.col("at_leg").alias("leg_id"), "service_day", "trip_id", "line", "leaves", F.col("delay").cast("bigint").alias("delay"), "calls")


def positioned(legs: DataFrame, at: int) -> DataFrame:
    """Where each journey is at `at`: service_day, trip_id, state, leg_id, fraction of the route, opacity.

    The current leg is the latest departed one. moving: on it; dwelling: it has arrived and another follows; arriving: it
    was the last, shown for FADE seconds; waiting: none departed, the first within FADE. Others are absent. A leg departed
    long ago still places its journey if another follows, so the window looks back a day.
    """
    x = legs.filter(F.col("t_dep").between(at - DAY, at + DAY))
    order = F.struct("t_dep", F.negative("leg_id").alias("l"))
    gone, ahead = F.col("t_dep") <= at, F.col("t_dep") > at
    leg = F.struct("leg_id", "t_dep", "dur", "route_start", "route_end")
    g = x.groupBy("service_day", "trip_id").agg(F.max_by(leg, F.when(gone, order)).alias("c"), F.min_by(leg, F.when(ahead, F.struct("t_dep", "leg_id"))).alias("n"))
    c, n = F.col("c"), F.col("n")
    end = c["t_dep"] + c["dur"]
    state = F.when(c.isNotNull() & (end >= at), "moving").when(c.isNotNull() & n.isNotNull(), "dwelling").when(c.isNotNull() & (end + FADE >= at), "arriving").when(c.isNull() & (n["t_dep"] - FADE <= at), "waiting")
    share = lambda f: (c["route_start"] + f * (c["route_end"] - c["route_start"])) / 255
    fraction = F.when(state == "moving", share((at - c["t_dep"]) / c["dur"])).when(state == "waiting", n["route_start"] / 255).otherwise(c["route_end"] / 255)
    opacity = F.when(state == "arriving", 1 - (at - end) / FADE).when(state == "waiting", 1 - (n["t_dep"] - at) / FADE).otherwise(1.0)
    g = g.select("service_day", "trip_id", state.alias("state"), F.when(c.isNotNull(), c["leg_id"]).otherwise(n["leg_id"]).alias("leg_id"), F.round(fraction, 6).alias("fraction"), F.round(opacity, 6).alias("opacity"))
    return g.filter("state IS NOT NULL")


def running(legs: DataFrame, bucket: int = 300) -> DataFrame:
    """Trains under way at each multiple of `bucket` seconds, by difference events: +1 where a leg begins to cover a mark, -1
    where it ends. Marks are pre-aggregated by day before the running sum, so no window holds more than a day's marks."""
    up = F.ceil(F.col("t_dep") / bucket) * bucket
    down = (F.floor((F.col("t_dep") + F.col("dur")) / bucket) + 1) * bucket
    marks = legs.filter("dur >= 0").select(F.inline(F.array(F.struct(up.alias("mark"), F.lit(1).alias("d")), F.struct(down.alias("mark"), F.lit(-1).alias("d")))))
    sums = marks.groupBy("mark").agg(F.sum("d").alias("d"))
    sums = sums.withColumn("day", F.floor(F.col("mark") / DAY))
    before = sums.groupBy("day").agg(F.sum("d").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("day", "base")
    within = F.sum("d").over(Window.partitionBy("day").orderBy("mark"))
    return sums.withColumn("r", within).join(before, "day").select("mark", (F.col("base") + F.col("r")).cast("bigint").alias("trains"))


def covered_day(days: DataFrame, wanted: str) -> DataFrame:
    """The covered day nearest to the wanted one; of two the later."""
    gap = F.abs(F.datediff(F.col("day"), F.lit(wanted).cast("date")))
    return days.select("day").distinct().agg(F.min_by("day", F.struct(gap, F.negative(F.unix_date("day")).alias("l"))).alias("day"))
