"""Journeys and duplicates across datasets: crosswalk, visits, verdicts on pairs, one continuation each, hidden copies."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legflow.operators.spatial import M_PER_DEG, great_circle_m, has_position
from legflow.runtime import cut

# Distances in metres and times in seconds of the linking rules.
NEAR_SIMILAR, NEAR_EQUAL, NEAR_ANY = 400, 1000, 60
SHARED, BRIDGE, BRIDGE_M, SPEED, TURN = 600, (60, 5400), 100_000, (4, 70), 135
ORDER = ("handover", "overlap", "bridge")
HIDE = 180


# Words that say nothing of which place a name means.
NOISE = ('bf', 'bahnhof', 'hbf', 'station', 'gare', 'stazione', 'centraal', 'sncf', 'db', 'sbb', 'cff', 'ffs', 'bhf', 'de', 'd', 'la', 'le', 'st', 'sankt', 'saint')


def _folded_letters() -> tuple[str, str]:
    """Lower-case letters of the extended Latin blocks that are a plain letter with marks, and those plain letters."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in [*range(0xDF, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(x, y[0]) for x, y in pairs if x == x.lower() and y[0].isascii() and y[0].isalpha() and all(map(unicodedata.combining, y[1:]))]
    return "".join(x for x, _ in pairs), "".join(y for _, y in pairs)


MARKED, PLAIN = _folded_letters()


def squashed(name: Column) -> Column:
    """A name for comparison: lower case, marks off the letters of the Latin alphabets, loose marks dropped, words (letters of
    any alphabet and digits) apart by single blanks."""
    plain = F.regexp_replace(F.translate(F.lower(name), MARKED, PLAIN), r"\p{M}+", "")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def words(name: Column) -> Column:
    """The different words of a name without NOISE; all of them where nothing else is left."""
    all_ = F.array_distinct(F.split(squashed(name), " "))
    some = F.array_except(all_, F.array(*map(F.lit, NOISE)))
    return F.when(F.size(some) > 0, some).otherwise(all_)


def similar(a: Column, b: Column) -> Column:
    """Of two word sets one holds the other, or they share half of all their words."""
    both = F.size(F.array_intersect(a, b))
    return (both == F.size(a)) | (both == F.size(b)) | (both * 2 >= F.size(F.array_union(a, b)))


def crosswalk_pairs(stations: DataFrame) -> DataFrame:
    """Each station's best partner in every later dataset: near and similar, else named alike, else at one spot.

    stations: dataset (ordered), id, name, lon, lat. Candidates meet in grid cells as wide as the greatest distance; the
    earlier dataset's side chooses, so several of its stations may share one.
    """
    cell = NEAR_EQUAL / M_PER_DEG
    p = stations.filter(has_position()).select("dataset", "id", squashed(F.col("name")).alias("n"), words(F.col("name")).alias("w"), "lon", "lat", F.floor(F.col("lat") / cell).alias("r"))
    wide = lambda r: cell / F.greatest(F.cos(F.radians(F.least(F.abs(r * cell), F.abs((r + 1) * cell)))), F.lit(0.01))
    col = lambda d: d.withColumn("c", F.floor(F.col("lon") / wide(F.col("r"))))
    three = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    a = col(p.withColumn("r", three("r"))).withColumn("c", three("c"))
    a = a.select(*[F.col(k).alias(f"a_{k}") for k in ("dataset", "id", "n", "w", "lon", "lat")], "r", "c")
    b = col(p).select(*[F.col(k).alias(f"b_{k}") for k in ("dataset", "id", "n", "w", "lon", "lat")], "r", "c")
    x = a.join(b, ["r", "c"]).filter("a_dataset < b_dataset").withColumn("d", great_circle_m(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat")))
    rank = F.when((F.col("d") <= NEAR_SIMILAR) & similar(F.col("a_w"), F.col("b_w")), 0).when((F.col("d") <= NEAR_EQUAL) & (F.col("a_n") == F.col("b_n")), 1).when(F.col("d") <= NEAR_ANY, 2)
    x = x.withColumn("rank", rank).filter("rank IS NOT NULL").groupBy("a_dataset", "a_id", "b_dataset").agg(F.min_by(F.struct("b_id", "rank", "d"), F.struct("rank", "d", "b_id")).alias("s"))
    return x.select("a_dataset", "a_id", "b_dataset", F.col("s.b_id").alias("b_id"), F.col("s.rank").cast("bigint").alias("rank"), F.round("s.d", 3).alias("d"))


def components(edges: DataFrame, a: str, b: str, rounds: int = 200) -> DataFrame:
    """node, component (its least node) of undirected edges, by alternating large-star and small-star steps.

    Each step joins neighbours to the least of them; the number of steps is logarithmic in the longest path. Every round is
    written down, and the loop ends when a round changes nothing; `rounds` of them without an end are an error.
    """
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).distinct()
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select("v", "m").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        done = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if done.exceptAll(e).isEmpty() and e.exceptAll(done).isEmpty():
            break
        e = done
    else:
        raise ArithmeticError(f"components are not done after {rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots, nodes.node == roots.u, "left").select("node", F.coalesce("component", "node").alias("component"))


def visits(legs: DataFrame) -> DataFrame:
    """service_day, trip_id, side, station, t: a departure where a leg begins its route, an arrival where it ends it."""
    side = lambda ok, name, station, t: F.when(ok, F.struct(F.lit(name).alias("side"), F.col(station).alias("station"), t.alias("t")))
    dep = side(F.col("route_start") == 0, "dep", "from_bpuic", F.col("t_dep"))
    arr = side(F.col("route_end") == 255, "arr", "to_bpuic", F.col("t_dep") + F.col("dur"))
    return legs.select("service_day", "trip_id", F.inline(F.array_compact(F.array(dep, arr))))


def train_number(trip: Column) -> Column:
    """The number in a trip id: of `a:b:c:number-rest` the part before the first dash of the last field, digits only."""
    last = F.try_element_at(F.split(trip, ":"), F.lit(-1))
    n = F.get(F.split(last, "-"), 0)
    return F.when(n.rlike("^[0-9]+$"), F.ltrim(n, F.lit("0")))


def _bearing(a: Column, b: Column) -> Column:
    """Degrees from north of the way from a to b (structs of lon, lat), flat at a's latitude."""
    return F.degrees(F.atan2((b["lon"] - a["lon"]) * F.cos(F.radians(a["lat"])), b["lat"] - a["lat"]))


def _turn(x: Column, y: Column) -> Column:
    return F.abs(F.pmod(y - x + 540, F.lit(360.0)) - 180)


def judged(first: DataFrame, second: DataFrame, home: tuple[str, str] | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Verdict on pairs of journeys of two datasets with one number on one day: handover, overlap or bridge.

    first, second: day, number, journey, pos (of its calls, from 0), last (its greatest pos), side, station (a group shared
    by both datasets, or null), country, lon, lat, t. No link where the second starts before the first starts. With a
    shared station within SHARED seconds: none if the second ends no later than the first; handover where that is the
    first's last and the second's first call, else overlap. Otherwise a bridge from the first's last arrival to the second's
    first departure, of BRIDGE seconds, up to BRIDGE_M metres and at a train's SPEED; each end in its own country (home:
    that of first and of second; None asks no country); neither end a station the other dataset has (seen: their
    groups); and turning by TURN degrees at most at either end, where the journeys have a call elsewhere.
    """
    a, b = _itineraries(first), _itineraries(second)
    return _verdicts(a, b, _meetings(a, b), home, seen)


def _itineraries(calls: DataFrame) -> DataFrame:
    """day, number, journey, c: a journey's calls in their order, as an array. Written down: it is read several times."""
    call = F.struct("pos", "last", "t", "side", "station", "country", "lon", "lat")
    return cut(calls.groupBy("day", "number", "journey").agg(F.array_sort(F.collect_list(call)).alias("c")))


def _ends(itineraries: DataFrame, x: str) -> DataFrame:
    """day, number, and of each journey: journey, first and last call, the nearest call to either that is elsewhere, as *_x."""
    at = lambda c: F.concat_ws("|", c["lon"], c["lat"])
    c = F.col("c")
    elsewhere = lambda end: F.filter(c, lambda e: at(e) != at(end))
    start, end = F.get(c, F.lit(0)), F.get(c, F.size(c) - 1)
    after, before = F.get(elsewhere(start), F.lit(0)), F.get(elsewhere(end), F.size(elsewhere(end)) - 1)
    return itineraries.select("day", "number", *[e.alias(f"{n}_{x}") for n, e in (("journey", F.col("journey")), ("start", start), ("end", end), ("after", after), ("before", before))])


def _meetings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of journeys with a shared station within SHARED seconds: times of their ends, the first of these calls in the
    order of a (m) and of b (w). Calls meet in ranges of SHARED seconds. Written down."""
    def calls(d: DataFrame, x: str) -> DataFrame:
        c = F.col("c")
        d = d.select("day", "number", F.col("journey").alias(f"journey_{x}"), F.get(c, F.lit(0))["t"].alias(f"start_{x}"), F.get(c, F.size(c) - 1)["t"].alias(f"end_{x}"), F.explode(F.filter(c, lambda e: e["station"].isNotNull())).alias("e"))
        return d.select("day", "number", f"journey_{x}", f"start_{x}", f"end_{x}", "e.station", *[F.col(f"e.{n}").alias(f"{n}_{x}") for n in ("pos", "last", "t")])

    span = lambda t: F.floor(F.col(t) / SHARED)
    left = calls(a, "a").withColumn("_h", span("t_a"))
    right = calls(b, "b").withColumn("_h", F.explode(F.array(span("t_b") - 1, span("t_b"), span("t_b") + 1)))
    x = left.join(right, ["day", "number", "station", "_h"]).filter(F.abs(F.col("t_a") - F.col("t_b")) <= SHARED)
    spot = F.struct("pos_a", "last_a", "pos_b", "last_b")
    times = [F.first(c).alias(c) for c in ("start_a", "end_a", "start_b", "end_b")]
    return cut(x.groupBy("day", "number", "journey_a", "journey_b").agg(F.min_by(spot, F.struct("pos_a", "pos_b")).alias("m"), F.min_by(spot, F.struct("pos_b", "pos_a")).alias("w"), *times))


def _verdicts(first: DataFrame, second: DataFrame, meet: DataFrame, home: tuple[str, str] | None, seen: DataFrame | None) -> DataFrame:
    """judged() of _itineraries() and the _meetings() of the two.

    Journeys that meet say their verdict by themselves; others can only be bridges, whose ends come together in ranges of
    the longest bridge. So the pairs of all journeys of a number and day are never written anywhere.
    """
    key = ["day", "number", "journey_a", "journey_b"]
    m = F.col("m")
    shared = meet.filter((F.col("start_b") >= F.col("start_a")) & ~F.coalesce(F.col("end_b") <= F.col("end_a"), F.lit(False)))
    kind = F.when((m["pos_a"] == m["last_a"]) & (m["pos_b"] == 0), "handover").otherwise("overlap")
    shared = shared.select(*key, kind.alias("kind"), F.lit(None).cast("bigint").alias("dur"), F.lit(None).cast("bigint").alias("t_dep"))

    a, b = F.col("end_a"), F.col("start_b")
    ea, eb = _ends(first, "a").filter(a["side"] == "arr"), _ends(second, "b").filter(b["side"] == "dep")
    if home:
        ea, eb = ea.filter(a["country"] == home[0]), eb.filter(b["country"] == home[1])
    if seen is not None:
        g = seen.select(F.col("station").alias("_g")).distinct()
        ea, eb = ea.join(g, a["station"] == F.col("_g"), "left_anti"), eb.join(g, b["station"] == F.col("_g"), "left_anti")
    h = F.floor(a["t"] / BRIDGE[1])
    x = ea.withColumn("_h", F.explode(F.array(h, h + 1))).join(eb.withColumn("_h", F.floor(b["t"] / BRIDGE[1])), ["day", "number", "_h"])
    gap = b["t"] - a["t"]
    dist = great_circle_m(a["lon"], a["lat"], b["lon"], b["lat"])
    across = _bearing(a, b)
    turns = F.greatest(_turn(_bearing(F.col("before_a"), a), across), _turn(across, _bearing(b, F.col("after_b"))))
    bridge = (F.col("start_b.t") >= F.col("start_a.t")) & gap.between(*BRIDGE) & (dist <= BRIDGE_M) & (dist / F.nullif(gap, F.lit(0))).between(*SPEED)
    bridge &= F.when(F.col("before_a").isNotNull() & F.col("after_b").isNotNull(), turns <= TURN).otherwise(True)
    bridges = x.filter(bridge).select(*key, F.lit("bridge").alias("kind"), gap.cast("bigint").alias("dur"), a["t"].cast("bigint").alias("t_dep"))
    return shared.unionByName(bridges.join(meet.select(*key), key, "left_anti"))


def linked_days(a: DataFrame, b: DataFrame, home: tuple[str, str] | None = None, seen: tuple[DataFrame, DataFrame] | bool | None = None) -> DataFrame:
    """from_side ('a' or 'b') and the verdicts of judged() in both directions; a bridge leaves on the UTC day it is filed under.

    a, b: calls of two datasets, see judged(). seen: groups of stations that a has, and that b has; both are taken from the
    calls where it is True.
    """
    x, y = _itineraries(a), _itineraries(b)
    if seen is True:
        seen = tuple(d.select(F.explode(F.transform("c", lambda e: e["station"])).alias("station")) for d in (x, y))
    # neither end may be a station the other dataset has: shared ones are those of both
    shared = cut(seen[0].select("station").distinct().join(seen[1].select("station").distinct(), "station", "left_semi")) if seen else None
    meet = _meetings(x, y)
    turned = F.struct(*[F.col(f"w.{n}_{s}").alias(f"{n}_{o}") for s, o in (("b", "a"), ("a", "b")) for n in ("pos", "last")])
    back = meet.select("day", "number", turned.alias("m"), *[F.col(f"{n}_{s}").alias(f"{n}_{o}") for s, o in (("b", "a"), ("a", "b")) for n in ("journey", "start", "end")])
    both = _verdicts(x, y, meet, home, shared).withColumn("from_side", F.lit("a")).unionByName(_verdicts(y, x, back, home[::-1] if home else None, shared).withColumn("from_side", F.lit("b")))
    day = F.date_from_unix_date(F.floor(F.col("t_dep") / 86_400).cast("int"))
    return both.filter((F.col("kind") != "bridge") | (day == F.col("day")))


def nearest_of(points: DataFrame, targets: DataFrame, reach_m: float = 20_000.0) -> DataFrame:
    """id, metres of each point to the nearest target: points (id, lon, lat), targets (lon, lat).

    Points and targets meet in cells `reach_m` wide; points without a target that near go on with a reach eight times as
    wide, at last all round the earth, so nobody is compared with everybody while near targets exist.
    """
    t = targets.filter(has_position()).select(F.col("lon").alias("x"), F.col("lat").alias("y")).distinct()
    left, done = cut(points.filter(has_position()).select("id", "lon", "lat").distinct()), None
    while not left.isEmpty():
        deg = min(360.0, reach_m / M_PER_DEG)
        wide = lambda r: F.least(F.lit(360.0), deg / F.greatest(F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(r * deg), F.abs((r + 1) * deg))))), F.lit(1e-6)))
        row = lambda c: F.floor(F.col(c) / deg)
        cols = lambda c: F.greatest(F.lit(1), F.floor(360.0 / wide(F.col("r")))).cast("int")
        column = lambda c: F.floor((F.col(c) + 180) / 360 * cols(c)).cast("int")
        a = left.withColumn("r", F.explode(F.array(row("lat") - 1, row("lat"), row("lat") + 1)))
        a = a.withColumn("c", F.explode(F.array_distinct(F.array(*[F.pmod(column("lon") + i, cols("lon")) for i in (-1, 0, 1)]))))
        b = t.withColumn("r", row("y")).withColumn("c", F.pmod(column("x"), cols("x")))
        d = great_circle_m(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))
        near = a.join(b, ["r", "c"]).groupBy("id", "lon", "lat").agg(F.min(d).alias("metres"))
        if deg < 360:
            near = near.filter(F.col("metres") <= reach_m)
        near = cut(near)
        done = near if done is None else done.unionByName(near)
        if deg >= 360:
            break
        left, reach_m = cut(left.join(near.select("id", "lon", "lat"), ["id", "lon", "lat"], "left_anti")), reach_m * 8
    return (done if done is not None else left.withColumn("metres", F.lit(None).cast("double"))).groupBy("id").agg(F.min("metres").alias("metres"))


def edge_distances(bridges: DataFrame, stations: DataFrame) -> DataFrame:
    """dataset, station, other, metres: from every end of a bridge to the nearest station the other side's dataset has.

    bridges: from_dataset, from_station, to_dataset, to_station; stations: dataset, id, lon, lat.
    """
    ends = bridges.select(F.col("from_dataset").alias("dataset"), F.col("from_station").alias("station"), F.col("to_dataset").alias("other"))
    ends = cut(ends.unionByName(bridges.select(F.col("to_dataset"), F.col("to_station"), F.col("from_dataset")).toDF("dataset", "station", "other")).distinct())
    at = ends.join(stations.withColumnRenamed("id", "station"), ["dataset", "station"])
    out = None
    for r in ends.select("other").distinct().collect():  # datasets: a handful
        near = nearest_of(at.filter(F.col("other") == r.other).select(F.struct("dataset", "station").alias("id"), "lon", "lat"), stations.filter(F.col("dataset") == r.other))
        near = near.select("id.dataset", "id.station", F.lit(r.other).alias("other"), "metres")
        out = near if out is None else out.unionByName(near)
    return out if out is not None else ends.withColumn("metres", F.lit(None).cast("double"))


BRIDGE_ROUTE, BRIDGE_FLAG = 0x10000, 128  # fixed values: where routes of bridges begin, and their flag


def bridge_legs(bridges: DataFrame, at: int, ahead: int) -> DataFrame:
    """Bridges (dataset, journey, route, t_dep, dur, type_id, delay) that leave within [at, ahead] as legs of their first journey."""
    x = bridges.filter(F.col("t_dep").between(at, ahead))
    return x.select("dataset", (F.col("route") + BRIDGE_ROUTE).alias("route_id"), F.col("journey").alias("journey_id"), F.lit(0).alias("route_start"), F.lit(1).alias("route_end"), "t_dep", "dur", "type_id", "delay", F.lit(BRIDGE_FLAG).alias("flags"))


def linked_ends(links: DataFrame, drawn: list[str]) -> DataFrame:
    """day, dataset, journey, side: 'end' of journeys that go on in another dataset, 'start' of those that came from one; only
    where both datasets are drawn."""
    x = links.filter(F.col("from_dataset").isin(*drawn) & F.col("to_dataset").isin(*drawn))
    ends = F.array(F.struct(F.col("from_dataset").alias("dataset"), F.col("from_journey").alias("journey"), F.lit("end").alias("side")), F.struct(F.col("to_dataset").alias("dataset"), F.col("to_journey").alias("journey"), F.lit("start").alias("side")))
    return x.select("day", F.inline(ends)).distinct()


def one_per_end(links: DataFrame) -> DataFrame:
    """Greedy matching a day in order of (kind, dur, journey_a, journey_b): a journey continues into one and from one.

    A link is decided as soon as it comes first at both its ends among those left: taken, and its rivals go. Rounds repeat
    until none is left; each is two windows over small groups, so a hot day is no single task.
    """
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    left = cut(links.withColumn("_o", F.struct(rank.alias("k"), F.coalesce("dur", F.lit(0)).alias("d"), "journey_a", "journey_b")))
    taken = None
    while not left.isEmpty():
        best = lambda e: F.min("_o").over(Window.partitionBy("day", e))
        x = left.withColumn("_w", (F.col("_o") == best("journey_a")) & (F.col("_o") == best("journey_b")))
        won = cut(x.filter("_w").drop("_w").dropDuplicates(["day", "_o"]))
        taken = won if taken is None else taken.unionByName(won)
        for e in ("journey_a", "journey_b"):
            left = left.join(won.select("day", e), ["day", e], "left_anti")
        left = cut(left.select(*won.columns))
    return (links if taken is None else taken).select(*links.columns)


EDGE_M = 60_000  # furthest a bridge's end may lie from the other dataset


def bridge_pairs(bridges: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Which crossings to believe: from_station, to_station, days, numbers, per_day, median, consistent, both_ways, accepted.

    bridges: day, from_station, to_station, number, dur. Accepted: 3 days or more; both ways or 2 a day; 5 numbers (8 one
    way); 60 % within the greater of 300 s and 30 % of the median; with edges (station, metres: see edge_distances()) both
    ends at most EDGE_M from the other dataset.
    """
    key = ["from_station", "to_station"]
    s = bridges.groupBy(*key).agg(F.countDistinct("day").alias("days"), F.countDistinct("number").alias("numbers"), F.count(F.lit(1)).alias("n"), F.percentile("dur", 0.5).alias("median"))
    near = bridges.join(s.select(*key, "median"), key).groupBy(*key).agg(F.avg((F.abs(F.col("dur") - F.col("median")) <= F.greatest(F.lit(300.0), 0.3 * F.col("median"))).cast("double")).alias("consistent"))
    back = s.select(F.col("to_station").alias("from_station"), F.col("from_station").alias("to_station"), (F.col("days") >= 3).alias("both_ways"))
    x = s.join(near, key).join(back, key, "left").withColumn("both_ways", F.coalesce("both_ways", F.lit(False))).withColumn("per_day", F.round(F.col("n") / F.col("days"), 6))
    ok = (F.col("days") >= 3) & (F.col("both_ways") | (F.col("per_day") >= 2)) & (F.col("numbers") >= F.when(F.col("both_ways"), 5).otherwise(8)) & (F.col("consistent") >= 0.6)
    if edges is not None:
        for k in key:
            x = x.join(edges.select(F.col("station").alias(k), F.col("metres").alias(f"_{k}")), k, "left")
        ok &= F.coalesce(F.greatest("_from_station", "_to_station") <= EDGE_M, F.lit(False))
    return x.select(*key, "days", "numbers", "per_day", "median", F.round("consistent", 6).alias("consistent"), "both_ways", ok.alias("accepted"))


def hidden_copies(legs: DataFrame, window_s: int = HIDE) -> DataFrame:
    """id, hidden: a leg is hidden iff a shown leg of another dataset with a lower rank departs within window_s of it.

    legs: id, place (what must be equal), dataset, rank, t_dep. Only shown legs hide others, so ranks are decided in
    order: as many rounds of a semi join as there are ranks. Pairs meet in ranges of window_s, never in a whole place.
    """
    x = cut(legs.select("id", "place", "dataset", "rank", "t_dep").withColumn("_b", F.floor(F.col("t_dep") / window_s)))
    ranks = sorted(r.rank for r in x.select("rank").distinct().collect())
    shown, hidden = None, None
    for r in ranks:
        mine = x.filter(F.col("rank") == r)
        if shown is None:
            shown, hidden = mine, x.filter(F.lit(False)).select("id")
            continue
        rival = shown.select("place", F.col("dataset").alias("_d"), F.col("t_dep").alias("_t"), F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"))
        on = ["place", "_b"]
        hit = cut(mine.join(rival, on).filter((F.col("dataset") != F.col("_d")) & (F.abs(F.col("t_dep") - F.col("_t")) <= window_s)).select("id").distinct())
        hidden = hidden.unionByName(hit)
        shown = shown.unionByName(mine.join(hit, "id", "left_anti").select(*shown.columns))
    if hidden is None:
        return x.select("id", F.lit(False).alias("hidden"))
    return x.select("id").join(hidden.withColumn("hidden", F.lit(True)), "id", "left").select("id", F.coalesce("hidden", F.lit(False)).alias("hidden"))

