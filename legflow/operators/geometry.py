"""Routes over a rail graph: polylines, their grid form and binary pack, points along them, shortest paths."""

from __future__ import annotations

import heapq
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legflow.runtime import cut
from legflow.operators.spatial import M_PER_DEG

# Fixed values of the binary pack: magic, version, greatest grid number.
MAGIC, VERSION, GRID = b"BRTS", 1, 65_535
SNAP_M, SNAP_MOST, SNAP_COST, DETOUR, DETOUR_M, TOLERANCE_M = 300.0, 32, 10.0, 4.0, 10_000.0, 10.0
_LINE = "array<struct<lon: double, lat: double>>"


def flat_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column, lat0: float) -> Column:
    """Distance on a plane true at latitude lat0."""
    return F.hypot((lon2 - lon1) * (M_PER_DEG * math.cos(math.radians(lat0))), (lat2 - lat1) * M_PER_DEG)


def fitted_box(points: DataFrame, margin: float = 0.1) -> DataFrame:
    """west, south, east, north around the points, margin degrees wider."""
    return points.agg((F.min("lon") - margin).alias("west"), (F.min("lat") - margin).alias("south"), (F.max("lon") + margin).alias("east"), (F.max("lat") + margin).alias("north"))


def quantized(line: Column, box: tuple[float, float, float, float]) -> Column:
    """A polyline as grid points (x, y in 0..GRID; halves to even), immediate repeats dropped."""
    w, s, e, n = box
    at = lambda v, lo, hi: F.least(F.lit(GRID), F.greatest(F.lit(0), F.rint((v - lo) / (hi - lo) * GRID).cast("int")))
    grid = F.transform(line, lambda p: F.struct(at(p["lon"], w, e).alias("x"), at(p["lat"], s, n).alias("y")))
    return F.filter(grid, lambda p, i: (i == 0) | ~p.eqNullSafe(F.get(grid, i - 1)))


def dequantized(grid: Column, box: tuple[float, float, float, float]) -> Column:
    w, s, e, n = box
    return F.transform(grid, lambda p: F.struct((w + p["x"] / GRID * (e - w)).alias("lon"), (s + p["y"] / GRID * (n - s)).alias("lat")))


def pack(routes: list[tuple[int, int, list[tuple[int, int]]]], box: tuple[float, float, float, float]) -> bytes:
    """The binary pack of (id, flag, grid points): header, ids, offsets, flags, points; little endian."""
    out = [MAGIC, struct.pack("<II4d", VERSION, len(routes), *box), struct.pack(f"<{len(routes)}I", *(r[0] for r in routes))]
    at = np.cumsum([0, *(len(r[2]) for r in routes)])
    out += [at.astype("<u4").tobytes(), bytes(r[1] for r in routes)]
    out += [np.array([p for r in routes for p in r[2]], dtype="<u2").reshape(-1, 2).tobytes()]
    return b"".join(out)


def unpack(data: bytes) -> tuple[tuple[float, ...], list[tuple[int, int, list[tuple[int, int]]]]]:
    """Box and routes of a pack; raises ValueError on another magic or version, or on a cut file."""
    if data[:4] != MAGIC:
        raise ValueError("not a route pack")
    version, n, *box = struct.unpack_from("<II4d", data, 4)
    if version != VERSION:
        raise ValueError(f"route pack version {version}")
    at = 4 + struct.calcsize("<II4d")
    if len(data) < at + 9 * n + 4:
        raise ValueError("route pack is cut short")
    ids = np.frombuffer(data, "<u4", n, at)
    offsets = np.frombuffer(data, "<u4", n + 1, at + 4 * n)
    flags = np.frombuffer(data, "u1", n, at + 8 * n + 4)
    if len(data) < at + 9 * n + 4 + 4 * int(offsets[-1]):
        raise ValueError("route pack is cut short")
    xy = np.frombuffer(data, "<u2", 2 * int(offsets[-1]), at + 9 * n + 4).reshape(-1, 2)
    return tuple(box), [(int(ids[i]), int(flags[i]), [tuple(map(int, p)) for p in xy[offsets[i] : offsets[i + 1]]]) for i in range(n)]


def read_packs(files: DataFrame) -> DataFrame:
    """path, route_id, flag, grid of packs read by spark.read.format('binaryFile')."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows = [(path, i, f, [{"x": x, "y": y} for x, y in g]) for i, f, g in unpack(content)[1]]
                yield pd.DataFrame(rows, columns=["path", "route_id", "flag", "grid"])

    return files.select("path", "content").mapInPandas(run, "path string, route_id bigint, flag int, grid array<struct<x: int, y: int>>")


def along(routes: DataFrame, samples: DataFrame) -> DataFrame:
    """Points at a fraction of a route's length: samples' columns, lon, lat, bearing (degrees from north).

    routes: route_id, line (array of lon, lat). samples: route_id, fraction (clamped to 0..1), further columns. Lengths are
    flat with the cosine at each segment's middle. Each route's cumulative lengths are computed once, in place; a route of
    one point gives that point with a null bearing, one of none nothing.
    """
    seg = lambda a, b: F.hypot((b["lon"] - a["lon"]) * F.cos(F.radians((a["lat"] + b["lat"]) / 2)), b["lat"] - a["lat"])
    line = F.col("line")
    r = routes.filter(F.size("line") > 0).withColumn("_s", F.transform(F.sequence(F.lit(0), F.greatest(F.size("line") - 2, F.lit(0))), lambda i: F.coalesce(seg(line[i], F.get(line, i + 1)), F.lit(0.0))))
    zero = F.array(F.lit(0.0))
    r = r.withColumn("_c", F.aggregate("_s", zero, lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))))
    x = samples.join(r.select("route_id", "line", "_c"), "route_id")
    want = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fraction"))) * F.element_at("_c", -1)
    x = x.withColumn("_w", want).withColumn("_i", F.greatest(F.lit(1), F.least(F.size("line") - 1, F.size(F.filter("_c", lambda c: c <= F.col("_w"))))))
    a, b = F.get("line", F.col("_i") - 1), F.get("line", F.col("_i"))
    c0, c1 = F.get("_c", F.col("_i") - 1), F.get("_c", F.col("_i"))
    f = F.coalesce(F.try_divide(F.col("_w") - c0, c1 - c0), F.lit(0.0))
    mix = lambda k: a[k] + f * (F.coalesce(b[k], a[k]) - a[k])
    turn = F.degrees(F.atan2((b["lon"] - a["lon"]) * F.cos(F.radians((a["lat"] + b["lat"]) / 2)), b["lat"] - a["lat"]))
    return x.select(*samples.columns, mix("lon").alias("lon"), mix("lat").alias("lat"), F.pmod(turn, F.lit(360.0)).alias("bearing"))


def simplified(points: np.ndarray, tolerance: float = TOLERANCE_M) -> np.ndarray:
    """Indices a polyline (metres, n x 2) keeps: none of the others lies further than `tolerance` from the line left.

    Ranges are split at their furthest point from a list, so long lines need no deep recursion.
    """
    n = len(points)
    keep = np.zeros(n, dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, n - 1)]
    while todo:
        i, j = todo.pop()
        if j <= i + 1:
            continue
        a, b, p = points[i], points[j], points[i + 1 : j]
        d = b - a
        length = float(d @ d)
        t = np.clip(((p - a) @ d) / length, 0, 1) if length else np.zeros(len(p))
        off = np.hypot(*(p - (a + t[:, None] * d)).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return np.flatnonzero(keep)


def shortest(edges: dict[int, list[tuple[int, float]]], source: int, targets: set[int]) -> dict[int, tuple[float, list[int]]]:
    """Cost and path from the source to each target it reaches; stops once all are settled."""
    best, before, done, left = {source: 0.0}, {}, set(), set(targets)
    heap = [(0.0, source)]
    while heap and left:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        left.discard(u)
        for v, w in edges.get(u, ()):
            if d + w < best.get(v, math.inf):
                best[v], before[v] = d + w, u
                heapq.heappush(heap, (d + w, v))
    out = {}
    for t in targets & done:
        path, u = [t], t
        while u != source:
            u = before[u]
            path.append(u)
        out[t] = (best[t], path[::-1])
    return out


def snapped(stations: DataFrame, nodes: DataFrame) -> DataFrame:
    """station, node, metres: at most SNAP_MOST nearest graph nodes within SNAP_M of each station.

    stations: station, lon, lat. nodes: node, lon, lat. Candidates meet in cells of SNAP_M.
    """
    from pyspark.sql import Window

    from legflow.operators.spatial import great_circle_m

    cell = SNAP_M / M_PER_DEG
    row = F.floor(F.col("lat") / cell)
    wide = lambda r: cell / F.greatest(F.cos(F.radians(F.least(F.abs(r * cell), F.abs((r + 1) * cell)))), F.lit(0.01))
    three = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    s = stations.withColumn("r", row).withColumn("r", three("r")).withColumn("c", F.floor(F.col("lon") / wide(F.col("r")))).withColumn("c", three("c"))
    n = nodes.select("node", F.col("lon").alias("x"), F.col("lat").alias("y")).withColumn("r", F.floor(F.col("y") / cell)).withColumn("c", F.floor(F.col("x") / wide(F.col("r"))))
    j = s.join(n, ["r", "c"]).withColumn("metres", great_circle_m(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))).filter(F.col("metres") <= SNAP_M)
    k = F.row_number().over(Window.partitionBy("station").orderBy("metres", "node"))
    return j.withColumn("_k", k).filter(F.col("_k") <= SNAP_MOST).select("station", "node", "metres")


MOST_NODES = 5_000_000


def routed(pairs: DataFrame, stations: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """route_id, line, metres, reason of each pair of stations over an undirected rail graph.

    pairs: route_id, from_station, to_station. edges: u, v. Each station is a node of its own, tied to the nodes near it at
    SNAP_COST a metre. A pair gets the straight line instead, with a reason: unsnappable (an end has no node near),
    unreachable, absurd_detour (over DETOUR times the straight way and DETOUR_M longer). Sources are spread over the
    executors; the graph goes to each of them, so it must fit a worker: over MOST_NODES nodes, edges or stations in use
    raise (a country's rails are under a million nodes, some 10 MB).
    """
    import builtins

    spark = pairs.sparkSession
    used = pairs.select(F.col("from_station").alias("station")).union(pairs.select("to_station")).distinct()
    stations = cut(stations.join(used, "station", "left_semi"))
    for what, d in (("nodes", nodes), ("edges", edges), ("stations", stations)):
        if d.limit(MOST_NODES + 1).count() > MOST_NODES:
            raise ValueError(f"over {MOST_NODES} {what}: route one region at a time")
    snaps: dict[int, list[tuple[int, float]]] = {}
    for r in snapped(stations, nodes).collect():
        snaps.setdefault(r.station, []).append((r.node, r.metres))
    place = {r.node: (r.lon, r.lat) for r in nodes.collect()}
    home = {r.station: (r.lon, r.lat) for r in stations.collect()}
    lat0 = sum(p[1] for p in place.values()) / builtins.max(1, len(place))
    kx = M_PER_DEG * math.cos(math.radians(lat0))
    metres = lambda p, q: math.hypot((q[0] - p[0]) * kx, (q[1] - p[1]) * M_PER_DEG)
    graph: dict[int, list[tuple[int, float]]] = {}
    for u, v in edges.select("u", "v").collect():
        if u in place and v in place:
            w = metres(place[u], place[v])
            graph.setdefault(u, []).append((v, w))
            graph.setdefault(v, []).append((u, w))
    shared = spark.sparkContext.broadcast((graph, place, home, snaps, kx))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        graph, place, home, snaps, kx = shared.value
        source, out = key[0], []
        far = lambda p, q: math.hypot((q[0] - p[0]) * kx, (q[1] - p[1]) * M_PER_DEG)
        local = {-1: [(n, d * SNAP_COST) for n, d in snaps.get(source, ())]}
        ends: dict[int, list[tuple[int, float]]] = {}
        for k, t in enumerate(g["to_station"]):
            for n, d in snaps.get(t, ()):
                ends.setdefault(n, []).append((-2 - k, d * SNAP_COST))

        class Joined(dict):
            def get(self, u: int, default: tuple = ()) -> list:
                return [*local.get(u, ()), *(graph.get(u, ()) if u >= 0 else ()), *ends.get(u, ())]

        found = shortest(Joined(), -1, {-2 - k for k in range(len(g))})
        for k, (rid, t) in enumerate(zip(g["route_id"], g["to_station"])):
            a, b = home.get(source), home.get(t)
            direct = [p for p in (a, b) if p]
            reason, line = None, direct
            if not snaps.get(source) or not snaps.get(t):
                reason = "unsnappable"
            elif -2 - k not in found:
                reason = "unreachable"
            else:
                line = [a, *(place[n] for n in found[-2 - k][1] if n >= 0), b]
                long = sum(far(p, q) for p, q in zip(line, line[1:]))
                if long > DETOUR * far(a, b) and long - far(a, b) > DETOUR_M:
                    reason, line = "absurd_detour", direct
            xy = np.array([(p[0] * kx, p[1] * M_PER_DEG) for p in line])
            line = [line[i] for i in simplified(xy)] if len(line) > 2 else line
            out.append((rid, [{"lon": p[0], "lat": p[1]} for p in line], sum(far(p, q) for p, q in zip(line, line[1:])), reason))
        return pd.DataFrame(out, columns=["route_id", "line", "metres", "reason"])

    return pairs.groupBy("from_station").applyInPandas(run, f"route_id bigint, line {_LINE}, metres double, reason string")


def network(routes: DataFrame) -> DataFrame:
    """Distinct undirected segments of grid polylines with the number of routes over each: ax, ay, bx, by, routes."""
    q = routes.select("route_id", F.transform("grid", lambda g, i: F.struct(g.alias("a"), F.get("grid", i + 1).alias("b"))).alias("s"))
    s = q.select("route_id", F.explode("s").alias("s")).filter("s.b IS NOT NULL")
    lo, hi = F.least("s.a", "s.b"), F.greatest("s.a", "s.b")
    return s.select("route_id", lo.alias("a"), hi.alias("b")).distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("routes")).select(F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"), "routes")
