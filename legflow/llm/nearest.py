"""Records of two tables paired with the nearest in time of the same entity within a tolerance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE_S = 86_400


def nearest_times(left: DataFrame, right: DataFrame, tolerance: int, range_s: int = RANGE_S) -> DataFrame:
    """entity, t, rt: of each distinct (entity, t) the nearest time rt of the entity in `right`, at most `tolerance` away.

    Both tables: entity (any type that casts to string), t (bigint). Of two times equally near the earlier wins. Both sides
    are reduced to distinct (entity, t) before the shuffle and cut into ranges of range_s, the right one with margins of
    `tolerance` into its neighbours, so an entity that holds a third of all rows still comes in groups of at most
    range_s + 2 * tolerance times. A group holds the entities of one hash bucket in one range; in it both sides are sorted
    by (entity, t) once and a binary search finds each left time's two neighbours. Null entities and times pair with none.
    """
    spark = left.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    where = F.pmod(F.xxhash64("e"), F.lit(buckets)).cast("int")
    one = lambda d: d.select(F.col("entity").cast("string").alias("e"), F.col("t").cast("bigint").alias("t")).filter("e IS NOT NULL AND t IS NOT NULL").distinct()
    a = one(left).select(where.alias("b"), F.floor(F.col("t") / range_s).alias("r"), "e", "t")
    span = F.sequence(F.floor((F.col("t") - tolerance) / range_s), F.floor((F.col("t") + tolerance) / range_s))
    b = one(right).select(where.alias("b"), F.explode(span).alias("r"), "e", "t")

    def search(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"e": pd.Series(dtype=str), "t": pd.Series(dtype="int64"), "rt": pd.Series(dtype="int64")})
        code, _ = pd.factorize(pd.concat([x["e"], y["e"]], ignore_index=True))
        t = np.concatenate([x["t"].to_numpy(), y["t"].to_numpy()])
        base, width = t.min(), int(t.max() - t.min()) + 2 * tolerance + 2
        # one number orders by entity, then time; entities lie further apart than the tolerance reaches
        k = code.astype(np.int64) * width + (t - base)
        kx, ky = k[: len(x)], np.sort(k[len(x) :])
        at = np.searchsorted(ky, kx)
        far = np.iinfo(np.int64).max
        before = np.where(at > 0, ky[np.maximum(at - 1, 0)], 0)
        after = np.where(at < len(ky), ky[np.minimum(at, len(ky) - 1)], 0)
        db = np.where(at > 0, kx - before, far)
        da = np.where(at < len(ky), after - kx, far)
        d = np.minimum(db, da)
        ok = d <= tolerance
        near = np.where(db <= da, before, after)
        xt = x["t"].to_numpy()
        return pd.DataFrame({"e": x["e"].to_numpy()[ok], "t": xt[ok], "rt": (xt + (near - kx))[ok]})

    found = a.groupBy("b", "r").cogroup(b.groupBy("b", "r")).applyInPandas(search, "e string, t bigint, rt bigint")
    return found.select(F.col("e").alias("entity"), "t", "rt")


def train_number(c: str) -> Column:
    """The digits of a train number without words and leading zeros; of several groups of digits the last. Null if none."""
    digits = F.regexp_extract(F.col(c), r"([0-9]+)[^0-9]*$", 1)
    return F.when(digits != "", F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0")))


def seconds(c: str) -> Column:
    """Epoch seconds of a time that may be in milliseconds."""
    t = F.col(c).cast("bigint")
    return F.when(F.abs(t) > 100_000_000_000, F.floor(t / 1000)).otherwise(t)


def runs_with_trips(runs: DataFrame, trips: DataFrame, tolerance: int = 900) -> DataFrame:
    """rid, trip_id: the trip of the same number whose t_first is nearest to a run's t_a; without t_a, t_last to its t_b.

    At most `tolerance` seconds either way, whatever the service day. Ties: the earlier trip, then the lesser trip_id.
    Repeated rows count once; a rid with several different rows pairs each. Null numbers and runs without either time
    pair with none.
    """
    a = runs.select("rid", train_number("num").alias("num"), seconds("t_a").alias("ta"), seconds("t_b").alias("tb"))
    a = a.select("rid", "num", F.when(F.col("ta").isNotNull(), "a").otherwise("b").alias("side"), F.coalesce("ta", "tb").alias("t"))
    a = a.filter("num IS NOT NULL AND t IS NOT NULL").withColumn("entity", F.concat_ws("|", "side", "num"))
    first, last = seconds("t_first"), seconds("t_last")
    sides = F.array(F.struct(F.lit("a").alias("side"), first.alias("t")), F.struct(F.lit("b").alias("side"), last.alias("t")))
    b = trips.select("trip_id", train_number("num").alias("num"), first.alias("t_first"), F.inline(sides)).filter("num IS NOT NULL AND t IS NOT NULL AND trip_id IS NOT NULL")
    b = b.select(F.concat_ws("|", "side", "num").alias("entity"), "t", F.struct("t_first", "trip_id").alias("who"))
    b = b.groupBy("entity", "t").agg(F.min("who").alias("who"))  # one trip per number and second
    near = nearest_times(a, b, tolerance)
    pairs = near.join(b.select("entity", F.col("t").alias("rt"), F.col("who.trip_id").alias("trip_id")), ["entity", "rt"])
    return a.join(pairs.select("entity", "t", "trip_id"), ["entity", "t"]).select("rid", "trip_id").distinct()
