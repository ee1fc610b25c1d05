"""Change feeds kept as data files and equality-delete files with sequence numbers.

Writers only append. An upsert appends an equality delete of its key and a data row, both with the change's sequence
number; a delete appends the equality delete alone. Readers anti-join data rows against *later* deletes of their key, so
neither arrival order nor repetition matters: the order is in the numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from legflow.runtime import scratch

SEQ, DEL = "_seq", "_del_seq"


def instant_ns(ts: Column) -> Column:
    """Nanoseconds since 1970 of an ISO 8601 text with any offset and up to nine decimals; unreadable text gives null.

    A text without an offset is UTC. Timestamps alone would cut the seventh decimal and tie two messages.
    """
    t = F.trim(ts)
    whole = F.regexp_replace(t, r"\.[0-9]+", "")
    zoned = F.when(whole.rlike(r"(Z|z|[+-][0-9]{2}(:?[0-9]{2})?)$") & whole.rlike("[Tt ]"), whole).otherwise(
        F.concat(whole, F.lit("Z"))
    )
    sec = F.unix_seconds(F.try_to_timestamp(zoned))
    frac = F.rpad(F.substring(F.regexp_extract(t, r"\.([0-9]+)", 1), 1, 9), 9, "0").try_cast("int")
    return sec * F.lit(1_000_000_000) + F.coalesce(frac, F.lit(0))


def split_feed(
    feed: DataFrame, key: Sequence[str], seq: str | Column, gone: Column, keep: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(data rows, equality deletes) of a feed.

    feed: one row per change. key: columns of the equality delete (nulls are values like others). gone: true for a pure
    delete (null counts as false). keep: payload columns. Changes without sequence number are ignored. Repeated changes
    collapse; of the deletes of a key only the latest number matters to any reader, so they are pre-aggregated.
    """
    seq = F.col(seq) if isinstance(seq, str) else seq
    x = feed.withColumn(SEQ, seq).withColumn("_gone", F.coalesce(gone, F.lit(False))).filter(F.col(SEQ).isNotNull())
    data = x.filter(~F.col("_gone")).select(*dict.fromkeys([*key, *keep]), SEQ).distinct()
    deletes = x.groupBy(*key).agg(F.max(SEQ).alias(DEL))
    return data, deletes


def current(data: DataFrame, deletes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Data rows without a later delete of their key.

    A delete with the row's own number does not hide it (an upsert writes both). Two different rows of one key and number
    both stay. `deletes` may hold several numbers a key; they are reduced before the join, so the join's right side has
    one row a key and a hot key on the left can be split by AQE.
    """
    d = deletes.groupBy(*key).agg(F.max(DEL).alias(DEL)).select(*[F.col(k).alias(f"_k_{k}") for k in key], DEL)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key))
    return data.join(d, same & (F.col(DEL) > F.col(SEQ)), "left_anti")


class DeltaTable:
    """A table in a folder, only ever appended to: `parts/<id>/rows` (data and pure deletes apart), `parts/<id>/deletes`
    (equality deletes) and `commits/<id>`, a file that names the parts it adds and those it replaces.

    A part counts from the moment its commit file has its name, which is one rename: a reader sees all of an append or
    nothing, and a failed one leaves files nobody reads. append() is safe to repeat: the same batch again changes nothing a
    reader sees. compact() replaces the parts it has read and no others, so what is appended meanwhile stays. vacuum()
    deletes the files of parts that no longer count; call it when no reader or writer older than they is at work.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], keep: Sequence[str]) -> None:
        self.spark, self.path, self.key, self.keep = spark, path.rstrip("/"), list(key), list(keep)

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _listed(self, name: str) -> list[str]:
        fs, p = self._fs(), self._path(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def parts(self) -> list[str]:
        """Ids of the parts that count."""
        done = [n for n in self._listed("commits") if not n.startswith("_")]
        if not done:
            return []
        rows = self.spark.read.text([f"{self.path}/commits/{n}" for n in done]).collect()  # two lines an append
        gone = {r.value[1:] for r in rows if r.value.startswith("-")}
        return sorted({r.value[1:] for r in rows if r.value.startswith("+")} - gone)

    def _commit(self, part: str, replaced: Sequence[str] = ()) -> None:
        fs, open_ = self._fs(), self._path(f"commits/_{part}")
        out = fs.create(open_, True)
        out.write("\n".join([f"+{part}", *[f"-{p}" for p in replaced]]).encode())
        out.close()
        if not fs.rename(open_, self._path(f"commits/{part}")):
            raise OSError(f"{self.path}: {part} could not be committed")

    def stage(self, feed: DataFrame, seq: str | Column, gone: Column) -> str:
        """Write a feed as a part that does not count yet; its id. The feed is read once."""
        part = uuid.uuid4().hex
        seq = F.col(seq) if isinstance(seq, str) else seq
        x = feed.select(*[F.col(c) for c in dict.fromkeys([*self.key, *self.keep])], seq.alias(SEQ), F.coalesce(gone, F.lit(False)).alias("_gone"))
        x.filter(F.col(SEQ).isNotNull()).distinct().write.partitionBy("_gone").parquet(f"{self.path}/parts/{part}/rows")
        schema = StructType([*x.schema.fields[:-1], StructField("_gone", BooleanType())])
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/parts/{part}/rows")
        # of the deletes of a key only the latest number matters to any reader
        rows.groupBy(*self.key).agg(F.max(SEQ).alias(DEL)).write.parquet(f"{self.path}/parts/{part}/deletes")
        self.spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/parts/{part}/schema")
        return part

    def append(self, feed: DataFrame, seq: str | Column, gone: Column) -> None:
        self._commit(self.stage(feed, seq, gone))

    def _rows(self, parts: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """(data, deletes) of parts, each read only where it is."""
        schema = self.spark.read.parquet(f"{self.path}/parts/{parts[0]}/schema").schema
        read = lambda s, name: reduce(DataFrame.unionByName, (self.spark.read.schema(s).parquet(f"{self.path}/parts/{p}/{name}") for p in parts))
        data = read(schema, "rows").filter(~F.col("_gone")).drop("_gone")
        return data, read(StructType([f for f in schema.fields if f.name in self.key] + [StructField(DEL, LongType())]), "deletes")

    def read(self) -> DataFrame:
        """The rows in force, with their number; a table without any append raises ValueError."""
        parts = self.parts()
        if not parts:
            raise ValueError(f"{self.path}: nothing was appended yet")
        data, deletes = self._rows(parts)
        return current(data.distinct() if len(parts) > 1 else data, deletes, self.key)

    def compact(self) -> None:
        old = self.parts()
        if len(old) < 2:
            return
        data, deletes = self._rows(old)
        part = uuid.uuid4().hex
        base = f"{self.path}/parts/{part}"
        current(data.distinct(), deletes, self.key).withColumn("_gone", F.lit(False)).write.partitionBy("_gone").parquet(f"{base}/rows")
        deletes.groupBy(*self.key).agg(F.max(DEL).alias(DEL)).write.parquet(f"{base}/deletes")
        self.spark.createDataFrame([], self.spark.read.parquet(f"{self.path}/parts/{old[0]}/schema").schema).write.parquet(f"{base}/schema")
        self._commit(part, old)

    def vacuum(self) -> list[str]:
        """Delete the files of parts that do not count; their ids."""
        fs, keep = self._fs(), set(self.parts())
        gone = [p for p in self._listed("parts") if p not in keep]
        for p in gone:
            fs.delete(self._path(f"parts/{p}"), True)
        return gone


CALL = ("rid", "tpl", "wta", "wtd", "wtp")


def _true(c: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(c))) == "true", F.lit(False))


def calls_with_actuals(sched: DataFrame, act: DataFrame) -> DataFrame:
    """Calls in force after all messages, with actual times: rid, tpl, wt, at_arr, at_dep; '' for a side without time.

    A schedule message is an upsert of its whole rid (so the delete key is rid, not the call); a message with
    deleted 'True' is a pure delete. Calls with can 'True' do not count. An actual is an upsert of (call, side); a
    removed side is a pure delete. Both feeds are written as data and delete files to the shared folder and read from
    there. Null rid, unreadable ts: ignored. Two messages of one rid or side with one instant:
    their rows both stand, of two times of a side the later text wins. Empty tables give an empty result.
    """
    spark, where = sched.sparkSession, scratch(sched.sparkSession, "calls")
    s = sched.filter(F.col("rid").isNotNull()).select(*CALL, "can", "deleted", instant_ns(F.col("ts")).alias("_ns"))
    schedules = DeltaTable(spark, f"{where}/schedules", ["rid"], [*CALL, "can"])
    schedules.append(s, "_ns", _true("deleted"))
    calls = schedules.read().filter(~_true("can")).select(*CALL).distinct()

    at = lambda side: F.when(F.col(f"at_{side}") != "", F.col(f"at_{side}"))
    sides = F.array(*(F.struct(F.lit(x).alias("side"), at(x).alias("at"), _true(f"{x}_removed").alias("removed")) for x in ("arr", "dep")))
    a = (
        act.filter(F.col("rid").isNotNull())
        .select(*CALL, instant_ns(F.col("ts")).alias("_ns"), F.inline(sides))
        .filter(F.col("at").isNotNull() | F.col("removed"))
    )
    actuals = DeltaTable(spark, f"{where}/actuals", [*CALL, "side"], ["at"])
    actuals.append(a, "_ns", F.col("removed"))
    times = (
        actuals.read()
        .groupBy(*CALL)
        .agg(*(F.max(F.when(F.col("side") == x, F.col("at"))).alias(f"at_{x}") for x in ("arr", "dep")))
        .select(*[F.col(c).alias(f"_a_{c}") for c in CALL], "at_arr", "at_dep")
    )
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_a_{c}")) for c in CALL))
    return calls.join(times, same).select(
        "rid",
        "tpl",
        F.coalesce("wta", "wtd", "wtp").alias("wt"),
        F.coalesce("at_arr", F.lit("")).alias("at_arr"),
        F.coalesce("at_dep", F.lit("")).alias("at_dep"),
    ).distinct()
