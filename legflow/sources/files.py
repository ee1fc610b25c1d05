"""Readers for archives of text files: everything as text, columns by name, nothing inferred."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from legflow.runtime import cut


def text_schema(names: Sequence[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def encodings(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, encoding of each file: utf-8 if the whole file is, else latin-1. A file is one cell of up to 2 GB; larger ones raise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import codecs

        for b in batches:
            out = []
            for content in b["content"]:
                d = codecs.getincrementaldecoder("utf-8")()
                try:
                    for at in range(0, len(content), 1 << 20):
                        d.decode(content[at : at + (1 << 20)])
                    d.decode(b"", True)
                    out.append("utf-8")
                except UnicodeDecodeError:
                    out.append("latin-1")
            yield pd.DataFrame({"path": b["path"], "encoding": out})

    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.mapInPandas(run, "path string, encoding string")


def csv_by_name(spark: SparkSession, paths: Sequence[str], names: Sequence[str], sep: str = ",", encoding: str | None = None) -> DataFrame:
    """The named columns of delimited files as text, with `_file`; columns a file lacks are null, short rows are padded.

    Headers may differ in order and extent, so files are grouped by their header (a driver's list of headers, not of rows).
    With encoding None each file's own is found first. Missing required columns are the caller's to check: see lacking().
    """
    groups: dict[tuple, list[str]] = {}
    known = {r.path: r.encoding for r in encodings(spark, paths).collect()} if encoding is None else {}
    plain = lambda p: re.sub("^file:/+", "/", p)
    known = {plain(p): e for p, e in known.items()}
    for p in paths:
        e = encoding or known.get(plain(p), "utf-8")
        head = spark.read.option("encoding", "UTF-8" if e == "utf-8" else "ISO-8859-1").option("sep", sep).option("header", False).csv(p).limit(1).collect()
        columns = tuple((v or "").strip().lstrip("﻿").strip('"') for v in head[0]) if head else ()
        groups.setdefault((e, columns), []).append(p)
    out = None
    for (e, columns), files in groups.items():
        if not columns:
            continue
        x = spark.read.schema(text_schema([f"c{i}" for i in range(len(columns))])).option("sep", sep).option("header", True).option("enforceSchema", True).option("encoding", "UTF-8" if e == "utf-8" else "ISO-8859-1").option("mode", "PERMISSIVE").csv(files)
        x = x.select(*[(F.col(f"c{columns.index(n)}") if n in columns else F.lit(None).cast("string")).alias(n) for n in names], F.col("_metadata.file_name").alias("_file"))
        out = x if out is None else out.unionByName(x)
    return out if out is not None else spark.createDataFrame([], text_schema([*names, "_file"]))


def lacking(spark: SparkSession, path: str, required: Sequence[str], sep: str = ",") -> list[str]:
    """Required columns a file's header does not have."""
    head = spark.read.option("sep", sep).option("header", False).csv(path).limit(1).collect()
    have = {(v or "").strip().lstrip("﻿") for v in head[0]} if head else set()
    return [c for c in required if c not in have]


def json_arrays(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Files that hold one array of objects each, by a declared schema; a field outside it is not read."""
    return spark.read.schema(schema).option("multiLine", True).json(list(paths))


def gtfs(spark: SparkSession, folder: str, name: str, columns: Sequence[str]) -> DataFrame:
    """A table of a timetable export: <folder>/<name>.txt or .txt.gz; both if both are there."""
    P = spark._jvm.org.apache.hadoop.fs.Path
    fs = P(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f for f in (f"{folder}/{name}.txt", f"{folder}/{name}.txt.gz") if fs.exists(P(f))]
    if not found:
        raise FileNotFoundError(f"{folder}/{name}.txt")
    return csv_by_name(spark, found, columns, encoding="utf-8")


def snapshots(spark: SparkSession, pattern: str, columns: Sequence[str]) -> DataFrame:
    """Files of one table by day (a glob such as stops-*.txt.gz) with `snap`, the date in the file's name; files without are left out."""
    x = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(pattern)
    x = x.select(*[(F.col(f"`{c}`") if c in x.columns else F.lit(None)).cast("string").alias(c) for c in columns], snapshot_day(F.col("_metadata.file_name")).alias("snap"))
    return x.filter("snap IS NOT NULL")


def months_for(first: str, last: str) -> list[str]:
    """yyyy-mm of the monthly files that can hold service days of [first, last]: a ride of the day before may run into the
    first, one of the last may be filed up to two days later."""
    a, b = datetime.date.fromisoformat(first) - datetime.timedelta(1), datetime.date.fromisoformat(last) + datetime.timedelta(2)
    return [f"{k // 12:04d}-{k % 12 + 1:02d}" for k in range(a.year * 12 + a.month - 1, b.year * 12 + b.month)]


def month_files(spark: SparkSession, folder: str, first: str, last: str) -> DataFrame:
    """Monthly Parquet files <folder>/<yyyy-mm>.parquet of months_for(); a missing one raises."""
    return spark.read.parquet(*[f"{folder}/{m}.parquet" for m in months_for(first, last)])


def dictionary(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """key, value of a JSON object whose names are keys; values as they are written (JSON for lists and objects)."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, string>").alias("m"))
    return text.select(F.explode("m").alias(key, value))


def largest_members(listing: DataFrame) -> DataFrame:
    """name, size, path of archive members (name, size, path): folders and empty ones are none, of duplicates the largest counts."""
    x = listing.filter(~F.col("name").endswith("/") & (F.col("size") > 0))
    return x.groupBy("name").agg(F.max(F.struct("size", "path")).alias("m")).select("name", "m.size", "m.path")


def extracted_days(rows: DataFrame, day: str, path: str) -> DataFrame:
    """Rows of an archive day kept as Parquet under <path>/<day>=...; days that are there already are not worked out again."""
    spark = rows.sparkSession
    P = spark._jvm.org.apache.hadoop.fs.Path
    p = P(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath().getName().partition("=")[2] for s in fs.listStatus(p)] if fs.exists(p) else []
    todo = rows.filter(~F.col(day).cast("string").isin(*[d for d in done if d])) if any(done) else rows
    todo.write.mode("append").partitionBy(day).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


# What an Italian day file may hold for a train and a call, and the marks that stand for a delay.
IT_TRAIN = frozenset("_id n p rp a ra c sub op oa fr cn dl oo od sep sea ope oae pr".split())
IT_CALL = frozenset("n ra rp oa op br bp".split())
IT_MARK = r"^(-?[0-9]+|N|S|X|n\.d\.)$"


def italian_day(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(trains, calls) of day files, one JSON object each: giorno, treni of the fields IT_TRAIN with calls fr of IT_CALL.

    A field or a mark of delay nobody knows raises when the rows are read: a source that changes must not pass unseen.
    """
    text = spark.read.text(list(paths), wholetext=True)
    day = text.select(F.get_json_object("value", "$.giorno").alias("service_day"), F.from_json(F.get_json_object("value", "$.treni"), "array<map<string, string>>").alias("t"))
    t = day.select(F.to_date("service_day").alias("service_day"), F.posexplode("t").alias("tidx", "m"))
    known = lambda keys, m: F.size(F.array_except(F.map_keys(m), F.array(*map(F.lit, sorted(keys))))) == 0
    check = lambda ok, what, v: F.when(ok, v).otherwise(F.raise_error(what))
    field = lambda k: F.element_at("m", F.lit(k))
    mark = lambda v: check(v.isNull() | v.rlike(IT_MARK), F.concat(F.lit("unknown mark "), v), v)
    t = t.withColumn("m", check(known(IT_TRAIN, F.col("m")), F.concat(F.lit("unknown field of a train: "), F.array_join(F.map_keys("m"), ",")), F.col("m")))
    t = t.withColumn("calls", F.coalesce(F.from_json(field("fr"), "array<map<string, string>>"), F.array().cast("array<map<string,string>>")))
    trains = t.select("service_day", "tidx", field("_id").alias("source_id"), field("n").alias("number"), *[field(k).alias(k) for k in ("c", "sub", "p", "a", "cn", "dl", "oo", "od", "sep", "sea", "ope", "oae")], mark(field("rp")).alias("rp"), mark(field("ra")).alias("ra"), field("op").try_cast("bigint").alias("op"), field("oa").try_cast("bigint").alias("oa"), F.size("calls").alias("n_stops"))
    c = t.select("service_day", "tidx", F.posexplode("calls").alias("seq", "m"))
    c = c.withColumn("m", check(known(IT_CALL, F.col("m")), F.concat(F.lit("unknown field of a call: "), F.array_join(F.map_keys("m"), ",")), F.col("m")))
    calls = c.select("service_day", "tidx", "seq", field("n").alias("name"), field("oa").try_cast("bigint").alias("s_arr"), field("op").try_cast("bigint").alias("s_dep"), mark(field("ra")).alias("ra"), mark(field("rp")).alias("rp"))
    return trains, calls


def merged_extracts(nodes: DataFrame, ways: DataFrame, rail: tuple[str, ...] = ("rail", "light_rail", "narrow_gauge", "subway", "tram")) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of map extracts that overlap: each id once, only ways of `rail` and the nodes they need.

    nodes: id, lon, lat; ways: id, railway, nodes (array of ids).
    """
    w = ways.filter(F.col("railway").isin(*rail)).dropDuplicates(["id"])
    need = w.select(F.explode("nodes").alias("id")).distinct()
    return nodes.join(need, "id", "left_semi").groupBy("id").agg(F.min(F.struct("lon", "lat")).alias("p")).select("id", "p.lon", "p.lat"), w


# The shapes of dated file names.
DATED = (r"([0-9]{4})-([0-9]{2})-([0-9]{2})", r"([0-9]{4})_([0-9]{2})_([0-9]{2})", r"([0-9]{4})([0-9]{2})([0-9]{2})")


def snapshot_day(name: F.Column) -> F.Column:
    """The date in a file name, in the first shape that is one; null if there is none."""
    tried = [F.to_date(F.try_to_timestamp(F.concat_ws("-", *[F.regexp_extract(name, p, i) for i in (1, 2, 3)]), F.lit("yyyy-MM-dd"))) for p in DATED]
    return F.coalesce(*tried)


def latest_per_day(listing: DataFrame) -> DataFrame:
    """day, url of listings (url, published): of several of a day the one published last, then the greatest url."""
    x = listing.withColumn("day", snapshot_day(F.col("url"))).filter("day IS NOT NULL")
    return x.groupBy("day").agg(F.max_by("url", F.struct("published", "url")).alias("url"))


def push_port(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(schedules, actuals) of files with one XML message a line: a row per location, in the columns of gb_sched and gb_act.

    Namespaces are ignored. A line that is no XML gives no rows; unread_lines() counts them.
    """
    lines = spark.read.text(list(paths))
    sched = "ts string, rid string, uid string, train_id string, ssd string, toc string, train_cat string, status string, is_passenger string, deleted string, idx int, kind string, tpl string, act string, pta string, ptd string, wta string, wtd string, wtp string, can string"
    act = "ts string, rid string, ssd string, tpl string, wta string, wtd string, wtp string, at_arr string, at_dep string, arr_removed string, dep_removed string"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree

        bare = lambda e: e.tag.rpartition("}")[2]
        flag = lambda v: "True" if v in ("true", "1") else "False"
        for b in batches:
            s, a = [], []
            for line in b["value"]:
                try:
                    root = ElementTree.fromstring(line)
                except ElementTree.ParseError:
                    continue
                ts = root.get("ts")
                for m in root.iter():
                    if bare(m) == "schedule":
                        for i, c in enumerate(x for x in m if bare(x) in ("OR", "OPOR", "IP", "OPIP", "PP", "DT", "OPDT")):
                            s.append((ts, m.get("rid"), m.get("uid"), m.get("trainId"), m.get("ssd"), m.get("toc"), m.get("trainCat", "OO"), m.get("status", "P"), flag(m.get("isPassengerSvc", "true")), flag(m.get("deleted")), i, bare(c), *(c.get(k) for k in ("tpl", "act", "pta", "ptd", "wta", "wtd", "wtp")), flag(c.get("can"))))
                    elif bare(m) == "TS":
                        for c in (x for x in m if bare(x) == "Location"):
                            arr, dep = (next((x for x in c if bare(x) == k), None) for k in ("arr", "dep"))
                            at = lambda e: None if e is None else e.get("at")
                            gone = lambda e: None if e is None else flag(e.get("atRemoved"))
                            a.append((ts, m.get("rid"), m.get("ssd"), *(c.get(k) for k in ("tpl", "wta", "wtd", "wtp")), at(arr), at(dep), gone(arr), gone(dep)))
            rows = lambda ddl, xs: [dict(zip(_names(ddl), x)) for x in xs]
            yield pd.DataFrame({"s": [rows(sched, s)], "a": [rows(act, a)]})

    both = cut(lines.mapInPandas(parse, f"s array<struct<{_typed(sched)}>>, a array<struct<{_typed(act)}>>"))
    return both.select(F.inline("s")), both.select(F.inline("a"))


def unread_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, lines, unread: how many lines of each file push_port() cannot read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree

        for b in batches:
            bad = []
            for line in b["value"]:
                try:
                    ElementTree.fromstring(line)
                    bad.append(0)
                except ElementTree.ParseError:
                    bad.append(1)
            yield pd.DataFrame({"file": b["file"], "bad": bad})

    x = spark.read.text(list(paths)).select("value", F.col("_metadata.file_name").alias("file")).mapInPandas(run, "file string, bad int")
    return x.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.sum("bad").alias("unread"))


def _names(ddl: str) -> list[str]:
    return [p.split()[0] for p in ddl.split(", ")]


def _typed(ddl: str) -> str:
    return ", ".join(": ".join(p.split()) for p in ddl.split(", "))
