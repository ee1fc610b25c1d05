"""Files whose fields drift: per-column profiles, renames by bipartite matching, one table per feed, a list of changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from legflow.runtime import broadcast_checked, cut, join_null_safe

LEAST_SCORE = 0.5
TYPE_SHARE = 0.9  # share of the values other than junk that a type must cover
HEADER_ROWS = 200_000

# What stands for "no value" in the feeds.
JUNK = ("", "n/a", "-", "?", "null")

# Notations of each type; a value's type is the first that fits.
NOTATIONS = {
    "boolean": r"(?i)^(true|false|0|1)$",
    "date": r"(?i)^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}[a-z]{3}[0-9]{4}|(19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01]))$",
    "integer": r"^[+-]?[0-9]+$",
    "decimal": r"^[+-]?([0-9]+[.,][0-9]*|[.,][0-9]+)$",
    "time": r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?$",
}
SEPARATORS = (",", ";", "\t", "|")
VAGUE = ("boolean", "date", "time")  # values of different columns of these types look alike


def junk(value: Column) -> Column:
    return value.isNull() | F.lower(F.trim(value)).isin(*JUNK)


def _unmarked(line: Column) -> Column:
    return F.regexp_replace(line, "^(﻿|￾|ï»¿|​|⁠)+", "")


def _with_fields(rows: DataFrame, columns: int) -> DataFrame:
    """_f: values of a line as array<string>; quoted values may hold separators, doubled quotes are one.

    Only lines with quotes go through the CSV parser, once each: its struct is a column of its own before it is taken apart.
    """
    schema = ", ".join(f"c{i} string" for i in range(max(1, columns)))
    quoted = F.instr("line", '"') > 0
    row = None
    for s in SEPARATORS:
        this, parsed_ = quoted & (F.col("sep") == s), F.from_csv("line", schema, {"sep": s, "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true"})
        row = F.when(this, parsed_) if row is None else row.when(this, parsed_)
    plain = F.split("line", F.concat(F.lit("\\Q"), F.col("sep"), F.lit("\\E")), -1)
    x = rows.withColumn("_q", row)
    values = F.when(quoted, F.array(*[F.col("_q")[f"c{i}"] for i in range(max(1, columns))])).otherwise(plain)
    return x.withColumn("_f", F.transform(values, lambda v: F.trim(v))).drop("_q")


def headers(lines: DataFrame) -> DataFrame:
    """feed, file_name, published_at, sep, names: one row per file with a line 1; repeats count once.

    Names are without marks, quotes and blanks, in upper case; a blank name is `_C<position>`, and of names that stand twice
    the later ones get their position appended. The separator is the likeliest of , ; tab | by count.
    """
    h = lines.filter((F.col("line_no") == 1) & F.col("file_name").isNotNull() & F.col("line").isNotNull())
    h = h.groupBy("feed", "file_name").agg(F.min("published_at").alias("published_at"), F.min("line").alias("line"))
    bare = F.regexp_replace(_unmarked(F.col("line")), '"[^"]*"', '"')
    count = lambda s: F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit("")))
    best = F.greatest(*[F.struct(count(s).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SEPARATORS)])
    h = h.withColumn("sep", best["s"])
    raw = F.split(F.regexp_replace(_unmarked(F.col("line")), r"[\"'\s ]", ""), F.concat(F.lit("\\Q"), F.col("sep"), F.lit("\\E")), -1)
    raw = F.when(F.col("sep") == "\t", F.split(F.regexp_replace(_unmarked(F.col("line")), r"[\"'  ]", ""), "\t", -1)).otherwise(raw)
    names = F.transform(raw, lambda v, i: F.when(F.trim(v) == "", F.concat(F.lit("_C"), i.cast("string"))).otherwise(F.upper(F.trim(v))))
    once = F.transform(names, lambda v, i: F.when(F.array_position(names, v) == i + 1, v).otherwise(F.concat(v, F.lit("_"), i.cast("string"))))
    return h.select("feed", "file_name", "published_at", "sep", once.alias("names"))


def parsed(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """feed, file_name, line_no, names, values (array<string>, as many as names; null where short or junk), of lines 2 on."""
    width = heads.agg(F.max(F.size("names"))).first()[0] or 1
    data = lines.filter((F.col("line_no") > 1) & F.col("line").isNotNull()).select("feed", "file_name", "line_no", "line").distinct()
    h = heads.select("feed", "file_name", "sep", "names")
    small = broadcast_checked(h, HEADER_ROWS)
    j = join_null_safe(data, small if small is not None else h, ["feed", "file_name"])
    f = _with_fields(j, width)
    value = F.transform("names", lambda _, i: F.get("_f", i))
    clean = F.transform(value, lambda v: F.when(~junk(v), v))
    return f.select("feed", "file_name", "line_no", "names", clean.alias("values"))


def _kind(v: Column) -> Column:
    k = None
    for name, pattern in NOTATIONS.items():
        k = F.when(v.rlike(pattern), name) if k is None else k.when(v.rlike(pattern), name)
    return k.otherwise("text")


def _shape(v: Column) -> Column:
    """A value's form: 9 for digits and a for letters, short runs by length; of a long form its hash."""
    s = F.regexp_replace(F.translate(F.regexp_replace(v, r"[\p{L}]+", "a"), "012345678", "999999999"), "9{7,}", "9*")
    return F.when(F.length(s) > 40, F.hex(F.xxhash64(s))).otherwise(s)


def _exploded(rows: DataFrame) -> DataFrame:
    v = rows.select("feed", "file_name", F.explode(F.arrays_zip(F.col("names").alias("name"), F.col("values").alias("v"))).alias("z"))
    return v.select("feed", "file_name", F.col("z.name").alias("name"), F.col("z.v").alias("v"))


def profiles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns, forms): feed, file_name, name, type, n of every column of every file; shape, k of its values, n.

    Values are pre-aggregated by (column, kind, form). Whole numbers only of 0 and 1 are boolean. type is null without values.
    """
    v = _exploded(rows).select("feed", "file_name", "name", _kind(F.col("v")).alias("kind"), _shape(F.col("v")).alias("shape"), F.col("v").isNotNull().alias("has"))
    key = ["feed", "file_name", "name"]
    cells = cut(v.groupBy(*key, "kind", "shape").agg(F.sum(F.col("has").cast("int")).alias("n")))
    kinds = cells.groupBy(*key).agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in (*NOTATIONS, "text")])
    ok = lambda *ks: sum(F.col(k) for k in ks) >= F.lit(TYPE_SHARE) * F.col("n")
    kind = (
        F.when(F.col("n") == 0, None)
        .when(ok("boolean"), "boolean")
        .when(ok("date"), "date")
        .when(ok("boolean", "integer", "date") & (F.col("decimal") == 0), "integer")
        .when(ok("boolean", "integer", "decimal", "date"), "decimal")
        .when(ok("time"), "time")
        .otherwise("text")
    )
    return kinds.select(*key, kind.alias("type"), "n"), cells.filter("n > 0").groupBy(*key, "shape").agg(F.sum("n").alias("k"))


def _open_sides(heads: DataFrame) -> DataFrame:
    """feed, file_name, name, to_file, old: the columns gone (in the file before) and new (in the file itself) of each file."""
    w = Window.partitionBy("feed").orderBy(F.col("published_at").asc_nulls_first(), "file_name")
    step = heads.select("feed", "file_name", "names", F.lag("names").over(w).alias("before"), F.lag("file_name").over(w).alias("last")).filter("last IS NOT NULL")
    step = step.select("feed", "file_name", "last", F.array_except("before", "names").alias("gone"), F.array_except("names", "before").alias("new")).filter((F.size("gone") > 0) & (F.size("new") > 0))
    old = step.select("feed", F.col("last").alias("file_name"), F.explode("gone").alias("name"), F.col("file_name").alias("to_file"), F.lit(True).alias("old"))
    return old.unionByName(step.select("feed", "file_name", F.explode("new").alias("name"), F.col("file_name").alias("to_file"), F.lit(False).alias("old")))


def shares(heads: DataFrame, sides: DataFrame, forms: DataFrame, values: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """feed, file_name, shared (list of old, new, share, form): of each column gone and each new one in a file, what share of
    the distinct values of the one that has fewer is in the other, and how far their values' forms agree (both 0..1).

    sides: _open_sides(); forms: see profiles(); values: headers -> parsed lines of these files. Counted, not estimated: from sketches of a fixed size nothing can be
    said of a small column in a large one. Only columns that come or go are read; numbers are compared by value (2011.0 as
    2011).
    """
    files = join_null_safe(heads, sides.select("feed", "file_name").distinct(), ["feed", "file_name"])
    small = broadcast_checked(sides, HEADER_ROWS)
    v = join_null_safe(_exploded(values(files)).filter("v IS NOT NULL"), small if small is not None else sides, ["feed", "file_name", "name"])
    plain = F.when(F.col("v").rlike(r"^[+-]?[0-9]+[.,]0*$"), F.regexp_replace("v", r"[.,]0*$", "")).otherwise(F.upper("v"))
    v = cut(v.select("feed", "to_file", "old", "name", F.xxhash64(plain).alias("hash")).distinct())
    n = v.groupBy("feed", "to_file", "old", "name").agg(F.count(F.lit(1)).alias("n"))
    side = lambda d, is_old, c: d.filter(F.col("old") == is_old).withColumnRenamed("name", f"{c}_name").drop("old")
    both = join_null_safe(side(v, True, "old"), side(v, False, "new"), ["feed", "to_file", "hash"]).groupBy("feed", "to_file", "old_name", "new_name").agg(F.count(F.lit(1)).alias("k"))
    both = join_null_safe(both, side(n, True, "old").withColumnRenamed("n", "n0"), ["feed", "to_file", "old_name"])
    both = join_null_safe(both, side(n, False, "new").withColumnRenamed("n", "n1"), ["feed", "to_file", "new_name"])
    both = both.select("feed", "to_file", "old_name", "new_name", (F.col("k") / F.least("n0", "n1")).alias("share"), F.lit(0.0).alias("form"))
    all_ = forms.groupBy("feed", "file_name", "name").agg(F.sum("k").alias("all"))
    parts = join_null_safe(join_null_safe(forms, all_, ["feed", "file_name", "name"]), small if small is not None else sides, ["feed", "file_name", "name"])
    parts = cut(parts.select("feed", "to_file", "old", "name", "shape", (F.col("k") / F.col("all")).alias("part")))
    alike = join_null_safe(side(parts, True, "old").withColumnRenamed("part", "p0"), side(parts, False, "new").withColumnRenamed("part", "p1"), ["feed", "to_file", "shape"])
    alike = alike.groupBy("feed", "to_file", "old_name", "new_name").agg(F.lit(0.0).alias("share"), F.sum(F.least("p0", "p1")).alias("form"))
    both = both.unionByName(alike).groupBy("feed", "to_file", "old_name", "new_name").agg(F.max("share").alias("share"), F.max("form").alias("form"))
    pair = F.struct(F.col("old_name").alias("old"), F.col("new_name").alias("new"), "share", "form")
    return both.groupBy("feed", F.col("to_file").alias("file_name")).agg(F.collect_list(pair).alias("shared"))


def name_similarity(a: str, b: str) -> float:
    """0..1: shared parts of two field names, where a part may be an abbreviation or a beginning of the other's."""
    x, y = ([p for p in n.replace("-", "_").replace(".", "_").split("_") if p] for n in (a, b))
    if a.replace("_", "") == b.replace("_", ""):
        return 1.0
    def near(p: str, q: str) -> float:
        if p == q:
            return 1.0
        s, l = sorted((p, q), key=len)
        if len(s) >= 2 and (l.startswith(s) or l.endswith(s)):
            return 0.9
        return 0.0
    if not x or not y:
        return 0.0
    parts = (sum(max(near(p, q) for q in y) for p in x) / len(x) + sum(max(near(p, q) for q in x) for p in y) / len(y)) / 2
    u, v = "".join(x), "".join(y)
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    g, h = grams(u), grams(v)
    both = len(g & h) / max(1, min(len(g), len(h)))
    return max(parts, both)


def content_score(a: dict, b: dict, value: float, form: float, together: frozenset = frozenset()) -> float:
    """0..1: how likely column b of a file is column a of the file before. value, form: their share
    and the agreement of their forms, see shares().

    Numbers and text must share values: 0.1 of the smaller set is no chance between columns drawn from different sets. Where values of any column look alike (times, dates, flags) form and name decide; then two names
    that stand together in a file of the feed are two fields.
    """
    if not a["type"] or not b["type"]:
        return 0.0
    if a["type"] in VAGUE and frozenset((a["name"], b["name"])) in together:
        return 0.0
    numeric = {"integer", "decimal"}
    if a["type"] != b["type"] and not {a["type"], b["type"]} <= numeric:
        return 0.0
    name = name_similarity(a["name"], b["name"])
    if a["type"] in VAGUE:
        return 0.65 * name + 0.2 * form + 0.15 * min(1.0, a["n"] / max(1, b["n"]), b["n"] / max(1, a["n"]))
    if value < 0.1:
        return 0.0
    return min(1.0, 0.45 + 0.8 * value) * 0.8 + 0.1 * form + 0.1 * name


def best_matching(score: list[list[float]], least: float) -> list[tuple[int, int]]:
    """Pairs (row, column) of the bipartite matching of greatest total score, of scores of at least `least`.

    Shortest augmenting paths with potentials; a pair below `least` is worth nothing, so it is never forced.
    """
    n = max(len(score), max((len(r) for r in score), default=0))
    if not n:
        return []
    cost = [[-(score[i][j] if i < len(score) and j < len(score[i]) and score[i][j] >= least else 0.0) for j in range(n)] for i in range(n)]
    u, v, owner = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)
    for i in range(n):
        owner[n], j0 = i, n
        dist, prev, done = [float("inf")] * (n + 1), [n] * (n + 1), [False] * (n + 1)
        while owner[j0] != n or j0 == n:
            done[j0], i0, step, j1 = True, owner[j0], float("inf"), n
            for j in range(n):
                if not done[j]:
                    c = cost[i0][j] - u[i0] - v[j]
                    if c < dist[j]:
                        dist[j], prev[j] = c, j0
                    if dist[j] < step:
                        step, j1 = dist[j], j
            for j in range(n + 1):
                if done[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    dist[j] -= step
            j0 = j1
        while j0 != n:
            owner[j0] = owner[prev[j0]]
            j0 = prev[j0]
    return sorted((owner[j], j) for j in range(n) if owner[j] < len(score) and j < len(score[owner[j]]) and score[owner[j]][j] >= least)


def _renames(together: dict) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """together: feed -> pairs of names that stand in one file."""

    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups:
            out = []
            for feed, file, gone, new, shared in zip(g["feed"], g["file_name"], g["gone"], g["new"], g["shared"]):
                gone, new = (sorted(x, key=lambda c: c["name"]) for x in (gone, new))
                apart = together.get(feed, frozenset())
                known = {(x["old"], x["new"]): (x["share"], x["form"]) for x in (() if shared is None else shared)}
                pairs = best_matching([[content_score(a, b, *known.get((a["name"], b["name"]), (0.0, 0.0)), apart) for b in new] for a in gone], LEAST_SCORE)
                old, to = {gone[i]["name"] for i, _ in pairs}, {new[j]["name"] for _, j in pairs}
                rows = [("renamed", gone[i]["name"], new[j]["name"]) for i, j in pairs]
                rows += [("removed", c["name"], "") for c in gone if c["name"] not in old] + [("added", c["name"], "") for c in new if c["name"] not in to]
                out += [(feed, file, *r) for r in rows]
            yield pd.DataFrame(out, columns=["feed", "file_name", "change_kind", "field_name", "new_name"])

    return run


def _together(heads: DataFrame) -> dict:
    """feed -> pairs of names found in one header; as many as the square of a feed's vocabulary at most."""
    sets = heads.select("feed", F.array_sort("names").alias("names")).distinct().select("feed", F.explode("names").alias("a"), "names")
    pairs = sets.select("feed", "a", F.explode("names").alias("b")).filter("a < b").distinct()
    out: dict = {}
    for r in pairs.collect():
        out.setdefault(r.feed, set()).add(frozenset((r.a, r.b)))
    return {f: frozenset(v) for f, v in out.items()}


def changes(heads: DataFrame, columns: DataFrame, forms: DataFrame, values: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """feed, file_name, change_kind, field_name, new_name of each file against the one of its feed published just before.

    Files of one instant follow by name. The order of fields and the notation of a type are no change. A column without
    values has no type and is never retyped or renamed. A feed's first file has no changes.
    """
    w = Window.partitionBy("feed").orderBy(F.col("published_at").asc_nulls_first(), "file_name")
    seq = heads.select("feed", "file_name", F.row_number().over(w).alias("seq"), F.col("names"))
    named = seq.select("feed", "file_name", "seq", F.explode("names").alias("name"))
    c = cut(join_null_safe(named, columns, ["feed", "file_name", "name"], "left"))
    col = F.struct("name", "type", F.coalesce("n", F.lit(0)).alias("n"))
    last = seq.groupBy("feed").agg(F.max("seq").alias("last"))
    files = seq.select("feed", F.col("file_name").alias("to_file"), F.col("seq").alias("to_seq"))
    as_old = join_null_safe(c, last, ["feed"]).filter("seq < last").select("feed", "name", (F.col("seq") + 1).alias("to_seq"), F.col("type").alias("t0"), col.alias("old"))
    as_new = c.filter("seq > 1").select(F.col("feed").alias("feed2"), F.col("name").alias("name2"), F.col("seq").alias("seq2"), F.col("type").alias("t1"), col.alias("new"))
    on = F.col("feed").eqNullSafe(F.col("feed2")) & (F.col("to_seq") == F.col("seq2")) & (F.col("name") == F.col("name2"))
    both = as_old.join(as_new, on, "full_outer").select(
        F.when(F.col("seq2").isNotNull(), F.col("feed2")).otherwise(F.col("feed")).alias("feed"), F.coalesce("seq2", "to_seq").alias("to_seq"), F.coalesce("name", "name2").alias("name"), "t0", "t1", "old", "new", F.col("name").isNull().alias("is_new"), F.col("name2").isNull().alias("is_gone")
    )
    f2 = files.select(F.col("feed").alias("f_feed"), F.col("to_seq").alias("f_seq"), F.col("to_file").alias("file_name"))
    both = both.join(f2, F.col("feed").eqNullSafe(F.col("f_feed")) & (F.col("to_seq") == F.col("f_seq"))).drop("f_feed", "f_seq")
    retyped = both.filter("NOT is_new AND NOT is_gone AND t0 <> t1").select("feed", "file_name", F.lit("retyped").alias("change_kind"), F.col("name").alias("field_name"), F.lit("").alias("new_name"))
    open_ = both.filter("is_new OR is_gone").groupBy("feed", "file_name").agg(F.collect_list(F.when(F.col("is_gone"), F.col("old"))).alias("gone"), F.collect_list(F.when(F.col("is_new"), F.col("new"))).alias("new"))
    open_ = join_null_safe(open_, shares(heads, cut(_open_sides(heads)), forms, values), ["feed", "file_name"], "left")
    moved = open_.mapInPandas(_renames(_together(heads)), "feed string, file_name string, change_kind string, field_name string, new_name string")
    return retyped.unionByName(moved)


def schema_changes(lines: DataFrame) -> DataFrame:
    """Changes between consecutive files of each feed, of raw lines (feed, file_name, published_at, line_no, line)."""
    heads = cut(headers(lines))
    return changes(heads, *profiles(parsed(lines, heads)), lambda h: parsed(lines, h))


# Spark patterns of the date notations above.
DATE_FORMATS = ("yyyy-MM-dd", "d.M.yyyy", "d/M/yyyy", "ddMMMyyyy", "yyyyMMdd")


def _typed(v: Column, kind: str) -> Column:
    if kind == "integer":
        return v.try_cast("bigint")
    if kind == "decimal":
        return F.replace(v, F.lit(","), F.lit(".")).try_cast("decimal(28,6)")
    if kind == "boolean":
        return v.try_cast("boolean")
    if kind == "date":
        tidy = F.when(v.rlike("[A-Za-z]"), F.initcap(F.lower(v))).otherwise(v)
        tidy = F.when(v.rlike("[A-Za-z]"), F.regexp_replace(tidy, r"([0-9]+)([A-Za-z]{3})([0-9]{4})", "$1-$2-$3")).otherwise(v)
        tried = [F.to_date(F.try_to_timestamp(tidy, F.lit("d-MMM-yyyy")))] + [F.to_date(F.try_to_timestamp(v, F.lit(f))) for f in DATE_FORMATS]
        return F.coalesce(*tried)
    if kind == "time":
        p = F.split(v, ":")
        return F.when(v.isNotNull(), F.concat_ws(":", F.lpad(F.get(p, 0), 2, "0"), F.get(p, 1), F.coalesce(F.get(p, 2), F.lit("00"))))
    return v


def unified(lines: DataFrame, feed: str, exact_types: bool = True) -> tuple[DataFrame, DataFrame]:
    """(table, changes) of one feed: file_name, line_no and one column per field over all files.

    Names joined by a rename are one field under the name it had first; if a file holds two of them, its first non-null
    value counts. A field whose type changes has the type that holds all of them: decimal for numbers, else text (then the
    values stay as they were written). With exact_types=False everything stays text. Names and types are few (a feed's
    vocabulary), so they are worked out on the driver; the rows are not.
    """
    lines = lines.filter(F.col("feed") == feed)
    heads = cut(headers(lines))
    rows = cut(parsed(lines, heads))
    columns, forms = profiles(rows)
    found = cut(changes(heads, columns, forms, lambda h: join_null_safe(rows, h.select("feed", "file_name"), ["feed", "file_name"])))
    links = found.filter("change_kind = 'renamed'").select("field_name", "new_name").distinct().collect()
    first = heads.select(F.explode("names").alias("name"), "published_at", "file_name").groupBy("name").agg(F.min(F.struct("published_at", "file_name")).alias("at"))
    order = [r.name for r in first.orderBy("at", "name").select("name").collect()]
    types: dict[str, set] = {}
    for r in columns.filter("type IS NOT NULL").select("name", "type").distinct().collect():
        types.setdefault(r.name, set()).add(r.type)
    top = {n: n for n in order}

    def find(n: str) -> str:
        while top[n] != n:
            n = top[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)), key=order.index)
        top[y] = x
    value = F.map_from_arrays("names", "values")
    out = []
    for name in [n for n in order if find(n) == n]:
        members = [n for n in order if find(n) == name]
        kinds = set().union(*(types.get(m, set()) for m in members))
        kind = kinds.pop() if len(kinds) == 1 else "decimal" if kinds == {"integer", "decimal"} else "text"
        v = F.coalesce(*[F.element_at("_v", F.lit(m)) for m in members])
        out.append((_typed(v, kind) if exact_types else v).alias(name.lower()))
    return rows.withColumn("_v", value).select("file_name", "line_no", *out), found
