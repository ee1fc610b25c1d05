from datetime import datetime

import itertools

from legflow.operators.drift import best_matching, schema_changes, unified

S = "feed string, file_name string, published_at timestamp, line_no int, line string"


def file(name, day, *lines, feed="f"):
    return [(feed, name, datetime(2020, 1, day), i + 1, x) for i, x in enumerate(lines)]


def table(head, *cols, sep=","):
    return [head, *(sep.join(str(v) for v in r) for r in zip(*cols))]


A, B = list(range(1000, 1040)), [f"P{i}" for i in range(40)]
T = [f"{i % 24}:{i:02}:10" for i in range(40)]


def test_changes_between_files(spark):
    rows = file("1", 1, *table("NUM,Name , DEP_TIME", A, B, T))
    rows += file("2", 2, *table('﻿"name","num","dep_time"', [f'"{x}"' for x in B], A, [t[:-3] for t in T]))
    rows += file("3", 3, *table("NAME,NUMBER,DEP_TIME", B, A, T))
    rows += file("4", 4, *table("NAME,NUMBER,OTHER", B, [f"{a}.0" for a in A], [f"Z{i}" for i in range(40)]))
    rows += file("5", 5, *table("NAME,NUMBER,OTHER", B, ["n/a"] * 40, [f"Z{i}" for i in range(40)]))
    rows += file("5", 5, *table("NAME,NUMBER,OTHER", B, ["n/a"] * 40, [f"Z{i}" for i in range(40)]))
    rows += file("0", 1, *table("a;b", A, B, sep=";"), feed=None)
    got = {(r.file_name, r.change_kind, r.field_name, r.new_name) for r in schema_changes(spark.createDataFrame(rows, S)).collect()}
    assert got == {("3", "renamed", "NUM", "NUMBER"), ("4", "removed", "DEP_TIME", ""), ("4", "added", "OTHER", ""), ("4", "retyped", "NUMBER", "")}


def test_names_that_stood_together_are_two_fields(spark):
    rows = file("1", 1, *table("NUM,REAL_TIME,PLAN_TIME", A, T, T[::-1])) + file("2", 2, *table("NUM,REAL_TIME", A, T))
    rows += file("3", 3, *table("NUM,PLAN_TIME", A, T)) + file("4", 4, *table("NUM,PLANNED_TIME", A, T))
    got = {(r.file_name, r.change_kind, r.field_name, r.new_name) for r in schema_changes(spark.createDataFrame(rows, S)).collect()}
    assert got == {("2", "removed", "PLAN_TIME", ""), ("3", "removed", "REAL_TIME", ""), ("3", "added", "PLAN_TIME", ""), ("4", "renamed", "PLAN_TIME", "PLANNED_TIME")}


def test_renamed_in_a_far_larger_file(spark):
    many = [f"P{i * 7 % 9000}" for i in range(9000)]
    rows = file("1", 1, *table("NUM,NAME", A, B)) + file("2", 2, *table("NO,NAME", range(9000), many)) + file("3", 3, *table("NO,LABEL", A, B))
    got = {(r.file_name, r.change_kind, r.field_name, r.new_name) for r in schema_changes(spark.createDataFrame(rows, S)).collect()}
    assert got == {("2", "renamed", "NUM", "NO"), ("3", "renamed", "NAME", "LABEL")}


def test_one_table(spark):
    rows = file("1", 1, *table("NUM,NAME,DAY", A, B, ["01JAN2020"] * 40)) + file("2", 2, "NAME,NO,DAY", '"P1, x",7,2020-01-02', "P2", "-,?,NULL")
    rows += file("3", 3, *table("NUMBER,NAME,DAY", A, B, ["03.01.2020"] * 40))
    t, found = unified(spark.createDataFrame(rows, S), "f")
    got = {(r.file_name, r.line_no): r for r in t.collect()}
    assert got["1", 2].num == 1000 and str(got["1", 2].day) == "2020-01-01" and str(got["3", 2].day) == "2020-01-03"
    assert got["2", 2].name == "P1, x" and got["2", 3].name == "P2" and got["2", 3].day is None and got["2", 4].name is None
    assert len(got) == 83 and found.count() > 0


def test_matching_is_the_best(spark):
    import random

    r = random.Random(2)
    for n, m in itertools.product(range(5), range(5)):
        s = [[r.choice([0, 0.3, 0.6, r.random()]) for _ in range(m)] for _ in range(n)]
        got = best_matching(s, 0.5)
        best = max((sum(s[i][j] for i, j in c) for k in range(min(n, m) + 1) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k) for c in [list(zip(rows, cols))] if all(s[i][j] >= 0.5 for i, j in c)), default=0)
        assert abs(sum(s[i][j] for i, j in got) - best) < 1e-9 and len({i for i, _ in got}) == len(got) == len({j for _, j in got})


def test_empty(spark):
    assert schema_changes(spark.createDataFrame([], S)).count() == 0
    assert schema_changes(spark.createDataFrame([("f", "1", None, 1, None), ("f", None, None, 1, "a"), ("f", "2", None, 1, "")], S)).count() == 0
