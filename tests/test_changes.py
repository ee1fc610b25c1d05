from itertools import permutations

from pyspark.sql import functions as F

from legflow.operators.changes import DeltaTable, calls_with_actuals, instant_ns

SCHED = "ts string, rid string, tpl string, wta string, wtd string, wtp string, can string, deleted string, extra string"
ACT = "ts string, rid string, tpl string, wta string, wtd string, wtp string, at_arr string, at_dep string, arr_removed string, dep_removed string, extra string"


def s(ts, rid, tpl, wta=None, wtd=None, wtp=None, can="False", deleted="False"):
    return (ts, rid, tpl, wta, wtd, wtp, can, deleted, None)


def a(ts, rid, tpl, wta=None, wtd=None, wtp=None, arr=None, dep=None, ra=None, rd=None):
    return (ts, rid, tpl, wta, wtd, wtp, arr, dep, ra, rd, None)


def found(spark, sched, act):
    df = calls_with_actuals(spark.createDataFrame(sched, SCHED), spark.createDataFrame(act, ACT))
    return sorted(map(tuple, df.collect()))


def test_instants_have_nanoseconds_and_offsets(spark):
    rows = [("2018-01-02T11:27:05.47-01:00",), ("2018-01-02T12:27:05.4700000Z",), ("2018-01-02T12:27:05.4700001Z",), ("2018-01-02T12:27:05",), ("x",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(instant_ns(F.col("t"))).collect()]
    assert got[0] == got[1] == got[2] - 100
    assert got[3] == got[0] - 470_000_000
    assert got[4:] == [None, None, None]


def test_order_and_repeats_do_not_matter(spark):
    act = [a("2018-01-01T10:00:00Z", "1", "A", "10:00", dep="10:01"), a("2018-01-01T11:30:00+01:00", "1", "A", "10:00", arr="10:02"), a("2018-01-01T10:40:00Z", "1", "A", "10:00", rd="True"), a("2018-01-01T10:40:00Z", "1", "A", "10:00", rd="True")]
    sched = [s("2018-01-01T08:00:00Z", "1", "A", "10:00"), s("2018-01-01T08:00:00Z", "1", "B", "10:10")]
    for order in list(permutations(act))[::5]:
        assert found(spark, sched, list(order)) == [("1", "A", "10:00", "10:02", "")]


def test_later_schedule_replaces_all_calls(spark):
    sched = [s("2018-01-01T09:00:00Z", "1", "B", None, "10:10"), s("2018-01-01T08:00:00Z", "1", "A", "10:00"), s("2018-01-01T08:00:00Z", "2", "A", "10:00"), s("2018-01-01T09:00:00Z", "2", "A", "10:00", deleted="True"), s("2018-01-01T08:00:00Z", "3", "A", "10:00", can="True")]
    act = [a("2018-01-01T10:00:00Z", r, t, *w, arr="1", dep="2") for r in "123" for t, w in (("A", ("10:00", None)), ("B", (None, "10:10")))]
    assert found(spark, sched, act) == [("1", "B", "10:10", "1", "2")]


def test_nulls_and_empty_tables(spark):
    assert found(spark, [], []) == []
    assert found(spark, [s(None, "1", "A"), s("2018-01-01T08:00:00Z", None, "A"), s("2018-01-01T08:00:00Z", "1", None)], [a("2018-01-01T08:00:00Z", "1", None, dep="9"), a("bad", "1", None, arr="8"), a("2018-01-01T08:00:00Z", None, None, arr="8")]) == [("1", None, None, "", "9")]


def test_table_appends_reads_and_compacts(spark, tmp_path):
    t = DeltaTable(spark, str(tmp_path / "t"), ["k"], ["v"])
    feed = lambda rows: spark.createDataFrame(rows, "k int, v string, n long, gone boolean")
    t.append(feed([(1, "a", 1, False), (2, "b", 5, False), (3, "c", 2, False), (None, "n", 1, False)]), "n", F.col("gone"))
    t.append(feed([(1, "x", 3, False), (2, None, 4, True), (3, None, 9, True), (3, "c", 2, False)]), "n", F.col("gone"))
    want = [(None, "n"), (1, "x"), (2, "b")]
    read = lambda: sorted(((r.k, r.v) for r in t.read().collect()), key=str)
    assert read() == sorted(want, key=str)
    t.compact()
    assert len(t.parts()) == 1 and read() == sorted(want, key=str)
    t.append(feed([(3, "late", 8, False), (1, "y", 10, False)]), "n", F.col("gone"))
    assert read() == sorted([(None, "n"), (1, "y"), (2, "b")], key=str)


def test_half_an_append_and_one_beside_a_compaction(spark, tmp_path, monkeypatch):
    t = DeltaTable(spark, str(tmp_path / "t"), ["k"], ["v"])
    feed = lambda rows: spark.createDataFrame(rows, "k int, v string, n long, gone boolean")
    read = lambda: sorted((r.k, r.v) for r in t.read().collect())
    t.append(feed([(1, "a", 1, False), (2, "b", 1, False)]), "n", F.col("gone"))
    lost = t.stage(feed([(1, "never", 2, False), (2, None, 2, True)]), "n", F.col("gone"))  # the writer dies before its commit
    assert read() == [(1, "a"), (2, "b")]
    t.append(feed([(1, "c", 3, False)]), "n", F.col("gone"))
    assert read() == [(1, "c"), (2, "b")]
    commit = t._commit

    def beside(part, replaced=()):
        monkeypatch.setattr(t, "_commit", commit)
        t.append(feed([(2, None, 4, True), (3, "d", 1, False)]), "n", F.col("gone"))  # while the compaction is at work
        commit(part, replaced)

    monkeypatch.setattr(t, "_commit", beside)
    t.compact()
    assert read() == [(1, "c"), (3, "d")] and len(t.parts()) == 2
    assert lost in t.vacuum() and read() == [(1, "c"), (3, "d")]
    t.compact()
    t.append(feed([(3, "old", 0, False), (2, "old", 3, False)]), "n", F.col("gone"))  # late rows stay hidden
    assert read() == [(1, "c"), (3, "d")]


def test_calls_go_through_data_and_delete_files(spark, monkeypatch):
    import legflow.operators.changes as C

    made = []
    scratch = C.scratch
    monkeypatch.setattr(C, "scratch", lambda sp, n: made.append(scratch(sp, n)) or made[-1])
    assert found(spark, [s("2018-01-01T08:00:00Z", "1", "A", "10:00")], [a("2018-01-01T10:00:00Z", "1", "A", "10:00", arr="1")]) == [("1", "A", "10:00", "1", "")]
    for table in ("schedules", "actuals"):
        assert DeltaTable(spark, f"{made[0]}/{table}", [], []).parts()


def test_stream_into_table(spark, tmp_path):
    from legflow.streaming.feeds import counts, into_table

    src = tmp_path / "in"
    for i, rows in enumerate(([(1, "a", 5, False)], [(1, "old", 2, False), (2, "b", 1, False)], [(2, None, 3, True)])):
        spark.createDataFrame(rows, "k int, v string, n long, gone boolean").coalesce(1).write.mode("append").parquet(str(src))
    t = DeltaTable(spark, str(tmp_path / "t"), ["k"], ["v"])
    stream = spark.readStream.schema("k int, v string, n long, gone boolean").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = into_table(stream, t, "n", F.col("gone")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.k, r.v) for r in t.read().collect()] == [(1, "a")]
    timed = stream.withColumn("t", F.timestamp_seconds(F.col("n") * 60))
    q = counts(timed, "t", "5 minutes", "1 hour").writeStream.format("memory").queryName("per5").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.table("per5").collect()) == 4
