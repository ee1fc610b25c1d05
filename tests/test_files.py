import gzip
import json

from legflow.operators.changes import calls_with_actuals
from legflow.operators.geometry import pack, read_packs, unpack
from legflow.sources import files


def test_csv_by_name_across_encodings_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("X;Y\n1;é\n2\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("Y;Z;X\nü;z;3\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(b"")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv")]
    got = {(r.X, r.Y, r.Z, r._file) for r in files.csv_by_name(spark, paths, ["X", "Y", "Z"], ";").collect()}
    assert got == {("1", "é", None, "a.csv"), ("2", None, None, "a.csv"), ("3", "ü", "z", "b.csv")}
    assert files.lacking(spark, paths[0], ["X", "Q"], ";") == ["Q"]


def test_json_gtfs_and_listings(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"n": 1, "rows": [{"type": "D"}]}, {"n": 2, "rows": [], "new": 5}]))
    t = files.json_arrays(spark, [str(tmp_path / "t.json")], "n int, rows array<struct<type: string>>").collect()
    assert [(r.n, len(r.rows)) for r in t] == [(1, 1), (2, 0)]
    (tmp_path / "stops.txt").write_text("stop_id,stop_name\nat:44:4:0:1,A\n")
    assert files.gtfs(spark, str(tmp_path), "stops", ["stop_id", "zone"]).first()[:2] == ("at:44:4:0:1", None)
    rows = spark.createDataFrame([("x_2020-01-02.zip", 1), ("x_2020_01_02b.zip", 2), ("20200103", 1), ("none", 1), ("2020-13-40", 1)], "url string, published int")
    assert {(str(r.day), r.url) for r in files.latest_per_day(rows).collect()} == {("2020-01-02", "x_2020_01_02b.zip"), ("2020-01-03", "20200103")}


def test_push_port_messages(spark, tmp_path):
    lines = [
        '<Pport xmlns="u:x" ts="2018-01-01T08:00:00Z"><uR><schedule rid="1" uid="U" trainId="2A" ssd="2018-01-01" toc="T"><OR tpl="AA" wtd="10:00"/><PP tpl="BB" wtp="10:05"/><DT tpl="CC" wta="10:10" can="true"/></schedule></uR></Pport>',
        "no xml",
        '<Pport xmlns="u:x" ts="2018-01-01T10:02:00Z"><uR><TS rid="1" ssd="2018-01-01"><Location tpl="AA" wtd="10:00"><dep at="10:01"/></Location><Location tpl="CC" wta="10:10"><arr atRemoved="true"/></Location></TS></uR></Pport>',
    ]
    with gzip.open(tmp_path / "h.gz", "wt") as f:
        f.write("\n".join(lines))
    s, a = files.push_port(spark, [str(tmp_path / "h.gz")])
    assert [(r.tpl, r.kind, r.idx, r.can) for r in s.orderBy("idx").collect()] == [("AA", "OR", 0, "False"), ("BB", "PP", 1, "False"), ("CC", "DT", 2, "True")]
    assert [tuple(r) for r in calls_with_actuals(s, a).collect()] == [("1", "AA", "10:00", "", "10:01")]


def test_route_pack_round_trip(spark, tmp_path):
    routes = [(3, 1, [(0, 0), (65_535, 7)]), (9, 0, []), (70_000, 2, [(5, 5)])]
    data = pack(routes, (1.0, 2.0, 3.0, 4.0))
    assert unpack(data) == ((1.0, 2.0, 3.0, 4.0), routes)
    for bad in (b"XXXX" + data[4:], data[:4] + b"\2" + data[5:], data[:-3], data[:50]):
        try:
            unpack(bad)
            raise AssertionError
        except ValueError:
            pass
    (tmp_path / "r.bin").write_bytes(data)
    got = read_packs(spark.read.format("binaryFile").load(str(tmp_path / "r.bin"))).collect()
    assert {(r.route_id, r.flag, len(r.grid)) for r in got} == {(3, 1, 2), (9, 0, 0), (70_000, 2, 1)}
