import random
from datetime import date, timedelta

from legflow.operators.history import coalesce_history, station_history

S = "snap date, stop_id string, stop_name string, stop_lat string, stop_lon string, location_type string, valid_from string"


def test_against_a_sequential_fold(spark):
    r, rows, want = random.Random(5), [], set()
    for e in range(40):
        days = sorted(r.sample(range(200), r.randint(1, 30)))
        runs = []
        for d in days:
            v = r.choice(["a", "b", None])
            day = date(2020, 1, 1) + timedelta(d)
            rows.append((e, day, v))
            if not runs or runs[-1][1] != v:
                runs.append([day, v])
        for i, (d, v) in enumerate(runs):
            want.add((e, v, d, runs[i + 1][0] - timedelta(1) if i + 1 < len(runs) else date(9999, 12, 31)))
    r.shuffle(rows)
    got = coalesce_history(spark.createDataFrame(rows, "e int, day date, v string"), "e", "day", ["v"])
    assert {tuple(x) for x in got.collect()} == want


def test_which_row_of_a_station_counts(spark):
    d1, d2, d3 = date(2023, 1, 1), date(2023, 1, 8), date(2023, 1, 15)
    rows = [
        (d1, "85", " A  B ", "47.000001", "8.0", "", ""), (d1, "85:0:1", "X", "40", "8", "0", ""), (d1, "Parent85", "Y", "41", "8", "1", ""),
        (d2, "85", "bad", "n/a", "8.0", "", ""), (d2, "Parent85", "A B", "47.0", "8.0", "0", ""), (d2, "85P", "Z", "1", "1", "1", ""),
        (d3, "85:0:1", "A B", "46.9", "8.0", "0", ""), (d3, "85:0:2", "A B", "47.1", "8.0", None, ""), (d3, "85:0:2", "A B", "47.1", "8.0", None, ""),
        (d1, "gen:85", "Q", "1", "1", "", ""), (None, "86", "Q", "1", "1", "", ""), (d2, "87", None, "1", "1", "", ""), (d1, None, "Q", "1", "1", "", ""),
    ]
    got = {(r.bpuic, r.name, float(r.lat), str(r.valid_from), str(r.valid_to)) for r in station_history(spark.createDataFrame(rows, S)).collect()}
    assert got == {(85, "A B", 47.0, "2023-01-01", "9999-12-31"), (87, None, 1.0, "2023-01-08", "9999-12-31")}


def test_empty(spark):
    assert station_history(spark.createDataFrame([], S)).count() == 0
