import random

from legflow.llm.nearest import nearest_times, runs_with_trips

R = "rid long, num string, service_day string, t_a long, a_a long, t_b long, a_b long"
T = "trip_id string, num string, service_day string, t_first long, t_last long, who string"


def test_against_brute_force(spark):
    r = random.Random(2)
    a = [(r.choice("xyz"), r.randrange(0, 400_000)) for _ in range(400)] + [("x", 86_400 * k) for k in range(4)]
    b = [(r.choice("xyw"), r.randrange(0, 400_000)) for _ in range(400)] + [("x", 86_400 * k - 5) for k in range(4)] + [("x", 86_400 * k + 5) for k in range(4)]
    got = {(x.entity, x.t): x.rt for x in nearest_times(spark.createDataFrame(a, "entity string, t long"), spark.createDataFrame(b, "entity string, t long"), 900).collect()}
    want = {}
    for e, t in a:
        near = sorted((abs(u - t), u) for f, u in b if f == e and abs(u - t) <= 900)
        if near:
            want[e, t] = near[0][1]
    assert got == want


def test_numbers_units_ties_and_nulls(spark):
    runs = [(1, "RJX 020", None, 1_500_000_000, None, None, None), (2, "#20", None, 1_500_000_000_000, None, 5, None), (3, " 20 ", None, None, None, 1_500_005_000, None), (4, None, None, 1_500_000_000, None, None, None), (5, "20", None, None, None, None, None), (6, "21", None, 1_500_000_000, None, None, None), (7, "x", None, 1, None, None, None), (1, "RJX 020", None, 1_500_000_000, None, None, None)]
    trips = [("late", "20", None, 1_500_000_060, 1_500_005_000, "q"), ("early", "20", None, 1_499_999_940, 1_500_004_000, "q"), ("early2", "20", None, 1_499_999_940, 1_500_004_000, "q"), ("far", "21", None, 1_500_000_901, 0, "q"), (None, "20", None, 1_500_000_000, 0, "q"), ("nul", None, None, 1_500_000_000, 0, "q")]
    got = {tuple(x) for x in runs_with_trips(spark.createDataFrame(runs, R), spark.createDataFrame(trips, T)).collect()}
    assert got == {(1, "early"), (2, "early"), (3, "late")}
    assert runs_with_trips(spark.createDataFrame([], R), spark.createDataFrame(trips, T)).count() == 0
    assert runs_with_trips(spark.createDataFrame(runs, R), spark.createDataFrame([], T)).count() == 0
