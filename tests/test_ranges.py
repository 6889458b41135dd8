import random

from pyspark.sql import functions as F

from verdigris.operators import islands, matching


def test_range_join_is_all_pairs(spark):
    rng = random.Random(2)
    points = [(rng.randrange(3), rng.randrange(-500, 500), i) for i in range(200)] + [(0, None, 900), (0, -(2**62), 901), (1, 2**62, 902)]
    ranges = [(rng.randrange(3), lo, lo + rng.choice([-1, 0, 1, 7, 300, 2000]), i) for i, lo in enumerate(rng.choices(range(-500, 500), k=40))]
    ranges += [(1, None, 5, 90), (1, 3, None, 91), (0, -(2**62), -(2**62), 92), (1, 0, 2**62, 93)]
    p, r = spark.createDataFrame(points, "g int, at long, p int"), spark.createDataFrame(ranges, "g int, lo long, hi long, r int")
    inside = lambda a, lo, hi: None not in (a, lo, hi) and lo <= a <= hi
    got = matching.range_join(p, r, "at", "lo", "hi", ["g"])
    want = sorted((x[2], y[3]) for x in points for y in ranges if x[0] == y[0] and inside(x[1], y[1], y[2]))
    assert sorted((x["p"], x["r"]) for x in got.select("p", "r").collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    left = matching.range_join(p, r, "at", "lo", "hi", ["g"], "left").select("p", "r").collect()
    alone = {y[3] for y in ranges} - {b for _, b in want}
    assert sorted(((x["p"], x["r"]) for x in left), key=str) == sorted([*want, *[(None, b) for b in alone]], key=str)
    assert matching.range_join(p, r.where("r < 0"), "at", "lo", "hi", ["g"]).count() == 0


def test_excused_gaps(spark):
    polls = spark.createDataFrame([("h", t) for t in (0, 10, 100, 200, 205)] + [("i", 0), ("i", 500)], "host string, ts long")
    requests = spark.createDataFrame([("h", 50, True), ("h", 60, False), ("h", 150, False), ("i", 501, True)], "host string, at long, ok boolean")
    got = islands.excused_gaps(polls, requests, ["host"], "ts", 60, "at", "ok")
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == [("h", 10, 100, 90, 2, 1, True), ("h", 100, 200, 100, 1, 0, False), ("i", 0, 500, 500, 0, 0, False)]
