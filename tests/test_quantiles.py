"""Quantiles by rank among far outliers, against sorting; how many values a step holds."""

import math
import random

from pyspark.sql import functions as F

from verdigris.operators import quantiles as qu

PICKS = {"p50": ("ceil", 0.5), "p95": ("ceil", 0.95), "p99": ("floor", 0.99)}


def rows():
    dice = random.Random(9)
    usual = [("usual", round(dice.lognormvariate(0, 1), 4)) for _ in range(3000)] + [("usual", 1e7)]
    signed = [("signed", round(dice.gauss(0, 50), 2)) for _ in range(800)] + [("signed", -1e12), ("signed", 3e15)]
    return usual + signed + [("one", 4.0)] * 5 + [("none", None)] + [(None, x) for x in (0.0, 1e-9, 1e300, -1e300)]


def test_against_sorting(spark):
    data = rows()
    got = {r["g"]: r for r in qu.quantiles(spark.createDataFrame(data, "g string, v double"), "v", PICKS, ["g"], digits=12).collect()}
    assert set(got) == {"usual", "signed", "one", None}
    for g, r in got.items():
        v = sorted(x for k, x in data if k == g and x is not None)
        assert r["n"] == len(v)
        want = [v[math.ceil(0.5 * len(v)) - 1], v[math.ceil(0.95 * len(v)) - 1], v[min(len(v) - 1, int(0.99 * len(v)))]]
        assert [r["p50"], r["p95"], r["p99"]] == want, g


def test_an_outlier_does_not_fill_a_step(spark):
    df = spark.createDataFrame([r for r in rows() if r[0] == "usual"], "g string, v double")
    steps = df.select(qu._step(F.col("v"), F.lit(0.0), F.lit(1e7)).alias("s")).groupBy("s").count()
    assert steps.agg(F.max("count")).first()[0] < 60
