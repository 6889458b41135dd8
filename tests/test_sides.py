"""The ground truth and its sides as numbers: the frame's own rows, and no aggregation that sorts."""

import re

import pytest
from pyspark.sql import functions as F

from verdigris.operators import answers as an
from verdigris.operators import paired as pr
from verdigris.plans import bindings as b
from verdigris.plans.paired import c01, c02, c04, c05, c06


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ground_truth_is_that_of_its_sql(spark, small):
    for t in ("lineitem", "orders"):
        b.table(spark, small, t).createOrReplaceTempView(t)
    for name in ("gt", "inc", "cand"):
        want, got = spark.sql(b.frame_sql(name)), b.frame(spark, small, name)
        assert got.columns == want.columns and not got.exceptAll(want).count() and not want.exceptAll(got).count()


def test_nothing_is_sorted_to_be_grouped(spark, small):
    for query in (c01, c02):
        assert "SortAggregate" not in plan(query(spark, small))


def test_coded_units_are_those_of_the_rows(spark):
    rows = [("gt", "1", None, "tol", 1, "save", "other", "network", None, True), ("gt", "1", None, "tol", 2, None, "other", "other", None, True),
            ("inc", "1", None, "tol", 1, "churn", None, None, None, False), ("cand", "2", "7", "tol", 1, "undefined", "save cost", "network", "other", True)]
    df = spark.createDataFrame(rows, "role string, call_id string, phone string, product string, pos long, call_result string, main string, secondary string, third string, parse_ok boolean")
    code = pr.coded("call_result", ["main", "secondary", "third"], "parse_ok", b.CALL_RESULTS, b.REASONS)
    got = pr.units_of_last_coded(df.withColumn("code", F.expr(code)), "pos", b.CALL_RESULTS, b.REASONS)
    key = lambda r: r["call_id"]
    assert sorted(got.collect(), key=key) == sorted(pr.units_of_last(df, "pos").collect(), key=key)
    with pytest.raises(Exception, match="not in the vocabulary"):
        df.withColumn("call_result", F.lit("lost")).select(F.expr(code)).collect()


def test_flips_shuffle_rows_once(spark):
    df = spark.createDataFrame([(i, "c", "p", "tol", "save", "a", None, None) for i in (0, 1)], "replicate int, call_id string, phone string, product string, call_result string, main string, secondary string, third string")
    assert plan(an.flips(df, 2)).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("query", [c02, c04, c05, c06])
def test_tasks_are_as_many_as_the_lines_need(spark, small, monkeypatch, query):
    """What each task joins and groups is bounded: their number follows the lines, not the session's number of partitions."""
    want = sorted(query(spark, small).collect())
    monkeypatch.setattr(b, "LINES_A_TASK", 500)
    n = -(-b.table(spark, small, "lineitem").count() // 500)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for partitions in (3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            df = query(spark, small)
            dealt = re.findall(r"Exchange hashpartitioning\((\w+?)#.*?(\d+)\), ", plan(df))
            assert [x for x in dealt if x[0] not in ("inc_error",)] == [(c, str(n)) for c in ("call_id", "l_orderkey", "o_orderkey")]
            assert sorted(df.collect()) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
