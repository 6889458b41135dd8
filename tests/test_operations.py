from verdigris.operators import operations


def test_summary_by_hand(spark):
    rows = [("m", "ok", float(i), 10, None if i == 3 else i, None if i % 2 else 0.5) for i in range(1, 101)] + [("n", "not_json", None, None, None, None)]
    df = spark.createDataFrame(rows, "arm string, outcome string, latency_s double, prompt_tokens long, completion_tokens long, cost double")
    got = {r["arm"]: r.asDict() for r in operations.operational_summary(df, ["arm"]).collect()}
    m = got["m"]
    assert (m["calls"], m["parse_ok"], m["reliable"], m["p50"], m["p95"], m["p99"], m["top"]) == (100, 100, True, 50.0, 95.0, 99.0, 100.0)
    assert (m["prompt_tokens"], m["completion_tokens"], m["missing_completion"], m["cost_floor"], m["missing_cost"]) == (1000, 5047, 1, 25.0, 50)
    n = got["n"]
    assert (n["calls"], n["parse_valid_rate"], n["reliable"], n["p50"], n["top"], n["cost_floor"]) == (1, 0.0, False, None, None, None)


def test_blocks_and_arms_by_hand(spark):
    rows = [(None, i, None if i == 20 else float(i)) for i in range(1, 21)]
    df = spark.createDataFrame(rows, "gpu string, at long, v double")
    got = operations.sample_blocks(df, ["gpu"], "v", "at").first().asDict()
    assert got == {"gpu": None, "samples": 19, "low": 1.0, "mean": 10.0, "top": 19.0, "delta": 18.0, "p95": 19.0}
    arms = spark.createDataFrame([("a", float(i), i, i % 2 == 0) for i in range(1, 21)] + [("b", 7.0, 1, True)], "arm string, latency_s double, prompt_tokens long, audio boolean")
    got = {r["arm"]: tuple(r)[1:] for r in operations.arm_table(arms, ["arm"]).collect()}
    assert got == {"a": (20, 10.5, 100, 110, 10.0, 19.0), "b": (1, 7.0, 0, 1, 7.0, 7.0)}
