"""Splits that keep blocks whole, their problems, and row numbers by ranges."""

import pytest
from pyspark.sql import functions as F

from verdigris.operators import splits
from verdigris.operators.ranking import ordered_row_number

ITEMS = "item_id string, family string, mechanism string"


def pack(spark, *more):
    base = [(f"RET-{i:02}", "clear" if i < 6 else "noisy", None) for i in range(12)]
    longer = [(f"RET-{100 + i}", "long", f"dilation of RET-{i // 2:02} at {3 + 7 * (i % 2)}x: same") for i in range(4)]
    return spark.createDataFrame([*base, *longer, *more], ITEMS)


def test_blocks_stay_whole_and_strata_take_turns(spark):
    got = {r["item_id"]: (r["block"], r["stratum"], r["part"]) for r in splits.draw(pack(spark)).collect()}
    assert len(got) == 16
    assert {got[i][2] for i in ("RET-00", "RET-100", "RET-101")} == {"tune"} and {got[i][2] for i in ("RET-01", "RET-102", "RET-103")} == {"holdout"}
    assert got["RET-101"][:2] == ("RET-00", splits.SEVERAL)
    assert [got[f"RET-{i:02}"][2] for i in (2, 3, 4, 5)] == ["tune", "holdout", "holdout", "tune"]
    assert [got[f"RET-{i:02}"][2] for i in range(6, 12)] == ["tune", "holdout", "holdout"] * 2
    drawn = splits.draw(pack(spark))
    assert splits.problems(drawn.select("item_id", "part"), pack(spark)).count() == 0


def test_packs_that_cannot_be_split(spark):
    with pytest.raises(ValueError, match="holdout"):
        splits.draw(pack(spark), tune_every=1)
    for bad, why in ((("RET-90", "x", "dilation of RET-99 at 3x: s"), "base"), (("RET-90", "x", "dilation of RET-100 at 3x: s"), "base"), (("RET-00", "x", None), "id of its own"), ((None, "x", None), "id of its own")):
        with pytest.raises(Exception, match=why):
            splits.draw(pack(spark, bad)).collect()
    assert splits.draw(pack(spark).limit(0)).count() == 0
    odd = {r["item_id"]: r["stratum"] for r in splits.draw(pack(spark, ("RET-77", None, None))).collect()}
    assert odd["RET-77"] is None and len(odd) == 17


def test_every_problem_is_a_row(spark):
    tune = ["RET-00", "RET-02", "RET-02", "RET-05", "RET-99"]
    holdout = ["RET-01", "RET-102", "RET-103", "RET-100", "RET-05", *[f"RET-{i:02}" for i in (3, 4, 6, 7, 8, 9, 10)]]
    split = spark.createDataFrame([(i, "tune") for i in tune] + [(i, "holdout") for i in holdout], "item_id string, part string")
    got = sorted((r["problem"], r["part"] or "", r["detail"]) for r in splits.problems(split, pack(spark)).collect())
    assert got == [("duplicate", "tune", "RET-02"), ("missing", "", "RET-101"), ("missing", "", "RET-11"), ("overlap", "", "RET-05"), ("straddling", "", "RET-00"), ("unknown", "tune", "RET-99")]
    none = splits.problems(split.limit(0), pack(spark)).collect()
    assert sorted(r["part"] for r in none if r["problem"] == "empty") == ["holdout", "tune"] and sum(r["problem"] == "missing" for r in none) == 16


@pytest.mark.parametrize("ranges", [1, 2, 7, 50])
def test_row_numbers_by_ranges(spark, ranges):
    rows = [(i, "abc"[i % 3] if i % 11 else None, None if i % 13 == 0 else float(i * 37 % 101), "x" if i < 150 else "y") for i in range(300)]
    df = spark.createDataFrame(rows, "i long, t string, v double, g string")
    key = lambda r: ((r[1] is not None, r[1] or ""), (r[2] is not None, -(r[2] or 0)), r[0])
    order = [F.col("t"), -F.col("v"), F.col("i")]
    got = {r["i"]: r["n"] for r in ordered_row_number(df, order, "n", ranges=ranges).collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(rows, key=key), 1)}
    got = {r["i"]: r["n"] for r in ordered_row_number(df, order, "n", ["g"], ranges).collect()}
    assert got == {r[0]: n for g in "xy" for n, r in enumerate(sorted((r for r in rows if r[3] == g), key=key), 1)}
    assert ordered_row_number(df.limit(0), order, "n", ranges=ranges).count() == 0
