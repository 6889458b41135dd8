"""Answers given several times: hand-worked cases of rows, instability, flips and arms."""

import json

import pytest

from verdigris.operators import answers as an

ANSWERS = "item_id string, arm string, replicate int, raw string, payload string, parse_ok boolean"
TRUTHS = "item_id string, call_id string, phone string, products array<string>"


def payload(reasons=("save cost", "", ""), outcome="save", product="Postpaid", advice="do", event="e", keyword="kw"):
    slots = {s: {"reason": r, "keyword": keyword if s == "main" else ""} for s, r in zip(an.SLOTS, reasons, strict=True)}
    return {"product": {product: slots | {"retention_outcome": outcome}}, "call_event_detection": event, "recommendation": advice}


def frames(spark, answers, truths=(("i", "c1", "p1", ["postpaid", "tvs"]),)):
    rows = [(i, "a", n, raw if raw is not None else json.dumps(p), json.dumps(p) if p is not None else None, ok) for n, (i, raw, p, ok) in enumerate(answers)]
    return spark.createDataFrame(rows, ANSWERS), spark.createDataFrame(list(truths), TRUTHS)


def classified(spark, *answers):
    row = an.classify(*frames(spark, [("i", *a) for a in answers])).first()
    return row["observable"], row["raw_unstable"], row["scored_unstable"], row["cosmetic_only"], row["changed"]


def test_decision_table_of_an_item(spark):
    one = (None, payload(), True)
    assert classified(spark, one) == (False, False, False, False, [])
    assert classified(spark, one, one) == (True, False, False, False, [])
    assert classified(spark, one, (None, payload(advice="other"), True)) == (True, True, False, True, ["recommendation"])
    assert classified(spark, one, one, (None, payload(reasons=("network", "", "")), True)) == (True, True, True, False, [])
    assert classified(spark, one, ("broken", None, False)) == (True, True, True, False, ["recommendation", "call_event_detection", "keyword"])
    # a label in another slot, in other letters, or twice is the same answer
    assert classified(spark, one, (None, payload(reasons=("Save cost", "save cost ", "")), True)) == (True, True, False, True, [])
    assert classified(spark, one, (None, payload(keyword="other"), True)) == (True, True, False, True, ["keyword"])
    assert classified(spark, one, (None, payload(event=["x"]), True)) == (True, True, False, True, ["call_event_detection"])


def test_what_cannot_be_is_an_error(spark):
    with pytest.raises(Exception, match="gave different rows"):
        classified(spark, ("same", payload(), True), ("same", payload(outcome="churn"), True))
    with pytest.raises(Exception, match="not in the test set"):
        an.classify(*frames(spark, [("other", None, payload(), True)])).collect()


def test_decomposition_counts_observable_items_only(spark):
    same, moved, scored = payload(), payload(advice="x"), payload(outcome="churn")
    answers = [("a", None, same, True), ("a", None, same, True), ("b", None, same, True), ("b", None, moved, True), ("c", None, same, True), ("c", None, scored, True), ("d", None, same, True)]
    items = an.classify(*frames(spark, answers, [(i, "c" + i, None, ["tvs"]) for i in "abcd"]))
    got = an.decompose(items).first().asDict()
    assert (got["items"], got["observable"], got["not_observable"], got["raw_unstable"], got["scored_unstable"], got["cosmetic_only"]) == (4, 3, 1, 2, 1, 1)
    assert got["raw_unstable_rate"] == pytest.approx(2 / 3) and got["cosmetic_share_of_instability"] == 0.5
    assert (got["cosmetic_recommendation"], got["cosmetic_call_event_detection"], got["cosmetic_keyword"]) == (1, 0, 0)
    stable = an.decompose(items.where("item_id in ('a', 'd')")).first()
    assert stable["cosmetic_share_of_instability"] == 0.0 and stable["raw_unstable_rate"] == 0.0


def test_rows_of_an_answer(spark):
    def rows(p, ok=True, products=("postpaid", "tvs")):
        answers, truths = frames(spark, [("i", None, p, ok)], [("i", "c1", "p1", list(products))])
        out = an.flatten(answers, truths).collect()
        assert {(r["call_id"], r["phone"], r["parse_ok"]) for r in out} == {("c1", "p1", ok)}
        return sorted(((r["product"], r["call_result"], r["main"], r["named_no_product"]) for r in out), key=str)

    blank = [("postpaid", None, None), ("tvs", None, None)]
    assert rows(payload()) == [("Postpaid", "save", "save cost", False)]
    assert rows(payload(), ok=False) == [(*b, False) for b in blank]
    assert rows(None) == [(*b, False) for b in blank]
    for empty in ({"product": {}}, {"product": {"tol": None}}, {"product": [1]}, {}):
        assert rows(empty) == [(*b, True) for b in blank]
    assert rows({}, products=()) == [(None, None, None, True)]
    # a malformed block loses its labels only; a reason that is no text is none
    assert rows({"product": {"tol": 5, "tvs": {"main": {"reason": ["network"]}}}}) == [("tol", None, "", False), ("tvs", None, "", False)]


ROWS = "replicate int, call_id string, phone string, product string, call_result string, main string, secondary string, third string"


def flipped(spark, replicates, *rows):
    got = an.flips(spark.createDataFrame([(*r, *[None] * (8 - len(r))) for r in rows], ROWS), replicates).collect()
    return {r["dimension"]: r["flips"] for r in got}


def test_flips_count_cells(spark):
    a = (1, "c", None, "tol", "save", "network")
    assert flipped(spark, 2, a, (2, "c", None, "tol", "churn", "other")) == {"call_result": 1, "reason": 1, "product": 0}
    assert flipped(spark, 2, a, (2, "c", None, "tol", "save", "other")) == {"call_result": 0, "reason": 1, "product": 0}
    assert flipped(spark, 3, a, (2, *a[1:]), (3, *a[1:])) == {"call_result": 0, "reason": 0, "product": 0}
    # a row that moves to another product leaves two cells of each kind, and the call's set differs
    assert flipped(spark, 2, a, (2, "c", None, "tvs", "save", "network")) == {"call_result": 2, "reason": 2, "product": 1}
    assert flipped(spark, 2, a) == {"call_result": 1, "reason": 1, "product": 1}
    assert flipped(spark, 1, a) == {"call_result": 0, "reason": 0, "product": 0}
    # a key twice is seen, though its labels are the same; products are a set
    assert flipped(spark, 2, a, a, (2, *a[1:])) == {"call_result": 1, "reason": 1, "product": 0}
    # a call without products is not a call that is absent
    assert flipped(spark, 2, (1, "c", "p"), (2, "c", "p")) == {"call_result": 0, "reason": 0, "product": 0}
    # reasons are a set whatever their slots
    assert flipped(spark, 2, a, (2, "c", None, " TOL", "Save", "", None, "Network,network")) == {"call_result": 0, "reason": 0, "product": 0}
    assert flipped(spark, 2) == {}


def test_arms_against_each_other(spark):
    one, other = payload(), payload(outcome="churn")
    two = payload() | {"product": payload()["product"] | {"tvs": {"retention_outcome": "save"}}}
    cases = {
        "same": ([one, one], [one, one]),
        "changed": ([one, one], [other, other]),
        "noise": ([one, other], [one, one]),
        "both": ([one, one], [two, other | {"product": two["product"]}]),
        "failed": ([one, one], [one, None]),
        "alone": ([one, one], []),
        "bad": ([{"product": {"tol": None}}] * 2, [{"product": {"tol": 5}}] * 2),
    }
    rows = [(i, arm, n, None, None if p is None else json.dumps(p), p is not None) for i, sides in cases.items() for arm, side in zip("ab", sides, strict=True) for n, p in enumerate(side)]
    answers = spark.createDataFrame([*rows, ("same", "elsewhere", 0, None, None, False)], ANSWERS)
    fields = an.field_verdicts(answers, ("a", "b"))
    got = {(r["item_id"], r["path"]): r["verdict"] for r in fields.collect()}
    assert got["same", "Postpaid.outcome"] == got["changed", "products"] == got["changed", "Postpaid.reasons"] == "SAME"
    assert got["changed", "Postpaid.outcome"] == "CHANGED" and got["noise", "Postpaid.outcome"] == "NOISE"
    assert got["both", "products"] == got["both", "tvs.outcome"] == "CHANGED" and got["failed", None] == got["alone", None] == "PARSE_FAILED"
    assert got["bad", "tol.outcome"] == "SAME" and ("bad", "tol.reasons") not in got
    items = {r["item_id"]: (r["verdict"], r["changed"], r["noise"], r["paths"]) for r in an.item_verdicts(fields).collect()}
    assert items["same"] == ("SAME", 0, 0, 3) and items["changed"] == ("CHANGED", 1, 0, 3) and items["noise"] == ("NOISE", 0, 1, 3)
    assert items["failed"] == items["alone"] == ("PARSE_FAILED", 0, 0, 0) and items["both"][0] == "CHANGED"
    with pytest.raises(Exception, match="not all its replicates"):
        an.field_verdicts(answers, ("a", "b"), replicates=2).collect()
