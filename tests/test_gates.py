"""Runtime gate and decision policies, by hand."""

import pytest

from verdigris.functions.stats import sign_band
from verdigris.operators import gates

CALLS = "arm string, item_id string, outcome string, model string, provider string, reasoning_tokens int, prompt_tokens int"


def test_problems_of_calls(spark):
    good, failed = ("ok", "m", "p", 0, 9), ("transport_error", None, None, None, None)
    arms = {
        "fine": [good, good, failed],
        "other": [good, ("not_json", "n", "q", 0, 9)],
        "nobody": [failed],
        "unknown": [good, ("ok", None, None, 0, 9)],
        "thinks": [good, ("not_json", "m", "p", 3, 9)],
        "silent": [("ok", "m", "p", None, 0)],
        "split": [good, ("ok", "m", "p", 0, 8)],
    }
    df = spark.createDataFrame([(a, "i", *c) for a, calls in arms.items() for c in calls], CALLS)
    got = {r["arm"]: (r["total"], r["parse_ok"], r["reliable"], r["problems"]) for r in gates.runtime_gate(df, ["arm"], "m", "p").collect()}
    assert got["fine"] == (3, 2, False, [])
    assert got["other"][3] == ["model", "provider"] and got["nobody"] == (1, 0, False, ["model", "provider"])
    assert got["unknown"][3] == ["model_unknown", "provider_unknown"] and got["thinks"][3] == ["reasoning"]
    assert got["silent"] == (1, 1, True, ["reasoning", "usage"]) and got["split"][3] == ["split"]


ARM = "arm string, qualification string, parse_ok long, total long, problems array<string>, ref_parse_ok long, ref_total long, ref_problems array<string>"
VERDICT = "arm string, dimension string, discordant long, net long, band int, verdict string"


def judged(d, discordant, net):
    band = sign_band(discordant)
    return d, discordant, net, band, "UNDERPOWERED" if band is None else "AHEAD" if net >= band else "BEHIND" if net <= -band else "INDISTINGUISHABLE"


ALL = [judged(d, 20, 0) for d in (*gates.DIMENSIONS, gates.STABILITY)]
BASE = ("QUALIFIED", 100, 100, [], 100, 100, [])


def decided(spark, cases, **how):
    arms = spark.createDataFrame([(name, *arm) for name, (arm, _) in cases.items()], ARM)
    verdicts = spark.createDataFrame([(name, *v) for name, (_, vs) in cases.items() for v in vs], VERDICT)
    return {r["arm"]: (r["decision"], r["reasons"]) for r in gates.decisions(arms, verdicts, ["arm"], **how).collect()}


def arm(**change):
    names = ("qualification", "parse_ok", "total", "problems", "ref_parse_ok", "ref_total", "ref_problems")
    return tuple(change.get(n, v) for n, v in zip(names, BASE, strict=True))


def test_the_first_rule_that_applies(spark):
    cases = {
        "pass": (arm(), ALL),
        "no_reference": (arm(ref_parse_ok=None, ref_total=None, ref_problems=None), ALL),
        "unqualified": (arm(qualification="SCHEMA_INCOMPATIBLE", parse_ok=0), []),
        "missing": (arm(), ALL[1:]),
        "nothing": (arm(), []),
        "twice": (arm(), [*ALL, ALL[0]]),
        "odd": (arm(), [*ALL, judged("tone", 20, 0)]),
        "made_up": (arm(), [*ALL[:3], (*ALL[3][:4], "AHEAD")]),
        "parity": (arm(), [*ALL[:3], ("stability", 20, 3, 12, "INDISTINGUISHABLE")]),
        "half": (arm(ref_total=None), ALL),
        "counts": (arm(parse_ok=101), ALL),
        "runtime": (arm(problems=["split"], ref_problems=["model"]), ALL),
        "weak_reference": (arm(ref_parse_ok=98, parse_ok=98), ALL),
        "weak": (arm(parse_ok=98), ALL),
        "gate": (arm(parse_ok=99), ALL),
        "behind": (arm(), [judged("call_result", 20, -20), *ALL[1:3], judged("stability", 4, 0)]),
        "thin": (arm(), [*ALL[:3], judged("stability", 4, 0)]),
        "loss": (arm(), [ALL[0], judged("reason", 20, -2), *ALL[2:]]),
    }
    got = decided(spark, cases)
    assert {k for k, v in got.items() if v == ("PASS", [])} == {"pass", "no_reference", "gate"}
    assert got["unqualified"] == ("UNAVAILABLE", ["qualification"])
    assert got["missing"] == ("INCONCLUSIVE", ["missing:call_result"]) and len(got["nothing"][1]) == 4
    assert got["twice"] == ("INCONCLUSIVE", ["duplicate:call_result"]) and got["odd"] == ("INCONCLUSIVE", ["unexpected"])
    assert got["made_up"] == got["parity"] == ("INCONCLUSIVE", ["evidence:stability"])
    assert got["half"] == ("INCONCLUSIVE", ["incumbent_counts"]) and got["counts"] == ("INCONCLUSIVE", ["candidate_counts"])
    assert got["runtime"] == ("INCONCLUSIVE", ["incumbent:model", "candidate:split"])
    assert got["weak_reference"] == ("INCONCLUSIVE", ["incumbent_unreliable"]) and got["weak"] == ("FAIL", ["unreliable"])
    assert got["behind"] == ("FAIL", ["behind:call_result"]) and got["thin"] == ("INCONCLUSIVE", ["underpowered:stability"])
    assert got["loss"] == ("INCONCLUSIVE", ["net_loss:reason"])
    assert decided(spark, {"loss": cases["loss"]}, margins={"reason": 2})["loss"] == ("PASS", [])
    old = decided(spark, cases, policy="legacy_v1")
    assert {k for k, v in old.items() if v[0] == "PASS"} == {"pass", "no_reference", "missing", "nothing", "twice", "odd", "made_up", "parity", "half", "gate", "loss"}
    assert old["runtime"] == ("INCONCLUSIVE", ["incumbent:model"]) and old["behind"] == ("FAIL", ["behind:call_result"])


def test_plans_that_make_no_sense(spark):
    for how in ({"policy": "v3"}, {"expected": ()}, {"expected": ("a", "a")}, {"margins": {"tone": 1}}, {"margins": {"reason": -1}}, {"margins": {"reason": True}}):
        with pytest.raises(ValueError):
            decided(spark, {"a": (arm(), ALL)}, **how)
