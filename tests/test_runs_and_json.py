"""Qualification, the run index, and JSON texts, worked by hand."""

import json

from pyspark.sql import functions as F

from verdigris.functions import jsons
from verdigris.operators import runs

CALL = {"outcome": "ok", "model": "m", "provider": "p", "reasoning_tokens": 0, "prompt_tokens": 9, "item_id": 1, "http_status": 200}


def test_qualification(spark):
    probes = {
        "fine": [{}] * 6,
        "five": [{}] * 5,
        "refused": [{}] * 5 + [{"http_status": 404, "outcome": "transport_error"}],
        "shape": [{}] * 5 + [{"outcome": "not_json", "reasoning_tokens": 3}],
        "regime": [{}] * 5 + [{"reasoning_tokens": 3, "model": "other"}],
        "identity": [{}] * 5 + [{"provider": "q", "prompt_tokens": None}],
        "nobody": [{"model": None}] * 6,
        "unused": [{}] * 5 + [{"prompt_tokens": 0}],
        "split": [{}] * 5 + [{"prompt_tokens": 10}],
        "unknown": [{}] * 5 + [{"reasoning_tokens": None}],
        "failed": [{}] * 5 + [{"outcome": "empty_other"}],
    }
    schema = "probe string, outcome string, model string, provider string, reasoning_tokens int, prompt_tokens int, item_id int, http_status int"
    rows = [(name, *(CALL | c).values()) for name, calls in probes.items() for c in calls]
    got = {r["probe"]: (r["calls"], r["parse_ok"], r["status"].removesuffix("_INCOMPATIBLE")) for r in runs.qualification(spark.createDataFrame(rows, schema), ["probe"], "m", "p").collect()}
    assert got == {
        "fine": (6, 6, "QUALIFIED"), "five": (5, 5, "SCHEMA"), "refused": (6, 5, "REQUEST"), "shape": (6, 5, "SCHEMA"), "regime": (6, 6, "REGIME"), "identity": (6, 6, "IDENTITY"),
        "nobody": (6, 6, "IDENTITY"), "unused": (6, 6, "PROVENANCE"), "split": (6, 6, "PROVENANCE"), "unknown": (6, 6, "PROVENANCE"), "failed": (6, 5, "SCHEMA"),
    }


def test_run_index(spark, tmp_path):
    for name, body in (("b", {"run_id": "x2", "created_utc": "2026-02", "rows": 4}), ("a", {"created_utc": "2026-03"}), ("c", {"run_id": "2026-01"}), ("bad", None)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.json").write_text(json.dumps(body, indent=1) if body else "{cut")
    (tmp_path / "dry").mkdir()
    (tmp_path / "dry" / "requests.jsonl").write_text("{}")
    got = [(r["directory"], r["run_id"], r["rows"], r["readable"]) for r in runs.run_index(spark, str(tmp_path)).collect()]
    assert got == [("c", "2026-01", None, True), ("b", "x2", 4, True), ("a", "a", None, True), ("bad", "bad", None, False)]


def test_run_index_columns_and_directories_without(spark, tmp_path):
    proofs = [
        ({"a": [5], "b": [7]}, {}, 3, "2/2"), ({"a": [5, 6], "b": [7], "c": []}, {"a": [5, 6]}, 3, "SPLIT 1/2"),
        ({"a": [5]}, {}, 1, "n/a (1 rep)"), ({}, {}, 3, "-"), (None, None, None, "-"),
    ]
    for i, (spread, split, repeats, _) in enumerate(proofs):
        (tmp_path / f"r{i}" / "deep").mkdir(parents=True)
        meta = {"prompt_token_spread": spread, "split_items": split, "repeats": repeats, "provider_requested": "p" if i else None, "prompt_id": "v2", "items": 4, "outcome_counts": [{"ok": 9}, {"not_json": 2, "ok": 1, "empty": 3}, {"empty": 1}, {}, None][i]}
        (tmp_path / f"r{i}" / "run.json").write_text(json.dumps(meta))
        (tmp_path / f"r{i}" / "deep" / "run.json").write_text("{}")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "run.json").write_text("{cut")
    (tmp_path / "dry").mkdir()
    got = runs.run_index(spark, str(tmp_path)).where("readable").collect()
    assert [r["directory"] for r in got] == [f"r{i}" for i in range(5)]
    assert [r["token_proof"] for r in got] == [p[3] for p in proofs]
    assert [r["outcomes"] for r in got] == ["ok=9", "ok=1, empty=3, not_json=2", "ok=0, empty=1", "-", "-"]
    assert [r["provider_requested"] for r in got] == [None, "p", "p", "p", "p"] and {r["items"] for r in got} == {4}
    assert [tuple(r) for r in runs.without_run(spark, str(tmp_path)).collect()] == [("bad", "unreadable run.json"), ("dry", "no run.json")]
    assert runs.run_index(spark, str(tmp_path / "none")).count() == runs.without_run(spark, str(tmp_path / "r0" / "deep")).count() == 0


def test_json_texts(spark):
    rows = [('{"b": [1, {"k": "x"}], "a": {"k": {"k": 2}}}',), ('{ "a":{"k":{"k":2}} , "b":[1,{"k":"x"}] }',), ("[1",), (None,)]
    got = (
        spark.createDataFrame(rows, "t string")
        .select(jsons.canonical("t").alias("c"), jsons.canonical_sha("t").alias("s"), jsons.at_path(F.col("t"), "b.1.k").alias("p"), jsons.at_path(F.col("t"), "a.z").alias("z"), jsons.values_of(F.col("t"), "k").alias("v"), jsons.round_trip("t").alias("r"))
        .collect()
    )
    assert got[0]["c"] == got[1]["c"] == '{"a":{"k":{"k":2}},"b":[1,{"k":"x"}]}' and got[0]["s"] == got[1]["s"]
    assert [r["p"] for r in got] == ["x", "x", None, None] and got[0]["z"] is None
    assert sorted(got[0]["v"]) == sorted(['{"k":2}', "2", '"x"']) and got[2]["v"] == got[3]["v"] == []
    assert [r["r"] for r in got] == [True, True, False, False]


def test_only_singles_fails_where_a_key_is_there_twice(spark):
    import pytest

    from verdigris.operators import paired

    schema = "call_id string, phone string, product string, call_result string, main string, secondary string, third string"
    one = spark.createDataFrame([("1", "2", "tol", "save", None, None, None)], schema)
    assert paired.only_singles(paired.units(one, one, one)).count() == 1
    with pytest.raises(Exception, match="several rows"):
        paired.only_singles(paired.units(one, one.union(one), one)).collect()
