"""Hand-computed values and known numbers."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from verdigris.functions import normalize as nz
from verdigris.functions import responses, similarity, stats
from verdigris.operators import islands, matching, paired, quantiles, ranking, transcripts
from verdigris.operators import scoring as sc
from verdigris.plans.bindings import CALL_RESULTS, PRODUCTS, REASONS
from verdigris.sources import readers, writers
from verdigris.streaming import journal

GT = """5001,0810000001,postpaid,save,network,,
5002,0810000002,postpaid,churn,save cost,network,
5003,0810000003,tol,Save,Network,,
5004,0810000004,postpaid,unknown,contract end,,
5005,0,tvs,save,other,,
5006,0810000006,postpaid,save,network,,
5006,0810000006,tol,churn,save cost,,
5007,0810000007,postpaid,save,"network, save cost",,
5008,0810000008,postpaid,churn,promotion related,,
5010,0810000010,postpaid,undefined,other,,
"""
ARM = """5001,0810000001,postpaid,save,network,,,true
5002,0810000002,postpaid,save,save cost,,,true
5003,0810000003,tol,save ,network,,,true
5005,0,tvs,save,other,,,true
5006,0810000006,postpaid,save,network,,,true
5006,0810000006,tol,churn,save cost,,,true
5007,0810000007,postpaid,save,"save cost, network",,,true
5008,0810000008,postpaid,churn,promotion related,,,true
5009,0810000009,postpaid,save,network,,,true
5010,0810000010,postpaid,save,network,,,true
"""


@pytest.fixture(scope="module")
def arms(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("labels")
    head = "call_id,phone_number,product,call_result,main,secondary,third"
    (at / "gt.csv").write_text(f"{head}\n{GT}")
    (at / "arm.csv").write_text(f"{head},parse_ok\n{ARM}")
    out = []
    for name in ("gt", "arm"):
        rows = readers.label_csv(spark, str(at / f"{name}.csv")).withColumn("pos", F.monotonically_increasing_id())
        norm = rows.select("pos", F.trim("call_id").alias("call_id"), nz.norm_phone(F.col("phone_number")).alias("phone"), nz.norm_text(F.col("product")).alias("product"), nz.norm_text(F.col("call_result")).alias("call_result"), "main", "secondary", "third", F.lit(True).alias("parse_ok"))
        out.append(norm.cache())
    return out


def counts(df):
    return {r["label"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in df.collect()}


def test_call_result_golden(arms):
    scored = sc.score_call_result(sc.label_join(*arms), CALL_RESULTS)
    assert counts(scored) == {"save": (5, 2, 0, 3), "churn": (2, 0, 1, 7), "unknown": (0, 0, 1, 9), "undefined": (0, 0, 1, 9)}
    w = sc.weighted_average(sc.rates(scored)).first()
    assert (w["weight"], w["accuracy"], w["precision"], w["recall"], w["f1"]) == (10, 0.85, 0.6571, 0.7, 0.6567)


def test_reason_golden(arms):
    got = counts(sc.score_reason(sc.label_join(*arms), REASONS))
    assert (got["network"], got["save cost"], got["other"], got["contract end"]) == ((4, 2, 1, 4), (3, 0, 0, 8), (1, 0, 1, 9), (0, 0, 1, 10))
    w = sc.weighted_average(sc.rates(sc.score_reason(sc.label_join(*arms), REASONS))).first()
    assert (w["accuracy"], w["precision"], w["recall"], w["f1"]) == (0.8636, 0.7778, 0.75, 0.7475)


def test_product_golden(arms):
    got = counts(sc.score_product(*arms, PRODUCTS))
    assert got == {"postpaid": (6, 1, 1, 1), "tol": (2, 0, 0, 7), "tvs": (0, 0, 0, 9), "unknown": (0, 0, 0, 9)}


def test_last_duplicate_wins_and_null_keys_match(spark):
    rows = spark.createDataFrame([("1", None, "a", "x", 1), ("1", None, "a", "y", 2)], "call_id string, phone string, product string, v string, pos int")
    one = sc.label_join(rows, rows).collect()
    assert len(one) == 1 and one[0]["gt"]["v"] == one[0]["pred"]["v"] == "y"
    assert sc.label_join(rows, rows, position=None).count() == 4


def test_normalisers(spark):
    rows = spark.createDataFrame([("  Ab　",), ("  ",), (None,), ("NaN",), ("0",)], "x string")
    assert [r[0] for r in rows.select(nz.norm_text(F.col("x"))).collect()] == ["ab", None, None, "nan", "0"]
    assert [r[0] for r in rows.select(nz.norm_phone(F.col("x"))).collect()] == ["ab", None, None, None, None]
    values = [("1,234.50-", "amount"), ("ABC ", "text"), ("12-34", "taxid"), ("31/12/2024", "date"), ("Yes", "bool"), ("x", "amount")]
    got = spark.createDataFrame(values, "x string, k string").select(nz.typed_value(F.col("x"), F.col("k"))).collect()
    assert [r[0] for r in got] == ["-1234.50", "abc", "0000000001234", "2024-12-31", "true", None]
    assert spark.range(1).select(nz.text_key(F.lit("é X​"))).first()[0] == "éx"


def test_sign_bands_and_intervals(spark):
    assert [stats.sign_band(d) for d in range(7)] == [None] * 6 + [6]
    assert stats.sign_band(10) == 8
    low, high = stats.clopper_pearson_of(0, 10, 0.025)
    assert low == 0 and abs(high - 0.3085) < 1e-4
    low, high = stats.clopper_pearson_of(5, 10, 0.025)
    assert abs(low - 0.1871) < 1e-4 and abs(high - 0.8129) < 1e-4
    lo, hi = stats.wilson(F.lit(10), F.lit(10), 1.959964)
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert abs(r["lo"] - 0.7225) < 1e-4 and abs(r["hi"] - 1) < 1e-9


def test_paired_refusal_and_orphans(spark):
    schema = "call_id string, phone string, product string, call_result string, main string, secondary string, third string, parse_ok boolean"
    row = ("1", None, "tol", "save", "network", None, None, True)
    gt, two = spark.createDataFrame([row], schema), spark.createDataFrame([row, row], schema)
    with pytest.raises(ValueError):
        paired.refuse_duplicates(paired.units(gt, two, gt))
    orphan = spark.createDataFrame([("9", "1", "tol", None, None, None, None, True)], schema)
    assert paired.judged(paired.units(gt, orphan, orphan), "call_result").count() == 1


def test_quantile_conventions(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    got = quantiles.quantiles(rows, "v", {"c": ("ceil", 0.95), "r": ("rounded", 0.5), "t": ("trunc", 0.95), "f": ("floor", 0.95)}).first()
    assert (got["c"], got["r"], got["t"], got["f"]) == (10.0, 6.0, 9.0, 10.0)
    assert quantiles.quantiles(rows.limit(1), "v", {"t": ("trunc", 0.95)}).first()["t"] == 1.0


def test_edit_counts_and_runaways():
    assert similarity.edit_counts(list("kitten"), list("sitting")) == (2, 0, 1)
    assert similarity.edit_counts(list("abc"), []) == (0, 3, 0)
    assert similarity.repeated_share("abcdefghijklmnopqrst" * 8) > 0.2
    assert similarity.repeated_share("".join(chr(0x4E00 + i) for i in range(400))) == 0


def test_jaro_winkler_matches_duckdb():
    pairs = [("martha", "marhta"), ("dwayne", "duane"), ("é", "è"), ("dixon", "dicksonx"), ("a", "b"), ("true vision", "true visions")]
    for a, b in pairs:
        want = duckdb.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
        assert abs(similarity.jaro_winkler_bytes(a.encode(), b.encode()) - want) < 1e-9


def test_islands(spark):
    rows = spark.createDataFrame([("a", i, bad) for i, bad in enumerate([1, 1, 1, 1, 0, 1, 1, 0])], "k string, t int, bad int")
    assert [tuple(r) for r in islands.consecutive_runs(rows, ["k"], ["t"], F.col("bad") == 1, 3).collect()] == [("a", 0, 4)]
    spans = spark.createDataFrame([("a", 0, 10), ("a", 5, 7), ("a", 20, 25)], "k string, s int, e int")
    assert tuple(islands.covered(spans, ["k"], "s", "e").first()) == ("a", 15, 25)


def test_joins(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "b", " "), (3, None, None)], "l int, c string, i string")
    right = spark.createDataFrame([(7, "a", "q"), (8, "z", "x"), (9, "z", " ")], "r int, c string, i string")
    got = matching.left_with_either(left, right, [("c", "c"), ("i", "i")], "l", "r").select("l", "r").collect()
    assert sorted((r[0], r[1] or 0) for r in got) == [(1, 7), (1, 8), (2, 0), (3, 0)]
    numbered = ranking.global_row_number(spark.range(100).selectExpr("99 - id as k"), "k", "n")
    assert all(r["n"] == r["k"] + 1 for r in numbered.collect())


def test_transcripts(spark):
    assert spark.range(1).select(transcripts.lossless(F.lit("เเ​ ๑๒  x"))).first()[0] == "แ 12 x"
    clean = spark.createDataFrame([("a b c", "a b c"), ("a b c", "a x c")], "ref string, hyp string")
    rates = [r["substituted"] for r in transcripts.error_counts(clean, "ref", "hyp", "word").collect()]
    assert rates == [0, 1]


def test_responses(spark):
    rows = [('{"k": 1}', "stop"), ('```json\n{"k": 1}\n```', "stop"), ('x {"k": {"a": "}"}} y', "stop"), ("[1]", "stop"), ('{"z": 1}', "stop"), (" ", "length"), ("", "stop"), ("I cannot do", "stop"), ('{"k": ', "length"), ("x", "error")]
    df = spark.createDataFrame(rows, "t string, f string")
    got = [r[0] for r in df.select(responses.outcome(F.col("t"), F.col("f"), F.lit(None).cast("string"), ("k",))).collect()]
    assert got == ["ok", "ok", "ok", "schema_violation", "schema_violation", "empty_length", "empty_other", "refusal", "not_json", "provider_error"]
    assert responses.decision(True, 0, 1.0, 1.0, {"a": "AHEAD"}, {"a": 3}, 2) == "PASS"
    assert responses.decision(True, 0, 1.0, 1.0, {"a": "BEHIND"}, {"a": -3}, 2) == "FAIL"
    assert responses.decision(True, 0, 1.0, 0.5, {"a": "AHEAD"}, {"a": 3}, 2) == "FAIL"
    assert responses.decision(False, 0, 1.0, 1.0, {}, {}, 2) == "UNAVAILABLE"


def test_sources_and_sinks(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    good, torn, odd = tmp_path / "g.jsonl", tmp_path / "t.jsonl", tmp_path / "o.jsonl"
    good.write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n')
    torn.write_text('{"a": 1, "b": "x"}\n{"a": 2, "b')
    odd.write_text('{"a": 1, "b": "x", "c": 0}\n')
    assert readers.strict_jsonl(spark, str(good), schema).count() == 2
    assert len(readers.tolerant_jsonl(spark, str(torn), schema).collect()) == 1
    for bad in (torn, odd):
        with pytest.raises(ValueError):
            readers.strict_jsonl(spark, str(bad), schema)
    base = spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(ValueError):
        writers.merge_insert_only(spark, base, base, ["k"])
    with pytest.raises(ValueError):
        writers.refuse_personal(spark.createDataFrame([("0812345678",)], "v string"))
    assert spark.range(1).select(writers.formula_safe(F.lit("=1+1"))).first()[0] == "'=1+1"
    assert readers.two_row_header([["a", "b"], ["", "c"]]) == ["a", "c"]
    lines = tmp_path / "p.jsonl"
    lines.write_text("\n".join([json.dumps({"key": "1", "status": "ok", "line_items": [{"n": 1}, {"n": 2}]}), json.dumps({"key": "2", "status": "ok", "line_items": []}), json.dumps({"key": "3", "status": "bad"}), "nope"]))
    got = readers.predictions(spark, str(lines), T.StructType([T.StructField("n", T.LongType())])).collect()
    assert sorted((r["outcome"]) for r in got) == ["EMPTY", "FAILED", "INVALID", "SUCCESS", "SUCCESS"]
    name = spark.range(1).select(*readers.file_name_fields(F.lit("/x/5001_08_2024.wav"), ["call", "phone", "time", "agent"])).first()
    assert tuple(name) == ("5001", "08", "2024", None)
    reg = readers.Registry()
    reg.add("labels", "1", readers.label_csv)
    with pytest.raises(ValueError):
        reg.add("labels", "2", readers.label_csv)


def test_journal_stream(spark, tmp_path):
    lines = [{"event": "started", "item_id": "a", "replicate": 1, "ts": "2024-01-01T00:00:00Z"}, {"event": "result", "item_id": "a", "replicate": 1, "ts": "2024-01-01T00:01:00Z", "row": "{}"}, {"event": "result", "item_id": "a", "replicate": 1, "ts": "2024-01-01T00:02:00Z", "row": "{}"}, {"event": "started", "item_id": "b", "replicate": 1, "ts": "2024-01-01T00:03:00Z"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "j.json").write_text("\n".join(map(json.dumps, lines)) + '\n{"event": "resu')
    stream = journal.results(journal.journal_stream(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("journal").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("journal").count() == 1
    events = spark.read.schema(journal.EVENTS).option("mode", "DROPMALFORMED").json(str(tmp_path / "in"))
    assert [tuple(r) for r in journal.unresolved(events).collect()] == [("b", 1)]
    with pytest.raises(ValueError):
        journal.refuse_duplicates(events)
