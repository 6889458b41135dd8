import hashlib
import json
import threading

import pytest
from pyspark.sql import functions as F

from verdigris.functions import jsons
from verdigris.sources.versions import LostRace, VersionedLog, drop_expired, drop_older


def rows(spark, *ids, ts="2026-08-01 00:00:00"):
    return spark.createDataFrame([(i, f"job{i}", ts) for i in ids], "id long, job string, update_dt string")


def ids(log):
    return sorted(r["id"] for r in log.read().collect())


def test_append_keeps_versions(spark, tmp_path):
    log = VersionedLog(spark, str(tmp_path / "log"))
    assert log.version() == 0 and log.read() is None
    assert log.append(rows(spark, 1)) == 1
    wider = rows(spark, 2).withColumn("note", F.lit("x"))
    assert log.append(wider) == 2
    assert ids(log) == [1, 2] and {r["id"]: r["note"] for r in log.read().collect()} == {1: None, 2: "x"}
    assert [r["id"] for r in log.read(1).collect()] == [1]


def test_the_loser_reads_again_and_no_row_is_lost(spark, tmp_path):
    log, other = (VersionedLog(spark, str(tmp_path / "log")) for _ in range(2))
    log.append(rows(spark, 1))
    once = iter([lambda: other.append(rows(spark, 2))])
    assert log.append(rows(spark, 3), before_commit=lambda: next(once, lambda: None)()) == 3
    assert ids(log) == [1, 2, 3]
    folders = [p.name for p in (tmp_path / "log").iterdir() if p.name.startswith("rows-")]
    assert len(folders) == 3  # what lost the race is gone


def test_losing_twice_is_an_error_and_changes_nothing(spark, tmp_path):
    log, other = (VersionedLog(spark, str(tmp_path / "log")) for _ in range(2))
    more = iter(range(10, 20))
    with pytest.raises(LostRace):
        log.append(rows(spark, 1), before_commit=lambda: other.append(rows(spark, next(more))))
    assert ids(log) == [10, 11]


def test_two_writers_at_once(spark, tmp_path):
    path, made = str(tmp_path / "log"), []
    writers = [threading.Thread(target=lambda i=i: made.append(VersionedLog(spark, path).append(rows(spark, i)))) for i in (1, 2)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(made) == [1, 2] and ids(VersionedLog(spark, path)) == [1, 2]


def test_prune_sort_and_forget(spark, tmp_path):
    log = VersionedLog(spark, str(tmp_path / "log"))
    log.append(rows(spark, 1, ts="2020-01-01 00:00:00").union(rows(spark, 2, ts="soon")))
    log.append(rows(spark, 3), prune=drop_older("update_dt", "2026-01-01"), newest_first="update_dt")
    assert ids(log) == [2, 3]
    log.append(rows(spark, 4), prune=drop_expired("job", ["job2"]))
    assert ids(log) == [3, 4]
    log.forget(keep=1)
    assert ids(log) == [3, 4] and len([p for p in (tmp_path / "log").iterdir() if p.name.startswith("rows-")]) == 1
    assert log.append(rows(spark, 5)) == 4


def test_a_manifest_that_is_never_filled(spark, tmp_path, monkeypatch):
    from verdigris.sources import versions

    monkeypatch.setattr(versions, "PATIENCE", 0.3)
    log = VersionedLog(spark, str(tmp_path / "log"))
    log.append(rows(spark, 1))
    (tmp_path / "log" / "_versions" / f"{2:020d}.json").write_text("")
    assert ids(log) == [1]
    with pytest.raises(LostRace, match="not filled"):
        log.append(rows(spark, 2))
    assert log.repair() and not log.repair()
    assert log.append(rows(spark, 2)) == 2 and ids(log) == [1, 2]


# canonical JSON and paths


@pytest.mark.parametrize("value", [{"b": 1.0, "a": -0.0}, {"n": 10**41, "f": 1e300}, {"é": "ü", "😀": 1, "￿": 2}, [1, [None, True]], "x", {"k": {"z": [], "y": {}}}])
def test_canonical_sha(spark, value):
    loose = json.dumps(value, indent=3)
    want = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    row = spark.createDataFrame([(loose,)], "t string").select(jsons.canonical(F.col("t")).alias("c"), jsons.canonical_sha(F.col("t")).alias("s")).first()
    assert tuple(row) == (want, hashlib.sha256(want.encode()).hexdigest())


def test_odd_json(spark):
    texts = [None, "", "{", '{"a":1,"a":2}', '"\\ud800"']
    got = [r["c"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(jsons.canonical(F.col("t")).alias("c")).collect()]
    assert got == [None, None, None, '{"a":2}', None]


@pytest.mark.parametrize(
    ("text", "path", "want"),
    [('{"0":{"x":2}}', "0.x", "2"), ('{"l":[{"0":7}]}', "l.0.0", "7"), ('{"a\'b":1}', "a'b", "1"), ('{"a":{"b":"x y"}}', "a.b", "x y"), ('{"a":[1]}', "a.1", None), ('{"a":[1]}', "a.x", None), ('{"a":null}', "a", None), ('{"a":{"b":[1.0]}}', "a", '{"b":[1.0]}'), ("[[3]]", "0.0", "3"), ("nope", "a", None)],
)
def test_at_path(spark, text, path, want):
    assert spark.createDataFrame([(text,)], "t string").select(jsons.at_path(F.col("t"), path).alias("v")).first()["v"] == want


def test_round_trip_tells_what_a_variant_loses(spark):
    texts = ['{"k": 1}', '{"k": 1.0}', "{", None]
    got = [r["s"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(jsons.round_trip(F.col("t")).alias("s")).collect()]
    assert got == [True, False, False, False]
