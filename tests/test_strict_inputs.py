"""Answers, transcripts and test sets at the edges of their rules."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions import responses as rs
from verdigris.functions import similarity as sim
from verdigris.sources import readers

CASES = [
    ('{"k": 1}', "ok"),
    ('﻿{"k": 1}', "ok"),
    ('```json\n{"k": 1}\n```', "ok"),
    ('```json\n{"k": 1}\n``` as asked', "ok"),
    ('```json\n{"k": 1}', "ok"),
    ('Here: {"k": "a } b", "m": {"n": 1}} done', "ok"),
    ('﻿```\nSure {"k": 1}\n```', "ok"),
    ('{"a": {"k": 1}, "b": "cut', "not_json"),
    ('text {"a": {"k": 1}', "not_json"),
    ('{"x": "customer said i cannot', "not_json"),
    ("I won't do that", "refusal"),
    ("We cannot comply with this", "refusal"),
    ("  As a language model, no", "refusal"),
    ("ขอโทษค่ะ", "refusal"),
    ("x" * 200 + " i cannot", "not_json"),
    ("[1, 2]", "schema_violation"),
    ('{"m": 1}', "schema_violation"),
    ("", "empty_other"),
]


def test_response_outcomes(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = rows.select("i", rs.outcome(F.col("t"), F.lit("stop"), F.lit(None).cast("string"), ("k",)).alias("o")).orderBy("i").collect()
    assert [r["o"] for r in got] == [o for _, o in CASES]


@pytest.mark.parametrize(
    "text, share",
    [
        ("", 0),
        ("x" * 79, 0),  # a unit has 20 characters and is shorter than a quarter
        ("a" * 500, 1),
        ("ab" * 300, 1),
        ("word " * 3, 0),
        ("the quick brown fox jumps. " * 9 + "z" * 70, 8 * 27 / 313),  # 27 characters eight times from within the first
        ("".join(chr(33 + i % 90) for i in range(180)), 0),  # everything twice only
        ("0123456789" * 30 + "".join(chr(200 + i) for i in range(900)), 0),  # no probe stands in the loop
    ],
)
def test_repeated_share(text, share):
    assert sim.repeated_share(text) == pytest.approx(share)


def test_runaways(spark):
    rows = [("", "anything at all"), ("abcd", "abcdefg"), ("abcd", "abcdef"), ("a" * 300, "the same words again and over. " * 10), ("a" * 900, "the same words again and over. " * 10), (None, "x")]
    got = spark.createDataFrame(rows, "r string, h string").select(sim.runaway("r", "h").alias("k")).collect()
    assert [r["k"] for r in got] == [None, "length", None, "repetition", None, None]


SCHEMA = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("n", T.LongType())])


@pytest.mark.parametrize(
    "raw, fine",
    [
        (b'{"item_id": "a", "n": 1}\n\n{"item_id": "b", "n": 2}\n', True),
        (b'\xef\xbb\xbf{"item_id": "a", "n": 1}\n{"item_id": "b", "n": 2}\n', False),
        (b'\xff\xfe{\x00', False),
        (b'{"item_id": "a", "n": 1}\r\n', False),
        (b'{"item_id": "a\rb", "n": 1}\n', False),
        (b'{"item_id": "\xff\xfe", "n": 1}\n', False),
        (b'{"item_id": "a"}\n', False),
        (b'{"item_id": "a", "n": 1, "m": 2}\n', False),
        (b"not json\n", False),
    ],
)
def test_strict_jsonl(spark, tmp_path, raw, fine):
    (tmp_path / "set.jsonl").write_bytes(raw)
    if fine:
        assert readers.strict_jsonl(spark, str(tmp_path), SCHEMA).count() == 2
    else:
        with pytest.raises(ValueError):
            readers.strict_jsonl(spark, str(tmp_path), SCHEMA)
