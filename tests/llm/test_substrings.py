"""Repeated strings inside and between documents, in chunks of every size."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_pairs import brute_removal

from verdigris.llm import substrings


def removed(docs):
    return sorted(map(tuple, substrings.remove_repeats(docs).drop("kept").collect()))


@pytest.fixture(scope="module")
def repetitive():
    rng = random.Random(8)
    line = "the same line of more than fifty bytes stands here again and again; "
    passage = " ".join(f"p{rng.randrange(99)}" for _ in range(80))
    word = lambda: f"w{rng.randrange(500)}"
    rows = [(i, " ".join(word() for _ in range(30)) + line * (i % 5) + " ".join(word() for _ in range(9)) + (passage if i % 3 else passage[40:]), "s") for i in range(40)]
    rows += [(100, line * 60, "s"), (101, line * 60, "s"), (7, line * 3, "s"), (7, line * 3 + "x", "s"), (50, "a" * 700, "s"), (51, "a" * 49, "s"), (52, "b" + "a" * 60, "s")]
    rows += [(60, "ab" * 200, "s"), (61, "ba" * 200, "s"), (62, None, "s"), (63, "", "s"), (64, passage, "s"), (64, passage, "s"), (-5, passage[10:90], "s")]
    return rows


@pytest.mark.parametrize("chunk, batch", [(1 << 20, 10_000), (50, 7), (1, 1)])
def test_against_brute_force(spark, repetitive, monkeypatch, chunk, batch):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    known = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        docs = spark.createDataFrame([(i, t) for i, t, _ in repetitive], "doc_id long, text string").repartition(3)
        assert removed(docs) == brute_removal(repetitive)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", known)


def test_a_task_sends_one_row_of_a_string_and_spreads_the_rest():
    n = 1000
    key, mark = np.full(n, 1 << 40, np.uint64), np.full(n, 5 << 32, np.int64)
    out = substrings.settle(key, mark, pa.array(np.arange(n) // 2), np.arange(n) * substrings._AT + 3)
    at = out.column(3).to_numpy()
    settled = (at & substrings._SETTLED) != 0
    assert settled.sum() == n - 2 and (~settled).sum() == 1 and (at[~settled] & substrings._MORE).all()
    assert len(np.unique(out.column(0).to_numpy()[settled])) == n - 2
