import json

import pytest

from verdigris.streaming import pairing

CONTRACT = {"model": "m", "prompt": {"id": "p", "t": 0.0}}


def header(contract=CONTRACT):
    return {"type": "run_journal", "schema_version": 2, "contract": contract, "contract_sha": pairing.canonical_sha(contract)}


def started(item, replicate=1):
    event = {"event": "started", "item_id": item, "replicate": replicate}
    return event | {"event_sha": pairing.canonical_sha(event)}


def result(item, replicate=1, **more):
    row = {"item_id": item, "replicate": replicate, **more}
    return {"event": "result", "row": row, "row_sha": pairing.canonical_sha(row)}


class Stream:
    def __init__(self, spark, folder, strict=False):
        self.spark, self.folder, self.strict, self.n = spark, folder, strict, 0
        (folder / "in").mkdir()

    def arrives(self, *lines, torn=""):
        self.n += 1
        text = "".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines) + torn
        (self.folder / "in" / f"{self.n}.jsonl").write_text(text)
        return self.runs()

    def runs(self):
        """One run of the query, from its checkpoint to what is there now."""

        def write(batch, number):
            (pairing.refuse(batch) if self.strict else batch).write.mode("overwrite").parquet(str(self.folder / "out" / f"n={number}"))

        stream = pairing.outcomes(pairing.journal_lines(self.spark, str(self.folder / "in")), CONTRACT).writeStream.foreachBatch(write)
        query = stream.option("checkpointLocation", str(self.folder / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        rows = self.spark.read.parquet(str(self.folder / "out"))
        return sorted((r["item_id"] or "", r["replicate"] or 0, r["outcome"]) for r in rows.collect()), rows


def test_pairs_over_restarts(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    got, rows = stream.arrives(header(), started("a"), result("a", x=1.0), started("b"), torn='{"event": "result", "row": {"item')
    assert got == [("", 0, "header"), ("", 0, "torn"), ("a", 1, "result"), ("a", 1, "started"), ("b", 1, "started")]
    assert [tuple(r) for r in pairing.unresolved(rows).collect()] == [("b", 1)]
    # another process goes on from the checkpoint: what it knows of a and b is still there
    got, rows = stream.arrives(result("b"), result("a", x=2), started("b"), result("c"), started("a", 2))
    assert [g for g in got if g not in (("", 0, "header"), ("", 0, "torn"))] == [
        ("a", 1, "repeated_result"), ("a", 1, "result"), ("a", 1, "started"), ("a", 2, "started"), ("b", 1, "repeated_start"), ("b", 1, "result"), ("b", 1, "started"), ("c", 1, "result_before_start"),
    ]
    kept = {(r["item_id"], r["outcome"]): r["row"] for r in rows.collect()}
    assert json.loads(kept["a", "result"]) == {"item_id": "a", "replicate": 1, "x": 1.0}
    assert stream.runs()[0] == got  # nothing new, nothing twice


def test_refused(spark, tmp_path):
    stream = Stream(spark, tmp_path, strict=True)
    stream.arrives(header(), started("a"), result("a"))
    with pytest.raises(Exception, match="1 x repeated_result"):
        stream.arrives(result("a"))


@pytest.mark.parametrize(
    ("line", "want"),
    [
        (header(), ("header", None)),
        (header({"model": "other"}), ("header", "other_contract")),
        (header() | {"contract": {"model": "forged"}}, ("header", "other_contract")),
        (header() | {"schema_version": 9}, ("header", "other_contract")),
        (started("a"), ("started", None)),
        (started("a") | {"replicate": 2}, ("bad", "hash")),
        (result("a") | {"row": {"item_id": "a", "replicate": 1, "y": 1}}, ("bad", "hash")),
        (started("a", 0), ("bad", "no_identity")),
        (started("a", True), ("bad", "no_identity")),
        (result(""), ("bad", "no_identity")),
        ({"event": "finished"}, ("bad", "not_an_event")),
        ([1], ("bad", "not_an_event")),
    ],
)
def test_lines(line, want):
    got = pairing.read_line(json.dumps(line), pairing.canonical_sha(CONTRACT))
    assert (got[0], got[5]) == want
