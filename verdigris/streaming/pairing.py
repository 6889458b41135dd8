"""A run's journal as a stateful stream: starts and results are paired cell by cell.

A journal file has a header with the run's contract and its hash, then events,
each with its own hash. Every line is checked by itself in Arrow batches; a cell
(item, replicate) keeps in state whether it was started and its result's hash,
so a second result is found however many batches, or restarts, lie between. The
state is in the query's checkpoint: a restarted query goes on where it was.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The journal's name of itself, and the versions of its form. The first has no starts.
JOURNAL, VERSIONS = "run_journal", (1, 2)
_LINE = "kind string, item_id string, replicate long, row string, sha string, problem string"
OUTCOMES = "item_id string, replicate long, outcome string, row string"
#: Outcomes that a journal may have.
SOUND = ("started", "result", "header", "torn")


def canonical_sha(value: object) -> str:
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _cell(value: Mapping) -> tuple[str, int] | None:
    item, replicate = value.get("item_id"), value.get("replicate")
    good = isinstance(item, str) and item and isinstance(replicate, int) and not isinstance(replicate, bool) and replicate >= 1
    return (item, replicate) if good else None


def read_line(text: str, contract_sha: str) -> tuple:
    """kind, item_id, replicate, row, sha, problem of a journal's line."""
    try:
        line = json.loads(text)
    except ValueError:
        return ("torn", None, None, None, None, None)
    if not isinstance(line, dict):
        return ("bad", None, None, None, None, "not_an_event")
    if line.get("type") == JOURNAL:
        same = line.get("contract_sha") == contract_sha == canonical_sha(line.get("contract")) and line.get("schema_version") in VERSIONS
        return ("header", None, None, None, None, None if same else "other_contract")
    kind = line.get("event", "result")
    body = {k: line.get(k) for k in ("event", "item_id", "replicate")} if kind == "started" else line.get("row")
    if kind not in ("started", "result") or not isinstance(body, dict):
        return ("bad", None, None, None, None, "not_an_event")
    sha, cell = canonical_sha(body), _cell(body)
    if line.get("event_sha" if kind == "started" else "row_sha") != sha:
        return ("bad", *(cell or (None, None)), None, None, "hash")
    if cell is None:
        return ("bad", None, None, None, None, "no_identity")
    return (kind, *cell, json.dumps(body, ensure_ascii=False, sort_keys=True) if kind == "result" else None, sha, None)


def journal_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a folder's journal files as they arrive."""
    return spark.readStream.option("lineSep", "\n").text(path)


def outcomes(lines: DataFrame, contract: Mapping) -> DataFrame:
    """item_id, replicate, outcome, row of a stream of lines (value), each as it is
    settled: `started`, `result` with its row, `header`, `torn` (a line that is no JSON, as
    a lost writer leaves it), or what is wrong: `other_contract`, `not_an_event`,
    `hash`, `no_identity`, `repeated_start`, `repeated_result`, `result_before_start`."""
    sha = canonical_sha(dict(contract))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read_line(v, sha) for v in batch["value"] if v.strip()]
            yield pd.DataFrame(found, columns=["kind", "item_id", "replicate", "row", "sha", "problem"]).astype({"replicate": "Int64"})

    def pair(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, done = state.get if state.exists else (False, None)
        events = pd.concat(list(frames), ignore_index=True)
        out = []
        for kind in ("header", "torn", "bad", "started", "result"):  # a cell's start and result may come in one batch
            for row, own, problem in events[events["kind"] == kind][["row", "sha", "problem"]].itertuples(index=False):
                if kind in ("header", "torn", "bad"):
                    out.append((problem or kind, None))
                elif kind == "started":
                    out.append(("repeated_start" if started or done else "started", None))
                    started = True
                elif done is not None:
                    out.append(("repeated_result", None))
                elif not started:
                    out.append(("result_before_start", None))
                else:
                    done = own
                    out.append(("result", row))
        if key[0] is not None:
            state.update((started, done))
        yield pd.DataFrame({"item_id": [key[0]] * len(out), "replicate": pd.array([key[1]] * len(out), "Int64"), "outcome": [o for o, _ in out], "row": [r for _, r in out]})

    events = lines.mapInPandas(read, _LINE)
    keys = events.withColumn("spread", F.when(F.col("item_id").isNull(), F.pmod(F.xxhash64("kind", "problem"), F.lit(64))).otherwise(0))
    return keys.groupBy("item_id", "replicate", "spread").applyInPandasWithState(pair, OUTCOMES, "started boolean, done string", "append", GroupStateTimeout.NoTimeout)


def refuse(batch: DataFrame) -> DataFrame:
    """batch, unless an outcome is none that a journal may have."""
    bad = batch.where(~F.col("outcome").isin(*SOUND)).groupBy("outcome").count().collect()  # a row a kind
    if bad:
        raise ValueError("the journal has " + ", ".join(sorted(f"{r['count']} x {r['outcome']}" for r in bad)))
    return batch


def unresolved(settled: DataFrame) -> DataFrame:
    """Cells that were started and have no result, of all outcomes so far; they are not to be run again by themselves."""
    cells = settled.where("item_id is not null").groupBy("item_id", "replicate").agg(F.max(F.col("outcome") == "result").alias("done"))
    return cells.where("not done").select("item_id", "replicate")
