"""Answers of a model to one item, given several times: their rows, how they differ
between replicates, and how two arms differ by more than their own noise.

An answer is a JSON text {"product": {name: block}}, a block being
{"retention_outcome": label, slot: {"reason": labels, "keyword": quotes}}, and other members
that nothing scores. It is read once, in Arrow batches; all comparing is done by grouping.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import norm_reasons, norm_text

#: The slots of a block, the members no score reads (keyword lies in the slots), and the cell of a path an answer lacks.
SLOTS = ("main", "secondary", "third")
UNSCORED = ("recommendation", "call_event_detection", "keyword")
MALFORMED = '"MALFORMED"'

_TEXT = T.StringType()
_BLOCK = T.StructType([T.StructField(c, _TEXT) for c in ("product", "call_result", *SLOTS)])
_READ = T.StructType([T.StructField("blocks", T.ArrayType(_BLOCK)), T.StructField("unscored", T.ArrayType(_TEXT)), T.StructField("cells", T.MapType(_TEXT, _TEXT))])


def _write(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def _slot(block: object, slot: str, part: str) -> object:
    cell = block.get(slot) if isinstance(block, dict) else None
    return cell.get(part) if isinstance(cell, dict) else None


def _reason(block: object, slot: str) -> str:
    reason = _slot(block, slot, "reason")
    return reason if isinstance(reason, str) else ""


def _read_one(text: str | None) -> tuple:
    try:
        answer = json.loads(text or "null")
    except (ValueError, RecursionError):
        answer = None
    answer = answer if isinstance(answer, dict) else {}
    products = answer.get("product") if isinstance(answer.get("product"), dict) else {}
    blocks, cells = [], {"products": _write(sorted(products))}
    for name, block in products.items():
        outcome = block.get("retention_outcome") if isinstance(block, dict) else None
        reasons = [_reason(block, s) for s in SLOTS]
        if block is not None:
            blocks.append((name, outcome if outcome is None or isinstance(outcome, str) else _write(outcome), *reasons))
        if isinstance(block, dict):
            cells[f"{name}.outcome"] = _write(block.get("retention_outcome", ""))
            cells[f"{name}.reasons"] = _write(sorted({r.strip() for r in reasons} - {""}))
        else:
            cells[f"{name}.outcome"] = MALFORMED
    quoted = [[n, [str(_slot(b, s, "keyword") or "") for s in SLOTS]] for n, b in sorted(products.items()) if isinstance(b, dict)]
    return blocks, [_write(answer.get(UNSCORED[0])), _write(answer.get(UNSCORED[1])), _write(quoted)], cells


@F.pandas_udf(_READ)
def read_answer(payload: pd.Series) -> pd.DataFrame:
    """blocks (null ones left out), the unscored members as JSON in UNSCORED's order,
    and cells, path -> JSON. What is no JSON object has no blocks."""
    return pd.DataFrame([_read_one(t) for t in payload], columns=["blocks", "unscored", "cells"])


def _rows_of(answers: DataFrame, truths: DataFrame) -> DataFrame:
    """answers with the columns of truths (one row an item: item_id, call_id, phone,
    products), read, and rows: one for each product the answer names; where it is not to
    be read or names none, one without labels for each product of the truth, at least one.
    """
    asked = truths.select("item_id", "call_id", "phone", "products")
    known = F.assert_true(F.col("call_id").isNotNull(), "an answer's item is not in the test set")
    read = answers.join(asked, "item_id", "left").where(known.isNull()).withColumn("_a", read_answer("payload"))
    said = F.when(F.coalesce("parse_ok", F.lit(False)) & (F.size("_a.blocks") > 0), F.col("_a.blocks"))
    wanted = F.when(F.size("products") > 0, F.col("products")).otherwise(F.array(F.lit(None).cast("string")))
    none = F.lit(None).cast("string")
    skeleton = F.transform(wanted, lambda p: F.struct(p.alias("product"), none.alias("call_result"), none.alias("main"), none.alias("secondary"), none.alias("third")))
    return read.withColumn("named", said.isNotNull()).withColumn("rows", F.coalesce(said, skeleton))


def flatten(answers: DataFrame, truths: DataFrame) -> DataFrame:
    """answers (item_id, payload, parse_ok, others kept) -> their columns but the payload,
    call_id, phone, product, call_result, main, secondary, third as the answer has them, and
    named_no_product: it was read and named none. Keys come from the test set, never from
    the answer. No answer is without rows; a null parse_ok counts as false. An item
    that the test set lacks is an error.
    """
    rows = _rows_of(answers, truths)
    kept = [c for c in answers.columns if c != "payload"]
    nothing = F.coalesce("parse_ok", F.lit(False)) & ~F.col("named") & F.col("payload").isNotNull()
    return rows.select(*kept, "call_id", "phone", nothing.alias("named_no_product"), F.inline("rows"))


def classify(answers: DataFrame, truths: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """answers (by, item_id, raw, payload, parse_ok), a row a replicate -> by, item_id,
    replicates, observable, raw_unstable, scored_unstable, cosmetic_only and changed, the
    members of UNSCORED that differ. One replicate shows nothing: such an item is not observable.

    What is scored is the set of rows (product, outcome, reasons as a set, whether it was
    read), in any order. Equal raw texts with different rows are an error.
    """
    rows = _rows_of(answers, truths)
    scored = F.transform("rows", lambda r: F.struct(F.coalesce(norm_text(r["product"]), F.lit("")).alias("p"), F.coalesce(norm_text(r["call_result"]), F.lit("")).alias("c"), norm_reasons(*[r[s] for s in SLOTS]).alias("r")))
    seen = rows.select(
        *by,
        "item_id",
        F.sha2(F.coalesce("raw", F.lit("")), 256).alias("raw"),
        F.sha2(F.to_json(F.struct(F.array_sort(scored), F.coalesce("parse_ok", F.lit(False)))), 256).alias("scored"),
        *[F.sha2(F.when(F.col("payload").isNotNull(), F.col("_a.unscored")[i]).otherwise("[]" if u == "keyword" else "null"), 256).alias(u) for i, u in enumerate(UNSCORED)],
    )
    moved = lambda c: F.min(c) != F.max(c)
    items = seen.groupBy(*by, "item_id").agg(F.count(F.lit(1)).alias("replicates"), moved("raw").alias("raw_unstable"), moved("scored").alias("scored_unstable"), *[moved(u).alias(u) for u in UNSCORED])
    sound = F.assert_true(F.col("raw_unstable") | ~F.col("scored_unstable"), "equal texts of an item gave different rows")
    changed = F.array_compact(F.array(*[F.when(F.col(u), F.lit(u)) for u in UNSCORED]))
    cosmetic = F.col("raw_unstable") & ~F.col("scored_unstable")
    return items.where(sound.isNull()).select(*by, "item_id", "replicates", (F.col("replicates") > 1).alias("observable"), "raw_unstable", "scored_unstable", cosmetic.alias("cosmetic_only"), changed.alias("changed"))


def decompose(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """classify()'s items -> their counts, rates over the observable ones (0 where there
    are none), the cosmetic share of raw instability, and for each unscored member how many
    cosmetic items it differs in (cosmetic_<member>)."""
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    flags = ("observable", "raw_unstable", "scored_unstable", "cosmetic_only")
    counts = [F.count(F.lit(1)).alias("items"), *[F.count_if(f).alias(f) for f in flags]]
    moved = [F.count_if(F.col("cosmetic_only") & F.array_contains("changed", u)).alias(f"cosmetic_{u}") for u in UNSCORED]
    sums = items.groupBy(*by).agg(*counts, *moved).withColumn("not_observable", F.col("items") - F.col("observable"))
    rates = {f"{f}_rate": share(f, F.col("observable")) for f in flags[1:]}
    return sums.withColumns(rates | {"cosmetic_share_of_instability": share("cosmetic_only", F.col("raw_unstable"))})


def flips(rows: DataFrame, replicates: int, by: Sequence[str] = ()) -> DataFrame:
    """rows (by, replicate, call_id, phone, product, call_result, main, secondary, third) of
    a run of so many replicates -> by, dimension, cells, flips: cells that did not have the
    same content in every replicate. Outcome and reasons are cells of a product in a call, with
    all rows of the key as a multiset; the products are one cell of the call, as a set.
    A cell that a replicate lacks differs; with one replicate nothing does.

    Nothing is collected: multisets are equal if each value is there equally often in all replicates.
    """
    no = F.lit(None).cast("string")
    row = lambda d, product, value, once: F.struct(F.lit(d).alias("dimension"), product.alias("product"), value.alias("value"), F.lit(once).alias("once"))
    product = norm_text(F.col("product"))
    facts = [
        row("call_result", product, F.coalesce(norm_text(F.col("call_result")), F.lit("")), False),
        row("reason", product, F.array_join(norm_reasons(*[F.col(s) for s in SLOTS]), ","), False),
        row("product", no, product, True),
        row("product", no, no, True),  # the call was there, with products or without
    ]
    # A call's rows are brought together once, before they become cells: all groupings below lie inside a call.
    called = rows.withColumn("call_id", norm_text(F.col("call_id"))).select(*by, "replicate", "call_id", "phone", "product", "call_result", *SLOTS).repartition("call_id", "phone")
    cells = called.select(*by, "replicate", "call_id", "phone", F.inline(F.array(*facts)))
    cell = [*by, "dimension", "call_id", "phone", "product"]
    times = cells.groupBy(*cell, "value", "once", "replicate").agg(F.count(F.lit(1)).alias("n"))
    values = times.groupBy(*cell, "value", "once").agg(F.count(F.lit(1)).alias("seen"), F.min("n").alias("least"), F.max("n").alias("most"))
    same = (F.col("seen") == replicates) & (F.col("once") | (F.col("least") == F.col("most")))
    moved = values.groupBy(*cell).agg(F.bool_or(~same).alias("moved"))
    return moved.groupBy(*by, "dimension").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("moved") & F.lit(replicates > 1)).alias("flips"))


def field_verdicts(answers: DataFrame, arms: tuple[str, str], replicates: int | None = None) -> DataFrame:
    """answers (item_id, arm, payload, parse_ok), a row a replicate -> item_id, path, verdict.

    Paths are products, <product>.outcome and <product>.reasons. A path is NOISE if
    an arm's replicates do not all agree on it (having none is an answer too), else SAME
    or CHANGED. An item with an unread answer, or none, in either arm has one row: no path, PARSE_FAILED.
    With replicates, an item that has another number in an arm is an error.
    """
    read = answers.where(F.col("arm").isin(*arms)).withColumn("_a", read_answer("payload"))
    fine = F.coalesce("parse_ok", F.lit(False)) & F.col("payload").isNotNull()
    # the entry '' of every answer counts the item's replicates, and whether they were read
    entries = F.map_concat(F.create_map(F.lit(""), F.when(fine, "1").otherwise("0")), F.when(fine, F.col("_a.cells")).otherwise(F.create_map().cast("map<string,string>")))
    cells = read.select("item_id", "arm", F.explode(entries).alias("path", "value"))
    of = lambda f, i: f(F.when(F.col("arm") == arms[i], F.col("value")))
    sums = cells.groupBy("item_id", "path").agg(*[of(f, i).alias(f"{n}{i}") for i in (0, 1) for n, f in (("n", F.count), ("low", F.min), ("high", F.max))])
    item = F.struct(*[F.max(F.when(F.col("path") == "", F.col(c))).over(Window.partitionBy("item_id")).alias(c) for c in ("n0", "n1", "low0", "low1")])
    rows = sums.withColumn("i", item)
    if replicates is not None:
        whole = F.assert_true((F.col("i.n0") == replicates) & (F.col("i.n1") == replicates), "an item has not all its replicates in an arm")
        rows = rows.where(whole.isNull())
    failed = ~F.coalesce((F.col("i.low0") == "1") & (F.col("i.low1") == "1"), F.lit(False))
    agreed = lambda i: (F.col(f"n{i}") == 0) | ((F.col(f"n{i}") == F.col(f"i.n{i}")) & (F.col(f"low{i}") == F.col(f"high{i}")))
    verdict = F.when(failed, "PARSE_FAILED").when(~(agreed(0) & agreed(1)), "NOISE").when(F.col("low0").eqNullSafe(F.col("low1")), "SAME").otherwise("CHANGED")
    return rows.where((F.col("path") == "") == failed).select("item_id", F.nullif("path", F.lit("")).alias("path"), verdict.alias("verdict"))


def item_verdicts(fields: DataFrame) -> DataFrame:
    """field_verdicts() -> item_id, verdict (PARSE_FAILED, CHANGED, NOISE or SAME, the first
    that any of its paths has), changed, noise, paths: how many."""
    has = lambda v: F.count_if(F.col("verdict") == v)
    sums = fields.groupBy("item_id").agg(has("PARSE_FAILED").alias("_f"), has("CHANGED").alias("changed"), has("NOISE").alias("noise"), F.count("path").alias("paths"))
    verdict = F.when(F.col("_f") > 0, "PARSE_FAILED").when(F.col("changed") > 0, "CHANGED").when(F.col("noise") > 0, "NOISE").otherwise("SAME")
    return sums.select("item_id", verdict.alias("verdict"), "changed", "noise", "paths")
