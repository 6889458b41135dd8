"""Validation of test sets: every problem of every item, as rows.

An item has ids, a transcript, label rows (`gt`, maps of text), the spans that
are its evidence and the citations that are its rules (maps of text by label).
All rules of an item are looked at in its own row; only repeated ids need a
shuffle. Nothing is refused here: the rows are the review.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import norm_text

#: The synthetic ranges of ids, the columns of a label row, and a citation's form.
CALL_ID = r"^5[0-9]{3}$"
PHONE = r"^0810000[0-9]{3}$"
GT_COLUMNS = ("product", "call_result", "main", "secondary", "third")
CITATION = r"^[A-Za-z0-9_][A-Za-z0-9_./-]*\.(?:py|txt|ya?ml|md):\d+(?:-\d+)?$"
#: The dimension of each label column.
DIMENSIONS = {"product": "product", "call_result": "call_result", "main": "reason", "secondary": "reason", "third": "reason"}

RULES = (
    "duplicate_item_id", "missing_item_id", "call_id", "phone_number", "empty_transcript", "empty_evidence", "evidence_not_verbatim", "no_labels",
    "label_columns", "repeated_product", "label_without_rule", "label_without_evidence", "label_unknown", "empty_rule", "citation",
)


def _blank(x: Column) -> Column:
    return F.coalesce(F.regexp_replace(x, r"(?U)\s+", "") == "", F.lit(True))


def _whole(x: Column, pattern: str) -> Column:
    """Whether all of x is of the pattern; a line end behind it is not."""
    return F.coalesce(x.rlike(pattern.replace("$", r"\z")), F.lit(False))


def _problem(rule: str, detail: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def _each(array: Column, make) -> Column:
    """Problems of an array's elements; make gives null where there is none."""
    return F.filter(F.transform(array, make), lambda p: p.isNotNull())


def _keys(x: Column) -> Column:
    return F.coalesce(F.map_keys(x), F.array().cast("array<string>"))


def _labels(row: Column) -> Column:
    """dimension:label of every label of a row, normalised, without blanks."""
    cells = [F.struct(F.lit(d).alias("dimension"), norm_text(F.element_at(row, c)).alias("label")) for c, d in DIMENSIONS.items()]
    return F.filter(F.array(*cells), lambda c: c["label"].isNotNull())


def violations(items: DataFrame, spaces: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """item_id, rule, detail: a row for each problem.

    items: item_id, app, call_id, phone_number, transcript, gt (array of maps),
    evidence and rules (maps). spaces: for each app the closed vocabulary of each
    dimension; an item of another app has its labels' membership reported as unknown.
    """
    gt = F.coalesce(F.col("gt"), F.array().cast("array<map<string,string>>"))
    span = lambda k: F.element_at("evidence", k)
    held = lambda column: F.transform(_keys(F.col(column)), F.lower)
    known = F.array(*[F.lit(f"{app}/{d}:{v.lower()}") for app, space in spaces.items() for d, values in space.items() for v in values])
    token = lambda c: F.concat(c["dimension"], F.lit(":"), c["label"])
    labels = F.flatten(F.transform(gt, _labels))
    wanted = F.array_sort(F.array(*[F.lit(c) for c in GT_COLUMNS]))
    products = F.filter(F.transform(gt, lambda r: norm_text(F.element_at(r, "product"))), lambda p: p.isNotNull())
    cited = lambda k: F.filter(F.transform(F.split(F.element_at("rules", k), "[;,]", -1), lambda c: F.trim(c)), lambda c: c != "")

    one = F.filter(
        F.array(
            F.when(_blank(F.col("item_id")), _problem("missing_item_id", F.col("item_id"))),
            F.when(~_whole(F.col("call_id"), CALL_ID), _problem("call_id", F.col("call_id"))),
            F.when(F.col("phone_number").isNotNull() & ~_whole(F.col("phone_number"), PHONE), _problem("phone_number", F.col("phone_number"))),
            F.when(_blank(F.col("transcript")), _problem("empty_transcript", F.lit(None))),
            F.when(F.size(gt) == 0, _problem("no_labels", F.lit(None))),
        ),
        lambda p: p.isNotNull(),
    )
    spans = _each(
        F.array_sort(_keys(F.col("evidence"))),
        lambda k: F.when(_blank(span(k)), _problem("empty_evidence", k)).when(~F.coalesce(F.col("transcript").contains(span(k)), F.lit(False)), _problem("evidence_not_verbatim", k)),
    )
    columns = _each(gt, lambda r: F.when(F.array_sort(F.map_keys(r)) != wanted, _problem("label_columns", F.array_join(F.array_sort(F.map_keys(r)), ","))))
    again = _each(F.array_distinct(products), lambda p: F.when(F.size(F.filter(products, lambda q: q == p)) > 1, _problem("repeated_product", p)))
    ruled = _each(labels, lambda c: F.when(~F.array_contains(held("rules"), F.concat(F.lit("rule_"), token(c))), _problem("label_without_rule", token(c))))
    shown = _each(labels, lambda c: F.when(~F.array_contains(held("evidence"), F.concat(F.lit("ev_"), token(c))), _problem("label_without_evidence", token(c))))
    member = lambda c: F.array_contains(known, F.concat(F.lower(F.trim("app")), F.lit("/"), token(c)))
    odd = _each(labels, lambda c: F.when(~F.coalesce(member(c), F.lit(False)), _problem("label_unknown", token(c))))
    rules = F.array_sort(_keys(F.col("rules")))
    cites = F.flatten(
        F.transform(
            rules,
            lambda k: F.when(F.size(F.coalesce(cited(k), F.array().cast("array<string>"))) == 0, F.array(_problem("empty_rule", k))).otherwise(_each(cited(k), lambda c: F.when(~_whole(c, CITATION), _problem("citation", c)))),
        )
    )
    within = items.select("item_id", F.inline(F.concat(one, spans, columns, again, ruled, shown, odd, cites)))
    twice = items.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1")
    return within.unionByName(twice.select("item_id", F.lit("duplicate_item_id").alias("rule"), F.col("n").cast("string").alias("detail")))
