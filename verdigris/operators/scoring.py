"""Label scoring: matching predictions to ground truth, and counting per class.

Counts for all classes of a dimension are made in one aggregation over the
matched rows; no row is multiplied by the classes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import norm_reasons

KEYS = ("call_id", "phone", "product")


def last_of_each(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The row of greatest position for each key, null being a key like any other."""
    w = Window.partitionBy(*keys).orderBy(F.desc(position))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def label_join(gt: DataFrame, pred: DataFrame, keys: Sequence[str] = KEYS, position: str | None = "pos") -> DataFrame:
    """Full outer join on keys where null matches null: the keys once, then
    structs `gt` and `pred`, null where a side has no row.

    With a position column the last row of each key counts on either side;
    without one, duplicates fan out.
    """
    if position:
        gt, pred = last_of_each(gt, keys, position), last_of_each(pred, keys, position)
    g = gt.select(*[F.col(k).alias(f"g_{k}") for k in keys], F.struct(*gt.columns).alias("gt"))
    p = pred.select(*[F.col(k).alias(f"p_{k}") for k in keys], F.struct(*pred.columns).alias("pred"))
    on = [F.col(f"g_{k}").eqNullSafe(F.col(f"p_{k}")) for k in keys]
    joined = g.join(p, on, "full")
    key = [F.when(F.col("gt").isNotNull(), F.col(f"g_{k}")).otherwise(F.col(f"p_{k}")).alias(k) for k in keys]
    return joined.select(*key, "gt", "pred")


def confusion(df: DataFrame, labels: Sequence[str], in_gt: Callable[[str], Column], in_pred: Callable[[str], Column], by: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest counts: label, tp, fp, fn, tn (and the columns of `by`), in one aggregation."""
    counts = []
    for i, label in enumerate(labels):
        g, p = F.coalesce(in_gt(label), F.lit(False)), F.coalesce(in_pred(label), F.lit(False))
        for name, cond in (("tp", g & p), ("fp", ~g & p), ("fn", g & ~p), ("tn", ~g & ~p)):
            counts.append(F.count_if(cond).alias(f"{name}_{i}"))
    rows = [F.struct(F.lit(label).alias("label"), *[F.col(f"{k}_{i}").alias(k) for k in ("tp", "fp", "fn", "tn")]) for i, label in enumerate(labels)]
    return df.groupBy(*by).agg(*counts).select(*by, F.inline(F.array(*rows)))


def rates(df: DataFrame, digits: int = 6) -> DataFrame:
    """weight, accuracy, precision, recall, f1 beside tp, fp, fn, tn; a rate without denominator is 0."""

    def share(a: Column, b: Column) -> Column:
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    return df.withColumns(
        {
            "weight": tp + fn,
            "accuracy": F.round(share(tp + tn, tp + fp + fn + tn), digits),
            "precision": F.round(precision, digits),
            "recall": F.round(recall, digits),
            "f1": F.round(share(2 * precision * recall, precision + recall), digits),
        }
    )


def weighted_average(df: DataFrame, by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Rates of rates(), averaged with the classes' weights; 0 without weight."""
    total = F.sum("weight")
    means = [F.round(F.when(total == 0, F.lit(0.0)).otherwise(F.sum(F.col(c) * F.col("weight")) / total), digits).alias(c) for c in ("accuracy", "precision", "recall", "f1")]
    return df.groupBy(*by).agg(total.alias("weight"), *means)


def score_call_result(joined: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows with a labelled ground truth; a missing or unparsed prediction has no label."""
    truth, said = F.col("gt.call_result"), F.when(F.col("pred.parse_ok"), F.col("pred.call_result"))
    return confusion(joined.where(truth.isNotNull()), labels, lambda x: truth == x, lambda x: said == x)


def score_reason(joined: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Every matched row; each side's reasons are a set."""
    truth = norm_reasons(F.col("gt.main"), F.col("gt.secondary"), F.col("gt.third"))
    said = norm_reasons(F.col("pred.main"), F.col("pred.secondary"), F.col("pred.third"))
    sets = joined.select(truth.alias("g"), F.when(F.col("pred.parse_ok"), said).alias("p"))
    return confusion(sets, labels, lambda x: F.array_contains("g", x), lambda x: F.array_contains("p", x))


def product_sets(rows: DataFrame) -> DataFrame:
    """call_id, phone, products: a call's set of products; calls without a phone are left out."""
    return rows.where(F.col("phone").isNotNull()).groupBy("call_id", "phone").agg(F.array_sort(F.collect_set("product")).alias("products"))


def product_join(gt: DataFrame, pred: DataFrame) -> DataFrame:
    g = product_sets(gt)
    p = product_sets(pred).withColumnsRenamed({"call_id": "p_call", "phone": "p_phone", "products": "p_products"})
    joined = g.join(p, (F.col("call_id") == F.col("p_call")) & (F.col("phone") == F.col("p_phone")), "full")
    empty = F.array().cast("array<string>")
    return joined.select(F.coalesce("call_id", "p_call").alias("call_id"), F.coalesce("phone", "p_phone").alias("phone"), F.coalesce("products", empty).alias("g"), F.coalesce("p_products", empty).alias("p"))


def score_product(gt: DataFrame, pred: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Call grain: a call's products on either side."""
    return confusion(product_join(gt, pred), labels, lambda x: F.array_contains("g", x), lambda x: F.array_contains("p", x))


def coverage(joined: DataFrame) -> DataFrame:
    """requested, joined, parse_failures, scored."""
    g, p = F.col("gt").isNotNull(), F.col("pred").isNotNull()
    return joined.agg(
        F.count_if(g).alias("requested"),
        F.count_if(g & p).alias("joined"),
        F.count_if(p & ~F.col("pred.parse_ok")).alias("parse_failures"),
        F.count_if(F.col("gt.call_result").isNotNull()).alias("scored"),
    )


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Counts of rows x columns with a null column and row and `total` margins."""
    named = df.select(F.coalesce(rows, F.lit("nan")).alias("r"), F.coalesce(columns, F.lit("nan")).alias("c"))
    cells = [F.count_if(F.col("c") == v).alias(v.replace(" ", "_")) for v in (*values, "nan")]
    return named.rollup("r").agg(*cells, F.count(F.lit(1)).alias("total")).select(F.coalesce("r", F.lit("total")).alias("label"), *[c for c in (v.replace(" ", "_") for v in (*values, "nan"))], "total")


def exact_match(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """For each (truth, prediction) column pair: equal cells are tp, unequal ones fp."""
    cells = F.array(*[F.struct(F.lit(g).alias("dimension"), F.col(g).eqNullSafe(F.col(p)).alias("ok")) for g, p in pairs])
    return df.select(F.inline(cells)).groupBy("dimension").agg(F.count_if("ok").alias("tp"), F.count_if(~F.col("ok")).alias("fp"))
