"""Joins with conditions that are not one equality: either-of keys, similar
names, time ranges, positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import jaro_winkler

#: A side is broadcast up to this many rows, counted first.
MAX_BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if a count shows it is small enough."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def either_key_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) pairs that agree on any of the key pairs, once each, of
    rows that these ids identify.

    A condition with OR would be a nested loop; this is one equality join a key
    pair, unioned. A later join leaves out what an earlier one has found, so the
    pairs need no distinct. Null and blank keys match nothing.
    """
    out = None
    a = left.select(F.col(left_id), *[F.col(x).alias(f"_a{k}") for k, (x, _) in enumerate(pairs)])
    b = right.select(F.col(right_id), *[F.col(y).alias(f"_b{k}") for k, (_, y) in enumerate(pairs)])
    for k in range(len(pairs)):
        one = a.where(F.trim(f"_a{k}") != "").join(b, F.col(f"_a{k}") == F.col(f"_b{k}"))
        for j in range(k):
            one = one.where(~F.coalesce((F.col(f"_a{j}") == F.col(f"_b{j}")) & (F.trim(f"_a{j}") != ""), F.lit(False)))
        one = one.select(left_id, right_id)
        out = one if out is None else out.unionByName(one)
    return out


def left_with_either(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """All of left, with the ids of right it matches by any key pair, null where none."""
    found = either_key_join(left, right, pairs, left_id, right_id).withColumnRenamed(left_id, "_l")
    return left.join(found, F.col(left_id) == F.col("_l"), "left").drop("_l")


def similar_names(names: DataFrame, master: DataFrame, name: str, key: str, least: float) -> DataFrame:
    """Distinct (name, key) pairs whose texts have Jaro-Winkler `least` or more.

    Similarity is computed once for each pair of distinct texts that can reach
    the threshold: with m common bytes at most min(len), Jaro is at most
    (2 + short / long) / 3 and Winkler adds 0.4 of the rest, so pairs of very
    different lengths are not compared.
    The distinct texts of the smaller side are broadcast after a count.
    """
    a = names.select(F.col(name).alias("a")).where("a is not null and a <> ''").distinct().withColumn("la", F.octet_length("a"))
    b = master.select(F.col(key).alias("b")).where("b is not null and b <> ''").distinct().withColumn("lb", F.octet_length("b"))
    bound = (2 + F.least("la", "lb") / F.greatest("la", "lb")) / 3
    reach = bound + 0.4 * (1 - bound) >= least
    return a.join(bounded(b), reach).where(jaro_winkler("a", "b") >= least).select(F.col("a").alias(name), F.col("b").alias(key))


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, by: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Points inside ranges (ends included) of whole numbers, with equal `by`;
    how="left" keeps ranges without points too.

    A range goes to bins as wide as the next power of two above its length, so
    it lies in two of them at most, and a point to one bin of each width that
    occurs, 64 at most and few as a rule: an equality join, whatever the ranges
    are. Null ends and null points are in no bin.
    """
    width = F.length(F.bin(F.col(high).cast("long") - F.col(low).cast("long")))
    held = ranges.withColumn("_bits", F.when(F.col(high) >= F.col(low), width))
    bits = sorted(r["_bits"] for r in held.where("_bits is not null").select("_bits").distinct().collect())  # a row a width
    ends = F.array_distinct(F.array(F.call_function("shiftright", F.col(low).cast("long"), F.col("_bits")), F.call_function("shiftright", F.col(high).cast("long"), F.col("_bits"))))
    binned = held.withColumn("_bin", F.explode_outer(F.when(F.col("_bits").isNotNull(), ends)))
    each = F.array(*[F.struct(F.lit(b).alias("_b"), F.shiftright(F.col(at).cast("long"), b).alias("_p")) for b in bits]) if bits else F.array().cast("array<struct<_b:int,_p:bigint>>")
    renamed = points.withColumnsRenamed({c: f"_at_{c}" for c in by})
    spread = renamed.where(F.col(at).isNotNull()).select("*", F.inline(each))
    keys = (F.col("_bits") == F.col("_b")) & (F.col("_bin") == F.col("_p")) & (F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))
    for c in by:
        keys &= F.col(c) == F.col(f"_at_{c}")
    inner = spread.join(binned, keys).drop("_b", "_p", "_bits", "_bin", *[f"_at_{c}" for c in by])
    if how == "inner":
        return inner
    found = inner.select(*ranges.columns, *[c for c in points.columns if c not in by])
    alone = ranges.join(found.select(*[F.col(c).alias(f"_r_{c}") for c in ranges.columns]).distinct(), [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in ranges.columns], "left_anti")
    return found.unionByName(alone, allowMissingColumns=True)


def positional_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_order: Column, right_order: Column) -> DataFrame:
    """The n-th row of a group on the left with the n-th on the right, as long as both have one."""
    a = left.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(left_order)))
    b = right.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(right_order)))
    return a.join(b, [*by, "_n"]).drop("_n")
