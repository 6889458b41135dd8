"""Quantiles under named conventions: which element of the sorted values is taken.

Values are counted by STEPS steps between a group's least and greatest; running
sums over these few counts tell in which step a wanted place lies, and only the
distinct values of that step are ordered. No group is sorted as a whole. Steps are
equal on a logarithmic scale, so a far outlier leaves the others in many steps.
Approximate percentiles follow none of these rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _at(rule: str, q: float, n: Column) -> Column:
    """The element's place from 1 on."""
    if rule == "ceil":  # nearest rank, upwards
        place = F.ceil(F.lit(q) * n)
    elif rule == "rounded":  # half to even of q * n + 0.5
        place = F.bround(F.lit(q) * n + 0.5, 0)
    elif rule == "trunc":  # int(q * n) - 1 from 0; -1 is the last
        place = F.floor(F.lit(q) * n)
        return F.when(place < 1, n).otherwise(place).cast("long")
    elif rule == "floor":  # int(q * n) from 0
        place = F.floor(F.lit(q) * n) + 1
    else:
        raise ValueError(rule)
    return F.greatest(F.lit(1), F.least(n, place)).cast("long")


STEPS = 4096


def _step(value: Column, low: Column, high: Column) -> Column:
    """The step of a value, from 0 to STEPS - 1; never less for a greater value."""
    log = lambda x: F.signum(x.cast("double")) * F.log1p(F.abs(x.cast("double")))
    width = log(high) - log(low)
    return F.when(width > 0, F.least(F.floor((log(value) - log(low)) / width * STEPS), F.lit(STEPS - 1))).otherwise(F.lit(0)).cast("int")


def quantiles(df: DataFrame, value: str, picks: dict[str, tuple[str, float]], by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """by, n, and for each name the element that (rule, q) picks; nulls are left out."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    ends = rows.groupBy(*by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_n"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by] or [F.lit(True)]
    # one row a value, with its step
    values = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_times"))
    step = _step(F.col("_v"), F.col("_low"), F.col("_high"))
    values = values.alias("v").join(ends.alias("e"), same("v", "e")).select("v.*", "_n", step.alias("_step"))
    steps = values.groupBy(*by, "_step").agg(F.sum("_times").alias("_in"), F.max("_n").alias("_n"))
    upto = F.sum("_in").over(Window.partitionBy(*by).orderBy("_step"))
    wanted = F.array(*[_at(rule, q, F.col("_n")) for rule, q in picks.values()])
    steps = steps.withColumn("_before", upto - F.col("_in"))
    steps = steps.where(F.exists(wanted, lambda p: (p > F.col("_before")) & (p <= F.col("_before") + F.col("_in")))).select(*by, "_step", "_before")
    near = values.alias("v").join(steps.alias("s"), [*same("v", "s"), F.col("v._step") == F.col("s._step")]).select("v.*", "_before")
    near = near.withColumn("_upto", F.col("_before") + F.sum("_times").over(Window.partitionBy(*by, "_step").orderBy("_v")))
    here = lambda rule, q: (_at(rule, q, F.col("_n")) <= F.col("_upto")) & (_at(rule, q, F.col("_n")) > F.col("_upto") - F.col("_times"))
    chosen = [F.round(F.max(F.when(here(rule, q), F.col("_v"))), digits).alias(name) for name, (rule, q) in picks.items()]
    return near.groupBy(*by).agg(F.max("_n").alias("n"), *chosen)
