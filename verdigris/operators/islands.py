"""Runs and gaps in ordered rows: gaps and islands, interval unions, fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import range_join


def consecutive_runs(df: DataFrame, by: Sequence[str], order: Sequence[str], member: Column, least: int) -> DataFrame:
    """by, start, length of each run of at least `least` consecutive member rows; start is the first order column's value."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.select(*by, *order, F.coalesce(member, F.lit(False)).alias("_m"))
    marked = marked.withColumn("_run", F.count_if(~F.col("_m")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.where("_m").groupBy(*by, "_run").agg(F.min(order[0]).alias("start"), F.count(F.lit(1)).alias("length"))
    return runs.where(F.col("length") >= least).drop("_run")


def gaps(df: DataFrame, by: Sequence[str], ts: str, longer: float) -> DataFrame:
    """by, gap_start, gap_end, gap: neighbouring rows further apart than `longer`."""
    w = Window.partitionBy(*by).orderBy(ts)
    rows = df.select(*by, F.lag(ts).over(w).alias("gap_start"), F.col(ts).alias("gap_end"))
    return rows.withColumn("gap", F.col("gap_end") - F.col("gap_start")).where(F.col("gap") > longer)


def excused_gaps(polls: DataFrame, requests: DataFrame, by: Sequence[str], ts: str, longer: float, at: str, ok: str) -> DataFrame:
    """gaps() of polls with requests_in_window and successes_in_window, of the
    requests that ended (at) inside it, and excused: some succeeded, so what was
    polled was up and the poller was not."""
    found = gaps(polls, by, ts, longer)
    met = range_join(requests.select(*by, at, ok), found, at, "gap_start", "gap_end", by, "left")
    n, good = F.count(at), F.count_if(F.coalesce(F.col(ok), F.lit(False)) & F.col(at).isNotNull())
    out = met.groupBy(*by, "gap_start", "gap_end", "gap").agg(n.alias("requests_in_window"), good.alias("successes_in_window"))
    return out.withColumn("excused", F.col("successes_in_window") > 0)


def covered(df: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """by, covered, span: length of the union of intervals, and from first start to last end.

    Each interval adds what lies past the furthest end before it.
    """
    w = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    furthest = F.max(end).over(w)
    added = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(furthest, F.col(start))))
    rows = df.select(*by, F.col(start), F.col(end), added.alias("_added"))
    return rows.groupBy(*by).agg(F.sum("_added").alias("covered"), (F.max(end) - F.min(start)).alias("span"))


def forward_fill(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def latest_values(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """For each key the last non-null value of every column, on its own."""
    rank = F.struct(*order)
    return df.groupBy(*by).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns])
