"""Operational summaries of calls: reliability, latency, tokens and cost, each quantile by its own report's rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles

#: Share of parsed answers from which an arm is reliable.
RELIABLE = 0.99


def with_quantiles(summary: DataFrame, rows: DataFrame, value: str, picks: dict[str, tuple[str, float]], by: Sequence[str], digits: int = 6) -> DataFrame:
    """summary (a row for each `by`) with quantiles of rows' values; null where a group has none."""
    found = quantiles(rows, value, picks, by, digits).drop("n").withColumnsRenamed({c: f"_q_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in by] or [F.lit(True)]
    return summary.join(found, on, "left").drop(*[f"_q_{c}" for c in by])


def operational_summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """calls, parsed, rate and gate; latency p50, p95, p99 (nearest rank upwards)
    and top; tokens known and calls without them; cost known, a lower bound, and
    calls without it. rows: outcome, latency_s, prompt_tokens, completion_tokens, cost."""
    ok, n = F.count_if(F.col("outcome") == "ok"), F.count(F.lit(1))
    sums = rows.groupBy(*by).agg(
        n.alias("calls"),
        ok.alias("parse_ok"),
        F.round(ok / n, 6).alias("parse_valid_rate"),
        (ok >= RELIABLE * n).alias("reliable"),
        F.round(F.max("latency_s"), 6).alias("top"),
        F.sum("prompt_tokens").cast("long").alias("prompt_tokens"),
        F.sum("completion_tokens").cast("long").alias("completion_tokens"),
        F.count_if(F.col("completion_tokens").isNull()).alias("missing_completion"),
        F.round(F.sum("cost"), 4).alias("cost_floor"),
        F.count_if(F.col("cost").isNull()).alias("missing_cost"),
    )
    return with_quantiles(sums, rows, "latency_s", {"p50": ("ceil", 0.5), "p95": ("ceil", 0.95), "p99": ("ceil", 0.99)}, by)


def sample_blocks(rows: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """samples, low, mean, p95 (rounded rank), top of a polled value, and by how much the last differs from the first."""
    sums = rows.groupBy(*by).agg(
        F.count(value).alias("samples"),
        F.round(F.min(value), 6).alias("low"),
        F.round(F.avg(value), 6).alias("mean"),
        F.round(F.max(value), 6).alias("top"),
        F.round(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))) - F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))), 6).alias("delta"),
    )
    return with_quantiles(sums, rows, value, {"p95": ("rounded", 0.95)}, by)


def arm_table(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, mean, p50 and p95 (int-truncated rank) of latency, and prompt tokens by modality. rows: latency_s, prompt_tokens, audio (boolean)."""
    tokens = lambda audio: F.sum(F.when(F.col("audio") == audio, F.col("prompt_tokens")).otherwise(0)).cast("long")
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_s"), 6).alias("mean"), tokens(False).alias("text_tokens"), tokens(True).alias("audio_tokens"))
    return with_quantiles(sums, rows, "latency_s", {"p50": ("ceil", 0.5), "p95": ("trunc", 0.95)}, by)
