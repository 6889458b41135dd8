"""Token usage of calls as their responses nest it, summed by direction and modality, and priced from a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modalities, in the order in which cached tokens are taken off the input.
MODALITIES = ("text", "audio", "image", "video")
_DETAIL = "array<struct<modality: string, tokenCount: bigint>>"
USAGE = f"promptTokensDetails {_DETAIL}, candidatesTokensDetails {_DETAIL}, thoughtsTokenCount bigint, cachedContentTokenCount bigint"


def _summed(details: Column, modality: str) -> Column:
    own = F.filter(F.coalesce(details, F.array().cast(_DETAIL)), lambda d: F.lower(d["modality"]) == modality)
    return F.aggregate(own, F.lit(0).cast("long"), lambda n, d: n + F.coalesce(d["tokenCount"], F.lit(0)))


def usage_tokens(rows: DataFrame, usage: str = "usage") -> DataFrame:
    """rows with input_text ... input_video, output_text ... output_video, thoughts
    and cached, from usage, the response's own JSON. Modalities of other names are not counted; JSON that cannot be read has no tokens."""
    read = F.from_json(F.col(usage), USAGE)
    counts = {f"input_{m}": _summed(read["promptTokensDetails"], m) for m in MODALITIES} | {f"output_{m}": _summed(read["candidatesTokensDetails"], m) for m in MODALITIES}
    return rows.withColumns(counts | {"thoughts": F.coalesce(read["thoughtsTokenCount"], F.lit(0)), "cached": F.coalesce(read["cachedContentTokenCount"], F.lit(0))})


def with_costs(rows: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """rows of usage_tokens() with cost_input, cost_output (rounded to 6 places)
    and unpriced, the billable tokens for which there is no price.

    prices: model, direction (input, output), modality (or `thoughts`, or `all`
    for those that have none of their own), cost_per_token, one row each. A
    model's prices are one map, so a row meets them once and is not multiplied.
    Cached tokens are free: they are taken off text first, then audio, image, video.
    """
    entries = F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "direction", "modality"), F.col("cost_per_token").cast("double"))))
    tables = prices.groupBy(F.col("model").alias("_model")).agg(entries.alias("_prices"))
    rows = rows.join(tables, F.col(model) == F.col("_model"), "left")
    price = lambda direction, modality: F.coalesce(F.element_at("_prices", f"{direction}:{modality}"), F.element_at("_prices", f"{direction}:all"))
    billed, left = {}, F.col("cached")
    for m in MODALITIES:
        billed["input", m] = F.greatest(F.col(f"input_{m}") - left, F.lit(0))
        left = F.greatest(left - F.col(f"input_{m}"), F.lit(0))
    billed |= {("output", m): F.col(f"output_{m}") for m in MODALITIES} | {("output", "thoughts"): F.col("thoughts")}
    cost = lambda direction: F.round(reduce(Column.__add__, [n * F.coalesce(price(d, m), F.lit(0.0)) for (d, m), n in billed.items() if d == direction]), 6)
    unpriced = reduce(Column.__add__, [F.when(price(d, m).isNull(), n).otherwise(0) for (d, m), n in billed.items()])
    return rows.withColumns({"cost_input": cost("input"), "cost_output": cost("output"), "unpriced": unpriced}).drop("_model", "_prices")
