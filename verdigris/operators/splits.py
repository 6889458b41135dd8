"""A split of a test set into a tune and a holdout part that keeps versions of one text together.

An item whose mechanism names a base (it is that item's text made longer) moves with it:
a base and its versions are one block, every other item is its own. A part of the blocks of
each family is tuned on; blocks of several items cross families and are a stratum of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ordered_row_number

#: How a mechanism names its base, and the stratum of blocks of several items.
BASE = r"^dilation of (RET-[0-9]+) at [0-9]+x:"
SEVERAL = "dilation-block"
PARTS = ("tune", "holdout")


def blocks(items: DataFrame, pattern: str = BASE) -> DataFrame:
    """items (item_id, family, mechanism) -> item_id, family, block (the base's id, or its own).

    An item without id, an id of several items, a base that is not among the items, and a
    base that is a version itself are errors: such blocks cannot be kept together.
    """
    base = F.nullif(F.regexp_extract(F.coalesce("mechanism", F.lit("")), pattern, 1), F.lit(""))
    one = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("family", base.alias("base"))).alias("_i"))
    sound = F.assert_true(F.col("item_id").isNotNull() & (F.col("_n") == 1), "an item has no id of its own")
    one = one.where(sound.isNull()).select("item_id", "_i.family", "_i.base")
    known = one.select(F.col("item_id").alias("base"), F.col("base").isNull().alias("_first"))
    versions = one.where(F.col("base").isNotNull()).join(known, "base", "left")
    there = F.assert_true(F.coalesce("_first", F.lit(False)), "a base is not among the items, or is a version itself")
    versions = versions.where(there.isNull()).select("item_id", "family", F.col("base").alias("block"))
    return one.where(F.col("base").isNull()).select("item_id", "family", F.col("item_id").alias("block")).unionByName(versions)


def draw(items: DataFrame, tune_every: int = 3, pattern: str = BASE) -> DataFrame:
    """-> item_id, family, block, stratum, part. Of a stratum's blocks, in the order of
    family and id of their first items, the first and every tune_every-th after it are tuned on."""
    if tune_every < 2:
        raise ValueError("with every block in one part there is no holdout")
    members = blocks(items, pattern)
    heads = members.groupBy("block").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("family", "item_id")).alias("_first"))
    heads = heads.select("block", F.when(F.col("_n") > 1, SEVERAL).otherwise(F.col("_first.family")).alias("stratum"), "_first")
    drawn = ordered_row_number(heads, [F.col("_first.family"), F.col("_first.item_id")], "_pos", ["stratum"])
    part = F.when((F.col("_pos") - 1) % tune_every == 0, PARTS[0]).otherwise(PARTS[1])
    return members.join(drawn.select("block", "stratum", part.alias("part")), "block").select("item_id", "family", "block", "stratum", "part")


def problems(split: DataFrame, items: DataFrame, pattern: str = BASE) -> DataFrame:
    """split (item_id, part) of items -> problem, part, detail: every way it is wrong.

    duplicate: an id twice in a part; unknown: an id that no item has; overlap: an item in
    both parts; missing: an item in none; empty: a part without ids; straddling: a block with
    items in tune and items that are not. detail is the item's or block's id.
    """
    of = lambda p: F.count_if(F.col("part") == p).alias(p)
    pack = items.select("item_id", F.lit("pack").alias("part"))
    seen = split.where(F.col("part").isin(*PARTS)).select("item_id", "part").unionByName(pack)
    counts = seen.groupBy("item_id").agg(*[of(p) for p in (*PARTS, "pack")])
    row = lambda when, problem, part: F.when(when, F.struct(F.lit(problem).alias("problem"), F.lit(part).alias("part"), F.col("item_id").alias("detail")))
    tune, holdout = F.col("tune") > 0, F.col("holdout") > 0
    none = F.lit(None).cast("string")
    found = [row(F.col(p) > 1, "duplicate", p) for p in PARTS]
    found += [row((F.col(p) > 0) & (F.col("pack") == 0), "unknown", p) for p in PARTS]
    found += [row(tune & holdout, "overlap", None), row(~tune & ~holdout, "missing", None)]
    per_item = counts.select(F.inline(F.array_compact(F.array(*found)))).withColumn("part", F.col("part").cast("string"))
    sides = blocks(items, pattern).join(counts.select("item_id", tune.alias("_t")), "item_id")
    straddling = sides.groupBy("block").agg(F.bool_or("_t").alias("some"), F.bool_and("_t").alias("all")).where("some and not all")
    filled = split.agg(*[of(p) for p in PARTS])
    empty = filled.select(F.inline(F.array_compact(F.array(*[F.when(F.col(p) == 0, F.struct(F.lit("empty").alias("problem"), F.lit(p).alias("part"), none.alias("detail"))) for p in PARTS]))))
    return per_item.unionByName(straddling.select(F.lit("straddling").alias("problem"), none.alias("part"), F.col("block").alias("detail"))).unionByName(empty)
