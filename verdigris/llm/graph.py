"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> node, component: the least node that links reach, for every
    node of a link.

    Nodes are ordered by a hash that changes with the round. Each round a node
    takes the least one among itself and its neighbours, then what that one
    took; the links between different takers make the next graph, smaller by a
    constant factor on average whatever the shape. At the end the rounds'
    tables are joined from the smallest up. All steps are joins and partial minima, so
    a hub's links are never gathered, and each round is a table in the shared
    folder. Null ends are left out; no links, no rows.
    """
    links = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = written(links.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct(), "links")
    levels = []
    while True:
        ordered = lambda c: F.struct(F.xxhash64(F.lit(len(levels)), c).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        low = edges.groupBy("a").agg(F.min(ordered("b")).alias("near"))
        low = low.select("a", F.least("near", ordered("a"))["x"].alias("low"))
        next_low = low.select(F.col("a").alias("of"), F.col("low").alias("lower"))
        taken = low.join(next_low, F.col("low") == F.col("of"), "left").select(F.col("a").alias("node"), F.coalesce("lower", "low").alias("label"))
        levels.append(written(taken, "labels"))
        ends = [levels[-1].select(F.col("node").alias(f"n{k}"), F.col("label").alias(f"l{k}")) for k in "ab"]
        left = edges.join(ends[0], F.col("a") == F.col("na")).join(ends[1], F.col("b") == F.col("nb")).where("la <> lb")
        left = written(left.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "links")
        dropped(edges)
        edges = left
        if edges.isEmpty():
            break
    out = levels[-1]
    for level in reversed(levels[:-1]):
        above = out.select(F.col("node").alias("of"), F.col("label").alias("root"))
        out = level.join(above, F.col("label") == F.col("of"), "left").select("node", F.coalesce("root", "label").alias("label"))
    least = out.groupBy("label").agg(F.min("node").alias("component")).withColumnRenamed("label", "of")
    out = written(out.join(least, F.col("label") == F.col("of")).select("node", "component"), "components")
    dropped(edges, *levels)
    return out
