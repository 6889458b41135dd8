"""Mixing sources to target weights by systematic sampling.

A source's target share becomes a number of expected copies for each of its
documents. Within the source the expected copies are prefix-summed over the
documents, one random offset is added, and a document is taken once for every
integer its stretch of the sum crosses. So a source with target/size 2.4 takes
each document two or three times, and the total is within one copy of exact.

Only (key, size, source) rows are shuffled, never texts. The prefix sum is in
two levels: documents are ranked inside cells (source, size class, split), and
the cells are summed before. A size class of a source has as many splits as its
rows fill with CELL_ROWS, so a hot source is spread over cells of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.matching import bounded

from .scratch import written

WEIGHTS = (5, 2, 1)
CEILING = 3
#: Rows that are ranked together, about.
CELL_ROWS = 1 << 10
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with `turn`, 0, 1, ... in code-point order, null last. Each range of names starts after those before."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    rows = sizes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = written(rows.withColumns({"part": F.shiftright(at, 33), "at": at.bitwiseAND((1 << 33) - 1)}), "sources")
    start, starts = 0, []
    for r in rows.groupBy("part").count().orderBy("part").collect():  # a row a range
        starts.append((r["part"], start))
        start += r["count"]
    starts = sizes.sparkSession.createDataFrame(starts, "part long, start long")
    return rows.join(F.broadcast(starts), "part").select("source", "source_size", (F.col("start") + F.col("at")).alias("turn"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size) -> with `target`: the total of all sizes shared by
    weight, weights dealt in code-point order of the sources (null last) in
    turn, no target above `ceiling` times its source's size.

    Capping and resharing until none is above ends at one level L with target
    min(ceiling * size, L * weight). Each round is one sum over the sources: the
    level rises to what the sources capped at the last level leave for the others,
    and stays when it caps no more. Sources are numbered in ranges of their names,
    so that no task holds all of them.
    """
    turn = F.array(*[F.lit(int(w)) for w in weights])
    out = numbered_sources(sizes).withColumn("weight", turn[(F.col("turn") % len(weights)).cast("int")])
    out = written(out.select("source", "source_size", "weight", (F.col("source_size") * ceiling).alias("cap")), "targets")
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        got = out.agg(
            F.sum("source_size"), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, True))
        ).first()
        if got[2] is None or got[3] == capped:
            break
        capped, level = got[3], (got[0] - got[1]) / got[2]
    # as doubles, a level that no source is above caps them all
    target = F.col("cap").cast("double") if got[2] is None else F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    return out.select("source", "source_size", target.alias("target"))


def offset(source: Column) -> Column:
    """A number in [0, 1) for each source, the same in every run."""
    hexed = F.substring(F.md5(F.concat(F.lit(SEED + "/"), F.coalesce(F.concat(F.lit("s:"), source), F.lit("null")))), 1, 8)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(4294967296.0)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, source, tie (a hash of the text): what the mix needs of the texts, read once."""
    return written(docs.select("doc_id", word_count(F.col("text")).alias("size"), "source", F.xxhash64("text").alias("tie")), "sizes")


def systematic_copies(rows: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """rows (doc_id, size, source, tie) -> with source_size, target and `copies`.

    Order within a source: size class (steps of 7 %), split (a hash of id and
    text, so null ids are dealt out too), id, tie. Sizes in that order rise, so
    words taken stay near the target and not only documents.
    """
    cells = rows.withColumn("klass", F.floor(10 * F.log2(F.col("size") + 1)).cast("int"))
    sizes = cells.groupBy("source", "klass").agg(F.ceil(F.count(F.lit(1)) / cell_rows).alias("splits"))
    sizes = bounded(written(sizes.select(F.col("source").alias("s"), F.col("klass").alias("k"), "splits"), "classes"))
    cells = cells.join(sizes, F.col("source").eqNullSafe(F.col("s")) & (F.col("klass") == F.col("k"))).drop("s", "k")
    cells = written(cells.withColumn("split", F.pmod(F.xxhash64("doc_id", "tie"), "splits").cast("int")).drop("splits"), "cells")
    key = ["source", "klass", "split"]
    per_cell = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("cell_size"))
    per_source = per_cell.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    below = Window.partitionBy("source").orderBy("klass", "split").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_cell.withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0)))
    plan = starts.alias("c").join(targets(per_source).alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
    plan = plan.select("c.source", "c.klass", "c.split", "before", "source_size", "target")
    ranked = cells.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "size", "tie")))
    same = F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.klass") == F.col("p.klass")) & (F.col("r.split") == F.col("p.split"))
    out = ranked.alias("r").join(plan.alias("p"), same)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("before") + F.col("rank")
    copies = F.floor(at * rate + F.col("u")) - F.floor((at - 1) * rate + F.col("u"))
    out = out.withColumn("u", offset(F.col("r.source")))
    return out.select("r.*", "source_size", "target", copies.cast("long").alias("copies"))


def mix_sources(docs: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target,
    copies, taken (= copies x size).

    Nulls: a null text has size 0; a null source is a source of its own, after
    all others; a null doc_id sorts first. A source whose
    size is 0 has target 0 and takes nothing. Repeated rows are documents of
    their own; among rows with equal doc_id and size the text's hash decides,
    and rows equal in all of these are interchangeable. An empty table gives no
    rows. Other columns of docs are not read.
    """
    out = systematic_copies(sized(docs), cell_rows)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns as given.

    Rows equal in doc_id, source, size and text hash are one document here, with
    the copies of all of them. Nulls are as in mix_sources(); columns may have any
    name; an empty table gives no rows.
    """
    tie = F.xxhash64("text")
    size = word_count(F.col("text"))
    takes = systematic_copies(sized(docs), cell_rows).groupBy("doc_id", "source", "size", "tie").agg(F.sum("copies").alias("copies"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", size.alias("size"), tie.alias("tie"))
    # one row for each distinct document carries all its copies
    keyed = keyed.dropDuplicates(["doc_id", "source", "size", "tie"])
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("doc_id", "source", "size", "tie")]
    out = keyed.alias("d").join(takes.where("copies > 0").alias("t"), on)
    return out.select("d.row", F.explode(F.sequence(F.lit(1), F.col("t.copies"))).alias("copy")).select("row.*")
