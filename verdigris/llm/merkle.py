"""A Merkle manifest of a table: a tree a group, a root over the groups, and a proof for each row.

A row's leaf is a digest of its columns. In every group (a language) the leaves
stand in the order of a key; each run of `fanout` neighbours becomes one node,
level by level, until one is left, the group's subroot. Subroots, in the order
of their groups, become the root in the same way.

Spark numbers the leaves by ranges and deals them out in aligned blocks of
BLOCK leaves. A task reduces its blocks alone, whatever the groups' sizes, and
what is left, a node a block, is the next table to be reduced until TOP nodes
remain. The driver builds that top tree and broadcasts each node's path to the
root; the executors put a row's path inside its block before it. Proofs are
folded by Spark's own expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import dropped, written

#: What a documents row's digest is made of.
DOCUMENT_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK = 1 << 10
TOP = 1 << 12
_STEPS = "array<struct<before: string, after: string>>"
_ARROW_STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest(*values: Column) -> Column:
    """H: lowercase hex sha256 of values, each `-` if null, else its UTF-8 byte count, a colon and the value."""
    as_text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in as_text]), 256)


def _node(run: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(run)).hexdigest().encode()


def tree_levels(nodes: list[bytes], height: int, fanout: int = 2) -> list[list[bytes]]:
    """nodes and the levels above them, `height` of them; digests as hex text."""
    out = [nodes]
    for _ in range(height):
        below = out[-1]
        out.append([_node(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def tree_height(n: int, fanout: int = 2) -> int:
    """Levels above n nodes until one is left."""
    height, reach = 0, 1
    while reach < n:
        height, reach = height + 1, reach * fanout
    return height


def _steps(levels: list[list[bytes]], fanout: int) -> pa.Array:
    """For each node of the lowest level its siblings before and after it, level by level below the highest."""
    before, after, of = [], [], []
    places, shift = np.arange(len(levels[0])), 0
    for level in levels[:-1]:
        for i in range(len(level)):
            lo = i - i % fanout
            before.append(b"".join(level[lo:i]))
            after.append(b"".join(level[i + 1 : lo + fanout]))
        of.append(shift + places)
        shift += len(level)
        places = places // fanout
    sides = pa.StructArray.from_arrays([pa.array(before, pa.binary()).cast(pa.string()), pa.array(after, pa.binary()).cast(pa.string())], ["before", "after"])
    index = np.stack(of, 1).ravel() if of else np.zeros(0, np.int64)
    offsets = pa.array(np.arange(len(levels[0]) + 1) * len(of), pa.int32())
    return pa.ListArray.from_arrays(offsets, sides.take(pa.array(index))).cast(_ARROW_STEPS)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Whole blocks of rows that are in order: one starts wherever `pos` is a multiple of size."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("pos").to_numpy() % size == 0).tolist()
        for lo, hi in zip([0, *starts], [*starts, batch.num_rows], strict=True):
            if lo in starts[:1] or lo and held:
                yield pa.Table.from_batches(held).combine_chunks() if held else None
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _block_levels(block: pa.Table, size: int, fanout: int) -> list[list[bytes]]:
    total = block.column("total")[0].as_py()
    return tree_levels(block.column("node").to_pylist(), tree_height(min(total, size), fanout), fanout)


def _in_blocks(placed: DataFrame, size: int, run: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    dealt = placed.withColumn("block", F.floor(F.col("pos") / size).cast("long")).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks((b for b in batches if b.num_rows), size):
            if block is not None:
                yield run(block)

    return dealt.mapInArrow(work, schema)


def _driver_paths(rows: list, fanout: int) -> tuple[list, list]:
    """(grp, pos, proof) and (grp, subroot) of a bounded number of nodes in order."""
    paths, subroots = [], []
    at = 0
    while at < len(rows):
        end = at + rows[at]["total"]
        levels = tree_levels([bytes(r["node"]) for r in rows[at:end]], tree_height(end - at, fanout), fanout)
        paths += [(r["grp"], r["pos"], [(s["before"], s["after"]) for s in steps]) for r, steps in zip(rows[at:end], _steps(levels, fanout).to_pylist(), strict=True)]
        subroots.append((rows[at]["grp"], levels[-1][0].decode()))
        at = end
    return paths, subroots


def _proved(placed: DataFrame, fanout: int, size: int, top: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """placed: grp, pos (from 0), total (of the group), node, more -> the same rows
    with `proof` up to their group's subroot, and a table grp, subroot; last, tables to drop in the end."""
    spark = placed.sparkSession
    rest = [f for f in placed.schema if f.name not in ("grp", "pos", "total", "node")]

    def root(block: pa.Table) -> pa.RecordBatch:
        head = block.slice(0, 1)
        pos = head.column("pos")[0].as_py() // size
        total = -(-head.column("total")[0].as_py() // size)
        node = _block_levels(block, size, fanout)[-1][0]
        return pa.RecordBatch.from_arrays([head.column("grp").combine_chunks(), pa.array([pos], pa.int64()), pa.array([total], pa.int64()), pa.array([node], pa.binary())], ["grp", "pos", "total", "node"])

    def prove(block: pa.Table) -> pa.RecordBatch:
        out = block.append_column("proof", _steps(_block_levels(block, size, fanout), fanout))
        return out.combine_chunks().to_batches()[0]

    roots = written(_in_blocks(placed.select("grp", "pos", "total", "node"), size, root, "grp string, pos long, total long, node binary"), "blocks")
    scratch = [roots]
    upper = roots.where("total > 1")
    if upper.count() <= top:
        paths, subroots = _driver_paths(upper.orderBy("grp", "pos").collect(), fanout)
        above = F.broadcast(spark.createDataFrame(paths, f"above string, of long, path {_STEPS}"))
        found = spark.createDataFrame(subroots, "grp string, subroot string")
    else:
        proved, found, more = _proved(upper, fanout, size, top)
        above = proved.select(F.col("grp").alias("above"), F.col("pos").alias("of"), F.col("proof").alias("path"))
        scratch += more
    subroots = roots.where("total = 1").select("grp", F.col("node").cast("string").alias("subroot")).unionByName(found)
    names = ", ".join(["grp string", "pos long", "total long", "node binary", *[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "block long", f"proof {_STEPS}"])
    inside = _in_blocks(placed.select("grp", "pos", "total", "node", *[f.name for f in rest]), size, prove, names)
    out = inside.join(above, (F.col("grp") == F.col("above")) & (F.col("block") == F.col("of")), "left")
    out = out.withColumn("proof", F.when(F.col("path").isNull(), F.col("proof")).otherwise(F.concat("proof", "path")))
    return out.drop("above", "of", "path", "block"), subroots, scratch


def _placed(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, list[DataFrame]]:
    """rows (grp, node, more) with pos and total: their place in their group by `order`, and its size."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.monotonically_increasing_id()
    keys = [F.asc("grp"), *order, F.asc("node"), F.asc("row")]
    ordered = rows.withColumn("row", row).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("row").withColumn("at", row)
    ordered = written(ordered, "ordered")
    part = F.shiftright("at", 33)
    counts = ordered.groupBy(part.alias("part"), F.col("grp").alias("of")).agg(F.count("*").alias("n"), F.min("at").alias("least"))
    whole = Window.partitionBy("of")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "of", "least", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("total"))
    out = ordered.join(starts, (part == F.col("part")) & (F.col("grp") == F.col("of")))
    return out.withColumn("pos", F.col("at") - F.col("least") + F.col("start")).drop("part", "of", "least", "start", "at"), [ordered]


def merkle_manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = DOCUMENT_COLUMNS,
    group: str = "lang",
    key: str = "doc_id",
    carry: dict[str, Column] | None = None,
    fanout: int = 2,
    block: int = BLOCK,
    top: int = TOP,
) -> DataFrame:
    """key, group, leaf, subroot, root and proof of every row, and the columns of carry.

    proof is a step a level, from the leaf up to the root: the digests (hex,
    concatenated) of the siblings before and after the node, both empty where
    it stands alone. Rows of one key stand in the order of their leaves; null
    keys and the null group come first, strings in UTF-8 byte order. A null in
    any column is part of the digest. Repeated rows are leaves of their own. A
    table without rows gives none. Other columns are left out, whatever their
    names.
    """
    size = fanout ** max(1, tree_height(block, fanout)) if block > fanout else fanout
    carry = carry or {}
    name = lambda c: F.col(f"`{c}`")
    text = name(group).cast("string")
    extra = {f"x{i}": value for i, value in enumerate(carry.values())}
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("+"), text), F.lit("")).alias("grp"),
        name(key).alias("key"),
        digest(*[name(c) for c in columns]).cast("binary").alias("node"),
        *[value.alias(x) for x, value in extra.items()],
    )
    leaves = written(leaves, "leaves")
    placed, scratch = _placed(leaves, [F.asc_nulls_first("key")])
    proved, subroots, more = _proved(placed, fanout, size, top)
    subroots = written(subroots, "subroots")
    if subroots.count() <= top:
        rows = [{"grp": r["grp"], "pos": i, "node": r["subroot"].encode()} for i, r in enumerate(sorted(subroots.collect(), key=lambda r: r["grp"].encode()))]
        paths, roots = _driver_paths([r | {"total": len(rows)} for r in rows], fanout)
        tops = docs.sparkSession.createDataFrame([(g, p, roots[0][1]) for g, _, p in paths], f"of string, path {_STEPS}, root string")
        tops = F.broadcast(tops)
    else:
        nodes = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("subroot").cast("binary").alias("node"))
        ranked, tables = _placed(nodes, [F.asc("key")])
        above, root, last = _proved(ranked, fanout, size, top)
        tops = above.select(F.col("key").alias("of"), F.col("proof").alias("path"), F.lit(root.first()["subroot"]).alias("root"))
        more += tables + last
    ends = subroots.select(F.col("grp").alias("sub"), "subroot").join(tops, F.col("sub") == F.col("of")).drop("of")
    out = proved.join(ends, F.col("grp") == F.col("sub")).select(
        F.col("key").alias(key),
        F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)).alias(group),
        F.col("node").cast("string").alias("leaf"),
        "subroot",
        "root",
        F.concat("proof", "path").alias("proof"),
        *[F.col(x).alias(c) for x, c in zip(extra, carry, strict=True)],
    )
    out._verdigris_scratch = [leaves, subroots, *scratch, *more]
    return out


def release(manifest: DataFrame) -> None:
    """Delete the tables that a manifest reads, once it has been used."""
    dropped(*getattr(manifest, "_verdigris_scratch", []))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """H of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def tampered_leaf(columns: tuple[str, ...] = DOCUMENT_COLUMNS, count: str = "n_chars", key: str = "doc_id", every: int = 7) -> Column:
    """The leaf with 1 added to the count, of the rows whose key's crc32 `every` divides; else null."""
    more = (F.col(count).cast("decimal(20,0)") + 1).cast("string")
    leaf = digest(*[more if c == count else F.col(c) for c in columns])
    return F.when(F.crc32(F.col(key).cast("string").cast("binary")) % every == 0, leaf)


def audit(docs: DataFrame) -> DataFrame:
    """Every documents row's digests, with every seventh key tampered with, and whether its fold gives the root."""
    out = merkle_manifest(docs, carry={"tampered": tampered_leaf()})
    fold = folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    out = out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold.alias("folded_root"), "lang")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
