"""A uniform shuffle into shards of exact size, by a communication matrix.

Documents start in the partitions they are read in. How many rows each of these
sends to each shard is drawn first, as one matrix with the partitions' counts as
row sums and the exact shard sizes as column sums: a multivariate hypergeometric
draw, which is the law that a uniform permutation of all rows would induce. Each
partition then permutes its own rows and cuts them by its row of the matrix; the
rows are exchanged and permuted again inside their shard. The result is
distributed as a uniform permutation cut into equal shards, and no count has to
be corrected afterwards.

The rows and their places of origin are written once, so that counts and labels
speak of the same partitions whatever is recomputed. What rows hold plays no part
in where they go: equal rows and hot keys are dealt out like any others. The
driver holds partitions x shards integers. Both permutations are seeded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

SHARDS = 8
SEED = 20240607
#: Rows that are ranked together in the second permutation, about.
CELL_ROWS = 1 << 12
#: Standard deviations around its mode within which a count is drawn; what lies beyond is below a double's resolution.
_REACH = 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n items drawn from good + bad ones are good, for any totals.

    Inversion of the exact law: its values relative to the mode follow from the
    ratios of neighbouring ones, so nothing has to be approximated by another law.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    share = good / total
    reach = int(_REACH * (n * share * (1 - share) * (total - n) / max(total - 1, 1)) ** 0.5) + 40
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    heights = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(heights - heights.max()))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], "right").clip(0, len(weights) - 1))


def communication_matrix(counts: np.ndarray, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """counts of each partition -> how many rows each sends to each shard.

    Shard sizes differ by one at most. Row by row, a partition's part of what the
    shards still need is multivariate hypergeometric.
    """
    total = int(counts.sum())
    need = [total // shards + (s < total % shards) for s in range(shards)]
    rng = np.random.default_rng(seed)
    out = np.zeros((len(counts), shards), np.int64)
    for i, n in enumerate(counts.tolist()):
        left = sum(need)
        for s in range(shards):
            left -= need[s]
            out[i, s] = hypergeometric(rng, need[s], left, n)
            n -= int(out[i, s])
            need[s] -= int(out[i, s])
    return out


def _dealt(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """rows -> with shard and slot (0, 1, ... in each shard); columns origin and at are added and used."""
    at = F.monotonically_increasing_id()
    rows = written(rows.withColumns({"origin": F.shiftright(at, 33).cast("int"), "at": at.bitwiseAND((1 << 33) - 1)}), "origins")
    found = rows.groupBy("origin").count().orderBy("origin").collect()  # a row a partition
    counts = np.array([r["count"] for r in found], np.int64)
    origins = np.array([r["origin"] for r in found], np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((origins, communication_matrix(counts, shards, seed)))
    keyed = lambda k: _labeller(shared, seed, k)
    dealt = rows.mapInArrow(keyed(rows.columns.index("origin")), rows.withColumn("shard", F.lit(0)).schema)
    # the second, inside the shard: cells of the shard in a row, and ranks inside the cells
    cells = max(1, -(-int(counts.sum()) // (shards * CELL_ROWS)))
    k2 = F.xxhash64(F.lit(seed + 2), "origin", "at")
    cell = F.pmod(F.shiftrightunsigned(k2, 7), F.lit(cells)).cast("int")
    sums = rows.select("origin", "at").mapInArrow(keyed(0), "origin int, at long, shard int").groupBy("shard", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("shard").alias("s"), F.col("cell").alias("c"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("k2", "origin", "at")) - 1
    out = dealt.withColumns({"k2": k2, "cell": cell}).withColumn("inside", inside)
    out = out.join(sums, (F.col("shard") == F.col("s")) & (F.col("cell") == F.col("c")))
    return out.withColumn("slot", (F.col("start") + F.col("inside")).cast("long"))


def _labeller(shared, seed: int, place: int):
    """Batches with columns origin and at, from `place` on -> with the shard of each row."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, matrix = shared.value
        of, labels = None, None
        for batch in batches:
            origin, at = (batch.column(k).to_numpy() for k in (place, place + 1))
            shard = np.zeros(batch.num_rows, np.int32)
            cuts = np.flatnonzero(np.concatenate([[True], origin[1:] != origin[:-1], [True]])) if len(origin) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if origin[lo] != of:  # the first permutation: a partition's rows in a random order, cut by its row of the matrix
                    of = origin[lo]
                    own = matrix[np.searchsorted(known, of)]
                    labels = np.random.default_rng([seed, int(of)]).permutation(np.repeat(np.arange(len(own), dtype=np.int32), own))
                shard[lo:hi] = labels[at[lo:hi]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], [*batch.schema.names, "shard"])

    return label


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard,
    slot (0, 1, ... in each shard), grown_shard (null under this law).

    Nulls: a null text has size 1 and the crc32 of no bytes, 0; a null doc_id is
    like any other. Repeated rows are rows of their own and get slots of their
    own. Fewer rows than shards leave the last shards empty; an empty table gives
    no rows. Other columns are not read. Reruns over the same files with the same
    splits agree.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return _dealt(rows, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def sharded_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The documents, columns as given, with `shard` and `slot` (in place of
    columns of these names). Repeated rows, null ids and texts get places of
    their own; an empty table gives no rows. Whole rows are exchanged once."""
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    out = _dealt(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")), shards, seed)
    return out.select("row.*", "shard", "slot")
