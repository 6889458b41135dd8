"""Exact Jaccard self-join of documents over word n-grams.

A document is the set of its distinct n-word shingles; documents with equal
texts are one node. Two nodes link when `percent` of their union is shared.

A node that shares `need = ceil(percent * n)` tokens with another shares, under
any global order of tokens, one of its first n - need + 1. Several orders are
used, each a necessary condition, and they are intersected before any pair is
verified:

* order 1 is by rarity (a bounded summary of frequent tokens over all
  documents, then a hash). Nodes are joined by their prefix tokens under it; how
  many of them a pair shares, and where the first stands, bounds the overlap.
  Tokens spread so thinly that no task meets them twice are missed by the summary;
  where prefixes turn out to be full of them, they are cut again with these behind;
* orders 2 and 3 are by independent hashes. A pair must share a prefix token
  under both as well, and be near in length.

Token lists of up to SHORT_LIST nodes give their pairs, longer ones those of each
two neighbouring size classes that hold no more. The nodes of more
are near copies by the thousand or share what is common everywhere; their
pairs are never written. Such nodes are gathered by size class into hot
clusters, cut into chunks of bounded tokens; a task gets two chunks, intersects
all three orders and counts shared tokens with matrix products of bounded
slices, and returns links enough to connect what it found. A pair that shares a
long list's token is in a hot cluster, so what the short lists alone say of a
pair is all that is needed of the others. Hashes only propose: a link is
counted on the words themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .graph import components
from .scratch import bounded_batches, dropped, written

WORDS = 4
PERCENT = 85
#: Text bytes a task works on at once: a dozen arrays of a word or token each.
BLOCK_BYTES = (1 << 19) - 1
#: Tokens held in the summary of frequent tokens (all others count as rare), and a task's own.
FREQUENT = 1 << 20
HELD = 1 << 20
#: Bits of a token's hash below its rank; the highest rank, twice FREQUENT, has to fit above them.
RANK_SHIFT = 42
assert 2 * FREQUENT << RANK_SHIFT < 1 << 64
#: Nodes that share a prefix token, up to which the pairs are written; longer lists are compared in tasks. Both ways are exact.
SHORT_LIST = 32
#: Prefixes are cut again where so few nodes come on a list that is long, or nearly, though its token was taken for rare.
NODES_A_LIST = 256
#: Tokens of a chunk: a cluster is cut into SPLITS chunks, of these sizes.
LEAST_CHUNK, MOST_CHUNK, SPLITS = 1 << 14, 1 << 18, 4
#: What a node weighs besides its tokens, so that a chunk has a bounded number of nodes.
NODE_WEIGHT = 64
SLICE = 4096
#: Rows (an id and two digests each) that are broadcast to the texts up to this count; beyond, both sides are shuffled.
MAX_BROADCAST_IDS = 500_000
#: The cell of a list that is not split.
WHOLE = -2
_SALTS = (np.uint64(0x8C95B3F1D6A7E24B), np.uint64(0x3F84D5B5B5470917), np.uint64(0x9216D5D98979FB1B))


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, text, stem and check: 120 bits of the text's SHA-256, as two numbers."""
    text = F.coalesce("text", F.lit(""))
    part = lambda at: F.conv(F.substring("sha", at, 15), 16, 10).cast("long")
    return docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("sha")).select("doc_id", "text", part(1).alias("stem"), part(16).alias("check"))


def token_sets(block: tb.Block, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of the block's documents, ascending inside each, and each
    document's first one (one more than documents). A document of fewer words
    than a shingle, but not none, has its whole sequence as one token."""
    _, _, hashes, first = block.words(tb.SPACED)
    grams, at = tb.ngrams(hashes, first, words)
    doc = tb.doc_of(at, first)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < words))
    if len(short):
        whole = np.array([_sequence(hashes[first[d] : first[d + 1]]) for d in short], np.uint64)
        grams, doc = np.concatenate([grams, whole]), np.concatenate([doc, short])
    # one sort by document and leading hash bits; only if two hashes agree in those, one by all bits
    order = np.argsort(_by_document(doc, grams))
    tied = (grams[order[1:]] >> np.uint64(20) == grams[order[:-1]] >> np.uint64(20)) & (grams[order[1:]] != grams[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    if tied.any():
        order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(block.n + 1))


def _by_document(doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Sort keys: the document, of which a block has fewer than 2**20, then 44 bits of the key."""
    return (doc.astype(np.uint64) << np.uint64(44)) | (keys >> np.uint64(20))


def _sequence(hashes: np.ndarray) -> np.uint64:
    out = np.uint64(len(hashes))
    for h in hashes:
        out = tb.mix(np.array([out ^ h], np.uint64))[0]
    return out


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def in_prefix(keys: np.ndarray, first: np.ndarray, percent: int) -> np.ndarray:
    """Which tokens are among the first of their document by the key's leading
    bits; all that equal the last of them are, so ties lose nothing."""
    n = np.diff(first)
    some = np.flatnonzero(n)
    ranked = _by_document(np.repeat(np.arange(len(n)), n), keys)
    last = np.sort(ranked)[first[some] + prefix_sizes(n[some], percent) - 1]
    return ranked <= np.repeat(last, n[some])


def frequent_tokens(docs: DataFrame, words: int, most: int = FREQUENT) -> np.ndarray:
    """Tokens in many documents, from the rarest of them to the most frequent.

    Every task counts all its documents and gives up to `most` tokens it met
    more than once; past HELD distinct tokens it forgets those met once. The
    counts only order tokens, and any order gives the same links.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            tokens, times = (np.concatenate(x) for x in zip((known, n), *held, strict=True))
            held.clear()
            order = np.argsort(tokens)
            tokens, times = tokens[order], times[order]
            del order
            starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            tokens, times = tokens[starts], np.add.reduceat(times, starts)
            if len(tokens) > HELD:
                tokens, times = tokens[times > 1], times[times > 1]
            return tokens, times

        for batch in batches:
            for block in tb.blocks(batch.column(0), BLOCK_BYTES):
                tokens, times = np.unique(token_sets(block, words)[0], return_counts=True)
                held.append((tokens, times.astype(np.int32)))
                size += len(tokens)
                if size > HELD:
                    known, n = merged()
                    size = 0
        if held:
            known, n = merged()
        known, n = known[n > 1], n[n > 1]
        if len(known) > most:
            top = np.argpartition(n, len(n) - most)[-most:]
            known, n = known[top], n[top]
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])
        pa.default_memory_pool().release_unused()

    rows = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = rows.orderBy(F.desc("n"), "token").limit(most).toArrow()  # FREQUENT rows at most
    token, n = top.column("token").to_numpy(), top.column("n").to_numpy()
    return token[np.lexsort((token, n))].view(np.uint64)


def rarity_keys(tokens: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order 1 as numbers: a token of the sorted `known` by its rank, others before all of them, by hash."""
    keys = tb.mix(tokens ^ _SALTS[1]) >> np.uint64(64 - RANK_SHIFT)
    if len(known):
        place = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        keys |= np.where(known[place] == tokens, rank[place], 0).astype(np.uint64) << np.uint64(RANK_SHIFT)
    return keys


def _in_order(doc: np.ndarray, keys: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The order of tokens by document, then key, then token."""
    order = np.argsort(keys)
    k, t = keys[order], tokens[order]
    if ((k[1:] == k[:-1]) & (t[1:] != t[:-1])).any():
        return np.lexsort((tokens, keys, doc))
    small = doc.astype(np.uint16) if len(doc) and doc[-1] < 1 << 16 else doc
    return order[np.argsort(small[order], kind="stable")]


def prefix_table(docs: DataFrame, words: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, stem, check, n (size of the set), node (null if it is empty) and p1,
    the prefix under order 1, in that order; of a node's documents in a task only
    the first has one."""
    order = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], (order + 1).astype(np.uint64)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for block in tb.blocks(batch.column(1), BLOCK_BYTES):
                tokens, first = token_sets(block, words)
                n = np.diff(first)
                stem, check = (batch.column(k).slice(block.lo, block.n) for k in (2, 3))
                new = np.zeros(block.n, bool)
                for d, pair in enumerate(zip(stem.to_pylist(), check.to_pylist(), strict=True)):
                    if n[d] and pair not in seen:
                        seen.add(pair)
                        new[d] = True
                doc = np.repeat(np.arange(block.n), n)
                own = new[doc]
                doc, tokens = doc[own], tokens[own]
                by = _in_order(doc, rarity_keys(tokens, known, rank), tokens)
                size = np.where(new, n, 0)
                place = np.arange(len(by)) - np.repeat(np.cumsum(size) - size, size)
                chosen = place < prefix_sizes(n, percent)[doc]
                ends = np.concatenate([[0], np.cumsum(np.where(new, prefix_sizes(n, percent), 0))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.lo, block.n),
                        stem,
                        check,
                        pa.array(n),
                        pa.array(stem.to_numpy(zero_copy_only=False), mask=n == 0),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens[by][chosen].view(np.int64))),
                    ],
                    ["doc_id", "stem", "check", "n", "node", "p1"],
                )
        pa.default_memory_pool().release_unused()

    return digested(docs).mapInArrow(cut, "doc_id long, stem long, check long, n long, node long, p1 array<long>")


def with_nodes(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table, and its nodes: node, least (doc_id), check. Texts whose first
    60 bits of SHA-256 agree and whose next ones do not are given nodes of their own."""
    while True:
        ends = [f("check").alias(k) for f, k in ((F.min, "check"), (F.max, "other"))]
        nodes = written(table.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), *ends), "nodes")
        twins = nodes.where("check <> other").select(F.col("node").alias("twin"))
        if twins.isEmpty():
            return table, nodes.drop("other")
        new = F.when(F.col("twin").isNotNull(), F.xxhash64("node", "check")).otherwise(F.col("node"))
        table = written(table.join(twins, F.col("node") == F.col("twin"), "left").withColumn("node", new).drop("twin"), "prefixes")
        dropped(nodes)


def hash_order(tokens: np.ndarray, salt: np.uint64) -> np.ndarray:
    return tb.mix(tb.mix(tokens ^ salt) + salt)


def _hashed_prefix(tokens: np.ndarray, first: np.ndarray, salt: np.uint64, percent: int) -> pa.Array:
    """16 bits of each token of the prefix."""
    chosen = in_prefix(hash_order(tokens, salt), first, percent)
    ends = np.concatenate([[0], np.cumsum(chosen)])[first]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((tokens[chosen] >> np.uint64(48)).astype(np.uint16).view(np.int16)))


def shared_postings(table: DataFrame) -> DataFrame:
    """token, node, n, pos (in the node's prefix), times (nodes): prefix tokens of order 1 that several nodes have."""
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = table.where("node is not null").select("node", "n", F.posexplode("p1").alias("pos", "token")).repartition(parts, "token")
    # the largest n and pos are kept so that both sides of the join read the same columns: one exchange then serves both
    ends = [F.min("node").alias("least"), F.max("node").alias("most"), F.max("n").alias("top_n"), F.max("pos").alias("top_pos")]
    lists = rows.groupBy("token").agg(*ends).where("least <> most").withColumnRenamed("token", "of")
    found = rows.join(lists, F.col("token") == F.col("of")).select("token", "node", "n", "pos", "top_n", "top_pos")
    found = written(found.distinct(), "shared")  # documents of one node
    times = found.groupBy("token").agg(F.count(F.lit(1)).alias("times")).withColumnRenamed("token", "of")
    out = written(found.join(times, F.col("token") == F.col("of")).select("token", "node", "n", "pos", "times"), "postings")
    dropped(found)
    return out


def _near(a: str, b: str, percent: int) -> Column:
    return (F.col(a) * percent <= 100 * F.col(b)) & (F.col(b) * percent <= 100 * F.col(a))


def size_class(percent: int) -> Column:
    """Linked sets differ in size by a factor percent at most: they are in one class or in neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / math.log(100 / (percent - 0.1))).cast("int")


def crowded_tokens(postings: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """Tokens of long lists, and of nearly long ones, that are not in the summary, from the shortest list to the longest."""
    lists = postings.where(F.col("times") > SHORT_LIST // 2).groupBy("token").agg(F.max("times").alias("times"))
    top = lists.orderBy(F.desc("times"), "token").limit(FREQUENT).toArrow()  # FREQUENT rows at most
    token, times = top.column("token").to_numpy(), top.column("times").to_numpy()
    token = token[np.lexsort((token, times))].view(np.uint64)
    return token[~np.isin(token, frequent)]


def in_cells(postings: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: postings (token, cell, klass, node, n, pos) whose pairs are few enough to be written, and
    edges a, b that keep the others together.

    Cell k of a long list has its nodes of size classes k and k + 1, so that a pair of one class or of two neighbouring ones
    is in the cell of the lower one; a short list is one cell. Nodes of a cell above SHORT_LIST have an edge to its least node.
    """
    rows = postings.select("token", "node", "n", "pos", "times", size_class(percent).alias("klass"))
    short = rows.where(F.col("times") <= SHORT_LIST).select("token", F.lit(WHOLE).alias("cell"), "klass", "node", "n", "pos")
    split = rows.where(F.col("times") > SHORT_LIST).select("token", F.explode(F.array("klass", F.col("klass") - 1)).alias("cell"), "klass", "node", "n", "pos")
    cells = split.groupBy("token", "cell").agg(F.count(F.lit(1)).alias("held"), F.min("node").alias("lead"))
    cells = written(cells.select(F.col("token").alias("t"), F.col("cell").alias("c"), "held", "lead"), "cells")
    if cells.count() <= MAX_BROADCAST_IDS:
        cells = F.broadcast(cells)
    split = split.join(cells, (F.col("token") == F.col("t")) & (F.col("cell") == F.col("c")))
    edges = split.where(F.col("held") > SHORT_LIST).select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    return short.unionByName(split.where(F.col("held") <= SHORT_LIST).select(*short.columns)), edges


def listed_pairs(short: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of the short cells of in_cells() that are near in size and that order 1 lets pass.

    A link shares ceil(percent * (n_a + n_b) / (100 + percent)) tokens. Of these
    at most `met` are in both prefixes and no more than what is behind the one
    prefix that ends first are not; and none stands before the first shared token.
    """
    left = short.select("token", "cell", F.col("klass").alias("k_a"), F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("at_a"))
    right = short.select(F.col("token").alias("t"), F.col("cell").alias("c"), F.col("klass").alias("k_b"), F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("at_b"))
    lower = (F.col("cell") == WHOLE) | (F.col("cell") == F.least("k_a", "k_b"))
    pairs = left.join(right, (F.col("token") == F.col("t")) & (F.col("cell") == F.col("c")) & (F.col("a") < F.col("b")) & lower & _near("n_a", "n_b", percent))
    pairs = pairs.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("met"), *[F.min(c).alias(c) for c in ("at_a", "at_b", "n_a", "n_b")]
    )
    need = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent) - 1e-9)
    behind = lambda n: F.ceil(percent * F.col(n) / F.lit(100) - 1e-9) - 1
    passed = (F.col("met") + F.greatest(behind("n_a"), behind("n_b")) >= need) & (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= need)
    return pairs.where(passed).select("a", "b")


def node_texts(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, least, check) -> node, n, text, p2 and p3 (prefixes under orders 2 and 3)."""

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column(1), BLOCK_BYTES):
                tokens, first = token_sets(block, words)
                own = [batch.column(k).slice(block.lo, block.n) for k in (0, 1)]
                prefixes = [_hashed_prefix(tokens, first, salt, percent) for salt in _SALTS[1:]]
                yield pa.RecordBatch.from_arrays([own[0], pa.array(np.diff(first)), own[1], *prefixes], ["node", "n", "text", "p2", "p3"])

    wanted = nodes.select("node", "least", F.col("check").alias("own"))
    if wanted.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    found = digested(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("check") == F.col("own")))
    found = found.select("node", "text").dropDuplicates(["node"])
    return found.mapInArrow(orders, "node long, n long, text string, p2 array<smallint>, p3 array<smallint>")


def shingle_set(text: str, words: int) -> set[tuple[bytes, ...]]:
    """The text's shingles as words. bytes.lower() folds A-Z and bytes.split() cuts at 20 and 09-0D, and no more."""
    w = text.encode().lower().split()
    return set(zip(*[w[k:] for k in range(words)], strict=False)) if len(w) >= words else {tuple(w)} if w else set()


def pair_links(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: the pairs that are links. Orders 2 and 3 are intersected before texts meet."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, left = None, set()
        for batch in batches:
            good = []
            for a, text_a, text_b in zip(*(batch.column(k) for k in (0, 2, 3)), strict=True):
                if a.as_py() != name:  # rows come sorted by a
                    name, left = a.as_py(), shingle_set(text_a.as_py(), words)
                right = shingle_set(text_b.as_py(), words)
                both = len(left & right)
                good.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good, pa.bool_())) for k in (0, 1)], ["a", "b"])

    orders = ("p2", "p3")
    left = texts.select(F.col("node").alias("of_a"), *[F.col(p).alias(f"{p}_a") for p in orders])
    right = texts.select(F.col("node").alias("of_b"), F.col("text").alias("text_b"), *[F.col(p).alias(f"{p}_b") for p in orders])
    met = pairs.join(left, F.col("a") == F.col("of_a")).join(right, F.col("b") == F.col("of_b"))
    met = met.where(F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b")).select("a", "b", "text_b")
    whole = met.join(texts.select(F.col("node").alias("of"), F.col("text").alias("text_a")), F.col("a") == F.col("of"))
    return whole.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def work_units(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, n, text, cluster) -> a row for each unit a node takes part in:
    cluster, c1, i1, c2, i2 (two chunks), side (0: first chunk, 1: second).

    Chunks meet those of their own size class and of the neighbouring ones. A
    cluster of one chunk is one unit.
    """
    weight = F.col("n") + NODE_WEIGHT
    klass = size_class(percent)
    totals = nodes.groupBy("cluster").agg(F.sum(weight).alias("total"))
    chunk = F.least(F.greatest(F.col("total") / SPLITS, F.lit(float(LEAST_CHUNK))), F.lit(float(MOST_CHUNK)))
    small = F.col("total") <= LEAST_CHUNK
    classes = nodes.select("cluster", "n", klass.alias("klass")).join(totals, "cluster").withColumn("klass", F.when(small, 0).otherwise(F.col("klass")))
    classes = classes.groupBy("cluster", "klass").agg(F.ceil(F.sum(weight) / F.max(chunk)).cast("int").alias("s"), F.max(small).alias("small"))
    plan = classes.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("klass", "s"))).alias("s"), F.max("small").alias("small"))
    rows = nodes.join(plan.withColumnRenamed("cluster", "of"), F.col("cluster") == F.col("of")).withColumn("c", F.when(F.col("small"), 0).otherwise(klass))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("node"), F.element_at("s", F.col("c"))).cast("int"))

    def many(c: F.Column) -> F.Column:
        n = F.coalesce(F.try_element_at("s", c), F.lit(0))
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def unit(c1, i1, c2, i2, side) -> F.Column:
        cols = zip((c1, i1, c2, i2, side), ("c1", "i1", "c2", "i2", "side"), strict=True)
        return F.struct(*[x.cast("int").alias(k) for x, k in cols])

    c, i = F.col("c"), F.col("i")
    same = F.transform(many(c), lambda j: unit(c, F.least(i, j), c, F.greatest(i, j), (i > j).cast("int")))
    above = F.transform(many(c + 1), lambda j: unit(c, i, c + 1, j, F.lit(0)))
    below = F.transform(many(c - 1), lambda j: unit(c - 1, j, c, i, F.lit(1)))
    return rows.select("cluster", "node", "n", "text", F.explode(F.concat(same, above, below)).alias("unit")).select("cluster", "unit.*", "node", "n", "text")


def _shared(left: np.ndarray, right: np.ndarray, code: np.ndarray, owner: np.ndarray, picked: np.ndarray, m: int, width: int) -> np.ndarray:
    """How many of the picked tokens each left and right member have in common."""
    out = np.zeros((len(left), len(right)), np.float32)
    at = np.flatnonzero(picked)
    at = at[np.argsort(code[at], kind="stable")]
    cuts = np.searchsorted(code[at], np.arange(0, width + SLICE, SLICE))
    for k in range(len(cuts) - 1):
        own = at[cuts[k] : cuts[k + 1]]
        if len(own):
            dense = np.zeros((m, min(SLICE, width - k * SLICE)), np.float32)
            dense[owner[own], code[own] - k * SLICE] = 1
            out += dense[left] @ dense[right].T
    return out


def _exact_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of the texts as numbers, equal exactly if the words are: distinct
    ones of each text, and each text's first one (one more than texts)."""
    known: dict[bytes, int] = {}
    rows = []
    for text in texts:
        w = text.encode().lower().split()
        w = [known.setdefault(x, len(known) + 1) for x in w] + [0] * (words - len(w) if w else 0)
        rows.append(np.array(w, np.int64))
    size = np.array([max(len(r) - words + 1, 0) for r in rows])
    doc = np.repeat(np.arange(len(rows)), size)
    code = np.zeros(len(doc), np.int64)
    for k in range(words):
        step = np.concatenate([r[k : k + m] for r, m in zip(rows, size, strict=True)])
        code = np.unique(code * (len(known) + 1) + step, return_inverse=True)[1]
    width = int(code.max()) + 1 if len(code) else 1
    doc, code = np.divmod(np.unique(doc * width + code), width)
    return code.astype(np.uint64), np.searchsorted(doc, np.arange(len(rows) + 1))


def unit_links(node: np.ndarray, texts: list[str], side: np.ndarray, words: int, percent: int) -> list[tuple[int, int]]:
    """Links of a unit, enough to connect what the unit links."""
    flat, first = _exact_sets(texts, words)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    often = times > 1
    common, code, width = often[place], (np.cumsum(often) - 1)[place], int(often.sum())
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    alone = not len(right)
    if alone:
        right = left
    if not width or not len(left):
        return []
    pair = (percent * n[left][:, None] <= 100 * n[right][None, :]) & (percent * n[right][None, :] <= 100 * n[left][:, None])
    if alone:
        pair &= np.arange(len(left))[:, None] < np.arange(len(left))[None, :]
    for salt in _SALTS[1:]:
        if not pair.any():
            return []
        pair &= _shared(left, right, code, owner, in_prefix(hash_order(flat, salt), first, percent) & common, len(n), width) > 0
    if not pair.any():
        return []
    both = _shared(left, right, code, owner, common, len(n), width)
    union = n[left][:, None] + n[right][None, :] - both
    found = np.argwhere(pair & (100 * both >= percent * union))
    parent = list(range(len(n)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(left[found[:, 0]].tolist(), right[found[:, 1]].tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[p] = q
            out.append((int(node[x]), int(node[y])))
    return out


def unit_pairs(units: DataFrame, words: int, percent: int) -> DataFrame:
    def verify(table: pa.Table) -> pa.Table:
        found = unit_links(table.column("node").to_numpy(), table.column("text").to_pylist(), table.column("side").to_numpy(), words, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return units.groupBy("cluster", "c1", "i1", "c2", "i2").applyInArrow(verify, "a long, b long")


def resolve(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Two tables: documents (doc_id, stem, check, n, node; node is null where there
    are no words) and nodes (node, least doc_id, component, a node)."""
    bounded_batches(docs.sparkSession)
    frequent = frequent_tokens(docs, words)
    whole, nodes = with_nodes(written(prefix_table(docs, words, percent, frequent), "prefixes"))
    postings = shared_postings(whole)
    more = crowded_tokens(postings, frequent)
    if len(more) * NODES_A_LIST > nodes.count():
        dropped(whole, nodes, postings)
        whole, nodes = with_nodes(written(prefix_table(docs, words, percent, np.concatenate([more, frequent])), "prefixes"))
        postings = shared_postings(whole)
    del frequent, more
    table = written(whole.drop("p1"), "documents")
    dropped(whole)
    short, edges = in_cells(postings, percent)
    pairs = written(listed_pairs(short, percent), "pairs")
    edges = written(edges, "edges")
    dropped(postings)
    clusters = components(edges).withColumnRenamed("component", "cluster")
    met = pairs.select(F.explode(F.array("a", "b")).alias("met")).union(clusters.select("node")).distinct()
    inside = nodes.join(met, F.col("node") == F.col("met"), "left_semi")
    texts = written(node_texts(docs, inside, words, percent), "texts")
    hot = texts.join(clusters.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).select("node", "n", "text", "cluster")
    links = pair_links(pairs, texts, words, percent).unionByName(unit_pairs(work_units(hot, percent), words, percent))
    links = written(links, "near")
    dropped(texts, pairs, edges)
    linked = components(links).withColumnRenamed("node", "of")
    dropped(links)
    nodes = nodes.join(linked, F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    return table, nodes


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links reach.

    A null or blank text has no shingles and links with nothing, not with
    another such text either; its component is itself. Null ids take part and
    never name a component, unless all of it has none. Rows with equal sets,
    repeated rows among them, are linked. An empty table gives no rows. Other
    columns of docs are not read.
    """
    table, nodes = resolve(docs, words, percent)
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "c")
    ids = nodes.join(least, F.col("component") == F.col("c")).select(F.col("node").alias("of"), "component_id")
    out = table.select("doc_id", F.col("n").alias("n_shingles"), "node").join(ids, F.col("node") == F.col("of"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The documents with one row left of each component: that of least doc_id
    (null ids last; of several texts under that id the one of least digest).
    Columns as given, whatever their names.

    Texts, not ids, are what is linked: rows under one id with unlinked texts all
    stay. Of repeated rows that are to stay, equal in id and text, one stays. Rows
    without words are linked with nothing and all stay. An empty table gives no rows.
    """
    table, nodes = resolve(docs, words, percent)
    rows = table.where("node is not null").groupBy("doc_id", "node", "stem", "check").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.join(nodes.select(F.col("node").alias("of"), "component"), F.col("node") == F.col("of")).drop("of", "node")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "stem", "check")).alias("first")
    best = rows.groupBy("component").agg(first).withColumnRenamed("component", "c")
    rows = rows.join(best, F.col("component") == F.col("c"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("stem") == F.col("first.stem")) & (F.col("check") == F.col("first.check"))
    # what does not simply stay: rows that go, and rows of which one of several stays
    odd = rows.where(~stays | (F.col("times") > 1)).select(F.struct("doc_id", "stem", "check").alias("key"), stays.alias("stays"))
    odd = written(odd, "odd")
    few = odd.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    text = F.coalesce("text", F.lit(""))
    part = lambda at: F.conv(F.substring(F.sha2(text, 256), at, 15), 16, 10).cast("long")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct("doc_id", part(1).alias("stem"), part(16).alias("check")).alias("key"))
    same = F.col("w.key").eqNullSafe(F.col("o.key"))
    o = F.broadcast(odd) if few else odd
    plain = whole.alias("w").join(o.alias("o"), same, "left_anti").select("w.row.*")
    several = F.broadcast(odd.where("stays")) if few else odd.where("stays")
    one = whole.alias("w").join(several.alias("o"), same, "left_semi").select("w.row", "w.key").dropDuplicates(["key"])
    return plain.unionByName(one.select("row.*"))
