"""Benchmark decontamination by a prefix-filtered join of shingles.

An item's windows (13 consecutive words; the whole item if it is shorter) are
the sets to be contained whole in a document. Shingles of up to three words are
ordered by rarity, counted over all documents; since the containment asked for
is complete, the necessary prefix of a window is its rarest shingle alone. A
document is probed with its own shingles; a shared prefix shingle gives the one
place where the window can stand, which must lie inside the document (length
and position bounds), and there all words are compared.

The benchmark is taken in blocks of bounded bytes, one at a time: its index is
built, broadcast for one pass over the documents and given up again. A benchmark
of one block is judged in that pass. Of more, each pass writes the marks of the
documents that are hit, and they are joined before anything is judged. Documents'
texts are never shuffled; a block of Arrow rows is probed with numpy. A word's
identity is its 64-bit hash, of 13 of which in a row a hit is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .rows import rows_where
from .scratch import written

WINDOW = 13
GRAM = 3
ITEM_BLOCK_BYTES = 8 << 20
#: Rows (an id and a digest) that are broadcast to the texts up to this count; beyond, both sides are shuffled.
MAX_BROADCAST_IDS = 500_000
#: A word, as the byte class of textblocks.ALNUM has it after lower-casing.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A document is contaminated if at least one in so many of its words is hit.
ONE_IN = 20


@dataclass
class ItemIndex:
    """Windows of a block of items, found by their prefix shingle."""

    lengths: np.ndarray  # words of each window
    words: np.ndarray  # window x WINDOW word hashes, zero-filled
    owner: np.ndarray  # item of each window
    names: list[str]  # item ids as text
    keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # shingle size -> sorted hashes, window, offset in it
    sieve: dict[int, np.ndarray]  # shingle size -> by the hash's top 16 bits, whether a key has them


def _windows(items: list[tuple[str, str]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths, words, owner, seen = [], [], [], set()
    texts = pa.array([t for _, t in items], pa.string())
    for block in tb.blocks(texts):
        _, _, hashes, first = block.words(tb.ALNUM)
        for d in range(block.n):
            own = hashes[first[d] : first[d + 1]]
            size = min(window, len(own))
            for s in range(len(own) - size + 1 if size else 0):
                w = own[s : s + size]
                key = (block.lo + d, w.tobytes())
                if key not in seen:
                    seen.add(key)
                    lengths.append(size)
                    words.append(np.concatenate([w, np.zeros(window - size, np.uint64)]))
                    owner.append(block.lo + d)
    return np.array(lengths, np.int64), np.array(words, np.uint64).reshape(-1, window), np.array(owner, np.int64)


def _grams(words: np.ndarray, g: int) -> np.ndarray:
    """Hashes of the shingles of g words of each window, as textblocks.ngrams makes them."""
    m = words.shape[1] - g + 1
    out = words[:, :m].copy()
    for k in range(1, g):
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out += words[:, k : m + k]
    return tb.mix(out)


def _sieve(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 16, bool)
    out[(keys >> np.uint64(48)).astype(np.int64)] = True
    return out


def _probe(hashes: np.ndarray, first: np.ndarray, g: int, keys: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, place in keys) of the document shingles that are keys; keys are sorted and distinct."""
    grams, at = tb.ngrams(hashes, first, g)
    some = np.flatnonzero(sieve[(grams >> np.uint64(48)).astype(np.int64)])
    place = np.searchsorted(keys, grams[some])
    place[place == len(keys)] = 0
    ok = keys[place] == grams[some] if len(keys) else np.zeros(0, bool)
    return at[some[ok]], place[ok]


def shingle_counts(docs: DataFrame, shingles: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """How often each of the given shingles stands in the documents."""
    sieves = {g: _sieve(k) for g, k in shingles.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {g: np.zeros(len(k), np.int64) for g, k in shingles.items()}
        for batch in batches:
            for block in tb.blocks(batch.column(0)):
                _, _, hashes, first = block.words(tb.ALNUM)
                for g, k in shingles.items():
                    _, place = _probe(hashes, first, g, k, sieves[g])
                    sums[g] += np.bincount(place, minlength=len(k))
        for g, n in sums.items():
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), g, np.int32)), pa.array(there), pa.array(n[there])], ["g", "place", "n"])

    rows = docs.select("text").mapInArrow(count, "g int, place long, n long").groupBy("g", "place").agg(F.sum("n").alias("n"))
    return {(r["g"], r["place"]): r["n"] for r in rows.collect()}  # a row a shingle of this block of items


def item_index(docs: DataFrame, items: list[tuple[str, str]], window: int = WINDOW, gram: int = GRAM) -> ItemIndex:
    lengths, words, owner = _windows(items, window)
    size_of = np.minimum(lengths, gram)
    shingles, grams = {}, {}
    for g in np.unique(size_of):
        w = np.flatnonzero(size_of == g)
        h = _grams(words[w], int(g))
        inside = np.arange(h.shape[1])[None, :] <= (lengths[w] - g)[:, None]
        grams[int(g)] = (w, h, inside)
        shingles[int(g)] = np.unique(h[inside])
    counts = shingle_counts(docs, shingles)
    keys, sieve = {}, {}
    for g, (w, h, inside) in grams.items():
        n = np.array([counts.get((g, i), 0) for i in range(len(shingles[g]))], np.int64)
        place = np.minimum(np.searchsorted(shingles[g], h), len(n) - 1)
        rarity = np.where(inside, n[place], np.iinfo(np.int64).max)
        offset = np.argmin(rarity, axis=1)  # the rarest shingle, the first of equals
        key = h[np.arange(len(w)), offset]
        order = np.argsort(key, kind="stable")
        keys[g] = (key[order], w[order], offset[order])
        sieve[g] = _sieve(key)
    return ItemIndex(lengths, words, owner, [n for n, _ in items], keys, sieve)


def _hits(index: ItemIndex, block: tb.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words of the block's documents; hit flag of each word; (document, item) pairs, distinct."""
    _, _, hashes, first = block.words(tb.ALNUM)
    marks = np.zeros(len(hashes) + 1, np.int64)
    pairs = []
    for g, (key, window, offset) in index.keys.items():
        distinct, lo, n = np.unique(key, return_index=True, return_counts=True)
        at, place = _probe(hashes, first, g, distinct, index.sieve[g])
        times = n[place]
        row = np.repeat(lo[place] - np.cumsum(times) + times, times) + np.arange(times.sum())
        w, start = window[row], np.repeat(at, times) - offset[row]
        doc = np.searchsorted(first, np.repeat(at, times), "right") - 1
        ok = (start >= first[doc]) & (start + index.lengths[w] <= first[doc + 1])
        w, start, doc = w[ok], start[ok], doc[ok]
        for k in range(index.words.shape[1]):  # words of the window, one after another
            own = k < index.lengths[w]
            same = ~own | (hashes[np.minimum(start + k, len(hashes) - 1)] == index.words[w, k])
            w, start, doc = w[same], start[same], doc[same]
        np.add.at(marks, start, 1)
        np.add.at(marks, start + index.lengths[w], -1)
        pairs.append(doc * len(index.names) + index.owner[w])
    pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return first, np.cumsum(marks[:-1]) > 0, pairs // max(len(index.names), 1), pairs % max(len(index.names), 1)


def item_blocks(benchmark: DataFrame, most: int = ITEM_BLOCK_BYTES) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """How many blocks there are, and the items, (id as text, text), in lists of
    bounded bytes, each collected when it is asked for. Items without text are left out."""
    items = benchmark.where("text is not null and text <> ''").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = 1 + total // most

    def lists() -> Iterator[list[tuple[str, str]]]:
        for i in range(n):
            own = items if n == 1 else items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == i)
            yield [(r["item_id"], r["text"]) for r in own.collect()]  # about `most` bytes

    return n, lists()


def _judged(words: np.ndarray, hit: np.ndarray) -> np.ndarray:
    return (hit > 0) & (ONE_IN * hit >= words)


def _sha(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _result(words, hit, items: list[set[str]]) -> list[pa.Array]:
    words, hit = np.array(words, np.int64), np.array(hit, np.int64)
    return [pa.array(words), pa.array(hit), pa.array([len(x) for x in items], pa.int64()), pa.array([_sha(x) for x in items], pa.string()), pa.array(_judged(words, hit))]


def _block_hits(index: ItemIndex | None, block: tb.Block) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """First words of the block's documents, hit flag of each word, items of each document."""
    items: list[set[str]] = [set() for _ in range(block.n)]
    if index is None:
        _, _, hashes, first = block.words(tb.ALNUM)
        return first, np.zeros(len(hashes), bool), items
    first, flags, docs, owners = _hits(index, block)
    for d, o in zip(docs.tolist(), owners.tolist(), strict=True):
        items[d].add(index.names[o])
    return first, flags, items


def _in_one_pass(docs: DataFrame, index: ItemIndex | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, hit, items = [], [], []
            for block in tb.blocks(batch.column(1)):
                first, flags, own = _block_hits(shared.value, block)
                total = np.concatenate([[0], np.cumsum(flags)])
                words += np.diff(first).tolist()
                hit += (total[first[1:]] - total[first[:-1]]).tolist()
                items += own
            yield pa.RecordBatch.from_arrays([batch.column(0), *_result(words, hit, items)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id long, {_RESULT}")


def _marks(docs: DataFrame, index: ItemIndex, number: int) -> DataFrame:
    """doc_id, key (of the text), block, hit (a bit a word), items: of the documents that this block of items hits."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hits, names = [], [], []
            for block in tb.blocks(batch.column(1)):
                first, flags, items = _block_hits(shared.value, block)
                for d in range(block.n):
                    if items[d]:
                        rows.append(block.lo + d)
                        hits.append(np.packbits(flags[first[d] : first[d + 1]]).tobytes())
                        names.append(sorted(items[d]))
            own = [batch.column(k).take(pa.array(rows, pa.int64())) for k in (0, 2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(hits, pa.binary()), pa.array(names, pa.list_(pa.string()))], ["doc_id", "key", "hit", "items"])

    found = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    found = written(found.mapInArrow(mark, "doc_id long, key string, hit binary, items array<string>"), "marks")
    shared.unpersist()
    return found.withColumn("block", F.lit(number))


def _in_passes(docs: DataFrame, indexes: Iterator[ItemIndex]) -> DataFrame:
    """doc_id, key and the result of every row, by one pass a block of items."""
    marks = None
    for k, index in enumerate(indexes):
        one = _marks(docs, index, k)
        marks = one if marks is None else marks.unionByName(one)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, hit, items = batch.column(2).to_numpy(), [], []
            for n, own in zip(words.tolist(), batch.column(3), strict=True):
                parts = own.as_py() or []
                flags = np.zeros(n, bool)
                for part in parts:
                    flags |= np.unpackbits(np.frombuffer(part["hit"], np.uint8), count=n).astype(bool)
                hit.append(int(flags.sum()))
                items.append({x for part in parts for x in part["items"]})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_result(words, hit, items)], ["doc_id", "key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = docs.select("doc_id", key.alias("key"), F.coalesce(F.regexp_count(F.lower(F.col("text")), F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"))
    if marks is None:
        together = rows.withColumn("marks", F.lit(None).cast("array<struct<hit:binary,items:array<string>>>"))
    else:
        # a row of a text a block, and blocks are few
        one = marks.groupBy("doc_id", "key", "block").agg(F.first(F.struct("hit", "items")).alias("mark"))
        own = one.groupBy(F.col("doc_id").alias("of"), F.col("key").alias("k")).agg(F.collect_list("mark").alias("marks"))
        together = rows.join(own, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("k")), "left").select("doc_id", "key", "n_words", "marks")
    return together.mapInArrow(join, f"doc_id long, key string, {_RESULT}")


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words. Null item ids are written as an empty string and
    count as one item; equal ids are one item. An item or document without
    words hits nothing. Repeated documents keep their rows; an empty table
    gives no rows. Documents may carry other columns; they are not read.
    """
    n, lists = item_blocks(benchmark)
    if n == 1:
        items = next(lists)
        return _in_one_pass(docs, item_index(docs, items, window) if items else None)
    return _in_passes(docs, (item_index(docs, items, window) for items in lists if items)).drop("key")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, all columns as given, whatever
    their names. Null texts have no words and are clean, as all are if there is no
    item; repeated rows are judged each. An empty table gives no rows."""
    n, lists = item_blocks(benchmark)
    if n == 1:
        items = next(lists)
        if not items:
            return docs
        shared = docs.sparkSession.sparkContext.broadcast(item_index(docs, items, window))

        def clean(texts: pa.Array) -> np.ndarray:
            good = []
            for block in tb.blocks(texts):
                first, flags, _, _ = _hits(shared.value, block)
                total = np.concatenate([[0], np.cumsum(flags)])
                good.append(~_judged(np.diff(first), total[first[1:]] - total[first[:-1]]))
            return np.concatenate(good)

        return rows_where(docs, clean)
    found = _in_passes(docs, (item_index(docs, items, window) for items in lists if items))
    bad = written(found.where("contaminated").select("doc_id", "key").distinct(), "contaminated")
    if bad.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:
        bad = F.broadcast(bad)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    same = F.col("w.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("w.key") == F.col("b.key"))
    return whole.alias("w").join(bad.alias("b"), same, "left_anti").select("row.*")


def oracle_sql(window: int = WINDOW) -> str:
    """scan_documents() by brute force in DuckDB: every run of words against every window."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""
with b as (select coalesce(cast(item_id as string), '') as item, {words} as words from benchmark),
i as (select item, words, least({window}, len(words)) as n from b where len(words) > 0),
iw as (select distinct item, n, array_to_string(words[s + 1 : s + n], ' ') as win from i, unnest(range(len(words) - n + 1)) as r(s)),
d as (select row_number() over () as k, doc_id, {words} as words from documents),
dw as (select k, n, s, array_to_string(words[s + 1 : s + n], ' ') as win from d, (select distinct n from iw) as lens, unnest(range(greatest(len(words) - n + 1, 0))) as r(s)),
h as (select k, dw.n, s, item from dw join iw on dw.n = iw.n and dw.win = iw.win),
c as (select k, count(distinct p) as n_hit from h, unnest(range(s, s + n)) as u(p) group by k),
t as (select k, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as sha from (select distinct k, item from h) group by k)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(sha, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from d left join c using (k) left join t using (k)
"""
