"""Removal of repeated byte strings by blockwise suffix sorting over a cover.

Every 50-byte string that also starts in a document with a smaller doc_id is
removed. To find them, suffixes are sorted one bucket at a time, and long ties
are resolved by names that were computed before, so memory is that of a bucket.

The cover sample is content-defined. A difference cover of positions modulo v
gives two equal strings a common offset inside v bytes, at 3/sqrt(v) or more of
all positions; here a position is in the sample if the hash of its KMER bytes
is the least in some 50-byte window. Equal windows have their least hash at the
same offset, so they meet in the sample in the same way, with a third of the
positions. A sample suffix's bucket is its first KMER bytes.

1. A sample suffix covers a run of windows, those whose least hash it is; the
   run's bytes have a name (a 56-bit hash). Suffixes are dealt out by bucket
   and sorted by name and document. A run whose name came before in the bucket,
   from a smaller document, is repeated whole: the long tie is resolved by the
   name. If a bucket holds several names, the first run of each is undecided.
2. The windows of undecided runs, a few hundredths of all, are suffixes of
   their own, dealt out and sorted by a 96-bit hash of their 50 bytes and document;
   all but those of the smallest document are repeated.

Only the least document of a name or window can leave the others undecided. So a
task settles its own rows first: what a smaller document of the same task has is
repeated, and is dealt out anywhere; of the rest each name goes out once a task,
with a mark if its document has it at several places. However often a string
stands in a corpus, no task gets more of it than there are tasks.

Documents get their marks by id, find the other places of marked strings among
their own bytes, and cut themselves. Only hashes and positions are sorted; texts
move twice, to meet their marks. Hashes are salted anew in every run.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .scratch import written

LENGTH = 50
KMER = 24
_NAME_BITS = np.uint64((1 << 24) - 1)
#: A place: 2**31 * start + windows; that the document has the string elsewhere too; that it is settled.
_AT, _MORE, _SETTLED = 1 << 31, 1 << 61, 1 << 62
_PLACE = _MORE - 1
#: Rows that a task settles among themselves at a time.
CHUNK = 1 << 20
_LOW = np.int64(0xFFFFFFFF)


def new_salt() -> int:
    return int.from_bytes(os.urandom(8), "little")


class Hashes:
    """Hashes of byte strings of a block."""

    def __init__(self, data: np.ndarray, salt: int):
        n = len(data)
        up, self.down = tb.powers(n + 1)
        codes = tb.mix(tb._BYTE + np.array([salt], np.uint64))
        self.run = np.zeros(n + 1, np.uint64)
        np.cumsum(codes[data] * up[:n], dtype=np.uint64, out=self.run[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return tb.mix((self.run[end] - self.run[start]) * self.down[start] + (end - start).astype(np.uint64) * tb._BASE)


def runs(block: tb.Block, salt: int, length: int = LENGTH, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one least hash: document, first and last window's
    start (in the block), that hash (the bucket), name of the run's bytes."""
    n = len(block.data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = Hashes(block.data, salt)
    at = np.arange(n - kmer + 1)
    least, span, wide = hashes.of(at, at + kmer), 1, length - kmer + 1
    while 2 * span <= wide:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    doc = np.repeat(np.arange(block.n), np.maximum(np.diff(block.offsets) - length + 1, 0))
    size = np.maximum(np.diff(block.offsets) - length + 1, 0)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + block.offsets[doc]
    own = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(start)) - 1
    if not len(start):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    return doc[lo], start[lo], start[hi], own[lo], hashes.of(start[lo], start[hi] + length)


def text_tags(docs: DataFrame) -> DataFrame:
    """doc_id, tag (of the text, so that different texts under one id stay apart), text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.hash(text).alias("tag"), text.alias("text"))


_ROWS = "key long, mark long, doc_id long, at long"


def settle(key: np.ndarray, mark: np.ndarray, ids: pa.Array, at: np.ndarray) -> pa.RecordBatch:
    """Rows of strings (key, and the upper half of mark; the lower is the text's tag)
    -> what other tasks need of them: strings of larger documents settled, under
    keys that spread them; of the least document one row a text, marked if there were more."""
    doc = _ids(ids)
    order = np.argsort(key, kind="stable")
    name = mark >> 32
    if ((key[order[1:]] == key[order[:-1]]) & (name[order[1:]] != name[order[:-1]])).any():
        order = np.lexsort((name, key))
    k, m = key[order], name[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(doc[order], np.flatnonzero(new)) if len(order) else doc
    settled = np.zeros(len(order), bool)
    settled[order] = doc[order] > least[group]
    left = order[~settled[order]]
    of, tag = group[~settled[order]], mark[left] & _LOW
    by = np.lexsort((tag, of))
    first = np.ones(len(by), bool)
    first[1:] = (of[by[1:]] != of[by[:-1]]) | (tag[by[1:]] != tag[by[:-1]])
    times = np.diff(np.append(np.flatnonzero(first), len(by)))
    one = left[by[first]]
    settled[one] = False
    kept = settled.copy()
    kept[one] = True
    flags = np.where(settled, _SETTLED, 0)
    flags[one] = np.where(times > 1, _MORE, 0)
    spread = tb.mix(doc.view(np.uint64) * tb._BASE + at.view(np.uint64))
    take = np.flatnonzero(kept)  # in the texts' order, in which rows are much like their neighbours
    out = (np.where(settled, spread, key)[take].view(np.int64), mark[take], ids.take(pa.array(take)), (at | flags)[take])
    return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in out], ["key", "mark", "doc_id", "at"])


def _chunks(parts: Iterator[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def done() -> pa.RecordBatch:
        key, mark, at = (np.concatenate([h[i] for h in held]) for i in (0, 1, 3))
        return settle(key, mark, pa.concat_arrays([h[2] for h in held]), at)

    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= CHUNK:
            yield done()
            held, size = [], 0
    if held:
        yield done()


def _mark(name: np.ndarray, tag: pa.Array) -> np.ndarray:
    """32 bits of a name above the tag."""
    return ((name >> np.uint64(32)).astype(np.int64) << 32) | (tag.to_numpy(zero_copy_only=False).astype(np.int64) & _LOW)


def sample_suffixes(tagged: DataFrame, salt: int, length: int, kmer: int) -> DataFrame:
    """The runs of all documents. A key is 40 bits of the bucket's hash and 24 of
    the name's, so rows are few bytes; the mark has 32 bits more of the name."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for block in tb.blocks(batch.column(2)):
                doc, lo, hi, bucket, name = runs(block, salt, length, kmer)
                take = pa.array(doc + block.lo)
                key = (tb.mix(bucket) & ~_NAME_BITS) | (name & _NAME_BITS)
                yield key, _mark(name, batch.column(1).take(take)), batch.column(0).take(take), (lo - block.offsets[doc]) * _AT + hi - lo + 1

    return tagged.where(F.octet_length("text") >= length).mapInArrow(lambda b: _chunks(cut(b)), _ROWS)


def _ids(column: pa.Array) -> np.ndarray:
    """Ids in order; null ids, which sort first, as the least."""
    return column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def _out(batch: pa.RecordBatch, rows: np.ndarray, repeated: np.ndarray) -> pa.RecordBatch:
    """doc_id, tag, at, decided of some rows."""
    take = pa.array(rows)
    tag = (batch.column(1).to_numpy()[rows] & _LOW).astype(np.uint32).view(np.int32)
    return pa.RecordBatch.from_arrays([batch.column(2).take(take), pa.array(tag), pa.array(batch.column(3).to_numpy()[rows] & ~np.int64(_SETTLED)), pa.array(repeated[rows])], ["doc_id", "tag", "at", "decided"])


class _Names:
    """First documents of names in sorted batches, each carried over to the next batch."""

    def __init__(self) -> None:
        self.key, self.name, self.doc = None, None, 0

    def firsts(self, key: np.ndarray, name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a row begins a name, and the document with which its name began."""
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        new[0] = self.key != key[0] or self.name != name[0]
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first = np.where(at < 0, self.doc, doc[np.maximum(at, 0)])
        self.key, self.name, self.doc = key[-1], name[-1], first[-1]
        return new, first


def scan_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted sample suffixes -> doc_id, tag, at, decided (repeated) or not.

    Held from batch to batch are the last bucket's names and documents so far (one,
    or several) and, until both are several, the first run of what it has.
    """
    known = _Names()
    bucket_of, names, low, high, waiting = None, 0, 0, 0, []
    for batch in batches:
        settled = (batch.column(3).to_numpy() & _SETTLED) != 0
        if settled.any():
            yield _out(batch, np.flatnonzero(settled), settled)
            batch = batch.filter(pa.array(~settled))
        if not batch.num_rows:
            continue
        key, name, doc = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy() >> 32, _ids(batch.column(2))
        bucket = key & ~_NAME_BITS
        new, first = known.firsts(key, name, doc)
        repeated = doc > first
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        of = np.cumsum(np.concatenate([[True], bucket[1:] != bucket[:-1]])) - 1
        many, least, most = np.add.reduceat(new.astype(np.int64), starts), np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
        if bucket[0] == bucket_of:
            many[0], least[0], most[0] = many[0] + names, min(least[0], low), max(most[0], high)
        else:
            waiting = []
        several = (many > 1) & (least != most)
        if several[0]:
            yield from waiting
            waiting = []
        yield _out(batch, np.flatnonzero(repeated | several[of]), repeated)
        if len(starts) > 1:
            waiting = []
        bucket_of, names, low, high = bucket[-1], many[-1], least[-1], most[-1]
        if not several[-1]:
            waiting.append(_out(batch, np.flatnonzero(~repeated & (of == of[-1])), repeated))


def open_windows(batches: Iterator[pa.RecordBatch], salt: int, length: int) -> Iterator[tuple]:
    """(doc_id, tag, text, marks) -> every window of the marked runs."""
    for batch in batches:
        marks = batch.column(3)
        for block in tb.blocks(batch.column(2)):
            hashes, others = Hashes(block.data, salt), Hashes(block.data, salt ^ 1)
            own = marks.slice(block.lo, block.n)
            many = own.value_lengths().to_numpy(zero_copy_only=False)
            places = own.flatten().to_numpy()
            first, count = np.divmod(places & _PLACE, _AT)
            doc = np.repeat(np.repeat(np.arange(block.n), many), count)
            start = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            there = start + block.offsets[doc]
            take = pa.array(doc + block.lo)
            key, name = (h.of(there, there + length) for h in (hashes, others))
            yield key, _mark(name, batch.column(1).take(take)), batch.column(0).take(take), start * _AT + 1 | np.repeat(places & _MORE, count)


def scan_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted windows -> doc_id, tag, at of the repeated ones."""
    known = _Names()
    for batch in batches:
        settled = (batch.column(3).to_numpy() & _SETTLED) != 0
        if settled.any():
            yield _out(batch, np.flatnonzero(settled), settled)
            batch = batch.filter(pa.array(~settled))
        if batch.num_rows:
            doc = _ids(batch.column(2))
            _, first = known.firsts(batch.column(0).to_numpy(), batch.column(1).to_numpy() >> 32, doc)
            repeated = doc > first
            yield _out(batch, np.flatnonzero(repeated), repeated)


def _with_marks(tagged: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """doc_id, tag, text and the document's marks, an array of `at`."""
    own = marks.groupBy(F.col("doc_id").alias("m_id"), F.col("tag").alias("m_tag")).agg(F.collect_list("at").alias("marks"))
    out = tagged.join(own, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("tag") == F.col("m_tag")), how)
    return out.select("doc_id", "tag", "text", F.coalesce("marks", F.array().cast("array<long>")).alias("marks"))


_FOUND = "doc_id long, tag int, at long, decided boolean"


def _sorted(rows: DataFrame, deal) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, deal).sortWithinPartitions("key", F.shiftright("mark", 32), F.asc_nulls_first("doc_id"))


def repeated_windows(docs: DataFrame, salt: int, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """doc_id, tag, at: runs of repeated windows, at = 2**31 * start + how many windows, and _MORE."""
    tagged = text_tags(docs)
    suffixes = _sorted(sample_suffixes(tagged, salt, length, kmer), F.shiftrightunsigned("key", 24))
    found = written(suffixes.mapInArrow(scan_buckets, _FOUND), "runs")
    undecided = _with_marks(tagged, found.where("not decided"), "inner")
    windows = undecided.mapInArrow(lambda b: _chunks(open_windows(b, salt, length)), _ROWS)
    single = written(_sorted(windows, F.col("key")).mapInArrow(scan_windows, _FOUND), "windows")
    return found.where("decided").unionByName(single).drop("decided")


def other_places(data: np.ndarray, hashes: np.ndarray, start: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of one document that equal one of the given runs' windows; hashes are those of all its windows."""
    own = np.repeat(start - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    known, at = np.unique(hashes[own], return_index=True)
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    like = np.flatnonzero(known[place] == hashes)
    model = own[at[place[like]]]
    for k in range(length):
        same = data[like + k] == data[model + k]
        like, model = like[same], model[same]
    return like


def remove_repeats(docs: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    Null texts are empty. Rows with one doc_id, repeated ones among them, are
    one document and do not remove each other's strings; null ids are one
    document, before all others. A text shorter than `length` bytes loses
    nothing. An empty table gives no rows. Other columns are not read.
    """
    salt = new_salt()
    repeated = repeated_windows(docs, salt, length, kmer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column(2)):
                own = batch.column(3).slice(block.lo, block.n)
                many = own.value_lengths().to_numpy(zero_copy_only=False)
                places = own.flatten().to_numpy()
                start, windows = np.divmod(places & _PLACE, _AT)
                doc = np.repeat(np.arange(block.n), many)
                more = np.flatnonzero(places & _MORE)
                if len(more):
                    hashes, found = Hashes(block.data, salt), []
                    for d in np.unique(doc[more]):
                        lo, hi = block.offsets[d], block.offsets[d + 1]
                        at = np.arange(lo, hi - length + 1)
                        mine = more[doc[more] == d]
                        found.append(lo + other_places(block.data[lo:hi], hashes.of(at, at + length), start[mine], windows[mine], length))
                    extra = np.concatenate(found)
                    start, windows = np.concatenate([start + block.offsets[doc], extra]), np.concatenate([windows, np.ones(len(extra), np.int64)])
                else:
                    start = start + block.offsets[doc]
                steps = np.zeros(len(block.data) + 1, np.int64)
                np.add.at(steps, start, 1)
                np.add.at(steps, start + windows + length - 1, -1)
                gone = np.cumsum(steps[:-1]) > 0
                before = np.zeros(len(gone), bool)
                before[1:] = gone[:-1]
                before[block.offsets[:-1][block.offsets[:-1] < len(gone)]] = False
                total = np.concatenate([[0], np.cumsum(gone)])[block.offsets]
                spans = np.concatenate([[0], np.cumsum(gone & ~before)])[block.offsets]
                kept = [block.data[a:b][~gone[a:b]].tobytes() for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.lo, block.n),
                        pa.array(np.diff(block.offsets)),
                        pa.array(np.diff(total)),
                        pa.array(np.diff(spans)),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                        pa.array(kept, pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    marked = _with_marks(text_tags(docs), repeated, "left")
    return marked.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
