"""Phrase collocations, language by language.

Level by level: texts become sequences of slots (0: none), first of frequent
words, then of frequent pairs of neighbouring slots, so a phrase of n words is
a pair of phrases of n-1 words that overlap, and nothing whose parts are rare is
ever a candidate. Candidates of a level are found with counts that stop at the
least count wanted; a minimal perfect hash is built over them, with their keys
stored to turn others away; mappers replace each pair by its slot and count the
slots in numpy arrays, which are summed as a tree. Cuts are then read by slot.

A hash holds MAX_SLOTS keys at most and a pass over the sequences has HASHES of
them, so what is broadcast, and each task's array, is bounded; more candidates
are handled in further passes. A pair is looked up in one hash of a pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textblocks as tb
from .perfect_hash import PerfectHash
from .scratch import dropped, written

MAX_SLOTS, HASHES = 1 << 19, 4
#: Slots a row of counts has, rows of counts that one task of the tree adds.
CHUNK, FAN_IN = 1 << 14, 16
#: Keys that a mapper holds before it hands them on, places of sequences that it handles together, bytes of texts likewise.
MAX_HELD, PLACES, BLOCK_BYTES = 1 << 20, 1 << 19, (1 << 20) - 1
#: Parts that a language's candidates are ranked in before the last ranking.
RANK_PARTS = 64

_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09]] = False
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"]] = True
_BREAK[0x0A:0x0E] = True
_WORD &= ~_BREAK


def _lang_hash(lang: str) -> np.uint64:
    h = np.array([len(lang)], np.uint64)
    for byte in lang.encode():
        h = tb.mix(h * np.uint64(257) + np.uint64(byte))
    return tb.mix(h)[0]


def _words(block: tb.Block, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and key (of language and word) of each word, and its document."""
    starts, ends, hashes, first = block.words(_WORD)
    doc = np.repeat(np.arange(block.n), np.diff(first))
    return starts, ends, tb.mix(hashes ^ langs[doc]), doc


def _distinct_langs(langs: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = langs.fill_null("und").dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def _same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[starts:ends] is other[at:at+size], for each place."""
    long = ends - starts
    same = long == size
    long = np.where(same, long, 0)
    total = np.cumsum(long)
    inside = np.arange(total[-1] if len(total) else 0) - np.repeat(total - long, long)
    differ = data[np.repeat(starts, long) + inside] != other[np.repeat(at, long) + inside]
    # places with a difference
    where = np.repeat(np.arange(len(starts)), long)[differ]
    same[where] = False
    return same


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, f: all occurrences of every word of docs (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, names = _distinct_langs(batch.column(0))
            hashes = np.array([_lang_hash(n) for n in names], np.uint64)
            for block in tb.blocks(batch.column(1), BLOCK_BYTES):
                own = code[block.lo : block.hi]
                starts, ends, keys, doc = _words(block, hashes[own])
                if not len(keys):
                    continue
                low = tb.LOWER[block.data]
                _, first, again, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
                one = first[again]
                if not (_same_bytes(low, starts, ends, low, starts[one], (ends - starts)[one]) & (own[doc] == own[doc[one]])).all():
                    first, n = np.arange(len(keys)), np.ones(len(keys), np.int64)  # two words share a key: each place for itself
                size = (ends - starts)[first]
                offsets = np.concatenate([[0], np.cumsum(size)])
                chars = low[np.repeat(starts[first] - offsets[:-1], size) + np.arange(offsets[-1])]
                words = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(chars.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(own[doc[first]])), words, pa.array(n, pa.int64())], ["lang", "word", "f"])

    return docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


class _Vocabulary:
    """Frequent words of one round: their keys, and their bytes and languages in the order of their slots."""

    def __init__(self, langs: list[str], words: list[str], base: int):
        hashes = {lang: _lang_hash(lang) for lang in sorted(set(langs))}
        self.langs = {lang: i for i, lang in enumerate(hashes)}
        data = [w.encode() for w in words]
        self.size = np.array([len(d) for d in data], np.int64)
        self.bytes = np.frombuffer(b"".join(data), np.uint8)
        self.start = np.cumsum(self.size) - self.size
        block = tb.Block(self.bytes, np.concatenate([[0], np.cumsum(self.size)]), 0, len(data))
        keys = _words(block, np.array([hashes[x] for x in langs], np.uint64))[2]
        keys, first = np.unique(keys, return_index=True)
        #: words whose key another one has; they are for another round
        self.others = np.setdiff1d(np.arange(len(words)), first)
        self.hash = PerfectHash(keys)
        self.chosen = first[self.hash.order]
        self.lang = np.array([self.langs[x] for x in langs], np.int64)[self.chosen] if words else np.zeros(0, np.int64)
        self.size, self.start = self.size[self.chosen], self.start[self.chosen]
        self.base = base

    def find(self, block: tb.Block, code: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all words of a block in its sequence, their ids (0: none), and where each document's sequence starts."""
        hashes = np.array([_lang_hash(n) for n in names], np.uint64)
        own = np.array([self.langs.get(n, -1) for n in names], np.int64)
        starts, ends, keys, doc = _words(block, hashes[code])
        slot = self.hash.slots(keys)
        hit = np.flatnonzero(slot >= 0)
        at, low = slot[hit], tb.LOWER[block.data]
        good = _same_bytes(low, starts[hit], ends[hit], self.bytes, self.start[at], self.size[at]) & (self.lang[at] == own[code[doc[hit]]])
        ids = np.zeros(len(keys), np.int64)
        ids[hit[good]] = self.base + at[good]
        # a 0 between the words of two pieces, and one behind each document
        breaks = np.concatenate([[0], np.cumsum(_BREAK[block.data])])[starts]
        gap = np.zeros(len(starts), np.int64)
        gap[1:] = (np.diff(breaks) > 0) & (doc[1:] == doc[:-1])
        place = np.arange(len(starts)) + np.cumsum(gap) + doc
        length = np.bincount(doc, minlength=block.n) + np.bincount(doc, weights=gap, minlength=block.n).astype(np.int64) + 1
        return place, ids, np.concatenate([[0], np.cumsum(length)])


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _encode(docs: DataFrame, shared: Broadcast, last: bool) -> DataFrame:
    """docs (lang, text, seq or null) with the ids of this round's words put into seq; without texts after the last round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            code, names = _distinct_langs(batch.column(0))
            for block in tb.blocks(batch.column(1), BLOCK_BYTES):
                place, ids, offsets = own.find(block, code[block.lo : block.hi], names)
                seq = np.zeros(offsets[-1], np.uint32)
                seq[place] = ids
                before = batch.column(2).slice(block.lo, block.n)
                if not before.null_count:
                    seq |= np.frombuffer(b"".join(before.to_pylist()), np.uint32)
                out = _binary(seq, offsets * 4)
                yield pa.RecordBatch.from_arrays([out] if last else [batch.column(0).slice(block.lo, block.n), batch.column(1).slice(block.lo, block.n), out], ["seq"] if last else ["lang", "text", "seq"])

    return docs.mapInArrow(run, "seq binary" if last else "lang string, text string, seq binary")


def _sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a batch one behind the other, and their offsets in bytes."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint32), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.uint32), offsets - offsets[0]


def _pairs(seq: np.ndarray) -> np.ndarray:
    """The key of each place with the next one, 0 where either has no slot."""
    out = np.zeros(len(seq), np.uint64)
    both = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))
    out[both] = seq[both].astype(np.uint64) << np.uint64(32) | seq[both + 1].astype(np.uint64)
    return out


def _portions(seq: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """First place and keys of portions of a sequence."""
    for lo in range(0, len(seq), PLACES):
        yield lo, _pairs(seq[lo : lo + PLACES + 1])[:PLACES]


def _candidates(seqs: DataFrame, least: int) -> DataFrame:
    """key: the pairs of neighbouring slots that occur `least` times; each mapper's counts stop there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def together() -> tuple[np.ndarray, np.ndarray]:
            keys, again = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.minimum(np.bincount(again, weights=np.concatenate([n for _, n in held])), least).astype(np.int32)

        def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])

        for batch in batches:
            for _, pairs in _portions(_sequence(batch.column(0))[0]):
                keys, n = np.unique(pairs[pairs > 0], return_counts=True)
                held.append((keys, np.minimum(n, least).astype(np.int32)))
                if sum(len(k) for k, _ in held) > MAX_HELD:
                    held = [together()]
                    if len(held[0][0]) > MAX_HELD // 2:
                        yield rows(*held.pop())
        if held:
            yield rows(*together())

    found = seqs.mapInArrow(run, "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= least).select("key")


class _Keys:
    """A round's candidates: their hash and their first id."""

    def __init__(self, keys: np.ndarray, base: int):
        self.hash, self.base = PerfectHash(keys), base
        self.hash.order = None  # not for broadcasting


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _round_of(keys: np.ndarray, rounds: int) -> np.ndarray:
    """Spark's pmod(xxhash64(key), rounds)."""
    a, b, c, d = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63))
    h = np.uint64(0x27D4EB2F165667C5 + 42 + 8) ^ _turned(keys * b, 31) * a
    h = _turned(h, 27) * a + d
    h = (h ^ h >> np.uint64(33)) * b
    h = (h ^ h >> np.uint64(29)) * c
    return (h ^ h >> np.uint64(32)).view(np.int64) % rounds


def _relabel(seqs: DataFrame, shared: Broadcast, first: int, rounds: int) -> DataFrame:
    """seqs (seq, next or null) with the ids of the pairs of this pass's rounds, from the first on, put into next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            seq, offsets = _sequence(batch.column(0))
            out = np.zeros(len(seq), np.uint32)
            for lo, pairs in _portions(seq):
                there = np.flatnonzero(pairs)
                of = _round_of(pairs[there], rounds)
                for k, keys in enumerate(own, first):
                    at = there[of == k]
                    slots = keys.hash.slots(pairs[at])
                    out[lo + at] = np.where(slots >= 0, slots + keys.base, 0)
            if not batch.column(1).null_count:
                out |= _sequence(batch.column(1))[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(out, offsets)], ["seq", "next"])

    return seqs.mapInArrow(run, "seq binary, next binary")


def _least_kind(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _array(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // size}").astype(np.int64)


def _slot_counts(seqs: DataFrame, base: int, size: int) -> DataFrame:
    """chunk, counts (8-byte integers) of the ids base to base+size-1 in seqs
    (seq): an array a task, added FAN_IN at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(size, np.int64)
        for batch in batches:
            seq = _sequence(batch.column(0))[0]
            seq = seq[(seq >= base) & (seq < base + size)] - np.uint32(base)
            counts += np.bincount(seq, minlength=size)
        at = [i for i in range(0, size, CHUNK) if counts[i : i + CHUNK].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i // CHUNK for i in at], pa.int32()), pa.array([TaskContext.get().partitionId()] * len(at), pa.int32()), pa.array([_least_kind(counts[i : i + CHUNK]).tobytes() for i in at], pa.binary())],
            ["chunk", "task", "counts"],
        )

    def add(group: pa.Table) -> pa.Table:
        chunk, task = group.column("chunk")[0].as_py(), group.column("node")[0].as_py()
        n = min(CHUNK, size - chunk * CHUNK)
        total = sum(_array(c.as_py(), n) for c in group.column("counts"))
        return pa.table({"chunk": pa.array([chunk], pa.int32()), "task": pa.array([task], pa.int32()), "counts": pa.array([_least_kind(total).tobytes()], pa.binary())})

    schema = "chunk int, task int, counts binary"
    out, tasks = seqs.mapInArrow(run, schema), seqs.rdd.getNumPartitions()
    while tasks > 1:
        out = out.withColumn("node", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("chunk", "node").applyInArrow(add, schema)
        tasks = -(-tasks // FAN_IN)
    return out.select("chunk", "counts")


def _by_slot(counts: DataFrame, base: int, size: int, keys: np.ndarray) -> DataFrame:
    """slot, a, left, right: the summed arrays, read with the stored keys."""
    spark = counts.sparkSession
    stored = [(i // CHUNK, bytearray(keys[i : i + CHUNK].tobytes())) for i in range(0, size, CHUNK)]
    table = spark.createDataFrame(stored, "of int, keys binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, counted, known in zip(*batch.columns, strict=True):
                key = np.frombuffer(known.as_py(), np.uint64)
                slot = base + chunk.as_py() * CHUNK + np.arange(len(key))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), pa.array(_array(counted.as_py(), len(key))), pa.array((key >> np.uint64(32)).astype(np.int64)), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64))],
                    ["slot", "a", "left", "right"],
                )

    joined = counts.join(table, F.col("chunk") == F.col("of")).select("chunk", "counts", "keys")
    return joined.mapInArrow(run, "slot long, a long, left long, right long")


def _rounds(n: int, most: int) -> int:
    return max(1, -(-n // most))


def _vocabularies(frequent: DataFrame, most: int) -> Iterator[tuple[_Vocabulary, pa.Table]]:
    """The frequent words, a round at a time: at most about `most` of them each, with their rows (slot, lang, phrase, a)."""
    rounds, base, others = _rounds(frequent.count(), most), 1, None
    for k in range(rounds):
        rows = frequent.where(F.pmod(F.xxhash64("lang", "word"), F.lit(rounds)) == k).select("lang", "word", "f").toArrow()
        while True:
            if others is not None and k == rounds - 1:
                rows, others = pa.concat_tables([rows, others]), None
            made = _Vocabulary(rows.column("lang").to_pylist(), rows.column("word").to_pylist(), base)
            n = len(made.hash)
            named = rows.take(pa.array(made.chosen))
            yield made, pa.table({"slot": pa.array(np.arange(base, base + n)), "lang": named.column("lang"), "phrase": named.column("word"), "a": named.column("f")})
            base = _below_limit(base + n)
            if len(made.others):
                rest = rows.take(pa.array(made.others))
                others = rest if others is None else pa.concat_tables([others, rest])
            if k < rounds - 1 or others is None:
                break
            rows = rows.slice(0, 0)


def _below_limit(base: int) -> int:
    if base >= 1 << 32:
        raise ValueError("more than 2**32 phrases of one length")
    return base


def find_phrases(docs: DataFrame, least: int = 10, max_words: int = 3, cover_percent: int = 50, top: int = 2000, max_slots: int = MAX_SLOTS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases
    of 2 to max_words words that occur `least` times.

    Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` and then into
    words `[^\\x20\\x09]+`. A null language is `und`, a null text empty. Repeated
    rows count each. A phrase's score is that of its worst cut into l and r; it
    goes if a longer candidate that contains it occurs cover_percent as often.
    Ties go by frequency, then by the phrase's bytes. No row, or no phrase that
    is frequent, gives an empty table; other columns are left out, whatever
    their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = written(count_words(texts), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent, known = words.where(F.col("f") >= least), []
    table: DataFrame = texts.withColumn("seq", F.lit(None).cast("binary"))
    scratch, waiting = [words], None

    def encode(vocabulary: _Vocabulary, last: bool) -> None:
        nonlocal table
        shared = spark.sparkContext.broadcast(vocabulary)
        before, table = table, written(_encode(table, shared, last), "sequences")
        shared.destroy()
        dropped(before)

    for vocabulary, rows in _vocabularies(frequent, max_slots):
        if waiting is not None:
            encode(waiting, False)
        waiting = vocabulary
        known.append(written(spark.createDataFrame(rows, "slot long, lang string, phrase string, a long"), "slots"))
    encode(waiting, True)
    level = known[0]
    for more in known[1:]:
        level = level.unionByName(more)
    scratch += known
    none = F.lit(None).cast("long")
    levels = [level.select("slot", "lang", "phrase", "a", none.alias("left"), none.alias("right"))]
    for _ in range(2, max_words + 1):
        candidates = written(_candidates(table, least), "candidates")
        rounds, base, counted = _rounds(candidates.count(), max_slots), 1, []
        seqs = table.select("seq", F.lit(None).cast("binary").alias("next"))
        for first in range(0, rounds, HASHES):
            made, start = [], base
            for k in range(first, min(first + HASHES, rounds)):
                keys = candidates.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k).toArrow().column("key").to_numpy().astype(np.int64).view(np.uint64)
                made.append(_Keys(np.sort(keys), base))
                base = _below_limit(base + len(keys))
            shared = spark.sparkContext.broadcast(made)
            before, seqs = seqs, written(_relabel(seqs, shared, first, rounds), "sequences")
            shared.destroy()
            dropped(before)
            if base > start:
                slots = _slot_counts(seqs.select(F.col("next").alias("seq")), start, base - start)
                counted.append(written(_by_slot(slots, start, base - start, np.concatenate([m.hash.keys for m in made])), "slots"))
        dropped(candidates, table)
        table = seqs.select(F.col("next").alias("seq"))
        table._verdigris_path = seqs._verdigris_path
        slots = counted[0] if counted else spark.createDataFrame([], "slot long, a long, left long, right long")
        for more in counted[1:]:
            slots = slots.unionByName(more)
        scratch += counted
        # the phrase: all of the left part and the last word of the right one
        left = levels[-1].select(F.col("slot").alias("left"), "lang", F.col("phrase").alias("start"))
        right = levels[-1].select(F.col("slot").alias("right"), F.element_at(F.split("phrase", " "), -1).alias("end"))
        named = slots.join(left, "left").join(right, "right").select("slot", "lang", F.concat_ws(" ", "start", "end").alias("phrase"), "a", "left", "right")
        levels.append(written(named, "phrases"))
        scratch.append(levels[-1])
    dropped(table)
    ranked = _ranked(_scored(levels, cover_percent), top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    ranked._verdigris_scratch = scratch
    return ranked


def _scored(levels: list[DataFrame], cover_percent: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one covers."""
    out = None
    for k in range(1, len(levels)):
        own = levels[k].select("slot", "lang", "phrase", "a", "left", "right", F.col("left").alias("l_at"), F.col("right").alias("r_at"), F.array().cast("array<bigint>").alias("starts"), F.array().cast("array<bigint>").alias("ends"))
        # from the level below down to words: counts of ever shorter starts, ends and of what is cut off them
        for below in range(k - 1, -1, -1):
            left = levels[below].select(F.col("slot").alias("l_at"), F.col("a").alias("l_a"), F.col("left").alias("l_next"))
            right = levels[below].select(F.col("slot").alias("r_at"), F.col("a").alias("r_a"), F.col("right").alias("r_next"))
            own = own.join(left, "l_at").join(right, "r_at")
            own = own.select("slot", "lang", "phrase", "a", "left", "right", F.col("l_next").alias("l_at"), F.col("r_next").alias("r_at"), F.array_append("starts", F.col("l_a")).alias("starts"), F.array_append("ends", F.col("r_a")).alias("ends"))
        # starts: of k words down to 1; ends: likewise. The cut after i words pairs the start of i with the end of k+1-i.
        wide = lambda c: c.cast("decimal(19,0)")
        cuts = [F.struct(_share(wide(F.col("a")), wide(F.col("starts")[k - i]), wide(F.col("ends")[i - 1])).alias("score"), F.lit(i).alias("after"), F.col("starts")[k - i].alias("l"), F.col("ends")[i - 1].alias("r")) for i in range(1, k + 1)]
        own = own.withColumn("cut", F.array_min(F.array(*cuts)))
        if k + 1 < len(levels):
            longer = levels[k + 1].select(F.explode(F.array("left", "right")).alias("of"), F.col("a").alias("longer"))
            longer = longer.groupBy("of").agg(F.max("longer").alias("longer"))
            own = own.join(longer, F.col("slot") == F.col("of"), "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover_percent * F.col("a")))
        own = own.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
        out = own if out is None else out.unionByName(own)
    return out


def _share(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals of 38 digits, so exactly for counts up to 10**15."""
    return F.call_function("div", a * a * F.lit(1000000).cast("decimal(7,0)"), left * right)


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = Window.partitionBy("lang", "part").orderBy(*order)
    first = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    return first.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def oracle_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (
  SELECT lang, row_number() OVER () AS piece_no, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), words AS (
  SELECT lang, piece_no, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM lists
), places AS (
  SELECT lang, w1, lead(w1) OVER piece AS w2, lead(w1, 2) OVER piece AS w3 FROM words WINDOW piece AS (PARTITION BY piece_no ORDER BY i)
), phrases AS (
  SELECT lang, 1 AS k, w1 AS phrase FROM places UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM places WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM places WHERE w3 IS NOT NULL
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM phrases GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, j.j, l.f AS l, r.f AS r, ((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM candidates c JOIN (VALUES (1), (2)) AS j(j) ON j.j < c.k
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : j.j], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j.j + 1 : c.k], ' ')
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM cuts
), longer AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM candidates WHERE k = 3
), covers AS (
  SELECT lang, phrase, max(a) AS most FROM longer GROUP BY ALL
), kept AS (
  SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score FROM best b LEFT JOIN covers c ON c.lang = b.lang AND c.phrase = b.phrase
  WHERE b.nth = 1 AND (c.most IS NULL OR 100 * c.most < 50 * b.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
