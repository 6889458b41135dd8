"""Token ids as files of fixed-width packed blocks.

Texts are tokenised in ascending doc_id order and each document's ids, with an
end id behind them, are stored with the fewest bits the vocabulary needs. A
block row of the file holds whole documents: their ids and counts, the number
of ids before it in its part (the block offset) and one packed byte string, so
a block is unpacked by a few numpy operations and any document is found
without unpacking the others. Parts are ranges of doc_id written by Spark's
Parquet writer, whose commit protocol makes a lost task harmless.

The library's byte-level model merges inside pre-tokens only, so each distinct
pre-token is encoded by the library once per worker and reused; it is found by a
hash and its bytes are compared. A text that holds one of the tokenizer's added
tokens goes to the library whole. Pre-tokens are cut with numpy over code points,
whose classes are asked of the library's own splitter.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblocks as tb
from .scratch import shared_dir

BLOCK_IDS = 1 << 18
MAX_KNOWN = 1 << 20
_L, _N, _S, _O = 0, 1, 2, 3
#: Code points above are unassigned or private but for tags and variation selectors.
_PROBED = (range(0xD800), range(0xE000, 0x32400), range(0xE0000, 0xE0200))


def char_classes(tokenizer) -> np.ndarray:
    """Letter, number, white space or other, of every code point: whether the
    library's splitter leaves it in one piece with a letter, a digit or a mark."""
    points = np.array([c for r in _PROBED for c in r])
    out = np.full(0x110000, _O, np.uint8)
    kind = np.full(len(points), _S, np.uint8)
    for mark, of in (("a", _L), ("1", _N), ("!", _O)):
        pieces = tokenizer.pre_tokenizer.pre_tokenize_str("".join(f"{mark}{chr(c)}\n" for c in points))
        spans = np.array([at for _, at in pieces], np.int64)
        start = spans[(spans[:, 0] % 3 == 0) & (spans[:, 1] >= spans[:, 0] + 2), 0] // 3
        kind[start] = of
    out[points] = kind
    return out


def pretoken_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the code points of documents; first: each
    document's first code point (one more than documents).

    The rule is the public byte-level split: an English contraction; an
    optional space and a run of letters, of numbers or of other characters; a
    run of white space, whose last character stays apart before text.
    """
    n = len(points)
    cls = classes[points]
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    before = np.empty(n, np.uint8)
    before[:1] = _S
    before[1:] = cls[:-1]
    blank = np.zeros(n, bool)  # a space in the same document just before
    blank[1:] = (points[:-1] == 0x20) & ~edge[1:n]
    after_text = np.zeros(n, bool)  # text in the same document just behind
    after_text[:-1] = (cls[1:] != _S) & ~edge[1:n]
    space = cls == _S
    start = np.where(space, (before != _S) | after_text, (cls != before) & ~blank) | edge[:n]
    # contractions, at apostrophes that start a pre-token
    quote = np.flatnonzero((points == 0x27) & (edge[:n] | ((before != _O) & ~blank)))
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        inside = np.concatenate([~edge[:n], np.zeros(3, bool)])
        a = np.where(inside[quote + 1], padded[quote + 1], 0)
        b = np.where(inside[quote + 1] & inside[quote + 2], padded[quote + 2], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        size = np.where(two, 2, np.where(one, 1, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        two_letters = quote[size == 2]
        start[two_letters + 2] = False
        behind = quote + size + 1
        start[behind[behind < n]] = True
    return np.flatnonzero(start)


def width_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids -> fixed-width bits, least significant first; eight ids are `width` bytes."""
    padded = np.zeros(-(-len(ids) // 8) * 8, np.uint64)
    padded[: len(ids)] = ids
    rows = padded.reshape(-1, 8)
    out = np.zeros((len(rows), width), np.uint8)
    for j in range(width):
        byte = np.zeros(len(rows), np.uint64)
        for k in range(8 * j // width, min(7, (8 * j + 7) // width) + 1):
            shift = k * width - 8 * j
            byte |= rows[:, k] << np.uint64(shift) if shift >= 0 else rows[:, k] >> np.uint64(-shift)
        out[:, j] = byte.astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes, n: int, width: int, start: int = 0) -> np.ndarray:
    """ids start..start+n of a packed block, without unpacking what lies before."""
    skip = start // 8
    rows = np.frombuffer(data, np.uint8)[skip * width : -(-(start + n) // 8) * width].reshape(-1, width).astype(np.uint64)
    out = np.zeros((len(rows), 8), np.uint64)
    for k in range(8):
        for j in range(k * width // 8, (k * width + width - 1) // 8 + 1):
            shift = 8 * j - k * width
            out[:, k] |= rows[:, j] << np.uint64(shift) if shift >= 0 else rows[:, j] >> np.uint64(-shift)
    out &= np.uint64((1 << width) - 1)
    return out.reshape(-1)[start - 8 * skip : start - 8 * skip + n].astype(np.uint32)


class Encoder:
    """A worker's tokenizer and the ids of the pre-tokens it has met."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.classes = char_classes(self.tokenizer) if self.by_piece else None
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.from_, self.long, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        if len(self.keys) + len(keys) > MAX_KNOWN:
            self.clear()
        found = self.library(pieces)
        size = np.array([len(x) for x in found], np.int64)
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], np.uint32)])
        raw = [p.encode() for p in pieces]
        long = np.array([len(x) for x in raw], np.int64)
        from_ = len(self.bytes) + np.cumsum(long) - long
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(raw), np.uint8)])
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        pairs = ((self.keys, keys), (self.at, at), (self.size, size), (self.from_, from_), (self.long, long))
        self.keys, self.at, self.size, self.from_, self.long = (np.concatenate(x)[order] for x in pairs)

    def whole(self, block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
        raw = block.data.tobytes()
        found = self.library([raw[a:b].decode() for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True)])
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def encode(self, block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
        """ids of all documents of the block, and how many each has."""
        raw = block.data.tobytes()
        if not self.by_piece or any(a in raw for a in self.added):
            return self.whole(block)
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(block.n, np.int64)
        lead = np.flatnonzero((block.data & 0xC0) != 0x80)
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        first = np.searchsorted(lead, block.offsets)
        starts = lead[pretoken_starts(points, first, self.classes)]
        ends = np.append(starts[1:], len(raw))
        up, down = tb.powers(len(raw) + 1)
        run = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(tb._BYTE[block.data] * up[: len(raw)], dtype=np.uint64, out=run[1:])
        hashes = tb.mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64) * tb._BASE)
        keys, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        for _ in range(2):
            place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
            new = self.keys[place] != keys if len(self.keys) else np.ones(len(keys), bool)
            if not new.any():
                break
            if len(self.keys) + new.sum() > MAX_KNOWN:
                self.clear()
                new[:] = True
            self.learn(keys[new], [raw[s:e].decode() for s, e in zip(starts[where[new]], ends[where[new]], strict=True)])
        # the hash only finds a piece: its bytes lie in self.bytes where the block has the same ones
        moved = np.repeat(self.from_[place][inverse] - starts, ends - starts)
        moved += np.arange(len(raw))
        if (self.long[place][inverse] != ends - starts).any() or (self.bytes[moved] != block.data).any():
            return self.whole(block)
        at, size = self.at[place][inverse], self.size[place][inverse]
        total = np.cumsum(size)
        ids = self.ids[np.repeat(at - total + size, size) + np.arange(total[-1])]
        per_doc = np.diff(np.concatenate([[0], total])[np.searchsorted(starts, block.offsets)])
        return ids, per_doc


@lru_cache(maxsize=1)
def _encoder(file: str) -> Encoder:
    return Encoder(file)


_FILE_SCHEMA = "part int, block int, first long, n_ids long, width int, least long, most long, doc_ids array<long>, counts array<long>, packed binary"


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, width: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Tokenise every document of docs, append end_id, write the packed file.

    Documents are dealt by ranges of doc_id and sorted inside them (null ids
    first, equal ids by a hash of the text); rows of one id are dealt out too. A null text is empty: its end id alone. An empty
    table writes a file without rows. tokenizer_file is a path every executor
    has, as part of the installed environment.
    """
    if width is None:
        from tokenizers import Tokenizer

        width = width_for(max(Tokenizer.from_file(tokenizer_file).get_vocab_size(), end_id + 1))

    def pack_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = _encoder(tokenizer_file)
        first, number = 0, 0
        held: list[tuple[np.ndarray, np.ndarray, list]] = []

        def row() -> pa.RecordBatch:
            nonlocal first, number, held
            ids = np.concatenate([h[0] for h in held])
            counts = np.concatenate([h[1] for h in held])
            names = [x for h in held for x in h[2]]
            known = [x for x in names if x is not None] or [None]
            numbers = [("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("least", pa.int64()), ("most", pa.int64())]
            out = pa.RecordBatch.from_pylist(
                [{"part": part, "block": number, "first": first, "n_ids": len(ids), "width": width, "least": known[0], "most": known[-1], "doc_ids": names, "counts": counts.tolist(), "packed": pack(ids, width)}],
                schema=pa.schema([*numbers, ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("packed", pa.binary())]),
            )
            first, number, held = first + len(ids), number + 1, []
            return out

        for batch in batches:
            for block in tb.blocks(batch.column(1)):
                ids, counts = encoder.encode(block)
                ids = np.insert(ids, np.cumsum(counts), end_id) if len(counts) else ids
                held.append((ids, counts + 1, batch.column(0).slice(block.lo, block.n).to_pylist()))
                if sum(len(h[0]) for h in held) >= block_ids:
                    yield row()
        if held:
            yield row()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("doc_id"), F.asc("tie"), F.asc("row")]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(pack_part, _FILE_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The file's block rows with `start`, the ids of all blocks before each."""
    rows = spark.read.schema(_FILE_SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row a part
    start, before = {}, 0
    for r in totals:
        start[r["part"]] = before
        before += r["n"]
    parts = spark.createDataFrame(list(start.items()) or [(-1, 0)], "part int, part_start long")
    return rows.join(F.broadcast(parts), "part").withColumn("start", F.col("part_start") + F.col("first")).drop("part_start")


def document_tokens(files: DataFrame, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of each document, unpacked from the file."""

    def open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tokens = unpack(r["packed"], r["n_ids"], r["width"])
                ends = np.cumsum(np.array(r["counts"], np.int64))
                parts = np.split(tokens, ends[:-1])
                columns = [
                    pa.array(r["doc_ids"], pa.int64()),
                    pa.array(r["start"] + ends - np.array(r["counts"], np.int64)),
                    pa.array(r["counts"], pa.int64()),
                    pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
                ]
                if ids:
                    columns.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return files.select("start", "n_ids", "width", "doc_ids", "counts", "packed").mapInArrow(open_blocks, schema)


def seek(files: DataFrame, doc_id: int) -> DataFrame:
    """doc_id, ids: the documents of one id (not null), by random access. Blocks are
    left out by their least and greatest id, without reading their bytes; of a block
    that has the document only its own stretch is unpacked."""

    def open_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for names, counts, width, packed in zip(*batch.columns, strict=True):
                many = counts.values.to_numpy()
                ends = np.cumsum(many)
                for k in np.flatnonzero(names.values.fill_null(doc_id - 1).to_numpy() == doc_id):
                    found.append(unpack(packed.as_py(), int(many[k]), width.as_py(), int(ends[k] - many[k])).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found), pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "ids"])

    there = files.where((F.col("least") <= doc_id) & (F.col("most") >= doc_id))
    return there.select("doc_ids", "counts", "width", "packed").mapInArrow(open_block, "doc_id long, ids array<long>")


def scratch_path(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/verdigris/tokens-{uuid.uuid4().hex}"
