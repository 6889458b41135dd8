"""Byte-level BPE as a transducer that is made deterministic as texts ask for it.

The merges of a rank file are compiled once into a trie of the tokens that
merging can make. A sequence of such tokens is what merging gives if and only
if every two neighbours are what merging gives for their own bytes, so reading
a piece byte by byte is a finite-state matter: at each byte some tokens are
half read, each behind the one sequence that ends where it began. A state of
the transducer is that set; a move tells the token with which a text that ended
there would end. States and moves are made when a text first needs them, kept
in a table of bounded size, and forgotten together when it is full. Tokens are
emitted up to the place where the sequences of all that is half read meet; how
far that lags behind is bounded by the tokens' length and the ties among them,
not by the text.

Decoding is the way back: bytes by id, in any portions, with a state machine of
UTF-8 that tells whole characters from a tail that the next ids complete.
"""

from __future__ import annotations

import base64
import gc
import math
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import textblocks as tb
from .scratch import bounded_batches
from .token_files import pretoken_starts

#: States that a transducer keeps, and pairs of neighbours that it remembers, at most.
MAX_STATES = 1 << 16
MAX_PAIRS = 1 << 17
#: Pieces up to so many bytes that a worker keeps with their ids, at most.
SHORT_PIECE, MAX_MET = 32, 3 << 16
#: Texts that are encoded together. At most 2**20 less 1, so that tables of powers stay small.
BLOCK_BYTES = (1 << 19) - 1
#: A node of the trie with so many tokens below has them listed. Bytes of a piece that are read before what is settled is emitted.
FEW, PORTION = 12, 1 << 12
#: A text beyond so many bytes is cut where white space begins, which is a cut between pieces anyway.
LONG_TEXT = 4 << 20


def read_ranks(file: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and its rank a line."""
    with open(file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(ranks: dict[bytes, int], piece: bytes, parts_left: int = 1) -> list[bytes]:
    """The merging itself, for short pieces, until so many parts are left: the neighbours of least rank first, the leftmost of equal ones."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    never = math.inf
    while len(parts) > parts_left:
        found = [ranks.get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        least = min(found)
        if least == never:
            break
        i = found.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class _Node:
    """Of the trie: what may follow, the token that ends here (-1: none), bytes
    from the root, and the tokens that end here or further on (None: many)."""

    __slots__ = ("below", "depth", "next", "token")

    def __init__(self, depth: int) -> None:
        self.next: dict[int, _Node] = {}
        self.token, self.depth = -1, depth
        self.below: tuple[int, ...] | None = None

    def gather(self) -> list[int]:
        found = [t for node in self.next.values() for t in node.gather()] + ([self.token] if self.token >= 0 else [])
        if len(found) <= FEW:
            self.below = tuple(sorted(found))
        return found


class _State:
    """items: a half-read node each, with the token before it or, where few
    tokens can still come of the node, with those that may stand behind that
    token. The last item is the one with nothing half read. moves: by byte, the
    next state and the token that a text ending there would end with."""

    __slots__ = ("items", "moves")

    def __init__(self, items: tuple) -> None:
        self.items = items
        self.moves: dict[int, tuple[_State, int]] = {}


class Transducer:
    """Bytes in, token ids out; one piece at a time, each on its own."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack {len(missing)} single bytes")
        self.ranks, self.max_states = ranks, max_states
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.root = _Node(0)
        #: the last merge that makes a token
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = merge(ranks, token, 2)
                if len(parts) > 2:  # merging never makes it
                    continue
                self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
            at = self.root
            for byte in token:
                at = at.next.setdefault(byte, _Node(at.depth + 1))
            at.token = rank
        self.root.gather()
        self.root.below = None
        #: whether a token is always made later than its halves
        self.in_order = all(h < rank or h not in self.halves for rank, halves in self.halves.items() for h in halves)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple, _State] = {}
        self.forget()

    def forget(self) -> None:
        for state in self.states.values():  # they refer to each other
            state.moves.clear()
        self.start = _State(((self.root, -1),))
        self.states = {self.start.items: self.start}

    def neighbours(self, a: int, b: int) -> bool:
        """Whether merging leaves the bytes of tokens a and b as these two."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            if self.in_order:
                known = self._apart(a, b)
            else:
                left, right = self.tokens[a], self.tokens[b]
                known = merge(self.ranks, left + right) == [left, right]
            self.pairs[a, b] = known
        return known

    def _apart(self, a: int, b: int) -> bool:
        """neighbours(), from the last merge back to the first: the tokens at
        either side of the border merge with each other unless one of them is
        taken into its own side before."""
        ranks, tokens, halves = self.ranks, self.tokens, self.halves
        taken = math.inf  # when one of the two is taken into its side
        while True:
            across = ranks.get(tokens[a] + tokens[b])
            if across is not None and across < taken:
                return False
            own, other = halves.get(a), halves.get(b)
            if own is None and other is None:
                return True
            # of equal merges the left one is first, so the right one is undone first
            if other is None or own is not None and a > b:
                taken, a = a, own[1]
            else:
                taken, b = b + 1, other[0]

    def _move(self, state: _State, byte: int) -> tuple[_State, int]:
        items, whole = [], -1
        for node, before in state.items:
            behind = node.next.get(byte)
            if behind is None:
                continue
            token = behind.token
            if behind.below is None:
                if token >= 0 and whole < 0 and (before < 0 or self.neighbours(before, token)):
                    whole = token
                items.append((behind, before))
                continue
            if node.below is None:
                may = [t for t in behind.below if before < 0 or self.neighbours(before, t)]
            else:
                may = [t for t in before if t in behind.below]
            if token in may:
                whole = token
                may.remove(token)
            if may:
                items.append((behind, tuple(may)))
        items.append((self.root, whole))
        name = tuple(items)
        to = self.states.get(name)
        if to is None:
            if len(self.states) >= self.max_states:
                self.forget()
                state.moves.clear()
            to = self.states[name] = _State(name)
        state.moves[byte] = move = (to, whole)
        return move

    def stream(self, portions: Iterable[bytes]) -> Iterator[list[int]]:
        """ids of one piece that comes in portions, as soon as they are settled:
        up to where the sequences of all half-read tokens have the same past."""
        state, ends = self.start, []
        for portion in portions:
            for byte in portion:
                state, token = state.moves.get(byte) or self._move(state, byte)
                ends.append(token)
            live = {len(ends) - node.depth for node, _ in state.items}
            while len(live) > 1:
                last = max(live)
                live.remove(last)
                live.add(last - self.size[ends[last - 1]])
            settled = live.pop()
            yield self._back(ends[:settled])
            ends = ends[settled:]
        yield self._back(ends)

    def _back(self, ends: list[int]) -> list[int]:
        out, at = [], len(ends)
        while at:
            out.append(ends[at - 1])
            at -= self.size[ends[at - 1]]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        """ids of one piece."""
        if len(piece) > PORTION:
            return [i for part in self.stream(piece[at : at + PORTION] for at in range(0, len(piece), PORTION)) for i in part]
        state, ends = self.start, []
        for byte in piece:
            try:
                state, token = state.moves[byte]
            except KeyError:
                state, token = self._move(state, byte)
            ends.append(token)
        return self._back(ends)


def _utf8_machine() -> np.ndarray:
    """next state by state and byte. 0: between characters; 1 to 3: so many
    continuation bytes to come; 4 to 7: the next one is bounded (after E0, ED,
    F0, F4); 8: not UTF-8."""
    table = np.full((9, 256), 8, np.uint8)
    table[0, :0x80] = 0
    table[0, 0xC2:0xE0], table[0, 0xE0:0xF0], table[0, 0xF0:0xF5] = 1, 2, 3
    table[0, 0xE0], table[0, 0xED], table[0, 0xF0], table[0, 0xF4] = 4, 5, 6, 7
    for left in (1, 2, 3):
        table[left, 0x80:0xC0] = left - 1
    table[4, 0xA0:0xC0], table[5, 0x80:0xA0], table[6, 0x90:0xC0], table[7, 0x80:0x90] = 1, 1, 2, 2
    return table


_UTF8 = _utf8_machine()


class Decoder:
    """ids in portions -> bytes, and the text of the characters that are whole so far."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.known = self.length > 0
        self.reset()

    def reset(self) -> None:
        self.tail = b""

    def to_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids; an id that the ranks lack is an error."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id that the ranks lack")
        size = self.length[ids]
        ends = np.cumsum(size)
        return self.bytes[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def feed(self, ids: np.ndarray) -> str:
        """The text of the whole characters that these ids complete; what is not
        UTF-8 becomes U+FFFD, a tail that more ids may complete is kept."""
        held = self.tail + self.to_bytes(ids).tobytes()
        ended = len(held)
        for at in range(len(held) - 1, max(len(held) - 4, -1), -1):
            if held[at] & 0xC0 != 0x80:  # the last character begins here
                state = 0
                for byte in held[at:]:
                    state = int(_UTF8[state, byte])
                ended = len(held) if state in (0, 8) else at
                break
        self.tail = held[ended:]
        return held[:ended].decode("utf-8", "replace")

    def finish(self) -> str:
        """What a tail that nothing completed becomes."""
        out = self.tail.decode("utf-8", "replace")
        self.reset()
        return out


def char_classes(pattern_classes: tuple[str, ...] = (r"\p{L}", r"\p{N}", r"\s")) -> np.ndarray:
    """Class of every code point as the splitter's own regular expressions see it (the last class is `other`)."""
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, len(pattern_classes), np.uint8)
    for k, pattern in enumerate(pattern_classes):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        for first in range(0, 0x110000, 0x2000):  # surrogates, which no text has, are two such portions
            if not 0xD800 <= first < 0xE000:
                found = bytes(probe.encode_ordinary("".join(map(chr, range(first, min(first + 0x2000, 0xD800 if first < 0xD800 else 0x110000))))))
                out[np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)] = k
    return out


class Encoder:
    """A worker's transducer and the splitter before it."""

    def __init__(self, file: str):
        self.transducer = Transducer(read_ranks(file))
        self.classes = char_classes()
        self.met: dict[bytes, list[int]] = {}

    def piece(self, piece: bytes) -> list[int]:
        """ids of a piece, which a worker's texts often have again."""
        ids = self.met.get(piece)
        if ids is None:
            ids = self.transducer.encode(piece)
            if len(piece) <= SHORT_PIECE:
                if len(self.met) >= MAX_MET:
                    self.met.clear()
                self.met[piece] = ids
        return ids

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First bytes of the pieces of texts that lie one behind the other."""
        raw = data.tobytes()
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        return lead[pretoken_starts(points, np.searchsorted(lead, offsets), self.classes)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, and how many each has. A piece that stands in the
        block again is looked up by a hash, and its bytes are compared."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts = self.pieces(data, offsets)
        ends = np.append(starts[1:], len(data))
        size = ends - starts
        up, down = tb.powers(len(data) + 1)
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(tb._BYTE[data] * up[: len(data)], dtype=np.uint64, out=run[1:])
        hashes = tb.mix((run[ends] - run[starts]) * down[starts] + size.astype(np.uint64) * tb._BASE)
        _, first, again = np.unique(hashes, return_index=True, return_inverse=True)
        like = np.repeat(starts[first][again] - starts, size) + np.arange(len(data))
        if (size[first][again] != size).any() or (data[np.minimum(like, len(data) - 1)] != data).any():
            first = again = np.arange(len(starts))  # two pieces share a hash: each for itself
        raw, encode = data.tobytes(), self.piece
        gc.disable()  # states refer to each other: looking through them again and again would take a third of the time
        try:
            found = [encode(raw[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        finally:
            gc.enable()
        n = np.array([len(x) for x in found], np.int64)
        flat = np.array([i for x in found for i in x], np.uint32)
        at = np.cumsum(n) - n
        many = n[again]
        total = np.cumsum(many)
        ids = flat[np.repeat(at[again] - total + many, many) + np.arange(total[-1])]
        return ids, np.diff(np.concatenate([[0], total])[np.searchsorted(starts, offsets)])


def _cuts(data: np.ndarray, most: int) -> list[int]:
    """Ends of portions of one long text, each where a space or line end follows something else."""
    blank = np.isin(data, np.array([0x20, 0x0A], np.uint8))
    good = np.flatnonzero(blank[1:] & ~(blank[:-1] | np.isin(data[:-1], np.array([0x09, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x80, 0x8A, 0x9F, 0xA8, 0xA9, 0xAF], np.uint8)))) + 1
    out, at = [], 0
    while len(data) - at > most:
        k = np.searchsorted(good, at + most)
        if k == len(good):
            break
        at = int(good[k])
        out.append(at)
    return [*out, len(data)]


@lru_cache(maxsize=1)
def _encoder(file: str) -> Encoder:
    return Encoder(file)


@lru_cache(maxsize=1)
def _decoder(file: str) -> Decoder:
    return Decoder(read_ranks(file))


def _portions(ids: np.ndarray, size: int = 1 << 16) -> Iterator[np.ndarray]:
    for at in range(0, len(ids), size):
        yield ids[at : at + size]


Batches = Iterator[pa.RecordBatch]


def _encoding(ranks_file: str) -> Callable[[Batches], Batches]:
    """Batches of doc_id and text -> doc_id, n_tokens and ids, block by block."""

    def run(batches: Batches) -> Batches:
        encoder = _encoder(ranks_file)
        for batch in batches:
            for block in tb.blocks(batch.column(1), BLOCK_BYTES):
                if block.n == 1 and len(block.data) > LONG_TEXT:
                    ends = _cuts(block.data, LONG_TEXT)
                    parts = [encoder.encode(block.data[a:b], np.array([0, b - a]))[0] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                    ids = np.concatenate(parts)
                    counts = np.array([len(ids)], np.int64)
                else:
                    ids, counts = encoder.encode(block.data, block.offsets)
                offsets = np.concatenate([[0], np.cumsum(counts * 4)])
                packed = pa.Array.from_buffers(pa.large_binary(), block.n, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.n), pa.array(counts, pa.int64()), packed.cast(pa.binary())], ["doc_id", "n_tokens", "ids"])

    return run


def _decoding(ranks_file: str, at: int) -> Callable[[Batches], Batches]:
    """Batches with ids in column `at` -> the same and decoded, 256 rows at a time."""

    def run(batches: Batches) -> Batches:
        decoder = _decoder(ranks_file)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows, texts = batch.slice(lo, 256), []
                for ids in rows.column(at):
                    decoder.reset()
                    found = [decoder.feed(part) for part in _portions(np.frombuffer(ids.as_py() or b"", "<u4"))]
                    texts.append("".join([*found, decoder.finish()]))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def _id_text(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encode_documents(docs: DataFrame, ranks_file: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers, as binary) of each document.

    ranks_file is a path every executor has, as part of the installed
    environment. A null or empty text has no ids. Repeated rows are encoded
    each; other columns are left out, whatever their names; an empty table
    gives no rows. No row leaves its task.
    """
    return _id_text(docs).mapInArrow(_encoding(ranks_file), "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, ranks_file: str) -> DataFrame:
    """The columns of encoded (with ids, as encode_documents gives them) and the
    text they decode to, in portions of ids. Null ids are none; what is not
    UTF-8 becomes U+FFFD; an id without a rank is an error."""
    at = encoded.columns.index("ids")
    return encoded.mapInArrow(_decoding(ranks_file, at), StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def recode_documents(docs: DataFrame, ranks_file: str) -> DataFrame:
    """decode_documents(encode_documents(docs)), in one worker a task: as two
    steps, each task has two workers, and a worker that Spark uses again for
    the other step holds the tables of both."""
    encode, decode = _encoding(ranks_file), _decoding(ranks_file, 2)
    return _id_text(docs).mapInArrow(lambda batches: decode(encode(batches)), "doc_id long, n_tokens long, ids binary, decoded string")
