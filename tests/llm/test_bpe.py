import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from verdigris.llm import bpe, scratch
from verdigris.llm.queries import op12_byte_bpe

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = "abeintrs  \n\r\t'´zé1.ſ 　\x85中🙂٣"


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(FILE)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.transducer.ranks, special_tokens={})


def ids_of(encoder, *texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    ids, counts = encoder.encode(np.frombuffer(b"".join(data), np.uint8), offsets)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_encode_like_the_library(encoder, library):
    rng = random.Random(1)
    texts = ["", "don't'll 've  x", "  ", "<|endoftext|>", "a" * 3000, " x", *["".join(rng.choices(ALPHABET, k=rng.randrange(70))) for _ in range(1500)]]
    assert ids_of(encoder, *texts) == [library.encode_ordinary(t) for t in texts]


def test_any_ranks_like_merging():
    """Ranks out of order, tokens that merging never makes, and few states."""
    rng = random.Random(7)
    for _ in range(40):
        tokens = {bytes(rng.choices(b"abc", k=rng.randrange(2, 6))) for _ in range(rng.randrange(25))}
        order = sorted(tokens, key=len) if rng.random() < 0.5 else rng.sample(sorted(tokens), len(tokens))
        ranks = {bytes([i]): i for i in range(256)} | {t: 256 + i for i, t in enumerate(order)}
        machine = bpe.Transducer(ranks, max_states=rng.choice([2, 9, 10**6]))
        for _ in range(120):
            piece = bytes(rng.choices(b"abcd", k=rng.randrange(40)))
            want = [ranks[t] for t in bpe.merge(ranks, piece)]
            assert machine.encode(piece) == want
            cut = rng.randrange(len(piece) + 1)
            assert [i for part in machine.stream([piece[:cut], piece[cut:]]) for i in part] == want


def test_emission_is_early(encoder):
    """Ids come out long before a piece ends."""
    sizes, read, written = encoder.transducer.size, 0, 0
    for part in list(encoder.transducer.stream([b"internationalisation" * 40] * 20))[:-1]:
        read, written = read + 800, written + sum(sizes[i] for i in part)
        assert read - written < 64
    piece = bytes(random.Random(4).choices(b"abcdefghij", k=3 * bpe.PORTION))
    assert encoder.transducer.encode(piece) == [i for part in encoder.transducer.stream(piece[k : k + 1] for k in range(len(piece))) for i in part]


def test_single_bytes_are_needed():
    with pytest.raises(ValueError, match="single bytes"):
        bpe.Transducer({b"a": 0})


def test_decode_in_portions(encoder, library):
    rng = random.Random(3)
    decoder = bpe.Decoder(encoder.transducer.ranks)
    for _ in range(200):
        text = "".join(rng.choices(ALPHABET + "🙃𝄞", k=30))
        ids = np.array(library.encode_ordinary(text), np.uint32)
        cuts = sorted(rng.choices(range(len(ids) + 1), k=4))
        decoder.reset()
        found = [decoder.feed(part) for part in np.split(ids, cuts)]
        assert "".join(found) + decoder.finish() == text
    # any bytes: what is not UTF-8 becomes U+FFFD, wherever the portions end
    for _ in range(500):
        raw = bytes(rng.choices([*range(0x60, 0x64), 0xE0, 0xED, 0xF0, 0xF4, 0xC3, *range(0x80, 0xC0, 9), 0xFF], k=12))
        ids = np.array([encoder.transducer.ranks[raw[i : i + 1]] for i in range(12)], np.uint32)
        decoder.reset()
        found = [decoder.feed(ids[i : i + 1]) for i in range(12)]
        assert "".join(found) + decoder.finish() == raw.decode("utf-8", "replace")
    with pytest.raises(ValueError, match="lack"):
        decoder.feed(np.array([60000], np.uint32))


def test_long_text_in_portions(spark, library, monkeypatch):
    rng = random.Random(5)
    text = " 　".join("".join(rng.choices("abc de\nf", k=50)) for _ in range(40000))
    data = np.frombuffer(text.encode(), np.uint8)
    ends = bpe._cuts(data, 1 << 16)
    assert ends[-1] == len(data) and len(ends) > 20
    docs = spark.createDataFrame([(1, text), (2, "x" * (bpe.LONG_TEXT + 9)), (3, text + text + text)], "doc_id long, text string")
    rows = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in bpe.encode_documents(docs, FILE).collect()}
    assert rows[1] == library.encode_ordinary(text)
    assert rows[3] == library.encode_ordinary(text + text + text)
    assert rows[2] == [i for part in bpe.Transducer(bpe.read_ranks(FILE)).stream([b"x" * (bpe.LONG_TEXT + 9)]) for i in part]


def test_odd_rows(spark, docs, nothing, library):
    """Null, empty, repeated rows, null ids and clashing names; an empty table."""
    more = docs.unionByName(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    encoded = bpe.encode_documents(more, FILE)
    got = sorted((str(r["doc_id"]), bytes(r["ids"]), r["n_tokens"], r["decoded"]) for r in bpe.decode_documents(encoded, FILE).collect())
    want = []
    for r in more.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((str(r["doc_id"]), np.array(ids, "<u4").tobytes(), len(ids), r["text"] or ""))
    assert got == sorted(want)
    assert bpe.decode_documents(bpe.encode_documents(nothing, FILE), FILE).count() == 0


def test_query_against_the_library(spark, small, library):
    got = sorted(tuple(r) for r in op12_byte_bpe(spark, small).collect())
    want = []
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_one_worker_a_task(spark, docs, small):
    """Encoding and decoding of the query are one step of one worker, fed with bounded batches."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        plan = op12_byte_bpe(spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1
        assert int(spark.conf.get(key, "0")) == scratch.BATCH_BYTES
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    two_steps = bpe.decode_documents(bpe.encode_documents(docs, FILE), FILE)
    key = lambda r: (str(r["doc_id"]), r["decoded"], r["n_tokens"], bytes(r["ids"]))
    assert sorted(map(key, bpe.recode_documents(docs, FILE).collect())) == sorted(map(key, two_steps.collect()))
