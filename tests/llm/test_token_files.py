"""Packed token files against the library itself."""

import random

import numpy as np
import pyarrow as pa
import pytest

from verdigris.llm import textblocks as tb
from verdigris.llm import token_files

public = pytest.importorskip("public_tokenizers")
FILE = public.path("byte_bpe_50k.json")
ENDINGS = ["it's", "can't", "i'm", "we'd", "they're", "we've", "she'll", "'", "''s", "x'", " 's", "'S", "it's ", "a's1", "l'l", "'ve'"]


@pytest.fixture(scope="module")
def encoder():
    return token_files.Encoder(FILE)


def same(encoder, texts):
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    got = []
    for block in tb.blocks(pa.array(texts)):
        ids, counts = encoder.encode(block)
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == want


@pytest.mark.parametrize("end", ENDINGS)
def test_contractions_at_the_end_of_texts_and_blocks(encoder, end):
    for texts in ([end], ["x " + end], [end, "s"], ["a", end], [end, end, "re you"], ["", end, ""]):
        same(encoder, texts)


def test_every_code_point_between_letters_digits_and_marks(encoder):
    points = [c for c in range(0x323B0) if not 0xD800 <= c < 0xE000] + list(range(0xE0000, 0xE0200)) + [0xF0000, 0x10FFFF]
    for form in ("a{}b", "1{}2", "!{}!", "' {}s", "x{}  {}y"):
        same(encoder, ["".join(form.format(*[chr(c)] * form.count("{}")) + "q" for c in points[k : k + 500]) for k in range(0, len(points), 500)])


def test_random_texts(encoder):
    rng = random.Random(11)
    pieces = ["'", "s", "t", "ll", "re", "ve", " ", "  ", "\n", "\t", "a", "Zz", "7", "42", "!", "é", "界", "　", " ", "½", "🙂", "ǅ", "́"]
    same(encoder, ["".join(rng.choices(pieces, k=rng.randrange(30))) for _ in range(4000)])


def test_a_piece_with_another_ones_hash_is_not_taken_for_it(encoder, monkeypatch):
    monkeypatch.setattr(tb, "mix", lambda x: np.zeros_like(x))
    fresh = token_files.Encoder(FILE)
    same(fresh, ["one two three", "three two one"])


def test_seek_unpacks_one_document(spark):
    rows = [(i, f"text number {i} it's") for i in range(0, 400, 2)] + [(None, "no id"), (50, "a second one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = token_files.scratch_path(spark)
    token_files.write_token_files(docs, path, FILE, block_ids=40)
    files = token_files.read_token_files(spark, path)
    assert files.count() >= 4
    encode = token_files.Encoder(FILE).tokenizer.encode
    for one in (0, 50, 398):
        want = sorted([*encode(t, add_special_tokens=False).ids, 2] for i, t in rows if i == one)
        assert sorted(list(r["ids"]) for r in token_files.seek(files, one).collect()) == want
    assert token_files.seek(files, 51).count() == 0
