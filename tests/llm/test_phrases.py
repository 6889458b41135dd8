import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import phrases
from verdigris.llm.perfect_hash import PerfectHash
from verdigris.llm.queries import op11_phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, most=3, cover=50, top=2000):
    """rows: (lang, text)"""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    covered = Counter()
    for (lang, words), a in found.items():
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                if j - i < len(words):
                    covered[lang, words[i:j]] = max(covered[lang, words[i:j]], a)
    out = {}
    for (lang, words), a in found.items():
        if 100 * covered[lang, words] >= cover * a and covered[lang, words]:
            continue
        cuts = [(10**6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -score) for lang, all_ in out.items() for rank, (score, a, p, l, r) in enumerate(sorted(all_)[:top], 1))


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def some(seed=1, n=160):
    rng = random.Random(seed)
    pool = ["a", "A", "b", "Éa", "éa", "x-y", "the", "the", "of", "🙂", "q\x0bq", "z z", "i'm"]
    marks = [" ", " ", " ", " ", "\t", ". ", ", ", "\n", "  ", "!?"]
    langs = [None, "und", "en", "en", "de", "", "中"]
    rows = [(rng.choice(langs), "".join(rng.choice(pool) + rng.choice(marks) for _ in range(rng.randrange(60)))) for _ in range(n)]
    return rows + [("en", None), (None, ""), ("de", " \t\n"), ("en", "new york city " * 40), ("en", "la la " * 3000)] + rows[:7]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "x", 2) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, seq string, key int").repartition(5)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        keys = np.unique(rng.integers(0, 2**64, n, np.uint64))
        made = PerfectHash(keys)
        assert sorted(made.slots(keys)) == list(range(len(keys)))
        assert (made.keys[made.slots(keys)] == keys).all() and (made.keys == keys[made.order]).all()
        others = np.setdiff1d(rng.integers(0, 2**64, 9000, np.uint64), keys)
        assert (made.slots(others) == -1).all()


@pytest.mark.parametrize(("least", "most", "top", "slots"), [(10, 3, 2000, 1 << 20), (2, 4, 25, 1 << 20), (3, 3, 2000, 16)])
def test_rule(spark, least, most, top, slots):
    """Also with few slots a round: words and pairs are found over several rounds."""
    rows = some()
    made = phrases.find_phrases(frame(spark, rows), least=least, max_words=most, top=top, max_slots=slots)
    assert result(made) == brute(rows, least, most, top=top)


def test_words_that_share_a_key(spark, monkeypatch):
    """The key only finds a word: its bytes and language decide."""
    words = phrases._words

    def clumsy(block, langs):
        starts, ends, keys, doc = words(block, langs)
        return starts, ends, keys % np.uint64(3), doc

    monkeypatch.setattr(phrases, "_words", clumsy)
    code, names = np.array([0, 1]), ["en", "de"]
    made = phrases._Vocabulary(["en", "de", "en"], ["a", "a", "bb"], 1)
    assert len(made.hash) + len(made.others) == 3
    data = np.frombuffer(b"a bb.aa" + b"a", np.uint8)
    place, ids, offsets = made.find(phrases.tb.Block(data, np.array([0, 7, 8]), 0, 2), code, names)
    known = {(["en", "de", "en"][i], ["a", "a", "bb"][i]): made.base + k for k, i in enumerate(made.chosen)}
    assert ids.tolist() == [known.get(x, 0) for x in (("en", "a"), ("en", "bb"), ("en", "aa"), ("de", "a"))]
    assert place.tolist() == [0, 1, 3, 5] and offsets.tolist() == [0, 5, 7]


def test_no_rows_and_no_phrases(spark):
    docs = frame(spark, [("en", "a b c"), (None, None)])
    assert phrases.find_phrases(docs.where("doc_id < 0")).count() == 0
    assert phrases.find_phrases(docs).count() == 0


def test_long_counts_are_exact(spark):
    """Products beyond 64 bits."""
    big = 3 * 10**9 + 7
    row = spark.range(1).select(*[F.lit(x).cast("decimal(19,0)").alias(c) for c, x in (("a", big), ("l", big + 5), ("r", 4 * big + 1))])
    assert row.select(phrases._share(F.col("a"), F.col("l"), F.col("r")).alias("x")).first()["x"] == 10**6 * big * big // ((big + 5) * (4 * big + 1))


def test_query_against_brute_force(spark, small):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert result(op11_phrases(spark, small)) == brute(rows)


def test_a_pass_over_the_sequences_takes_several_hashes(spark, monkeypatch):
    """Every hash had a pass of its own, which wrote all sequences again: the work grew with the candidates times the input."""
    keys = np.random.default_rng(3).integers(1, 1 << 63, 500, dtype=np.uint64)
    table = spark.createDataFrame([(int(k),) for k in keys], "key long")
    assert [r[0] for r in table.select(F.expr("pmod(xxhash64(key), 7)")).collect()] == phrases._round_of(keys, 7).tolist()
    passes, relabel = [], phrases._relabel
    monkeypatch.setattr(phrases, "_relabel", lambda *args: passes.append(args[2:]) or relabel(*args))
    rows = some(9)
    made = phrases.find_phrases(frame(spark, rows), least=2, max_words=2, max_slots=12)
    assert result(made) == brute(rows, 2, 2)
    rounds = passes[0][1]
    assert rounds > phrases.HASHES and passes == [(k, rounds) for k in range(0, rounds, phrases.HASHES)]
