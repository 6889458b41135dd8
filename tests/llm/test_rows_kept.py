"""What operators that return documents do with odd rows and names."""

import pytest
from pyspark.sql import functions as F

from verdigris.llm import decontam, ngram_join, sharding, source_mix, toxicity

TEXT = " ".join(f"w{i}" for i in range(60))
NEAR = TEXT + " more"
OTHER = " ".join(f"v{i}" for i in range(40))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _text_key int, `a.b` string, row int, key int, origin int, at int, cell int, stem long, other string"
NAMES = ["doc_id", "text", "source", "kept", "_text_key", "a.b", "origin"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, TEXT), (1, OTHER), (2, NEAR), (2, "quite another text under this id"), (3, TEXT), (3, TEXT), (None, NEAR), (None, "no id, own words here"), (4, None), (4, None), (5, " "), (6, "")]
    made = [(i, t, "en", "s", 0, f"k{n}", n, f"dot{n}", 1, 2, 3, 4, 5, 6, "z") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA).repartition(2)


def test_one_of_each_links_texts_and_not_ids(odd):
    out = ngram_join.one_of_each(odd, 5, 80)
    assert out.columns == odd.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    want = [(1, TEXT), (1, OTHER), (2, "quite another text under this id"), (None, "no id, own words here"), (4, None), (4, None), (5, " "), (6, "")]
    assert got == sorted(want, key=str)
    assert ngram_join.one_of_each(odd.where("false"), 5, 80).count() == 0


def test_one_of_each_without_broadcasts(odd, monkeypatch):
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST_IDS", 0)
    assert ngram_join.one_of_each(odd, 5, 80).count() == 8


def test_texts_with_one_short_digest_are_nodes_of_their_own(spark):
    rows = [(1, 10, 7, 3, 10), (2, 10, 8, 3, 10), (3, 10, 7, 3, 10), (4, 11, 9, 3, 11), (5, 12, 1, 0, None)]
    table = spark.createDataFrame(rows, "doc_id long, stem long, check long, n long, node long")
    whole, nodes = ngram_join.with_nodes(table)
    by = {r["doc_id"]: r["node"] for r in whole.collect()}
    assert by[1] == by[3] and len({by[1], by[2], by[4]}) == 3 and by[5] is None
    assert sorted(r["least"] for r in nodes.collect()) == [1, 2, 4]


def test_mix_and_shards_take_any_names(odd):
    mixed = source_mix.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() >= 3
    out = sharding.sharded_documents(odd, 3)
    assert out.columns == [*odd.columns, "shard", "slot"]
    whole = lambda df: sorted(tuple(str(x) for x in r) for r in df.select(*[F.col(f"`{c}`") for c in NAMES]).collect())
    assert whole(out) == whole(odd)
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert sorted(sizes) == [4, 4, 4]
    assert sharding.sharded_documents(odd.where("false")).count() == 0 and source_mix.mixed_documents(odd.where("false")).count() == 0


def test_clean_documents_and_texts(spark, odd):
    bench = spark.createDataFrame([(1, OTHER)], "item_id long, text string")
    assert decontam.clean_documents(odd, bench).count() == 11 and decontam.clean_documents(odd.where("false"), bench).count() == 0
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.clean_texts(odd, labels).count() == 12 and toxicity.clean_texts(odd.where("false"), labels).count() == 0


def test_shards_match_their_inputs(spark, docs, rows):
    import zlib

    got = sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in sharding.assign_shards(docs).collect())
    assert got == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)


@pytest.mark.parametrize("good, bad, n", [(5, 7, 4), (40, 2, 30), (3, 10**7, 10**6), (10**11, 7 * 10**11, 4 * 10**10)])
def test_hypergeometric_draws(good, bad, n):
    import numpy as np

    rng = np.random.default_rng(1)
    drawn = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(300 if good < 10**6 else 40)], float)
    mean = n * good / (good + bad)
    sd = (mean * bad / (good + bad) * (good + bad - n) / (good + bad - 1)) ** 0.5
    assert drawn.min() >= max(0, n - bad) and drawn.max() <= min(n, good)
    assert abs(drawn.mean() - mean) < 4.5 * sd / len(drawn) ** 0.5
    assert 0.5 * sd < drawn.std() < 1.7 * sd


def test_decontamination_in_passes(spark, docs, rows, monkeypatch):
    from test_pairs import brute_hits, items_of

    items = items_of(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", (150,))
    assert decontam.item_blocks(bench)[0] > 2
    want = sorted(x[0] for x in brute_hits(rows, items) if not x[-1])
    for most in (decontam.MAX_BROADCAST_IDS, 0):
        monkeypatch.setattr(decontam, "MAX_BROADCAST_IDS", most)
        clean = decontam.clean_documents(docs, bench)
        assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == want


def test_mix_in_many_cells_is_as_near(docs, rows):
    few = {r["doc_id"]: r for r in source_mix.mix_sources(docs).collect()}
    many = source_mix.mix_sources(docs, 3).collect()
    assert len(many) == len(rows)
    source = {i: s for i, _, s in rows}
    taken, copies, count = {}, {}, {}
    for r in many:
        s, rate = source[r["doc_id"]], r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["target"] == few[r["doc_id"]]["target"] and int(rate) <= r["copies"] <= int(rate) + 1
        copies[s], count[s] = copies.get(s, 0) + r["copies"], count.get(s, 0) + rate
    assert all(abs(copies[s] - count[s]) <= 1 for s in copies)
