"""Each stage of the pipeline against plain versions, on the smallest tables."""

import corpus_pipeline as cp
from test_pairs import brute_components, brute_hits


def test_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_join", "decontamination", "source_mix", "sharding"]
    as_rows = lambda df: [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    clean = cp.drop_toxic(spark, docs, small).cache()
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()
    rows = as_rows(clean)
    kept = cp.drop_near_copies(spark, clean, small).cache()
    assert sorted(r[0] for r in as_rows(kept)) == sorted({c for _, _, c in brute_components(rows, cp.WORDS, cp.PERCENT)})
    rows = as_rows(kept)
    good = cp.drop_contaminated(spark, kept, small).cache()
    assert sorted(r[0] for r in as_rows(good)) == sorted(x[0] for x in brute_hits(rows, bench) if not x[-1])
    mixed = cp.mix(spark, good, small)
    assert mixed.columns == docs.columns
    last = cp.shard(spark, mixed, small)
    assert last.count() == mixed.count() and {"shard", "slot"} <= set(last.columns)
