import pyarrow as pa

from verdigris.llm import ngram_join, scratch, toxicity


def test_batches_of_written_tables_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    texts = spark.range(0, 4000, 1, 1).selectExpr("repeat(cast(id as string), 2000) as text")
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        rows = scratch.written(texts.mapInArrow(sizes, "n long, size long"), "sizes").collect()
        assert sum(r["n"] for r in rows) == 4000
        assert max(r["size"] for r in rows) < scratch.BATCH_BYTES + (1 << 20)
        spark.conf.set(key, "1m")  # the session's own limit stays
        rows = scratch.written(texts.mapInArrow(sizes, "n long, size long"), "sizes").collect()
        assert max(r["size"] for r in rows) < 2 << 20
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_first_steps_of_a_session_get_bounded_batches(spark, docs, monkeypatch):
    """Frequent tokens and stems are counted before the first table is written."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(key, None), []

    def stop(*_):
        seen.append(spark.conf.get(key, None))
        raise KeyError

    monkeypatch.setattr(ngram_join, "frequent_tokens", stop)
    monkeypatch.setattr(toxicity, "training_ids", stop)
    try:
        for step in (lambda: ngram_join.resolve(docs), lambda: toxicity.train(docs, docs)):
            spark.conf.unset(key)
            try:
                step()
            except KeyError:
                pass
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    assert seen == [str(scratch.BATCH_BYTES)] * 2


def test_tables_of_powers_of_the_join_stay_small():
    assert ngram_join.BLOCK_BYTES < 1 << 19
