"""Operators on single texts, against plain versions; sampling and sharding by their laws."""

import hashlib
import random
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from verdigris.llm import fingerprints, license_scan, pii, sharding, source_mix, token_files, toxicity

TOKENIZER = "byte_bpe_50k.json"


def brute_licenses(rows):
    documents = pd.DataFrame([(i, t) for i, t, _ in rows], columns=["doc_id", "text"])  # noqa: F841
    return duckdb.sql(license_scan.oracle_sql()).df()


def test_license_scan(spark):
    texts = [
        "All rights reserved. all  rights, RESERVED", "cc by cc by", "accc by", None, "", "Licensed under the Apache License, Version 2.0\nother",
        "released under\nthe MIT license", "Released under the MIT License. Copyright", "GNU General Public License and cc BY", "all rights all rights reserved", "ſtraße K CC by",
        "unless required by applicable law agreed to in writing software distributed under the license is distributed on an as is basis " + "x " * 3000,
    ]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(1, texts[1], "s")]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id long, text string, s int")
    got = license_scan.scan_licenses(docs).toPandas()
    want = brute_licenses(rows)
    for name in ("base_labels", "labels"):
        got[name] = got[name].map(",".join)
    got["score"] = got["score"].round(6)
    key = lambda d: sorted(tuple(None if pd.isna(x) else x for x in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert key(got) == key(want)
    assert license_scan.scan_licenses(docs.where("doc_id < 0")).count() == 0


def test_token_files(spark, docs, rows, nothing):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public.path(TOKENIZER))
    path = token_files.scratch_path(spark)
    token_files.write_token_files(docs, path, public.path(TOKENIZER))
    got = sorted(map(tuple, token_files.document_tokens(token_files.read_token_files(spark, path)).collect()))
    start, want = 0, []
    for i, t in sorted((i, t or "") for i, t, _ in rows):
        ids = [*encode.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    empty = token_files.scratch_path(spark)
    token_files.write_token_files(nothing, empty, public.path(TOKENIZER))
    assert token_files.document_tokens(token_files.read_token_files(spark, empty)).count() == 0


def test_packing_round_trip():
    rng = np.random.default_rng(3)
    for width in (1, 7, 16, 17, 31):
        ids = rng.integers(0, 1 << width, 1001).astype(np.uint64)
        packed = token_files.pack(ids, width)
        assert (token_files.unpack(packed, 1001, width) == ids).all()
        assert (token_files.unpack(packed, 13, width, 500) == ids[500:513]).all()


def canon(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return re.sub(r"\s+", " ", t).strip(" ")


def test_fingerprints(docs, rows, nothing):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs).collect()}
    ordered = sorted((i, t or "") for i, t, _ in rows)
    names = {}
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(t)
        if i != 90:  # two rows of one id
            assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
            assert (r["near_next"] == 1) == (canon(t) == canon(after))
        names.setdefault(canon(t), set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in names.values())
    assert len(set().union(*names.values())) == len(names)
    assert fingerprints.fingerprint_edits(nothing).count() == 0
    assert fingerprints.fingerprint(docs).count() == len(rows)


def test_pii(spark, nothing):
    text = "mail a.b@c.de and x@y, ip 10.0.0.255 or 1.2.3.256, card 4111 1111 1111 1111, phone +49 (30) 123-4567, iban DE89370400440532013000 é ssn social 123-45-6789"
    found = pii.digest_columns(pii.find_pii(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))).collect()
    one = {r["doc_id"]: r for r in found}
    assert (one[1]["n_email"], one[1]["n_ip"], one[1]["n_card"], one[1]["n_phone"]) == (1, 1, 1, 1)
    assert "iban:" in one[1]["spans"] and "ssn:" in one[1]["spans"]
    assert one[2]["spans"] == one[3]["spans"] == ""
    base = ",".join(s for s in one[1]["spans"].split(",") if s.split(":")[0] in pii.BASE_KINDS)
    assert one[1]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert pii.find_pii(nothing).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), ceiling=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        left, rest = total - sum(capped.values()), [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > ceiling * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: ceiling * sizes[s] for s in over}


def test_source_mix(docs, rows, nothing):
    got = source_mix.mix_sources(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target, taken, names = brute_targets(sizes), {}, {}
    source = {i: s for i, _, s in rows}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6
        assert r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        names[s] = max(names.get(s, 0), r["size"])
    assert all(abs(taken[s] - target[s]) <= 3 * names[s] for s in taken)
    assert sorted(map(tuple, got)) == sorted(map(tuple, source_mix.mix_sources(docs.repartition(7)).collect()))
    mixed = source_mix.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert source_mix.mix_sources(nothing).count() == 0


def test_sharding(docs, rows, nothing):
    got = sharding.assign_shards(docs).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"rows"}
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    whole = sharding.sharded_documents(docs)
    assert whole.count() == len(rows) and set(docs.columns) <= set(whole.columns)
    assert sorted((r["shard"], r["slot"]) for r in whole.collect()) == sorted((r["shard"], r["slot"]) for r in got)
    assert sharding.assign_shards(nothing).count() == 0


def test_communication_matrix_sums():
    counts = np.array([0, 5, 17, 1, 100])
    m = sharding.communication_matrix(counts, 8)
    assert (m.sum(axis=1) == counts).all() and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1 and (m >= 0).all()


def test_toxicity(spark, nothing):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 80))]
        toxic = int(i % 6 == 0)
        if toxic:
            words[1:1] = ["idiot", "moron"] if i % 12 else [f"grunf{c}" for c in rng.sample("abcdefgh", 3)]
        rows.append((i, " ".join(words), "x"))
        labels.append((i, 0, toxic))
    rows += [(9000, None, "x"), (9001, "", "x"), (None, "idiot", "x")]
    docs = spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string")
    marks = spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, marks).collect()}
    truth = {i: x for i, _, x in labels}
    held = [i for i in truth if got[i]["held_out"]]
    assert len(held) > 60 and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.97 * len(held)
    assert got[9000]["score"] == got[9001]["score"] < 0.5
    assert toxicity.score_toxicity(nothing, marks).count() == 0
    alone = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, marks.where("doc_id < 0")).collect()}
    assert alone[None]["predicted"] == 1 and alone[9001]["predicted"] == 0
