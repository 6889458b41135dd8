import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from verdigris.llm import merkle
from verdigris.llm.queries import op13_merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, pos int, node string, total int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def climb(nodes, fanout=2):
    """The root, and each node's siblings (before, after), by the rule as it is written."""
    at, steps, level = list(range(len(nodes))), [[] for _ in nodes], nodes
    while len(level) > 1:
        for k, i in enumerate(at):
            lo = i - i % fanout
            steps[k].append(("".join(level[lo:i]), "".join(level[i + 1 : lo + fanout])))
        at = [i // fanout for i in at]
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], steps


def brute(rows, fanout=2):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        own = sorted(langs[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = own, *climb([leaf_of(r) for r in own], fanout)
    root, tops = climb([trees[g][1] for g in order], fanout)
    out = []
    for g, top in zip(order, tops, strict=True):
        own, sub, steps = trees[g]
        for r, mine in zip(own, steps, strict=True):
            path, leaf = mine + top, leaf_of(r)
            bad = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            fold = leaf_of((*r[:3], r[3] + 1, r[4])) if bad else leaf
            for a, b in path:
                fold = h(a, fold, b)
            proof = h(*[a + b for a, b in path])
            out.append((r[0], leaf, sub, root, proof, fold, fold == root))
    return sorted(out, key=str)


def some(n, seed=3):
    rng = random.Random(seed)
    langs = [None, "", "en", "en", "en", "de", "é", "z"]
    rows = [(i, rng.choice([None, "web", "bücher"]), rng.choice(langs), rng.choice([None, 0, 9, 2**63 - 1]), rng.choice([None, "", "a:b-", "x" * 50000, "größe\n", f"t{i}"])) for i in range(n)]
    rows += [(5, "a", "en", 1, "tie"), (5, "b", "en", 1, "tie"), (None, None, None, None, None), (None, "s", "lone", 3, "no key")]
    return rows + rows[:9]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "g", 1, "n", 2) for r in rows], SCHEMA).repartition(5)


def result(df):
    return sorted([tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)


@pytest.mark.parametrize("n", [0, 1, 40, 700])
def test_audit_is_the_rule(spark, n):
    rows = some(n)
    assert result(merkle.audit(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize(("fanout", "block", "top"), [(2, 4, 4), (2, 8, 2), (3, 9, 3), (4, 2, 1000)])
def test_small_blocks_and_tops(spark, fanout, block, top):
    """Several rounds of blocks, and more groups than the driver takes."""
    rows = [(i, None, f"l{i % 11}" if i % 3 else "hot", i, None) for i in range(150)]
    made = merkle.merkle_manifest(frame(spark, rows), fanout=fanout, block=block, top=top)
    made = made.withColumn("fold", merkle.folded(F.col("leaf"), F.col("proof"))).withColumn("p", merkle.proof_digest(F.col("proof")))
    got = sorted((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["p"]) for r in made.collect())
    assert got == sorted(b[:5] for b in brute(rows, fanout))
    assert made.where("fold <> root").count() == 0
    merkle.release(made)


def test_one_row_and_none(spark):
    one = [(7, "s", None, None, "x")]
    assert result(merkle.audit(frame(spark, one))) == brute(one)
    assert brute(one)[0][4] == h("")
    assert merkle.audit(frame(spark, one).where("doc_id < 0")).count() == 0


def test_any_change_shows(spark):
    rows = some(60)
    root = merkle.audit(frame(spark, rows)).first()["root"]
    for k in range(5):
        changed = list(rows[20])
        changed[k] = (changed[k] or 0) + 100 if k in (0, 3) else (changed[k] or "") + "!"
        assert merkle.audit(frame(spark, [*rows[:20], tuple(changed), *rows[21:]])).first()["root"] != root


def test_query_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    assert result(op13_merkle_manifest(spark, small)) == brute([tuple(r) for r in docs.collect()])
