"""The joins and removals, against plain loops over all pairs."""

import hashlib
import re

import numpy as np

from verdigris.llm import decontam, ngram_join, substrings
from verdigris.llm.graph import components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else None


def brute_components(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t, _ in rows]
    label = {k: k for k in range(len(sets))}
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(a):
                x, y = sets[a][1], sets[b][1]
                if x and y and label[a] != label[b] and 100 * len(x & y) >= percent * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    least = {}
    for k, (i, _) in enumerate(sets):
        least[label[k]] = min(least.get(label[k], i), i)
    return sorted((i, len(s or ()), i if s is None else least[label[k]]) for k, (i, s) in enumerate(sets))


def test_jaccard_components(docs, rows):
    found = ngram_join.jaccard_components(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect())) == brute_components(rows, 4, 85)


def test_jaccard_with_long_lists_and_many_chunks(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 2)
    monkeypatch.setattr(ngram_join, "LEAST_CHUNK", 300)
    found = ngram_join.jaccard_components(docs, 5, 80)
    assert sorted(map(tuple, found.collect())) == brute_components(rows, 5, 80)


def test_jaccard_with_prefixes_cut_again(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 2)
    monkeypatch.setattr(ngram_join, "NODES_A_LIST", 1 << 40)
    monkeypatch.setattr(ngram_join, "frequent_tokens", lambda docs, words: np.zeros(0, np.uint64))
    found = ngram_join.jaccard_components(docs, 5, 80)
    assert sorted(map(tuple, found.collect())) == brute_components(rows, 5, 80)


def test_a_long_list_of_unlike_sizes_is_not_one_cluster(spark):
    """One token in texts of all sizes drew them, and whatever they shared, into a cluster whose work is the square of its texts."""
    sizes = [100 * 11**k // 10**k for k in range(40)] + [50] * 40
    postings = spark.createDataFrame([(7, node, n, 0, len(sizes)) for node, n in enumerate(sizes)], "token long, node long, n long, pos long, times long")
    short, edges = ngram_join.in_cells(postings, 85)
    assert {x for r in edges.collect() for x in r} == set(range(40, 80))  # the forty of one size
    assert {r["node"] for r in short.collect()} >= set(range(40))
    pairs = [(i, j) for j in range(40) for i in range(j) if 100 * sizes[i] >= 85 * sizes[j]]
    near = [r for r in short.collect() if r["node"] < 40]
    met = [(x["node"], y["node"]) for x in near for y in near if x["node"] < y["node"] and x["cell"] == y["cell"] == min(x["klass"], y["klass"])]
    assert pairs and len(met) == len(set(met)) and set(met) >= set(pairs)  # each pair near in size, once


def test_one_of_each_keeps_rows_whole(docs, rows):
    kept = ngram_join.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute_components(rows, 5, 80)}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(got) == sorted(want)


def test_jaccard_empty(nothing):
    assert ngram_join.jaccard_components(nothing).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 50)] + [(None, 3), (7, 7)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {i: 0 for i in range(101)} | {500 + i: 500 for i in range(50)}


def brute_removal(rows):
    seen, out = {}, []
    by_id = sorted({(i, t or "") for i, t, _ in rows})
    for i, t in by_id:
        b = t.encode()
        for k in range(len(b) - 49):
            seen.setdefault(b[k : k + 50], i)
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeated_substrings(docs, rows):
    found = substrings.remove_repeats(docs).drop("kept")
    assert sorted(map(tuple, found.collect())) == brute_removal(rows)


def test_repeated_substrings_empty(nothing):
    assert substrings.remove_repeats(nothing).count() == 0


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(rows, items):
    out = []
    for i, t, _ in rows:
        words, hit, names = alnum(t), set(), set()
        for name, item in items:
            own = alnum(item)
            n = min(13, len(own))
            for s in range(len(own) - n + 1 if n else 0):
                for k in range(len(words) - n + 1):
                    if words[k : k + n] == own[s : s + n]:
                        hit.update(range(k, k + n))
                        names.add(str(name) if name is not None else "")
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out)


def items_of(rows):
    long_ = rows[89][1].split()
    return [(1, " ".join(long_[100:130])), (2, rows[5][1]), (3, "one two"), (4, None), (5, "  "), (None, "w1 w2 w3"), (6, " ".join(long_[110:140]))]


def test_decontamination(spark, docs, rows):
    items = items_of(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.scan_documents(docs, bench)
    assert sorted(map(tuple, found.collect())) == brute_hits(rows, items)
    clean = decontam.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(x[0] for x in brute_hits(rows, items) if not x[-1])


def test_decontamination_in_blocks_and_empty(spark, docs, rows, nothing, monkeypatch):
    items = items_of(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", (150,))
    assert sorted(map(tuple, decontam.scan_documents(docs, bench).collect())) == brute_hits(rows, items)
    assert decontam.scan_documents(docs, bench.where("item_id < 0")).where("n_hit > 0").count() == 0
    assert decontam.scan_documents(nothing, bench).count() == 0
