"""Queries that have no SQL do the whole job: all rows, whole values, the full number of draws."""

import math
import random

import __spark_entry__ as entry
from verdigris.functions import similarity, stats
from verdigris.plans.bindings import table


def plain_edit_counts(ref, hyp):
    row = [(j, 0, 0, j) for j in range(len(hyp) + 1)]  # cost, substituted, deleted, inserted
    for i, r in enumerate(ref, 1):
        new = [(i, 0, i, 0)]
        for j, h in enumerate(hyp, 1):
            c, s, d, n = row[j - 1]
            best = (c, s, d, n) if r == h else (c + 1, s + 1, d, n)
            c, s, d, n = row[j]
            if c + 1 < best[0]:
                best = (c + 1, s, d + 1, n)
            c, s, d, n = new[j - 1]
            if c + 1 < best[0]:
                best = (c + 1, s, d, n + 1)
            new.append(best)
        row = new
    return row[-1][1:]


def test_edit_counts_by_both_ways():
    rng = random.Random(4)
    pairs = [("", ""), ("", "ab"), ("ab", ""), ("a", "b"), ("abcabc", "abc"), ("é𝄞x", "x𝄞é"), (["the", "a"], ["a", "teh"])]
    for _ in range(1500):
        letters = "ab" if rng.random() < 0.5 else "abcdefgh"
        pairs.append(tuple("".join(rng.choices(letters, k=rng.randrange(40))) for _ in "rh"))
    for _ in range(40):
        one = rng.choices("abcdef", k=rng.randrange(200, 400))
        two = list(one)
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(two))
            two[at : at + rng.randrange(3)] = rng.choices("abcdef", k=rng.randrange(3))
        pairs.append(("".join(one), "".join(two)))
    for ref, hyp in pairs:
        want = plain_edit_counts(ref, hyp)
        assert similarity.edit_counts(ref, hyp) == want, (ref, hyp)
        assert similarity._many_edits(*similarity._codes(ref, hyp), 1) == want, (ref, hyp)
    assert similarity._few_edits(*similarity._codes("abcdef", "ghijkl"), 5) is None


def test_edit_counts_of_long_texts():
    rng = random.Random(7)
    text = " ".join(rng.choices(["the", "of", "wort", "\u0e01\u0e32", "house"], k=20_000))
    assert sum(similarity.edit_counts(text, text[3:].replace("the", "teh"))) <= 3 + 2 * text.count("the")
    assert similarity.edit_counts(text, text) == (0, 0, 0)


def test_transcript_scores_take_whole_texts_of_all_rows(spark, small):
    texts = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    seen = {r["doc_id"] for r in entry.queries()["t05_runaways"](spark, small).collect()}
    assert seen == set(texts)
    for name, cut in (("t01_edit_counts", list), ("t03_word_errors", str.split)):
        rows = entry.queries()[name](spark, small).collect()
        assert max(r["units"] for r in rows) > 120 and {r["doc_id"] % 3 for r in rows} == {0, 1, 2}
        for r in rows:
            ref = texts[r["doc_id"]]
            assert name != "t01_edit_counts" or r["units"] == len(ref)
            if len(ref) < 400:
                want = plain_edit_counts(cut(ref), cut(ref[3:].replace("the", "teh")))
                assert (r["substituted"], r["deleted"], r["inserted"]) == want, ref


def test_bootstrap_has_all_arms_and_all_resamples(spark, small):
    rows = {r["arm"]: r for r in entry.queries()["c13_bootstrap"](spark, small).collect()}
    assert set(rows) == {None, *(f"d{i}" for i in range(10))}
    assert sum(r["n"] for r in rows.values()) == entry.queries()["c04_clusters"](spark, small).count()
    # a law that is known: of n clusters, k for one arm, the others for none
    n, k = 500, 100
    one = spark.createDataFrame([("a", 0, int(i < k)) for i in range(n)] + [(None, 1, 0)], "arm string, inc_only int, cand_only int")
    got = {r["arm"]: r for r in stats.cluster_bootstrap(one, "arm").collect()}
    assert (got[None]["n"], got[None]["low"], got[None]["high"]) == (1, -1.0, -1.0)

    def below(x):  # P(X <= x) of a binomial
        return math.fsum(math.comb(n, i) * (k / n) ** i * (1 - k / n) ** (n - i) for i in range(x + 1))

    low, high = round(got["a"]["low"] * n), round(got["a"]["high"] * n)
    assert abs(below(low) - 1 / 64) < 0.006 and abs(below(high) - 63 / 64) < 0.006


def test_rates_distances_and_outliers_of_a_small_table(spark, tmp_path):
    rng = random.Random(12)
    texts = [" ".join(rng.choices(["the", "cat", "on", "mat", "ก", "é"], k=rng.randrange(1, 25))) for _ in range(30)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ask = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    counts = {i: (plain_edit_counts(t, t[3:].replace("the", "teh")), len(t)) for i, t in enumerate(texts)}
    errors = {i: sum(e) for i, (e, _) in counts.items()}
    assert {r["doc_id"]: r["distance"] for r in ask("t02_edit_distance")} == errors
    (one,) = ask("t06_pooled_rate")
    units = sum(n for _, n in counts.values())
    assert (one["items"], one["errors"], one["units"], one["rate"]) == (30, sum(errors.values()), units, round(sum(errors.values()) / units, 6))
    families = {f: [i for i in counts if i % 4 == f] for f in range(4)}
    assert {r["family"]: r["errors"] for r in ask("t07_rate_by_family")} == {f: sum(errors[i] for i in own) for f, own in families.items()}
    worst = {f: max(own, key=lambda i: (errors[i], -i)) for f, own in families.items()}
    got = {r["family"]: (r["worst"], r["share"]) for r in ask("t11_outlier_share")}
    assert got == {f: (w, round(errors[w] / sum(errors[i] for i in families[f]), 6)) for f, w in worst.items()}


def test_edit_counts_have_a_row_of_every_document(spark, tmp_path):
    """Texts that repeat themselves were taken for runaways and left out."""
    loop = "the same line is said once more and again by the cat, " * 12
    texts = ["on the mat the cat sat", loop, loop[:-9] + "the end", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, cut in (("t01_edit_counts", list), ("t03_word_errors", str.split)):
        got = {r["doc_id"]: (r["substituted"], r["deleted"], r["inserted"], r["units"]) for r in entry.queries()[name](spark, str(tmp_path)).collect()}
        assert got.pop(4) == (None,) * 4
        assert got == {i: (*plain_edit_counts(cut(t), cut(t[3:].replace("the", "teh"))), len(cut(t))) for i, t in enumerate(texts[:-1])}
