import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, node long, key int, marks int, shard int, size string"


def make(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, 2, 3, 4, "y") for i, t, s in rows], SCHEMA)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, a repeated row, null, empty, blank, tiny and long texts."""
    rng = random.Random(5)
    out = [(i, prose(rng, rng.randrange(3, 90)), f"s{i % 3}" if i % 7 else None) for i in range(60)]
    base = prose(rng, 120)
    for i in range(60, 80):
        words = base.split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = f"e{rng.randrange(999)}"
        out.append((i, " ".join(words), "hot"))
    out += [(80, base, "hot"), (81, None, "s1"), (82, "", "s1"), (83, " \n\t ", None), (84, "one", "s2"), (85, "One two", "s2"), (86, "one two", "s2")]
    out += [(87, out[3][1], "s0"), (88, "Éa straße ﬁ İ " * 5, "s0"), (89, prose(rng, 6000), "s1"), (90, "ab " * 400, "s1"), (90, "ab " * 400, "s1")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return make(spark, rows).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return make(spark, [(1, "x", "s")]).where("doc_id < 0")
