"""License scan: base phrases, and an exact set-similarity join with templates.

A block is a window of a text's words, whatever the lines, taken as a set: for a
template of up to w words, w a power of two, windows of 2 w words begin at every
w-th word, so what is as long as the template lies whole in one of them. A
template (a sentence of a licence notice, as a set of words) is found in every
block that holds at least `threshold` of the template's words. The join is exact:

* tokens are ordered globally, rare first, by their count over all documents;
* prefix filter: a block that holds `need = ceil(threshold * n)` of a
  template's n tokens holds one of its first n - need + 1, so only these are
  join keys, and a document with none of them is not unpacked at all;
* length filter: a block needs `need` tokens of the vocabulary;
* positional filter: what can still follow the first shared token, in the
  block and in the template, must reach `need`;
* what is left is verified by intersecting the token sets.

Everything is DataFrame functions. The templates are a fixed list of the
caller's, so the join's template side, a few rows a template, is broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases and the labels of the base scan.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label and wording of common licence notices, one sentence each.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd 3 clause license"),
    ("gpl", "this work is licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under cc by"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-nd", "licensed under cc by nd"),
    ("cc-by", "this work is licensed under a creative commons attribution international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.85
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


LEAST_STEP = 8


def template_tokens(templates=TEMPLATES) -> list[tuple[int, str, list[str], int]]:
    """(number, label, sorted distinct words, step of its windows) of each template, cut as texts are."""
    import re

    out = []
    for i, (label, line) in enumerate(templates):
        words = [w for w in re.split(_NOT_WORD, line.lower()) if w]
        out.append((i, label, sorted(set(words)), max(LEAST_STEP, 1 << (len(words) - 1).bit_length())))
    return out


def spaced_words(text: Column) -> Column:
    """The text's words, lower case, each with a space on both sides, so that a
    run of words is found as a substring: ' all  rights  reserved '.

    lower() also folds letters beyond ASCII, none of which is in a phrase; the
    Kelvin sign alone would become an ASCII letter and is set aside first.
    """
    plain = F.lower(F.replace(text, F.lit("K"), F.lit("ĸ")))
    return F.concat(F.lit(" "), F.regexp_replace(plain, _NOT_WORD, "  "), F.lit(" "))


def _needle(phrase: str) -> str:
    return f" {'  '.join(phrase.split())} "


def _words_before(s: Column, chars: Column) -> Column:
    return F.regexp_count(F.left(s, chars), F.lit("[^ ]+")).cast("long")


def base_columns(s: Column, phrases=BASE_PHRASES) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word, base_labels (an array) from spaced words."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases:
        needle = _needle(phrase)
        there = s.contains(needle)
        gone = F.length(F.replace(s, F.lit(needle), F.lit("")))
        counts.append(F.when(there, ((F.length(s) - gone) / len(needle)).cast("long")).otherwise(F.lit(0)))
        firsts.append(F.when(there, _words_before(s, F.locate(needle, s) - 1)))
        back = F.locate(needle[::-1], F.reverse(s))
        lasts.append(F.when(there, _words_before(s, F.length(s) - back - len(needle) + 1)))
        labels.append(F.when(there, F.lit(label)))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return {
        "n_words": F.regexp_count(s, F.lit("[^ ]+")).cast("long"),
        "n_base": total.cast("long"),
        "first_word": F.least(*firsts) if len(firsts) > 1 else firsts[0],
        "last_word": F.greatest(*lasts) if len(lasts) > 1 else lasts[0],
        "base_labels": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def token_counts(spaced: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the vocabulary stands in all documents."""
    spark = spaced.sparkSession
    known = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    words = spaced.select(F.explode(F.split("s", " +")).alias("word"))
    found = words.join(F.broadcast(known), "word").groupBy("word").count().collect()  # one row a vocabulary word
    return {r["word"]: r["count"] for r in found}


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases=BASE_PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels
    (arrays, sorted, distinct), score: 1 where a base phrase stands, else the
    largest share of a template that a block of the text holds (0 if below the
    threshold).

    A null text is empty: no words, no labels, score 0. Null ids and repeated
    rows keep their rows; rows equal in doc_id and text have equal results. An
    empty table gives no rows. A template that matches with equal shares under
    several labels gives all of them. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    listed = template_tokens(templates)
    spaced = docs.select("doc_id", "text", spaced_words(F.coalesce("text", F.lit(""))).alias("s"))
    vocabulary = sorted({w for _, _, words, _ in listed for w in words})
    counts = token_counts(spaced, vocabulary)
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}

    index = []
    for i, label, words, step in listed:
        need = math.ceil(threshold * len(words) - 1e-9)
        by_rank = sorted(words, key=rank.get)
        index += [(by_rank[p], step, i, label, p, len(words), need, by_rank) for p in range(len(words) - need + 1)]
    keys = sorted({row[0] for row in index})
    index_df = spark.createDataFrame(index, "word string, step int, template int, label string, place int, n int, need int, tokens array<string>")

    # one pattern, so that the optimiser cannot copy the normalisation once for each key
    has_key = F.col("s").rlike(f" (?:{'|'.join(keys)}) ")
    key = F.xxhash64("text")
    base = spaced.select("doc_id", key.alias("tie"), *[c.alias(k) for k, c in base_columns(F.col("s"), phrases).items()])

    words = spaced.where(has_key).select("doc_id", key.alias("tie"), F.split(F.btrim("s"), " +").alias("words"))
    steps = F.array(*[F.lit(x) for x in sorted({row[1] for row in index})])
    blocks = words.select("doc_id", "tie", "words", F.explode(steps).alias("step"))
    starts = F.explode(F.sequence(F.lit(1), F.size("words"), F.col("step"))).alias("start")
    blocks = blocks.select("doc_id", "tie", "words", "step", starts).select("doc_id", "tie", "step", F.slice("words", F.col("start"), 2 * F.col("step")).alias("block"))
    blocks = blocks.where(F.arrays_overlap("block", F.array(*[F.lit(w) for w in keys])))
    ordered = F.array_intersect(F.array(*[F.lit(w) for w in order]), "block")  # keeps the global order
    blocks = blocks.select("doc_id", "tie", "step", ordered.alias("block")).where(F.size("block") >= int(min(r[6] for r in index)))
    hits = blocks.select("doc_id", "tie", "step", "block", F.posexplode("block").alias("at", "word")).join(F.broadcast(index_df), ["word", "step"])
    # from the first shared token on; an earlier one in the prefix is another row, which passes if this pair can match
    follows = F.least(F.size("block") - F.col("at"), F.col("n") - F.col("place"))
    earlier = F.least(F.col("at"), F.col("place"))
    hits = hits.where((F.size("block") >= F.col("need")) & (follows + earlier >= F.col("need")))
    shared = F.size(F.array_intersect("block", "tokens"))
    found = hits.where(shared >= F.col("need")).groupBy("doc_id", "tie").agg(
        F.array_sort(F.collect_set("label")).alias("found"), F.max(shared / F.col("n")).alias("share")
    )
    out = base.alias("b").join(found.alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("b.tie").eqNullSafe(F.col("f.tie")), "left")
    nothing = F.array().cast("array<string>")
    return out.select(
        "b.doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base_labels",
        F.array_sort(F.array_union("base_labels", F.coalesce("found", nothing))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def oracle_sql(templates=TEMPLATES, threshold: float = THRESHOLD, phrases=BASE_PHRASES) -> str:
    """The same by brute force: every window against every template, in DuckDB."""
    rows = []
    for i, label, words, step in template_tokens(templates):
        need = math.ceil(threshold * len(words) - 1e-9)
        rows.append(f"({i}, '{label}', {words!r}, {len(words)}, {need}, {step})")
    cut = lambda x: f"list_filter(string_split_regex(lower(replace({x}, 'K', 'ĸ')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    at = []
    for phrase, label in phrases:
        p = phrase.split()
        at.append(f"select k, i, '{label}' as label from numbered, unnest(range(len(words))) as r(i) where " + " and ".join(f"words[i + {n + 1}] = '{w}'" for n, w in enumerate(p)))
    return f"""
with numbered as (select row_number() over () as k, doc_id, text, {cut("coalesce(text, '')")} as words from documents),
templates(t, label, tokens, n, need, step) as (values {", ".join(rows)}),
blocks as (select k, step, list_distinct(words[i + 1 : i + 2 * step]) as block
  from numbered, (select distinct step from templates) as s, unnest(range(0, len(words), step)) as r(i)),
found as (select k, label, len(list_intersect(block, tokens)) / n as share from blocks join templates using (step)
  where len(list_intersect(block, tokens)) >= need),
base as ({" union all ".join(at)}),
base_sum as (select k, count(*) as n_base, min(i) as first_word, max(i) as last_word,
  array_to_string(list_sort(list(distinct label)), ',') as base_labels from base group by k),
labels as (select k, array_to_string(list_sort(list(distinct label)), ',') as labels
  from (select k, label from base union all select k, label from found) group by k),
shares as (select k, max(share) as share from found group by k)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  round(case when n_base > 0 then 1.0 else coalesce(share, 0.0) end, 6) as score
from numbered left join base_sum using (k) left join labels using (k) left join shares using (k)
"""
