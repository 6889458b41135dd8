"""Toxicity by weak supervision.

Voters mark texts: lexicon voters hold one insult each, pattern voters a word
stem in 1, 2 .. LEVELS different words of a text. Pattern voters are chosen on
the labelled texts of the training part: those that labelled toxic texts share
and clean ones hardly have. No label goes further than that choice.

A generative model of the votes, fitted by expectation maximisation without
labels, estimates how often each voter fires in clean texts and in each of up to
KINDS kinds of toxic ones, and the correlation of each two voters, overall and
given the kind; voters that move together share one voter's evidence. It starts from the votes alone. Its
posteriors are the targets of a logistic regression over stems and words, which
scores every text.

Stems are found, and both models fitted, on at most MAX_LABELLED labelled texts
in the order of a hash of their id, of the training part; the ids are what is
broadcast. Scoring is one pass, nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .rows import rows_where
from .scratch import bounded_batches, written

#: Words of the lexicon voters.
LEXICON = (
    "idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "clown", "disgusting",
    "dumb", "imbecile", "fool", "jerk", "vermin", "garbage", "filth", "creep", "coward", "freak",
)
MAX_LABELLED = 20_000
#: Bytes of a stem, which is a proper beginning of a word; a feature is a stem in 1, 2 .. LEVELS different words.
STEMS = (4, 5, 6, 7)
LEVELS = 3
#: Size of the models, whatever the data: voters of the label model, features of the classifier.
MAX_VOTERS, MAX_FEATURES = 256, 512
#: A stem must be in so many labelled toxic texts (and half the square root of
#: their number), with at least this likelihood ratio statistic and share of toxic texts.
LEAST_TEXTS, LEAST_RATIO, LEAST_SHARE = 3, 11.0, 0.85
#: From this correlation on voters share their evidence: given the class, and overall, where only copies are so near.
CORRELATED, COPIED = 0.5, 0.9
#: Kinds of toxic texts that the label model can tell apart: voters of one kind rest where another kind is.
KINDS = 8
#: Texts that the driver centres at a time when it fits the label model.
ROWS = 1 << 11
_WHOLE = np.uint64(0x27D4EB2F165667C5)


def _distinct(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the distinct (doc, key) pairs first are, sorted by pair, and how often each is there."""
    order = np.lexsort((keys, doc))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


def features(block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's distinct words and of their stems, with the document."""
    starts, ends, words, first = block.words(tb.ALNUM)
    doc = np.repeat(np.arange(block.n), np.diff(first))
    own, _ = _distinct(doc, words)
    starts, ends, words, doc = starts[own], ends[own], words[own], doc[own]
    n = len(block.data)
    up, down = tb.powers(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(tb._BYTE[tb.LOWER[block.data]] * up[:n], dtype=np.uint64, out=run[1:])
    found, owner = [words ^ _WHOLE], [doc]
    for size in STEMS:
        longer = ends - starts > size
        s = starts[longer]
        found.append(tb.mix((run[s + size] - run[s]) * down[s] + np.array(size, np.uint64)[None] * tb._BASE))
        owner.append(doc[longer])
    return np.concatenate(found), np.concatenate(owner)


def _levels(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hashes met in so many words: which hash, and each level it reaches."""
    top = np.minimum(times, LEVELS)
    of = np.repeat(np.arange(len(times)), top)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(top) - top, top)


def lexicon_hashes() -> np.ndarray:
    out = []
    for block in tb.blocks(pa.array(LEXICON)):
        out.append(block.words(tb.ALNUM)[2] ^ _WHOLE)
    return np.concatenate(out)


def _incidence(block: tb.Block, known: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, LEVELS * place in known + level) of the features a document has, distinct, by document; known is sorted."""
    hashes, doc = features(block)
    some = np.flatnonzero(sieve[(hashes >> np.uint64(48)).astype(np.int64)])
    place = np.minimum(np.searchsorted(known, hashes[some]), len(known) - 1)
    ok = known[place] == hashes[some]
    pairs, times = np.unique(doc[some[ok]] * len(known) + place[ok], return_counts=True)
    of, level = _levels(times)
    return pairs[of] // len(known), pairs[of] % len(known) * LEVELS + level


def _sieve(known: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 16, bool)
    out[(known >> np.uint64(48)).astype(np.int64)] = True
    return out


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def training_ids(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, toxic of up to `most` labelled rows of the training part; the label is the greatest of repeated rows."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _stem_counts(texts: DataFrame, known: np.ndarray | None) -> DataFrame:
    """(text, toxic) -> feature, level, toxic and clean texts that have it; of the known features, if given."""
    sieve = None if known is None else _sieve(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for block in tb.blocks(batch.column(0)):
                if known is None:
                    hashes, doc = features(block)
                    own, times = _distinct(doc, hashes)
                    of, level = _levels(times)
                    hashes, doc = hashes[own[of]], doc[own[of]]
                else:
                    doc, place = _incidence(block, known, sieve)
                    hashes, level = known[place // LEVELS], place % LEVELS
                held.append((level, hashes, toxic[block.lo + doc]))
        if held:
            level, hashes, is_toxic = (np.concatenate(x) for x in zip(*held, strict=True))
            at, total = _distinct(level, hashes)
            place = np.empty(len(level), np.int64)
            order = np.lexsort((hashes, level))
            place[order] = np.repeat(np.arange(len(at)), total)
            bad = np.bincount(place, is_toxic, len(at)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[at].view(np.int64)), pa.array(level[at].astype(np.int32)), pa.array(bad), pa.array(total - bad)], ["feature", "level", "bad", "good"]
            )

    rows = texts.select("text", "toxic").mapInArrow(count, "feature long, level int, bad long, good long")
    return rows.groupBy("feature", "level").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _ratio(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> np.ndarray:
    """Likelihood ratio statistic of a feature leaning to the toxic texts; 0 if it leans the other way."""
    seen, total = bad + good, n_bad + n_good
    term = lambda k, e: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(e, 1e-9)), 0)
    g = term(bad, seen * n_bad / total) + term(good, seen * n_good / total)
    g += term(n_bad - bad, (total - seen) * n_bad / total) + term(n_good - good, (total - seen) * n_good / total)
    return np.where(bad * n_good > good * n_bad, 2 * g, 0)


@dataclass
class LabelModel:
    """Share of texts of each kind, the last being the clean ones; how often each
    voter fires in them (voters x kinds); correlation of each two voters given the
    kind; each one's share of the evidence of the voters it moves with."""

    rates: np.ndarray
    fires: np.ndarray
    correlation: np.ndarray
    share: np.ndarray

    @property
    def toxic(self) -> np.ndarray:
        return self.fires[:, :-1] @ self.rates[:-1] / self.rates[:-1].sum()

    @property
    def clean(self) -> np.ndarray:
        return self.fires[:, -1]

    def kinds(self, votes: np.ndarray) -> np.ndarray:
        rests = np.log(1 - self.fires) * self.share[:, None]
        odds = np.log(self.rates) + rests.sum(axis=0) + votes @ (np.log(self.fires) * self.share[:, None] - rests)
        odds = np.exp(odds - odds.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def posteriors(self, votes: np.ndarray) -> np.ndarray:
        return 1 - self.kinds(votes)[:, -1]


def _correlations(votes: np.ndarray, part: np.ndarray, fires: np.ndarray) -> np.ndarray:
    """Of the voters (columns), around what each text's part in the kinds has them fire; ROWS texts at a time."""
    cov = np.zeros((votes.shape[1], votes.shape[1]))
    for lo in range(0, len(votes), ROWS):
        centred = votes[lo : lo + ROWS] - part[lo : lo + ROWS] @ fires.T
        cov += centred.T @ centred
    cov /= max(len(votes), 1)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    out = cov / np.outer(sd, sd)
    np.fill_diagonal(out, 0)
    return out


def label_model(votes: np.ndarray, rounds: int = 25) -> LabelModel:
    """Fitted to votes (0/1; texts x voters) alone, by expectation maximisation.

    Voters are taken to fire more in toxic texts: the first guess of a text is how
    many fire in it, a group of copies being one voter, against the mean of all
    texts. Kinds start as the texts of the voter that fires most in what no kind
    has yet. That a voter rests is evidence as well. A voter's log odds are divided
    by one plus its strong correlations with the others.
    """
    votes = votes.astype(np.float64)
    n, overall = len(votes), _correlations(votes, np.ones((len(votes), 1)), votes.mean(axis=0)[:, None])
    copies = np.where(overall >= COPIED, overall, 0.0)
    fired = votes @ (1 / (1 + copies.sum(axis=1)))
    guess = (fired / max(fired.mean(), 1e-9)) ** 2
    left = np.clip(guess / (guess + 1), 0.01, 0.99)
    parts: list[np.ndarray] = []
    while len(parts) < KINDS:
        own = left * votes[:, np.argmax(left @ votes)]
        if parts and own.sum() < max(5, n**0.5 / 8):
            break
        parts.append(own)
        left = left - own
    part = np.stack([*parts, 1 - np.sum(parts, axis=0)], axis=1)
    for _ in range(rounds):
        rates = (part.sum(axis=0) + 1) / (n + part.shape[1])
        fires = np.minimum((votes.T @ part + 0.02) / (part.sum(axis=0) + 1), 0.999)
        given = _correlations(votes, part, fires)
        share = 1 / (1 + np.maximum(np.where(given >= CORRELATED, given, 0.0), copies).sum(axis=1))
        model = LabelModel(rates, fires, given, share)
        part = model.kinds(votes)
    return model


def fit_linear(x: np.ndarray, target: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by full gradient steps with momentum scaling."""
    w, b = np.zeros(x.shape[1]), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        off = (1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype) + b, -50, 50))) - target).astype(x.dtype)
        g, gb = x.T @ off / len(x) + decay * w, off.mean()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        s = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= s * m / (np.sqrt(v) + 1e-8)
        b -= s * mb / (np.sqrt(vb) + 1e-8)
    return w, b


@dataclass
class Scorer:
    """A linear classifier over features: sorted hashes, the weights of their levels, the constant."""

    known: np.ndarray
    weights: np.ndarray
    constant: float

    def scores(self, block: tb.Block) -> np.ndarray:
        doc, place = _incidence(block, self.known, _sieve(self.known))
        z = self.constant + np.bincount(doc, self.weights[place], block.n)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _lexicon_scorer(lexicon: np.ndarray) -> Scorer:
    known = np.unique(lexicon)
    return Scorer(known, np.repeat([[6.0] + [0.0] * (LEVELS - 1)], len(known), axis=0).ravel(), -3.0)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Scorer:
    """Voters, label model and classifier. Without labelled rows of both kinds,
    the lexicon alone votes and a text with one of its words scores above half."""
    spark = docs.sparkSession
    bounded_batches(spark)
    lexicon = lexicon_hashes()
    ids = [(r["doc_id"], r["toxic"]) for r in training_ids(labels, most).collect()]  # `most` ids at most
    n_bad = sum(x for _, x in ids)
    if not n_bad or n_bad == len(ids):
        return _lexicon_scorer(lexicon)
    chosen = spark.createDataFrame(ids, "doc_id long, toxic int")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # one text an id, so that what is fitted on is as many texts as ids
    texts = written(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "labelled")

    least = max(LEAST_TEXTS, int(n_bad**0.5 / 2))
    rows = _stem_counts(texts.where("toxic = 1"), None).where(F.col("bad") >= least).select("feature").distinct()
    stems = np.sort(rows.toArrow().column("feature").to_numpy()).view(np.uint64)  # of the bounded sample's texts
    counted = _stem_counts(texts, np.unique(np.concatenate([stems, lexicon]))).toArrow()  # LEVELS rows a stem at most
    key = counted.column("feature").to_numpy().view(np.uint64)
    level, bad, good = (counted.column(k).to_numpy().astype(np.int64) for k in ("level", "bad", "good"))
    ratio = _ratio(bad, good, n_bad, len(ids) - n_bad)
    ratio[(bad < least) | (bad < LEAST_SHARE * (bad + good)) | np.isin(key, lexicon)] = 0
    best = np.lexsort((level, key, -ratio))
    best = best[ratio[best] >= LEAST_RATIO][: MAX_FEATURES - len(lexicon)]
    known = np.unique(np.concatenate([key[best], lexicon]))
    sieve = _sieve(known)
    columns = np.concatenate([np.searchsorted(known, lexicon) * LEVELS, np.searchsorted(known, key[best]) * LEVELS + level[best]])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column(1)):
                doc, place = _incidence(block, known, sieve)
                ends = np.searchsorted(doc, np.arange(block.n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.n), pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))], ["doc_id", "at"])

    marked = texts.select("doc_id", "text").mapInArrow(mark, "doc_id long, at array<int>").orderBy("doc_id").select("at").toArrow().column("at")  # `most` texts' marks
    if not len(marked):
        return _lexicon_scorer(lexicon)
    column = np.full(len(known) * LEVELS, -1)
    column[columns] = np.arange(len(columns))
    x = np.zeros((len(marked), len(columns)), np.float32)
    first = 0
    for part in marked.chunks:
        text = first + np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
        own = column[part.flatten().to_numpy()]
        x[text[own >= 0], own[own >= 0]] = 1
        first += len(part)
    del counted, key, level, bad, good, ratio, marked
    votes = x[:, :MAX_VOTERS]  # the lexicon, then the stems from the best on
    votes = votes > 0
    fitted, constant = fit_linear(x, label_model(votes).posteriors(votes))
    weights = np.zeros(len(known) * LEVELS)
    weights[columns] = fitted
    return Scorer(known, weights, constant)


def score_texts(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.n), pa.array(shared.value.scores(block))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if the score is 0.5 or more).

    A null or empty text has no features and gets the score of such a text. A
    null doc_id counts as held out. Null or other labels than 0 and 1 are not
    learned from; repeated rows are scored each. An empty table gives no rows.
    Other columns, label, language and source among them, are not read.
    """
    out = score_texts(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, columns as given.

    Texts without words and null texts score as such a text does, below half;
    null ids and repeated rows are judged each by its text. An empty table gives
    no rows, and without labels the lexicon alone judges.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return rows_where(docs, lambda texts: np.concatenate([shared.value.scores(block) < 0.5 for block in tb.blocks(texts)]))
