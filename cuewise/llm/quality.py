"""Weak-label quality classifier.

Method: overlapping heuristic labellers vote good, bad or nothing on each document.
Expectation-maximisation over the votes estimates how often each is right for
good and for bad documents, and how common those are, without any true label.  The
posteriors label a training sample for a linear scorer on hashed byte n-grams and
two measured shares that n-grams cannot hold: words that repeat the word before, and lines that
repeat an earlier line.  Labellers only teach: no vote is a feature of the scorer, which
decides on every document from its whole text, whether anybody voted or not.

Scale: votes depend on a text alone, so their patterns are counted in one pass;
three outcomes a labeller bound the number of patterns (3^9), and only those
counts reach the driver.  The scorer is fitted on a bounded sample (``train_rows``,
of a longer text a chunk of ``train_chars``; its votes are those of the whole text), chosen and
ordered by a hash of id and text.  Scoring is a map without a shuffle and without votes, unless
their posterior is asked for; the model's size is fixed.

Edge cases: a null, empty or blank text has no votes, quality null, and is kept
only by ``keep_empty``; ties in the score go to keep; rows with equal or null ids
are scored alone; an empty table gives an empty result; further columns pass, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .hashed import averages, counted

GRAMS, BITS = (2, 3), 16
GOOD, BAD, NONE = 1, 0, 2
#: What a share of repeats counts as a feature, beside n-grams' shares.
REPEATS = 0.3
#: A one-sided labeller's rate on good documents starts from this share of its rate on bad ones.
FALSE_ALARM = 0.005
#: Very common words of four languages.
COMMON = frozenset(
    "the of and to in is that for it was on with be by this la le les de des et en un une que est pour dans il el los las del se y con por para der die das und ist ein eine den von zu mit nicht auf sich es".split()
)
#: Characters that are no symbols, besides letters.
LISTED = " \n\t.,;:'-\"()?!|0123456789"
#: The first six look for one kind of junk and say nothing when they do not find it.
LABELLERS = ("symbols", "capitals", "shouting", "bars", "repeated_lines", "repeated_words", "common_words", "word_length", "sentences")
ONE_SIDED = 6


def _fault(value: float, bad_from: float) -> int:
    return BAD if value >= bad_from else NONE


def _vote(value: float, bad_below: float, good_from: float) -> int:
    return BAD if value < bad_below else GOOD if value >= good_from else NONE


def _unlisted(text: str) -> tuple[int, frozenset[str]]:
    """How many characters are neither letters, marks, numbers or punctuation of any script nor listed, and the marks."""
    rest, marks = 0, set()
    for c, n in Counter(text).items():
        kind = "L" if c in LISTED else unicodedata.category(c)[0]
        if kind == "M":
            marks.add(c)
        elif kind != "L" and (c.isascii() or kind not in "NPZ"):
            rest += n
    return rest, frozenset(marks)


def votes(text: str | None) -> tuple[int, ...] | None:
    """Each labeller's vote on a text; None where there are no words."""
    words = (text or "").split()
    if not words:
        return None
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    n, chars = len(words), len(text)
    odd, marks = len(text) - letters - sum(map(text.count, LISTED)), frozenset()
    if odd >= 0.03 * len(text) and not text.isascii():
        odd, marks = _unlisted(text)
        letters += sum(map(text.count, marks))
    lines = [x for x in text.split("\n") if x.strip()]
    lowered = text.lower().split()
    stutter = NONE if n < 20 else _fault(sum(map(eq, words, words[1:])) / n, 0.1)
    bare = text.translate(dict.fromkeys(map(ord, marks))).split() if marks else words
    # Scripts without spaces give long "words".
    unspaced = letters / n > 14 and sum(map("\u0e00".__le__, text)) > chars / 2
    few = n < 10 or stutter == BAD  # too little for the last three to judge by
    return (
        NONE if n < 5 else _fault(odd / chars, 0.03),
        NONE if letters < 20 else _fault(upper / letters, 0.35),
        _fault((text.count("!!") + text.count("??") + text.count("$$")) / n, 0.05),
        _fault(text.count("|") / n, 0.08),
        NONE if len(lines) < 8 else _fault(1 - len(set(lines)) / len(lines), 0.5),
        stutter,
        # Few of the known words: another language, as far as this one can tell.
        NONE if few or n < 30 else GOOD if sum(map(COMMON.__contains__, lowered)) / n >= 0.08 else NONE,
        NONE if few or unspaced else GOOD if 2.5 <= letters / n <= 9 else BAD if letters / n > 14 or letters / n < 1.5 else NONE,
        NONE if few else _vote(sum(map(str.isalpha, bare)) / n, 0.4, 0.7),
    )


def pattern(found: tuple[int, ...] | None) -> int | None:
    """Votes as one number in base 3."""
    return None if found is None else sum(v * 3**k for k, v in enumerate(found))


@dataclass
class LabelModel:
    """``rates[k, y, v]``: how often labeller ``k`` votes ``v`` when the truth is ``y``."""

    rates: np.ndarray
    prior: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance of good for each vote pattern."""
        digits = patterns[:, None] // 3 ** np.arange(len(self.rates)) % 3
        chance = [np.log(p) + np.log(self.rates[np.arange(len(self.rates)), y, digits]).sum(axis=1) for y, p in ((BAD, 1 - self.prior), (GOOD, self.prior))]
        return 1 / (1 + np.exp(np.clip(chance[0] - chance[1], -500, 500)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, *, rounds: int = 60, prior: float = 0.8, trust: float = 0.85) -> LabelModel:
    """Expectation-maximisation over counted vote patterns.

    It starts from labellers that are right at rate ``trust`` when they vote, which also
    settles which of the two classes is the good one.
    """
    k = len(LABELLERS)
    digits = patterns[:, None] // 3 ** np.arange(k) % 3
    both = [[trust, 1 - trust, 1.0], [1 - trust, trust, 1.0]]
    fault = [[0.4, 0.0, 1.0], [0.4 * FALSE_ALARM, 0.0, 1.0]]
    start = np.array([fault if x < ONE_SIDED else both for x in range(k)]) + 1e-6
    model = LabelModel(start, prior)
    for _ in range(rounds):
        good = model.posterior(patterns)
        rates = np.empty_like(model.rates)
        for y, weight in ((BAD, counts * (1 - good)), (GOOD, counts * good)):
            for v in (0, 1, 2):
                # Smoothing worth ten documents keeps the starting belief where votes are few.
                rates[:, y, v] = (weight[:, None] * (digits == v)).sum(axis=0) + 10 * start[:, y, v]
        rates[: ONE_SIDED + 1] /= rates[: ONE_SIDED + 1].sum(axis=2, keepdims=True)
        rates[ONE_SIDED + 1 :] /= rates[ONE_SIDED + 1 :, :, :NONE].sum(axis=2, keepdims=True)
        # Saying nothing is no evidence: the fault is another one, or the text too short to judge.
        rates[:, :, NONE] = 1
        model = LabelModel(rates, float(np.clip((counts * good).sum() / counts.sum(), 0.01, 0.99)))
    return model


def repeats(text: str) -> tuple[float, float]:
    """The shares of words that equal the word before, and of lines that an earlier line equals."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    return sum(map(eq, words, words[1:])) / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0


@dataclass
class Scorer:
    """Weights of the n-grams' buckets, then of the two shares of repeats."""

    weight: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        """Quality of each text from 0 to 1."""
        shares = np.array([repeats(t) for t in texts]).reshape(-1, 2) @ self.weight[2**BITS :] * REPEATS
        return 1 / (1 + np.exp(-np.clip(averages(texts, self.weight[: 2**BITS, None], GRAMS, BITS)[:, 0] + shares + self.bias, -500, 500)))


def fit_scorer(texts: list[str], target: np.ndarray, *, epochs: int = 6, rate: float = 60.0, seed: int = 3) -> Scorer:
    """Logistic regression on shares of n-grams and repeats by stochastic gradient descent, both classes weighing the same."""
    rows, rng, slots = [], np.random.default_rng(seed), 2**BITS + np.arange(2)
    for (index, part), text in zip(counted(texts, GRAMS, BITS), texts, strict=True):
        rows.append((np.concatenate([index.astype(np.int64), slots]), np.concatenate([part, np.multiply(repeats(text), REPEATS)])))
    weight, bias = np.zeros(2**BITS + 2), 0.0
    share = np.clip(target.mean(), 0.02, 0.98) if len(target) else 0.5
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(rows)):
            index, part = rows[i]
            p = 1 / (1 + np.exp(-np.clip(weight[index] @ part + bias, -500, 500)))
            error = (p - target[i]) * (target[i] * 0.5 / share + (1 - target[i]) * 0.5 / (1 - share))
            np.subtract.at(weight, index, step * error * part)
            bias -= 0.01 * error
    return Scorer(weight, bias)


def _with_votes(rows: DataFrame) -> DataFrame:
    """Rows (hash, text) as (hash, votes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pattern(votes(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], names=["hash", "votes"])

    return rows.mapInArrow(run, "hash long, votes int")


def _sample(rows: DataFrame, below: int, train_rows: int, train_chars: int) -> tuple[list[str], np.ndarray]:
    """Texts, or chunks of longer ones, and vote patterns of the rows (hash, text) that come first by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [pattern(votes(t)) for t in texts]
            begin = [h % max(1, len(t or "") - train_chars + 1) for h, t in zip(batch.column(0).to_pylist(), texts, strict=True)]
            chunks = [(t or "")[a : a + train_chars] for t, a in zip(texts, begin, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32()), pa.array(chunks, pa.string())], names=["hash", "votes", "text"])

    some = rows.where(F.col("hash") < below).mapInArrow(run, "hash long, votes int, text string").where("votes is not null")
    # Without a vote the posterior is the prior, which teaches nothing about the text.
    nothing = sum(NONE * 3**k for k in range(len(LABELLERS)))
    first = some.where(F.col("votes") != nothing).orderBy("hash", "text").limit(train_rows).toPandas()
    return first["text"].tolist(), first["votes"].to_numpy(np.int64)


def fit(docs: DataFrame, *, train_rows: int = 6000, train_chars: int = 20_000) -> tuple[LabelModel, Scorer] | None:
    """Label model from all documents' votes, scorer from a bounded sample; None without any words."""
    space = 1 << 30
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(space)).alias("hash"), "text")
    counts = _with_votes(rows).where("votes is not null").groupBy("votes").agg(F.count("*").alias("n"), F.min("hash").alias("first")).toPandas()
    if not len(counts):
        return None
    patterns = counts["votes"].to_numpy(np.int64)
    labels = fit_labels(patterns, counts["n"].to_numpy(float))
    # A few more are drawn than are wanted; one at least, however many rows repeat.
    share = int(space * min(1.0, (train_rows + 5 * train_rows**0.5) / counts["n"].sum()))
    texts, found = _sample(rows, max(share, int(counts["first"].min()) + 1), train_rows, train_chars)
    return labels, fit_scorer(texts, labels.posterior(found))


def _scored(docs: DataFrame, model: tuple[LabelModel, Scorer] | None, *, voted: bool = False) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ..., then posterior (of the votes, if ``voted``) and quality (of the scorer)."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            some = np.array([bool(t) and not t.isspace() for t in texts], bool)
            posterior, quality = np.full(len(texts), np.nan), np.full(len(texts), np.nan)
            if model is not None and some.any():
                worded = [t for t, s in zip(texts, some, strict=True) if s]
                quality[some] = model[1].score(worded)
                if voted:
                    posterior[some] = model[0].posterior(np.array([pattern(votes(t)) for t in worded], np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(posterior, from_pandas=True), pa.array(quality, from_pandas=True)], names=[*names, "posterior", "quality"])

    schema = StructType([*(StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)), StructField("posterior", DoubleType()), StructField("quality", DoubleType())])
    return docs.toDF(*names).mapInArrow(run, schema)


def classify(docs: DataFrame, *, keep_from: float = 0.5, train_rows: int = 6000, train_chars: int = 20_000, keep_empty: bool = False) -> DataFrame:
    """doc_id, posterior, quality and keep for every row."""
    scored = _scored(docs.select("doc_id", "text"), fit(docs, train_rows=train_rows, train_chars=train_chars), voted=True)
    return scored.select(F.col("c0").alias("doc_id"), "posterior", "quality", F.coalesce(F.col("quality") >= keep_from, F.lit(keep_empty)).alias("keep"))


def kept_documents(docs: DataFrame, *, keep_from: float = 0.5, train_rows: int = 6000, train_chars: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    kept = _scored(docs, fit(docs, train_rows=train_rows, train_chars=train_chars)).where(F.col("quality") >= keep_from)
    return kept.drop("posterior", "quality").toDF(*docs.columns)
