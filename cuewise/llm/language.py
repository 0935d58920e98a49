"""Language identification: averaged hashed subword embeddings and a linear softmax.

Method: a text is the mean of the embeddings of its words' byte 3- and 4-grams
(hashed into a fixed number of rows); a linear softmax on that mean gives the
languages' scores.  Both are trained by stochastic gradient descent in numpy.
Part of the training rows is held back for calibration: a temperature that makes
the scores honest, and the score below which an answer counts as rejected.

Scale: training uses a bounded sample (``train_rows``, of a longer text a chunk of
``train_chars``) with a quota for each of the ``most_languages`` most frequent languages, chosen and ordered by a hash of id and text, so its cost does not follow the input.
Embeddings and softmax fold into one table with a row a bucket and a column a
language; prediction is a map over whole texts with gathers from that table, no shuffle.

Edge cases: a text that is null or has no letter is ``und`` with score 0; rows
without a language or id are not learnt from; repeated rows are learnt from and answered as often as they come, rows of
equal id each by its own text; without any training row all is
``und``; an empty table gives an empty result; further columns, of any name, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .hashed import averages, counted

GRAMS, BITS, WIDTH = (3, 4), 15, 16
UNKNOWN = "und"
_ALMOST_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a letter of any script is in a text; signs such as ² or Ⅷ are none."""
    found = _ALMOST_LETTER.search(text)
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text)))


@dataclass
class Model:
    """``table``: each bucket's contribution to each language's logit."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        return _softmax((averages(texts, self.table, GRAMS, BITS) + self.bias) / self.temperature)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[str], *, epochs: int = 4, rate: float = 2.0, seed: int = 1, aim: float = 0.99) -> Model | None:
    """Fit embeddings, softmax, temperature and rejection on the given rows."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    target = np.array([languages.index(x) for x in labels])
    rows = list(counted(texts, GRAMS, BITS))
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 20 else order
    fit = order[len(rows) // 5 :] if len(rows) >= 20 else order
    embed = rng.normal(0, 1 / WIDTH, (2**BITS, WIDTH)).astype(np.float32)
    weight, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            index, share = rows[i]
            mean = share @ embed[index]
            error = _softmax(mean @ weight + bias)
            error[target[i]] -= 1
            back = weight @ error
            weight -= step * np.outer(mean, error)
            bias -= 0.1 * step * error
            # A bucket's share of a text is small, so embeddings take larger steps.
            embed[index] -= 10 * step * share[:, None] * back
    model = Model(languages, embed @ weight, bias)
    logits = averages([texts[i] for i in held], model.table, GRAMS, BITS) + bias
    model.temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(held)), target[held]] + 1e-12).mean())
    chances = _softmax(logits / model.temperature)
    score, right = chances.max(axis=1), chances.argmax(axis=1) == target[held]
    for level in np.sort(np.unique(score))[::-1]:
        if right[score >= level].mean() < aim:
            break
        model.reject_below = float(level)
    return model


def quota(counts: dict[str, int], train_rows: int) -> int:
    """The most rows of one language with which all languages together give ``train_rows`` and no more; one at least."""
    left, rest = train_rows, sorted(counts.values())
    for k, n in enumerate(rest):
        if n * (len(rest) - k) >= left:
            return max(1, left // (len(rest) - k))
        left -= n
    return max([1, *rest])


def training_sample(docs: DataFrame, eligible: Column, *, train_rows: int, train_chars: int, most_languages: int = 500) -> tuple[list[str], list[str]]:
    """Up to a common quota of eligible rows of each language by a hash of id and text; of a longer text a chunk of ``train_chars``."""
    rows = docs.where(eligible & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    space, hashed = 1 << 30, F.xxhash64("doc_id", "text")
    per_language = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.pmod(hashed, F.lit(space))).alias("first"))
    counts = {r["lang"]: r for r in per_language.orderBy(F.desc("n"), "lang").limit(min(train_rows, most_languages)).collect()}
    if not counts:
        return [], []
    most = quota({x: r["n"] for x, r in counts.items()}, train_rows)
    # A few more than the quota are drawn, so that hardly a language falls short of it; the first by hash at least.
    shares = [(x, max(r["first"] + 1, int(space * min(1.0, (most + 5 * most**0.5) / r["n"])))) for x, r in counts.items()]
    # One row a language, ``most_languages`` at most: what the driver holds can be sent to all tasks.
    drawn = rows.join(F.broadcast(docs.sparkSession.createDataFrame(shares, "of string, share long")), F.col("lang") == F.col("of"))
    drawn = drawn.where(F.pmod(hashed, F.lit(space)) < F.col("share"))
    begin = F.pmod(hashed, F.greatest(F.length("text") - train_chars + 1, F.lit(1))) + 1
    drawn = drawn.select(F.substring("text", begin.cast("int"), F.lit(train_chars)).alias("text"), "lang", hashed.alias("hash"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "text"))
    found = drawn.withColumn("turn", turn).where(F.col("turn") <= most).orderBy("lang", "turn").select("text", "lang").toPandas()
    return found["text"].tolist(), found["lang"].tolist()


def predict(docs: DataFrame, model: Model | None, *columns: Column) -> DataFrame:
    """``columns``, then lang_pred, score and rejected, for each row of ``docs``."""
    kept = docs.select(*columns, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]) + ", lang_pred string, score double, rejected boolean"
    names = [*kept.columns[:-1], "lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            known = np.array([model is not None and t is not None and has_letter(t) for t in texts], bool)
            chances = model.probabilities(texts) if model is not None else np.zeros((len(texts), 1))
            best = chances.argmax(axis=1) if len(texts) else np.zeros(0, int)
            score = np.where(known, chances.max(axis=1, initial=0), 0.0)
            answers = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            rejected = ~known | (score < (model.reject_below if model is not None else 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(answers, pa.string()), pa.array(score), pa.array(rejected)], names=names)

    return kept.mapInArrow(run, schema)


def identify(docs: DataFrame, *, train_rows: int = 4000, train_chars: int = 20_000, most_languages: int = 500) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row.

    Learnt are the ``most_languages`` languages with the most rows, from ``train_rows`` rows in all.

    Rows whose id, as text, has a CRC-32 of remainder 2 modulo 4 are held out from
    all training; ``rejected`` marks answers below the calibrated score.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(*training_sample(docs, ~held_out, train_rows=train_rows, train_chars=train_chars, most_languages=most_languages))
    return predict(docs, model, F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"))
