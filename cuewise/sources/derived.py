"""Cue and word timelines derived from the ``documents`` table, in whole milliseconds.

A document is an episode and each of its non-empty lines a cue; durations and gaps
follow from text length and position, so every engine derives the same timeline.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import ArrayType, LongType

from ..operators.folds import dealt


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cues(spark: SparkSession, sf_dir: str, *, whole: bool = False) -> DataFrame:
    """(doc_id, line_no, text, start_ms, end_ms); ``whole``: documents are dealt, and not their lines, for what reads the text in
    several branches, as all of them then share one shuffle, whichever columns each one reads."""
    given = documents(spark, sf_dir).select("doc_id", "text")
    lines = (dealt(given, "doc_id") if whole else given).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    kept = lines.select("doc_id", F.col("line_no").cast("long"), F.trim("line").alias("text")).where("text <> ''")
    k = (F.col("line_no") * 7919 + F.col("doc_id") * 104729) % 10
    timed = kept.withColumn("dur", (300 + (F.length("text") * 37) % 7000).cast("long")).withColumn("gap", F.when(k == 0, -150).when(k == 1, 0).when(k == 2, 100).when(k == 3, 12000).otherwise(350).cast("long"))
    before = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(before), F.lit(0))
    # The window below, and what walks documents later, use this dealing (``folds.fold`` with ``placed``).
    return (timed if whole else dealt(timed, "doc_id")).select("doc_id", "line_no", "text", start.cast("long").alias("start_ms"), (start + F.col("dur")).cast("long").alias("end_ms"))


@F.arrow_udf(ArrayType(LongType()))
def _running(sizes: pa.Array) -> pa.Array:
    """The running sums of each list."""
    ends = np.cumsum(sizes.value_lengths().to_numpy(zero_copy_only=False))
    upto = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)])
    begins = np.concatenate([[0], ends]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(begins), pa.array(upto[1:] - np.repeat(upto[begins[:-1]], np.diff(begins))))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running_sums(sizes: Column) -> Column:
    """The running sums of a list without leaving Spark's own expressions, so that rows stay dealt as they are: of stretches of about the root
    of its length, and of the stretches' totals, as each step copies what it has."""
    none = F.array().cast("array<bigint>")
    summed = lambda xs: F.aggregate(xs, none, lambda upto, x: F.concat(upto, F.array(F.coalesce(F.try_element_at(upto, F.lit(-1)), F.lit(0)) + x)))
    step = lambda xs: F.ceil(F.sqrt(F.size(xs))).cast("int")
    stretches = lambda xs: _let(step(xs), lambda k: F.transform(F.sequence(F.lit(1), F.size(xs), k), lambda at: summed(F.slice(xs, at, k))))
    joined = lambda parts: F.flatten(F.zip_with(parts, summed(F.transform(parts, lambda xs: F.element_at(xs, -1))), lambda xs, upto: _let(upto - F.element_at(xs, -1), lambda more: F.transform(xs, lambda x: x + more))))
    return _let(sizes, lambda xs: F.when(F.size(xs) > 0, _let(stretches(xs), joined)).otherwise(none))


def _said() -> Column:
    return F.filter(F.split("text", " "), lambda x: x != "")


def words(cue: DataFrame) -> DataFrame:
    """(doc_id, line_no, word_pos, word, start_ms, end_ms): a cue's span dealt to its words by characters.

    A line's running lengths are made before its words become rows, so words are neither shuffled nor sorted for them and
    stay where their documents are.
    """
    split = cue.select("doc_id", "line_no", "start_ms", (F.col("end_ms") - F.col("start_ms")).alias("span"), _said().alias("said"))
    sized = split.withColumn("upto", _running(F.transform("said", lambda x: F.length(x))))
    rows = sized.select("doc_id", "line_no", "start_ms", "span", F.element_at("upto", -1).alias("total"), F.posexplode(F.arrays_zip("said", "upto")).alias("word_pos", "w"))
    point = lambda k: F.col("start_ms") + F.expr(f"span * ({k}) div total")
    return rows.select("doc_id", "line_no", F.col("word_pos").cast("long").alias("word_pos"), F.col("w.said").alias("word"), point("w.upto - length(w.said)").alias("start_ms"), point("w.upto").alias("end_ms"))


def line_words(cue: DataFrame) -> DataFrame:
    """(doc_id, line_no, start_ms, end_ms, words): each cue's ``words`` in order, an array of (word, start_ms, end_ms), which never become rows; cues without any are left out.

    Lines stay dealt by document, also for Spark: what is grouped, joined or put in windows by document is not shuffled."""
    start, span = F.col("start_ms"), F.col("end_ms") - F.col("start_ms")

    def timed(said: Column, upto: Column) -> Column:
        at = lambda k, total: start + F.call_function("div", span * k, total)
        word = lambda w, k, total: F.struct(w.alias("word"), at(k - F.length(w), total).alias("start_ms"), at(k, total).alias("end_ms"))
        return _let(F.element_at(upto, -1), lambda total: F.zip_with(said, upto, lambda w, k: word(w, k, total)))

    listed = _let(_said(), lambda said: F.when(F.size(said) > 0, _let(_running_sums(F.transform(said, lambda x: F.length(x))), lambda upto: timed(said, upto))))
    return cue.select("doc_id", "line_no", "start_ms", "end_ms", listed.alias("words")).where("words is not null")


def locked(cue: DataFrame) -> DataFrame:
    """Cues with a flag that stands for a lock on the sound."""
    return cue.withColumn("locked", (F.col("line_no") * 31 + F.col("doc_id")) % 7 != 0)
