"""Mixing sources to target weights along a time-varying curriculum.

Method: every source has a weight schedule over training time 0..1, linear
between knots.  Its integral is the source's share; shares become word targets,
held at a multiple of the source's size, the excess going to the others by
weight.  A document's place in its source's word count (cumulative demand) is
turned into training time by inverting the integrated schedule, and the output is
range-sorted by that time.

Scale: all native.  Word counts are taken in one scan; what follows moves only
ids, sizes and a hash.  A running sum over a source would put a hot source into
one task, so each source is cut into hash ranges: sums of the ranges (at most
``RANGES`` a source) are accumulated, and the running sum inside a range starts
from there.  No collect, no broadcast hint: the table of sources is as long as
there are sources.

Edge cases: a null text has size 0 and is never taken; the null source is a source
of its own, last in order; equal or null ids are separate rows in a fixed order
by size; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .staging import Staging

WORD = r"[^\x20\x09-\x0D]+"
#: Hash ranges a source; a running sum covers one of them.
RANGES = 1024

Schedule = Sequence[tuple[float, float]]
#: Weights 3, 1 and 2 over the whole run: falling, even and rising.
RAMPS: tuple[Schedule, ...] = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 3.0)))


def integral(schedule: Schedule) -> float:
    """The schedule's area: the source's weight over the whole run."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def inverse_integral(schedule: Schedule, share: Column) -> Column:
    """Training time at which ``share`` (0..1) of the schedule's area lies behind."""
    area, begin, steps = share * F.lit(integral(schedule)), 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        rest, slope = area - F.lit(begin), (w1 - w0) / (t1 - t0)
        # Root of slope/2 x^2 + w0 x = rest, in the form that also holds for slope 0.
        below = F.lit(float(w0)) + F.sqrt(F.greatest(F.lit(float(w0 * w0)) + F.lit(2.0 * slope) * rest, F.lit(0.0)))
        begin += (t1 - t0) * (w0 + w1) / 2
        steps.append((begin, F.lit(float(t0)) + F.coalesce(F.lit(2.0) * rest / F.nullif(below, F.lit(0.0)), F.lit(0.0))))
    out = steps[-1][1]
    for end, time in reversed(steps[:-1]):
        out = F.when(area < F.lit(end), time).otherwise(out)
    return out


def by_turn(values: Sequence[Column], turn: Column) -> Column:
    """The value whose turn it is, repeating."""
    out = values[-1]
    for k, value in reversed(list(enumerate(values[:-1]))):
        out = F.when(turn % len(values) == k, value).otherwise(out)
    return out


def sized(docs: DataFrame, *keys: str) -> DataFrame:
    """Id, source, size in words and the hash of id and text that fixes the order within a source, so that rows that share an id, or have none, do not share a range."""
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.md5(F.coalesce("text", F.lit("")))))
    return docs.select(
        *keys, F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), order.alias("order")
    ).withColumn("range", F.floor(F.conv(F.substring("order", 1, 4), 16, 10).cast("int") / F.lit(65536 // RANGES)).cast("int"))


def source_targets(sources: DataFrame, schedules: Sequence[Schedule], share: float, most_repeats: float) -> DataFrame:
    """``source``, ``source_size`` -> with ``turn`` and ``target`` words.

    In order of cap by weight, a source is capped if the level that the words and
    weights left over allow reaches its cap; the first level that does not is the
    level of all sources from there on.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    ratio = W.orderBy("ratio", "turn")
    level = F.when(F.col("level") < F.col("ratio"), F.col("level"))
    return (
        sources.withColumn("turn", F.row_number().over(every) - 1)
        .withColumn("weight", by_turn([F.lit(integral(s)) for s in schedules], F.col("turn")))
        .withColumn("cap", F.col("source_size") * F.lit(float(most_repeats)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
        .withColumn("capped", F.coalesce(F.sum("cap").over(ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("weights"))
        .withColumn("even", F.max(level).over(W.partitionBy()))
        .withColumn("target", F.when(F.col("level") < F.col("ratio"), F.col("even") * F.col("weight")).otherwise(F.col("cap")))
        .select("source", "source_size", "turn", "target")
    )


def mix(docs: DataFrame, *, schedules: Sequence[Schedule] = RAMPS, share: float = 1.5, most_repeats: float = 2.0) -> DataFrame:
    """Words taken from each document and when; every schedule's area must be above 0.

    Columns: doc_id, source, size, source_size, target, taken, position (training
    time 0..1 of the first words taken, null if none) and position_2 (of the
    second passage through the document).  Sorted by position.  A source gives exactly
    its target, rounded: whole passages over it and then its first documents in
    hash order, the last one in part.
    """
    mixed = placements(docs, schedules=schedules, share=share, most_repeats=most_repeats)
    return mixed.orderBy(F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), "size")


def placements(docs: DataFrame, *keys: str, schedules: Sequence[Schedule] = RAMPS, share: float = 1.5, most_repeats: float = 2.0) -> DataFrame:
    """The rows of ``mix`` in no order, led by the columns ``keys`` that tell rows of equal or no id apart."""
    staging = Staging(docs.sparkSession, "mixing")
    rows = staging.write(sized(docs, *keys), "sized")
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("source", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("range_start"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), schedules, share, most_repeats)
    places = starts.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    places = places.withColumnsRenamed({"source": "of", "range": "of_range"})

    inside = W.partitionBy("source", "range").orderBy("order", F.col("doc_id").asc_nulls_last(), "size", *keys).rowsBetween(W.unboundedPreceding, -1)
    joined = rows.join(places, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("of_range")))
    start = F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    whole = F.col("source_size") * F.col("passes")
    share_at = lambda words: inverse_each(schedules, F.when(F.col("target") > 0, F.least(words / F.col("target"), F.lit(1.0))))
    mixed = (
        joined.withColumn("start", start)
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", F.floor(F.col("target") + F.lit(0.5)).cast("long") - whole)
        .withColumn("part", F.least(F.greatest(F.col("rest") - F.col("start"), F.lit(0)), F.col("size")))
        .withColumn("taken", F.col("passes") * F.col("size") + F.col("part"))
        .withColumn("position", F.when(F.col("taken") > 0, share_at(F.col("start"))))
        .withColumn("position_2", F.when(F.col("taken") > F.col("size"), share_at(F.col("source_size") + F.col("start"))))
    )
    return mixed.select(*keys, "doc_id", "source", "size", "source_size", "target", "taken", "position", "position_2")


def inverse_each(schedules: Sequence[Schedule], share: Column) -> Column:
    return by_turn([inverse_integral(s, share) for s in schedules], F.col("turn"))
