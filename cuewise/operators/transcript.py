"""From windows of a medium to one transcript.

Each window is recognised by itself; its words' offsets are moved to the medium's clock, words that
two windows heard are kept in one of them, and windows are put in order whatever order they were answered in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F

from ..schema import WINDOW, WINDOW_OVERLAP
from ..sources.captions import recognised
from . import timeline
from .plugins import Service, _applied

#: Windows (key, window_id, w_start, w_end, in seconds) -> (key, window_id, doc): the recogniser's JSON for each.
Recogniser = Callable[[DataFrame], DataFrame]


def by_service(service: Service, key: str) -> Recogniser:
    """A recogniser of windows as a plain function over frames, called as parallel as there are partitions."""

    def recognise(windows: DataFrame) -> DataFrame:
        kind = windows.schema[key].dataType.simpleString()
        return _applied(windows, service, f"`{key}` {kind}, window_id long, doc string")

    return recognise


def transcript(media: DataFrame, key: str, recognise: Recogniser, *, width: float = WINDOW, overlap: float = WINDOW_OVERLAP) -> DataFrame:
    """(key, word_pos, word, start, end) of media (key, seconds), times in seconds to the millisecond.

    A window without an answer gives no words; words are at least 0.02 s long.  A window's words stay together until they are chosen and
    numbered, by how many the windows before keep: nothing is shuffled where media and answers are dealt by key.
    """
    spans = timeline.windows(media, key, "seconds", width, overlap)
    ms = lambda c: F.bround(c * 1000).cast("long")
    bounds = timeline.stitch_bounds(spans.select(key, "window_id", "w_start", ms(F.col("w_start")).alias("from_ms"), ms(F.col("w_end")).alias("to_ms")), key)
    listed = bounds.groupBy(key).agg(F.collect_list(F.struct("window_id", "w_start", "low", "high")).alias("__spans"))
    own = F.get(F.filter("__spans", lambda s: s["window_id"] == F.col("window_id")), F.lit(0))
    found = recognise(spans).select(key, "window_id", "doc").join(listed, key).withColumn("__own", own).where("__own is not null")
    said = F.transform(recognised(F.col("doc"), F.col("__own.w_start")), lambda w: F.struct(w["word"].alias("word"), ms(w["start"]).alias("start_ms"), ms(w["end"]).alias("end_ms")))
    kept = F.filter(said, lambda w: timeline.within_bounds((w["start_ms"] + w["end_ms"]) / 2, F.col("__own.low"), F.col("__own.high")))
    windows = found.select(key, "window_id", kept.alias("words")).where("words is not null")
    before = F.coalesce(F.sum(F.size("words")).over(timeline.order(key, "window_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    words = windows.withColumn("__before", before).select(key, "__before", F.posexplode("words").alias("__at", "w"))
    return words.select(key, (F.col("__before") + F.col("__at")).cast("long").alias("word_pos"), "w.word", (F.col("w.start_ms") / 1000).alias("start"), (F.col("w.end_ms") / 1000).alias("end"))
