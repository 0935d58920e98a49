"""Window and join operators over timelines, in whole milliseconds unless said otherwise.

Every operator takes the episode key first.  Windows partition by it, so a task holds
an episode at a time; joins pair the key, and times are binned where a range alone would pair all rows of an episode.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schema import MICRO_GAP, TAIL, TAIL_CEILING

#: Marks and blanks that are not spoken.
MARKS = r"""[\s\x{3000},?!，。？！、：:;；—\-~"'「」『』“”‘’【】《》〈〉…·]+"""


def order(key: str, pos: str):
    return W.partitionBy(key).orderBy(pos)


def gap_class(gap: Column, scale: float = 1000.0) -> Column:
    """Overlap, zero, micro or normal; null behind the last cue."""
    edge, micro = 0.001 * scale, MICRO_GAP * scale
    return F.when(gap < -edge, "overlap").when(F.abs(gap) < edge, "zero").when((gap >= edge) & (gap < micro), "micro").when(gap.isNotNull(), "normal")


def with_gaps(cues: DataFrame, key: str, pos: str) -> DataFrame:
    """Adds the gap to the next cue and its class."""
    gap = F.lead("start_ms").over(order(key, pos)) - F.col("end_ms")
    return cues.withColumn("gap_ms", gap).withColumn("gap_class", gap_class(F.col("gap_ms")))


def silences(cues: DataFrame, key: str, pos: str, least_ms: int = 10_000) -> DataFrame:
    """Silences between cues, which are numbered from 1, and before the first one (``prev_index`` 0)."""
    w = order(key, pos)
    between = cues.withColumns({"next_index": F.row_number().over(w).cast("long"), "from_ms": F.coalesce(F.lag("end_ms").over(w), F.lit(0))})
    length = F.col("start_ms") - F.col("from_ms")
    return between.where(length >= least_ms).select(key, (F.col("next_index") - 1).alias("prev_index"), "next_index", "from_ms", F.col("start_ms").alias("to_ms"), length.alias("silence_ms"))


def renumbered(rows: DataFrame, key: str, pos: str) -> DataFrame:
    return rows.withColumn("number", F.row_number().over(order(key, pos)).cast("long"))


def text_offsets(cues: DataFrame, key: str, pos: str) -> DataFrame:
    """Where each cue's text starts in the episode's text."""
    before = order(key, pos).rowsBetween(W.unboundedPreceding, -1)
    return cues.withColumn("text_offset", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("long"))


def islands(cues: DataFrame, key: str, pos: str, locked: str = "locked") -> DataFrame:
    """Maximal runs of unlocked cues: first, last and length."""
    run = F.sum(F.col(locked).cast("int")).over(order(key, pos))
    return cues.withColumn("run", run).where(~F.col(locked)).groupBy(key, "run").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("cues")).drop("run")


def anchors(cues: DataFrame, key: str, pos: str, locked: str = "locked") -> DataFrame:
    """Unlocked cues with the end of the last locked cue before and the start of the next behind."""
    w = order(key, pos)
    before = F.last(F.when(F.col(locked), F.col("end_ms")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    behind = F.first(F.when(F.col(locked), F.col("start_ms")), ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    return cues.withColumns({"anchor_before": before, "anchor_behind": behind}).where(~F.col(locked))


def proportional(cues: DataFrame, key: str, pos: str, weight: Column, start: Column, end: Column) -> DataFrame:
    """Deal the span [start, end] of each ``key`` to its rows by weight, in whole milliseconds."""
    w = order(key, pos)
    weighed = cues.withColumns({"__w": weight.cast("long"), "__start": start, "__span": end - start})
    placed = weighed.withColumns({"__total": F.sum("__w").over(W.partitionBy(key)), "__to": F.sum("__w").over(w)})
    at = lambda upto: F.col("__start") + F.expr(f"__span * ({upto}) div greatest(__total, 1)")
    return placed.withColumns({"start_ms": at("__to - __w"), "end_ms": at("__to")}).drop("__w", "__start", "__span", "__total", "__to")


def binned(rows: DataFrame, first: Column, last: Column, width: int) -> DataFrame:
    """A row for each bin of time that [first, last] touches."""
    floor = lambda x: F.floor(x / width)
    return rows.withColumn("bin", F.explode(F.sequence(floor(first), F.greatest(floor(first), floor(last)))))


def interval_join(spans: DataFrame, words: DataFrame, key: str, slack_ms: int, width: int = 30_000) -> DataFrame:
    """Words that touch a span widened by ``slack_ms`` on both sides.

    ``spans``: key, span_id, from_ms, to_ms.  Both sides are joined by bin; a pair counts in
    the bin of the later of the two starts, so it comes once.
    """
    low, high = F.col("from_ms") - slack_ms, F.col("to_ms") + slack_ms
    left = binned(spans.select(key, "span_id", low.alias("low"), high.alias("high")), F.col("low"), F.col("high"), width)
    right = binned(words, F.col("start_ms"), F.col("end_ms"), width)
    touching = (F.col("end_ms") >= F.col("low")) & (F.col("start_ms") <= F.col("high"))
    once = F.col("bin") == F.floor(F.greatest("low", "start_ms") / width)
    return left.join(right, [key, "bin"]).where(touching & once).drop("bin", "low", "high")


def windows(media: DataFrame, key: str, duration: str, width: float = 1080.0, overlap: float = 5.0) -> DataFrame:
    """Recognition windows of a medium: each starts ``overlap`` before the last one's nominal end."""
    d = F.col(duration)
    count = F.greatest(F.ceil(d / width), F.lit(1)).cast("long")
    rows = media.select(key, d.alias("__d"), F.explode(F.sequence(F.lit(0), count - 1)).alias("window_id"))
    begin = F.when(F.col("window_id") == 0, 0.0).otherwise(F.col("window_id") * width - overlap)
    return rows.select(key, F.col("window_id").cast("long").alias("window_id"), begin.alias("w_start"), F.least((F.col("window_id") + 1) * width, F.col("__d")).alias("w_end"))


def stitched(words: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """One word sequence from overlapping windows: a word counts in the window on whose side of the
    overlaps' middles its own middle lies.

    ``words``: key, window_id, start_ms, end_ms; ``spans``: key, window_id, from_ms, to_ms.
    """
    bounds = stitch_bounds(spans, key).select(key, "window_id", "low", "high")
    at = (F.col("start_ms") + F.col("end_ms")) / 2
    return words.join(bounds, [key, "window_id"]).where(within_bounds(at, F.col("low"), F.col("high"))).drop("low", "high")


def stitch_bounds(spans: DataFrame, key: str) -> DataFrame:
    """``spans`` with ``low`` and ``high``, the overlaps' middles between which a window's words count; null where there is none."""
    w = W.partitionBy(key).orderBy("window_id")
    low = (F.lag("to_ms").over(w) + F.col("from_ms")) / 2
    high = (F.col("to_ms") + F.lead("from_ms").over(w)) / 2
    return spans.withColumns({"low": low, "high": high})


def within_bounds(at: Column, low: Column, high: Column) -> Column:
    return (low.isNull() | (at >= low)) & (high.isNull() | (at < high))


def onset_clamped(words: DataFrame, key: str, pos: str) -> DataFrame:
    """Words, in seconds, whose start was drawn into the silence before them.

    A word's expected length follows from its speech units; behind a pause more is
    allowed before the start moves to a length that fits.
    """
    bare = F.regexp_replace(F.col("word"), MARKS, "")
    wide = F.length(F.regexp_replace(bare, r"[\x00-\x7F]", ""))
    units = F.greatest(F.lit(1.0), wide + (F.length(bare) - wide) / 3.0)
    gap = F.coalesce(F.col("start") - F.lag("end").over(order(key, pos)), F.lit(999.0))
    cap = F.when(gap >= 0.30, units * 0.45 + 0.25).otherwise(units * 0.65 + 0.50)
    target = F.when(gap >= 0.30, units * 0.30 + 0.15).otherwise(units * 0.35 + 0.20)
    long = (bare != "") & (F.greatest(F.lit(0.01), F.col("end") - F.col("start")) > cap)
    return words.withColumn("onset", F.when(long, F.greatest(F.col("start"), F.col("end") - target)).otherwise(F.col("start")))


def char_timeline(words: DataFrame, key: str, pos: str) -> DataFrame:
    """A row for each character of a word, at even shares of its time."""
    split = words.select(key, pos, "start_ms", (F.col("end_ms") - F.col("start_ms")).alias("__span"), F.length("word").alias("__n"), F.posexplode(F.split("word", "")).alias("char_pos", "char")).where("char <> ''")
    at = lambda k: F.col("start_ms") + F.expr(f"__span * (char_pos + {k}) div __n")
    return split.select(key, pos, F.col("char_pos").cast("long").alias("char_pos"), "char", at(0).alias("c_start"), at(1).alias("c_end"))


def capped(cues: DataFrame, key: str, pos: str) -> DataFrame:
    """Sanitizer's first pass: an end not behind its start, or more than 6 s away, is set."""
    end = F.when(F.col("end_ms") <= F.col("start_ms"), F.col("start_ms") + 1000).otherwise(F.col("end_ms"))
    fixed = cues.withColumn("end_ms", end)
    following = F.lead("start_ms").over(order(key, pos))
    limit = F.least(F.col("start_ms") + 6000, following)
    long = F.when(following > F.col("start_ms"), limit).otherwise(F.col("start_ms") + 4000)
    return fixed.withColumn("end_ms", F.when(F.col("end_ms") - F.col("start_ms") > 6000, long).otherwise(F.col("end_ms")))


def tailed(cues: DataFrame, key: str, pos: str, width: Column, comfortable: Column) -> DataFrame:
    """Sanitizer's third pass, in seconds: time to read, bridged micro gaps, least and greatest duration."""
    s, e = F.col("start"), F.col("end")
    n = F.coalesce(F.lead("start").over(order(key, pos)), e + 10)
    out = cues.withColumn("__next", n)
    tail = F.greatest(F.lit(TAIL), F.least(F.lit(TAIL_CEILING), width / comfortable - F.greatest(F.lit(0.01), e - s)))
    gap = F.col("__next") - e
    out = out.withColumn("end", F.when(gap >= tail + MICRO_GAP, e + tail).when(gap > 0, F.col("__next")).otherwise(e))
    room = F.col("__next") - e
    grown = F.least(e + F.least(1.0 - (e - s), room), F.col("__next"))
    short = (e - s < 1.0) & (room > 0)
    out = out.withColumn("__short", short).withColumn("end", F.when(F.col("__short"), grown).otherwise(e))
    left = F.col("__next") - e
    out = out.withColumn("end", F.when(F.col("__short") & (left > 0) & (left < MICRO_GAP) & (F.col("__next") - s <= 6.0), F.col("__next")).otherwise(e))
    return out.withColumn("end", F.when(e - s > 6.0, s + 6.0).otherwise(e)).drop("__next", "__short")


def media_capped(cues: DataFrame, media_ms: Column) -> DataFrame:
    """Sanitizer's last pass: no cue ends more than the tail behind its medium."""
    limit = media_ms + int(TAIL * 1000)
    late = media_ms.isNotNull() & (F.col("end_ms") > limit)
    return cues.withColumn("end_ms", F.when(late, F.greatest(F.col("start_ms") + 200, limit)).otherwise(F.col("end_ms")))


def numbered_chars(words: DataFrame, key: str, pos: str) -> DataFrame:
    """``char_timeline`` in seconds with each character's ``place`` among all of its episode, from 0; ``words`` has start and end in seconds."""
    before = order(key, pos).rowsBetween(W.unboundedPreceding, -1)
    placed = words.select(key, pos, "word", "start", "end", F.coalesce(F.sum(F.length("word")).over(before), F.lit(0)).alias("__offset"))
    split = placed.select(key, pos, "start", ((F.col("end") - F.col("start")) / F.length("word")).alias("__share"), "__offset", F.posexplode(F.split("word", "")).alias("__k", "char")).where("char <> ''")
    at = lambda k: F.col("start") + k * F.col("__share")
    return split.select(key, pos, (F.col("__offset") + F.col("__k")).cast("long").alias("place"), "char", at(F.col("__k")).alias("c_start"), at(F.col("__k") + 1).alias("c_end"))


def interpolated(cues: DataFrame, chars: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Cues with times of unlocked runs taken from the heard characters, or else the time, between their locked neighbours.

    ``cues``: keys, pos, start, end (seconds), locked, size (characters, 1 or more), first and last (places of
    a locked cue's heard characters); ``chars``: keys, place (from 0, without gaps), c_start, c_end.  A run of unlocked cues
    is an island; what its cues' characters stand for is in proportion to their running lengths, places rounded half to even.
    Where fewer characters are free than cues wait, their span is dealt by length; where none is, the time between the
    neighbours, if there is any.  A run that has a neighbour on one side only takes characters if they are not too
    many.  Everything else keeps its times.  Adds ``interpolated``; a group without characters or locked cues does not change.
    """
    heard = chars.groupBy(*keys).agg((F.max("place") + 1).alias("__heard"))
    rows = _asking(cues.join(heard, list(keys), "left"), keys, pos)
    asked = rows.where(F.col("__first").isNotNull()).select(*keys, pos, F.posexplode(F.array("__first", "__last")).alias("__which", "place"))
    met = asked.join(chars.select(*keys, "place", "c_start", "c_end"), [*keys, "place"])
    found = met.groupBy(*keys, pos).agg(F.max(F.when(F.col("__which") == 0, F.col("c_start"))).alias("__begin"), F.max(F.when(F.col("__which") == 1, F.col("c_end"))).alias("__end"))
    return _given(rows.join(found, [*keys, pos], "left"), cues.columns)


def interpolated_along(cues: DataFrame, stretches: DataFrame, keys: Sequence[str], pos: str, at: Callable[[Column, Column], Column]) -> DataFrame:
    """``interpolated`` where characters are not listed but lie in stretches, such as lines of words.

    ``stretches``: keys, place (of its first character), stretch (a struct); they have no gaps.  ``at(stretch, k)``: a struct (c_start, c_end) of
    a stretch's character k, from 0.  ``cues`` also has heard, the number of its group's characters (null without any).
    The stretch that a place lies in is the last one that begins there or before: an as-of join by a window over both
    tables, so nothing is shuffled where both are dealt by the keys already.
    """
    rows = _asking(cues.withColumnRenamed("heard", "__heard"), keys, pos)
    kind = stretches.schema["stretch"].dataType
    both = rows.withColumns({"__stretch": F.lit(None).cast(kind), "__place": F.lit(None).cast("long")}).unionByName(
        stretches.select(*keys, F.col("stretch").alias("__stretch"), F.col("place").cast("long").alias("__place")), allowMissingColumns=True)
    for asked in ("__first", "__last"):
        # A stretch comes before places that are its own first character.
        w = W.partitionBy(*keys).orderBy(F.coalesce(F.col("__place"), F.col(asked)), F.col("__place").isNull())
        both = both.withColumn(f"{asked}_in", F.last(F.when(F.col("__place").isNotNull(), F.struct("__place", "__stretch")), ignorenulls=True).over(w))
    times = lambda asked: F.when(F.col(asked).isNotNull(), at(F.col(f"{asked}_in.__stretch"), F.col(asked) - F.col(f"{asked}_in.__place")))
    met = both.where(F.col("__place").isNull()).withColumns({"__begin": times("__first")["c_start"], "__end": times("__last")["c_end"]})
    return _given(met, [c for c in cues.columns if c != "heard"])


def _asking(cues: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Cues with ``__kind``, how their times are found, and the places of the characters at which each, or its run, begins and ends."""
    w = W.partitionBy(*keys).orderBy(pos)
    behind, ahead = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    of_locked = lambda c: F.when(F.col("locked"), F.col(c))
    rows = cues.withColumns({
        "__run": F.sum(F.col("locked").cast("int")).over(w),
        "__after": F.last(of_locked("last"), ignorenulls=True).over(behind), "__since": F.last(of_locked("end"), ignorenulls=True).over(behind),
        "__before": F.first(of_locked("first"), ignorenulls=True).over(ahead), "__until": F.first(of_locked("start"), ignorenulls=True).over(ahead),
    })
    island = W.partitionBy(*keys, "__run", "locked")
    both = F.col("__after").isNotNull() & F.col("__before").isNotNull()
    neighboured = ~F.col("locked") & (F.col("__after").isNotNull() | F.col("__before").isNotNull())
    rows = rows.withColumns({
        "__n": F.count("*").over(island), "__total": F.sum("size").over(island), "__done": F.coalesce(F.sum("size").over(island.orderBy(pos).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "__low": F.coalesce(F.col("__after") + 1, F.lit(0)),
    }).withColumn("__free", F.coalesce(F.col("__before") - 1, F.col("__heard") - 1) - F.col("__low") + 1)
    spoken = neighboured & (F.col("__free") > 0) & (both | (F.col("__free") <= 3 * F.col("__total") + 15))
    quiet = both & (F.col("__until") > F.col("__since") + 0.05)
    rows = rows.withColumn("__kind", F.when(spoken & (F.col("__free") >= F.col("__n")), "places").when(spoken, "span").when(neighboured & ~F.coalesce(spoken, F.lit(False)) & quiet, "time"))

    place = lambda c: F.bround(c / F.col("__total") * F.col("__free")).cast("long")
    within = lambda c, least: F.greatest(least, F.least(c, F.col("__free") - 1))
    a = within(place(F.col("__done")), F.lit(0))
    by_place = F.col("__kind") == "places"
    rows = rows.withColumn("__a", F.when(by_place, a).otherwise(0)).withColumn("__b", F.when(by_place, within(place(F.col("__done") + F.col("size")) - 1, F.col("__a"))).otherwise(F.col("__free") - 1))
    return rows.withColumns({c: F.when(F.col("__kind").isin("places", "span"), F.col("__low") + F.col(at)) for c, at in (("__first", "__a"), ("__last", "__b"))})


def _given(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cues with the times that follow from the characters met, or from their neighbours."""
    by_place = F.col("__kind") == "places"
    by_time = F.col("__kind") == "time"
    begin = F.when(by_time, F.col("__since")).otherwise(F.col("__begin"))
    end = F.when(by_time, F.col("__until")).otherwise(F.greatest(F.col("__begin") + 0.2 * F.col("__n"), F.col("__end")))
    dealt = lambda upto: begin + (end - begin) * upto / F.col("__total")
    start_at = F.when(F.col("__kind").isNull(), F.col("start")).when(by_place, F.col("__begin")).otherwise(dealt(F.col("__done")))
    end_at = F.when(F.col("__kind").isNull(), F.col("end")).when(by_place, F.col("__end")).otherwise(dealt(F.col("__done") + F.col("size")))
    kept = [c for c in columns if c not in ("start", "end")]
    return rows.select(*kept, start_at.alias("start"), end_at.alias("end"), F.col("__kind").isNotNull().alias("interpolated"))


def piecewise(positions: DataFrame, blocks: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """Positions (key, at, ...) with ``place``, where they stand in another text by the matching blocks of the two.

    ``blocks``: key, text_at, heard_at, size: matches that rise in both texts and do not overlap; ``sizes``: key,
    heard_size.  An as-of join by one window over both tables: inside a block, its end included, a position moves with it;
    between two it is interpolated and rounded down; before the first and behind the last it keeps its distance
    within the heard text; without any block it is null.
    """
    block = F.struct("text_at", "heard_at", "size")
    own = positions.columns
    both = positions.withColumn("__block", F.lit(None).cast("struct<text_at:bigint,heard_at:bigint,size:bigint>")).unionByName(
        blocks.select(key, F.col("text_at").alias("at"), block.cast("struct<text_at:bigint,heard_at:bigint,size:bigint>").alias("__block")), allowMissingColumns=True)
    # Positions come before blocks that begin there, so that the block before ends, and the next one begins, at a position or later.
    w = W.partitionBy(key).orderBy("at", F.col("__block").isNotNull())
    rows = both.withColumns({
        "__p": F.last("__block", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)),
        "__q": F.first("__block", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)),
    }).where("__block is null").join(sizes.select(key, "heard_size"), key, "left")
    at, p, q = F.col("at"), F.col("__p"), F.col("__q")
    text_end, heard_end = p["text_at"] + p["size"], p["heard_at"] + p["size"]
    share = (at - text_end) / F.greatest(F.lit(1), q["text_at"] - text_end)
    between = (heard_end + share * F.greatest(F.lit(0), q["heard_at"] - heard_end)).cast("long")
    place = (
        F.when(p.isNotNull() & (at <= text_end), p["heard_at"] + at - p["text_at"]).when(q.isNotNull() & (at == q["text_at"]), q["heard_at"])
        .when(p.isNotNull() & q.isNotNull(), between).when(q.isNotNull(), F.greatest(F.lit(0), q["heard_at"] - (q["text_at"] - at)))
        .when(p.isNotNull(), F.least(F.col("heard_size") - 1, heard_end + at - text_end))
    )
    return rows.withColumn("place", place).select(*own, "place")
