"""Words as a stream: segments that close at a pause, or by the whole rule.

The pause rule alone is a session window with a watermark.  The whole rule is a recurrence: its state for an episode is the
open segment, which width and length bound, and a timer closes it when no more words come.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import PAUSE, segment_breaks


def paused_segments(words: DataFrame, key: str, *, late: str = "10 minutes", pause: float = PAUSE) -> DataFrame:
    """(key, start, end, words) of runs of words without a pause; ``words`` has key, at (timestamp), word.

    Words later than ``late`` behind the newest are left out.  Works on batch tables as well.
    """
    gap = f"{int(pause * 1000)} milliseconds"
    sessions = words.withWatermark("at", late).groupBy(key, F.session_window("at", gap).alias("w"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])
    return sessions.agg(F.min("at").alias("start"), F.max("at").alias("end"), ordered.alias("words")).drop("w")


_OPEN = "number long, last long, pos array<long>, words array<string>, starts array<double>, ends array<double>"
_COLUMNS = ["segment", "start", "end", "words", "late"]
Word = tuple[int, str, float, float]


class Segmenter(StatefulProcessor):
    """The open segment of an episode; the last word waits for the next one, whose pause decides."""

    def __init__(self, key: str, idle_ms: int, wide: bool):
        self.key, self.idle_ms, self.wide = key, idle_ms, wide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        number, last, held = self._read()
        new = pd.concat(list(rows)).sort_values("pos", kind="stable")
        at = new["at"].max()
        early = [r for r in new[["pos", "word", "start", "end"]].itertuples(index=False, name=None) if r[0] > last]
        late = [r for r in new[["pos", "word", "start", "end"]].itertuples(index=False, name=None) if r[0] <= last]
        if early:
            held += early
            last = held[-1][0]
        closed, held = self._closed(held, whole=False)
        found = [(number + k, *segment, False) for k, segment in enumerate(closed)] + [(None, start, end, [word], True) for _, word, start, end in late]
        self.open.update((number + len(closed), last, *([list(c) for c in zip(*held, strict=True)] if held else [[], [], [], []])))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(max(int(at.timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield self._frame(key, found)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        number, last, held = self._read()
        closed, _ = self._closed(held, whole=True)
        self.open.update((number + len(closed), last, [], [], [], []))
        yield self._frame(key, [(number + k, *segment, False) for k, segment in enumerate(closed)])

    def close(self) -> None:
        pass

    def _read(self) -> tuple[int, int, list[Word]]:
        if not self.open.exists():
            return 0, -(1 << 62), []
        number, last, *columns = self.open.get()
        return number, last, list(zip(*columns, strict=True))

    def _closed(self, words: list[Word], *, whole: bool) -> tuple[list[tuple], list[Word]]:
        """Segments that are closed, and the words behind them; ``whole``: no more words come."""
        closed, members, done = [], [], 0
        for i, (counts, closes) in enumerate(segment_breaks((w[1:] for w in words), self.wide)):
            if i == len(words) - 1 and not whole:
                break
            if counts:
                members.append(words[i])
            if closes:
                closed.append((members[0][2], members[-1][3], [w[1] for w in members]))
                members, done = [], i + 1
        return closed, words[done:]

    def _frame(self, key: Any, found: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(found, columns=_COLUMNS).astype({"segment": "Int64", "start": "float64", "end": "float64", "late": "bool"})
        frame.insert(0, self.key, key[0])
        return frame


def stream_segments(words: DataFrame, key: str, *, late: str = "10 minutes", idle: float = 600.0, wide: bool = False) -> DataFrame:
    """(key, segment, start, end, words, late): ``operators.folds.segments`` of a stream of words (key, pos, at, word, start, end).

    ``at`` is the words' event time and ``pos`` their order within an episode.  Segments come as soon as they are closed, an episode's last one ``idle`` seconds
    of event time behind its last word, after which an episode that goes on begins a new segment.  A word that comes behind one of a later
    ``pos`` in an earlier batch cannot join a segment any more: it is a row of its own, marked late, with a null segment;
    words more than ``late`` behind the newest are left out, as every watermark does.
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    kind = words.schema[key].dataType.simpleString()
    rows = words.select(key, F.col("pos").cast("long").alias("pos"), "at", "word", "start", "end").withWatermark("at", late)
    schema = f"`{key}` {kind}, segment long, start double, end double, words array<string>, late boolean"
    processor = Segmenter(key, int(idle * 1000), wide)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
