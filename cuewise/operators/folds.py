"""Ordered recurrences over a timeline: each output row depends on the ones before it.

Rows are dealt by episode and sorted by Spark; a task then streams through its episodes in
Arrow batches, one row after the other, and holds no more of an episode than the
recurrence looks back or ahead.  Times are in seconds.
"""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..schema import LEAD_IN

_SENTENCE = re.compile(r"[。！？.!?][\"'”’）)]*$")
_CLAUSE = re.compile(r"[，、；：,;:\-][\"'”’）)]*$")
# Fixed values of segmenting: soft and hard width, pauses and greatest length in seconds.
SOFT, HARD = {"wide": 15.0, "latin": 38.0}, {"wide": 24.0, "latin": 60.0}
PAUSE, SOFT_PAUSE, LONGEST = 0.35, 0.10, 5.5
# Fixed values of chunking: endings that close a thought and openings that continue one.
CLOSING = ("？", "?", "！", "!", "。", "……", "...")
CLOSING_WORDS = ("來說", "來講", "而言", "之後", "的話", "來看")
CONNECTIVES = ("但是", "而且", "所以", "不過", "然而", "如果")
# Fixed values of lead-in, in seconds: between cues, kept by a cue that is cut, kept by one that gives, worth giving.
APART, CUT_TO, KEEPS, WORTH = 0.02, 0.2, 1.0, 0.04

_BATCH = 20_000
#: Rows read at a time where a recurrence looks ahead.
_AHEAD = 512
Row = tuple


def dealt(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows dealt by key to the session's number of partitions: groups are heavy for their bytes, so
    adaptive execution must not gather them into few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def arrow_rows(rows: Iterable[Row], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Row tuples as Arrow batches."""
    held: list[Row] = []
    for row in rows:
        held.append(row)
        if len(held) == _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def mapped_rows(rows: DataFrame, each: Callable[[Iterator[Row]], Iterator[Row]], schema: StructType) -> DataFrame:
    """``each`` over a partition's rows as tuples."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from arrow_rows(each(stream), arrow)

    return rows.mapInArrow(run, schema)


def fold(rows: DataFrame, key: str, pos: str, walk: Callable[[Iterator[Row]], Iterator[Row]], schema: StructType, *, placed: bool = False) -> DataFrame:
    """Apply ``walk`` to each episode's rows, as tuples in order of ``pos``; ``placed``: each episode's rows are in one partition already."""
    by_key = itemgetter(rows.columns.index(key))

    def each(stream: Iterator[Row]) -> Iterator[Row]:
        for _, own in groupby(stream, by_key):
            yield from walk(own)

    return mapped_rows((rows if placed else dealt(rows, key)).sortWithinPartitions(key, pos), each, schema)


def _words_width(word: str, wide: bool) -> float:
    return sum(1.0 if ord(c) > 127 else 0.5 for c in word) if wide else len(word) + 1.0


def segment_breaks(words: Iterable[tuple[str, float, float]], wide: bool) -> Iterator[tuple[bool, bool]]:
    """For each word whether it counts (is not blank) and whether a segment ends behind it."""
    kind = "wide" if wide else "latin"
    soft, hard = SOFT[kind], HARD[kind]
    width, since, waiting = 0.0, None, None
    for word, start, end in words:
        if waiting is not None:
            said, ended = waiting
            gap = start - ended
            closes = said != "" and (
                gap >= PAUSE or width >= hard or ended - since >= LONGEST or _SENTENCE.search(said) is not None or (width >= soft and (gap >= SOFT_PAUSE or _CLAUSE.search(said) is not None))
            )
            yield said != "", closes
            if closes:
                width, since = 0.0, None
        said = word.strip()
        if said:
            width += _words_width(said, wide)
            since = start if since is None else since
        waiting = said, end
    if waiting is not None:
        yield waiting[0] != "", waiting[0] != ""


def segment_numbers(words: list[str], starts: list[float], ends: list[float], wide: bool) -> list[int]:
    """The segment of each word, -1 for blank ones and for words that no break closes."""
    out, members, number = [-1] * len(words), [], 0
    for i, (counts, closes) in enumerate(segment_breaks(zip(words, starts, ends, strict=True), wide)):
        if counts:
            members.append(i)
        if closes:
            for m in members:
                out[m] = number
            members, number = [], number + 1
    return out


def closed_segments(wide: bool) -> Callable[[Iterator[Row]], Iterator[tuple[int, list[Row]]]]:
    """Each segment's number and rows (key, pos, word, start, end), as it closes."""

    def walk(rows: Iterator[Row]) -> Iterator[tuple[int, list[Row]]]:
        seen: list[Row] = []

        def spoken_words() -> Iterator[tuple[str, float, float]]:
            for row in rows:
                seen.append(row)
                yield row[2:]

        open_, number, taken = [], 0, 0
        for counts, closes in segment_breaks(spoken_words(), wide):
            row = seen[taken]
            taken += 1
            if counts:
                open_.append(row)
            if closes:
                yield number, open_
                open_, number = [], number + 1
                del seen[:taken]
                taken = 0

    return walk


def segmented(words: DataFrame, key: str, pos: str, *, wide: bool = False, placed: bool = False) -> DataFrame:
    """(key, segment, start, end, word, pos): words with the segment they fall into."""
    closed, own = closed_segments(wide), {f.name: f for f in words.schema}

    def walk(rows: Iterator[Row]) -> Iterator[Row]:
        return ((k, number, start, end, word, p) for number, held in closed(rows) for k, p, word, start, end in held)

    schema = StructType([own[key], StructField("segment", LongType()), own["start"], own["end"], own["word"], own[pos]])
    return fold(words.select(key, pos, "word", "start", "end"), key, pos, walk, schema, placed=placed)


def segments(words: DataFrame, key: str, pos: str, *, wide: bool = False, placed: bool = False) -> DataFrame:
    """(key, segment, start, end, words): words gathered to segments at pauses, sentence ends and lengths; a segment is a row as soon as it closes."""
    closed, own = closed_segments(wide), {f.name: f for f in words.schema}

    def walk(rows: Iterator[Row]) -> Iterator[Row]:
        return ((held[0][0], number, held[0][3], held[-1][4], [r[2] for r in held]) for number, held in closed(rows) if held)

    schema = StructType([own[key], StructField("segment", LongType()), own["start"], own["end"], StructField("words", ArrayType(own["word"].dataType))])
    return fold(words.select(key, pos, "word", "start", "end"), key, pos, walk, schema, placed=placed)


@lru_cache(100_000)
def spoken(word: str) -> str:
    """A word without punctuation and symbols, in lower case."""
    return "".join(c.lower() for c in word if unicodedata.category(c)[0] not in "PS").strip()


def loop_at(tokens: Sequence[str], *, repeats: int, longest: int) -> int:
    """The size of the longest pattern that repeats from the first token on often enough to be a loop; 0 if none does."""
    first, n = tokens[0], len(tokens)
    for size in range(min(longest, n // 2), 0, -1):
        if tokens[size] != first:
            continue
        times = 3 if size >= 3 else repeats + 1
        if n >= times * size and all(tokens[k] == tokens[k - size] for k in range(size, times * size)) and any(tokens[:size]):
            return size
    return 0


def loop_free(rows: Iterable[Row], token_of: Callable[[Row], str], *, repeats: int = 3, longest: int = 8) -> Iterator[Row]:
    """Rows that stay when runs of one pattern of tokens shrink to a single copy.

    From left to right, the longest pattern that repeats at a place wins: three times for patterns of
    three tokens or more, else once more than ``repeats``; patterns of blanks do not count.  Held are as many rows as
    decide whether a loop begins; its further copies go as they come.
    """
    ahead, source = max(3 * longest, 2 * (repeats + 1)), iter(rows)
    held: list[Row] = []
    tokens: list[str] = []
    at, ended = 0, False

    def filled(wanted: int) -> int:
        """Rows held from ``at`` on, ``wanted`` of them if there are so many."""
        nonlocal at, ended
        if len(held) - at < wanted and not ended:
            del held[:at], tokens[:at]
            at = 0
            new = list(islice(source, max(wanted, _AHEAD) - len(held)))
            ended = len(held) + len(new) < max(wanted, _AHEAD)
            held.extend(new)
            tokens.extend(map(token_of, new))
        return len(held) - at

    while n := filled(ahead):
        again = tokens[at] in tokens[at + 1 : at + 1 + longest]
        size = loop_at(tokens[at : at + min(n, ahead)], repeats=repeats, longest=longest) if again else 0
        if not size:
            yield held[at]
            at += 1
            continue
        yield from held[at : at + size]
        pattern = tokens[at : at + size]
        at += size
        while filled(size) >= size and tokens[at : at + size] == pattern:
            at += size


def best_by_margin(rows: DataFrame, key: str, pos: str, score: str, margin: float) -> DataFrame:
    """The row of each key that wins in order of ``pos``: a later one must beat the best so far by more than ``margin``, so the first of
    nearly equal ones stays.  Only the best row is held; rows without a score do not take part."""
    at = rows.columns.index(score)

    def walk(own: Iterator[Row]) -> Iterator[Row]:
        best: Row | None = None
        for row in own:
            if best is None or row[at] > best[at] + margin:
                best = row
        if best is not None:
            yield best

    return fold(rows.where(F.col(score).isNotNull()), key, pos, walk, rows.schema)


def without_loops(tokens: list[str], *, repeats: int = 3, longest: int = 8) -> list[int]:
    """The places of ``loop_free`` tokens."""
    return [k for k, _ in loop_free(enumerate(tokens), itemgetter(1), repeats=repeats, longest=longest)]


def suppress_loops(words: DataFrame, key: str, pos: str, *, placed: bool = False) -> DataFrame:
    word = words.columns.index("word")
    return fold(words, key, pos, lambda rows: loop_free(rows, lambda r: spoken(r[word])), words.schema, placed=placed)


def chunk_ends(cues: Iterable[tuple[float, float, str]], target: int) -> Iterator[bool]:
    """For each cue (start, end, text) whether a chunk ends behind it: at pauses and closed thoughts near the target size.

    What is left goes into one chunk if it is no more than a chunk may hold; so no more than that and one cue are held.
    """
    least, most = max(20, int(target * 0.7)), int(target * 1.3)
    source, held = iter(cues), []

    def worth(i: int) -> float:
        (_, end, text), (start, _, following) = held[i], held[i + 1]
        value = 15.0 * min(start - end, 2.0) - 0.4 * abs(i - target)
        value += 6.0 * text.endswith(CLOSING) + 3.0 * text.endswith(CLOSING_WORDS)
        return value - 4.0 * following.startswith(CONNECTIVES)

    while True:
        held += islice(source, most + 1 - len(held))
        if len(held) <= most:
            break
        cut = max(range(least, most), key=worth) + 1 if least < most else target
        yield from (k == cut - 1 for k in range(cut))
        del held[:cut]
    yield from (k == len(held) - 1 for k in range(len(held)))


def chunk_numbers(starts: list[float], ends: list[float], texts: list[str], target: int) -> list[int]:
    """The chunk of each cue."""
    return list(accumulate(chunk_ends(zip(starts, ends, texts, strict=True), target), initial=0))[: len(texts)]


def semantic_chunks(cues: DataFrame, key: str, pos: str, target: int = 80) -> DataFrame:
    """Cues with ``chunk``."""
    start, end, text = map(cues.columns.index, ("start", "end", "text"))

    def walk(rows: Iterator[Row]) -> Iterator[Row]:
        waiting: deque[Row] = deque()

        def read() -> Iterator[tuple[float, float, str]]:
            for row in rows:
                waiting.append(row)
                yield row[start], row[end], row[text]

        chunk = 0
        for ends in chunk_ends(read(), target):
            yield (*waiting.popleft(), chunk)
            chunk += ends

    return fold(cues, key, pos, walk, StructType([*cues.schema, StructField("chunk", LongType())]))


Span = tuple[float, float]


def repaired(spans: Iterable[Span]) -> Iterator[Span]:
    """Strictly rising starts and no overlaps: a cue cuts the one before if that keeps 0.6 s, else it waits."""
    before: Span | None = None
    for start, end in spans:
        if before is not None:
            s, e = before
            start = start if start > s else s + 0.5
            if e > start:
                e = start if start >= s + 0.6 else max(s + 0.5, start)
                start = max(start, e)
            end = end if end > start else start + 1.0
            yield s, e
        before = start, end
    if before is not None:
        yield before


def monotone(starts: list[float], ends: list[float]) -> tuple[list[float], list[float]]:
    """``repaired`` of whole columns."""
    spans = list(repaired(zip(starts, ends, strict=True)))
    return [s for s, _ in spans], [e for _, e in spans]


def _timed_fold(cues: DataFrame, key: str, pos: str, walk: Callable[[Iterator[Row]], Iterator[Span]], *read: str, placed: bool = False) -> DataFrame:
    """Cues with the start and end that ``walk`` gives for their columns ``read``."""
    at, start, end = [cues.columns.index(c) for c in read], cues.columns.index("start"), cues.columns.index("end")

    def each(rows: Iterator[Row]) -> Iterator[Row]:
        waiting: deque[Row] = deque()

        def columns() -> Iterator[Row]:
            for row in rows:
                waiting.append(row)
                yield tuple(row[k] for k in at)

        for s, e in walk(columns()):
            row = list(waiting.popleft())  # a walk is a row or two behind what it has read
            row[start], row[end] = s, e
            yield tuple(row)

    schema = StructType([StructField(f.name, DoubleType()) if f.name in ("start", "end") else f for f in cues.schema])
    return fold(cues, key, pos, each, schema, placed=placed)


def monotone_repair(cues: DataFrame, key: str, pos: str, *, placed: bool = False) -> DataFrame:
    return _timed_fold(cues, key, pos, repaired, "start", "end", placed=placed)


def meeting(begin: float, end: float, wish: float, yields: bool) -> Span:
    """Where a cue ends and the next one, which wishes to start at ``wish``, starts; ``yields``: the first may be cut."""
    if yields and end > wish:
        end = max(begin + CUT_TO, wish)
    lack = end + APART - wish
    given = min(lack, max(0.0, end - begin - KEEPS))
    if lack > 0 and given >= WORTH:
        return end - given, end - given
    return end, wish if lack <= 0 else max(end, wish)


def ahead_of_sound(cues: Iterable[tuple[float, float, bool]], *, video_start: bool = True, last: float = float("inf"), lead: float = LEAD_IN) -> Iterator[Span]:
    """Spans of cues (start, end, locked) moved ahead of the sound; the state is the cue before: its span and whether it is locked."""
    span: Span | None = None
    was_locked = False
    for start, end, locked in cues:
        begin = wish = max(0.0, start - lead)
        if span is not None:
            ended, begin = meeting(*span, wish, locked and not was_locked)
            yield span[0], ended
        elif not video_start:
            begin = start
        if end <= begin:
            end = begin + 0.5 if locked else min(begin + 0.5, last)
        span, was_locked = (begin, end), locked
    if span is not None:
        yield span


def led_in(starts: list[float], ends: list[float], locked: list[bool], **how) -> tuple[list[float], list[float]]:
    """``ahead_of_sound`` of whole columns."""
    spans = list(ahead_of_sound(zip(starts, ends, locked, strict=True), **how))
    return [s for s, _ in spans], [e for _, e in spans]


def lead_in(cues: DataFrame, key: str, pos: str, *, placed: bool = False) -> DataFrame:
    return _timed_fold(cues, key, pos, ahead_of_sound, "start", "end", "locked", placed=placed)
