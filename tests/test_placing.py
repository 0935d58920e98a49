"""Interpolation and piecewise places as windows, against the row-wise steps of realigning."""

import random

import pytest

from cuewise.functions.spoken import Spoken
from cuewise.operators import align, timeline

CUES = "k string, c int, pos int, start double, end double, locked boolean, size long, first long, last long"


def made(seed: int) -> tuple[list[tuple], Spoken]:
    """Cues in order, runs of them without a lock, and heard characters: few, none or many between locks."""
    r = random.Random(seed)
    heard, rows, at, now = Spoken(), [], 0, 1.0
    for pos in range(r.randrange(1, 25)):
        locked = r.random() < 0.4
        size = r.randrange(1, 30)
        n = size if locked else r.choice([0, 0, 0, 1, 2, size // 2, size, 3 * size])
        begin = now
        for _ in range(n):
            now += r.choice([0.03, 0.07, 0.2])
            heard.add("x", now - 0.03, now)
        now += r.choice([0.0, 0.01, 0.4, 3.0])
        rows.append([pos, begin if locked else begin + r.random(), now if locked else now + r.random(), locked, size, at if locked else None, at + n - 1 if locked else None])
        at += n
    return rows, heard


def test_interpolation_equals_that_of_realigning(spark):
    cues, chars, want = [], [], {}
    for seed in range(120):
        key = (f"e{seed % 7}", seed)
        rows, heard = made(seed)
        cues += [(*key, *row) for row in rows]
        chars += [(*key, k, s, e) for k, (s, e) in enumerate(zip(heard.starts, heard.ends, strict=True))]
        plain = [dict(zip(("pos", "start", "end", "locked", "size", "first", "last"), row, strict=True)) | {"interpolated": False} for row in rows]
        if heard.chars:
            align._between(plain, heard)
        want |= {(*key, row["pos"]): (row["start"], row["end"], row["interpolated"]) for row in plain}
    got = timeline.interpolated(spark.createDataFrame(cues, CUES).repartition(4), spark.createDataFrame(chars, "k string, c int, place long, c_start double, c_end double").repartition(3), ["k", "c"], "pos")
    assert {(r.k, r.c, r.pos): (r.start, r.end, r.interpolated) for r in got.collect()} == want
    assert 0.2 < sum(i for *_, i in want.values()) / len(want) < 0.7


def test_interpolation_without_characters_or_rows(spark):
    none = spark.createDataFrame([], "k string, c int, place long, c_start double, c_end double")
    cues = spark.createDataFrame([("a", 1, 0, 1.0, 2.0, True, 3, None, None), ("a", 1, 1, 2.5, 2.6, False, 3, None, None), ("a", 1, 2, 5.0, 6.0, True, 3, None, None)], CUES)
    got = timeline.interpolated(cues, none, ["k", "c"], "pos").orderBy("pos").collect()
    assert [(r.start, r.end, r.interpolated) for r in got] == [(1.0, 2.0, False), (2.5, 2.6, False), (5.0, 6.0, False)]
    assert timeline.interpolated(cues.where("false"), none, ["k", "c"], "pos").collect() == []


def texts(seed: int) -> tuple[str, str]:
    r = random.Random(seed)
    text = "".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 120)))
    heard = "".join(c if r.random() < 0.85 else r.choice(["", "z", "zz"]) for c in text)
    at = r.randrange(len(heard) + 1)
    return heard[:at] + "q" * r.choice([0, 0, 9]) + heard[at:], text


def test_places_equal_those_of_realigning(spark):
    positions, blocks, sizes, want = [], [], [], {}
    for seed in range(150):
        heard, text = texts(seed)
        stones = align.Milestones(heard, text)
        blocks += [(seed, b.b, b.a, b.size) for b in stones.blocks]
        sizes.append((seed, len(heard)))
        positions += [(seed, at, "x") for at in range(len(text) + 1)]
        want |= {(seed, at): stones.place(at) for at in range(len(text) + 1)}
    p, b, s = spark.createDataFrame(positions, "k int, at long, text_at string"), spark.createDataFrame(blocks, "k int, text_at long, heard_at long, size long"), spark.createDataFrame(sizes, "k int, heard_size long")
    got = timeline.piecewise(p.withColumnRenamed("text_at", "more").repartition(4), b.repartition(3), "k", s)
    assert {(r.k, r["at"]): r.place for r in got.collect()} == want and got.columns == ["k", "at", "more", "place"]
    assert sum(v is None for v in want.values()) < 0.2 * len(want)


@pytest.mark.parametrize("at", [0, 5])
def test_places_without_blocks(spark, at):
    p, s = spark.createDataFrame([(1, at)], "k int, at long"), spark.createDataFrame([(1, 4)], "k int, heard_size long")
    assert timeline.piecewise(p, spark.createDataFrame([], "k int, text_at long, heard_at long, size long"), "k", s).collect()[0].place is None


def test_likeness_of_neighbours(spark):
    """Every cue of the table against the formula, matched characters from the standard library's matcher."""
    from difflib import SequenceMatcher

    from cuewise.plans.registry import QUERIES
    from cuewise.sources import derived

    from . import plain
    from .against import SF

    got = {(r.doc_id, r.line_no): r.likeness for r in QUERIES["neighbour_likeness"](spark, SF).collect()}
    before = None
    for r in derived.cues(spark, SF).orderBy("doc_id", "line_no").collect():
        wanted, heard = plain.spoken(r.text), before[1] if before and before[0] == r.doc_id else None
        before = r.doc_id, wanted
        if not heard or not wanted:
            assert got[r.doc_id, r.line_no] is None
            continue
        common = sum(b.size for b in SequenceMatcher(None, heard, wanted).get_matching_blocks())
        second = len(heard) > 1 and len(wanted) > 1
        ends = (0.15 if heard[0] == wanted[0] else 0.08 if second and heard[1] == wanted[1] else 0.0) + (0.10 if heard[-1] == wanted[-1] else 0.05 if second and heard[-2] == wanted[-2] else 0.0)
        want = 0.50 * common / len(wanted) + 0.25 * common / len(heard) + ends if common else 0.0
        assert got[r.doc_id, r.line_no] == pytest.approx(10_000 * want, abs=0.51)
    assert len(got) > 1000


def test_the_first_of_nearly_equal_rows_wins(spark):
    from cuewise.operators import folds

    scores = {"a": [1.0, 1.5, 1.2, 2.1, 2.2], "b": [None, -3.0, None], "c": [None], "d": [5.0, 4.0]}
    rows = [(k, n, s, "x") for k, own in scores.items() for n, s in enumerate(own)]
    table = spark.createDataFrame(rows, "k string, pos int, score double, more string").repartition(3)
    got = sorted((r.k, r.pos, r.score) for r in folds.best_by_margin(table, "k", "pos", "score", 1.0).collect())
    assert got == [("a", 3, 2.1), ("b", 1, -3.0), ("d", 0, 5.0)]


def _matched(heard: str, wanted: str) -> int:
    from difflib import SequenceMatcher

    return sum(b.size for b in SequenceMatcher(None, heard, wanted).get_matching_blocks())


def test_common_characters_are_those_of_difflib(monkeypatch):
    """Over short and long texts, few and many different characters; lines of usual length never reach the matcher itself."""
    r = random.Random(3)
    some = lambda signs, n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzäöü0123456789"[:signs]) for _ in range(n))
    pairs = []
    for _ in range(400):
        signs = r.choice([1, 2, 4, 20, 39])
        wanted = some(signs, r.choice([r.randrange(1, 330), r.randrange(195, 205)]))
        heard = "".join(c if r.random() < 0.8 else r.choice(["", "z", some(signs, 3)]) for c in wanted)
        pairs += [(heard, wanted), (some(signs, r.randrange(1, 400)), wanted)]
    want = [_matched(*p) for p in pairs]
    monkeypatch.setattr(align, "SequenceMatcher", None)
    assert [align.Wanted(w).common(h) for h, w in pairs] == want


def test_common_characters_of_very_long_texts():
    r = random.Random(4)
    wanted = "".join(r.choice("abcdefghijklmnop0123") for _ in range(3000))
    heard = "".join(c for c in wanted if r.random() < 0.9)
    assert align.Wanted(wanted).common(heard) == _matched(heard, wanted)


@pytest.mark.parametrize("text", ["only words, no number.", ".프로 a.b", "tone and one-half, twenty\tone", "三百 hundred 2 hundredth", "3 hundred", "fünf. ½ ٣ Ⅳ", "İΣ　x\x1fy"])
def test_normal_text_skips_no_rewrite(text):
    import unicodedata

    from cuewise.functions import spoken

    want = "".join(unicodedata.normalize("NFKC", c).lower() for c in text)
    for rule in spoken.REWRITES:
        want = rule.pattern.sub(rule.new, want)
    assert spoken.normal_text(text) == want


def test_interpolation_along_stretches_equals_that_of_characters(spark):
    """Stretches of one to nine characters with single times, so that a place is found inside its stretch."""
    from pyspark.sql import functions as F

    cues, stretches, want = [], [], {}
    for seed in range(120):
        rows, heard = made(seed)
        r, n, at = random.Random(seed), len(heard.chars), 0
        cues += [(seed, *row, n or None) for row in rows]
        while at < n:
            size = min(r.randrange(1, 10), n - at)
            stretches.append((seed, at, (heard.starts[at : at + size], heard.ends[at : at + size])))
            at += size
        plain = [dict(zip(("pos", "start", "end", "locked", "size", "first", "last"), row, strict=True)) | {"interpolated": False} for row in rows]
        if heard.chars:
            align._between(plain, heard)
        want |= {(seed, row["pos"]): (row["start"], row["end"], row["interpolated"]) for row in plain}
    c = spark.createDataFrame(cues, "k int, pos int, start double, end double, locked boolean, size long, first long, last long, heard long").repartition(4)
    s = spark.createDataFrame(stretches, "k int, place long, stretch struct<starts:array<double>,ends:array<double>>").repartition(3)
    at = lambda x, k: F.struct(F.get(x["starts"], k.cast("int")).alias("c_start"), F.get(x["ends"], k.cast("int")).alias("c_end"))
    got = timeline.interpolated_along(c, s, ["k"], "pos", at)
    assert {(r.k, r.pos): (r.start, r.end, r.interpolated) for r in got.collect()} == want


def test_interpolating_a_query_shuffles_cues_only(spark):
    """Neither words nor characters become rows, and nothing is shuffled but what the cues are dealt by."""
    from cuewise.plans.registry import QUERIES

    from .against import SF

    plan = QUERIES["interpolate_unlocked"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and plan.count("posexplode") <= 2
