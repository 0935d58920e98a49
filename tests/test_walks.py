"""Steps that walk an episode's words where they lie: as the joins do it, without moving words."""

import random
import unicodedata
from difflib import SequenceMatcher

import pytest

from cuewise.functions import spoken
from cuewise.operators import align, folds
from cuewise.plans import fold_queries as Q

from .test_folds import shuffles

SF = "/root/testdata/sf0.001"


def said(seed: int, n: int = 400) -> list[tuple[str, int, str, float, float]]:
    """Words of one episode, some pauses and some that start before the one ahead of them."""
    r, at, rows = random.Random(seed), 0.0, []
    for k in range(n):
        start = max(0.0, at - r.choice([0.0, 0.0, 0.0, 0.4]))
        end = start + r.choice([0.1, 0.3, 0.9])
        rows.append(("e", k, r.choice(["alpha", "be", "gamma.", "delta,", "epsilon-zeta", "twenty one", "é世界", "Ω"]), start, end))
        at = end + r.choice([0.0, 0.05, 0.2, 3.0])
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_segments_are_pinned_and_realigned_as_by_joins(spark, seed):
    words = spark.createDataFrame(said(seed), "k string, word_pos long, word string, start double, end double")
    made = folds.segments(words, "k", "word_pos").selectExpr("k", "segment", "start", "end", "array_join(words, ' ') AS text")
    want = align.pinned_clauses(made, words, "k", "segment", "word_pos", 16.0, "en").collect()
    assert sorted(map(tuple, align.pinned_segments(words, "k", "word_pos", 16.0, "en").collect())) == sorted(map(tuple, want))
    chunk = "floor(segment / 10) AS chunk"
    want = align.realigned(made.selectExpr("*", chunk), folds.segmented(words, "k", "word_pos").selectExpr("*", chunk), ["k", "chunk"], "segment", "word_pos").collect()
    got = align.realigned_segments(words, "k", "word_pos", 10, lambda number, start, end, text: (start, end, text)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_a_walk_holds_what_segments_can_reach(monkeypatch):
    held = []
    monkeypatch.setattr(align, "sorted", lambda rows, key: held.append(len(rows)) or sorted(rows, key=key), raising=False)
    rows = [("e", k, "word.", 1.0 * k, k + 0.5) for k in range(5000)]
    taken = []
    stream = align.near_segments((taken.append(r) or r for r in rows), False, 0.3)
    for number, (own, near) in enumerate(stream):
        assert own == [rows[number]] and near == [rows[number]] and len(taken) <= number + 10
    assert number == 4999
    with pytest.raises(ValueError, match="before one ahead"):
        list(align.near_segments([("e", 0, "a", 10.0, 11.0), ("e", 1, "b", 4.0, 5.0)], False, 0.3))


def test_words_are_not_shuffled_to_be_pinned_or_realigned(spark):
    for name in ("pin_clauses", "realign", "realign_misheard"):
        assert shuffles(Q.QUERIES[name](spark, SF)) == 1


def test_one_text_within_the_other_is_one_match():
    r = random.Random(4)
    for _ in range(300):
        inner = "".join(r.choice("abc") for _ in range(r.randrange(0, 12)))
        outer = "".join(r.choice("abc") for _ in range(r.randrange(0, 30))) + inner + "".join(r.choice("abc") for _ in range(r.randrange(0, 30)))
        for a, b in ((inner, outer), (outer, inner)):
            want = [m for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size >= 4]
            assert [(m.a, m.b, m.size) for m in align.long_matches(a, b, 4) if m.size == len(inner)] == [(m.a, m.b, m.size) for m in want if m.size == len(inner)]


def test_words_of_any_script_are_timed_as_one_by_one(monkeypatch):
    r = random.Random(5)
    for _ in range(60):
        words, at = [], 0.0
        for _ in range(40):
            words.append((r.choice(["Straße", "ＡＢ", "三十", "五.", "ﬁn", "İs", "百分之五", "…", "日本語、", "twenty", "3", ".5", "퍼센트", "　x", "é"]), at, at + r.choice([0.0, 0.3, 2.0])))
            at = words[-1][2] + r.choice([0.0, 0.5])
        found = spoken.char_timeline(words)
        monkeypatch.setattr(spoken, "_SOME", 1 << 30)
        want = spoken.char_timeline(words)
        monkeypatch.undo()
        assert found.text == want.text and found.starts == pytest.approx(want.starts, abs=1e-12) and found.ends == pytest.approx(want.ends, abs=1e-12)
    words = [("日本語", k, k + 0.5) for k in range(30)]
    calls = []
    monkeypatch.setattr(spoken, "normalised", lambda parts: calls.append(1))
    assert spoken.char_timeline(words).text == "日本語" * 30 and not calls and unicodedata.normalize("NFKC", "日") == "日"


def test_words_of_lines_stay_in_place(spark):
    """Nothing is moved behind the lines: not to be written as JSON, recognised in windows, stitched, numbered or brought to their written form."""
    from cuewise.plans.registry import QUERIES

    for name in ("words_json_explode", "window_transcript", "spoken_times"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
        assert not [line for line in plan if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" not in line]


def test_words_of_a_line_are_those_of_rows(spark):
    from cuewise.sources import derived

    lines = [(1, 0, " a  bc def "), (1, 1, "x"), (1, 2, "  "), (2, 0, "ab " * 20_000), (2, 1, "é 世界 𝒳𝒳 " * 99), (3, 0, "")]
    cues = spark.createDataFrame([(d, n, t, 1000 * n, 1000 * n + 40_000) for d, n, t in lines], "doc_id long, line_no long, text string, start_ms long, end_ms long")
    listed = derived.line_words(cues).selectExpr("doc_id", "line_no", "posexplode(words) AS (word_pos, w)").selectExpr("doc_id", "line_no", "CAST(word_pos AS long) AS word_pos", "w.word", "w.start_ms", "w.end_ms")
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, derived.words(cues).collect()))
