import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cuewise.operators import align, audit, folds, plugins, timeline
from cuewise.streaming.sessions import paused_segments


def test_segments_break_at_a_pause():
    words = ["we", "go", "home", "now"]
    assert folds.segment_numbers(words, [0.0, 0.3, 0.6, 1.7], [0.2, 0.5, 0.9, 2.0], False) == [0, 0, 0, 1]
    assert folds.segment_numbers(["a", " "], [0.0, 0.3], [0.2, 0.5], False) == [-1, -1]


def test_loops_shrink_to_one_copy():
    assert folds.without_loops(["la"] * 6) == [0]
    assert folds.without_loops(["a", "b", "c"] * 3) == [0, 1, 2]
    assert folds.without_loops(["a", "a", "a", "b"]) == [0, 1, 2, 3]


def test_chunks_cut_at_the_long_pause():
    starts = [i * 1.0 for i in range(40)]
    starts = [s + (1.2 if i >= 22 else 0.0) for i, s in enumerate(starts)]
    chunks = folds.chunk_numbers(starts, [s + 0.9 for s in starts], ["x"] * 40, 25)
    assert chunks == [0] * 22 + [1] * 18


@given(st.lists(st.tuples(st.floats(0, 50), st.floats(-1, 8)), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_repair_leaves_rising_starts_and_no_overlap(rows):
    s, e = folds.monotone([a for a, _ in rows], [a + d for a, d in rows])
    assert all(b > a for a, b in zip(s, s[1:], strict=False))
    assert all(x <= y + 1e-9 for x, y in zip(e, s[1:], strict=False))


def test_lead_in_borrows_time():
    s, e = folds.led_in([1.0, 3.0], [2.95, 4.0], [True, True])
    assert s[0] == pytest.approx(0.82)
    assert e[0] == pytest.approx(s[1])
    assert s[1] < 3.0


def test_clauses_are_even_and_within_the_limit():
    parts = align.split_clause("我們今天要來討論人工智慧的發展以及未來的各種可能性", 15.0, "zh-TW")
    assert len(parts) == 2 and all(align.width(p, "zh-TW") <= 15 for p in parts)
    words = " ".join(["word"] * 20)
    parts = align.split_clause(words, 42.0, "en")
    assert " ".join(parts) == words and max(map(len, parts)) <= 42


@given(st.lists(st.text("abc,.", min_size=1, max_size=9), min_size=1, max_size=25))
@settings(max_examples=60, deadline=None)
def test_balanced_parts_join_to_the_whole(tokens):
    assert " ".join(align.balanced(tokens, " ", 20.0, "en")) == " ".join(tokens)


def test_pinning_prefers_the_pause():
    text = "今天天氣很好我們出去玩吧"
    words = [(c, 1.0 + 0.2 * k + (0.5 if k >= 6 else 0.0), 1.2 + 0.2 * k + (0.5 if k >= 6 else 0.0)) for k, c in enumerate(text)]
    (s1, e1, _), (s2, e2, _) = align.pin([text[:6], text[6:]], 1.0, 4.0, words)
    assert (s1, e2) == (1.0, 4.0)
    assert e1 == pytest.approx(2.2) and s2 == pytest.approx(2.7)


def test_realign_locks_and_interpolates():
    words = [(w, float(k), k + 0.8) for k, w in enumerate("alpha beta gamma delta epsilon zeta".split(), 1)]
    cues = [(0, 0.0, 1.0, "Alpha beta"), (1, 1.0, 2.0, "xxqq zz"), (2, 2.0, 9.0, "epsilon zeta")]
    rows = align.realign(cues, words)
    assert [r["locked"] for r in rows] == [True, False, True]
    assert rows[1]["interpolated"] and rows[0]["end"] <= rows[1]["start"] <= rows[1]["end"] <= 5.0
    assert rows[2]["end"] == pytest.approx(6.8)


def test_realigned_groups(spark):
    cues = spark.createDataFrame([("e", 0, 0, 0.0, 1.0, "alpha beta")], "k string, chunk int, pos int, start double, end double, text string")
    words = spark.createDataFrame([("e", 0, 0, "alpha", 2.0, 2.5), ("e", 0, 1, "beta", 2.6, 3.0)], "k string, chunk int, word_pos int, word string, start double, end double")
    (row,) = align.realigned(cues, words, ["k", "chunk"], "pos", "word_pos").collect()
    assert row.locked and row.end == pytest.approx(3.0) and row.start < 2.0


def test_tail_gives_time_to_read(spark):
    cues = spark.createDataFrame([("e", 0, 1.0, 2.0, "這是一句很長的字幕文字"), ("e", 1, 8.0, 9.0, "好")], "k string, pos int, start double, end double, text string")
    first = timeline.tailed(cues, "k", "pos", F.length("text").cast("double"), F.lit(5.5)).orderBy("pos").first()
    assert first["end"] - first["start"] >= 2.0
    near = spark.createDataFrame([("e", 0, 1.0, 2.0, "ok"), ("e", 1, 2.5, 3.5, "ok")], "k string, pos int, start double, end double, text string")
    assert timeline.tailed(near, "k", "pos", F.lit(2.0), F.lit(16.0)).orderBy("pos").first()["end"] == 2.5


def test_inflated_onset_moves(spark):
    words = spark.createDataFrame([("e", 0, "大家", 0.10, 2.40), ("e", 1, "好", 2.4, 2.6)], "k string, pos int, word string, start double, end double")
    assert timeline.onset_clamped(words, "k", "pos").orderBy("pos").first()["onset"] >= 1.40


def test_windows(spark):
    media = spark.createDataFrame([("a", 300.0), ("b", 2200.0)], "k string, d double")
    rows = timeline.windows(media, "k", "d").orderBy("k", "window_id").collect()
    assert [(r.k, r.w_start, r.w_end) for r in rows] == [("a", 0.0, 300.0), ("b", 0.0, 1080.0), ("b", 1075.0, 2160.0), ("b", 2155.0, 2200.0)]


def test_gate(spark):
    verdict = spark.range(1).select(audit.gate(F.lit(50.0), F.lit(1.0), F.lit(10.0), F.lit(0)).alias("v")).first()["v"]
    assert verdict.violations == ["LOW_ACOUSTIC_LOCK_RATE", "LAST_OUT_EXCEEDS_DURATION"] and verdict.action == "ONE_SHOT_REMEDIATE"
    assert spark.range(1).select(audit.gate(F.lit(100.0), F.lit(1.0), F.lit(None).cast("double"), F.lit(0)).alias("v")).first()["v"].passed


def test_services(spark):
    media = spark.createDataFrame([(1, bytearray(b"one two"))], "episode_id long, content binary")
    assert [r.word for r in plugins.recognised(media, plugins.spelled_recogniser).orderBy("word_pos").collect()] == ["one", "two"]
    chunks = spark.createDataFrame([("a", "A"), ("b", "B")], "chunk_key string, srt string")
    cache = spark.createDataFrame([("a", "cached")], "chunk_key string, answer string")
    assert {r.chunk_key: r.answer for r in plugins.corrected(chunks, plugins.echo_corrector, cache).collect()} == {"a": "cached", "b": "```srt\nB\n```"}
    asked = spark.createDataFrame([("a", "ja", "A"), ("b", "fr", "B")], "chunk_key string, locale string, srt string")
    templates = spark.createDataFrame([("en", "E"), ("ja", "J")], "locale string, template string")
    assert {r.chunk_key: r.prompt for r in plugins.prompted(asked, templates).collect()} == {"a": "J\n\nA", "b": "E\n\nB"}
    waits: list[float] = []
    answers = iter([ConnectionError(), ConnectionError(), 7])

    def call():
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert plugins.with_retries(call, wait=waits.append, seed=1) == 7 and len(waits) == 2 and waits[0] >= 2.5


def test_wav_length(spark):
    import io
    import wave

    raw = io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16_000), w.writeframes(b"\0\0" * 24_000)
    rows = spark.createDataFrame([(bytearray(raw.getvalue()),), (bytearray(b"no"),), (None,)], "content binary").select(plugins.wav_seconds("content").alias("s")).collect()
    assert [r.s for r in rows] == [1.5, None, None]


def test_streamed_segments(spark):
    words = spark.createDataFrame(pd.DataFrame({"k": ["e"] * 3, "at": pd.to_datetime([0, 200, 1000], unit="ms"), "word": ["a", "b", "c"]}))
    assert sorted(r.words for r in paused_segments(words, "k").collect()) == [["a", "b"], ["c"]]


def test_plain_lines_are_cleaned_without_rewrites(monkeypatch):
    from cuewise.functions import tables
    from cuewise.operators import align

    assert [align.cleaned(x, "en") for x in ("a  b\t c - ", "# **t** -\n\n x", "a -- ", "_a_")] == ["a b c", "t\nx", "a --", "_a_"]
    monkeypatch.setattr("re.sub", None)
    assert align.cleaned("Plain words, no marks.", "en") == "Plain words, no marks."
    # Rows of a table function go in batches; as Arrow each row would be a table of its own.
    from pyspark.util import PythonEvalType

    assert tables.SplitClauses.evalType == PythonEvalType.SQL_TABLE_UDF
