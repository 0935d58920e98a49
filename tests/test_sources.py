"""Sound files, polled operations, caption blocks, table functions and service chains."""

import io
import json
import random
import struct
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from cuewise.functions import tables
from cuewise.operators import align, plugins, transcript
from cuewise.plans.registry import QUERIES
from cuewise.sources import captions, media, polled

from . import plain
from .against import SF


def wav(samples: np.ndarray, rate: int, width: int = 2) -> bytes:
    """Whole-number samples (frames by channels) as a file by the standard library."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(samples.shape[1])
        w.setsampwidth(width)
        w.setframerate(rate)
        wide = (samples + 128).astype(np.uint8).tobytes() if width == 1 else samples.astype("<i4").ravel().view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
        w.writeframes(wide)
    return out.getvalue()


def noise(frames: int, channels: int, bits: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).integers(-(1 << (bits - 1)), 1 << (bits - 1), (frames, channels))


@pytest.mark.parametrize("width", [1, 2, 3, 4])
@pytest.mark.parametrize("channels", [1, 2])
def test_samples_are_those_of_the_file(width, channels):
    samples = noise(333, channels, 8 * width)
    found = media.sound(wav(samples, 16_000, width))
    assert (found.rate, found.channels, found.bits, found.frames, found.seconds) == (16_000, channels, 8 * width, 333, round(333 / 16_000, 3))
    assert media.mono(found) == pytest.approx(samples.mean(axis=1) / 2.0 ** (8 * width - 1), abs=1e-12)


@pytest.mark.parametrize("rate", [8_000, 11_025, 16_000, 22_050, 44_100, 48_000])
def test_a_tone_stays_at_another_rate(rate):
    """A tone below half of both rates keeps its height, and one above what 16 kHz can hold is gone."""
    tone = lambda hz, at, n: np.sin(2 * np.pi * hz * np.arange(n) / at)
    out = media.resampled(tone(1000, rate, rate), rate)
    assert len(out) == 16_000
    assert np.abs(out - tone(1000, 16_000, 16_000))[400:-400].max() < 0.01
    if rate >= 44_100:
        assert np.abs(media.resampled(tone(12_000, rate, rate), rate))[400:-400].max() < 0.02


def test_files_with_more_in_them():
    plain_file = wav(noise(50, 1, 16), 8_000)
    extra = b"LIST" + struct.pack("<I", 5) + b"odd!!\0"
    listed = plain_file[:12] + extra + plain_file[12:]
    assert media.sound(listed).data == media.sound(plain_file).data and media.sound(listed).seconds == 50 / 8000 // 0.001 / 1000 or media.sound(listed).seconds == 0.006
    form = struct.pack("<HHIIHHHHIH14s", media.EXTENSIBLE, 1, 8_000, 16_000, 2, 16, 22, 16, 4, media.PCM, b"\0" * 14)
    wide = b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<I", len(form)) + form + plain_file[36:]
    assert bytes(media.sound(wide).data) == bytes(media.sound(plain_file).data)
    floats = np.array([0.5, -0.25], "<f4").tobytes()
    real = b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, media.FLOAT, 1, 8_000, 32_000, 4, 32) + b"data" + struct.pack("<I", 8) + floats
    assert media.mono(media.sound(real)).tolist() == [0.5, -0.25]
    cut = plain_file[:-20]
    assert media.sound(cut).frames == 50 and len(media.mono(media.sound(cut))) == 40


@pytest.mark.parametrize("content", [None, b"", b"RIFF", b"RIFF0000WAVE", b"no sound at all, but text", b"RIFF0000WAVEdata\x04\0\0\0abcd", b"RIFF0000WAVEfmt \x10\0\0\0" + b"\0" * 16 + b"data\0\0\0\0"])
def test_what_is_no_sound_is_null(content):
    assert media.sound(content) is None


def test_a_folder_of_files_is_scanned(spark, tmp_path):
    made = {"a.wav": wav(noise(16_000, 1, 16), 16_000), "b/c.wav": wav(noise(44_100, 2, 16), 44_100), "b/d.txt": b"text", "e.wav": wav(noise(0, 1, 16), 8_000)}
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = media.read_media(spark, str(tmp_path)).select("path", media.scan_wav("content").alias("s"), media.mono_16k("content").alias("pcm")).collect()
    got = {r.path.split("/")[-1]: (r.s and r.s.seconds, None if r.pcm is None else len(r.pcm)) for r in rows}
    assert got == {"a.wav": (1.0, 32_000), "c.wav": (1.0, 32_000), "d.txt": (None, None), "e.wav": (0.0, 0)}
    same = next(bytes(r.pcm) for r in rows if r.path.endswith("a.wav"))
    assert same == made["a.wav"][44:]


def test_written_files_are_read_by_the_standard_library(spark):
    rows = spark.createDataFrame([(bytearray(b"abcdefg"), 8000, 1, 8), (bytearray(b"abcdefgh"), 44100, 2, 16)], "samples binary, rate int, channels int, bits int")
    for r in rows.select("*", media.wav(F.col("samples"), F.col("rate"), F.col("channels"), F.col("bits")).alias("file")).collect():
        with wave.open(io.BytesIO(bytes(r.file))) as w:
            assert (w.getframerate(), w.getnchannels(), 8 * w.getsampwidth(), w.readframes(99)) == (r.rate, r.channels, r.bits, bytes(r.samples))


# Polled operations

DONE = (200, json.dumps({"done": True, "response": {"words": ["ä"]}}))
BUSY = (200, json.dumps({"done": False}))


def read(spark, answers, **options):
    spark.dataSource.register(polled.polled_source(polled.Recorded(answers), "polled_test"))
    reader = spark.read.format("polled_test").option("every", 0.0)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_operations_are_asked_until_they_are_done(spark):
    answers = {f"op{k}": [BUSY] * (k % 3) + [DONE] for k in range(10)}
    rows = read(spark, answers, parts=4)
    assert rows.rdd.getNumPartitions() == 4
    assert {r.operation: (json.loads(r.response), r.polls) for r in rows.collect()} == {f"op{k}": ({"words": ["ä"]}, k % 3 + 1) for k in range(10)}
    assert read(spark, {}, parts=4).count() == 0


@pytest.mark.parametrize(("answers", "message"), [([(403, "no")], "status 403"), ([(404, "gone")], "status 404"), ([(200, json.dumps({"done": True, "error": {"code": 3, "message": "bad sound"}}))], "bad sound")])
def test_a_partition_that_is_refused_fails_the_read(spark, answers, message):
    with pytest.raises(PythonException, match=message):
        read(spark, {"good": [DONE], "bad": answers}, parts=2).collect()


def test_an_operation_that_never_ends_is_given_up(spark):
    with pytest.raises(PythonException, match="not done after"):
        read(spark, {"good": [DONE], "slow": [BUSY]}, parts=2, every=0.01, cap=0.05).collect()


def test_what_is_busy_is_asked_again():
    waits: list[float] = []
    client = polled.Recorded({"x": [(503, ""), (429, ""), (500, ""), DONE]})
    assert polled.requested(client, "x", wait=waits.append, chance=random.Random(1))["done"]
    assert [pytest.approx(2.0 * 2**k, rel=0.151) for k in range(3)] == waits
    with pytest.raises(polled.Refused, match="503"):
        polled.requested(polled.Recorded({"x": [(503, "")]}), "x", wait=waits.append)
    assert polled.requested(polled.Recorded({"x": [(200, "  ")]}), "x") == {}

    class Broken:
        asked = 0

        def get(self, name):
            self.asked += 1
            if self.asked < 3:
                raise ConnectionError(name)
            return DONE

    assert polled.requested(Broken(), "x", wait=waits.append)["done"]


def test_statuses_tell_which_calls_are_tried_again():
    asked: list[int] = []

    def call(status):
        asked.append(status)
        raise plugins.StatusError(status)

    for status, times in ((429, 3), (503, 3), (400, 1), (403, 1)):
        asked.clear()
        with pytest.raises(plugins.StatusError):
            plugins.with_retries(lambda s=status: call(s), tries=3, wait=lambda _: None)
        assert len(asked) == times


# Services in a chain, windows, blocks and table functions


def test_the_first_service_that_can_run_answers(spark):
    def missing(frame):
        import a_library_that_is_not_there  # noqa: F401

    def elsewhere(frame):
        raise plugins.Unavailable("no device")

    rows = spark.createDataFrame([(1, bytearray(b"one two")), (2, bytearray(b"three"))], "episode_id long, content binary")
    service = plugins.first_available(missing, elsewhere, plugins.spelled_recogniser)
    assert sorted((r.episode_id, r.word) for r in plugins.recognised(rows, service).collect()) == [(1, "one"), (1, "two"), (2, "three")]
    with pytest.raises(plugins.Unavailable):
        plugins.first_available(missing, elsewhere)(pd.DataFrame({"episode_id": [1]}))
    with pytest.raises(ZeroDivisionError):
        plugins.first_available(lambda frame: 1 / 0, plugins.spelled_recogniser)(pd.DataFrame())


def test_windows_are_put_in_order_and_silent_ones_left_out(spark):
    doc = lambda *words: json.dumps({"results": [{"alternatives": [{"words": [{"word": w, "startOffset": f"{a}s", "endOffset": f"{b}s"} for w, a, b in words]}]}]})

    def service(frame):
        said = {0: doc(("one", 1, 2), ("both", 56.0, 57.0), ("late", 58.0, 59.0)), 1: doc(("both", 1.0, 2.0), ("late", 3.0, 4.0), ("two", 30, 30)), 2: None}
        return pd.DataFrame({"k": frame["k"], "window_id": frame["window_id"], "doc": [said[w] for w in frame["window_id"]]}).iloc[::-1]

    table = spark.createDataFrame([("x", 150.0)], "k string, seconds double")
    got = [tuple(r) for r in transcript.transcript(table, "k", transcript.by_service(service, "k"), width=60.0, overlap=5.0).orderBy("word_pos").collect()]
    assert got == [("x", 0, "one", 1.0, 2.0), ("x", 1, "both", 56.0, 57.0), ("x", 2, "late", 58.0, 59.0), ("x", 3, "two", 85.0, 85.02)]


def test_blocks_as_chunking_reads_them(spark):
    text = "1\n00:00:01,000 --> 00:00:02,500\n first \nsecond line\n\n\n00:00:03,000 --> 00:00:04,000\nbare\n\nno time at all\n\n4\n00:00:05,000 --> 00:00:06,000\n\n x \n\n00:00:07,000 --> 00:00:08,000"
    rows = spark.createDataFrame([("f", text), ("empty", ""), ("null", None)], "k string, srt string")
    got = [(r.k, r.block_pos, r.start, r.end, r.text) for r in captions.scan_blocks(rows, "k", F.col("srt")).orderBy("block_pos").collect()]
    assert got == [("f", 0, 1.0, 2.5, "first"), ("f", 1, 3.0, 4.0, "bare"), ("f", 2, 0.0, 0.0, ""), ("f", 3, 5.0, 6.0, ""), ("f", 4, 0.0, 0.0, ""), ("f", 5, 7.0, 8.0, "")]


def test_lateral_clauses_are_those_of_the_column_function(spark):
    got, want = (sorted(map(tuple, QUERIES[n](spark, SF).select("doc_id", "line_no", "clause", "text").collect())) for n in ("lateral_clauses", "split_long_clause"))
    assert got == want
    tables.register(spark)
    assert spark.sql("SELECT * FROM split_clauses(CAST(NULL AS STRING), 42D, 'en')").collect() == []


def test_spoken_times(spark):
    """All cues of the table: the text as the untimed form has it, and times by a plain rewriting of one list of characters."""
    from cuewise.plans import flow_queries as Q

    cues: dict = {}
    for r in Q.derived.words(Q.derived.cues(spark, SF)).orderBy("doc_id", "line_no", "word_pos").collect():
        cues.setdefault((r.doc_id, r.line_no), []).append((r.word, r.start_ms / 1000, r.end_ms / 1000))
    got = {(r.doc_id, r.line_no): r for r in QUERIES["spoken_times"](spark, SF).collect()}
    assert got.keys() == cues.keys()
    for k, words in cues.items():
        chars = plain.timed(words)
        assert got[k].text == "".join(c for c, _, _ in chars)
        assert [round(s * 1000) for _, s, _ in chars] == pytest.approx(got[k].starts_ms, abs=1) and [round(e * 1000) for _, _, e in chars] == pytest.approx(got[k].ends_ms, abs=1)


def test_written_forms_of_several_scripts(spark):
    rows = [("a", 0, "百分之", 0.0, 0.6), ("a", 1, "五十", 0.6, 1.0), ("b", 0, "three", 0.0, 0.4), ("b", 1, "point", 0.4, 0.8), ("b", 2, "five", 0.8, 1.2), ("c", 0, "...", 0.0, 0.1), ("c", 1, None, 0.1, 0.2), ("d", 0, "ｶﾅ", 0.0, 0.7), ("e", 0, "이십", 0.0, 0.5)]
    table = spark.createDataFrame(rows, "k string, pos int, word string, start double, end double")
    got = {r.k: (r.text, r.starts, r.ends) for r in align.written(table, ["k"], "pos").collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "50%", "b": "3.5", "c": "", "d": "カナ", "e": "20"}
    assert got["a"][1] == pytest.approx([0.0, 1 / 3, 2 / 3]) and got["a"][2] == pytest.approx([1 / 3, 2 / 3, 1.0])
    assert got["c"][1] == [] and got["e"][1] == pytest.approx([0.0, 0.25])
    spread = align.characters(align.written(table, ["k"], "pos"), ["k"])
    assert sorted((r.k, r.place, r.char) for r in spread.collect() if r.k == "b") == [("b", 0, "3"), ("b", 1, "."), ("b", 2, "5")]
