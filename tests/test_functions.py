import pytest
from pyspark.sql import functions as F

from cuewise.functions import links, text as T, timecode
from cuewise.functions.spoken import normal_text
from cuewise.sources import captions


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("seconds", "code"), [(0.0, "00:00:00,000"), (3661.5, "01:01:01,500"), (-2.0, "00:00:00,000"), (1.9996, "00:00:01,999")])
def test_time_codes(spark, seconds, code):
    assert one(spark, timecode.srt_timestamp(F.lit(seconds))) == code


@pytest.mark.parametrize(("code", "seconds"), [("01:01:01,500", 3661.5), ("00:00:02.250", 2.25), ("00:00:01,5", 1.005), ("nonsense", None)])
def test_parsed_time_codes(spark, code, seconds):
    got = one(spark, timecode.parse_timestamp(F.lit(code)))
    assert got == (pytest.approx(seconds) if seconds is not None else None)


@pytest.mark.parametrize(("offset", "seconds"), [("1.5s", 1.5), ("7", 7.0), ("soon", 0.0), (None, 0.0)])
def test_offsets(spark, offset, seconds):
    assert one(spark, timecode.offset_seconds(F.lit(offset))) == seconds


@pytest.mark.parametrize(("tag", "locale"), [("zh_TW", "zh-TW"), ("zh-Hans", "zh-CN"), ("ja-JP", "ja"), ("ko", "ko"), ("en-GB", "en"), ("fr", "en"), ("", "en"), (None, "en")])
def test_locales(spark, tag, locale):
    assert one(spark, T.locale(F.lit(tag).cast("string"))) == locale


@pytest.mark.parametrize(("locale", "text", "width"), [("zh-TW", "字幕 ab", 3.0), ("ko", "가나 a", 3.0), ("en", "ab cd", 5.0)])
def test_display_width(spark, locale, text, width):
    assert one(spark, T.display_width(F.lit(text), F.lit(locale))) == width


@pytest.mark.parametrize(
    ("locale", "raw", "clean"),
    [
        ("zh-TW", "我們用Python，寫1,000行。", "我們用 Python 寫 1,000 行"),
        ("zh-TW", "**重點**\n\n## 標題。", "重點\n標題"),
        ("en", "Well, **this** is  it-", "Well, this is it"),
        ("en", "Keep the stop.", "Keep the stop."),
    ],
)
def test_cleaning(spark, locale, raw, clean):
    from cuewise.operators.align import cleaned

    assert one(spark, T.clean(F.lit(raw), F.lit(locale))) == clean
    assert cleaned(raw, locale) == clean


@pytest.mark.parametrize(
    ("a", "b"),
    [("一百二十三", "123"), ("百分之三十", "30%"), ("三點八", "3.8"), ("twenty-five", "25"), ("two hundred and five", "205"), ("삼점팔", "3.8"), ("이십오 퍼센트", "25%"), ("100美金", "$100"), ("1,000", "1000"), ("fifty per cent", "50%"), ("ＡＢＣ", "abc")],
)
def test_spoken_forms(a, b):
    assert normal_text(a) == normal_text(b)


def test_recogniser_codes(spark):
    code = lambda tag, prompt=None: one(spark, T.recogniser_codes(F.lit(tag), F.lit(prompt).cast("string")))
    assert code("zh") == ["cmn-Hant-TW", "en-US"]
    assert code("en") == ["en-US"]
    assert code("auto") == ["auto"]
    assert code("auto", "これは") == ["ja-JP", "en-US"]
    assert code("auto", "专有名词") == ["cmn-Hans-CN", "en-US"]


def test_display_join_and_brackets(spark):
    assert one(spark, T.join_words(F.array(*map(F.lit, ["今天", "天氣", "，", "ok", "then", "!"])))) == "今天天氣， ok then!"
    assert one(spark, T.unbalanced(F.lit("（a) [b]"))) == ["()", "（）"]


def test_bias_prompt(spark):
    own = "> **Whisper Initial Prompt**: `alpha, beta`\n**gamma**"
    assert one(spark, T.bias_prompt(F.lit(own), F.lit("en"))) == "alpha, beta"
    terms = "- **Core Topic**\n- **Apache Spark** (engine)\n- **Arrow（欄）**\n- **Arrow（欄）**"
    assert one(spark, T.bias_prompt(F.lit(terms), F.lit("en"))) == "The following is a video transcription containing terms: Apache Spark, Arrow."
    assert one(spark, T.bias_prompt(F.lit("no terms"), F.lit("en"))) is None


def test_links(spark):
    found = lambda s: one(spark, links.drive_id(F.lit(s)))
    assert tuple(found("https://drive.google.com/file/d/1AbCdEfGhIjKl/view")) == ("1AbCdEfGhIjKl", "file")
    assert tuple(found("gdrive://folder/1AbCdEfGhIjKl?x=1")) == ("1AbCdEfGhIjKl", "folder")
    assert found("https://example.com/a") is None
    assert tuple(one(spark, links.object_uri(F.lit("gs://bucket/a/b.wav")))) == ("bucket", "a/b.wav")
    assert one(spark, links.media_type(F.lit("/x/y.MKV"))) == "video/x-matroska"
    assert tuple(one(spark, links.setting(F.lit('export A="b c" # d')))) == ("A", "b c")
    assert one(spark, links.setting(F.lit("# A=b"))) is None


def test_file_names(spark):
    broken = "影片.mp4".encode().decode("latin-1")
    assert one(spark, links.repaired_name(F.lit(broken))) == "影片.mp4"
    assert one(spark, links.repaired_name(F.lit("plain.mp4"))) == "plain.mp4"
    header = lambda h: one(spark, links.header_filename(F.lit(h), F.lit("x")))
    assert header("attachment; filename*=UTF-8''%E5%BD%B1.mp4") == "影.mp4"
    assert header('attachment; filename="a b.mp4"') == "a b.mp4"
    assert header("attachment") == "x"


def test_caption_files(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,000\none\ntwo\n\nbroken\n\n00:00:03,000 --> 00:00:04,500\nthree\n"
    rows = captions.parse_srt(spark.createDataFrame([("e", srt)], "k string, v string"), "k", F.col("v")).orderBy("cue_pos").collect()
    assert [(r.idx, r.start, r.end, r.text) for r in rows] == [(1, 1.0, 2.0, "one\ntwo"), (2, 3.0, 4.5, "three")]
    assert one(spark, captions.to_vtt(F.lit("1\n00:00:01,000 --> 00:00:02,000\na, b\n"))) == "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\na, b\n"
    assert one(spark, T.fenced(F.lit("Sure:\n```srt\n1\n00:00:01,000 --> 00:00:02,000\nx\n```"))).startswith("1\n")
    assert one(spark, T.fenced(F.lit("no captions"))) is None


def test_word_cache_round_trip(spark, tmp_path):
    words = spark.createDataFrame([("e", 0, "a", 0.0, 0.5), ("e", 1, "b", 0.6, 0.9)], "episode_id string, word_pos int, word string, start double, end double")
    (tmp_path / "e.json").write_text(captions.word_cache(words, "episode_id", "asr", "en").first()["doc"])
    back = captions.read_word_cache(spark, str(tmp_path), "asr").orderBy("word_pos").collect()
    assert [(r.word, r.start, r.end) for r in back] == [("a", 0.0, 0.5), ("b", 0.6, 0.9)]
    assert captions.read_word_cache(spark, str(tmp_path), "other").isEmpty()


def test_output_folder_and_settings(spark):
    none = F.lit(None).cast("string")
    assert one(spark, links.output_dir(F.lit("/a/b.mp4"), none)) == "/a/output"
    assert one(spark, links.output_dir(F.lit("/a/output/b.mp4"), none)) == "/a/output"
    assert one(spark, links.output_dir(F.lit("b.mp4"), F.lit("/x"))) == "/x"
    assert one(spark, links.first_set(none, F.lit(" "), F.lit("c"), F.lit("d"))) == "c"
    assert one(spark, T.in_script(F.lit("国语"), {"国": "國", "语": "語"})) == "國語"


def test_joined_words_equal_those_joined_one_by_one(spark):
    """Words with blanks, signs of all kinds, the sign that stands between words, empty ones and nulls."""
    import random
    import re

    r, wide = random.Random(5), f"[{T.WIDE}]"
    signs = ["a", "字", ",", ".", "）", "「", " ", "  ", "", "b c", " d ", "!", "。", "가", "x.", "字a", ")", "\t", "𝒳", "　", "\n", "$", "\\", "\x1f", None]
    rows = [[r.choice(signs) for _ in range(r.randrange(0, 9))] for _ in range(3000)]

    def joined(words):
        line = ""
        for word in filter(None, (w.strip(" ") for w in words if w is not None)):
            last, first = line[-1:], word[0]
            wl, wf = re.match(wide, last), re.match(wide, first)
            close = (wl and wf) or (wl and re.match(T.AFTER_WIDE, first)) or (wf and re.match(T.AHEAD_OF_WIDE, last)) or (not wl and re.match(T.AFTER_LATIN, first))
            line += word if not line or close else " " + word
        return line

    got = spark.createDataFrame(list(enumerate(rows)), "k int, w array<string>").select("k", T.join_words(F.col("w")).alias("j")).collect()
    assert {x.k: x.j for x in got} == {k: joined(row) for k, row in enumerate(rows)}
    assert one(spark, T.join_words(F.lit(None).cast("array<string>"))) is None


def test_a_long_line_is_joined_in_one_pass(spark):
    """A quarter of a million words; joined one by one, each word would copy the line before it."""
    import time

    words = F.transform(F.sequence(F.lit(1), F.col("id") + 250_000), lambda i: F.when(i % 5 == 0, ".").otherwise("word"))
    rows = spark.range(1).select(T.join_words(words).alias("v"))
    began = time.time()
    assert len(rows.first()["v"]) == 250_000 // 5 * (4 * 4 + 1) + 250_000 // 5 * 4 - 1
    assert time.time() - began < 30


@pytest.mark.parametrize("loc", ["zh-TW", "ko", "en"])
def test_cleaning_steps_equal_rewrites_of_every_line(spark, loc):
    """What is looked for before a rewrite loses none: lines of all signs that any step knows, against the rewrites alone."""
    import random

    r = random.Random(6)
    signs = ["a", "字", ",", "，", ".", " ", "\t", "\n", "\r", "*", "_", "__", "`", "# ", "1", "-", "—", "$3", "5%", "。", "　", "\u0085", "\xa0", "；", ":", "가", "℃", "+", "\x1c", "\x0b"]
    rows = [(k, "".join(r.choice(signs) for _ in range(r.randrange(0, 12)))) for k in range(3000)]

    def line(x):
        x = F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), T.MARKDOWN_MARKS, "")
        if loc == "en":
            return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), f"(?U){T.CLOSING_HYPHEN}", ""), r"(?U)^\s+|\s+$", "")
        x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, T.COMMAS, " "), T.WIDE_LATIN, "$1 $2"), T.LATIN_WIDE, "$1 $2")
        return F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), rf"(?U){T.CLOSING_MARKS}|^\s+", "")

    loc_is = F.lit(loc)
    want = F.array_join(F.transform(F.filter(F.split("t", "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+", "") != ""), line), "\n")
    got = spark.createDataFrame(rows, "k int, t string").select("k", T.clean(F.col("t"), loc_is).alias("got"), want.alias("want")).collect()
    assert [x.got for x in got] == [x.want for x in got]


def test_most_cleaning_steps_look_before_they_rewrite():
    assert sum(likely is None for _, likely, *_ in T._STEPS) == 2
