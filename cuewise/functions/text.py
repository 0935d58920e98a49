"""Languages, display width, cleaning and joining of caption text as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce
from operator import and_, or_

from pyspark.sql import Column, SparkSession, functions as F

from ..schema import BRACKETS

# Language tags that mean traditional or simplified Chinese.
TRADITIONAL = ("zh", "zh-tw", "zh-hant", "zh-hk", "zh-mo", "cmn-hant", "cmn-tw")
SIMPLIFIED = ("zh-cn", "zh-hans", "zh-sg", "cmn-hans", "cmn-cn")
# Recogniser codes of language tags; others are en-US.
RECOGNISER = {
    "zh": "cmn-Hant-TW", "zh-tw": "cmn-Hant-TW", "zh-hant": "cmn-Hant-TW", "cmn-hant-tw": "cmn-Hant-TW",
    "zh-cn": "cmn-Hans-CN", "zh-hans": "cmn-Hans-CN", "cmn-hans-cn": "cmn-Hans-CN",
    "ja": "ja-JP", "ja-jp": "ja-JP", "ko": "ko-KR", "ko-kr": "ko-KR", "en": "en-US", "en-us": "en-US", "en-gb": "en-GB",
}
# Ranges of wide scripts, and what more counts as wide where words are joined for display.
HAN, KANA, HANGUL = "一-鿿㐀-䶿", "\u3040-ヿ", "가-\ud7af"
CJK = HAN + KANA + HANGUL
WIDE = CJK + "\uf900-\ufaff"
# Patterns of cleaning, for Spark's expressions and Python's alike: marks of markdown, commas that are not in numbers,
# wide before Latin, Latin before wide, closing marks, a closing hyphen.
MARKDOWN_MARKS = r"\*{1,3}|_{2,}|`{1,3}|^\s*#{1,6}\s+"
COMMAS = r"(?:(?<!\d),|,(?!\d)|，)+"
WIDE_LATIN, LATIN_WIDE = rf"([{CJK}])([A-Za-z0-9]|[$¥€£₩]\d)", rf"([A-Za-z0-9]|\d[%°℃+])([{CJK}])"
CLOSING_MARKS, CLOSING_HYPHEN = r"[\s。，、；:;,.—-]+$", r"(?<!-)-\s*$"
# Fixed value: units that a line break must not cut: words and numbers, wide characters with closing marks, others.
ATOM = rf"[$¥€£₩]?[A-Za-z0-9]+(?:[.,:/\-][A-Za-z0-9]+)*[%°℃+]?\s*|[{CJK}][。，、？！；：」』）》]*|[^\s]"
# Marks that no blank stands before: behind a wide character, ahead of one, behind Latin.
AFTER_WIDE, AHEAD_OF_WIDE, AFTER_LATIN = "[，。！？；：、）」』】》]", "[，。！？；：、（）「」『』【】《》]", r"[,.!?;:)\]}%]"


def tag(language: Column) -> Column:
    return F.lower(F.trim(F.replace(language, F.lit("_"), F.lit("-"))))


def locale(language: Column) -> Column:
    """Caption locale of a language tag: zh-TW, zh-CN, ja, ko or, for all others and none, en."""
    t = tag(language)
    return (
        F.when(t.isin(*TRADITIONAL), "zh-TW").when(t.isin(*SIMPLIFIED), "zh-CN").when(t.startswith("ja"), "ja").when(t.startswith("ko"), "ko").otherwise("en")
    )


def policy(loc: Column) -> Column:
    """Which limits a locale goes by: cjk, ko or latin."""
    return F.when(loc.isin("zh-TW", "zh-CN", "ja"), "cjk").when(loc == "ko", "ko").otherwise("latin")


def by_policy(loc: Column, values: dict[str, float]) -> Column:
    p = policy(loc)
    return F.when(p == "cjk", float(values["cjk"])).when(p == "ko", float(values["ko"])).otherwise(float(values["latin"]))


def recogniser_codes(language: Column, prompt: Column) -> Column:
    """Codes to recognise by; ``auto`` looks at the prompt's script, and non-English ones are paired with en-US."""
    t = F.coalesce(tag(language), F.lit("auto"))
    known = F.create_map(*[F.lit(x) for pair in RECOGNISER.items() for x in pair])
    code = F.coalesce(F.element_at(known, t), F.lit("en-US"))
    named = F.when(F.lower(code).startswith("en-"), F.array(code)).otherwise(F.array(code, F.lit("en-US")))
    p = F.coalesce(prompt, F.lit(""))
    pair = lambda c: F.array(F.lit(c), F.lit("en-US"))
    seen = (
        F.when(p.rlike(f"[{KANA}]"), pair("ja-JP")).when(p.rlike(f"[{HANGUL}]"), pair("ko-KR"))
        .when(p.contains("简体中文") | p.contains("专有名词"), pair("cmn-Hans-CN")).when(p.rlike(r"[\x{4E00}-\x{9FFF}]"), pair("cmn-Hant-TW"))
        .otherwise(F.array(F.lit("auto")))
    )
    return F.when(t.isin("auto", "none", ""), seen).otherwise(named)


def detected_locale(code: Column) -> Column:
    """Caption locale of a recogniser's detected language."""
    c = F.lower(code)
    starts = lambda *heads: c.rlike("^(" + "|".join(heads) + ")")
    return F.when(starts("cmn-hans", "zh-cn"), "zh-CN").when(starts("cmn", "zh", "yue"), "zh-TW").when(starts("ja"), "ja").when(starts("ko"), "ko").when(starts("en"), "en")


def display_width(text: Column, loc: Column) -> Column:
    """Width on screen: wide characters count 1 and ASCII half (spaces not, but for Korean); Latin locales count characters."""
    p = policy(loc)
    bare = F.when(p == "cjk", F.replace(text, F.lit(" "), F.lit(""))).otherwise(text)
    wide = F.length(F.regexp_replace(bare, r"[\x00-\x7F]", ""))
    return F.when(p == "latin", F.length(text).cast("double")).otherwise(wide + (F.length(bare) - wide) * 0.5)


def _holds(*signs: str) -> Callable[[Column], Column]:
    return lambda x: reduce(or_, [x.contains(sign) for sign in signs])


def _edges(first: str, last: str) -> Callable[[Column], Column]:
    """Whether the first or the last character is of a class."""
    return lambda x: F.left(x, F.lit(1)).rlike(f"(?U)[{first}]") | F.right(x, F.lit(1)).rlike(f"(?U)[{last}]")


# Steps of cleaning a line: where each applies, what must be there for it to find anything, which is looked for first as it costs far less, and the rewrite.
_TRIM = (_edges(r"\s", r"\s"), r"(?U)^\s+|\s+$", "")
_BLANKS = (_holds("  ", "\t"), r"[ \t]+", " ")
_ANY, _ONLY_WIDE, _ONLY_LATIN = None, True, False
_STEPS = (
    (_ANY, *_TRIM), (_ANY, _holds("*", "_", "`", "#"), MARKDOWN_MARKS, ""),
    (_ONLY_WIDE, _holds(",", "，"), COMMAS, " "), (_ONLY_WIDE, None, WIDE_LATIN, "$1 $2"), (_ONLY_WIDE, None, LATIN_WIDE, "$1 $2"),
    (_ANY, *_BLANKS), (_ONLY_WIDE, _edges(r"\s", r"\s。，、；:;,.—-"), rf"(?U){CLOSING_MARKS}|^\s+", ""),
    (_ONLY_LATIN, _edges("-", r"\s-"), f"(?U){CLOSING_HYPHEN}", ""), (_ONLY_LATIN, *_TRIM),
)


def _step(when: Column | None, likely: Callable[[Column], Column] | None, pattern: str, new: str) -> Callable[[Column], Column]:
    def rewritten(x: Column) -> Column:
        told = [c for c in (when, likely and likely(x)) if c is not None]
        out = F.regexp_replace(x, pattern, new)
        return F.when(reduce(and_, told), out).otherwise(x) if told else out

    return rewritten


def clean(text: Column, loc: Column) -> Column:
    """Caption text by its locale's typography: markdown marks go, blanks collapse; wide scripts
    lose inline commas and closing punctuation and set Latin and numbers apart."""
    wide = policy(loc) != "latin"
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"(?U)\S"))
    # Each step has its own lambda, as a column that is named twice would be computed twice there.
    for where, likely, pattern, new in _STEPS:
        lines = F.transform(lines, _step({_ANY: None, _ONLY_WIDE: wide, _ONLY_LATIN: ~wide}[where], likely, pattern, new))
    return F.array_join(lines, "\n")


def atoms(text: Column) -> Column:
    """Units that a line break must not cut."""
    return F.regexp_extract_all(text, F.lit(ATOM), F.lit(0))


# Fixed value: what stands between words while they are joined, and where it goes.
_BETWEEN = "\x1f"
_CLOSE = f"(?<=[{WIDE}]){_BETWEEN}(?=[{WIDE}]|{AFTER_WIDE})|(?<={AHEAD_OF_WIDE}){_BETWEEN}(?=[{WIDE}])|(?<![{WIDE}]){_BETWEEN}(?={AFTER_LATIN})"


def join_words(words: Column) -> Column:
    """Words in a row as text: no space between wide characters or before closing punctuation.

    Whether a space goes is told by the characters on both sides of it, so the words are joined once and the spaces looked at
    where they are; only words that hold the sign between them themselves are joined one by one.
    """

    def glue(line: Column, word: Column) -> Column:
        last, first = F.right(line, F.lit(1)), F.left(word, F.lit(1))
        wide_last, wide_first = last.rlike(f"[{WIDE}]"), first.rlike(f"[{WIDE}]")
        close = (
            (wide_last & wide_first) | (wide_last & first.rlike(AFTER_WIDE)) | (last.rlike(AHEAD_OF_WIDE) & wide_first)
            | (~wide_last & first.rlike(AFTER_LATIN))
        )
        return F.when(line == "", word).when(close, F.concat(line, word)).otherwise(F.concat(line, F.lit(" "), word))

    one_by_one = F.aggregate(F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != ""), F.lit(""), glue)
    # Words are trimmed and empty ones left out: blanks beside the sign go, of several signs one stays, none at the ends.
    joined = F.regexp_replace(F.trim(F.array_join(words, _BETWEEN), F.lit(f" {_BETWEEN}")), f"(?<! ) *+{_BETWEEN}[ {_BETWEEN}]*+", _BETWEEN)
    return F.when(words.isNull() | F.array_join(words, "").contains(_BETWEEN), one_by_one).otherwise(F.translate(F.regexp_replace(joined, _CLOSE, ""), _BETWEEN, " "))


def unbalanced(text: Column) -> Column:
    """Bracket pairs of which one side occurs more often than the other.

    Most texts hold no bracket at all, which costs far less to see than to count: it is looked for first, the wide ones only where
    a character takes more than one byte.
    """
    times = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    narrow, wide = (_holds(*(c for pair in BRACKETS for c in pair if c.isascii() is told))(text) for told in (True, False))
    odd = F.filter(F.array(*[F.when(times(a) != times(b), a + b) for a, b in BRACKETS]), lambda x: x.isNotNull())
    return F.when(narrow | ((F.octet_length(text) > F.length(text)) & wide), odd).otherwise(F.array().cast("array<string>"))


def questions(text: Column) -> Column:
    """Text cut behind question marks."""
    return F.split(text, r"(?<=[？?])\s+")


def fenced(answer: Column) -> Column:
    """The captions in an answer: what its code fence holds, or all of it; null where there is no time line."""
    inside = F.regexp_extract(answer, r"(?is)```(?:srt)?\s*\n(.*?)```", 1)
    body = F.regexp_replace(F.when(inside != "", inside).otherwise(answer), r"^\s+|\s+\z", "")
    return F.when(body.contains("-->"), body)


# Headings of a glossary that are no terms.
CATEGORIES = (
    "Person", "Speaker", "Names", "Organizations", "Products", "Places", "Brands", "Domain Jargon", "Tech Terms", "Core Topic",
    "全片專有名詞", "Whisper", "講者與人物", "公司、品牌", "行業專有名詞", "核心主題", "Glossary", "Terminology",
)
# Prefix, separator and suffix of a bias prompt.
PROMPT = {
    "zh-TW": ("以下為繁體中文對談字幕，專有名詞：", "、", "。"),
    "zh-CN": ("以下为简体中文对谈字幕，专有名词：", "、", "。"),
    "ja": ("以下は日本語の対談字幕です。専門用語：", "、", "。"),
    "ko": ("다음은 한국어 대화 자막입니다. 전문 용어: ", ", ", "."),
    "en": ("The following is a video transcription containing terms: ", ", ", "."),
}


def glossary_terms(markdown: Column, longest: int | None = 24, shortest: int = 1) -> Column:
    """Bold terms of a glossary in order, once each, without headings and explanations in brackets.

    A prompt takes terms of up to 24 characters, an audit (``longest=None, shortest=2``) those of two or more.
    """
    bold = F.filter(F.transform(F.regexp_extract_all(markdown, F.lit(r"\*\*(.+?)\*\*"), F.lit(1)), lambda x: F.trim(x)), lambda x: ~x.rlike("|".join(CATEGORIES)))
    short = F.transform(bold, lambda x: F.trim(F.regexp_extract(x, r"^([^（(]*)", 1)))
    return F.array_distinct(F.filter(short, lambda x: (F.length(x) >= shortest) & (F.lit(True) if longest is None else F.length(x) <= longest)))


def _adder(prefix: str, sep: str, room: int):
    """A step that adds a term as long as the text stays within ``room``; after the first that does not fit, none."""

    def add(s: Column, term: Column) -> Column:
        longer = F.concat(s["text"], F.when(s["text"] == prefix, "").otherwise(sep), term)
        full = s["full"] | (F.length(longer) > room)
        return F.struct(F.when(full, s["text"]).otherwise(longer).alias("text"), full.alias("full"))

    return add


def bias_prompt(markdown: Column, loc: Column, budget: int = 145) -> Column:
    """A recogniser's bias prompt: the glossary's own line, or its terms as far as the budget goes."""
    line = F.trim(F.regexp_extract(markdown, r"(?i)\*\*Whisper\s+(?:Initial\s+)?Prompt\*\*:\s*(.+)", 1))
    line = F.trim(F.regexp_replace(line, r"""^[`'"]+|[`'"]+$""", ""))
    cut = F.left(line, F.lit(budget))
    upto = F.length(F.regexp_extract(cut, r"(?s)^(.*)[、，,]", 1))
    own = F.when(F.length(line) <= budget, line).when(upto > 20, F.concat(F.left(line, upto), F.lit("。"))).otherwise(F.concat(cut, F.lit("...")))
    out = None
    for name, (prefix, sep, suffix) in PROMPT.items():
        room = budget - len(suffix)
        state = F.struct(F.lit(prefix).alias("text"), F.lit(False).alias("full"))

        made = F.concat(F.aggregate(glossary_terms(markdown), state, _adder(prefix, sep, room), lambda s: s["text"]), F.lit(suffix))
        out = F.when(loc == name, made) if out is None else out.when(loc == name, made)
    return F.when(line != "", own).when(F.size(glossary_terms(markdown)) > 0, out)


def in_script(text: Column, table: dict[str, str]) -> Column:
    """Text with single characters replaced, as from simplified to traditional script."""
    return F.translate(text, "".join(table), "".join(table.values()))


@cache
def script_table(spark: SparkSession, rule: str = "Simplified-Traditional") -> dict[str, str]:
    """Single characters that ``rule``, a transliterator of the ICU library that Spark brings, replaces by one other."""
    han = [chr(c) for c in (*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000))]
    made = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance(rule).transliterate("\n".join(han)).split("\n")
    return {a: b for a, b in zip(han, made, strict=True) if a != b and len(b) == 1}
