"""Scalar functions, readers and writers, applied to driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import links, text as T, timecode
from ..sources import captions, derived
from . import oracle as O

KEY, POS = "doc_id", "line_no"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fmt_srt_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time codes of cue starts; whole milliseconds, so no rounding decides."""
    return derived.cues(spark, sf_dir).select(KEY, POS, timecode.srt_timestamp(F.col("start_ms") / 1000).alias("code"))


def parse_srt_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = derived.cues(spark, sf_dir).select(KEY, POS, timecode.srt_timestamp(F.col("end_ms") / 1000).alias("code"))
    return codes.select(KEY, POS, F.bround(timecode.parse_timestamp(F.col("code")) * 1000).cast("long").alias("end_ms"))


def parse_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets such as 12.5s made of event values; every seventh cannot be read."""
    e = _table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 7 == 0, "soon").otherwise(F.concat(F.floor(F.col("value") * 10).cast("string"), F.lit(".25s")))
    return e.select("event_id", timecode.offset_seconds(raw).alias("seconds"))


def display_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of cues under three locales."""
    c = derived.cues(spark, sf_dir)
    return c.select(KEY, POS, *[T.display_width(F.col("text"), F.lit(loc)).alias(name) for loc, name in (("zh-TW", "cjk"), ("ko", "korean"), ("en", "latin"))])


def lang_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    tags = F.array(F.col("lang"), *[F.lit(x) for x in ("zh", "zh_HK", "ZH-Hans", "cmn-CN", "ja-JP", "KO_kr", "en-GB", "")])
    raw = F.element_at(tags, (F.col(KEY) % 9 + 1).cast("int"))
    return d.select(KEY, raw.alias("tag"), T.locale(raw).alias("locale"))


def stt_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    tags = F.array(F.col("lang"), *[F.lit(x) for x in ("zh", "zh-CN", "ja", "ko_KR", "en-GB", "auto")])
    raw = F.element_at(tags, (F.col(KEY) % 7 + 1).cast("int"))
    return d.select(KEY, F.array_join(T.recogniser_codes(raw, F.lit(None).cast("string")), "+").alias("codes"))


def clean_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.cues(spark, sf_dir).select(KEY, POS, T.clean(F.col("text"), F.lit("en")).alias("cleaned"))


def clean_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns, line by line: how many lines stay and how long they are."""
    t = _table(spark, sf_dir, "conversations").withColumn("cleaned", T.clean(F.col("text"), F.lit("en")))
    return t.select("conv_id", "turn", F.size(F.filter(F.split("cleaned", "\n"), lambda x: x != "")).cast("long").alias("kept_lines"))


def gdrive_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    forms = F.array(
        F.concat(F.lit("https://drive.google.com/file/d/"), key, F.lit("/view")), F.concat(F.lit("https://drive.google.com/drive/folders/"), key, F.lit("?usp=sharing")),
        F.concat(F.lit("https://drive.google.com/open?id="), key), F.concat(F.lit("gdrive://folder/"), key), F.concat(F.lit("gdrive:"), key), F.concat(F.lit("https://example.com/"), key),
    )
    uri = F.element_at(forms, (F.col("o_orderkey") % 6 + 1).cast("int"))
    found = links.drive_id(uri)
    return _table(spark, sf_dir, "orders").select("o_orderkey", links.is_drive(uri).alias("is_drive"), found["id"].alias("drive_id"), found["type"].alias("kind"))


def gcs_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("s3://media/"), F.col("c_name"))).otherwise(F.concat(F.lit("gs://media-"), F.col("c_nationkey").cast("string"), F.lit("/raw/"), F.col("c_name"), F.lit(".wav")))
    found = links.object_uri(uri)
    return _table(spark, sf_dir, "customer").select("c_custkey", found["bucket"].alias("bucket"), found["blob"].alias("blob"))


_EXTENSIONS = (".mp4", ".MKV", ".wav", ".mp3", ".m4a", ".txt", "")


def mime_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    extension = F.element_at(F.array(*[F.lit(x) for x in _EXTENSIONS]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", links.media_type(F.concat(F.lit("/media/"), F.translate("p_name", " .", "__"), extension)).alias("media_type"))


def env_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, key = F.replace("s_name", F.lit("#"), F.lit("_")), F.col("s_suppkey")
    line = (
        F.when(key % 5 == 0, F.concat(F.lit("# "), name)).when(key % 5 == 1, F.concat(F.lit("export KEY_"), key.cast("string"), F.lit('="'), name, F.lit('"')))
        .when(key % 5 == 2, F.concat(F.lit("  KEY = "), name, F.lit(" # note"))).when(key % 5 == 3, F.lit("")).otherwise(F.concat(F.lit("A="), name, F.lit("=b")))
    )
    found = links.setting(line)
    return _table(spark, sf_dir, "supplier").select("s_suppkey", found["key"].alias("key"), found["value"].alias("value")).where("key is not null")


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(KEY, F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


def _srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = derived.cues(spark, sf_dir).select(KEY, F.col(POS).alias("cue_pos"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text")
    return captions.render_srt(cues, KEY)


def srt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _srt(spark, sf_dir)


def srt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions written as text and read again."""
    ms = lambda c: F.bround(F.col(c) * 1000).cast("long").alias(f"{c}_ms")
    return captions.parse_srt(_srt(spark, sf_dir), KEY, F.col("srt")).select(KEY, F.col("cue_pos").cast("long").alias("cue_pos"), F.col("idx").cast("long").alias("idx"), ms("start"), ms("end"), "text")


def vtt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _srt(spark, sf_dir).select(KEY, captions.to_vtt(F.col("srt")).alias("vtt"))


def words_json_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recogniser output with all words as offsets, moved by 100 s and read back."""
    lines = derived.line_words(derived.cues(spark, sf_dir))
    offset = lambda c: F.concat((c / 1000).cast("string"), F.lit("s"))
    item = lambda w: F.struct(w["word"].alias("word"), offset(w["start_ms"]).alias("startOffset"), offset(w["end_ms"]).alias("endOffset"))
    ordered = F.transform(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(POS, "words"))), lambda x: x["words"])), item)
    doc = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.lit("").alias("transcript"), ordered.alias("words"))).alias("alternatives"))).alias("results")))
    docs = lines.groupBy(KEY).agg(doc.alias("doc"))
    ms = lambda c: F.bround(F.col(c) * 1000).cast("long").alias(f"{c}_ms")
    return captions.recognised_words(docs, KEY, F.col("doc"), F.lit(100.0)).select(KEY, F.col("word_pos").cast("long").alias("word_pos"), "word", ms("start"), ms("end"))


def atomic_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.cues(spark, sf_dir).select(KEY, POS, F.size(T.atoms(F.col("text"))).cast("long").alias("atoms"))


def join_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a cue, its last full stop as a token of its own, joined for display."""
    c = derived.cues(spark, sf_dir)
    tokens = F.concat(F.split(F.regexp_replace("text", r"[.]$", ""), " "), F.when(F.col("text").endswith("."), F.array(F.lit("."))).otherwise(F.array().cast("array<string>")))
    return c.select(KEY, POS, T.join_words(tokens).alias("joined"))


def prompt_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bias prompt from a glossary of all words of each document."""
    words = F.filter(F.split(F.translate("text", "(*", "  "), " "), lambda x: x != "")
    whole = derived.cues(spark, sf_dir).groupBy(KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(POS, words.alias("ws")))), lambda x: F.array_join(F.transform(x["ws"], lambda w: F.concat(F.lit("- **"), w, F.lit("**"))), "\n")), "\n").alias("glossary"))
    return whole.where("glossary like '%**%'").select(KEY, T.bias_prompt(F.col("glossary"), F.lit("en")).alias("prompt"))


#: Letters that stand for wide characters in the queries below.
LETTERS, HAN, SIMPLIFIED = "abcdefghijklmnop", "字幕時間軸對齊我們的了中文測試行", "国语时间轴对齐们发书长门马鱼鸟云"


def _wide(spark: SparkSession, sf_dir: str, signs: str = HAN) -> DataFrame:
    """Cues in which most letters are wide characters, some closing marks full-width."""
    return derived.cues(spark, sf_dir).withColumn("text", F.translate("text", LETTERS + ";!", signs + "，。"))


def wide_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir).select(KEY, POS, *[T.display_width(F.col("text"), F.lit(loc)).alias(name) for loc, name in (("ja", "cjk"), ("ko", "korean"), ("en", "latin"))])


def wide_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir).select(KEY, POS, T.clean(F.col("text"), F.lit("zh-TW")).alias("cleaned"))


def wide_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.atoms(F.col("text"))
    return _wide(spark, sf_dir).select(KEY, POS, F.size(found).cast("long").alias("atoms"), F.array_join(F.slice(found, 1, 5), "|").alias("first"))


def wide_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir).select(KEY, POS, T.join_words(F.split("text", " ")).alias("joined"))


def script_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simplified characters brought to traditional ones."""
    return _wide(spark, sf_dir, SIMPLIFIED).select(KEY, POS, T.in_script(F.col("text"), T.script_table(spark)).alias("text"))


QUERIES = {f.__name__: f for f in (fmt_srt_ts, parse_srt_ts, parse_offsets, display_width, lang_normalize, stt_codes, clean_latin, clean_turns, gdrive_parse, gcs_uri, mime_type, env_parse, content_hash, srt_render, srt_roundtrip, vtt_render, words_json_explode, atomic_units, join_display, prompt_terms, wide_width, wide_clean, wide_atoms, wide_join, script_map)}

_CODE = lambda c: f"printf('%02d:%02d:%02d,%03d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000)"
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\*{1,3}|_{2,}|`{1,3}|^\s*#{1,6}\s+', '', 'g'), '[ \t]+', ' ', 'g'), '(^|[^-])-\s*$', '\1'), '^\s+|\s+$', '', 'g')"
_BLOCKS = O.CUES + f", blocks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM cues), srts AS (SELECT doc_id, string_agg(n || chr(10) || {_CODE('start_ms')} || ' --> ' || {_CODE('end_ms')} || chr(10) || text || chr(10), chr(10) ORDER BY n) AS srt FROM blocks GROUP BY doc_id)"
ORACLES = {
    "fmt_srt_ts": O.CUES + f"SELECT doc_id, line_no, {_CODE('start_ms')} AS code FROM cues",
    "parse_srt_ts": O.CUES + "SELECT doc_id, line_no, end_ms FROM cues",
    "parse_offsets": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0.0::DOUBLE ELSE floor(value * 10) + 0.25::DOUBLE END AS seconds FROM events",
    "display_width": O.CUES + r""", sized AS (SELECT *, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS wide, length(replace(text, ' ', '')) AS dense FROM cues)
SELECT doc_id, line_no, wide + (dense - wide) * 0.5::DOUBLE AS cjk, wide + (length(text) - wide) * 0.5::DOUBLE AS korean, CAST(length(text) AS DOUBLE) AS latin FROM sized""",
    "lang_normalize": """WITH tagged AS (SELECT doc_id, [lang, 'zh', 'zh_HK', 'ZH-Hans', 'cmn-CN', 'ja-JP', 'KO_kr', 'en-GB', ''][doc_id % 9 + 1] AS tag FROM documents)
SELECT doc_id, tag, CASE WHEN tag IN ('zh', 'zh_HK') THEN 'zh-TW' WHEN tag IN ('ZH-Hans', 'cmn-CN') THEN 'zh-CN' WHEN tag = 'ja-JP' THEN 'ja' WHEN tag = 'KO_kr' THEN 'ko' ELSE 'en' END AS locale FROM tagged""",
    "stt_codes": """SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'cmn-Hant-TW+en-US' WHEN 2 THEN 'cmn-Hans-CN+en-US' WHEN 3 THEN 'ja-JP+en-US' WHEN 4 THEN 'ko-KR+en-US'
  WHEN 5 THEN 'en-GB' WHEN 6 THEN 'auto' ELSE 'en-US' END AS codes FROM documents""",
    "clean_latin": O.CUES + f"SELECT doc_id, line_no, {_CLEAN} AS cleaned FROM cues",
    "clean_turns": "WITH ls AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS text FROM conversations) SELECT conv_id, turn, count(*) FILTER (WHERE " + _CLEAN + " <> '') AS kept_lines FROM ls GROUP BY conv_id, turn",
    "gdrive_parse": """WITH k AS (SELECT o_orderkey, o_orderkey % 6 AS form, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS key FROM orders)
SELECT o_orderkey, form <> 5 AS is_drive, CASE WHEN form < 5 THEN key END AS drive_id, CASE form WHEN 0 THEN 'file' WHEN 1 THEN 'folder' WHEN 2 THEN 'unknown' WHEN 3 THEN 'folder' WHEN 4 THEN 'unknown' END AS kind FROM k""",
    "gcs_uri": "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 'media-' || c_nationkey END AS bucket, CASE WHEN c_custkey % 5 <> 0 THEN regexp_extract('raw/' || c_name || '.wav', '^([^?#]*)', 1) END AS blob FROM customer",
    "mime_type": "SELECT p_partkey, CASE p_partkey % 7 WHEN 1 THEN 'video/x-matroska' WHEN 2 THEN 'audio/wav' WHEN 3 THEN 'audio/mpeg' WHEN 4 THEN 'audio/mp4' ELSE 'video/mp4' END AS media_type FROM part",
    "env_parse": """WITH n AS (SELECT s_suppkey, replace(s_name, '#', '_') AS name FROM supplier)
SELECT s_suppkey, CASE s_suppkey % 5 WHEN 1 THEN 'KEY_' || s_suppkey WHEN 2 THEN 'KEY' ELSE 'A' END AS key, CASE s_suppkey % 5 WHEN 4 THEN name || '=b' ELSE name END AS value FROM n WHERE s_suppkey % 5 IN (1, 2, 4)""",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents",
    "srt_render": _BLOCKS + " SELECT doc_id, srt FROM srts",
    "srt_roundtrip": O.CUES + ", n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS idx FROM cues) SELECT doc_id, idx - 1 AS cue_pos, idx, start_ms, end_ms, text FROM n",
    "vtt_render": _BLOCKS + " SELECT doc_id, 'WEBVTT' || chr(10) || chr(10) || array_to_string(list_transform(string_split(srt, chr(10)), lambda x: CASE WHEN contains(x, '-->') THEN replace(x, ',', '.') ELSE x END), chr(10)) AS vtt FROM srts",
    "words_json_explode": O.WORDS + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, word_pos) - 1 AS word_pos, word, start_ms + 100000 AS start_ms, greatest(start_ms + 20, end_ms) + 100000 AS end_ms FROM words",
    "atomic_units": O.CUES + r"SELECT doc_id, line_no, CAST(len(regexp_extract_all(text, '[$¥€£₩]?[A-Za-z0-9]+(?:[.,:/\-][A-Za-z0-9]+)*[%°℃+]?\s*|[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}][。，、？！；：」』）》]*|[^\s]')) AS BIGINT) AS atoms FROM cues",
    "join_display": O.CUES + r""", t AS (SELECT doc_id, line_no, text, list_filter(string_split(regexp_replace(text, '[.]$', ''), ' '), lambda x: x <> '') AS ws FROM cues),
u AS (SELECT doc_id, line_no, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM t)
SELECT t.doc_id, t.line_no, coalesce(string_agg(CASE WHEN i > 1 AND NOT regexp_matches(w, '^[,.!?;:)\]}%]') THEN ' ' || w ELSE w END, '' ORDER BY i), '') || CASE WHEN text LIKE '%.' THEN '.' ELSE '' END AS joined
FROM t LEFT JOIN u ON t.doc_id = u.doc_id AND t.line_no = u.line_no GROUP BY t.doc_id, t.line_no, text""",
    # The first of each term counts; terms are added until one does not fit.
    "prompt_terms": O.CUES + r""", words AS (
  SELECT doc_id, line_no, ws.w, ws.i FROM (SELECT doc_id, line_no, unnest(list_transform(list_filter(string_split(translate(text, '(*', '  '), ' '), lambda x: x <> ''), lambda x, k: {'w': x, 'i': k})) AS ws FROM cues)),
terms AS (
  SELECT doc_id, trim(regexp_extract(trim(w), '^([^（(]*)', 1)) AS term, min({'line': line_no, 'i': i}) AS place FROM words
  WHERE NOT regexp_matches(trim(w), 'Person|Speaker|Names|Organizations|Products|Places|Brands|Domain Jargon|Tech Terms|Core Topic|全片專有名詞|Whisper|講者與人物|公司、品牌|行業專有名詞|核心主題|Glossary|Terminology') GROUP BY ALL),
fitting AS (
  SELECT *, sum(length(term) + 2) OVER (PARTITION BY doc_id ORDER BY place) - 2 + length('The following is a video transcription containing terms: ') AS upto FROM terms WHERE term <> '' AND length(term) <= 24),
made AS (SELECT doc_id, string_agg(term, ', ' ORDER BY place) FILTER (WHERE upto <= 144) AS listed FROM fitting GROUP BY doc_id)
SELECT d.doc_id, 'The following is a video transcription containing terms: ' || coalesce(listed, '') || '.' AS prompt FROM (SELECT DISTINCT doc_id FROM words) d JOIN made ON made.doc_id = d.doc_id""",
}
_WIDE = O.CUES + f", wide AS (SELECT doc_id, line_no, translate(text, '{LETTERS};!', '{HAN}，。') AS text FROM cues)"
_SIGN = "[一-鿿㐀-䶿぀-ヿ가-힯豈-﫿]"
ORACLES |= {
    "wide_width": _WIDE + r""", sized AS (SELECT *, len(list_filter(string_split(text, ''), lambda c: unicode(c) > 127)) AS wide, length(replace(text, ' ', '')) AS dense FROM wide)
SELECT doc_id, line_no, wide + (dense - wide) * 0.5::DOUBLE AS cjk, wide + (length(text) - wide) * 0.5::DOUBLE AS korean, CAST(length(text) AS DOUBLE) AS latin FROM sized""",
    # Commas between digits are set aside, twice as matches may share a digit.
    "wide_clean": _WIDE + r""", a AS (SELECT doc_id, line_no, regexp_replace(trim(text), '\*{1,3}|_{2,}|`{1,3}|^\s*#{1,6}\s+', '', 'g') AS t FROM wide),
b AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(t, '(\d),(\d)', '\1' || chr(1) || '\2', 'g'), '(\d),(\d)', '\1' || chr(1) || '\2', 'g') AS t FROM a),
c AS (SELECT doc_id, line_no, replace(regexp_replace(t, '[,，]+', ' ', 'g'), chr(1), ',') AS t FROM b),
d AS (SELECT doc_id, line_no, regexp_replace(t, '([一-鿿㐀-䶿぀-ヿ가-힯])([A-Za-z0-9]|[$¥€£₩]\d)', '\1 \2', 'g') AS t FROM c),
e AS (SELECT doc_id, line_no, regexp_replace(t, '([A-Za-z0-9]|\d[%°℃+])([一-鿿㐀-䶿぀-ヿ가-힯])', '\1 \2', 'g') AS t FROM d)
SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '[\s。，、；:;,.—-]+$', '')) AS cleaned FROM e""",
    "wide_atoms": _WIDE + r""", found AS (SELECT doc_id, line_no, regexp_extract_all(text, '[$¥€£₩]?[A-Za-z0-9]+(?:[.,:/\-][A-Za-z0-9]+)*[%°℃+]?\s*|[一-鿿㐀-䶿぀-ヿ가-힯][。，、？！；：」』）》]*|[^\s]') AS xs FROM wide)
SELECT doc_id, line_no, CAST(len(xs) AS BIGINT) AS atoms, array_to_string(xs[1:5], '|') AS first FROM found""",
    "wide_join": _WIDE + f""", t AS (SELECT doc_id, line_no, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM wide),
u AS (SELECT doc_id, line_no, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM t),
p AS (SELECT *, right(lag(w) OVER (PARTITION BY doc_id, line_no ORDER BY i), 1) AS z, left(w, 1) AS a FROM u),
q AS (SELECT *, regexp_matches(z, '{_SIGN}') AS zw, regexp_matches(a, '{_SIGN}') AS aw FROM p)
SELECT t.doc_id, t.line_no, coalesce(string_agg(CASE WHEN z IS NULL OR (zw AND aw) OR (zw AND regexp_matches(a, '[，。！？；：、）」』】》]')) OR (aw AND regexp_matches(z, '[，。！？；：、（）「」『』【】《》]'))
  OR (NOT zw AND regexp_matches(a, '[,.!?;:)\\]}}%]')) THEN w ELSE ' ' || w END, '' ORDER BY i), '') AS joined
FROM t LEFT JOIN q ON q.doc_id = t.doc_id AND q.line_no = t.line_no GROUP BY t.doc_id, t.line_no""",
    "script_map": O.CUES + f"SELECT doc_id, line_no, translate(text, '{LETTERS};!', '國語時間軸對齊們發書長門馬魚鳥雲，。') AS text FROM cues",
}
