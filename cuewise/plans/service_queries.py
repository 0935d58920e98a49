"""What stands around recognition and correction: caches, prompts, slices, names, settings, numerals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import links, text as T
from ..functions.spoken import normalise_alignment
from ..operators import plugins, proofread
from ..schema import WORD_CACHE
from ..sources import captions, derived
from . import oracle as O

KEY, POS = "doc_id", "line_no"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_cache_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words as cached transcriptions, read back for the engine that made them."""
    words = derived.words(derived.cues(spark, sf_dir)).select(KEY, (F.col(POS) * 100_000 + F.col("word_pos")).alias("word_pos"), "word", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"))
    back = F.from_json("doc", WORD_CACHE)
    docs = captions.word_cache(words, KEY, "asr", "en").select(KEY, back.alias("c")).where("c.asr_engine = 'asr'")
    ms = lambda c: F.bround(F.col(f"w.{c}") * 1000).cast("long").alias(f"{c}_ms")
    return docs.select(KEY, F.posexplode("c.words").alias("place", "w")).select(KEY, F.col("place").cast("long").alias("place"), "w.word", ms("start"), ms("end"))


def upload_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as objects to be stored; what is stored differs where a document has a vertical bar, and lacks those of web sources."""
    docs = derived.documents(spark, sf_dir).select(F.col(KEY).cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"), "source")
    stored = docs.where("source <> 'web'").select("path", F.regexp_replace("text", r"\|", "!").cast("binary").alias("content"))
    return plugins.unsent(docs.select("path", F.col("text").cast("binary").alias("content")), stored).select("path", "size", "sha256")


def audio_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretch of sound that goes with each chunk of 30 lines."""
    cues = derived.cues(spark, sf_dir).select(KEY, F.floor(F.col(POS) / 30).cast("long").alias("chunk"), POS, (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"))
    ms = lambda c: F.bround(F.col(c) * 1000).cast("long").alias(f"{c}_ms")
    return proofread.audio_slices(cues, KEY, POS).select(KEY, "chunk", ms("begin"), ms("length"))


def prompt_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's prompt by its language; there is no template for some, and two for one."""
    docs = derived.documents(spark, sf_dir).select(F.col(KEY).cast("string").alias("chunk_key"), F.coalesce("lang", F.lit("")).alias("locale"), F.md5("text").alias("srt"))
    templates = spark.createDataFrame([("en", "Mend:"), ("de", "Verbessere:"), ("de", "Verbessere bitte:")], "locale string, template string")
    return plugins.prompted(docs, templates).select(F.col("chunk_key").cast("long").alias(KEY), "prompt")


def answer_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a service's answers: fenced, bare or without any captions; the cues they hold."""
    d = derived.documents(spark, sf_dir)
    srt = F.concat(F.lit("1\n00:00:01,000 --> 00:00:02,000\n"), F.md5("text"), F.lit("\n\n2\n00:00:03,000 --> 00:00:04,000\nx\n"))
    answer = F.when(F.col(KEY) % 3 == 0, F.concat(F.lit("Here:\n```SRT\n"), srt, F.lit("```\nDone."))).when(F.col(KEY) % 3 == 1, srt).otherwise(F.concat(F.lit("Sorry, "), F.col("text")))
    return captions.answered_cues(d.where("text is not null").select(KEY, answer.alias("answer")), KEY, F.col("answer")).select(KEY, "cue_pos", "text")


def glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that an audit takes from a glossary of all words of each document, in order."""
    words = F.filter(F.split(F.translate("text", "*", " "), " "), lambda x: x != "")
    bold = F.array_join(F.transform(words, lambda w: F.concat(F.lit("**"), w, F.lit("**"))), "\n")
    whole = derived.cues(spark, sf_dir).groupBy(KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(POS, bold.alias("b")))), lambda x: x["b"]), "\n").alias("glossary"))
    terms = T.glossary_terms(F.col("glossary"), longest=None, shortest=2)
    return whole.select(KEY, F.size(terms).cast("long").alias("terms"), F.md5(F.array_join(terms, ",")).alias("digest"))


def detected_locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*[F.lit(x) for x in ("cmn-Hant-TW", "yue-HK", "CMN-hans-cn", "zh-CN", "ja-JP", "ko-KR", "en-US", "fr-FR")])
    return derived.documents(spark, sf_dir).select(KEY, T.detected_locale(F.element_at(codes, (F.col(KEY) % 8 + 1).cast("int"))).alias("locale"))


def output_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    paths = F.array(F.concat(F.lit("/media/"), key, F.lit("/a.mp4")), F.concat(F.lit("/media/"), key, F.lit("/output/a.mp4")), F.concat(key, F.lit(".mp4")))
    chosen = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("/chosen/"), key))
    return _table(spark, sf_dir, "customer").select("c_custkey", links.output_dir(F.element_at(paths, (F.col("c_custkey") % 3 + 1).cast("int")), chosen).alias("folder"))


def header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    forms = F.array(
        F.concat(F.lit("attachment; filename*=UTF-8''%E5%BD%B1%20"), key, F.lit(".mp4; x=1")), F.concat(F.lit('attachment; FileName="a+b '), key, F.lit('.mp4"')),
        F.concat(F.lit("inline; filename="), key, F.lit(".wav; size=3")), F.lit("attachment"),
    )
    return _table(spark, sf_dir, "orders").select("o_orderkey", links.header_filename(F.element_at(forms, (F.col("o_orderkey") % 4 + 1).cast("int")), F.concat(F.lit("download-"), key)).alias("name"))


def mojibake_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in UTF-8 that were read as Latin-1, some of them twice as long, brought back."""
    name = F.concat(F.lit("été-Straße-"), F.col("p_partkey").cast("string"), F.lit(".mp4"))
    broken = F.decode(F.encode(name, "UTF-8"), "ISO-8859-1")
    raw = F.when(F.col("p_partkey") % 3 == 0, broken).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("影"), broken)).otherwise(F.concat(F.lit("plain-"), F.col("p_partkey").cast("string")))
    return _table(spark, sf_dir, "part").select("p_partkey", links.repaired_name(raw).alias("name"))


def first_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of command line, environment, file and default that is set."""
    k = F.col("s_suppkey")
    given = lambda n, what: F.when(k % n == 0, F.concat(F.lit(what), k.cast("string"))).when(k % n == 1, F.lit(" "))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", links.first_set(given(7, "cli-"), given(5, "env-"), given(3, "file-"), F.lit("default")).alias("value"))


def spoken_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers below a thousand in three languages, brought to digits; single Korean digits are not, as they are words as well."""
    n = F.col("o_orderkey") % 1000
    han = lambda digits, powers: F.concat(*[F.when(d > 0, F.concat(F.substring(F.lit(digits), (d + 1).cast("int"), F.lit(1)), F.lit(p))).otherwise(F.lit("")) for d, p in zip((F.floor(n / 100), F.floor(n / 10) % 10, n % 10), powers, strict=True)])
    units, tens = "zero one two three four five six seven eight nine".split(), "twenty thirty forty fifty sixty seventy eighty ninety".split()
    named = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at.cast("int"))
    low = F.floor(n / 10) % 10
    english = F.concat(F.when(n >= 100, F.concat(named(units, F.floor(n / 100) + 1), F.lit(" hundred "))).otherwise(F.lit("")), F.when(low >= 2, F.concat(named(tens, F.greatest(low - 1, F.lit(1))), F.lit("-"), named(units, n % 10 + 1))).otherwise(F.lit("")))
    rows = _table(spark, sf_dir, "orders")
    usable = (low >= 2) & (n % 10 > 0)
    return rows.select("o_orderkey", normalise_alignment(F.when(n == 0, "零").otherwise(han("零一二三四五六七八九", ("百", "十", "")))).alias("chinese"), normalise_alignment(F.when(n >= 10, han("영일이삼사오육칠팔구", ("백", "십", "")))).alias("korean"), normalise_alignment(F.when(usable, english)).alias("english"))


QUERIES = {f.__name__: f for f in (word_cache_roundtrip, upload_skip, audio_slices, prompt_templates, answer_fence, glossary_terms, detected_locales, output_folders, header_names, mojibake_names, first_settings, spoken_numbers)}

ORACLES = {
    "word_cache_roundtrip": O.WORDS + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, word_pos) - 1 AS place, word, start_ms, end_ms FROM words",
    "upload_skip": """SELECT CAST(doc_id AS VARCHAR) AS path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, sha256(coalesce(text, '')) AS sha256
FROM documents WHERE contains(coalesce(text, ''), '|') OR source IS NULL OR source = 'web'""",
    "audio_slices": O.CUES + """SELECT doc_id, line_no // 30 AS chunk, greatest(0, arg_min(start_ms, line_no) - 500) AS begin_ms,
  greatest(1000, arg_max(end_ms, line_no) + 500 - greatest(0, arg_min(start_ms, line_no) - 500)) AS length_ms FROM cues GROUP BY doc_id, line_no // 30""",
    "prompt_templates": "SELECT doc_id, concat_ws(chr(10) || chr(10), CASE lang WHEN 'de' THEN 'Verbessere bitte:' ELSE 'Mend:' END, md5(text)) AS prompt FROM documents",
    "answer_fence": """SELECT doc_id, CAST(p AS INTEGER) AS cue_pos, CASE p WHEN 0 THEN md5(text) ELSE 'x' END AS text FROM documents, (VALUES (0), (1)) v(p)
WHERE text IS NOT NULL AND doc_id % 3 <> 2""",
    "glossary_terms": O.CUES + r""", words AS (
  SELECT doc_id, line_no, ws.w, ws.i FROM (SELECT doc_id, line_no, unnest(list_transform(list_filter(string_split(translate(text, '*', ' '), ' '), lambda x: x <> ''), lambda x, k: {'w': x, 'i': k})) AS ws FROM cues)),
terms AS (
  SELECT doc_id, trim(regexp_extract(trim(w), '^([^（(]*)', 1)) AS term, min({'line': line_no, 'i': i}) AS place FROM words
  WHERE NOT regexp_matches(trim(w), 'Person|Speaker|Names|Organizations|Products|Places|Brands|Domain Jargon|Tech Terms|Core Topic|全片專有名詞|Whisper|講者與人物|公司、品牌|行業專有名詞|核心主題|Glossary|Terminology') GROUP BY ALL),
listed AS (SELECT doc_id, count(*) AS terms, md5(string_agg(term, ',' ORDER BY place)) AS digest FROM terms WHERE length(term) >= 2 GROUP BY doc_id)
SELECT d.doc_id, coalesce(terms, 0) AS terms, coalesce(digest, md5('')) AS digest FROM (SELECT DISTINCT doc_id FROM cues) d LEFT JOIN listed USING (doc_id)""",
    "detected_locales": "SELECT doc_id, ['zh-TW', 'zh-TW', 'zh-CN', 'zh-CN', 'ja', 'ko', 'en', NULL][doc_id % 8 + 1] AS locale FROM documents",
    "output_folders": """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '/chosen/' || c_custkey WHEN c_custkey % 3 = 2 THEN 'output' ELSE '/media/' || c_custkey || '/output' END AS folder FROM customer""",
    "header_names": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '影 ' || o_orderkey || '.mp4' WHEN 1 THEN 'a+b ' || o_orderkey || '.mp4' WHEN 2 THEN o_orderkey || '.wav' ELSE 'download-' || o_orderkey END AS name FROM orders""",
    "mojibake_names": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'été-Straße-' || p_partkey || '.mp4' WHEN 1 THEN '影été-Straße-' || p_partkey || '.mp4' ELSE 'plain-' || p_partkey END AS name FROM part""",
    "first_settings": """SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'cli-' || s_suppkey WHEN s_suppkey % 5 = 0 THEN 'env-' || s_suppkey WHEN s_suppkey % 3 = 0 THEN 'file-' || s_suppkey ELSE 'default' END AS value FROM supplier""",
    "spoken_numbers": """SELECT o_orderkey, CAST(o_orderkey % 1000 AS VARCHAR) AS chinese, CASE WHEN o_orderkey % 1000 >= 10 THEN CAST(o_orderkey % 1000 AS VARCHAR) ELSE '' END AS korean,
  CASE WHEN o_orderkey // 10 % 10 >= 2 AND o_orderkey % 10 > 0 THEN CAST(o_orderkey % 1000 AS VARCHAR) ELSE '' END AS english FROM orders""",
}
