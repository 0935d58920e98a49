"""The subpackage's registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import codes, fim, language, lines, mixing, neighbours, ngram_join, packing, quality, simhash, suffix_dedup, topk, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def _sql_plain(text: str) -> str:
    """DuckDB's form of ``warc.plain``; the tables hold no numeric references."""
    for name, char in warc.NAMED.items():
        text = f"replace({text}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    text = f"replace({text}, '&amp;', '&')"
    text = rf"regexp_replace({text}, '[ \t\r\f\x{{B}}\x{{A0}}]+', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({text}, ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+\z', '', 'g')"


def _sql_id(kind: str, *parts: str) -> str:
    h = f"md5(concat_ws(chr(10), '{kind}', {', '.join(parts)}))"
    return f"'urn:uuid:' || concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), substr({h}, 17, 4), substr({h}, 21, 12))"


# Patterns of the oracle's own: comments go first, then each hidden element, then tags.
_SHOWN = r"regexp_replace(payload, '(?s)<!--.*?-->', '', 'g')"
for _hidden in ("script", "style", "noscript", "template", "svg"):
    _SHOWN = rf"regexp_replace({_SHOWN}, '(?is)<{_hidden}(\s[^<>]*)?>.*?</{_hidden}\s*>', '', 'g')"
_BLOCKS = "p div br li ul ol dl dt dd h1 h2 h3 h4 h5 h6 tr td th table section article aside main header footer nav title head body html blockquote pre hr form figure figcaption".replace(" ", "|")
_TEXT = _sql_plain(rf"regexp_replace(regexp_replace({_SHOWN}, '(?i)</?({_BLOCKS})(\s[^<>]*|/)?>', chr(10), 'g'), '<[/!?A-Za-z][^<>]*>', '', 'g')")
_TITLE = _sql_plain("CASE WHEN contains(lower(payload), '<title') THEN regexp_extract(payload, '(?is)<title[^<>]*>(.*?)</title', 1) ELSE '' END")
_HEAD_LANG = """regexp_extract(regexp_extract(payload, '(?i)<html[^<>]*>'), '(?i)\\blang=["'']?([A-Za-z0-9-]+)', 1)"""
_LINKS = """list_transform(list_filter(regexp_extract_all(payload, '(?i)<a\\s[^<>]*>'), lambda x: regexp_matches(x, '(?i)\\bhref\\s*=')), lambda x: regexp_extract(x, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s<>]+)', 1))"""
OP2_SQL = f"""
WITH source AS (
  SELECT page_id, url AS target_uri, coalesce(html, '') AS payload FROM pages),
response AS (
  SELECT *, {_sql_id("response", "coalesce(CAST(page_id AS VARCHAR), '?' || sha256(payload))", "coalesce(target_uri, '')")} AS refers_to,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
      || 'Content-Length: ' || octet_length(encode(payload)) || chr(13) || chr(10) || chr(13) || chr(10) AS http
  FROM source),
parts AS (
  SELECT *, {_sql_id("conversion", "refers_to")} AS conversion_id, {_sql_id("metadata", "refers_to")} AS metadata_id, {_TEXT} AS text,
    {_TITLE} AS title, {_HEAD_LANG} AS language,
    {_LINKS} AS links
  FROM response),
bodies AS (
  SELECT *, 'metadata' AS warc_type, metadata_id AS record_id, conversion_id AS concurrent_to, 'application/warc-fields' AS content_type,
    CASE WHEN title <> '' THEN 'title: ' || replace(title, chr(10), ' ') || chr(13) || chr(10) ELSE '' END
      || CASE WHEN language <> '' THEN 'language: ' || language || chr(13) || chr(10) ELSE '' END
      || coalesce(array_to_string(list_transform(links, lambda x: 'outlink: ' || x || chr(13) || chr(10)), ''), '') AS body FROM parts
  UNION ALL
  SELECT *, 'conversion', conversion_id, NULL, 'text/plain; charset=utf-8', text FROM parts)
SELECT page_id, warc_type, record_id, refers_to, concurrent_to, target_uri, '2024-01-01T00:00:00Z' AS date, content_type,
  CAST(octet_length(encode(body)) AS BIGINT) AS content_length, 'sha256:' || sha256(body) AS block_digest, body, http AS source_http_headers,
  'sha256:' || sha256(http || payload) AS source_block_digest, 'sha256:' || sha256(payload) AS source_payload_digest
FROM bodies
"""


def op3_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || md5(coalesce(text, ''))) AS ord,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
turns AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE turn % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM turns),
leveled AS (
  SELECT *, cap / weight AS ratio,
         (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, turn,
         CASE WHEN level < ratio THEN max(CASE WHEN level < ratio THEN level END) OVER () * weight ELSE cap END AS target
  FROM leveled),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.turn, t.target,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.doc_id ASC NULLS LAST, s.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS passes
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, passes * size + least(greatest(CAST(floor(target + 0.5) AS BIGINT) - source_size * passes - start, 0), size) AS taken
  FROM placed),
shares AS (
  SELECT *, CASE WHEN taken > 0 THEN least(start / target, 1.0::DOUBLE) END AS u,
         CASE WHEN taken > size THEN least((source_size + start) / target, 1.0::DOUBLE) END AS u2
  FROM taken)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE turn % 3
    WHEN 0 THEN 2.0::DOUBLE * (u * 3.0::DOUBLE) / (4.0::DOUBLE + sqrt(greatest(16.0::DOUBLE + -4.0::DOUBLE * (u * 3.0::DOUBLE), 0.0::DOUBLE)))
    WHEN 1 THEN 2.0::DOUBLE * (u * 1.0::DOUBLE) / (1.0::DOUBLE + sqrt(greatest(1.0::DOUBLE + 0.0::DOUBLE * (u * 1.0::DOUBLE), 0.0::DOUBLE)))
    ELSE 2.0::DOUBLE * (u * 2.0::DOUBLE) / (1.0::DOUBLE + sqrt(greatest(1.0::DOUBLE + 4.0::DOUBLE * (u * 2.0::DOUBLE), 0.0::DOUBLE))) END AS position,
  CASE turn % 3
    WHEN 0 THEN 2.0::DOUBLE * (u2 * 3.0::DOUBLE) / (4.0::DOUBLE + sqrt(greatest(16.0::DOUBLE + -4.0::DOUBLE * (u2 * 3.0::DOUBLE), 0.0::DOUBLE)))
    WHEN 1 THEN 2.0::DOUBLE * (u2 * 1.0::DOUBLE) / (1.0::DOUBLE + sqrt(greatest(1.0::DOUBLE + 0.0::DOUBLE * (u2 * 1.0::DOUBLE), 0.0::DOUBLE)))
    ELSE 2.0::DOUBLE * (u2 * 2.0::DOUBLE) / (1.0::DOUBLE + sqrt(greatest(1.0::DOUBLE + 4.0::DOUBLE * (u2 * 2.0::DOUBLE), 0.0::DOUBLE))) END AS position_2
FROM shares
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH split AS (
  SELECT doc_id, u.pos, string_split(coalesce(text, ''), chr(10))[u.pos] AS line
  FROM documents, LATERAL (SELECT unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS pos) u),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split),
shared AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.top AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP6_SQL = """
WITH usable AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
whole AS (SELECT vec_id, list_transform(vec, lambda x: floor(x * 256)) AS vec FROM usable),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        table(spark, sf_dir, "documents"),
        tokenizer_file=public_tokenizers.path("byte_bpe_50k.json"),
    ).drop("row_id")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op12_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def _sql_assigned(books: str) -> str:
    """Parts with the nearest entry of ``books``: ties to the lower entry."""
    return f"""
  SELECT id, part, min_by(entry, d * 256 + entry) AS entry, min(d) AS d FROM (
    SELECT p.id, p.part, b.entry, list_sum(list_transform(range(1, len(p.vec) + 1), lambda k: (p.vec[k] - b.vec[k]) * (p.vec[k] - b.vec[k])))::HUGEINT AS d
    FROM points p JOIN {books} b ON p.part = b.part)
  GROUP BY id, part"""


def _sql_round(turn: int) -> str:
    """``books_{turn}`` from the books before: componentwise means, rounded down; unused entries stay."""
    return f"""
assigned_{turn} AS MATERIALIZED ({_sql_assigned(f"books_{turn - 1}")}),
sums_{turn} AS (
  SELECT a.part, a.entry, k, sum(p.vec[k])::BIGINT AS s, count(*) AS c
  FROM assigned_{turn} a JOIN points p ON a.id = p.id AND a.part = p.part, LATERAL (SELECT unnest(range(1, len(p.vec) + 1)) AS k) u
  GROUP BY a.part, a.entry, k),
means_{turn} AS (SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY k) AS vec FROM sums_{turn} GROUP BY part, entry),
books_{turn} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.vec, b.vec) AS vec FROM books_{turn - 1} b LEFT JOIN means_{turn} m ON b.part = m.part AND b.entry = m.entry),"""


OP12_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS vec
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
points AS MATERIALIZED (
  SELECT id, part, vec[part * len(vec) // 4 + 1 : (part + 1) * len(vec) // 4] AS vec FROM kept, LATERAL (SELECT unnest(range(4)) AS part) u),
books_0 AS MATERIALIZED (SELECT part, id - 1 AS entry, vec FROM points WHERE id <= 256),{"".join(_sql_round(t) for t in (1, 2, 3, 4))}
assigned AS MATERIALIZED ({_sql_assigned("books_4")}),
coded AS MATERIALIZED (
  SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM assigned GROUP BY id),
labelled AS (SELECT k.label, sum(c.error)::BIGINT AS label_error FROM kept k JOIN coded c ON k.id = c.id GROUP BY k.label),
digest AS (SELECT sha256(string_agg(array_to_string(vec, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books_4)
SELECT k.vec_id, c.code, c.error, l.label_error, codebooks_sha256
FROM kept k JOIN coded c ON k.id = c.id JOIN labelled l ON k.label IS NOT DISTINCT FROM l.label, digest
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP13_SQL = r"""
WITH lined AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM lined),
cut AS (
  SELECT *, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1 : least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
         array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1 : greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
         array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1 :], '') AS suffix
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(coalesce(prefix, '')) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(coalesce(middle, '')) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || coalesce(prefix, '') || '<S>' || coalesce(suffix, '') || '<M>' || coalesce(middle, '')
         ELSE '<S>' || coalesce(suffix, '') || '<P>' || coalesce(prefix, '') || '<M>' || coalesce(middle, '') END) AS output_sha256, sha256(text) AS restored_sha256
FROM cut
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op3_curriculum_mixing": op3_curriculum_mixing,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_exact_topk": op6_exact_topk,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_language_id": op10_language_id,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_code_compression": op12_code_compression,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: DuckDB SQL of the queries that SQL can express over whole tables.
ORACLES: dict[str, str] = {
    "op2_warc_derivatives": OP2_SQL,
    "op3_curriculum_mixing": OP3_SQL,
    "op6_exact_topk": OP6_SQL,
    "op8_line_dedup": OP8_SQL,
    "op12_code_compression": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
