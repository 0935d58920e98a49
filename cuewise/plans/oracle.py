"""SQL pieces that the oracle queries share: the derived timelines, and text functions written out."""

from __future__ import annotations

CUES = """
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no FROM documents),
kept AS (SELECT doc_id, line_no, trim(line, ' ') AS text FROM split WHERE trim(line, ' ') <> ''),
timed AS (
  SELECT *, CAST(300 + (length(text) * 37) % 7000 AS BIGINT) AS dur,
    CASE (line_no * 7919 + doc_id * 104729) % 10 WHEN 0 THEN -150 WHEN 1 THEN 0 WHEN 2 THEN 100 WHEN 3 THEN 12000 ELSE 350 END AS gap FROM kept),
placed AS (
  SELECT *, CAST(coalesce(sum(dur + gap) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM timed),
cues AS (SELECT doc_id, line_no, text, start_ms, start_ms + dur AS end_ms FROM placed)
"""

GAPS = CUES + """,
gapped AS (SELECT *, lead(start_ms) OVER (PARTITION BY doc_id ORDER BY line_no) - end_ms AS gap_ms FROM cues),
classed AS (
  SELECT *, CASE WHEN gap_ms < -1 THEN 'overlap' WHEN abs(gap_ms) < 1 THEN 'zero' WHEN gap_ms >= 1 AND gap_ms < 200 THEN 'micro'
    WHEN gap_ms IS NOT NULL THEN 'normal' END AS gap_class FROM gapped)
"""


def _count(char: str) -> str:
    return f"(length(text) - length(replace(text, '{char}', '')))"


_PAIRS = ("()", "[]", "{}", "（）", "「」", "『』", "《》", "【】")
UNBALANCED = " + ".join(f"CASE WHEN {_count(a)} <> {_count(b)} THEN 1 ELSE 0 END" for a, b in _PAIRS)
TRAILING = "regexp_matches(text, '[。，、；:;,.—-]+$')"
MARKDOWN = r"regexp_matches(text, '\*{1,3}|_{2,}|`{1,3}|^\s*#{1,6}\s|^\s*>\s')"

ENRICHED = GAPS + f""",
measured AS (SELECT *, greatest(end_ms - start_ms, 10) AS dur_ms, CAST(length(text) AS DOUBLE) AS width FROM classed),
rated AS (
  SELECT *, CAST(width * 100000 AS BIGINT) AS n, CAST(greatest(dur_ms, 100) AS BIGINT) AS d FROM measured),
rounded AS (SELECT *, n // d + CASE WHEN n % d * 2 > d OR (n % d * 2 = d AND n // d % 2 = 1) THEN 1 ELSE 0 END AS cents FROM rated),
enriched AS (
  SELECT *, cents / 100.0::DOUBLE AS cps, {TRAILING} AS end_marks, contains(text, '，') AS inline_comma,
    {UNBALANCED} AS unbalanced, {MARKDOWN} AS markdown, width > 42.0 AS overlength, cents > 2000 AS fast,
    dur_ms < 1000 AS short, dur_ms > 6000 AS long
  FROM rounded)
"""

METRICS = ENRICHED + """,
metrics AS (
  SELECT doc_id, count(*) AS cues, arg_min(start_ms, line_no) AS first_in_ms, arg_max(end_ms, line_no) AS last_out_ms, CAST(sum(dur_ms) AS BIGINT) AS total_ms,
    max(dur_ms) AS longest_ms, max(cps) AS peak_cps, CAST(sum(cents) AS BIGINT) AS all_cents, list_sort(list(dur_ms))[count(*) // 2 + 1] AS median_ms, count(*) FILTER (WHERE short) AS short, count(*) FILTER (WHERE long) AS long,
    count(*) FILTER (WHERE overlength) AS overlength, count(*) FILTER (WHERE fast) AS fast,
    count(*) FILTER (WHERE gap_class = 'overlap') AS overlapping, count(*) FILTER (WHERE gap_class = 'zero') AS zero_gaps,
    count(*) FILTER (WHERE gap_class = 'micro') AS micro_gaps, count(*) FILTER (WHERE gap_class = 'normal') AS pauses,
    count(*) FILTER (WHERE end_marks) AS end_marks, count(*) FILTER (WHERE inline_comma) AS inline_commas,
    count(*) FILTER (WHERE unbalanced > 0) AS unbalanced, count(*) FILTER (WHERE markdown) AS markdown,
    count(*) FILTER (WHERE (line_no * 31 + doc_id) % 7 <> 0) AS locked, count(*) FILTER (WHERE (line_no * 31 + doc_id) % 7 = 0) AS fallback
  FROM enriched GROUP BY doc_id)
"""

WORDS = CUES + """,
spaced AS (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM cues),
numbered AS (
  SELECT doc_id, line_no, start_ms AS cue_start, end_ms - start_ms AS span, unnest(ws) AS word, CAST(generate_subscripts(ws, 1) - 1 AS BIGINT) AS word_pos FROM spaced),
summed AS (
  SELECT *, sum(length(word)) OVER (PARTITION BY doc_id, line_no) AS total, sum(length(word)) OVER (PARTITION BY doc_id, line_no ORDER BY word_pos) AS upto FROM numbered),
words AS (
  SELECT doc_id, line_no, word_pos, word, CAST(cue_start + span * (upto - length(word)) // total AS BIGINT) AS start_ms, CAST(cue_start + span * upto // total AS BIGINT) AS end_ms FROM summed)
"""


def nearest(n: str, d: str) -> str:
    """``n / d`` to two places, of two as near the even one."""
    return f"(({n}) * 100 // ({d}) + CASE WHEN ({n}) * 100 % ({d}) * 2 > ({d}) OR (({n}) * 100 % ({d}) * 2 = ({d}) AND ({n}) * 100 // ({d}) % 2 = 1) THEN 1 ELSE 0 END) / 100.0::DOUBLE"
