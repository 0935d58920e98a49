"""Audit queries over the derived cue timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import audit, timeline
from ..sources import derived
from . import oracle as O

KEY, POS = "doc_id", "line_no"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.enriched(derived.locked(derived.cues(spark, sf_dir)), KEY, POS, F.lit("en"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = (F.count_if("locked").alias("locked"), F.count_if(~F.col("locked")).alias("fallback"))
    return audit.metrics(_rows(spark, sf_dir), KEY, POS, *counts)


CORE = ("doc_id", "cues", "first_in_ms", "last_out_ms", "total_ms", "longest_ms", "peak_cps", "short", "long", "overlength", "fast", "overlapping", "zero_gaps", "micro_gaps", "pauses", "end_marks", "inline_commas", "unbalanced", "markdown")


def audit_core_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select(*CORE)


def gap_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.with_gaps(derived.cues(spark, sf_dir), KEY, POS).select(KEY, POS, "gap_ms", "gap_class")


def prolonged_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.silences(derived.cues(spark, sf_dir), KEY, POS)


def _lines(flag: str, *columns: str):
    return lambda spark, sf_dir: _rows(spark, sf_dir).where(flag).select(KEY, POS, *columns)


def bracket_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).where(F.size("unbalanced") > 0).select(KEY, POS, F.size("unbalanced").cast("long").alias("pairs"))


def upper_median_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).groupBy(KEY).agg(audit.upper_median("dur_ms").alias("median_ms"))


def _terms(cues: DataFrame) -> DataFrame:
    """Each document's distinct words of twelve characters or more."""
    return cues.select(KEY, F.explode(F.regexp_extract_all("text", F.lit("[^ ]{12,}"), F.lit(0))).alias("term")).distinct()


def glossary_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = derived.cues(spark, sf_dir, whole=True)
    return audit.term_counts(cues, _terms(cues), KEY, POS)


def _report(spark: SparkSession, sf_dir: str, cues: DataFrame) -> DataFrame:
    """The whole audit of every document; media end with the last even second before their last cue's end."""
    rows = audit.enriched(derived.locked(cues), KEY, POS, F.lit("en"))
    episodes = derived.documents(spark, sf_dir).select(KEY)
    return audit.report(rows, KEY, POS, episodes, _terms(cues), media_ms=F.floor(F.col("last_out_ms") / 2000) * 2000)


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures, with arrays as text."""
    found = _report(spark, sf_dir, derived.cues(spark, sf_dir, whole=True))
    quiet = F.array_join(F.transform("silences", lambda x: F.concat_ws("/", x["prev_index"].cast("string"), x["code"], x["next_index"].cast("string"))), ";")
    return found.withColumns({"violations": F.array_join("violations", ","), "silences": quiet})


def empty_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts where captions are only the lines with a vertical bar: most documents have none."""
    cues = derived.cues(spark, sf_dir, whole=True).where(F.col("text").contains("|"))
    return _report(spark, sf_dir, cues).select(KEY, "passed", F.array_join("violations", ",").alias("violations"), "action", "locked_pct", "overrun", "cues")


def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON and Markdown of every report: digest of the page, lines of its issues, and three figures read back from the JSON."""
    cues = derived.cues(spark, sf_dir, whole=True).where(F.col(KEY).isNotNull())
    found = _report(spark, sf_dir, cues)
    rows = audit.enriched(cues, KEY, POS, F.lit("en"))
    pages = audit.report_pages(found, audit.issues(rows, KEY, POS), KEY, POS).withColumn("r", F.from_json("json", "cues long, grade string, n_silences long"))
    lines = F.size(F.filter(F.split("markdown", "\n"), lambda x: x.rlike(r"^\| \d+ \| \d+ \| [a-z_]+ \| "))).cast("long")
    return pages.select(KEY, F.split("markdown", "\n")[2].alias("verdict"), lines.alias("issue_lines"), "r.cues", "r.grade", "r.n_silences")


def review_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.issues(_rows(spark, sf_dir), KEY, POS).select(KEY, POS, "type", "severity")


def review_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.ranked(audit.issues(_rows(spark, sf_dir), KEY, POS), KEY, POS, 15).select(KEY, "rank", POS, "type", "severity")


def compliance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.compliance(_metrics(spark, sf_dir), F.col("locked"), F.col("fallback")).select(KEY, "score", "grade")


def lock_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select(KEY, "locked", "fallback", audit.lock_rate(F.col("locked"), F.col("fallback")).alias("rate"))


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The medium is taken to end with the last even second before the last cue's end."""
    media = F.floor(F.col("last_out_ms") / 2000) * 2.0
    rate = audit.lock_rate(F.col("locked"), F.col("fallback"))
    verdict = audit.gate(rate, F.col("last_out_ms") / 1000 - media, media, F.col("overlapping"))
    return _metrics(spark, sf_dir).withColumn("v", verdict).select(KEY, F.col("v.passed"), F.array_join("v.violations", ",").alias("violations"), "v.action")


def last_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = F.floor(F.col("last_out_ms") / 2000) * 2000
    return _metrics(spark, sf_dir).select(KEY, "last_out_ms", (F.col("last_out_ms") - media).alias("overrun_ms"))


def partial_final_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of chunks of 20 cues merged to episodes, with the places of unlocked cues in order."""
    rows = derived.locked(derived.cues(spark, sf_dir)).withColumn("chunk", F.floor(F.col(POS) / 20))
    part = rows.groupBy(KEY, "chunk").agg(F.count("*").alias("n"), F.count_if("locked").alias("locked"), F.collect_list(F.when(~F.col("locked"), F.col(POS))).alias("open"))
    return part.groupBy(KEY).agg(F.sum("n").alias("cues"), F.sum("locked").alias("locked"), F.array_join(F.array_sort(F.flatten(F.collect_list("open"))), ",").alias("open"))


QUERIES = {
    "audit_core_metrics": audit_core_metrics,
    "gap_classes": gap_classes,
    "prolonged_silences": prolonged_silences,
    "overlength_lines": _lines("overlength", "width"),
    "high_cps_lines": _lines("fast", "cps"),
    "short_lines": _lines("short", "dur_ms"),
    "trailing_punct": _lines("end_marks", "text"),
    "md_residue": _lines("markdown", "text"),
    "inline_comma": _lines("inline_comma", "text"),
    "bracket_balance": bracket_balance,
    "upper_median_duration": upper_median_duration,
    "glossary_coverage": glossary_coverage,
    "review_issues": review_issues,
    "review_topk": review_topk,
    "compliance_score": compliance_score,
    "lock_rate": lock_rate,
    "quality_gate": quality_gate,
    "last_out": last_out,
    "partial_final_stats": partial_final_stats,
    "audit_report": audit_report,
    "empty_verdict": empty_verdict,
    "report_documents": report_documents,
}

_ISSUES = O.ENRICHED + """,
issues AS (
  SELECT doc_id, line_no, 'markdown' AS type, 0 AS type_rank, 20.0::DOUBLE AS severity FROM enriched WHERE markdown
  UNION ALL SELECT doc_id, line_no, 'bracket', 1, 15.0 FROM enriched WHERE unbalanced > 0
  UNION ALL SELECT doc_id, line_no, 'overlength', 2, width - 42.0 FROM enriched WHERE overlength
  UNION ALL SELECT doc_id, line_no, 'high_cps', 3, cps - 20.0 FROM enriched WHERE fast
  UNION ALL SELECT doc_id, line_no, 'short', 4, (1000 - dur_ms) / 1000 FROM enriched WHERE short AND cps > 5.0)
"""
_PCT = lambda c: f"{c} * 100.0::DOUBLE / cues"
_SCORE = f"""100.0::DOUBLE - (least(20.0::DOUBLE, overlapping * 5.0::DOUBLE) + least(10.0::DOUBLE, micro_gaps * 2.0::DOUBLE) + least(10.0::DOUBLE, end_marks * 1.0::DOUBLE)
  + least(10.0::DOUBLE, unbalanced * 3.0::DOUBLE) + least(10.0::DOUBLE, markdown * 5.0::DOUBLE) + least(10.0::DOUBLE, {_PCT('overlength')} * 0.5::DOUBLE)
  + least(5.0::DOUBLE, {_PCT('short')} * 0.3::DOUBLE) + least(10.0::DOUBLE, {_PCT('fast')} * 0.5::DOUBLE)
  + CASE WHEN locked + fallback > 0 THEN least(5.0::DOUBLE, fallback * 100.0::DOUBLE / greatest(locked + fallback, 1) * 0.2::DOUBLE) ELSE 0.0::DOUBLE END)"""
_RATE = "round_even(locked * 100.0::DOUBLE / greatest(1, locked + fallback), 1)"
_CODE = lambda c: f"printf('%02d:%02d:%02d,%03d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000)"
_SILENCES = """,
spaced AS (
  SELECT *, row_number() OVER w AS idx, coalesce(lag(end_ms) OVER w, 0) AS since FROM cues WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
quiet AS (
  SELECT doc_id, count(*) AS n_silences, string_agg((idx - 1) || '/' || """ + _CODE("since") + """ || ' --> ' || """ + _CODE("start_ms") + """ || '/' || idx, ';' ORDER BY since, start_ms) AS silences
  FROM spaced WHERE start_ms - since >= 10000 GROUP BY doc_id)"""
_TERMS = """,
terms AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split(text, ' '), lambda x: length(x) >= 12)) AS term FROM cues),
whole AS (SELECT doc_id, string_agg(text, ' ' ORDER BY line_no) AS captions FROM cues GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS terms, count(*) FILTER (WHERE contains(captions, term)) AS terms_found FROM terms JOIN whole USING (doc_id) GROUP BY doc_id)"""
_JUDGED = f""",
scored AS (SELECT *, round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, {_SCORE})), 1) AS score, {_RATE} AS rate, last_out_ms // 2000 * 2000 AS media_ms FROM metrics),
judged AS (
  SELECT *, CASE WHEN media_ms > 0 THEN (last_out_ms - media_ms) / 1000 ELSE 0.0::DOUBLE END AS over,
    CASE WHEN score >= 95 THEN 'A+' WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' ELSE 'C' END AS grade,
    concat_ws(',', CASE WHEN rate < 80 THEN 'LOW_ACOUSTIC_LOCK_RATE' END, CASE WHEN media_ms > 0 AND last_out_ms - media_ms > 500 THEN 'LAST_OUT_EXCEEDS_DURATION' END,
      CASE WHEN overlapping > 0 THEN 'TIMELINE_OVERLAPS' END) AS found FROM scored),
verdicts AS (
  SELECT d.doc_id, j.* EXCLUDE (doc_id), coalesce(j.found, 'EMPTY_SUBTITLES') AS violations, coalesce(j.found = '', false) AS passed,
    CASE WHEN j.found = '' THEN 'DELIVER' ELSE 'ONE_SHOT_REMEDIATE' END AS action, coalesce(j.rate, 0.0::DOUBLE) AS locked_pct, coalesce(j.over, 0.0::DOUBLE) AS overrun
  FROM documents d LEFT JOIN judged j ON d.doc_id = j.doc_id)"""
_BARRED = O.METRICS.replace("cues AS (SELECT doc_id, line_no, text, start_ms, start_ms + dur AS end_ms FROM placed)", "cues AS (SELECT doc_id, line_no, text, start_ms, start_ms + dur AS end_ms FROM placed WHERE contains(text, '|'))")
ORACLES = {
    "audit_report": O.METRICS + _JUDGED + _SILENCES + _TERMS + """,
counted AS (SELECT doc_id, count(*) FILTER (WHERE markdown) + count(*) FILTER (WHERE unbalanced > 0) + count(*) FILTER (WHERE overlength) + count(*) FILTER (WHERE fast) + count(*) FILTER (WHERE short AND cents > 500) AS issues FROM enriched GROUP BY doc_id)
SELECT doc_id, passed, violations, action, locked_pct, overrun, coalesce(v.cues, 0) AS cues, CASE WHEN v.cues > 0 THEN 'en' END AS locale, media_ms / 1000 AS media, first_in_ms / 1000 AS first_in, """ + _CODE("first_in_ms") + """ AS first_in_code,
  last_out_ms / 1000 AS last_out, """ + _CODE("last_out_ms") + """ AS last_out_code, """ + O.nearest("total_ms", "v.cues * 1000") + """ AS mean_duration, """ + O.nearest("median_ms", "1000") + """ AS median_duration,
  (all_cents // v.cues + CASE WHEN all_cents % v.cues * 2 > v.cues OR (all_cents % v.cues * 2 = v.cues AND all_cents // v.cues % 2 = 1) THEN 1 ELSE 0 END) / 100.0::DOUBLE AS mean_cps, peak_cps,
  CASE WHEN v.cues > 0 THEN 20.0::DOUBLE END AS cps_limit, CASE WHEN v.cues > 0 THEN 42.0::DOUBLE END AS line_limit, fast, overlength, end_marks, unbalanced, markdown, inline_commas, short, long, overlapping, micro_gaps, zero_gaps, pauses,
  """ + O.nearest("fast * 100", "v.cues") + """ AS fast_pct, """ + O.nearest("overlength * 100", "v.cues") + """ AS overlength_pct, """ + O.nearest("short * 100", "v.cues") + """ AS short_pct,
  CASE WHEN v.cues > 0 THEN coalesce(n_silences, 0) END AS n_silences, CASE WHEN v.cues > 0 THEN coalesce(silences, '') END AS silences, locked, fallback,
  CASE WHEN v.cues > 0 THEN coalesce(terms, 0) END AS terms, CASE WHEN v.cues > 0 THEN coalesce(terms_found, 0) END AS terms_found, score, grade, issues
FROM verdicts v LEFT JOIN quiet USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN counted USING (doc_id)""",
    "empty_verdict": _BARRED + _JUDGED + " SELECT doc_id, passed, violations, action, locked_pct, overrun, coalesce(cues, 0) AS cues FROM verdicts",
    "report_documents": O.METRICS + _JUDGED + _SILENCES + """,
counted AS (SELECT doc_id, count(*) FILTER (WHERE markdown) + count(*) FILTER (WHERE unbalanced > 0) + count(*) FILTER (WHERE overlength) + count(*) FILTER (WHERE fast) + count(*) FILTER (WHERE short AND cents > 500) AS issues FROM enriched GROUP BY doc_id)
SELECT doc_id, CASE WHEN passed THEN 'PASS (' ELSE 'FAIL (' END || action || ')' || CASE WHEN violations <> '' THEN ': ' || replace(violations, ',', ', ') ELSE '' END AS verdict,
  least(15, coalesce(issues, 0)) AS issue_lines, coalesce(v.cues, 0) AS cues, grade, CASE WHEN v.cues > 0 THEN coalesce(n_silences, 0) END AS n_silences
FROM verdicts v LEFT JOIN quiet USING (doc_id) LEFT JOIN counted USING (doc_id)""",
    "audit_core_metrics": O.METRICS + f"SELECT {', '.join(CORE)} FROM metrics",
    "gap_classes": O.GAPS + "SELECT doc_id, line_no, gap_ms, gap_class FROM classed",
    "prolonged_silences": O.CUES + """, between AS (
  SELECT *, row_number() OVER w AS next_index, coalesce(lag(end_ms) OVER w, 0) AS from_ms FROM cues WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, next_index - 1 AS prev_index, next_index, from_ms, start_ms AS to_ms, start_ms - from_ms AS silence_ms FROM between WHERE start_ms - from_ms >= 10000""",
    "overlength_lines": O.ENRICHED + "SELECT doc_id, line_no, width FROM enriched WHERE overlength",
    "high_cps_lines": O.ENRICHED + "SELECT doc_id, line_no, cps FROM enriched WHERE fast",
    "short_lines": O.ENRICHED + "SELECT doc_id, line_no, dur_ms FROM enriched WHERE short",
    "trailing_punct": O.ENRICHED + "SELECT doc_id, line_no, text FROM enriched WHERE end_marks",
    "md_residue": O.ENRICHED + "SELECT doc_id, line_no, text FROM enriched WHERE markdown",
    "inline_comma": O.ENRICHED + "SELECT doc_id, line_no, text FROM enriched WHERE inline_comma",
    "bracket_balance": O.ENRICHED + "SELECT doc_id, line_no, CAST(unbalanced AS BIGINT) AS pairs FROM enriched WHERE unbalanced > 0",
    "upper_median_duration": O.ENRICHED + "SELECT doc_id, list_sort(list(dur_ms))[count(*) // 2 + 1] AS median_ms FROM enriched GROUP BY doc_id",
    "glossary_coverage": O.CUES + """, terms AS (
  SELECT DISTINCT doc_id, unnest(list_filter(string_split(text, ' '), lambda x: length(x) >= 12)) AS term FROM cues),
whole AS (SELECT doc_id, string_agg(text, ' ' ORDER BY line_no) AS captions FROM cues GROUP BY doc_id),
counted AS (
  SELECT doc_id, term, CAST((length(captions) - length(replace(captions, term, ''))) // length(term) AS BIGINT) AS times FROM terms JOIN whole USING (doc_id))
SELECT doc_id, term, times FROM counted WHERE times > 0""",
    "review_issues": _ISSUES + "SELECT doc_id, line_no, type, severity FROM issues",
    "review_topk": _ISSUES + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY severity DESC, type_rank, line_no) AS rank FROM issues)
SELECT doc_id, rank, line_no, type, severity FROM ranked WHERE rank <= 15""",
    "compliance_score": O.METRICS + f""", scored AS (SELECT doc_id, round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, {_SCORE})), 1) AS score FROM metrics)
SELECT doc_id, score, CASE WHEN score >= 95 THEN 'A+' WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' ELSE 'C' END AS grade FROM scored""",
    "lock_rate": O.METRICS + f"SELECT doc_id, locked, fallback, {_RATE} AS rate FROM metrics",
    "quality_gate": O.METRICS + f""", checked AS (
  SELECT doc_id, concat_ws(',', CASE WHEN {_RATE} < 80 THEN 'LOW_ACOUSTIC_LOCK_RATE' END,
    CASE WHEN last_out_ms // 2000 > 0 AND last_out_ms / 1000 - last_out_ms // 2000 * 2.0::DOUBLE > 0.5::DOUBLE THEN 'LAST_OUT_EXCEEDS_DURATION' END,
    CASE WHEN overlapping > 0 THEN 'TIMELINE_OVERLAPS' END) AS violations FROM metrics)
SELECT doc_id, violations = '' AS passed, violations, CASE WHEN violations = '' THEN 'DELIVER' ELSE 'ONE_SHOT_REMEDIATE' END AS action FROM checked""",
    "last_out": O.METRICS + "SELECT doc_id, last_out_ms, last_out_ms - last_out_ms // 2000 * 2000 AS overrun_ms FROM metrics",
    "partial_final_stats": O.CUES + """SELECT doc_id, count(*) AS cues, count(*) FILTER (WHERE (line_no * 31 + doc_id) % 7 <> 0) AS locked,
  coalesce(string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (WHERE (line_no * 31 + doc_id) % 7 = 0), '') AS open FROM cues GROUP BY doc_id""",
}
