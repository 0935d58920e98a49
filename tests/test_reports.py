"""Reports as documents: each is made once, for every row of the documents, and its looks for marks equal the whole patterns."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cuewise.functions import text as T
from cuewise.operators import audit, terms
from cuewise.plans import audit_queries
from cuewise.sources import derived

from .against import SF, by_name

ODD = ["", "a", "a.", ". a", "a.\n", "a.\r\n", "a.\n\n", "a.\r", "。 ", "a—-", "a. ", "𝄞,", "*", "a_b", "a__b", "`x`", "# a", " \t## a", "a # b", "####### a", "#", ">", " > a", "a > b", "\n> a", None]


def test_a_report_is_made_once_and_its_text_is_shuffled_twice(spark):
    plan = audit_queries.report_documents(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = audit_queries.report_documents(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # One of documents that all branches share, one of terms and captions.
    assert sum("REPARTITION_BY_NUM" in line and "ReusedExchange" not in line for line in plan.splitlines()) == 2


def test_rows_without_an_id_and_of_one_id_have_reports(spark, tmp_path):
    rows = [(1, "One line here, ended.\n\n# two"), (1, None), (None, None), (2, ""), (3, "(x\n" * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(audit_queries.ORACLES["report_documents"])
    names = [d[0] for d in want.description]
    got = audit_queries.report_documents(spark, str(tmp_path))
    assert by_name(got.columns, [tuple(r) for r in got.collect()]) == by_name(names, want.fetchall())


def test_marks_are_seen_as_by_whole_patterns(spark):
    rows = spark.createDataFrame([(k, 0, 1000, x) for k, x in enumerate(ODD)], "k int, start_ms long, end_ms long, text string")
    whole = {"end_marks": audit.TRAILING, "markdown": r"\*{1,3}|_{2,}|`{1,3}|^\s*#{1,6}\s|^\s*>\s"}
    seen = audit.enriched(rows, "k", "start_ms", F.lit("en"))
    for name, pattern in whole.items():
        assert [tuple(r) for r in seen.select("text", name).where(~F.col(name).eqNullSafe(F.col("text").rlike(pattern))).collect()] == []


@pytest.mark.parametrize("text, pairs", [("(", ["()"]), ("()", []), ("»«", []), ("（a", ["（）"]), ("] 『』 」", ["[]", "「」"]), (None, []), ("", [])])
def test_odd_brackets(spark, text, pairs):
    assert spark.createDataFrame([(text,)], "t string").select(T.unbalanced(F.col("t"))).first()[0] == pairs


def test_absent_terms(spark):
    cues = spark.createDataFrame([("x", 1, "deep sea"), ("y", 1, None)], "k string, pos int, text string")
    asked = spark.createDataFrame([("x", "deep"), ("x", "none"), ("x", None), ("x", ""), ("y", "a"), ("z", "b")], "k string, term string")
    got = {tuple(r) for r in terms.term_counts(cues, asked, "k", "pos", absent=True).collect()}
    assert got == {("x", "deep", 1), ("x", "none", 0), ("x", None, 0), ("x", "", 0), ("y", "a", 0), ("z", "b", 0)}


def test_terms_meet_captions_that_share_their_shuffle(spark):
    cues = derived.cues(spark, SF, whole=True)
    rows = audit.enriched(cues, "doc_id", "line_no", F.lit("en"))
    found = audit.report(rows, "doc_id", "line_no", derived.documents(spark, SF).select("doc_id"), audit_queries._terms(cues), media_ms=F.col("last_out_ms"))
    assert found.where("terms_found < terms").count() == 0 < found.where("terms_found > 0").count()


def test_every_figure_of_odd_documents_is_that_of_sql(spark, tmp_path):
    """Documents without captions, final line breaks and vertical tabs, long words of characters beyond 16 bits among others."""
    rows = [(1, None), (2, ""), (3, " \n "), (4, "Ended.\r\nEnded,\x85\nEnded.\n"), (5, "\x0b# no heading\n \t# heading\n>\x0bno quote\n> quote"), (6, "plain and 𝒳𝒳𝒳𝒳𝒳𝒳𝒳𝒳𝒳𝒳𝒳𝒳\nextraordinarily é深\nextraordinarily 👨‍👩‍👧👨‍👩‍👧👨‍👩‍👧 x\n" * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(audit_queries.ORACLES["audit_report"])
    names = [d[0] for d in want.description]
    got = audit_queries.audit_report(spark, str(tmp_path))
    assert by_name(got.columns, [tuple(r) for r in got.collect()]) == by_name(names, want.fetchall())


def test_long_episodes_of_wide_and_narrow_characters():
    """Stretches begin anew, where an iterator that is given other texts freed what it did not own."""
    texts = ["the deep sea", "𝒳 deep 𝒳", "é深", "", "deep"] * 9000
    whole = " ".join(texts)
    wanted = ["deep", "sea 𝒳", "deep the", "é深", "x" * 50, "p 𝒳 é", " "]
    assert terms.occurrences(wanted, iter(texts)) == {t: whole.count(t) for t in wanted if t in whole}
