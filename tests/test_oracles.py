import pytest

from cuewise.plans.registry import ORACLES, QUERIES

from .against import SF, assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name])


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["segment_words", "semantic_chunks", "lead_in", "split_long_clause", "caption_pipeline", "prompt_terms"])
def test_queries_without_an_oracle_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
