"""Stages over tables with extra columns of the names that the stages use themselves, and the bound of the language sample."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewise.llm import language

from .test_operators import docs, odd_texts, prose  # noqa: F401
from .test_pipeline import COLUMNS

NAMES = (
    "row doc of at times first kept order position position_2 taken size target turn range part entry hash piece pieces group place start length offset component_id n_shingles node keep n_dropped n_lines "
    "quality posterior votes vote score weight label key line c0 c1 __row __first __at __of __times __keep __text __node held_out lang_pred bits fingerprint"
).split()
ODD = ["a b", "x.y", "Größe"]


@pytest.fixture(scope="module")
def crowded(spark):
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(odd_texts())]
    rows += [(50 + k, prose(50 + k, 60), "en", "s0", 0) for k in range(20)]
    table = spark.createDataFrame(rows, COLUMNS).repartition(3)
    return table.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES + ODD])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_of_any_name_pass_through_a_stage(spark, crowded, name):
    run = dict(corpus_pipeline.STAGES)[name]
    got = run(spark, crowded, "")
    assert got.dtypes == crowded.dtypes
    rows = got.collect()
    assert rows and all(row[n] == f"own {n}" for row in rows for n in NAMES + ODD)
    plain = run(spark, crowded.select("doc_id", "text", "lang", "source", "n_chars"), "").collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in plain)


def test_columns_of_any_name_are_packed(spark, crowded, tmp_path):
    crowded.write.parquet(str(tmp_path / "docs"))
    rows = corpus_pipeline.best_fit_packing(spark, spark.read.parquet(str(tmp_path / "docs")), "").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in crowded.select("doc_id").collect()}


@pytest.mark.parametrize(("languages", "train_rows", "most"), [(300, 120, 500), (300, 1000, 40), (7, 50, 500), (2, 1000, 1)])
def test_the_language_sample_keeps_its_bounds(spark, languages, train_rows, most):
    rows = spark.createDataFrame([(k, f"text {k}", f"l{k % languages:03d}") for k in range(languages * 9)] + [(100_000 + k, f"more {k}", "l001") for k in range(50)], "doc_id long, text string, lang string")
    texts, langs = language.training_sample(rows, F.lit(True), train_rows=train_rows, train_chars=100, most_languages=most)
    assert 0 < len(texts) <= train_rows and len(set(langs)) <= min(most, train_rows)
    assert "l001" in langs and set(langs) <= {f"l{k:03d}" for k in range(languages)}
    if languages * 9 + 50 <= train_rows:
        assert most < languages or len(texts) == languages * 9 + 50


def test_answers_are_those_of_a_plain_version(spark):
    """Each text alone: the mean of its n-grams' rows, a softmax, the largest; whatever stands beside it in a batch."""
    words = {"de": "der die und nicht straße über", "en": "the and with what over street", "es": "el los una calle sobre año"}
    rng = np.random.default_rng(4)
    text = lambda lang, n: " ".join(rng.choice(words[lang].split(), n))
    rows = [(k, text(lang, 12), lang) for k, lang in enumerate(list(words) * 60)]
    model = language.train([t for _, t, _ in rows], [x for _, _, x in rows])
    odd = [(1000, None), (1001, ""), (1002, "12 34 !?"), (1003, "der " * 30_000), (1004, "x"), (1005, "über straße und"), (1006, "the street with what")]
    table = spark.createDataFrame([(k, t) for k, t, _ in rows] + odd, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in language.predict(table, model, F.col("doc_id")).collect()}
    for doc, t in [(k, t) for k, t, _ in rows] + odd:
        if t is None or not any(c.isalpha() for c in t):
            assert (got[doc].lang_pred, got[doc].score, got[doc].rejected) == ("und", 0.0, True)
            continue
        data = b"\n" + t.encode() + b"\n" * 9
        found, n_grams = np.zeros(len(model.languages)), 0
        for n in language.GRAMS:
            for at in range(len(t.encode()) + 1):
                piece = data[at : at + n]
                if not any(b in b" \t\n\r\x0b\x0c" for b in piece[1:-1]):
                    found, n_grams = found + model.table[language_bucket(piece, n)], n_grams + 1
        logits = (found / n_grams + model.bias) / model.temperature
        chances = np.exp(logits - logits.max())
        chances /= chances.sum()
        assert got[doc].lang_pred == model.languages[int(chances.argmax())] and got[doc].score == pytest.approx(chances.max(), abs=1e-4)
        assert got[doc].rejected == (got[doc].score < model.reject_below)
    assert got[1005].lang_pred == "de" and got[1006].lang_pred == "en" and got[1003].lang_pred == "de"


def language_bucket(piece: bytes, n: int) -> int:
    """The bucket of one n-gram, by whole numbers."""
    from cuewise.llm.hashed import _STEP

    h = n
    for b, step in zip(piece, _STEP.tolist(), strict=False):
        h = (h + b * step) % 2**32
        h = ((h ^ (h >> 15)) * 0x2C1B3C6D) % 2**32
    return h >> (32 - language.BITS)


@pytest.mark.parametrize("fanout", [1, 3, 9])
def test_parts_dealt_in_two_steps_give_the_same_components(docs, monkeypatch, fanout):  # noqa: F811
    """Many parts: blocks of a few texts send rows to groups of parts, and groups deal them on, a few shingles at a time."""
    from cuewise.llm import ngram_join

    from . import brute
    from .test_operators import pairs

    want = brute.jaccard_components(pairs(docs))
    monkeypatch.setattr(ngram_join, "_BLOCK_CHARS", 2000)
    monkeypatch.setattr(ngram_join, "_FANOUT", fanout)
    monkeypatch.setattr(ngram_join, "_TOGETHER", 40)
    monkeypatch.setattr(ngram_join, "_PARTS_A_TASK", 3)
    assert ngram_join._groups(64) == 8 and ngram_join._groups(65) == 9
    assert sorted(map(tuple, ngram_join.ngram_components(docs, frequent_from=3, block_rows=4).collect())) == want


def test_groups_of_parts_stay_few():
    from cuewise.llm import ngram_join

    for n in (1, 64, 1024, 1025, 3_000_000):
        groups = ngram_join._groups(n)
        assert groups == n if n <= 1024 else groups * groups >= n > (groups - 1) ** 2
