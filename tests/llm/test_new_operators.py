"""SimHash links, vector codes and rearranged texts against brute force, on odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewise.llm import codes, fim, simhash
from cuewise.llm.queries import QUERIES

from ..against import SF
from . import brute
from .test_operators import SCHEMA, docs, nothing, odd_texts, pairs, prose  # noqa: F401  (fixtures)


# SimHash


def test_fingerprints_and_components_match_all_pairs(docs):  # noqa: F811
    want = brute.fingerprint_components([(k, brute.fingerprint(t)) for k, t in pairs(docs)])
    for bits in (1, 2, 4, None):
        assert sorted(map(tuple, simhash.simhash_components(docs, segment_bits=bits).collect())) == want


def test_the_query_over_a_whole_table(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute.fingerprint_components([(k, brute.fingerprint(t)) for k, t in texts])
    assert sorted(map(tuple, QUERIES["op11_simhash_near_dedup"](spark, SF).collect())) == want
    assert any(c != k for k, _, c in want)


def near_and_far(n: int, seed: int) -> list[int]:
    """Fingerprints around a few centres, zero and all ones among them, so that cells hold crowds and steps leave their range."""
    rng, out = np.random.default_rng(seed), []
    centres = [0, (1 << 64) - 1, 0xAAAAAAAAAAAAAAAA, 1 << 63, *map(int, rng.integers(0, 2**64, 4, dtype=np.uint64))]
    for _ in range(n):
        bits = centres[rng.integers(len(centres))]
        for at in rng.choice(64, rng.integers(0, 5), replace=False):
            bits ^= 1 << int(at)
        out.append(bits)
    return sorted(set(out))


@pytest.mark.parametrize("segment_bits", [1, 2, 4])
@pytest.mark.parametrize("differing", [0, 1, 2])
def test_the_grid_finds_each_close_pair_once(spark, segment_bits, differing):
    marks = near_and_far(500, segment_bits)
    signed = [b - (1 << 64) if b >> 63 else b for b in marks]
    table = spark.createDataFrame([(b,) for b in signed], "bits long").repartition(5)
    got = [tuple(r) for r in simhash.close_pairs(table, differing=differing, segment_bits=segment_bits, crowd=16).collect()]
    back = lambda b: b & ((1 << 64) - 1)
    want = {(x, y) for i, x in enumerate(signed) for y in signed[:i] + signed[i + 1 :] if x < y and (back(x) ^ back(y)).bit_count() <= differing}
    assert len(got) == len(set(got)) and set(got) == want
    assert differing == 0 or len(want) > 100


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = prose(70, 3000)
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    assert simhash.fingerprint(text.encode()) == whole == brute.fingerprint(text)


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two", "a b c", "a b c d", "a\x1cb c d e", "x " * 50])
def test_odd_texts_have_their_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == brute.fingerprint(text)


def test_empty_texts_are_linked_and_rows_without_an_id_are_not(spark):
    rows = spark.createDataFrame([(9, None), (4, " "), (None, ""), (7, "some other words"), (7, "")], "doc_id long, text string")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(rows).collect()}
    zero = "0" * 16
    other = f"{brute.fingerprint('some other words'):016x}"
    assert got == {(9, zero, 4), (4, zero, 4), (None, zero, None), (7, zero, 4), (7, other, 7)}


def test_simhash_of_an_empty_table_and_clashing_names(spark, nothing):  # noqa: F811
    assert simhash.simhash_components(nothing).collect() == []
    clash = spark.createDataFrame([(k, "the same words in all", k, "x", 1, 2) for k in range(5)], "doc_id long, text string, bits long, node string, component int, cell int")
    assert {r.component_id for r in simhash.simhash_components(clash).collect()} == {0}
    with pytest.raises(ValueError, match="2 bits"):
        simhash.simhash_components(nothing, differing=3)


# Vector codes


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)


def test_codes_match_a_plain_version(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=8) * (1 + k % 3)], k % 4 if k % 7 else None) for k in range(160)]
    rows += [(1000 + k, rows[k][1], 9) for k in range(20)]
    want, digest = brute.quantised([r[:2] for r in rows], 4, 16, 3)
    got = codes.compress(vectors(spark, rows), entries=16, rounds=3).collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == want and {r.codebooks_sha256 for r in got} == {digest}
    for r in got:
        assert r.label_error == sum(x.error for x in got if x.label == r.label)


@pytest.mark.parametrize("largest", [3, 1000, 1 << 26])
def test_the_annulus_holds_every_nearest_entry(largest):
    """Small numbers give ties in plenty, large ones go past what doubles hold."""
    rng = np.random.default_rng(largest)
    book = codes.Codebook(rng.integers(-largest, largest + 1, (64, 4)))
    points = np.concatenate([rng.integers(-largest, largest + 1, (700, 4)), book.entries[:5], np.zeros((1, 4), np.int64)])
    every = np.array([[sum(int(a - b) ** 2 for a, b in zip(p, e, strict=True)) for e in book.entries] for p in points], dtype=object)
    index, error = book.nearest(points)
    assert error.tolist() == [min(row) for row in every]
    assert index.tolist() == [min(k for k, d in enumerate(row) if d == min(row)) for row in every]


def test_the_annulus_leaves_entries_out(monkeypatch):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(2000, 4)) * rng.choice([10, 100, 1000], 2000)[:, None]
    book, seen = codes.Codebook(np.floor(points[:256]).astype(np.int64)), []
    plain = codes.squared_distances
    monkeypatch.setattr(codes, "squared_distances", lambda x, y: seen.append(len(x) * len(y)) or plain(x, y))
    book.nearest(np.floor(points).astype(np.int64))
    assert sum(seen) < 0.7 * len(points) * 256


def test_rows_that_do_not_count(spark):
    good = [0.5, -0.25, 1.0, 0.0]
    rows = [(1, good, 1), (2, None, 1), (3, [0.5, None, 1.0, 0.0], 1), (4, [0.5, float("nan"), 1.0, 0.0], 1), (5, [0.5, float("-inf"), 1.0, 0.0], 1), (6, [], 1), (7, [0.1], 1),
            (None, good, None), (1, good, 1), (8, [0.0] * 4, 2), (9, [1e300, -1e300, 0.0, 0.0], 3)]
    got = codes.compress(vectors(spark, rows), entries=2, rounds=1).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 1), (False, 1), (False, 8), (False, 9), (True, 0)]
    assert all(len(r.code) == 8 and r.error >= 0 for r in got) and len({r.codebooks_sha256 for r in got}) == 1


def test_codes_of_an_empty_table_clashing_names_and_odd_lengths(spark):
    assert codes.compress(vectors(spark, [])).collect() == [] == codes.compress(vectors(spark, [(1, None, 1)])).collect()
    rows = [(k, [float(k), 1.0, float(-k), 0.5, 2.0], "a", "b", 3) for k in range(9)]
    clash = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, code string, `of` int")
    got = codes.compress(clash, entries=3).collect()
    assert len(got) == 9 and {r.label for r in got} == {"a"} and {r.label_error for r in got} == {sum(r.error for r in got)}
    assert [s.stop - s.start for s in codes.cuts(5, 4)] == [2, 1, 1, 1] and codes.cuts(64, 4)[3] == slice(48, 64)


# Fill-in-the-middle


def test_rearranged_texts_match_a_plain_version(spark, docs):  # noqa: F811
    odd = [(500, "a\nb\n\nc"), (501, "\n"), (502, "\n\n\n"), (503, "has <S> in it\nand more"), (504, "été\n日本語\n😀😀\nend\r\n x"), (505, "<\nP>\n<S\n>"), (None, "no id\nat all\n"), (None, "no id\nat all\n"), (None, None), (506, "x\n" * 5000)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    for percent, spm in ((100, 50), (60, 10)):
        got = sorted((tuple(r) for r in fim.fill_in_middle(every, percent=percent, spm_percent=spm).collect()), key=repr)
        want = sorted(((k, *brute.rearranged(k, t, percent, spm)) for k, t in pairs(every)), key=repr)
        assert got == want
        assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_texts_come_back_from_output_and_form(docs):  # noqa: F811
    rows = docs.select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), F.concat("text", F.lit("<\n<P\n>\n<"), "text").alias("text")))
    back = fim.fill_in_middle(rows).select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert {r.doc_id: r.back for r in back} == {k: t or "" for k, t in pairs(rows)}


def test_rearranging_an_empty_table_clashing_names_and_equal_ids(spark, nothing):  # noqa: F811
    assert fim.fill_in_middle(nothing).collect() == []
    rows = [(3, "one\ntwo\nthree", "n", 1, "o"), (3, "one\ntwo\nthree", "n", 2, "o"), (3, "four\nfive", "n", 3, "o")]
    clash = spark.createDataFrame(rows, "doc_id long, text string, n string, first int, output string")
    got = [tuple(r) for r in fim.fill_in_middle(clash).collect()]
    assert sorted(got) == sorted((3, *brute.rearranged(3, t)) for _, t, *_ in rows)
