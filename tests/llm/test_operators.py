"""The operators against brute force, on tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cuewise.llm import language, lines, mixing, neighbours, ngram_join, packing, quality, suffix_dedup, topk, warc
from cuewise.llm.queries import ORACLES, QUERIES

from ..against import SF, assert_same
from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, entry string"
TOKENS = {"tokenizer_file": public_tokenizers.path("byte_bpe_50k.json")}


def prose(seed: int, words: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(words))


def odd_texts() -> list:
    base = prose(1, 60)
    near = base.replace(base[30:35], "zzzzz")
    shared = "A line that very many of the documents here have in common."
    return [
        base, near, base, None, "", "   ", "one two", "One TWO", prose(2, 4000), prose(3, 40) + "\n" + shared, prose(4, 40) + "\n" + shared.upper(), f"  {shared} \n" + prose(5, 9), shared, shared + "\n" + shared,
        prose(6, 30), prose(6, 30)[:100], "x" * 400, "y" + "x" * 300, "été à la plage " * 20, base[:200] + prose(7, 30),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 3}" if k % 7 else None, len(t or ""), 1, "e") for k, t in enumerate(odd_texts())]
    rows += [(100 + k, t, None, "s0", 0, 2, "f") for k, t in enumerate([odd_texts()[0], *(odd_texts()[0].replace("a", "b", n) for n in range(1, 5))] * 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs) -> list[tuple]:
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name])


def test_components_match_all_pairs(docs):
    got = sorted(map(tuple, ngram_join.ngram_components(docs, frequent_from=3, block_rows=4).collect()))
    assert got == brute.jaccard_components(pairs(docs))


def test_components_of_a_crowd(spark):
    """Many near copies of one text, and many texts that share half of it: no pair is lost."""
    base, rng = prose(11, 60).split(), np.random.default_rng(3)
    rows = []
    for k in range(90):
        words = list(base)
        for at in rng.choice(60, rng.integers(0, 3), replace=False):
            words[at] = f"w{k}{at}"
        rows.append((k, " ".join(words)))
    rows += [(200 + k, " ".join(base[:40]) + " " + prose(500 + k, 20)) for k in range(40)]
    crowd = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(map(tuple, ngram_join.ngram_components(crowd, frequent_from=8, block_rows=16).collect()))
    assert got == brute.jaccard_components(rows)


@pytest.mark.parametrize("n", [1, 5, 21, 22, 100, 1000, 40_000])
def test_prefix_lengths_hold_what_partners_share(n):
    limit = ngram_join.Threshold(75)
    assert limit.least(n) >= 0.75 * n > limit.least(n) - 1
    assert limit.filter_prefix(n) <= n and 1 <= limit.filter_need(n) <= limit.least(n)
    assert set(limit.classes(n)) & set(limit.classes(n * 4 // 3))


def test_repeated_bytes_match_brute_force(docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    want = {k: (a, b, c, hashlib.sha256(d).hexdigest()) for k, (a, b, c, d) in brute.repeated_bytes(pairs(docs)).items()}
    assert got == want


def test_repeats_ignore_rows_without_an_id_and_rows_of_one_id(spark):
    text = prose(8, 40)
    rows = spark.createDataFrame([(None, text), (5, text), (5, text), (5, text + "!")], "doc_id long, text string")
    got = suffix_dedup.remove_repeats(rows, with_text=True).collect()
    assert len(got) == 4 and {r.n_removed for r in got} == {0}
    assert {bytes(r.kept).decode() for r in got} == {text, text + "!"}


def test_cover_reaches_every_shift():
    gaps = {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert gaps == set(range(suffix_dedup.PERIOD))


def test_lines(docs, spark):
    report = {r.doc_id: r for r in lines.line_report(docs, min_docs=5).collect()}
    assert {k: r.n_dropped for k, r in report.items() if r.n_dropped} == dict.fromkeys((0, 2, 100, 105, 9, 10, 11, 12), 1)
    assert report[13].n_dropped == 0 and report[12].kept_sha256 == hashlib.sha256(b"").hexdigest()
    thinner = {r.doc_id: r.text for r in lines.without_shared_lines(docs).collect()}
    assert thinner[9] == prose(3, 40) and thinner[3] is None and thinner[12] == ""


def test_columns_whose_names_clash(spark):
    text = "the same long line in each and every document of this table"
    docs = spark.createDataFrame([(k, text, k, "x", "y", 1) for k in range(9)], "doc_id long, text string, keep int, `__keep` string, text_hash string, n_dropped int")
    thinner = lines.without_shared_lines(docs)
    assert thinner.columns == docs.columns and sorted(r.text for r in thinner.collect()) == [""] * 8 + [text]
    assert {(r.keep, r["__keep"], r.text_hash, r.n_dropped) for r in thinner.collect()} == {(k, "x", "y", 1) for k in range(9)}


def test_strings_whose_first_hashes_are_equal_are_told_apart():
    first, second = np.array([5, 3, 5, 5, 3], np.uint64), np.array([1, 2, 9, 1, 2], np.uint64)
    classes = suffix_dedup.Classes(first, second)
    assert classes.of[0] == classes.of[3] != classes.of[2] and classes.of[1] == classes.of[4] and len(classes.hashes) == 3
    assert classes.lowest(np.array([4, 7, 0, 2, 6])).tolist() == [6, 2, 0]


def test_no_table_is_left_behind(spark, docs):
    suffix_dedup.remove_repeats(docs).collect()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("staged_")]


def test_rows_without_an_id_do_not_share_a_range(spark):
    rows = spark.createDataFrame([(None, prose(k, 20), "a") for k in range(300)] + [(7, prose(900 + k, 20), "a") for k in range(300)], "doc_id long, text string, source string")
    assert mixing.sized(rows).select("range").distinct().count() > 300
    assert sum(r.taken for r in mixing.mix(rows).collect()) == 18_000


def test_a_line_that_spans_ranges(spark):
    text = "the same long line in each and every document of this table"
    crowd = spark.createDataFrame([(k, text) for k in range(500)], "doc_id long, text string").repartition(6)
    rows = lines.line_report(crowd).collect()
    assert sum(r.n_dropped for r in rows) == 499
    assert [r.doc_id for r in rows if not r.n_dropped] == [499]


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, **TOKENS, limit=256).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.row_id, []).append(r)
    assert len(by_doc) == docs.count()
    texts = dict(pairs(docs))
    for own in by_doc.values():
        own.sort(key=lambda r: r.piece)
        ids = np.array([*tokenizer.encode(texts[own[0].doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert sum(r.length for r in own) == len(ids) and all(r.length == 256 for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *(n for _, n in held)])[:-1].tolist() and sum(n for _, n in held) <= 256
    assert len(bins) <= 1.1 * sum(r.length for r in rows) / 256 + 1


@pytest.mark.parametrize("text", ["a  b", " lead", "trail ", "line\n next", "tab\t x", "don't stop", "x　y z", "<|endoftext|> a", "a <|endoftext|>\nb\n", "été naïve 12 34", "\x1c a b", "\n\nfoo", " a\nb c\n\nd  e\tf g", "it 's\n's b", "x\r\ny z", "a\u0085b c"])
def test_word_memo_equals_the_tokenizer(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    memo = packing.WordMemo(tokenizer)
    assert np.frombuffer(memo.text(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_equals_a_plain_walk_over_all_bins(docs):
    """Production's rule by brute force: the tightest of the open bins, and the fullest closes when there are too many."""
    rng = np.random.default_rng(8)
    for bins in (3, 20, 1000):
        lengths = rng.integers(1, 65, 400).tolist()
        open_, where, made = [], [], 0
        for n in lengths:
            fitting = [b for b in open_ if b[1] >= n]
            if fitting:
                found = min(fitting, key=lambda b: b[1])
            else:
                if len(open_) == bins:
                    open_.remove(min(open_, key=lambda b: b[1]))
                found = [made, 64]
                made += 1
                open_.append(found)
            found[1] -= n
            where.append(found[1])
            if not found[1]:
                open_.remove(found)
        number, at = packing.best_fit(lengths, 64, bins)
        assert [64 - a - n for a, n in zip(at, lengths, strict=True)] == where and max(number) + 1 == made


def test_special_tokens_and_equal_rows(spark):
    rows = spark.createDataFrame([(None, "a b")] * 400 + [(1, "x <|endoftext|> y")], "doc_id long, text string")
    got = packing.pack(rows, **TOKENS, limit=8, pieces_per_group=50).collect()
    assert len({r.row_id for r in got}) == 401
    groups = [n for _, n in sorted(__import__("collections").Counter(r.sequence_id >> 40 for r in got).items())]
    assert len(groups) == 9 and max(groups) < 100


def test_few_open_bins_close_the_fullest():
    where, at = packing.best_fit([6, 5, 4, 3, 2], 8, 2)
    # 6 and 5 open two bins; 4 fits neither, so the fuller one (6) closes; 3 joins 5, and 2 joins 4.
    assert (where, at) == ([0, 1, 2, 1, 2], [0, 0, 0, 5, 4])


def test_mix_reaches_its_targets(docs):
    rows = mixing.mix(docs).collect()
    by: dict = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, [0, r.target, r.source_size])[0] += r.taken
    assert all(abs(taken - target) <= 1 and target <= 2 * size + 1e-9 for taken, target, size in by.values())
    assert sum(t for _, t, _ in by.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    placed = [r.position for r in rows if r.position is not None]
    assert placed == sorted(placed) and all(0 <= p <= 1 for p in placed)


def test_schedules_invert(spark):
    for schedule in [*mixing.RAMPS, ((0.0, 0.0), (0.5, 2.0), (1.0, 1.0))]:
        shares = [0.0, 0.1, 0.5, 0.9, 1.0]
        got = spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.inverse_integral(schedule, F.col("s")).alias("t")).collect()
        fine = np.linspace(0, 1, 20_001)
        weight = np.interp(fine, *zip(*schedule, strict=True))
        area = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        want = np.interp(np.array(shares) * area[-1], area, fine)
        assert np.allclose([r.t for r in got], want, atol=2e-3)


def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=8)]) for k in range(300)]
    rows += [(300 + k, rows[0][1]) for k in range(40)]
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] + [0.0] * 7), (403, [None] + [0.0] * 7), (404, []), (405, [1.0]), (None, rows[1][1])]
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3), {i: np.array(v) for i, v in rows[:340]}


def test_exact_top_k(spark):
    table, good = vectors(spark)
    good = good | {401: np.zeros(8)}
    got = topk.top_k(table, F.col("vec_id") % 50 == 0, block_rows=64, query_rows=3, run_rows=130, slice_rows=4).collect()
    ints = {i: np.floor(v * 256).astype(int) for i, v in good.items()}
    want = []
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:5]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_bounds_hold_at_every_depth_and_cross_blocks():
    rng = np.random.default_rng(6)
    vectors, queries = np.floor(rng.normal(size=(500, 12)) * 256).astype(int), np.floor(rng.normal(size=(40, 12)) * 256).astype(int)
    vectors[100:140], queries[3] = vectors[0], 0
    lists = topk.SortedLists(np.arange(500), vectors)
    exact = (lists.vectors @ queries.T).astype(float)
    reader = topk._Reader(lists, queries.astype(float))
    for depth in (1, 50, 200, 300, 500):
        reader.read(depth)
        assert (reader.lower <= exact + 1e-6).all() and (reader.upper() >= exact - 1e-6).all()
    assert np.array_equal(reader.lower, exact)
    ids = np.arange(1000, 1040)
    got = topk.best_of_run(np.arange(500), vectors, ids, queries, 5, 128, 7)
    for c, (_, found, scores) in enumerate(got):
        best = np.lexsort((np.arange(500), -exact[:, c]))[:5]
        assert found.tolist() == best.tolist() and scores.tolist() == exact[best, c].astype(int).tolist()


def test_neighbours_recall_and_ties(spark):
    table, good = vectors(spark)
    got: dict = {}
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0, list_rows=20, probes=10, least_probes=6, group_lists=3, chunk_rows=15, ask_rows=4).collect():
        got.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q in (i for i in good if i % 20 == 0):
        best = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)[:20]
        own = sorted(got[q], key=lambda r: r.rank)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert all(r.score == pytest.approx(float(good[q] @ good[r.vec_id]), abs=1e-12) for r in own)
        hits += len({i for _, i in best} & {r.vec_id for r in own})
        total += 20
    assert hits / total >= 0.9


def test_vector_operators_ignore_clashing_columns_and_repeated_rows(spark):
    rng = np.random.default_rng(12)
    rows = [(k % 90, [float(x) for x in v], k, "x", 0.5, k) for k, v in enumerate(rng.normal(size=(90, 4)).round(2).repeat(2, axis=0)[:90])]
    table = spark.createDataFrame(rows * 2, "vec_id long, embedding array<double>, list int, vec string, score double, rank int").repartition(4)
    points = {r[0]: np.array(r[1]) for r in rows}
    near = neighbours.search(table, F.col("vec_id") % 20 == 0, k=3).collect()
    exact = topk.top_k(table, F.col("vec_id") % 20 == 0, k=3).collect()
    for got, score in ((near, lambda a, b: float(a @ b)), (exact, lambda a, b: int(np.floor(a * 256) @ np.floor(b * 256)))):
        for q in range(0, 90, 20):
            best = sorted((-score(points[q], v), i) for i, v in points.items() if i != q)[:3]
            assert [(i, pytest.approx(-s)) for s, i in best] == [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]


def test_languages_are_told_apart_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_signs_that_are_no_letters(spark):
    rows = [(0, "the little house of the town " * 9, "en", "x"), (1, "das kleine Haus in der Stadt ", "de", "x"), (4, "² ½ Ⅷ 12", "en", "x"), (5, "². a", None, "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = language.identify(docs).collect()
    assert len(got) == 12 and {r.lang_pred for r in got if r.doc_id == 4} == {"und"} and {r.lang_pred for r in got if r.doc_id == 5} <= {"en", "de"}


def test_models_learn_from_long_texts_alone_and_do_not_follow_the_files(spark):
    long = {"en": "the people of the old town walk by the river and talk with their friends ", "de": "die Leute der alten Stadt gehen am Fluss und reden mit ihren Freunden "}
    rows = [(k, long["en" if k % 2 else "de"] * 400 + str(k), "en" if k % 2 else "de") for k in range(40)] + [(None, long["en"], "en")] * 2 + [(7, long["en"], None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first, second = (sorted(map(tuple, language.identify(docs.repartition(n)).collect()), key=repr) for n in (2, 5))
    assert first == second and all(r[2] == ("en" if r[0] % 2 else "de") for r in first if r[0] is not None)
    one, two = (sorted(map(tuple, quality.classify(docs.repartition(n)).collect()), key=repr) for n in (2, 5))
    assert one == two and all(r[3] for r in one)


def test_quality_of_odd_rows(spark):
    junk = "AB$$ CD!! EFGH$$ IJ## KLM?? NOP!! QR%% STU$$ VW&& XYZ!! "
    rows = [(None, "the people of the old town walk by the river and they talk with friends in the evening", 1, 0.5)] * 30 + [(1, junk, 0, None)] * 20 + [(2, None, None, 0.1), (3, "", 1, 0.2), (4, " \n ", 1, 0.3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int, posterior double").repartition(3)
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {rows[0]} and kept.count() == 30
    got = quality.classify(docs).collect()
    assert len(got) == 53 and all(r.keep == (r.doc_id is None) for r in got) and {r.doc_id for r in got if r.quality is None} == {2, 3, 4}


def test_quality_scores_are_those_of_a_plain_computation():
    """The scorer by brute force: n-gram by n-gram, repeat by repeat."""
    texts = ["the old town", "AB$$ CD!! EFGH$$ IJ## KLM?? NOP!!", "été à la plage | a | b | c", "the the old old old town\n\nthe town\n  \nthe town\nthe town"]
    rng = np.random.default_rng(4)
    scorer = quality.Scorer(rng.normal(size=2**quality.BITS + 2), 0.3)
    from cuewise.llm.hashed import buckets

    for text, got in zip(texts, scorer.score(texts), strict=True):
        raw, held = b"\n" + text.encode() + b"\n", []
        for n in quality.GRAMS:
            grams = [raw[i : i + n] for i in range(len(raw) - n + 1)]
            held += [scorer.weight[buckets(np.frombuffer(g, np.uint8), n, quality.BITS)[0]] for g in grams if not any(c in b" \t\n\v\f\r" for c in g[1:-1])]
        words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
        same = sum(words[i] == words[i - 1] for i in range(1, len(words))) / len(words)
        seen = sum(lines[i] in lines[:i] for i in range(len(lines))) / len(lines)
        assert got == pytest.approx(1 / (1 + np.exp(-(np.mean(held) + quality.REPEATS * (same * scorer.weight[-2] + seen * scorer.weight[-1]) + 0.3))), rel=1e-9)


def test_language_of_odd_texts(docs):
    rows = {r.doc_id: r for r in language.identify(docs).collect()}
    assert {k for k, r in rows.items() if r.lang_pred == "und"} == {3, 4, 5}
    assert rows[0].held_out == (zlib.crc32(b"0") % 4 == 2)


def test_quality_keeps_clean_and_rejects_junk(spark):
    sf = SF.replace("0.001", "0.01")
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    kept = quality.kept_documents(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id")
    assert kept.join(good, "doc_id").count() >= 0.99 * good.count()
    bad = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").select("doc_id")
    assert kept.join(bad, "doc_id").count() <= 0.05 * bad.count()


def test_the_scorer_goes_beyond_the_votes(spark):
    """Junk that nobody voted on goes, and a false alarm stays: labellers teach and do not decide."""
    _, scorer = quality.fit(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"))
    clean = "The old house by the river that the people of the town like to walk to in the evening "
    junk = ["### %%% @@@ ***", "Th*** iner%%% #&&&", "&&&### ***@@@"]
    alarms = [clean + "when when the the rain rain is over.", clean + "| open all day | free | for all |", clean + "over!! and they?? stay"]
    assert all(set(quality.votes(t)) == {quality.NONE} for t in junk) and all(quality.BAD in quality.votes(t) for t in alarms)
    assert (scorer.score(junk) < 0.1).all() and (scorer.score(alarms) > 0.8).all()


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.8
    digits = np.full((len(truth), len(quality.LABELLERS)), quality.NONE)
    for k, right in enumerate((0.95, 0.9, 0.7), quality.ONE_SIDED):
        digits[:, k] = np.where(rng.random(len(truth)) < right, truth, ~truth)
    patterns, counts = np.unique(digits @ 3 ** np.arange(digits.shape[1]), return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float))
    assert model.prior == pytest.approx(0.8, abs=0.03)
    assert [model.rates[k, 1, 1] for k in range(quality.ONE_SIDED, quality.ONE_SIDED + 3)] == pytest.approx([0.95, 0.9, 0.7], abs=0.03)


def test_warc_round_trip(spark):
    html = "<html lang=en><head><title>A &amp; B</title><script>x()</script></head><body><!-- c --><p>One<br>two&#8211;three &copy;</p><a href='/u'>go</a></body></html>"
    pages = spark.createDataFrame([(1, "http://e.org/", html), (1, "http://e.org/", html), (2, None, None), (None, "u", "")], "page_id long, url string, html string")
    records = warc.derivatives(warc.responses(pages))
    rows = records.collect()
    assert len(rows) == 8
    text = {r.warc_type: r for r in rows if r.page_id == 1}
    assert text["conversion"].body == "A & B\nOne\ntwo–three ©\ngo"
    assert text["metadata"].body == "title: A & B\r\nlanguage: en\r\noutlink: /u\r\n"
    assert text["metadata"].concurrent_to == text["conversion"].record_id
    assert text["conversion"].refers_to == text["metadata"].refers_to
    parsed = list(warc.parse(b"".join(bytes(r.record) for r in warc.serialised(records).collect())))
    assert len(parsed) == 8
    for headers, block in parsed:
        assert headers["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        assert headers["WARC-Refers-To"].startswith("<urn:uuid:")


def test_warc_of_broken_pages(spark):
    """A page of a megabyte of tags that never close costs what other pages of its size do, and line ends do not end headers."""
    import time

    pages = [(1, "http://e.org/a\r\nX: y", "<title>One&#13;&#10;two</title><a href='/u&#10;v'>x</a>"), (2, "u", "<a " * 350_000), (3, "u", "<title>" * 150_000), (4, "u", "<script" * 150_000 + "<html " * 150_000), (5, "u", "<!--" * 250_000), (6, "u", "&" * 500_000)]
    began = time.time()
    records = warc.derivatives(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string")))
    rows = {(r.page_id, r.warc_type): r for r in records.collect()}
    assert len(rows) == 12 and time.time() - began < 60
    assert rows[1, "metadata"].body == "title: One two\r\noutlink: /u%0Av\r\n" and rows[1, "metadata"].target_uri == "http://e.org/a%0D%0AX: y"
    parsed = list(warc.parse(b"".join(bytes(r.record) for r in warc.serialised(records.where("page_id = 1")).collect())))
    assert len(parsed) == 2 and all("Content-Length" in h and "X" not in h for h, _ in parsed)


def test_empty_tables(spark, nothing):
    assert ngram_join.ngram_components(nothing).isEmpty()
    assert suffix_dedup.remove_repeats(nothing).isEmpty()
    assert lines.line_report(nothing).isEmpty()
    assert packing.pack(nothing, **TOKENS).isEmpty()
    assert mixing.mix(nothing).isEmpty()
    assert language.identify(nothing).isEmpty()
    assert quality.classify(nothing).isEmpty()
    vecs = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.search(vecs, F.col("vec_id") % 20 == 0).isEmpty()
    assert topk.top_k(vecs, F.col("vec_id") % 50 == 0).isEmpty()
    assert warc.derivatives(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))).isEmpty()
