"""What a review found missing, one test a finding."""

import numpy as np
from pyspark.sql import functions as F

from cuewise.llm import language, neighbours, quality, warc


def isotropic(spark, n: int, width: int = 64, seed: int = 9):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, width))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(points)], "vec_id long, embedding array<double>").repartition(4), points


def recall(rows, points, queries, k: int = 20) -> float:
    got: dict = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    scores = points[queries] @ points.T
    scores[np.arange(len(queries)), queries] = -np.inf
    return float(np.mean([len(got[q] & set(np.argsort(-row)[:k].tolist())) / k for q, row in zip(queries, scores, strict=True)]))


def test_neighbours_are_found_where_lists_are_many_times_the_probes(spark):
    table, points = isotropic(spark, 3000)
    rows = neighbours.search(table, F.col("vec_id") % 60 == 0, list_rows=15, probes=10, least_probes=5).collect()
    assert recall(rows, points, list(range(0, 3000, 60))) >= 0.95


def test_the_scorer_decides_where_nobody_voted(spark):
    """Short clean texts in a corpus of mostly junk do not go with the prior."""
    clean = "the small house of the old town is by the river and the people like to walk there in the evening with friends " * 2
    junk = "AB$$ CD!! EFGH$$ IJ## KLM?? NOP!! QR%% STU$$ VW&& XYZ!! BCD$$ EFG## HIJ!! "
    rows = [(k, clean + "so they say") for k in range(60)] + [(100 + k, junk) for k in range(540)]
    rows += [(1000, "the people walk by the river"), (1001, "the old town is small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {quality.NONE} == set(quality.votes(rows[-1][1])) == set(quality.votes(rows[-2][1]))
    kept = {r.doc_id for r in quality.classify(docs).where("keep").collect()}
    assert {1000, 1001} <= kept and not kept & set(range(100, 640))


def test_clean_texts_of_other_scripts_and_languages_get_no_bad_vote():
    hindi = "यह एक छोटा सा घर है जो नदी के किनारे पर बना हुआ है और लोग शाम को वहाँ टहलने जाते हैं। " * 4
    thai = "ภาษาไทยเป็นภาษาที่มีระดับเสียงของคำแน่นอน ทำให้การเขียนภาษาไทยต้องมีรูปวรรณยุกต์ " * 12
    polish = "Mały dom stoi nad rzeką, a ludzie chodzą tam wieczorem ze swoimi przyjaciółmi i rozmawiają o pogodzie. " * 4
    quotes = "“Yes” — she said — “it’s the old town’s house”… " * 8
    for text in (hindi, thai, polish, quotes):
        assert quality.BAD not in quality.votes(text), text[:20]
    assert quality.votes("Thnd*** iner%%% ther&&& ththsh$$$ ountin### " * 8)[0] == quality.BAD


def test_a_labeller_that_errs_is_found_out():
    """A fault vote that comes with good votes only is learnt to be a false alarm."""
    def digits(*own):
        return sum(v * 3**k for k, v in enumerate(own))

    n, g, b = quality.NONE, quality.GOOD, quality.BAD
    alarm, clean, junk = digits(b, n, n, n, n, n, g, g, g), digits(n, n, n, n, n, n, g, g, g), digits(n, b, b, n, n, n, n, n, b)
    model = quality.fit_labels(np.array([alarm, clean, junk]), np.array([2000.0, 6000.0, 1500.0]))
    assert model.posterior(np.array([alarm]))[0] > 0.8 and model.posterior(np.array([junk]))[0] < 0.2


def test_a_rare_language_and_one_of_long_texts_are_learnt(spark):
    def text(letters, k, words):
        rng = np.random.default_rng(k)
        return " ".join("".join(rng.choice(list(letters), 5)) for _ in range(words))

    rows = [(k, text("abcdefg", k, 12), "aa") for k in range(3000)] + [(5000 + k, text("hijklmn", k, 12), "bb") for k in range(24)] + [(6000 + k, text("opqrstu", k, 400), "cc") for k in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = language.training_sample(docs, F.lit(True), train_rows=300, train_chars=500)
    assert langs.count("bb") == langs.count("cc") == 24 and len(langs) <= 300
    assert max(map(len, texts)) <= 500
    got = language.identify(docs, train_rows=300, train_chars=500).collect()
    want = {k: lang for k, _, lang in rows}
    assert all(np.mean([r.lang_pred == x for r in got if want[r.doc_id] == x]) > 0.8 for x in ("aa", "bb", "cc"))


def test_all_references_are_decoded_and_links_are_those_of_the_page(spark):
    page = "<title>caf&eacute; &rsquo;&NotEqualTilde;</title><!-- <a href='/no'>x</a> --><script>'<a href=/no2>'</script><noscript><a href=/yes></noscript><p>&uuml;&ntilde; &amp;eacute; &#38;lt; &nosuch; &copy 1 a&b</p><a href='/a?x=1&amp;y=2&copy=3'>go</a>"
    rows = {r.warc_type: r.body for r in warc.derivatives(warc.responses(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"))).collect()}
    assert rows["conversion"].endswith("üñ &eacute; &lt; &nosuch; © 1 a&b\ngo")
    assert rows["metadata"] == "title: café ’≂̸\r\noutlink: /yes\r\noutlink: /a?x=1&y=2&copy=3\r\n"


def clustered(n: int, width: int, clusters: int, seed: int = 2) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    points = centres[rng.integers(0, clusters, n)] + 0.4 * rng.normal(size=(n, width)) * rng.choice([0.3, 1, 2], n)[:, None]
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def test_the_distance_ratio_selects_lists():
    """Where vectors have clusters, a query reads few of the lists that the hardest ones need, and still finds its neighbours."""
    points = clustered(12_000, 32, 80)
    lifted = neighbours.lifted(points, 1.0)
    graph = neighbours.Graph.build(neighbours.centroid_tree(lifted, 240))
    home = neighbours.closures(graph.centroids, lifted, 4, 1.15)
    asked = np.concatenate([points, np.zeros((len(points), 1))], axis=1)

    def true(queries):
        scores = points[queries] @ points.T
        scores[np.arange(len(queries)), queries] = -np.inf
        return [(i, [home[v] for v in row]) for i, row in enumerate(np.argsort(-scores, axis=1)[:, :20])]

    tried, others = np.arange(0, 12_000, 120), np.arange(7, 12_000, 120)
    needed = neighbours.lists_needed(graph, asked[tried], true(tried), 0.96)
    most, ratio, mean = neighbours.pruning(graph, asked[tried], true(tried), 0.96, needed)
    assert mean < 0.7 * needed and most >= needed
    found = []
    for i, own in true(others):
        near, d = graph.nearest(asked[others[i]], most)
        read = set(near[d <= ratio**2 * d[0]].tolist())
        found.append(np.mean([not read.isdisjoint(lists) for lists in own]))
    assert np.mean(found) >= 0.92


def test_pruning_reads_no_more_than_is_needed():
    rng = np.random.default_rng(6)
    points = rng.normal(size=(3000, 16))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    lifted = neighbours.lifted(points, 1.0)
    graph = neighbours.Graph.build(neighbours.centroid_tree(lifted, 60))
    home = neighbours.closures(graph.centroids, lifted, 4, 1.15)
    own = [(i, [home[v] for v in np.argsort(-(points[i] @ points.T))[1:21]]) for i in range(50)]
    needed = neighbours.lists_needed(graph, lifted[:50], own, 0.96)
    most, ratio, mean = neighbours.pruning(graph, lifted[:50], own, 0.96, needed)
    assert mean <= needed <= most


def test_vectors_are_placed_alike_however_many_are_compared_at_a_time(monkeypatch):
    points = clustered(700, 8, 10)
    lifted = neighbours.lifted(points, 1.0)
    centroids = neighbours.centroid_tree(lifted, 50)
    whole = neighbours.closures(centroids, lifted, 4, 1.15)
    monkeypatch.setattr(neighbours, "_COMPARED", 1000)
    assert neighbours.closures(centroids, lifted, 4, 1.15) == whole


def recall_of(spark, points):
    """(mean recall, of the worse half of queries, rows found) against brute force."""
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>").repartition(4)
    got: dict = {}
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0, list_rows=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = []
    for q in range(0, len(points), 20):
        scores = points @ points[q]
        scores[q] = -np.inf
        found.append(len(got.get(q, set()) & set(np.argsort(-scores, kind="stable")[:20].tolist())) / 20)
    return np.mean(found), np.mean(np.sort(found)[: len(found) // 2]), sum(map(len, got.values()))


def test_one_very_long_vector_does_not_blur_the_others(spark):
    points = np.random.default_rng(8).normal(size=(1500, 24))
    points[7] *= 1e9
    mean, _, rows = recall_of(spark, points)
    assert mean >= 0.93 and rows == 75 * 20


def test_easy_queries_do_not_hide_those_that_find_little(spark):
    """Two of three vectors are nearly the same; their queries find all in any case."""
    rng = np.random.default_rng(9)
    points = rng.normal(size=(3000, 24))
    points[1000:] = points[0] + 1e-6 * rng.normal(size=(2000, 24))
    points = points[rng.permutation(3000)]
    mean, worse, _ = recall_of(spark, points)
    assert mean >= 0.93 and worse >= 0.9


def test_equal_points_end_the_tree():
    assert len(neighbours.centroid_tree(np.ones((500, 8)), 100)) == 1
