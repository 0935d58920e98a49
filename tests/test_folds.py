"""Recurrences as streams: equal to looking at a whole episode, and holding little of it."""

import random

import pytest

from cuewise.operators import folds


def shrunk(tokens: list[str], repeats: int = 3, longest: int = 8) -> list[int]:
    """Loops by looking at the whole list from each place."""
    out, i, n = [], 0, len(tokens)
    while i < n:
        for size in range(min(longest, (n - i) // 2), 0, -1):
            pattern, copies = tokens[i : i + size], 1
            while tokens[i + copies * size : i + (copies + 1) * size] == pattern:
                copies += 1
            if any(pattern) and copies >= (3 if size >= 3 else repeats + 1):
                out += range(i, i + size)
                i += copies * size
                break
        else:
            out.append(i)
            i += 1
    return out


def test_loops_are_those_of_the_whole_list():
    r = random.Random(4)
    for _ in range(4000):
        signs = ["a", "b", "", "c"][: r.randrange(1, 5)]
        tokens = [r.choice(signs) for _ in range(r.randrange(0, 60))]
        at, pattern = r.randrange(len(tokens) + 1), [r.choice([*signs, "x"]) for _ in range(r.randrange(1, 10))]
        tokens[at:at] = pattern * r.randrange(0, 8)
        assert folds.without_loops(tokens) == shrunk(tokens)


@pytest.mark.parametrize("n", [0, 1, 500, 100_000])
def test_a_loop_of_any_length_is_read_once_and_not_held(n, monkeypatch):
    read = 0

    def words():
        nonlocal read
        for k in range(n):
            read += 1
            yield k, "abc"[k % 3]

    kept = []
    for row in folds.loop_free(words(), lambda r: r[1]):
        kept.append(row)
        assert read <= folds._AHEAD or read == n
    # Twice three is the longest pattern that repeats; what is left of a copy stays.
    assert read == n and len(kept) == (6 + n % 6 if n >= 18 else n)


def test_a_long_text_is_not_held_ahead():
    read = 0

    def words():
        nonlocal read
        for k in range(20_000):
            read += 1
            yield k, str(k % 977)

    for given, _ in enumerate(folds.loop_free(words(), lambda r: r[1])):
        assert read - given <= 2 * folds._AHEAD


def test_chunks_are_closed_as_cues_come():
    read = 0
    r = random.Random(7)

    def cues():
        nonlocal read
        at = 0.0
        for _ in range(5000):
            read += 1
            at += 1.0 + r.choice([0.0, 0.5, 2.5])
            yield at, at + 0.9, r.choice(["so", "so.", "但是", "end?"])

    sizes, size = [], 0
    for given, ends in enumerate(folds.chunk_ends(cues(), 80)):
        size += 1
        assert read - given <= 106
        if ends:
            sizes.append(size)
            size = 0
    assert size == 0 and sum(sizes) == 5000 and all(56 < s <= 104 for s in sizes[:-1]) and sizes[-1] <= 104


def shuffles(rows) -> int:
    return rows._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_words_and_segments_stay_where_their_documents_are(spark):
    """Lines are dealt once; neither words nor segments are shuffled or put in windows behind that."""
    from cuewise.plans import fold_queries as Q

    sf = "/root/testdata/sf0.001"
    for name in ("segment_words", "suppress_loops"):
        assert shuffles(Q.QUERIES[name](spark, sf)) == 1
    assert Q._words(spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_events_of_one_millisecond_follow_each_other_by_id(spark, tmp_path):
    """Whatever order the rows are read in; values differ, so the order decides the gaps' classes."""
    import datetime

    from cuewise.plans import timeline_queries as T

    at = datetime.datetime(2024, 1, 1)
    rows = [(k, at + datetime.timedelta(seconds=3 * (k // 4)), 1, [0.5, 2.9, 3.0, 9.0][k % 4]) for k in range(40)]
    found = []
    for name, given in (("up", rows), ("down", rows[::-1])):
        spark.createDataFrame(given, "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/{name}/events.parquet")
        found.append(T.event_overlaps(spark, f"{tmp_path}/{name}").collect())
    assert found[0] == found[1] and found[0][0].overlap_gaps == 39


def test_event_times_are_the_nearest_milliseconds(spark, tmp_path):
    """Of times with microseconds, before 1970 too, gaps are those of SQL; each user has one gap next to a limit."""
    import datetime

    import duckdb

    from cuewise.plans import timeline_queries as T

    rows = []
    for user, (year, first, second, value) in enumerate((y, a, b, v) for y in (1960, 2024) for a in (0, 499, 500, 999) for b in (0, 499, 500, 501) for v in (1.8, 1.999, 2.0, 2.001, 2.002)):
        at = datetime.datetime(year, 1, 1)
        rows += [(2 * user, at + datetime.timedelta(microseconds=first), user, value), (2 * user + 1, at + datetime.timedelta(seconds=2, microseconds=second), user, 0.0)]
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, value FROM '{path}/*.parquet'")
    found = T.event_overlaps(spark, str(tmp_path)).select("user_id", "overlap_gaps", "zero_gaps", "micro_gaps", "normal_gaps").collect()
    assert sorted(map(tuple, found)) == sorted(con.execute(T.ORACLES["event_overlaps"]).fetchall())
