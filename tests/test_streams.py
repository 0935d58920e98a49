"""The whole segment rule on a replayed stream."""

import datetime as dt
import os

import pytest

from cuewise.operators import folds
from cuewise.plans import fold_queries as Q
from cuewise.streaming import sessions

from .against import SF

SCHEMA = "doc_id long, pos long, at timestamp, word string, start double, end double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BEGIN = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def replayed(spark, tmp_path, batches, **how):
    """What the stream of batches gives; two far-off words at the end bring the clock past all that waits."""
    far = [[(-1, k, BEGIN + dt.timedelta(days=30 + k), "end", 0.0, 0.1)] for k in range(2)]
    stamp = 1_700_000_000
    for k, rows in enumerate([*batches, *far]):
        path = tmp_path / "in" / f"batch-{k:03d}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(path))
        for file in path.glob("*.parquet"):
            target = tmp_path / "words" / f"{k:03d}.parquet"
            target.parent.mkdir(exist_ok=True)
            file.rename(target)
            os.utime(target, (stamp + k, stamp + k))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "words"))
    out, name = sessions.stream_segments(stream, "doc_id", **how), f"segments_{abs(hash(str(tmp_path)))}"
    query = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.table(name).where("doc_id >= 0").collect()


def word(doc, pos, text, start, end):
    return doc, pos, BEGIN + dt.timedelta(seconds=start), text, start, end


def test_a_replayed_table_gives_the_batch_segments(rocks, tmp_path):
    words = Q._words(rocks, SF).where("doc_id < 25")
    rows = [word(r.doc_id, r.word_pos, r.word, r.start, r.end) for r in words.orderBy("doc_id", "word_pos").collect()]
    # Each document in five batches, in the order of its words.
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r[0], []).append(r)
    batches = [[r for own in by_doc.values() for r in own[len(own) * k // 5 : len(own) * (k + 1) // 5]] for k in range(5)]
    got = replayed(rocks, tmp_path, batches, late="30 days", idle=3600.0)
    want = folds.segments(words, "doc_id", "word_pos").collect()
    assert not any(r.late for r in got)
    assert sorted((r.doc_id, r.segment, r.start, r.end, r.words) for r in got) == sorted((r.doc_id, r.segment, r.start, r.end, r.words) for r in want)


def test_late_words_are_told(rocks, tmp_path):
    batches = [
        [word(1, 0, "one", 0.0, 0.2), word(1, 1, "two", 0.3, 0.5), word(1, 3, "four.", 0.9, 1.1), word(1, 4, "five", 1.2, 1.4)],
        [word(1, 2, "three", 0.6, 0.8), word(1, 5, "", 1.5, 1.5), word(2, 7, "alone", 3.0, 3.1)],
        [word(1, 6, "six", 4.0, 4.2)],
    ]
    got = sorted(((r.doc_id, r.segment, r.words, r.late) for r in replayed(rocks, tmp_path, batches, late="1 day", idle=60.0)), key=str)
    assert got == sorted([(1, 0, ["one", "two"], False), (1, None, ["three"], True), (1, 1, ["four."], False), (1, 2, ["five", "six"], False), (2, 0, ["alone"], False)], key=str)


def test_an_idle_episode_is_closed_and_may_go_on(rocks, tmp_path):
    later = BEGIN + dt.timedelta(hours=5)
    batches = [[word(1, 0, "one", 0.0, 0.2)], [(2, 0, later, "clock", 0.0, 0.1)], [(2, 1, later, "clock", 0.1, 0.2)], [(1, 1, later, "two", 0.3, 0.4)]]
    got = sorted((r.doc_id, r.segment, r.words) for r in replayed(rocks, tmp_path, batches, late="10 minutes", idle=60.0))
    assert got == [(1, 0, ["one"]), (1, 1, ["two"]), (2, 0, ["clock", "clock"])]
