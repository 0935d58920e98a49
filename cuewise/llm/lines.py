"""Dropping lines that many documents share.

Method: line hashes are range-partitioned with a secondary sort by document
(largest first) and position, so the first document of a hash is the one that
keeps its lines.  A task streams through its range holding no more than the
current hash's first few documents, and what comes back is a compressed keep
bitmap per document, never text.

Scale: the range key includes the document, so a line that a third of all
documents hold is cut over many tasks.  Only the first and last hash of a range
can reach into another one; their counts (two rows a partition) meet in one small
aggregate, whose size is bounded by the number of partitions, and that table alone
is broadcast.

Edge cases: a null or empty text is one empty line; rows without an id keep all
lines and do not count; rows of equal id are one document for counting, and equal
rows get equal bitmaps; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .staging import Staging, parts

BLANK = " \t\n\v\f\r"
_DROP, _EDGE, _COUNT = 0, 1, 2
#: Partitions up to which the table of their first and last hashes, two rows of 40 bytes each, is broadcast.
BROADCAST_PARTS = 100_000
_STREAMED = "kind int, hi long, lo long, doc_id long, text_hash long, pos int, n_docs long, first boolean"


def line_key(line: str) -> str:
    """A line as compared: stripped at both ends, A-Z in lower case."""
    line = line.strip(BLANK)
    return line.lower() if line.isascii() else line.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each line whose key has ``min_chars`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, positions, digests = [], [], []
            for i, text in enumerate(batch.column(2)):
                for pos, line in enumerate((text.as_py() or "").split("\n")):
                    if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                        at.append(i)
                        positions.append(pos)
                        digests.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass")))
            pairs = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(positions, pa.int32())], names=["hi", "lo", "doc_id", "text_hash", "pos"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "hi long, lo long, doc_id long, text_hash long, pos int")


class _Range:
    """Streams one sorted range; see ``_STREAMED`` for the rows it puts out."""

    def __init__(self, min_docs: int):
        self.min_docs, self.key, self.leading, self.out = min_docs, None, True, []

    def end(self, last: bool) -> None:
        """Close the current hash; a range's first and last hash leave their counts."""
        if self.key is None:
            return
        if self.leading or last:
            self.out.append((_COUNT, *self.key, self.top, 0, 0, self.n_docs, False))
            self.out += [(_EDGE, *self.key, *row, self.n_docs, False) for row in self.held]
        self.leading = False

    def add(self, key: tuple[int, int], row: tuple[int, int, int]) -> None:
        if key != self.key:
            self.end(False)
            self.key, self.top, self.doc, self.n_docs, self.held = key, row[0], None, 0, []
        if row[0] != self.doc:
            self.doc = row[0]
            self.n_docs += 1
            if self.n_docs == self.min_docs and not self.leading:
                self.out += [(_DROP, *self.key, *r, 0, False) for r in self.held if r[0] != self.top]
                self.held = []
        if self.leading:
            self.out.append((_EDGE, *self.key, *row, 0, False))
        elif self.n_docs < self.min_docs:
            self.held.append(row)
        elif row[0] != self.top:
            self.out.append((_DROP, *self.key, *row, 0, False))


def dropped_lines(lines: DataFrame, *, min_docs: int, staging: Staging) -> DataFrame:
    """(doc_id, text_hash, pos) of the lines that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Range(min_docs)
        for batch in batches:
            for hi, lo, doc, text_hash, pos in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stream.add((hi, lo), (doc, text_hash, pos))
            yield _record(stream)
        stream.end(True)
        yield _record(stream)

    def _record(stream: _Range) -> pa.RecordBatch:
        rows, stream.out = stream.out, []
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["kind", "hi", "lo", "doc_id", "text_hash", "pos", "n_docs", "first"])

    ranged = lines.repartitionByRange(parts(lines.sparkSession), "hi", "lo", F.desc("doc_id"))
    streamed = staging.write(ranged.sortWithinPartitions("hi", "lo", F.desc("doc_id"), "pos").mapInArrow(run, _STREAMED), "streamed")
    # At most two rows a partition.
    bounded = parts(lines.sparkSession) <= BROADCAST_PARTS
    shared = streamed.where(F.col("kind") == _COUNT).groupBy("hi", "lo").agg(F.sum("n_docs").alias("docs"), F.max("doc_id").alias("top")).where(F.col("docs") >= min_docs)
    edges = streamed.where(F.col("kind") == _EDGE).join(F.broadcast(shared) if bounded else shared, ["hi", "lo"]).where(F.col("doc_id") != F.col("top"))
    columns = ("doc_id", "text_hash", "pos")
    return streamed.where(F.col("kind") == _DROP).select(*columns).unionByName(edges.select(*columns))


def keep_bitmaps(docs: DataFrame, *, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """Bitmaps of documents that lose lines: doc_id, text_hash (of the text), n_dropped, keep.

    ``keep`` is a deflated bitmap, one bit a line up to the last dropped one or some more, set
    for lines that stay; later lines stay.
    """
    staging = Staging(docs.sparkSession, "lines")
    dropped = dropped_lines(line_hashes(docs, min_chars), min_docs=min_docs, staging=staging)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keeps = []
            for positions in batch.column(2):
                at = positions.values.to_numpy()
                bits = np.ones(8 * (at.max() // 8 + 1), bool)
                bits[at] = False
                keeps.append(zlib.compress(np.packbits(bits).tobytes()))
            counts = pa.compute.list_value_length(batch.column(2)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, pa.array(keeps, pa.binary())], names=["doc_id", "text_hash", "n_dropped", "keep"])

    import pyarrow.compute  # noqa: F401  (pa.compute)

    # A set: rows that repeat as a whole give the same positions.  Its size is bounded by the document's lines.
    grouped = dropped.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("positions"))
    return grouped.mapInArrow(run, "doc_id long, text_hash long, n_dropped long, keep binary")


def apply_keep(text: str, keep: bytes | None) -> str:
    """The text without the lines that its bitmap drops."""
    if keep is None:
        return text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    lines = text.split("\n")
    return "\n".join(line for i, line in enumerate(lines) if i >= len(bits) or bits[i])


def with_keep(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ..., then ``keep`` (null: all lines stay) and ``n_dropped``."""
    text, doc = (f"c{docs.columns.index(c)}" for c in ("text", "doc_id"))
    hashed = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).withColumn("own_hash", F.xxhash64(text))
    joined = hashed.join(bitmaps, (F.col(doc).cast("long") == F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")), "left")
    return joined.withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0)).cast("long")).drop("own_hash", "doc_id", "text_hash")


def line_report(docs: DataFrame, *, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 of the text that stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, digests = [], []
            for text, keep in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py() or ""
                lines.append(text.count("\n") + 1)
                digests.append(hashlib.sha256(apply_keep(text, keep).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), batch.column(3), pa.array(digests)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    joined = with_keep(docs.select("doc_id", "text"), keep_bitmaps(docs, min_docs=min_docs, min_chars=min_chars))
    return joined.select(F.col("c0").cast("long"), "c1", "keep", "n_dropped").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def without_shared_lines(docs: DataFrame, *, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """``docs`` with the shared lines gone from ``text``; a null text stays null."""

    @F.pandas_udf("string")
    def kept(text, keep):
        return text.combine(keep, lambda t, k: None if t is None else apply_keep(t, k))

    joined = with_keep(docs, keep_bitmaps(docs, min_docs=min_docs, min_chars=min_chars))
    text = f"c{docs.columns.index('text')}"
    thinner = joined.withColumn(text, F.when(F.col("keep").isNull(), F.col(text)).otherwise(kept(text, "keep")))
    return thinner.drop("keep", "n_dropped").toDF(*docs.columns)
