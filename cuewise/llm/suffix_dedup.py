"""Removing byte strings that earlier documents hold, by blockwise suffix sorting.

Method: difference-cover blockwise construction.  Positions whose place in their
document, modulo 13, lies in a difference cover are samples; any two positions
reach sampled ones at one common distance below 13.  Samples are classed by the 38
bytes that follow them (their ranks), one bucket of the hash range at a time.  Two
equal strings of 50 bytes therefore hold equal samples at the same place, and a
suffix that reaches no sample whose class spans documents cannot be repeated:
ties that long are decided by the cover's classes alone, and only the remaining
suffixes are sorted, again a bucket at a time, by their 50 bytes.  The contract
needs classes of equal strings and not their order, so buckets are ranges of a hash
rather than of the bytes: bytes of every suffix, or even of the cover's alone, are many times the input.
Strings are equal if their bucket and 88 more bits of two hashes are; the one with the smallest document wins its class.

Scale: texts that copy a smaller document as a whole go first, by digest.  The rest is
read into a table of blocks (a few MB each), bucketed so that joining it with
what comes back moves no text.  What is shuffled are hashes, packed by block and
bucket, and bits come back in the same order; a bucket is a fixed amount of
them, so a task's memory does not grow with the input.  Within a block equal
strings are brought together first: of a passage that a third of the documents
hold, a block sends each string once.

Edge cases: a null text has no bytes; documents shorter than the string length
lose nothing; rows of equal id never remove from each other; a row without an id
neither removes nor loses; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shingles import mixed
from .staging import Staging, parts

#: Residues whose differences give every residue modulo the period.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Bytes of text in a block, and bytes of input that one bucket stands for.
BLOCK, BUCKET = 4_000_000, 3_200_000
_U64 = np.uint64


def _tables(seed: int) -> tuple[np.ndarray, list]:
    """Random values of bytes, and odd factors."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, 256, dtype=_U64), [_U64(int(x) | 1) for x in rng.integers(0, 2**64, 8, dtype=_U64)]


#: Two independent hashes.
_HASHES = (_tables(7), _tables(8))
_SPAN = 1 << 16
_BLOCKS = "block long, ids binary, lens binary, data binary"


def blocks(docs: DataFrame) -> DataFrame:
    """Documents with an id, joined to blocks of bytes."""

    def record(block: int, ids: list, raw: list) -> pa.RecordBatch:
        packed = (np.array(ids, np.int64).tobytes(), np.array([len(r) for r in raw], np.int64).tobytes(), b"".join(raw))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([p], pa.binary()) for p in packed)], names=["block", "ids", "lens", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, raw, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                raw.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(raw[-1])
                if size >= BLOCK:
                    yield record(block, ids, raw)
                    block, ids, raw, size = block + 1, [], [], 0
        if ids:
            yield record(block, ids, raw)

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _BLOCKS)


class Block:
    """One block's bytes, with hashes of its strings."""

    def __init__(self, ids: bytes, lens: bytes, data: bytes, length: int):
        self.ids, self.lens = np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int64)
        self.data, self.length = np.frombuffer(data, np.uint8), length
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def hashes(self, width: int, at: np.ndarray, which: int = 0) -> np.ndarray:
        """64-bit hashes of the ``width`` bytes from each position ``at``, in rising order."""
        of_byte, factors = _HASHES[which]
        out, cuts = np.empty(len(at), _U64), np.arange(0, len(self.data) + _SPAN, _SPAN)
        ends = np.searchsorted(at, cuts)
        for low, a, b in zip(cuts.tolist(), ends.tolist(), ends[1:].tolist(), strict=False):
            if a < b:  # a span at a time, so that the arrays stay in the processor's cache
                h, have = of_byte[self.data[low : low + _SPAN + width]], 1
                while have * 2 <= width:
                    h = h[:-have] * factors[have.bit_length()] + h[have:]
                    have *= 2
                own = at[a:b] - low
                out[a:b] = mixed(h[own] * factors[0] + h[own + (width - have)])
        return out

    def samples(self) -> np.ndarray:
        """Positions of the cover from which enough bytes follow."""
        width = self.length - PERIOD + 1
        out = []
        for start, size in zip(self.starts.tolist(), self.lens.tolist(), strict=True):
            if size >= self.length:
                places = (np.arange(0, size - width + 1, PERIOD)[:, None] + np.array(COVER)).ravel()
                out.append(places[places <= size - width] + start)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of whole strings that reach a repeated sample below the period."""
        marks = np.zeros(len(self.data) + PERIOD + 1, np.int32)
        marks[repeated + 1] = 1
        reach = np.cumsum(marks, out=marks)
        near = reach[PERIOD : PERIOD + len(self.data)] > reach[: len(self.data)]
        for start, end in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            near[max(start, end - self.length + 1) : end] = False
        return np.flatnonzero(near)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets as ranges of the hash."""
    return ((hashes >> _U64(32)) * _U64(n) >> _U64(32)).astype(np.int64)


class Classes:
    """Equal hashes of a block brought together, in hash order; ``of``: each place's class.

    With a ``second`` hash strings are equal where both are.
    """

    def __init__(self, hashes: np.ndarray, second: np.ndarray | None = None):
        order = np.argsort(hashes)
        new = self._new(hashes[order])
        if second is not None:
            both = new | self._new(second[order])
            if (both != new).any():  # strings that differ share a first hash
                order = np.lexsort((second, hashes))
                both = self._new(hashes[order]) | self._new(second[order])
            new = both
            self.second = second[order][new]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.begin = np.flatnonzero(new)
        self.order, self.hashes = order, hashes[order][new]

    @staticmethod
    def _new(ranked: np.ndarray) -> np.ndarray:
        return np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)

    def lowest(self, values: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(values[self.order], self.begin) if len(self.begin) else values[:0]

    def highest(self, values: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(values[self.order], self.begin) if len(self.begin) else values[:0]


def _cuts(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each bucket begins among hashes in order."""
    return np.searchsorted(bucket_of(hashes, n), np.arange(n + 1))


_SAMPLES = "bucket int, block long, keys binary, several binary"
_STRINGS = "bucket int, block long, keys binary, docs binary"
_BITS = "block long, bucket int, bits binary"


def _record(rows: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _each_block(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[int, Block, list[dict[int, bytes]]]]:
    """Blocks with the bits that came back for them, by bucket."""
    for batch in batches:
        for k in range(batch.num_rows):
            block, ids, lens, data, *bits = (c[k].as_py() for c in batch.columns)
            yield block, Block(ids, lens, data, length), [{b["bucket"]: b["bits"] for b in found or ()} for found in bits]


def _unpacked(classes: Classes, bits: dict[int, bytes], n: int, order: np.ndarray | None = None) -> np.ndarray:
    """A flag for each class; ``order``: of the classes when they were sent, hash order if not given."""
    cuts = _cuts(classes.hashes, n)
    out = np.zeros(len(classes.hashes), bool)
    for bucket, packed in bits.items():
        a, b = cuts[bucket], cuts[bucket + 1]
        out[a:b] = np.unpackbits(np.frombuffer(packed, np.uint8), count=b - a)
    if order is None:
        return out
    flags = np.empty_like(out)
    flags[order] = out
    return flags


def _by_owner(classes: Classes, owner: np.ndarray, n: int) -> np.ndarray:
    """Classes by bucket, and in a bucket by document."""
    rank = np.unique(owner, return_inverse=True)[1]
    return np.argsort((bucket_of(classes.hashes, n) << 32) + rank, kind="stable")


def sample_keys(table: DataFrame, n: int, length: int) -> DataFrame:
    """The classes of each block's samples, by bucket: 32 bits of hash and whether several documents share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, _ in _each_block(batches, length):
            at = block.samples()
            classes, docs = Classes(block.hashes(length - PERIOD + 1, at)) if len(at) else Classes(np.zeros(0, _U64)), block.doc_of(at)
            several = classes.lowest(docs) != classes.highest(docs)
            keys, cuts = classes.hashes.astype(np.uint32), _cuts(classes.hashes, n)
            rows = [(k, number, keys[a:b].tobytes(), np.packbits(several[a:b]).tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
            yield _record(rows, ["bucket", "block", "keys", "several"], (pa.int32(), pa.int64(), pa.binary(), pa.binary()))

    return table.mapInArrow(run, _SAMPLES)


def repeated_samples(keys: DataFrame, n: int) -> DataFrame:
    """One bucket at a time: bits of the classes that several blocks or several documents of a block hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if not rows:
            return
        sizes = [len(r[2]) // 4 for r in rows]
        found = np.frombuffer(b"".join(r[2] for r in rows), np.uint32)
        ranked = np.sort(found)
        again = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        flags, seen = np.zeros(len(found), bool), np.zeros(1 << 22, bool)
        seen[again & np.uint32((1 << 22) - 1)] = True
        likely = np.flatnonzero(seen[found & np.uint32((1 << 22) - 1)])
        if len(again):
            flags[likely] = again[np.minimum(np.searchsorted(again, found[likely]), len(again) - 1)] == found[likely]
        out, at = [], 0
        for (bucket, block, _, several), size in zip(rows, sizes, strict=True):
            own = flags[at : at + size] | np.unpackbits(np.frombuffer(several, np.uint8), count=size).astype(bool)
            out.append((block, bucket, np.packbits(own).tobytes()))
            at += size
        yield _record(out, ["block", "bucket", "bits"], (pa.int64(), pa.int32(), pa.binary()))

    return keys.repartitionById(n, F.col("bucket")).mapInArrow(run, _BITS)


def _strings(block: Block, sample_bits: dict[int, bytes], n: int) -> tuple[np.ndarray, Classes]:
    """Starts of the strings that may be repeated, and their classes."""
    at = block.samples()
    if not len(at) or not sample_bits:
        return np.zeros(0, np.int64), Classes(np.zeros(0, _U64), np.zeros(0, _U64))
    classes = Classes(block.hashes(block.length - PERIOD + 1, at))
    starts = block.candidates(at[_unpacked(classes, sample_bits, n)[classes.of]])
    return starts, Classes(block.hashes(block.length, starts), block.hashes(block.length, starts, 1))


def string_keys(table: DataFrame, n: int, length: int) -> DataFrame:
    """The classes of each block's remaining strings, by bucket: 56 and 32 bits of their hashes and the block's smallest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, (bits,) in _each_block(batches, length):
            starts, classes = _strings(block, bits, n)
            owner = classes.lowest(block.ids[block.doc_of(starts)])
            order, cuts = _by_owner(classes, owner, n), _cuts(classes.hashes, n)
            owner = owner[order]
            keys = np.concatenate([classes.hashes[order].view(np.uint8).reshape(-1, 8)[:, :7], classes.second[order].view(np.uint8).reshape(-1, 8)[:, :4]], axis=1)
            new = np.flatnonzero(np.diff(owner, prepend=owner[:1] - 1))
            rows = []
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if a < b:
                    # A bucket's documents and how many classes each has there.
                    begin = np.union1d([a], new[np.searchsorted(new, a) : np.searchsorted(new, b)])
                    counts = np.diff(np.append(begin, b))
                    rows.append((k, number, keys[a:b].tobytes(), owner[begin].tobytes() + counts.astype(np.int64).tobytes()))
            yield _record(rows, ["bucket", "block", "keys", "docs"], (pa.int32(), pa.int64(), pa.binary(), pa.binary()))

    return table.mapInArrow(run, _STRINGS)


def _owners(docs: bytes) -> np.ndarray:
    """The document of each class that ``string_keys`` packed."""
    ids, counts = np.frombuffer(docs, np.int64).reshape(2, -1)
    return np.repeat(ids, counts)


def later_strings(keys: DataFrame, n: int) -> DataFrame:
    """One bucket at a time: bits of a block's classes that a smaller document of another block holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if not rows:
            return
        sizes = [len(r[2]) // 11 for r in rows]
        packed = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, 11)
        first, second = np.zeros((2, sum(sizes), 8), np.uint8)
        first[:, :7], second[:, :4] = packed[:, :7], packed[:, 7:]
        owner = np.concatenate([_owners(r[3]) for r in rows])
        classes = Classes(first.view(_U64).ravel(), second.view(_U64).ravel())
        later = owner > classes.lowest(owner)[classes.of]
        out, at = [], 0
        for (bucket, block, _, _), size in zip(rows, sizes, strict=True):
            out.append((block, bucket, np.packbits(later[at : at + size]).tobytes()))
            at += size
        yield _record(out, ["block", "bucket", "bits"], (pa.int64(), pa.int32(), pa.binary()))

    return keys.repartitionById(n, F.col("bucket")).mapInArrow(run, _BITS)


def removed_mask(block: Block, sample_bits: dict[int, bytes], later_bits: dict[int, bytes], n: int) -> np.ndarray:
    """Which bytes of a block go."""
    starts, classes = _strings(block, sample_bits, n)
    gone = np.zeros(len(block.data) + 1, np.int32)
    if len(starts):
        ids = block.ids[block.doc_of(starts)]
        lowest = classes.lowest(ids)
        later = (ids > lowest[classes.of]) | _unpacked(classes, later_bits, n, _by_owner(classes, lowest, n))[classes.of]
        gone[starts[later]] += 1
        np.subtract.at(gone, starts[later] + block.length, 1)
    return np.cumsum(gone[:-1]) > 0


_REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_KEPT = _REPORT + ", kept binary"


def _results(table: DataFrame, n: int, length: int, with_text: bool) -> DataFrame:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, (samples, later) in _each_block(batches, length):
            gone = removed_mask(block, samples, later, n)
            rows = []
            for doc, a, b in zip(block.ids.tolist(), block.starts.tolist(), block.ends.tolist(), strict=True):
                own, data = gone[a:b], block.data[a:b]
                kept = (data[~own] if own.any() else data).tobytes()
                spans = int(np.count_nonzero(np.diff(own, prepend=False) & own))
                rows.append((doc, b - a, b - a - len(kept), spans, hashlib.sha256(kept).hexdigest(), *[kept] * with_text))
            yield _record(rows, names, (*[pa.int64()] * 4, pa.string(), *[pa.binary()] * with_text))

    return table.mapInArrow(run, _KEPT if with_text else _REPORT)


def whole_copies(named: DataFrame, length: int) -> DataFrame:
    """(doc_id, n_bytes) of texts of at least ``length`` bytes that equal one of a smaller id.

    Ids that stand on several rows are left to the other steps.
    """
    digests = named.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), F.min(F.octet_length("text")).cast("long").alias("n_bytes")).where("rows = 1")
    shared = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("held")).where("held > 1")
    return digests.join(shared, "digest").where((F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= length)).select("doc_id", "n_bytes")


def _with_bits(table: DataFrame, *bits: DataFrame) -> DataFrame:
    """Blocks with the bits of all their buckets; a block has one entry a bucket at most."""
    for k, found in enumerate(bits):
        grouped = found.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(f"bits_{k}"))
        table = table.join(grouped, "block", "left")
    return table


def remove_repeats(docs: DataFrame, *, length: int = 50, with_text: bool = False) -> DataFrame:
    """Remove each byte under a ``length``-byte string that also starts in a document of smaller id.

    Columns: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 and, if asked for, the bytes kept.
    """
    if length < PERIOD:
        raise ValueError(f"strings must have at least {PERIOD} bytes")
    spark = docs.sparkSession
    staging = Staging(spark, "suffixes")
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    copies = staging.write(whole_copies(named, length), "copies")
    rest = named.join(copies.select(F.col("doc_id").alias("__copy")).distinct(), F.col("doc_id") == F.col("__copy"), "left_anti")
    n_parts = parts(spark)
    table = staging.bucketed(blocks(rest), "blocks", "block", n_parts)
    total = table.select(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    n = max(n_parts, -(-total // BUCKET))
    samples = staging.write(repeated_samples(sample_keys(table, n, length), n), "samples")
    later = staging.write(later_strings(string_keys(_with_bits(table, samples), n, length), n), "strings")
    found = _results(_with_bits(table, samples, later), n, length, with_text)
    gone = copies.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), *([F.lit(b"").alias("kept")] if with_text else []))
    found = found.unionByName(gone)
    anonymous = docs.where("doc_id is null").select(
        F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), *([F.coalesce("text", F.lit("")).cast("binary").alias("kept")] if with_text else []),
    )
    return found.unionByName(anonymous)
