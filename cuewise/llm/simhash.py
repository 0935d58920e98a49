"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked where few bits differ.

Method: segment-popcount embedding.  A fingerprint is cut into segments of some bits, and
its point holds the number of set bits of each.  The Manhattan distance of two
points is at most the number of bits in which the fingerprints differ, so links are
found by a range join of points on a grid of unit cells.  As two points within distance 2 are within
distance 1 on one half of the segments, there are two grids, one a half: a
point is a member of its own cell and asks there and in the cells one step up in one
segment (one step down is asked by the other side).  What meets is verified on all bits.

Scale: texts are read once and yield a fingerprint each; from there only distinct
fingerprints move, with about a dozen cells each.  Segments get narrower as the
number of fingerprints grows (``segment_bits``), so that cells hold few at any size.  A cell of more than ``crowd``
members is cut into blocks of members, and those who ask in it ask in every block.  A fingerprint has at most 2,080 others within two bits,
so links grow with the number of fingerprints.  Copies share a fingerprint and are never paired.

Edge cases: a null, empty or blank text has fingerprint zero, which links like any other; fewer
than three words are one shingle; rows without an id have a fingerprint, a null
component and link nothing; rows of equal id are rows of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .staging import Staging

WIDTH, SEED, BITS = 3, 42, 64
#: Shingles whose bits are counted at a time.
_CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    """Bit i is set if more than half of the text's shingle hashes, repeats included, have it."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - WIDTH + 1)
    joined, ends = b" ".join(words), list(accumulate((len(w) + 1 for w in words), initial=0))
    last = min(WIDTH, len(words))
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        some = range(at, min(n, at + _CHUNK))
        hashes = np.array([digest(joined[ends[k] : ends[k + last] - 1], SEED) for k in some], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, bits): each row's fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.int64())], names=["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, bits long")


def point(half: Column, segment_bits: int) -> Column:
    """The numbers of set bits of a half's segments, packed: each in the place of its own segment."""
    every_other = lambda x, k, mask: F.shiftrightunsigned(x, k).bitwiseAND(F.lit(mask))
    if segment_bits == 1:
        return half
    pairs = every_other(half, 0, 0x55555555) + every_other(half, 1, 0x55555555)
    return pairs if segment_bits == 2 else every_other(pairs, 0, 0x33333333) + every_other(pairs, 2, 0x33333333)


def segment_width(rows: int) -> int:
    """Widest segments whose cells still hold few of ``rows`` points: half a fingerprint has some 16, 24 or 32 bits of cells."""
    return 4 if rows < 1 << 16 else 2 if rows < 1 << 26 else 1


def cells(marks: DataFrame, segment_bits: int) -> tuple[DataFrame, DataFrame]:
    """Members (cell, bits) and askers (cell, bits, own) of both halves' grids; a cell is a half's counts and which half it is."""
    steps = 32 // segment_bits
    low, high = F.col("bits").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("bits", 32)
    halves = marks.select("bits", F.posexplode(F.array(point(low, segment_bits), point(high, segment_bits))).alias("half", "counts"))
    cell = lambda counts: (F.col("half").cast("long") * F.lit(1 << 33) + counts).alias("cell")
    count = lambda k: F.shiftrightunsigned("counts", k * segment_bits).bitwiseAND(F.lit((1 << segment_bits) - 1))
    up = F.array(F.lit(0).cast("long"), *(F.when(count(k) < segment_bits, F.lit(1 << (k * segment_bits)).cast("long")) for k in range(steps)))
    asked = halves.select("bits", "half", "counts", F.explode(F.array_compact(up)).alias("step"))
    return halves.select(cell(F.col("counts")), "bits"), asked.select(cell(F.col("counts") + F.col("step")), "bits", (F.col("step") == 0).alias("own"))


def close_pairs(marks: DataFrame, *, differing: int, segment_bits: int, crowd: int) -> DataFrame:
    """(low, high): pairs of distinct fingerprints that differ in at most ``differing`` bits, 2 or fewer."""
    members, askers = cells(marks, segment_bits)
    crowded = members.groupBy("cell").agg(F.ceil(F.count("*") / crowd).cast("int").alias("blocks")).where("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1))
    held = members.join(crowded, "cell", "left").select("cell", F.pmod(F.xxhash64("bits"), blocks).cast("int").alias("block"), F.col("bits").alias("other"))
    crowded = crowded.toDF("crowded_cell", "blocks")
    asking = askers.join(crowded, F.col("cell") == F.col("crowded_cell"), "left").select("cell", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "bits", "own")
    near = F.bit_count(F.col("bits").bitwiseXOR(F.col("other"))) <= differing
    once = ~F.col("own") | (F.col("bits") < F.col("other"))
    met = asking.join(held, ["cell", "block"]).where(once & near)
    return met.select(F.least("bits", "other").alias("low"), F.greatest("bits", "other").alias("high")).distinct()


def simhash_components(docs: DataFrame, *, differing: int = 2, segment_bits: int | None = None, crowd: int = 4096) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    ``segment_bits`` (1, 2 or 4; by the number of fingerprints if None) and ``crowd`` set the cost, not the result.
    """
    if not 0 <= differing <= 2:
        raise ValueError("the two grids find pairs that differ in at most 2 bits")
    staging = Staging(docs.sparkSession, "simhash")
    rows = staging.write(fingerprints(docs), "rows")
    marks = staging.write(rows.where("doc_id is not null").groupBy("bits").agg(F.min("doc_id").alias("smallest")), "marks")
    width = segment_bits or segment_width(marks.count())
    pairs = close_pairs(marks.select("bits"), differing=differing, segment_bits=width, crowd=crowd)
    near = components(pairs.toDF("a", "b"), staging)
    grouped = marks.join(near, F.col("bits") == F.col("node"), "left").select(F.col("bits").alias("mark"), F.coalesce("component", "bits").alias("group"), "smallest")
    least = grouped.groupBy("group").agg(F.min("smallest").alias("component"))
    found = grouped.join(least, "group").select("mark", "component")
    joined = rows.join(found, F.col("bits") == F.col("mark"), "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
