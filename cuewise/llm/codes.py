"""Product quantisation of vectors in whole numbers: codes, errors and the codebooks they come from.

Method: components are scaled and rounded down, vectors cut into equal parts, and each part position has a
codebook that some rounds of assigning and averaging refine.  A part's nearest entry is found by
annular norm pruning: entries are sorted by norm, the entries of nearest norm give a
first distance, and as an entry cannot be closer than its norm is to the part's, a binary
search bounds the annulus of norms that may still hold a nearer or equally near one.  That annulus is
evaluated, its ends included, and all of it exactly.

Scale: a round is one pass over the table with the codebooks (a fixed number of entries,
whatever the table's size) in every task.  A task adds up its own parts by entry, so what is shuffled
and collected are sums by entry and component, bounded by the codebooks.  The last
pass's codes are written, as errors are summed by label from them; sums by label are aggregated before they
move and joined by label, so a hot label is never one task's.

Edge cases: rows whose vector is null, empty or holds a null or non-finite component are dropped, and so
are vectors of another length than the most common one (the longer, if two are); a length that
the parts do not divide gives the first parts one component more; rows without an id are
coded and come last among the first entries; rows of equal id are rows of their own, in the order of their
vectors; fewer rows than entries make a smaller codebook; scaled components are held within 2^26, so that
distances stay exact; label errors are held at the largest long; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .staging import Staging

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Scaled components beyond this are held at it.
_LARGEST = 1 << 26
#: Parts compared at a time; they are neighbours in norm, so their annuli overlap.
_TOGETHER = 64
#: Entries of nearest norm that give the first distance.
_FIRST = 8
#: Whole numbers that doubles still hold exactly.
_EXACT = 1 << 53
_LONGEST = (1 << 63) - 1


@dataclass
class Codebook:
    """The entries of one part position, with their norms in rising order."""

    entries: np.ndarray

    def __post_init__(self):
        norms = np.sqrt((self.entries.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.ranked = norms[self.order], self.entries[self.order]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each point's nearest entry (ties to the lower index) and the squared distance to it."""
        index, error = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        norms = np.sqrt((points.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(norms, kind="stable")
        for at in range(0, len(points), _TOGETHER):
            some = order[at : at + _TOGETHER]
            index[some], error[some] = self._annulus(points[some], norms[some])
        return index, error

    def _annulus(self, points: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``nearest`` of some points in order of their norms."""
        k = len(self.norms)
        near = np.clip(np.searchsorted(self.norms, (norms[0] + norms[-1]) / 2) - _FIRST // 2, 0, max(0, k - _FIRST))
        best = np.sqrt(squared_distances(points, self.ranked[near : near + _FIRST]).min(axis=1).astype(np.float64))
        # Roots are rounded; a hair more on both sides never leaves out an entry that is equally near.
        slack = (norms + best + 1) * 1e-12
        low = np.searchsorted(self.norms, norms - best - slack, "left")
        high = np.searchsorted(self.norms, norms + best + slack, "right")
        a, b = low.min(), high.max()
        distances = squared_distances(points, self.ranked[a:b])
        place = np.arange(a, b)
        distances[(place < low[:, None]) | (place >= high[:, None])] = _LONGEST
        error = distances.min(axis=1)
        lowest = np.where(distances == error[:, None], self.order[a:b], k)
        return lowest.min(axis=1), error


def squared_distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries."""
    largest = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * int(largest) ** 2 * points.shape[1] < _EXACT:
        # Doubles hold all terms exactly here, and multiply faster than integers.
        x, y = points.astype(np.float64), entries.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((points - e) ** 2).sum(axis=1) for e in entries], axis=1)


def scaled(vectors: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column count, and their components in whole numbers."""
    fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False))
    chosen = vectors.filter(pa.array(fits))
    # A null component is read as nan.
    flat = chosen.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(chosen), width)
    finite = np.isfinite(flat).all(axis=1)
    fits[np.flatnonzero(fits)[~finite]] = False
    whole = np.floor(np.clip(flat[finite] * float(scale), -_LARGEST, _LARGEST))
    return fits, whole.astype(np.int64)


def cuts(width: int, parts: int) -> list[slice]:
    """Consecutive parts of a vector, equal if ``parts`` divides ``width``."""
    ends = np.cumsum([0, *(width // parts + (p < width % parts) for p in range(parts))])
    return [slice(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _usable(table: DataFrame) -> DataFrame:
    """Rows of finite vectors that are not empty."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)))


def first_codebooks(rows: DataFrame, spans: Sequence[slice], entries: int, scale: int) -> list[Codebook]:
    """Each position's parts of the ``entries`` rows with the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    _, whole = scaled(first.column(0).combine_chunks(), spans[-1].stop, scale)
    return [Codebook(whole[:, s]) for s in spans]


def _sums(rows: DataFrame, books: list[Codebook], spans: list[slice], scale: int) -> DataFrame:
    """(part, entry, position, total): sums of the parts of every entry; their number stands at position -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(b.entries), b.entries.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            _, whole = scaled(batch.column(0), spans[-1].stop, scale)
            for total, book, span in zip(totals, books, spans, strict=True):
                index, _ = book.nearest(whole[:, span])
                np.add.at(total, index, np.concatenate([np.ones((len(whole), 1), np.int64), whole[:, span]], axis=1))
        for part, total in enumerate(totals):
            entry, at = np.nonzero(np.repeat(total[:, :1] > 0, total.shape[1], axis=1))
            columns = (np.full(len(entry), part), entry, at - 1, total[entry, at])
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["part", "entry", "position", "total"])

    return rows.select("embedding").mapInArrow(run, "part long, entry long, position long, total long")


def refined(rows: DataFrame, books: list[Codebook], spans: list[slice], scale: int) -> list[Codebook]:
    """The codebooks after one round: each entry the mean of its parts, rounded down; entries without parts stay."""
    # As many rows as the codebooks have numbers.
    found = _sums(rows, books, spans, scale).groupBy("part", "entry", "position").agg(F.sum("total").alias("total")).toArrow()
    part, entry, position, total = (found.column(c).to_numpy() for c in ("part", "entry", "position", "total"))
    out = []
    for p, book in enumerate(books):
        sums = np.zeros((len(book.entries), book.entries.shape[1] + 1), np.int64)
        own = part == p
        sums[entry[own], position[own] + 1] = total[own]
        used = sums[:, 0] > 0
        entries = book.entries.copy()
        entries[used] = sums[used, 1:] // sums[used, :1]
        out.append(Codebook(entries))
    return out


def _coded(rows: DataFrame, books: list[Codebook], spans: list[slice], scale: int) -> DataFrame:
    """(vec_id, label, code, error) of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, whole = scaled(batch.column(2), spans[-1].stop, scale)
            found = [book.nearest(whole[:, span]) for book, span in zip(books, spans, strict=True)]
            codes = ["".join(map("{:02x}".format, c)) for c in zip(*(index.tolist() for index, _ in found), strict=True)]
            error = np.sum([e for _, e in found], axis=0, dtype=np.int64)
            kept = batch.filter(pa.array(fits))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def digest(books: Sequence[Codebook]) -> str:
    """Lowercase hex SHA-256 of all entries' components in order."""
    numbers = ",".join(",".join(map(str, b.entries.ravel().tolist())) for b in books if b.entries.size)
    return hashlib.sha256(numbers.encode()).hexdigest()


def compress(table: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every row of ``table`` (vec_id, embedding, label) that counts.

    ``entries`` is at most 256, so that an index has two hex digits.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hex digits an entry")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    lengths = _usable(rows).groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    width = common["length"] if common else parts
    spans = cuts(width, parts)
    books = first_codebooks(_usable(rows).where(F.size("embedding") == width), spans, entries, scale)
    if common:
        for _ in range(rounds):
            books = refined(rows, books, spans, scale)
        coded = Staging(table.sparkSession, "codes").write(_coded(rows, books, spans, scale), "coded")
    else:
        coded = rows.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONGEST).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
