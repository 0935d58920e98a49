"""Best-fit packing of token sequences with a fixed number of open bins.

Method: bounded-space online best-fit.  Pieces arrive one by one; each goes into
the open bin with the least free space that still holds it.  The free spaces in
use are the set bits of one integer, so the tightest bin is the lowest set bit at
or above the piece's length.  When the fixed number of open bins is used up, the
fullest one closes first.

Scale: tokenising is a map over the documents and nothing but piece lengths and
checksums leaves it.  Pieces are dealt by a hash of row, document, number and
checksum to packing groups whose number follows the number of pieces, so a group's memory does not
grow with the input; each group packs alone and its sequence ids start at its own
offset.  A hot source is spread like any other, since only the hash decides.

Edge cases: a null text packs as an empty one (the end token alone); a document
longer than a sequence is cut, the first piece being the shorter one; repeated
rows and rows with equal or null ids are separate documents; an empty table gives
an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from .staging import Staging

PIECES = "row_id long, doc_id long, piece int, start long, length int, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"
#: Words whose ids a worker remembers, from one task to the next, before it starts afresh.
MEMO_WORDS = 600_000
#: White space besides blanks and line feeds.
_OTHER = re.compile("[\t\r\v\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A blank between two words: the tokenizer's own split starts a unit there.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def is_broad(text: str) -> bool:
    """Whether white space in a text is anywhere more than one blank or line feed between two words; there the tokenizer decides on the whole stretch."""
    return text[:1] in " \n" or text[-1:] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _OTHER.search(text) is not None


#: Marks that may close a word; an apostrophe may begin a unit with letters and is none of them.
CLOSING = ".,;:!?)"


def is_plain(word: str) -> bool:
    """Whether a word is of letters alone, of scripts about which all versions of Unicode agree."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0530")


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordMemo:
    """Ids of texts by ``tokenizer`` as little-endian unsigned 32-bit bytes, a word's ids being looked up once.

    The tokenizer splits a text before it merges anything: behind a word a lone blank starts
    a unit with what follows, and a lone line feed is one of its own.  So a text's ids are those of its
    first word and of its blank-led words in a row.  ``led`` has blank-led words, without their blank.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.led: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.letters = byte_letters()

    def merged(self, word: str) -> bytes:
        """Ids of a word of letters led by a blank, which the tokenizer does not split: its merges alone decide."""
        return packed([t.id for t in self.tokenizer.model.tokenize((b" " + word.encode()).decode("latin-1").translate(self.letters))])

    def encoded(self, words: list[str]) -> Iterator[bytes]:
        for found in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
            yield packed(found.ids)

    def learn(self, led: set[str], bare: set[str]) -> None:
        """Look up what is new of blank-led words and of words without a blank."""
        led = led.difference(self.led)
        lines = {w: w.split("\n") for w in led if "\n" in w and not is_broad(w)}
        led.update(first for first, *_ in lines.values() if first not in self.led)
        bare.update(line for _, *rest in lines.values() for line in rest)
        bare.add("\n")
        whole, closed = [], []
        for word in led.difference(lines):
            stem = word.rstrip(CLOSING)
            if not is_plain(stem):
                whole.append(word)
                continue
            if stem not in self.led:
                self.led[stem] = self.merged(stem)
            if stem != word:
                closed.append((word, stem))
        bare.update({w[len(stem) :] for w, stem in closed})
        new = [w for w in bare if w not in self.bare]
        self.bare.update(zip(new, self.encoded(new), strict=True))
        self.led.update(zip(whole, self.encoded([" " + w for w in whole]), strict=True))
        # Punctuation behind letters is a unit of its own.
        for word, stem in closed:
            self.led[word] = self.led[stem] + self.bare[word[len(stem) :]]
        feed = self.bare["\n"]
        for w, (first, *rest) in lines.items():
            self.led[w] = self.led[first] + b"".join([feed + self.bare[line] for line in rest])

    def texts(self, texts: list[str]) -> list[bytes]:
        if len(self.led) > MEMO_WORDS:
            self.led.clear()
            self.bare.clear()
        split = [_BETWEEN.split(t) if is_broad(t) else t.split(" ") for t in texts]
        first = [words.pop(0) for words in split]
        self.learn(set(chain.from_iterable(split)), set(first))
        return [self.bare[f] + b"".join(map(self.led.__getitem__, words)) for f, words in zip(first, split, strict=True)]

    def text(self, text: str) -> bytes:
        return self.texts([text])[0]


_MEMOS: dict[str, WordMemo] = {}


def memo_of(tokenizer_file: str) -> WordMemo:
    """The worker's memo of a tokenizer."""
    if tokenizer_file not in _MEMOS:
        # Spark has a worker for each core already.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _MEMOS[tokenizer_file] = WordMemo(Tokenizer.from_file(tokenizer_file))
    return _MEMOS[tokenizer_file]


def cut(n_ids: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for the first, which takes the rest."""
    if n_ids <= limit:
        return [(0, n_ids)]
    first = n_ids % limit or limit
    return [(0, first)] + [(s, limit) for s in range(first, n_ids, limit)]


def _encoded(memo: WordMemo, column: pa.Array, at_once: int = 4_000_000) -> Iterator[bytes]:
    """Ids of a column's texts, some of them at a time."""
    held, size = [], 0
    for text in column:
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= at_once:
            yield from memo.texts(held)
            held, size = [], 0
    yield from memo.texts(held)


def tokenized_pieces(docs: DataFrame, *, tokenizer_file: str, limit: int, end_id: int, place: Column | None = None) -> DataFrame:
    """One row a piece: document, piece number, start, length and checksum of its ids, and its document's ``place``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = memo_of(tokenizer_file)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for n, (row, doc, ids) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _encoded(memo, batch.column(2)), strict=True)):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, limit)):
                    for column, value in zip(out, (row, doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n), strict=True):
                        column.append(value)
            columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
            columns[6] = batch.column(3).take(columns[6])
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

    names = ["row_id", "doc_id", "piece", "start", "length", "ids_crc32"] + (["place"] if place is not None else [])
    row = F.monotonically_increasing_id()
    rows = docs.select(row.alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text", (row if place is None else place).alias("place"))
    return rows.mapInArrow(run, PIECES if place is None else PIECES + ", place long")


def written_place(docs: DataFrame) -> Column:
    """Where a row stands: in the order of the numbered files that Spark wrote and read again, else in that of the partitions."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return F.monotonically_increasing_id()
    number = lambda pattern: F.coalesce(F.expr(f"try_cast(regexp_extract(_metadata.file_name, '{pattern}', 1) AS bigint)"), F.lit(0))
    return F.shiftleft(number("part-([0-9]+)"), 43) + F.shiftleft(number("[.-]c([0-9]+)[.]"), 33) + F.col("_metadata.row_index")


def best_fit(lengths: list[int], limit: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin number and offset of each piece, in order of arrival; ``open_bins`` bins stay open at most."""
    bins_with: list[list[int]] = [[] for _ in range(limit + 1)]
    free = 0  # bit f: some open bin has f free
    n_open = made = 0
    where, at = [], []
    for length in lengths:
        fits = free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = bins_with[space].pop()
            if not bins_with[space]:
                free &= ~(1 << space)
        else:
            if n_open == open_bins:
                space = (free & -free).bit_length() - 1
                bins_with[space].pop()
                if not bins_with[space]:
                    free &= ~(1 << space)
                n_open -= 1
            space, number = limit, made
            made += 1
            n_open += 1
        where.append(number)
        at.append(limit - space)
        space -= length
        if space:
            if not bins_with[space]:
                free |= 1 << space
            bins_with[space].append(number)
        else:
            n_open -= 1
    return where, at


def pack_pieces(pieces: DataFrame, *, limit: int, open_bins: int, groups: int) -> DataFrame:
    """Places for all pieces: sequence id and offset, packed within ``groups`` groups.

    Where pieces have a ``place``, groups are runs of it, one after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task holds one group, whose size is bounded by pieces_per_group.
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        group = table.column("group")[0].as_py()
        where, at = best_fit(table.column("length").to_pylist(), limit, open_bins)
        table = table.select([c for c in table.column_names if c not in ("group", "place")])
        table = table.append_column("sequence_id", pa.array(np.array(where, np.int64) + (group << 40), pa.int64()))
        yield from table.append_column("offset", pa.array(at, pa.int64())).to_batches(max_chunksize=50_000)

    if "place" in pieces.columns:
        runs = pieces.repartitionByRange(groups, "place").withColumn("group", F.spark_partition_id())
        return runs.sortWithinPartitions("place", "piece").mapInArrow(run, PLACED)
    # Pieces arrive in the order of a hash, so that long and short ones are mixed.
    dealt = pieces.withColumn("arrival", F.xxhash64("row_id", "doc_id", "piece", "ids_crc32"))
    dealt = dealt.withColumn("group", F.pmod("arrival", F.lit(groups)).cast("int"))
    ordered = dealt.repartitionById(groups, F.col("group")).sortWithinPartitions("arrival", "row_id", "piece").drop("arrival")
    return ordered.mapInArrow(run, PLACED)


def pack(
    docs: DataFrame,
    *,
    tokenizer_file: str,
    limit: int = 1024,
    end_id: int = 2,
    open_bins: int = 256,
    pieces_per_group: int = 100_000,
    in_order: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most ``limit`` tokens.

    Columns: row_id (tells rows of equal doc_id apart), doc_id, piece, start,
    length, ids_crc32, sequence_id, offset.  With ``in_order`` groups are contiguous runs
    of the rows as they were written, and sequence ids follow the runs.
    """
    staging = Staging(docs.sparkSession, "packing")
    pieces = staging.write(tokenized_pieces(docs, tokenizer_file=tokenizer_file, limit=limit, end_id=end_id, place=written_place(docs) if in_order else None), "pieces")
    groups = max(1, -(-pieces.count() // pieces_per_group))
    return pack_pieces(pieces, limit=limit, open_bins=open_bins, groups=groups)
