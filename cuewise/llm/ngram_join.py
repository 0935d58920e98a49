"""Jaccard self-join of documents on word shingles, and the components of its links.

Method: token-combination prefixes.  Shingles are ordered by hash.  If two sets
share at least ``o`` shingles, the first ``s`` shared ones lie in both sets' first
``n - t + s``, where ``t`` is the fewest that a partner must share.  With frequent
shingles dealt to ``c`` classes and ``s = c + 1``, either one of those shared
shingles is rare, and single rare shingles are indexed, or two frequent ones fall
into one class, and pairs of frequent shingles of a class are indexed.  Candidates
are then verified on the whole sets, so the result is exact.

Scale: four steps, each on what the one before left.

1. Prefixes of all documents are dealt by hash, once per block of documents for
   a shingle that many of its documents hold.  A document too few of whose
   prefix shingles occur elsewhere has no partner, and most end here.  A block sends a row to each
   part; where parts are many, they form groups, a block sends a row to each group, and what came for a group
   is dealt to its parts in larger rows, so that rows grow with the input and not with its square.
2. Equal sets become one class, whose smallest id stands for it.  Classes of which
   too few of all shingles occur in another class end here, in some rounds.
3. Each index entry links its sets to one leader, that with the most common
   shingles, never to each other; in a group of near copies that is the text they
   were made from.  Components that still meet in an entry are then compared in
   blocks of sets, counting common shingles through posting lists inside a task.  A
   group of thousands of near copies so costs rows in proportion to its size.
4. Components come from hooking and pointer jumping over the verified links.

Hot shingles are counted with map-side aggregation or met in joins that adaptive
execution can split; nothing is collected or broadcast by hand.

Edge cases: a null, empty or blank text has no shingles and no links; fewer than
five words are one shingle; equal rows are linked with themselves only through
their class; rows without an id are returned with a null component and link
nothing; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shingles import mixed, shingle_sets
from .staging import Staging, parts

#: Text held at a time while prefixes of a block are brought together.
_BLOCK_CHARS = 12_000_000
#: Characters of input that one part of the dealt shingles stands for, so that a task's memory does not follow the input.
_PART_CHARS = 32_000_000
#: Texts are filtered by a Bloom filter of the ids that are wanted, of the fixed size that Spark gives it, before they move.
_FILTER_FIRST = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "100g",
}
_U64 = np.uint64
#: Parts to which a block sends a row each; beyond them, parts are dealt in two steps.
_FANOUT = 1024
#: Parts whose shingles one task deals in the second step, and shingles that it deals at a time.
_PARTS_A_TASK, _TOGETHER = 8, 1_000_000


class Threshold:
    """A Jaccard threshold of ``percent`` hundredths and the lengths that follow from it."""

    def __init__(self, percent: int):
        self.percent = percent

    def least(self, n: int) -> int:
        """Shingles that a partner of a set of ``n`` must share, and its own least size."""
        return -(-self.percent * n // 100)

    def classes(self, n: int) -> list[int]:
        """Numbers of classes that a set of ``n`` indexes pairs under: its size bracket's, and the next lower one's if a partner can be there."""
        of = lambda size: max(16, 2 ** (max(1, size).bit_length() - 1) // 16)
        return sorted({of(n), of(self.least(n))})

    def spread(self, n: int) -> int:
        """How many shared shingles the first filter looks for in a set of ``n``."""
        return max(17, n // 6)

    def filter_prefix(self, n: int) -> int:
        return min(n, n - self.least(n) + self.spread(n))

    def filter_need(self, n: int) -> int:
        """Shared shingles that the filter prefix of a set with a partner has at least."""
        return min(self.least(n), self.spread(self.least(n)))

    def linked(self, common: int, n_a: int, n_b: int) -> bool:
        return 100 * common >= self.percent * (n_a + n_b - common)


def _set_hash(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set; 0, 0 for an empty one."""
    if not len(tokens):
        return 0, 0
    both = np.array([mixed(tokens ^ _U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U64), mixed(tokens + _U64(0x5851F42D4C957F2D)).sum(dtype=_U64)])
    return tuple(both.view(np.int64).tolist())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts, some ``_BLOCK_CHARS`` of text at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc)
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= _BLOCK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


_DEALT = "part int, doc_id long, n long, h1 long, h2 long, shared long, tokens binary, docs binary, many binary"
_MARKS = "whole boolean, doc_id long, n long, h1 long, h2 long, shared long"


def _groups(n_parts: int) -> int:
    """Groups of parts; as many as there are parts if these are few."""
    return n_parts if n_parts <= _FANOUT else math.isqrt(n_parts - 1) + 1


def _part(tokens: np.ndarray, n_parts: int) -> np.ndarray:
    return (tokens >> _U64(32)) % _U64(n_parts)


def _dealt(ids: list, about: list[tuple[int, int, int]], held: list[np.ndarray], n_parts: int) -> Iterator[pa.RecordBatch]:
    """A row for each set (``about``: n, h1, h2), and for each group of parts the block's distinct shingles in ``held``."""
    n_groups = _groups(n_parts)
    tokens = np.concatenate([np.zeros(0, _U64), *held])
    owner = np.repeat(np.arange(len(ids)), [len(h) for h in held])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(tokens)))
    shared = np.bincount(owner[np.repeat(count > 1, count)], minlength=len(ids))
    rows: list[tuple] = [(k % n_groups, doc, *a, int(s), None, None, None) for k, (doc, a, s) in enumerate(zip(ids, about, shared, strict=True))]
    tokens, owner, single = tokens[first], np.array([-1 if d is None else d for d in ids], np.int64)[owner[first]], count == 1
    rows += _shares(_part(tokens, n_parts) % _U64(n_groups), n_groups, tokens[single], owner[single], tokens[~single], single)
    yield from _dealt_batches(rows)


def _shares(part: np.ndarray, n_parts: int, single: np.ndarray, owner: np.ndarray, several: np.ndarray, is_single: np.ndarray) -> Iterator[tuple]:
    """A row for each part: its shingles that one document of a block has, with those documents, and those that several have."""
    cut = lambda own: (order := np.argsort(own, kind="stable"), np.searchsorted(own[order], np.arange(n_parts + 1, dtype=_U64)))
    (one, ends), (many, many_ends) = cut(part[is_single]), cut(part[~is_single])
    for p in range(n_parts):
        a, b, c, d = ends[p], ends[p + 1], many_ends[p], many_ends[p + 1]
        if a < b or c < d:
            yield p, None, 0, 0, 0, 0, single[one[a:b]].tobytes(), owner[one[a:b]].tobytes(), several[many[c:d]].tobytes()


def _dealt_batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), *[pa.int64()] * 5, *[pa.binary()] * 3)
    for at in range(0, len(rows), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 20_000], strict=True), kinds, strict=True)], names=["part", "doc_id", "n", "h1", "h2", "shared", "tokens", "docs", "many"])


def _dealt_on(dealt: DataFrame, n_parts: int) -> DataFrame:
    """Rows of groups dealt to the groups' parts."""
    n_groups = _groups(n_parts)
    if n_groups == n_parts:
        return dealt
    per_group = -(-n_parts // n_groups)
    tasks = max(1, per_group // _PARTS_A_TASK)

    def parts_of(group: int, held: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        # The parts of a group are ``n_groups`` apart.
        single, owner, several = (np.frombuffer(b"".join(h), t) for h, t in zip(held, (_U64, np.int64, _U64), strict=True))
        both = np.concatenate([single, several])
        rows = _shares(_part(both, n_parts) // _U64(n_groups), per_group, single, owner, several, np.arange(len(both)) < len(single))
        yield from _dealt_batches([(group + p * n_groups, *rest) for p, *rest in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, size = -1, [[], [], []], 0
        for batch in batches:
            own = batch.column("tokens").is_null()
            if (rows := batch.filter(own)).num_rows:
                # A set's row goes on by its own numbers, so that a task that runs again sends it where it went before.
                mark = rows.column("doc_id").fill_null(0).to_numpy().view(_U64) * _U64(0x9E3779B97F4A7C15) + rows.column("h1").to_numpy().view(_U64)
                yield rows.set_column(0, "part", pa.array((mixed(mark) % _U64(n_parts)).astype(np.int32)))
            rows = batch.filter(pc.invert(own))
            for part, *values in zip(*(rows.column(c).to_pylist() for c in ("part", "tokens", "docs", "many")), strict=True):
                if held[0] and (part != group or size >= 8 * _TOGETHER):
                    yield from parts_of(group, held)
                    held, size = [[], [], []], 0
                group = part
                for kept, value in zip(held, values, strict=True):
                    kept.append(value)
                size += len(values[0]) + len(values[2])
        if held[0]:
            yield from parts_of(group, held)

    salt = F.pmod(F.xxhash64("doc_id", "h1", "tokens", "many"), F.lit(tasks)).cast("int")
    return dealt.repartitionById(n_groups * tasks, F.col("part") * tasks + salt).mapInArrow(run, _DEALT)


def _deal_prefixes(docs: DataFrame, limit: Threshold, n_parts: int) -> DataFrame:
    """Filter prefixes of all documents, dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches):
            about, held = [], []
            for doc, tokens in zip(ids, shingle_sets(texts), strict=True):
                about.append((len(tokens), *_set_hash(tokens)))
                held.append(tokens[: limit.filter_prefix(len(tokens))] if doc is not None else tokens[:0])
            yield from _dealt(ids, about, held, n_parts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _DEALT)


def _deal_sets(sets: DataFrame, n_parts: int) -> DataFrame:
    """Whole sets, dealt, with their node as the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [t.values.to_numpy().view(_U64) for t in batch.column(1)]
            yield from _dealt(batch.column(0).to_pylist(), [(len(h), 0, 0) for h in held], held, n_parts)

    return sets.select("node", "tokens").mapInArrow(run, _DEALT)


def _mark_shared(dealt: DataFrame, n_parts: int) -> DataFrame:
    """Documents' rows as they came, and for documents how many of their shingles in this part other blocks hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["whole", "doc_id", "n", "h1", "h2", "shared"]
        tokens, docs, many = [], [], []
        for batch in batches:
            own = batch.column("tokens").is_null()
            rows = batch.filter(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(rows.num_rows, bool)), *(rows.column(c) for c in names[1:])], names=names)
            rows = batch.filter(pc.invert(own))
            tokens += rows.column("tokens").to_pylist()
            docs += rows.column("docs").to_pylist()
            many += rows.column("many").to_pylist()
        single, doc, several = np.frombuffer(b"".join(tokens), _U64), np.frombuffer(b"".join(docs), np.int64), np.frombuffer(b"".join(many), _U64)
        order = np.argsort(single, kind="stable")
        single, doc = single[order], doc[order]
        same = single[1:] == single[:-1]
        hit = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(single) else np.zeros(0, bool)
        hit |= np.isin(single, several)
        found, counts = np.unique(doc[hit], return_counts=True)
        zero = np.zeros(len(found), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(found), bool)), pa.array(found), *[pa.array(zero)] * 3, pa.array(counts)], names=names)

    return _dealt_on(dealt, n_parts).repartitionById(n_parts, F.col("part")).mapInArrow(run, _MARKS)


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, h1, h2, tokens) with the whole sorted set as a list of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches):
            sets = list(shingle_sets(texts))
            hashes = [_set_hash(s) for s in sets]
            for at in range(0, len(ids), 2_000):
                part = sets[at : at + 2_000]
                offsets = np.cumsum([0, *map(len, part)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, _U64), *part]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 2_000], pa.int64()), pa.array([len(s) for s in part], pa.int64()), *(pa.array([h[k] for h in hashes[at : at + 2_000]], pa.int64()) for k in (0, 1)), lists], names=["doc_id", "n", "h1", "h2", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, tokens array<long>")


def index_entries(n: int, tokens: np.ndarray, frequent: np.ndarray, limit: Threshold) -> np.ndarray:
    """Index entries of a set.

    ``tokens``: those of its longest prefix that other sets hold, in order;
    ``frequent``: which of them count as frequent.
    """
    entries = [tokens[~frequent]]
    often = tokens[frequent]
    if limit.least(n) <= 16:
        entries.append(often)
    for c in limit.classes(n):
        if n < 17:
            break
        slot = (mixed(often) % _U64(c)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        ranked, slot = often[order], slot[order]
        for step in range(1, len(ranked)):  # partners at growing distance within the class
            same = slot[step:] == slot[:-step]
            if not same.any():
                break
            entries.append(mixed(ranked[:-step][same] * _U64(0x9E3779B97F4A7C15) + mixed(ranked[step:][same]) + _U64(c)))
    return np.unique(np.concatenate(entries))


def _entries(marked: DataFrame, limit: Threshold, frequent_from: int) -> DataFrame:
    """(node, n, rank, pairs of token and df) -> (entry, node, n, rank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, ranks = (batch.column(c).to_pylist() for c in range(3))
            for k, pairs in enumerate(batch.column(3)):
                flat = pairs.values.flatten()
                tokens, df = flat[0].to_numpy().view(_U64), flat[1].to_numpy()
                order = np.argsort(tokens)
                found = index_entries(sizes[k], tokens[order], df[order] >= frequent_from, limit).view(np.int64)
                for at in range(0, len(found), 100_000):
                    piece = found[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(np.full(len(piece), nodes[k])), pa.array(np.full(len(piece), sizes[k])), pa.array(np.full(len(piece), ranks[k]))], names=["entry", "node", "n", "rank"])

    return marked.select("node", "n", "rank", "pairs").mapInArrow(run, "entry long, node long, n long, rank double")


def _verified(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                good.append(limit.linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("a_tokens"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("b_tokens"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "a_tokens", "b_tokens").mapInArrow(run, "a long, b long")


def _pruned(sets: DataFrame, limit: Threshold, staging: Staging, n_parts: int, rounds: int = 3) -> DataFrame:
    """The sets of whose shingles other sets hold as many as a partner must share; the rest are alone."""
    for turn in range(rounds):
        marks = _mark_shared(_deal_sets(sets, n_parts), n_parts).groupBy("doc_id").agg(F.sum("shared").alias("shared"), F.min(F.when(F.col("whole"), F.col("n"))).alias("n"))
        alive = marks.where("doc_id is not null").where(F.col("shared") >= F.ceil(F.col("n") * limit.percent / 100)).select(F.col("doc_id").alias("node"))
        fewer = staging.write(sets.join(alive, "node", "left_semi"), f"pruned-{turn}")
        before, after = sets.count(), fewer.count()
        staging.drop(f"pruned-{turn - 1}" if turn else "sets")
        sets = fewer
        if after > 0.9 * before:
            break
    return sets


def _compare_blocks(limit: Threshold):
    """For a cogroup of some sets and a block of others: links into each of the others' components."""
    names = ["a", "b"]

    def compare(asking: pa.Table, members: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        if asking.num_rows and members.num_rows:
            lists = members.column("tokens").combine_chunks()
            sizes = pc.list_value_length(lists).to_numpy()
            node, component = members.column("node").to_numpy(), members.column("c").to_numpy()
            tokens = lists.flatten().to_numpy()
            order = np.argsort(tokens, kind="stable")
            ranked, owner = tokens[order], np.repeat(np.arange(len(sizes)), sizes)[order]
            for x, own, wanted in zip(asking.column("node").to_pylist(), asking.column("c").to_pylist(), asking.column("tokens").combine_chunks(), strict=True):
                wanted = np.sort(wanted.values.to_numpy())
                low, high = np.searchsorted(ranked, wanted, "left"), np.searchsorted(ranked, wanted, "right")
                spans = [owner[a:b] for a, b in zip(low, high, strict=True) if a < b]
                if spans:
                    common = np.bincount(np.concatenate(spans), minlength=len(sizes))
                    good = np.flatnonzero(limit.linked(common, len(wanted), sizes) & (component != own))
                    for k in good[np.unique(component[good], return_index=True)[1]]:
                        out.append((x, int(node[k])))
        columns = list(zip(*out, strict=True)) if out else [(), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

    return compare


def _compared(asking: DataFrame, members: DataFrame, sets: DataFrame, limit: Threshold, block_rows: int, staging: Staging, name: str) -> DataFrame:
    """(a, b): links of each unit's asking sets with its members; both sides have (unit, node, c).

    Each side is cut into blocks, and each pair of blocks is one task's work.
    """
    cut = lambda rows: F.ceil(rows / block_rows).cast("int")
    block = lambda rows: F.pmod(F.xxhash64("node"), cut(rows)).cast("int")
    every = lambda rows: F.explode(F.sequence(F.lit(0), cut(rows) - 1))
    asked, held = asking.groupBy("unit").agg(F.count("*").alias("asked")), members.groupBy("unit").agg(F.count("*").alias("held"))
    sizes = staging.write(asked.join(held, "unit"), f"{name}-sizes")
    tokens = sets.select("node", "tokens")
    left = asking.join(sizes, "unit").join(tokens, "node").select("unit", block(F.col("asked")).alias("ask"), every(F.col("held")).alias("member"), "node", "c", "tokens")
    right = members.join(sizes, "unit").join(tokens, "node").select("unit", every(F.col("asked")).alias("ask"), block(F.col("held")).alias("member"), "node", "c", "tokens")
    right = right.toDF(*right.columns)  # columns of its own, as both sides come from the same tables
    keys = ("unit", "ask", "member")
    links = staging.write(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_compare_blocks(limit), "a long, b long"), name)
    staging.drop(f"{name}-sizes")
    return links


def _across(placed: DataFrame, sets: DataFrame, limit: Threshold, staging: Staging, block_rows: int, few: int = 32) -> DataFrame:
    """(a, b): links between components that index entries still have in common.

    Components that meet in entries of at most ``few`` of them are compared pair by pair,
    the smaller one's sets of fitting size with the larger one's.  Entries of more form clusters, and each
    cluster's sets outside its largest component are compared with all its sets.
    """
    member = staging.write(placed.select("node", "n", "c").distinct(), "members")
    meeting = placed.select("entry", "c").distinct()
    counts = meeting.groupBy("entry").agg(F.count("*").alias("met")).where("met > 1")
    meeting = staging.write(meeting.join(counts, "entry"), "meeting")

    together = meeting.where(F.col("met") <= few).groupBy("entry").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    both = F.flatten(F.transform("cs", lambda x, i: F.transform(F.slice("cs", i + 2, F.size("cs")), lambda y: F.struct(x.alias("c1"), y.alias("c2")))))
    pairs = together.select(F.explode(both).alias("p")).select("p.*").distinct()
    size = member.groupBy("c").agg(F.count("*").alias("rows"), F.min("n").alias("low"), F.max("n").alias("high"))
    of = lambda k: size.toDF(f"c{k}", f"r{k}", f"low{k}", f"high{k}")
    # Sets whose sizes differ too much cannot be partners.
    fits = (F.col("high2") * 100 >= F.col("low1") * limit.percent) & (F.col("high1") * 100 >= F.col("low2") * limit.percent)
    sized = pairs.join(of(1), "c1").join(of(2), "c2").where(fits)
    first = F.col("r1") >= F.col("r2")
    larger = lambda name: F.when(first, F.col(f"{name}1")).otherwise(F.col(f"{name}2"))
    units = staging.write(sized.select(larger("c").alias("unit"), larger("low").alias("low"), larger("high").alias("high"), F.when(first, F.col("c2")).otherwise(F.col("c1")).alias("other")), "units")
    near = (F.col("n") * 100 >= F.col("low") * limit.percent) & (F.col("high") * 100 >= F.col("n") * limit.percent)
    asking = units.join(member.withColumnRenamed("c", "other"), "other").where(near).select("unit", "node", F.col("other").alias("c"))
    members = units.select("unit").distinct().join(member, F.col("unit") == F.col("c")).select("unit", "node", "c")
    close = _compared(asking, members, sets, limit, block_rows, staging, "pairwise")

    crowded = placed.join(meeting.where(F.col("met") > few).select("entry").distinct(), "entry")
    spans = crowded.groupBy("entry").agg(F.min("node").alias("first"))
    links = crowded.join(spans, "entry").where(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    clusters = components(links, staging, "clusters").select("node", F.col("component").alias("unit")).join(member, "node")
    main = clusters.groupBy("unit", "c").agg(F.count("*").alias("held")).groupBy("unit").agg(F.max(F.struct("held", "c"))["c"].alias("main"))
    clusters = staging.write(clusters.join(main, "unit"), "clustered")
    crowd = _compared(clusters.where("c <> main").select("unit", "node", "c"), clusters.select("unit", "node", "c"), sets, limit, block_rows, staging, "crowded")
    return close.unionByName(crowd).distinct()


def _class_links(sets: DataFrame, limit: Threshold, frequent_from: int, block_rows: int, staging: Staging) -> DataFrame:
    """Components of the classes: (node, component) for nodes with links."""
    n = F.col("n")
    least = F.ceil(n * limit.percent / 100)
    # At least the prefix of index_entries: the bracket's classes are at most max(16, n / 16).
    longest = F.least(n, n - least + F.greatest(F.lit(17), F.floor(n / 16) + 1)).cast("int")
    prefixes = sets.select("node", "n", F.explode(F.slice("tokens", F.lit(1), longest)).alias("token"))
    df = prefixes.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    marked = prefixes.join(df, "token").groupBy("node", "n").agg((F.sum(F.log("df")) / F.col("n")).alias("rank"), F.collect_list(F.struct("token", "df")).alias("pairs"))
    entries = staging.write(_entries(marked, limit, frequent_from), "entries")

    leaders = entries.groupBy("entry").agg(F.max(F.struct("rank", "node", "n")).alias("leader"), F.count("*").alias("held")).where("held > 1")
    fits = F.least(n, "leader.n") * 100 >= F.greatest(n, "leader.n") * limit.percent
    stars = entries.join(leaders, "entry").where((F.col("node") != F.col("leader.node")) & fits)
    stars = stars.select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")).distinct()
    links = staging.write(_verified(stars, sets, limit), "star-links")
    near = components(links, staging, "star")

    placed = entries.join(near, "node", "left").select("entry", "node", "n", F.coalesce("component", "node").alias("c"))
    placed = staging.write(placed, "placed")
    staging.drop("entries")
    more = staging.write(_across(placed, sets, limit, staging, block_rows), "more-links")
    staging.drop("placed", "members", "meeting", "units", "pairwise", "clustered", "crowded")
    if more.isEmpty():
        return near
    return components(links.unionByName(more), staging, "all")


def ngram_components(docs: DataFrame, *, percent: int = 75, frequent_from: int = 64, block_rows: int = 2048) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id.

    ``frequent_from``: the number of sets from which a shingle counts as
    frequent, and ``block_rows`` the sets compared at a time; they set the cost, not the result.
    """
    spark = docs.sparkSession
    staging, limit = Staging(spark, "ngrams"), Threshold(percent)
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_parts = max(parts(spark, 64), -(-chars // _PART_CHARS))
    marks = staging.write(_mark_shared(_deal_prefixes(docs, limit, n_parts), n_parts), "marks")
    rows = marks.where("whole").select("doc_id", "n", "h1", "h2")
    shared = marks.where("doc_id is not null").groupBy("doc_id").agg(F.sum("shared").alias("shared"), F.min(F.when(F.col("whole") & (F.col("n") > 0), F.col("n"))).alias("n"))
    least = F.ceil(F.col("n") * percent / 100)
    wanted = F.least(least, F.greatest(F.lit(17), F.floor(least / 6)))
    left = shared.where((F.col("n") > 0) & (F.col("shared") >= wanted)).select("doc_id")

    classes = rows.where("n > 0").join(left, "doc_id", "left_semi").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("node"))
    classes = staging.write(classes, "classes")
    chosen = classes.where("n > 0").select(F.col("node").alias("__node"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, F.col("doc_id") == F.col("__node"), "left_semi")
    # Equal rows of a class give equal sets; a class keeps one.
    sets = _sets(texts).join(classes, ["h1", "h2", "n"]).groupBy("node", "h1", "h2", "n").agg(F.first("tokens").alias("tokens"))
    sets = staging.write(sets, "sets", **_FILTER_FIRST)
    near = _class_links(_pruned(sets, limit, staging, n_parts), limit, frequent_from, block_rows, staging)
    found = classes.join(near, "node", "left").select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.col("n").alias("cn"), F.coalesce("component", "node").alias("component"))
    joined = rows.join(found, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & (F.col("n") == F.col("cn")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
