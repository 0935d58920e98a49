"""Approximate nearest neighbours by inner product over balanced posting lists.

Method: centroids are fitted on a bounded sample, level by level, with a penalty on large clusters.
A vector goes into the list of its nearest centroid and, at a boundary, into those of
other centroids nearly as near, unless a list already chosen lies between.
For queries the centroids are searched through a neighbour graph held in memory, and a
distance ratio to the best one selects the lists that a query reads.  The ratio and the most lists
follow from the table: some queries of different vectors (``tried``) are compared with
all vectors, and of the pairs of a ratio and a number that find ``aim`` of those neighbours, and ``hard_aim`` of those of
the quarter of them that finds least, that with the
fewest lists on average is taken; so many queries that are easy do not make up for a few that find little.
A query reads on until its lists surely hold ``k`` other rows.  Inner products
become distances by one more component that brings all vectors to one length.

Scale: lists follow the number of vectors up to ``max_lists`` and a quarter of the sample, which bounds the graph that tasks hold, as
``sample_rows`` bounds what it is fitted on.  Vectors are compared with all centroids some at a time, in bounded memory.  Lists that the fit put side by side form a
group, and a query goes once to each group with lists that it reads.  A group's vectors and the
queries that read it are both cut into chunks of bounded length by a hash, so neither a list into which a third of
all vectors fall nor one that all queries read is one task's work.  A group's chunk returns one row
of its best few for each query; a query's rows are bounded by the lists it reads.

Edge cases: vectors that are null, zero, empty or hold a null or non-finite
component take no part, nor do lengths other than the common one; rows of equal id count
once, as the first of their vectors in order; ties go to the smaller id; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .staging import Staging
from .vectors import matrix, of_one_length, usable


#: Distances to centroids held at a time.
_COMPARED = 4_000_000
#: Added to squared distances, so that a ratio to none is defined.
_TINY = 1e-12


@dataclass
class Graph:
    """Centroids, each linked to its nearest ones and some far ones."""

    centroids: np.ndarray
    links: np.ndarray
    entry: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray, degree: int = 24, seed: int = 5) -> Graph:
        n = len(centroids)
        norms = (centroids**2).sum(axis=1)
        near = np.empty((n, min(degree, n)), np.int64)
        for at in range(0, n, 1024):
            d = norms - 2 * centroids[at : at + 1024] @ centroids.T
            near[at : at + 1024] = np.argsort(d, axis=1, kind="stable")[:, : near.shape[1]]
        far = np.random.default_rng(seed).integers(0, n, (n, 4))
        return cls(centroids, np.concatenate([near, far], axis=1), np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def nearest(self, point: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search: some ``want`` nearest centroids and their squared distances, nearest first."""
        seen = np.zeros(len(self.centroids), bool)
        pool = self.entry
        seen[pool] = True
        found = ((self.centroids[pool] - point) ** 2).sum(axis=1)
        open_ = np.ones(len(pool), bool)
        while open_.any():
            order = np.argsort(found, kind="stable")[: max(want, 16)]
            pool, found, open_ = pool[order], found[order], open_[order]
            step = np.flatnonzero(open_)[:4]
            if not len(step):
                break
            open_[step] = False
            new = np.unique(self.links[pool[step]])
            new = new[~seen[new]]
            seen[new] = True
            pool = np.concatenate([pool, new])
            found = np.concatenate([found, ((self.centroids[new] - point) ** 2).sum(axis=1)])
            open_ = np.concatenate([open_, np.ones(len(new), bool)])
        order = np.argsort(found, kind="stable")[:want]
        return pool[order], found[order]


def balanced_centroids(points: np.ndarray, k: int, *, rounds: int = 12, seed: int = 4) -> np.ndarray:
    """K-means whose assignment adds to each distance a share for the cluster's size so far."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    k = min(k, len(distinct))
    centroids = distinct[rng.choice(len(distinct), k, replace=False)]
    # By the median, as one far point would make the share outweigh all distances.
    spread = np.median(((points - np.median(points, axis=0)) ** 2).sum(axis=1))
    sizes, scale = np.full(k, len(points) / k), spread * k / len(points)
    for _ in range(rounds):
        load = 0.1 * scale * (sizes - len(points) / k)
        owner = np.concatenate([np.argmin((centroids**2).sum(axis=1) - 2 * points[a : a + 2048] @ centroids.T + load, axis=1) for a in range(0, len(points), 2048)])
        sizes = 0.5 * sizes + 0.5 * np.bincount(owner, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, points)
        some = np.bincount(owner, minlength=k) > 0
        centroids[some] = sums[some] / np.bincount(owner, minlength=k)[some, None]
    return centroids


def centroid_tree(points: np.ndarray, k: int, *, wide: int = 64) -> np.ndarray:
    """Some ``k`` centroids, those near each other side by side: beyond ``wide`` of them clusters of clusters."""
    if k <= wide:
        return balanced_centroids(points, max(1, k))
    top = balanced_centroids(points, min(wide, round(k**0.5)))
    owner = np.concatenate([np.argmin((top**2).sum(axis=1) - 2 * points[a : a + 2048] @ top.T, axis=1) for a in range(0, len(points), 2048)])
    own = [part for part in (points[owner == c] for c in range(len(top))) if len(part)]
    if len(own) < 2:  # equal points, or as good as
        return balanced_centroids(points, wide)
    return np.concatenate([centroid_tree(part, max(1, round(k * len(part) / len(points))), wide=wide) for part in own])


def lifted(vectors: np.ndarray, longest: float, *, shifted: bool = False) -> np.ndarray:
    """Vectors with the component that brings them all to the longest one's length; ``shifted``: less that length.

    The shift changes no distance, and short vectors beside a very long one keep their digits.
    """
    norms = (vectors**2).sum(axis=1)
    rest = np.sqrt(np.maximum(longest**2 - norms, 0))
    last = -norms / np.maximum(longest + rest, _TINY) if shifted else rest
    return np.concatenate([vectors, last[:, None]], axis=1)


def closures(centroids: np.ndarray, points: np.ndarray, copies: int, ratio: float) -> list[list[int]]:
    """The lists of each vector: the nearest, and others within ``ratio`` of its distance that no chosen one lies before."""
    norms, some = (centroids**2).sum(axis=1), min(4 * copies, len(centroids))
    out: list[list[int]] = []
    together = max(16, min(1024, _COMPARED // len(centroids)))
    for at in range(0, len(points), together):
        part = points[at : at + together]
        d = np.maximum((part**2).sum(axis=1)[:, None] + norms - 2 * part @ centroids.T, 0)
        near = np.argpartition(d, some - 1, axis=1)[:, :some] if some < len(centroids) else np.tile(np.arange(some), (len(part), 1))
        far = np.take_along_axis(d, near, axis=1)
        order = np.argsort(far, axis=1, kind="stable")
        near, far = np.take_along_axis(near, order, axis=1), np.take_along_axis(far, order, axis=1)
        own = centroids[near]
        between = norms[near][:, :, None] + norms[near][:, None, :] - 2 * own @ own.transpose(0, 2, 1)
        chosen = np.zeros(near.shape, bool)
        chosen[:, 0] = True
        for c in range(1, some):
            clear = (~chosen | (between[:, c] > 0.25 * far[:, c : c + 1])).all(axis=1)
            chosen[:, c] = clear & (far[:, c] <= ratio**2 * far[:, 0] + 1e-12) & (chosen.sum(axis=1) < copies)
        out += [n[c].tolist() for n, c in zip(near, chosen, strict=True)]
    return out


def true_neighbours(rows: DataFrame, points: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, np.ndarray]]:
    """For each of a few queries its place in ``points`` and the vectors of its ``k`` nearest other rows, from all rows."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0), np.empty(0, np.int64), np.empty((0, points.shape[1])))] * len(points)
        for batch in batches:
            own, vectors = batch.column(0).to_numpy(), matrix(batch.column(1))
            for q, row in enumerate((vectors @ points.T).T):
                far = np.where(own == ids[q], np.inf, -row)
                top = np.argsort(far, kind="stable")[:k]
                top = top[np.isfinite(far[top])]
                far, named, found = (np.concatenate(x) for x in zip(held[q], (far[top], own[top], vectors[top]), strict=True))
                top = np.lexsort((named, far))[:k]
                held[q] = far[top], named[top], found[top]
        out = [(q, f, i, v.tolist()) for q, h in enumerate(held) for f, i, v in zip(*h, strict=True)]
        columns = zip(*out, strict=True) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())), strict=True)], names=["q", "far", "vec_id", "vec"])

    found = rows.select("vec_id", "vec").mapInArrow(best, "q int, far double, vec_id long, vec array<double>")
    first = F.slice(F.array_sort(F.collect_list(F.struct("far", "vec_id", "vec"))), 1, k)
    return [(r.q, np.array([b.vec for b in r.best])) for r in found.groupBy("q").agg(first.alias("best")).collect()]


@dataclass(frozen=True)
class Aim:
    """What share of their true neighbours the queries that are tried have to find: all of them, and the hardest quarter."""

    mean: float
    hard: float

    @classmethod
    def of(cls, aim: Aim | float) -> Aim:
        return aim if isinstance(aim, Aim) else cls(aim, 0.0)

    def met(self, recalls: np.ndarray) -> bool:
        least = np.sort(recalls)[: -(-len(recalls) // 4)]
        return bool(recalls.mean() >= self.mean - 1e-9 and least.mean() >= self.hard - 1e-9)


def lists_needed(graph: Graph, points: np.ndarray, neighbours: list[tuple[int, list[list[int]]]], aim: Aim | float) -> int:
    """The fewest nearest lists (within an eighth) with which the ``aim`` is met, found through the graph."""

    aim = Aim.of(aim)

    def recalls(want: int) -> np.ndarray:
        read = {q: set(graph.nearest(points[q], want)[0].tolist()) for q, _ in neighbours}
        return np.array([np.mean([not read[q].isdisjoint(lists) for lists in own]) for q, own in neighbours])

    want, most = 1, len(graph.centroids)
    while want < most and not aim.met(recalls(want)):
        want = min(most, want + max(1, want // 8))
    return want


def pruning(graph: Graph, points: np.ndarray, neighbours: list[tuple[int, list[list[int]]]], aim: Aim | float, needed: int) -> tuple[int, float, float]:
    """(most, ratio, mean): of the nearest ``most`` lists a query reads those within ``ratio`` of the first one's distance, ``mean`` on average.

    Of the pairs that meet the ``aim``, as the nearest ``needed`` lists do, that with the fewest lists
    read; with more lists to choose from, the ratio can be smaller.
    """
    aim, best = Aim.of(aim), (needed, np.inf, float(needed))
    for most in sorted({min(len(graph.centroids), round(needed * wider)) for wider in (1, 1.25, 1.5, 2, 3)}):
        ratios, found = [], []
        for q, own in neighbours:
            near, d = graph.nearest(points[q], most)
            ratio = np.sqrt((d + _TINY) / (d[0] + _TINY))
            ratios.append(ratio)
            at = dict(zip(near.tolist(), ratio.tolist(), strict=True))
            found.append(np.array([min((at[x] for x in lists if x in at), default=np.inf) for lists in own]))
        # The smallest ratio that finds enough is one at which some neighbour is found.
        places = np.unique(np.concatenate(found))
        places = places[np.isfinite(places)]
        low, high = 0, len(places)
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if aim.met(np.array([(f <= places[middle]).mean() for f in found])) else (middle + 1, high)
        if low < len(places):
            ratio = float(places[low])
            mean = float(np.mean([(r <= ratio * (1 + 1e-9)).sum() for r in ratios]))
            if mean < best[2]:
                best = most, ratio * (1 + 1e-9), mean
    return best


def read_lists(graph: Graph, sizes: np.ndarray, point: np.ndarray, probes: int, least_probes: int, ratio: float, enough: int) -> np.ndarray:
    """The lists that a query reads, in order: those within ``ratio``, ``least_probes`` at least, and on until they hold ``enough`` rows."""
    near, d = graph.nearest(point, probes)
    if sizes[near].sum() < enough:
        d = ((graph.centroids - point) ** 2).sum(axis=1)
        near = np.argsort(d, kind="stable")
        near = near[: max(probes, int(np.searchsorted(np.cumsum(sizes[near]), enough)) + 1)]
        d = d[near]
    held = np.cumsum(sizes[near]) - sizes[near]
    return np.sort(near[((d + _TINY <= ratio**2 * (d[0] + _TINY)) & (np.arange(len(d)) < probes)) | (np.arange(len(d)) < least_probes) | (held < enough)])


def search(
    table: DataFrame,
    is_query: Column,
    *,
    k: int = 20,
    sample_rows: int = 100_000,
    list_rows: int = 128,
    max_lists: int = 16_384,
    copies: int = 4,
    boundary_ratio: float = 1.15,
    probes: int = 32,
    least_probes: int = 4,
    prune_ratio: float = 1.6,
    group_lists: int = 16,
    chunk_rows: int = 8192,
    ask_rows: int = 4096,
    tried: int = 100,
    aim: float = 0.96,
    hard_aim: float = 0.92,
) -> DataFrame:
    """Each query's ``k`` nearest other rows found: query_id, rank, vec_id, score (the inner product).

    ``probes``, ``least_probes`` and ``prune_ratio`` hold where there is nothing to try; else what is read follows from ``aim``,
    and is ``least_probes`` lists at least.
    """
    spark = table.sparkSession
    staging = Staging(spark, "neighbours")
    rows = of_one_length(usable(table, zero=False)).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    rows = staging.write(rows, "rows")
    # Lists are made of vectors brought to components within 1, whose squares neither overflow nor vanish.
    scale = rows.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0] or 1.0
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x / F.lit(scale)) * (x / F.lit(scale)))
    n, longest = rows.agg(F.count("*"), F.sqrt(F.coalesce(F.max(norm), F.lit(0.0)))).first()
    space = 1 << 30
    share = int(space * min(1.0, sample_rows / max(1, n)))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(space)) < share).limit(2 * sample_rows).select("vec").toPandas()["vec"] if n else []
    if len(sample) == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points = lifted(np.stack(list(sample)) / scale, longest, shifted=True)
    lists = int(min(max_lists, max(1, n // list_rows), max(1, len(points) // 4)))
    graph = Graph.build(centroid_tree(points, lists))

    def placed(vectors: np.ndarray) -> np.ndarray:
        # Of a query only the direction matters; at the lifted radius its own distances compare best.
        vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        return np.concatenate([vectors / np.linalg.norm(vectors, axis=1, keepdims=True) * longest, np.full((len(vectors), 1), -longest)], axis=1)

    if lists > least_probes:
        asking = rows.where(is_query).groupBy("vec").agg(F.min("vec_id").alias("vec_id"))
        some = int(space * min(1.0, 2 * tried / max(1, asking.count())))
        trial = asking.where(F.pmod(F.xxhash64("vec_id", F.lit("trial")), F.lit(space)) < some).limit(tried).select("vec_id", "vec").toPandas()
        if len(trial):
            asked = np.stack(list(trial["vec"]))
            near = true_neighbours(rows, asked, trial["vec_id"].to_numpy(np.int64), k)
            homes = [(q, closures(graph.centroids, lifted(v / scale, longest, shifted=True), copies, boundary_ratio)) for q, v in near]
            wanted = Aim(aim, hard_aim)
            needed = lists_needed(graph, placed(asked), homes, wanted) if homes else 1
            probes, prune_ratio, _ = pruning(graph, placed(asked), homes, wanted, needed) if homes else (probes, prune_ratio, 0.0)
            probes = max(probes, least_probes)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = closures(graph.centroids, lifted(matrix(batch.column(1)) / scale, longest, shifted=True), copies, boundary_ratio)
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([pa.array([c for f in found for c in f], pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], names=["list", "vec_id", "vec"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, groups, wanted = [], [], []
            for i, point in enumerate(placed(matrix(batch.column(1)))):
                read = read_lists(graph, list_sizes, point, probes, least_probes, prune_ratio, enough)
                for part in np.split(read, np.flatnonzero(np.diff(read // group_lists)) + 1):
                    at.append(i)
                    groups.append(int(part[0]) // group_lists)
                    wanted.append(part.tolist())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), batch.column(0).take(at), batch.column(1).take(at), pa.array(wanted, pa.list_(pa.int32()))], names=["group", "query_id", "query", "lists"])

    posted = staging.write(rows.mapInArrow(post, "list int, vec_id long, vec array<double>").withColumn("group", F.floor(F.col("list") / group_lists).cast("int")), "lists")
    list_sizes = np.zeros(len(graph.centroids), np.int64)
    for row in posted.groupBy("list").count().collect():
        list_sizes[row["list"]] = row["count"]
    # A vector is in at most ``copies`` lists, so these many rows are of more than k different ones.
    enough = copies * (k + 1)
    queries = staging.write(rows.where(is_query).mapInArrow(probe, "group int, query_id long, query array<double>, lists array<int>"), "asking")
    cut = lambda found, most, name: found.groupBy("group").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = cut(posted, chunk_rows, "chunks").join(cut(queries, ask_rows, "asks"), "group")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    number = lambda name, count: F.pmod(F.xxhash64(name), F.col(count)).cast("int")
    dealt = posted.join(sizes, "group").select("group", number("vec_id", "chunks").alias("chunk"), every("asks").alias("ask"), "list", "vec_id", "vec")
    asked = queries.join(sizes, "group").select("group", every("chunks").alias("chunk"), number("query_id", "asks").alias("ask"), "query_id", "query", "lists")

    def compare(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        names, out = ["query_id", "far", "ids"], []
        if vectors.num_rows and queries.num_rows:
            ids, first, at = np.unique(vectors.column("vec_id").to_numpy(), return_index=True, return_inverse=True)
            all_rows, points = matrix(vectors.column("vec").combine_chunks())[first], matrix(queries.column("query").combine_chunks())
            held, wanted = np.zeros((group_lists, len(ids))), np.zeros((len(points), group_lists))
            held[vectors.column("list").to_numpy() % group_lists, at] = 1
            lists = queries.column("lists").combine_chunks()
            wanted[np.repeat(np.arange(len(points)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy() % group_lists] = 1
            low = max(0, len(ids) - k - 1)
            for a in range(0, len(points), 256):
                rough = points[a : a + 256] @ all_rows.T
                edge = 1e-9 * np.abs(rough).max(axis=1)
                rough[wanted[a : a + 256] @ held == 0] = -np.inf
                least = np.partition(rough, low, axis=1)[:, low] - edge
                for q, point, row, bound in zip(queries.column("query_id").to_numpy()[a : a + 256].tolist(), points[a : a + 256], rough, least, strict=True):
                    # Summed a row at a time, so that a vector scores the same in each of its groups.
                    likely = np.flatnonzero((row >= bound) & (row > -np.inf) & (ids != q))
                    far = -(all_rows[likely] * point).sum(axis=1)
                    top = np.argsort(far, kind="stable")[:k]
                    out.append((q, far[top], ids[likely[top]]))
        columns = zip(*out, strict=True) if out else [()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())), strict=True)], names=names)

    keys = ("group", "chunk", "ask")
    found = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(compare, "query_id long, far array<double>, ids array<long>")
    # A query has at most ``probes`` groups' chunks of k each; a vector found in several of them counts once.
    # It is in at most ``copies`` lists, so the first k different ones are among the first copies * k.
    every = F.flatten(F.collect_list(F.arrays_zip("far", "ids")))
    first = F.slice(F.array_sort(every), 1, copies * k)
    best = found.groupBy("query_id").agg(F.slice(F.array_distinct(first), 1, k).alias("best"))
    ranked = best.select("query_id", F.posexplode("best").alias("rank", "b"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.ids").alias("vec_id"), (-F.col("b.far")).alias("score"))
