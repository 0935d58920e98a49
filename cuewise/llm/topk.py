"""Exact top-k by no-random-access aggregation.

Method: every component has a list of its values in order.  A query's score is a sum of
one contribution a list; lists are read in step, from the end that adds most to it, each entry
once.  A row's lower bound is what was read of it plus the least that its other lists can add; its
upper bound adds what stands at the places read so far instead.  Reading stops when
the rows that can still reach the k-th score, be it of this block's lower bounds or of blocks
read before, are few; their scores are then resolved.

Scale: candidates are dealt to runs of blocks and queries to slices by a hash, and each pair of a run
and a slice is one task, in which the slice's queries pass the run's blocks one after the other and take
their k-th score along.  Both sides' sizes are bounded, so a task's memory does not follow the
input, and candidates move once a slice of thousands of queries.  A task gives at most k
rows a query; those meet in a window that Spark limits to k rows a query before its shuffle.
All queries against all rows is work in proportion to both: bounds save reading, not that.

Edge cases: vectors that are null, empty or hold a null or non-finite component
take no part, nor do lengths other than the common one; rows of equal id count once, as the first of
their vectors in order; ties go to the smaller id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .staging import Staging, parts
from .vectors import matrix, of_one_length, usable

#: Shares of the lists after which bounds are compared.
DEPTHS = (1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 1)


class SortedLists:
    """A block of integer vectors with a list (values in rising order and their rows) of each component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        # Doubles hold these sums exactly, and multiply faster than integers.
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        rows = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.ascontiguousarray(np.take_along_axis(self.vectors, rows, axis=0).T)
        self.rows = np.ascontiguousarray(rows.T)

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int, reached: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of its best ``k`` other rows, best first, ties to the smaller id.

        ``reached``: a score that a row must reach to count for each query, as its k-th best elsewhere.
        """
        n, q = len(self.ids), queries.astype(np.float64)
        place = np.searchsorted(self.ids, query_ids)
        own = np.where((place < n) & (self.ids[np.minimum(place, n - 1)] == query_ids), place, -1)
        reached = np.full(len(q), -np.inf) if reached is None else reached
        out: list = [None] * len(q)
        active, reader = np.arange(len(q)), _Reader(self, q)
        for depth in sorted({max(1, round(n * share)) for share in DEPTHS}):
            reader.read(depth)
            lower, upper = reader.lower, reader.upper()
            here = np.flatnonzero(own[active] >= 0)
            at = own[active[here]]
            lower_own, lower[at, here] = lower[at, here], -np.inf
            upper[at, here] = -np.inf
            kth = np.partition(lower, n - k, axis=0)[n - k] if n >= k else np.full(len(active), -np.inf)
            lower[at, here] = lower_own
            qualify = (upper >= np.maximum(kth, reached[active])) & (upper > -np.inf)
            done = (qualify.sum(axis=0) <= max(4 * k, n // 16)) | (depth == n)
            for c in np.flatnonzero(done):
                found, i = np.flatnonzero(qualify[:, c]), active[c]
                scores = (self.vectors[found] @ q[i]).astype(np.int64)
                best = np.lexsort((self.ids[found], -scores))[:k]
                out[i] = (self.ids[found[best]], scores[best])
            active = active[~done]
            if not len(active):
                break
            reader.keep(~done)
        return out


class _Reader:
    """What some queries know of a block's rows after reading all lists to one depth from both ends.

    Positive components of a query read from the top, negative ones from the bottom.
    """

    def __init__(self, lists: SortedLists, queries: np.ndarray):
        self.lists, self.depth = lists, 0
        self.up, self.down = np.maximum(queries, 0).T.copy(), np.minimum(queries, 0).T.copy()
        self.low, self.high = lists.values[:, 0], lists.values[:, -1]
        least = self.low @ self.up + self.high @ self.down
        self.lower = np.repeat(least[None, :], len(lists.ids), axis=0)
        self.unread = np.ones((len(lists.ids), 2 * len(self.low)))

    def read(self, depth: int) -> None:
        """Read on to ``depth``: each entry adds what its row has above the least it could have had."""
        lists, n = self.lists, len(self.lists.ids)
        for j in range(len(self.low)):
            for at, weight, end, side in ((slice(n - depth, n - self.depth), self.up[j], self.low[j], 0), (slice(self.depth, depth), self.down[j], self.high[j], len(self.low))):
                rows = lists.rows[j, at]
                self.lower[rows] += np.multiply.outer(lists.values[j, at] - end, weight)
                self.unread[rows, side + j] = 0
        self.depth = depth

    def upper(self) -> np.ndarray:
        """Lower bounds, and for lists in which a row was not met the difference to what stands at the depth reached."""
        n, d = len(self.lists.ids), self.depth
        top, bottom = self.lists.values[:, n - d] - self.low, self.lists.values[:, d - 1] - self.high
        return self.lower + self.unread @ np.concatenate([self.up * top[:, None], self.down * bottom[:, None]])

    def keep(self, chosen: np.ndarray) -> None:
        self.up, self.down, self.lower = self.up[:, chosen], self.down[:, chosen], np.ascontiguousarray(self.lower[:, chosen])


def best_of_run(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, block_rows: int, query_rows: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query id repeated, ids, scores) of each query's best rows in a run of blocks, which it passes with its k-th score so far."""
    blocks = [SortedLists(ids[a : a + block_rows], vectors[a : a + block_rows]) for a in range(0, len(ids), block_rows)]
    out = []
    for a in range(0, len(query_ids), query_rows):
        own, asked = query_ids[a : a + query_rows], queries[a : a + query_rows]
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(own)
        for block in blocks:
            reached = np.array([s[-1] if len(s) == k else -np.inf for _, s in best], np.float64)
            for c, (new_ids, new_scores) in enumerate(block.top(own, asked, k, reached)):
                held, scores = np.concatenate([best[c][0], new_ids]), np.concatenate([best[c][1], new_scores])
                first = np.lexsort((held, -scores))[:k]
                best[c] = held[first], scores[first]
        out += [(np.full(len(i), q), i, s) for q, (i, s) in zip(own.tolist(), best, strict=True)]
    return out


def quantised(table: DataFrame, scale: int) -> DataFrame:
    """(vec_id, vec): components times ``scale``, rounded down, one row an id."""
    rows = of_one_length(usable(table, zero=True)).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    return rows.select("vec_id", F.transform("vec", lambda x: F.floor(x * scale).cast("long")).alias("vec"))


def top_k(table: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, block_rows: int = 2048, query_rows: int = 64, run_rows: int = 32_768, slice_rows: int = 8192) -> DataFrame:
    """Each query's ``k`` highest integer inner products: query_id, rank, vec_id, score."""
    spark = table.sparkSession
    rows = Staging(spark, "topk").write(quantised(table, scale), "rows")
    n, asked = rows.agg(F.count("*"), F.count_if(is_query)).first()
    runs, tasks = max(1, -(-n // run_rows)), parts(spark)
    # Small tables: more slices, down to one group of queries each, so that all cores have work.
    slices = max(1, -(-asked // slice_rows), min(-(-tasks // runs), -(-asked // query_rows)))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    number = lambda count, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count)).cast("int")
    candidates = rows.select(number(runs, "run").alias("run"), every(slices).alias("slice"), "vec_id", "vec")
    queries = rows.where(is_query).select(every(runs).alias("run"), number(slices, "slice").alias("slice"), F.col("vec_id").alias("query_id"), F.col("vec").alias("query"))

    def compare(held: pa.Table, asking: pa.Table) -> pa.Table:
        names, found = ["query_id", "vec_id", "score"], []
        if held.num_rows and asking.num_rows:
            vectors, wanted = matrix(held.column("vec").combine_chunks()), matrix(asking.column("query").combine_chunks())
            found = best_of_run(held.column("vec_id").to_numpy(), vectors, asking.column("query_id").to_numpy(), wanted, k, block_rows, query_rows)
        columns = zip(*found, strict=True) if found else [()] * 3
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *c]), pa.int64()) for c in columns], names=names)

    keys, count = ("run", "slice"), min(runs * slices, max(tasks, 2000))
    left, right = candidates.repartition(count, *keys), queries.repartition(count, *keys)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
