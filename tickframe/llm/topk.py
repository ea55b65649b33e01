"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are whole numbers. A shard of candidates keeps, per dimension, postings in segments of equal
quantised value. For a query, a segment's impact is the largest contribution it can still add above the
dimension's smallest one. Segments are taken in descending impact and added into accumulators; what is
left in each dimension bounds every score from above. A query stops only when the k-th best lower bound
proves that most candidates cannot enter; the possible members that remain are scored again, exactly.
The queries of a block read each their own segments and add them up in one matrix product.

Every block of queries goes once through every shard, and each meeting returns at most k rows per query.
A copy of a shard is indexed once and meets several blocks. The results of the shards are then merged by a
window that Spark prunes before its shuffle. Blocks and shards have fixed sizes, so their numbers grow with the data.

Edge cases: vectors that are null, empty, or hold a null or non-finite component take no part, nor does a
row without id or of another length than the query's. Rows with the same id are candidates each, but
never of a query with this id; their queries are one, of the smallest vector. Fewer candidates than k give fewer rows. Ties go to the smaller id.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 32_768  # candidates of a shard
BLOCK = 256     # queries of a block
SEGMENTS = 6    # segments of a dimension
RESCORED = 3    # a search may stop when at most one in so many candidates is still possible
LEFT = (1 / 64, 1 / 256, 0)  # a search looks whether it may stop when at most so much of all impact is left
BLOCKS = 16     # blocks of queries that one copy of a shard meets, unless tasks would be too few
POSTINGS = 1 << 25  # numbers in the postings of one index; wider vectors have smaller ones


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) per component; null if the vector cannot take part."""
    usable = vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


class Index:
    """Postings of one shard in segments of descending value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        n = len(ids)
        cuts = np.unique(np.linspace(0, n, min(SEGMENTS, n) + 1).astype(int))
        across = np.ascontiguousarray(self.vectors.T)
        order = np.argsort(-across, axis=1, kind="stable")
        values = np.take_along_axis(across, order, axis=1)
        #: Per segment and dimension the largest value (``top``) and the smallest one (``low``); per dimension each candidate's segment.
        self.top, self.low = values[:, cuts[:-1]].T, values[:, cuts[1:] - 1].T
        self.segment = np.empty_like(order, dtype=np.int8)
        np.put_along_axis(self.segment, order, np.repeat(np.arange(len(cuts) - 1, dtype=np.int8), np.diff(cuts))[None], axis=1)
        self._postings = np.zeros((0, n))

    def postings(self, kind: type) -> np.ndarray:
        """A row for each direction, segment in this direction and dimension: its candidates' values above the dimension's
        smallest one or, for negative weights, below its largest one; 0 for all other candidates."""
        if self._postings.dtype != kind or not len(self._postings):
            (segments, dims), n = self.top.shape, len(self.ids)
            rows = np.zeros((2, segments, dims, n), kind)
            every = np.arange(dims)[:, None], np.arange(n)
            rows[0][self.segment, *every] = self.vectors.T - self.low[-1][:, None]
            rows[1][segments - 1 - self.segment, *every] = self.vectors.T - self.top[0][:, None]
            self._postings = rows.reshape(-1, n)
        return self._postings

    def search(self, query: np.ndarray, k: int, barred: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, score) of the k best, except rows with the id ``barred``; ties to the smaller id."""
        return self.search_block(query[None], k, np.array([barred]))[0]

    def search_block(self, queries: np.ndarray, k: int, barred: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for each of several queries. Each reads the segments in its own order; they add them up together."""
        n, segments = len(self.ids), len(self.top)
        up = queries[:, None] > 0
        # Towards descending contribution a dimension is read forwards or, for a negative weight, backwards.
        best = np.where(up, self.top, self.low[::-1]) * queries[:, None]
        floor = np.where(up, self.low[-1], self.top[0]) * queries[:, None]
        impact = best - floor
        queue = np.argsort(-impact.reshape(len(queries), -1), axis=1, kind="stable")
        turn = np.empty_like(queue)
        np.put_along_axis(turn, queue, np.arange(queue.shape[1])[None], axis=1)
        # What unread postings can still add, after each step: in each dimension the impact of its next segment.
        fall = -np.diff(impact, axis=1, append=0).reshape(len(queries), -1)
        most = impact[:, 0].sum(axis=1)
        left = most[:, None] - np.cumsum(np.take_along_axis(fall, queue, axis=1), axis=1)
        # Sums are whole numbers between 0 and this one; floats that hold them exactly are multiplied faster.
        largest = (np.abs(queries).astype(float) @ (self.top[0].astype(float) - self.low[-1])).max(initial=0)
        kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64
        postings = self.postings(kind)
        own = np.searchsorted(self.ids, barred), np.searchsorted(self.ids, barred, "right")
        kth = max(0, n - k)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        asked, score, done = np.arange(len(queries)), np.zeros((len(queries), n), kind), np.zeros(len(queries), np.int64)
        for share in LEFT:
            stop = np.minimum((left[asked] > share * most[asked, None]).sum(axis=1) + 1, queue.shape[1])
            step = turn[asked].reshape(-1, segments, queries.shape[1])
            read = (step >= done[asked, None, None]) & (step < stop[:, None, None])
            weights = np.where(read, queries[asked, None], 0)
            weights = np.stack([np.where(up[asked], weights, 0), np.where(up[asked], 0, weights)], axis=1)
            score += weights.reshape(len(asked), -1).astype(kind) @ postings
            done[asked] = stop
            for at, q in enumerate(asked):
                score[at, own[0][q]:own[1][q]] = -1
            worst = np.partition(score, kth, axis=1)[:, kth]
            possible = score >= (worst - left[asked, stop - 1]).astype(kind)[:, None]
            proven = (possible.sum(axis=1) <= max(4 * k, n // RESCORED)) | (share == 0)
            for at in np.flatnonzero(proven):
                q = asked[at]
                members = np.flatnonzero(possible[at])
                members = members[(members < own[0][q]) | (members >= own[1][q])]
                exact = self.vectors[members] @ queries[q]
                chosen = np.lexsort((self.ids[members], -exact))[:k]
                found[q] = members[chosen], exact[chosen]
            asked, score = asked[~proven], score[~proven]
            if not len(asked):
                break
        return found


def _of_width(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows with so many components."""
    rows = rows.filter(pc.equal(pc.list_value_length(rows["v"]), width))
    return rows["id"].to_numpy(), pc.list_flatten(rows["v"]).to_numpy().reshape(-1, width)


def search(vectors: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of every query (ids divisible by ``every``)."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), whole(F.col(vector_column)).alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull())
    asked = rows.filter(F.col("id") % every == 0)
    sizes = rows.agg(F.count("*").alias("all"), F.count_if(F.col("id") % every == 0).alias("asked")).first()
    shards, blocks = max(1, ceil(sizes["all"] / SHARD)), max(1, ceil(sizes["asked"] / BLOCK))
    # Each copy of a shard meets BLOCKS blocks of queries, or fewer if there are more cores than such meetings. Meetings take long
    # and hold few bytes: tasks that are joined by their bytes would leave cores idle.
    copies = min(blocks, max(ceil(blocks / BLOCKS), ceil(2 * vectors.sparkSession.sparkContext.defaultParallelism / shards)))
    tasks, meeting = 2 * shards * copies, ("copy", "shard")
    left = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards))).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    right = asked.groupBy("id").agg(F.min("v").alias("v")).withColumn("copy", F.pmod(F.xxhash64("id"), F.lit(copies)).cast("int"))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def meet(shard: pa.Table, queries: pa.Table) -> pa.Table:
        out = [np.zeros((3, 0), np.int64)]
        for width in pc.unique(pc.list_value_length(queries["v"])).to_pylist():
            ids, own = _of_width(shard, width)
            query_ids, vectors = _of_width(queries, width)
            most = max(1, POSTINGS // (2 * SEGMENTS * width))
            for first in range(0, len(ids), most):
                index = Index(ids[first:first + most], own[first:first + most])
                for at in range(0, len(query_ids), BLOCK):
                    block = query_ids[at:at + BLOCK]
                    for query_id, (found, scores) in zip(block, index.search_block(vectors[at:at + BLOCK], k, block)):
                        out.append(np.stack([np.full(len(found), query_id), index.ids[found], scores]))
        return pa.table(list(np.concatenate(out, axis=1)), names=["query_id", "vec_id", "score"])

    found = left.repartition(tasks, *meeting).groupBy(*meeting).cogroup(right.repartition(tasks, *meeting).groupBy(*meeting)).applyInArrow(
        meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
