"""What the two vector searches share: usable vectors, shards, and the merge of partial results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT = "uid long, query_id long, vec_id long, score {}"


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero: bool) -> tuple[DataFrame, int, int]:
    """``vec_id, vector, uid`` of the rows that take part, their number and dimension.

    Left out are null ids, null or empty vectors, and vectors with a null or
    non-finite component, zero vectors unless ``zero``, and vectors of another
    than the most frequent length. Rows equal in id and vector count once.
    """
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(fine)
    if not zero:
        rows = rows.where(F.exists(v, lambda x: x != 0))
    lengths = [(n, d) for d, n in rows.groupBy(F.size(v).alias("d")).count().collect()]  # one row per length
    n, d = max(lengths, default=(0, 1))
    rows = rows.where(F.size(v) == d).withColumn("uid", F.xxhash64("vec_id", "vector")).dropDuplicates(["vec_id", "uid"])
    return rows, n, d


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def found_type(score_type: str) -> str:
    return RESULT.format(score_type)


class Best:
    """The ``k`` best candidates of each query in a task, each once, in a buffer of bounded size.

    A full buffer is brought down to the best; what then still fills it by half
    is given out, so a query may have more than ``k`` rows in all, never fewer
    of its best.
    """

    def __init__(self, k: int, most: int = 1 << 20):
        self.k, self.most = k, most
        self.parts: list[pa.RecordBatch] = []
        self.rows = 0

    def add(self, found: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.parts.append(found)
        self.rows += found.num_rows
        if self.rows > self.most:
            few = self._best()
            self.parts, self.rows = [few], few.num_rows
            if self.rows > self.most // 2:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield self._best()
        self.parts, self.rows = [], 0

    def _best(self) -> pa.RecordBatch:
        t = pa.Table.from_batches(self.parts).combine_chunks()
        uid, query, vec, score = (t.column(c).to_numpy() for c in ("uid", "query_id", "vec_id", "score"))
        order = np.lexsort((vec, -score, query, uid))
        uid, query, vec, score = uid[order], query[order], vec[order], score[order]
        new = np.ones(len(uid), dtype=bool)  # of another query than the row before
        new[1:] = (uid[1:] != uid[:-1]) | (query[1:] != query[:-1])
        fresh = new.copy()
        fresh[1:] |= (vec[1:] != vec[:-1]) | (score[1:] != score[:-1])
        nth = np.cumsum(fresh)
        nth -= np.maximum.accumulate(np.where(new, nth, 0))
        return t.take(pa.array(order[fresh & (nth < self.k)])).combine_chunks().to_batches()[0]


def visit(dimension: int, score_type: str, build: Callable, batch: int = 256, k: int | None = None) -> Callable:
    """Tasks over rows ``shard, asks, vec_id, uid, vector``, sorted by shard and asks: 0 for rows held there, 1 for queries.

    A task holds one shard at a time, given to ``build(ids, matrix)``, and
    streams the queries past the function it returns, which gives each query's
    best few there as (indexes, scores). With ``k``, what a query finds in
    several shards of a task is brought down to the ``k`` best.
    """

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if k is None:
            yield from shards(batches)
            return
        held = Best(k)
        for found in shards(batches):
            yield from held.add(found)
        yield from held.rest()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.float64() if score_type == "double" else pa.int64()
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        best, now = None, None

        def answers(ids, uids, vectors, best):
            own, found = best
            for lo in range(0, len(ids), batch):
                chosen = list(found(vectors[lo : lo + batch], ids[lo : lo + batch]))
                counts = [len(i) for i, _ in chosen]
                at = np.repeat(np.arange(lo, lo + len(chosen)), counts)
                hits = np.concatenate([i for i, _ in chosen]).astype(np.int64) if sum(counts) else np.empty(0, dtype=np.int64)
                scores = np.concatenate([s for _, s in chosen]) if sum(counts) else np.empty(0)
                yield pa.RecordBatch.from_arrays([pa.array(uids[at]), pa.array(ids[at]), pa.array(own[hits]), pa.array(scores).cast(kind)], names=["uid", "query_id", "vec_id", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            shard_of, asks = b.column("shard").to_numpy(), b.column("asks").to_numpy()
            ids, uids, vectors = b.column("vec_id").to_numpy(), b.column("uid").to_numpy(), matrix(b.column("vector"), dimension)
            change = (shard_of[1:] != shard_of[:-1]) | (asks[1:] != asks[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts, cuts[1:]):
                if shard_of[lo] != now:
                    parts, best, now = [], None, shard_of[lo]
                if not asks[lo]:
                    parts.append((ids[lo:hi], vectors[lo:hi]))
                elif parts or best:
                    if best is None:
                        own = np.concatenate([i for i, _ in parts])
                        best, parts = (own, build(own, np.concatenate([m for _, m in parts]))), []
                    yield from answers(ids[lo:hi], uids[lo:hi], vectors[lo:hi], best)

    return tasks


def search(rows: DataFrame, queries: DataFrame, shards: int, shard: F.Column, dimension: int, k: int, score_type: str, build: Callable) -> DataFrame:
    """The ``k`` best of every query: ``query_id, rank, vec_id, score``.

    Rows are dealt over ``shards``; each query visits every shard (see
    :func:`visit`). Partial results are merged by score and id.
    """
    held = rows.select(F.pmod(shard, F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), "vec_id", "uid", "vector")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "vec_id", "uid", "vector")
    dealt = held.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "asks", "vec_id")
    found = dealt.mapInArrow(visit(dimension, score_type, build), found_type(score_type))
    order = Window.partitionBy("query_id", "uid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
