"""Exact top-k search by block-max pruning over quantised vectors.

Vectors are quantised to integers; each component is a term. Rows lie in blocks
of consecutive ids. A block knows the largest and smallest value of each term;
weighing them by the query bounds every score in the block. A query takes the
blocks in the order of these bounds, scores them through their forward index,
the block's rows, and stops when the next bound falls below its k-th score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.vectors import search, usable


def exact(x: np.ndarray) -> np.ndarray:
    """Whole numbers as floats where all sums of products stay exact, else as integers."""
    top = float(np.abs(x).max(initial=0))
    return x.astype(np.float64) if top * top * x.shape[1] < 2.0**52 else x.astype(np.int64)


def top_k(vectors: DataFrame, queries, k: int = 5, scale: int = 256, block: int = 64, shard_rows: int = 1 << 18, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` largest integer inner products, exactly.

    A component x becomes ``floor(scale * x)``. ``queries`` is a condition on
    ``vec_id``; candidates are all usable rows (see :func:`usable`; zero vectors
    take part) but those of the query's own id. Ties go to the smaller id. All
    rows are returned where there are fewer than ``k``.
    """
    rows, n, dimension = usable(vectors, id_col, vector_col, zero=True)
    quantised = rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale).cast("double")))

    def build(ids, x):
        index = exact(x)
        firsts = np.arange(0, len(ids), block)
        upper, lower = np.maximum.reduceat(index, firsts), np.minimum.reduceat(index, firsts)

        def best(q, own):
            asked = exact(q)
            asked = asked.astype(np.int64) if index.dtype == np.int64 else asked
            work = index.astype(np.int64) if asked.dtype == np.int64 else index
            up, low = (upper, lower) if asked.dtype == index.dtype else (upper.astype(np.int64), lower.astype(np.int64))
            bounds = np.maximum(asked, 0) @ up.T + np.minimum(asked, 0) @ low.T
            order = np.argsort(-bounds, axis=1, kind="stable")
            for query, me, bound, blocks in zip(asked, own, bounds, order):
                at, score = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
                for t in range(0, len(blocks), 4):
                    if len(at) == k and bound[blocks[t]] < score[-1]:
                        break
                    new = np.concatenate([np.arange(f, min(f + block, len(ids))) for f in firsts[blocks[t : t + 4]]])
                    new = new[ids[new] != me]
                    got = (work[new] @ query).astype(np.int64)
                    if len(at) == k:
                        good = got >= score[-1]
                        new, got = new[good], got[good]
                    at, score = np.concatenate([at, new]), np.concatenate([score, got])
                    kept = np.lexsort((ids[at], -score))[:k]
                    at, score = at[kept], score[kept]
                yield at, score

        return best

    shards = max(8, -(-n // shard_rows))
    return search(quantised, quantised.where(queries), shards, F.xxhash64(F.floor(F.col("vec_id") / block)), dimension, k, "long", build)
