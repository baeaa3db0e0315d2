"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled by the largest norm and lifted to unit length by one more
component, so the largest inner products are the smallest distances. Each of
``tables`` hash tables has some Gaussian projections, shifted and cut into
cells of ``width``; a vector's cells are its bucket, and rows are dealt over
the cluster by table and bucket.

A query begins at its home bucket, the most promising combination of cells,
and perturbs one cell after the other: a heap gives buckets in falling order
of estimated success, which is the probability that a neighbour's projections
fall into the cells against a power of the share of all vectors there. It ends
when the buckets are expected to hold a fraction of all vectors, fitted on a
bounded sample to reach the target recall there. The query then joins the
buckets' rows; candidates of all tables are merged and ranked by exact inner
products. Queries that find fewer than ``k`` are searched exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.shared import materialise
from marginalia.llm.vectors import found_type, matrix, search, usable, visit

RARITY = 0.7  # the power of a cell's share; at 0 probes prefer full buckets, at 1 very rare ones
EDGE = 0.03  # else many buckets hold next to nothing, and probes to them are wasted
MOST_FUNCTIONS = 18


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """The logistic approximation, within 0.01, which is enough for an order."""
    return 1 / (1 + np.exp(np.clip(-1.702 * z, -60, 60)))


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    x = x / largest
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]])


def unit_queries(q: np.ndarray) -> np.ndarray:
    return np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))])


@dataclass
class Table:
    """One hash table: its projections, and the share of all vectors in each cell of each function, as a sample has it.

    The cells of the ``EDGE`` smallest and largest projections of the sample, and those beyond, belong to the next ones.
    """

    number: int
    directions: np.ndarray
    shift: np.ndarray
    width: float
    low: np.ndarray
    shares: list[np.ndarray]

    @classmethod
    def over(cls, number: int, sample: np.ndarray, directions: np.ndarray, shift: np.ndarray, width: float) -> Table:
        cells = np.floor((sample @ directions + shift) / width).astype(np.int64)
        low, high = (np.quantile(cells, q, axis=0, method="nearest") for q in (EDGE, 1 - EDGE))
        counts = [np.bincount(np.clip(c, a, b) - a).astype(float) for c, a, b in zip(cells.T, low, high)]
        return cls(number, directions, shift, width, low, [(c + 0.5) / (c + 0.5).sum() for c in counts])

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        found = np.floor((vectors @ self.directions + self.shift) / self.width).astype(np.int64) - self.low
        return np.clip(found, 0, np.array([len(s) - 1 for s in self.shares]))

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """One number for a table and bucket; tables are told apart by the lowest part."""
        key = np.zeros(len(cells), dtype=np.int64)
        for j, s in enumerate(self.shares):
            key = key * len(s) + cells[:, j]
        return key * 64 + self.number

    def success(self, queries: np.ndarray, similarity: float) -> list[np.ndarray]:
        """For each function, queries x cells: the logarithm of the estimated success of a cell."""
        at, spread = similarity * (queries @ self.directions), np.sqrt(1 - similarity**2)
        found = []
        for j, share in enumerate(self.shares):
            edges = (np.arange(len(share) + 1) + self.low[j]) * self.width - self.shift[j]
            edges[0], edges[-1] = -1e9, 1e9
            near = np.diff(normal_cdf((edges[None, :] - at[:, j : j + 1]) / spread), axis=1)
            found.append(np.log(near + 1e-9) - RARITY * np.log(share))
        return found

    def probes(self, success: list[np.ndarray], fraction: float) -> Iterator[tuple[int, ...]]:
        """Buckets of one query, the most promising first, until they are expected to hold ``fraction`` of all vectors.

        ``success`` has the scores of the cells of each function. The heap holds
        perturbed buckets; each pop moves one function on to its next best cell.
        """
        order = [np.argsort(-s, kind="stable").tolist() for s in success]
        gain = [s[o].tolist() for s, o in zip(success, order)]
        share = [p[o].tolist() for p, o in zip(self.shares, order)]
        m = len(order)
        heap = [(-sum(g[0] for g in gain), (0,) * m, 0)]
        seen = 0.0
        while heap and seen < fraction:
            score, at, free = heapq.heappop(heap)
            yield tuple(order[j][at[j]] for j in range(m))
            held = 1.0
            for j in range(m):
                held *= share[j][at[j]]
            seen += held
            # functions before ``free`` stay where they are, so every bucket is reached in one way
            for j in range(free, m):
                if at[j] + 1 < len(gain[j]):
                    heapq.heappush(heap, (score + gain[j][at[j]] - gain[j][at[j] + 1], at[:j] + (at[j] + 1,) + at[j + 1 :], j))


@dataclass
class Index:
    """What rows and queries need to find their buckets; its size is set by the dimension, the tables and the cells."""

    tables: list[Table]
    largest: float
    similarity: float
    fraction: float

    def row_keys(self, x: np.ndarray) -> np.ndarray:
        vectors = lifted(x, self.largest)
        return np.stack([t.keys(t.cells(vectors)) for t in self.tables], axis=1)

    def query_keys(self, q: np.ndarray) -> Iterator[np.ndarray]:
        asked = unit_queries(q)
        success = [t.success(asked, self.similarity) for t in self.tables]
        for k in range(len(q)):
            yield np.concatenate([t.keys(np.array(list(t.probes([s[k] for s in of], self.fraction)))) for t, of in zip(self.tables, success)])


def fit(sample: np.ndarray, n: int, largest: float, k: int, tables: int, functions: int, width: float, recall: float, seed: int, queries: int = 400) -> Index:
    """The tables, the typical similarity of a k-th neighbour, and the fraction that reaches the recall on the sample.

    A neighbour is reached once the buckets before its own are visited; the
    fraction of rows that these hold is counted for the neighbours of sample
    rows, in each table, and the target quantile of the least of them is taken.
    In a sample of n' of n rows the first k n' / n stand for the first k.
    """
    rng = np.random.default_rng(seed)
    drawn = [(rng.standard_normal((sample.shape[1] + 1, functions)), rng.random(functions) * width) for _ in range(tables)]
    vectors = lifted(sample, largest)
    made = [Table.over(t, vectors, a, b, width) for t, (a, b) in enumerate(drawn)]
    if n <= 4 * k or len(sample) < 3:
        return Index(made, largest, 0.5, 1.0)
    asked = unit_queries(sample[:queries])
    products = asked @ vectors.T
    products[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    top = int(np.clip(round(k * len(sample) / n), 1, len(sample) - 1))
    best = np.argsort(-products, axis=1)[:, :top]
    similarity = float(np.clip(np.median(np.take_along_axis(products, best[:, -1:], axis=1)), 0.05, 0.98))
    needed = np.ones(best.shape)
    for t in made:
        cells = t.cells(vectors)
        scores = sum(s[:, cells[:, j]] for j, s in enumerate(t.success(asked, similarity)))
        ordered = np.sort(scores, axis=1)
        for q in range(len(asked)):
            before = 1 - np.searchsorted(ordered[q], scores[q, best[q]], side="right") / len(sample)
            needed[q] = np.minimum(needed[q], before)
    fraction = float(np.quantile(needed, recall)) + 1 / len(sample)
    return Index(made, largest, similarity, min(1.0, max(fraction, 10 * k / n)))


def functions_for(n: int, width: float, bucket_rows: int) -> int:
    """So many functions that buckets hold about ``bucket_rows`` of ``n`` vectors: a unit normal cut into cells of a width has as much entropy as so many equal cells."""
    cells = max(2.0, 4.13 / width)
    return int(np.clip(round(np.log(max(1.0, n / bucket_rows)) / np.log(cells)), 2, MOST_FUNCTIONS))


def keyed(rows: DataFrame, index: Index, dimension: int, asks: bool) -> DataFrame:
    """``vec_id, uid, vector, keys``: the buckets of rows, or those that queries visit."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                x = matrix(b.column("vector"), dimension)
                keys = list(shared.value.query_keys(x) if asks else shared.value.row_keys(x))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(keys, pa.list_(pa.int64()))], names=["vec_id", "uid", "vector", "keys"])

    return rows.select("vec_id", "uid", "vector").mapInArrow(tasks, "vec_id long, uid long, vector array<double>, keys array<long>")


def nearest(
    vectors: DataFrame, queries, k: int = 20, tables: int = 6, width: float = 1.2, bucket_rows: int = 2048, recall: float = 0.96, sample: int = 4096, part_rows: int = 1 << 15, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` largest inner products found for each query row.

    ``queries`` is a condition on ``vec_id``. All usable rows are indexed (see
    :func:`usable`; zero vectors take no part) and are candidates of every
    query but those of the same id. The fraction of each table that is visited
    is fitted on ``sample`` rows; a table of at most ``4 * k`` rows is visited
    whole. A bucket of more than ``part_rows`` rows is split, and its queries
    go to every part. Scores are double inner products of the original
    vectors; ties go to the smaller id.
    """
    rows, n, dimension = usable(vectors, id_col, vector_col, zero=False)
    rows = materialise(rows, "vectors")
    largest = float(rows.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).alias("m")).first()["m"] or 1.0)
    keep = min(1.0, 2 * sample / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64("uid", F.lit("sample")), F.lit(1 << 20)) < int(keep * (1 << 20)) + 1).select("uid", "vector").limit(3 * sample)
    picked = sorted((r["uid"], r["vector"]) for r in drawn.collect())[:sample]  # 3 * sample rows at most
    asked = rows.where(queries)
    if not picked:
        return search(rows, asked, 8, F.xxhash64("uid"), dimension, k, "double", exhaustive(k))
    index = fit(np.array([v for _, v in picked]).reshape(-1, dimension), n, largest, k, tables, functions_for(n, width, bucket_rows), width, recall, seed)

    held = keyed(rows, index, dimension, asks=False).withColumn("key", F.explode("keys")).drop("keys")
    sizes = materialise(held.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(part_rows)).cast("int").alias("parts")), "buckets")
    large = sizes.where(F.col("parts") > 1)  # at most tables * n / part_rows rows, joined as their size allows
    part = F.pmod(F.xxhash64("uid"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = held.join(large, "key", "left").select(F.xxhash64("key", part).alias("shard"), F.lit(0).alias("asks"), "vec_id", "uid", "vector")
    probes = keyed(asked, index, dimension, asks=True).withColumn("key", F.explode("keys")).join(sizes, "key")  # none to empty buckets
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    probes = probes.select(F.xxhash64("key", "part").alias("shard"), F.lit(1).alias("asks"), "vec_id", "uid", "vector")
    both = dealt.unionByName(probes).repartition("shard").sortWithinPartitions("shard", "asks", "vec_id")
    found = both.mapInArrow(visit(dimension, "double", exhaustive(k), k=k), found_type("double"))
    # a candidate met in several tables has one dense rank
    order = Window.partitionBy("query_id", "uid").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).dropDuplicates(["query_id", "uid", "rank"])
    ranked = materialise(ranked.select("query_id", "uid", "rank", "vec_id", "score"), "neighbours")
    full = ranked.where(F.col("rank") == min(k, n - 1)).select(F.col("query_id").alias("vec_id"), "uid")
    short = asked.join(full, ["vec_id", "uid"], "left_anti")
    result = ranked.select("query_id", "rank", "vec_id", "score")
    if short.isEmpty():
        return result
    done = result.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti")
    again = asked.join(short.select("vec_id").distinct(), "vec_id", "left_semi")
    shards = max(8, -(-n // (1 << 18)))
    return done.unionByName(search(rows, again, shards, F.xxhash64("uid"), dimension, k, "double", exhaustive(k)))


def exhaustive(k: int):
    """The k best of all rows of a bucket for each query."""

    def build(ids, x):
        def best(q, own):
            near = q @ x.T
            for scores, query, me in zip(near, q, own):
                at = np.flatnonzero(ids != me)
                if len(at) > 2 * k:
                    line = np.partition(scores[at], -k)[-k]
                    at = at[scores[at] >= line - 1e-9 * (abs(line) + 1)]
                score = (x[at] * query).sum(axis=1)
                order = np.lexsort((ids[at], -score))[:k]
                yield at[order], score[order]

        return best

    return build
