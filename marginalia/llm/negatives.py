"""Hard negatives by norm-bucketed search.

Candidates are ordered by norm and dealt over shards of neighbouring norms;
within a shard they lie in buckets of one label, by falling norm. By
Cauchy-Schwarz no score in a bucket exceeds the anchor's norm times the
bucket's largest norm. An anchor passes over shards and buckets whose bound is
below the lower limits of its windows, and over buckets whose bound is below
the k-th score found so far in every window that has k.

Two searches are made: the anchors' positives among rows of their label, which
set the windows, and then the negatives among rows of other labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.shared import materialise
from marginalia.llm.topk import exact
from marginalia.llm.vectors import matrix

#: A window of scores, both ends included, and the positive it belongs to.
ASK = "array<struct<positive_id: long, positive_score: long, low: long, high: long>>"


def usable(vectors: DataFrame, label: Column, id_col: str, vector_col: str, scale: int) -> tuple[DataFrame, int, int]:
    """``vec_id, label, vector, norm, uid`` of the rows that take part, their number and dimension; vectors hold ``floor(scale * x)``.

    Left out are rows with a null id, label or vector, an empty vector, or a
    null or non-finite component. Inner products need one length, so vectors of
    another than the most frequent length are left out too. Rows equal in id,
    label and vector count once.
    """
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    rows = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.withColumn("vector", F.transform(v, lambda x: F.floor(x * scale).cast("double")))
    lengths = [(n, d) for d, n in rows.groupBy(F.size(v).alias("d")).count().collect()]  # one row per length
    n, d = max(lengths, default=(0, 1))
    rows = rows.where(F.size(v) == d).withColumn("uid", F.xxhash64("vec_id", "label", "vector")).dropDuplicates(["vec_id", "label", "uid"])
    return rows.withColumn("norm", F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))), n, d


def by_norm(rows: DataFrame, n: int, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their ``shard``, and ``shards``: one row with an array of (shard, top), the largest norm there.

    Shards are ranges of norms with about equal numbers of rows. A range that
    equal norms make too large is split by a hash.
    """
    parts = max(8, -(-n // shard_rows))
    borders = rows.agg(F.percentile_approx("norm", [k / parts for k in range(1, parts)], 100 * parts).alias("b"))  # one row, as long as there are shards
    ranged = rows.crossJoin(F.broadcast(borders)).withColumn("range", F.size(F.filter("b", lambda x: x < F.col("norm")))).drop("b")
    size = max(1, -(-n // parts))
    counts = ranged.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / F.lit(1.5 * size)).cast("int").alias("salts"))
    counts = F.broadcast(counts)  # one row per shard
    dealt = ranged.join(counts, "range").withColumn("shard", F.col("range").cast("long") * (1 << 24) + F.pmod(F.col("uid"), F.col("salts")))
    dealt = materialise(dealt.drop("range", "salts"), "by-norm")
    tops = dealt.groupBy("shard").agg(F.max("norm").alias("top"))
    return dealt, tops.agg(F.collect_list(F.struct("shard", "top")).alias("shards"))


class Shard:
    """The rows of a shard in buckets of one label, by falling norm."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, bucket: int):
        x = exact(x)
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        order = np.lexsort((ids, -norms, labels))
        self.ids, self.labels, self.x, norms = ids[order], labels[order], x[order], norms[order]
        starts = [0, *(np.flatnonzero(self.labels[1:] != self.labels[:-1]) + 1).tolist(), len(ids)]
        self.buckets = [(lo, min(lo + bucket, b)) for a, b in zip(starts, starts[1:]) for lo in range(a, b, bucket)]
        self.tops = np.array([norms[lo] for lo, _ in self.buckets])
        self.of = np.array([self.labels[lo] for lo, _ in self.buckets])
        self.order = np.argsort(-self.tops, kind="stable")

    def search(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, windows: list[np.ndarray], same: bool, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(anchor, window, rows, scores) of the ``k`` best in each window of (low, high).

        Buckets are visited by falling norm, each with all anchors that its bound does not rule out.
        """
        norms = np.sqrt((x * x).sum(axis=1))
        x = exact(x).astype(self.x.dtype) if self.x.dtype == np.int64 else exact(x)
        index = self.x.astype(np.int64) if x.dtype == np.int64 else self.x
        # an anchor's need: the least score that any of its windows can still use
        need = np.array([w[:, 0].min() if len(w) else np.inf for w in windows])
        best: list[list] = [[(np.empty(0, np.int64), np.empty(0, np.int64))] * len(w) for w in windows]
        for b in self.order:
            bound = norms * self.tops[b]
            open_ = (bound + 1e-6 * (bound + 1) >= need) & ((labels == self.of[b]) == same)
            asked = np.flatnonzero(open_)
            if not len(asked):
                continue
            lo, hi = self.buckets[b]
            scores = (x[asked] @ index[lo:hi].T).astype(np.int64)
            useful = (scores >= need[asked][:, None]).any(axis=1)
            for row in np.flatnonzero(useful):
                q, line = asked[row], scores[row]
                for w, (low, high) in enumerate(windows[q]):
                    at, got = best[q][w]
                    floor = got[-1] if len(got) == k else low
                    new = np.flatnonzero((line >= floor) & (line <= high))
                    if same:
                        new = new[self.ids[lo + new] != ids[q]]
                    if len(new):
                        if len(new) > 4 * k:
                            new = new[line[new] >= np.partition(line[new], -k)[-k]]
                        at, got = np.concatenate([at, lo + new]), np.concatenate([got, line[new]])
                        kept = np.lexsort((self.ids[at], -got))[:k]
                        best[q][w] = at[kept], got[kept]
                need[q] = min(g[-1] if len(g) == k else low for (_, g), (low, _) in zip(best[q], windows[q]))
        for q, found in enumerate(best):
            for w, (at, got) in enumerate(found):
                if len(at):
                    yield q, w, at, got


def visit(held: DataFrame, asked: DataFrame, shards: DataFrame, dimension: int, same: bool, k: int, bucket: int, batch: int) -> DataFrame:
    """For each anchor of ``asked`` (with its ``windows``) the ``k`` best rows of each window in each shard.

    An anchor goes to the shards whose bound reaches one of its windows. A task
    holds one shard at a time and streams anchors past it.
    """

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        shard, now = None, None
        for b in batches:
            if not b.num_rows:
                continue
            of, asks = b.column("shard").to_numpy(), b.column("asks").to_numpy()
            ids, uids, labels = (b.column(c).to_numpy() for c in ("vec_id", "uid", "label"))
            vectors = matrix(b.column("vector"), dimension)
            change = (of[1:] != of[:-1]) | (asks[1:] != asks[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts, cuts[1:]):
                if of[lo] != now:
                    parts, shard, now = [], None, of[lo]
                if not asks[lo]:
                    parts.append((ids[lo:hi], labels[lo:hi], vectors[lo:hi]))
                    continue
                if shard is None:
                    shard, parts = Shard(*(np.concatenate(p) for p in zip(*parts)), bucket), []
                for at in range(lo, hi, batch):
                    end = min(at + batch, hi)
                    wanted = [np.array([(w["low"], w["high"]) for w in ws], dtype=np.int64).reshape(-1, 2) for ws in b.column("windows").slice(at, end - at).to_pylist()]
                    rows = [(at + q, w, shard.ids[i], s) for q, w, i, s in shard.search(ids[at:end], labels[at:end], vectors[at:end], wanted, same, k)]
                    counts = [len(s) for *_, s in rows]
                    who = np.repeat(np.array([r[0] for r in rows], dtype=np.int64), counts)
                    which = np.repeat(np.array([r[1] for r in rows], dtype=np.int32), counts)
                    found, scores = (np.concatenate([r[j] for r in rows]) if rows else np.empty(0, np.int64) for j in (2, 3))
                    yield pa.RecordBatch.from_arrays([pa.array(uids[who]), pa.array(ids[who]), pa.array(which), pa.array(found), pa.array(scores)], names=["uid", "anchor_id", "window", "found_id", "score"])

    low = F.array_min(F.transform("windows", lambda w: w["low"]))
    reach = F.filter("shards", lambda s: s["top"] * F.col("norm") * (1 + 1e-6) + 1e-6 >= low)
    sent = asked.crossJoin(F.broadcast(shards)).withColumn("shard", F.explode(F.transform(reach, lambda s: s["shard"])))  # shards is one row
    columns = ["vec_id", "uid", "label", "vector"]
    both = held.select("shard", F.lit(0).alias("asks"), *columns, F.lit(None).cast(ASK).alias("windows")).unionByName(sent.select("shard", F.lit(1).alias("asks"), *columns, "windows"))
    return both.repartition("shard").sortWithinPartitions("shard", "asks", "vec_id").mapInArrow(tasks, "uid long, anchor_id long, window int, found_id long, score long")


def mine(
    vectors: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, of: int = 100, scale: int = 256,
    bucket: int = 512, shard_rows: int = 1 << 18, batch: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on ``vec_id``, ``label`` a column of the input
    (by default its column ``label``). Scores are integer inner products of
    ``floor(scale * x)``. An anchor's positives are the first ``positives``
    rows of its label by falling score, then smaller id, without those of its
    own id. For each positive, the first ``k`` rows of another label follow
    whose score s meets ``low * positive <= of * s <= high * positive``. Fewer
    where there are fewer; a positive without negatives gives no row. Which
    rows take part is said at :func:`usable`. The input may have other columns
    of any name. Two different rows of one id are two anchors.
    """
    rows, n, dimension = usable(vectors, F.col("label") if label is None else label, id_col, vector_col, scale)
    held, shards = by_norm(rows, n, shard_rows)
    asked = held.where(anchors)
    least, most = -(1 << 62), 1 << 62
    everything = F.array(F.struct(F.lit(None).cast("long").alias("positive_id"), F.lit(None).cast("long").alias("positive_score"), F.lit(least).alias("low"), F.lit(most).alias("high"))).cast(ASK)
    found = visit(held, asked.withColumn("windows", everything), shards, dimension, True, positives, bucket, batch)
    order = Window.partitionBy("uid", "anchor_id").orderBy(F.desc("score"), "found_id")
    found = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives)
    # whole-number limits: -floor(-a / b) is the ceiling
    edges = F.struct(F.col("nth"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"), _ceil_div(F.col("score") * low, of).alias("low"), _floor_div(F.col("score") * high, of).alias("high"))
    windows = found.groupBy("uid", "anchor_id").agg(F.sort_array(F.collect_list(edges)).alias("w"))  # at most ``positives`` each
    windows = windows.withColumn("windows", F.transform("w", lambda w: F.struct(w["positive_id"].alias("positive_id"), w["positive_score"].alias("positive_score"), w["low"].alias("low"), w["high"].alias("high"))))
    windows = materialise(windows.select("uid", F.col("anchor_id").alias("vec_id"), "windows"), "windows")
    second = visit(held, asked.join(windows, ["uid", "vec_id"]), shards, dimension, False, k, bucket, batch)
    ranked = second.withColumn("rank", F.row_number().over(Window.partitionBy("uid", "anchor_id", "window").orderBy(F.desc("score"), "found_id"))).where(F.col("rank") <= k)
    named = windows.select("uid", F.col("vec_id").alias("anchor_id"), F.posexplode("windows").alias("window", "w")).select("uid", "anchor_id", "window", "w.positive_id", "w.positive_score")
    return ranked.join(named, ["uid", "anchor_id", "window"]).select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _floor_div(a: Column, b: int) -> Column:
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def _ceil_div(a: Column, b: int) -> Column:
    return -_floor_div(-a, b)
