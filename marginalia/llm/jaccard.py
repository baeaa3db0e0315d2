"""Self-join of documents on the Jaccard similarity of word shingles, by chosen paths.

1. Documents with equal shingle sets become one node with a multiplicity.
2. Every node picks shingles by a hash threshold of ``runs / (share * size)``:
   that is the first level of ``runs`` independent chosen-path trees, since
   the same shingle is picked by all similar sets. Nodes that picked the same
   shingle share a bucket.
3. Buckets over ``leaf`` nodes are split again by further shingles, drawn from
   a consistent sample of each set; this parts documents that share only a
   frequent passage. Buckets that stay large are cut into parts, of which a
   tile compares two, so no pair is lost and no task gets more than two parts.
   Nodes that all have a smaller bucket in common are not paired again, and
   buckets of such nodes alone are left out.
4. Small buckets are compared by brute force: first on the samples, then the
   survivors on their whole texts, exactly. A pair is judged only in the
   smallest of its common buckets, so links are counted once without listing
   pairs.
5. Each bucket returns a row per node: its links and the smallest node it is
   connected to. Components of these stars are the classes.

6. The runs are repeated, twice as many each time, until the recall that two
   halves of them tell reaches the target.

With ``runs`` = 14 a pair at the threshold shares at least 14 picks on average
and is missed with a probability of about exp(-14). A shared pick survives the
splits of its bucket with a probability of 0.63 for one split and 0.47 for two,
so a pair whose picks are all in large buckets is missed with up to exp(-6.6);
where such pairs are so many that the recall is below the target, the runs are
repeated. Links over the threshold are exact.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.components import components
from marginalia.llm.shared import materialise, plain_names
from marginalia.llm.shingles import WordHashes, mix, shingle_set, unit

NEAR = 0.05  # links less than this above the threshold, which are the most likely to be missed, tell the recall
FEATURES = "doc_id long, h1 long, h2 long, size int, picks array<long>, sample binary"


def features(docs: DataFrame, width: int, runs: int, share: float, sample: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: hash and size of its shingle set, first-level picks of ``runs`` runs, and a consistent sample; no hash without a doc_id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle_set(text.as_py() if doc is not None else None, words, width)
                h1, h2 = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype="<i8").tolist() if doc is not None else (None, None)
                at, rate = unit(mix(s, 1)), runs / (share * max(1, len(s)))
                picked = s[at < rate]
                sampled = s[unit(mix(s, 2)) < sample / max(1, len(s))].astype("<u4")
                for column, value in zip(out, (doc, h1, h2, len(s), picked.view(np.int64), sampled.tobytes())):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "h1", "h2", "size", "picks", "sample"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(rows, FEATURES)


def by_bucket(rows: DataFrame, facts: DataFrame, hot: int = 1 << 16) -> DataFrame:
    """The rows of the buckets in ``facts``, with the columns of ``facts``: ``path``, the number ``n`` of nodes, and others.

    Buckets with more than one ``hot``-th of all rows, fewer than ``hot``, are
    broadcast; so no task gets all rows of such a bucket. ``facts`` is read
    several times, so it should be a written table.
    """
    more = [c for c in facts.columns if c != "path"]
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    large = F.col("n") > max(256, total // hot)
    known = rows.join(F.broadcast(facts.where(large).select("path", F.struct(*more).alias("_hot"))), "path", "left")
    small = F.col("_hot").isNull()
    dealt = known.withColumns({"_small": small, "_key": F.when(small, F.col("path")).otherwise(F.xxhash64("node", "h1"))})
    others = facts.where(~large).select(F.col("path").alias("_key"), F.lit(True).alias("_small"), F.struct(*more).alias("_facts"))
    joined = dealt.join(others, ["_small", "_key"], "left").withColumn("_facts", F.coalesce("_hot", "_facts"))
    return joined.where(F.col("_facts").isNotNull()).select(*rows.columns, "_facts.*")


def with_bucket_size(picks: DataFrame) -> DataFrame:
    """The picks with the number ``n`` of nodes of their bucket, for buckets with two or more; ``picks`` is read twice."""
    sizes = materialise(picks.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "jaccard-sizes")
    return by_bucket(picks, sizes)


def with_likes(rows: DataFrame) -> DataFrame:
    """Adds ``n, likes, like`` to ``path, node, h1, first``, and leaves out buckets that judge no pair.

    ``first`` is the smallest bucket of a node. Nodes of a bucket with the same
    smaller ``first`` have that bucket in common, so none of their pairs is
    judged here. ``likes`` counts the largest such set of the bucket, and
    ``like`` marks its nodes. ``rows`` is read twice.
    """
    smaller = F.col("first") < F.col("path")
    alike = rows.groupBy("path", F.when(smaller, F.col("first")).alias("first")).agg(F.count(F.lit(1)).alias("k"))
    best = F.max(F.when(F.col("first").isNotNull(), F.struct("k", "first")))
    facts = alike.groupBy("path").agg(F.sum("k").alias("n"), best.alias("_best"))
    facts = facts.select("path", "n", F.coalesce("_best.k", F.lit(0)).cast("long").alias("likes"), F.col("_best.first").alias("_alike"))
    facts = materialise(facts.where(F.col("n") > F.greatest(F.lit(1), "likes")), "jaccard-sizes")
    return by_bucket(rows, facts).withColumn("like", F.coalesce(F.col("first") == F.col("_alike"), F.lit(False))).drop("_alike")


def deeper(large: DataFrame, nodes: DataFrame, share: float) -> DataFrame:
    """The next level of paths of nodes in large buckets: ``path, node, h1``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, counts = [np.empty(0, dtype=np.int64)], []
            for path, sample in zip(batch.column("path").to_pylist(), batch.column("sample").to_pylist()):
                tokens = np.frombuffer(sample, dtype="<u4").astype(np.uint64)
                mixed = mix(tokens ^ np.uint64(path & 0xFFFFFFFFFFFFFFFF), 3)
                kept = mix(mixed[unit(mixed) < 1 / (share * max(1, len(tokens)))], 4)
                kept = kept >> np.uint64(1) << np.uint64(1) | np.uint64(path & 1)  # of the same half of the runs as its first pick
                paths.append(kept.view(np.int64))
                counts.append(len(kept))
            at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths)), batch.column("node").take(at), batch.column("h1").take(at)], names=["path", "node", "h1"])

    sampled = large.select("path", "node", "h1").join(nodes.select("node", "h1", "sample"), ["node", "h1"])
    return sampled.mapInArrow(rows, "path long, node long, h1 long")


def tiles(rows: DataFrame, leaf: int) -> DataFrame:
    """Adds ``part, a, b``: each bucket in parts of about ``leaf``, a row for every pair of parts.

    The nodes that ``like`` marks have parts of their own, after those of the
    others, and no two of these are paired: a bucket that only repeats the
    pairs of a smaller one has few tiles.
    """

    def parts(k):
        return F.ceil(k / F.lit(leaf)).cast("int")

    rows = rows.withColumns({"_free": parts(F.col("n") - F.col("likes")), "_all": parts(F.col("n") - F.col("likes")) + parts(F.col("likes"))})
    first, size = F.when(F.col("like"), F.col("_free")).otherwise(0), F.when(F.col("like"), F.col("_all") - F.col("_free")).otherwise(F.col("_free"))
    rows = rows.withColumn("part", (first + F.pmod(F.xxhash64("node", F.lit(17)), size)).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.when(F.col("like"), F.col("_free")).otherwise(F.col("_all")) - 1)))
    return rows.withColumns({"a": F.least("part", "_other").cast("int"), "b": F.greatest("part", "_other").cast("int")}).drop("_free", "_all", "_other")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (path, a, b), from a partition sorted by them."""
    waiting: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("path", "a", "b")])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            mine = tuple(k[:, lo].tolist())
            if waiting and mine != key:
                yield pa.Table.from_batches(waiting)
                waiting = []
            key = mine
            waiting.append(batch.slice(lo, hi - lo))
    if waiting:
        yield pa.Table.from_batches(waiting)


def overlaps(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = len(sets)
    total = np.zeros((n, n), dtype=np.float32)
    if not n:
        return total
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[token] > 1
    owner, token = owner[shared], np.unique(token[shared], return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    cuts = np.searchsorted(token, np.arange(0, (token[-1] if len(token) else -1) + 1 + chunk, chunk))
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        seen = np.zeros((n, chunk), dtype=np.float32)
        seen[owner[lo:hi], token[lo:hi] - k * chunk] = 1
        total += seen @ seen.T
    return total


def own_pairs(table: pa.Table) -> np.ndarray:
    """Which pairs this tile judges: of its two parts, and with no smaller bucket in common."""
    path, a, b = (table.column(c)[0].as_py() for c in ("path", "a", "b"))
    part, node = table.column("part").to_numpy(), table.column("node").to_numpy()
    mine = node[:, None] != node[None, :]
    if a != b:
        mine &= part[:, None] != part[None, :]
    smaller = [np.array([x for x in leaves if x < path], dtype=np.int64) for leaves in table.column("leaves").to_pylist()]
    if any(len(s) for s in smaller):
        mine &= overlaps(smaller) == 0
    return mine


def met_twice(table: pa.Table, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many of each node's pairs meet in the first half of all runs, in the second, and in both; the lowest bit of a path tells its half."""
    if not pairs.any():
        return (np.zeros(len(pairs), dtype=np.int64),) * 3
    leaves = [np.array(x, dtype=np.int64) for x in table.column("leaves").to_pylist()]
    halves = [overlaps([x[(x & 1) == k] for x in leaves]) > 0 for k in (0, 1)]
    return tuple((pairs & x).sum(axis=1) for x in (halves[0], halves[1], halves[0] & halves[1]))


def survivors(threshold: float, sample: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            if t.num_rows < 2:
                continue
            size = t.column("size").to_numpy().astype(np.float64)
            larger = np.maximum(size[:, None], size[None, :])
            maybe = own_pairs(t) & (np.minimum(size[:, None], size[None, :]) >= threshold * larger)
            if maybe.any():
                common = overlaps([np.frombuffer(x, dtype="<u4") for x in t.column("sample").to_pylist()])
                rate = np.minimum(1.0, sample / larger)
                least = threshold * larger * rate  # expected for a pair at the threshold
                maybe &= common >= least - 5 * np.sqrt(least * (1 - rate)) - 1e-9
            kept = np.flatnonzero(maybe.any(axis=1))
            if len(kept):
                some = t.select(["path", "node", "h1"]).take(pa.array(kept))
                first = pa.array([min(x) for x in t.column("leaves").take(pa.array(kept)).to_pylist()], pa.int64())
                yield from some.append_column("first", first).to_batches()

    return rows


def judged(threshold: float, width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for t in groups(batches):
            sets, kept, seen = [], [], set()
            for k, (node, h1, text) in enumerate(zip(*(t.column(c).to_pylist() for c in ("node", "h1", "text")))):
                s = shingle_set(text, words, width)
                if (node, h1) not in seen and np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype="<i8")[0] == h1:
                    seen.add((node, h1))
                    sets.append(s)
                    kept.append(k)
            if len(kept) < 2:
                continue
            t = t.take(pa.array(kept))
            size = np.array([len(s) for s in sets], dtype=np.float64)
            common = overlaps(sets)
            linked = own_pairs(t) & (common >= threshold * (size[:, None] + size[None, :] - common) - 1e-6)
            node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy().astype(np.float64)
            label = node.copy()
            while True:  # the smallest node each is connected to, here
                least = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
                new = np.minimum(label, least)
                if (new == label).all():
                    break
                label = new
            some = np.flatnonzero(linked.any(axis=1))
            if len(some):
                links = (linked @ copies).astype(np.int64)
                h1 = t.column("h1").to_numpy()
                near = linked & (common < (threshold + NEAR) * (size[:, None] + size[None, :] - common))
                first, second, both = met_twice(t, near)
                columns = (node, h1, links, label, first, second, both)
                yield pa.RecordBatch.from_arrays([pa.array(x[some].astype(np.int64)) for x in columns], names=["node", "h1", "links", "label", "first", "second", "both"])

    return rows


def marked(rows: DataFrame, key: str, wanted: DataFrame, log_bits: int = 24) -> DataFrame:
    """Adds ``_maybe``: whether the key may be in ``wanted``, by a bit set of fixed size; false for a null key.

    The set is a broadcast table of at most ``2 ** (log_bits - 6)`` words. A
    false ``_maybe`` is certain. When the keys outgrow the set, more rows are
    true, so an exact join has to follow.
    """

    def place(k):
        return F.pmod(F.xxhash64(k, F.lit("bits")), F.lit(1 << log_bits))

    bit = F.expr("shiftleft(1L, cast(_place & 63 as int))")
    word = F.call_function("shiftright", "_place", F.lit(6)).alias("_word")
    words = wanted.where(F.col(key).isNotNull()).select(place(F.col(key)).alias("_place")).groupBy(word).agg(F.bit_or(bit).alias("_bits"))
    at = rows.withColumn("_place", F.when(F.col(key).isNotNull(), place(F.col(key)))).withColumn("_word", word)
    maybe = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return at.join(F.broadcast(words), "_word", "left").withColumn("_maybe", maybe).drop("_word", "_place", "_bits")


def narrowed(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key may be in ``wanted``, so that few others enter the join that follows."""
    return marked(rows, key, wanted).where("_maybe").drop("_maybe")


def one_of_each_class(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, every column, that stand for their class: those whose id is the class id.

    Of rows with the same id the one with the smallest text stays; rows with a
    null id all stay. Only rows that may have to go are moved.
    """
    plain, names, at = plain_names(docs)
    plain = plain.withColumn("_id", F.col(at[id_col]).cast("long"))
    gone = classes.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("_id"))
    again = classes.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where(F.col("count") > 1).select(F.col("doc_id").alias("_id"))
    keyed = marked(plain, "_id", gone.unionByName(again))
    first = Window.partitionBy("_id").orderBy(F.col(at[text_col]).asc_nulls_first())
    kept = keyed.where("_maybe").join(gone, "_id", "left_anti").withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") == 1)
    columns = list(at.values())
    return keyed.where(~F.col("_maybe")).select(*columns).unionByName(kept.select(*columns)).toDF(*names)


def estimated_recall(found: DataFrame) -> float:
    """The share of the links near the threshold that the runs find, estimated from two independent halves of them.

    Of the links that one half finds, the other finds a share; both miss the
    product of what each misses. Without such links it is 1.
    """
    first, second, both = found.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("first", "second", "both"))).first()
    if not first or not second:
        return 1.0 if not first + second else 0.0
    return 1 - (1 - both / first) * (1 - both / second)


def links_of(docs: DataFrame, width: int, threshold: float, runs: int, leaf: int, depth: int, sample: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows with a shingle set's hash, the distinct sets, rows without an id, and the links of ``runs`` runs by node."""
    facts = materialise(features(docs, width, runs, threshold, sample, id_col, text_col), "jaccard-features")
    same, one = ["h1", "h2"], ["node", "h1"]  # a shingle set; a node
    some = facts.where(F.col("h1").isNotNull())
    grouped = some.groupBy(*same).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("picks").alias("picks"), F.first("sample").alias("sample"))
    nodes = materialise(grouped, "jaccard-nodes")

    level = materialise(with_bucket_size(nodes.select(F.explode("picks").alias("path"), *one)), "jaccard-level")
    leaves = level.where(F.col("n") <= leaf)
    large = level.where(F.col("n") > leaf)
    for _ in range(depth - 1):
        large = level.where(F.col("n") > leaf)
        if large.isEmpty():
            break
        level = materialise(with_bucket_size(materialise(deeper(large, nodes, threshold), "jaccard-deeper")), "jaccard-level")
        leaves = leaves.unionByName(level.where(F.col("n") <= leaf))
    leaves = leaves.unionByName(level.where(F.col("n") > leaf))

    lists = materialise(leaves.groupBy(*one).agg(F.collect_list("path").alias("leaves")), "jaccard-lists")  # about ``runs`` of each node
    known = nodes.select(*one, "copies", "size", "sample").join(lists, one)
    order = ["path", "a", "b"]
    placed = materialise(lists.select(*one, F.explode("leaves").alias("path"), F.array_min("leaves").alias("first")), "jaccard-placed")
    met = tiles(with_likes(placed).join(known.drop("copies"), one), leaf).select(*order, "part", *one, "size", "sample", "leaves")
    close = met.repartition(*order).sortWithinPartitions(*order).mapInArrow(survivors(threshold, sample), "path long, node long, h1 long, first long")
    close = materialise(with_likes(materialise(close.distinct(), "jaccard-close")), "jaccard-close")

    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    texts = narrowed(texts.where(F.col("text").isNotNull()), "node", close).join(close.select("node").distinct(), "node")
    full = tiles(close.join(known.select(*one, "copies", "leaves"), one).join(texts, "node"), leaf // 2).select(*order, "part", *one, "copies", "leaves", "text")
    found = full.repartition(*order).sortWithinPartitions(*order).mapInArrow(judged(threshold, width), "node long, h1 long, links long, label long, first long, second long, both long")
    found = materialise(found, "jaccard-links")

    alone = facts.where(F.col("h1").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return some, nodes, alone, found


def jaccard_classes(
    docs: DataFrame, width: int = 5, threshold: float = 0.8, runs: int = 14, leaf: int = 512, depth: int = 3, sample: int = 96, recall: float = 0.9995, most_runs: int = 224, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, class_id, n_links`` for every row of ``docs``.

    ``runs`` are doubled until the recall, estimated from the links found, is at
    least ``recall`` (see :func:`estimated_recall`); where ``most_runs`` do not
    reach it there is a warning with the estimate.

    Two documents are linked if the Jaccard similarity of their shingle sets
    is at least ``threshold``; ``n_links`` counts the other rows a row is linked
    to, copies too. ``class_id`` is the smallest doc_id connected by links.
    Null or blank texts have no shingles and are copies of each other. A null
    doc_id has a null class and no links. Rows that repeat a doc_id with
    different texts belong to one class; each keeps the links of its text.
    """
    while True:
        some, nodes, alone, found = links_of(docs, width, threshold, runs, leaf, depth, sample, id_col, text_col)
        reached = estimated_recall(found)
        if reached >= recall:
            break
        if 2 * runs > most_runs:
            warnings.warn(f"the estimated recall of {runs} runs is {reached:.6f}, below {recall}", RuntimeWarning, stacklevel=2)
            break
        runs *= 2
    same, one = ["h1", "h2"], ["node", "h1"]

    repeated = some.groupBy("doc_id").agg(F.count_distinct(*same).alias("k")).where(F.col("k") > 1)
    merged = repeated.join(some, "doc_id").join(nodes.select(*same, "node"), same).select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    classes = components(found.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(merged))
    links = found.groupBy(*one).agg(F.sum("links").alias("links"))
    by_set = nodes.join(links, one, "left").join(classes, "node", "left")
    by_set = by_set.select(*same, F.coalesce("label", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    return some.select("doc_id", *same).join(by_set, same).select("doc_id", "class_id", "n_links").unionByName(alone)
