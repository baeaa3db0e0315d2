"""A large group of near copies: every link is counted, and buckets that only repeat pairs make few rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import jaccard
from marginalia.llm.shingles import WordHashes, shingle_set


def near_copies(n):
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(160)]
    return [(k, " ".join(w if rng.random() > 0.007 else f"x{rng.randrange(10**6)}" for w in base)) for k in range(n)]


def test_links_of_a_large_group(spark):
    rows = near_copies(400)
    sets = [shingle_set(t, WordHashes()) for _, t in rows]
    common = jaccard.overlaps(sets)
    size = np.array([len(s) for s in sets])
    linked = common >= 0.8 * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(linked, False)
    want = {k: int(linked[k].sum()) for k in range(len(rows))}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in jaccard.jaccard_classes(docs, leaf=32, depth=1).collect()}
    assert got == want and max(want.values()) > 100


def test_tiles_grow_by_the_nodes_without_a_common_bucket(spark):
    # all nodes but a tenth have the bucket 0 in common, and all have 1 to 13
    rows = spark.range(2000).select(F.explode(F.expr("sequence(0L, 13L)")).alias("path"), F.col("id").alias("node"), F.col("id").alias("h1"))
    rows = rows.where((F.col("path") > 0) | (F.col("node") % 10 > 0)).withColumn("first", F.when(F.col("node") % 10 > 0, 0).otherwise(1).cast("long"))
    made = jaccard.tiles(jaccard.with_likes(rows), 100).persist()
    assert made.where("path = 0").count() == 1800 * 18
    assert made.where("path > 0").count() == 13 * (200 * 20 + 1800 * 2)  # 13 * 2000 * 20 without
    by = {}
    for r in made.collect():
        by.setdefault((r.path, r.a, r.b), []).append((r.node, r.part))
    met = {path: set() for path in (0, 1)}
    for (path, a, b), mine in by.items():
        if path in met:
            met[path] |= {(x, y) for x, p in mine for y, q in mine if x < y and (a == b or p != q)}
    lacking = set(range(0, 2000, 10))
    assert met[0] == {(x, y) for x in range(2000) for y in range(x + 1, 2000) if x not in lacking and y not in lacking}
    assert met[1] >= {(min(x, y), max(x, y)) for x in lacking for y in range(2000) if x != y}
    made.unpersist()
