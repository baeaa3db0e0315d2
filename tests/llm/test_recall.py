"""Runs of the Jaccard join are repeated until the estimated recall reaches the target."""

import numpy as np
import pytest

from marginalia.llm import jaccard


def similar_texts(groups: int, copies: int, length: int = 120):
    """Groups of texts that have one own word of ``length``, so that most pairs of a group lie just above the threshold."""
    rng = np.random.default_rng(7)
    texts = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(length)]
        for c in range(copies):
            words = list(base)
            words[int(rng.integers(5, length - 5))] = f"c{g}x{c}"
            texts.append(" ".join(words))
    return texts


def brute(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = np.zeros(len(texts), dtype=int)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            links[i] += i != j and (len(a & b) >= threshold * len(a | b) if a | b else True)
    return links.tolist()


def got(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.n_links for r in jaccard.jaccard_classes(docs, **how).orderBy("doc_id").collect()]


def test_too_few_runs_are_repeated_until_the_recall_is_reached(spark):
    texts = similar_texts(12, 10)
    want = brute(texts)
    assert sum(want) > 500
    with pytest.warns(RuntimeWarning, match="estimated recall of 1 runs"):
        assert got(spark, texts, runs=1, most_runs=1) != want
    assert got(spark, texts, runs=1) == want


def test_defaults_with_split_buckets_find_all(spark):
    texts = similar_texts(2, 70)
    assert got(spark, texts, leaf=16) == brute(texts)


def test_sizes_of_hot_buckets_are_the_same(spark):
    picks = spark.createDataFrame([(5, k, k) for k in range(3000)] + [(k // 2 + 10, k, k) for k in range(400)] + [(9, 1, 1)], "path long, node long, h1 long")
    sizes = {(r.path, r.n): r["count"] for r in jaccard.with_bucket_size(picks).groupBy("path", "n").count().collect()}
    assert sizes == {(5, 3000): 3000, **{(k + 10, 2): 2 for k in range(200)}}
