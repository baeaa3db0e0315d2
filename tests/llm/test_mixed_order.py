"""The order set by mixing is the order of the packed sequences."""

import random

import corpus_pipeline
import numpy as np
import pytest

from marginalia.llm import mixing, packing, shared

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(n=400):
    rng = random.Random(5)
    sizes = [3, 20, 90, 400, 1500]
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice(sizes))) for _ in range(n)]
    return [(k, None if k == 7 else text, "en", "big" if k % 4 else "small", len(text)) for k, text in enumerate(texts)]


def packed(spark, docs, tmp_path):
    return corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()


def check_order(found, places, capacity=2048):
    """Sequences ascend with their first document, documents within them by place, pieces of a document by number."""
    by = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        by.setdefault(r.sequence_id, []).append(r)
    for rs in by.values():
        at = 0
        for r in rs:
            assert r.offset == at
            at += r.length
        assert at <= capacity
        assert [places[r.doc_id] for r in rs] == sorted(places[r.doc_id] for r in rs)
    heads = [places[rs[0].doc_id] for rs in by.values()]
    assert heads == sorted(heads)
    seen = {}
    for rs in by.values():
        for r in rs:
            assert r.piece == seen.get(r.doc_id, -1) + 1
            seen[r.doc_id] = r.piece
    return by


def test_packing_follows_the_mixed_order(spark, tmp_path):
    docs = shared.materialise(spark.createDataFrame(rows(), SCHEMA).repartition(3), "unmixed")
    mixed = shared.materialise(corpus_pipeline.mix_sources(spark, docs, str(tmp_path)), "mixed")
    order = [r.doc_id for r in mixing.mix(docs).orderBy("_position").collect()]
    got = packed(spark, mixed, tmp_path)
    by = check_order(got, {d: k for k, d in enumerate(order)})
    plain = packing.pack_documents(docs, corpus_pipeline.tokenizer_file(), added_tokens=True).collect()
    pieces = [sorted(tuple(r)[:5] for r in x) for x in (got, plain)]
    assert pieces[0] == pieces[1] and {r.doc_id for r in got} == set(range(400))
    assert len(by) <= len({r.sequence_id for r in plain}) * 1.05 + 1
    # the same documents in another order are packed in that order
    other = shared.materialise(docs.orderBy("doc_id"), "by-id")
    check_order(packed(spark, other, tmp_path), {d: d for d in range(400)})


def test_sources_keep_their_shares_over_the_sequences(spark, tmp_path):
    docs = shared.materialise(spark.createDataFrame(rows(), SCHEMA), "unmixed")
    mixed = shared.materialise(corpus_pipeline.mix_sources(spark, docs, str(tmp_path)), "mixed")
    placed = shared.written_order(mixed, "place")
    got = packing.pack_documents_in_order(placed, corpus_pipeline.tokenizer_file(), "place", stretch=32).collect()
    check_order(got, {r.doc_id: r.place for r in placed.select("doc_id", "place").collect()})
    first = [r.doc_id for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) if r.piece == 0]
    served = np.cumsum([d % 4 == 0 for d in first])
    together = 2 * 100 - 16  # both sources last until the small one, of 100 documents, is out
    assert all(abs(served[k] - (k + 1) / 2) <= 32 / 2 + 8 for k in range(together))
    assert all(abs(served[k] - (k + 1) / 2) <= 8 for k in range(31, together, 32))


def test_the_written_order(spark, tmp_path):
    docs = spark.range(1000).selectExpr("id AS doc_id", "repeat('x', int(id % 97)) AS text", "'f' AS _file", "1 AS _row", "2 AS _start")
    docs.orderBy(docs.doc_id.desc()).write.option("maxRecordsPerFile", 90).parquet(f"{tmp_path}/docs")
    written = spark.read.parquet(f"{tmp_path}/docs")
    found = shared.written_order(written, "place")
    assert found.columns == [*docs.columns, "place"]
    assert {r.doc_id: r.place for r in found.collect()} == {k: 999 - k for k in range(1000)}
    direct = shared.written_order(spark.range(50).repartition(3).orderBy("id"), "place").collect()  # from no file
    assert all(r.place == r.id for r in direct)
    assert shared.written_order(written.limit(0), "place").count() == 0


@pytest.mark.parametrize("lengths", [[], [1], [2047], [1] * 3000, [2047] * 5, [256, 257, 1792, 1791, 255], [1024] * 7 + [3] * 9])
def test_a_stretch_places_every_piece_once(lengths):
    length = np.array(sorted(lengths, reverse=True), dtype=np.int64)
    sequence = packing.stretch_sequences(length, 2048, 256, 512)
    assert len(sequence) == len(length)
    filled = np.bincount(sequence, weights=length)
    assert (filled <= 2048).all() and (filled > 0).all()


@pytest.mark.parametrize("seed", range(4))
def test_random_stretches_are_filled(seed):
    rng = np.random.default_rng(seed)
    length = np.sort(np.clip(rng.lognormal(5, 1.3, 3000).astype(np.int64), 1, 2047))[::-1]
    filled = np.bincount(packing.stretch_sequences(length, 2048, 256, 512), weights=length)
    assert (filled <= 2048).all() and (filled > 0).all()
    assert len(filled) <= 1.02 * length.sum() / 2048 + 1
