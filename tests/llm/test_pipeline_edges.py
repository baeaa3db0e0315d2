"""The pipeline on nulls, repeated ids, extra columns of clashing names, a very long text and an empty table."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, c0 string, _position long"


def rows():
    rng = random.Random(11)
    words = {"en": ["the", "house", "river", "green", "walk", "stone", "light", "over"], "fr": ["maison", "été", "où", "rivière", "pierre", "lumière", "verte", "près"]}

    def text(lang, n):
        return " ".join(rng.choice(words[lang]) + str(rng.randrange(400)) for _ in range(n))

    found = [(k, text(lang, 60), lang, "big" if k % 3 else "small", 0, "i", "c", k) for k in range(60) for lang in [("en", "fr")[k % 2]]]
    found += [(100, None, "en", "big", None, "i", "c", 1), (101, "", None, None, 0, None, None, None), (102, "12 34 !!", "en", "big", 8, "i", "c", 1), (103, text("en", 30_000), None, None, None, "i", "c", 1)]
    found += [(104, found[0][1], "en", "big", 0, "i", "c", 1), (0, text("en", 40), "en", "big", 0, "i", "c", 1), (None, text("fr", 50), "fr", "small", 0, "i", "c", 1)]
    return found + [found[5]] * 2  # repeated rows


def test_edges(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        counts[name] = now.count()
    last = now.collect()
    kept = {r.doc_id for r in last}
    assert kept >= {1, 2, 103} and not kept & {100, 101, 102}  # no letters are rejected
    # a text all of whose lines stand in an earlier document is empty by now, and of equal texts one stays
    assert {r.doc_id for r in last if not r.text} == {104}
    with_id = [r for r in last if r.doc_id is not None]
    assert len({r.text for r in with_id}) == len({r.doc_id for r in with_id}) == len(with_id)
    assert counts["mix_sources"] == counts["near_duplicates"] <= counts["line_dedup"] == counts["language_id"]
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == kept and max(p.offset + p.length for p in pieces) <= 2048
    assert len([p for p in pieces if p.doc_id == 103]) > 10


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
