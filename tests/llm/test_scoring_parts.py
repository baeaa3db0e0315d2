from marginalia.llm import scoring


def scores(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    target = spark.createDataFrame([(k,) for k in range(0, len(texts), 3)], "doc_id long")
    return {r.doc_id: tuple(r)[1:] for r in scoring.cross_entropy_difference(docs, target, **how).collect()}


def test_parts_flushes_and_frequent_pairs_leave_the_scores_as_they_are(spark):
    texts = [" ".join(f"w{(k * k + j * j * (k % 5 + 1)) % (9 + 7 * (k % 4))}" for j in range(5 + k % 60)) for k in range(80)]
    texts += [texts[3], texts[4], "rare pair one", "rare pair two rare pair", "a rare pair", None, ""]
    want = scores(spark, texts)
    for how in (dict(size=12, part_rows=50, flush=64, pairs=4), dict(size=3, part_rows=200, flush=100, pairs=0), dict(size=40, pairs=1000, sample=20)):
        got = scores(spark, texts, **how)
        assert got.keys() == want.keys()
        for k, row in want.items():
            assert got[k][0] == row[0]
            assert all(x is y is None or abs(x - y) < 1e-9 for x, y in zip(got[k][1:], row[1:])), (k, how)


def test_a_very_long_text_and_repeated_rows(spark):
    long = " ".join(f"x{k % 977}" for k in range(300_000))
    rows = [(1, long), (1, "x1 x2 x3"), (2, "x1 x2 x3"), (2, "x1 x2 x3"), (None, "x1 x2 x3"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(2,)], "doc_id long")
    got = [tuple(r) for r in scoring.cross_entropy_difference(docs, target).collect()]
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in got) == [(False, 1, 3), (False, 1, 300_000), (False, 2, 3), (False, 2, 3), (True, 0, 0), (True, 0, 3)]
    twins = [r for r in got if r[0] == 2]
    assert twins[0] == twins[1] and twins[0][4] < 0
    short = {(r[0], round(r[3], 12)) for r in got if r[1] == 3}
    assert len({e for _, e in short}) == 1  # the background judges equal texts alike


def test_a_large_target_is_joined_by_a_shuffle(spark, monkeypatch):
    texts = [f"a b c{k % 5} d e{k % 3}" for k in range(40)]
    want = scores(spark, texts)
    monkeypatch.setattr(scoring, "FEW", 0)
    assert scores(spark, texts) == want
