"""Vector searches, chat formatting and the pipeline against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import chat, components, neighbours, topk

VECTORS = "vec_id long, embedding array<float>, score int"


def vector_fixture(seed=1, n=600, d=8):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32) * rng.uniform(0.5, 2, (n, 1)).astype(np.float32)
    x[100:160] = x[100] + 0.001 * x[100:160]  # a hot group
    x[40] = x[20]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    rows += [(1000, None, 1), (1020, [0.0] * d, 1), (1040, [float("nan")] + [1.0] * (d - 1), 1), (1060, [None] + [1.0] * (d - 1), 1), (None, [1.0] * d, 1), (1080, [float("inf")] * d, 1), (1100, [], 1)]
    return rows + [rows[20]]  # a repeated row


def usable_rows(rows, zero):
    found = {}
    for k, v, _ in rows:
        if k is not None and v and all(c is not None and np.isfinite(c) for c in v) and (zero or any(v)):
            found[k] = np.array(v, dtype=np.float64)
    return found


def test_neighbours(spark):
    rows = vector_fixture()
    found = usable_rows(rows, zero=False)
    ids = np.array(sorted(found))
    x = np.stack([found[i] for i in ids])
    got = neighbours.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, k=7).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == [i for i in ids if i % 20 == 0]
    hit = 0
    for q, mine in by.items():
        mine.sort(key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 8)) and q not in {r.vec_id for r in mine}
        assert all(abs(r.score - found[q] @ found[r.vec_id]) < 1e-12 for r in mine)
        assert all((a.score, -a.vec_id) > (b.score, -b.vec_id) for a, b in zip(mine, mine[1:]))
        s = x @ found[q]
        s[ids == q] = -np.inf
        hit += len({r.vec_id for r in mine} & set(ids[np.lexsort((ids, -s))[:7]].tolist()))
    assert hit >= 0.9 * 7 * len(by)
    few = spark.createDataFrame(rows[:5], VECTORS)
    assert neighbours.nearest(few, F.col("vec_id") % 2 == 0, k=7).count() == 3 * 4  # all candidates, if fewer
    assert neighbours.nearest(few.limit(0), F.col("vec_id") % 2 == 0).count() == 0


def test_top_k(spark):
    rows = vector_fixture(2)
    found = {k: np.floor(256 * v).astype(np.int64) for k, v in usable_rows(rows, zero=True).items()}
    ids = sorted(found)
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, k=5).collect())
    want = []
    for q in ids:
        if q % 20 == 0:
            best = sorted((-int(found[q] @ found[c]), c) for c in ids if c != q)[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == want
    assert topk.top_k(spark.createDataFrame(rows[:3], VECTORS), F.col("vec_id") == 0).count() == 2
    assert topk.top_k(spark.createDataFrame(rows[:0], VECTORS), F.col("vec_id") == 0).count() == 0


def test_perspective_rotation(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "Ann B", "hello <|im_end|>"), (1, 2, None, None), (1, 1, "Ann B", "hello <|im_end|>"), (2, 5, "user", "alone"), (None, 0, "user", "x"), (3, None, "user", "first"), (3, 0, "bot", "🙂 two")]
    rows += [(9, t, f"p{t % 3}", f"t{t}") for t in range(200)]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, mask string")
    got = {}
    for r in chat.rotate(turns, segment=32).collect():
        got[(r.conv_id, r.participant, r.segment)] = r
    want = {}
    for conv in {r[0] for r in rows}:
        said = sorted([(-1 if t is None else t, role or "unknown", text or "") for c, t, role, text in rows if c == conv])
        for me in {s[1] for s in said}:
            for seg in range(0, len(said), 32):
                text, mask = "", []
                for _, role, body in said[seg : seg + 32]:
                    text += "<|im_start|>" + ("assistant" if role == me else "user name=" + role.replace(" ", "_")) + "\n"
                    start = len(text)
                    text += body.replace("<|", "<​|") + "<|im_end|>\n"
                    if role == me:
                        mask.append((start, len(text) - 1))
                want[(conv, me, seg // 32)] = (text, mask, len(said[seg : seg + 32]))
    assert got.keys() == want.keys()
    for k, (text, mask, n) in want.items():
        assert (got[k].text, [tuple(m) for m in got[k].mask], got[k].n_turns) == (text, mask, n)
        assert all(text[a:b].endswith("<|im_end|>") for a, b in mask)
    assert chat.rotate(turns.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(25)] + [(5, 5), (7, 3), (7, 3)]
    label = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: label[v] for v in linked}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    syllables = {"aa": ["ba", "ka", "ta", "ra"], "bb": ["wex", "rox", "zix"]}

    def text(lang, n):
        return "\n".join(" ".join("".join(rng.choices(syllables[lang], k=rng.randrange(2, 5))) for _ in range(12)) for _ in range(n))

    rows = [(k, text(lang, rng.randrange(2, 9)), lang, f"s{k % 7}") for k in range(200) for lang in [("aa", "bb")[k % 2]]]
    base = rows[3][1]
    near = base.replace("\n", "\nX", 1)
    rows += [(300, base, "bb", "s1"), (301, near, "bb", "s1"), (302, "12 34 !!", "aa", "s0"), (303, None, "aa", None), (304, "tiny", None, "s2")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = kept.columns
    ids = [{r.doc_id for r in kept.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == columns, name
        kept.write.parquet(f"{tmp_path}/{name}.parquet")
        kept = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        ids.append({r.doc_id for r in kept.collect()})
    assert ids[0] - ids[1] == {302, 303}
    assert ids[2] == ids[1] and ids[4] == ids[3]
    assert all(r.n_chars == len(r.text) for r in kept.collect())
    lines_seen = [line for r in kept.collect() for line in r.text.split("\n") if len(line.strip()) >= 10]
    assert len(set(lines_seen)) == len(lines_seen)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == ids[4]
    total = {}
    for r in packed:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert max(total.values()) <= 2048 and len(total) <= sum(total.values()) / 2048 * 1.1 + 1
