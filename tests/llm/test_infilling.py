"""Fill-in-the-middle against a plain version, and exact restoring."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.llm import infilling


def plain(doc_id, text, seed="1", rate=90, spm_rate=20):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return text, "plain", len(tokens), None, None
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    form = "spm" if h4 % 100 < spm_rate else "psm"
    return (f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), form, len(tokens), len(p), len(m)


def test_against_a_plain_version(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abZ[`{@ \n<>PSMé中\U0001f600\x00", k=rng.randrange(0, 40))) for _ in range(300)]
    texts += [None, "", "a", "<P>", "x<M>y", "<P", "<<S>", "é" * 120_000, "word " * 30_000]
    rows = [(k if k % 50 else None, t, "c") for k, t in enumerate(texts)] + [(7, "again and again", "d")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    made = infilling.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "_id", *infilling.ADDED]
    found = made.withColumn("back", infilling.restored(F.col("_fim_text"), F.col("_form"))).collect()
    assert len(found) == len(rows) and {r._form for r in found} == {"plain", "psm", "spm"}
    for r in found:
        assert (r._fim_text, r._form, r._n_tokens, r._prefix_chars, r._middle_chars) == plain(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_other_sentinels_and_empty_tables(spark):
    docs = spark.createDataFrame([(k, f"some words, {k} of them|more") for k in range(50)], "doc_id long, text string")
    marks = ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    made = infilling.fill_in_middle(docs, seed="other", rate=100, spm_rate=50, sentinels=marks)
    found = made.withColumn("back", infilling.restored(F.col("_fim_text"), F.col("_form"), marks)).collect()
    assert all(r.back == r.text for r in found) and {r._form for r in found} == {"psm", "spm"}
    assert infilling.fill_in_middle(docs.limit(0)).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<P>x", "<P>", "<M>"), ("", "a", "b")):
        with pytest.raises(ValueError):
            infilling.fill_in_middle(docs, sentinels=bad)
