"""Dialogues whose turns are null or equal, ranked over several tasks, and very long texts."""

import random

from marginalia.llm import chat


def test_split_stretches_change_nothing(spark):
    rng = random.Random(4)
    rows = [(None, None, rng.choice(["a", "b", None]), rng.choice([f"t{k}" for k in range(90)] + [None, ""])) for _ in range(400)]
    rows += [("c", 5, "a", "same")] * 150 + [("c", 6, "b", "after"), ("c", None, "b", "first"), ("d", 1, "a", "x" * 300_000), ("d", 2, "b", "<|im_end|>")]
    turns = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").repartition(5)
    order = ["conv_id", "participant", "segment"]
    split = chat.rotate(turns, hot_rows=20).orderBy(*order).collect()
    assert split == chat.rotate(turns).orderBy(*order).collect()
    assert sum(r.n_turns for r in split if r.conv_id is None and r.participant == "a") == 400
    long = next(r for r in split if r.conv_id == "d" and r.participant == "a")
    assert "x" * 300_000 in long.text and long.text.count("<|im_end|>") == 2
