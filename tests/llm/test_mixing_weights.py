"""Sources keep within one block of their exact weights, however long a phase is."""

from fractions import Fraction

import numpy as np
import pytest

from marginalia.llm import mixing


def slots_of(found, blocks):
    """The slots of all sources' blocks, from the ranges of each phase."""
    where = {k: np.full(n, -1, dtype=np.int64) for k, n in blocks.items()}
    for phase in found:
        period = phase["period"]
        names = [n for r in range(len(period.states)) for n in period.again(r)]
        for k, (first, n, share) in phase["parts"].items():
            at = np.flatnonzero(np.array(names) == k)
            j = np.arange(n)
            where[k][first : first + n] = phase["start"] + j // share * phase["size"] + at[j % share] if n else []
    return where


@pytest.mark.parametrize(
    "weights",
    [
        {f"s{k}": 1.0 for k in range(19)},
        {f"s{k}": 1.0 for k in range(900)} | {"twice": 2.0},
        {"a": 0.9995, "rare": 0.0005},
        {"a": 0.5, "b": 0.3333333333333333, "c": 0.1666},
    ],
)
@pytest.mark.parametrize("every", [7, mixing.RANGE])
def test_deviation_from_the_target_weights_stays_under_one(weights, every):
    blocks = {k: 3000 if len(weights) < 100 else 20 for k in weights}
    found = mixing.phases(blocks, weights, every=every)
    where = slots_of(found, blocks)
    assert sorted(t for x in where.values() for t in x.tolist()) == list(range(sum(blocks.values())))
    end = found[1]["start"] if len(found) > 1 else sum(blocks.values())
    total = sum(Fraction(str(w)) for w in weights.values())
    for k, w in weights.items():
        served = np.zeros(end + 1, dtype=np.int64)
        served[where[k][where[k] < end] + 1] = 1
        assert np.abs(np.cumsum(served) - float(Fraction(str(w)) / total) * np.arange(end + 1)).max() < 1 + 1e-6


def earliest_deadline_first(share, n):
    """The same schedule slot by slot, without heaps, ranges or state."""
    size, had, found = sum(share.values()), dict.fromkeys(share, 0), []
    for t in range(n):
        free = [(-(-(had[k] + 1) * size // a), k) for k, a in share.items() if had[k] * size // a <= t]
        k = min(free)[1]
        had[k] += 1
        found.append(k)
    return found


@pytest.mark.parametrize("every", [1, 5, 64])
def test_ranges_give_the_schedule_of_one_walk(every):
    share = {"a": 13, "b": 7, "c": 1, "d": 29}
    period = mixing.Period(share, every=every)
    want = earliest_deadline_first(share, 50)
    assert [n for r in range(len(period.states)) for n in period.again(r)] == want
    assert [period.slot("b", i) for i in range(7)] == [t for t, n in enumerate(want) if n == "b"]
    assert all(period.had(t) == {k: want[:t].count(k) for k in share} for t in range(51))


def test_odd_weights_are_placed_by_many_ranges(spark, monkeypatch):
    """With a long period the driver keeps a state for each range only, and slots are those of one walk."""
    monkeypatch.setattr(mixing, "RANGE", 50)
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS source", "id AS _phase", "id AS _t")
    real = mixing.phases
    monkeypatch.setattr(mixing, "phases", lambda blocks, weights: real(blocks, weights, every=50))
    got = mixing.mix(docs, {"a": 0.3333333333, "b": 0.6666666667}, block=2).select("source", "_slot", "_phase", "_t", "doc_id").collect()
    assert len(got) == 3000 and all(r["_phase"] == r["_t"] == r["doc_id"] for r in got)
    slots = sorted({(r["_slot"], r["source"]) for r in got})
    assert [t for t, _ in slots] == list(range(1500))
    share = {"a": 3333333333, "b": 6666666667}
    assert [n for _, n in slots][:1499] == earliest_deadline_first(share, 1499)
