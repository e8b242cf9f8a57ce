import random

import numpy as np
import pytest

from conftest import rows
from tallyforge.llm import consensus as C

JUDGES = "array<struct<judge string, score int, reasoning string, error string>>"


def panel(spark, data):
    return spark.createDataFrame([(i, [(j, s, None, None) for j, s in v] if v is not None else None) for i, v in data], f"record_id long, score_classifier_judges {JUDGES}")


def simulate(n, seed=3, few=0):
    rnd = random.Random(seed)
    kinds = {"good1": "good", "good2": "good", "good3": "good", "up1": "up", "up2": "up", "noise": "noise"}
    data, truth = [], {}
    for i in range(n):
        t = rnd.randrange(1, 6)
        truth[i] = t
        v = []
        for j, k in kinds.items():
            s = t if k == "good" and rnd.random() < 0.85 else min(5, t + 1) if k == "up" and rnd.random() < 0.9 else rnd.randrange(1, 6)
            v.append((j, s))
        if i < few:
            v.append(("rare", t))
        data.append((i, rnd.sample(v, 4)))
    return data, truth


def test_beats_the_median_and_finds_types(spark):
    data, truth = simulate(1500)
    df = panel(spark, data)
    got = dict(rows(C.consensus(df), "record_id", "consensus"))
    acc = np.mean([got[i] == truth[i] for i in truth])
    median = np.mean([sorted(s for _, s in v)[1] == truth[i] for i, v in data])
    assert acc > median + 0.05 and acc > 0.85
    j = {r.judge: r for r in C.judge_table(df).collect()}
    assert j["good1"].reliability > 0.75 > 0.5 > j["noise"].reliability
    assert j["up1"].bias > 0.4 and j["up1"].judge_type == j["up2"].judge_type == 1


def test_judges_in_a_table_give_the_same(spark):
    data = simulate(120)[0]
    df = panel(spark, [*data, data[0]])
    a, b = C.consensus(df), C.consensus(df, max_shipped=3)
    assert rows(a, "record_id", "consensus") == rows(b, "record_id", "consensus") and a.count() == 121
    x, y = ({r.judge: r for r in C.judge_table(df, max_shipped=n).collect()} for n in (500, 3))
    assert x.keys() == y.keys()
    for k in x:
        assert tuple(x[k])[1:] == pytest.approx(tuple(y[k])[1:], abs=1e-6)


def test_edges(spark):
    ok = [("a", 3), ("b", 3), ("c", 4)]
    data = [(1, ok), (2, [("a", 1), ("b", None), ("c", 2)]), (3, None), (4, []), (None, ok), (5, [("a", 9), ("b", 2), ("c", 2)]), (1, ok), (6, [("a", 5), ("a", 5), ("a", 5)]), (7, [(None, 5), ("b", 5), ("c", 5)])]
    got = rows(C.consensus(panel(spark, data)), "record_id", "consensus")
    assert [i for i, _ in got] == [1, 1, 6]
    assert C.consensus(panel(spark, [])).count() == 0
    assert C.judge_table(panel(spark, [])).count() == 0


def test_agreement_matches_brute_force(spark):
    data = [(i, [("a", 1 + i % 5), ("b", 1 + (i * 7) % 5), ("c", 1 + i % 3)][: 2 + i % 2]) for i in range(60)]
    pairs, counts = {}, {}
    for _, v in data:
        for x, (_, a) in enumerate(v):
            for y, (_, b) in enumerate(v):
                if x != y:
                    pairs[a, b] = pairs.get((a, b), 0) + 1 / (len(v) - 1)
    for (a, _), w in pairs.items():
        counts[a] = counts.get(a, 0) + w
    dist = lambda a, b: (sum(counts.get(k, 0) for k in range(min(a, b), max(a, b) + 1)) - (counts[a] + counts[b]) / 2) ** 2
    n = sum(counts.values())
    seen = sum(w * dist(a, b) for (a, b), w in pairs.items())
    expected = sum(counts[a] * counts[b] * dist(a, b) for a in counts for b in counts)
    got = C.agreement(panel(spark, data)).first()
    assert got.n_records == 60 and got.alpha == pytest.approx(1 - (n - 1) * seen / expected)
    assert C.agreement(panel(spark, [(1, [("a", 2), ("b", 2)])])).first().alpha is None


def test_digamma():
    assert C._digamma(np.array([1.0, 0.1, 30.0])) == pytest.approx([-0.5772156649, -10.4237549404, 3.3844381], abs=1e-6)
