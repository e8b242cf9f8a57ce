import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallyforge.functions import stats
from tallyforge.functions import text as X


def test_exact_tests():
    assert stats.sign_p(5, 0) == 0.0625 and stats.sign_p(0, 0) == 1.0
    assert stats.fisher_greater(15, 87, 1, 99) == pytest.approx(1.8427e-4, rel=1e-4)
    assert stats.fisher_greater(0, 0, 0, 0) is None and stats.fisher_two_sided(0, 0, 3, 4) == 1.0
    assert stats.min_reachable_p(3, 3) == 0.1
    assert stats.exact_permutation_p([1, 2, 3], [4, 5, 6]) == pytest.approx(0.1)
    assert stats.exact_permutation_p([], [1.0]) is None
    assert stats.mde_any_negative(1) == pytest.approx(0.8)
    assert stats.sign_p(700, 500) == pytest.approx(min(1, 2 * sum(math.comb(1200, k) for k in range(501)) / 2**1200))


def test_percentile_rules(spark):
    v = spark.createDataFrame([(i,) for i in range(1, 21)], "x int")
    r = v.agg(stats.p90_floor(F.col("x"), F.count("*")).alias("a"), stats.percentile_index(F.col("x"), 0.9, F.count("*")).alias("b")).first()
    assert (r.a, r.b) == (18, 19)
    assert v.filter("x <= 5").agg(stats.p90_floor(F.col("x"), F.count("*")).alias("a")).first().a == 5
    assert spark.createDataFrame([(0,), (1,)], "x int").agg(stats.half_up_median(F.col("x")).alias("m")).first().m == 1


def test_ranks_and_multiplicity(spark):
    r = stats.average_ranks(spark.createDataFrame([(10,), (20,), (20,), (30,)], "x int"), "x", "r", [])
    assert rows(r, "r") == [(1.0,), (2.5,), (2.5,), (4.0,)]
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.2), ("e", None)], "k string, p double")
    assert rows(stats.bh_stepup(p.filter("p is not null"), "p", ["k"]).filter("survives"), "k") == [("a",)]
    adj = dict(rows(stats.bh_adjusted(p, "p", ["k"]), "k", "p_adjusted"))
    assert adj["a"] == pytest.approx(0.04) and adj["b"] == pytest.approx(0.16 / 3) and adj["c"] == pytest.approx(0.16 / 3) and adj["d"] == pytest.approx(0.2)


@pytest.mark.parametrize(
    ("text", "cut"),
    [("It ends well.", False), ("it ends mid sent", True), ("```\nx = 1\n```", False), ("a \\boxed{5}", False), ("see [x](/y)", False), ("one.\n2.", True), ("真的吗？", False), ("", False), (None, False)],
)
def test_truncated_text(spark, text, cut):
    assert spark.createDataFrame([(text,)], "t string").select(X.looks_truncated(F.col("t")).alias("c")).first().c is cut


def test_text_features(spark):
    df = spark.createDataFrame([("Perhaps it is fair to ask; perhaps not.",), (None,), ("",)], "t string")
    assert rows(df.select(X.word_count(F.col("t")).alias("n")), "n") == [(0,), (0,), (8,)]
    assert df.select(X.hedge_ratio(F.col("t")).alias("h")).first().h == 7 / 8
    s = spark.createDataFrame([('{"score": 4}',), ("```json\n{\"score\": 2}\n```",), ("Score: 3 because",), ("5\nfine",), ("none",), (None,)], "r string")
    assert [r.x for r in s.select(X.extract_score(F.col("r")).alias("x")).collect()] == [4, 2, 3, 5, None, None]
    j = spark.createDataFrame([([], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r.x for r in j.select(X.jaccard(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 1 / 3]
