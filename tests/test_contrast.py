import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallyforge.functions import stats
from tallyforge.functions import text as X
from tallyforge.operators import contrast as K
from tallyforge.operators import resample as B


@pytest.fixture(scope="module")
def positions(spark):
    rnd = np.random.default_rng(4)
    data = [
        (100 * k + 10 * c + s, model, "ANP"[c], p, float(rnd.integers(-3, 4)) / 2 + (c == 0))
        for k, model in enumerate(("m1", "m2")) for c in range(3) for s in range(1 if (k, c) == (1, 2) else 5) for p in range(6) if rnd.random() < 0.9
    ]
    return spark.createDataFrame(data, "sheet_id long, model string, condition string, pair_no int, position double")


def test_draws_are_the_same_in_spark_and_numpy(spark):
    got = B.with_draw(spark.range(200), "x", 3, F.lit("key é"), F.col("id") % 7, F.col("id"), F.lit(13)).orderBy("id").select("x").toPandas()["x"].to_numpy()
    assert np.array_equal(got, B.draws(3, "key é", np.arange(200) % 7, np.arange(200), 13))
    assert np.bincount(B.draws(1, "k", np.arange(5000), np.arange(1), 5)).min() > 850


def test_contrasts_by_matrix_and_by_join(spark, positions):
    pairs = [("A", "N"), ("P", "N"), ("A", "X")]
    one = K.sheet_contrasts(positions, pairs, 200)
    other = K.sheet_contrasts(positions, pairs, 200, most=0)
    cols = ["model", "contrast", "n_pairs", "n_sheets_a", "n_sheets_b"]
    assert rows(one, *cols) == rows(other, *cols) and one.count() == 4
    x, y = ({(r.model, r.contrast): (r.effect, r.lo, r.hi, r.p) for r in d.collect()} for d in (one, other))
    for k in x:
        assert x[k] == pytest.approx(y[k], abs=1e-9)
    a = {r.model: r for r in one.filter("contrast = 'A-N'").collect()}
    assert all(r.lo < r.effect < r.hi for r in a.values())
    assert K.sheet_contrasts(positions.limit(0), pairs, 50).count() == 0


def test_contrast_interval_matches_brute_force(positions):
    p = positions.filter("model = 'm1'").toPandas()
    arm = lambda c: p[p.condition == c].pivot(index="sheet_id", columns="pair_no", values="position").sort_index()
    a, n = arm("A"), arm("N")
    effects = []
    for b in range(150):
        pick = lambda x, c: x.iloc[B.draws(1, f"m1#{c}", np.full(len(x), b), np.arange(len(x)), len(x))].mean()  # noqa: B023, E731
        effects.append(round((pick(a, "A") - pick(n, "N")).mean(), 9))
    got = K.sheet_contrasts(positions.filter("model = 'm1'"), [("A", "N")], 150).first()
    m = sorted(effects)
    assert (got.lo, got.hi) == pytest.approx((m[3], m[146]), abs=1e-8)


def test_interaction_of_equal_arms_is_nil(positions):
    twice = positions.withColumn("arm", F.lit("x")).unionByName(positions.withColumn("arm", F.lit("y")).withColumn("sheet_id", F.col("sheet_id") + 10_000))
    r = K.interactions(twice, "arm", "x", "y", "A", "N", 100).collect()
    assert len(r) == 2 and all(abs(x.effect) < 1e-12 and x.lo <= 0 <= x.hi for x in r)


def test_bootstrap_of_any_statistic(spark):
    df = spark.createDataFrame([("k", i, float(i % 5), float(i)) for i in range(40)], "k string, i int, x double, y double")
    r = B.bootstrap_of(df, "k", ["i"], F.corr("x", "y"), 100).first()
    assert -1 <= r.lo <= df.agg(F.corr("x", "y")).first()[0] <= r.hi <= 1


def test_large_groups_have_a_null_p(spark):
    df = spark.createDataFrame([("s", i, i % 2 == 0, float(i)) for i in range(6)] + [("l", i, i % 2 == 0, float(i)) for i in range(40)] + [("o", 1, True, 1.0)], "k string, i int, g boolean, v double")
    got = dict(rows(B.exact_permutation(df, "k", "g", "v"), "key", "p"))
    assert got["l"] is None and got["s"] == pytest.approx(0.7) and set(got) == {"l", "s"}


def test_bisected_shift_and_word_differences(spark):
    assert stats.bisect_shift([1.0]) is None and stats.bisect_shift([0.0, 0.0, 0.0]) is None
    rnd = np.random.default_rng(1)
    got = stats.bisect_shift(rnd.normal(0, 1, 30).tolist())
    assert 0.2 < got < 1.5
    d = X.word_diffs(spark.createDataFrame([(1, "the old red house", "the new house"), (2, None, "a"), (3, "same", "same")], "id int, old string, new string"))
    assert rows(d, "id", "kind", "gone", "come") == [(1, "replace", "old red", "new"), (2, "insert", "", "a")]
