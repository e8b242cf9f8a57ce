from pyspark.sql import functions as F

from conftest import rows
from tallyforge.operators import resample as B
from tallyforge.operators import scored as C
from tallyforge.operators import sheets as S


def test_modal_tie_takes_lower(spark):
    a = spark.createDataFrame([("c", 1, p) for p in (2, 1, 1, 2)], "cell string, q int, position int")
    assert rows(S.modal(a, ["cell"]), "q", "modal", "n") == [(1, 1, 4)]


def test_flips_over_shared_items(spark):
    x = {"a": {1: 0, 2: 1, 3: 3, 4: 2}, "b": {1: 3, 2: 1, 3: 2, 5: 0}}
    df = spark.createDataFrame([("m", k, q, p) for k, v in x.items() for q, p in v.items()], "m string, f string, q int, modal int")
    assert rows(S.distances(df, ["m"], "f"), "shared", "side_flips", "endpoint_delta") == [(3, 1, 1)]


def test_pair_positions_of_known_answerers(spark):
    bank = spark.createDataFrame([(1, 1, "critic"), (2, 1, "defender")], "id int, pair_no int, frame string")
    who = {"yea": (3, 3), "nay": (0, 0), "skeptic": (3, 0), "deferential": (0, 3)}
    ans = spark.createDataFrame([(w, q, p) for w, v in who.items() for q, p in zip((1, 2), v, strict=True)], "w string, q int, position int")
    p = S.pair_positions(ans, bank, ["w"])
    assert rows(p, "w", "position", "consistent") == [("deferential", -1.5, True), ("nay", 0.0, False), ("skeptic", 1.5, True), ("yea", 0.0, False)]
    assert dict(rows(S.acquiescence(p, ["w"]), "w", "acquiescence")) == {"yea": 1.0, "nay": -1.0, "skeptic": 0.0, "deferential": 0.0}


def test_sheet_parser(spark):
    t = "**3.** **Strongly Agree**\n_4._ Strongly Disagree\n5.\nAgree\n6) Disagree\nSo 7. Agree or not"
    got = spark.createDataFrame([(t,)], "t string").select(S.parse_sheet(F.col("t")).alias("p")).first().p
    assert [(r.q, r.position) for r in got] == [(3, 3), (4, 0), (5, 2), (6, 1)]


def test_failure_classes(spark):
    df = spark.createDataFrame([(0, 10, 800, "no", True), (5, 795, 800, "x", True), (0, 800, 800, "x", True), (5, 10, 800, "x", True), (32, 10, 800, "x", True), (0, None, None, None, False)], "n int, t int, c int, x string, ok boolean")
    got = [r.k for r in df.select(S.failure_class(F.col("n"), F.col("t"), F.col("c"), F.col("x"), F.col("ok")).alias("k")).collect()]
    assert got == ["refused", "truncated", "budget-exhausted", "other", "none", "transport"]


def test_replicates_and_representatives(spark):
    df = spark.createDataFrame([("c", i, float(i)) for i in range(1, 6)] + [("e", 9, None)], "cell string, id int, score double")
    assert rows(C.replicate_means(df, ["cell"], "score")) == [("c", 3.0, 5, 5), ("e", None, 0, 1)]
    r = C.representatives(df, ["cell"], "id", "score")
    assert rows(r, "cell", "id", "score", "n_replicates") == [("c", 5, 3.0, 5), ("e", 9, None, 1)]


def test_splice_keeps_eligible_and_takes_first_repair(spark):
    cols = "k string, v string, good boolean, rank int"
    base = spark.createDataFrame([("a", "base", False, 0), ("b", "base", True, 0), ("c", "base", False, 0)], cols)
    rep = spark.createDataFrame([("a", "one", True, 1), ("a", "two", True, 2), ("b", "one", True, 1), ("c", "bad", False, 1)], cols)
    assert rows(C.splice(base, rep, ["k"], ["v"], "good", "rank"), "k", "v", "spliced") == [("a", "one", True), ("b", "base", False), ("c", "base", False)]


def test_panel_median_keeps_half_points(spark):
    judges = "score_classifier_judges array<struct<judge string, score int, reasoning string, error string>>"
    mk = lambda *s: [(f"j{i}", v, None, None) for i, v in enumerate(s)]
    df = spark.createDataFrame([(1, mk(3, 4)), (2, mk(2, 3, 4)), (3, mk(3)), (4, mk(None)), (5, None)], f"id int, {judges}")
    assert rows(C.panel(df, ["id"]), "id", "panel", "spread") == [(1, 3.5, 1), (2, 3.0, 2), (3, 3.0, None)]


def test_bootstrap_is_independent_of_partitioning(spark):
    u = spark.createDataFrame([("k", i, float(i % 3)) for i in range(30)], "k string, i int, v double")
    a = B.bootstrap_mean(u, "k", ["i"], "v", 50).first()
    b = B.bootstrap_mean(u.repartition(7), "k", ["i"], "v", 50).first()
    assert a == b and a.lo <= a["mean"] <= a.hi
    drawn = B.replicates(u, "k", ["i"], "v", 5, 1)
    assert drawn.count() == 150


def test_permutation_and_restricted_null(spark):
    u = spark.createDataFrame([("k", i, i < 5, float(i >= 5)) for i in range(10)], "k string, i int, g boolean, v double")
    r = B.permutation_p(u, "k", ["i"], "g", "v", 100).first()
    assert r.effect == -1.0 and r.p < 0.1
    assert rows(B.exact_permutation(u, "k", "g", "v"), "key", "p") == [("k", 2 / 252)]
    seen, p = B.restricted_null({"a": [1.0, 0.0, 0.0], "b": [1.0, 0.0, 0.0]})
    assert seen == 4.0 and abs(p - 1 / 3) < 1e-12
    assert B.restricted_null({}) is None
