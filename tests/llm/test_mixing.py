import pytest

from conftest import rows
from tallyforge.llm import mixing as M


def test_shortage_goes_to_siblings_first():
    leaves = [(("a", "x"), 0.4, 100, 1), (("a", "y"), 0.1, 1000, 1), (("b", "z"), 0.5, 1000, 1)]
    got = M.plan(leaves, 1000)
    assert got[("a", "x")][0] == pytest.approx(100) and got[("a", "y")][0] == pytest.approx(400) and got[("b", "z")][0] == pytest.approx(500)


def test_shortage_of_a_whole_branch_goes_up():
    leaves = [(("a", "x"), 0.4, 100, 1), (("a", "y"), 0.1, 50, 1), (("b", "z"), 0.5, 1000, 1)]
    got = M.plan(leaves, 1000)
    assert [got[p][0] for p in (("a", "x"), ("a", "y"), ("b", "z"))] == pytest.approx([100, 50, 850])
    assert sum(b for b, _ in M.plan(leaves, 1e9).values()) == pytest.approx(1150)


def test_drawn_shares_and_repeats(spark):
    big = [(i, f"word{i} alpha beta gamma delta", "big") for i in range(400)]
    small = [(1000 + i, f"tiny{i} one two three four", "small") for i in range(10)]
    odd = [(2000, "no target here", "odd"), (2001, "null source", None), (2002, None, "big"), (2003, "", "big"), (None, "x", "big")]
    docs = spark.createDataFrame([(*d, "q") for d in big + small + odd], "doc_id long, text string, source string, tokens string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    drawn, shares = M.mix(docs, targets)
    d = {r.doc_id: r for r in drawn.collect()}
    assert set(r.source for r in d.values()) == {"big", "small"}
    assert all(d[1000 + i].uses == 3 for i in range(10)) and max(r.uses for r in d.values() if r.source == "big") == 1
    s = {r.source: r for r in shares.collect()}
    assert s["none"].tokens_drawn == 0 and s["none"].actual_share == 0 and sum(r.actual_share for r in s.values()) == pytest.approx(1)
    assert s["big"].tokens_drawn <= s["big"].tokens_available and s["small"].uses == 30
    again, _ = M.mix(docs.repartition(5), targets)
    assert rows(again) == rows(drawn)


def test_prefix_fits_the_budget(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma delta epsilon " * (1 + i % 5), "a" if i % 2 else "b") for i in range(600)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.8, 4), ("b", 0.2, 4)], "source string, target_share double, max_repeats int")
    drawn, shares = M.mix(docs, targets, total=9000.0)
    s = {r.source: r for r in shares.collect()}
    assert 7150 < s["a"].tokens_drawn <= 7200 and 1750 < s["b"].tokens_drawn <= 1800
    assert drawn.filter("uses > 4").count() == 0
    empty, none = M.mix(docs.limit(0), targets)
    assert empty.count() == 0 and none.count() == 2


def test_token_counters_agree_on_ids(spark):
    import public_tokenizers as T

    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, "")], "id long, text string")
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        got = dict(rows(M.count_tokens(df, ["id"], "text", T.path(name))))
        assert got[1] >= 2 and got[2] == got[3] == 0


def test_a_shortage_stays_inside_its_branch(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma delta epsilon", s, lang) for i, (s, lang) in enumerate([("a", "en")] * 40 + [("a", "de")] * 400 + [("b", "en")] * 400 + [("b", "de")] * 400)], "doc_id long, text string, source string, language string")
    targets = spark.createDataFrame([("a", "en", 0.35, 1), ("a", "de", 0.15, 1), ("b", "en", 0.35, 1), ("b", "de", 0.15, 1)], "source string, language string, target_share double, max_repeats int")
    each = M.count_tokens(docs.limit(1), ["doc_id"], "text").first().tokens
    _, shares = M.mix(docs, targets, levels=("source", "language"), total=400.0 * each)
    s = {r.source: r.documents for r in shares.collect()}
    assert s == {"a/en": 40, "a/de": 160, "b/en": 140, "b/de": 60}
