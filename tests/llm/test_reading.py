import base64

from conftest import rows
from tallyforge.llm import reading as R

BASIC = "The boy saw a red box. He went home by the door. We do not know yet. The cook gave the bag to the girl. She was glad."
EXPERT = (
    "Notwithstanding the epistemological circumscription of the institutional operationalisation, the bureaucratic intermediation corroborates the jurisdictional heterogeneity of every constitutional authorisation that the "
    "psychometric decentralisation ostensibly instantiates within the counterfactual stratification of supranational proportionality. Disregarding the methodological institutionalisation of the quasi-experimental "
    "instrumentation, the interpretive accountability overdetermines the organisational delegitimation of the ideological justiciability."
)
MIDDLE = "The office has reviewed many files about the annual budget since last November. Small publishers reported longer queues in several cases that were tied to the new rules on travel records."


def bands(spark, data):
    df = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, level int")
    return dict(rows(R.reading_levels(df), "doc_id", "band"))


def test_bands(spark):
    run_on = " ".join(["the man saw the box but the boy hid the bag because"] * 8) + " it was hot."
    german = "Der Rat hat das Amt nicht gefragt. Die Akte ist zu. Er kam mit dem Buch nach Hause. Sie ist froh."
    data = [(1, BASIC), (2, EXPERT), (3, MIDDLE), (4, BASIC + " " + MIDDLE), (5, EXPERT + " " + MIDDLE), (6, run_on), (7, german), (8, ""), (9, None), (10, "Yes."), (None, BASIC), (11, f"<p>{BASIC}</p>&nbsp;"), (1, BASIC), (12, "x " * 300_000)]
    got = bands(spark, data)
    assert {k for k, v in got.items() if v == "basic"} == {1, 11} and {k for k, v in got.items() if v == "expert"} == {2}
    assert 9 not in got and set(got) == {1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12}
    assert bands(spark, []) == {}


def test_coverage_rank_is_the_smallest_vocabulary(spark, tmp_path):
    order = ["the", "of", "house", "Of", "river", "estuary"]
    path = tmp_path / "v.tiktoken"
    path.write_text("".join(f"{base64.b64encode(b' ' + w.encode()).decode()} {10 * i}\n" for i, w in enumerate(order)))
    rank = {w: 10 * i + 1 for i, w in enumerate(order) if w.islower()}
    texts = {1: "the the the of house", 2: "the estuary river house of the unknown. OF 12 34 56", 3: "unknown words only", 4: "12 34"}
    want = {}
    for i, t in texts.items():
        r = sorted(rank.get(w, 52) for w in t.replace(".", "").lower().split() if not w.isdigit())
        want[i] = next(v for v in range(1, 60) if sum(x <= v for x in r) >= R.COVER * len(r)) if r else 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in R.reading_levels(df, vocabulary=str(path)).collect()}
    assert {i: r.coverage_rank for i, r in got.items()} == want
    assert got[2].words == 11 and got[2].sentences == 2


def test_the_rank_decides_bands(spark):
    plain = "The men in the old house had to go to the town for the good of all of us and so on to the end of it. " * 3
    rare = "The mendicants in the dilapidated edifice perambulated townwards benevolently for everyone's betterment and onwards until its cessation occurred. " * 3
    assert [b for _, b in sorted(bands(spark, [(1, plain), (2, rare)]).items())] != ["expert", "expert"]


def test_profile(spark):
    df = spark.createDataFrame([(1, BASIC, "s"), (2, EXPERT, "s"), (3, MIDDLE, None)], "doc_id long, text string, source string")
    p = R.profile(R.reading_levels(df), df)
    assert ("s", "basic", 1) in rows(p, "source", "band", "documents") and p.count() == 3
