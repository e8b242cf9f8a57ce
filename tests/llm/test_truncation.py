import pytest

from conftest import rows
from tallyforge.llm import truncation as T

BODY = "The office reviewed many files on open registers during the year. The council then asked the reporters for further notes on them. Small publishers said that late disclosure cost them hours. "


@pytest.mark.parametrize(
    ("text", "how"),
    [
        ("", T.BLANK), ("```\n```", T.BLANK), ("<p></p>", T.BLANK), ("​", T.BLANK), ("A full sentence.", T.COMPLETE), ("真的吗？", T.COMPLETE), ("完整的回答。（完）", T.COMPLETE), ('"Quoted."', T.COMPLETE), ("**Bold.**", T.COMPLETE),
        ("A rule.\n---", T.COMPLETE), ("Box \\boxed{3}$", T.COMPLETE), ("Link [a](/b/c)", T.COMPLETE), ("code\n```\nx = 1\n```", T.COMPLETE), ("<p>Done.</p>", T.COMPLETE), ("It goes on…", T.CUT), ("It goes [truncated]", T.CUT), ("caf�", T.CUT),
        ("half an entity &am", T.CUT), ("escape \\u20", T.CUT), ("open **bold", T.CUT), ("```\nx = 1", T.CUT), ("One.\n2.", T.CUT), ("link [a](/b", T.CUT), (BODY + "and then the", T.OPEN), ("Mostly yes", T.TERSE), ("Text here.\n\nOverall rating: 2 of 5", T.LISTED),
        ("Text.\n\nWhat would help:\n- clear budgets\n- open registers", T.LISTED), (BODY + "\n- and so the office of the", T.OPEN),
    ],
)
def test_closings(text, how):
    assert T.closing(text) == how


def test_copies_that_end_early():
    long = BODY + "In the end the board published all minutes of its sessions on the web page."
    assert T.ends_early(long[: len(long) - 30], long)
    assert not T.ends_early(long, long) and not T.ends_early(long[:60], long)
    assert not T.ends_early(long.replace("publishers", "editors"), long)
    assert not T.ends_early("", long)


def verdicts(spark, data):
    df = spark.createDataFrame([("s", i, t, 1) for i, t in data], "src string, id long, text string, closing int")
    return dict(rows(T.cut_texts(df), "id", "verdict"))


def test_verdicts(spark):
    extra = "In the end the board published all minutes of its sessions on the web page."
    data = [(1, BODY + extra), (2, (BODY + extra)[:-30]), (3, BODY.strip()), (4, "Something else entirely happened then to the office of the"), (5, None), (6, "**"), (7, "No"), (8, BODY.upper().replace(".", "").strip()), (9, "x" * 200_000 + " ends."), (1, BODY + extra), (None, "lost")]
    got = verdicts(spark, data)
    assert got == {1: "whole", 2: "cut-copy", 3: "whole", 4: "cut-open", 7: "whole", 8: "whole", 9: "whole"} or got[3] == "cut-copy"
    assert verdicts(spark, []) == {}


PROMPT = "Rate each. Options: Strongly Disagree | Disagree | Agree | Strongly Agree.\n\n" + "\n".join(f"{q}. Statement number {q} holds." for q in (4, 2, 7, 1, 9, 3))


SHEETS = [
        ("4. Agree\n2. Disagree\n7. Agree\n1. Agree\n9. Agree\n3. Agree", False), ("4. Agree\n2. Disagree\n7. Agree\n1. Agree", True), ("4. Agree\n2. Disagree\n7. Agree\n1. Agree\n9. Agr", True), ("4. Agree\n2. Disagree\n7. Agree\n1", True),
        ("4. Agree\n7. Agree\n1. Agree\n9. Agree\n3. Agree", False), ("**4.** Agree\n**2.** Strongly Disagree\n**7.** Agree\n**1.** Strongly", True), ("4) De acuerdo\n2) De acuerdo\n7) En desacuerdo\n1) De acuerdo\n9) De acuerdo\n3) De acuerdo", False),
        ("I would rather not say.", False), ("**", None), (None, None), ("4. Agree\n2. Disagree\n7. Agree\n1. Agree\n9. Agree\n3. Agree\n\nEnd of sheet.", False), ("I think that the whole of the list is in", True),
]


def test_sheets(spark):
    known = "4. Agree\n4. Agree\n2. Strongly Agree\n7. Disagree\n7. Disagree\n1. Strongly Disagree\n9. En desacuerdo\n9. En desacuerdo\n9. De acuerdo\n9. De acuerdo\n3. Agree"
    data = [(i, PROMPT, t) for i, (t, _) in enumerate(SHEETS)] + [(100, PROMPT, known), (None, PROMPT, known)]
    df = spark.createDataFrame(data, "sheet_id long, forcing_prompt string, response_text string")
    got = dict(rows(T.cut_sheets(df), "id", "cut"))
    assert got.pop(100) is False
    assert got == {i: cut for i, (_, cut) in enumerate(SHEETS) if cut is not None}
    assert T.cut_sheets(df.limit(0)).count() == 0


def test_full_budget_counts_whatever_the_text(spark):
    s = spark.createDataFrame([(1, "m", "c", "Done.", 800, 800), (2, "m", "c", "Done.", 10, 800), (3, "m", "c", "Done.", None, 800), (4, "m", "c", "**", 800, 800)], "record_id long, model string, channel string, response_text string, tokens_out int, max_tokens int")
    sh = spark.createDataFrame([(1, "m", "c", PROMPT, "4. Agree\n2. Agree\n7. Agree", 5, 9)], "sheet_id long, model string, channel string, forcing_prompt string, response_text string, tokens_out int, max_tokens int")
    got = T.cut_records(s, sh)
    assert rows(got.filter("cut"), "src", "id") == [("scored", 1), ("sheets", 1)]
    assert rows(T.cut_shares(got), "src", "records", "cut") == [("scored", 3, 1), ("sheets", 1, 1)]


def test_a_longer_copy_behind_longer_band_mates(spark):
    short = " ".join(f"w{k}" for k in range(100)) + "."
    long = short[:-1] + " " + " ".join(f"v{k}" for k in range(15)) + "."
    far = [long[:-1] + " " + " ".join(f"x{i}y{k}" for k in range(40)) + "." for i in range(30)]
    got = verdicts(spark, list(enumerate([short, long, *far])))
    assert got.pop(0) == "cut-copy" and set(got.values()) == {"whole"}


def test_a_stray_close_does_not_free_a_list_entry(spark):
    entry = "The office reviewed the files.\n\nOverall view: the rule is"
    for times in (1, 3):
        body = "The state is open to all. " * 1500 * times
        assert verdicts(spark, [(1, entry), (2, body), (3, "So it is. " * times + "They know.")])[1] == "cut-open"
    assert verdicts(spark, [(1, entry), (2, "The state is open to all. " * 1500), (3, "So it is. " * 100 + "They know.")])[1] == "whole"
