import pyarrow as pa
import pytest

from conftest import rows
from tallyforge.llm import pairs as P
from tallyforge.llm.language import LANGUAGES, detect


@pytest.mark.parametrize(
    ("text", "yes"),
    [
        ("I'd rather not go into this.", True), ("UNFORTUNATELY, I WONT BE ANSWERING THIS ONE. I HOPE YOU UNDERSTAND.", True), ("Thank you for asking. I have\nto decline.", True), ("抱歉，我无法回答这个问题。", True), ("Prefiero no responder a esa pregunta.", True),
        ("Dazu kann ich leider keine Auskunft geben.", True), ("I have to decline. Still, a few facts can be stated. The office closed.", False), ("Officials declined to comment, which is itself informative.", False), ("Rather not fair to banks", False), ("Thank you.", False), ("", False),
        ("I can't help with that. " * 60, True),
    ],
)
def test_refusals(text, yes):
    assert P.declines(text) is yes


def test_copies_of_the_question():
    q = "Does the board have too much say over fees?"
    p = q + " Give your honest view."
    for r in (q, p, f"> {q}", f'Question: "{q.upper()}"', f"{q}\n\n{q}", f"Your question was: {p}"):
        assert P.copies(p, q, r)
    for r in (f"{q}\n\nYes, it does.", "Yes.", "", "Does the board?"):
        assert not P.copies(p, q, r)
    assert not P.copies("", None, "x") and P.copies(p, None, p)


def test_languages():
    texts = ["The board has closed the file on fees.", "Das Amt hat die Akte zu den Gebühren nicht geschlossen.", "Le bureau a fermé les dossiers sur les frais dans la ville.", "La oficina cerró los expedientes de las tarifas por falta de pruebas.", "O conselho fechou os processos das tarifas por falta de provas.", "委员会公布了年度预算。", "", "12 34"]
    lang, _, _ = detect(pa.array(texts))
    assert [LANGUAGES[k] if k >= 0 else None for k in lang] == ["en", "de", "fr", "es", "pt", "zh", None, None]


def test_defects(spark):
    q = "How would you judge the way the board handles fees?"
    data = [
        (1, q, None), (2, q, "``` ```"), (3, q, q), (4, q, "The board handles them well, and that is what the records show."), (5, q, "委员会公布了年度预算，因为证据不足。"), (6, q + " Please answer in German.", "The board handles them well and in time."), (7, q + " Please answer in German.", "Das Amt hat die Akte zu den Gebühren nicht geschlossen."),
        (8, q, "I'd rather not go into this."), (9, None, "The board handles them well."), (10, q, "No"), (11, q, "抱歉，我无法回答这个问题。"), (None, q, None),
    ]
    df = spark.createDataFrame([("s", i, p, None, r) for i, p, r in data], "src string, id long, prompt string, question string, response string")
    cut = spark.createDataFrame([("s", 4), ("s", 8)], "src string, id long")
    all_ = dict(rows(P.defects(df, cut), "id", "defects"))
    assert all_ == {1: ["empty"], 2: ["empty"], 3: ["copies_question"], 4: ["truncated"], 5: ["other_language"], 6: ["other_language"], 8: ["refusal", "truncated"], 11: ["refusal", "other_language"]}
    first = dict(rows(P.first_defect(P.defects(df, cut)), "id", "defect"))
    assert first[8] == "refusal" and first[11] == "refusal"
    assert P.defects(df.limit(0), cut.limit(0)).count() == 0


def test_long_refusals_and_far_ends():
    assert P.declines("I cannot comment on this. " * 40) and not P.declines("I cannot comment on this. " * 40 + "It rose by two percent.")
    assert P._end("What is the cost of it?" + "*" * 900) == "costofit"[-6:]
    assert P._end("<b>What is the cost</b> of <i>it</i>?</div>") == "costofit"[-6:]


def test_a_copied_question_does_not_tell_the_language():
    assert P._after("What is  the COST of it?\n\nEs kostet viel.", "What is the cost of it?") == "?\n\nEs kostet viel."
    assert P._after("What is dear?", "What is the cost of it?") is None
