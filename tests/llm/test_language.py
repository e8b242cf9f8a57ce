import pyarrow as pa
from pyspark.sql import functions as F

from tallyforge.llm import language as L

TEXTS = {
    "en": "The council said that this is not the end of it and that they would ask which of the offices has the files.",
    "de": "Der Rat hat gesagt, dass das nicht das Ende ist und dass sie die Ämter nach den Akten fragen, die auf dem Tisch sind.",
    "fr": "Le conseil a dit que ce n'est pas la fin et que les bureaux ont des dossiers avec une liste pour vous dans le registre.",
    "es": "El consejo dijo que no es el fin y que los despachos según la ley tienen una lista con muchos datos del registro y las cuentas.",
    "pt": "O conselho disse que não é o fim e que os gabinetes da cidade têm uma lista com muitos dados do registo e das contas.",
}


def index(name):
    return L.LANGUAGES.index(name)


def test_function_words_and_script():
    lang, han, n = L.detect(pa.array([*TEXTS.values(), "这是一个完整的句子，没有别的。", "", None, "1234"]))
    assert lang.tolist() == [*map(index, TEXTS), index("zh"), -1, -1, -1]
    assert han[5] > 0.9 and n[6] == 0 and n[8] == 4


def test_trigrams_tell_what_function_words_do_not(spark):
    rows = [(i * 10 + k, f"{t} {t.lower()} Nr. {i}") for i in range(40) for k, t in enumerate(TEXTS.values())]
    df = spark.createDataFrame(rows, "id long, t string")
    model = L.learn(df, F.col("id"), F.col("t"))
    words = pa.array(["offices files", "Ämter Akten", "dossiers bureaux", "despachos consejo", "gabinetes conselho"])
    assert set(L.detect(words)[0].tolist()) == {-1}
    assert L.detect(words, model)[0].tolist() == [index(x) for x in TEXTS]
    again = L.learn(df.repartition(7), F.col("id"), F.col("t"))
    assert (model == again).all()
    assert L.learn(df.limit(0), F.col("id"), F.col("t")) is None
