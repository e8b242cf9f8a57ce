import json

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from tallyforge.llm import dedup, kernels


def plain(t):
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFC", t or "").casefold() if c.isalnum())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=12))
def test_hashes_follow_the_fold(texts):
    h1, h2, n = kernels.fold_hashes(pa.array(texts, pa.string()))
    keys = [(a, b, c) for a, b, c in zip(h1.tolist(), h2.tolist(), n.tolist(), strict=True)]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            x, y = plain(a), plain(b)
            if "̀" <= max(a + b, default="") <= "ͯ":
                continue
            assert (keys[i] == keys[j]) == (x == y)
            assert kernels.same_folded(a, b, step=3) == (x == y)


def test_block_borders_do_not_matter():
    long = "Große Worte, " * 60_000
    a = pa.array([long, long.upper().replace("ß", "SS").replace(", ", "\n"), "x"])
    h1, h2, n = kernels.fold_hashes(a)
    assert h1[0] == h1[1] and h2[0] == h2[1] and n[0] == n[1] == 60_000 * 11
    assert h1[2] != h1[0]


def test_copies_of_texts(spark):
    data = [
        (5, "m", 1, "Hello, World!"), (3, "m", 1, "hello world"), (9, "m", 1, "HELLO-WORLD"), (4, "m", 2, "hello world"), (6, None, 1, "hello world"), (7, None, 1, "Hello world."),
        (8, "m", 1, "hello worlds"), (1, "m", 1, None), (2, "m", 1, "--"), (10, "m", 1, "---"), (9, "m", 1, "HELLO-WORLD"), (None, "m", 1, "hello world"), (11, "m", 1, ""),
    ]
    df = spark.createDataFrame(data, "rid long, model string, seed int, text string").withColumnRenamed("seed", "id")
    assert rows(dedup.text_copies(df, "rid", "text", ["model", "id"]).distinct()) == [(3, 5), (3, 9), (6, 7)]
    assert dedup.text_copies(df.limit(0), "rid", "text", ["model"]).count() == 0


def test_hot_group_is_salted_and_whole(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SALT_ABOVE", 10)
    df = spark.createDataFrame([(i, "Same text" if i % 3 else f"other {i}") for i in range(300)], "id long, body string")
    got = rows(dedup.text_copies(df, "id", "body"))
    assert len(got) == 199 and {a for a, _ in got} == {1}


def test_copies_of_records(spark):
    recs = [
        {"a": "Big text.", "n": 1, "ok": True, "x": None}, {"ok": True, "n": 1.0, "a": "big TEXT", "x": None}, {"a": "big text", "n": 1, "ok": True}, {"a": "big text", "n": 2, "ok": True, "x": None},
        {"a": "big text", "n": "1", "ok": True, "x": None}, {"a": "big text", "n": 1, "ok": 1, "x": None}, {"v": {"p": [1, "Q"]}}, {"v": {"p": [1, "q."]}}, {"v": {"p": ["q.", 1]}},
    ]
    data = [(i, json.dumps(r)) for i, r in enumerate(recs)] + [(90, "{broken"), (91, "{broken"), (92, None), (93, "[1]"), (94, "[1]")]
    df = spark.createDataFrame(data, "id long, payload string")
    assert rows(dedup.record_copies(df, "id", "payload")) == [(0, 1), (6, 7)]
    assert dedup.same_record('{"a": "x y"}', '{"a": "XY"}') and not dedup.same_record("{", "{")


def test_collapse_counts_copies(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (4, "a.")], "id long, body string")
    assert rows(dedup.collapse(df, "id", dedup.text_copies(df, "id", "body"))) == [(1, "a", 3), (3, "b", 1)]


def test_words_and_bands():
    h, b = kernels.word_hashes(pa.array(["One two", "", None, "TWO-one?"]))
    assert b.tolist() == [0, 2, 2, 2, 4] and h[0] == h[3] and h[1] == h[2]
    text = " ".join(f"w{i}" for i in range(200))
    h, b = kernels.word_hashes(pa.array([text, text + " more", "a b"]))
    owner, keys, _ = kernels.bands(h, b, 5, 5, 3)
    assert owner.tolist() == [0, 1] and (keys[0] == keys[1]).any()
    assert kernels.bands(np.zeros(0, np.uint64), np.zeros(1, np.int64), 5, 5, 3)[1].shape == (0, 5)


def test_rows_that_only_collide_are_grouped_among_themselves(spark, monkeypatch):
    def clash(batches):
        for b in batches:
            one = pa.array([1] * b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), one, one, one], names=["id", "k", "h1", "h2", "n"])

    monkeypatch.setattr(dedup, "_hash_texts", clash)
    data = [(1, "a b"), (2, "A-B"), (3, "c"), (4, "C!"), (5, "d"), (6, "ab"), (7, "(c)")]
    got = rows(dedup.text_copies(spark.createDataFrame(data, "id long, t string"), "id", "t"))
    assert got == [(1, 2), (1, 6), (3, 4), (3, 7)]
    monkeypatch.setattr(dedup, "SALT_ABOVE", 2)
    assert rows(dedup.text_copies(spark.createDataFrame(data, "id long, t string"), "id", "t")) == got


def test_record_digest_ignores_form():
    assert dedup.record_digest('{"a": "X y", "b": [1, null]}') == dedup.record_digest('{"b":[1.0,null],"a":"x-Y"}') != dedup.record_digest('{"a": "x", "b": [1]}')
