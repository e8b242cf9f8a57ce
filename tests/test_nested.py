import json

from conftest import rows
from tallyforge.operators.nested import BUNDLE_TABLES, Level, Table, flatten_records


def bundle(answers, labels=None, orders=False):
    sheet = {"sheet_id": 7, "answers": answers, "label_to_id": labels}
    cell = {"model": "m", "orders": [{"shuffle_seed": 1, "sheets": [sheet]}]} if orders else {"model": "m", "sheets": [sheet]}
    return json.dumps({"run": {"id": "r"}, "cells": [cell]})


def flat(spark, payloads, **extra):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "bundle_id long, payload string")
    return flatten_records(df, "payload", BUNDLE_TABLES, ["bundle_id"])


def test_shapes_of_answers_read_alike(spark):
    lists = bundle([{"q": 3, "position": 1}, {"q": 4, "position": "2"}], {"1": 3, "2": 4}, orders=True)
    keyed = bundle({"3": 1, "4": "2"}, json.dumps({"1": 3, "2": 4}))
    single = bundle({"q": 3, "position": 1})
    t = flat(spark, [lists, keyed, single])
    assert rows(t["answers"], "bundle_id", "sheet_id", "q", "position") == [(0, 7, 3, 1), (0, 7, 4, 2), (1, 7, 3, 1), (1, 7, 4, 2), (2, 7, 3, 1)]
    assert rows(t["label_to_id"], "bundle_id", "label", "item_id") == [(0, 1, 3), (0, 2, 4), (1, 1, 3), (1, 2, 4)]
    assert rows(t["sheets"], "bundle_id", "order_no", "shuffle_seed") == [(0, 0, 1), (1, None, None), (2, None, None)]


def test_unreadable_null_and_empty(spark):
    t = flat(spark, ['{"cells": [', None, "", "[1]", '{"cells": null}', '{"cells": [{"sheets": null}, {}]}', bundle(None), bundle([])])
    assert t["answers"].count() == 0
    assert t["sheets"].count() == 2
    assert t["cells"].count() == 4
    assert flat(spark, [])["answers"].count() == 0


def test_nulls_and_odd_values_stay_or_turn_null(spark):
    t = flat(spark, [bundle([{"q": 1, "position": None}, {"q": 2}, {"q": None, "position": 3}, {"q": 5, "position": "x"}])])
    assert rows(t["answers"], "q", "position") == [(1, None), (2, None), (5, None), (None, 3)]


def test_clashing_and_extra_columns(spark):
    df = spark.createDataFrame([(1, bundle([{"q": 1, "position": 0}]), "x", 9)], "bundle_id long, payload string, model string, _record int")
    t = flatten_records(df, "payload", BUNDLE_TABLES, ["bundle_id"])
    assert rows(t["answers"], "bundle_id", "model", "q") == [(1, "m", 1)]


def test_deeper_spec_and_long_arrays(spark):
    spec = [Table("leaf", ((Level("a", index="i"), Level("b", {"v": ("v", "int")}, index="j")),))]
    payload = json.dumps({"a": [{"b": [{"v": k} for k in range(5000)]}, {"b": {"v": -1}}]})
    t = flatten_records(spark.createDataFrame([(payload,)], "p string"), "p", spec)["leaf"]
    assert t.count() == 5001
    assert rows(t.filter("i = 1"), "j", "v") == [(0, -1)]
