import json

from conftest import rows
from tallyforge.operators import drift


def lines(spark, files, schema="collector string, file_no int, payload string, line_id long"):
    out, n = [], 0
    for (c, no), records in files.items():
        for r in records:
            n += 1
            out.append((c, no, r if r is None or isinstance(r, str) else json.dumps(r), n))
    return spark.createDataFrame(out, schema)


BASE = [{"schema": "battery-run/1", "failure_mode": ["refused", "other", None][i % 3], "flag": i % 2 == 0, "n": i, "at": f"2026-01-{i + 1:02d}T00:00:00Z"} for i in range(12)]


def moved(old, new):
    return [{new if k == old else k: v for k, v in r.items()} for r in BASE]


def test_each_kind_of_change(spark):
    files = {
        ("c", 1): BASE,
        ("c", 3): moved("failure_mode", "fail_kind"),
        ("c", 4): [r | {"n": str(r["n"])} for r in moved("failure_mode", "fail_kind")],
        ("c", 5): [{k: v for k, v in r.items() if k != "schema"} | {"extra": {"a": 1}} for r in BASE],
        ("d", 5): BASE,
    }
    got = rows(drift.changes(lines(spark, files)), "collector", "file_no", "field", "change_kind", "new_field")
    assert got == [
        ("c", 3, "failure_mode", "renamed", "fail_kind"),
        ("c", 4, "n", "retyped", "n"),
        ("c", 5, "extra", "added", "extra"),
        ("c", 5, "fail_kind", "renamed", "failure_mode"),
        ("c", 5, "n", "retyped", "n"),
        ("c", 5, "schema", "removed", "schema"),
    ]


def test_unlike_content_is_no_renaming(spark):
    other = [{k: v for k, v in r.items() if k != "failure_mode"} | {"provider": f"host-{i}"} for i, r in enumerate(BASE)]
    got = rows(drift.changes(lines(spark, {("c", 1): BASE, ("c", 2): other})), "field", "change_kind")
    assert got == [("failure_mode", "removed"), ("provider", "added")]


def test_sparse_stray_and_broken(spark):
    stray = [r | ({"tmp": 1} if i < 2 else {}) for i, r in enumerate(BASE)]
    odd = [r | ({"flag": "yes"} if i == 0 else {}) for i, r in enumerate(stray)]
    files = {("c", 1): BASE, ("c", 2): [*odd, "{broken", None, "", "[1]", "3"], ("c", 3): ["{broken"], ("c", 4): BASE}
    assert drift.changes(lines(spark, files)).count() == 0
    assert drift.changes(lines(spark, {}, "collector string, file_no int, payload string, line_id long")).count() == 0


def test_union_schema_and_consistent_table(spark):
    files = {("c", 1): [{"a": 1, "b": {"x": [1, "s"]}}], ("c", 2): [{"a": "1", "b": None}]}
    u = rows(drift.union_schema(drift.readable(lines(spark, files))), "path", "alternatives")
    assert ("a", ["number", "string"]) in u and ("b.x[]", ["number", "string"]) in u
    files = {("c", 1): BASE, ("c", 2): moved("failure_mode", "fail_kind")}
    t = drift.consistent(lines(spark, files)).filter("file_no = 2").collect()
    assert {r.fields.get("failure_mode") for r in t} == {"refused", "other", None}
    assert all("fail_kind" not in r.fields for r in t)
    assert t[0].numbers["n"] is not None and t[0].strings["schema"] == "battery-run/1"
    assert set(t[0].booleans) == {"flag"} and t[0].objects == t[0].arrays == {}


def test_unlike_content_of_long_files_is_no_renaming(spark):
    old = [{"schema": "battery-run/1", "note": f"left{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}"} for i in range(400)]
    new = [{"schema": "battery-run/1", "host": r["note"].replace("left", "other")} for r in old]
    got = rows(drift.changes(lines(spark, {("c", 1): old, ("c", 2): new})), "field", "change_kind")
    assert got == [("host", "added"), ("note", "removed")]
    kept = [{"schema": r["schema"], "remark": r["note"]} for r in old]
    assert rows(drift.changes(lines(spark, {("c", 1): old, ("c", 2): kept})), "field", "change_kind", "new_field") == [("note", "renamed", "remark")]


def test_the_registered_table_keeps_every_field(spark, tmp_path):
    from tallyforge.plans import records

    lines(spark, {("c", 1): BASE, ("c", 2): [r | {"later": r["n"]} for r in BASE]}).write.parquet(f"{tmp_path}/drift_lines.parquet")
    got = records.p3_table(spark, str(tmp_path)).filter("line_id = 13").collect()[0]
    assert set(json.loads(got.fields)) == {"schema", "failure_mode", "flag", "n", "at", "later"}
    assert set(json.loads(got.numbers)) == {"n", "later"} and {"at", "schema"} <= set(json.loads(got.strings)) and set(json.loads(got.booleans)) == {"flag"}


def test_conflicts_split_into_typed_branches_and_old_names_merge(spark):
    files = {("c", 1): BASE, ("c", 2): [r | {"n": "x"} for r in moved("failure_mode", "fail_kind")], ("c", 3): [moved("failure_mode", "fail_kind")[0] | {"failure_mode": "late", "n": {"a": [1]}}]}
    t = {r.line_id: r for r in drift.consistent(lines(spark, files)).collect()}
    assert t[1].numbers["n"] == 0.0 and t[13].strings["n"] == "x" and json.loads(t[25].objects["n"]) == {"a": [1]}
    assert t[25].fields["failure_mode"] == "late" and json.loads(t[25].fields["n"]) == {"a": [1]}


def test_alternatives_that_appear_at_any_depth(spark):
    deep = lambda x: {"a": {"b": [{"c": {"d": [{"e": x}]}}]}}
    files = {("c", 1): [deep(1)], ("c", 2): [deep("s"), {"z": None}], ("c", 3): [deep("s"), {"z": True}], ("d", 1): [{"q": 1}]}
    got = rows(drift.appearing(drift.readable(lines(spark, files))), "collector", "path", "type", "file_no", "kind", "n")
    assert got == [("c", "a.b[].c.d[].e", "string", 2, "type", 2), ("c", "z", "boolean", 3, "path", 1)]
    assert drift.appearing(drift.readable(lines(spark, {}))).count() == 0
