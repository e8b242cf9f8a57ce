import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from tallyforge.sources import records as R
from tallyforge.streaming import ingest


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def test_jsonl_scan_and_rejects(spark, tmp_path):
    write(tmp_path / "2026-01-a/raw/x.jsonl", ['{"id": 1, "v": "é"}', "", "{broken", '{"id": 2}'])
    write(tmp_path / "2026-01-b/scored_two/y.jsonl", ['{"id": 3, "v": null, "extra": 1}'])
    good, bad = R.read_jsonl(spark, [str(tmp_path)], "id int, v string")
    assert rows(good, "id", "v", "run", "method") == [(1, "é", "2026-01-a", None), (2, None, "2026-01-a", None), (3, None, "2026-01-b", "scored_two")]
    assert rows(bad, "line") == [("{broken",)]


def test_layouts_and_catalog(tmp_path):
    write(tmp_path / "runs/one/raw/a/x.jsonl", ["{}"])
    write(tmp_path / "runs/one/flat.jsonl", ["{}"])
    write(tmp_path / "data/two/flat.jsonl", ["{}"])
    (tmp_path / "data/_skip").mkdir()
    roots = [str(tmp_path / "runs"), str(tmp_path / "data")]
    assert [p.rsplit("/", 1)[1] for p in R.layout_paths(f"{tmp_path}/runs/one")] == ["x.jsonl"]
    assert [p.rsplit("/", 1)[1] for p in R.layout_paths(f"{tmp_path}/data/two")] == ["flat.jsonl"]
    assert sorted(R.catalog(roots)) == ["one", "two"]
    with pytest.raises(LookupError, match="one, two"):
        R.resolve_run(roots, "three")
    (tmp_path / "data/one").mkdir()
    with pytest.raises(ValueError, match="two roots"):
        R.catalog(roots)
    assert R.current_runs(["a", "a-fixed", "b"], {"a": "a-fixed", "b": "b-fixed"}) == ["a-fixed", "b"]


def test_csv_and_json_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("x/1", 1), ("y", 2)], "model string, n int")
    R.write_csv(df.repartition(4), f"{tmp_path}/c.csv", ["n", "model"])
    assert (tmp_path / "c.csv").read_bytes() == b"n,model\n1,x/1\n2,y\n"
    assert rows(R.read_csv(spark, f"{tmp_path}/c.csv", "n int, model string"), "n", "model") == [(1, "x/1"), (2, "y")]
    R.write_csv(df.limit(0), f"{tmp_path}/e.csv", ["n", "model"])
    assert (tmp_path / "e.csv").read_text().strip() in ("n,model", "")
    R.write_json(df.filter("n = 1"), f"{tmp_path}/r.json")
    assert (tmp_path / "r.json").read_text() == '{"model":"x/1","n":1}\n'
    assert R.read_csv(spark, f"{tmp_path}/none", "n int").count() == 0
    R.write_by_model(df, f"{tmp_path}/m")
    assert rows(spark.read.json(f"{tmp_path}/m"), "model", "model_file") == [("x/1", "x_1"), ("y", "y")]
    assert R.markdown(df.filter("n = 2")).endswith("| y | 2 |")


def test_redaction(spark):
    df = spark.createDataFrame([("key sk-123 here", "ok"), (None, "sk-9")], "a string, b string")
    out, tally = R.redact(df, ["a", "b"], [r"sk-[0-9]+"])
    assert rows(out) == [("key [redacted] here", "ok"), (None, "[redacted]")]
    assert rows(tally) == [("a", 1), ("b", 1)]
    deep = spark.createDataFrame([(1, [{"k": "sk-1", "m": {"x": "sk-2", "y": "z"}}]), (2, None)], "id int, v array<struct<k string, m map<string, string>>>")
    out, tally = R.redact(deep, ["v"], [r"sk-[0-9]+"])
    assert out.filter("id = 1").first().v[0].asDict() == {"k": "[redacted]", "m": {"x": "[redacted]", "y": "z"}}
    assert out.filter("id = 2").first().v is None and rows(tally) == [("v", 1)]


def test_scalars_and_stata(spark, tmp_path):
    import pandas as pd

    (tmp_path / "c.cff").write_text("title: 'A title'\nabstract: >-\n  One line\n  and one more.\nversion: 2\n")
    got = [R.read_scalar(str(tmp_path / "c.cff"), k) for k in ("title", "abstract", "version", "none")]
    assert got == ["A title", "One line and one more.", "2", None]
    pd.DataFrame({"a": [1, 2, 3], "b": ["x", "y", "z"]}).to_stata(tmp_path / "s.dta", write_index=False)
    assert rows(R.stata_to_parquet(spark, str(tmp_path / "s.dta"), f"{tmp_path}/s", rows=2), "a", "b") == [(1, "x"), (2, "y"), (3, "z")]


def test_stream_drops_redeliveries(spark, tmp_path):
    schema = T.StructType().add("id", T.IntegerType()).add("at", T.TimestampType())
    lines = [json.dumps({"id": i % 3, "at": f"2026-01-01T0{i}:10:00Z"}) for i in range(6)]
    write(tmp_path / "in/a.jsonl", lines)
    stream = ingest.record_stream(spark, str(tmp_path / "in"), schema, ["id"], "at")
    q = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen").count() == 3
    counts = ingest.windowed_counts(spark.readStream.schema(schema).json(str(tmp_path / "in")), "at", ["id"])
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 6
    assert rows(ingest.touched_cells(spark.table("seen"), ["id"])) == [(0,), (1,), (2,)]
