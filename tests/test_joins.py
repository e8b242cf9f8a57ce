import re

from tallyforge.operators import drift
from tallyforge.plans import report_queries


def broadcast_joins(df):
    """Keys of the planned joins that broadcast a side."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [re.sub(r"#\d+L?", "", k) for k in re.findall(r"BroadcastHashJoin \[(.*?)\]", plan)]


def test_exploded_sheets_are_not_broadcast(spark, data):
    assert broadcast_joins(report_queries.attribution_mappings(spark, data)) == ["q", "q"]  # the item bank


def test_no_join_over_drifting_files_broadcasts(spark, data, monkeypatch):
    seen, written = [], drift.written
    monkeypatch.setattr(drift, "written", lambda df: seen.append(df) or written(df))
    lines = spark.read.parquet(f"{data}/drift_lines.parquet")
    seen += [drift.changes(lines), drift.consistent(lines), drift.appearing(drift.readable(lines))]
    assert len(seen) > 10 and [k for df in seen for k in broadcast_joins(df)] == []
