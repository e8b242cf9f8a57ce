"""Queries of the two general record problems: nested bundles and drifting schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import drift, nested
from tallyforge.session import table


def _bundles(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return nested.flatten_records(table(spark, d, "run_bundles"), "payload", nested.BUNDLE_TABLES, ["bundle_id", "run"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    tables = {t.name: t for t in nested.BUNDLE_TABLES if t.name in ("answers", "label_to_id")}
    columns = {
        "answers": {"sheet_id": "r.sheet_id", "k": "cast(r.q as int)", "v": "r.position"},
        "label_to_id": {"sheet_id": "r.sheet_id", "k": "cast(r.label as int)", "v": "cast(r.item_id as int)"},
    }
    return nested.stacked(table(spark, d, "run_bundles"), "payload", tables, columns).dropna().select("sheet_id", "child", "k", "v").distinct()


def p1_sheets(spark: SparkSession, d: str) -> DataFrame:
    return _bundles(spark, d)["sheets"]


def p1_spans(spark: SparkSession, d: str) -> DataFrame:
    return _bundles(spark, d)["spans"]


def p1_cells(spark: SparkSession, d: str) -> DataFrame:
    return _bundles(spark, d)["cells"]


def p1_orders(spark: SparkSession, d: str) -> DataFrame:
    return _bundles(spark, d)["orders"]


def p1_problems(spark: SparkSession, d: str) -> DataFrame:
    return _bundles(spark, d)["problems"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "drift_lines"))


def p3_schema(spark: SparkSession, d: str) -> DataFrame:
    return drift.union_schema(drift.readable(table(spark, d, "drift_lines"))).select("path", F.concat_ws("|", "alternatives").alias("alternatives"), "n")


def p3_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return drift.appearing(drift.readable(table(spark, d, "drift_lines")))


def p3_table(spark: SparkSession, d: str) -> DataFrame:
    t = drift.consistent(table(spark, d, "drift_lines"))
    return t.select("line_id", "collector", "file_no", *[F.to_json(c).alias(c) for c in t.columns[3:]])


QUERIES = {f.__name__: f for f in (p1_found, p1_cells, p1_orders, p1_sheets, p1_problems, p1_spans, p3_found, p3_schema, p3_alternatives, p3_table)}

_AT = "unnest(range(1, CAST(json_array_length({0}, '$.{1}') AS BIGINT) + 1)) - 1 AS {2}"
_BUNDLES = f"""b AS (SELECT bundle_id, run, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM run_bundles),
  ci AS (SELECT *, {_AT.format('p', 'cells', 'cell_no')} FROM b WHERE json_type(p, '$.cells') = 'ARRAY'), c AS (SELECT bundle_id, run, cell_no, json_extract(p, '$.cells[' || cell_no || ']') AS c FROM ci),
  cc AS (SELECT bundle_id, run, c, CAST(cell_no AS INTEGER) AS cell_no, json_extract_string(c, '$.model') AS model, json_extract_string(c, '$.condition') AS condition, json_extract_string(c, '$.provider.served') AS provider FROM c),
  oi AS (SELECT *, {_AT.format('c', 'orders', 'order_no')} FROM cc WHERE json_type(c, '$.orders') = 'ARRAY'), oo AS (SELECT * EXCLUDE (order_no), CAST(order_no AS INTEGER) AS order_no, json_extract(c, '$.orders[' || order_no || ']') AS o FROM oi),
  od AS (SELECT *, CAST(json_extract_string(o, '$.shuffle_seed') AS BIGINT) AS shuffle_seed FROM oo),
  hs AS (SELECT bundle_id, run, cell_no, model, condition, provider, order_no, shuffle_seed, o AS h FROM od UNION ALL SELECT bundle_id, run, cell_no, model, condition, provider, NULL, NULL, c FROM cc),
  si AS (SELECT *, {_AT.format('h', 'sheets', 'sheet_no')} FROM hs WHERE json_type(h, '$.sheets') = 'ARRAY'), s AS (SELECT * EXCLUDE (h, sheet_no), CAST(sheet_no AS INTEGER) AS sheet_no, json_extract(h, '$.sheets[' || sheet_no || ']') AS s FROM si)"""
_KEYS = "bundle_id, run, cell_no, model, condition, provider"
_NUM = "CAST(json_extract_string(s, '$.{0}') AS {1}) AS {2}"

SQL = {
    "p1_cells": f"WITH {_BUNDLES} SELECT {_KEYS} FROM cc",
    "p1_orders": f"WITH {_BUNDLES} SELECT {_KEYS}, order_no, shuffle_seed FROM od",
    "p1_sheets": f"WITH {_BUNDLES} SELECT {_KEYS}, order_no, shuffle_seed, sheet_no, {_NUM.format('sheet_id', 'BIGINT', 'sheet_id')}, {_NUM.format('seed', 'BIGINT', 'seed')}, {_NUM.format('renumbered', 'BOOLEAN', 'renumbered')}, {_NUM.format('usage.tokens.in', 'INTEGER', 'tokens_in')}, {_NUM.format('usage.tokens.out', 'INTEGER', 'tokens_out')} FROM s",
    "p1_problems": f"WITH {_BUNDLES}, i AS (SELECT *, {_AT.format('s', 'problems', 'n')} FROM s WHERE json_type(s, '$.problems') = 'ARRAY') SELECT {_KEYS}, order_no, shuffle_seed, sheet_no, {_NUM.format('sheet_id', 'BIGINT', 'sheet_id')}, CAST(n AS INTEGER) AS problem_no, json_extract_string(s, '$.problems[' || n || '].kind') AS kind FROM i",
    "p1_found": """WITH b AS (SELECT CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM run_bundles), c AS (SELECT unnest(json_extract(p, '$.cells[*]')) AS c FROM b WHERE p IS NOT NULL), o AS (SELECT unnest(json_extract(c, '$.orders[*]')) AS o FROM c),
  s AS (SELECT unnest(json_extract(c, '$.sheets[*]')) AS s FROM c UNION ALL SELECT unnest(json_extract(o, '$.sheets[*]')) FROM o),
  f AS (SELECT CAST(json_extract(s, '$.sheet_id') AS BIGINT) AS sheet_id, CASE WHEN json_type(s, '$.answers') = 'VARCHAR' THEN json_extract_string(s, '$.answers')::JSON ELSE json_extract(s, '$.answers') END AS a, CASE WHEN json_type(s, '$.label_to_id') = 'VARCHAR' THEN json_extract_string(s, '$.label_to_id')::JSON ELSE json_extract(s, '$.label_to_id') END AS l FROM s),
  e AS (SELECT sheet_id, unnest(CASE WHEN json_type(a) = 'ARRAY' THEN json_extract(a, '$[*]') WHEN json_type(a) = 'OBJECT' AND list_contains(json_keys(a), 'q') THEN [a] ELSE [] END) AS e FROM f),
  m AS (SELECT sheet_id, a, unnest(json_keys(a)) AS k FROM f WHERE json_type(a) = 'OBJECT' AND NOT list_contains(json_keys(a), 'q')), n AS (SELECT sheet_id, l, unnest(json_keys(l)) AS k FROM f WHERE json_type(l) = 'OBJECT'),
  u AS (SELECT sheet_id, 'answers' AS child, CAST(json_extract_string(e, '$.q') AS INTEGER) AS k, CAST(json_extract_string(e, '$.position') AS INTEGER) AS v FROM e UNION ALL SELECT sheet_id, 'answers', CAST(k AS INTEGER), CAST(json_extract_string(a, '$."' || k || '"') AS INTEGER) FROM m
  UNION ALL SELECT sheet_id, 'label_to_id', CAST(k AS INTEGER), CAST(json_extract_string(l, '$."' || k || '"') AS INTEGER) FROM n) SELECT DISTINCT * FROM u WHERE k IS NOT NULL AND v IS NOT NULL""",
}
