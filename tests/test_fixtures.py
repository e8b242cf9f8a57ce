"""Queries that the test tables leave without rows, on literal tables that give some."""

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallyforge.operators import scored as C
from tallyforge.operators import sheets as S
from tallyforge.plans import registry

SCHEMA = """sheet_id long, model string, channel string, condition string, template string, temperature double, shuffle_seed int, run_no int, seed long, valid boolean,
  n_items int, answers array<struct<q int, position int, printed_label int>>"""


def sheet(i, template, positions, condition="A"):
    return (i, "v/m-1", "hosted", condition, template, 0.7, 3, i, 100 + i, True, 4, [(q + 1, p, None) for q, p in enumerate(positions)])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sheets"))
    data = [sheet(i, "T01", [3, 3, 0, 0]) for i in range(4)] + [sheet(10 + i, "T02", [0, 0, 3, 3 if i else 0]) for i in range(4)] + [sheet(20, "T03", [2, 2, 2, 2]), sheet(21, "T03", [2, 2, 2, 1])]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{d}/sheets.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW sheets AS SELECT * FROM '{d}/sheets.parquet/*.parquet'")
    return d, con


@pytest.mark.parametrize(("name", "least"), [("degenerate_sheets", 1), ("elicitation_format", 3), ("replicate_floor", 1)])
def test_rows_and_twins(spark, tables, name, least):
    d, con = tables
    df = registry.queries()[name](spark, d)
    order = sorted(df.columns)
    cur = con.execute(registry.oracle_sql()[name])
    at = [[c[0] for c in cur.description].index(c) for c in order]
    got = sorted([tuple(r[c] for c in order) for r in df.collect()], key=str)
    assert len(got) >= least and [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in sorted([tuple(r[i] for i in at) for r in cur.fetchall()], key=str)]


def test_packed_replicates_equal_the_joined_ones(spark, tables):
    ans = S.answers(spark.read.parquet(f"{tables[0]}/sheets.parquet"))
    joined = S.distances(ans, ["model", "template"], "sheet_id", "position").groupBy("model", "template", "side_flips", "endpoint_delta").agg(F.count("*").alias("n"))
    assert rows(S.replicate_distances(ans, ["model", "template"])) == rows(joined)


def test_closed_population(spark):
    df, known = spark.createDataFrame([("a",), ("b",)], "m string"), spark.createDataFrame([("a",)], "v string")
    assert C.assert_closed(df.filter("m = 'a'"), "m", known, "unknown model").count() == 1
    with pytest.raises(Exception, match="unknown model"):
        C.assert_closed(df, "m", known, "unknown model").collect()


def test_methods_are_a_registry(spark):
    df = spark.createDataFrame([(1, [("a", 1, None), ("b", 4, None), ("c", 9, "bad")], 2.0), (2, [], None)], "id int, score_classifier_judges array<struct<judge string, score int, error string>>, score_classifier double")
    assert rows(C.method_scores(df, ["id"]), "id", "method", "score") == [(1, "highest", 4.0), (1, "lowest", 1.0), (1, "panel", 2.5), (1, "stored", 2.0)]
