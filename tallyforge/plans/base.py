"""Registration of queries with their SQL, and SQL pieces that several share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.session import table

FIRST = "list_filter(answers, lambda a, i: list_position(list_transform(answers, lambda x: x.q), a.q) = i)"
ANS = f"""ans AS (SELECT sheet_id, run_no, seed, channel, model, condition, template, temperature, shuffle_seed, a.q AS q, a.position AS position
  FROM (SELECT *, unnest({FIRST}) AS a FROM sheets WHERE valid) WHERE a.q IS NOT NULL AND a.position IS NOT NULL)"""
JUDGED = """judged AS (SELECT record_id, model, condition, question_id, topic, j.judge AS judge, j.score AS score
  FROM (SELECT *, unnest(score_classifier_judges) AS j FROM scored) WHERE j.score IS NOT NULL AND j.error IS NULL)"""


class Registry:
    """Queries of a module, and SQL for those that have it."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def take(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return take


def modal_sql(key: str) -> str:
    """Modal position of each item by ``key`` from ``ans``: most frequent, then lowest."""
    return f"""SELECT {key}, q, position AS modal, total AS n FROM (SELECT {key}, q, position, n, sum(n) OVER (PARTITION BY {key}, q)::BIGINT AS total,
      row_number() OVER (PARTITION BY {key}, q ORDER BY n DESC, position) AS r FROM (SELECT {key}, q, position, count(*) AS n FROM ans GROUP BY {key}, q, position)) WHERE r = 1"""


def distance_sql(cells: str, hold: list[str], factor: str, value: str = "modal") -> str:
    on = " AND ".join(f"x.{h} IS NOT DISTINCT FROM y.{h}" if h == "" else f"x.{h} = y.{h}" for h in [*hold, "q"])
    keys = "".join(f"x.{h} AS {h}, " for h in hold)
    group = "".join(f"x.{h}, " for h in hold)
    return f"""SELECT {keys}x.{factor} AS a, y.{factor} AS b, count(*) AS shared, count(*) FILTER (WHERE (x.{value} >= 2) <> (y.{value} >= 2)) AS side_flips,
      abs(count(*) FILTER (WHERE x.{value} NOT IN (0, 3) AND y.{value} IN (0, 3)) - count(*) FILTER (WHERE x.{value} IN (0, 3) AND y.{value} NOT IN (0, 3))) AS endpoint_delta
      FROM {cells} x JOIN {cells} y ON {on} AND x.{factor} < y.{factor} GROUP BY {group}x.{factor}, y.{factor}"""


def floor_sql(pairs: str, name: str) -> str:
    parts = []
    for c in ("side_flips", "endpoint_delta"):
        parts.append(f"CAST(floor(median({c}) + 0.5) AS INTEGER) AS {c}_median, CASE WHEN count(*) >= 10 THEN list_sort(list({c}))[floor(0.9 * count(*))::INT] ELSE max({c}) END AS {c}_p90, max({c}) AS {c}_max")
    return f"SELECT '{name}' AS floor, count(*) AS n, {', '.join(parts)} FROM {pairs}"


__all__ = ["ANS", "FIRST", "JUDGED", "Registry", "distance_sql", "floor_sql", "modal_sql", "table"]
