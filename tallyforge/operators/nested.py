"""Deeply nested JSON records as related flat tables.

A table is reached by one or more routes through the record. Each route becomes nested
higher-order calls that hand ancestor keys and positions down; ``flatten`` joins the levels,
``concat`` the routes, and one ``inline`` emits the table's rows. All of it is one projection
on the JVM: no shuffle, no Python, and as many rows per task as its records hold.

A field may come in more than one shape (list, single object, object keyed by id, JSON text
in a string, null, absent); a level's ``kind`` says how to read them alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Level:
    """One step down: ``path`` below the parent, columns to carry, and the array's kind.

    kind ``list``: a list of objects, or one object. kind ``keyed``: a list of objects, one
    object that has the ``key`` field, or an object from key to ``value``. kind ``map``: an
    object from key to value. JSON text inside a string is read like what it holds.
    ``columns`` maps output names to (path, type); ``index`` names the position column.
    """

    path: str
    columns: dict[str, tuple[str, str]] = field(default_factory=dict)
    kind: str = "list"
    index: str | None = None
    key: str = "key"
    value: str = "value"

    def items(self, parent: str) -> str:
        got = f"try_variant_get({parent}, '$.{self.path}', 'variant')"
        text = f"try_parse_json(try_variant_get({parent}, '$.{self.path}', 'string'))"
        return f"coalesce({self._read(got)}, CASE WHEN try_variant_get({got}, '$', 'map<string,variant>') IS NULL THEN {self._read(text)} END, array())"

    def _read(self, v: str) -> str:
        elements = f"try_variant_get({v}, '$', 'array<variant>')"
        if self.kind == "list":
            one = f"CASE WHEN try_variant_get({v}, '$', 'map<string,variant>') IS NOT NULL THEN array({v}) END"
            return f"coalesce({elements}, {one})"
        entries = f"map_entries(try_variant_get({v}, '$', 'map<string,variant>'))"
        pairs = f"transform({entries}, e -> to_variant_object(named_struct('{self.key}', e.key, '{self.value}', e.value)))"
        if self.kind == "map":
            return pairs
        one = f"CASE WHEN try_variant_get({v}, '$.{self.key}', 'variant') IS NOT NULL THEN array({v}) END"
        return f"coalesce({elements}, {one}, {pairs})"


@dataclass(frozen=True)
class Table:
    """A target table: its name and the routes (sequences of levels) that lead to its rows."""

    name: str
    routes: tuple[tuple[Level, ...], ...]

    def columns(self) -> dict[str, str]:
        """Name and type of all columns, ancestors first, over all routes."""
        out: dict[str, str] = {}
        for route in self.routes:
            for level in route:
                if level.index:
                    out.setdefault(level.index, "int")
                for name, (_, kind) in level.columns.items():
                    out.setdefault(name, kind)
        return out

    def expression(self, root: str) -> str:
        return "concat(" + ", ".join(self._route(r, 0, root, {}) for r in self.routes) + ")"

    def _route(self, route: tuple[Level, ...], depth: int, parent: str, carried: dict[str, str]) -> str:
        level, x, i = route[depth], f"x{depth}", f"i{depth}"
        own = dict(carried)
        if level.index:
            own[level.index] = i
        for name, (path, kind) in level.columns.items():
            own[name] = f"try_variant_get({x}, '$.{path}', '{kind}')"
        if depth + 1 < len(route):
            return f"flatten(transform({level.items(parent)}, ({x}, {i}) -> {self._route(route, depth + 1, x, own)}))"
        struct = ", ".join(f"'{n}', CAST({own.get(n, 'NULL')} AS {t})" for n, t in self.columns().items())
        return f"transform({level.items(parent)}, ({x}, {i}) -> named_struct({struct}))"


def flatten_records(df: DataFrame, payload: str, tables: list[Table], keep: list[str] = ()) -> dict[str, DataFrame]:
    """The flat tables of JSON text column ``payload``, each row with the ``keep`` columns.

    A payload that is null, empty or not JSON gives no rows in any table; a field of a shape
    that its level does not know gives none below it, and a value that does not fit its
    column's type is null. Records stored twice give their rows twice.
    """
    parsed = df.select(*[F.col(f"`{c}`") for c in keep], F.try_parse_json(F.col(f"`{payload}`")).alias("_record")).filter("_record is not null")
    names = [f"`{c}`" for c in keep]
    return {t.name: parsed.selectExpr(*names, f"inline({t.expression('_record')})") for t in tables}


def stacked(df: DataFrame, payload: str, tables: dict[str, Table], columns: dict[str, dict[str, str]]) -> DataFrame:
    """Rows of several tables under common ``columns`` (table name to output column to
    expression over the table's row ``r``), with the table's name as ``child``: one parse of
    each payload and one ``inline`` for all of them."""
    parsed = df.select(F.try_parse_json(F.col(f"`{payload}`")).alias("_record")).filter("_record is not null")
    parts = []
    for name, t in tables.items():
        fields = ", ".join(f"'{c}', {e}" for c, e in columns[name].items())
        parts.append(f"transform({t.expression('_record')}, r -> named_struct('child', '{name}', {fields}))")
    return parsed.selectExpr(f"inline(concat({', '.join(parts)}))")


_CELL = Level("cells", {"model": ("model", "string"), "condition": ("condition", "string"), "provider": ("provider.served", "string")}, index="cell_no")
_ORDER = Level("orders", {"shuffle_seed": ("shuffle_seed", "bigint")}, index="order_no")
_SHEET = Level("sheets", {"sheet_id": ("sheet_id", "bigint"), "seed": ("seed", "bigint"), "renumbered": ("renumbered", "boolean"),
                          "tokens_in": ("usage.tokens.in", "int"), "tokens_out": ("usage.tokens.out", "int")}, index="sheet_no")
_SHEET_KEY = Level("sheets", {"sheet_id": ("sheet_id", "bigint")}, index="sheet_no")
_ANSWER = Level("answers", {"q": ("q", "bigint"), "position": ("position", "int"), "printed_label": ("printed_label", "int")}, "keyed", "answer_no", "q", "position")
_LABEL = Level("label_to_id", {"label": ("label", "bigint"), "item_id": ("item_id", "bigint")}, "map", None, "label", "item_id")
_PROBLEM = Level("problems", {"kind": ("kind", "string")}, "list", "problem_no")
_SPAN = Level("trace.spans", {"start": ("from", "int"), "stop": ("to", "int")}, "list", "span_no")


def _both(sheet: Level, *below: Level) -> tuple[tuple[Level, ...], ...]:
    return ((_CELL, _ORDER, sheet, *below), (_CELL, sheet, *below))


BUNDLE_TABLES = [
    Table("cells", ((_CELL,),)),
    Table("orders", ((_CELL, _ORDER),)),
    Table("sheets", _both(_SHEET)),
    Table("answers", _both(_SHEET_KEY, _ANSWER)),
    Table("label_to_id", _both(_SHEET_KEY, _LABEL)),
    Table("problems", _both(_SHEET_KEY, _PROBLEM)),
    Table("spans", _both(_SHEET_KEY, _ANSWER, _SPAN)),
]
"""Run bundles: cells, orders below some, sheets, and what a sheet holds."""
