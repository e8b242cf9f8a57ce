"""Schemas that drift between files: one consistent table, and every change.

Tagged-union inference: the records of each file are read side by side; every path keeps all
the types it was seen with. A field of several types gets one typed branch per type and a
canonical value. Between a collector's consecutive files, alternatives that appear, vanish or
take another's content under a new name are reported.

Every statistic is a count per (collector, file, field, type, hash of content), summed per
task before it is shuffled. Contents are compared by a join on those hashes, for the fields
that vanished or are new only.

No join broadcasts a side: all follow the data, and tables written to parquet in between take
a small part there of what they take in memory, so the threshold would let too much pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import written

PRESENT = 0.2  # a file has a field if this share of its readable records hold it non-null
SAME = {"string": 0.3, "number": 0.4, "boolean": 0.6, "object": 0.5, "array": 0.5}
"""Least overlap of content, by type, for a vanished field to go on under a new name."""

_TYPE = """CASE WHEN s = 'VOID' THEN NULL WHEN s = 'BOOLEAN' THEN 'boolean' WHEN s = 'STRING' THEN 'string'
  WHEN s LIKE 'OBJECT<%' THEN 'object' WHEN s LIKE 'ARRAY<%' THEN 'array' ELSE 'number' END"""


def _objects(lines: DataFrame, payload: str = "payload", collector: str = "collector", file_no: str = "file_no", **more: str) -> DataFrame:
    """(collector, file_no, text, and ``more`` by its names): the lines that begin as JSON objects."""
    names = {"collector": collector, "file_no": file_no, "text": payload} | more
    return lines.filter(F.ltrim(F.col(f"`{payload}`"), F.lit(" \t\r\n")).startswith("{")).select(*[F.col(f"`{v}`").alias(k) for k, v in names.items()])


def _parsed(objects: DataFrame) -> DataFrame:
    """``objects`` with ``record`` for ``text``, those that can be parsed."""
    return objects.withColumn("record", F.try_parse_json("text")).drop("text").filter("record is not null")


def readable(lines: DataFrame, **names: str) -> DataFrame:
    """(collector, file_no, record): the lines that are JSON objects."""
    return _parsed(_objects(lines, **names)).filter("collector is not null and file_no is not null")


def _fields(records: DataFrame, *more: str) -> DataFrame:
    """(collector, file_no, *more, pos, field, s, type, value): the top-level fields of each
    record; one row without a field for a record that has none. Nulls have no type."""
    each = records.sparkSession.tvf.variant_explode_outer(F.col("record").outer()).alias("e")
    flat = records.lateralJoin(each).select("collector", "file_no", *more, "e.pos", F.col("e.key").alias("field"), "e.value")
    return flat.withColumn("s", F.schema_of_variant("value")).withColumn("type", F.expr(_TYPE))


def alternatives(records: DataFrame, depth: int | None = None) -> DataFrame:
    """(collector, file_no, path, type, n): how often each path holds each type in each file.

    Paths go into objects (``a.b``) and arrays (``a[]``), to ``depth`` levels or, without one,
    as deep as any record does: a level is counted and its nested values are written before
    the next, and the descent ends when none are left. Nulls are left out.
    """
    level = records.select("collector", "file_no", F.lit("").alias("path"), F.col("record").alias("value"))
    out = None
    while depth is None or depth > 0:
        each = records.sparkSession.tvf.variant_explode(F.col("value").outer()).alias("e")
        step = F.expr("concat(path, CASE WHEN e.key IS NULL THEN '[]' WHEN path = '' THEN e.key ELSE concat('.', e.key) END)")
        typed = level.lateralJoin(each).select("collector", "file_no", step.alias("path"), F.schema_of_variant("e.value").alias("s"), F.col("e.value").alias("value")).withColumn("type", F.expr(_TYPE))
        counts = typed.filter("type is not null").groupBy("collector", "file_no", "path", "type").agg(F.count("*").alias("n"))
        out = counts if out is None else out.unionByName(counts)
        nested = typed.filter("s LIKE 'OBJECT<_%' or s LIKE 'ARRAY<_%'").filter("s not in ('OBJECT<>', 'ARRAY<>')").select("collector", "file_no", "path", "value")
        if depth is not None:
            depth -= 1
            level = nested
            continue
        level = written(nested)
        if level.isEmpty():
            break
    return out


def union_schema(records: DataFrame, depth: int | None = None) -> DataFrame:
    """(path, alternatives, n): the fused schema; several alternatives form a tagged union."""
    counts = alternatives(records, depth).groupBy("path", "type").agg(F.sum("n").alias("n"))
    return counts.groupBy("path").agg(F.array_sort(F.collect_list("type")).alias("alternatives"), F.sum("n").alias("n"))


def appearing(records: DataFrame, depth: int | None = None) -> DataFrame:
    """(collector, path, type, file_no, kind, n): each alternative that appears after a
    collector's first file, where it does first; ``kind`` is ``path`` if the path is new with
    it, ``type`` if the path then gets a further type. ``n`` counts it over all files."""
    counts = alternatives(records, depth)
    first = counts.groupBy("collector", "path", "type").agg(F.min("file_no").alias("file_no"), F.sum("n").alias("n"))
    paths = first.groupBy("collector", "path").agg(F.min("file_no").alias("path_from"))
    start = first.groupBy("collector").agg(F.min("file_no").alias("start"))
    got = first.join(paths.hint("merge"), ["collector", "path"]).join(start.hint("merge"), "collector").filter("file_no > start")
    return got.select("collector", "path", "type", "file_no", F.when(F.col("file_no") == F.col("path_from"), "path").otherwise("type").alias("kind"), "n")


def _tokens() -> F.Column:
    """What a value's content looks like: tokens whose distribution outlives a renaming."""
    text = "try_variant_get(value, '$', 'string')"
    shape = f"regexp_replace(regexp_replace({text}, '[A-Za-z]+', 'a'), CASE WHEN left(ltrim({text}), 1) IN ('{{', '[') THEN '[0-9]+' ELSE '[0-9]' END, '9')"
    numbered = "regexp_replace(regexp_replace(s, '[0-9]+', '#'), '(`?#`?: [A-Z]+(, )?)+', '#*')"
    return F.expr(
        f"""CASE type WHEN 'string' THEN array(concat('v', {text}), concat('s', CASE WHEN {shape} RLIKE '[^a ]' THEN {shape} ELSE {text} END))
            WHEN 'number' THEN array(concat('v', cast(cast(log2(1 + abs(try_variant_get(value, '$', 'double'))) AS int) AS string)))
            WHEN 'boolean' THEN array(concat('v', {text}))
            ELSE array(concat('v', {numbered})) END"""
    )


def counted(fields: DataFrame) -> DataFrame:
    """(collector, file_no, field, type, n, records): values of each field and type, and
    the records that begin with them (whose sum over a file is its number of records)."""
    begins = F.count_if(F.coalesce("pos", F.lit(0)) == 0)
    return fields.groupBy("collector", "file_no", "field", "type").agg(F.count("*").alias("n"), begins.alias("records"))


def profiles(counts: DataFrame) -> DataFrame:
    """(collector, file_no, field, type, share, n): the fields that each file has.

    ``type`` is the most frequent of a field's types (the first by name on a tie), ``share``
    the share of readable records that hold the field, ``n`` its values of that type.
    """
    total = counts.groupBy("collector", "file_no").agg(F.sum("records").alias("records"))
    best = counts.filter("field is not null and type is not null").groupBy("collector", "file_no", "field").agg(
        F.sum("n").alias("held"), F.max_by(F.struct("type", "n"), F.struct("n", F.expr("-ascii(type) * 1000 - ascii(substr(type, 2, 1))"))).alias("b")
    )
    share = F.col("held") / F.col("records")
    return best.join(total.hint("merge"), ["collector", "file_no"]).filter(share >= PRESENT).select("collector", "file_no", "field", "b.type", share.alias("share"), "b.n")


def _overlaps(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """``pairs`` with ``overlap``, the share of like content of a vanished and a new field:
    of their values or their shapes, whichever is larger. Pairs without any are left out."""
    old = counts.select("collector", F.col("file_no").alias("before"), F.col("field").alias("f"), "type", "tag", "token", F.col("n").alias("was"))
    new = counts.select("collector", "file_no", F.col("field").alias("g"), "type", "tag", "token", F.col("n").alias("is"))
    by = [c for c in pairs.columns if c not in ("gone", "come")]
    both = pairs.join(old.hint("merge"), ["collector", "before", "f", "type"]).join(new.hint("merge"), ["collector", "file_no", "g", "type", "tag", "token"])
    shared = both.groupBy(*by, "tag").agg(F.sum(F.least(F.col("was") / F.col("gone.n"), F.col("is") / F.col("come.n"))).alias("overlap"), F.first("gone").alias("gone"), F.first("come").alias("come"))
    return shared.groupBy(*by).agg(F.max("overlap").alias("overlap"), F.first("gone").alias("gone"), F.first("come").alias("come"))


def changes(lines: DataFrame, **names: str) -> DataFrame:
    """(collector, file_no, field, change_kind, new_field) against the collector's file before.

    Kinds are added, removed, retyped and renamed. A vanished field was renamed if a new one
    of the same type has like content; each takes its best match if both prefer each other.
    Lines that are not JSON objects, null collectors and null file numbers do not count; a
    file without a readable record is passed over. A collector's first file has no changes.
    """
    p = written(profiles(written(counted(_fields(readable(lines, **names))))))  # a row per file and field, read three times below
    files = p.select("collector", "file_no").distinct().withColumn("before", F.lag("file_no").over(Window.partitionBy("collector").orderBy("file_no"))).filter("before is not null")
    cell = F.struct("type", "share", "n")
    now = files.join(p.hint("merge"), ["collector", "file_no"]).select("collector", "file_no", "before", "field", cell.alias("come"))
    old = files.join(p.withColumnRenamed("file_no", "before").hint("merge"), ["collector", "before"]).select("collector", "file_no", "before", "field", cell.alias("gone"))
    both = now.join(old, ["collector", "file_no", "before", "field"], "full")
    step = written(both.filter("come is null or gone is null or come.type <> gone.type"))
    gone = step.filter("come is null").select("collector", "file_no", "before", F.col("field").alias("f"), "gone")
    come = step.filter("gone is null").select("collector", "file_no", F.col("field").alias("g"), "come")
    least = F.expr("CASE gone.type " + " ".join(f"WHEN '{t}' THEN {v}" for t, v in SAME.items()) + " END")
    score = F.expr("overlap - 0.2 * abs(gone.share - come.share) - 0.01 * levenshtein(lower(f), lower(g)) / greatest(length(f), length(g))")
    pairs = written(gone.join(come.hint("merge"), ["collector", "file_no"]).filter("gone.type = come.type").withColumn("type", F.col("gone.type")))
    sides = F.explode(F.array(F.struct(F.col("before").alias("file_no"), F.col("f").alias("field")), F.struct("file_no", F.col("g").alias("field")))).alias("x")
    needed = pairs.select("collector", "type", sides).groupBy("collector", "x.file_no").agg(F.collect_set(F.struct("x.field", "type")).alias("needed"))
    # lines meet the fields they need as text: parsed or exploded, they would fill the shuffle
    fields = _fields(_parsed(_objects(lines, **names).join(needed.hint("shuffle_hash"), ["collector", "file_no"])), "needed")
    tokens = fields.filter(F.array_contains("needed", F.struct("field", "type"))).select("collector", "file_no", "field", "type", F.explode(_tokens()).alias("token"))
    counts = tokens.groupBy("collector", "file_no", "field", "type", F.substring("token", 1, 1).alias("tag"), F.xxhash64("token").alias("token")).agg(F.count("*").alias("n"))
    like = _overlaps(pairs, written(counts)).withColumn("score", score).filter((F.col("score") >= least - 0.05))
    rank = F.struct(-F.col("score"), "f", "g")
    first = like.withColumn("a", F.row_number().over(Window.partitionBy("collector", "file_no", "f").orderBy(rank))).withColumn("b", F.row_number().over(Window.partitionBy("collector", "file_no", "g").orderBy(rank)))
    renamed = first.filter("a = 1 and b = 1").select("collector", "file_no", "f", "g")
    plain = step.join(renamed.select("collector", "file_no", F.explode(F.array("f", "g")).alias("field")).hint("merge"), ["collector", "file_no", "field"], "left_anti")
    kind = F.when(F.col("gone").isNull(), "added").when(F.col("come").isNull(), "removed").otherwise("retyped")
    return plain.select("collector", "file_no", "field", kind.alias("change_kind"), F.col("field").alias("new_field")).unionByName(
        renamed.select("collector", "file_no", F.col("f").alias("field"), F.lit("renamed").alias("change_kind"), F.col("g").alias("new_field"))
    )


BRANCHES = {"string": "string", "number": "double", "boolean": "boolean", "object": "string", "array": "string"}
"""Types of a tagged union and what their branch holds; objects and arrays are JSON text."""


def consistent(lines: DataFrame, line_id: str = "line_id", payload: str = "payload", collector: str = "collector", file_no: str = "file_no") -> DataFrame:
    """Every readable line in one table: (line_id, collector, file_no, fields, strings,
    numbers, booleans, objects, arrays).

    ``fields`` maps a field's first name in its collector to its canonical value, which is
    text. The typed branches hold the value once more under its type: ``numbers`` as double,
    ``booleans`` as boolean, the others as text; a conflict between types thus splits into
    branches and never loses a value. Names follow the renamings that :func:`changes` finds; a
    name none applies to stays. Where a record holds a field under its old and its new name,
    the later in the record counts.
    """
    names = {"payload": payload, "collector": collector, "file_no": file_no}
    steps = changes(lines, **names).filter("change_kind = 'renamed'")
    steps = written(steps.groupBy("collector").agg(F.array_sort(F.collect_list(F.struct("file_no", "field", "new_field"))).alias("steps")))
    src = _parsed(_objects(lines, **names, line_id=line_id).join(steps.hint("merge"), "collector", "left"))
    # the renamings up to a line's file, newest first; none for most lines, which then skip all of this
    src = src.withColumn("past", F.expr("CASE WHEN steps IS NOT NULL THEN reverse(filter(steps, s -> s.file_no <= file_no)) END"))
    origin = "CASE WHEN past IS NULL THEN e.key ELSE aggregate(past, e.key, (n, s) -> CASE WHEN s.new_field = n THEN s.field ELSE n END) END"
    entries = f"transform(map_entries(try_variant_get(record, '$', 'map<string,variant>')), e -> named_struct('name', {origin}, 's', schema_of_variant(e.value), 'value', e.value))"
    held = src.select("line_id", "collector", "file_no", "past", F.expr(entries).alias("e"))
    held = held.withColumn("e", F.expr("filter(e, x -> x.s <> 'VOID')"))
    held = held.withColumn("e", F.expr("CASE WHEN past IS NULL THEN e ELSE filter(e, (x, i) -> NOT exists(slice(e, i + 2, size(e)), y -> y.name = x.name)) END"))
    kind = {"string": "x.s = 'STRING'", "boolean": "x.s = 'BOOLEAN'", "object": "x.s LIKE 'OBJECT<%'", "array": "x.s LIKE 'ARRAY<%'"}
    kind["number"] = "NOT (" + " OR ".join(kind.values()) + ")"
    branch = lambda t: F.expr(f"map_from_entries(transform(filter(e, x -> {kind[t]}), x -> struct(x.name, try_variant_get(x.value, '$', '{BRANCHES[t]}'))))")
    fields = F.expr("map_from_entries(transform(e, x -> struct(x.name, try_variant_get(x.value, '$', 'string'))))")
    return held.select("line_id", "collector", "file_no", fields.alias("fields"), *[branch(t).alias(f"{t}s") for t in BRANCHES])
