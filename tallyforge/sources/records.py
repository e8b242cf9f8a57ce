"""Record sources and sinks: JSON lines with declared schemas, run catalogs, reports."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOT_RUNS = frozenset({"notes", "withdrawn"})


def read_jsonl(spark: SparkSession, paths: list[str], schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """Records of JSON-lines files under a declared schema, and the lines that are not JSON.

    Every record carries ``file_path`` and ``run`` (the name of the directory above its
    layout). Lines are split and parsed by the scan, so files of any size are read in
    parallel. Blank lines are neither records nor rejects. Rejects: (file_path, line).
    """
    declared = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType([*declared.fields, T.StructField("_corrupt", T.StringType())])
    raw = spark.read.option("recursiveFileLookup", "true").text(paths).select("value", F.col("_metadata.file_path").alias("file_path")).filter(F.trim("value") != "")
    parsed = raw.select("file_path", "value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    good = F.try_parse_json("value").isNotNull()
    run = F.regexp_extract("file_path", r"/([^/]+)/(?:(?:raw|scored[^/]*|aggregated)/)?[^/]+$", 1)
    method = F.regexp_extract("file_path", r"/(scored[^/]*)/[^/]+$", 1)
    kept = parsed.filter(good).select(*[F.col(f"r.{f.name}").alias(f.name) for f in declared.fields], "file_path", run.alias("run"), F.when(method != "", method).alias("method"))
    return kept, parsed.filter(~good).select("file_path", F.col("value").alias("line"))


def _entries(path: str) -> list[tuple[str, str, bool]]:
    """(name, path, is a directory) of what a directory holds, by name; none if it does not
    exist. Any file system the session knows (local, HDFS, object stores) will do."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        root = Path(path)
        return [(p.name, str(p), p.is_dir()) for p in sorted(root.iterdir())] if root.is_dir() else []
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        return []
    got = [(e.getPath().getName(), e.getPath().toString().removeprefix("file:"), e.isDirectory()) for e in fs.listStatus(where)]
    return sorted(got)


def _records_below(path: str) -> list[str]:
    return sorted(x for name, p, is_dir in _entries(path) for x in (_records_below(p) if is_dir else [p] * name.endswith(".jsonl")))


def layout_paths(run_dir: str) -> list[str]:
    """Record files of a run: those below ``raw``; only if there are none, its flat files."""
    return _records_below(f"{run_dir}/raw") or [p for name, p, is_dir in _entries(run_dir) if not is_dir and name.endswith(".jsonl")]


def catalog(roots: list[str]) -> dict[str, str]:
    """Run name to directory over all roots; a name in two roots is an error."""
    found: dict[str, str] = {}
    for root in roots:
        for name, p, is_dir in _entries(root):
            if is_dir and not name.startswith(("_", ".")) and name not in NOT_RUNS:
                if name in found:
                    raise ValueError(f"run {name} is in two roots: {found[name]} and {p}")
                found[name] = p
    return found


def resolve_run(roots: list[str], name: str) -> str:
    """The directory of a run; an unknown name is an error that lists what exists."""
    runs = catalog(roots)
    if name not in runs:
        raise LookupError(f"no run {name}; there are {', '.join(sorted(runs)) or 'none'}")
    return runs[name]


def current_runs(runs: list[str], repairs: dict[str, str]) -> list[str]:
    """Runs without those that a repaired run, if it is there, supersedes."""
    here = set(runs)
    gone = {base for base, repaired in repairs.items() if repaired in here}
    return sorted(here - gone)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV file with a header; a missing file is an empty table of the same schema."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, header=True, schema=schema)


def _single_file(df: DataFrame, path: str, write) -> None:
    """Write a report of one partition below ``path`` and make its one part file ``path``."""
    spark = df.sparkSession
    parts = f"{path}.parts"
    write(df, parts)
    new = spark._jvm.org.apache.hadoop.fs.Path
    fs = new(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(p for name, p, _ in _entries(parts) if name.startswith("part-"))
    fs.delete(new(path), True)
    fs.rename(new(part), new(path))
    fs.delete(new(parts), True)


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str] | None = None) -> None:
    """A report as one CSV file: columns in the order given, rows by ``order`` (nulls first; by
    all columns without one), line feeds only. An empty report is its header."""
    rows = df.select(*columns).repartition(1).sortWithinPartitions(*[F.asc_nulls_first(c) for c in order or columns])
    _single_file(rows, path, lambda d, p: d.write.mode("overwrite").option("lineSep", "\n").csv(p, header=True))


def write_json(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A report as one file of JSON lines with sorted keys, rows by ``order``; a report of one
    row is one JSON object."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    rows = df.repartition(1).sortWithinPartitions(*[F.asc_nulls_first(c) for c in order or sorted(df.columns)]).select(line.alias("value"))
    _single_file(rows, path, lambda d, p: d.write.mode("overwrite").option("lineSep", "\n").text(p))


def read_scalar(path: str, name: str) -> str | None:
    """A top-level scalar of a YAML-like file: plain, quoted, or folded over indented lines."""
    spark = SparkSession.getActiveSession()
    lines = Path(path).read_text(encoding="utf-8").split("\n") if spark is None else "".join(r[0] for r in spark.read.text(path, wholetext=True).collect()).split("\n")
    for i, line in enumerate(lines):
        m = re.match(rf"{re.escape(name)}:\s*(.*?)\s*$", line)
        if m and re.fullmatch(r"[>|][+-]?", m[1] or ">"):
            block = []
            for more in lines[i + 1 :]:
                if more.strip() and not more.startswith((" ", "\t")):
                    break
                block.append(more.strip())
            text = (" " if not m[1].startswith("|") else "\n").join(x for x in block if x)
            return text or None
        if m:
            return m[1][1:-1] if len(m[1]) > 1 and m[1][0] == m[1][-1] and m[1][0] in "'\"" else m[1]
    return None


def stata_to_parquet(spark: SparkSession, path: str, out: str, rows: int = 100_000) -> DataFrame:
    """Convert a Stata file to parquet, ``rows`` at a time, and read that. (The format is not
    splittable, so it is read once and in order.)"""
    import pandas as pd

    with pd.read_stata(path, chunksize=rows, convert_categoricals=False) as chunks:
        for i, c in enumerate(chunks):
            spark.createDataFrame(c).write.mode("overwrite" if i == 0 else "append").parquet(out)
    return spark.read.parquet(out)


def write_by_model(df: DataFrame, path: str, model: str = "model") -> None:
    """JSON lines, one directory per model (its name sanitised)."""
    name = F.regexp_replace(F.col(model), "[^A-Za-z0-9.-]", "_")
    df.withColumn("model_file", name).write.mode("overwrite").partitionBy("model_file").json(path)


def _walk(kind: T.DataType, value: Column, clean) -> Column:
    """``value`` with ``clean`` applied to every string inside it, keys of maps aside."""
    if isinstance(kind, T.StringType):
        return clean(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _walk(kind.elementType, x, clean))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _walk(kind.valueType, x, clean))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_walk(f.dataType, value[f.name], clean).alias(f.name) for f in kind.fields]))
    return value


def redact(df: DataFrame, columns: list[str], patterns: list[str], mark: str = "[redacted]") -> tuple[DataFrame, DataFrame]:
    """Columns with every match of the patterns replaced in every string they hold, however
    deeply nested, and a tally (field, rows touched)."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    re.compile(joined)
    new = {c: _walk(df.schema[c].dataType, F.col(c), lambda x: F.regexp_replace(x, joined, mark)) for c in columns}
    same = lambda c: F.to_json(F.struct(F.col(c).alias("v"))).eqNullSafe(F.to_json(F.struct(new[c].alias("v"))))
    tally = df.agg(*[F.count_if(~same(c)).alias(c) for c in columns])
    return df.withColumns(new), tally.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("field", "rows"))


def markdown(df: DataFrame) -> str:
    """A report as a markdown table, streamed row by row."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.toLocalIterator())])
