"""Duplicates hidden by formatting: same letters and digits, letter case aside.

Method: each text streams through a skip-and-fold lookup table into two rolling polynomial
hashes (kernels.fold_hashes); no canonical string is made. Hashes are grouped with map-side
combining, and every further member of a group is compared with the group's first row by
two skipping pointers (kernels.same_folded) before it counts as a copy.

A group of copies may hold any share of the rows: only (key, hash, id) triples are grouped,
as partial minima and counts; members of a large group find their first row, and are compared
with it, under a salt, the first row being repeated per salt. Rows that collide on all hashes
but differ are grouped once more by a third hash, which is not polynomial.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import kernels
from tallyforge.session import prepare, written

SALT_ABOVE = 10_000
SALTS = 32


def _hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h1, h2, n = kernels.fold_hashes(b.column(2))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n)],
            names=["id", "k", "h1", "h2", "n"],
        )


def _leaves(value: object, path: str) -> Iterator[tuple[str, object]]:
    """(path, scalar) of every leaf; empty containers and nulls are leaves too."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from _leaves(v, f"{path}.{json.dumps(k)}")
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from _leaves(v, f"{path}[{i}]")
    else:
        yield path, value


def _scalar(v: object) -> str:
    """A value other than a string, as text that is equal for equal values only."""
    if isinstance(v, bool) or v is None or isinstance(v, (dict, list)):
        return json.dumps(v)
    if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
        v = int(v)
    return repr(v)


def _parse(payload: str | None) -> dict | None:
    try:
        got = json.loads(payload) if payload is not None else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def _hash_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, keys, other, texts, text_at = [], [], [], [], []
        ok = np.zeros(b.num_rows, bool)
        for i, payload in enumerate(b.column(2).to_pylist()):
            record = _parse(payload)
            if record is None:
                continue
            ok[i] = True
            for path, v in _leaves(record, ""):
                if isinstance(v, str):
                    text_at.append(len(rows))
                    texts.append(v)
                    other.append(1)
                else:
                    other.append(xxhash.xxh3_64_intdigest(_scalar(v)))
                rows.append(i)
                keys.append(xxhash.xxh3_64_intdigest(path))
        h = [np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)]
        if rows:
            k, o = np.array(keys, np.uint64), np.array(other, np.uint64)
            folded = kernels.fold_hashes(pa.array(texts, pa.string()))
            for j in (0, 1):
                v = kernels.mix64(o + np.uint64(j))
                if texts:
                    v[text_at] = folded[j] + np.uint64(0xABCDEF)
                np.add.at(h[j], rows, kernels.mix64(kernels.mix64(k + np.uint64(7 * j)) + v))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), pa.array(ok.astype(np.int64))],
            names=["id", "k", "h1", "h2", "n"],
        )


def same_record(a: str | None, b: str | None) -> bool:
    """Whether two JSON objects hold the same fields with the same values, in any order,
    strings compared by letters and digits."""
    x, y = _parse(a), _parse(b)
    if x is None or y is None:
        return False
    p, q = dict(_leaves(x, "")), dict(_leaves(y, ""))
    if p.keys() != q.keys():
        return False
    for k, v in p.items():
        w = q[k]
        if isinstance(v, str) != isinstance(w, str):
            return False
        if not (kernels.same_folded(v, w) if isinstance(v, str) else _scalar(v) == _scalar(w)):
            return False
    return True


def record_digest(payload: str | None) -> int:
    """A third hash of a JSON object, of its paths and folded values in the order of the paths."""
    h = xxhash.xxh3_64()
    for path, v in sorted(_leaves(_parse(payload) or {}, ""), key=lambda x: x[0]):
        h.update(f"{path}={kernels.fold_digest(v) if isinstance(v, str) else _scalar(v)};")
    return h.intdigest()


def _verify(same, digest):
    """Rows come sorted by group, salt and id; each is compared with the first of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last, body = None, None, None
        for b in batches:
            out = []
            for first, salt, i, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (first, salt) != group:
                    group, last, body = (first, salt), i, text
                elif i != last:
                    last = i
                    out.append((first, i, None if text == body or same(body, text) else digest(text) - (1 << 63)))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], names=["first_id", "copy_id", "other"])

    return run


def _copies(df: DataFrame, id_col: str, body: str, keys: Sequence[str], hasher, same, digest) -> DataFrame:
    prepare(df.sparkSession)
    src = df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        F.xxhash64(F.lit(0), *[F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in keys]).alias("k"),
        F.col(f"`{body}`").alias("body"),
    ).filter("id is not null and body is not null")
    # the texts are hashed once; groups and members are both read from this narrow table
    hashed = written(src.mapInArrow(hasher, "id bigint, k bigint, h1 bigint, h2 bigint, n bigint").filter("n > 0"))
    groups = written(hashed.groupBy("k", "h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("size")).filter("size > 1"))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    hot = groups.filter(F.col("size") > SALT_ABOVE).select("k", "h1", "h2", F.col("first_id").alias("hot"), F.explode(every).alias("salt"))
    cold = groups.filter(F.col("size") <= SALT_ABOVE).select(F.col("k").alias("part"), "h1", "h2", "first_id")
    # a row of a hot group has its first row already and is spread by its own id
    members = hashed.withColumn("salt", salt).join(hot, ["k", "h1", "h2", "salt"], "left").withColumn("part", F.when(F.col("hot").isNull(), F.col("k")).otherwise(F.col("id")))
    members = members.join(cold, ["part", "h1", "h2"], "left").select("id", F.coalesce("hot", "first_id").alias("first_id"), F.col("hot").isNotNull().alias("large"), "salt").filter("first_id is not null")
    with_text = members.join(src.select("id", "body"), "id")
    parts = F.when(~F.col("large"), F.array(F.lit(0))).when(F.col("id") == F.col("first_id"), every).otherwise(F.array("salt"))
    spread = with_text.select("first_id", F.explode(parts).alias("salt"), "id", "body")
    checked = written(spread.repartition("first_id", "salt").sortWithinPartitions("first_id", "salt", "id").mapInArrow(_verify(same, digest), "first_id bigint, copy_id bigint, other bigint"))
    others = checked.filter("other is not null")
    again = others.join(others.groupBy("first_id", "other").agg(F.min("copy_id").alias("least")), ["first_id", "other"]).filter("copy_id <> least")
    return checked.filter("other is null").select("first_id", "copy_id").unionByName(again.select(F.col("least").alias("first_id"), "copy_id").distinct())


def text_copies(df: DataFrame, id_col: str, text_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """(first_id, copy_id): each row whose text and keys repeat those of a smaller id.

    Rows are copies if their ``keys`` are equal (a null equals a null) and the letters and
    digits of their texts agree in order, letter case aside. Null texts and texts without
    letters and digits have no copies; neither have rows with a null id. Rows stored twice
    under one id count as one. An empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    return _copies(df, id_col, text_col, keys, _hash_texts, kernels.same_folded, kernels.fold_digest)


def record_copies(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(first_id, copy_id) of JSON objects with the same fields and values.

    Field order does not count; strings compare by letters and digits, numbers by value. A
    field that is null differs from one that is absent. Payloads that are not JSON objects
    have no copies.
    """
    return _copies(df, id_col, payload_col, (), _hash_records, same_record, record_digest)


def collapse(df: DataFrame, id_col: str, pairs: DataFrame) -> DataFrame:
    """The rows of ``df`` that are not copies, each with ``n_copies`` (1 if it is alone)."""
    n = pairs.groupBy("first_id").agg(F.count_distinct("copy_id").alias("_more"))
    kept = df.join(pairs.select(F.col("copy_id").alias(id_col)).distinct(), id_col, "left_anti")
    return kept.join(n, kept[id_col] == n["first_id"], "left").select(
        *[kept[c] for c in kept.columns], (F.coalesce(n["_more"], F.lit(0)) + 1).alias("n_copies")
    )
