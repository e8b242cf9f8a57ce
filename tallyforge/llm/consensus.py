"""Consensus of disagreeing judges by a community confusion model.

Judges belong to a few types; each type has a confusion matrix, and each judge a matrix drawn
around its type's, so a judge with few labels is read through its type. Truth, membership
and matrices are inferred by variational updates. A pass over the records needs only the
judges' expected log matrices and returns expected counts per judge, summed per task before
they are shuffled. The records are held once, as lists of small integers, in the checkpoint
folder.

The judges' parameters travel to the tasks as one array while there are at most
``MAX_SHIPPED`` judges. Beyond that judges live in a table: labels are joined with their
parameters under a salt, and only the types, the classes and sums over judges come to the
driver. Both ways compute the same updates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import prepare, settle, written

CLASSES = 5
MAX_SHIPPED = 20_000
SALTS = 16  # parts of one judge's labels where they are joined
STRENGTH = 20.0  # labels that a judge's type is worth
PASSES = 15
TOLERANCE = 1e-3


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for _ in range(6):
        small = x < 6
        shift = np.where(small, shift - 1 / x, shift)
        x = np.where(small, x + 1, x)
    i = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def _elog(a: np.ndarray) -> np.ndarray:
    return _digamma(a) - _digamma(a.sum(-1, keepdims=True))


def seed_types() -> np.ndarray:
    """Pseudo-counts of five starting types: exact, leaning up, leaning down, random, reversed."""
    k = np.arange(CLASSES)
    d = k[None, :] - k[:, None]
    types = [np.exp(-1.2 * np.abs(d)), np.exp(-1.2 * np.abs(d - 1)), np.exp(-1.2 * np.abs(d + 1)), np.ones_like(d, float), np.exp(-1.2 * np.abs(k[None, :] + k[:, None] - CLASSES + 1))]
    return np.stack([10 * t / t.sum(1, keepdims=True) for t in types])


@dataclass
class Model:
    """Posterior of the fit: ``judge`` (J, K, K) and ``kind`` (J, M) with the judges' names."""

    names: list[str]
    classes: np.ndarray
    judge: np.ndarray
    kind: np.ndarray
    types: np.ndarray


def update(counts: np.ndarray, classes: np.ndarray, types: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, ...]:
    """Membership, types and judge matrices from expected counts (J, K, K)."""
    score = _elog(share)[None, :] + np.einsum("jks,mks->jm", counts, _elog(types))
    score -= score.max(1, keepdims=True)
    kind = np.exp(score)
    kind /= kind.sum(1, keepdims=True)
    types = seed_types() + np.einsum("jm,jks->mks", kind, counts)
    mean = types / types.sum(-1, keepdims=True)
    judge = STRENGTH * np.einsum("jm,mks->jks", kind, mean) + counts
    return kind, types, judge, 1.0 + kind.sum(0), 1.0 + classes


def _posterior(batch: pa.RecordBatch, elog: np.ndarray | None, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per record the class posterior; per label its record, judge and score. Without
    matrices the posterior is the smoothed distribution of the scores themselves."""
    js, ss = batch.column(1), batch.column(2)
    n = js.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    j = js.flatten().to_numpy(zero_copy_only=False)
    s = ss.flatten().to_numpy(zero_copy_only=False)
    rec = np.repeat(np.arange(len(n)), n)
    if elog is None:
        near = np.exp(-np.abs(np.arange(CLASSES)[:, None] - np.arange(CLASSES)[None, :]))
        per = np.log(near / near.sum(1, keepdims=True))[:, s].T
    else:
        per = elog[j, :, s]
    q = np.zeros((len(n), CLASSES))
    for k in range(CLASSES):
        q[:, k] = np.bincount(rec, per[:, k], len(n))
    q += prior
    q -= q.max(1, keepdims=True)
    np.exp(q, out=q)
    q /= q.sum(1, keepdims=True)
    return q, rec, j, s


def _count(elog: np.ndarray | None, prior: np.ndarray, judges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, classes = np.zeros((CLASSES, judges * CLASSES)), np.zeros(CLASSES)
        for b in batches:
            q, rec, j, s = _posterior(b, elog, prior)
            classes += q.sum(0)
            cell = j.astype(np.int64) * CLASSES + s
            for k in range(CLASSES):
                total[k] += np.bincount(cell, q[rec, k], judges * CLASSES)
        cell = np.flatnonzero(total.any(0))
        out = [*(cell + CLASSES).tolist(), *range(CLASSES)]
        cols = [np.concatenate([total[k][cell], np.where(np.arange(CLASSES) == k, classes, 0.0)]) for k in range(CLASSES)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), *[pa.array(c) for c in cols]], names=["cell", *[f"n{k}" for k in range(CLASSES)]])

    return run


def _decide(elog: np.ndarray, prior: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, rec, _, s = _posterior(b, elog, prior)
            best = q.argmax(1)
            n = np.maximum(np.bincount(rec, minlength=len(best)), 1)
            agree = np.bincount(rec, s == best[rec], len(best)) / n
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array((best + 1).astype(np.int32)), pa.array(q[np.arange(len(q)), best]), pa.array(agree)],
                names=["record_id", "consensus", "probability", "agreement"],
            )

    return run


_CELLS = "cell bigint, " + ", ".join(f"n{k} double" for k in range(CLASSES))
_WIDE = [f"m{k}{x}" for k in range(CLASSES) for x in range(CLASSES)]  # judge counts, class by score


def _code(names: list[str]):
    """Judges' names of each record as positions in ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names, pa.string())
        for b in batches:
            who = b.column(1)
            flat = pc.index_in(who.flatten(), value_set=known).cast(pa.int32())
            offsets = pa.array(np.concatenate([[0], np.cumsum(who.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat), b.column(2)], names=["record_id", "j", "s"])

    return run


def _labels(df: DataFrame, id_col: str, judges_col: str, least: int) -> DataFrame:
    """(record_id, judge, s) of records with enough usable scores, as lists."""
    usable = F.filter(F.col(f"`{judges_col}`"), lambda x: x["score"].between(1, CLASSES) & x["judge"].isNotNull())
    return (
        df.select(F.col(f"`{id_col}`").cast("bigint").alias("record_id"), usable.alias("u"))
        .filter((F.size("u") >= least) & F.col("record_id").isNotNull())
        .select("record_id", F.col("u.judge").alias("judge"), F.transform("u", lambda x: (x["score"] - 1).cast("int")).alias("s"))
    )


def fit(df: DataFrame, id_col: str = "record_id", judges_col: str = "score_classifier_judges", least: int = 3, max_shipped: int = MAX_SHIPPED) -> tuple[Model | JoinedModel, DataFrame]:
    """Fit the model on all records with ``least`` or more scores; also their labels.

    Scores that are null or outside 1..5 and judges without a name are ignored.
    """
    prepare(df.sparkSession)
    labels = _labels(df, id_col, judges_col, least)
    some = labels.select(F.explode("judge").alias("judge")).distinct().limit(max_shipped + 1).collect()
    if len(some) > max_shipped:
        return _fit_joined(labels)
    names = sorted(r[0] for r in some)
    records = settle(labels.mapInArrow(_code(names), "record_id bigint, j array<int>, s array<int>"))
    J = len(names)
    types, share = seed_types(), np.ones(len(seed_types()))
    elog, classes, kind, judge = None, np.ones(CLASSES), np.zeros((J, len(types))), np.zeros((J, CLASSES, CLASSES))
    prior = np.zeros(CLASSES)
    for _ in range(PASSES if J else 0):
        parts = records.mapInArrow(_count(elog, prior, J), _CELLS).groupBy("cell").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(CLASSES)])
        got = parts.toArrow().to_pandas().to_numpy()
        counts, seen = np.zeros((J * CLASSES, CLASSES)), np.zeros(CLASSES)
        for row in got:
            cell = int(row[0])
            if cell < CLASSES:
                seen += row[1:]
            else:
                counts[cell - CLASSES] += row[1:]
        before = judge
        kind, types, judge, share, classes = update(counts.reshape(J, CLASSES, CLASSES).transpose(0, 2, 1), seen, types, share)
        elog, prior = _elog(judge), _elog(classes)
        a, b = judge / judge.sum(-1, keepdims=True), before / np.maximum(before.sum(-1, keepdims=True), 1e-9)
        if np.abs(a - b).max() < TOLERANCE:
            break
    return Model(names, classes, judge, kind, types), records


# --- more judges than one array should hold -----------------------------------------------


@dataclass
class JoinedModel:
    """Posterior of the fit where judges form a table: ``judges`` (judge, e: expected log
    matrix by class and score, m: matrix, kind: most probable type, change)."""

    judges: DataFrame
    classes: np.ndarray
    types: np.ndarray


_JUDGES = "judge string, e array<double>, m array<double>, kind int, change double"


def _membership(types: np.ndarray, share: np.ndarray):
    """Sums over judges that the types need: members, and counts by type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(types), 1 + CLASSES * CLASSES))
        for b in batches:
            counts, kind = _members(b, types, share)
            total += np.concatenate([kind.sum(0)[:, None], np.einsum("jm,jks->mks", kind, counts).reshape(len(types), -1)], 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(types)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["t", "x"])

    return run


def _members(b: pa.RecordBatch, types: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.stack([b.column(1 + k).to_numpy() for k in range(len(_WIDE))], 1).reshape(-1, CLASSES, CLASSES)
    score = _elog(share)[None, :] + np.einsum("jks,mks->jm", counts, _elog(types))
    score -= score.max(1, keepdims=True)
    kind = np.exp(score)
    return counts, kind / kind.sum(1, keepdims=True)


def _matrices(old: np.ndarray, share: np.ndarray, types: np.ndarray):
    """Judges' matrices from their counts: membership under the ``old`` types, drawn around
    the new ones; ``change`` against the matrix before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean = types / types.sum(-1, keepdims=True)
        for b in batches:
            counts, kind = _members(b, old, share)
            judge = STRENGTH * np.einsum("jm,mks->jks", kind, mean) + counts
            now = judge / judge.sum(-1, keepdims=True)
            was = np.array([x if x is not None else [0.0] * len(_WIDE) for x in b.column(1 + len(_WIDE)).to_pylist()]).reshape(-1, CLASSES, CLASSES)
            change = np.abs(now - was / np.maximum(was.sum(-1, keepdims=True), 1e-9)).max((1, 2)) if len(now) else np.zeros(0)
            flat = lambda x: pa.array(x.reshape(len(x), -1).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), flat(_elog(judge)), flat(judge), pa.array(kind.argmax(1).astype(np.int32)), pa.array(change)], names=["judge", "e", "m", "kind", "change"]
            )

    return run


def _posteriors(flat: DataFrame, judges: DataFrame | None, prior: np.ndarray) -> DataFrame:
    """(row, q0..q4): class posterior of each stored row."""
    if judges is None:
        near = np.exp(-np.abs(np.arange(CLASSES)[:, None] - np.arange(CLASSES)[None, :]))
        table = np.log(near / near.sum(1, keepdims=True))
        e = F.array(*[F.array(*[F.lit(float(v)) for v in table[:, x]]) for x in range(CLASSES)])
        labelled = flat.select("row", e[F.col("s")].alias("e"))
    else:
        params = judges.select("judge", "e", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        both = flat.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(params, ["judge", "salt"])
        labelled = both.select("row", F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.col("e")[k * CLASSES + F.col("s")]).alias("e"))
    q = labelled.groupBy("row").agg(*[F.sum(F.col("e")[k]).alias(f"e{k}") for k in range(CLASSES)])
    logit = [F.col(f"e{k}") + F.lit(float(prior[k])) for k in range(CLASSES)]
    top = F.greatest(*logit)
    w = q.select("row", *[F.exp(x - top).alias(f"w{k}") for k, x in enumerate(logit)])
    norm = sum((F.col(f"w{k}") for k in range(1, CLASSES)), F.col("w0"))
    return w.select("row", *[(F.col(f"w{k}") / norm).alias(f"q{k}") for k in range(CLASSES)])


def _fit_joined(labels: DataFrame) -> tuple[JoinedModel, DataFrame]:
    """:func:`fit` with the judges in a table; each stored row counts by itself."""
    records = written(settle(labels).withColumn("row", F.monotonically_increasing_id()))
    flat = records.select("row", F.explode(F.arrays_zip("judge", "s")).alias("l")).select("row", "l.judge", "l.s")
    types, share, prior = seed_types(), np.ones(len(seed_types())), np.zeros(CLASSES)
    judges, classes = None, np.ones(CLASSES)
    for _ in range(PASSES):
        q = written(_posteriors(flat, judges, prior))
        seen = q.agg(*[F.sum(f"q{k}") for k in range(CLASSES)]).first()
        cells = [F.sum(F.when(F.col("s") == x, F.col(f"q{k}")).otherwise(0.0)).alias(f"m{k}{x}") for k in range(CLASSES) for x in range(CLASSES)]
        counts = flat.join(q, "row").groupBy("judge").agg(*cells)
        counts = counts.join(judges.select("judge", F.col("m").alias("was")), "judge", "left") if judges is not None else counts.withColumn("was", F.lit(None).cast("array<double>"))
        counts = written(counts.select("judge", *_WIDE, "was"))
        total = np.zeros((len(types), 1 + CLASSES * CLASSES))
        for r in counts.drop("was").mapInArrow(_membership(types, share), "t int, x array<double>").groupBy("t").agg(*[F.sum(F.col("x")[i]).alias(f"x{i}") for i in range(total.shape[1])]).collect():
            total[r[0]] = r[1:]
        old, before = types, share
        types = seed_types() + total[:, 1:].reshape(-1, CLASSES, CLASSES)
        share, classes = 1.0 + total[:, 0], 1.0 + np.array([x or 0.0 for x in seen])
        judges = written(counts.mapInArrow(_matrices(old, before, types), _JUDGES))
        prior = _elog(classes)
        if (judges.agg(F.max("change")).first()[0] or 0.0) < TOLERANCE:
            break
    return JoinedModel(judges, classes, types), records


def _consensus_joined(model: JoinedModel, records: DataFrame) -> DataFrame:
    flat = records.select("row", F.explode(F.arrays_zip("judge", "s")).alias("l")).select("row", "l.judge", "l.s")
    q = _posteriors(flat, model.judges, _elog(model.classes)).select("row", F.array(*[f"q{k}" for k in range(CLASSES)]).alias("q"))
    best = (F.array_position("q", F.array_max("q")) - 1).cast("int")
    out = records.select("row", "record_id", "s").join(q.select("row", best.alias("b"), F.array_max("q").alias("probability")), "row")
    agree = F.size(F.filter("s", lambda x: x == F.col("b"))) / F.size("s")
    return out.select("record_id", (F.col("b") + 1).alias("consensus"), "probability", agree.alias("agreement"))


def consensus(df: DataFrame, id_col: str = "record_id", judges_col: str = "score_classifier_judges", least: int = 3, max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """(record_id, consensus, probability, agreement) per record with ``least`` scores.

    ``consensus`` is the most probable class 1..5 (the lower on a tie), ``agreement`` the
    share of the record's judges that gave it. Records with fewer usable scores, null judge
    lists or null ids have no row; each stored row is judged by itself, so a repeated id
    gives a row each time. An empty table gives an empty result.
    """
    model, records = fit(df, id_col, judges_col, least, max_shipped)
    out = "record_id bigint, consensus int, probability double, agreement double"
    if isinstance(model, JoinedModel):
        return _consensus_joined(model, records)
    if not model.names:
        return df.sparkSession.createDataFrame([], out)
    return records.mapInArrow(_decide(_elog(model.judge), _elog(model.classes)), out)


_TABLE = "judge string, n_scores bigint, reliability double, bias double, judge_type int"


def _report(names: list[str], judge: np.ndarray, kind: np.ndarray, classes: np.ndarray) -> list[tuple]:
    k, p = np.arange(CLASSES), classes / classes.sum()
    m = judge / judge.sum(-1, keepdims=True)
    acc, bias = np.einsum("k,jkk->j", p, m), np.einsum("k,jk->j", p, np.einsum("jks,s->jk", m, k) - k)
    n = np.rint(judge.sum((1, 2)) - STRENGTH * CLASSES).astype(int)
    return [(a, int(b), float(c), float(d), int(e)) for a, b, c, d, e in zip(names, n, acc, bias, kind, strict=True)]


def judge_table(df: DataFrame, id_col: str = "record_id", judges_col: str = "score_classifier_judges", least: int = 3, max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """(judge, n_scores, reliability, bias, judge_type): expected accuracy of each judge, its
    mean distance above the truth, and its most probable type (0 exact, 1 leaning up, 2
    leaning down, 3 random, 4 reversed at the start of the fit)."""
    model, _ = fit(df, id_col, judges_col, least, max_shipped)
    if isinstance(model, JoinedModel):
        classes = model.classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = _report(b.column(0).to_pylist(), np.array(b.column(1).to_pylist()).reshape(-1, CLASSES, CLASSES), b.column(2).to_numpy(), classes)
                yield pa.RecordBatch.from_pylist([dict(zip(("judge", "n_scores", "reliability", "bias", "judge_type"), g, strict=True)) for g in got], schema=pa.schema([("judge", pa.string()), ("n_scores", pa.int64()), ("reliability", pa.float64()), ("bias", pa.float64()), ("judge_type", pa.int32())]))

        return model.judges.select("judge", "m", "kind").mapInArrow(run, _TABLE)
    return df.sparkSession.createDataFrame(_report(model.names, model.judge, model.kind.argmax(1), model.classes) if model.names else [], _TABLE)


def agreement(df: DataFrame, judges_col: str = "score_classifier_judges", by: str | None = None) -> DataFrame:
    """Ordinal agreement (Krippendorff's alpha) of the judges, over all rows or per ``by``.

    Rows with fewer than two usable scores do not count; alpha is null where all scores are
    equal. One shuffle of at most 25 partial sums per group and task.
    """
    g = F.col(f"`{by}`") if by else F.lit("all")
    usable = F.filter(F.col(f"`{judges_col}`"), lambda x: x["score"].between(1, CLASSES))
    per = df.select(g.alias("grp"), F.transform(usable, lambda x: x["score"]).alias("s")).filter(F.size("s") >= 2)
    hist = per.select("grp", F.size("s").alias("m"), *[F.size(F.expr(f"filter(s, x -> x = {k + 1})")).alias(f"c{k}") for k in range(CLASSES)])
    cells = [(F.sum(F.col(f"c{a}") * (F.col(f"c{b}") - (1 if a == b else 0)) / (F.col("m") - 1))).alias(f"o{a}{b}") for a in range(CLASSES) for b in range(CLASSES)]
    o = hist.groupBy("grp").agg(F.count("*").alias("n_records"), *cells)
    n = [sum((F.col(f"o{a}{b}") for b in range(1, CLASSES)), F.col(f"o{a}0")) for a in range(CLASSES)]
    total = sum(n[1:], n[0])
    zero = F.lit(0.0)
    seen, expected = zero, zero
    for a in range(CLASSES):
        for b in range(a + 1, CLASSES):
            d = sum((n[c] for c in range(a + 1, b)), zero) + (n[a] + n[b]) / 2
            seen = seen + F.col(f"o{a}{b}") * d * d
            expected = expected + n[a] * n[b] * d * d
    return o.select("grp", "n_records", F.when(expected > 0, 1 - (total - 1) * seen / expected).alias("alpha"))
