"""Bootstrap of contrasts between arms of sheets, a whole group of draws at a time.

A group's units become a matrix; the draws become a matrix of how often each unit was drawn;
one product gives the resampled means of all replicates. The draws are those of
:func:`tallyforge.operators.resample.with_draw`, so SQL can repeat them. Groups of more than
``MOST_UNITS`` units are resampled by joins instead (:func:`resample.replicates`), with the
same draws and the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import resample as B

MOST_UNITS = 20_000
CHUNK = 1 << 22  # cells of one matrix of draws


def counts(seed: int, key: str, n: int, reps: int) -> Iterator[np.ndarray]:
    """How often each of ``n`` units of ``key`` is drawn, replicates by units, in chunks."""
    step = max(1, CHUNK // max(n, 1))
    for lo in range(0, reps, step):
        b = np.arange(lo, min(reps, lo + step))
        at = B.draws(seed, key, b[:, None], np.arange(n)[None, :], n)
        yield np.bincount((np.arange(len(b))[:, None] * n + at).ravel(), minlength=len(b) * n).reshape(len(b), n).astype(float)


def resampled_means(x: np.ndarray, seed: int, key: str, reps: int) -> np.ndarray:
    """Means of the columns of ``x`` (units by columns, NaN for what a unit lacks) in each
    replicate; NaN where no drawn unit has the column."""
    known = np.isfinite(x)
    filled = np.where(known, x, 0.0)
    out = []
    for c in counts(seed, key, len(x), reps):
        n = c @ known
        out.append(np.divide(c @ filled, n, out=np.full(n.shape, np.nan), where=n > 0))
    return np.concatenate(out)


def _mean(x: np.ndarray) -> np.ndarray:
    """Mean over the last axis of what is known; NaN where nothing is."""
    known = np.isfinite(x)
    n = known.sum(-1)
    return np.divide(np.where(known, x, 0.0).sum(-1), n, out=np.full(n.shape, np.nan), where=n > 0)


def summary(effects: np.ndarray) -> tuple[float | None, float | None, float | None]:
    """sorted[int(.025 B)], sorted[int(.975 B)], and the add-one two-sided p of draws."""
    m = np.sort(np.round(effects[np.isfinite(effects)], 9))
    if not len(m):
        return None, None, None
    at = lambda q: float(m[min(int(q * len(m)), len(m) - 1)])
    p = 2 * (min((m <= 0).sum(), (m >= 0).sum()) + 1) / (len(m) + 1)
    return at(0.025), at(0.975), float(min(1.0, p))


_CONTRASTS = "model string, contrast string, n_pairs bigint, n_sheets_a bigint, n_sheets_b bigint, effect double, lo double, hi double, p double"


def _arms(table: pa.Table) -> tuple[dict[str, np.ndarray], list[int]]:
    pairs = sorted(set(table["pair_no"].to_pylist()))
    col = {p: k for k, p in enumerate(pairs)}
    arms: dict[str, dict[int, list[tuple[int, float]]]] = {}
    for c, s, p, x in zip(*(table[k].to_pylist() for k in ("condition", "sheet_id", "pair_no", "position")), strict=True):
        arms.setdefault(c, {}).setdefault(s, []).append((col[p], x))
    out = {}
    for c, sheets in arms.items():
        m = np.full((len(sheets), len(pairs)), np.nan)
        for i, s in enumerate(sorted(sheets)):
            for k, x in sheets[s]:
                m[i, k] = x
        out[c] = m
    return out, pairs


def sheet_contrasts(positions: DataFrame, contrasts: list[tuple[str, str]], reps: int, seed: int = 1, most: int = MOST_UNITS) -> DataFrame:
    """Per model and contrast (a, b): mean over shared pairs of position under a less under b,
    its percentile interval and add-one p, both arms' sheets resampled at their own size.

    ``positions`` has sheet_id, model, condition, pair_no and position, one row each. A model
    without one of the arms, or without a shared pair, has no row for the contrast.
    """
    wanted = sorted({c for ab in contrasts for c in ab})
    p = positions.filter(F.col("condition").isin(*wanted)).select("model", "condition", "sheet_id", "pair_no", F.col("position").cast("double").alias("position"))
    largest = p.groupBy("model").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if largest is not None and largest > most * 40:
        return _joined(p, contrasts, reps, seed)

    def run(table: pa.Table) -> pa.Table:
        arms, _ = _arms(table)
        model = table["model"][0].as_py()
        drawn = {c: resampled_means(x, seed, f"{model}#{c}", reps) for c, x in arms.items()}
        rows = []
        for a, b in contrasts:
            if a in arms and b in arms:
                gap = _mean(arms[a].T) - _mean(arms[b].T)
                if np.isfinite(gap).any():
                    lo, hi, pv = summary(_mean(drawn[a] - drawn[b]))
                    rows.append((model, f"{a}-{b}", int(np.isfinite(gap).sum()), len(arms[a]), len(arms[b]), float(_mean(gap)), lo, hi, pv))
        names = [c.split()[0] for c in _CONTRASTS.split(", ")]
        types = [pa.string(), pa.string(), *[pa.int64()] * 3, *[pa.float64()] * 4]
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})

    return p.groupBy("model").applyInArrow(run, _CONTRASTS)


def _joined(p: DataFrame, contrasts: list[tuple[str, str]], reps: int, seed: int) -> DataFrame:
    """:func:`sheet_contrasts` by joins, for models with more sheets than one task should hold."""
    p = p.withColumn("arm", F.concat_ws("#", "model", "condition"))
    drawn = B.replicates(p.select("arm", "sheet_id").distinct(), "arm", ["sheet_id"], "sheet_id", reps, seed).withColumnRenamed("value", "sheet_id")
    means = drawn.join(p, ["arm", "sheet_id"]).groupBy("model", "condition", "b", "pair_no").agg(F.avg("position").alias("x"))
    seen = p.groupBy("model", "condition", "pair_no").agg(F.avg("position").alias("x"))
    size = p.groupBy("model", "condition").agg(F.count_distinct("sheet_id").alias("n"))
    out = None
    for a, b in contrasts:
        of = lambda df, c, name: df.filter(F.col("condition") == c).drop("condition").withColumnRenamed("x", name)
        e = of(means, a, "xa").join(of(means, b, "xb"), ["model", "b", "pair_no"]).groupBy("model", "b").agg(F.round(F.avg(F.expr("xa - xb")), 9).alias("m"))
        s, n = F.sort_array(F.collect_list("m")), F.count("*")
        at = lambda q: F.element_at(s, (F.least(F.floor(F.lit(q) * n), n - 1) + 1).cast("int"))  # noqa: B023, E731
        ci = e.groupBy("model").agg(at(0.025).alias("lo"), at(0.975).alias("hi"), F.least(F.lit(1.0), 2 * (F.least(F.count_if(F.col("m") <= 0), F.count_if(F.col("m") >= 0)) + 1) / (n + 1)).alias("p"))
        eff = of(seen, a, "xa").join(of(seen, b, "xb"), ["model", "pair_no"]).groupBy("model").agg(F.count("*").alias("n_pairs"), F.avg(F.expr("xa - xb")).alias("effect"))
        both = eff.join(of(size, a, "x").withColumnRenamed("n", "n_sheets_a"), "model").join(of(size, b, "x").withColumnRenamed("n", "n_sheets_b"), "model").join(ci, "model")
        part = both.select("model", F.lit(f"{a}-{b}").alias("contrast"), "n_pairs", "n_sheets_a", "n_sheets_b", "effect", "lo", "hi", "p")
        out = part if out is None else out.unionByName(part)
    return out


def interactions(positions: DataFrame, arm: str, first: str, second: str, a: str, base: str, reps: int, seed: int = 1) -> DataFrame:
    """Per model: (a - base) in arm ``first`` less (a - base) in arm ``second``, with interval
    and add-one p; sheets of the four cells are resampled each by itself.

    Models that lack one of the cells, or share no pair over all four, have no row. The sheets
    of one model must fit one task.
    """
    p = positions.filter(F.col("condition").isin(a, base) & F.col(arm).isin(first, second))
    p = p.select("model", F.concat_ws("#", arm, "condition").alias("condition"), "sheet_id", "pair_no", F.col("position").cast("double").alias("position"))
    cells = [f"{x}#{c}" for x in (first, second) for c in (a, base)]

    def run(table: pa.Table) -> pa.Table:
        arms, _ = _arms(table)
        model = table["model"][0].as_py()
        rows = []
        if all(c in arms for c in cells):
            gap = [_mean(arms[c].T) for c in cells]
            effect = (gap[0] - gap[1]) - (gap[2] - gap[3])
            if np.isfinite(effect).any():
                x = [resampled_means(arms[c], seed, f"{model}#{c}", reps) for c in cells]
                rows.append((model, int(np.isfinite(effect).sum()), float(_mean(effect)), *summary(_mean((x[0] - x[1]) - (x[2] - x[3])))))
        types = [pa.string(), pa.int64(), *[pa.float64()] * 4]
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(("model", "n_pairs", "effect", "lo", "hi", "p"), types, strict=True))})

    return p.groupBy("model").applyInArrow(run, "model string, n_pairs bigint, effect double, lo double, hi double, p double")


def modal_noise(answers: DataFrame, cell: str, reps: int, seed: int = 1) -> DataFrame:
    """(cell, mean_flips, most_flips, p90_flips): two independent resamples of a cell's sheets,
    the modal position (the lower on a tie) of each item in either, and the items whose modal
    falls on the other side. The sheets of one cell must fit one task."""

    def run(table: pa.Table) -> pa.Table:
        name = table[cell][0].as_py()
        sheets, qs = (np.unique(table[c].to_numpy(), return_inverse=True) for c in ("sheet_id", "q"))
        one = np.zeros((len(sheets[0]), len(qs[0]), 4))
        one[sheets[1], qs[1], table["position"].to_numpy()] = 1
        flat, flips = one.reshape(len(one), -1), []
        for c, d in zip(counts(seed, f"{name}#1", len(one), reps), counts(seed, f"{name}#2", len(one), reps), strict=True):
            n, m = ((x @ flat).reshape(len(x), -1, 4) for x in (c, d))
            seen = (n.sum(2) > 0) & (m.sum(2) > 0)
            flips.append((seen & ((n.argmax(2) >= 2) != (m.argmax(2) >= 2))).sum(1))
        f = np.sort(np.concatenate(flips))
        p90 = f[int(0.9 * len(f)) - 1] if len(f) >= 10 else f[-1]
        return pa.table({cell: [name], "mean_flips": [float(f.mean())], "most_flips": [int(f[-1])], "p90_flips": [int(p90)]})

    src = answers.filter("position between 0 and 3").select(cell, "sheet_id", "q", F.col("position").cast("int").alias("position"))
    return src.groupBy(cell).applyInArrow(run, f"{cell} string, mean_flips double, most_flips bigint, p90_flips bigint")
