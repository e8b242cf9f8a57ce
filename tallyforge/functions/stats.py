"""Exact order statistics, ranks, multiplicity control and exact discrete tests."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def p90_floor(values: Column, n: Column) -> Column:
    """sorted[int(.9 n) - 1] from ten values on, else the maximum (aggregate expression)."""
    s = F.sort_array(F.collect_list(values))
    return F.when(n >= 10, F.element_at(s, F.floor(F.lit(0.9) * n).cast("int"))).otherwise(F.max(values))


def percentile_index(values: Column, q: float, n: Column) -> Column:
    """sorted[min(int(q n), n - 1)], counted from 0: a second, distinct percentile rule."""
    s = F.sort_array(F.collect_list(values))
    return F.element_at(s, (F.least(F.floor(F.lit(q) * n), n - 1) + 1).cast("int"))


def half_up_median(values: Column) -> Column:
    """The median of non-negative integers, halves rounded up."""
    return F.floor(F.median(values) + 0.5).cast("int")


def average_ranks(df: DataFrame, value: str, out: str, by: list[str]) -> DataFrame:
    """Fractional ranks from 1; ties share the mean of their positions."""
    w, tie = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return df.withColumn(out, F.rank().over(w) + (F.count("*").over(tie) - 1) / 2.0)


def bh_stepup(df: DataFrame, p: str, keys: list[str], q: float = 0.05) -> DataFrame:
    """``survives``: whether p is at or below the largest p_k <= k q / m. Nulls count in m and
    never survive. Family sizes are counts of hypotheses, small beside the records."""
    order = Window.partitionBy().orderBy(F.asc_nulls_last(p), *keys)
    whole = Window.partitionBy()
    r = df.withColumn("_k", F.row_number().over(order)).withColumn("_m", F.count("*").over(whole))
    r = r.withColumn("_top", F.max(F.when(F.col(p) <= F.col("_k") * q / F.col("_m"), F.col("_k"))).over(whole))
    return r.withColumn("survives", F.coalesce((F.col("_k") <= F.col("_top")) & F.col(p).isNotNull(), F.lit(False))).drop("_k", "_m", "_top")


def bh_adjusted(df: DataFrame, p: str, keys: list[str], out: str = "p_adjusted") -> DataFrame:
    """p n / rank, at most 1, made monotone from the largest p down."""
    order = Window.partitionBy().orderBy(p, *keys)
    r = df.filter(F.col(p).isNotNull()).withColumn("_raw", F.least(F.col(p) * F.count("*").over(Window.partitionBy()) / F.row_number().over(order), F.lit(1.0)))
    return r.withColumn(out, F.min("_raw").over(order.rowsBetween(0, Window.unboundedFollowing))).drop("_raw")


@lru_cache(maxsize=100_000)
def sign_p(positive: int, negative: int) -> float:
    """Two-sided binomial sign test; 1 where there is nothing to compare."""
    n = positive + negative
    if n == 0:
        return 1.0
    tail = sum(math.comb(n, k) for k in range(min(positive, negative) + 1))
    return float(min(1.0, 2 * tail / 2**n)) if n < 1000 else min(1.0, math.exp(math.log(2 * tail) - n * math.log(2)))


@lru_cache(maxsize=100_000)
def fisher_greater(a: int, b: int, c: int, d: int) -> float | None:
    """P(X >= a) of the hypergeometric table [[a, b], [c, d]]; None for an empty table."""
    if a + b + c + d == 0:
        return None
    row, col, n = a + b, a + c, a + b + c + d
    total = math.comb(n, col)
    hits = sum(math.comb(row, x) * math.comb(n - row, col - x) for x in range(a, min(row, col) + 1))
    return hits / total


@lru_cache(maxsize=100_000)
def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of the tables no likelier than the one seen, with a slack of 1e-9; 1 if a margin is 0."""
    row, col, n = a + b, a + c, a + b + c + d
    if row in (0, n) or col in (0, n):
        return 1.0
    total = math.comb(n, col)
    p = {x: math.comb(row, x) * math.comb(n - row, col - x) / total for x in range(max(0, col - (n - row)), min(row, col) + 1)}
    return min(1.0, sum(v for v in p.values() if v <= p[a] * (1 + 1e-9)))


def _sign(positive: pd.Series, negative: pd.Series) -> pd.Series:
    return pd.Series([sign_p(int(x), int(y)) for x, y in zip(positive, negative, strict=True)], dtype="float64")


def _one(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_greater(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d, strict=True)], dtype="float64")


def _two(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d, strict=True)], dtype="float64")


def sign_test(positive: str, negative: str) -> Column:
    """Two-sided sign test of two count columns (exact integers, Arrow batches)."""
    return F.pandas_udf(_sign, "double")(positive, negative)


def fisher_one(a: str, b: str, c: str, d: str) -> Column:
    """One-sided Fisher exact test of four count columns."""
    return F.pandas_udf(_one, "double")(a, b, c, d)


def fisher_two(a: str, b: str, c: str, d: str) -> Column:
    """Two-sided Fisher exact test of four count columns."""
    return F.pandas_udf(_two, "double")(a, b, c, d)


def min_reachable_p(n_a: int, n_b: int) -> float:
    """The smallest two-sided p an exact permutation of two groups can reach."""
    return 2 / math.comb(n_a + n_b, n_a)


def mde_any_negative(n: int, power: float = 0.8) -> float:
    """Smallest per-unit chance of an opposite sign that ``n`` units show with ``power``."""
    return 1 - (1 - power) ** (1 / n)


def exact_permutation_p(a: list[float], b: list[float], most: int = 200_000) -> float | None:
    """Two-sided exact permutation test of a difference of means, slack 1e-12; None beyond
    ``most`` splits or for an empty group."""
    from itertools import combinations

    n, k = len(a) + len(b), len(a)
    if not a or not b or math.comb(n, k) > most:
        return None
    x, total = [*a, *b], sum(a) + sum(b)
    seen = abs(sum(a) / k - sum(b) / (n - k))
    hits = sum(abs(s / k - (total - s) / (n - k)) >= seen - 1e-12 for s in (sum(c) for c in combinations(x, k)))
    return hits / math.comb(n, k)


def bisect_shift(values: list[float], sims: int = 400, power: float = 0.8, steps: int = 14) -> float | None:
    """Smallest shift of all values that a two-sided sign test at 0.05 finds with ``power``, by
    bisection; simulations resample the centred values with fixed draws. None where even a
    shift of their whole range is not found, or for fewer than two values."""
    from tallyforge.operators.resample import draws

    n = len(values)
    if n < 2:
        return None
    x = np.array(values) - float(np.mean(values))
    at = draws(1, "shift", np.arange(sims)[:, None], np.arange(n)[None, :], n)
    sample = x[at]

    def found(shift: float) -> float:
        up, down = (sample + shift > 1e-12).sum(1), (sample + shift < -1e-12).sum(1)
        return float(np.mean([sign_p(int(u), int(v)) <= 0.05 for u, v in zip(up, down, strict=True)]))

    lo, hi = 0.0, float(x.max() - x.min()) + 1e-9
    if found(hi) < power:
        return None
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if found(mid) >= power else (mid, hi)
    return round(hi, 6)
