"""Resampling whose draws are functions of their names, not of a generator's state.

Draw ``i`` of replicate ``b`` for a key starts from a number made of the seed, the key's md5, b
and i, and raises it three times to the fifth power modulo a prime, a bijection each time:
results depend neither on partitioning nor on row order, and SQL, Spark and numpy compute the
same ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import stats

PRIME = 2**31 - 1
STEPS = (7919, 104729, 1299709)  # for seed, replicate and draw
ROUNDS = (12345, 67890, 424242)


def _start(seed: int, key: Column, b: Column, i: Column) -> Column:
    name = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")
    return (name + F.lit(seed * STEPS[0]).cast("bigint") + b.cast("bigint") * STEPS[1] + i.cast("bigint") * STEPS[2]) % PRIME


def with_draw(df: DataFrame, out: str, seed: int, key: Column, b: Column, i: Column, n: Column) -> DataFrame:
    """``df`` with the index 0..n-1 of one draw as column ``out``. Each power is a column of its
    own for a moment, so that none is computed twice."""
    df = df.withColumn("_x", _start(seed, key, b, i))
    for c in ROUNDS:
        df = df.withColumn("_s", F.col("_x") * F.col("_x") % PRIME).withColumn("_x", (F.col("_s") * F.col("_s") % PRIME * F.col("_x") + c) % PRIME)
    # never null, or joins on it would test the whole arithmetic for null once more
    return df.withColumn(out, F.coalesce(F.col("_x") % n, F.lit(-1).cast("bigint"))).drop("_x", "_s")


def draws(seed: int, key: str, b: np.ndarray, i: np.ndarray, n: int) -> np.ndarray:
    """:func:`with_draw` for arrays of replicates and draws."""
    start = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) + seed * STEPS[0]
    x = (np.int64(start) + b.astype(np.int64) * STEPS[1] + i.astype(np.int64) * STEPS[2]) % PRIME
    for c in ROUNDS:
        square = x * x % PRIME
        x = (square * square % PRIME * x + c) % PRIME
    return x % n


def _tasks(df: DataFrame) -> int:
    """Tasks over which the few units are spread before each becomes many draws; without
    that, adaptive execution would leave them, and all their draws, in one task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def replicates(units: DataFrame, key: str, order: list[str], value: str, reps: int, seed: int) -> DataFrame:
    """(key, b, value): every unit drawn in each replicate, as often as it was drawn.

    Units are numbered within their key by ``order``; n draws a replicate keep multiplicity.
    Expands to units times ``reps`` rows, all joined on (key, index).
    """
    w = Window.partitionBy(key).orderBy(*order)
    numbered = units.select(key, (F.row_number().over(w) - 1).cast("bigint").alias("idx"), F.col(value).alias("value"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    spread = numbered.repartition(_tasks(units), key, "idx")
    drawn = spread.select(key, "n", F.col("idx").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("b"))
    drawn = with_draw(drawn, "idx", seed, F.col(key), F.col("b"), F.col("i"), F.col("n")).select(key, "b", "idx")
    return drawn.join(numbered.select(key, "idx", "value").hint("shuffle_hash"), [key, "idx"]).select(key, "b", "value")


def interval(means: DataFrame, key: str, value: str, reps: int) -> DataFrame:
    """Percentile interval: sorted[int(.025 B)] and sorted[int(.975 B)], and the two-sided p
    2 min(P(<= 0), P(>= 0)), at most 1."""
    s = F.sort_array(F.collect_list(value))
    at = lambda q: F.element_at(s, min(int(q * reps), reps - 1) + 1)
    p = F.least(F.lit(1.0), 2.0 * F.least(F.count_if(F.col(value) <= 0), F.count_if(F.col(value) >= 0)) / F.count("*"))
    return means.groupBy(key).agg(at(0.025).alias("lo"), at(0.975).alias("hi"), p.alias("p"))


def bootstrap_of(units: DataFrame, key: str, order: list[str], statistic: Column, reps: int = 200, seed: int = 1) -> DataFrame:
    """Interval and p of any aggregate expression over resampled rows of ``units``."""
    names = [c for c in units.columns if c != key]
    row = units.select(key, F.struct(*names).alias("_row"), *order)
    drawn = replicates(row, key, order, "_row", reps, seed).select(key, "b", "value.*")
    return interval(drawn.groupBy(key, "b").agg(statistic.alias("m")), key, "m", reps)


def bootstrap_mean(units: DataFrame, key: str, order: list[str], value: str, reps: int = 200, seed: int = 1) -> DataFrame:
    """Mean of each key's units with its percentile interval and two-sided p."""
    means = replicates(units, key, order, value, reps, seed).groupBy(key, "b").agg(F.avg("value").alias("m"))
    return interval(means, key, "m", reps).join(units.groupBy(key).agg(F.avg(value).alias("mean"), F.count("*").alias("n")), key)


def permutation_p(units: DataFrame, key: str, order: list[str], group: str, value: str, reps: int = 200, seed: int = 1) -> DataFrame:
    """Monte-Carlo permutation of a difference of two group means, with +1/+1 p.

    In each replicate a key's rows are ordered by md5 of their name and the first n_a form
    group a.
    """
    w = Window.partitionBy(key).orderBy(*order)
    rows = units.select(key, F.col(group).cast("int").alias("g"), F.col(value).alias("value"), F.row_number().over(w).alias("i"))
    size = rows.groupBy(key).agg(F.sum("g").alias("na"), F.count("*").alias("n"), (F.avg(F.when(F.col("g") == 1, F.col("value"))) - F.avg(F.when(F.col("g") == 0, F.col("value")))).alias("seen"))
    name = F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("b").cast("string"), F.col("i").cast("string"))
    shuffled = rows.repartition(_tasks(units), key, "i").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("r", F.row_number().over(Window.partitionBy(key, "b").orderBy(F.md5(name), "i")))
    first = F.col("r") <= F.col("na")
    diff = shuffled.join(size, key).filter("na > 0 and na < n").groupBy(key, "b", "seen").agg((F.avg(F.when(first, F.col("value"))) - F.avg(F.when(~first, F.col("value")))).alias("d"))
    return diff.groupBy(key).agg(F.first("seen").alias("effect"), ((F.count_if(F.abs("d") >= F.abs("seen") - 1e-12) + 1) / (F.count("*") + 1.0)).alias("p"))


def _exact(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in groups:
        yield pd.DataFrame({"key": df["key"], "p": [stats.exact_permutation_p(list(a), list(b)) for a, b in zip(df["a"], df["b"], strict=True)]})


def exact_permutation(units: DataFrame, key: str, group: str, value: str, most: int = 12) -> DataFrame:
    """(key, p): exact two-sided permutation p of small groups, null beyond ``most`` a side."""
    g = units.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(F.when(F.col(group), F.col(value)))).alias("a"), F.array_sort(F.collect_list(F.when(~F.col(group), F.col(value)))).alias("b"))
    small = (F.size("a") <= most) & (F.size("b") <= most)
    g = g.filter((F.size("a") > 0) & (F.size("b") > 0))
    large = g.filter(~small).select("key", F.lit(None).cast("double").alias("p"))
    return g.filter(small).mapInPandas(_exact, "key string, p double").unionByName(large)


def restricted_null(table: dict[str, list[float]], most: int = 400_000) -> tuple[float, float] | None:
    """Omnibus statistic of a stem by sector table and its exact p over relabellings of the
    sectors within each stem: the sum of squared sector sums. None beyond ``most``."""
    import itertools
    import math

    stems = [list(v) for v in table.values()]
    if not stems or math.prod(math.factorial(len(s)) for s in stems) > most:
        return None
    sums: dict[tuple[float, ...], int] = {(0.0,) * len(stems[0]): 1}
    for s in stems:
        new: dict[tuple[float, ...], int] = {}
        for p in itertools.permutations(s):
            for k, n in sums.items():
                t = tuple(round(a + b, 12) for a, b in zip(k, p, strict=True))
                new[t] = new.get(t, 0) + n
        sums = new
    seen = sum(sum(c) ** 2 for c in zip(*stems, strict=True))
    hits = sum(n for k, n in sums.items() if sum(x * x for x in k) >= seen - 1e-9)
    return seen, hits / sum(sums.values())
