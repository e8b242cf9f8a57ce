"""Judged responses: eligibility, replicate collapse, pairing of arms, repairs, judges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as X


def exclusion_reason(cap_default: int = 800) -> Column:
    """failed-call, empty or truncated, the first that holds; null for an eligible response."""
    cut = X.truncated(F.col("response_text"), F.col("truncated"), F.col("tokens_out"), F.coalesce("max_tokens", F.lit(cap_default)))
    return F.when(F.col("ok").eqNullSafe(False), "failed-call").when(X.blank(F.col("response_text")), "empty").when(cut, "truncated")


def bucket() -> Column:
    """eligible, scored_empty, scored_truncated or unscored: every row is in exactly one."""
    names = {"failed-call": "unscored", "empty": "scored_empty", "truncated": "scored_truncated", "eligible": "eligible"}
    by_reason = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    # the reason reads the whole text, so it is named once and looked up
    return F.when(F.col("score_classifier").isNull(), "unscored").otherwise(by_reason[F.coalesce(exclusion_reason(), F.lit("eligible"))])


def replicate_means(df: DataFrame, key: Sequence[str], value: str = "score_classifier", where: Column | None = None) -> DataFrame:
    """Mean of the non-null values of each cell, and its depth; a cell without any stays,
    with a null mean and depth 0. ``where`` keeps only the rows it holds for."""
    df = df if where is None else df.filter(where)
    return df.groupBy(*key).agg(F.avg(value).alias("mean_score"), F.count(value).alias("depth"), F.count("*").alias("n_rows"))


def representatives(df: DataFrame, key: Sequence[str], order: str, value: str = "score_classifier") -> DataFrame:
    """The last row of each cell (by ``order``), its value replaced by the cell's mean."""
    rest = [c for c in df.columns if c not in key and c not in (order, value)]
    last = F.max_by(F.struct(*rest, order), F.col(order))
    return df.groupBy(*key).agg(last.alias("r"), F.avg(value).alias(value), F.count("*").alias("n_replicates")).select(*key, f"r.{order}", *[f"r.{c}" for c in rest], value, "n_replicates")


def pair_arms(cells: DataFrame, hold: Sequence[str], factor: str, value: str, arms: Sequence[str]) -> DataFrame:
    """One wide row per ``hold``: the value of each arm. One shuffle, whatever the arms."""
    return cells.groupBy(*hold).agg(*[F.avg(F.when(F.col(factor) == a, F.col(value))).alias(a) for a in arms])


def splice(base: DataFrame, repairs: DataFrame, key: Sequence[str], columns: Sequence[str], eligible: str, priority: str) -> DataFrame:
    """Rows of ``base``; one that is not eligible takes ``columns`` from the first eligible
    repair with its key. ``spliced`` says where that happened; eligible rows never change."""
    w = Window.partitionBy(*key).orderBy(priority)
    first = repairs.filter(F.col(eligible)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_found"))
    both = base.join(first, list(key), "left")
    use = ~F.col(eligible) & F.coalesce("_found", F.lit(False))
    keep = [c for c in base.columns if c not in columns]
    return both.select(*keep, *[F.when(use, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns], use.alias("spliced"))


def judge_scores(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per usable judge score: not null, no error."""
    return df.select(*keep, F.explode("score_classifier_judges").alias("j")).filter("j.score is not null and j.error is null").select(*keep, "j.judge", "j.score")


def panel(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Median of each row's usable scores, unrounded, and the spread where there are two."""
    usable = F.transform(F.filter("score_classifier_judges", lambda j: j["score"].isNotNull() & j["error"].isNull()), lambda j: j["score"])
    s = df.select(*keep, F.array_sort(usable).alias("s")).filter(F.size("s") > 0).withColumn("n", F.size("s"))
    mid = (F.expr("s[(n - 1) div 2]") + F.expr("s[n div 2]")) / 2.0
    return s.select(*keep, mid.alias("panel"), F.when(F.col("n") >= 2, F.expr("s[n - 1] - s[0]")).alias("spread"), F.col("n").alias("n_judges"))


METHODS = {
    "panel": lambda s: (F.element_at(s, ((F.size(s) - 1) / 2).cast("int") + 1) + F.element_at(s, (F.size(s) / 2).cast("int") + 1)) / 2.0,
    "lowest": lambda s: F.element_at(s, 1).cast("double"),
    "highest": lambda s: F.element_at(s, -1).cast("double"),
}
"""Ways to score a row from its usable judge scores in order; more may be added by name."""


def method_scores(df: DataFrame, keep: Sequence[str], methods: Sequence[str] = tuple(METHODS), stored: str = "score_classifier") -> DataFrame:
    """One row per row and method (``stored`` is the recorded score): its score, null ones left out."""
    usable = F.filter("score_classifier_judges", lambda j: j["score"].isNotNull() & j["error"].isNull())
    s = df.select(*keep, F.col(stored).alias("_stored"), F.array_sort(F.transform(usable, lambda j: j["score"])).alias("s"))
    each = [F.struct(F.lit(m).alias("method"), F.when(F.size("s") > 0, METHODS[m](F.col("s"))).alias("score")) for m in methods]
    return s.select(*keep, F.explode(F.array(*each, F.struct(F.lit("stored").alias("method"), F.col("_stored").alias("score")))).alias("m")).select(*keep, "m.*").filter("score is not null")


def assert_closed(df: DataFrame, column: str, known: DataFrame, message: str) -> DataFrame:
    """``df``, which fails with ``message`` at the first row whose ``column`` is not among the
    one column of ``known``; null values fail too."""
    k = known.select(F.col(known.columns[0]).alias(column), F.lit(True).alias("_known")).distinct()
    joined = df.join(k, column, "left")
    return joined.filter(F.when(F.col("_known"), True).otherwise(F.raise_error(F.lit(message)).cast("boolean"))).drop("_known")
