"""Answer sheets in long form: answers, modal positions, floors between cells, pair positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["model", "condition", "template", "temperature", "shuffle_seed"]
SHEET = ["sheet_id", "run_no", "seed", "channel", *CELL]


def side(position: Column) -> Column:
    """The agreeing half of the scale."""
    return position >= 2


def endpoint(position: Column) -> Column:
    """Either end of the scale."""
    return position.isin(0, 3)


def answers(sheets: DataFrame, extra: list[str] = ()) -> DataFrame:
    """One row per answered item of each valid sheet; an item's first answer counts."""
    first = F.filter("answers", lambda a, i: F.array_position(F.transform("answers", lambda x: x["q"]), a["q"]) == i + 1)
    return sheets.filter("valid").select(*SHEET, *extra, F.explode(first).alias("a")).select(*SHEET, *extra, F.col("a.q").alias("q"), F.col("a.position").alias("position")).filter("q is not null and position is not null")


def degenerate(sheets: DataFrame) -> DataFrame:
    """Sheets whose answers are all the same."""
    positions = F.array_distinct(F.transform("answers", lambda x: x["position"]))
    return sheets.filter((F.size("answers") > 1) & (F.size(positions) == 1))


def seed_dedupe(sheets: DataFrame, key: list[str]) -> DataFrame:
    """The first sheet (lowest id) of each key and seed; sheets without a seed all stay."""
    w = Window.partitionBy(*key, "seed").orderBy("sheet_id")
    return sheets.withColumn("_n", F.row_number().over(w)).filter("_n = 1 or seed is null").drop("_n")


def modal(ans: DataFrame, key: list[str]) -> DataFrame:
    """Most frequent position of each item in each cell, the lower on a tie."""
    counts = ans.groupBy(*key, "q", "position").agg(F.count("*").alias("n"))
    return counts.groupBy(*key, "q").agg(F.max_by("position", F.struct("n", -F.col("position"))).alias("modal"), F.sum("n").alias("n"))


def distances(cells: DataFrame, hold: list[str], factor: str, value: str = "modal") -> DataFrame:
    """Side flips and endpoint change over shared items, for each unordered pair of levels of
    ``factor`` with ``hold`` fixed. An equality join on ``hold`` and item; levels differ by <."""
    a = cells.select(*hold, "q", F.col(factor).alias("a"), F.col(value).alias("x"))
    b = cells.select(*hold, "q", F.col(factor).alias("b"), F.col(value).alias("y"))
    both = a.join(b, [*hold, "q"]).filter("a < b")
    gained = F.count_if(~endpoint(F.col("x")) & endpoint(F.col("y")))
    lost = F.count_if(endpoint(F.col("x")) & ~endpoint(F.col("y")))
    return both.groupBy(*hold, "a", "b").agg(F.count("*").alias("shared"), F.count_if(side(F.col("x")) != side(F.col("y"))).alias("side_flips"), F.abs(gained - lost).alias("endpoint_delta"))


def replicate_distances(ans: DataFrame, hold: list[str]) -> DataFrame:
    """(*hold, side_flips, endpoint_delta, n): how many unordered pairs of sheets of a cell
    lie at each distance, over the items both answered (pairs without one do not count).

    A sheet becomes three integers (items answered, agreed with, at an end), equal sheets of a
    cell become one row with its count, and only distinct ones are paired. Items are numbered
    0 to 62; :func:`distances` takes any.
    """
    bit = lambda on: F.coalesce(F.bit_or(F.when(on, F.expr("shiftleft(1L, q)"))), F.lit(0).cast("bigint"))
    sheets = ans.groupBy(*hold, "sheet_id").agg(bit(F.lit(True)).alias("k"), bit(side(F.col("position"))).alias("a"), bit(endpoint(F.col("position"))).alias("e"))
    one = sheets.groupBy(*hold, "k", "a", "e").agg(F.count("*").alias("m"))
    x, y = one.select(*hold, F.struct("k", "a", "e").alias("x"), F.col("m").alias("mx")), one.select(*hold, F.struct("k", "a", "e").alias("y"), F.col("m").alias("my"))
    both = x.join(y, hold).filter("x < y").filter("x.k & y.k <> 0")
    ends = "bit_count(~x.e & y.e & x.k & y.k) - bit_count(x.e & ~y.e & x.k & y.k)"
    between = both.select(*hold, F.expr("cast(bit_count((x.a ^ y.a) & x.k & y.k) as bigint)").alias("side_flips"), F.expr(f"cast(abs({ends}) as bigint)").alias("endpoint_delta"), (F.col("mx") * F.col("my")).alias("n"))
    zero = F.lit(0).cast("bigint")
    same = one.filter("m > 1").dropna(subset=hold).select(*hold, zero.alias("side_flips"), zero.alias("endpoint_delta"), F.expr("m * (m - 1) div 2").alias("n"))
    return between.unionByName(same).groupBy(*hold, "side_flips", "endpoint_delta").agg(F.sum("n").alias("n"))


def at_ranks(hist: DataFrame, by: list[str], value: str, ranks: dict[str, str], weight: str = "n") -> DataFrame:
    """(*by, total, one column for each rank): the value at ranks (1-based SQL expressions of
    ``total``) of a histogram; null where ``total`` has no such rank. Sorts distinct values
    only, however many there are of each."""
    h = hist.groupBy(*by, value).agg(F.sum(weight).alias("_n"))
    h = h.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by).orderBy(value))).withColumn("total", F.sum("_n").over(Window.partitionBy(*by)))
    at = [F.min(F.when((F.col("_upto") >= F.expr(r)) & (F.expr(r) > 0), F.col(value))).alias(k) for k, r in ranks.items()]
    return h.groupBy(*by).agg(F.coalesce(F.max("total"), F.lit(0).cast("bigint")).alias("total"), *at, F.max(value).alias("_max"))


def floor(pairs: DataFrame, name: str, weight: str | None = None) -> DataFrame:
    """One row: number of pairs; integer half-up median, p90 and maximum of both distances.

    Read off histograms of the distances (``weight``: how many pairs a row stands for).
    """
    hist = pairs.groupBy("side_flips", "endpoint_delta").agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    out = None
    for c in ("side_flips", "endpoint_delta"):
        r = at_ranks(hist, [], c, {"lo": "(total + 1) div 2", "hi": "total div 2 + 1", "p": "cast(floor(0.9 * total) as bigint)"})
        one = r.select(
            F.col("total").alias("n"), F.floor((F.col("lo") + F.col("hi")) / 2.0 + 0.5).cast("int").alias(f"{c}_median"),
            F.when(F.col("total") >= 10, F.col("p")).otherwise(F.col("_max")).alias(f"{c}_p90"), F.col("_max").alias(f"{c}_max"),
        )
        out = one if out is None else out.crossJoin(one.drop("n"))  # one row each
    return out.select(F.lit(name).alias("floor"), "*")


def pair_positions(ans: DataFrame, bank: DataFrame, key: list[str]) -> DataFrame:
    """Per key and mirrored pair: (critic - defender) / 2 around the midpoint, consistency
    (whether the halves fall on opposite sides), and whether both or neither were agreed to."""
    items = F.broadcast(bank.select(F.col("id").alias("q"), "pair_no", "frame"))
    halves = ans.join(items, "q").groupBy(*key, "pair_no").agg(
        F.max(F.when(F.col("frame") == "critic", F.col("position"))).alias("critic"), F.max(F.when(F.col("frame") == "defender", F.col("position"))).alias("defender")
    )
    both = halves.dropna(subset=["critic", "defender"])
    c, d = F.col("critic"), F.col("defender")
    return both.select(*key, "pair_no", "critic", "defender", ((c - d) / 2.0).alias("position"), ((c - 1.5) * (d - 1.5) < 0).alias("consistent"), (side(c) & side(d)).alias("agree_both"), (~side(c) & ~side(d)).alias("disagree_both"))


def acquiescence(pairs: DataFrame, key: list[str]) -> DataFrame:
    """(agreed to both - disagreed with both) / pairs."""
    return pairs.groupBy(*key).agg(((F.count_if("agree_both") - F.count_if("disagree_both")) / F.count("*")).alias("acquiescence"), F.avg(F.col("consistent").cast("double")).alias("consistency"), F.count("*").alias("pairs"))


def failure_class(n_answers: Column, tokens: Column, cap: Column, text: Column, ok: Column) -> Column:
    """Structural outcome of a sheet of 32 items: none, transport, budget-exhausted,
    truncated, refused or other. A sheet is at its cap from ten tokens below."""
    n, at_cap = F.coalesce(n_answers, F.lit(0)), F.coalesce(tokens >= cap - 10, F.lit(False))
    return F.when(~ok, "transport").when(n >= 32, "none").when((n == 0) & at_cap, "budget-exhausted").when(at_cap, "truncated").when((n == 0) & (F.length(F.trim(F.coalesce(text, F.lit("")))) > 0), "refused").otherwise("other")


def parse_sheet(text: Column) -> Column:
    """Lines ``N. option`` of a response as array<struct<q, position>>, decorations and case
    aside; a number on its own line takes the next line's option."""
    plain = F.regexp_replace(F.lower(text), r"[*_`]", "")
    folded = F.regexp_replace(plain, r"(?m)^([ \t]*[0-9]+[ \t]*[.):-])[ \t]*\n+[ \t]*", "$1 ")
    line = r"(?m)^[ \t]*([0-9]+)[ \t]*[.):-]+[ \t]*(strongly disagree|strongly agree|disagree|agree)[ \t.]*$"
    q, o = F.regexp_extract_all(folded, F.lit(line), 1), F.regexp_extract_all(folded, F.lit(line), 2)
    code = F.create_map(*[F.lit(x) for kv in zip(("strongly disagree", "disagree", "agree", "strongly agree"), range(4), strict=True) for x in kv])
    return F.transform(F.arrays_zip(q.alias("q"), o.alias("o")), lambda x: F.struct(x["q"].cast("int").alias("q"), code[x["o"]].alias("position")))
