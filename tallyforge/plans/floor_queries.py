"""Composed floors, verdicts and calibrations."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import stats
from tallyforge.operators import resample as B
from tallyforge.operators import scored as C
from tallyforge.operators import sheets as S
from tallyforge.plans.base import ANS, JUDGED, Registry, distance_sql, floor_sql, modal_sql, table
from tallyforge.plans.resample_queries import _POS, boot_sql
from tallyforge.plans.scored_queries import _ID, _KEY, _PQ, ELIG, _elig, _models

R = Registry()
MC = f"cells AS ({modal_sql('model, condition')})"


def _answers(spark, d):
    return S.answers(table(spark, d, "sheets"))


def _modal(spark, d, key=("model", "condition")):
    return S.modal(_answers(spark, d), list(key))


def _positions(spark, d, key):
    return S.pair_positions(_answers(spark, d), table(spark, d, "item_bank"), key)


_FLOORS = {"order": (["model", "condition", "template"], "shuffle_seed"), "paraphrase": (["model", "condition"], "template"), "condition": (["model"], "condition"), "serving": (["model", "condition"], "channel")}


def _floor_sql(name: str) -> str:
    hold, factor = _FLOORS[name]
    key = ", ".join([*hold, factor])
    return f"SELECT * FROM (WITH cells AS ({modal_sql(key)}), pairs AS ({distance_sql('cells', hold, factor)}) {floor_sql('pairs', name)})"


@R.add(f"WITH {ANS}, a AS ({' UNION ALL '.join(_floor_sql(n) for n in _FLOORS)}) SELECT floor, n, side_flips_median, CAST(side_flips_p90 AS BIGINT) AS side_flips_p90, side_flips_max, CASE WHEN n = 0 THEN 'no pairs' WHEN n < 10 THEN 'p90 is the maximum' ELSE 'computed' END AS note FROM a")
def floor_registry(spark, d):
    ans = _answers(spark, d)
    rows = [S.floor(S.distances(S.modal(ans, [*hold, factor]), hold, factor), name) for name, (hold, factor) in _FLOORS.items()]
    a = functools.reduce(lambda x, y: x.unionByName(y), rows)
    return a.select("floor", "n", "side_flips_median", F.col("side_flips_p90").cast("bigint").alias("side_flips_p90"), "side_flips_max", F.when(F.col("n") == 0, "no pairs").when(F.col("n") < 10, "p90 is the maximum").otherwise("computed").alias("note"))


_SAME = f"""{ANS}, {MC}, ids AS (SELECT model, {_ID} FROM (SELECT DISTINCT model FROM sheets)), pr AS (SELECT x.model AS m1, y.model AS m2, CASE WHEN x.stem = y.stem AND x.version = y.version THEN 'same-version' WHEN x.stem = y.stem THEN 'successor' ELSE 'unrelated' END AS kind
  FROM ids x JOIN ids y ON x.vendor = y.vendor AND x.model < y.model)"""


@R.add(f"""WITH {_SAME}, f AS (SELECT kind, m1, m2, x.condition, count(*) AS shared, count(*) FILTER (WHERE (x.modal >= 2) <> (y.modal >= 2)) AS flips FROM pr JOIN cells x ON x.model = m1 JOIN cells y ON y.model = m2 AND y.condition = x.condition AND y.q = x.q GROUP BY kind, m1, m2, x.condition)
  SELECT kind, count(*) AS pairs, ROUND(avg(flips), 9) AS mean_flips, max(flips) AS most_flips FROM f GROUP BY kind""")
def version_drift(spark, d):
    ids = _models(spark, d).join(table(spark, d, "sheets").select("model").distinct(), "model", "left_semi")
    x, y = ids.alias("x"), ids.alias("y")
    kind = F.expr("CASE WHEN x.stem = y.stem AND x.version = y.version THEN 'same-version' WHEN x.stem = y.stem THEN 'successor' ELSE 'unrelated' END")
    pr = x.join(y, F.expr("x.vendor = y.vendor and x.model < y.model")).select(F.col("x.model").alias("m1"), F.col("y.model").alias("m2"), kind.alias("kind"))
    cells = _modal(spark, d)
    a = cells.select(F.col("model").alias("m1"), "condition", "q", F.col("modal").alias("a"))
    b = cells.select(F.col("model").alias("m2"), "condition", "q", F.col("modal").alias("b"))
    f = pr.join(a, "m1").join(b, ["m2", "condition", "q"]).groupBy("kind", "m1", "m2", "condition").agg(F.count_if((F.col("a") >= 2) != (F.col("b") >= 2)).alias("flips"))
    return f.groupBy("kind").agg(F.count("*").alias("pairs"), F.round(F.avg("flips"), 9).alias("mean_flips"), F.max("flips").alias("most_flips"))


_SHEETPOS = _POS.replace("AND condition IN ('A', 'N')", "")


@R.add(f"""WITH {_SHEETPOS}, o AS (SELECT sp.model, sp.condition, s.shuffle_seed, avg(x) AS x FROM sp JOIN sheets s USING (sheet_id) WHERE s.shuffle_seed IS NOT NULL GROUP BY sp.model, sp.condition, s.shuffle_seed)
  SELECT model, condition, count(*) AS orders, ROUND(max(x) - min(x), 9) AS spread FROM o GROUP BY model, condition HAVING count(*) > 1""")
def order_floor_positions(spark, d):
    p = _positions(spark, d, ["sheet_id", "model", "condition", "shuffle_seed"]).filter("shuffle_seed is not null")
    o = p.groupBy("model", "condition", "shuffle_seed").agg(F.avg("position").alias("x"))
    return o.groupBy("model", "condition").agg(F.count("*").alias("orders"), F.round(F.max("x") - F.min("x"), 9).alias("spread")).filter("orders > 1")


@R.add(f"""WITH {ANS}, self AS (SELECT model, condition, template, list_sort(list(side_flips))[count(*) // 2 + 1] AS own FROM ({distance_sql('ans', ['model', 'condition', 'template'], 'sheet_id', 'position')}) GROUP BY model, condition, template),
  cells AS ({modal_sql('model, condition, template')}), across AS ({distance_sql('cells', ['model', 'condition'], 'template')})
  SELECT c.model, c.condition, c.a, c.b, c.side_flips AS across, x.own AS own_a, y.own AS own_b, greatest(x.own, y.own) >= 0.5 * c.side_flips AS disqualified FROM across c JOIN self x ON x.model = c.model AND x.condition = c.condition AND x.template = c.a JOIN self y ON y.model = c.model AND y.condition = c.condition AND y.template = c.b""")
def elicitation_format(spark, d):
    ans = _answers(spark, d)
    own = S.at_ranks(S.replicate_distances(ans, ["model", "condition", "template"]), ["model", "condition", "template"], "side_flips", {"own": "total div 2 + 1"})
    c = S.distances(S.modal(ans, ["model", "condition", "template"]), ["model", "condition"], "template")
    side = lambda t: own.select("model", "condition", F.col("template").alias(t), F.col("own").alias(f"own_{t}"))
    j = c.join(side("a"), ["model", "condition", "a"]).join(side("b"), ["model", "condition", "b"])
    return j.select("model", "condition", "a", "b", F.col("side_flips").alias("across"), "own_a", "own_b", (F.greatest("own_a", "own_b") >= 0.5 * F.col("side_flips")).alias("disqualified"))


@R.add(f"""WITH {_SHEETPOS}, m AS (SELECT model, avg(x) FILTER (WHERE condition = 'A') AS a, avg(x) FILTER (WHERE condition = 'P') AS p, avg(x) FILTER (WHERE condition = 'N') AS n FROM sp GROUP BY model)
  SELECT count(*) AS models, count(*) FILTER (WHERE abs(a - n) > 0.25 AND abs(p - n) <= 0.25) AS instruction_only, count(*) FILTER (WHERE abs(a - n) > 0.25 AND abs(p - n) > 0.25) AS both_move, count(*) FILTER (WHERE abs(a - n) <= 0.25 AND abs(p - n) > 0.25) AS placebo_only FROM m WHERE a IS NOT NULL AND p IS NOT NULL AND n IS NOT NULL""")
def placebo_summary(spark, d):
    p = _positions(spark, d, ["sheet_id", "model", "condition"]).groupBy("model").agg(*[F.avg(F.when(F.col("condition") == c.upper(), F.col("position"))).alias(c) for c in "apn"]).dropna()
    ia, ip = F.abs(F.expr("a - n")) > 0.25, F.abs(F.expr("p - n")) > 0.25
    return p.agg(F.count("*").alias("models"), F.count_if(ia & ~ip).alias("instruction_only"), F.count_if(ia & ip).alias("both_move"), F.count_if(~ia & ip).alias("placebo_only"))


@R.add("""WITH s AS (SELECT model, coalesce(provider, 'unknown') AS provider, count(*) AS sheets, count(*) FILTER (WHERE failure_mode = 'refused') AS refused FROM sheets GROUP BY 1, 2)
  SELECT x.model, x.provider AS a, y.provider AS b, x.sheets AS sheets_a, y.sheets AS sheets_b, ROUND(x.refused / x.sheets - y.refused / y.sheets, 9) AS gap FROM s x JOIN s y ON x.model = y.model AND x.provider < y.provider""")
def serving_path(spark, d):
    s = table(spark, d, "sheets").groupBy("model", F.coalesce("provider", F.lit("unknown")).alias("provider")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("failure_mode") == "refused", F.lit(False))).alias("r"))
    return s.alias("x").join(s.alias("y"), F.expr("x.model = y.model and x.provider < y.provider")).selectExpr("x.model", "x.provider AS a", "y.provider AS b", "x.n AS sheets_a", "y.n AS sheets_b", "ROUND(x.r / x.n - y.r / y.n, 9) AS gap")


_HALF = "('0x' || substr(md5('7|' || CAST(sheet_id AS VARCHAR)), 1, 8))::BIGINT % 2"


@R.add(f"""WITH {_SHEETPOS}, h AS (SELECT model, condition, avg(x) FILTER (WHERE {_HALF} = 0) AS a, avg(x) FILTER (WHERE {_HALF} = 1) AS b, count(DISTINCT sheet_id) AS sheets FROM sp GROUP BY model, condition)
  SELECT model, condition, sheets, ROUND(a - b, 9) AS gap FROM h WHERE a IS NOT NULL AND b IS NOT NULL""")
def split_half(spark, d):
    half = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("7|"), F.col("sheet_id").cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(2))
    p = _positions(spark, d, ["sheet_id", "model", "condition"]).withColumn("h", half)
    g = p.groupBy("model", "condition").agg(*[F.avg(F.when(F.col("h") == i, F.col("position"))).alias(c) for i, c in enumerate("ab")], F.count_distinct("sheet_id").alias("sheets")).dropna()
    return g.select("model", "condition", "sheets", F.round(F.expr("a - b"), 9).alias("gap"))


_DROPS = "dr0 AS (SELECT s.sheet_id, len(list_filter(range(1, 33), lambda i: NOT list_contains(list_transform(s.answers, lambda x: x.q), i))) AS k FROM sheets s WHERE coalesce(n_answers, 0) BETWEEN 16 AND 31)"


@R.add(f"""WITH {_DROPS}, pl AS (SELECT b, q, count(*) AS n FROM (SELECT sheet_id, k, b, q, row_number() OVER (PARTITION BY sheet_id, b ORDER BY md5(concat_ws('|', '3', sheet_id, b, q)), q) AS r FROM (SELECT *, unnest(range(1, 33)) AS q FROM (SELECT *, unnest(range(0, 50)) AS b FROM dr0 WHERE k > 0))) WHERE r <= k GROUP BY b, q),
  mx AS (SELECT b, max(n) AS m FROM pl GROUP BY b), seen AS (SELECT max(n) AS m FROM (SELECT i, count(*) AS n FROM (SELECT unnest(list_filter(range(1, 33), lambda i: NOT list_contains(list_transform(answers, lambda x: x.q), i))) AS i FROM sheets WHERE coalesce(n_answers, 0) BETWEEN 16 AND 31) GROUP BY i))
  SELECT (SELECT m FROM seen) AS most_dropped, ROUND((count(*) FILTER (WHERE m >= (SELECT m FROM seen)) + 1) / (count(*) + 1.0), 9) AS p FROM mx""")
def concentration(spark, d):
    miss = table(spark, d, "sheets").filter(F.coalesce("n_answers", F.lit(0)).between(16, 31)).select("sheet_id", F.array_except(F.sequence(F.lit(1), F.lit(32)), F.transform("answers", lambda x: x["q"])).alias("m")).filter(F.size("m") > 0)
    seen = miss.select(F.explode("m").alias("q")).groupBy("q").agg(F.count("*").alias("n")).agg(F.max("n").alias("seen"))
    name = F.concat_ws("|", F.lit("3"), F.col("sheet_id").cast("string"), F.col("b").cast("string"), F.col("q").cast("string"))
    g = miss.select("sheet_id", F.size("m").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("b"))
    picked = g.select("sheet_id", "b", "k", F.explode(F.sequence(F.lit(1), F.lit(32))).alias("q")).withColumn("h", F.md5(name))
    picked = picked.groupBy("sheet_id", "b", "k").agg(F.sort_array(F.collect_list(F.struct("h", "q"))).alias("o")).select("b", F.explode(F.slice("o", F.lit(1), F.col("k"))).alias("x"))
    mx = picked.groupBy("b", "x.q").agg(F.count("*").alias("n")).groupBy("b").agg(F.max("n").alias("m"))
    return mx.join(F.broadcast(seen)).groupBy(F.col("seen").alias("most_dropped")).agg(F.round((F.count_if(F.col("m") >= F.col("seen")) + 1) / (F.count("*") + 1.0), 9).alias("p"))


@R.add(f"""WITH {ANS}, k AS (SELECT shuffle_seed, q, count(*) AS n FROM (SELECT s.shuffle_seed, unnest(list_filter(range(1, 33), lambda i: NOT list_contains(list_transform(s.answers, lambda x: x.q), i))) AS q FROM sheets s WHERE coalesce(n_answers, 0) BETWEEN 16 AND 31 AND shuffle_seed IS NOT NULL) GROUP BY shuffle_seed, q),
  i AS (SELECT count(*) FILTER (WHERE o >= 2) AS item_evidence, count(*) AS items FROM (SELECT q, count(*) AS o FROM k GROUP BY q)), s AS (SELECT count(*) FILTER (WHERE o >= 2) AS order_evidence FROM (SELECT shuffle_seed, count(*) AS o FROM k GROUP BY shuffle_seed))
  SELECT items, item_evidence, order_evidence, CASE WHEN item_evidence > 0 AND order_evidence > 0 THEN 'MIXED' WHEN item_evidence > 0 THEN 'ITEM' WHEN order_evidence > 0 THEN 'ORDER' ELSE 'NOT SEPARABLE' END AS verdict FROM i, s""")
def separation(spark, d):
    k = table(spark, d, "sheets").filter(F.coalesce("n_answers", F.lit(0)).between(16, 31) & F.col("shuffle_seed").isNotNull()).select("shuffle_seed", F.explode(F.array_except(F.sequence(F.lit(1), F.lit(32)), F.transform("answers", lambda x: x["q"]))).alias("q")).distinct()
    i = k.groupBy("q").agg(F.count("*").alias("o")).agg(F.count("*").alias("items"), F.count_if(F.col("o") >= 2).alias("item_evidence"))
    s = k.groupBy("shuffle_seed").agg(F.count("*").alias("o")).agg(F.count_if(F.col("o") >= 2).alias("order_evidence"))
    x = i.join(F.broadcast(s))
    return x.withColumn("verdict", F.when((F.col("item_evidence") > 0) & (F.col("order_evidence") > 0), "MIXED").when(F.col("item_evidence") > 0, "ITEM").when(F.col("order_evidence") > 0, "ORDER").otherwise("NOT SEPARABLE"))


_MM = "mm AS (SELECT 'all' AS k, model, ROUND(avg(score_classifier), 9) AS x, ROUND(avg(hedge_ratio), 9) AS y FROM scored GROUP BY model)"


@R.add(f"""WITH {_MM}, mk AS (SELECT * FROM mm WHERE x IS NOT NULL AND y IS NOT NULL), {boot_sql('mk', 'k', 'model', 'model', 100)}, cr AS (SELECT dr.b, corr(mk.x, mk.y) AS m FROM dr JOIN mk ON mk.model = dr.value GROUP BY dr.b)
  SELECT ROUND(list_sort(list(m))[3], 6) AS lo, ROUND(list_sort(list(m))[98], 6) AS hi, count(*) AS draws FROM cr""")
def correlation_bootstrap(spark, d):
    m = table(spark, d, "scored").groupBy("model").agg(F.round(F.avg("score_classifier"), 9).alias("x"), F.round(F.avg("hedge_ratio"), 9).alias("y")).dropna().withColumn("k", F.lit("all"))
    drawn = B.replicates(m, "k", ["model"], "model", 100, 1).withColumnRenamed("value", "model").join(m.select("model", "x", "y"), "model")
    s = drawn.groupBy("b").agg(F.corr("x", "y").alias("m")).agg(F.sort_array(F.collect_list("m")).alias("s"))
    return s.select(F.round(F.col("s")[2], 6).alias("lo"), F.round(F.col("s")[97], 6).alias("hi"), F.size("s").cast("bigint").alias("draws"))


@R.add(f"""WITH {_PQ}, m AS (SELECT model, avg(b - a) AS x, count(b - a) AS n, stddev_samp(b - a) AS s FROM pq GROUP BY model HAVING count(b - a) >= 2)
  SELECT model, ROUND(x, 9) AS effect, ROUND(1.96 * s / sqrt(n), 9) AS half_width, CASE WHEN s = 0 THEN 'degenerate' WHEN abs(x) + 1.96 * s / sqrt(n) < 1 THEN 'within margin' ELSE 'not excluded' END AS verdict FROM m""")
def equivalence_bounds(spark, d):
    q = C.pair_arms(C.replicate_means(table(spark, d, "scored"), _KEY), ["model", "question_id"], "condition", "mean_score", ["A", "B"]).withColumn("x", F.expr("B - A"))
    m = q.groupBy("model").agg(F.avg("x").alias("x"), F.count("x").alias("n"), F.stddev_samp("x").alias("s")).filter("n >= 2").withColumn("h", F.expr("1.96 * s / sqrt(n)"))
    return m.select("model", F.round("x", 9).alias("effect"), F.round("h", 9).alias("half_width"), F.when(F.col("s") == 0, "degenerate").when(F.abs("x") + F.col("h") < 1, "within margin").otherwise("not excluded").alias("verdict"))


@R.add(f"""WITH {ELIG} SELECT run, model, condition, count(*) FILTER (WHERE reason IS NULL AND score_classifier IS NOT NULL) AS eligible FROM elig GROUP BY run, model, condition ORDER BY eligible, run, model, condition LIMIT 15""")
def smallest_cells(spark, d):
    e = _elig(spark, d).groupBy("run", "model", "condition").agg(F.count_if(F.col("reason").isNull() & F.col("score_classifier").isNotNull()).alias("eligible"))
    return e.orderBy("eligible", "run", "model", "condition").limit(15)


@R.add(f"WITH {ELIG} SELECT coalesce(scoring_status, 'none') AS status, coalesce(reason, 'eligible') AS reason, count(*) AS n FROM elig GROUP BY 1, 2")
def release_tally(spark, d):
    return _elig(spark, d).groupBy(F.coalesce("scoring_status", F.lit("none")).alias("status"), F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


@R.add(f"""WITH {ELIG} SELECT 'strict' AS rule, count(*) FILTER (WHERE reason IS NULL OR score_classifier IS NULL) AS kept, count(*) FILTER (WHERE reason IS NOT NULL AND score_classifier IS NOT NULL) AS dropped FROM elig UNION ALL SELECT 'historical', count(*), 0 FROM elig""")
def soft_filter(spark, d):
    keep = F.col("reason").isNull() | F.col("score_classifier").isNull()
    e = _elig(spark, d).agg(F.count_if(keep).alias("k"), F.count_if(~keep).alias("x"), F.count("*").alias("n"))
    return e.select(F.explode(F.array(F.struct(F.lit("strict").alias("rule"), F.col("k").alias("kept"), F.col("x").alias("dropped")), F.struct(F.lit("historical").alias("rule"), F.col("n").alias("kept"), F.lit(0).cast("bigint").alias("dropped")))).alias("r")).select("r.*").withColumn("dropped", F.col("dropped"))


@R.add(f"""WITH {JUDGED}, f AS (SELECT record_id, median(score) AS panel, min(score)::DOUBLE AS lowest, max(score)::DOUBLE AS highest FROM judged GROUP BY record_id), m AS (SELECT record_id, 'panel' AS method, panel AS x FROM f UNION ALL SELECT record_id, 'lowest', lowest FROM f UNION ALL SELECT record_id, 'highest', highest FROM f UNION ALL SELECT record_id, 'stored', score_classifier FROM scored WHERE score_classifier IS NOT NULL)
  SELECT a.method AS a, b.method AS b, count(*) AS both_scored, ROUND(avg((a.x = b.x)::INT), 9) AS exact, ROUND(avg((abs(a.x - b.x) <= 1)::INT), 9) AS within_one, ROUND(avg(abs(a.x - b.x)), 9) AS mean_diff FROM m a JOIN m b ON a.record_id = b.record_id AND a.method < b.method GROUP BY a.method, b.method""")
def method_pairs(spark, d):
    """Every two registered scoring methods on the rows that both score."""
    m = C.method_scores(table(spark, d, "scored"), ["record_id"])
    x, y = m.select("record_id", F.col("method").alias("a"), F.col("score").alias("x")), m.select("record_id", F.col("method").alias("b"), F.col("score").alias("y"))
    u = x.join(y, "record_id").filter("a < b")
    gap = F.abs(F.col("x") - F.col("y"))
    return u.groupBy("a", "b").agg(F.count("*").alias("both_scored"), F.round(F.avg((gap == 0).cast("int")), 9).alias("exact"), F.round(F.avg((gap <= 1).cast("int")), 9).alias("within_one"), F.round(F.avg(gap), 9).alias("mean_diff"))


#: How a stance is framed in prose; strong forms beat plain ones.
_FRAMES = {"strongly agree": r"\bi (?:would )?(?:strongly|completely|fully) agree\b", "strongly disagree": r"\bi (?:would )?(?:strongly|completely|fully) disagree\b", "agree": r"\bi (?:would |tend to |somewhat )?agree\b", "disagree": r"\bi (?:would |tend to |somewhat )?disagree\b"}
_LABEL = r"^\W*((?:strongly )?(?:dis)?agree)\b"
_STANCE = f"""CASE WHEN response_text IS NULL THEN 'no-text' WHEN NOT regexp_matches(low, '[^ \\t\\r\\n]') THEN 'empty' WHEN regexp_matches(low, '{_LABEL}') THEN regexp_extract(low, '{_LABEL}', 1)
  WHEN regexp_matches(low, '{_FRAMES['strongly agree']}|{_FRAMES['agree']}') AND regexp_matches(low, '{_FRAMES['strongly disagree']}|{_FRAMES['disagree']}') THEN 'ambiguous' {' '.join(f"WHEN regexp_matches(low, '{p}') THEN '{k}'" for k, p in _FRAMES.items())} ELSE 'no-stance' END"""


@R.add(f"SELECT stance, count(*) AS n FROM (SELECT {_STANCE} AS stance FROM (SELECT response_text, lower(coalesce(response_text, '')) AS low FROM (SELECT response_text FROM scored UNION ALL SELECT text FROM item_bank))) GROUP BY stance")
def stance_codes(spark, d):
    """Stance of a text: a leading label, else a framed stance; both sides are ambiguous, and
    texts without one get a named failure code."""
    t = table(spark, d, "scored").select("response_text").unionAll(table(spark, d, "item_bank").select("text")).toDF("response_text")
    low = F.lower(F.coalesce("response_text", F.lit("")))
    label = F.regexp_extract(low, _LABEL, 1)
    both = low.rlike(f"{_FRAMES['strongly agree']}|{_FRAMES['agree']}") & low.rlike(f"{_FRAMES['strongly disagree']}|{_FRAMES['disagree']}")
    stance = F.when(F.col("response_text").isNull(), "no-text").when(~low.rlike(r"[^ \t\r\n]"), "empty").when(label != "", label).when(both, "ambiguous")
    for k, p in _FRAMES.items():
        stance = stance.when(low.rlike(p), k)
    return t.groupBy(stance.otherwise("no-stance").alias("stance")).agg(F.count("*").alias("n"))


@R.add(f"""WITH {ANS}, {MC}, v AS (SELECT split_part(model, '/', 1) AS vendor, i.ratchet IS NOT NULL AS tagged, modal - 1.5 AS x FROM cells JOIN item_bank i ON i.id = q)
  SELECT vendor, ROUND(avg(CASE WHEN tagged THEN x END) - avg(CASE WHEN NOT tagged THEN x END), 9) AS gap, count(*) AS cells FROM v GROUP BY vendor""")
def vendor_crossover(spark, d):
    items = F.broadcast(table(spark, d, "item_bank").select(F.col("id").alias("q"), F.col("ratchet").isNotNull().alias("tagged")))
    v = _modal(spark, d).join(items, "q").withColumn("x", F.col("modal") - 1.5)
    return v.groupBy(F.split("model", "/")[0].alias("vendor")).agg(F.round(F.avg(F.when(F.col("tagged"), F.col("x"))) - F.avg(F.when(~F.col("tagged"), F.col("x"))), 9).alias("gap"), F.count("*").alias("cells"))


@R.add("SELECT n, ROUND(2 / exp(lgamma(2 * n + 1) - 2 * lgamma(n + 1)), 6) AS min_p, 2 / exp(lgamma(2 * n + 1) - 2 * lgamma(n + 1)) <= 0.05 AS reachable FROM (SELECT CAST(unnest(range(1, 13)) AS BIGINT) AS n)")
def min_reachable_p(spark, d):
    rows = [(n, round(stats.min_reachable_p(n, n), 6), stats.min_reachable_p(n, n) <= 0.05) for n in range(1, 13)]
    return spark.createDataFrame(rows, "n bigint, min_p double, reachable boolean")


@R.add(f"""WITH {_SHEETPOS}, m AS (SELECT model, condition, avg((position_sign > 0)::INT) AS share, count(*) AS n FROM (SELECT *, sign(x) AS position_sign FROM sp) GROUP BY model, condition)
  SELECT model, condition, n, CASE WHEN share - 1.96 * sqrt(share * (1 - share) / n) > 0.5 THEN 'above' WHEN share + 1.96 * sqrt(share * (1 - share) / n) < 0.5 THEN 'below' ELSE 'chance' END AS verdict FROM m""")
def chance_verdicts(spark, d):
    m = _positions(spark, d, ["sheet_id", "model", "condition"]).groupBy("model", "condition").agg(F.avg((F.col("position") > 0).cast("int")).alias("s"), F.count("*").alias("n"))
    half = F.expr("1.96 * sqrt(s * (1 - s) / n)")
    return m.select("model", "condition", "n", F.when(F.col("s") - half > 0.5, "above").when(F.col("s") + half < 0.5, "below").otherwise("chance").alias("verdict"))


@R.add(f"WITH {ANS}, {MC}, x AS ({distance_sql('cells', ['model'], 'condition')}), w AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY side_flips DESC, a, b) AS r FROM x) SELECT model, a, b, side_flips FROM w WHERE r = 1")
def widest_contrast(spark, d):
    x = S.distances(_modal(spark, d), ["model"], "condition")
    return x.withColumn("r", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("side_flips"), "a", "b"))).filter("r = 1").select("model", "a", "b", "side_flips")


QUERIES, SQL = R.queries, R.sql
