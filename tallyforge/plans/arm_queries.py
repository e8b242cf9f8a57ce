"""Arms beside their floors, sensitivity, accounting and gates."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import stats
from tallyforge.functions import text as X
from tallyforge.operators import sheets as S
from tallyforge.plans.base import ANS, Registry, distance_sql, floor_sql, modal_sql, table
from tallyforge.plans.floor_queries import _FLOORS
from tallyforge.plans.inference_queries import _BH, CONTRASTS, _contrasts
from tallyforge.plans.inference_queries import DRAWS as _DRAWS
from tallyforge.plans.resample_queries import _POSITIONS, contrast_sql, positions
from tallyforge.plans.scored_queries import _ID, _models

R = Registry()
MC = f"cells AS ({modal_sql('model, condition')})"


def _answers(spark, d):
    return S.answers(table(spark, d, "sheets"))


def _union(frames):
    return functools.reduce(lambda a, b: a.unionByName(b), frames)


# --- floors of declared pairs and arms ------------------------------------------------------


@R.add(f"""WITH {ANS}, {MC}, pr AS (SELECT model AS quant, regexp_replace(model, '-(mini|thinking|[0-9]+b)$', '') AS base, regexp_extract(model, '-(mini|thinking|[0-9]+b)$', 1) AS label FROM (SELECT DISTINCT model FROM sheets) WHERE regexp_matches(model, '-(mini|thinking|[0-9]+b)$')),
  f AS (SELECT quant, x.condition, count(*) AS shared, count(*) FILTER (WHERE (x.modal >= 2) <> (y.modal >= 2)) AS flips FROM pr JOIN cells x ON x.model = base JOIN cells y ON y.model = quant AND y.condition = x.condition AND y.q = x.q GROUP BY quant, x.condition), h AS (SELECT DISTINCT model FROM cells)
  SELECT pr.label, pr.base, pr.quant, f.condition, f.shared, f.flips AS side_flips, CASE WHEN f.quant IS NOT NULL THEN 'pair' WHEN b.model IS NULL AND q.model IS NULL THEN 'silent' WHEN b.model IS NULL OR q.model IS NULL THEN 'half-pair' ELSE 'no shared condition' END AS status
  FROM pr LEFT JOIN f ON f.quant = pr.quant LEFT JOIN h b ON b.model = pr.base LEFT JOIN h q ON q.model = pr.quant""")
def requantisation_floor(spark, d):
    """Distance of each declared variant (a suffix of size, tier or mode) from its base, orders
    pooled; pairs with one half or none are rows with a reason."""
    end = r"-(mini|thinking|[0-9]+b)$"
    pr = table(spark, d, "sheets").select("model").distinct().filter(F.col("model").rlike(end)).select(F.col("model").alias("quant"), F.regexp_replace("model", end, "").alias("base"), F.regexp_extract("model", end, 1).alias("label"))
    cells = S.modal(_answers(spark, d), ["model", "condition"])
    x, y = cells.select(F.col("model").alias("base"), "condition", "q", F.col("modal").alias("x")), cells.select(F.col("model").alias("quant"), "condition", "q", F.col("modal").alias("y"))
    f = pr.join(x, "base").join(y, ["quant", "condition", "q"]).groupBy("quant", "condition").agg(F.count("*").alias("shared"), F.count_if((F.col("x") >= 2) != (F.col("y") >= 2)).alias("side_flips"))
    have = cells.select("model").distinct()
    b, q = have.select(F.col("model").alias("base"), F.lit(True).alias("hb")), have.select(F.col("model").alias("quant"), F.lit(True).alias("hq"))
    status = F.when(F.col("shared").isNotNull(), "pair").when(F.col("hb").isNull() & F.col("hq").isNull(), "silent").when(F.col("hb").isNull() | F.col("hq").isNull(), "half-pair").otherwise("no shared condition")
    return pr.join(f, "quant", "left").join(b, "base", "left").join(q, "quant", "left").select("label", "base", "quant", "condition", "shared", "side_flips", status.alias("status"))


_ARM = "CASE WHEN temperature = 0.7 THEN 'stock' WHEN temperature = 0.0 THEN 'treated-cold' ELSE 'treated-hot' END"
_ARMS = f"""{ANS}, aa AS (SELECT *, {_ARM} AS arm FROM ans), am AS (SELECT model, condition, arm, q, position AS modal FROM (SELECT model, condition, arm, q, position, row_number() OVER (PARTITION BY model, condition, arm, q ORDER BY count(*) DESC, position) AS r FROM aa GROUP BY model, condition, arm, q, position) WHERE r = 1),
  dp AS (SELECT model, condition, arm, count(DISTINCT coalesce(seed, -sheet_id)) AS depth FROM aa GROUP BY model, condition, arm)"""


def _arm_cells(spark, d):
    ans = _answers(spark, d).withColumn("arm", F.expr(_ARM))
    depth = ans.groupBy("model", "condition", "arm").agg(F.count_distinct(F.coalesce("seed", -F.col("sheet_id"))).alias("depth"))
    return S.modal(ans, ["model", "condition", "arm"]), depth


@R.add(f"""WITH {_ARMS}, f AS (SELECT x.model, x.condition, y.arm, count(*) AS shared, count(*) FILTER (WHERE (x.modal >= 2) <> (y.modal >= 2)) AS side_flips, abs(count(*) FILTER (WHERE x.modal NOT IN (0, 3) AND y.modal IN (0, 3)) - count(*) FILTER (WHERE x.modal IN (0, 3) AND y.modal NOT IN (0, 3))) AS endpoint_delta
  FROM am x JOIN am y ON x.model = y.model AND x.condition = y.condition AND x.q = y.q AND x.arm = 'stock' AND y.arm <> 'stock' GROUP BY x.model, x.condition, y.arm)
  SELECT f.*, s.depth AS sheets_stock, t.depth AS sheets_arm, CASE WHEN s.depth >= 4 AND t.depth >= 4 THEN 'counted' ELSE 'too few sheets' END AS status FROM f JOIN dp s ON s.model = f.model AND s.condition = f.condition AND s.arm = 'stock' JOIN dp t ON t.model = f.model AND t.condition = f.condition AND t.arm = f.arm""")
def treated_arms(spark, d):
    """Stock against each treated arm, modal by modal, under every condition; an arm needs four
    sheets of distinct seeds to count, others are named."""
    cells, depth = _arm_cells(spark, d)
    x = cells.filter("arm = 'stock'").select("model", "condition", "q", F.col("modal").alias("x"))
    y = cells.filter("arm <> 'stock'").select("model", "condition", "arm", "q", F.col("modal").alias("y"))
    gained, lost = F.count_if(~S.endpoint(F.col("x")) & S.endpoint(F.col("y"))), F.count_if(S.endpoint(F.col("x")) & ~S.endpoint(F.col("y")))
    f = x.join(y, ["model", "condition", "q"]).groupBy("model", "condition", "arm").agg(F.count("*").alias("shared"), F.count_if((F.col("x") >= 2) != (F.col("y") >= 2)).alias("side_flips"), F.abs(gained - lost).alias("endpoint_delta"))
    s, t = depth.filter("arm = 'stock'").select("model", "condition", F.col("depth").alias("sheets_stock")), depth.withColumnRenamed("depth", "sheets_arm")
    return f.join(s, ["model", "condition"]).join(t, ["model", "condition", "arm"]).withColumn("status", F.when((F.col("sheets_stock") >= 4) & (F.col("sheets_arm") >= 4), "counted").otherwise("too few sheets"))


@R.add(f"""WITH {_ARMS}, p AS (SELECT x.model, x.condition, x.arm AS a, y.arm AS b, count(*) FILTER (WHERE (x.modal >= 2) <> (y.modal >= 2)) AS flips FROM am x JOIN am y ON x.model = y.model AND x.condition = y.condition AND x.q = y.q AND x.arm < y.arm GROUP BY ALL),
  pn AS (SELECT x.model, x.arm, count(*) FILTER (WHERE (x.modal >= 2) <> (y.modal >= 2)) AS flips FROM am x JOIN am y ON x.model = y.model AND x.arm = y.arm AND x.q = y.q AND x.condition = 'P' AND y.condition = 'D' GROUP BY ALL),
  rf AS (SELECT model, {_ARM} AS arm, count(*) FILTER (WHERE failure_mode = 'refused') AS x FROM sheets WHERE condition = 'A' GROUP BY ALL)
  SELECT 'treated by treated' AS step, count(*) AS cells, CAST(sum(flips) AS BIGINT) AS total FROM p WHERE a <> 'stock' AND b <> 'stock' UNION ALL SELECT 'refusals under A', count(*), CAST(sum(x) AS BIGINT) FROM rf UNION ALL SELECT 'stock by treated', count(*), CAST(sum(flips) AS BIGINT) FROM p WHERE a = 'stock' OR b = 'stock'
  UNION ALL SELECT 'prompt in stock', count(*), CAST(sum(flips) AS BIGINT) FROM pn WHERE arm = 'stock'""")
def treated_stages(spark, d):
    """The staged reading of an intervention: treated arms among themselves, refusals, stock
    against treated, and beside it what a prompt alone moves in the stock arm."""
    cells, _ = _arm_cells(spark, d)
    p = S.distances(cells, ["model", "condition"], "arm")
    pn = S.distances(cells.filter("condition in ('D', 'P')"), ["model", "arm"], "condition")
    rf = table(spark, d, "sheets").filter("condition = 'A'").groupBy("model", F.expr(_ARM).alias("arm")).agg(F.count_if(F.coalesce(F.col("failure_mode") == "refused", F.lit(False))).alias("x"))
    one = lambda df, step, col: df.agg(F.lit(step).alias("step"), F.count("*").alias("cells"), F.sum(col).cast("bigint").alias("total"))
    stock = (F.col("a") == "stock") | (F.col("b") == "stock")
    return _union([one(p.filter(~stock), "treated by treated", "side_flips"), one(rf, "refusals under A", "x"), one(p.filter(stock), "stock by treated", "side_flips"), one(pn.filter("arm = 'stock'"), "prompt in stock", "side_flips")])


@R.add(f"""WITH {ANS}, a AS (SELECT * FROM ans WHERE condition = 'A' AND template = 'T01'), cells AS (SELECT model, temperature, shuffle_seed, q, position AS modal FROM (SELECT model, temperature, shuffle_seed, q, position, row_number() OVER (PARTITION BY model, temperature, shuffle_seed, q ORDER BY count(*) DESC, position) AS r FROM a GROUP BY model, temperature, shuffle_seed, q, position) WHERE r = 1),
  pairs AS ({distance_sql('cells', ['model', 'temperature'], 'shuffle_seed')}) {floor_sql('pairs', 'presentation order')}""")
def presentation_order_floor(spark, d):
    """The order floor as registered: condition A, template T01, orders paired within model and
    temperature."""
    a = _answers(spark, d).filter("condition = 'A' and template = 'T01'")
    return S.floor(S.distances(S.modal(a, ["model", "temperature", "shuffle_seed"]), ["model", "temperature"], "shuffle_seed"), "presentation order")


_SAME = f"""ids AS (SELECT model, {_ID} FROM (SELECT DISTINCT model FROM sheets)), pr AS (SELECT x.model AS m1, y.model AS m2, CASE WHEN x.stem = y.stem AND x.version = y.version THEN 'same-version' WHEN x.stem = y.stem THEN 'successor' ELSE 'unrelated' END AS kind
  FROM ids x JOIN ids y ON x.vendor = y.vendor AND x.model < y.model)"""
_KINDS = f"""{ANS}, {MC}, {_SAME}, kf AS (SELECT kind, m1, m2, x.condition, count(*) FILTER (WHERE (x.modal >= 2) <> (y.modal >= 2)) AS flips FROM pr JOIN cells x ON x.model = m1 JOIN cells y ON y.model = m2 AND y.condition = x.condition AND y.q = x.q GROUP BY kind, m1, m2, x.condition)"""


def _kinds(spark, d):
    ids = _models(spark, d).join(table(spark, d, "sheets").select("model").distinct(), "model", "left_semi")
    x, y = ids.alias("x"), ids.alias("y")
    kind = F.expr("CASE WHEN x.stem = y.stem AND x.version = y.version THEN 'same-version' WHEN x.stem = y.stem THEN 'successor' ELSE 'unrelated' END")
    pr = x.join(y, F.expr("x.vendor = y.vendor and x.model < y.model")).select(F.col("x.model").alias("m1"), F.col("y.model").alias("m2"), kind.alias("kind"))
    cells = S.modal(_answers(spark, d), ["model", "condition"])
    a, b = cells.select(F.col("model").alias("m1"), "condition", "q", F.col("modal").alias("a")), cells.select(F.col("model").alias("m2"), "condition", "q", F.col("modal").alias("b"))
    return pr.join(a, "m1").join(b, ["m2", "condition", "q"]).groupBy("kind", "m1", "m2", "condition").agg(F.count_if((F.col("a") >= 2) != (F.col("b") >= 2)).alias("flips"))


@R.add(f"""WITH {_KINDS}, t AS (SELECT list_sort(list(flips))[least(floor(0.95 * count(*))::INT, count(*) - 1) + 1] AS p95 FROM kf WHERE kind = 'unrelated')
  SELECT m1, m2, condition, kind, flips, p95 AS threshold, flips > p95 AS clears FROM kf, t WHERE kind <> 'unrelated'""")
def version_clears_null(spark, d):
    """Related models' distances beside the 95% point of unrelated pairs of the same vendor."""
    k = _kinds(spark, d)
    t = S.at_ranks(k.filter("kind = 'unrelated'").withColumn("n", F.lit(1)), [], "flips", {"threshold": "least(cast(floor(0.95 * total) as bigint), total - 1) + 1"}).select("threshold")
    return k.filter("kind <> 'unrelated'").crossJoin(F.broadcast(t)).select("m1", "m2", "condition", "kind", "flips", "threshold", (F.col("flips") > F.col("threshold")).alias("clears"))


_PERM = 500


@R.add(f"""WITH {_KINDS}, nr AS (SELECT 'all' AS key, (kind <> 'unrelated')::INT AS g, flips AS value, row_number() OVER (ORDER BY m1, m2, condition) AS i FROM kf), sz AS (SELECT sum(g) AS na, count(*) AS n, avg(value) FILTER (WHERE g = 1) - avg(value) FILTER (WHERE g = 0) AS seen FROM nr),
  sh AS (SELECT b, value, row_number() OVER (PARTITION BY b ORDER BY md5(concat_ws('|', '1', key, b, i)), i) AS r FROM (SELECT *, unnest(range(0, {_PERM})) AS b FROM nr)), df AS (SELECT b, any_value(seen) AS seen, avg(value) FILTER (WHERE r <= na) - avg(value) FILTER (WHERE r > na) AS dd FROM sh, sz WHERE na > 0 AND na < n GROUP BY b)
  SELECT ROUND(any_value(seen), 6) AS effect, ROUND((count(*) FILTER (WHERE abs(dd) >= abs(seen) - 1e-12) + 1) / (count(*) + 1.0), 6) AS p FROM df HAVING count(*) > 0""")
def related_pair_permutation(spark, d):
    """Whether related models lie nearer than unrelated ones of their vendor, by permutation."""
    from tallyforge.operators import resample as B

    k = _kinds(spark, d).withColumn("key", F.lit("all")).withColumn("g", F.col("kind") != "unrelated")
    r = B.permutation_p(k, "key", ["m1", "m2", "condition"], "g", "flips", _PERM)
    return r.select(F.round("effect", 6).alias("effect"), F.round("p", 6).alias("p"))


_CLR = f"""WITH {ANS}, {MC}, oc AS ({modal_sql('model, condition, template, shuffle_seed')}), op AS ({distance_sql('oc', ['model', 'condition', 'template'], 'shuffle_seed')}), fl AS ({floor_sql('op', 'order')}), n AS (SELECT model, q, modal FROM cells WHERE condition = 'N'),
  c AS (SELECT x.condition, x.model, count(*) FILTER (WHERE (x.modal >= 2) <> (n.modal >= 2)) AS flips, abs(count(*) FILTER (WHERE n.modal NOT IN (0, 3) AND x.modal IN (0, 3)) - count(*) FILTER (WHERE n.modal IN (0, 3) AND x.modal NOT IN (0, 3))) AS ends FROM cells x JOIN n ON n.model = x.model AND n.q = x.q WHERE x.condition <> 'N' GROUP BY x.condition, x.model),
  m AS (SELECT condition, count(*) AS models, CAST(floor(median(flips) + 0.5) AS INTEGER) AS side_median, CAST(floor(median(ends) + 0.5) AS INTEGER) AS endpoint_median FROM c GROUP BY condition)
  SELECT condition, models, side_median, endpoint_median, CAST(side_flips_p90 AS BIGINT) AS side_floor, CAST(endpoint_delta_p90 AS BIGINT) AS endpoint_floor, coalesce(side_median > side_flips_p90 AND endpoint_median > endpoint_delta_p90, false) AS clears FROM m, fl"""


@R.add(_CLR)
def clearing_rule(spark, d):
    """An instruction clears if the medians of both its distances exceed the order floor's p90."""
    ans = _answers(spark, d)
    fl = S.floor(S.distances(S.modal(ans, ["model", "condition", "template", "shuffle_seed"]), ["model", "condition", "template"], "shuffle_seed"), "order").select(F.col("side_flips_p90").cast("bigint").alias("side_floor"), F.col("endpoint_delta_p90").cast("bigint").alias("endpoint_floor"))
    cells = S.modal(ans, ["model", "condition"])
    both = cells.filter("condition <> 'N'").join(cells.filter("condition = 'N'").select("model", "q", F.col("modal").alias("was")), ["model", "q"])
    x, n = S.endpoint(F.col("modal")), S.endpoint(F.col("was"))
    c = both.groupBy("condition", "model").agg(F.count_if((F.col("modal") >= 2) != (F.col("was") >= 2)).alias("flips"), F.abs(F.count_if(~n & x) - F.count_if(n & ~x)).alias("ends"))
    m = c.groupBy("condition").agg(F.count("*").alias("models"), stats.half_up_median(F.col("flips")).alias("side_median"), stats.half_up_median(F.col("ends")).alias("endpoint_median"))
    return m.crossJoin(F.broadcast(fl)).withColumn("clears", F.coalesce((F.col("side_median") > F.col("side_floor")) & (F.col("endpoint_median") > F.col("endpoint_floor")), F.lit(False)))


_RUNG = f"""{_POSITIONS}, sm AS (SELECT sp.model, sp.condition, sp.sheet_id, s.run_no, s.shuffle_seed, s.provider IS DISTINCT FROM s.provider_pinned AND s.provider_pinned IS NOT NULL AS off, avg(sp.x) AS x FROM sp JOIN sheets s USING (sheet_id) GROUP BY ALL),
  e AS (SELECT model, avg(x) FILTER (WHERE condition = 'A') - avg(x) FILTER (WHERE condition = 'N') AS effect, avg(x) FILTER (WHERE condition = 'A' AND run_no <= 3) - avg(x) FILTER (WHERE condition = 'N' AND run_no <= 3) AS first_half, avg(x) FILTER (WHERE condition = 'A' AND run_no > 3) - avg(x) FILTER (WHERE condition = 'N' AND run_no > 3) AS second_half,
  count(*) FILTER (WHERE off) AS off_pin, count(*) FILTER (WHERE condition = 'A') AS treated, count(*) FILTER (WHERE condition = 'N') AS reference FROM sm WHERE condition IN ('A', 'N') GROUP BY model),
  o AS (SELECT model, max(x) - min(x) AS spread FROM (SELECT model, shuffle_seed, avg(x) AS x FROM sm WHERE condition = 'N' AND shuffle_seed IS NOT NULL GROUP BY model, shuffle_seed) GROUP BY model HAVING count(*) > 1)"""


@R.add(f"""WITH {_RUNG} SELECT e.model, treated, reference, ROUND(effect, 6) + 0.0 AS effect, ROUND(first_half, 6) + 0.0 AS first_half, ROUND(second_half, 6) + 0.0 AS second_half, ROUND(spread, 6) AS order_floor, off_pin, coalesce(sign(ROUND(first_half, 9)) = sign(ROUND(second_half, 9)), false) AS replicates, coalesce(abs(effect) > spread, false) AS exceeds_floor FROM e LEFT JOIN o ON o.model = e.model WHERE effect IS NOT NULL""")
def within_rung(spark, d):
    """Treated less reference on sheet means, in early and late runs apart, beside the model's
    own spread between orders and its off-pin sheets."""
    return _rung(spark, d).selectExpr("model", "treated", "reference", *[f"ROUND({c}, 6) + 0.0 AS {c}" for c in ("effect", "first_half", "second_half")], "ROUND(spread, 6) AS order_floor", "off_pin", "replicates", "exceeds_floor")


def _sheet_means(spark, d):
    p = positions(spark, d, ["sheet_id", "model", "condition"]).groupBy("model", "condition", "sheet_id").agg(F.avg("position").alias("x"))
    off = F.col("provider_pinned").isNotNull() & ~F.col("provider").eqNullSafe(F.col("provider_pinned"))
    return p.join(table(spark, d, "sheets").select("sheet_id", "run_no", "shuffle_seed", off.alias("off")), "sheet_id")


def _rung(spark, d):
    sm = _sheet_means(spark, d)
    at = lambda c, on=None: F.avg(F.when((F.col("condition") == c) & (F.expr(on) if on else F.lit(True)), F.col("x")))
    gap = lambda on=None: at("A", on) - at("N", on)
    e = sm.filter("condition in ('A', 'N')").groupBy("model").agg(gap().alias("effect"), gap("run_no <= 3").alias("first_half"), gap("run_no > 3").alias("second_half"), F.count_if("off").alias("off_pin"), F.count_if(F.col("condition") == "A").alias("treated"), F.count_if(F.col("condition") == "N").alias("reference"))
    o = sm.filter("condition = 'N' and shuffle_seed is not null").groupBy("model", "shuffle_seed").agg(F.avg("x").alias("x")).groupBy("model").agg((F.max("x") - F.min("x")).alias("spread"), F.count("*").alias("k")).filter("k > 1").drop("k")
    return e.join(o, "model", "left").filter("effect is not null").withColumn("replicates", F.expr("coalesce(sign(ROUND(first_half, 9)) = sign(ROUND(second_half, 9)), false)")).withColumn("exceeds_floor", F.expr("coalesce(abs(effect) > spread, false)"))


@R.add()
def within_rung_reportable(spark, d):
    """:func:`within_rung` with the exact permutation p and its step-up survivors; a contrast is
    reportable if it survives, replicates, exceeds its floor and has no off-pin sheet. (Exact
    enumeration has no SQL; p is null beyond twelve sheets an arm.)"""
    from tallyforge.operators import resample as B

    u = _sheet_means(spark, d).filter("condition in ('A', 'N')").withColumn("g", F.col("condition") == "A")
    p = B.exact_permutation(u, "model", "g", "x").withColumnRenamed("key", "model")
    r = stats.bh_stepup(_rung(spark, d).join(p, "model", "left"), "p", ["model"])
    return r.withColumn("reportable", F.col("survives") & F.col("replicates") & F.col("exceeds_floor") & (F.col("off_pin") == 0))


# --- sensitivity and accounting --------------------------------------------------------------


def _medians_sql(answers: str, tag: str) -> str:
    parts = []
    for name, (hold, factor) in _FLOORS.items():
        key = ", ".join([*hold, factor])
        cells = f"SELECT {key}, q, position AS modal FROM (SELECT {key}, q, position, row_number() OVER (PARTITION BY {key}, q ORDER BY count(*) DESC, position) AS r FROM {answers} GROUP BY {key}, q, position) WHERE r = 1"
        parts.append(f"SELECT '{name}' AS floor, count(*) AS n_{tag}, CAST(floor(median(side_flips) + 0.5) AS INTEGER) AS median_{tag} FROM (WITH cells AS ({cells}) {distance_sql('cells', hold, factor)})")
    return " UNION ALL ".join(parts)


@R.add(f"""WITH {ANS}, full_ AS (SELECT ans.* FROM ans JOIN sheets USING (sheet_id) WHERE sheets.n_answers >= 32), a AS ({_medians_sql('ans', 'all')}), b AS ({_medians_sql('full_', 'complete')})
  SELECT a.floor, n_all, median_all, n_complete, median_complete, CASE WHEN n_all = 0 THEN 'absent' WHEN n_complete = 0 THEN 'new row' WHEN abs(median_all - median_complete) <= 1 THEN 'within one' ELSE 'MOVES' END AS verdict FROM a JOIN b ON a.floor = b.floor""")
def partial_sensitivity(spark, d):
    """Each floor with partial sheets and without them: what the partial ones move."""
    ans = _answers(spark, d)
    full = ans.join(table(spark, d, "sheets").filter("n_answers >= 32").select("sheet_id"), "sheet_id", "left_semi")

    def medians(a, tag):
        rows = [S.floor(S.distances(S.modal(a, [*hold, factor]), hold, factor), name).select("floor", F.col("n").alias(f"n_{tag}"), F.col("side_flips_median").alias(f"median_{tag}")) for name, (hold, factor) in _FLOORS.items()]
        return _union(rows)

    both = medians(ans, "all").join(medians(full, "complete"), "floor")
    verdict = F.when(F.col("n_all") == 0, "absent").when(F.col("n_complete") == 0, "new row").when(F.abs(F.col("median_all") - F.col("median_complete")) <= 1, "within one").otherwise("MOVES")
    return both.withColumn("verdict", verdict)


def _power_sql() -> str:
    parts = []
    for name, (hold, factor) in _FLOORS.items():
        key = ", ".join([*hold, factor])
        parts.append(f"""SELECT '{name}' AS floor, n AS pairs, threshold, (SELECT min(shift) FROM (SELECT shift, avg((least(side_flips + shift, 32) > threshold)::INT) AS power FROM x, (SELECT CAST(unnest(range(0, 33)) AS INTEGER) AS shift) GROUP BY shift) WHERE power >= 0.8) AS mde FROM
  (WITH cells AS ({modal_sql(key)}), x0 AS ({distance_sql('cells', hold, factor)}) SELECT list_sort(list(side_flips))[least(floor(0.95 * count(*))::INT, count(*) - 1) + 1] AS threshold, count(*) AS n FROM x0) t""".replace("FROM x,", f"FROM (WITH cells AS ({modal_sql(key)}) {distance_sql('cells', hold, factor)}) x,"))
    return " UNION ALL ".join(parts)


@R.add(f"WITH {ANS}, a AS ({_power_sql()}) SELECT floor, pairs, threshold, mde, CASE WHEN pairs = 0 THEN 'no pairs' WHEN pairs < 5 THEN 'too few pairs' WHEN floor(0.95 * pairs)::INT >= pairs - 1 THEN 'threshold is the maximum' WHEN mde IS NULL THEN 'no shift clears' ELSE 'computed' END AS caveat FROM a")
def power_inventory(spark, d):
    """Threshold and smallest detectable shift of every floor, with the first caveat that holds."""
    ans = _answers(spark, d)
    rows = []
    for name, (hold, factor) in _FLOORS.items():
        h = S.distances(S.modal(ans, [*hold, factor]), hold, factor).groupBy("side_flips").agg(F.count("*").alias("n"))
        t = S.at_ranks(h, [], "side_flips", {"threshold": "least(cast(floor(0.95 * total) as bigint), total - 1) + 1"}).select(F.col("total").alias("pairs"), "threshold")
        g = h.crossJoin(F.broadcast(t)).select("side_flips", "n", "threshold", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("shift")).groupBy("shift").agg((F.sum(F.when(F.least(F.col("side_flips") + F.col("shift"), F.lit(32)) > F.col("threshold"), F.col("n")).otherwise(0)) / F.sum("n")).alias("power"))
        rows.append(t.crossJoin(g.agg(F.min(F.when(F.col("power") >= 0.8, F.col("shift"))).alias("mde"))).select(F.lit(name).alias("floor"), "pairs", "threshold", "mde"))
    caveat = F.when(F.col("pairs") == 0, "no pairs").when(F.col("pairs") < 5, "too few pairs").when(F.expr("floor(0.95 * pairs) >= pairs - 1"), "threshold is the maximum").when(F.col("mde").isNull(), "no shift clears").otherwise("computed")
    return _union(rows).withColumn("caveat", caveat)


_CT = contrast_sql(_POSITIONS, CONTRASTS, _DRAWS)


@R.add(f"""WITH {_CT}, {_BH} SELECT contrast, count(*) AS tests, (SELECT count(*) FROM bh) AS family, count(*) FILTER (WHERE p <= 0.05) AS unadjusted, count(*) FILTER (WHERE p_adjusted <= 0.05) AS step_up, count(*) FILTER (WHERE p * (SELECT count(*) FROM bh) <= 0.05) AS bonferroni, CAST(ROUND(count(*) * 0.05, 6) AS DOUBLE) AS expected_by_chance FROM bh GROUP BY contrast""")
def family_accounting(spark, d):
    """How many tests the family holds, by contrast, and how many survive which adjustment."""
    c = _contrasts(spark, d).withColumn("family", F.count("*").over(Window.partitionBy()))
    return c.groupBy("contrast", "family").agg(F.count("*").alias("tests"), F.count_if(F.col("p") <= 0.05).alias("unadjusted"), F.count_if(F.col("p_adjusted") <= 0.05).alias("step_up"), F.count_if(F.col("p") * F.col("family") <= 0.05).alias("bonferroni"), F.round(F.count("*") * 0.05, 6).alias("expected_by_chance")).select("contrast", "tests", "family", "unadjusted", "step_up", "bonferroni", "expected_by_chance")


# --- dissociation ------------------------------------------------------------------------------

_WORDSQL = r"list_distinct(list_filter(string_split(lower(regexp_replace(coalesce(response_text, ''), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> ''))"
_PERFIRST = f"""fr AS (SELECT model, question_id, condition, score_classifier, response_text, {_WORDSQL} AS w FROM (SELECT *, row_number() OVER (PARTITION BY model, question_id, condition ORDER BY record_id) AS r FROM scored WHERE condition IN ('A', 'B')) WHERE r = 1),
  jp AS (SELECT x.model, CASE WHEN len(list_distinct(list_concat(x.w, y.w))) = 0 THEN 1.0 ELSE len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) END AS jac, len(y.w) - len(x.w) AS longer, y.score_classifier - x.score_classifier AS moved FROM fr x JOIN fr y ON x.model = y.model AND x.question_id = y.question_id AND x.condition = 'A' AND y.condition = 'B')"""


@R.add(f"""WITH {_PERFIRST}, m AS (SELECT model, count(*) AS pairs, avg(jac) AS jaccard, avg(longer) AS longer, avg(moved) AS moved FROM jp GROUP BY model)
  SELECT model, pairs, ROUND(jaccard, 6) AS jaccard, ROUND(longer, 6) AS longer, ROUND(moved, 6) + 0.0 AS stance_moved, CASE WHEN moved IS NULL THEN 'NEEDS-SCORE' WHEN jaccard >= 0.6 AND longer < 40 THEN 'UNINTERPRETABLE NULL' WHEN abs(ROUND(moved, 9)) >= 0.3 THEN 'MOVED STANCE' ELSE 'DISSOCIATION CONFIRMED' END AS verdict FROM m""")
def dissociation_verdicts(spark, d):
    """Whether texts were rewritten between the arms (word overlap under 0.6, or 40 words more)
    and, apart from that, whether the stance moved by 0.3."""
    w = Window.partitionBy("model", "question_id", "condition").orderBy("record_id")
    fr = table(spark, d, "scored").filter("condition in ('A', 'B')").withColumn("r", F.row_number().over(w)).filter("r = 1")
    words = F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(F.coalesce("response_text", F.lit("")), r"[^\p{L}\p{N}]+", " ")), " "), lambda x: x != ""))
    fr = fr.select("model", "question_id", "condition", F.col("score_classifier").alias("s"), words.alias("w"))
    x, y = fr.filter("condition = 'A'").drop("condition"), fr.filter("condition = 'B'").select("model", "question_id", F.col("s").alias("t"), F.col("w").alias("v"))
    p = x.join(y, ["model", "question_id"]).select("model", X.jaccard(F.col("w"), F.col("v")).alias("jac"), (F.size("v") - F.size("w")).alias("longer"), (F.col("t") - F.col("s")).alias("moved"))
    m = p.groupBy("model").agg(F.count("*").alias("pairs"), F.avg("jac").alias("jaccard"), F.avg("longer").alias("longer"), F.avg("moved").alias("moved"))
    verdict = F.when(F.col("moved").isNull(), "NEEDS-SCORE").when((F.col("jaccard") >= 0.6) & (F.col("longer") < 40), "UNINTERPRETABLE NULL").when(F.abs(F.round("moved", 9)) >= 0.3, "MOVED STANCE").otherwise("DISSOCIATION CONFIRMED")
    return m.select("model", "pairs", F.round("jaccard", 6).alias("jaccard"), F.round("longer", 6).alias("longer"), F.expr("ROUND(moved, 6) + 0.0").alias("stance_moved"), verdict.alias("verdict"))


# --- gates -------------------------------------------------------------------------------------

def _meta_sql() -> str:
    return " UNION ALL ".join(f"SELECT model, condition, '{c}' AS field, coalesce(CAST({c} AS VARCHAR), 'none') AS value FROM sheets" for c in ("max_tokens", "template", "instrument", "n_items"))


@R.add(f"""WITH f AS ({_meta_sql()}), s AS (SELECT model, field, condition, list_sort(list_distinct(list(value))) AS vs FROM f WHERE condition IN ('A', 'N') GROUP BY ALL)
  SELECT a.model, a.field, array_to_string(a.vs, ',') AS in_a, array_to_string(b.vs, ',') AS in_n, CASE WHEN a.vs = b.vs THEN 'match' ELSE 'differs' END AS status FROM s a JOIN s b ON a.model = b.model AND a.field = b.field AND a.condition = 'A' AND b.condition = 'N'""")
def arm_match(spark, d):
    """Metadata of two arms that must agree but for the declared intervention, field by field."""
    fields = ("max_tokens", "template", "instrument", "n_items")
    s = table(spark, d, "sheets").filter("condition in ('A', 'N')").select("model", "condition", F.explode(F.create_map(*[x for c in fields for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("none")))])).alias("field", "value"))
    v = s.groupBy("model", "field").agg(*[F.array_join(F.array_sort(F.collect_set(F.when(F.col("condition") == c, F.col("value")))), ",").alias(n) for c, n in (("A", "in_a"), ("N", "in_n"))], F.count_distinct("condition").alias("k"))
    return v.filter("k = 2").select("model", "field", "in_a", "in_n", F.when(F.col("in_a") == F.col("in_n"), "match").otherwise("differs").alias("status"))


@R.add("""WITH b AS (SELECT bundle_id, run, payload::JSON AS p FROM run_bundles WHERE json_valid(payload)), c AS (SELECT bundle_id, unnest(json_extract(p, '$.cells[*]')) AS c FROM b), k AS (SELECT bundle_id, count(DISTINCT json_extract_string(c, '$.model')) AS models FROM c GROUP BY bundle_id),
  x AS (SELECT b.bundle_id, b.run, CAST(json_extract_string(p, '$.run.manifest.models.attempted') AS INTEGER) AS attempted, CAST(json_extract_string(p, '$.run.manifest.models.completed') AS INTEGER) AS completed, coalesce(models, 0) AS received FROM b LEFT JOIN k ON k.bundle_id = b.bundle_id)
  SELECT *, CASE WHEN attempted IS NULL THEN 'no manifest' WHEN received = attempted THEN 'match' WHEN received = completed THEN 'completed only' ELSE 'differs' END AS status FROM x""")
def manifest_vs_received(spark, d):
    """Models that a run's manifest names beside those its bundle holds."""
    p = table(spark, d, "run_bundles").select("bundle_id", "run", F.try_parse_json("payload").alias("p")).filter("p is not null")
    num = lambda f: F.expr(f"try_variant_get(p, '$.run.manifest.models.{f}', 'int')").alias(f)
    models = F.expr("cast(size(array_distinct(filter(transform(coalesce(try_variant_get(p, '$.cells', 'array<variant>'), array()), c -> try_variant_get(c, '$.model', 'string')), m -> m is not null))) as bigint)")
    x = p.select("bundle_id", "run", num("attempted"), num("completed"), models.alias("received"))
    return x.withColumn("status", F.when(F.col("attempted").isNull(), "no manifest").when(F.col("received") == F.col("attempted"), "match").when(F.col("received") == F.col("completed"), "completed only").otherwise("differs"))


_PLANNED = ("A-N", "P-N", "C-P", "E-N")


@R.add(f"""WITH {_CT}, pl(contrast) AS (VALUES {', '.join(f"('{c}')" for c in _PLANNED)}), f AS (SELECT contrast, count(*) AS n FROM ct GROUP BY contrast)
  SELECT pl.contrast, coalesce(n, 0) AS rows, CASE WHEN n IS NULL THEN 'not computable' ELSE 'computable' END AS status FROM pl LEFT JOIN f ON f.contrast = pl.contrast""")
def outcomes_computable(spark, d):
    """Every planned contrast must yield rows; a planned kind that no query yields is named."""
    planned = spark.createDataFrame([(c,) for c in _PLANNED], "contrast string")
    found = _contrasts(spark, d).groupBy("contrast").agg(F.count("*").alias("n"))
    return planned.join(found, "contrast", "left").select("contrast", F.coalesce("n", F.lit(0)).alias("rows"), F.when(F.col("n").isNull(), "not computable").otherwise("computable").alias("status"))


_GATES = {
    "unknown condition": ("scored", "condition NOT IN ('A', 'B', 'C', 'D', 'E', 'N', 'P', 'B-prime', 'B-Layered')"),
    "score out of range": ("scored", "score_classifier IS NOT NULL AND (score_classifier < 1 OR score_classifier > 5)"),
    "scored without text": ("scored", "score_classifier IS NOT NULL AND (response_text IS NULL OR NOT {rx}(response_text, '[^ \\t\\r\\n]'))"),
    "over the cap": ("scored", "tokens_out > max_tokens"),
    "valid sheet without answers": ("sheets", "valid AND coalesce(n_answers, 0) = 0"),
    "count of answers wrong": ("sheets", "n_answers IS NOT NULL AND n_answers <> {size}(answers)"),
    "off pin": ("sheets", "provider_pinned IS NOT NULL AND provider <> provider_pinned"),
}
"""Gates by name: the table and the rows that break them."""


_GATE_SQL = " UNION ALL ".join(f"SELECT '{k}' AS gate, '{t}' AS source, count(*) AS checked, count(*) FILTER (WHERE {c.format(size='len', rx='regexp_matches')}) AS broken FROM {t}" for k, (t, c) in _GATES.items())


@R.add(f"SELECT gate, source, checked, broken, CASE WHEN broken = 0 THEN 'pass' ELSE 'fail' END AS status FROM ({_GATE_SQL})")
def gate_report(spark, d):
    """All registered row gates in one pass over each table."""
    out = []
    for t in dict.fromkeys(t for t, _ in _GATES.values()):
        mine = {k: c for k, (s, c) in _GATES.items() if s == t}
        agg = table(spark, d, t).agg(F.count("*").alias("checked"), *[F.count_if(F.coalesce(F.expr(c.format(size="size", rx="regexp_like")), F.lit(False))).alias(k) for k, c in mine.items()])
        out.append(agg.select("checked", F.explode(F.create_map(*[x for k in mine for x in (F.lit(k), F.col(f"`{k}`"))])).alias("gate", "broken")).select("gate", F.lit(t).alias("source"), "checked", "broken"))
    return _union(out).withColumn("status", F.when(F.col("broken") == 0, "pass").otherwise("fail"))


QUERIES, SQL = R.queries, R.sql
