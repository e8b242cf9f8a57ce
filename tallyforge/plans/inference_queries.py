"""Inference on contrasts: reports with intervals and multiplicity, predictions, nulls, power."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import stats
from tallyforge.operators import contrast as K
from tallyforge.operators import resample as B
from tallyforge.operators import sheets as S
from tallyforge.plans.base import ANS, Registry, distance_sql, modal_sql, table
from tallyforge.plans.resample_queries import _DELTAS, _POSITIONS, ROUNDED, _deltas, boot_sql, contrast_sql, positions

R = Registry()
CONTRASTS = [("A", "N"), ("P", "N"), ("C", "P")]
DRAWS = 500

_BH = """bh AS (SELECT *, min(raw) OVER (ORDER BY p, model, contrast ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p_adjusted
  FROM (SELECT *, least(1.0, p * count(*) OVER () / row_number() OVER (ORDER BY p, model, contrast)) AS raw FROM ct))"""
_REPORT = f"{contrast_sql(_POSITIONS, CONTRASTS, DRAWS)}, {_BH}"


def _contrasts(spark, d):
    c = K.sheet_contrasts(positions(spark, d, ["sheet_id", "model", "condition"]), CONTRASTS, DRAWS)
    return stats.bh_adjusted(c, "p", ["model", "contrast"])


@R.add(f"WITH {_REPORT} SELECT {', '.join(ROUNDED)}, ROUND(p_adjusted, 6) AS p_adjusted, p_adjusted <= 0.05 AS significant FROM bh")
def position_contrasts(spark, d):
    """Every contrast of every model with interval, p and its step-up adjusted p over the family."""
    return _contrasts(spark, d).selectExpr(*ROUNDED, "ROUND(p_adjusted, 6) AS p_adjusted", "p_adjusted <= 0.05 AS significant")


_CELLPOS = f"""ps AS (SELECT model || '#' || condition AS arm, model, condition, sheet_id, avg(x) AS x FROM sp GROUP BY model, condition, sheet_id), {boot_sql('ps', 'arm', 'sheet_id', 'x', DRAWS).replace('num AS', 'num2 AS').replace('dr AS', 'dr2 AS').replace('FROM num)', 'FROM num2)').replace('JOIN num ON num.key = d.key AND num.idx = d.idx', 'JOIN num2 num ON num.key = d.key AND num.idx = d.idx')},
  mb AS (SELECT key, b, ROUND(avg(value), 9) AS m FROM dr2 GROUP BY key, b), pi AS (SELECT key, list_sort(list(m)) AS s FROM mb GROUP BY key),
  pp AS (SELECT ps.model, ps.condition, count(*) AS sheets, avg(x) AS position, any_value(s)[{int(0.025 * DRAWS) + 1}] AS lo, any_value(s)[{int(0.975 * DRAWS) + 1}] AS hi FROM ps JOIN pi ON pi.key = ps.arm GROUP BY ps.model, ps.condition),
  cn AS (SELECT model, condition, avg(((critic - 1.5) * (defender - 1.5) < 0)::INT) AS consistent FROM (SELECT sheet_id, model, condition, c AS critic, dd AS defender FROM hv WHERE c IS NOT NULL AND dd IS NOT NULL) GROUP BY model, condition)"""


def _cells(spark, d):
    p = positions(spark, d, ["sheet_id", "model", "condition"])
    per = p.groupBy("model", "condition", "sheet_id").agg(F.avg("position").alias("x")).withColumn("arm", F.concat_ws("#", "model", "condition"))
    m = B.replicates(per, "arm", ["sheet_id"], "x", DRAWS, 1).groupBy("arm", "b").agg(F.round(F.avg("value"), 9).alias("m"))
    ci = B.interval(m, "arm", "m", DRAWS).select("arm", "lo", "hi")
    cells = per.groupBy("arm", "model", "condition").agg(F.count("*").alias("sheets"), F.avg("x").alias("position")).join(ci, "arm").drop("arm")
    return cells, p.groupBy("model", "condition").agg(F.avg(F.col("consistent").cast("int")).alias("consistent"))


@R.add(f"WITH {_POSITIONS}, {_CELLPOS} SELECT pp.model, pp.condition, sheets, ROUND(position, 6) + 0.0 AS position, ROUND(lo, 6) + 0.0 AS lo, ROUND(hi, 6) + 0.0 AS hi, ROUND(consistent, 6) AS consistent FROM pp JOIN cn ON cn.model = pp.model AND cn.condition = pp.condition")
def position_cells(spark, d):
    """Position of each cell with the interval of a sheet bootstrap, and its consistency."""
    cells, cons = _cells(spark, d)
    return cells.join(cons, ["model", "condition"]).selectExpr("model", "condition", "sheets", "ROUND(position, 6) + 0.0 AS position", "ROUND(lo, 6) + 0.0 AS lo", "ROUND(hi, 6) + 0.0 AS hi", "ROUND(consistent, 6) AS consistent")


@R.add(f"""WITH {_REPORT}, {_CELLPOS}, w AS (SELECT model, max(position) FILTER (WHERE condition = 'N') AS n, max(position) FILTER (WHERE condition = 'A') AS a, max(lo) FILTER (WHERE condition = 'N') AS lo, max(hi) FILTER (WHERE condition = 'N') AS hi FROM pp GROUP BY model),
  k AS (SELECT model, consistent FROM cn WHERE condition = 'N'), g AS (SELECT model, bool_or(p_adjusted <= 0.05) FILTER (WHERE contrast = 'A-N') AS f, bool_or(p_adjusted <= 0.05) FILTER (WHERE contrast = 'P-N') AS p, max(effect) FILTER (WHERE contrast = 'C-P') AS cp FROM bh GROUP BY model),
  x AS (SELECT w.*, f, p, cp, consistent FROM w LEFT JOIN g ON g.model = w.model LEFT JOIN k ON k.model = w.model),
  o AS (SELECT 1 AS n, count(*) FILTER (WHERE n IS NOT NULL AND a IS NOT NULL) AS models, count(*) FILTER (WHERE abs(a) < abs(n)) AS hits FROM x
  UNION ALL SELECT 2, count(*) FILTER (WHERE f IS NOT NULL AND p IS NOT NULL), count(*) FILTER (WHERE f AND NOT p) FROM x
  UNION ALL SELECT 3, count(n), least(count(*) FILTER (WHERE n > 0 AND lo > 0), count(*) FILTER (WHERE n < 0 AND hi < 0)) FROM x
  UNION ALL SELECT 4, count(*) FILTER (WHERE cp IS NOT NULL AND (lo > 0 OR hi < 0)), count(*) FILTER (WHERE cp IS NOT NULL AND (lo > 0 OR hi < 0) AND (cp > 0) = (n > 0)) FROM x
  UNION ALL SELECT 5, count(*) FILTER (WHERE abs(a - n) > 0.1), count(*) FILTER (WHERE abs(a - n) > 0.1 AND consistent >= 0.8) FROM x), pl AS (SELECT count(*) FILTER (WHERE p) AS placebo FROM x WHERE f IS NOT NULL AND p IS NOT NULL)
  SELECT o.n AS prediction, models, hits, ROUND(hits / nullif(models, 0), 6) AS rate, CASE o.n WHEN 1 THEN CASE WHEN models > 0 AND hits >= 0.75 * models THEN 'PASS' ELSE 'FAIL' END WHEN 2 THEN CASE WHEN placebo > 0 THEN 'FAIL' ELSE 'PASS' END
  WHEN 3 THEN CASE WHEN hits > 0 THEN 'PASS' ELSE 'FAIL' END WHEN 4 THEN CASE WHEN models = 0 THEN 'NOT TESTABLE' WHEN hits > 0.5 * models THEN 'PASS' ELSE 'FAIL' END ELSE CASE WHEN models > 0 AND hits = models THEN 'PASS' ELSE 'FAIL' END END AS verdict FROM o, pl""")
def prediction_scores(spark, d):
    """The five registered predictions as proportions: the instruction compresses the position
    (three models of four); the placebo does nothing by itself; signs differ between models; the
    control moves with the unprompted sign; models that move answer consistently."""
    cells, cons = _cells(spark, d)
    at = lambda c, v: F.max(F.when(F.col("condition") == c, F.col(v)))
    w = cells.groupBy("model").agg(at("N", "position").alias("n"), at("A", "position").alias("a"), at("N", "lo").alias("lo"), at("N", "hi").alias("hi"))
    on = lambda c, e: F.max(F.when(F.col("contrast") == c, e))
    g = _contrasts(spark, d).groupBy("model").agg(on("A-N", F.col("p_adjusted") <= 0.05).alias("f"), on("P-N", F.col("p_adjusted") <= 0.05).alias("p"), on("C-P", F.col("effect")).alias("cp"))
    x = w.join(g, "model", "left").join(cons.filter("condition = 'N'").select("model", "consistent"), "model", "left")
    n = lambda e: F.count_if(F.coalesce(F.expr(e), F.lit(False)))
    clear = "cp is not null and (lo > 0 or hi < 0)"
    tests = [
        ("n is not null and a is not null", n("abs(a) < abs(n)")), ("f is not null and p is not null", n("f and not p")),
        ("n is not null", F.least(n("n > 0 and lo > 0"), n("n < 0 and hi < 0"))), (clear, n(f"{clear} and (cp > 0) = (n > 0)")), ("abs(a - n) > 0.1", n("abs(a - n) > 0.1 and consistent >= 0.8")),
    ]
    agg = x.agg(F.array(*[F.struct(F.lit(i + 1).alias("prediction"), n(e).alias("models"), h.alias("hits")) for i, (e, h) in enumerate(tests)]).alias("t"), n("p and f is not null").alias("placebo"))
    verdict = """CASE prediction WHEN 1 THEN if(models > 0 AND hits >= 0.75 * models, 'PASS', 'FAIL') WHEN 2 THEN if(placebo > 0, 'FAIL', 'PASS') WHEN 3 THEN if(hits > 0, 'PASS', 'FAIL')
      WHEN 4 THEN CASE WHEN models = 0 THEN 'NOT TESTABLE' WHEN hits > 0.5 * models THEN 'PASS' ELSE 'FAIL' END ELSE if(models > 0 AND hits = models, 'PASS', 'FAIL') END"""
    return agg.select(F.explode("t").alias("t"), "placebo").select("t.*", "placebo").selectExpr("prediction", "models", "hits", "ROUND(try_divide(hits, models), 6) AS rate", f"{verdict} AS verdict")


_PAIRBOOT = f"""{_POSITIONS}, om AS (SELECT model, condition, pair_no, avg(x) AS x FROM sp GROUP BY model, condition, pair_no), pd AS (SELECT p.model, p.pair_no, ROUND(p.x - q.x, 9) AS delta FROM om p JOIN om q ON p.model = q.model AND p.pair_no = q.pair_no AND p.condition = 'A' AND q.condition = 'N'),
  {boot_sql('pd', 'model', 'pair_no', 'delta', DRAWS)}, ms AS (SELECT key, b, ROUND(avg(value), 9) AS m FROM dr GROUP BY key, b), ci AS (SELECT key, list_sort(list(m)) AS s FROM ms GROUP BY key)"""


@R.add(f"WITH {_PAIRBOOT} SELECT pd.model, count(*) AS n_pairs, ROUND(avg(delta), 6) + 0.0 AS effect, ROUND(any_value(s)[{int(0.025 * DRAWS) + 1}], 6) + 0.0 AS lo, ROUND(any_value(s)[{int(0.975 * DRAWS) + 1}], 6) + 0.0 AS hi, false AS calibrated FROM pd JOIN ci ON ci.key = pd.model GROUP BY pd.model")
def pair_contrast(spark, d):
    """The retired bootstrap over pairs, kept beside the sheet bootstrap and marked uncalibrated."""
    om = positions(spark, d, ["sheet_id", "model", "condition"]).groupBy("model", "pair_no").agg(*[F.avg(F.when(F.col("condition") == c, F.col("position"))).alias(c) for c in "AN"]).dropna()
    delta = om.select("model", "pair_no", F.round(F.expr("A - N"), 9).alias("delta"))
    m = B.replicates(delta, "model", ["pair_no"], "delta", DRAWS, 1).groupBy("model", "b").agg(F.round(F.avg("value"), 9).alias("m"))
    ci = B.interval(m, "model", "m", DRAWS)
    return delta.groupBy("model").agg(F.count("*").alias("n_pairs"), F.avg("delta").alias("effect")).join(ci, "model").selectExpr("model", "n_pairs", "ROUND(effect, 6) + 0.0 AS effect", "ROUND(lo, 6) + 0.0 AS lo", "ROUND(hi, 6) + 0.0 AS hi", "false AS calibrated")


_MD = f"""{_DELTAS}, md AS (SELECT 'all' AS k, model, ROUND(avg(delta), 9) AS x FROM u GROUP BY model), {boot_sql('md', 'k', 'model', 'x', 1000)}, ms AS (SELECT b, median(value) AS m FROM dr GROUP BY b), ci AS (SELECT list_sort(list(m)) AS s FROM ms)"""


@R.add(f"""WITH {_MD}, c AS (SELECT count(*) FILTER (WHERE x > 0) AS up, count(*) FILTER (WHERE x < 0) AS down, count(*) FILTER (WHERE x = 0) AS ties, median(x) AS med FROM md), lf AS (SELECT k, sum(ln(greatest(k, 1))) OVER (ORDER BY k) AS f FROM range(0, 10001) r(k)),
  t AS (SELECT sum(exp(n.f - a.f - b.f - (up + down) * ln(2))) AS tail FROM c JOIN lf a ON a.k <= least(up, down) JOIN lf n ON n.k = up + down JOIN lf b ON b.k = up + down - a.k)
  SELECT up, down, ties, ROUND(med, 6) AS median, ROUND(s[26], 6) AS lo, ROUND(s[976], 6) AS hi, ROUND(CASE WHEN up + down = 0 THEN 1.0 ELSE least(1.0, 2 * tail) END, 6) AS sign_p FROM c, ci, t WHERE up + down + ties > 0""")
def median_difference(spark, d):
    """Median over models of the arms' difference: bootstrap interval and, beside it, a sign test.
    No row without a model."""
    x = _deltas(spark, d).groupBy("model").agg(F.round(F.avg("delta"), 9).alias("x")).withColumn("k", F.lit("all"))
    m = B.replicates(x, "k", ["model"], "x", 1000, 1).groupBy("k", "b").agg(F.median("value").alias("m"))
    c = x.groupBy("k").agg(F.count_if(F.col("x") > 0).alias("up"), F.count_if(F.col("x") < 0).alias("down"), F.count_if(F.col("x") == 0).alias("ties"), F.median("x").alias("med"))
    return c.withColumn("p", stats.sign_test("up", "down")).join(B.interval(m, "k", "m", 1000).drop("p"), "k").selectExpr("up", "down", "ties", "ROUND(med, 6) AS median", "ROUND(lo, 6) AS lo", "ROUND(hi, 6) AS hi", "ROUND(p, 6) AS sign_p")


_ITEMS = f"""{ANS}, cells AS ({modal_sql('model, condition')}), a AS (SELECT model, q, modal FROM cells WHERE condition = 'A'), n AS (SELECT model, q, modal FROM cells WHERE condition = 'N'),
  it AS (SELECT 'all' AS k, a.q, count(*) AS pairs, count(*) FILTER (WHERE (a.modal >= 2) = (n.modal >= 2)) AS same FROM a JOIN n ON a.model = n.model AND a.q = n.q GROUP BY a.q)"""


@R.add(f"""WITH {_ITEMS}, {boot_sql('it', 'k', 'q', 'q', 1000)}, ms AS (SELECT dr.b, ROUND(sum(it.same) / sum(it.pairs), 9) AS m FROM dr JOIN it ON it.q = dr.value GROUP BY dr.b), ci AS (SELECT list_sort(list(m)) AS s FROM ms)
  SELECT (SELECT count(*) FROM it) AS items, (SELECT ROUND(sum(same) / sum(pairs), 6) FROM it) AS share, ROUND(s[26], 6) AS lo, ROUND(s[976], 6) AS hi FROM ci WHERE (SELECT count(*) FROM it) > 0""")
def item_bootstrap_share(spark, d):
    """Share of (model, item) cells that stay on their side under instruction, with an interval
    over resampled items: any aggregate of the drawn items can take the share's place. No row
    without a shared cell."""
    cells = S.modal(S.answers(table(spark, d, "sheets")), ["model", "condition"])
    both = cells.groupBy("model", "q").agg(*[F.max(F.when(F.col("condition") == c, F.col("modal"))).alias(c) for c in "AN"]).dropna()
    it = both.groupBy("q").agg(F.count("*").alias("pairs"), F.count_if((F.col("A") >= 2) == (F.col("N") >= 2)).alias("same")).withColumn("k", F.lit("all"))
    share = F.sum("same") / F.sum("pairs")
    ci = B.bootstrap_of(it, "k", ["q"], F.round(share, 9), 1000)
    return it.groupBy("k").agg(F.count("*").alias("items"), F.round(share, 6).alias("share")).join(ci, "k").selectExpr("items", "share", "ROUND(lo, 6) AS lo", "ROUND(hi, 6) AS hi")


_TOPICS = f"""tp AS (SELECT 'all' AS k, topic, count(score_classifier) FILTER (WHERE condition = 'A') AS na, coalesce(sum(score_classifier) FILTER (WHERE condition = 'A'), 0) AS sa, count(score_classifier) FILTER (WHERE condition = 'B') AS nb, coalesce(sum(score_classifier) FILTER (WHERE condition = 'B'), 0) AS sb
  FROM scored WHERE topic IS NOT NULL AND condition IN ('A', 'B') GROUP BY topic)"""


@R.add(f"""WITH {_TOPICS}, {boot_sql('tp', 'k', 'topic', 'topic', 1000)}, ms AS (SELECT dr.b, ROUND(sum(sb) / sum(nb) - sum(sa) / sum(na), 9) AS m FROM dr JOIN tp ON tp.topic = dr.value GROUP BY dr.b), ci AS (SELECT list_sort(list(m)) AS s FROM ms)
  SELECT count(*) AS clusters, ROUND(sum(sb) / sum(nb) - sum(sa) / sum(na), 6) AS difference, ROUND(any_value(s)[26], 6) AS lo, ROUND(any_value(s)[976], 6) AS hi FROM tp, ci""")
def topic_cluster_difference(spark, d):
    """Difference of the two arms' mean scores; topics are resampled and both arms take the
    same draw with its multiplicities."""
    s = table(spark, d, "scored").filter("topic is not null and condition in ('A', 'B')")
    of = lambda c: F.when(F.col("condition") == c, F.col("score_classifier"))
    tp = s.groupBy("topic").agg(*[e for c in "AB" for e in (F.count(of(c)).alias(f"n{c}"), F.coalesce(F.sum(of(c)), F.lit(0.0)).alias(f"s{c}"))]).withColumn("k", F.lit("all"))
    gap = F.try_divide(F.sum("sB"), F.sum("nB")) - F.try_divide(F.sum("sA"), F.sum("nA"))
    ci = B.bootstrap_of(tp, "k", ["topic"], F.round(gap, 9), 1000)
    return tp.groupBy("k").agg(F.count("*").alias("clusters"), F.round(gap, 6).alias("difference")).join(ci, "k").selectExpr("clusters", "difference", "ROUND(lo, 6) AS lo", "ROUND(hi, 6) AS hi")


_ARMPOS = f"""{_POSITIONS}, ap AS (SELECT sp.sheet_id, sp.model, sp.pair_no, sp.x, CASE WHEN s.renumbered THEN 'renumbered' ELSE 'plain' END || '#' || sp.condition AS condition FROM sp JOIN sheets s USING (sheet_id)),
  aq AS (SELECT *, model || '#' || condition AS arm FROM ap WHERE condition IN ('renumbered#C', 'renumbered#N', 'plain#C', 'plain#N'))"""


@R.add(f"""WITH {_ARMPOS}, st AS (SELECT DISTINCT arm, sheet_id FROM aq), {boot_sql('st', 'arm', 'sheet_id', 'sheet_id', DRAWS)}, pm AS (SELECT aq.model, aq.condition, dr.b, aq.pair_no, avg(aq.x) AS x FROM dr JOIN aq ON aq.sheet_id = dr.value AND aq.arm = dr.key GROUP BY ALL),
  w AS (SELECT model, b, pair_no, max(x) FILTER (WHERE condition = 'renumbered#C') AS ha, max(x) FILTER (WHERE condition = 'renumbered#N') AS hn, max(x) FILTER (WHERE condition = 'plain#C') AS la, max(x) FILTER (WHERE condition = 'plain#N') AS ln_ FROM pm GROUP BY ALL),
  e AS (SELECT model, b, ROUND(avg((ha - hn) - (la - ln_)), 9) AS m FROM w WHERE (ha - hn) - (la - ln_) IS NOT NULL GROUP BY model, b), ci AS (SELECT model, list_sort(list(m)) AS s, count(*) AS k, least(1.0, 2 * (least(count(*) FILTER (WHERE m <= 0), count(*) FILTER (WHERE m >= 0)) + 1) / (count(*) + 1)) AS p FROM e GROUP BY model),
  o AS (SELECT model, pair_no, avg(x) FILTER (WHERE condition = 'renumbered#C') AS ha, avg(x) FILTER (WHERE condition = 'renumbered#N') AS hn, avg(x) FILTER (WHERE condition = 'plain#C') AS la, avg(x) FILTER (WHERE condition = 'plain#N') AS ln_ FROM aq GROUP BY ALL),
  f AS (SELECT model, count(*) AS n_pairs, avg((ha - hn) - (la - ln_)) AS effect FROM o WHERE (ha - hn) - (la - ln_) IS NOT NULL GROUP BY model)
  SELECT f.model, n_pairs, ROUND(effect, 6) + 0.0 AS effect, ROUND(s[least(floor(0.025 * k)::INT, k - 1) + 1], 6) + 0.0 AS lo, ROUND(s[least(floor(0.975 * k)::INT, k - 1) + 1], 6) + 0.0 AS hi, ROUND(p, 6) AS p FROM f JOIN ci ON ci.model = f.model""")
def interaction(spark, d):
    """Difference of differences: what condition C moves in renumbered sheets of a model, less
    what it moves in the others, with a sheet bootstrap of all four cells."""
    p = positions(spark, d, ["sheet_id", "model", "condition"])
    arm = F.when(F.col("renumbered"), "renumbered").otherwise("plain").alias("numbering")
    p = p.join(table(spark, d, "sheets").select("sheet_id", arm), "sheet_id")
    x = K.interactions(p, "numbering", "renumbered", "plain", "C", "N", DRAWS)
    return x.selectExpr("model", "n_pairs", *[f"ROUND({c}, 6) + 0.0 AS {c}" for c in ("effect", "lo", "hi")], "ROUND(p, 6) AS p")


_SPLITS = 100
_RANK = "row_number() OVER (PARTITION BY arm, b ORDER BY md5(concat_ws('|', '7', arm, b, sheet_id)), sheet_id)"


@R.add(f"""WITH {_POSITIONS}, ps AS (SELECT model || '#' || condition AS arm, sheet_id, avg(x) AS x FROM sp GROUP BY model, condition, sheet_id), k AS (SELECT *, count(*) OVER (PARTITION BY arm) AS n FROM ps),
  h AS (SELECT arm, b, n, x, {_RANK} AS r FROM (SELECT *, unnest(range(0, {_SPLITS})) AS b FROM k WHERE n >= 6)), g AS (SELECT arm, b, n, avg(x) FILTER (WHERE r <= n // 2) AS a, avg(x) FILTER (WHERE r > n // 2) AS c, var_samp(x) FILTER (WHERE r <= n // 2) AS va, var_samp(x) FILTER (WHERE r > n // 2) AS vc, stddev_samp(x) AS sd FROM h GROUP BY arm, b, n),
  z AS (SELECT arm, n, sd < 0.02 AS degenerate, abs(ROUND(a - c, 9)) > ROUND(1.96 * sqrt(va / (n // 2) + vc / (n - n // 2)), 9) AS reject FROM g)
  SELECT arm, n AS sheets, count(*) AS splits, ROUND(avg(reject::INT), 6) AS reject_rate, bool_or(degenerate) AS degenerate FROM z GROUP BY arm, n""")
def split_half_rejects(spark, d):
    """How often the halves of one real cell (six sheets or more) differ significantly, over
    named splits: a contrast of nothing with nothing should reject in one of twenty."""
    ps = positions(spark, d, ["sheet_id", "model", "condition"]).withColumn("arm", F.concat_ws("#", "model", "condition")).groupBy("arm", "sheet_id").agg(F.avg("position").alias("x"))
    k = ps.withColumn("n", F.count("*").over(Window.partitionBy("arm"))).filter("n >= 6")
    h = k.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(_SPLITS - 1))))
    name = F.md5(F.concat_ws("|", F.lit("7"), "arm", F.col("b").cast("string"), F.col("sheet_id").cast("string")))
    h = h.withColumn("r", F.row_number().over(Window.partitionBy("arm", "b").orderBy(name, "sheet_id"))).withColumn("first", F.expr("r <= n div 2"))
    of = lambda f, on: f(F.when(F.col("first") == on, F.col("x")))
    g = h.groupBy("arm", "b", "n").agg(of(F.avg, True).alias("a"), of(F.avg, False).alias("c"), of(F.var_samp, True).alias("va"), of(F.var_samp, False).alias("vc"), F.stddev_samp("x").alias("sd"))
    z = g.selectExpr("arm", "n", "sd < 0.02 AS degenerate", "abs(ROUND(a - c, 9)) > ROUND(1.96 * sqrt(va / (n div 2) + vc / (n - n div 2)), 9) AS reject")
    return z.groupBy("arm", F.col("n").alias("sheets")).agg(F.count("*").alias("splits"), F.round(F.avg(F.col("reject").cast("int")), 6).alias("reject_rate"), F.bool_or("degenerate").alias("degenerate"))


_CX = f"{ANS}, cells AS ({modal_sql('model, condition')}), x AS ({distance_sql('cells', ['model'], 'condition')})"


@R.add(f"""WITH {_CX}, t AS (SELECT list_sort(list(side_flips))[least(floor(0.95 * count(*))::INT, count(*) - 1) + 1] AS threshold, count(*) AS n, floor(0.95 * count(*))::INT >= count(*) - 1 AS p95_is_max FROM x),
  g AS (SELECT shift, avg((least(side_flips + shift, 32) > threshold)::INT) AS power FROM x, t, (SELECT CAST(unnest(range(0, 33)) AS INTEGER) AS shift) GROUP BY shift)
  SELECT n AS pairs, threshold, p95_is_max, (SELECT min(shift) FROM g WHERE power >= 0.8) AS mde, CASE WHEN n < 5 THEN 'too few pairs' WHEN p95_is_max THEN 'threshold is the maximum' WHEN (SELECT min(shift) FROM g WHERE power >= 0.8) IS NULL THEN 'no shift clears' ELSE 'computed' END AS caveat FROM t""")
def mde_shift(spark, d):
    """Smallest integer shift, clipped at the instrument's 32 items, that clears the 95% point
    of the pairs' own distances in four of five cases; null where none does."""
    x = S.distances(S.modal(S.answers(table(spark, d, "sheets")), ["model", "condition"]), ["model"], "condition")
    h = x.groupBy("side_flips").agg(F.count("*").alias("n"))
    w = Window.partitionBy().orderBy("side_flips")
    h = h.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    rank = F.least(F.floor(F.lit(0.95) * F.col("all")), F.col("all") - 1) + 1
    t = h.groupBy("all").agg(F.min(F.when(F.col("upto") >= rank, F.col("side_flips"))).alias("threshold"))
    g = h.select("side_flips", "n", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("shift")).join(F.broadcast(t)).groupBy("shift", "all", "threshold").agg((F.sum(F.when(F.least(F.col("side_flips") + F.col("shift"), F.lit(32)) > F.col("threshold"), F.col("n")).otherwise(0)) / F.sum("n")).alias("power"))
    m = g.groupBy("all", "threshold").agg(F.min(F.when(F.col("power") >= 0.8, F.col("shift"))).alias("mde"))
    top = F.expr("floor(0.95 * all) >= all - 1")
    return m.select(F.col("all").alias("pairs"), "threshold", top.alias("p95_is_max"), "mde", F.when(F.col("all") < 5, "too few pairs").when(top, "threshold is the maximum").when(F.col("mde").isNull(), "no shift clears").otherwise("computed").alias("caveat"))


QUERIES, SQL = R.queries, R.sql
