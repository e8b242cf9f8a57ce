"""Queries that resample, with SQL that repeats their draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import stats
from tallyforge.operators import contrast as K
from tallyforge.operators import resample as B
from tallyforge.operators import scored as C
from tallyforge.operators import sheets as S
from tallyforge.plans.base import ANS, Registry, distance_sql, modal_sql, table
from tallyforge.plans.scored_queries import _KEY, _PQ

R = Registry()
REPS = 200


def draw_sql(key: str, n: str = "n", seed: int = 1) -> str:
    p = B.PRIME
    start = f"(('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8))::BIGINT + {seed * B.STEPS[0]} + b::BIGINT * {B.STEPS[1]} + i::BIGINT * {B.STEPS[2]}) % {p}"
    return f"list_reduce([{start}, {', '.join(map(str, B.ROUNDS))}], lambda x, c: ((x * x % {p}) * (x * x % {p}) % {p} * x + c) % {p}) % {n}"


def boot_sql(units: str, key: str, order: str, value: str, reps: int = REPS) -> str:
    """CTEs ``num`` (numbered units), ``dr`` (drawn values) of a bootstrap over ``units``."""
    return f"""num AS (SELECT {key} AS key, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS idx, {value} AS value, count(*) OVER (PARTITION BY {key}) AS n FROM {units}),
  dr AS (SELECT d.key, d.b, num.value FROM (SELECT key, b, {draw_sql('key')} AS idx FROM (SELECT key, n, idx AS i, unnest(range(0, {reps})) AS b FROM num)) d JOIN num ON num.key = d.key AND num.idx = d.idx)"""


_ENDS = f"list_sort(list(m))[{int(0.025 * REPS) + 1}] AS lo, list_sort(list(m))[{int(0.975 * REPS) + 1}] AS hi, least(1.0, 2.0 * least(count(*) FILTER (WHERE m <= 0), count(*) FILTER (WHERE m >= 0)) / count(*)) AS p"
_DELTAS = f"{_PQ}, u AS (SELECT model, question_id, ROUND(b - a, 9) AS delta FROM pq WHERE a IS NOT NULL AND b IS NOT NULL)"


def _deltas(spark, d):
    q = C.pair_arms(C.replicate_means(table(spark, d, "scored"), _KEY), ["model", "question_id"], "condition", "mean_score", ["A", "B"])
    return q.withColumn("delta", F.round(F.expr("B - A"), 9)).filter("delta is not null").select("model", "question_id", "delta")


@R.add(f"""WITH {_DELTAS}, {boot_sql('u', 'model', 'question_id', 'delta')}, ms AS (SELECT key, b, avg(value) AS m FROM dr GROUP BY key, b), ci AS (SELECT key, {_ENDS} FROM ms GROUP BY key)
  SELECT ci.key AS model, ROUND(avg(u.delta), 6) AS mean, ROUND(lo, 6) AS lo, ROUND(hi, 6) AS hi, count(*) AS n FROM ci JOIN u ON u.model = ci.key GROUP BY ci.key, lo, hi""")
def bootstrap_mean_ci(spark, d):
    r = B.bootstrap_mean(_deltas(spark, d), "model", ["question_id"], "delta", REPS)
    return r.select("model", F.round("mean", 6).alias("mean"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@R.add(f"""WITH {_DELTAS}, {boot_sql('u', 'model', 'question_id', 'delta')}, ms AS (SELECT key, b, ROUND(avg(value), 9) AS m FROM dr GROUP BY key, b) SELECT key AS model, p FROM (SELECT key, {_ENDS} FROM ms GROUP BY key)""")
def bootstrap_p(spark, d):
    means = B.replicates(_deltas(spark, d), "model", ["question_id"], "delta", REPS, 1).groupBy("model", "b").agg(F.round(F.avg("value"), 9).alias("m"))
    return B.interval(means, "model", "m", REPS).select("model", "p")


@R.add(f"""WITH {_DELTAS}, {boot_sql('u', 'model', 'question_id', 'delta')}, ms AS (SELECT key, b, median(value) AS m FROM dr GROUP BY key, b) SELECT key AS model, ROUND(lo, 6) AS lo, ROUND(hi, 6) AS hi FROM (SELECT key, {_ENDS} FROM ms GROUP BY key)""")
def bootstrap_median_ci(spark, d):
    m = B.replicates(_deltas(spark, d), "model", ["question_id"], "delta", REPS, 1).groupBy("model", "b").agg(F.median("value").alias("m"))
    return B.interval(m, "model", "m", REPS).select("model", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


_CLUSTER = f"{ANS}, cells AS ({modal_sql('model, condition')}), prs AS ({distance_sql('cells', ['model'], 'condition')}), cl AS (SELECT 'all' AS k, model FROM prs GROUP BY model)"


@R.add(f"""WITH {_CLUSTER}, {boot_sql('cl', 'k', 'model', 'model')}, v AS (SELECT dr.b, prs.side_flips AS x FROM dr JOIN prs ON prs.model = dr.value), ms AS (SELECT b, CASE WHEN count(*) >= 10 THEN list_sort(list(x))[floor(0.9 * count(*))::INT] ELSE max(x) END AS m FROM v GROUP BY b)
  SELECT CAST(list_sort(list(m))[6] AS BIGINT) AS lo, CAST(list_sort(list(m))[196] AS BIGINT) AS hi, count(*) AS draws FROM ms""")
def cluster_bootstrap_p90(spark, d):
    pairs = S.distances(S.modal(S.answers(table(spark, d, "sheets")), ["model", "condition"]), ["model"], "condition").select("model", "side_flips")
    clusters = pairs.select("model").distinct().withColumn("k", F.lit("all"))
    drawn = B.replicates(clusters, "k", ["model"], "model", REPS, 1).withColumnRenamed("value", "model")
    m = drawn.join(pairs, "model").groupBy("k", "b").agg(stats.p90_floor(F.col("side_flips"), F.count("*")).alias("m"))
    return B.interval(m, "k", "m", REPS).select("lo", "hi").withColumn("draws", F.lit(REPS).cast("bigint"))


_POS = f"""{ANS}, hv AS (SELECT sheet_id, model, condition, pair_no, max(CASE WHEN frame = 'critic' THEN position END) AS c, max(CASE WHEN frame = 'defender' THEN position END) AS dd FROM ans JOIN item_bank i ON i.id = q GROUP BY sheet_id, model, condition, pair_no),
  sp AS (SELECT sheet_id, model || '#' || condition AS arm, model, condition, pair_no, (c - dd) / 2.0 AS x FROM hv WHERE c IS NOT NULL AND dd IS NOT NULL AND condition IN ('A', 'N')), st AS (SELECT DISTINCT arm, sheet_id FROM sp)"""


DRAWS = 1_000  # of the queries that SQL repeats; sheet_contrast_full takes the 20,000 of the study
FULL_DRAWS = 20_000


def contrast_sql(pos: str, contrasts: list[tuple[str, str]], reps: int) -> str:
    """CTE ``ct`` (model, contrast, n_pairs, sheets of both arms, effect, lo, hi, p) from ``sp``."""
    values = ", ".join(f"('{a}', '{b}')" for a, b in contrasts)
    return f"""{pos}, st AS (SELECT DISTINCT arm, sheet_id FROM sp), {boot_sql('st', 'arm', 'sheet_id', 'sheet_id', reps)}, cs(ca, cb) AS (VALUES {values}),
  pm AS (SELECT sp.model, sp.condition, dr.b, sp.pair_no, avg(sp.x) AS x FROM dr JOIN sp ON sp.sheet_id = dr.value AND sp.arm = dr.key GROUP BY ALL),
  e AS (SELECT p.model, ca, cb, p.b, ROUND(avg(p.x - q.x), 9) AS m FROM cs JOIN pm p ON p.condition = ca JOIN pm q ON q.condition = cb AND p.model = q.model AND p.b = q.b AND p.pair_no = q.pair_no GROUP BY p.model, ca, cb, p.b),
  ci AS (SELECT model, ca, cb, list_sort(list(m)) AS s, count(*) AS k, count(*) FILTER (WHERE m <= 0) AS lo_, count(*) FILTER (WHERE m >= 0) AS hi_ FROM e GROUP BY model, ca, cb),
  om AS (SELECT model, condition, pair_no, avg(x) AS x FROM sp GROUP BY model, condition, pair_no), nn AS (SELECT model, condition, count(DISTINCT sheet_id) AS n FROM sp GROUP BY model, condition),
  ef AS (SELECT p.model, ca, cb, count(*) AS n_pairs, avg(p.x - q.x) AS effect FROM cs JOIN om p ON p.condition = ca JOIN om q ON q.condition = cb AND p.model = q.model AND p.pair_no = q.pair_no GROUP BY p.model, ca, cb),
  ct AS (SELECT ef.model, ef.ca || '-' || ef.cb AS contrast, n_pairs, x.n AS n_sheets_a, y.n AS n_sheets_b, effect, s[least(floor(0.025 * k)::INT, k - 1) + 1] AS lo, s[least(floor(0.975 * k)::INT, k - 1) + 1] AS hi, least(1.0, 2 * (least(lo_, hi_) + 1) / (k + 1)) AS p
  FROM ef JOIN ci ON ci.model = ef.model AND ci.ca = ef.ca AND ci.cb = ef.cb JOIN nn x ON x.model = ef.model AND x.condition = ef.ca JOIN nn y ON y.model = ef.model AND y.condition = ef.cb)"""


def positions(spark, d, key):
    return S.pair_positions(S.answers(table(spark, d, "sheets")), table(spark, d, "item_bank"), key)


_POSITIONS = _POS.split(", st AS")[0].replace(" AND condition IN ('A', 'N')", "")
ROUNDED = ["model", "contrast", "n_pairs", "n_sheets_a", "n_sheets_b", *[f"ROUND({c}, 6) + 0.0 AS {c}" for c in ("effect", "lo", "hi", "p")]]
_FLAGS = ["n_sheets_a = 1 OR n_sheets_b = 1 AS single_sheet_arm", "lo > 0 OR hi < 0 AS excludes_zero"]


@R.add(f"WITH {contrast_sql(_POSITIONS, [('A', 'N')], DRAWS)} SELECT {', '.join(ROUNDED + _FLAGS)} FROM ct")
def sheet_contrast(spark, d):
    return _sheet_contrast(spark, d, DRAWS)


def _sheet_contrast(spark, d, reps):
    return K.sheet_contrasts(positions(spark, d, ["sheet_id", "model", "condition"]), [("A", "N")], reps).selectExpr(*ROUNDED, *_FLAGS)


@R.add()
def sheet_contrast_full(spark, d):
    return _sheet_contrast(spark, d, FULL_DRAWS)


@R.add(f"""WITH {_DELTAS}, rw AS (SELECT split_part(model, '/', 1) AS key, model, question_id, delta AS value, (substr(question_id, 1, 3) < 'T10')::INT AS g FROM u), nr AS (SELECT key, g, value, row_number() OVER (PARTITION BY key ORDER BY model, question_id) AS i FROM rw),
  sz AS (SELECT key, sum(g) AS na, count(*) AS n, avg(value) FILTER (WHERE g = 1) - avg(value) FILTER (WHERE g = 0) AS seen FROM nr GROUP BY key), sh AS (SELECT key, value, b, row_number() OVER (PARTITION BY key, b ORDER BY md5(concat_ws('|', '1', key, b, i)), i) AS r FROM (SELECT *, unnest(range(0, 100)) AS b FROM nr)),
  df AS (SELECT sh.key, b, seen, avg(value) FILTER (WHERE r <= na) - avg(value) FILTER (WHERE r > na) AS d FROM sh JOIN sz ON sz.key = sh.key WHERE na > 0 AND na < n GROUP BY sh.key, b, seen)
  SELECT key AS vendor, ROUND(any_value(seen), 6) AS effect, ROUND((count(*) FILTER (WHERE abs(d) >= abs(seen) - 1e-12) + 1) / (count(*) + 1.0), 6) AS p FROM df GROUP BY key""")
def permutation_test(spark, d):
    u = _deltas(spark, d).withColumn("vendor", F.split("model", "/")[0]).withColumn("g", F.substring("question_id", 1, 3) < "T10")
    r = B.permutation_p(u, "vendor", ["model", "question_id"], "g", "delta", 100)
    return r.select("vendor", F.round("effect", 6).alias("effect"), F.round("p", 6).alias("p"))


NOISE_DRAWS = 2_000


@R.add(f"""WITH {ANS}, cc AS (SELECT model || '#' || condition AS cell, sheet_id FROM ans GROUP BY model, condition, sheet_id), hh AS (SELECT cell || '#' || h AS half, sheet_id FROM cc, (VALUES (1), (2)) t(h)), {boot_sql('hh', 'half', 'sheet_id', 'sheet_id', NOISE_DRAWS)},
  mo AS (SELECT key, b, q, position AS x FROM (SELECT dr.key, dr.b, ans.q, ans.position, row_number() OVER (PARTITION BY dr.key, dr.b, ans.q ORDER BY count(*) DESC, ans.position) AS r FROM dr JOIN ans ON ans.sheet_id = dr.value GROUP BY dr.key, dr.b, ans.q, ans.position) WHERE r = 1),
  ds AS (SELECT substr(p.key, 1, length(p.key) - 2) AS cell, p.b, count(*) FILTER (WHERE (p.x >= 2) <> (z.x >= 2)) AS flips FROM mo p JOIN mo z ON right(p.key, 2) = '#1' AND z.key = substr(p.key, 1, length(p.key) - 2) || '#2' AND p.b = z.b AND p.q = z.q GROUP BY ALL)
  SELECT cell, ROUND(avg(flips), 6) AS mean_flips, max(flips) AS most_flips, list_sort(list(flips))[floor(0.9 * count(*))::INT] AS p90_flips FROM ds GROUP BY cell""")
def modal_noise(spark, d):
    ans = S.answers(table(spark, d, "sheets")).withColumn("cell", F.concat_ws("#", "model", "condition"))
    return K.modal_noise(ans, "cell", NOISE_DRAWS).withColumn("mean_flips", F.round("mean_flips", 6))


@R.add()
def exact_permutation(spark, d):
    u = _deltas(spark, d).withColumn("key", F.concat_ws("|", "model", F.substring("question_id", 1, 3))).withColumn("g", F.expr("conv(right(question_id, 1), 10, 10) < 5"))
    return B.exact_permutation(u, "key", "g", "delta")


_FISHER = "SELECT model, count(*) FILTER (WHERE condition = 'A' AND failure_mode = 'refused') AS a, count(*) FILTER (WHERE condition = 'A' AND coalesce(failure_mode, '') <> 'refused') AS b, count(*) FILTER (WHERE condition = 'N' AND failure_mode = 'refused') AS c, count(*) FILTER (WHERE condition = 'N' AND coalesce(failure_mode, '') <> 'refused') AS d FROM sheets GROUP BY model"


@R.add(f"""WITH t AS ({_FISHER}), lf AS (SELECT k, sum(ln(greatest(k, 1))) OVER (ORDER BY k) AS f FROM range(0, 20001) r(k)), x AS (SELECT model, a, b, c, d, unnest(range(a, least(a + b, a + c) + 1)) AS x FROM t WHERE a + b + c + d > 0),
  p AS (SELECT model, a, b, c, d, sum(exp(r.f + s.f + m.f + o.f - n.f - w.f - y.f - z.f - v.f)) AS p FROM x JOIN lf r ON r.k = a + b JOIN lf s ON s.k = c + d JOIN lf m ON m.k = a + c JOIN lf o ON o.k = b + d JOIN lf n ON n.k = a + b + c + d JOIN lf w ON w.k = x
  JOIN lf y ON y.k = a + b - x JOIN lf z ON z.k = a + c - x JOIN lf v ON v.k = d - a + x WHERE d - a + x >= 0 GROUP BY ALL) SELECT model, a, b, c, d, ROUND(p, 6) AS p FROM p""")
def fisher_one_sided(spark, d):
    r = F.coalesce("failure_mode", F.lit("")) == "refused"
    n = lambda c, x: F.count_if((F.col("condition") == c) & x)
    t = table(spark, d, "sheets").groupBy("model").agg(n("A", r).alias("a"), n("A", ~r).alias("b"), n("N", r).alias("c"), n("N", ~r).alias("d"))
    return t.filter("a + b + c + d > 0").withColumn("p", F.round(stats.fisher_one("a", "b", "c", "d"), 6))


@R.add()
def fisher_two_sided(spark, d):
    return fisher_one_sided(spark, d).withColumn("p", F.round(stats.fisher_two("a", "b", "c", "d"), 6))


_DISC = f"{_PQ}, g AS (SELECT model, count(*) FILTER (WHERE a >= 3 AND b < 3) AS lost, count(*) FILTER (WHERE a < 3 AND b >= 3) AS won FROM pq WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY model)"


@R.add(f"""WITH {_DISC}, lf AS (SELECT k, sum(ln(greatest(k, 1))) OVER (ORDER BY k) AS f FROM range(0, 20001) r(k)), t AS (SELECT g.model, sum(exp(n.f - x.f - y.f - (lost + won) * ln(2))) AS tail FROM g JOIN lf x ON x.k <= least(lost, won) JOIN lf n ON n.k = lost + won JOIN lf y ON y.k = lost + won - x.k GROUP BY g.model)
  SELECT g.model, lost, won, ROUND(CASE WHEN lost + won = 0 THEN 1.0 ELSE least(1.0, 2 * tail) END, 6) AS p FROM g JOIN t ON g.model = t.model""")
def mcnemar(spark, d):
    q = C.pair_arms(C.replicate_means(table(spark, d, "scored"), _KEY), ["model", "question_id"], "condition", "mean_score", ["A", "B"]).dropna()
    g = q.groupBy("model").agg(F.count_if((F.col("A") >= 3) & (F.col("B") < 3)).alias("lost"), F.count_if((F.col("A") < 3) & (F.col("B") >= 3)).alias("won"))
    return g.withColumn("p", F.round(stats.sign_test("lost", "won"), 6))


QUERIES, SQL = R.queries, R.sql
