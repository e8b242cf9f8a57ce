"""Queries over judged responses: eligibility, reports, pairing, judges, text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import stats
from tallyforge.functions import text as X
from tallyforge.operators import scored as C
from tallyforge.plans.base import JUDGED, Registry, table

R = Registry()

_W = r"len(regexp_extract_all(coalesce(response_text, ''), '[\p{L}\p{N}_]+'))"
_T = r"regexp_replace(coalesce(response_text, ''), '\s+$', '')"
_LOOKS = rf"""CASE WHEN {_T} = '' THEN false WHEN regexp_matches({_T}, '(^|\n)[ \t]*[0-9]+[.)]$') THEN true WHEN regexp_matches({_T}, '```$') THEN false WHEN regexp_matches({_T}, '\\boxed\{{[^{{}}]*\}}\$?$') THEN false
  WHEN regexp_matches({_T}, '\]\([^()]*\)$') THEN false ELSE NOT regexp_matches({_T}, '[.!?。！？]["''”’»)*_\]]*$') END"""
_CUT = f"""CASE WHEN truncated IS NOT NULL THEN truncated WHEN coalesce(tokens_out >= coalesce(max_tokens, 800), false) THEN true
  ELSE ({_W} >= 50 OR coalesce(tokens_out >= 0.8 * coalesce(max_tokens, 800), false)) AND {_LOOKS} END"""
_BLANK = r"length(regexp_replace(coalesce(response_text, ''), '[\s\x{00A0}\x{200B}\x{3000}]', '', 'g')) = 0"
_REASON = f"CASE WHEN ok IS NOT DISTINCT FROM false THEN 'failed-call' WHEN {_BLANK} THEN 'empty' WHEN {_CUT} THEN 'truncated' END"
ELIG = f"elig AS (SELECT *, {_REASON} AS reason FROM scored)"
_BUCKET = "CASE WHEN score_classifier IS NULL OR coalesce(reason = 'failed-call', false) THEN 'unscored' WHEN reason = 'empty' THEN 'scored_empty' WHEN reason = 'truncated' THEN 'scored_truncated' ELSE 'eligible' END"


def _elig(spark, d):
    return table(spark, d, "scored").withColumn("reason", C.exclusion_reason())


@R.add(f"WITH {ELIG} SELECT coalesce(reason, 'eligible') AS reason, count(*) AS n, ROUND(count(*) / sum(count(*)) OVER (), 9) AS share FROM elig GROUP BY coalesce(reason, 'eligible')")
def eligible_reasons(spark, d):
    n = _elig(spark, d).groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


@R.add(f"WITH {ELIG} SELECT {_BUCKET} AS bucket, count(*) AS n FROM elig GROUP BY 1")
def partition_buckets(spark, d):
    return table(spark, d, "scored").groupBy(C.bucket().alias("bucket")).agg(F.count("*").alias("n"))


@R.add(f"WITH {ELIG}, b AS (SELECT *, {_BUCKET} AS bucket FROM elig) SELECT model, condition, count(*) AS total, count(*) FILTER (WHERE bucket = 'eligible') AS eligible, count(*) FILTER (WHERE bucket = 'scored_empty') AS scored_empty, count(*) FILTER (WHERE bucket = 'unscored') AS unscored FROM b GROUP BY model, condition")
def missingness(spark, d):
    b = table(spark, d, "scored").withColumn("bucket", C.bucket())
    return b.groupBy("model", "condition").agg(F.count("*").alias("total"), *[F.count_if(F.col("bucket") == x).alias(x) for x in ("eligible", "scored_empty", "unscored")])


@R.add(f"SELECT model, count(*) FILTER (WHERE {_LOOKS}) AS looks_truncated, count(*) AS n FROM scored GROUP BY model")
def truncated_text(spark, d):
    return table(spark, d, "scored").groupBy("model").agg(F.count_if(X.looks_truncated(F.coalesce("response_text", F.lit("")))).alias("looks_truncated"), F.count("*").alias("n"))


@R.add(f"WITH {ELIG} SELECT run, model, count(*) AS attempted, count(*) FILTER (WHERE reason IS NULL AND score_classifier IS NOT NULL) AS eligible, count(*) FILTER (WHERE reason = 'empty') AS empty_, count(*) FILTER (WHERE reason = 'truncated') AS cut, max(CASE WHEN reason IS NOT NULL AND score_classifier IS NOT NULL THEN record_id END) AS last_unusable FROM elig GROUP BY run, model")
def exclusion_audit(spark, d):
    e = _elig(spark, d)
    r = F.coalesce("reason", F.lit(""))
    return e.groupBy("run", "model").agg(F.count("*").alias("attempted"), F.count_if((r == "") & F.col("score_classifier").isNotNull()).alias("eligible"), F.count_if(r == "empty").alias("empty_"), F.count_if(r == "truncated").alias("cut"), F.max(F.when((r != "") & F.col("score_classifier").isNotNull(), F.col("record_id"))).alias("last_unusable"))


_CELLS = "cells AS (SELECT model, condition, question_id, avg(score_classifier) AS mean_score, count(score_classifier) AS depth, count(*) AS n_rows FROM scored GROUP BY model, condition, question_id)"
_KEY = ["model", "condition", "question_id"]


@R.add(f"WITH {_CELLS} SELECT model, condition, question_id, ROUND(mean_score, 9) AS mean_score, depth, n_rows FROM cells")
def replicate_means(spark, d):
    return C.replicate_means(table(spark, d, "scored"), _KEY).withColumn("mean_score", F.round("mean_score", 9))


@R.add("SELECT model, condition, question_id, max(record_id) AS record_id, max_by(sample_idx_, record_id) AS sample_idx, ROUND(avg(score_classifier), 9) AS score, count(*) AS n_replicates FROM (SELECT *, coalesce(sample_idx, -1) AS sample_idx_ FROM scored) GROUP BY model, condition, question_id")
def representative_rows(spark, d):
    s = table(spark, d, "scored").select(*_KEY, "record_id", F.coalesce("sample_idx", F.lit(-1)).alias("sample_idx"), "score_classifier")
    return C.representatives(s, _KEY, "record_id").select(*_KEY, "record_id", "sample_idx", F.round("score_classifier", 9).alias("score"), "n_replicates")


_PQ = f"{_CELLS}, pq AS (SELECT model, question_id, avg(CASE WHEN condition = 'A' THEN mean_score END) AS a, avg(CASE WHEN condition = 'B' THEN mean_score END) AS b FROM cells GROUP BY model, question_id)"


def _per_question(spark, d):
    return C.pair_arms(C.replicate_means(table(spark, d, "scored"), _KEY), ["model", "question_id"], "condition", "mean_score", ["A", "B"])


@R.add(f"WITH {_PQ} SELECT model, question_id, ROUND(a, 9) AS score_a, ROUND(b, 9) AS score_b, ROUND(b - a, 9) AS delta FROM pq")
def per_question(spark, d):
    return _per_question(spark, d).select("model", "question_id", F.round("A", 9).alias("score_a"), F.round("B", 9).alias("score_b"), F.round(F.expr("B - A"), 9).alias("delta"))


@R.add(f"""WITH {_PQ}, q AS (SELECT model, avg(a) AS mean_a, avg(b) AS mean_b, avg(b - a) AS mean_delta, CASE WHEN count(b - a) >= 2 THEN stddev_samp(b - a) END AS sd_delta FROM pq GROUP BY model),
  h AS (SELECT model, avg((refusal_class IS NOT NULL)::INT) AS refusal, avg(hedge_ratio) AS hedge FROM scored GROUP BY model)
  SELECT q.model, ROUND(mean_a, 9) AS mean_a, ROUND(mean_b, 9) AS mean_b, ROUND(mean_delta, 9) AS mean_delta, ROUND(sd_delta, 9) AS sd_delta, ROUND(refusal, 9) AS refusal_rate, ROUND(hedge, 9) AS mean_hedge FROM q JOIN h ON q.model = h.model""")  # fmt: skip
def per_model(spark, d):
    q = _per_question(spark, d).withColumn("x", F.expr("B - A")).groupBy("model").agg(F.avg("A").alias("a"), F.avg("B").alias("b"), F.avg("x").alias("m"), F.when(F.count("x") >= 2, F.stddev_samp("x")).alias("s"))
    h = table(spark, d, "scored").groupBy("model").agg(F.avg(F.col("refusal_class").isNotNull().cast("int")).alias("r"), F.avg("hedge_ratio").alias("h"))
    return q.join(h, "model").select("model", *[F.round(x, 9).alias(n) for x, n in (("a", "mean_a"), ("b", "mean_b"), ("m", "mean_delta"), ("s", "sd_delta"), ("r", "refusal_rate"), ("h", "mean_hedge"))])


@R.add("""WITH f AS (SELECT model, coalesce(topic, substr(question_id, 1, 3)) AS topic, question_id, min_by(score_classifier, record_id) FILTER (WHERE condition = 'A' AND score_classifier IS NOT NULL) AS a,
  min_by(score_classifier, record_id) FILTER (WHERE condition = 'B' AND score_classifier IS NOT NULL) AS b FROM scored GROUP BY 1, 2, 3)
  SELECT model, topic, count(*) AS questions, ROUND(avg(a), 9) AS mean_a, ROUND(avg(b), 9) AS mean_b, ROUND(avg(b - a), 9) AS mean_delta FROM f GROUP BY model, topic""")  # fmt: skip
def per_topic(spark, d):
    topic = F.coalesce("topic", F.substring("question_id", 1, 3)).alias("topic")
    first = lambda c: F.min_by("score_classifier", F.when((F.col("condition") == c) & F.col("score_classifier").isNotNull(), F.col("record_id")))
    f = table(spark, d, "scored").groupBy("model", topic, "question_id").agg(first("A").alias("a"), first("B").alias("b"))
    return f.groupBy("model", "topic").agg(F.count("*").alias("questions"), F.round(F.avg("a"), 9).alias("mean_a"), F.round(F.avg("b"), 9).alias("mean_b"), F.round(F.avg(F.col("b") - F.col("a")), 9).alias("mean_delta"))


@R.add(f"""WITH {_PQ}, x AS (SELECT model, question_id, b - a AS delta FROM pq WHERE a IS NOT NULL AND b IS NOT NULL), top AS (SELECT model, question_id, delta FROM x ORDER BY abs(ROUND(delta, 9)) DESC, model, question_id LIMIT 1)
  SELECT (SELECT count(*) FROM x) AS pairs, top.model AS headline_model, top.question_id AS headline_question, ROUND(top.delta, 9) AS headline_delta, (SELECT count(*) FROM x WHERE delta <= -1) AS drops, (SELECT count(*) FROM x WHERE delta >= 1) AS rises FROM top""")
def run_summary(spark, d):
    x = _per_question(spark, d).withColumn("delta", F.expr("B - A")).filter("delta is not null")
    n = x.agg(F.count("*").alias("pairs"), F.count_if(F.col("delta") <= -1).alias("drops"), F.count_if(F.col("delta") >= 1).alias("rises"))
    top = x.orderBy(F.abs(F.round("delta", 9)).desc(), "model", "question_id").limit(1)
    return n.join(F.broadcast(top)).select("pairs", F.col("model").alias("headline_model"), F.col("question_id").alias("headline_question"), F.round("delta", 9).alias("headline_delta"), "drops", "rises")


@R.add(f"""WITH {_CELLS}, w AS (SELECT question_id, avg(CASE WHEN condition = 'A' THEN mean_score END) AS base, avg(CASE WHEN condition = 'B' THEN mean_score END) AS g, avg(CASE WHEN condition = 'C' THEN mean_score END) AS a,
  avg(CASE WHEN condition = 'D' THEN mean_score END) AS l FROM cells GROUP BY question_id) SELECT question_id, ROUND(l - ((g - base) + (a - base) + base), 9) AS residual FROM w WHERE base IS NOT NULL AND g IS NOT NULL AND a IS NOT NULL AND l IS NOT NULL""")
def additivity_residual(spark, d):
    w = C.pair_arms(C.replicate_means(table(spark, d, "scored"), _KEY), ["question_id"], "condition", "mean_score", ["A", "B", "C", "D"]).dropna()
    return w.select("question_id", F.round(F.expr("D - ((B - A) + (C - A) + A)"), 9).alias("residual"))


@R.add(f"""WITH {ELIG}, base AS (SELECT *, reason IS NULL AND score_classifier IS NOT NULL AS good FROM elig WHERE run NOT LIKE '%recollect%'), rep AS (SELECT model, question_id, condition, score_classifier AS s, record_id AS rid FROM (SELECT *,
  row_number() OVER (PARTITION BY model, question_id, condition ORDER BY record_id) AS n FROM elig WHERE run LIKE '%recollect%' AND reason IS NULL AND score_classifier IS NOT NULL) WHERE n = 1)
  SELECT record_id, CASE WHEN NOT good AND rid IS NOT NULL THEN s ELSE score_classifier END AS score, CASE WHEN NOT good AND rid IS NOT NULL THEN rid ELSE record_id END AS source_id, NOT good AND rid IS NOT NULL AS spliced
  FROM base LEFT JOIN rep ON base.model = rep.model AND base.question_id = rep.question_id AND base.condition = rep.condition""")  # fmt: skip
def splice_repairs(spark, d):
    e = _elig(spark, d).select("record_id", *_KEY, "run", "score_classifier", (F.col("reason").isNull() & F.col("score_classifier").isNotNull()).alias("good"), F.col("record_id").alias("source_id"))
    is_rep = F.col("run").like("%recollect%")
    out = C.splice(e.filter(~is_rep), e.filter(is_rep), _KEY, ["score_classifier", "source_id"], "good", "record_id")
    return out.select("record_id", F.col("score_classifier").alias("score"), "source_id", "spliced")


@R.add(f"WITH {ELIG}, k AS (SELECT DISTINCT model, question_id, condition FROM scored), good AS (SELECT DISTINCT model, question_id, condition FROM elig WHERE reason IS NULL AND score_classifier IS NOT NULL) SELECT model, question_id, condition FROM k ANTI JOIN good USING (model, question_id, condition)")
def splice_holes(spark, d):
    e = _elig(spark, d)
    good = e.filter("reason is null and score_classifier is not null").select(*_KEY)
    return e.select("model", "question_id", "condition").distinct().join(good, _KEY, "left_anti").select("model", "question_id", "condition")


@R.add(f"""WITH {ELIG} SELECT model, question_id, condition, record_id, good FROM (SELECT *, reason IS NULL AND score_classifier IS NOT NULL AS good, row_number() OVER (PARTITION BY model, question_id, condition
  ORDER BY (reason IS NULL AND score_classifier IS NOT NULL) DESC, record_id DESC) AS n FROM elig) WHERE n = 1""")
def keep_best(spark, d):
    e = _elig(spark, d).withColumn("good", F.col("reason").isNull() & F.col("score_classifier").isNotNull())
    best = e.groupBy("model", "question_id", "condition").agg(F.max(F.struct("good", "record_id")).alias("b"))
    return best.select("model", "question_id", "condition", "b.record_id", "b.good")


@R.add("SELECT run, count(*) AS records, count(DISTINCT model) AS models, min(record_id) AS first_id, contains(run, 'recollect') AS derived, CASE WHEN contains(run, 'expansion') THEN 'expansion' WHEN contains(run, 'recollect') THEN 'recollect' WHEN contains(run, 'main') THEN 'main' ELSE 'other' END AS protocol FROM scored GROUP BY run")
def run_catalog(spark, d):
    protocol = F.when(F.contains("run", F.lit("expansion")), "expansion").when(F.contains("run", F.lit("recollect")), "recollect").when(F.contains("run", F.lit("main")), "main").otherwise("other")
    s = table(spark, d, "scored").groupBy("run").agg(F.count("*").alias("records"), F.count_distinct("model").alias("models"), F.min("record_id").alias("first_id"))
    return s.withColumn("derived", F.contains("run", F.lit("recollect"))).withColumn("protocol", protocol)


@R.add("WITH r AS (SELECT DISTINCT run FROM scored), s AS (SELECT replace(run, 'recollect', 'main') AS base FROM r WHERE run LIKE '%recollect%') SELECT run FROM r SEMI JOIN s ON r.run = s.base")
def superseded_runs(spark, d):
    r = table(spark, d, "scored").select("run").distinct()
    repaired = r.filter(F.col("run").like("%recollect%")).select(F.replace("run", F.lit("recollect"), F.lit("main")).alias("run"))
    return r.join(repaired, "run", "left_semi")


@R.add("WITH r AS (SELECT run, count(*) AS n, CAST(substr(run, 1, 4) AS INTEGER) * 100 + CAST(substr(run, 6, 2) AS INTEGER) AS ym FROM scored GROUP BY run), b(band, lo, hi) AS (VALUES ('early', NULL, 202605), ('middle', 202605, 202608), ('late', 202608, NULL)) SELECT band, count(*) AS runs, CAST(sum(n) AS BIGINT) AS records FROM r JOIN b ON (lo IS NULL OR ym >= lo) AND (hi IS NULL OR ym < hi) GROUP BY band")
def vintage_bands(spark, d):
    bands = spark.createDataFrame([("early", None, 202605), ("middle", 202605, 202608), ("late", 202608, None)], "band string, lo int, hi int")
    r = table(spark, d, "scored").groupBy("run").agg(F.count("*").alias("n")).withColumn("ym", F.substring("run", 1, 4).cast("int") * 100 + F.substring("run", 6, 2).cast("int"))
    return r.join(F.broadcast(bands), F.expr("(lo is null or ym >= lo) and (hi is null or ym < hi)")).groupBy("band").agg(F.count("*").alias("runs"), F.sum("n").alias("records"))


_ID = r"split_part(model, '/', 1) AS vendor, regexp_extract(split_part(model, '/', 2), '^([a-z]+)', 1) AS stem, regexp_extract(model, '-([0-9]+(?:\.[0-9]+)?)(?:-|$)', 1) AS version, regexp_extract(model, '-([0-9]+b)$', 1) AS size, regexp_extract(model, '-(mini|thinking)$', 1) AS tier"


def _models(spark, d):
    m = table(spark, d, "scored").select("model").distinct()
    name = F.split("model", "/")
    return m.select("model", name[0].alias("vendor"), F.regexp_extract(name[1], "^([a-z]+)", 1).alias("stem"), F.regexp_extract("model", r"-([0-9]+(?:\.[0-9]+)?)(?:-|$)", 1).alias("version"), F.regexp_extract("model", r"-([0-9]+b)$", 1).alias("size"), F.regexp_extract("model", r"-(mini|thinking)$", 1).alias("tier"))


@R.add(f"SELECT model, {_ID} FROM (SELECT DISTINCT model FROM scored)")
def model_ids(spark, d):
    return _models(spark, d)


@R.add(f"""WITH m AS (SELECT model, {_ID} FROM (SELECT DISTINCT model FROM scored)) SELECT x.model AS a, y.model AS b, CASE WHEN x.stem <> y.stem THEN 'UNRELATED' WHEN x.version <> y.version THEN 'SUCCESSOR' WHEN x.size <> y.size THEN 'size' WHEN x.tier <> y.tier THEN 'tier' ELSE 'IDENTICAL' END AS relation
  FROM m x JOIN m y ON x.vendor = y.vendor AND x.model < y.model""")
def model_relations(spark, d):
    m = _models(spark, d)
    x, y = m.alias("x"), m.alias("y")
    rel = F.expr("CASE WHEN x.stem <> y.stem THEN 'UNRELATED' WHEN x.version <> y.version THEN 'SUCCESSOR' WHEN x.size <> y.size THEN 'size' WHEN x.tier <> y.tier THEN 'tier' ELSE 'IDENTICAL' END")
    return x.join(y, F.expr("x.vendor = y.vendor and x.model < y.model")).select(F.col("x.model").alias("a"), F.col("y.model").alias("b"), rel.alias("relation"))


@R.add(f"""WITH m AS (SELECT model, {_ID} FROM (SELECT DISTINCT model FROM scored)) SELECT vendor, stem, model, lead(model) OVER (PARTITION BY vendor, stem ORDER BY CAST(version AS DOUBLE), model) AS successor,
  row_number() OVER (PARTITION BY vendor, stem ORDER BY CAST(version AS DOUBLE), model) AS step FROM m""")
def lineage_pairs(spark, d):
    w = Window.partitionBy("vendor", "stem").orderBy(F.col("version").cast("double"), "model")
    return _models(spark, d).select("vendor", "stem", "model", F.lead("model").over(w).alias("successor"), F.row_number().over(w).cast("bigint").alias("step"))


@R.add(f"""WITH s AS (SELECT record_id, list_sort(list_transform(list_filter(score_classifier_judges, lambda j: j.score IS NOT NULL AND j.error IS NULL), lambda j: j.score)) AS s FROM scored)
  SELECT record_id, (s[(len(s) - 1) // 2 + 1] + s[len(s) // 2 + 1]) / 2.0 AS panel, CASE WHEN len(s) >= 2 THEN s[len(s)] - s[1] END AS spread, CAST(len(s) AS INTEGER) AS n_judges FROM s WHERE len(s) > 0""")
def panel_median(spark, d):
    return C.panel(table(spark, d, "scored"), ["record_id"])


_DEV = f"{JUDGED}, dev AS (SELECT *, score - median(score) OVER (PARTITION BY record_id) AS x FROM judged)"


def _leans(spark, d):
    usable = F.filter("score_classifier_judges", lambda j: j["score"].isNotNull() & j["error"].isNull())
    p = table(spark, d, "scored").select("condition", usable.alias("u")).filter(F.size("u") > 0).withColumn("s", F.array_sort(F.transform("u", lambda j: j["score"]))).withColumn("n", F.size("s"))
    p = p.withColumn("mid", (F.expr("s[(n - 1) div 2]") + F.expr("s[n div 2]")) / 2.0).select("condition", "mid", F.explode("u").alias("j"))
    x = F.col("j.score") - F.col("mid")
    return p.groupBy("j.judge", "condition").agg(F.count("*").alias("n"), F.avg(x).alias("lean"), F.stddev_pop(x).alias("sd"))


@R.add(f"WITH {_DEV} SELECT judge, condition, count(*) AS n, ROUND(avg(x), 9) AS lean, ROUND(stddev_pop(x), 9) AS sd FROM dev GROUP BY judge, condition")
def judge_deviation(spark, d):
    return _leans(spark, d).withColumn("lean", F.round("lean", 9)).withColumn("sd", F.round("sd", 9))


@R.add(f"""WITH {_DEV}, m AS (SELECT judge, condition, avg(x) AS lean FROM dev WHERE condition IN ('A', 'B') GROUP BY judge, condition), r AS (SELECT *, rank() OVER (PARTITION BY condition ORDER BY ROUND(lean, 9)) AS r FROM m)
  SELECT a.judge, a.r AS rank_a, b.r AS rank_b, a.r = b.r AS stable, ROUND(b.lean - a.lean, 9) AS shift FROM r a JOIN r b ON a.judge = b.judge AND a.condition = 'A' AND b.condition = 'B'""")
def rank_stability(spark, d):
    m = _leans(spark, d).filter("condition in ('A', 'B')").withColumn("r", F.rank().over(Window.partitionBy("condition").orderBy(F.round("lean", 9))))
    w = m.groupBy("judge").agg(*[F.max(F.when(F.col("condition") == c, F.col(x))).alias(f"{x}_{c}") for c in "AB" for x in ("r", "lean")]).dropna()
    return w.select("judge", F.col("r_A").cast("bigint").alias("rank_a"), F.col("r_B").cast("bigint").alias("rank_b"), F.expr("r_A = r_B").alias("stable"), F.round(F.expr("lean_B - lean_A"), 9).alias("shift"))


@R.add(f"""WITH {JUDGED} SELECT x.judge AS a, y.judge AS b, count(*) AS items, ROUND(avg((x.score = y.score)::INT), 9) AS exact, ROUND(avg((abs(x.score - y.score) <= 1)::INT), 9) AS within_one, ROUND(avg(abs(x.score - y.score)), 9) AS mean_diff
  FROM judged x JOIN judged y ON x.record_id = y.record_id AND x.judge < y.judge GROUP BY x.judge, y.judge""")
def pairwise_agreement(spark, d):
    usable = F.filter("score_classifier_judges", lambda j: j["score"].isNotNull() & j["error"].isNull())
    pairs = table(spark, d, "scored").select(usable.alias("u")).select(F.explode(F.flatten(F.transform("u", lambda x: F.transform(F.filter("u", lambda y: y["judge"] > x["judge"]), lambda y: F.struct(x["judge"].alias("a"), y["judge"].alias("b"), F.abs(x["score"] - y["score"]).alias("d")))))).alias("p"))
    diff = F.col("p.d")
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("items"), F.round(F.avg((diff == 0).cast("int")), 9).alias("exact"), F.round(F.avg((diff <= 1).cast("int")), 9).alias("within_one"), F.round(F.avg(diff), 9).alias("mean_diff"))


_O = f"""{JUDGED}, m AS (SELECT record_id, count(*) AS m FROM judged GROUP BY record_id HAVING count(*) >= 2), o AS (SELECT x.score AS a, y.score AS b, sum(1.0 / (m.m - 1)) AS w
  FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY judge, score) AS i FROM judged) x JOIN (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY judge, score) AS i FROM judged) y ON x.record_id = y.record_id AND x.i <> y.i JOIN m ON m.record_id = x.record_id GROUP BY x.score, y.score),
  n AS (SELECT a AS k, sum(w) AS n FROM o GROUP BY a), dl AS (SELECT p.k AS a, q.k AS b, p.n AS na, q.n AS nb, power((SELECT sum(n) FROM n z WHERE z.k BETWEEN least(p.k, q.k) AND greatest(p.k, q.k)) - (p.n + q.n) / 2, 2) AS d FROM n p, n q WHERE p.k <> q.k)"""


@R.add(f"WITH {_O} SELECT ROUND(1 - ((SELECT sum(n) FROM n) - 1) * (SELECT sum(o.w * dl.d) FROM o JOIN dl ON o.a = dl.a AND o.b = dl.b) / (SELECT sum(na * nb * d) FROM dl), 9) AS alpha, (SELECT count(*) FROM m) AS items")
def krippendorff_alpha(spark, d):
    usable = F.transform(F.filter("score_classifier_judges", lambda j: j["score"].isNotNull() & j["error"].isNull()), lambda j: j["score"])
    s = table(spark, d, "scored").select(usable.alias("s")).filter(F.size("s") >= 2)
    o = s.select(F.size("s").alias("m"), *[F.size(F.expr(f"filter(s, x -> x = {k})")).alias(f"c{k}") for k in range(1, 6)])
    o = o.agg(F.count("*").alias("items"), *[F.sum(F.col(f"c{a}") * (F.col(f"c{b}") - int(a == b)) / (F.col("m") - 1)).alias(f"o{a}{b}") for a in range(1, 6) for b in range(1, 6)])
    n = {a: sum((F.col(f"o{a}{b}") for b in range(2, 6)), F.col(f"o{a}1")) for a in range(1, 6)}
    total = n[1] + n[2] + n[3] + n[4] + n[5]
    seen, expected = F.lit(0.0), F.lit(0.0)
    for a in range(1, 6):
        for b in range(a + 1, 6):
            dd = sum((n[c] for c in range(a, b + 1)), F.lit(0.0)) - (n[a] + n[b]) / 2
            seen, expected = seen + F.col(f"o{a}{b}") * dd * dd, expected + n[a] * n[b] * dd * dd
    return o.select(F.round(1 - (total - 1) * seen / expected, 9).alias("alpha"), "items")


@R.add(f"""WITH {JUDGED}, c AS (SELECT judge, model, question_id, avg(CASE WHEN condition = 'A' THEN score END) AS a, avg(CASE WHEN condition = 'B' THEN score END) AS b FROM judged GROUP BY judge, model, question_id)
  SELECT judge, count(b - a) AS pairs, ROUND(avg(b - a), 9) AS mean_delta FROM c GROUP BY judge""")
def per_judge_rescoring(spark, d):
    j = C.judge_scores(table(spark, d, "scored"), ["model", "condition", "question_id"])
    c = j.groupBy("judge", "model", "question_id").agg(*[F.avg(F.when(F.col("condition") == x, F.col("score"))).alias(x) for x in "AB"])
    return c.groupBy("judge").agg(F.count(F.expr("B - A")).alias("pairs"), F.round(F.avg(F.expr("B - A")), 9).alias("mean_delta"))


@R.add("""WITH p AS (SELECT record_id, score_classifier AS stored, list_aggregate(list_transform(list_filter(score_classifier_judges, lambda j: j.score IS NOT NULL AND j.error IS NULL), lambda j: j.score), 'median') AS panel FROM scored)
  SELECT count(*) AS both_scored, ROUND(avg((stored = panel)::INT), 9) AS exact, ROUND(avg((abs(stored - panel) <= 1)::INT), 9) AS within_one FROM p WHERE stored IS NOT NULL AND panel IS NOT NULL""")
def cross_method_agreement(spark, d):
    p = C.panel(table(spark, d, "scored"), ["score_classifier"]).filter("score_classifier is not null")
    diff = F.abs(F.col("score_classifier") - F.col("panel"))
    return p.agg(F.count("*").alias("both_scored"), F.round(F.avg((diff == 0).cast("int")), 9).alias("exact"), F.round(F.avg((diff <= 1).cast("int")), 9).alias("within_one"))


@R.add("SELECT coalesce(CAST(CAST(score_classifier * 2 AS INTEGER) AS VARCHAR), 'null') AS half_points, count(*) AS n, ROUND(avg(hedge_ratio), 9) AS mean_hedge, ROUND(median(hedge_ratio), 9) AS median_hedge FROM scored GROUP BY 1")
def hedge_by_score(spark, d):
    b = F.coalesce((F.col("score_classifier") * 2).cast("int").cast("string"), F.lit("null"))
    return table(spark, d, "scored").groupBy(b.alias("half_points")).agg(F.count("*").alias("n"), F.round(F.avg("hedge_ratio"), 9).alias("mean_hedge"), F.round(F.median("hedge_ratio"), 9).alias("median_hedge"))


@R.add("SELECT model, ROUND(avg(CASE WHEN position = 'mild' THEN score_classifier END), 9) AS mild, ROUND(avg(CASE WHEN position = 'neutral' THEN score_classifier END), 9) AS neutral, ROUND(avg(CASE WHEN position = 'pointed' THEN score_classifier END), 9) AS pointed, ROUND(avg(CASE WHEN position = 'pointed' THEN score_classifier END) - avg(CASE WHEN position = 'mild' THEN score_classifier END), 9) AS progression FROM scored WHERE condition = 'B' GROUP BY model")
def framing_progression(spark, d):
    at = lambda p: F.avg(F.when(F.col("position") == p, F.col("score_classifier")))
    return table(spark, d, "scored").filter("condition = 'B'").groupBy("model").agg(F.round(at("mild"), 9).alias("mild"), F.round(at("neutral"), 9).alias("neutral"), F.round(at("pointed"), 9).alias("pointed"), F.round(at("pointed") - at("mild"), 9).alias("progression"))


@R.add("""WITH c AS (SELECT model, question_id, max_by(score_classifier, record_id) AS s FROM scored WHERE condition = 'A' AND score_classifier IS NOT NULL GROUP BY model, question_id), q AS (SELECT split_part(model, '/', 1) AS vendor, question_id, avg(s) AS s FROM c GROUP BY 1, 2)
  SELECT vendor, ROUND(avg(s), 9) AS mean_score, count(*) AS questions FROM q GROUP BY vendor""")
def vendor_cluster_means(spark, d):
    c = table(spark, d, "scored").filter("condition = 'A' and score_classifier is not null").groupBy("model", "question_id").agg(F.max_by("score_classifier", "record_id").alias("s"))
    q = c.groupBy(F.split("model", "/")[0].alias("vendor"), "question_id").agg(F.avg("s").alias("s"))
    return q.groupBy("vendor").agg(F.round(F.avg("s"), 9).alias("mean_score"), F.count("*").alias("questions"))


@R.add(f"WITH {_PQ} SELECT model, question_id, ROUND(b - a, 9) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY abs(ROUND(b - a, 9)) DESC, question_id) AS n FROM pq WHERE a IS NOT NULL AND b IS NOT NULL) WHERE n <= 3")
def pattern_examples(spark, d):
    x = _per_question(spark, d).withColumn("delta", F.round(F.expr("B - A"), 9)).filter("delta is not null")
    return x.withColumn("n", F.row_number().over(Window.partitionBy("model").orderBy(F.abs("delta").desc(), "question_id"))).filter("n <= 3").select("model", "question_id", "delta")


@R.add(f"""SELECT condition, ROUND(corr(score_classifier, w), 9) AS r, ROUND(avg(w), 9) AS mean_words, count(*) AS n FROM (SELECT condition, score_classifier, {_W} AS w FROM scored WHERE score_classifier IS NOT NULL AND response_text IS NOT NULL) GROUP BY condition""")
def length_control(spark, d):
    s = table(spark, d, "scored").filter("score_classifier is not null and response_text is not null").withColumn("w", X.word_count(F.col("response_text")))
    return s.groupBy("condition").agg(F.round(F.corr("score_classifier", "w"), 9).alias("r"), F.round(F.avg("w"), 9).alias("mean_words"), F.count("*").alias("n"))


_M = "m AS (SELECT model, avg(score_classifier) AS x, avg(hedge_ratio) AS y FROM scored GROUP BY model)"


@R.add(f"WITH {_M} SELECT model, rank() OVER (ORDER BY ROUND(x, 9)) + (count(*) OVER (PARTITION BY ROUND(x, 9)) - 1) / 2.0 AS rank_x FROM m WHERE x IS NOT NULL")
def average_ranks(spark, d):
    m = table(spark, d, "scored").groupBy("model").agg(F.round(F.avg("score_classifier"), 9).alias("x")).filter("x is not null")
    return stats.average_ranks(m, "x", "rank_x", []).select("model", "rank_x")


@R.add(f"""WITH {_M}, k AS (SELECT rank() OVER (ORDER BY ROUND(x, 9)) + (count(*) OVER (PARTITION BY ROUND(x, 9)) - 1) / 2.0 AS a, rank() OVER (ORDER BY ROUND(y, 9)) + (count(*) OVER (PARTITION BY ROUND(y, 9)) - 1) / 2.0 AS b, ROUND(x, 9) AS x, ROUND(y, 9) AS y FROM m WHERE x IS NOT NULL AND y IS NOT NULL)
  SELECT ROUND(corr(a, b), 9) AS spearman, ROUND(corr(x, y), 9) AS pearson, count(*) AS n FROM k""")
def correlations(spark, d):
    m = table(spark, d, "scored").groupBy("model").agg(F.round(F.avg("score_classifier"), 9).alias("x"), F.round(F.avg("hedge_ratio"), 9).alias("y")).dropna()
    k = stats.average_ranks(stats.average_ranks(m, "x", "a", []), "y", "b", [])
    return k.agg(F.round(F.corr("a", "b"), 9).alias("spearman"), F.round(F.corr("x", "y"), 9).alias("pearson"), F.count("*").alias("n"))


_SIGN = f"""{_PQ}, g AS (SELECT model, count(*) FILTER (WHERE b - a > 0) AS up, count(*) FILTER (WHERE b - a < 0) AS down, count(*) FILTER (WHERE b - a = 0) AS ties FROM pq GROUP BY model),
  lf AS (SELECT k, sum(ln(greatest(k, 1))) OVER (ORDER BY k) AS f FROM range(0, 20001) t(k)),
  t AS (SELECT g.model, sum(exp(n.f - a.f - b.f - (up + down) * ln(2))) AS tail FROM g JOIN lf a ON a.k <= least(up, down) JOIN lf n ON n.k = up + down JOIN lf b ON b.k = up + down - a.k GROUP BY g.model),
  sg AS (SELECT g.model, up, down, ties, CASE WHEN up + down = 0 THEN 1.0 ELSE least(1.0, 2 * tail) END AS p FROM g JOIN t ON g.model = t.model)"""


def _signs(spark, d):
    g = _per_question(spark, d).withColumn("x", F.expr("B - A")).groupBy("model").agg(F.count_if(F.coalesce(F.col("x") > 0, F.lit(False))).alias("up"), F.count_if(F.coalesce(F.col("x") < 0, F.lit(False))).alias("down"), F.count_if(F.coalesce(F.col("x") == 0, F.lit(False))).alias("ties"))
    return g.withColumn("p", stats.sign_test("up", "down"))


@R.add(f"WITH {_SIGN} SELECT model, up, down, ties, ROUND(p, 9) AS p FROM sg")
def sign_test(spark, d):
    return _signs(spark, d).withColumn("p", F.round("p", 9))


@R.add(f"""WITH {_SIGN}, k AS (SELECT *, row_number() OVER (ORDER BY ROUND(p, 9), model) AS k, count(*) OVER () AS m FROM sg), z AS (SELECT *, max(CASE WHEN ROUND(p, 9) <= k * 0.05 / m THEN k END) OVER () AS top FROM k)
  SELECT model, ROUND(p, 9) AS p, coalesce(k <= top, false) AS survives FROM z""")
def bh_stepup(spark, d):
    return stats.bh_stepup(_signs(spark, d).withColumn("p", F.round("p", 9)), "p", ["model"]).select("model", F.round("p", 9).alias("p"), "survives")


@R.add(f"""WITH {_SIGN}, k AS (SELECT model, ROUND(p, 9) AS p, row_number() OVER (ORDER BY ROUND(p, 9), model) AS k, count(*) OVER () AS m FROM sg)
  SELECT model, ROUND(p, 9) AS p, ROUND(min(least(p * m / k, 1.0)) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 9) AS p_adjusted FROM k""")
def bh_adjusted(spark, d):
    return stats.bh_adjusted(_signs(spark, d).withColumn("p", F.round("p", 9)), "p", ["model"]).select("model", F.round("p", 9).alias("p"), F.round("p_adjusted", 9).alias("p_adjusted"))


@R.add(f"SELECT record_id, {_W} AS words FROM scored")
def word_count(spark, d):
    return table(spark, d, "scored").select("record_id", X.word_count(F.col("response_text")).cast("bigint").alias("words"))


_H = " + ".join(f"(length(low) - length(replace(low, '{p}', ''))) // {len(p)} * {len(p.split())}" for p in X.HEDGES)


@R.add(f"SELECT record_id, ROUND(CASE WHEN w > 0 THEN ({_H}) / w END, 9) AS ratio FROM (SELECT record_id, lower(coalesce(response_text, '')) AS low, {_W} AS w FROM scored)")
def hedge_phrases(spark, d):
    return table(spark, d, "scored").select("record_id", F.round(X.hedge_ratio(F.col("response_text")), 9).alias("ratio"))


def _q(x: str) -> str:
    return x.replace("'", "''")


def _spans_sql(m: str) -> str:
    """Words of the clauses after each match of a marker, without look-ahead: the text is cut
    before each match, and what follows a match is the rest of the pieces less the match."""
    cut = f"string_split(regexp_replace(low, '({_q(m)})', chr(1) || '\\1', 'g'), chr(1))"
    rest = f"regexp_replace(array_to_string(ps[i:], ''), '^(?:{_q(m)})', '')"
    words = f"len(regexp_extract_all(regexp_extract(substr({rest}, 1, 200), '^[^.;]*'), '[\\p{{L}}\\p{{N}}_]+'))"
    return f"coalesce(list_sum(list_transform([{cut}], lambda ps: list_sum(list_transform(range(2, len(ps) + 1), lambda i: least({words} + 1, 25))))), 0)"


_SPAN = " + ".join(map(_spans_sql, X.HEDGE_MARKERS))
_RATIO = f"CASE WHEN w > 0 THEN least(({_SPAN}) / w, 1.0) ELSE 0.0 END"


@R.add(f"SELECT record_id, ROUND({_RATIO}, 9) AS ratio FROM (SELECT record_id, lower(coalesce(response_text, '')) AS low, {_W} AS w FROM scored)")
def hedge_spans(spark, d):
    return table(spark, d, "scored").select("record_id", F.round(X.hedge_span_ratio(F.coalesce("response_text", F.lit(""))), 9).alias("ratio"))


_REFUSED = f"(len(list_filter(regexp_extract_all(low, '{_q(X.DECLINING)}({X.EMPHATIC})?', 1), lambda x: coalesce(x, '') = '')) > 0 OR regexp_matches(low, '{_q('|'.join(X.REFUSAL_MARKERS))}'))"


@R.add(f"""WITH t AS (SELECT response_text, lower(coalesce(response_text, '')) AS low, {_W} AS w FROM scored), r AS (SELECT *, {_REFUSED} AS refused, regexp_matches(low, '{'|'.join(X.REDIRECT_MARKERS)}') AS redirect, {_RATIO} AS ratio FROM t)
  SELECT kind, confidence, count(*) AS n FROM (SELECT CASE WHEN refused AND w >= 100 THEN 'recovery' WHEN refused AND redirect THEN 'redirect' WHEN refused THEN 'policy-block' END AS kind,
  CASE WHEN response_text IS NULL THEN NULL WHEN refused AND w >= 100 THEN 'refusing-then-answering' WHEN refused THEN 'refusing' WHEN ratio >= 0.25 THEN 'hedging' ELSE 'definitive' END AS confidence FROM r) GROUP BY kind, confidence""")
def refusal_class(spark, d):
    c = table(spark, d, "scored").select(X.refusal_class(F.col("response_text")).alias("c"))
    return c.groupBy("c.kind", "c.confidence").agg(F.count("*").alias("n"))


@R.add("SELECT model, count(*) FILTER (WHERE contains(substr(lower(coalesce(response_text, '')), 1, 300), 'decline') OR contains(substr(lower(coalesce(response_text, '')), 1, 300), 'rather not')) AS marked FROM scored GROUP BY model")
def marker_prefix(spark, d):
    return table(spark, d, "scored").groupBy("model").agg(F.count_if(X.has_any(F.col("response_text"), ("decline", "rather not"))).alias("marked"))


@R.add("SELECT DISTINCT model, regexp_replace(model, '[^A-Za-z0-9.-]', '_', 'g') AS file_stem FROM scored")
def sanitised_names(spark, d):
    return table(spark, d, "scored").select("model", X.sanitise(F.col("model")).alias("file_stem")).distinct()


_FW = r"list_filter(string_split(lower(regexp_replace(coalesce(response_text, ''), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"


@R.add(f"""WITH t AS (SELECT model, question_id, condition, seed, record_id, {_FW} AS w FROM scored), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, question_id, condition, seed ORDER BY record_id) AS n FROM t) WHERE n = 1)
  SELECT t.record_id, f.record_id AS first_id, ROUND(CASE WHEN len(list_distinct(list_concat(t.w, f.w))) = 0 THEN 1.0 ELSE len(list_intersect(t.w, f.w)) / len(list_distinct(list_concat(t.w, f.w))) END, 9) AS jaccard
  FROM t JOIN f ON t.model = f.model AND t.question_id = f.question_id AND t.condition = f.condition AND t.seed = f.seed AND t.record_id > f.record_id""")
def jaccard_pairs(spark, d):
    t = table(spark, d, "scored").select("model", "question_id", "condition", "seed", "record_id", X.fold_words(F.col("response_text")).alias("w"))
    f = t.groupBy("model", "question_id", "condition", "seed").agg(F.min(F.struct("record_id", "w")).alias("f"))
    return t.join(f, ["model", "question_id", "condition", "seed"]).filter("record_id > f.record_id").select("record_id", F.col("f.record_id").alias("first_id"), F.round(X.jaccard(F.array_distinct("w"), F.array_distinct("f.w")), 9).alias("jaccard"))


@R.add(f"""WITH s AS (SELECT question_id, count(*) AS attempts, count(DISTINCT seed) AS seeds FROM scored WHERE ok GROUP BY question_id) SELECT question_id, attempts, seeds, 1000 - seeds AS missing FROM s WHERE seeds < 1000""")
def work_list(spark, d):
    s = table(spark, d, "scored").filter("ok").groupBy("question_id").agg(F.count("*").alias("attempts"), F.count_distinct("seed").alias("seeds"))
    return s.filter("seeds < 1000").withColumn("missing", 1000 - F.col("seeds"))


@R.add("""SELECT cell.model, cell.condition, n, texts, texts = 1 AND n > 1 AS identical, crowded FROM (SELECT model, condition, question_id, count(*) AS n, count(DISTINCT sha256(coalesce(response_text, ''))) AS texts, count(*) FILTER (WHERE tokens_out >= 0.9 * max_tokens) AS crowded, {'model': model, 'condition': condition} AS cell FROM scored GROUP BY model, condition, question_id HAVING count(*) > 1)""")
def replicate_identity(spark, d):
    g = table(spark, d, "scored").groupBy("model", "condition", "question_id").agg(F.count("*").alias("n"), F.count_distinct(F.sha2(F.coalesce("response_text", F.lit("")), 256)).alias("texts"), F.count_if(F.coalesce(F.col("tokens_out") >= 0.9 * F.col("max_tokens"), F.lit(False))).alias("crowded"))
    return g.filter("n > 1").select("model", "condition", "n", "texts", ((F.col("texts") == 1) & (F.col("n") > 1)).alias("identical"), "crowded")


@R.add(f"""WITH {ELIG}, v AS (SELECT count(*) AS n, count(*) FILTER (WHERE reason = 'truncated') AS cut, count(*) FILTER (WHERE reason = 'empty') AS blank, count(*) FILTER (WHERE max_tokens IS NULL) AS nocap, count(*) FILTER (WHERE reason IS NOT NULL AND score_classifier IS NOT NULL) AS dirty FROM elig)
  SELECT 'truncated' AS check_name, CASE WHEN cut / n > 0.05 THEN 'FAIL' WHEN cut / n > 0.01 THEN 'WARN' ELSE 'OK' END AS status, cut AS rows FROM v UNION ALL SELECT 'empty', CASE WHEN blank / n > 0.05 THEN 'FAIL' WHEN blank / n > 0.01 THEN 'WARN' ELSE 'OK' END, blank FROM v
  UNION ALL SELECT 'cap_recorded', CASE WHEN nocap / n > 0.05 THEN 'FAIL' WHEN nocap / n > 0.01 THEN 'WARN' ELSE 'OK' END, nocap FROM v UNION ALL SELECT 'scored_but_unusable', CASE WHEN dirty / n > 0.05 THEN 'FAIL' WHEN dirty / n > 0.01 THEN 'WARN' ELSE 'OK' END, dirty FROM v""")  # fmt: skip
def claim_checks(spark, d):
    r = F.coalesce("reason", F.lit(""))
    v = _elig(spark, d).agg(F.count("*").alias("n"), F.count_if(r == "truncated").alias("truncated"), F.count_if(r == "empty").alias("empty"), F.count_if(F.col("max_tokens").isNull()).alias("cap_recorded"), F.count_if((r != "") & F.col("score_classifier").isNotNull()).alias("scored_but_unusable"))
    names = ("truncated", "empty", "cap_recorded", "scored_but_unusable")
    u = v.select("n", F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c))])).alias("check_name", "rows"))
    share = F.col("rows") / F.col("n")
    return u.select("check_name", F.when(share > 0.05, "FAIL").when(share > 0.01, "WARN").otherwise("OK").alias("status"), "rows")


QUERIES, SQL = R.queries, R.sql
