"""Values, lineage, parsing and collection in detail."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import stats
from tallyforge.functions import text as X
from tallyforge.operators import resample as B
from tallyforge.operators import sheets as S
from tallyforge.plans.base import ANS, Registry, distance_sql, modal_sql, table
from tallyforge.plans.resample_queries import _DELTAS, _deltas, boot_sql, draw_sql

R = Registry()
MC = f"cells AS ({modal_sql('model, condition')})"


def _answers(spark, d):
    return S.answers(table(spark, d, "sheets"))


_VALUES = ("finish_reason", "refusal_class", "confidence", "scoring_status")


@R.add("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, coalesce({c}, 'none') AS value, count(*) AS n FROM scored GROUP BY {c}" for c in _VALUES) + ") QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 3")
def top_values(spark, d):
    """The three most frequent values of each field, ties by value."""
    v = table(spark, d, "scored").select(F.explode(F.create_map(*[x for c in _VALUES for x in (F.lit(c), F.coalesce(c, F.lit("none")))])).alias("field", "value")).groupBy("field", "value").agg(F.count("*").alias("n"))
    return v.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))).filter("r <= 3").drop("r")


@R.add("WITH t AS (SELECT max(substr(collected_at, 1, 10)) AS last FROM sheets) SELECT model, count(*) AS sheets, max(substr(collected_at, 1, 10)) AS last_day FROM sheets, t WHERE CAST(substr(collected_at, 1, 10) AS DATE) > CAST(t.last AS DATE) - 30 GROUP BY model")
def recent_days(spark, d):
    """Sheets of the last thirty days of the collection; the day is the data's, not the clock's."""
    s = table(spark, d, "sheets").select("model", F.substring("collected_at", 1, 10).alias("day"))
    last = s.agg(F.max("day").alias("last"))
    return s.crossJoin(F.broadcast(last)).filter(F.to_date("day") > F.date_sub(F.to_date("last"), 30)).groupBy("model").agg(F.count("*").alias("sheets"), F.max("day").alias("last_day"))


@R.add("""WITH l AS (SELECT sheet_id, CAST(e.key AS INTEGER) AS label, e.value AS item FROM (SELECT sheet_id, unnest(map_entries(label_to_id)) AS e FROM sheets WHERE renumbered AND label_to_id IS NOT NULL)) SELECT sheet_id, item, row_number() OVER (PARTITION BY sheet_id ORDER BY label) - 1 AS slot FROM l""")
def item_slots(spark, d):
    """Slot of each item in the order it was shown, from the labels a sheet printed."""
    s = table(spark, d, "sheets").filter("renumbered and label_to_id is not null").select("sheet_id", F.explode("label_to_id").alias("k", "item"))
    return s.select("sheet_id", "item", (F.row_number().over(Window.partitionBy("sheet_id").orderBy(F.col("k").cast("int"))) - 1).cast("bigint").alias("slot"))


@R.add(f"WITH {ANS}, {MC}, x AS ({distance_sql('cells', ['model'], 'condition')}) SELECT q AS quantile, count(*) AS n, list_sort(list(side_flips))[least(floor(q * count(*))::INT, count(*) - 1) + 1] AS value, floor(q * count(*))::INT >= count(*) - 1 AS is_max FROM x, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (0.999::DOUBLE)) t(q) GROUP BY q")
def index_percentiles(spark, d):
    """sorted[min(int(q n), n - 1)] and whether that is the maximum."""
    h = S.distances(S.modal(_answers(spark, d), ["model", "condition"]), ["model"], "condition").groupBy("side_flips").agg(F.count("*").alias("n"))
    qs = (0.5, 0.9, 0.95, 0.999)
    r = S.at_ranks(h, [], "side_flips", {f"v{i}": f"least(cast(floor({q}D * total) as bigint), total - 1) + 1" for i, q in enumerate(qs)})
    rows = F.array(*[F.struct(F.lit(q).alias("quantile"), F.col("total").alias("n"), F.col(f"v{i}").alias("value"), F.expr(f"floor({q}D * total) >= total - 1").alias("is_max")) for i, q in enumerate(qs)])
    return r.select(F.explode(rows).alias("x")).select("x.*")


@R.add("SELECT condition, count(DISTINCT model) AS models, ROUND(1 - pow(1 - 0.8, 1.0 / count(DISTINCT model)), 9) AS mde FROM sheets WHERE valid GROUP BY condition")
def opposite_sign_mde(spark, d):
    """Chance of an opposite sign that so many models show at least once in four of five cases."""
    return table(spark, d, "sheets").filter("valid").groupBy("condition").agg(F.count_distinct("model").alias("models")).select("condition", "models", F.expr("ROUND(1 - pow(1 - 0.8D, 1.0D / models), 9)").alias("mde"))


@R.add("WITH g AS (SELECT CAST(unnest(range(2, 61)) AS BIGINT) AS n), p AS (SELECT n, 2 / exp(lgamma(2 * n + 1) - 2 * lgamma(n + 1)) AS p FROM g) SELECT t.threshold, min(n) AS n FROM p, (VALUES (0.05::DOUBLE), (0.01::DOUBLE), (0.001::DOUBLE), (0.0000001::DOUBLE)) t(threshold) WHERE p <= t.threshold GROUP BY t.threshold")
def smallest_arm(spark, d):
    """Least sheets an arm so that an exact permutation can reach each threshold; searched to 60."""
    rows = [(t, next((n for n in range(2, 61) if stats.min_reachable_p(n, n) <= t), None)) for t in (0.05, 0.01, 0.001, 0.0000001)]
    return spark.createDataFrame(rows, "threshold double, n bigint")


@R.add()
def word_diff(spark, d):
    """Words only in an item or only in its mirror, in order (longest common subsequences have
    no SQL; the bank is a fixed table)."""
    return X.word_diffs(table(spark, d, "item_bank").filter("mirror_of is not null").alias("a").join(table(spark, d, "item_bank").alias("b"), F.expr("a.mirror_of = b.id")).select(F.col("a.id").alias("id"), F.col("a.text").alias("old"), F.col("b.text").alias("new")))


@R.add(f"""WITH f AS (SELECT *, regexp_extract(model, '^([^/]+)/', 1) AS vendor FROM (SELECT DISTINCT model FROM scored)), p AS (SELECT model, vendor, regexp_replace(regexp_replace(regexp_replace(regexp_extract(model, '/(.*)$', 1), '-[0-9]{{6,8}}$', ''), '-[0-9]+b$', ''), '-(mini|thinking)$', '') AS rest, regexp_extract(model, '-([0-9]{{6,8}})$', 1) AS snapshot, regexp_extract(model, '-([0-9]+b)(?:-|$)', 1) AS size, regexp_extract(model, '-(thinking)(?:-|$)', 1) AS mode, regexp_extract(model, '-(mini)(?:-|$)', 1) AS tier FROM f)
  SELECT model, vendor, trim(regexp_replace(rest, '[^a-z]+', ' ', 'g')) AS stem, array_to_string(list_transform(string_split(regexp_extract(rest, '([0-9]+(?:\\.[0-9]+)*)', 1), '.'), lambda x: lpad(x, 4, '0')), '.') AS version_key, snapshot, size, mode, tier FROM p""")
def model_parse(spark, d):
    """Model ids peeled into stem, sortable version, date snapshot, size, mode and tier."""
    return _parsed(spark, d)


def _parsed(spark, d):
    m = table(spark, d, "scored").select("model").distinct()
    rest = F.regexp_extract("model", "/(.*)$", 1)
    for end in (r"-[0-9]{6,8}$", r"-[0-9]+b$", r"-(mini|thinking)$"):
        rest = F.regexp_replace(rest, end, "")
    version = F.array_join(F.transform(F.split(F.regexp_extract(rest, r"([0-9]+(?:\.[0-9]+)*)", 1), r"\."), lambda x: F.lpad(x, 4, "0")), ".")
    part = lambda p: F.regexp_extract("model", p, 1)
    return m.select("model", part("^([^/]+)/").alias("vendor"), F.trim(F.regexp_replace(rest, "[^a-z]+", " ")).alias("stem"), version.alias("version_key"), part(r"-([0-9]{6,8})$").alias("snapshot"), part(r"-([0-9]+b)(?:-|$)").alias("size"), part(r"-(thinking)(?:-|$)").alias("mode"), part(r"-(mini)(?:-|$)").alias("tier"))


_PARSE_SQL = R.sql["model_parse"]
_REL = "CASE WHEN x.stem <> y.stem THEN 'UNRELATED' WHEN x.version_key <> y.version_key THEN 'SUCCESSOR' WHEN (x.size <> y.size)::INT + (x.mode <> y.mode)::INT + (x.tier <> y.tier)::INT + (x.snapshot <> y.snapshot)::INT > 1 THEN 'UNKNOWN' WHEN x.size <> y.size THEN 'size' WHEN x.mode <> y.mode THEN 'mode' WHEN x.tier <> y.tier THEN 'tier' WHEN x.snapshot <> y.snapshot THEN 'snapshot' ELSE 'IDENTICAL' END"


@R.add(f"WITH m AS ({_PARSE_SQL}) SELECT x.model AS a, y.model AS b, {_REL} AS relation FROM m x JOIN m y ON x.vendor = y.vendor AND x.model < y.model")
def pair_relations(spark, d):
    """Relation of any two models of a vendor; UNKNOWN where more than one thing differs."""
    m = _parsed(spark, d)
    return m.alias("x").join(m.alias("y"), F.expr("x.vendor = y.vendor and x.model < y.model")).select(F.col("x.model").alias("a"), F.col("y.model").alias("b"), F.expr(_REL.replace("::INT", "").replace("(x.", "int(x.")).alias("relation"))


@R.add("""WITH c AS (SELECT model, condition, question_id, count(score_classifier) AS depth FROM scored GROUP BY ALL), r AS (SELECT model, condition, min(depth) AS least, max(depth) AS most, count(*) AS cells FROM c GROUP BY model, condition) SELECT model, condition, cells, least, most, most > least AS ragged FROM r""")
def ragged_depth(spark, d):
    """Whether the cells of an arm hold unequal numbers of scored replicates."""
    c = table(spark, d, "scored").groupBy("model", "condition", "question_id").agg(F.count("score_classifier").alias("depth"))
    return c.groupBy("model", "condition").agg(F.count("*").alias("cells"), F.min("depth").alias("least"), F.max("depth").alias("most"), (F.max("depth") > F.min("depth")).alias("ragged"))


@R.add("""WITH p AS (SELECT DISTINCT question_id, condition, sha256(coalesce(system_prompt, '') || '|' || coalesce(user_prompt, '')) AS h FROM scored) SELECT x.question_id, x.condition AS a, y.condition AS b, count(*) AS prompts FROM p x JOIN p y ON x.question_id = y.question_id AND x.h = y.h AND x.condition < y.condition GROUP BY ALL""")
def prompt_collisions(spark, d):
    """Conditions of a question that were asked with one and the same prompt."""
    h = F.sha2(F.concat(F.coalesce("system_prompt", F.lit("")), F.lit("|"), F.coalesce("user_prompt", F.lit(""))), 256)
    p = table(spark, d, "scored").select("question_id", "condition", h.alias("h")).distinct()
    return p.alias("x").join(p.alias("y"), F.expr("x.question_id = y.question_id and x.h = y.h and x.condition < y.condition")).groupBy("x.question_id", F.col("x.condition").alias("a"), F.col("y.condition").alias("b")).agg(F.count("*").alias("prompts"))


@R.add("""WITH n AS (SELECT model, condition, count(DISTINCT seed) AS seeds, count(*) FILTER (WHERE valid) AS valid_, count(seed) - count(DISTINCT seed) AS repeats FROM sheets GROUP BY model, condition), pl AS (SELECT m.model, c.condition FROM (SELECT DISTINCT model FROM sheets) m, (SELECT DISTINCT condition FROM sheets) c)
  SELECT pl.model, pl.condition, coalesce(seeds, 0) AS seeds, coalesce(repeats, 0) AS repeats, CASE WHEN n.model IS NULL THEN 'missing' WHEN valid_ = 0 THEN 'empty' WHEN seeds < 3 THEN 'short' ELSE 'complete' END AS status FROM pl LEFT JOIN n ON n.model = pl.model AND n.condition = pl.condition""")
def wave_cells(spark, d):
    """Planned cells (every model under every condition): missing, empty, short of three seeds."""
    s = table(spark, d, "sheets")
    n = s.groupBy("model", "condition").agg(F.count_distinct("seed").alias("seeds"), F.count_if("valid").alias("ok_"), (F.count("seed") - F.count_distinct("seed")).alias("repeats"))
    planned = s.select("model").distinct().crossJoin(F.broadcast(s.select("condition").distinct()))
    status = F.when(F.col("seeds").isNull(), "missing").when(F.col("ok_") == 0, "empty").when(F.col("seeds") < 3, "short").otherwise("complete")
    return planned.join(n, ["model", "condition"], "left").select("model", "condition", F.coalesce("seeds", F.lit(0)).alias("seeds"), F.coalesce("repeats", F.lit(0)).alias("repeats"), status.alias("status"))


@R.add("""WITH k AS (SELECT unnest(json_keys(payload)) AS field, payload FROM raw_lines WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'), t AS (SELECT field, json_type(payload, '$."' || field || '"') AS t FROM k)
  SELECT field, CASE WHEN t IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN 'number' WHEN t = 'VARCHAR' THEN 'string' WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t = 'ARRAY' THEN 'array' WHEN t = 'OBJECT' THEN 'object' ELSE 'null' END AS type, count(*) AS n FROM t GROUP BY 1, 2""")
def field_types(spark, d):
    """Type histogram of every field of the raw records, nulls included."""
    from tallyforge.operators import drift

    r = table(spark, d, "raw_lines").select(F.lit("all").alias("collector"), F.lit(1).alias("file_no"), "payload")
    f = drift._fields(drift.readable(r)).filter("field is not null")
    return f.groupBy("field", F.coalesce("type", F.lit("null")).alias("type")).agg(F.count("*").alias("n"))


_DET = f"{_DELTAS}, {boot_sql('u', 'model', 'question_id', 'delta', 1000)}, ms AS (SELECT key, b, ROUND(avg(value), 9) AS m FROM dr GROUP BY key, b), ci AS (SELECT key, list_sort(list(m)) AS s FROM ms GROUP BY key)"


@R.add(f"""WITH {_DET}, e AS (SELECT u.model, count(*) AS n, avg(delta) AS mean, any_value(s)[26] AS lo, any_value(s)[976] AS hi FROM u JOIN ci ON ci.key = u.model GROUP BY u.model)
  SELECT model, n, ROUND(mean, 6) + 0.0 AS mean, ROUND(lo, 6) + 0.0 AS lo, ROUND(hi, 6) + 0.0 AS hi, CASE WHEN lo = hi THEN 'degenerate' WHEN greatest(abs(lo), abs(hi)) < 1 THEN 'within margin' ELSE 'not excluded' END AS verdict FROM e""")
def equivalence_bootstrap(spark, d):
    """Largest effect that a bootstrap interval does not exclude, against a margin of one point."""
    u = _deltas(spark, d)
    m = B.replicates(u, "model", ["question_id"], "delta", 1000, 1).groupBy("model", "b").agg(F.round(F.avg("value"), 9).alias("m"))
    e = u.groupBy("model").agg(F.count("*").alias("n"), F.avg("delta").alias("mean")).join(B.interval(m, "model", "m", 1000), "model")
    verdict = F.when(F.col("lo") == F.col("hi"), "degenerate").when(F.greatest(F.abs("lo"), F.abs("hi")) < 1, "within margin").otherwise("not excluded")
    return e.select("model", "n", *[F.expr(f"ROUND({c}, 6) + 0.0").alias(c) for c in ("mean", "lo", "hi")], verdict.alias("verdict"))


@R.add()
def mde_bisection(spark, d):
    """Smallest common shift of the models' mean deltas that a sign-flip test finds in four of
    five simulations, by bisection over named draws (iterative; the input is one row a model)."""
    x = [r[0] for r in _deltas(spark, d).groupBy("model").agg(F.round(F.avg("delta"), 9).alias("x")).orderBy("model").select("x").limit(10_000).collect()]
    got = stats.bisect_shift(x)
    return spark.createDataFrame([(len(x), got)], "models bigint, mde double")


@R.add()
def restricted_permutation(spark, d):
    """Per model: sum of squared frame totals and its exact p when the two halves of each pair
    are relabelled within the pair (enumeration; null beyond 400,000 relabellings)."""
    a = _answers(spark, d).join(F.broadcast(table(spark, d, "item_bank").select(F.col("id").alias("q"), "pair_no", "frame")), "q")
    m = a.groupBy("model", "pair_no").agg(*[F.avg(F.when(F.col("frame") == f, F.col("position") - 1.5)).alias(f) for f in ("critic", "defender")]).dropna()

    def run(df):
        import pandas as pd

        got = B.restricted_null({int(r.pair_no): [r.critic, r.defender] for r in df.sort_values("pair_no").itertuples()})
        return pd.DataFrame([(df["model"].iloc[0], len(df), *(got or (None, None)))], columns=["model", "pairs", "statistic", "p"])

    return m.groupBy("model").applyInPandas(run, "model string, pairs bigint, statistic double, p double")


_FC = "r AS (SELECT condition, count(*) FILTER (WHERE failure_mode = 'refused') AS x, count(*) AS n FROM sheets WHERE failure_mode IS DISTINCT FROM 'transport' AND regexp_matches(condition, '^F[01][01][01]$') GROUP BY condition)"
_FDRAWS = 500


@R.add(f"""WITH {_FC}, p AS (SELECT sum(x) / sum(n) AS p FROM r), u AS (SELECT condition AS key, n, unnest(range(0, n)) AS i FROM r), dd AS (SELECT key, n, b, count(*) FILTER (WHERE {draw_sql('key', '1000000', 5)} < floor((SELECT p FROM p) * 1000000)) AS x FROM (SELECT *, unnest(range(0, {_FDRAWS})) AS b FROM u) GROUP BY key, n, b),
  g AS (SELECT b, max(x / n) - min(x / n) AS spread FROM dd GROUP BY b), o AS (SELECT max(x / n) - min(x / n) AS seen FROM r)
  SELECT ROUND((SELECT p FROM p), 6) AS pooled_rate, ROUND(seen, 6) AS seen_spread, ROUND(list_sort(list(spread))[{_FDRAWS // 10}], 6) AS p10, ROUND(list_sort(list(spread))[{_FDRAWS // 2}], 6) AS p50, ROUND(list_sort(list(spread))[{9 * _FDRAWS // 10}], 6) AS p90, ROUND(avg((ROUND(spread, 9) >= ROUND(seen, 9))::INT), 6) AS share_as_wide FROM g, o GROUP BY seen""")
def factorial_null(spark, d):
    """Spread of refusal rates between factorial cells if all refused at the pooled rate: named
    Bernoulli draws of every sheet, 10/50/90% points and the share of draws as wide as seen."""
    s = table(spark, d, "sheets").filter(~F.col("failure_mode").eqNullSafe("transport") & F.col("condition").rlike("^F[01][01][01]$"))
    r = s.groupBy("condition").agg(F.count_if(F.coalesce(F.col("failure_mode") == "refused", F.lit(False))).alias("x"), F.count("*").alias("n"))
    o = r.agg((F.sum("x") / F.sum("n")).alias("p"), (F.max(F.col("x") / F.col("n")) - F.min(F.col("x") / F.col("n"))).alias("seen"))
    u = r.crossJoin(F.broadcast(o)).select("condition", "n", "p", "seen", F.explode(F.expr("sequence(0L, n - 1)")).alias("i")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(_FDRAWS - 1))))
    u = B.with_draw(u, "h", 5, F.col("condition"), F.col("b"), F.col("i"), F.lit(1_000_000))
    g = u.groupBy("condition", "n", "b", "p", "seen").agg(F.count_if(F.col("h") < F.floor(F.col("p") * 1_000_000)).alias("x")).groupBy("b", "p", "seen").agg((F.max(F.col("x") / F.col("n")) - F.min(F.col("x") / F.col("n"))).alias("spread"))
    a = F.sort_array(F.collect_list("spread"))
    at = lambda k: F.round(F.element_at(a, k), 6)
    return g.groupBy("p", "seen").agg(at(_FDRAWS // 10).alias("p10"), at(_FDRAWS // 2).alias("p50"), at(9 * _FDRAWS // 10).alias("p90"), F.round(F.avg((F.round("spread", 9) >= F.round("seen", 9)).cast("int")), 6).alias("share_as_wide")).select(F.round("p", 6).alias("pooled_rate"), F.round("seen", 6).alias("seen_spread"), "p10", "p50", "p90", "share_as_wide")


_HOLES = f"""u AS (SELECT q AS item, sheet_id, position AS value FROM ans WHERE condition = 'N')"""


@R.add(f"""WITH {ANS}, {_HOLES}, {boot_sql('u', 'item', 'sheet_id', 'value', 200)}, bm AS (SELECT b, key, avg(value) AS x FROM dr GROUP BY b, key), ax AS (SELECT b, ROUND(sum(x) / 8 + 0.38, 9) AS economic, ROUND(sum(x) / 19.5 + 2.41, 9) AS social FROM bm GROUP BY b)
  SELECT count(*) AS draws, ROUND(avg(economic), 6) AS economic, ROUND(list_sort(list(economic))[6], 6) AS economic_lo, ROUND(list_sort(list(economic))[196], 6) AS economic_hi, ROUND(avg(social), 6) AS social FROM ax""")
def missingness_simulation(spark, d):
    """Axis scores when each item takes its answers from donors drawn among those who gave one:
    items with holes resample their own donors."""
    u = _answers(spark, d).filter("condition = 'N'").select(F.col("q").alias("item"), "sheet_id", "position")
    bm = B.replicates(u, "item", ["sheet_id"], "position", 200, 1).groupBy("b", "item").agg(F.avg("value").alias("x"))
    ax = bm.groupBy("b").agg(F.round(F.sum("x") / 8 + 0.38, 9).alias("e"), F.round(F.sum("x") / 19.5 + 2.41, 9).alias("s"))
    a = F.sort_array(F.collect_list("e"))
    return ax.agg(F.count("*").alias("draws"), F.round(F.avg("e"), 6).alias("economic"), F.round(F.element_at(a, 6), 6).alias("economic_lo"), F.round(F.element_at(a, 196), 6).alias("economic_hi"), F.round(F.avg("s"), 6).alias("social"))


@R.add(f"""WITH {ANS}, dy AS (SELECT ans.*, substr(s.collected_at, 1, 10) AS day FROM ans JOIN sheets s USING (sheet_id) WHERE ans.condition IN ('A', 'D')), md AS (SELECT model, condition, day, q, position AS modal FROM (SELECT model, condition, day, q, position, row_number() OVER (PARTITION BY model, condition, day, q ORDER BY count(*) DESC, position) AS r FROM dy GROUP BY model, condition, day, q, position) WHERE r = 1),
  last AS (SELECT model, condition, max(day) AS day, count(DISTINCT day) AS days FROM dy GROUP BY model, condition), k AS (SELECT md.*, days FROM md JOIN last ON md.model = last.model AND md.condition = last.condition AND md.day = last.day)
  SELECT x.model, x.day AS day_a, y.day AS day_d, any_value(x.days > 1 OR y.days > 1) AS split_days, count(*) AS shared, count(*) FILTER (WHERE (x.modal >= 2) <> (y.modal >= 2)) AS side_flips FROM k x JOIN k y ON x.model = y.model AND x.q = y.q AND x.condition = 'A' AND y.condition = 'D' GROUP BY x.model, x.day, y.day""")
def prompt_later_day(spark, d):
    """The historical A to D arm: cells by day of collection, the later day wins; whether either
    arm was collected over several days."""
    days = table(spark, d, "sheets").select("sheet_id", F.substring("collected_at", 1, 10).alias("day"))
    a = _answers(spark, d).filter("condition in ('A', 'D')").join(days, "sheet_id")
    last = a.groupBy("model", "condition").agg(F.max("day").alias("day"), F.count_distinct("day").alias("days"))
    k = S.modal(a, ["model", "condition", "day"]).join(last, ["model", "condition", "day"])
    side = lambda c, s: k.filter(F.col("condition") == c).select("model", "q", *[F.col(x).alias(f"{x}_{s}") for x in ("modal", "day", "days")])
    both = side("A", "a").join(side("D", "d"), ["model", "q"])
    return both.groupBy("model", "day_a", "day_d").agg(F.bool_or((F.col("days_a") > 1) | (F.col("days_d") > 1)).alias("split_days"), F.count("*").alias("shared"), F.count_if((F.col("modal_a") >= 2) != (F.col("modal_d") >= 2)).alias("side_flips"))


_BACK = f"""{ANS}, pv AS (SELECT ans.*, s.provider FROM ans JOIN sheets s USING (sheet_id) WHERE s.provider IS NOT NULL), tw AS (SELECT model, min(provider) AS a, max(provider) AS b, count(DISTINCT provider) AS k FROM pv GROUP BY model),
  bm AS (SELECT model, provider, shuffle_seed, q, position AS modal FROM (SELECT model, provider, shuffle_seed, q, position, row_number() OVER (PARTITION BY model, provider, shuffle_seed, q ORDER BY count(*) DESC, position) AS r FROM pv WHERE shuffle_seed IS NOT NULL GROUP BY model, provider, shuffle_seed, q, position) WHERE r = 1)"""


@R.add(f"""WITH {_BACK}, f AS (SELECT model, median(flips) AS between_ FROM (SELECT x.model, x.shuffle_seed, count(*) FILTER (WHERE (x.modal >= 2) <> (y.modal >= 2)) AS flips FROM bm x JOIN bm y ON x.model = y.model AND x.shuffle_seed = y.shuffle_seed AND x.q = y.q JOIN tw ON tw.model = x.model AND x.provider = tw.a AND y.provider = tw.b AND a < b GROUP BY x.model, x.shuffle_seed) GROUP BY model),
  o AS (SELECT model, max(flips) AS own FROM (SELECT x.model, x.provider, x.shuffle_seed, y.shuffle_seed AS other, count(*) FILTER (WHERE (x.modal >= 2) <> (y.modal >= 2)) AS flips FROM bm x JOIN bm y ON x.model = y.model AND x.provider = y.provider AND x.q = y.q AND x.shuffle_seed < y.shuffle_seed JOIN tw ON tw.model = x.model AND x.provider IN (tw.a, tw.b) GROUP BY ALL) GROUP BY model)
  SELECT tw.model, tw.k AS backends, between_ AS between_backends, own AS own_order_floor, CASE WHEN tw.k < 2 THEN 'one backend' WHEN between_ IS NULL THEN 'insufficient' WHEN own IS NULL THEN 'no floor' WHEN between_ > own THEN 'exceeds floor' ELSE 'within floor' END AS verdict FROM tw LEFT JOIN f ON f.model = tw.model LEFT JOIN o ON o.model = tw.model""")
def serving_floor(spark, d):
    """Flips between a model's first and last backend on shared orders, against the larger of
    both backends' own distances between orders."""
    a = _answers(spark, d).join(table(spark, d, "sheets").filter("provider is not null").select("sheet_id", "provider"), "sheet_id")
    tw = a.groupBy("model").agg(F.min("provider").alias("pa"), F.max("provider").alias("pb"), F.count_distinct("provider").alias("backends"))
    bm = S.modal(a.filter("shuffle_seed is not null"), ["model", "provider", "shuffle_seed"]).join(tw, "model").filter("provider in (pa, pb)")
    x = bm.filter("provider = pa and pa < pb").select("model", "shuffle_seed", "q", F.col("modal").alias("x"))
    y = bm.filter("provider = pb and pa < pb").select("model", "shuffle_seed", "q", F.col("modal").alias("y"))
    f = x.join(y, ["model", "shuffle_seed", "q"]).groupBy("model", "shuffle_seed").agg(F.count_if((F.col("x") >= 2) != (F.col("y") >= 2)).alias("f")).groupBy("model").agg(F.median("f").alias("between_backends"))
    o = S.distances(bm, ["model", "provider"], "shuffle_seed").groupBy("model").agg(F.max("side_flips").alias("own_order_floor"))
    verdict = F.when(F.col("backends") < 2, "one backend").when(F.col("between_backends").isNull(), "insufficient").when(F.col("own_order_floor").isNull(), "no floor").when(F.col("between_backends") > F.col("own_order_floor"), "exceeds floor").otherwise("within floor")
    return tw.join(f, "model", "left").join(o, "model", "left").select("model", "backends", "between_backends", "own_order_floor", verdict.alias("verdict"))


_CLAIMS = {
    "truncated responses": ("scored", "coalesce(tokens_out >= max_tokens, false)"), "empty responses": ("scored", "response_text IS NULL OR NOT regexp_matches(response_text, '[^ \\t\\r\\n]')"), "failed calls": ("scored", "ok IS NOT DISTINCT FROM false"),
    "cap not recorded": ("scored", "max_tokens IS NULL"), "scores without judges": ("scored", "score_classifier IS NOT NULL AND coalesce(score_classifier_n_valid, 0) = 0"), "cached replies": ("scored", "latency_ms < 50"),
    "degenerate sheets": ("sheets", "valid AND len(answers) > 1 AND len(list_distinct(list_transform(answers, lambda x: x.position))) = 1"), "unlabelled failures": ("sheets", "NOT valid AND failure_mode IS NULL"), "order not recorded": ("sheets", "shuffle_seed IS NULL"),
}


@R.add("SELECT name, checked, hits, CASE WHEN hits > 0.05 * checked THEN 'FAIL' WHEN hits > 0.01 * checked THEN 'WARN' ELSE 'OK' END AS status FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS checked, count(*) FILTER (WHERE {c}) AS hits FROM {t}" for k, (t, c) in _CLAIMS.items()) + ")")
def claim_gate(spark, d):
    """The nine checks before a claim: what share of the rows behind it is unfit."""
    out = None
    for t in ("scored", "sheets"):
        mine = {k: c for k, (s, c) in _CLAIMS.items() if s == t}
        sql = lambda c: c.replace("len(list_distinct(list_transform(answers, lambda x: x.position)))", "size(array_distinct(transform(answers, x -> x.position)))").replace("len(", "size(").replace("ok IS NOT DISTINCT FROM false", "ok <=> false").replace("regexp_matches(", "regexp_like(")
        agg = table(spark, d, t).agg(F.count("*").alias("checked"), *[F.count_if(F.coalesce(F.expr(sql(c)), F.lit(False))).alias(k) for k, c in mine.items()])
        part = agg.select("checked", F.explode(F.create_map(*[x for k in mine for x in (F.lit(k), F.col(f"`{k}`"))])).alias("name", "hits"))
        out = part if out is None else out.unionByName(part)
    return out.select("name", "checked", "hits", F.when(F.col("hits") > 0.05 * F.col("checked"), "FAIL").when(F.col("hits") > 0.01 * F.col("checked"), "WARN").otherwise("OK").alias("status"))


@R.add(f"""WITH n AS (SELECT sheet_id, c.k AS k, c.v AS v FROM (SELECT sheet_id, unnest(list_transform(answers, lambda a: {{'k': a.q, 'v': a.position}})) AS c FROM sheets)), g AS (SELECT sheet_id, k, count(*) AS times, count(DISTINCT v) AS kinds FROM n WHERE k IS NOT NULL GROUP BY sheet_id, k), x AS (SELECT sheet_id, count(*) FILTER (WHERE kinds > 1) AS contradicted, count(*) FILTER (WHERE times > 1 AND kinds <= 1) AS repeated, count(*) AS items, count(*) FILTER (WHERE k NOT IN (SELECT id FROM item_bank)) AS extra FROM g GROUP BY sheet_id)
  SELECT sheet_id, items - contradicted AS kept, contradicted, repeated, extra, (SELECT count(*) FROM item_bank) - (items - extra) AS missing FROM x WHERE contradicted > 0 OR repeated > 0 OR extra > 0""")
def answer_problems(spark, d):
    """Sheets with repeated answers: a repeat that agrees counts once, one that contradicts
    invalidates its item; items outside the bank are extra, unanswered ones missing."""
    n = table(spark, d, "sheets").select("sheet_id", F.explode("answers").alias("a")).select("sheet_id", F.col("a.q").alias("k"), F.col("a.position").alias("v")).filter("k is not null")
    g = n.groupBy("sheet_id", "k").agg(F.count("*").alias("times"), F.count_distinct("v").alias("kinds"))
    bank = table(spark, d, "item_bank").select(F.col("id").alias("k"), F.lit(True).alias("known"))
    g = g.join(F.broadcast(bank), "k", "left")
    x = g.groupBy("sheet_id").agg(F.count_if(F.col("kinds") > 1).alias("contradicted"), F.count_if((F.col("times") > 1) & (F.col("kinds") <= 1)).alias("repeated"), F.count("*").alias("items"), F.count_if(F.col("known").isNull()).alias("extra"))
    size = bank.agg(F.count("*").alias("bank"))
    return x.filter("contradicted > 0 or repeated > 0 or extra > 0").crossJoin(F.broadcast(size)).selectExpr("sheet_id", "items - contradicted AS kept", "contradicted", "repeated", "extra", "bank - (items - extra) AS missing")


QUERIES, SQL = R.queries, R.sql
