"""Data-quality gates, text matching, lineage and further reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.operators import scored as C
from tallyforge.operators import sheets as S
from tallyforge.plans.base import ANS, Registry, distance_sql, modal_sql, table
from tallyforge.plans.scored_queries import _CELLS, _KEY, _PQ

R = Registry()

_FOLD = "coalesce(text, '')"
for _k, _v in X.ENTITIES.items():
    _FOLD = f"replace({_FOLD}, '{_k}', '{_v.replace(chr(39), chr(39) * 2)}')"
_WORDS = rf"list_filter(string_split(regexp_replace(replace(lower({_FOLD}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _windows(table_: str, key: str, size: int) -> str:
    """(key, h) of every window of ``size`` words and of one word less, as SQL."""
    parts = [f"SELECT {key}, w, i, {k} AS k FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS i FROM f WHERE len(w) > 0)" for k in (size, size - 1)]
    return f"WITH f AS (SELECT {key}, {_WORDS} AS w FROM {table_}), x AS ({parts[0]} UNION ALL SELECT * FROM ({parts[1]}) WHERE len(w) >= {size}) SELECT {key}, substr(sha256(array_to_string(w[i:i+k-1], ' ')), 1, 16) AS h FROM x"


@R.add(f"""WITH s AS (SELECT model, count(*) AS sheets, avg(least(len(list_distinct(list_transform(answers, lambda a: a.q))), n_items) / n_items) AS parsed, count(*) FILTER (WHERE coalesce(failure_mode, '') = 'transport') AS transport,
  count(*) FILTER (WHERE len(answers) = 0 AND coalesce(failure_mode, '') <> 'refused') AS lost FROM sheets GROUP BY model)
  SELECT model, sheets, ROUND(parsed, 9) AS parse_rate, transport, lost, lost / sheets > 0.05 AS blocks FROM s""")
def collection_acceptance(spark, d):
    f = F.coalesce("failure_mode", F.lit(""))
    items = F.least(F.size(F.array_distinct(F.transform("answers", lambda a: a["q"]))), F.col("n_items"))
    s = table(spark, d, "sheets").groupBy("model").agg(F.count("*").alias("sheets"), F.round(F.avg(items / F.col("n_items")), 9).alias("parse_rate"), F.count_if(f == "transport").alias("transport"), F.count_if((F.size("answers") == 0) & (f != "refused")).alias("lost"))
    return s.withColumn("blocks", F.col("lost") / F.col("sheets") > 0.05)


_ID64 = "('0x' || substr(md5(CAST(record_id AS VARCHAR)), 1, 12))::BIGINT"


@R.add(f"SELECT run, count(*) AS on_disk, count(DISTINCT model) AS models, CAST(sum(tokens_out) AS BIGINT) AS tokens, CAST(sum({_ID64}) % 2147483647 AS BIGINT) AS id_sum, bit_xor({_ID64}) AS id_xor FROM scored GROUP BY run")
def corpus_signature(spark, d):
    """An order-free digest of each run's record ids (sum and xor of their hashes), so that no
    task ever holds a run's list of ids."""
    h = F.conv(F.substring(F.md5(F.col("record_id").cast("string")), 1, 12), 16, 10).cast("bigint")
    total = (F.sum(h.cast("decimal(38,0)")) % F.lit(2147483647).cast("decimal(38,0)")).cast("bigint")
    return table(spark, d, "scored").groupBy("run").agg(F.count("*").alias("on_disk"), F.count_distinct("model").alias("models"), F.sum("tokens_out").cast("bigint").alias("tokens"), total.alias("id_sum"), F.bit_xor(h).alias("id_xor"))


@R.add("""WITH spec(field, want) AS (VALUES ('schema', 'battery-run/1'), ('instrument', 'stance-battery'), ('n_items', '32')), f AS (SELECT sheet_id, 'schema' AS field, schema AS got FROM sheets UNION ALL SELECT sheet_id, 'instrument', instrument FROM sheets UNION ALL SELECT sheet_id, 'n_items', CAST(n_items AS VARCHAR) FROM sheets)
  SELECT spec.field, got, count(*) AS n FROM f JOIN spec ON f.field = spec.field WHERE got IS NOT NULL AND got <> want GROUP BY spec.field, got""")
def wave_verification(spark, d):
    spec = {"schema": "battery-run/1", "instrument": "stance-battery", "n_items": "32"}
    s = table(spark, d, "sheets").select(F.explode(F.create_map(*[x for c in spec for x in (F.lit(c), F.col(c).cast("string"))])).alias("field", "got"))
    want = F.create_map(*[F.lit(x) for kv in spec.items() for x in kv])
    return s.filter(F.col("got").isNotNull() & (F.col("got") != want[F.col("field")])).groupBy("field", "got").agg(F.count("*").alias("n"))


@R.add("WITH p AS (SELECT DISTINCT split_part(model, '/', 1) AS vendor FROM scored) SELECT 'panel' AS check_name, count(*) AS models, count(*) FILTER (WHERE vendor NOT IN (SELECT vendor FROM p)) AS unclassified FROM (SELECT DISTINCT model, split_part(model, '/', 1) AS vendor FROM sheets)")
def panel_closure(spark, d):
    """Models of the sheets whose vendor the judged panel does not declare
    (:func:`scored.assert_closed` fails on them instead)."""
    vendor = F.split("model", "/")[0].alias("vendor")
    panel = table(spark, d, "scored").select(vendor).distinct().withColumn("known", F.lit(True))
    m = table(spark, d, "sheets").select("model").distinct().select("model", vendor).join(panel, "vendor", "left")
    return m.agg(F.lit("panel").alias("check_name"), F.count("*").alias("models"), F.count_if(F.col("known").isNull()).alias("unclassified"))


@R.add("SELECT condition, count(*) AS n, condition IN ('A', 'B', 'C', 'D', 'E', 'N', 'P', 'B-prime', 'B-Layered') AS known FROM scored GROUP BY condition")
def condition_labels(spark, d):
    known = F.col("condition").isin("A", "B", "C", "D", "E", "N", "P", "B-prime", "B-Layered")
    return table(spark, d, "scored").groupBy("condition").agg(F.count("*").alias("n")).withColumn("known", known)


@R.add("SELECT schema, count(*) AS n FROM sheets WHERE schema IN ('battery-run/1', 'compass-run/1') GROUP BY schema")
def schema_filter(spark, d):
    return table(spark, d, "sheets").filter(F.col("schema").isin("battery-run/1", "compass-run/1")).groupBy("schema").agg(F.count("*").alias("n"))


@R.add("""WITH f AS (SELECT unnest(['topic', 'sample_idx', 'tokens_in', 'tokens_out', 'max_tokens', 'finish_reason', 'truncated']) AS field, unnest([topic IS NOT NULL, sample_idx IS NOT NULL, tokens_in IS NOT NULL, tokens_out IS NOT NULL, max_tokens IS NOT NULL, finish_reason IS NOT NULL, truncated IS NOT NULL]) AS held FROM scored)
  SELECT field, count(*) FILTER (WHERE held) AS held, count(*) AS n, ROUND(avg(held::INT), 9) AS coverage FROM f GROUP BY field""")
def field_coverage(spark, d):
    fields = ("topic", "sample_idx", "tokens_in", "tokens_out", "max_tokens", "finish_reason", "truncated")
    s = table(spark, d, "scored").agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in fields])
    u = s.select("n", F.explode(F.create_map(*[x for c in fields for x in (F.lit(c), F.col(c))])).alias("field", "held"))
    return u.withColumn("coverage", F.round(F.col("held") / F.col("n"), 9))


@R.add("""WITH r AS (SELECT *, sha256(concat_ws('|', model, question_id, condition, CAST(seed AS VARCHAR), coalesce(response_text, ''))) AS h, run LIKE '%recollect%' AS side FROM scored)
  SELECT run, count(*) AS only_here FROM r WHERE side AND NOT EXISTS (SELECT 1 FROM r x WHERE NOT x.side AND x.h = r.h) GROUP BY run""")
def identity_anti_join(spark, d):
    r = table(spark, d, "scored").select("run", F.sha2(F.concat_ws("|", "model", "question_id", "condition", F.col("seed").cast("string"), F.coalesce("response_text", F.lit(""))), 256).alias("h"), F.col("run").like("%recollect%").alias("side"))
    return r.filter("side").join(r.filter("not side").select("h"), "h", "left_anti").groupBy("run").agg(F.count("*").alias("only_here"))


@R.add(f"WITH h AS (SELECT DISTINCT item_id, h FROM ({_windows('eval_items', 'item_id', 9)})) SELECT h, count(*) AS items FROM h GROUP BY h HAVING count(*) > 1")
def shared_shingles(spark, d):
    w = table(spark, d, "eval_items").select("item_id", F.explode(X.windows(X.fold_words(F.col("text")), 9, both=True)).alias("t")).select("item_id", X.fingerprint(F.col("t")).alias("h")).distinct()
    return w.groupBy("h").agg(F.count("*").alias("items")).filter("items > 1")


@R.add(f"""WITH b AS (SELECT DISTINCT id, h FROM ({_windows('item_bank', 'id', 6)})), banned AS (SELECT h FROM b GROUP BY h HAVING count(*) < 4)
  SELECT doc_id, count(*) AS windows FROM ({_windows('documents', 'doc_id', 6)}) WHERE h IN (SELECT h FROM banned) GROUP BY doc_id""")
def fingerprint_scan(spark, d):
    """Documents with windows of six or five words of the bank; phrases of four or more items
    are allowed spans, stock wording that no document leaks."""
    windows = lambda t, key: table(spark, d, t).select(key, F.explode(X.windows(X.fold_words(F.col("text")), 6, both=True)).alias("t"))
    bank = windows("item_bank", "id").distinct().groupBy("t").agg(F.count("*").alias("items")).filter("items < 4")
    banned = bank.select(X.fingerprint(F.col("t")).alias("h"), F.xxhash64("t").alias("x"))
    # a quick hash passes few windows; only those are fingerprinted
    near = windows("documents", "doc_id").withColumn("x", F.xxhash64("t")).join(banned.select("x").distinct(), "x", "left_semi")
    return near.select("doc_id", X.fingerprint(F.col("t")).alias("h")).join(banned.select("h"), "h", "left_semi").groupBy("doc_id").agg(F.count("*").alias("windows"))


@R.add(f"""WITH {_CELLS}, r AS (SELECT s.model, substr(s.run, 1, 7) AS month, avg(s.score_classifier) AS x FROM scored s WHERE s.condition = 'B' GROUP BY 1, 2)
  SELECT model, month, ROUND(x - first_value(x) OVER (PARTITION BY model ORDER BY month), 9) AS drift, CASE WHEN x - first_value(x) OVER (PARTITION BY model ORDER BY month) > 0.25 THEN 'up' WHEN x - first_value(x) OVER (PARTITION BY model ORDER BY month) < -0.25 THEN 'down' ELSE 'flat' END AS direction FROM r WHERE x IS NOT NULL""")
def drift_direction(spark, d):
    r = table(spark, d, "scored").filter("condition = 'B'").groupBy("model", F.substring("run", 1, 7).alias("month")).agg(F.avg("score_classifier").alias("x")).filter("x is not null")
    z = F.col("x") - F.first("x").over(Window.partitionBy("model").orderBy("month"))
    return r.select("model", "month", z.alias("z")).select("model", "month", F.round("z", 9).alias("drift"), F.when(F.col("z") > 0.25, "up").when(F.col("z") < -0.25, "down").otherwise("flat").alias("direction"))


@R.add("""WITH f AS (SELECT split_part(model, '/', 1) AS vendor, regexp_extract(split_part(model, '/', 2), '^([a-z]+)', 1) AS stem, CAST(regexp_extract(model, '-([0-9]+(?:\\.[0-9]+)?)(?:-|$)', 1) AS DOUBLE) AS version, avg(score_classifier) AS x, count(DISTINCT run) AS runs FROM scored WHERE condition = 'A' GROUP BY 1, 2, 3)
  SELECT vendor, stem, version, ROUND(x, 9) AS mean_score, row_number() OVER (PARTITION BY vendor, stem ORDER BY version) AS step, runs FROM f WHERE x IS NOT NULL""")
def family_arc(spark, d):
    name = F.split("model", "/")
    version = F.regexp_extract("model", r"-([0-9]+(?:\.[0-9]+)?)(?:-|$)", 1).cast("double")
    f = table(spark, d, "scored").filter("condition = 'A'").groupBy(name[0].alias("vendor"), F.regexp_extract(name[1], "^([a-z]+)", 1).alias("stem"), version.alias("version")).agg(F.avg("score_classifier").alias("x"), F.count_distinct("run").alias("runs")).filter("x is not null")
    return f.select("vendor", "stem", "version", F.round("x", 9).alias("mean_score"), F.row_number().over(Window.partitionBy("vendor", "stem").orderBy("version")).cast("bigint").alias("step"), "runs")


@R.add(f"""WITH {ANS}, {_PQ}, j AS (SELECT model, avg(b - a) AS delta FROM pq GROUP BY model), m AS (SELECT model, avg((position >= 2)::INT) AS agree FROM ans GROUP BY model)
  SELECT j.model, ROUND(delta, 9) AS judged_delta, ROUND(agree, 9) AS agree_rate FROM j JOIN m ON j.model = m.model WHERE delta IS NOT NULL""")
def judged_vs_mechanical(spark, d):
    q = C.pair_arms(C.replicate_means(table(spark, d, "scored"), _KEY), ["model", "question_id"], "condition", "mean_score", ["A", "B"])
    j = q.groupBy("model").agg(F.avg(F.expr("B - A")).alias("delta")).filter("delta is not null")
    m = S.answers(table(spark, d, "sheets")).groupBy("model").agg(F.avg(S.side(F.col("position")).cast("int")).alias("agree"))
    return j.join(m, "model").select("model", F.round("delta", 9).alias("judged_delta"), F.round("agree", 9).alias("agree_rate"))


@R.add(f"""WITH {ANS}, c AS (SELECT model, count(DISTINCT sheet_id) AS sheets, count(DISTINCT condition) AS conditions FROM ans GROUP BY model), f AS (SELECT model, avg((coalesce(failure_mode, '') = 'refused')::INT) AS refusal FROM sheets GROUP BY model),
  p AS ({distance_sql('ans', ['model', 'condition'], 'sheet_id', 'position')}), q AS (SELECT model, median(side_flips) AS med, max(side_flips) AS mx FROM p GROUP BY model)
  SELECT c.model, sheets, conditions, ROUND(refusal, 9) AS refusal_rate, med AS replicate_median, mx AS replicate_max FROM c JOIN f ON f.model = c.model LEFT JOIN q ON q.model = c.model""")
def model_cards(spark, d):
    ans = S.answers(table(spark, d, "sheets"))
    c = ans.groupBy("model").agg(F.count_distinct("sheet_id").alias("sheets"), F.count_distinct("condition").alias("conditions"))
    f = table(spark, d, "sheets").groupBy("model").agg(F.round(F.avg((F.coalesce("failure_mode", F.lit("")) == "refused").cast("int")), 9).alias("refusal_rate"))
    h = S.at_ranks(S.replicate_distances(ans, ["model", "condition"]), ["model"], "side_flips", {"lo": "(total + 1) div 2", "hi": "total div 2 + 1"})
    q = h.select("model", ((F.col("lo") + F.col("hi")) / 2.0).alias("replicate_median"), F.col("_max").alias("replicate_max"))
    return c.join(f, "model").join(q, "model", "left")


@R.add("""WITH s AS (SELECT CASE WHEN channel = 'hosted' THEN 'hosted' ELSE 'local' END AS bucket, model, avg((coalesce(failure_mode, '') = 'refused')::INT) AS r FROM sheets GROUP BY 1, 2), b AS (SELECT bucket, count(*) AS models, avg(r) AS r FROM s GROUP BY bucket)
  SELECT x.bucket AS a, y.bucket AS b, x.models AS models_a, y.models AS models_b, ROUND(x.r - y.r, 9) AS gap FROM b x JOIN b y ON x.bucket < y.bucket""")
def cohort_gaps(spark, d):
    s = table(spark, d, "sheets").groupBy(F.when(F.col("channel") == "hosted", "hosted").otherwise("local").alias("bucket"), "model").agg(F.avg((F.coalesce("failure_mode", F.lit("")) == "refused").cast("int")).alias("r"))
    b = s.groupBy("bucket").agg(F.count("*").alias("models"), F.avg("r").alias("r"))
    return b.alias("x").join(b.alias("y"), F.expr("x.bucket < y.bucket")).selectExpr("x.bucket AS a", "y.bucket AS b", "x.models AS models_a", "y.models AS models_b", "ROUND(x.r - y.r, 9) AS gap")


@R.add(f"""WITH {ANS}, o AS (SELECT sheet_id, i.id, i.pair_no, i.frame, a.q, a.position, label_to_id FROM ans a JOIN item_bank i ON i.id = a.q JOIN sheets USING (sheet_id) WHERE renumbered),
  h AS (SELECT sheet_id, pair_no, max(CASE WHEN frame = 'critic' THEN position END) AS c, max(CASE WHEN frame = 'defender' THEN position END) AS dd FROM o GROUP BY sheet_id, pair_no),
  k AS (SELECT sheet_id, avg(((c - 1.5) * (dd - 1.5) < 0)::INT) AS by_id FROM h WHERE c IS NOT NULL AND dd IS NOT NULL GROUP BY sheet_id)
  SELECT sheet_id, ROUND(by_id, 9) AS consistency, CASE WHEN by_id >= 0.7 THEN 'by-id' WHEN by_id <= 0.3 THEN 'opposed' ELSE 'chance' END AS verdict FROM k""")
def sheet_attribution(spark, d):
    ids = table(spark, d, "sheets").filter("renumbered")
    p = S.pair_positions(S.answers(ids), table(spark, d, "item_bank"), ["sheet_id"])
    k = p.groupBy("sheet_id").agg(F.avg(F.col("consistent").cast("int")).alias("k"))
    return k.select("sheet_id", F.round("k", 9).alias("consistency"), F.when(F.col("k") >= 0.7, "by-id").when(F.col("k") <= 0.3, "opposed").otherwise("chance").alias("verdict"))


@R.add(f"""WITH {ANS}, cells AS ({modal_sql('model, condition')}) SELECT model, condition, ROUND(avg(CASE WHEN i.claim_type = 'normative' THEN modal - 1.5 END), 9) AS normative, ROUND(avg(CASE WHEN i.claim_type = 'documented' THEN modal - 1.5 END), 9) AS documented, count(*) AS n
  FROM cells JOIN item_bank i ON i.id = q GROUP BY model, condition""")
def axis_scores(spark, d):
    items = F.broadcast(table(spark, d, "item_bank").select(F.col("id").alias("q"), "claim_type"))
    c = S.modal(S.answers(table(spark, d, "sheets")), ["model", "condition"]).join(items, "q")
    on = lambda t: F.round(F.avg(F.when(F.col("claim_type") == t, F.col("modal") - 1.5)), 9)
    return c.groupBy("model", "condition").agg(on("normative").alias("normative"), on("documented").alias("documented"), F.count("*").alias("n"))


@R.add("""SELECT claim_type, frame, count(*) AS items, count(*) FILTER (WHERE ratchet IS NOT NULL) AS tagged, count(DISTINCT pair_no) AS pairs, count(*) FILTER (WHERE mirror_of IS NOT NULL) AS mirrored FROM item_bank GROUP BY claim_type, frame""")
def bank_alignment(spark, d):
    return table(spark, d, "item_bank").groupBy("claim_type", "frame").agg(F.count("*").alias("items"), F.count("ratchet").alias("tagged"), F.count_distinct("pair_no").alias("pairs"), F.count("mirror_of").alias("mirrored"))


@R.add("""WITH t AS (SELECT model, condition, question_id, refusal_class IS NOT NULL AS flagged, coalesce(score_classifier <= 2, false) AS low FROM scored) SELECT condition, ROUND(avg(flagged::INT) - avg(low::INT), 9) AS gap, ROUND(avg((flagged <> low)::INT), 9) AS disagreement FROM t GROUP BY condition""")
def detector_disagreement(spark, d):
    flagged, low = F.col("refusal_class").isNotNull(), F.coalesce(F.col("score_classifier") <= 2, F.lit(False))
    return table(spark, d, "scored").groupBy("condition").agg(F.round(F.avg(flagged.cast("int")) - F.avg(low.cast("int")), 9).alias("gap"), F.round(F.avg((flagged != low).cast("int")), 9).alias("disagreement"))


@R.add("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, ROUND(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 9) AS mean_k FROM events GROUP BY user_id")
def event_props(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), F.round(F.avg(F.get_json_object("props", "$.k").cast("double")), 9).alias("mean_k"))


@R.add("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, ROUND(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_events(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@R.add("""SELECT r_name AS region, s.l_returnflag AS condition, grouping(r_name, l_returnflag) AS level, count(*) AS n, CAST(sum(s.l_quantity) AS DOUBLE) AS quantity FROM lineitem s JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  GROUP BY ROLLUP (r_name, l_returnflag)""")
def rollup_by_region(spark, d):
    dims = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.expr("n_nationkey = s_nationkey")).join(F.broadcast(table(spark, d, "region")), F.expr("r_regionkey = n_regionkey")).select("s_suppkey", F.col("r_name").alias("region"))
    x = table(spark, d, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("condition"), "l_quantity").join(dims, F.expr("s_suppkey = l_suppkey"))
    return x.rollup("region", "condition").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


QUERIES, SQL = R.queries, R.sql
