"""Queries over answer sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators import sheets as S
from tallyforge.plans.base import ANS, Registry, distance_sql, floor_sql, modal_sql, table

R = Registry()
MCO = "model, condition, template, shuffle_seed"
BANK = "JOIN item_bank i ON i.id = q"
PAIRS = f"""pairs AS (SELECT {{key}}, pair_no, critic, defender, (critic - defender) / 2.0 AS position, (critic - 1.5) * (defender - 1.5) < 0 AS consistent,
  critic >= 2 AND defender >= 2 AS agree_both, critic < 2 AND defender < 2 AS disagree_both FROM (SELECT {{key}}, pair_no, max(CASE WHEN frame = 'critic' THEN position END) AS critic,
  max(CASE WHEN frame = 'defender' THEN position END) AS defender FROM ans {BANK} GROUP BY {{key}}, pair_no) WHERE critic IS NOT NULL AND defender IS NOT NULL)"""


def _answers(spark, d) -> DataFrame:
    return S.answers(table(spark, d, "sheets"))


@R.add(f"WITH {ANS} {modal_sql('model, condition')}")
def modal_answers(spark, d):
    return S.modal(_answers(spark, d), ["model", "condition"])


@R.add(f"WITH {ANS}, cells AS ({modal_sql(MCO)}), pairs AS ({distance_sql('cells', ['model', 'condition', 'template'], 'shuffle_seed')}) {floor_sql('pairs', 'order')}")
def order_floor(spark, d):
    cells = S.modal(_answers(spark, d), ["model", "condition", "template", "shuffle_seed"])
    return S.floor(S.distances(cells, ["model", "condition", "template"], "shuffle_seed"), "order")


@R.add(f"WITH {ANS}, cells AS ({modal_sql(MCO)}) {distance_sql('cells', ['model', 'condition', 'template'], 'shuffle_seed')}")
def order_pairs(spark, d):
    return S.distances(S.modal(_answers(spark, d), ["model", "condition", "template", "shuffle_seed"]), ["model", "condition", "template"], "shuffle_seed")


@R.add(f"WITH {ANS}, pairs AS ({distance_sql('ans', ['model', 'condition', 'template', 'shuffle_seed', 'temperature'], 'sheet_id', 'position')}) {floor_sql('pairs', 'replicate')}")
def replicate_floor(spark, d):
    return S.floor(S.replicate_distances(_answers(spark, d), ["model", "condition", "template", "shuffle_seed", "temperature"]), "replicate", "n")


@R.add(f"WITH {ANS}, cells AS ({modal_sql('model, condition, template')}), pairs AS ({distance_sql('cells', ['model', 'condition'], 'template')}) {floor_sql('pairs', 'paraphrase')}")
def paraphrase_floor(spark, d):
    return S.floor(S.distances(S.modal(_answers(spark, d), ["model", "condition", "template"]), ["model", "condition"], "template"), "paraphrase")


@R.add(f"WITH {ANS}, cells AS ({modal_sql('model, condition')}), pairs AS ({distance_sql('cells', ['model'], 'condition')}) {floor_sql('pairs', 'condition')}")
def condition_floor(spark, d):
    return S.floor(S.distances(S.modal(_answers(spark, d), ["model", "condition"]), ["model"], "condition"), "condition")


@R.add(f"WITH {ANS}, cells AS ({modal_sql('model, condition')}) SELECT model, shared, side_flips, endpoint_delta FROM ({distance_sql('cells', ['model'], 'condition')}) WHERE a = 'A' AND b = 'D'")
def prompt_a_to_d(spark, d):
    return S.distances(S.modal(_answers(spark, d), ["model", "condition"]), ["model"], "condition").filter("a = 'A' and b = 'D'").select("model", "shared", "side_flips", "endpoint_delta")


@R.add(f"""WITH {ANS}, cells AS (SELECT *, CASE WHEN channel = 'hosted' THEN 'hosted' ELSE 'local' END AS served FROM (SELECT {MCO}, channel, q, position AS modal FROM (SELECT {MCO}, channel, q, position,
  row_number() OVER (PARTITION BY {MCO}, channel, q ORDER BY count(*) DESC, position) AS r FROM ans GROUP BY {MCO}, channel, q, position) WHERE r = 1)),
  pairs AS ({distance_sql('cells', ['served', 'channel', 'model', 'condition', 'template'], 'shuffle_seed')})
  SELECT served, count(*) AS n, max(side_flips) AS side_flips_max, ROUND(avg(side_flips), 9) AS side_flips_mean FROM pairs GROUP BY served""")  # fmt: skip
def order_floor_by_class(spark, d):
    key = ["model", "condition", "template", "shuffle_seed", "channel"]
    cells = S.modal(_answers(spark, d), key).withColumn("served", F.when(F.col("channel") == "hosted", "hosted").otherwise("local"))
    pairs = S.distances(cells, ["served", "channel", "model", "condition", "template"], "shuffle_seed")
    return pairs.groupBy("served").agg(F.count("*").alias("n"), F.max("side_flips").alias("side_flips_max"), F.round(F.avg("side_flips"), 9).alias("side_flips_mean"))


@R.add(f"""WITH {ANS}, cells AS ({modal_sql('model, condition, template')}), k AS (SELECT model, condition, q, count(*) AS t, count(DISTINCT modal >= 2) AS sides FROM cells GROUP BY model, condition, q),
  m AS (SELECT model, condition, max(t) AS t FROM k GROUP BY model, condition)
  SELECT k.model, k.condition, m.t AS templates, count(*) AS shared_items, count(*) FILTER (WHERE sides > 1) AS union_flips FROM k JOIN m ON k.model = m.model AND k.condition = m.condition AND k.t = m.t
  WHERE m.t > 1 GROUP BY k.model, k.condition, m.t""")  # fmt: skip
def paraphrase_union(spark, d):
    cells = S.modal(_answers(spark, d), ["model", "condition", "template"])
    k = cells.groupBy("model", "condition", "q").agg(F.count("*").alias("t"), F.count_distinct(S.side(F.col("modal"))).alias("sides"))
    m = k.groupBy("model", "condition").agg(F.max("t").alias("templates"))
    return k.join(m, ["model", "condition"]).filter("t = templates and templates > 1").groupBy("model", "condition", "templates").agg(F.count("*").alias("shared_items"), F.count_if(F.col("sides") > 1).alias("union_flips"))


@R.add(f"WITH {ANS}, {PAIRS.format(key='sheet_id, model, condition')} SELECT model, condition, pair_no, ROUND(avg(position), 9) AS position, count(*) AS sheets FROM pairs GROUP BY model, condition, pair_no")
def pair_positions(spark, d):
    p = S.pair_positions(_answers(spark, d), table(spark, d, "item_bank"), ["sheet_id", "model", "condition"])
    return p.groupBy("model", "condition", "pair_no").agg(F.round(F.avg("position"), 9).alias("position"), F.count("*").alias("sheets"))


@R.add(f"""WITH {ANS}, {PAIRS.format(key='sheet_id, model, condition')} SELECT model, condition, ROUND((count(*) FILTER (WHERE agree_both) - count(*) FILTER (WHERE disagree_both)) / count(*), 9) AS acquiescence,
  ROUND(avg(CASE WHEN consistent THEN 1.0 ELSE 0.0 END), 9) AS consistency, count(*) AS pairs FROM pairs GROUP BY model, condition""")
def acquiescence(spark, d):
    p = S.pair_positions(_answers(spark, d), table(spark, d, "item_bank"), ["sheet_id", "model", "condition"])
    return S.acquiescence(p, ["model", "condition"]).withColumn("acquiescence", F.round("acquiescence", 9)).withColumn("consistency", F.round("consistency", 9))


@R.add(f"""WITH {ANS}, {PAIRS.format(key='sheet_id, model, condition')}, r AS (SELECT pair_no, avg((critic >= 2)::INT) AS p, avg((defender >= 2)::INT) AS q, avg(agree_both::INT) AS both_, avg(disagree_both::INT) AS neither FROM pairs GROUP BY pair_no)
  SELECT pair_no, ROUND(p, 9) AS critic_rate, ROUND(q, 9) AS defender_rate, ROUND(both_, 9) AS both_rate, ROUND(neither, 9) AS neither_rate, ROUND(both_ - p * q, 9) AS excess FROM r""")
def pair_contingency(spark, d):
    p = S.pair_positions(_answers(spark, d), table(spark, d, "item_bank"), ["sheet_id", "model", "condition"])
    r = p.groupBy("pair_no").agg(F.avg((F.col("critic") >= 2).cast("int")).alias("p"), F.avg((F.col("defender") >= 2).cast("int")).alias("q"), F.avg(F.col("agree_both").cast("int")).alias("b"), F.avg(F.col("disagree_both").cast("int")).alias("n"))
    return r.select("pair_no", F.round("p", 9).alias("critic_rate"), F.round("q", 9).alias("defender_rate"), F.round("b", 9).alias("both_rate"), F.round("n", 9).alias("neither_rate"), F.round(F.expr("b - p * q"), 9).alias("excess"))


@R.add(f"""WITH {ANS}, cells AS ({modal_sql('model, condition')}), base AS (SELECT model, q, modal FROM cells WHERE condition = 'N'), arm AS (SELECT model, condition, q, modal FROM cells WHERE condition <> 'N')
  SELECT arm.condition, coalesce(i.ratchet, 'none') AS tag, count(*) AS cells, count(*) FILTER (WHERE base.modal IN (0, 3)) AS strong, count(*) FILTER (WHERE base.modal IN (0, 3) AND arm.modal NOT IN (0, 3)) AS lost,
  ROUND(count(*) FILTER (WHERE base.modal IN (0, 3) AND arm.modal NOT IN (0, 3)) / nullif(count(*) FILTER (WHERE base.modal IN (0, 3)), 0), 9) AS loss_of_strong,
  ROUND(count(*) FILTER (WHERE base.modal IN (0, 3) AND arm.modal NOT IN (0, 3)) / count(*), 9) AS loss_of_all
  FROM base JOIN arm ON base.model = arm.model AND base.q = arm.q JOIN item_bank i ON i.id = arm.q GROUP BY arm.condition, coalesce(i.ratchet, 'none')""")  # fmt: skip
def tagged_loss_rates(spark, d):
    cells = S.modal(_answers(spark, d), ["model", "condition"])
    base = cells.filter("condition = 'N'").select("model", "q", F.col("modal").alias("was"))
    tags = F.broadcast(table(spark, d, "item_bank").select(F.col("id").alias("q"), F.coalesce("ratchet", F.lit("none")).alias("tag")))
    both = cells.filter("condition <> 'N'").join(base, ["model", "q"]).join(tags, "q")
    strong, lost = F.count_if(S.endpoint(F.col("was"))), F.count_if(S.endpoint(F.col("was")) & ~S.endpoint(F.col("modal")))
    return both.groupBy("condition", "tag").agg(F.count("*").alias("cells"), strong.alias("strong"), lost.alias("lost"), F.round(lost / F.when(strong > 0, strong), 9).alias("loss_of_strong"), F.round(lost / F.count("*"), 9).alias("loss_of_all"))


@R.add(f"""WITH {ANS} SELECT i.claim_type, i.frame, count(*) AS n, ROUND(avg((position >= 2)::INT), 9) AS agree_rate, ROUND(avg((position = (SELECT max(position) FROM ans))::INT), 9) AS top_rate
  FROM ans {BANK} GROUP BY i.claim_type, i.frame HAVING count(*) >= 20""")
def agreement_by_class(spark, d):
    ans = _answers(spark, d)
    top = ans.agg(F.max("position").alias("top"))
    items = F.broadcast(table(spark, d, "item_bank").select(F.col("id").alias("q"), "claim_type", "frame"))
    x = ans.join(items, "q").join(F.broadcast(top))
    return x.groupBy("claim_type", "frame").agg(F.count("*").alias("n"), F.round(F.avg(S.side(F.col("position")).cast("int")), 9).alias("agree_rate"), F.round(F.avg((F.col("position") == F.col("top")).cast("int")), 9).alias("top_rate")).filter("n >= 20")


@R.add(f"""WITH {ANS}, r AS (SELECT q, frame, avg((position >= 2)::INT) AS rate FROM ans {BANK} GROUP BY q, frame)
  SELECT frame, count(*) FILTER (WHERE rate BETWEEN 0.4 AND 0.6) AS contested, ROUND(min(rate), 9) AS lowest, ROUND(max(rate), 9) AS highest, count(*) AS items FROM r GROUP BY frame""")
def item_gradient(spark, d):
    items = F.broadcast(table(spark, d, "item_bank").select(F.col("id").alias("q"), "frame"))
    r = _answers(spark, d).join(items, "q").groupBy("q", "frame").agg(F.avg(S.side(F.col("position")).cast("int")).alias("rate"))
    return r.groupBy("frame").agg(F.count_if(F.col("rate").between(0.4, 0.6)).alias("contested"), F.round(F.min("rate"), 9).alias("lowest"), F.round(F.max("rate"), 9).alias("highest"), F.count("*").alias("items"))


@R.add("SELECT sheet_id, model, condition, answers[1].position AS position, len(answers) AS n FROM sheets WHERE len(answers) > 1 AND len(list_distinct(list_transform(answers, lambda x: x.position))) = 1 AND len(list_filter(answers, lambda x: x.position IS NULL)) = 0")
def degenerate_sheets(spark, d):
    return S.degenerate(table(spark, d, "sheets")).filter(F.size(F.filter("answers", lambda x: x["position"].isNull())) == 0).select("sheet_id", "model", "condition", F.col("answers")[0]["position"].alias("position"), F.size("answers").cast("bigint").alias("n"))


@R.add("""SELECT model, condition, count(*) AS sheets, count(DISTINCT seed) AS seeds FROM (SELECT *, row_number() OVER (PARTITION BY model, condition, shuffle_seed, template, seed ORDER BY sheet_id) AS n FROM sheets WHERE valid)
  WHERE n = 1 OR seed IS NULL GROUP BY model, condition""")
def seed_deduped(spark, d):
    s = S.seed_dedupe(table(spark, d, "sheets").filter("valid"), ["model", "condition", "shuffle_seed", "template"])
    return s.groupBy("model", "condition").agg(F.count("*").alias("sheets"), F.count_distinct("seed").alias("seeds"))


@R.add("SELECT sheet_id, model, condition, n FROM (SELECT sheet_id, model, condition, count(*) OVER (PARTITION BY model, condition, shuffle_seed) AS n FROM sheets WHERE valid) WHERE n >= 4")
def min_depth_cells(spark, d):
    w = Window.partitionBy("model", "condition", "shuffle_seed")
    return table(spark, d, "sheets").filter("valid").select("sheet_id", "model", "condition", F.count("*").over(w).alias("n")).filter("n >= 4")


@R.add("""SELECT lower(trim(split_part(split_part(instrument, ';', 1), ',', 1))) AS head, CASE WHEN lower(trim(split_part(split_part(instrument, ';', 1), ',', 1))) IN ('stance-battery', 'stance-battery-v2') THEN 'stance-battery'
  WHEN instrument IS NULL AND n_items = 32 THEN 'stance-battery' END AS instrument, count(*) AS n FROM sheets GROUP BY 1, 2""")
def instrument_match(spark, d):
    head = F.lower(F.trim(F.split(F.split("instrument", ";")[0], ",")[0]))
    found = F.when(head.isin("stance-battery", "stance-battery-v2"), "stance-battery").when(F.col("instrument").isNull() & (F.col("n_items") == 32), "stance-battery")
    return table(spark, d, "sheets").groupBy(head.alias("head"), found.alias("instrument")).agg(F.count("*").alias("n"))


@R.add("SELECT model, count(*) AS sheets, count(*) FILTER (WHERE provider_pinned IS NOT NULL AND provider IS DISTINCT FROM provider_pinned) AS off_pin FROM sheets GROUP BY model")
def off_pin(spark, d):
    off = F.col("provider_pinned").isNotNull() & ~F.col("provider").eqNullSafe(F.col("provider_pinned"))
    return table(spark, d, "sheets").groupBy("model").agg(F.count("*").alias("sheets"), F.count_if(off).alias("off_pin"))


@R.add("SELECT model, min_by(channel, sheet_id) FILTER (WHERE channel IS NOT NULL) AS channel, coalesce(min_by(channel, sheet_id) FILTER (WHERE channel IS NOT NULL) = 'hosted', contains(model, '/')) AS served FROM sheets GROUP BY model")
def served_over_api(spark, d):
    """By the first recorded channel; a model without one is served if its id names a vendor."""
    first = F.min_by("channel", F.when(F.col("channel").isNotNull(), F.col("sheet_id")))
    return table(spark, d, "sheets").groupBy("model").agg(first.alias("channel")).withColumn("served", F.coalesce(F.col("channel") == "hosted", F.contains("model", F.lit("/"))))


@R.add("""WITH k AS (SELECT *, CASE WHEN NOT ok THEN 'transport' WHEN coalesce(n_answers, 0) >= 32 THEN 'none' WHEN coalesce(n_answers, 0) = 0 AND coalesce(tokens_out >= max_tokens - 10, false) THEN 'budget-exhausted'
  WHEN coalesce(tokens_out >= max_tokens - 10, false) THEN 'truncated' WHEN coalesce(n_answers, 0) = 0 AND length(trim(coalesce(response_text, ''))) > 0 THEN 'refused' ELSE 'other' END AS derived FROM sheets)
  SELECT derived, coalesce(failure_mode, 'none') AS stored, count(*) AS n FROM k GROUP BY derived, coalesce(failure_mode, 'none')""")
def failure_audit(spark, d):
    kind = S.failure_class(F.col("n_answers"), F.col("tokens_out"), F.col("max_tokens"), F.col("response_text"), F.col("ok"))
    return table(spark, d, "sheets").groupBy(kind.alias("derived"), F.coalesce("failure_mode", F.lit("none")).alias("stored")).agg(F.count("*").alias("n"))


_FOLDED = r"regexp_replace(regexp_replace(lower(response_text), '[*_`]', '', 'g'), '(?m)^([ \t]*[0-9]+[ \t]*[.):-])[ \t]*\n+[ \t]*', '\1 ', 'g')"
_LINE = r"'(?m)^[ \t]*([0-9]+)[ \t]*[.):-]+[ \t]*(strongly disagree|strongly agree|disagree|agree)[ \t.]*$'"


@R.add(f"""WITH p AS (SELECT sheet_id, regexp_extract_all({_FOLDED}, {_LINE}, 1) AS q, regexp_extract_all({_FOLDED}, {_LINE}, 2) AS o FROM sheets WHERE response_text IS NOT NULL)
  SELECT sheet_id, len(q) AS parsed, len(list_distinct(q)) AS items, CAST(list_sum(list_transform(o, lambda x: list_position(['strongly disagree', 'disagree', 'agree', 'strongly agree'], x) - 1)) AS BIGINT) AS position_sum FROM p WHERE len(q) > 0""")
def sheet_parser(spark, d):
    p = table(spark, d, "sheets").filter("response_text is not null").select("sheet_id", S.parse_sheet(F.col("response_text")).alias("p")).filter(F.size("p") > 0)
    total = F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x["position"])
    return p.select("sheet_id", F.size("p").cast("bigint").alias("parsed"), F.size(F.array_distinct(F.transform("p", lambda x: x["q"]))).cast("bigint").alias("items"), total.alias("position_sum"))


@R.add("SELECT sheet_id, CAST(e.key AS INTEGER) AS label, e.value AS item_id FROM (SELECT sheet_id, unnest(map_entries(label_to_id)) AS e FROM sheets WHERE renumbered)")
def label_remap(spark, d):
    return table(spark, d, "sheets").filter("renumbered").select("sheet_id", F.explode("label_to_id").alias("k", "item_id")).select("sheet_id", F.col("k").cast("int").alias("label"), "item_id")


@R.add("""SELECT model, condition, max_by(shuffle_seed, n * 1000000 - shuffle_seed) AS shuffle_seed, max(n) AS n FROM (SELECT model, condition, shuffle_seed, count(*) AS n FROM sheets WHERE valid AND shuffle_seed IS NOT NULL
  GROUP BY model, condition, shuffle_seed) GROUP BY model, condition""")
def deepest_cell(spark, d):
    n = table(spark, d, "sheets").filter("valid and shuffle_seed is not null").groupBy("model", "condition", "shuffle_seed").agg(F.count("*").alias("n"))
    return n.groupBy("model", "condition").agg(F.max_by("shuffle_seed", F.struct("n", -F.col("shuffle_seed"))).alias("shuffle_seed"), F.max("n").alias("n"))


@R.add("""SELECT model, count(*) FILTER (WHERE failure_mode = 'refused') AS refused, count(*) AS n, ROUND(count(*) FILTER (WHERE failure_mode = 'refused') / count(*), 9) AS rate, condition FROM sheets
  WHERE failure_mode IS DISTINCT FROM 'transport' GROUP BY model, condition""")
def switch_table(spark, d):
    s = table(spark, d, "sheets").filter(~F.col("failure_mode").eqNullSafe("transport"))
    refused = F.count_if(F.coalesce(F.col("failure_mode") == "refused", F.lit(False)))
    return s.groupBy("model", "condition").agg(refused.alias("refused"), F.count("*").alias("n"), F.round(refused / F.count("*"), 9).alias("rate"))


_RATES = "r AS (SELECT model, condition, count(*) FILTER (WHERE failure_mode = 'refused') AS x, count(*) AS n FROM sheets WHERE failure_mode IS DISTINCT FROM 'transport' GROUP BY model, condition)"


@R.add(f"WITH {_RATES} SELECT condition, ROUND(sum(x) / sum(n), 9) AS pooled, ROUND(avg(x / n), 9) AS equal_weighted, count(*) AS models FROM r GROUP BY condition")
def refusal_by_condition(spark, d):
    r = switch_table(spark, d)
    return r.groupBy("condition").agg(F.round(F.sum("refused") / F.sum("n"), 9).alias("pooled"), F.round(F.avg(F.col("refused") / F.col("n")), 9).alias("equal_weighted"), F.count("*").alias("models"))


@R.add(f"""WITH {_RATES}, s AS (SELECT model, sum(CASE WHEN condition = 'A' THEN x END) > 0 AS a, sum(CASE WHEN condition = 'N' THEN x END) > 0 AS n, min(x = n) AS all_refused FROM r GROUP BY model)
  SELECT model, CASE WHEN all_refused THEN 'total_refuser' WHEN coalesce(a, false) AND coalesce(n, false) THEN 'both' WHEN coalesce(a, false) THEN 'switch' WHEN coalesce(n, false) THEN 'reverse' ELSE 'none' END AS pattern FROM s""")
def switch_patterns(spark, d):
    r = switch_table(spark, d)
    any_ = lambda c: F.coalesce(F.sum(F.when(F.col("condition") == c, F.col("refused"))) > 0, F.lit(False))
    s = r.groupBy("model").agg(any_("A").alias("a"), any_("N").alias("n"), F.bool_and(F.col("refused") == F.col("n")).alias("all_refused"))
    return s.select("model", F.when(F.col("all_refused"), "total_refuser").when(F.col("a") & F.col("n"), "both").when(F.col("a"), "switch").when(F.col("n"), "reverse").otherwise("none").alias("pattern"))


@R.add(f"""WITH {_RATES}, f AS (SELECT model, substr(condition, 2, 1) AS b1, substr(condition, 3, 1) AS b2, substr(condition, 4, 1) AS b3, x / n AS rate FROM r WHERE regexp_matches(condition, '^F[01][01][01]$')), sat AS (SELECT model FROM f GROUP BY model HAVING min(rate) >= 0.99 OR max(rate) <= 0.01),
  u AS (SELECT model, 1 AS bit, b1 AS b, rate FROM f UNION ALL SELECT model, 2, b2, rate FROM f UNION ALL SELECT model, 3, b3, rate FROM f)
  SELECT model, bit, ROUND(avg(CASE WHEN b = '1' THEN rate END) - avg(CASE WHEN b = '0' THEN rate END), 9) AS effect, count(*) AS cells FROM u WHERE model NOT IN (SELECT model FROM sat) GROUP BY model, bit""")
def factorial_effects(spark, d):
    """Effect of each clause on refusals; models that refuse all or nothing are left out."""
    whole = Window.partitionBy("model")
    r = switch_table(spark, d).filter(F.col("condition").rlike("^F[01][01][01]$")).withColumn("rate", F.col("refused") / F.col("n"))
    r = r.withColumn("lo", F.min("rate").over(whole)).withColumn("hi", F.max("rate").over(whole)).filter("lo < 0.99 and hi > 0.01")
    u = r.select("model", "rate", F.posexplode(F.split(F.substring("condition", 2, 3), "")).alias("i", "b")).filter("b <> ''")
    return u.groupBy("model", (F.col("i") + 1).alias("bit")).agg(F.round(F.avg(F.when(F.col("b") == "1", F.col("rate"))) - F.avg(F.when(F.col("b") == "0", F.col("rate"))), 9).alias("effect"), F.count("*").alias("cells"))


@R.add("""WITH o AS (SELECT model, condition, shuffle_seed, avg((coalesce(failure_mode, '') = 'refused')::INT) AS rate, count(*) AS n FROM sheets WHERE shuffle_seed IS NOT NULL GROUP BY model, condition, shuffle_seed)
  SELECT model, condition, count(*) AS orders, CASE WHEN min(rate) >= 0.99 OR max(rate) <= 0.01 THEN NULL ELSE ROUND(max(rate) - min(rate), 9) END AS spread FROM o GROUP BY model, condition""")
def between_order_spread(spark, d):
    o = table(spark, d, "sheets").filter("shuffle_seed is not null").groupBy("model", "condition", "shuffle_seed").agg(F.avg((F.coalesce("failure_mode", F.lit("")) == "refused").cast("int")).alias("rate"))
    return o.groupBy("model", "condition").agg(F.count("*").alias("orders"), F.when((F.min("rate") >= 0.99) | (F.max("rate") <= 0.01), None).otherwise(F.round(F.max("rate") - F.min("rate"), 9)).alias("spread"))


@R.add("""SELECT model, condition, ROUND(median(tokens_out), 9) AS median_tokens, count(*) FILTER (WHERE tokens_out >= max_tokens) AS at_cap, count(*) FILTER (WHERE done_reason = 'stop') AS stopped,
  count(*) FILTER (WHERE done_reason = 'length') AS length_, count(*) FILTER (WHERE done_reason IS NULL) AS unknown FROM sheets GROUP BY model, condition""")
def termination_profile(spark, d):
    return table(spark, d, "sheets").groupBy("model", "condition").agg(
        F.round(F.median("tokens_out"), 9).alias("median_tokens"), F.count_if(F.coalesce(F.col("tokens_out") >= F.col("max_tokens"), F.lit(False))).alias("at_cap"),
        F.count_if(F.coalesce(F.col("done_reason") == "stop", F.lit(False))).alias("stopped"), F.count_if(F.coalesce(F.col("done_reason") == "length", F.lit(False))).alias("length_"), F.count_if(F.col("done_reason").isNull()).alias("unknown"),
    )


@R.add("""SELECT model, condition, array_to_string(list_sort(list_distinct(list(CAST(template AS VARCHAR)))), ',') AS templates, count(DISTINCT temperature) AS temperatures, count(DISTINCT substr(collected_at, 1, 10)) AS days FROM sheets GROUP BY model, condition""")
def cell_sets(spark, d):
    return table(spark, d, "sheets").groupBy("model", "condition").agg(F.array_join(F.array_sort(F.collect_set("template")), ",").alias("templates"), F.count_distinct("temperature").alias("temperatures"), F.count_distinct(F.substring("collected_at", 1, 10)).alias("days"))


@R.add("""WITH f AS (SELECT model, condition, 'max_tokens' AS field, CAST(max_tokens AS VARCHAR) AS value FROM sheets UNION ALL SELECT model, condition, 'template', template FROM sheets UNION ALL SELECT model, condition, 'instrument', instrument FROM sheets),
  a AS (SELECT model, field, condition, count(DISTINCT value) AS k, min(value) AS lo FROM f GROUP BY model, field, condition)
  SELECT model, field, max(k) AS most_within, count(DISTINCT lo) AS between_arms, max(k) > 1 OR count(DISTINCT lo) > 1 AS problem FROM a GROUP BY model, field""")
def comparable_arms(spark, d):
    s = table(spark, d, "sheets").select("model", "condition", F.explode(F.create_map(*[x for c in ("max_tokens", "template", "instrument") for x in (F.lit(c), F.col(c).cast("string"))])).alias("field", "value"))
    a = s.groupBy("model", "field", "condition").agg(F.count_distinct("value").alias("k"), F.min("value").alias("lo"))
    return a.groupBy("model", "field").agg(F.max("k").alias("most_within"), F.count_distinct("lo").alias("between_arms"), ((F.max("k") > 1) | (F.count_distinct("lo") > 1)).alias("problem"))


@R.add("""WITH s AS (SELECT renumbered AS arm, count(*) FILTER (WHERE coalesce(n_answers, 0) BETWEEN 1 AND 31) AS partial, count(*) FILTER (WHERE n_answers >= 32) AS complete FROM sheets WHERE renumbered IS NOT NULL GROUP BY renumbered)
  SELECT arm, partial, complete, ROUND(partial / (partial + complete), 9) AS rate FROM s""")
def omission_arms(spark, d):
    s = table(spark, d, "sheets").filter("renumbered is not null").groupBy(F.col("renumbered").alias("arm")).agg(F.count_if(F.coalesce("n_answers", F.lit(0)).between(1, 31)).alias("partial"), F.count_if(F.coalesce(F.col("n_answers") >= 32, F.lit(False))).alias("complete"))
    return s.withColumn("rate", F.round(F.expr("partial / (partial + complete)"), 9))


@R.add(f"""WITH miss AS (SELECT sheet_id, i.id AS q FROM sheets s, item_bank i WHERE coalesce(n_answers, 0) BETWEEN 16 AND 31 AND NOT list_contains(list_transform(answers, lambda x: x.q), i.id))
  SELECT q, count(*) AS dropped, count(DISTINCT s.shuffle_seed) AS orders, count(DISTINCT s.shuffle_seed) >= 2 AS item_evidence FROM miss JOIN sheets s ON s.sheet_id = miss.sheet_id GROUP BY q""")
def dropped_items(spark, d):
    s = table(spark, d, "sheets").filter(F.coalesce("n_answers", F.lit(0)).between(16, 31))
    bank = F.broadcast(table(spark, d, "item_bank").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    miss = s.join(bank).select("shuffle_seed", F.explode(F.array_except("ids", F.transform("answers", lambda x: x["q"]))).alias("q"))
    return miss.groupBy("q").agg(F.count("*").alias("dropped"), F.count_distinct("shuffle_seed").alias("orders"), (F.count_distinct("shuffle_seed") >= 2).alias("item_evidence"))


@R.add(f"""WITH {ANS}, {PAIRS.format(key='sheet_id, model, condition')}, m AS (SELECT model, pair_no, avg(position) AS x FROM pairs GROUP BY model, pair_no), p AS (SELECT *, x - avg(x) OVER (PARTITION BY pair_no) AS y FROM m)
  SELECT model, pair_no, ROUND(y - avg(y) OVER (PARTITION BY model), 9) AS residual FROM p""")
def two_way_centring(spark, d):
    p = S.pair_positions(_answers(spark, d), table(spark, d, "item_bank"), ["sheet_id", "model", "condition"])
    m = p.groupBy("model", "pair_no").agg(F.avg("position").alias("x"))
    y = m.withColumn("y", F.col("x") - F.avg("x").over(Window.partitionBy("pair_no")))
    return y.select("model", "pair_no", F.round(F.col("y") - F.avg("y").over(Window.partitionBy("model")), 9).alias("residual")).withColumn("residual", F.when(F.col("residual") == 0, 0.0).otherwise(F.col("residual")))


@R.add(f"""WITH {ANS}, n AS (SELECT model, condition, count(DISTINCT sheet_id) AS k FROM ans GROUP BY model, condition), v AS (SELECT model, list(condition ORDER BY condition) AS cs FROM n GROUP BY model),
  a AS (SELECT model, k FROM n WHERE condition = 'A'), b AS (SELECT model, k FROM n WHERE condition = 'D')
  SELECT v.model, CASE WHEN a.k IS NULL OR b.k IS NULL THEN 'no-arm' WHEN a.k < 2 OR b.k < 2 THEN 'low-coverage' ELSE 'scored' END AS bucket FROM v LEFT JOIN a ON a.model = v.model LEFT JOIN b ON b.model = v.model""")
def pair_accounting(spark, d):
    n = _answers(spark, d).groupBy("model").agg(*[F.count_distinct(F.when(F.col("condition") == c, F.col("sheet_id"))).alias(c) for c in "AD"])
    return n.select("model", F.when((F.col("A") == 0) | (F.col("D") == 0), "no-arm").when((F.col("A") < 2) | (F.col("D") < 2), "low-coverage").otherwise("scored").alias("bucket"))


@R.add(f"""WITH {ANS}, cells AS ({modal_sql('model, condition')}), x AS ({distance_sql('cells', ['model'], 'condition')}), s AS (SELECT CAST(unnest(range(0, 33)) AS INTEGER) AS shift)
  SELECT shift, ROUND(avg((least(side_flips + shift, 32) > 5)::INT), 9) AS power FROM x, s GROUP BY shift""")
def mde_grid(spark, d):
    x = S.distances(S.modal(_answers(spark, d), ["model", "condition"]), ["model"], "condition").groupBy("side_flips").agg(F.count("*").alias("n"))
    g = x.select("side_flips", "n", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("shift"))
    return g.groupBy("shift").agg(F.round(F.sum(F.when(F.least(F.col("side_flips") + F.col("shift"), F.lit(32)) > 5, F.col("n")).otherwise(0)) / F.sum("n"), 9).alias("power"))


QUERIES, SQL = R.queries, R.sql
