"""Reports that set two readings of the same sheets side by side."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators import sheets as S
from tallyforge.plans.arm_queries import _KINDS, _kinds
from tallyforge.plans.base import ANS, Registry, modal_sql, table
from tallyforge.plans.detail_queries import item_slots
from tallyforge.plans.inference_queries import _BH, CONTRASTS, _contrasts
from tallyforge.plans.inference_queries import DRAWS as _DRAWS
from tallyforge.plans.resample_queries import _POSITIONS, contrast_sql, positions
from tallyforge.plans.scored_queries import _PQ, _per_question

R = Registry()
MC = f"cells AS ({modal_sql('model, condition')})"
_SLOTS = """sl AS (SELECT sheet_id, item, row_number() OVER (PARTITION BY sheet_id ORDER BY label) AS slot FROM (SELECT sheet_id, CAST(e.key AS INTEGER) AS label, e.value AS item FROM (SELECT sheet_id, unnest(map_entries(label_to_id)) AS e FROM sheets WHERE renumbered AND label_to_id IS NOT NULL)))"""


def _answers(spark, d):
    return S.answers(table(spark, d, "sheets"))


def _consistency_sql(source: str) -> str:
    return f"""(SELECT sheet_id, avg(((c - 1.5) * (dd - 1.5) < 0)::INT) AS k FROM (SELECT sheet_id, pair_no, max(position) FILTER (WHERE frame = 'critic') AS c, max(position) FILTER (WHERE frame = 'defender') AS dd FROM {source} JOIN item_bank b ON b.id = item GROUP BY sheet_id, pair_no) WHERE c IS NOT NULL AND dd IS NOT NULL GROUP BY sheet_id)"""


@R.add(f"""WITH {ANS}, {_SLOTS}, sh AS (SELECT sheet_id FROM ans JOIN sheets USING (sheet_id) WHERE renumbered AND label_to_id IS NOT NULL GROUP BY sheet_id HAVING count(*) >= 8), bi AS (SELECT ans.sheet_id, q AS item, position FROM ans JOIN sh USING (sheet_id)), bs AS (SELECT ans.sheet_id, sl.item, position FROM ans JOIN sh USING (sheet_id) JOIN sl ON sl.sheet_id = ans.sheet_id AND sl.slot = ans.q),
  x AS (SELECT sh.sheet_id, i.k AS by_id, s.k AS by_slot FROM sh LEFT JOIN {_consistency_sql('bi')} i ON i.sheet_id = sh.sheet_id LEFT JOIN {_consistency_sql('bs')} s ON s.sheet_id = sh.sheet_id)
  SELECT sheet_id, ROUND(by_id, 6) AS by_id, ROUND(by_slot, 6) AS by_slot, CASE WHEN by_id >= 0.7 AND by_id > coalesce(by_slot, 0) THEN 'answered by id' WHEN by_slot >= 0.7 AND by_slot > coalesce(by_id, 0) THEN 'answered by slot' ELSE 'UNATTRIBUTABLE' END AS verdict FROM x""")
def attribution_mappings(spark, d):
    """Pair consistency of renumbered sheets (eight answers or more) when answers are read by
    item id and when they are read by slot; a sheet that neither reading makes clear is named.

    Sheets and what is exploded from them are joined by merge: their estimated size leaves the
    explosion out, and they would be broadcast at many times the threshold."""
    ans = _answers(spark, d)
    sh = ans.join(table(spark, d, "sheets").filter("renumbered and label_to_id is not null").select("sheet_id").hint("merge"), "sheet_id").groupBy("sheet_id").agg(F.count("*").alias("n")).filter("n >= 8").select("sheet_id")
    mine = ans.join(sh.hint("merge"), "sheet_id").select("sheet_id", "q", "position")
    slots = item_slots(spark, d).select("sheet_id", (F.col("slot") + 1).alias("q"), "item").hint("merge")
    by_slot = mine.withColumn("q", F.col("q").cast("bigint")).join(slots, ["sheet_id", "q"]).select("sheet_id", F.col("item").alias("q"), "position")
    k = lambda a, name: S.pair_positions(a, table(spark, d, "item_bank"), ["sheet_id"]).groupBy("sheet_id").agg(F.avg(F.col("consistent").cast("int")).alias(name))
    x = sh.join(k(mine, "i"), "sheet_id", "left").join(k(by_slot, "s"), "sheet_id", "left")
    verdict = F.when((F.col("i") >= 0.7) & (F.col("i") > F.coalesce("s", F.lit(0.0))), "answered by id").when((F.col("s") >= 0.7) & (F.col("s") > F.coalesce("i", F.lit(0.0))), "answered by slot").otherwise("UNATTRIBUTABLE")
    return x.select("sheet_id", F.round("i", 6).alias("by_id"), F.round("s", 6).alias("by_slot"), verdict.alias("verdict"))


@R.add("""WITH m AS (SELECT model, median(tokens_out) FILTER (WHERE condition = 'A') AS a, median(tokens_out) FILTER (WHERE condition = 'N') AS n, count(*) FILTER (WHERE tokens_out >= max_tokens AND condition = 'A') AS cap_a, count(*) FILTER (WHERE tokens_out >= max_tokens AND condition = 'N') AS cap_n FROM sheets GROUP BY model)
  SELECT model, a AS median_a, n AS median_n, ROUND(a / n, 6) AS ratio, cap_a, cap_n FROM m WHERE a IS NOT NULL AND n > 0""")
def termination_ratio(spark, d):
    """Median tokens of both arms, their ratio, and the sheets of each at the cap."""
    of = lambda c: F.median(F.when(F.col("condition") == c, F.col("tokens_out")))
    cap = lambda c: F.count_if((F.col("condition") == c) & F.coalesce(F.col("tokens_out") >= F.col("max_tokens"), F.lit(False)))
    m = table(spark, d, "sheets").groupBy("model").agg(of("A").alias("median_a"), of("N").alias("median_n"), cap("A").alias("cap_a"), cap("N").alias("cap_n"))
    return m.filter("median_a is not null and median_n > 0").select("model", "median_a", "median_n", F.round(F.col("median_a") / F.col("median_n"), 6).alias("ratio"), "cap_a", "cap_n")


@R.add(f"""WITH {ANS}, r AS (SELECT channel, model, claim_type, count(*) AS n, avg((position >= 2)::INT) AS rate FROM ans JOIN item_bank i ON i.id = q GROUP BY channel, model, claim_type HAVING count(*) >= 20)
  SELECT channel AS class, claim_type, count(*) AS models, ROUND(sum(rate * n) / sum(n), 6) AS pooled, ROUND(avg(rate), 6) AS equal_weighted, count(*) FILTER (WHERE rate = 1) AS unanimous, count(*) < 3 AS thin FROM r GROUP BY channel, claim_type""")
def agreement_by_serving(spark, d):
    """Agreement by how models are served and by claim type: models of twenty answers or more,
    how many agree throughout, and whether the class is thin (under three models)."""
    items = F.broadcast(table(spark, d, "item_bank").select(F.col("id").alias("q"), "claim_type"))
    r = _answers(spark, d).join(items, "q").groupBy("channel", "model", "claim_type").agg(F.count("*").alias("n"), F.avg(S.side(F.col("position")).cast("int")).alias("rate")).filter("n >= 20")
    return r.groupBy(F.col("channel").alias("class"), "claim_type").agg(F.count("*").alias("models"), F.round(F.sum(F.col("rate") * F.col("n")) / F.sum("n"), 6).alias("pooled"), F.round(F.avg("rate"), 6).alias("equal_weighted"), F.count_if(F.col("rate") == 1).alias("unanimous"), (F.count("*") < 3).alias("thin"))


_CT = f"{contrast_sql(_POSITIONS, CONTRASTS, _DRAWS)}, {_BH}"
_SPREAD = """os AS (SELECT model, max(x) - min(x) AS spread FROM (SELECT sp.model, s.shuffle_seed, avg(sp.x) AS x FROM sp JOIN sheets s USING (sheet_id) WHERE sp.condition = 'N' AND s.shuffle_seed IS NOT NULL GROUP BY sp.model, s.shuffle_seed) GROUP BY model HAVING count(*) > 1)"""


@R.add(f"""WITH {_CT}, {_SPREAD} SELECT bh.model, contrast, ROUND(effect, 6) + 0.0 AS effect, ROUND(p_adjusted, 6) AS p_adjusted, ROUND(spread, 6) AS order_floor, CASE WHEN spread IS NULL THEN 'no floor' WHEN p_adjusted <= 0.05 AND abs(effect) > spread THEN 'clears' WHEN p_adjusted <= 0.05 THEN 'below floor' ELSE 'not significant' END AS verdict FROM bh LEFT JOIN os ON os.model = bh.model""")
def contrasts_beside_floors(spark, d):
    """Every contrast beside its model's own spread between orders: it clears if it survives the
    step-up and exceeds the floor."""
    p = positions(spark, d, ["sheet_id", "model", "condition", "shuffle_seed"]).filter("condition = 'N' and shuffle_seed is not null")
    o = p.groupBy("model", "shuffle_seed").agg(F.avg("position").alias("x")).groupBy("model").agg((F.max("x") - F.min("x")).alias("spread"), F.count("*").alias("k")).filter("k > 1")
    c = _contrasts(spark, d).join(o, "model", "left")
    verdict = F.when(F.col("spread").isNull(), "no floor").when((F.col("p_adjusted") <= 0.05) & (F.abs("effect") > F.col("spread")), "clears").when(F.col("p_adjusted") <= 0.05, "below floor").otherwise("not significant")
    return c.select("model", "contrast", F.expr("ROUND(effect, 6) + 0.0").alias("effect"), F.round("p_adjusted", 6).alias("p_adjusted"), F.round("spread", 6).alias("order_floor"), verdict.alias("verdict"))


_PATHS = f"""{ANS}, {_PQ}, j AS (SELECT model, avg(b - a) AS judged FROM pq GROUP BY model HAVING avg(b - a) IS NOT NULL), m AS (SELECT model, avg((position >= 2)::INT) FILTER (WHERE condition = 'A') - avg((position >= 2)::INT) FILTER (WHERE condition = 'N') AS mechanical FROM ans GROUP BY model),
  b AS (SELECT j.model, ROUND(judged, 9) AS judged, ROUND(mechanical, 9) AS mechanical FROM j JOIN m ON m.model = j.model WHERE mechanical IS NOT NULL)"""


@R.add(f"""WITH {_PATHS}, k AS (SELECT *, rank() OVER (ORDER BY judged) + (count(*) OVER (PARTITION BY judged) - 1) / 2.0 AS rj, rank() OVER (ORDER BY mechanical) + (count(*) OVER (PARTITION BY mechanical) - 1) / 2.0 AS rm FROM b)
  SELECT count(*) AS models, count(*) FILTER (WHERE sign(judged) = sign(mechanical) AND judged <> 0) AS same_direction, ROUND(corr(rj, rm), 6) AS rank_agreement, CASE WHEN count(*) < 3 THEN 'too few' WHEN corr(rj, rm) >= 0.5 THEN 'agree' WHEN corr(rj, rm) <= -0.5 THEN 'oppose' ELSE 'unrelated' END AS verdict FROM k""")
def both_paths(spark, d):
    """What the instruction moves in judged answers beside what it moves on sheets: direction and
    rank agreement over the models that have both."""
    j = _per_question(spark, d).groupBy("model").agg(F.avg(F.expr("B - A")).alias("judged")).filter("judged is not null")
    of = lambda c: F.avg(F.when(F.col("condition") == c, S.side(F.col("position")).cast("int")))
    m = _answers(spark, d).groupBy("model").agg((of("A") - of("N")).alias("mechanical")).filter("mechanical is not null")
    b = j.join(m, "model").select("model", F.round("judged", 9).alias("judged"), F.round("mechanical", 9).alias("mechanical"))
    rank = lambda c: F.rank().over(Window.partitionBy().orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0
    k = b.withColumn("rj", rank("judged")).withColumn("rm", rank("mechanical"))
    r = F.corr("rj", "rm")
    return k.agg(F.count("*").alias("models"), F.count_if((F.signum("judged") == F.signum("mechanical")) & (F.col("judged") != 0)).alias("same_direction"), F.round(r, 6).alias("rank_agreement"), F.when(F.count("*") < 3, "too few").when(r >= 0.5, "agree").when(r <= -0.5, "oppose").otherwise("unrelated").alias("verdict"))


@R.add("""WITH s AS (SELECT coalesce(ratchet, 'none') AS tag, list(id) AS ids FROM item_bank GROUP BY 1), c AS (SELECT claim_type, list(id) AS ids FROM item_bank GROUP BY 1)
  SELECT tag, claim_type, len(list_intersect(s.ids, c.ids)) AS shared, len(list_filter(s.ids, lambda x: NOT list_contains(c.ids, x))) = 0 AS tag_inside_type, len(list_filter(c.ids, lambda x: NOT list_contains(s.ids, x))) = 0 AS type_inside_tag FROM s, c WHERE len(list_intersect(s.ids, c.ids)) > 0""")
def partition_alignment(spark, d):
    """Whether a tag of the bank is a subset of a claim type, or the reverse: a contrast on one
    is confounded with the other where either holds."""
    b = table(spark, d, "item_bank").select("id", F.coalesce("ratchet", F.lit("none")).alias("tag"), "claim_type")
    size = lambda c: F.count("*").over(Window.partitionBy(c))
    both = b.withColumn("nt", size("tag")).withColumn("nc", size("claim_type")).groupBy("tag", "claim_type", "nt", "nc").agg(F.count("*").alias("shared"))
    return both.select("tag", "claim_type", "shared", (F.col("shared") == F.col("nt")).alias("tag_inside_type"), (F.col("shared") == F.col("nc")).alias("type_inside_tag"))


@R.add(f"""WITH {ANS}, c AS (SELECT DISTINCT condition FROM sheets), ds AS (SELECT m.model, x.condition AS a, y.condition AS b FROM (SELECT DISTINCT model FROM sheets) m, c x, c y WHERE x.condition < y.condition), n AS (SELECT model, condition, count(DISTINCT q) AS items FROM ans GROUP BY model, condition),
  p AS (SELECT ds.model, CASE WHEN x.items IS NULL OR y.items IS NULL THEN 'no arm' WHEN least(x.items, y.items) < 20 THEN 'low coverage' ELSE 'scored' END AS bucket FROM ds LEFT JOIN n x ON x.model = ds.model AND x.condition = ds.a LEFT JOIN n y ON y.model = ds.model AND y.condition = ds.b), k AS (SELECT count(*) AS k FROM c)
  SELECT model, count(*) FILTER (WHERE bucket = 'scored') AS scored, count(*) FILTER (WHERE bucket = 'low coverage') AS low_coverage, count(*) FILTER (WHERE bucket = 'no arm') AS no_arm, count(*) = any_value(k * (k - 1) // 2) AS reconciles FROM p, k GROUP BY model""")
def pair_reconciliation(spark, d):
    """Every designed pair of conditions of a model is scored, of low coverage (under twenty
    items) or lacks an arm; the three must sum to the design."""
    s = table(spark, d, "sheets")
    c = s.select("condition").distinct()
    n = _answers(spark, d).groupBy("model", "condition").agg(F.count_distinct("q").alias("items"))
    pairs = c.select(F.col("condition").alias("a")).join(F.broadcast(c.select(F.col("condition").alias("b"))), F.expr("a < b"))
    design = s.select("model").distinct().crossJoin(F.broadcast(pairs))
    x = n.select("model", F.col("condition").alias("a"), F.col("items").alias("x"))
    y = n.select("model", F.col("condition").alias("b"), F.col("items").alias("y"))
    p = design.join(x, ["model", "a"], "left").join(y, ["model", "b"], "left").withColumn("bucket", F.when(F.col("x").isNull() | F.col("y").isNull(), "no arm").when(F.least("x", "y") < 20, "low coverage").otherwise("scored"))
    of = lambda b: F.count_if(F.col("bucket") == b)
    k = c.agg(F.count("*").alias("k"))
    return p.crossJoin(F.broadcast(k)).groupBy("model", "k").agg(of("scored").alias("scored"), of("low coverage").alias("low_coverage"), of("no arm").alias("no_arm"), F.count("*").alias("all_")).select("model", "scored", "low_coverage", "no_arm", F.expr("all_ = k * (k - 1) div 2").alias("reconciles"))


@R.add(f"""WITH {_KINDS}, prs AS (SELECT kind, flips AS side_flips FROM kf) SELECT kind AS floor, count(*) AS n, CAST(floor(median(side_flips) + 0.5) AS INTEGER) AS side_flips_median, CASE WHEN count(*) >= 10 THEN list_sort(list(side_flips))[floor(0.9 * count(*))::INT] ELSE max(side_flips) END AS side_flips_p90, max(side_flips) AS side_flips_max, count(*) < 10 AS p90_is_max FROM prs GROUP BY kind""")
def version_floors(spark, d):
    """A floor row for each relation of models: same version, successor, unrelated."""
    h = _kinds(spark, d).groupBy("kind", "flips").agg(F.count("*").alias("n"))
    r = S.at_ranks(h, ["kind"], "flips", {"lo": "(total + 1) div 2", "hi": "total div 2 + 1", "p": "cast(floor(0.9 * total) as bigint)"})
    return r.select(F.col("kind").alias("floor"), F.col("total").alias("n"), F.floor((F.col("lo") + F.col("hi")) / 2.0 + 0.5).cast("int").alias("side_flips_median"), F.when(F.col("total") >= 10, F.col("p")).otherwise(F.col("_max")).alias("side_flips_p90"), F.col("_max").alias("side_flips_max"), (F.col("total") < 10).alias("p90_is_max"))


QUERIES, SQL = R.queries, R.sql
