"""The pN_ queries of the problems on text and labels, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import consensus, dedup, leak, mixing, pairs, reading, truncation
from tallyforge.session import prepare, table

SCORED_KEYS = ("model", "question_id", "condition", "seed")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_records(table(spark, d, "scored"), table(spark, d, "sheets")).filter("cut").select("src", "id")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_shares(truncation.cut_records(table(spark, d, "scored"), table(spark, d, "sheets")))


def p2_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_records(table(spark, d, "scored"), table(spark, d, "sheets")).groupBy("src", "verdict").agg(F.count("*").alias("records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "scored")).select("record_id", "consensus")


def p4_judges(spark: SparkSession, d: str) -> DataFrame:
    return consensus.judge_table(table(spark, d, "scored"))


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(table(spark, d, "scored"), by="model").withColumn("alpha", F.round("alpha", 6))


def p5_all(spark: SparkSession, d: str) -> DataFrame:
    scored, sheets = table(spark, d, "scored"), table(spark, d, "sheets")
    cut = truncation.cut_records(scored, sheets).filter("cut")
    return pairs.defects(pairs.study_pairs(scored, sheets), cut)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.first_defect(p5_all(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    a = dedup.text_copies(table(spark, d, "scored"), "record_id", "response_text", SCORED_KEYS)
    b = dedup.record_copies(table(spark, d, "raw_lines"), "line_id", "payload")
    return a.select(F.lit("scored").alias("src"), "first_id", "copy_id").unionByName(b.select(F.lit("raw_lines").alias("src"), "first_id", "copy_id"))


def p6_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Every record once, of both tables, and how many copies of it there are."""
    pairs = p6_found(spark, d)
    ids = {"scored": "record_id", "raw_lines": "line_id"}
    kept = [
        dedup.collapse(table(spark, d, src).select(F.col(key).alias("id")), "id", pairs.filter(F.col("src") == src)).select(F.lit(src).alias("src"), "id", "n_copies")
        for src, key in ids.items()
    ]
    return kept[0].unionByName(kept[1])


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("span").alias("longest_span"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_tree(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached when each source's target is split over its languages, English seven
    parts of ten: what a language lacks goes to its source's other language first."""
    docs = table(spark, d, "documents").withColumn("language", F.when(F.lower("lang") == "en", "en").otherwise("other"))
    split = F.explode(F.array(F.struct(F.lit("en").alias("language"), F.lit(0.7).alias("part")), F.struct(F.lit("other").alias("language"), F.lit(0.3).alias("part")))).alias("x")
    targets = table(spark, d, "mix_targets").select("*", split).select("source", "x.language", (F.col("target_share") * F.col("x.part")).alias("target_share"), "max_repeats")
    return mixing.mix(docs, targets, levels=("source", "language"))[1]


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_levels(spark, d).filter("band is not null").select("doc_id", "band")


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return reading.profile(reading.reading_levels(docs), docs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p2_found, p2_shares, p2_verdicts, p4_found, p4_judges, p4_agreement, p5_found, p5_all, p6_found, p6_collapsed,
        p7_found, p7_leaks, p7_items, p8_mix, p8_shares, p8_tree, p9_found, p9_levels, p9_profile,
    )
}



def _fold(x: str) -> str:
    return f"regexp_replace(replace(lower(nfc_normalize({x})), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


_COPIES = f"""s AS (SELECT record_id AS id, model, question_id, condition, seed, {_fold('response_text')} AS f FROM scored WHERE response_text IS NOT NULL), g AS (SELECT id, min(id) OVER (PARTITION BY model, question_id, condition, seed, f) AS first_id FROM s WHERE f <> ''),
  k AS (SELECT line_id, unnest(json_keys(payload)) AS k, payload FROM raw_lines WHERE json_valid(payload)), v AS (SELECT line_id, k, json_extract(payload, '$."' || k || '"') AS v FROM k),
  r AS (SELECT line_id, string_agg(k || '=' || CASE json_type(v) WHEN 'VARCHAR' THEN 's' || {_fold("json_extract_string(v, '$')")} ELSE CAST(v AS VARCHAR) END, chr(1) ORDER BY k) AS f FROM v GROUP BY line_id), h AS (SELECT line_id AS id, min(line_id) OVER (PARTITION BY f) AS first_id FROM r),
  pairs AS (SELECT 'scored' AS src, first_id, id AS copy_id FROM g WHERE id <> first_id UNION ALL SELECT 'raw_lines', first_id, id FROM h WHERE id <> first_id)"""

_ALPHA = """s AS (SELECT model AS grp, record_id, list_filter(list_transform(score_classifier_judges, lambda j: j.score), lambda x: x BETWEEN 1 AND 5) AS v FROM scored), m AS (SELECT grp, record_id, len(v) AS m, unnest(v) AS a FROM s WHERE len(v) >= 2),
  r AS (SELECT grp, record_id, m, a, count(*) AS c FROM m GROUP BY ALL), o AS (SELECT x.grp, x.a AS a, y.a AS b, sum(x.c * (y.c - (x.a = y.a)::INT) / (x.m - 1)) AS w FROM r x JOIN r y ON x.record_id = y.record_id GROUP BY x.grp, x.a, y.a), n AS (SELECT grp, a, sum(w) AS n FROM o GROUP BY grp, a),
  p AS (SELECT x.grp, x.a AS a, y.a AS b, x.n * y.n AS nn, (SELECT sum(z.n) FROM n z WHERE z.grp = x.grp AND z.a BETWEEN x.a AND y.a) - (x.n + y.n) / 2 AS d FROM n x JOIN n y ON x.grp = y.grp AND x.a < y.a),
  e AS (SELECT p.grp, sum(coalesce(w, 0) * d * d) AS seen, sum(nn * d * d) AS expected FROM p LEFT JOIN o ON o.grp = p.grp AND o.a = p.a AND o.b = p.b GROUP BY p.grp), t AS (SELECT grp, sum(n) AS total FROM n GROUP BY grp), k AS (SELECT grp, count(*) AS n_records FROM s WHERE len(v) >= 2 GROUP BY grp)"""

SQL: dict[str, str] = {
    "p4_agreement": f"WITH {_ALPHA} SELECT k.grp, n_records, ROUND(1 - (total - 1) * seen / expected, 6) AS alpha FROM k LEFT JOIN t ON t.grp = k.grp LEFT JOIN e ON e.grp = k.grp",
    "p6_found": f"WITH {_COPIES} SELECT * FROM pairs",
    "p6_collapsed": f"""WITH {_COPIES}, a AS (SELECT 'scored' AS src, record_id AS id FROM scored UNION ALL SELECT 'raw_lines', line_id FROM raw_lines), n AS (SELECT src, first_id AS id, count(*) AS more FROM pairs GROUP BY src, first_id)
  SELECT src, id, coalesce(more, 0) + 1 AS n_copies FROM a LEFT JOIN n USING (src, id) WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.src = a.src AND p.copy_id = a.id)""",
}


def register(queries: dict, sql: dict) -> None:
    """Add this subpackage's queries and SQL to the engine's."""
    queries.update({k: (lambda s, d, f=f: f(prepare(s), d)) for k, f in QUERIES.items()})
    sql.update(SQL)
