"""Aggregations over the report, annotation, target and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.operators import aggregates as A
from tarnwork.plans.scalar_queries import _t

PAIR = ["perturbation_id", "symptom"]


def a_observations(spark, d):
    o = A.observations(_t(spark, d, "reports"), [*PAIR, "relation"], "report_ordinal")
    return o.withColumn("max_frequency", F.round("max_frequency", 6))


def a_max_of_means(spark, d):
    r = _t(spark, d, "reports").where("report_value = 1 and evidence_code in ('frequency', 'placebo_controlled_frequency')")
    return A.max_of_means(r, PAIR, "source_term_id", "frequency", "label_frequency").withColumn("label_frequency", F.round("label_frequency", 6))


def _matrix(spark, d):
    r = _t(spark, d, "reports").withColumn("source", F.lower(F.regexp_replace("source", "[^A-Za-z0-9]", "")))
    return A.count_matrix(r, PAIR, "source", "source_record_id", "report_value", F.coalesce(F.log1p("frequency_denominator"), F.lit(1.0)))


def a_count_matrix(spark, d):
    return _matrix(spark, d).withColumn("positive", F.round("positive", 5)).withColumn("negative", F.round("negative", 5))


def a_implicit_negatives(spark, d):
    m = A.implicit_negatives(_matrix(spark, d), _t(spark, d, "reports"), PAIR, ["perturbation_id"], "source", 0.5)
    return m.groupBy("source").agg(F.count("*").alias("cells"), F.round(F.sum("positive"), 3).alias("positive"), F.round(F.sum("negative"), 3).alias("negative"))


def a_soft_evidence(spark, d):
    return A.soft_evidence(_t(spark, d, "reports").where("relation = 'induces' and report_value is not null"), PAIR)


def a_resolved_pairs(spark, d):
    tiers = spark.createDataFrame(
        [(c, s, p, u) for c, p, u in (("monogenic", 0.9, 1.0), ("pharmacological", 0.7, 0.6), ("animal", 0.4, 0.2)) for s, p in (("positive", p), ("negative", 0.0))],
        "evidence_class string, direction string, probability double, unit_strength double")
    return A.resolved_pairs(a_soft_evidence(spark, d), PAIR, tiers).withColumn("strength", F.round("strength", 6))


def a_pair_categories(spark, d):
    return A.pair_categories(_t(spark, d, "reports"), PAIR, "report_value")


def a_summary(spark, d):
    return A.summary_counts(_t(spark, d, "reports"), ["evidence_class", "relation", "symptom", "evidence_code", "report_value"])


def a_heavy_diseases(spark, d):
    return A.heavy_values(_t(spark, d, "annotations").where("disease_id is not null"), "disease_id", "term_id", 10)


def a_concentration(spark, d):
    return A.concentration(_t(spark, d, "reports"), "symptom", "source_record_id", "perturbation_id", 5).withColumn("top_share", F.round("top_share", 6))


def a_pivot(spark, d):
    t = A.pivot_max(_t(spark, d, "events"), "user_id", "event_type", ["click", "error", "purchase", "signup", "view"], "value")
    return t.select("user_id", *[F.round(c, 6).alias(c) for c in ("click", "error", "purchase", "signup", "view")])


def a_most_common(spark, d):
    return A.most_common(_t(spark, d, "drug_targets"), "perturbation_id", "target_type", "PROTEIN FAMILY")


def a_equal_shares(spark, d):
    return A.equal_shares(_t(spark, d, "drug_targets"), "drug_target_id", "accessions").withColumn("share", F.round("share", 9))


def a_standardised(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    z = A.standardised(p, ["size", "price"], "p_brand")
    return z.select("p_partkey", "p_brand", F.round("size", 5).alias("size"), F.round("price", 5).alias("price"))


def a_trimmed_scale(spark, d):
    li = _t(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("v"), F.sum("l_quantity").alias("r"))
    return A.trimmed_scale_factor(li, "v", "r").select(F.round("factor", 6).alias("factor"), "kept")


QUERIES = {f.__name__: f for f in (a_observations, a_max_of_means, a_count_matrix, a_implicit_negatives, a_soft_evidence, a_resolved_pairs, a_pair_categories, a_summary, a_heavy_diseases, a_concentration, a_pivot, a_most_common, a_equal_shares, a_standardised, a_trimmed_scale)}

_RANK = "CASE evidence_class WHEN 'monogenic' THEN 0 WHEN 'pharmacological' THEN 1 WHEN 'open_targets' THEN 2 WHEN 'human_association' THEN 3 WHEN 'animal' THEN 4 WHEN 'literature' THEN 5 ELSE 6 END"
_MATRIX = """r AS (SELECT *, lower(regexp_replace(source, '[^A-Za-z0-9]', '', 'g')) AS src FROM reports),
w AS (SELECT perturbation_id, symptom, src, source_record_id, report_value, max(coalesce(ln(1 + frequency_denominator::DOUBLE), 1.0)) w FROM r WHERE report_value IS NOT NULL GROUP BY ALL),
m AS (SELECT perturbation_id, symptom, src AS source, coalesce(sum(w) FILTER (report_value = 1), 0) AS positive, coalesce(sum(w) FILTER (report_value <> 1), 0) AS negative FROM w GROUP BY 1, 2, 3)"""
_SOFT = """k AS (SELECT *, CASE WHEN report_value = 1 THEN 'positive' ELSE 'negative' END AS direction, coalesce(CASE WHEN starts_with(trim(split_part("references", ';', 1)), 'PMID:') THEN trim(split_part("references", ';', 1)) END,
  source || '|' || CASE WHEN trim(source_record_id) <> '' THEN source_record_id END, report_id) AS rec FROM reports WHERE relation = 'induces' AND report_value IS NOT NULL),
s AS (SELECT perturbation_id, symptom, evidence_class, direction, count(DISTINCT rec) AS n_distinct, string_agg(DISTINCT source, ';' ORDER BY source) AS sources FROM k GROUP BY 1, 2, 3, 4)"""
_TIERS = "t(evidence_class, direction, probability, unit_strength) AS (VALUES ('monogenic','positive',0.9,1.0),('monogenic','negative',0.0,1.0),('pharmacological','positive',0.7,0.6),('pharmacological','negative',0.0,0.6),('animal','positive',0.4,0.2),('animal','negative',0.0,0.2))"
_DIMS = ("evidence_class", "relation", "symptom", "evidence_code", "report_value")

SQL = {
    "a_observations": f"""
WITH p AS (SELECT perturbation_id, symptom, relation, arg_min({{'c': evidence_class, 't': perturbation_type}}, {{'r': {_RANK}, 'o': report_ordinal}}) AS f, count(*) AS report_count, count_if(report_value = 1)::BIGINT AS positive_report_count,
  count_if(report_value IS NULL OR report_value <> 1)::BIGINT AS negative_report_count, round(max(frequency) FILTER (report_value = 1), 6) AS max_frequency, (sum(frequency_denominator) FILTER (report_value = 1))::BIGINT AS patient_count,
  min(evidence_date) FILTER (report_value = 1) AS evidence_date, string_agg(DISTINCT source, ';' ORDER BY source) AS sources FROM reports GROUP BY 1, 2, 3),
e AS (SELECT perturbation_id, symptom, relation, trim(unnest(string_split("references", ';'))) AS ref FROM reports WHERE report_value = 1),
q AS (SELECT perturbation_id, symptom, relation, count(DISTINCT ref) AS a, count(DISTINCT ref) FILTER (starts_with(ref, 'PMID:')) AS b FROM e WHERE ref <> '' GROUP BY 1, 2, 3)
SELECT perturbation_id, symptom, relation, f.c AS evidence_class, f.t AS perturbation_type, report_count, positive_report_count, negative_report_count, max_frequency, patient_count, evidence_date, sources, coalesce(a, 0) AS distinct_reference_count, coalesce(b, 0) AS distinct_pubmed_reference_count
FROM p LEFT JOIN q USING (perturbation_id, symptom, relation)""",
    "a_max_of_means": "WITH m AS (SELECT perturbation_id, symptom, source_term_id, avg(frequency) AS m FROM reports WHERE report_value = 1 AND evidence_code IN ('frequency', 'placebo_controlled_frequency') AND frequency IS NOT NULL GROUP BY 1, 2, 3) SELECT perturbation_id, symptom, round(max(m), 6) AS label_frequency FROM m GROUP BY 1, 2",
    "a_count_matrix": f"WITH {_MATRIX} SELECT perturbation_id, symptom, source, round(positive, 5) AS positive, round(negative, 5) AS negative FROM m",
    "a_implicit_negatives": f"""WITH {_MATRIX}, i AS (SELECT DISTINCT perturbation_id, symptom FROM reports), c AS (SELECT DISTINCT perturbation_id, source FROM m),
z AS (SELECT i.perturbation_id, i.symptom, c.source FROM i JOIN c USING (perturbation_id) ANTI JOIN m ON m.perturbation_id = i.perturbation_id AND m.symptom = i.symptom AND m.source = c.source),
u AS (SELECT source, positive, negative FROM m UNION ALL SELECT source, 0, 0.5 FROM z) SELECT source, count(*) AS cells, round(sum(positive), 3) AS positive, round(sum(negative), 3) AS negative FROM u GROUP BY 1""",
    "a_soft_evidence": f"WITH {_SOFT} SELECT * FROM s",
    "a_resolved_pairs": f"""WITH {_SOFT}, {_TIERS}, j AS (SELECT s.*, probability::DOUBLE AS probability, unit_strength::DOUBLE AS unit_strength, {_RANK} AS rk FROM s JOIN t USING (evidence_class, direction)),
p AS (SELECT perturbation_id, symptom, count(DISTINCT direction) AS dd, arg_min({{'c': evidence_class, 'd': direction, 'n': n_distinct, 'p': probability, 'u': unit_strength}}, {{'r': rk, 'c': evidence_class}}) AS b FROM j GROUP BY 1, 2)
SELECT perturbation_id, symptom, dd > 1 AS contested, CASE WHEN dd = 1 THEN b.c END AS evidence_class, CASE WHEN dd = 1 THEN b.d END AS direction, CASE WHEN dd = 1 THEN b.p END AS probability, CASE WHEN dd = 1 THEN round(b.u * pow(least(b.n::DOUBLE, 10.0), 0.5), 6) END AS strength FROM p""",
    "a_pair_categories": "SELECT perturbation_id, symptom, CASE WHEN min(report_value) IS NULL THEN 'unstated' WHEN min(report_value) = 1 THEN 'all_positive' WHEN max(report_value) = 0 THEN 'all_negative' ELSE 'conflicting' END AS category FROM reports GROUP BY 1, 2",
    "a_summary": " UNION ALL ".join([f"SELECT '{c}' AS dimension, coalesce({c}::VARCHAR, '<null>') AS value, count(*) AS n FROM reports GROUP BY {c}" for c in _DIMS] + ["SELECT 'total', 'all', count(*) FROM reports"]),
    "a_heavy_diseases": "SELECT disease_id, count(DISTINCT term_id) AS n FROM annotations WHERE disease_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT term_id) >= 10",
    "a_concentration": "WITH p AS (SELECT symptom, source_record_id, count(DISTINCT perturbation_id) AS n FROM reports GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY symptom ORDER BY n DESC, source_record_id NULLS FIRST) AS r FROM p) SELECT symptom, count(*) AS clusters, sum(n)::BIGINT AS members, round(sum(CASE WHEN r <= 5 THEN n ELSE 0 END) / sum(n), 6) AS top_share FROM r GROUP BY 1",
    "a_pivot": "SELECT user_id, " + ", ".join(f"round(max(value) FILTER (event_type = '{c}'), 6) AS {c}" for c in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "a_most_common": "WITH p AS (SELECT perturbation_id, target_type, count(*) AS n FROM drug_targets WHERE target_type IS NOT NULL GROUP BY 1, 2) SELECT perturbation_id, arg_min(target_type, {'c': target_type = 'PROTEIN FAMILY', 'n': -n, 't': target_type}) AS target_type FROM p GROUP BY 1",
    "a_equal_shares": "WITH e AS (SELECT unnest(accessions) AS value, 1.0::DOUBLE / len(accessions) AS w FROM drug_targets WHERE len(accessions) > 0) SELECT value, round(sum(w) / (SELECT sum(w) FROM e), 9) AS share FROM e GROUP BY 1",
    "a_standardised": "SELECT p_partkey, p_brand, round(coalesce((p_size - avg(p_size) OVER w) / CASE WHEN stddev_pop(p_size) OVER w > 0 THEN stddev_pop(p_size) OVER w ELSE 1 END, 0), 5) AS size, round(coalesce((p_retailprice - avg(p_retailprice) OVER w) / CASE WHEN stddev_pop(p_retailprice) OVER w > 0 THEN stddev_pop(p_retailprice) OVER w ELSE 1 END, 0), 5) AS price FROM part WINDOW w AS (PARTITION BY p_brand)",
    "a_trimmed_scale": """WITH l AS (SELECT l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) v, sum(l_quantity) r FROM lineitem GROUP BY 1), m AS (SELECT log2(v / r) m, 0.5 * log2(v * r) a FROM l WHERE v > 0 AND r > 0),
q AS (SELECT quantile_cont(m, 0.3) ml, quantile_cont(m, 0.7) mh, quantile_cont(a, 0.05) al, quantile_cont(a, 0.95) ah FROM m) SELECT round(pow(2.0, avg(m)), 6) AS factor, count(*) AS kept FROM m, q WHERE m BETWEEN ml AND mh AND a BETWEEN al AND ah""",
}
