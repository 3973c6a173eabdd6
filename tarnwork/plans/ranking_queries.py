"""Ranks, strata and ranking metrics over scored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.operators import ranking as R
from tarnwork.plans.scalar_queries import _t


def _scores(spark, d):
    """Documents scored by length; the label is whether they are English, the key their source."""
    t = _t(spark, d, "documents").where("source is not null and lang is not null")
    return t.select("doc_id", "source", F.lower(F.substring("lang", 1, 2)).alias("lang2"), F.col("n_chars").cast("double").alias("score"), (F.lower(F.substring("lang", 1, 2)) == "en").cast("int").alias("label"))


def r_average_precision(spark, d):
    return R.average_precision(_scores(spark, d), ["source"], "score", "label").withColumn("average_precision", F.round("average_precision", 6))


def r_auroc(spark, d):
    return R.auroc(_scores(spark, d), ["source"], "score", "label").withColumn("auroc", F.round("auroc", 6))


def r_stratified_auroc(spark, d):
    s = _scores(spark, d).withColumn("half", F.col("doc_id") % 2)
    return R.stratified_auroc(s, ["half"], "source", "score", "label").withColumn("stratified_auroc", F.round("stratified_auroc", 6))


def r_macro(spark, d):
    ap = R.average_precision(_scores(spark, d).withColumn("half", F.col("doc_id") % 2), ["half", "source"], "score", "label")
    return R.macro_over(ap, ["half"], "average_precision", "positives", "rows", 3).withColumn("macro_average_precision", F.round("macro_average_precision", 6))


def r_reciprocal_rank(spark, d):
    r = _t(spark, d, "reports").where("report_value is not null").groupBy("perturbation_id", "symptom").agg(F.sum("report_value").alias("score"), F.max("report_value").alias("label"))
    p = R.positive_ranks(r.withColumn("label", F.when(F.col("score") % 3 == 1, 1).otherwise(0)), "perturbation_id", "score", "label", "symptom", 3)
    return p.agg(F.round(F.avg(1 / F.col("best_rank")), 6).alias("reciprocal_rank"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hits_at_3"), F.count("*").alias("rows"))


def r_calibration(spark, d):
    p = _t(spark, d, "target_pairs").select("score", F.when(F.col("matched_on") == "sequence", 1).otherwise(0).alias("label"))
    return R.calibration_error(p, "score", "label").withColumn("calibration_error", F.round("calibration_error", 6))


def r_rank_share(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return R.average_rank_share(p, "p_brand", "p_size").withColumn("rank_share", F.round("rank_share", 6))


def r_equal_bins(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_acctbal")
    return R.equal_count_bins(c, [F.col("c_acctbal"), F.col("c_custkey")], 5).select("c_custkey", F.col("bin").cast("long").alias("bin"))


def r_quantile_strata(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"))
    return R.quantile_strata(p, "price", 4).select("p_partkey", F.col("stratum").cast("long").alias("stratum"))


def r_order_statistic(spark, d):
    n = _t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return R.order_statistic_flag(n, "n", 0.99, "hub")


def r_count_labels(spark, d):
    n = _t(spark, d, "drug_targets").groupBy("perturbation_id").agg(F.countDistinct("target_chembl_id").alias("n"))
    return n.select("perturbation_id", R.count_label(F.col("n")).alias("label"))


def r_simplex(spark, d):
    p = _t(spark, d, "target_pairs").where("matched_on is not null").groupBy("matched_on", "left_target_id").agg(F.max("score").alias("score"))
    return R.simplex(p.where("left_target_id is not null"), "matched_on", "score").select("matched_on", "left_target_id", F.round("weight", 6).alias("weight"))


def r_holm(spark, d):
    p = _t(spark, d, "lineitem").groupBy("l_shipdate").agg(F.count("*").alias("n")).groupBy(F.year("l_shipdate").alias("y")).agg((1.0 / F.sum("n")).alias("p"))
    return R.holm(p, "p", "y", 0.01).select(F.col("y").cast("long").alias("y"), "rejected")


def r_bootstrap(spark, d):
    b = R.bootstrap_macro(_scores(spark, d), "doc_id", "source", "score", "label")
    return b.agg(F.percentile("value", 0.025).alias("lower"), F.avg("value").alias("mean"), F.percentile("value", 0.975).alias("upper"))


QUERIES = {f.__name__: f for f in (r_average_precision, r_auroc, r_stratified_auroc, r_macro, r_reciprocal_rank, r_calibration, r_rank_share, r_equal_bins, r_quantile_strata, r_order_statistic, r_count_labels, r_simplex, r_holm, r_bootstrap)}

_S = "s AS (SELECT doc_id, source, n_chars::DOUBLE AS score, CASE WHEN lower(substr(lang, 1, 2)) = 'en' THEN 1 ELSE 0 END AS label, doc_id % 2 AS half FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)"


def _ap(keys: str) -> str:
    return f"""l AS (SELECT {keys}, score, sum(label) tp, count(*) n FROM s GROUP BY {keys}, score), c AS (SELECT *, sum(tp) OVER (PARTITION BY {keys} ORDER BY score DESC) ctp, sum(n) OVER (PARTITION BY {keys} ORDER BY score DESC) cn FROM l),
ap AS (SELECT {keys}, CASE WHEN sum(tp) > 0 THEN sum(tp * ctp / cn) / sum(tp) END AS average_precision, sum(tp)::BIGINT AS positives, sum(n)::BIGINT AS rows FROM c GROUP BY {keys})"""


def _auc(keys: str) -> str:
    return f"""l AS (SELECT {keys}, score, sum(label) tp, sum(1 - label) neg FROM s GROUP BY {keys}, score), c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) below FROM l),
g AS (SELECT {keys}, sum(tp * (below + 0.5 * neg)) AS c, sum(tp) * sum(neg) AS pairs FROM c GROUP BY {keys})"""


SQL = {
    "r_average_precision": f"WITH {_S}, {_ap('source')} SELECT source, round(average_precision, 6) AS average_precision, positives, rows FROM ap",
    "r_auroc": f"WITH {_S}, {_auc('source')} SELECT source, CASE WHEN pairs > 0 THEN round(c / pairs, 6) END AS auroc FROM g",
    "r_stratified_auroc": f"WITH {_S}, {_auc('half, source')} SELECT half, round(sum(c) / nullif(sum(pairs), 0), 6) AS stratified_auroc FROM g GROUP BY half",
    "r_macro": f"WITH {_S}, {_ap('half, source')} SELECT half, round(avg(average_precision), 6) AS macro_average_precision, count(*) AS groups FROM ap WHERE positives >= 3 AND rows > positives GROUP BY half",
    "r_reciprocal_rank": """WITH r AS (SELECT perturbation_id, symptom, sum(report_value) AS score FROM reports WHERE report_value IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY perturbation_id ORDER BY score DESC, symptom) AS r FROM r),
b AS (SELECT perturbation_id, min(r) AS b FROM k WHERE score % 3 = 1 GROUP BY 1) SELECT round(avg(1.0 / b), 6) AS reciprocal_rank, round(avg(CASE WHEN b <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hits_at_3, count(*) AS rows FROM b""",
    "r_calibration": "WITH p AS (SELECT least(floor(score * 10), 9) b, score, CASE WHEN matched_on = 'sequence' THEN 1.0 ELSE 0.0 END y FROM target_pairs WHERE score IS NOT NULL), g AS (SELECT b, count(*) n, abs(avg(score) - avg(y)) gap FROM p GROUP BY 1) SELECT round(sum(n * gap) / sum(n), 6) AS calibration_error FROM g",
    "r_rank_share": "SELECT p_partkey, p_brand, p_size, round((rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) / (count(*) OVER (PARTITION BY p_brand) + 1), 6) AS rank_share FROM part",
    "r_equal_bins": "SELECT c_custkey, floor((row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) * 5 / (SELECT count(*) FROM customer))::BIGINT AS bin FROM customer",
    "r_quantile_strata": "WITH e AS (SELECT list_distinct(quantile_cont(p_retailprice, [0.25, 0.5, 0.75])) e FROM part) SELECT p_partkey, len(list_filter(e, lambda x: x <= p_retailprice))::BIGINT AS stratum FROM part, e",
    "r_order_statistic": "WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT n, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS t FROM n) SELECT l_partkey, n, n >= (SELECT min(n) FROM o WHERE r > floor(t * 0.99)) AS hub FROM n",
    "r_count_labels": "SELECT perturbation_id, CASE WHEN count(DISTINCT target_chembl_id) = 0 THEN '0' WHEN count(DISTINCT target_chembl_id) <= 3 THEN count(DISTINCT target_chembl_id)::VARCHAR ELSE '4+' END AS label FROM drug_targets GROUP BY 1",
    "r_simplex": """WITH p AS (SELECT matched_on, left_target_id, max(score) score FROM target_pairs WHERE matched_on IS NOT NULL AND left_target_id IS NOT NULL GROUP BY 1, 2), c AS (SELECT *, row_number() OVER w AS k, sum(score) OVER w AS s FROM p WINDOW w AS (PARTITION BY matched_on ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
t AS (SELECT matched_on, arg_max((s - 1) / k, k) AS tau FROM c WHERE 1 + k * score > s GROUP BY 1) SELECT matched_on, left_target_id, round(greatest(score - tau, 0), 6) AS weight FROM p JOIN t USING (matched_on)""",
    "r_holm": "WITH p AS (SELECT year(l_shipdate) y, 1.0 / count(*) AS p FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, y) i, count(*) OVER () m FROM p) SELECT y, bool_and(p <= 0.01 / (m - i + 1)) OVER (ORDER BY p, y) AS rejected FROM r",
}
