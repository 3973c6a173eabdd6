"""Folds, splits, hold-outs, permutations, baselines and reliability."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.functions.ids import id_key, not_placeholder
from tarnwork.operators import aggregates as A
from tarnwork.operators import evaluation as V
from tarnwork.operators.joins import shared_neighbours
from tarnwork.plans.keys import KEY as _KEY, good as _good
from tarnwork.plans.scalar_queries import _t


def _items(spark, d):
    return _t(spark, d, "split_items").select("item_id", id_key(not_placeholder(F.col("group_id"))).alias("grp"), id_key(F.col("perturbation_id")).alias("p"), "evidence_date", "perturbation_type", "symptom")


def e_folds(spark, d):
    i = _items(spark, d)
    f = V.grouped_folds(i, "grp", 5)
    return i.join(f, "grp").groupBy("fold").agg(F.count("*").alias("items"), F.countDistinct("grp").alias("groups"))


def e_time_split(spark, d):
    i = _items(spark, d).withColumn("side", V.time_split(F.col("evidence_date"), "2018-01-01"))
    return i.groupBy("side").agg(F.count("*").alias("items"), F.min("evidence_date").alias("first"), F.max("evidence_date").alias("last"))


def e_without_partners(spark, d):
    i = _items(spark, d).withColumn("held", F.col("item_id") % 10 == 0)
    return V.without_partners(i, "grp", "held").select("item_id", "held", "trains")


def e_straddling(spark, d):
    i = _items(spark, d).where("grp is not null").withColumn("inside", F.col("item_id") % 4 == 0)
    return V.straddling(i, "grp", "inside")


def e_drawn(spark, d):
    g = _items(spark, d).where("grp is not null").groupBy("perturbation_type", "grp").agg(F.count("*").alias("size"), F.min("item_id").alias("first"))
    return V.drawn_groups(g, "perturbation_type", "grp", "size", 0.2, V.spread(F.col("first"), 3))


def e_held_values(spark, d):
    t = _t(spark, d, "drug_targets").select(id_key(F.col("perturbation_id")).alias("p"), id_key(not_placeholder(F.col("target_chembl_id"))).alias("t"), "drug_target_id").where("p is not null and t is not null")
    first = t.groupBy("t").agg(F.min("drug_target_id").alias("o"))
    pairs = t.select("p", "t").distinct().join(first, "t")
    keyed = pairs.withColumn("t", F.concat(F.lpad(V.spread(F.col("o")).cast("string"), 12, "0"), F.lit("|"), F.col("t")))
    return V.held_out_values(keyed, "p", "t", 0.3, F.col("t")).select(F.split_part("t", F.lit("|"), F.lit(2)).alias("t"), F.col("position").cast("long").alias("position"), "touched")


def e_permuted(spark, d):
    r = _t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return V.permuted_within(r, "c_custkey", "c_mktsegment", ["c_acctbal"], 5).select("c_custkey", "c_mktsegment", "c_acctbal")


def e_base_rates(spark, d):
    return V.base_rates(_t(spark, d, "reports"), "symptom", "report_value").withColumn("rate", F.round("rate", 6))


def e_neighbour_scores(spark, d):
    t = _t(spark, d, "drug_targets").select(id_key(F.col("perturbation_id")).alias("p"), id_key(not_placeholder(F.col("target_chembl_id"))).alias("t")).where("p is not null and t is not null")
    held = _t(spark, d, "held_out_additions").select(id_key(F.col("perturbation_id")).alias("p")).distinct()
    pairs = shared_neighbours(t.join(held, "p", "left_semi"), t.join(held, "p", "left_anti"), "t", "p", "p")
    labels = _t(spark, d, "reports").where("report_value is not null").groupBy(id_key(F.col("perturbation_id")).alias("right_id"), "symptom").agg(F.max("report_value").cast("double").alias("label"))
    n = V.neighbour_scores(pairs, labels, "symptom", 2.0)
    return n.select("left_id", "symptom", "best", F.round("mean", 6).alias("mean"), F.round("shrunk", 6).alias("shrunk"))


def e_kappa(spark, d):
    c = _t(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_linestatus") == "O", "N").otherwise("R").alias("other"))
    return V.kappa(c, "l_returnflag", "other").select(F.round("exact_match", 6).alias("exact_match"), F.round("kappa", 6).alias("kappa"))


def e_profiles(spark, d):
    v = _t(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    p = V.class_profiles(v, "vec_id", "dim", "x", "label")
    return p.select("vec_id", F.col("class").cast("long").alias("class"), F.round("cosine", 5).alias("cosine"))


def _latent(spark, d, grouped=True):
    r = _t(spark, d, "reports").withColumn("source", F.lower(F.regexp_replace("source", "[^A-Za-z0-9]", "")))
    m = A.count_matrix(r, ["perturbation_id", "symptom"], "source", "source_record_id", "report_value", F.lit(1.0))
    kind = r.groupBy("perturbation_id", "symptom").agg(F.min("evidence_class").alias("kind"))
    m = m.join(kind, ["perturbation_id", "symptom"]) if grouped else m
    return V.latent_reliability(m, ["perturbation_id", "symptom"], "source", "kind" if grouped else None)


def e_latent_sources(spark, d):
    s = _latent(spark, d)[1]
    return s.select("source", F.round("sensitivity", 5).alias("sensitivity"), F.round("specificity", 5).alias("specificity"), "held")


def e_latent_prevalence(spark, d):
    return _latent(spark, d)[2].withColumn("prevalence", F.round("prevalence", 5))


def e_log_likelihood(spark, d):
    """Of the reports under even rates of 0.8 and a prevalence of one half."""
    r = _t(spark, d, "reports").withColumn("source", F.lower(F.regexp_replace("source", "[^A-Za-z0-9]", "")))
    m = A.count_matrix(r, ["perturbation_id", "symptom"], "source", "source_record_id", "report_value", F.lit(1.0))
    rates = m.select("source").distinct().select("source", F.lit(0.8).alias("sensitivity"), F.lit(0.7).alias("specificity"))
    return V.marginal_log_likelihood(m, ["perturbation_id", "symptom"], "source", rates, F.lit(0.4)).select(F.round("log_likelihood", 3).alias("log_likelihood"))


def e_latent_items(spark, d):
    return _latent(spark, d)[0].withColumn("posterior", F.round("posterior", 4))


def e_shortest(spark, d):
    p = _t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.sum("p_size").cast("double").alias("a"), F.round(F.avg("p_retailprice"), 4).alias("b"))
    return V.shortest_description(p, ["p_brand"], "p_type", ["a", "b"]).withColumn("length", F.round("length", 4))


def e_posterior_weights(spark, d):
    k = ["perturbation_id", "symptom"]
    r = _t(spark, d, "reports").where("perturbation_id is not null")
    post = r.where("report_value is not null").groupBy(*k).agg(F.avg("report_value").alias("posterior"))
    rates = r.select("source").distinct().select("source", F.lit(0.8).alias("sensitivity"), F.lit(0.7).alias("specificity"))
    return V.posterior_weights(post, r.where("report_value = 1"), rates, k, 0.6).withColumn("weight", F.round("weight", 6))


def _links(spark, d):
    return _t(spark, d, "reports").where("frequency is not null and perturbation_id is not null").groupBy("symptom", "perturbation_id").agg(F.avg("frequency").alias("v"))


def e_module_sides(spark, d):
    return V.module_sides(_links(spark, d), "perturbation_id", "symptom", "v", 0.2).withColumn("above", F.round("above", 6))


def e_module_drivers(spark, d):
    return V.module_drivers(_links(spark, d), "symptom", "perturbation_id", "v", 0.1, 0.8).withColumn("v", F.round("v", 6))


def e_checked(spark, d):
    i = _t(spark, d, "split_items").where("perturbation_id is not null")
    top = i.groupBy("symptom").agg(F.min("perturbation_id").alias("reference"), F.max("perturbation_id").alias("other"), F.min("item_id").alias("statement"))
    s = top.select("statement", F.col("symptom").alias("item"), "reference", "other", (F.col("statement") % 3 - 1).alias("expected"), (F.col("statement") % 2 == 0).alias("judged"))
    p = i.groupBy(F.col("perturbation_id").alias("unit"), F.col("symptom").alias("item")).agg(F.count("*").cast("double").alias("value"))
    return V.checked(s, p, 0.5)


def e_paired_bootstrap(spark, d):
    t = _t(spark, d, "documents").where("source is not null and lang is not null").select("doc_id", "source", F.col("n_chars").cast("double").alias("a"), F.size(F.split("text", r"\s+")).cast("double").alias("b"), F.when(F.lower(F.substring("lang", 1, 2)) == "en", 1).otherwise(0).alias("label"))
    return V.paired_bootstrap(t, "doc_id", "source", "a", "b", "label")


QUERIES = {f.__name__: f for f in (e_folds, e_time_split, e_without_partners, e_straddling, e_drawn, e_held_values, e_permuted, e_base_rates, e_neighbour_scores, e_kappa, e_profiles, e_latent_sources, e_latent_items, e_latent_prevalence, e_log_likelihood, e_shortest, e_posterior_weights, e_module_sides, e_module_drivers, e_checked, e_paired_bootstrap)}


_I = f"i AS (SELECT item_id, {_good('group_id')} AS grp, perturbation_type, evidence_date FROM split_items)"
_T = f"t AS (SELECT DISTINCT {_KEY.format('perturbation_id')} p, {_good('target_chembl_id')} t FROM drug_targets)"
_EM = """r AS (SELECT DISTINCT perturbation_id p, symptom s, lower(regexp_replace(source, '[^A-Za-z0-9]', '', 'g')) AS src, source_record_id, report_value v FROM reports WHERE report_value IS NOT NULL),
m AS (SELECT p, s, src, count(*) FILTER (v = 1)::DOUBLE a, count(*) FILTER (v <> 1)::DOUBLE b FROM r GROUP BY 1, 2, 3)"""


SQL = {
    "e_time_split": f"WITH {_I} SELECT CASE WHEN evidence_date <= '2018-01-01' THEN 'train' WHEN evidence_date > '2018-01-01' THEN 'test' END AS side, count(*) AS items, min(evidence_date) AS first, max(evidence_date) AS last FROM i GROUP BY 1",
    "e_without_partners": f"WITH {_I}, h AS (SELECT DISTINCT grp FROM i WHERE item_id % 10 = 0 AND grp IS NOT NULL) SELECT item_id, item_id % 10 = 0 AS held, item_id % 10 <> 0 AND (grp IS NULL OR grp NOT IN (SELECT grp FROM h)) AS trains FROM i",
    "e_straddling": f"WITH {_I} SELECT grp FROM i WHERE grp IS NOT NULL GROUP BY 1 HAVING min(item_id % 4 = 0) <> max(item_id % 4 = 0)",
    "e_drawn": f"WITH {_I}, g AS (SELECT perturbation_type, grp, count(*) size, min(item_id) f FROM i WHERE grp IS NOT NULL GROUP BY 1, 2), w AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY perturbation_type ORDER BY ((f + 3) * 2654435761) % 4294967296, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) c, sum(size) OVER (PARTITION BY perturbation_type) t FROM g) SELECT perturbation_type, grp, size FROM w WHERE c < 0.2 * t",
    "e_held_values": f"""WITH {_T}, o AS (SELECT {_good('target_chembl_id')} t, min(drug_target_id) o FROM drug_targets WHERE {_KEY.format('perturbation_id')} IS NOT NULL GROUP BY 1), v AS (SELECT t, row_number() OVER (ORDER BY lpad(((o * 2654435761) % 4294967296)::VARCHAR, 12, '0') || '|' || t) AS k FROM o WHERE t IS NOT NULL),
f AS (SELECT p, min(k) k FROM t JOIN v USING (t) WHERE p IS NOT NULL GROUP BY 1), n AS (SELECT k, count(*) n FROM f GROUP BY 1), x AS (SELECT v.t, v.k, sum(coalesce(n, 0)) OVER (ORDER BY v.k) AS touched, sum(coalesce(n, 0)) OVER () AS total FROM v LEFT JOIN n USING (k)),
b AS (SELECT arg_min(k, {{'g': abs(touched - 0.3 * total), 'k': k}}) AS b FROM x) SELECT t, k::BIGINT AS position, touched::BIGINT AS touched FROM x, b WHERE k <= b""",
    "e_permuted": "WITH a AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) i FROM customer), b AS (SELECT c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY ((c_custkey + 5) * 2654435761) % 4294967296, c_custkey) i FROM customer) SELECT c_custkey, c_mktsegment, c_acctbal FROM a JOIN b USING (c_mktsegment, i)",
    "e_base_rates": "SELECT symptom, round(avg(report_value), 6) AS rate, count(*) AS n FROM reports WHERE report_value IS NOT NULL GROUP BY 1",
    "e_neighbour_scores": f"""WITH {_T}, h AS (SELECT DISTINCT {_KEY.format('perturbation_id')} p FROM held_out_additions), s AS (SELECT a.p AS left_id, b.p AS right_id, count(*) AS shared FROM t a JOIN t b USING (t) WHERE a.p IN (SELECT p FROM h) AND b.p NOT IN (SELECT p FROM h) GROUP BY 1, 2),
l AS (SELECT {_KEY.format('perturbation_id')} AS right_id, symptom, max(report_value)::DOUBLE AS label FROM reports WHERE report_value IS NOT NULL GROUP BY 1, 2), g AS (SELECT symptom, avg(label) r FROM l GROUP BY 1)
SELECT left_id, symptom, max(label) AS best, round(sum(shared * label) / sum(shared), 6) AS mean, round((sum(shared * label) + 2 * any_value(r)) / (sum(shared) + 2), 6) AS shrunk FROM s JOIN l USING (right_id) JOIN g USING (symptom) GROUP BY 1, 2""",
    "e_kappa": "WITH c AS (SELECT l_returnflag a, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END b FROM lineitem), s AS (SELECT count(*)::DOUBLE t, count(*) FILTER (a = b)::DOUBLE m FROM c), x AS (SELECT a, count(*)::DOUBLE n FROM c GROUP BY 1), y AS (SELECT b, count(*)::DOUBLE n FROM c GROUP BY 1), e AS (SELECT sum(x.n * y.n) e FROM x JOIN y ON x.a = y.b) SELECT round(m / t, 6) AS exact_match, round((m / t - e / (t * t)) / (1 - e / (t * t)), 6) AS kappa FROM s, e",
    "e_profiles": """WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE x, generate_subscripts(embedding, 1) d FROM embeddings), m AS (SELECT label, d, sum(x) m FROM v GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) n FROM m GROUP BY 1), r AS (SELECT vec_id, sqrt(sum(x * x)) r FROM v GROUP BY 1)
SELECT v.vec_id, m.label::BIGINT AS class, round(sum(v.x * m.m) / any_value(r.r) / any_value(n.n), 5) AS cosine FROM v JOIN m USING (d) JOIN n ON n.label = m.label JOIN r ON r.vec_id = v.vec_id GROUP BY 1, 2""",
    "e_log_likelihood": f"WITH {_EM}, l AS (SELECT p, s, ln(0.4) + sum(a * ln(0.8) + b * ln(0.2)) AS t, ln(0.6) + sum(a * ln(0.3) + b * ln(0.7)) AS f FROM m GROUP BY 1, 2) SELECT round(sum(greatest(t, f) + ln(exp(t - greatest(t, f)) + exp(f - greatest(t, f)))), 3) AS log_likelihood FROM l",
    "e_shortest": "WITH p AS (SELECT p_brand, p_type, sum(p_size)::DOUBLE + round(avg(p_retailprice), 4) AS l FROM part GROUP BY 1, 2) SELECT p_brand, arg_min(p_type, {'l': l, 't': p_type}) AS p_type, round(min(l), 4) AS length FROM p WHERE l IS NOT NULL GROUP BY 1",
    "e_posterior_weights": "SELECT perturbation_id, symptom, round(avg(report_value) * 0.6, 6) AS weight FROM reports WHERE perturbation_id IS NOT NULL AND report_value IS NOT NULL AND symptom IS NOT NULL GROUP BY 1, 2 HAVING max(report_value) = 1",
    "e_module_sides": "WITH v AS (SELECT symptom, perturbation_id, avg(frequency) v FROM reports WHERE frequency IS NOT NULL AND perturbation_id IS NOT NULL GROUP BY 1, 2), x AS (SELECT *, v - CASE WHEN count(*) OVER w > 1 THEN (sum(v) OVER w - v) / (count(*) OVER w - 1) ELSE 0.0 END AS above FROM v WINDOW w AS (PARTITION BY symptom)) SELECT symptom, perturbation_id, round(above, 6) AS above FROM x WHERE above > 0.2 AND symptom IS NOT NULL",
    "e_module_drivers": "WITH v AS (SELECT symptom, perturbation_id, avg(frequency) v FROM reports WHERE frequency IS NOT NULL AND perturbation_id IS NOT NULL GROUP BY 1, 2), q AS (SELECT symptom, quantile_cont(v, 0.8) q FROM v GROUP BY 1 HAVING stddev_pop(v) > 0.1) SELECT symptom, perturbation_id, round(v, 6) AS v FROM v JOIN q USING (symptom) WHERE v >= q",
    "e_checked": "WITH i AS (SELECT * FROM split_items WHERE perturbation_id IS NOT NULL), t AS (SELECT symptom, min(perturbation_id) r, max(perturbation_id) o, min(item_id) s FROM i GROUP BY 1), p AS (SELECT perturbation_id u, symptom, count(*)::DOUBLE v FROM i GROUP BY 1, 2), x AS (SELECT s, b.v - a.v AS d FROM t JOIN p a ON a.u = r AND a.symptom = t.symptom JOIN p b ON b.u = o AND b.symptom = t.symptom) SELECT s AS statement, d AS difference, CASE WHEN s % 2 <> 0 THEN 'not judged' WHEN CASE s % 3 WHEN 2 THEN d > 0.5 WHEN 0 THEN d < -0.5 ELSE abs(d) <= 0.5 END THEN 'met' ELSE 'not met' END AS verdict FROM x",
}
