"""Precedence joins, first-row rules, unions and counted drops."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.functions.ids import id_key, not_placeholder
from tarnwork.operators import joins as J
from tarnwork.plans.keys import BAD as _BAD, good as _good
from tarnwork.plans.scalar_queries import _t


def j_first_report(spark, d):
    r = _t(spark, d, "reports").select("perturbation_id", "symptom", "source", "report_value", "report_ordinal")
    return J.first_per_key(r, ["perturbation_id", "symptom"], [F.col("report_ordinal")])


def j_last_delivery(spark, d):
    r = _t(spark, d, "reports").select("report_id", "report_value", "report_ordinal", "source")
    return J.last_per_key(r, ["report_id"], [F.col("report_ordinal")])


def j_unambiguous(spark, d):
    t = _t(spark, d, "drug_targets").select(id_key(not_placeholder(F.col("target_chembl_id"))).alias("target"), F.explode("accessions").alias("accession"))
    return J.unambiguous(t, "accession", "target")


def j_inverse(spark, d):
    t = _t(spark, d, "drug_targets").select(id_key(not_placeholder(F.col("target_chembl_id"))).alias("target"), F.transform("gene_symbols", lambda g: id_key(not_placeholder(g))).alias("genes"))
    return J.inverse(t.where("target is not null"), "target", "genes", "gene").where("gene is not null").select("gene", F.array_join("target", "|").alias("targets"))


def j_precedence(spark, d):
    b = _t(spark, d, "split_items").select("item_id", id_key(F.col("perturbation_id")).alias("p"))
    key = id_key(F.col("perturbation_id")).alias("key")
    routes = [(n, F.col("p"), _t(spark, d, t).select(key, F.lower("drug").alias("v")).where("key is not null and v is not null").groupBy("key").agg(F.min("v").alias("value")))
              for n, t in (("binding", "drug_label_protein_binding"), ("routes", "drug_administration_routes"))]
    return J.precedence_join(b, routes, "drug").select("item_id", "drug", "drug_route")


def j_fill_union(spark, d):
    a = _t(spark, d, "drug_label_protein_binding").select(F.col("binding_id").alias("row_id"), "perturbation_id", "qualifier")
    b = _t(spark, d, "drug_administration_routes").select(F.col("route_row_id").alias("row_id"), "perturbation_id", "route_class", "kept_positives")
    return J.fill_union([a, b], {"kept_positives": 0, "qualifier": ""})


def j_flagged(spark, d):
    o, f = _t(spark, d, "orders").select("o_orderkey", "o_custkey"), _t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.flagged(o, f, ["o_orderkey"], "returned")


def j_kept_relations(spark, d):
    kept, _ = _ctd(spark, d)
    return kept.select("relation_id", "symptom", "relation")


def _ctd(spark, d):
    c = _t(spark, d, "ctd_relations")
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    return J.counted_drops(c, [("no drug name", blank(F.col("drug_name"))), ("unmatched", F.col("chemical_match_method") == "unmatched"), ("no symptom", blank(F.col("symptom"))), ("mixed descriptor", F.col("mesh_descriptor_level") == "mixed")])


def j_drop_reasons(spark, d):
    return _ctd(spark, d)[1]


def j_compare(spark, d):
    r = _t(spark, d, "reports").groupBy("perturbation_id", "symptom")
    a = r.agg(F.max(F.when(F.col("relation") == "induces", F.col("report_value"))).alias("v"))
    b = _t(spark, d, "reports").where("evidence_class = 'monogenic'").groupBy("perturbation_id", "symptom").agg(F.max("report_value").alias("v"))
    return J.compare_tables(a, b, ["perturbation_id", "symptom"], ["v"])


def j_shared_targets(spark, d):
    t = _t(spark, d, "drug_targets").select(id_key(F.col("perturbation_id")).alias("p"), id_key(not_placeholder(F.col("target_chembl_id"))).alias("target")).where("target is not null and p is not null")
    held = _t(spark, d, "held_out_additions").where("held_out").select(id_key(F.col("perturbation_id")).alias("p")).distinct()
    return J.shared_neighbours(t.join(held, "p", "left_semi"), t.join(held, "p", "left_anti"), "target", "p", "p")


QUERIES = {f.__name__: f for f in (j_first_report, j_last_delivery, j_unambiguous, j_inverse, j_precedence, j_fill_union, j_flagged, j_kept_relations, j_drop_reasons, j_compare, j_shared_targets)}

_K = "nullif(regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g'), '')"


def _key(c: str) -> str:
    return _K.format(c)


def _good(c: str) -> str:
    return f"CASE WHEN {_key(c)} NOT IN {_BAD} THEN {_key(c)} END"


_DROP = """CASE WHEN coalesce(trim(drug_name), '') = '' THEN 'no drug name' WHEN chemical_match_method = 'unmatched' THEN 'unmatched' WHEN coalesce(trim(symptom), '') = '' THEN 'no symptom' WHEN mesh_descriptor_level = 'mixed' THEN 'mixed descriptor' END"""

SQL = {
    "j_first_report": "SELECT perturbation_id, symptom, arg_min({'s': source}, report_ordinal).s AS source, arg_min({'v': report_value}, report_ordinal).v AS report_value, min(report_ordinal) AS report_ordinal FROM reports GROUP BY 1, 2",
    "j_last_delivery": "SELECT report_id, arg_max({'v': report_value}, report_ordinal).v AS report_value, max(report_ordinal) AS report_ordinal, arg_max({'s': source}, report_ordinal).s AS source FROM reports GROUP BY 1",
    "j_unambiguous": f"WITH t AS (SELECT {_good('target_chembl_id')} AS target, unnest(accessions) AS accession FROM drug_targets) SELECT accession, min(target) AS target FROM t WHERE accession IS NOT NULL AND target IS NOT NULL GROUP BY 1 HAVING min(target) = max(target)",
    "j_inverse": f"WITH t AS (SELECT {_good('target_chembl_id')} AS target, unnest(gene_symbols) AS s FROM drug_targets), g AS (SELECT target, {_good('s')} AS gene FROM t) SELECT gene, string_agg(DISTINCT target, '|' ORDER BY target) AS targets FROM g WHERE gene IS NOT NULL AND target IS NOT NULL GROUP BY 1",
    "j_precedence": f"""WITH b AS (SELECT {_key('perturbation_id')} k, min(lower(drug)) v FROM drug_label_protein_binding WHERE drug IS NOT NULL GROUP BY 1), r AS (SELECT {_key('perturbation_id')} k, min(lower(drug)) v FROM drug_administration_routes WHERE drug IS NOT NULL GROUP BY 1)
SELECT item_id, coalesce(b.v, r.v) AS drug, CASE WHEN b.v IS NOT NULL THEN 'binding' WHEN r.v IS NOT NULL THEN 'routes' ELSE 'none' END AS drug_route FROM (SELECT item_id, {_key('perturbation_id')} k FROM split_items) s LEFT JOIN b USING (k) LEFT JOIN r USING (k)""",
    "j_fill_union": "SELECT binding_id AS row_id, perturbation_id, coalesce(qualifier, '') AS qualifier, NULL::VARCHAR AS route_class, 0::BIGINT AS kept_positives FROM drug_label_protein_binding UNION ALL SELECT route_row_id, perturbation_id, '', route_class, coalesce(kept_positives, 0) FROM drug_administration_routes",
    "j_flagged": "SELECT o_orderkey, o_custkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS returned FROM orders",
    "j_kept_relations": f"SELECT relation_id, symptom, relation FROM ctd_relations WHERE {_DROP} IS NULL",
    "j_drop_reasons": f"SELECT {_DROP} AS reason, count(*) AS n FROM ctd_relations WHERE {_DROP} IS NOT NULL GROUP BY 1",
    "j_compare": """WITH a AS (SELECT perturbation_id, symptom, max(CASE WHEN relation = 'induces' THEN report_value END) v FROM reports GROUP BY 1, 2), b AS (SELECT perturbation_id, symptom, max(report_value) v FROM reports WHERE evidence_class = 'monogenic' GROUP BY 1, 2)
SELECT coalesce(a.perturbation_id, b.perturbation_id) AS perturbation_id, coalesce(a.symptom, b.symptom) AS symptom, CASE WHEN a.symptom IS NULL THEN 'added' WHEN b.symptom IS NULL THEN 'removed' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'changed' END AS state
FROM a FULL JOIN b ON a.perturbation_id = b.perturbation_id AND a.symptom = b.symptom""",
    "j_shared_targets": f"""WITH t AS (SELECT DISTINCT {_key('perturbation_id')} p, {_good('target_chembl_id')} x FROM drug_targets), h AS (SELECT DISTINCT {_key('perturbation_id')} p FROM held_out_additions WHERE held_out)
SELECT a.p AS left_id, b.p AS right_id, count(*) AS shared FROM t a JOIN t b ON a.x = b.x WHERE a.p IN (SELECT p FROM h) AND b.p NOT IN (SELECT p FROM h) AND a.p IS NOT NULL AND b.p IS NOT NULL GROUP BY 1, 2""",
}
