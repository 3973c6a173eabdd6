"""Multi-table evidence operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.functions import rules as U
from tarnwork.functions.ids import id_key, not_placeholder
from tarnwork.functions.scalars import normalised_name, split_list
from tarnwork.operators import evidence as E
from tarnwork.operators.aggregates import observations
from tarnwork.plans.keys import KEY as _KEY, BAD as _BAD, good as _good
from tarnwork.plans.scalar_queries import _t


def v_label_statements(spark, d):
    li, o = _t(spark, d, "lineitem"), _t(spark, d, "orders")
    effects = li.select(F.col("l_orderkey").alias("label"), F.col("l_returnflag").alias("section"), F.col("l_partkey").alias("term"), F.col("l_discount").alias("score"))
    terms = _t(spark, d, "part").select(F.col("p_partkey").alias("term"), F.col("p_brand").alias("symptom"))
    labels = o.select(F.col("o_orderkey").alias("label"), F.col("o_orderpriority").alias("country"))
    ingredients = li.select(F.col("l_orderkey").alias("label"), F.col("l_suppkey").alias("ingredient"))
    return E.label_statements(effects, terms, labels, ingredients, "R").select("ingredient", "country", "symptom", "labels", "fewest_ingredients", "labels_in_total", F.round("share", 6).alias("share"), F.round(F.col("best_score") + 0.0, 6).alias("best_score"))


def v_grades(spark, d):
    o = observations(_t(spark, d, "reports"), ["perturbation_id", "symptom", "relation"], "report_ordinal")
    entries = _t(spark, d, "reports").where("report_value = 1").groupBy("perturbation_id", "symptom", "relation").agg(
        F.countDistinct("source_record_id").alias("series"), F.max(F.col("source_record_id").startswith("OMIM:")).alias("synopsis"), F.max(F.coalesce("association_type", F.lit("")) != "").alias("typed"), F.coalesce(F.sum("rubric_causal_association"), F.lit(0.0)).alias("causal"))
    j = o.join(entries, ["perturbation_id", "symptom", "relation"], "left")
    yes = F.lit(True)
    z = lambda c, v: F.coalesce(c, F.lit(v))
    g = U.evidence_grade(F.col("evidence_class"), z(F.col("typed"), False), z(F.col("causal"), 0.0), z(F.col("series"), 0), z(F.col("synopsis"), False), z(F.col("series"), 0), yes, F.col("positive_report_count") > 0, strict=True)
    j = j.withColumn("grade", g)
    return j.select("perturbation_id", "symptom", "relation", "grade", F.round(U.grade_weight(F.col("grade"), F.col("evidence_class"), F.col("max_frequency"), F.lit(None).cast("string")), 6).alias("weight"))


def v_prefix_conflicts(spark, d):
    return E.prefix_conflicts(_t(spark, d, "drug_vocabulary").select(F.split_part("drug_name", F.lit(" "), F.lit(1)).alias("n")), "n")


def v_collapse(spark, d):
    c = _t(spark, d, "ctd_relations").where("stitch_flat_id is not null and chemical_mesh_id is not null").select("symptom", "stitch_flat_id", "chemical_match_method")
    return E.collapse_by_priority(c, "symptom", "stitch_flat_id", F.coalesce(F.col("chemical_match_method") != "ctd_chemical_name", F.lit(True)))


def v_both_keys(spark, d):
    p = _t(spark, d, "target_pairs").select("pair_id", id_key(F.col("left_target_id")).alias("l"), id_key(F.col("right_target_id")).alias("r"))
    return E.both_keys(p, "l", "r", "target").select("pair_id", "target")


def v_mechanisms(spark, d):
    t = _t(spark, d, "drug_targets").select(id_key(F.col("perturbation_id")).alias("unit"), id_key(not_placeholder(F.col("target_chembl_id"))).alias("disease"), F.col("action_type").alias("kind"))
    l = _t(spark, d, "target_pairs").select(id_key(F.col("left_target_id")).alias("disease"), id_key(F.col("right_target_id")).alias("other")).where("disease is not null and other is not null").distinct()
    pairs = t.select("unit", F.col("disease").alias("other")).join(l.select("other", "disease"), "other").select("unit", "disease").union(t.select("unit", "disease"))
    return E.mechanisms(t.where("kind is not null"), l, pairs.where("unit is not null and disease is not null"))


def v_first_unless_absent(spark, d):
    r = _t(spark, d, "reports").where("report_value is not null")
    a = r.where("source = 'label-text'").groupBy("perturbation_id", "symptom").agg(F.max("report_value").alias("v"))
    b = r.where("source = 'trial-arm'").groupBy("perturbation_id", "symptom").agg(F.max("report_value").alias("v"))
    return E.first_unless_absent(a, b, ["perturbation_id", "symptom"], "v")


def v_arms(spark, d):
    li = _t(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_linestatus", "l_extendedprice")
    return E.arm_comparison(li, ["l_suppkey"], "l_partkey", "l_linestatus", "l_extendedprice", "O", "F")


def v_edge_evidence(spark, d):
    p = _t(spark, d, "target_pairs").select(id_key(F.col("left_target_id")).alias("source"), id_key(F.col("right_target_id")).alias("target"), F.coalesce("matched_on", F.lit("none")).alias("relation"), "pair_id", "score").where("source is not null and target is not null and source <> target")
    refs = p.select("source", "target", F.col("pair_id").alias("citation"))
    neg = p.where("score < 0.7").select(F.col("source").alias("a"), F.col("target").alias("b"))
    return E.edge_evidence(p.select("source", "target", "relation"), refs, neg, ["sequence"])


def v_bulk_citations(spark, d):
    return E.bulk_citations(_t(spark, d, "reports").select("report_ordinal", split_list(F.col("references")).alias("c")), "report_ordinal", "c", 1)


def v_split_nodes(spark, d):
    t = _t(spark, d, "drug_targets").select(id_key(F.col("perturbation_id")).alias("source"), id_key(not_placeholder(F.col("target_chembl_id"))).alias("target"), F.coalesce("action_type", F.lit("none")).alias("relation"), "drug_target_id").where("source is not null and target is not null")
    parts = _t(spark, d, "drug_targets").select(id_key(not_placeholder(F.col("target_chembl_id"))).alias("node"), F.explode("accessions").alias("part")).where("node is not null and part is not null")
    return E.split_nodes(t, parts, "drug_target_id")


def v_disjoint_parts(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ordinal"), F.col("l_suppkey").alias("node"), F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0).alias("sign"), F.col("l_quantity").alias("magnitude"))
    first = li.groupBy("l_orderkey", "ordinal", "node").agg(F.min_by(F.struct("sign", "magnitude"), F.struct("sign", "magnitude")).alias("x")).select("l_orderkey", "ordinal", "node", "x.*")
    return E.disjoint_parts(first, "l_orderkey").withColumn("magnitude", F.round("magnitude", 4))


def v_recurring_pairs(spark, d):
    r = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("reaction"), F.col("l_suppkey").alias("species"), F.when(F.col("l_linestatus") == "O", "in").otherwise("out").alias("side"))
    return E.recurring_pairs(r, 3)


def v_unanimous(spark, d):
    t = _t(spark, d, "drug_targets").where("action_type is not null and pref_name is not null").select(id_key(F.col("perturbation_id")).alias("p"), "action_type", "pref_name")
    return E.unanimous(t, ["p"], "action_type", "pref_name")[0]


def v_apply_priors(spark, d):
    r = _t(spark, d, "reports").groupBy("perturbation_id", "symptom").agg(F.coalesce(F.max("report_value"), F.lit(0)).alias("outcome"), F.count("*").cast("double").alias("weight"))
    c = r.withColumn("eligible", F.col("outcome") == 0)
    p = _t(spark, d, "ctd_relations").groupBy("symptom").agg(F.round(F.avg((F.col("relation") == "induces").cast("double")), 6).alias("q"))
    pr = r.join(p, "symptom").select("perturbation_id", "symptom", F.when(F.col("weight") > 3, 0.0).otherwise(F.col("q")).alias("probability"), F.lit(2.5).alias("strength"))
    return E.apply_priors(c, pr, ["perturbation_id", "symptom"]).select("perturbation_id", "symptom", "target", "weight")


def v_balanced(spark, d):
    r = _t(spark, d, "split_items").select("item_id", "symptom", (F.col("perturbation_type") == "drug").alias("positive"), F.lit(1.0).alias("weight"))
    return E.balanced_weights(r, "symptom", "positive", "weight").select("item_id", F.round("weight", 6).alias("weight"))


def v_correlations(spark, d):
    v = _t(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return E.vector_correlations(v, "label", "dim", "x").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.round("distance", 5).alias("distance"))


def v_best_phrase(spark, d):
    t = _t(spark, d, "ontology").where("child_name is not null").select(F.col("child_name").alias("term")).distinct().withColumn("s", F.split(normalised_name(F.col("term")), " "))
    v = _t(spark, d, "fine_constructs").where("hpo_name is not null").select("hpo_name").distinct().withColumn("s", F.split(normalised_name(F.col("hpo_name")), " "))
    return E.best_phrase(t, "term", "s", v, "hpo_name", "s", "other")


def v_cards(spark, d):
    r = _t(spark, d, "reports").where("report_value = 1")
    return E.cards(r, "symptom", [F.coalesce(-F.col("pubmed_reference_count"), F.lit(2**62)), F.col("report_ordinal")], ["perturbation_id", "source", "pubmed_reference_count"], 5)


QUERIES = {f.__name__: f for f in (v_label_statements, v_grades, v_prefix_conflicts, v_collapse, v_both_keys, v_mechanisms, v_first_unless_absent, v_arms, v_edge_evidence, v_bulk_citations, v_split_nodes, v_disjoint_parts, v_recurring_pairs, v_unanimous, v_apply_priors, v_balanced, v_correlations, v_best_phrase, v_cards)}



def _k(c: str) -> str:
    return _KEY.format(c)


def _good(c: str) -> str:
    return f"CASE WHEN {_k(c)} NOT IN {_BAD} THEN {_k(c)} END"


_P = f"p AS (SELECT * FROM (SELECT {_k('left_target_id')} AS source, {_k('right_target_id')} AS target, coalesce(matched_on, 'none') AS relation, pair_id, score FROM target_pairs) WHERE source IS NOT NULL AND target IS NOT NULL AND source <> target)"
_RANK = "CASE evidence_class WHEN 'monogenic' THEN 0 WHEN 'pharmacological' THEN 1 WHEN 'open_targets' THEN 2 WHEN 'human_association' THEN 3 WHEN 'animal' THEN 4 WHEN 'literature' THEN 5 ELSE 6 END"

SQL = {
    "v_label_statements": """WITH i AS (SELECT DISTINCT l_orderkey AS label, l_suppkey AS ingredient FROM lineitem), o AS (SELECT label, ingredient, o_orderpriority AS country FROM i JOIN orders ON o_orderkey = label), s AS (SELECT label, count(*) n FROM i GROUP BY 1), t AS (SELECT ingredient, country, count(DISTINCT label) AS labels_in_total FROM o GROUP BY 1, 2),
g AS (SELECT ingredient, country, p_brand AS symptom, count(DISTINCT o.label) AS labels, max(l_discount) AS best_score, min(s.n) AS fewest_ingredients FROM lineitem JOIN part ON p_partkey = l_partkey JOIN o ON o.label = l_orderkey JOIN s ON s.label = l_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2, 3)
SELECT ingredient, country, symptom, labels, fewest_ingredients, labels_in_total, round(labels / labels_in_total, 6) AS share, round(best_score + 0.0, 6) AS best_score FROM g JOIN t USING (ingredient, country)""",
    "v_grades": f"""WITH o AS (SELECT perturbation_id, symptom, relation, arg_min(evidence_class, {{'r': {_RANK}, 'o': report_ordinal}}) AS cls, count_if(report_value = 1) AS pos, round(max(frequency) FILTER (report_value = 1), 6) AS f, count(DISTINCT source_record_id) FILTER (report_value = 1) AS series,
  coalesce(bool_or(starts_with(source_record_id, 'OMIM:')) FILTER (report_value = 1), false) AS syn, coalesce(bool_or(coalesce(association_type, '') <> '') FILTER (report_value = 1), false) AS typed, coalesce(sum(rubric_causal_association) FILTER (report_value = 1), 0) AS causal FROM reports GROUP BY 1, 2, 3),
g AS (SELECT *, CASE WHEN cls = 'monogenic' AND typed AND causal = 0 THEN 'C' WHEN cls = 'monogenic' AND (series >= 2 OR syn) THEN 'A' WHEN cls = 'monogenic' THEN 'C' WHEN cls = 'pharmacological' AND pos > 0 THEN 'B' WHEN cls = 'pharmacological' THEN 'E' WHEN cls = 'open_targets' THEN 'B' WHEN cls = 'human_association' THEN 'C' WHEN cls = 'animal' THEN 'D' WHEN cls = 'literature' THEN 'E' END AS grade FROM o)
SELECT perturbation_id, symptom, relation, grade, round(CASE WHEN cls = 'open_targets' THEN 0.45 WHEN grade = 'A' THEN CASE WHEN f IS NULL THEN 1.0 ELSE greatest(0.25, least(1.0, f * 4)) END WHEN grade = 'B' THEN 0.6 * CASE WHEN f IS NULL THEN 1.0 ELSE greatest(0.25, least(1.0, f * 10)) END WHEN grade = 'C' THEN 0 WHEN grade = 'D' THEN 0.2 ELSE 0.05 END, 6) AS weight FROM g""",
    "v_prefix_conflicts": "WITH p AS (SELECT split_part(drug_name, ' ', 1) v FROM drug_vocabulary), n AS (SELECT v, count(*) n FROM p GROUP BY 1) SELECT v, 'repeated' AS reason FROM n WHERE n > 1 UNION ALL SELECT DISTINCT a.v, 'contains another' FROM n a JOIN n b ON a.v <> b.v AND starts_with(a.v, b.v) UNION ALL SELECT v, 'empty' FROM n WHERE trim(v) = ''",
    "v_collapse": """WITH c AS (SELECT symptom, stitch_flat_id v, coalesce(chemical_match_method <> 'ctd_chemical_name', true) AS p FROM ctd_relations WHERE stitch_flat_id IS NOT NULL AND chemical_mesh_id IS NOT NULL),
q AS (SELECT symptom, arg_min(v, {'p': p, 'v': v}) AS chosen, list_sort(list(DISTINCT v)) AS a FROM c GROUP BY 1) SELECT symptom, chosen, array_to_string(list_filter(a, lambda x: x <> chosen), ';') AS others FROM q""",
    "v_both_keys": f"SELECT pair_id, {_k('left_target_id')} AS target FROM target_pairs WHERE {_k('left_target_id')} IS NOT NULL UNION SELECT pair_id, {_k('right_target_id')} FROM target_pairs WHERE {_k('right_target_id')} IS NOT NULL",
    "v_mechanisms": f"""WITH t AS (SELECT {_k('perturbation_id')} u, {_good('target_chembl_id')} x, action_type k FROM drug_targets), l AS (SELECT DISTINCT {_k('left_target_id')} x, {_k('right_target_id')} o FROM target_pairs WHERE left_target_id IS NOT NULL AND right_target_id IS NOT NULL),
a AS (SELECT u, x, list_sort(list(DISTINCT k)) own FROM t WHERE k IS NOT NULL GROUP BY 1, 2), b AS (SELECT t.u, l.x, list_sort(list(DISTINCT t.k)) inh FROM l JOIN t ON t.x = l.o WHERE t.k IS NOT NULL GROUP BY 1, 2),
p AS (SELECT DISTINCT u, x FROM (SELECT t.u, l.x FROM t JOIN l ON l.o = t.x UNION ALL SELECT u, x FROM t) WHERE u IS NOT NULL AND x IS NOT NULL)
SELECT u AS unit, x AS disease, CASE WHEN len(coalesce(own, inh)) = 1 THEN coalesce(own, inh)[1] END AS kind, CASE WHEN own IS NOT NULL THEN 'direct' WHEN inh IS NOT NULL THEN 'linked' ELSE 'none' END AS basis, coalesce(len(coalesce(own, inh)) > 1, false) AS conflict FROM p LEFT JOIN a USING (u, x) LEFT JOIN b USING (u, x)""",
    "v_first_unless_absent": "WITH a AS (SELECT perturbation_id, symptom, max(report_value) v FROM reports WHERE source = 'label-text' AND report_value IS NOT NULL GROUP BY 1, 2), b AS (SELECT perturbation_id, symptom, max(report_value) v FROM reports WHERE source = 'trial-arm' AND report_value IS NOT NULL GROUP BY 1, 2) SELECT perturbation_id, symptom, coalesce(a.v, b.v) AS v, coalesce(a.v <> b.v, false) AS disputed FROM a FULL JOIN b USING (perturbation_id, symptom)",
    "v_arms": "WITH e AS (SELECT l_suppkey, l_partkey, avg(l_extendedprice) FILTER (l_linestatus = 'O') t, avg(l_extendedprice) FILTER (l_linestatus = 'F') c FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, count(*) AS entries, count_if(t > c)::BIGINT AS above FROM e WHERE t IS NOT NULL AND c IS NOT NULL GROUP BY 1",
    "v_edge_evidence": f"""WITH {_P}, s AS (SELECT source, target, count(DISTINCT pair_id) n FROM p GROUP BY 1, 2), u AS (SELECT least(source, target) a, greatest(source, target) b, count(DISTINCT pair_id) n FROM p GROUP BY 1, 2), x AS (SELECT DISTINCT least(source, target) a, greatest(source, target) b FROM p WHERE score < 0.7), e AS (SELECT DISTINCT source, target, relation FROM p)
SELECT e.source, e.target, e.relation, coalesce(CASE WHEN e.relation = 'sequence' THEN u.n ELSE s.n END, 0) AS citations, x.a IS NOT NULL AS contested FROM e LEFT JOIN s ON s.source = e.source AND s.target = e.target LEFT JOIN u ON u.a = least(e.source, e.target) AND u.b = greatest(e.source, e.target) LEFT JOIN x ON x.a = least(e.source, e.target) AND x.b = greatest(e.source, e.target)""",
    "v_bulk_citations": """WITH e AS (SELECT DISTINCT report_ordinal, trim(unnest(string_split("references", ';'))) c FROM reports), f AS (SELECT * FROM e WHERE c <> ''), b AS (SELECT c FROM f GROUP BY 1 HAVING count(*) > 1), g AS (SELECT report_ordinal, count(*) a, count_if(c NOT IN (SELECT c FROM b)) k FROM f GROUP BY 1)
SELECT r.report_ordinal, coalesce(a, 0) AS "all", coalesce(k, 0)::BIGINT AS kept FROM reports r LEFT JOIN g USING (report_ordinal)""",
    "v_split_nodes": f"""WITH t AS (SELECT {_k('perturbation_id')} source, {_good('target_chembl_id')} target, coalesce(action_type, 'none') relation, drug_target_id FROM drug_targets), p AS (SELECT DISTINCT {_good('target_chembl_id')} node, unnest(accessions) part FROM drug_targets), q AS (SELECT * FROM p WHERE part IS NOT NULL AND node IS NOT NULL)
SELECT source, coalesce(part, target) AS target, relation, min(drug_target_id) AS drug_target_id FROM t LEFT JOIN q ON node = target WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2, 3""",
    "v_disjoint_parts": """WITH l AS (SELECT l_orderkey, l_linenumber o, l_suppkey node, arg_min({'s': s, 'm': m}, {'s': s, 'm': m}) x FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END::DOUBLE s, l_quantity m FROM lineitem) GROUP BY 1, 2, 3),
g AS (SELECT l_orderkey, node, min(o) AS part, sum(x.s * x.m) AS t, arg_min(x.s, o) AS f, count(DISTINCT o) AS n FROM l GROUP BY 1, 2) SELECT l_orderkey, node, part, CASE WHEN t = 0 THEN f ELSE sign(t)::DOUBLE END AS sign, round(abs(t), 4) AS magnitude, n > 1 AS shared FROM g""",
    "v_recurring_pairs": "SELECT a.l_suppkey AS substrate, b.l_suppkey AS product, count(DISTINCT a.l_orderkey) AS reactions FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey AND a.l_linestatus = 'O' AND b.l_linestatus <> 'O' GROUP BY 1, 2 HAVING count(DISTINCT a.l_orderkey) >= 3",
    "v_unanimous": f"SELECT {_k('perturbation_id')} AS p, min(action_type) AS action_type, string_agg(DISTINCT pref_name, ';' ORDER BY pref_name) AS pref_name FROM drug_targets WHERE action_type IS NOT NULL AND pref_name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT action_type) = 1",
    "v_apply_priors": """WITH r AS (SELECT perturbation_id, symptom, coalesce(max(report_value), 0) o, count(*)::DOUBLE w FROM reports GROUP BY 1, 2), p AS (SELECT symptom, round(avg((relation = 'induces')::INT), 6) q FROM ctd_relations GROUP BY 1), j AS (SELECT r.*, CASE WHEN p.symptom IS NULL THEN NULL WHEN w > 3 THEN 0.0 ELSE q END AS pr FROM r LEFT JOIN p USING (symptom))
SELECT perturbation_id, symptom, CASE WHEN o = 0 AND pr IS NOT NULL THEN pr ELSE o::DOUBLE END AS target, CASE WHEN o = 0 AND pr = 0 THEN greatest(w, 2.5) WHEN o = 0 AND pr IS NOT NULL THEN 2.5 ELSE w END AS weight FROM j""",
    "v_balanced": "WITH r AS (SELECT item_id, symptom, perturbation_type = 'drug' AS p FROM split_items), n AS (SELECT symptom, p, count(*) n FROM r GROUP BY 1, 2), m AS (SELECT p, avg(n) m FROM n GROUP BY 1) SELECT item_id, round(m / n, 6) AS weight FROM r JOIN n USING (symptom, p) JOIN m USING (p)",
    "v_correlations": "WITH v AS (SELECT label, unnest(embedding)::DOUBLE x, generate_subscripts(embedding, 1) d FROM embeddings), g AS (SELECT label, d, avg(x) x FROM v GROUP BY 1, 2) SELECT a.label::BIGINT AS a, b.label::BIGINT AS b, round(1 - corr(a.x, b.x), 5) AS distance FROM g a JOIN g b ON a.d = b.d AND a.label < b.label GROUP BY 1, 2",
    "v_best_phrase": r"""WITH t AS (SELECT DISTINCT child_name AS term, unnest(string_split(lower(trim(regexp_replace(child_name, '\s+', ' ', 'g'))), ' ')) s FROM ontology WHERE child_name IS NOT NULL), v AS (SELECT DISTINCT hpo_name, unnest(string_split(lower(trim(regexp_replace(hpo_name, '\s+', ' ', 'g'))), ' ')) s FROM fine_constructs WHERE hpo_name IS NOT NULL),
o AS (SELECT term, hpo_name, count(*) n FROM t JOIN v USING (s) GROUP BY 1, 2), b AS (SELECT *, max(n) OVER (PARTITION BY term) m FROM o), u AS (SELECT term, min(hpo_name) h FROM b WHERE n = m GROUP BY 1 HAVING count(*) = 1) SELECT DISTINCT t.term, coalesce(u.h, 'other') AS hpo_name FROM t LEFT JOIN u USING (term)""",
    "v_cards": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY symptom ORDER BY pubmed_reference_count DESC NULLS LAST, report_ordinal) k FROM reports WHERE report_value = 1) SELECT symptom, string_agg(coalesce(perturbation_id, '') || ' | ' || coalesce(source, '') || ' | ' || coalesce(pubmed_reference_count::VARCHAR, ''), chr(10) ORDER BY k) AS card FROM r WHERE k <= 5 GROUP BY 1",
}
