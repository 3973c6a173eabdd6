"""Matches over several routes, cascades, and aggregates of tests and arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.functions.ids import id_key, not_placeholder
from tarnwork.operators import matching as M
from tarnwork.plans.keys import good, key
from tarnwork.plans.scalar_queries import _t

_K = lambda c: id_key(not_placeholder(F.col(c)))


def _targets(spark, d):
    return _t(spark, d, "drug_targets").select("drug_target_id", id_key(F.col("perturbation_id")).alias("unit"), _K("target_chembl_id").alias("target"), "action_type", "gene_symbols", "target_type", "accessions", "pref_name").where("unit is not null and target is not null")


def _held(spark, d):
    return _t(spark, d, "held_out_additions").where("held_out").select(id_key(F.col("perturbation_id")).alias("unit")).distinct()


def m_gene_map(spark, d):
    t = _targets(spark, d)
    key_of = lambda c, where: t.where(where).select(c.alias("key"), F.col("target").alias("value"))
    gene, acc = F.try_element_at("gene_symbols", F.lit(1)), F.try_element_at("accessions", F.lit(1))
    nodes = t.where("action_type = 'SUBSTRATE' or action_type is null").select("drug_target_id", acc.alias("id"), gene.alias("symbol"))
    return M.mapped_genes(nodes, key_of(acc, "action_type = 'AGONIST'"), key_of(F.col("unit"), "action_type = 'INHIBITOR'"), key_of(gene, "target_type = 'SINGLE PROTEIN' and action_type = 'AGONIST'"), key_of(gene, "target_type = 'PROTEIN FAMILY'"), key_of(gene, "target_type = 'PROTEIN COMPLEX'")).select("drug_target_id", "gene", "gene_route")


def m_first_candidate(spark, d):
    t = _targets(spark, d)
    want = t.groupBy("target").agg(F.min(F.lower("pref_name")).alias("name")).select(F.col("target").alias("key"), "name")
    c = t.select(F.col("target").alias("key"), F.col("drug_target_id").alias("ordinal"), F.col("drug_target_id").alias("id"), F.col("target_type").alias("kind"), F.lower("pref_name").alias("name"), F.lower("action_type").alias("synonym"))
    return M.first_candidate(want, c, "SINGLE PROTEIN")


def m_parents(spark, d):
    b = _t(spark, d, "ingredient_bridge")
    first = b.where("chembl_parent is not null and bridge_method = 'unii'").groupBy(F.col("ingredient_id").alias("child")).agg(F.min("chembl_parent").alias("parent"))
    second = b.where("chembl_parent is not null and bridge_method = 'name'").groupBy(F.col("ingredient_id").alias("child")).agg(F.min("chembl_parent").alias("parent"))
    return M.parent_molecules(b.select(F.col("ingredient_id").alias("child")), first, second)


def m_mechanism_targets(spark, d):
    t = _targets(spark, d)
    mol = t.select("unit", F.col("unit").alias("molecule"))
    kinds = t.groupBy("target").agg(F.min("target_type").alias("organism"))
    return M.mechanism_targets(mol, t.select(F.col("unit").alias("molecule"), "target", F.col("action_type").alias("action"), F.col("drug_target_id").alias("ordinal")), kinds, "SINGLE PROTEIN")


def m_fallback(spark, d):
    t = _targets(spark, d)
    units = _t(spark, d, "split_items").select(id_key(F.col("perturbation_id")).alias("unit")).where("unit is not null")
    routes = [t.where("action_type = 'AGONIST'").select("unit", "target"), t.select("unit", "target"), _t(spark, d, "reports").where("source_record_id like 'OMIM:%'").select(id_key(F.col("perturbation_id")).alias("unit"), F.col("source_record_id").alias("target"))]
    return M.with_fallback(units, routes)


def m_only_target(spark, d):
    t = _targets(spark, d).withColumn("sign", F.when(F.col("action_type") == "AGONIST", 1).otherwise(-1))
    one = t.groupBy("unit").agg(F.count_distinct("target").alias("n"), F.max("sign").alias("s"), F.min("target").alias("x")).where("n = 1 and s = -1").agg(F.min("x")).scalar()
    return M.only_target(t.select("unit", "target", "sign"), one, -1)


def m_replaced_complexes(spark, d):
    t = _targets(spark, d)
    rows = t.select("unit", F.col("target").alias("row"), F.transform("gene_symbols", lambda g: id_key(not_placeholder(g))).alias("genes")).groupBy("unit", "row").agg(F.flatten(F.collect_list("genes")).alias("genes"))
    specific = t.where("target_type = 'SINGLE PROTEIN'").select("unit", F.explode("gene_symbols").alias("g")).select("unit", id_key(not_placeholder(F.col("g"))).alias("gene"))
    return M.replaced_complexes(rows, specific)


def m_rewritten(spark, d):
    r = _t(spark, d, "reports").where("perturbation_type = 'gene'").select("report_ordinal", F.col("perturbation_id").alias("gene"), F.col("source_record_id").alias("disease"))
    mech = _t(spark, d, "reports").where("association_type in ('MENDELIAN', 'POLYGENIC') and perturbation_id is not null").groupBy(F.col("perturbation_id").alias("gene"), F.col("source_record_id").alias("disease")).agg(F.min("association_type").alias("kind"))
    named = _t(spark, d, "held_out_additions").where("perturbation_type = 'gene'").groupBy(F.col("perturbation_id").alias("gene")).agg(F.min("label").alias("variant")).select("gene", F.lit("MENDELIAN").alias("kind"), F.concat(F.lit("v:"), "variant").alias("variant"))
    return M.rewritten_keys(r, mech, named).select("report_ordinal", "key")


def m_placements(spark, d):
    s = _t(spark, d, "split_items").select("item_id", id_key(F.col("perturbation_id")).alias("unit"), "symptom")
    rep = _t(spark, d, "reports").select(id_key(F.col("perturbation_id")).alias("unit"), "symptom", "report_value")
    rules = [("held out", _held(spark, d), ["unit"], True), ("reported", rep.where("report_value = 1"), ["unit", "symptom"], True), ("denied", rep.where("report_value = 0"), ["unit", "symptom"], True), ("without target", _targets(spark, d), ["unit"], False)]
    return M.placements(s, rules).select("item_id", "placement")


def m_definitions(spark, d):
    f = _t(spark, d, "fine_constructs").where("name is not null")
    r = _t(spark, d, "reports").where("source_term_id is not null").groupBy("symptom", "source_term_id").agg(F.count("*").alias("n"))
    eq = f.where("hpo_id <> ''").select(F.col("name").alias("definition"), F.col("hpo_id").alias("node"))
    by = f.join(r, f.coarse == r.symptom)
    return M.mapped_definition(f.select(F.col("name").alias("definition")), eq, by.where("n >= 8").select(F.col("name").alias("definition"), F.col("source_term_id").alias("node")), by.where("n >= 3").select(F.col("name").alias("definition"), F.col("source_term_id").alias("node")), 40)


def m_annotated(spark, d):
    t = _targets(spark, d)
    nodes = t.groupBy("target").agg(F.min(F.try_element_at("accessions", F.lit(1))).alias("id"), F.min("unit").alias("symbol")).withColumnRenamed("target", "node")
    ids = t.where("action_type = 'AGONIST'").select(F.explode("accessions").alias("id"), F.size("gene_symbols").cast("double").alias("level"))
    return M.annotated_levels(nodes, ids, t.select(F.col("unit").alias("symbol"), F.size("accessions").cast("double").alias("level")), 2.0)


def m_never_trained(spark, d):
    t, h = _targets(spark, d), _held(spark, d)
    return M.never_trained(t.join(h, "unit", "left_semi"), t.join(h, "unit", "left_anti"), "unit", "target")


def m_seen_share(spark, d):
    t, h = _targets(spark, d), _held(spark, d)
    return M.seen_share(t.join(h, "unit", "left_semi"), t.join(h, "unit", "left_anti"), "unit", "target").select("unit", F.round("share", 6).alias("share"))


def m_entry_parts(spark, d):
    t = _targets(spark, d).select("target", "unit", "action_type", "pref_name")
    return M.grouped_entries(t.where("action_type is not null"), "target", "unit", "action_type", "unit")


def m_resolved_symbols(spark, d):
    t = _targets(spark, d)
    e = t.where("target_type = 'SINGLE PROTEIN'").select(F.try_element_at("gene_symbols", F.lit(1)).alias("symbol"), F.try_element_at("accessions", F.lit(1)).alias("entry")).where("entry is not null")
    p = t.where("target_type = 'PROTEIN FAMILY'").select(F.explode("gene_symbols").alias("symbol"), F.col("target").alias("entry"))
    return M.resolved_symbols(t.select(F.explode("gene_symbols").alias("symbol")), e, p)


def m_source_label(spark, d):
    r = _t(spark, d, "reports").where("perturbation_id is not null").withColumn("source", F.lower("source"))
    return M.common_prefix_label(r, "perturbation_id", "source", "label", "labels")


def m_directed_records(spark, d):
    r = _t(spark, d, "reports")
    return M.directed_records(r, ["perturbation_id", "symptom"], F.col("report_value") == 1, (F.col("report_value") == 0) | (F.col("frequency") == 0), "evidence_class")


def m_popularity(spark, d):
    r = _t(spark, d, "reports")
    return M.popularity(r, r.where("evidence_class = 'pharmacological'"), "perturbation_id", "references")


def m_tests(spark, d):
    p = _t(spark, d, "target_pairs").select("matched_on", _K("left_target_id").alias("unit"), (1 - F.col("score")).alias("p"), _K("right_target_id").alias("term"), F.col("pair_id").alias("n"))
    return M.collected_tests(p.where("unit is not null"), ["unit", "matched_on"], "p", "term", "n", 0.2)


def m_tested_reports(spark, d):
    r = _t(spark, d, "reports").where("perturbation_id is not null and symptom is not null")
    pos = r.where("report_value = 1").select("perturbation_id", "symptom")
    every = r.select("perturbation_id", "evidence_class").distinct().join(r.select("evidence_class", "symptom").distinct(), "evidence_class")
    return M.tested_reports(pos, every, ["perturbation_id", "symptom"], ["perturbation_id"])


def m_arms(spark, d):
    c = _t(spark, d, "ctd_relations")
    a = M.classified_arms(c.select("relation_id", "drug_name", F.split_part(F.lower("chemical_name"), F.lit(" "), F.lit(1)).alias("w")), "drug_name", F.col("w"), ["tablet", "capsule"], "drug")
    return a.select("relation_id", "arm")


def m_species(spark, d):
    t = _targets(spark, d)
    s = t.select(F.explode("accessions").alias("id"), "target_type").where("id is not null").groupBy("id").agg(F.min("target_type").alias("species"))
    return M.species_counts(t.where("action_type <> 'AGONIST'"), "drug_target_id", "accessions", s, "SINGLE PROTEIN")


def m_typed_weights(spark, d):
    t = _targets(spark, d)
    nodes = t.groupBy(F.col("target").alias("node")).agg(F.min("target_type").alias("type"))
    w = t.where("action_type is not null").groupBy(F.col("target").alias("node"), F.col("action_type").alias("class")).agg(F.avg(F.size("accessions")).alias("weight"))
    return M.typed_weights(nodes, {"SINGLE PROTEIN": w, "PROTEIN FAMILY": w.withColumn("weight", F.col("weight") / 2)}, t.select(F.col("action_type").alias("class")).where("class is not null")).select("node", "class", F.round("weight", 6).alias("weight"))


def m_strongest(spark, d):
    p = _t(spark, d, "target_pairs").select(_K("left_target_id").alias("unit"), (1 - F.col("score")).alias("p"), "pair_id")
    return M.strongest_rows(p.where("unit is not null"), ["unit"], "p", ["pair_id"]).select("unit", "pair_id", F.round("p", 6).alias("p"))


def m_gain_only(spark, d):
    r = _t(spark, d, "reports").where("association_type is not null and association_type <> '' and perturbation_id is not null").withColumn("causal", F.col("rubric_causal_association") == 1)
    return M.gain_only(r, "perturbation_id", "association_type", "causal", "MENDELIAN")


def m_combined(spark, d):
    s = _t(spark, d, "split_items").select("perturbation_id", "symptom", "evidence_class", "perturbation_type")
    h = _t(spark, d, "held_out_additions").select("perturbation_id", "perturbation_type")
    return M.combined_evidence(s, h, ["perturbation_id", "perturbation_type"], {"symptom": "none", "evidence_class": "combination"})


def m_holdout_modules(spark, d):
    t = _targets(spark, d)
    pos = _t(spark, d, "reports").where("report_value = 1").groupBy(id_key(F.col("perturbation_id")).alias("unit")).agg(F.count("*").alias("n"))
    return M.holdout_modules(t.select("unit", F.col("target").alias("node")), t.where("action_type is not null").select(F.col("action_type").alias("module"), F.col("target").alias("node")).distinct(), pos, 50)


def m_lockbox(spark, d):
    s = _t(spark, d, "split_items").select(id_key(F.col("perturbation_id")).alias("unit"), "perturbation_type").where("unit is not null").groupBy("unit").agg(F.min("perturbation_type").alias("kind"))
    u = s.withColumn("grp", F.substring("unit", 1, 4))
    return M.lockbox(u, u.where("grp < 'D'"), "unit", "grp")


def m_masked(spark, d):
    return M.masked_by_grade(_t(spark, d, "reports").where("perturbation_id is not null"), ["perturbation_id", "symptom"], "evidence_code", ["IEA", "TAS", "other"])


def m_selected(spark, d):
    r = _t(spark, d, "reports").where("perturbation_id is not null")
    a = r.where("frequency is not null").groupBy("perturbation_id", "symptom").agg(F.count("*").alias("entries"), F.count_if(F.col("frequency") > 0.2).alias("above"))
    return M.selected_pairs(r, ["perturbation_id", "symptom"], "report_value", a, False)


def m_sufficiency(spark, d):
    r = _t(spark, d, "reports").where("perturbation_id is not null").groupBy("perturbation_id", "symptom").agg(F.sum("frequency").alias("v"))
    return M.sufficiency(r, "perturbation_id", "symptom", "v").select("symptom", "units", F.round("mean", 6).alias("mean"))


_T = f"t AS (SELECT * FROM (SELECT drug_target_id, {key('perturbation_id')} AS unit, {good('target_chembl_id')} AS target, action_type, gene_symbols, target_type, accessions, pref_name FROM drug_targets) WHERE unit IS NOT NULL AND target IS NOT NULL)"
_H = f"h AS (SELECT DISTINCT {key('perturbation_id')} AS unit FROM held_out_additions WHERE held_out)"

SQL = {
    "m_gene_map": f"WITH {_T}, a AS (SELECT accessions[1] k, min(target) v FROM t WHERE action_type = 'AGONIST' GROUP BY 1), b AS (SELECT unit k, min(target) v FROM t WHERE action_type = 'INHIBITOR' GROUP BY 1), c AS (SELECT gene_symbols[1] k, min(target) v FROM t WHERE target_type = 'SINGLE PROTEIN' AND action_type = 'AGONIST' GROUP BY 1), p AS (SELECT gene_symbols[1] k, min(target) v FROM t WHERE target_type = 'PROTEIN FAMILY' GROUP BY 1 HAVING min(target) = max(target)), l AS (SELECT gene_symbols[1] k, min(target) v FROM t WHERE target_type = 'PROTEIN COMPLEX' GROUP BY 1 HAVING min(target) = max(target)) SELECT drug_target_id, coalesce(a.v, b.v, c.v, p.v, l.v) AS gene, CASE WHEN a.v IS NOT NULL THEN 'id' WHEN b.v IS NOT NULL THEN 'symbol' WHEN c.v IS NOT NULL THEN 'current' WHEN p.v IS NOT NULL THEN 'previous' WHEN l.v IS NOT NULL THEN 'alias' ELSE 'none' END AS gene_route FROM t LEFT JOIN a ON a.k = accessions[1] LEFT JOIN b ON b.k = gene_symbols[1] LEFT JOIN c ON c.k = gene_symbols[1] LEFT JOIN p ON p.k = gene_symbols[1] LEFT JOIN l ON l.k = gene_symbols[1] WHERE action_type = 'SUBSTRATE' OR action_type IS NULL",
    "m_first_candidate": f"WITH {_T}, w AS (SELECT target, min(lower(pref_name)) n FROM t GROUP BY 1), c AS (SELECT target, drug_target_id i, CASE WHEN lower(pref_name) = n THEN 0 WHEN lower(action_type) = n THEN 1 END r FROM t JOIN w USING (target) WHERE target_type = 'SINGLE PROTEIN') SELECT target AS key, arg_min(i, {{'r': r, 'i': i}}) AS id FROM c WHERE r IS NOT NULL GROUP BY 1",
    "m_parents": "SELECT ingredient_id AS child, coalesce(min(chembl_parent) FILTER (bridge_method = 'unii'), min(chembl_parent) FILTER (bridge_method = 'name'), ingredient_id) AS parent FROM ingredient_bridge WHERE ingredient_id IS NOT NULL GROUP BY 1",
    "m_mechanism_targets": f"WITH {_T}, k AS (SELECT target, min(target_type) o FROM t GROUP BY 1) SELECT unit, target, arg_max(action_type, drug_target_id) FILTER (action_type IS NOT NULL OR true) AS action FROM (SELECT unit, target, first(action_type ORDER BY drug_target_id DESC) AS action_type, max(drug_target_id) AS drug_target_id FROM t GROUP BY 1, 2) JOIN k USING (target) WHERE coalesce(o = 'SINGLE PROTEIN', true) GROUP BY 1, 2",
    "m_fallback": f"WITH {_T}, u AS (SELECT DISTINCT {key('perturbation_id')} AS unit FROM split_items WHERE {key('perturbation_id')} IS NOT NULL), r AS (SELECT DISTINCT unit, target, 1 AS route FROM t WHERE action_type = 'AGONIST' UNION SELECT unit, target, 2 FROM t UNION SELECT {key('perturbation_id')}, source_record_id, 3 FROM reports WHERE source_record_id LIKE 'OMIM:%'), b AS (SELECT unit, min(route) AS route FROM r GROUP BY 1) SELECT u.unit, r.target, coalesce(b.route, 0) AS route FROM u LEFT JOIN b USING (unit) LEFT JOIN r ON r.unit = u.unit AND r.route = b.route",
    "m_only_target": f"WITH {_T}, n AS (SELECT unit, min(target) x FROM t GROUP BY 1 HAVING count(DISTINCT target) = 1 AND bool_and(action_type IS DISTINCT FROM 'AGONIST')), g AS (SELECT unit, min(target) a, max(target) b, bool_and(action_type IS DISTINCT FROM 'AGONIST') s FROM t GROUP BY 1) SELECT unit FROM g WHERE a = b AND a = (SELECT min(x) FROM n) AND s",
    "m_replaced_complexes": f"WITH {_T}, e AS (SELECT DISTINCT unit, target, {good('s')} g FROM (SELECT unit, target, unnest(gene_symbols) s FROM t)), x AS (SELECT * FROM e WHERE g IS NOT NULL), p AS (SELECT DISTINCT unit, {good('s')} g FROM (SELECT unit, unnest(gene_symbols) s FROM t WHERE target_type = 'SINGLE PROTEIN')), j AS (SELECT x.unit, x.target, x.g, p.g AS named, count(*) OVER (PARTITION BY x.unit, x.target) n, count(p.g) OVER (PARTITION BY x.unit, x.target) k FROM x LEFT JOIN p ON p.unit = x.unit AND p.g = x.g), b AS (SELECT unit, g AS gene, CASE WHEN n = 1 THEN 'single' WHEN k >= 2 THEN CASE WHEN named IS NOT NULL THEN 'specific' END ELSE 'complex' END AS basis FROM j) SELECT unit, gene, min(basis) AS basis FROM b WHERE basis IS NOT NULL GROUP BY 1, 2",
    "m_rewritten": "WITH m AS (SELECT perturbation_id g, source_record_id s, min(association_type) k FROM reports WHERE association_type IN ('MENDELIAN', 'POLYGENIC') AND perturbation_id IS NOT NULL GROUP BY 1, 2), v AS (SELECT perturbation_id g, 'v:' || min(label) v FROM held_out_additions WHERE perturbation_type = 'gene' GROUP BY 1) SELECT report_ordinal, coalesce(CASE WHEN k = 'MENDELIAN' THEN v END, perturbation_id || '|' || k, perturbation_id) AS key FROM reports LEFT JOIN m ON g = perturbation_id AND s = source_record_id LEFT JOIN v ON v.g = perturbation_id WHERE perturbation_type = 'gene'",
    "m_placements": f"WITH {_T}, {_H}, r AS (SELECT {key('perturbation_id')} u, symptom, report_value v FROM reports), s AS (SELECT item_id, {key('perturbation_id')} u, symptom FROM split_items) SELECT item_id, CASE WHEN u IN (SELECT unit FROM h WHERE unit IS NOT NULL) THEN 'held out' WHEN EXISTS (SELECT 1 FROM r WHERE r.u = s.u AND r.symptom = s.symptom AND v = 1) THEN 'reported' WHEN EXISTS (SELECT 1 FROM r WHERE r.u = s.u AND r.symptom = s.symptom AND v = 0) THEN 'denied' WHEN u IS NULL OR u NOT IN (SELECT unit FROM t) THEN 'without target' ELSE 'unplaced' END AS placement FROM s",
    "m_definitions": "WITH f AS (SELECT * FROM fine_constructs WHERE name IS NOT NULL), r AS (SELECT symptom, source_term_id t, count(*) n FROM reports WHERE source_term_id IS NOT NULL GROUP BY 1, 2), x AS (SELECT name, hpo_id AS node, 1 AS route FROM f WHERE hpo_id <> '' UNION SELECT name, t, 2 FROM f JOIN r ON symptom = coarse WHERE n >= 8 UNION SELECT name, t, 3 FROM f JOIN r ON symptom = coarse WHERE n >= 3), b AS (SELECT name, min(route) AS route FROM x GROUP BY 1), k AS (SELECT x.*, count(*) OVER (PARTITION BY name) c FROM x JOIN b USING (name, route)) SELECT name AS definition, node, route FROM k WHERE c <= 40",
    "m_annotated": f"WITH {_T}, n AS (SELECT target AS node, min(accessions[1]) AS id, min(unit) AS symbol FROM t GROUP BY 1), a AS (SELECT i, max(len(g))::DOUBLE l FROM (SELECT unnest(accessions) i, gene_symbols g FROM t WHERE action_type = 'AGONIST') GROUP BY 1), b AS (SELECT unit s, max(len(accessions))::DOUBLE l FROM t GROUP BY 1) SELECT node, coalesce(a.l, b.l) AS level, coalesce(a.l, b.l) IS NOT NULL AS known, coalesce(coalesce(a.l, b.l) >= 2, false) AS expressed FROM n LEFT JOIN a ON a.i = n.id LEFT JOIN b ON b.s = n.symbol",
    "m_never_trained": f"WITH {_T}, {_H}, s AS (SELECT DISTINCT target FROM t WHERE unit NOT IN (SELECT unit FROM h)), x AS (SELECT DISTINCT unit, target FROM t WHERE unit IN (SELECT unit FROM h)) SELECT unit, count(*) AS values, count(*) FILTER (target NOT IN (SELECT target FROM s)) AS unseen FROM x GROUP BY 1",
    "m_seen_share": f"WITH {_T}, {_H}, s AS (SELECT DISTINCT target FROM t WHERE unit NOT IN (SELECT unit FROM h)), x AS (SELECT DISTINCT unit, target FROM t WHERE unit IN (SELECT unit FROM h)) SELECT unit, round(1 - count(*) FILTER (target NOT IN (SELECT target FROM s)) / count(*), 6) AS share FROM x GROUP BY 1",
    "m_entry_parts": f"WITH {_T}, s AS (SELECT target, unit, list_sort(list(DISTINCT action_type)) r FROM t WHERE action_type IS NOT NULL GROUP BY 1, 2), p AS (SELECT target, r, min(unit) p FROM s GROUP BY 1, 2), k AS (SELECT target, count(*) k, min(p) f FROM p GROUP BY 1) SELECT s.target, s.unit, CASE WHEN k < 2 THEN f ELSE p END AS part FROM s JOIN p USING (target, r) JOIN k USING (target)",
    "m_resolved_symbols": f"WITH {_T}, e AS (SELECT gene_symbols[1] s, accessions[1] a FROM t WHERE target_type = 'SINGLE PROTEIN' AND accessions[1] IS NOT NULL), q AS (SELECT s, min(a) d FROM e WHERE s IS NOT NULL GROUP BY 1), o AS (SELECT DISTINCT a FROM e), p AS (SELECT s, min(target) p FROM (SELECT unnest(gene_symbols) s, target FROM t WHERE target_type = 'PROTEIN FAMILY') WHERE s IS NOT NULL GROUP BY 1 HAVING min(target) = max(target)), y AS (SELECT DISTINCT s FROM (SELECT unnest(gene_symbols) s FROM t) WHERE s IS NOT NULL) SELECT y.s AS symbol, coalesce(d, o.a, p) AS entry, CASE WHEN d IS NOT NULL THEN 'direct' WHEN o.a IS NOT NULL THEN 'accession' WHEN p IS NOT NULL THEN 'previous' ELSE 'none' END AS route FROM y LEFT JOIN q ON q.s = y.s LEFT JOIN o ON o.a = y.s LEFT JOIN p ON p.s = y.s",
    "m_source_label": "SELECT perturbation_id, CASE WHEN bool_and(lower(source) LIKE 'label%') THEN 'labels' ELSE array_to_string(list_sort(list(DISTINCT lower(source))), ';') END AS label FROM reports WHERE perturbation_id IS NOT NULL AND source IS NOT NULL GROUP BY 1",
    "m_directed_records": "WITH x AS (SELECT perturbation_id, symptom, evidence_class, 'present' AS direction FROM reports WHERE report_value = 1 UNION ALL SELECT perturbation_id, symptom, evidence_class, 'absent' FROM reports WHERE report_value = 0 OR frequency = 0) SELECT perturbation_id, symptom, direction, evidence_class, count(*) AS records FROM x GROUP BY ALL",
    "m_popularity": """SELECT perturbation_id, count(DISTINCT "references") FILTER (evidence_class = 'pharmacological' AND "references" <> '') AS papers FROM reports WHERE perturbation_id IS NOT NULL GROUP BY 1""",
    "m_tests": f"WITH p AS (SELECT {good('left_target_id')} AS unit, matched_on, 1 - score AS p, {good('right_target_id')} AS term, pair_id n FROM target_pairs) SELECT unit, matched_on, count(*) AS tests, min(p) AS least_p, max(n) AS most, coalesce(array_to_string(list_sort(list(DISTINCT term) FILTER (p < 0.2 AND term IS NOT NULL)), '|'), '') AS significant FROM p WHERE unit IS NOT NULL GROUP BY 1, 2",
    "m_tested_reports": "WITH r AS (SELECT * FROM reports WHERE perturbation_id IS NOT NULL AND symptom IS NOT NULL), y AS (SELECT DISTINCT perturbation_id, symptom FROM r WHERE report_value = 1), e AS (SELECT DISTINCT a.perturbation_id, b.symptom FROM (SELECT DISTINCT perturbation_id, evidence_class FROM r) a JOIN (SELECT DISTINCT evidence_class, symptom FROM r) b USING (evidence_class)) SELECT *, 1 AS report_value FROM y UNION ALL SELECT *, 0 FROM (SELECT * FROM e EXCEPT SELECT * FROM y)",
    "m_arms": r"WITH c AS (SELECT relation_id, ' ' || regexp_replace(lower(coalesce(drug_name, '')), '[^a-z0-9]', ' ', 'g') || ' ' AS t, lower(coalesce(drug_name, '')) AS n, split_part(lower(chemical_name), ' ', 1) w FROM ctd_relations) SELECT relation_id, CASE WHEN (contains(t, ' tablet ') AND w <> 'tablet') OR (contains(t, ' capsule ') AND w <> 'capsule') THEN 'excluded' WHEN contains(t, ' drug ') THEN 'control' WHEN w IS NOT NULL AND trim(w) <> '' AND regexp_matches(n, '(^|[^a-z0-9])' || regexp_escape(w) || '($|[^a-z0-9])') THEN 'drug' ELSE 'other' END AS arm FROM c",
    "m_species": f"WITH {_T}, s AS (SELECT i, min(target_type) sp FROM (SELECT unnest(accessions) i, target_type FROM t) WHERE i IS NOT NULL GROUP BY 1), e AS (SELECT drug_target_id, unnest(list_distinct(accessions)) i FROM t WHERE action_type <> 'AGONIST'), n AS (SELECT drug_target_id, count(sp) k, count(*) FILTER (sp = 'SINGLE PROTEIN') h FROM e LEFT JOIN s USING (i) GROUP BY 1) SELECT t.drug_target_id, coalesce(k, 0) AS known, coalesce(h, 0) AS human FROM t LEFT JOIN n USING (drug_target_id) WHERE action_type <> 'AGONIST'",
    "m_typed_weights": f"WITH {_T}, n AS (SELECT target AS node, min(target_type) AS type FROM t GROUP BY 1), w AS (SELECT target AS node, action_type AS class, avg(coalesce(len(accessions), -1)) FILTER (accessions IS NOT NULL) w FROM t WHERE action_type IS NOT NULL GROUP BY 1, 2), c AS (SELECT DISTINCT action_type AS class FROM t WHERE action_type IS NOT NULL) SELECT n.node, c.class, round(coalesce(CASE type WHEN 'SINGLE PROTEIN' THEN w WHEN 'PROTEIN FAMILY' THEN w / 2 END, 1.0), 6) AS weight FROM n, c LEFT JOIN w ON w.node = n.node AND w.class = c.class",
    "m_strongest": f"WITH p AS (SELECT {good('left_target_id')} AS unit, 1 - score AS p, pair_id FROM target_pairs), r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY p NULLS LAST, pair_id) k FROM p WHERE unit IS NOT NULL) SELECT unit, pair_id, round(p, 6) AS p FROM r WHERE k = 1",
    "m_gain_only": "SELECT perturbation_id FROM reports WHERE association_type IS NOT NULL AND association_type <> '' AND perturbation_id IS NOT NULL AND rubric_causal_association = 1 GROUP BY 1 HAVING bool_and(association_type = 'MENDELIAN')",
    "m_combined": "SELECT perturbation_id, symptom, evidence_class, perturbation_type FROM split_items UNION ALL SELECT perturbation_id, 'none', 'combination', perturbation_type FROM held_out_additions",
    "m_holdout_modules": f"WITH {_T}, m AS (SELECT DISTINCT action_type AS module, target FROM t WHERE action_type IS NOT NULL), a AS (SELECT DISTINCT m.module, t.unit FROM t JOIN m USING (target)), p AS (SELECT {key('perturbation_id')} AS unit, count(*) n FROM reports WHERE report_value = 1 GROUP BY 1), k AS (SELECT module FROM a LEFT JOIN p USING (unit) GROUP BY 1 HAVING sum(coalesce(n, 0)) >= 50) SELECT module, unit FROM a WHERE module IN (SELECT module FROM k)",
    "m_lockbox": f"SELECT DISTINCT {key('perturbation_id')} AS unit, substr({key('perturbation_id')}, 1, 4) AS grp FROM split_items WHERE substr({key('perturbation_id')}, 1, 4) < 'D'",
    "m_masked": "SELECT perturbation_id, symptom FROM reports WHERE perturbation_id IS NOT NULL GROUP BY 1, 2 HAVING bool_and(coalesce(evidence_code IN ('IEA', 'TAS', 'other'), false))",
    "m_selected": "WITH p AS (SELECT perturbation_id, symptom, max(report_value) y, count(frequency) e, count(*) FILTER (frequency > 0.2) a FROM reports WHERE perturbation_id IS NOT NULL GROUP BY 1, 2) SELECT perturbation_id, symptom, CASE WHEN y = 1 AND e > 0 AND a = 0 THEN 'set aside' WHEN y = 1 THEN 'kept' WHEN y = 0 THEN 'negative' ELSE 'set aside' END AS use, CASE WHEN y = 1 AND e > 0 AND a = 0 THEN 'never above control' WHEN y = 1 THEN 'reported' WHEN y = 0 THEN 'reported absent' ELSE 'no value' END AS reason FROM p",
    "m_sufficiency": "WITH r AS (SELECT perturbation_id, symptom, sum(frequency) v FROM reports WHERE perturbation_id IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY perturbation_id ORDER BY v DESC, symptom) i FROM r WHERE v IS NOT NULL) SELECT symptom, count(*) AS units, round(avg(v), 6) AS mean FROM k WHERE i = 1 GROUP BY 1",
}

QUERIES = {n: globals()[n] for n in SQL}
