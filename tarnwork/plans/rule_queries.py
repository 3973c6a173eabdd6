"""Decision rules, scalar parsers and counting filters over the evidence tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.functions import rules as U
from tarnwork.functions import scalars as S
from tarnwork.functions import stats as ST
from tarnwork.functions.ids import id_key, not_placeholder
from tarnwork.operators import filters as L
from tarnwork.operators import evidence as E
from tarnwork.operators.joins import counted_drops
from tarnwork.plans.keys import good, key
from tarnwork.plans.scalar_queries import _t

#: Relation types of the relation table and what they state.
RELATIONS = {"marker/mechanism": ("induces", 1), "therapeutic": ("relieves", 1)}
#: Actions that raise and that lower a target's activity.
RAISING, LOWERING = ["AGONIST", "ACTIVATOR", "OPENER", "POSITIVE ALLOSTERIC MODULATOR"], ["ANTAGONIST", "INHIBITOR", "BLOCKER", "NEGATIVE ALLOSTERIC MODULATOR"]
#: Design of a study by evidence code, and its weight.
KINDS = {"PCS": "Cohort Study", "TAS": "Review", "IEA": "Case Reports", "frequency": "Clinical Trial"}
DESIGNS = {"trial": 1.0, "cohort": 0.8, "review": 0.4, "case_report": 0.3, "animal": 0.25, "other": 0.2}


def s_relation_type(spark, d):
    c = _t(spark, d, "ctd_relations")
    m = U.mapped_relation(F.col("direct_evidence"), F.col("mesh_descriptor_level"), RELATIONS, ["symptom", "mixed"])
    return c.select("relation_id", m["relation"].alias("mapped"), m["value"].alias("value"))


def s_demoted(spark, d):
    rel, flag = U.demoted(F.col("relation"), F.col("mesh_descriptor_level"))
    return _t(spark, d, "ctd_relations").select("relation_id", rel.alias("relation"), flag.alias("demoted"))


def s_association_type(spark, d):
    r = _t(spark, d, "reports").where("association_type is not null and association_type <> '' and perturbation_id is not null")
    by = lambda p, n: r.where(F.col("source_record_id").startswith(p)).groupBy("perturbation_id").agg(F.max_by("association_type", "report_ordinal").alias(n))
    pairs = _t(spark, d, "reports").select("perturbation_id", "source_record_id").where("perturbation_id is not null and source_record_id is not null").distinct()
    j = pairs.join(by("ORPHA:", "a"), "perturbation_id", "left").join(by("OMIM:", "b"), "perturbation_id", "left")
    t = U.association(F.col("source_record_id"), F.col("a"), F.col("b"), ["MENDELIAN"], ["POLYGENIC"])
    return j.select("perturbation_id", "source_record_id", t["type"].alias("type"), t["causal"].alias("causal"))


def s_study_design(spark, d):
    r = _t(spark, d, "reports")
    kinds = F.array(S.lookup(F.col("evidence_code"), KINDS))
    animal = F.coalesce(F.col("model_description").contains("mouse"), F.lit(False))
    design = U.study_design(kinds, F.coalesce(F.col("model_description").contains("human"), F.lit(False)), animal)
    w = U.metadata_weight(design, DESIGNS, F.col("source_record_label") == "synopsis entry", 0.5)
    return r.select("report_ordinal", design.alias("design"), F.round(w, 6).alias("weight"), *U.indicator_columns(F.col("evidence_code"), ["PCS", "TAS", "IEA"], "code"))


def s_interaction_sign(spark, d):
    a = F.upper("action_type")
    s = U.flag_sign(a.isin(RAISING), a.isin(LOWERING))
    return _t(spark, d, "drug_targets").select("drug_target_id", s["relation"].alias("relation"), s["sign"].alias("sign"), U.action_sign(F.col("action_type"), RAISING, LOWERING).alias("action_sign"))


def s_symbols(spark, d):
    t = _t(spark, d, "drug_targets")
    n = F.concat(F.lit("gene:"), F.coalesce(F.try_element_at(F.filter("accessions", lambda x: x.isNotNull()), F.lit(1)), F.lit("none")), F.lit("|"), "target_chembl_id")
    return t.select("drug_target_id", S.node_symbol(n).alias("symbol"), S.without_suffix(F.concat(F.lower("action_type"), F.lit("_c"))).alias("bare"), S.bounded_count(F.size("gene_symbols"), 3).alias("few"))


def s_driving_force(spark, d):
    p = _t(spark, d, "target_pairs").select("pair_id", (F.col("score") * F.when(F.col("pair_id") % 3 == 0, -1).otherwise(1)).alias("w")).where("w is not null")
    total = p.agg(F.sum(F.abs("w"))).scalar()
    return p.select("pair_id", F.round(F.col("w") / total, 9).alias("share"))


def s_concentration(spark, d):
    c = S.calibrated_concentration(F.col("score") * 10, 4.0, 9.0, -0.8, 5.5)
    return _t(spark, d, "target_pairs").select("pair_id", F.round(c, 6).alias("micromolar"), F.round(S.pseudo_count(F.col("score"), 50.0), 6).alias("odds"))


def s_entities(spark, d):
    c = _t(spark, d, "ctd_relations").select("relation_id", F.concat(F.lit("Disease|MESH:"), "disease_mesh_id", F.lit("; "), "chemical_mesh_id").alias("e"))
    e = S.entity(F.col("e"))
    return c.select("relation_id", e["kind"].alias("kind"), F.array_join(e["ids"], ",").alias("ids"))


def s_words(spark, d):
    c = _t(spark, d, "ctd_relations")
    name = F.split_part(F.lower("disease_name"), F.lit(" "), F.lit(2))
    return c.select(
        "relation_id", S.stem(name).alias("stem"), S.names_word(F.col("disease_name"), F.split_part("symptom", F.lit("_"), F.lit(1))).alias("named"),
        F.array_join(S.spellings(F.col("disease_name")), "|").alias("spellings"))


def s_citations(spark, d):
    r = _t(spark, d, "annotations").select("annotation_id", F.regexp_replace("references", "[^A-Za-z0-9:]+", ";").alias("c")).where("c is not null")
    c = S.citations(F.col("c"), ["OMIM", "ORPHA"])
    return r.select("annotation_id", F.size(c["kept"]).alias("kept"), F.size(c["excluded"]).alias("excluded"))


def s_codes(spark, d):
    v = _t(spark, d, "drug_vocabulary")
    return v.select("drug_id", S.starts_with_any(F.col("other_codes"), ["N", "G", "OS"]).alias("admitted"))


def s_availability(spark, d):
    """Of dated provenance: the earliest of curation and publication, the latter made up from the first PMID."""
    pm = F.regexp_extract("references", r"PMID:(\d+)", 1).try_cast("bigint")
    dated = F.col("disease_id").startswith("OMIM:")
    published = F.when(dated & pm.isNotNull(), F.array(F.make_date((2000 + pm % 20).cast("int"), (1 + pm % 12).cast("int"), F.lit(1))))
    when = S.availability(F.when(dated, S.bracketed_dates(F.col("biocuration"))), published)
    return _t(spark, d, "annotations").select("annotation_id", when["date"].cast("string").alias("available"), when["source"].alias("date_source"))


def s_grade_weights(spark, d):
    """Weights of grades by class, frequency and statement type."""
    kind = F.element_at(F.array(*[F.lit(k) for k in (*U.STATEMENT_WEIGHTS, "unheard")]), (1 + F.col("report_ordinal") % 7).cast("int"))
    grade = F.element_at(F.array(*[F.lit(g) for g in "ABCDE"]), (1 + F.col("report_ordinal") % 5).cast("int"))
    w = U.grade_weight(grade, F.col("evidence_class"), F.col("frequency"), F.when(F.col("report_ordinal") % 3 > 0, F.lower(kind)))
    return _t(spark, d, "reports").select("report_ordinal", F.round(w, 6).alias("weight"))


def s_gene_rule(spark, d):
    p = _t(spark, d, "target_pairs").where("score is not null")
    names = F.array(*[F.lit(n) for n in ("a", "b", "c")])
    levels = F.array("score", (F.col("pair_id") % 10) / 10.0, F.lit(0.5))
    rule = F.when(F.col("pair_id") % 2 == 0, "a or (b and c)").otherwise("(a and b) or (x and c)")
    return p.select("pair_id", F.round(U.gene_rule(rule, names, levels), 6).alias("value"))


def f_weighting_rows(spark, d):
    r = _t(spark, d, "reports")
    zero = (F.col("frequency") == 0) & F.col("frequency_denominator").isNotNull() & (F.col("evidence_class") == "monogenic")
    return r.where((F.col("report_value") == 1) | zero).groupBy("evidence_class", "symptom").agg(F.count("*").alias("n"), F.count_if(F.col("report_value") == 1).alias("positive"))


def f_arm_reports(spark, d):
    """Rows of the trial source pass only with a frequency above the margin and a denominator; the rest pass through."""
    r = _t(spark, d, "reports").withColumn("src", F.lower(id_key(F.col("source"))))
    trial = F.col("src") == "trialarm"
    _, counts = counted_drops(r, [("no denominator", trial & F.col("frequency_denominator").isNull()), ("no frequency", trial & F.col("frequency").isNull()), ("within margin", trial & (F.col("frequency") < 0.05))])
    return counts


def f_human_worded(spark, d):
    r = _t(spark, d, "reports").where("perturbation_id is not null")
    return L.every_group(r, ["perturbation_id", "symptom"], {"animal": F.col("model_description").contains("mouse"), "unnamed": F.coalesce(F.col("model_description"), F.lit("")) == ""})


def _edges(spark, d):
    p = _t(spark, d, "target_pairs")
    k = lambda c: id_key(not_placeholder(F.col(c)))
    return p.select("pair_id", k("left_target_id").alias("source"), k("right_target_id").alias("target"), F.coalesce("matched_on", F.lit("none")).alias("relation"), "score").where("source is not null and target is not null")


def f_admitted_pairs(spark, d):
    e = _edges(spark, d)
    t = _t(spark, d, "drug_targets").select(id_key(not_placeholder(F.col("target_chembl_id"))).alias("source"), "action_type")
    back = e.where("relation = 'name'").select("source", "target")
    return L.admitted_pairs(e, t.where("action_type = 'AGONIST'"), back, F.col("score") > 0.8).select("pair_id")


def f_known_absent(spark, d):
    t = _t(spark, d, "drug_targets").groupBy(id_key(not_placeholder(F.col("target_chembl_id"))).alias("node")).agg((F.max(F.size("accessions")) > 1).alias("expressed")).where("node is not null")
    return L.without_known_absent(_edges(spark, d), t, F.col("relation") == "sequence")[1]


def f_without_nodes(spark, d):
    e = _edges(spark, d)
    n = e.select(F.col("source").alias("node")).union(e.select("target")).distinct()
    return L.without_nodes(n, e, F.col("node").endswith("7"), "relation", ["acc"])[2]


def f_prefix_list(spark, d):
    """The codes' leading letters, none of which begins another."""
    v = _t(spark, d, "drug_vocabulary").select(F.substring("drug_name", 1, 4).alias("prefix")).where("prefix is not null").distinct()
    return L.prefix_conflict_free(v, "prefix")


def f_explicit_cells(spark, d):
    r = _t(spark, d, "reports").where("perturbation_id is not null")
    cells = r.select("perturbation_id", "symptom", "source").where("report_value is not null").distinct().withColumn("explicit", F.lit(True))
    every = r.select("perturbation_id", "source").distinct().join(r.select("perturbation_id", "symptom").distinct(), "perturbation_id")
    return every.join(cells, ["perturbation_id", "symptom", "source"], "left").groupBy("perturbation_id").agg(F.count("*").alias("cells"), F.count("explicit").alias("explicit"))


def v_overridden(spark, d):
    k = ["perturbation_id", "symptom"]
    r = _t(spark, d, "reports").where("perturbation_id is not null and relation is not null")
    base = r.groupBy(*k).agg(F.min("relation").alias("relation"))
    change = r.where("report_value = 0").groupBy(*k).agg(F.max("relation").alias("relation"))
    return E.overridden(base, change, k, "relation").select(*k, "relation", "basis")


def v_lower_to_preferred(spark, d):
    c = _t(spark, d, "fine_constructs").select(F.col("coarse").alias("concept"), F.when(F.col("is_namesake"), "PT").otherwise("LLT").alias("level"), "name")
    return E.lower_to_preferred(c)


def v_expression_minimum(spark, d):
    t = _t(spark, d, "drug_targets").where("target_chembl_id is not null")
    members = t.select(F.col("target_chembl_id").alias("complex"), F.explode("gene_symbols").alias("member")).distinct()
    levels = t.select(F.explode("gene_symbols").alias("member"), F.col("target_type").alias("sample"), F.size("accessions").alias("n")).groupBy("member", "sample").agg(F.sum("n").cast("double").alias("level"))
    return E.expression_minimum(members, levels)


def v_relative_levels(spark, d):
    p = _t(spark, d, "part").groupBy("p_brand", "p_size").agg(F.max("p_retailprice").alias("level"))
    return E.relative_levels(p, "p_brand", "level", 5.0).select("p_brand", "p_size", F.round("level", 9).alias("level"))


def t_deviation(spark, d):
    return _t(spark, d, "target_pairs").groupBy("matched_on").agg(F.avg("score").alias("m"), F.count("score").alias("n"), F.stddev_samp("score").alias("sd")).select(
        "matched_on", F.round(ST.deviation(F.lit("standard error"), F.col("sd") / F.sqrt("n"), F.lit(0.0), F.lit(0.0), F.col("n")), 9).alias("sd"))


_E = f"e AS (SELECT * FROM (SELECT pair_id, {good('left_target_id')} AS source, {good('right_target_id')} AS target, coalesce(matched_on, 'none') AS relation, score FROM target_pairs) WHERE source IS NOT NULL AND target IS NOT NULL)"
_UP = "('AGONIST','ACTIVATOR','OPENER','POSITIVE ALLOSTERIC MODULATOR')"
_DOWN = "('ANTAGONIST','INHIBITOR','BLOCKER','NEGATIVE ALLOSTERIC MODULATOR')"

SQL = {
    "s_relation_type": "SELECT relation_id, CASE WHEN mesh_descriptor_level IN ('symptom', 'mixed') THEN CASE direct_evidence WHEN 'marker/mechanism' THEN 'induces' WHEN 'therapeutic' THEN 'relieves' END END AS mapped, CASE WHEN mesh_descriptor_level IN ('symptom', 'mixed') AND direct_evidence IN ('marker/mechanism', 'therapeutic') THEN 1 END AS value FROM ctd_relations",
    "s_demoted": "SELECT relation_id, CASE WHEN mesh_descriptor_level = 'mixed' AND relation IN ('induces', 'relieves') THEN 'associated_with' ELSE relation END AS relation, coalesce(mesh_descriptor_level = 'mixed' AND relation IN ('induces', 'relieves'), false) AS demoted FROM ctd_relations",
    "s_association_type": """WITH r AS (SELECT * FROM reports WHERE association_type IS NOT NULL AND association_type <> '' AND perturbation_id IS NOT NULL),
a AS (SELECT perturbation_id, arg_max(association_type, report_ordinal) a FROM r WHERE source_record_id LIKE 'ORPHA:%' GROUP BY 1), b AS (SELECT perturbation_id, arg_max(association_type, report_ordinal) b FROM r WHERE source_record_id LIKE 'OMIM:%' GROUP BY 1),
p AS (SELECT DISTINCT perturbation_id, source_record_id FROM reports WHERE perturbation_id IS NOT NULL AND source_record_id IS NOT NULL),
j AS (SELECT perturbation_id, source_record_id, CASE WHEN source_record_id LIKE 'ORPHA:%' THEN coalesce(a, b) ELSE b END AS type FROM p LEFT JOIN a USING (perturbation_id) LEFT JOIN b USING (perturbation_id))
SELECT *, CASE type WHEN 'MENDELIAN' THEN true WHEN 'POLYGENIC' THEN false END AS causal FROM j""",
    "s_study_design": """WITH k AS (SELECT report_ordinal, evidence_code c, source_record_label l, coalesce(contains(model_description, 'mouse'), false) a, coalesce(contains(model_description, 'human'), false) h FROM reports),
g AS (SELECT *, CASE WHEN c = 'TAS' THEN 'review' WHEN a AND NOT h THEN 'animal' WHEN c = 'frequency' THEN 'trial' WHEN c = 'PCS' THEN 'cohort' WHEN c = 'IEA' THEN 'case_report' ELSE 'other' END AS design FROM k)
SELECT report_ordinal, design, round(greatest(0.05, least(1.0, CASE design WHEN 'trial' THEN 1.0 WHEN 'cohort' THEN 0.8 WHEN 'review' THEN 0.4 WHEN 'case_report' THEN 0.3 WHEN 'animal' THEN 0.25 ELSE 0.2 END * CASE WHEN l = 'synopsis entry' THEN 0.5 ELSE 1.0 END))::DOUBLE, 6) AS weight,
coalesce((c = 'PCS')::INT::DOUBLE, 0.0) AS "code_PCS", coalesce((c = 'TAS')::INT::DOUBLE, 0.0) AS "code_TAS", coalesce((c = 'IEA')::INT::DOUBLE, 0.0) AS "code_IEA" FROM g""",
    "s_interaction_sign": f"WITH x AS (SELECT drug_target_id, coalesce(upper(action_type) IN {_UP}, false) u, coalesce(upper(action_type) IN {_DOWN}, false) w FROM drug_targets) SELECT drug_target_id, CASE WHEN u OR w THEN 'regulates' ELSE 'binds' END AS relation, CASE WHEN u THEN 1 WHEN w THEN -1 ELSE 0 END AS sign, CASE WHEN u THEN 1 WHEN w THEN -1 END AS action_sign FROM x",
    "s_symbols": "SELECT drug_target_id, CASE WHEN target_chembl_id IS NOT NULL THEN coalesce(list_filter(accessions, lambda x: x IS NOT NULL)[1], 'none') END AS symbol, lower(action_type) AS bare, coalesce(len(gene_symbols) BETWEEN 1 AND 3, false) AS few FROM drug_targets",
    "s_driving_force": "WITH p AS (SELECT pair_id, score * CASE WHEN pair_id % 3 = 0 THEN -1 ELSE 1 END w FROM target_pairs WHERE score IS NOT NULL) SELECT pair_id, round(w / (SELECT sum(abs(w)) FROM p), 9) AS share FROM p",
    "s_concentration": "SELECT pair_id, round(pow(10.0, 5.5 - 0.8 * greatest(4.0, least(9.0, score * 10))), 6) AS micromolar, round(CASE WHEN score >= 1 THEN 50.0 ELSE least(50.0, score / (1 - score)) END, 6) AS odds FROM target_pairs",
    "s_entities": "SELECT relation_id, CASE WHEN disease_mesh_id || chemical_mesh_id IS NOT NULL THEN 'Disease' END AS kind, trim(disease_mesh_id) || ',' || trim(chemical_mesh_id) AS ids FROM ctd_relations",
    "s_words": r"""WITH w AS (SELECT relation_id, disease_name, split_part(lower(disease_name), ' ', 2) w, split_part(symptom, '_', 1) f, lower(trim(regexp_replace(disease_name, '\s+', ' ', 'g'))) low FROM ctd_relations)
SELECT relation_id, CASE WHEN length(w) < 5 THEN w ELSE regexp_replace(regexp_replace(w, '(ies)$', 'y'), '([a-z]{3})(ings?|ed|ness|ity|al|es|s)$', '\1') END AS stem, contains(' ' || regexp_replace(lower(disease_name), '[^a-z0-9]', ' ', 'g') || ' ', ' ' || lower(f) || ' ') AS named,
array_to_string(list_transform(list_filter([{'i': 1, 'v': low}, {'i': 2, 'v': replace(low, ' ', '')}, {'i': 3, 'v': regexp_replace(low, '[^a-z0-9]', '', 'g')}], lambda x: x.i = 1 OR (x.i = 2 AND x.v <> low) OR (x.i = 3 AND x.v <> low AND x.v <> replace(low, ' ', ''))), lambda x: x.v), '|') AS spellings FROM w""",
    "s_citations": """WITH r AS (SELECT annotation_id, list_filter(string_split(regexp_replace("references", '[^A-Za-z0-9:]+', ';', 'g'), ';'), lambda x: x <> '') c FROM annotations WHERE "references" IS NOT NULL)
SELECT annotation_id, len(list_distinct(list_transform(list_filter(c, lambda x: split_part(x, ':', 1) NOT IN ('OMIM', 'ORPHA')), lambda x: split_part(x, ':', -1))))::INT AS kept, len(list_distinct(list_transform(list_filter(c, lambda x: split_part(x, ':', 1) IN ('OMIM', 'ORPHA')), lambda x: split_part(x, ':', -1))))::INT AS excluded FROM r""",
    "s_codes": "SELECT drug_id, coalesce(len(list_filter(other_codes, lambda x: x LIKE 'N%' OR x LIKE 'G%' OR x LIKE 'OS%')) > 0, false) AS admitted FROM drug_vocabulary",
    "s_availability": r"""WITH x AS (SELECT annotation_id, disease_id LIKE 'OMIM:%' AS o, list_min(list_filter(list_transform(regexp_extract_all(biocuration, '\[(\d{4}-\d{2}-\d{2})\]', 1), lambda s: try_cast(s AS DATE)), lambda s: s IS NOT NULL)) AS m, try_cast(nullif(regexp_extract("references", 'PMID:(\d+)', 1), '') AS BIGINT) p FROM annotations),
y AS (SELECT annotation_id, CASE WHEN o THEN m END AS m, CASE WHEN o AND p IS NOT NULL THEN make_date(2000 + p % 20, 1 + p % 12, 1) END AS q FROM x)
SELECT annotation_id, (CASE WHEN q IS NOT NULL AND (m IS NULL OR q <= m) THEN q ELSE m END)::VARCHAR AS available, CASE WHEN q IS NOT NULL AND (m IS NULL OR q <= m) THEN 'publication' WHEN m IS NOT NULL THEN 'biocuration' END AS date_source FROM y""",
    "s_grade_weights": """WITH r AS (SELECT report_ordinal, evidence_class c, frequency f, ['A', 'B', 'C', 'D', 'E'][1 + report_ordinal % 5] g, CASE WHEN report_ordinal % 3 > 0 THEN [0.10, 0.08, 0.08, 0.08, 0.05, 0.02, 0.02][1 + report_ordinal % 7] END s FROM reports)
SELECT report_ordinal, round((CASE WHEN c = 'open_targets' THEN 0.45 WHEN g = 'A' AND c = 'monogenic' THEN CASE WHEN f IS NULL THEN 1.0 ELSE greatest(0.25, least(1.0, f * 4)) END WHEN g = 'B' THEN CASE WHEN f IS NULL THEN 0.6 ELSE 0.6 * greatest(0.25, least(1.0, f * 10)) END WHEN g = 'E' AND s IS NOT NULL THEN s ELSE CASE g WHEN 'A' THEN 1.0 WHEN 'C' THEN 0.0 WHEN 'D' THEN 0.2 ELSE 0.05 END END)::DOUBLE, 6) AS weight FROM r""",
    "s_gene_rule": "SELECT pair_id, round(CASE WHEN pair_id % 2 = 0 THEN greatest(score, least((pair_id % 10) / 10.0, 0.5)) ELSE greatest(least(score, (pair_id % 10) / 10.0), 0.5) END, 6) AS value FROM target_pairs WHERE score IS NOT NULL",
    "f_weighting_rows": "SELECT evidence_class, symptom, count(*) AS n, count(*) FILTER (report_value = 1) AS positive FROM reports WHERE report_value = 1 OR (frequency = 0 AND frequency_denominator IS NOT NULL AND evidence_class = 'monogenic') GROUP BY 1, 2",
    "f_arm_reports": "WITH r AS (SELECT *, regexp_replace(lower(source), '[^a-z0-9]', '', 'g') = 'trialarm' AS t FROM reports), x AS (SELECT CASE WHEN t AND frequency_denominator IS NULL THEN 'no denominator' WHEN t AND frequency IS NULL THEN 'no frequency' WHEN t AND frequency < 0.05 THEN 'within margin' END AS reason FROM r) SELECT reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY 1",
    "f_human_worded": "SELECT perturbation_id, symptom, count(*) AS rows FROM reports WHERE perturbation_id IS NOT NULL GROUP BY 1, 2 HAVING NOT bool_and(coalesce(contains(model_description, 'mouse'), false)) AND NOT bool_and(coalesce(model_description, '') = '')",
    "f_admitted_pairs": f"WITH {_E}, c AS (SELECT DISTINCT {good('target_chembl_id')} s FROM drug_targets WHERE action_type = 'AGONIST'), a AS (SELECT DISTINCT source, target FROM e WHERE relation = 'name') SELECT pair_id FROM e WHERE NOT (coalesce(score > 0.8, false) AND source IN (SELECT s FROM c WHERE s IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM a WHERE a.source = e.source AND a.target = e.target))",
    "f_known_absent": f"WITH {_E}, t AS (SELECT {good('target_chembl_id')} n, max(len(accessions)) > 1 AS x FROM drug_targets GROUP BY 1) SELECT CASE WHEN relation <> 'sequence' THEN 'other relation' WHEN x IS NULL THEN 'unknown' WHEN x THEN 'expressed' ELSE 'dropped' END AS state, count(*) AS n FROM e LEFT JOIN t ON t.n = e.source GROUP BY 1",
    "f_without_nodes": f"WITH {_E} SELECT relation, count(*) AS edges FROM e WHERE source NOT LIKE '%7' AND target NOT LIKE '%7' AND relation NOT LIKE 'acc%' GROUP BY 1",
    "f_prefix_list": "SELECT DISTINCT trim(substr(drug_name, 1, 4)) AS prefix FROM drug_vocabulary WHERE drug_name IS NOT NULL",
    "f_explicit_cells": "WITH r AS (SELECT * FROM reports WHERE perturbation_id IS NOT NULL), c AS (SELECT DISTINCT perturbation_id, symptom, source FROM r WHERE report_value IS NOT NULL), s AS (SELECT DISTINCT perturbation_id, source FROM r), y AS (SELECT DISTINCT perturbation_id, symptom FROM r) SELECT s.perturbation_id, count(*) AS cells, count(c.source) AS explicit FROM s JOIN y USING (perturbation_id) LEFT JOIN c ON c.perturbation_id = s.perturbation_id AND c.symptom = y.symptom AND c.source = s.source GROUP BY 1",
    "v_overridden": "WITH r AS (SELECT * FROM reports WHERE perturbation_id IS NOT NULL AND relation IS NOT NULL), b AS (SELECT perturbation_id, symptom, min(relation) o FROM r GROUP BY 1, 2), c AS (SELECT perturbation_id, symptom, max(relation) n FROM r WHERE report_value = 0 GROUP BY 1, 2) SELECT perturbation_id, symptom, coalesce(n, o) AS relation, CASE WHEN n IS NOT NULL THEN 'overrides ' || o ELSE '' END AS basis FROM b LEFT JOIN c USING (perturbation_id, symptom)",
    "v_lower_to_preferred": "SELECT DISTINCT l.name AS lower, p.name AS preferred FROM fine_constructs l JOIN fine_constructs p USING (coarse) WHERE NOT l.is_namesake AND p.is_namesake",
    "v_expression_minimum": "WITH m AS (SELECT DISTINCT target_chembl_id c, unnest(gene_symbols) g FROM drug_targets WHERE target_chembl_id IS NOT NULL), x AS (SELECT unnest(gene_symbols) g, target_type s, len(accessions) n FROM drug_targets WHERE target_chembl_id IS NOT NULL), l AS (SELECT g, s, sum(n)::DOUBLE v FROM x GROUP BY 1, 2) SELECT c AS complex, s AS sample, min(v) AS level FROM m JOIN l USING (g) WHERE v IS NOT NULL GROUP BY 1, 2",
    "v_relative_levels": "WITH p AS (SELECT p_brand, p_size, max(p_retailprice) v FROM part GROUP BY 1, 2) SELECT p_brand, p_size, round(v / (max(v) OVER (PARTITION BY p_brand) + 5.0), 9) AS level FROM p",
    "t_deviation": "SELECT matched_on, round(stddev_samp(score), 9) AS sd FROM target_pairs GROUP BY 1",
}

QUERIES = {n: globals()[n] for n in SQL}
