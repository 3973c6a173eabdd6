"""Report builders over the evidence tables, and what they leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.functions import scalars as S
from tarnwork.functions.ids import hpo_id, id_key, not_placeholder
from tarnwork.operators import reports as B
from tarnwork.plans.graph_queries import _hp
from tarnwork.plans.keys import good, key
from tarnwork.plans.scalar_queries import SQL as SCALARS
from tarnwork.plans.scalar_queries import _t

FREQUENCIES = SCALARS["s_frequency"]


def _annotated(spark, d):
    r = _t(spark, d, "reports").where("perturbation_type = 'gene'")
    triples = r.select(F.col("perturbation_id").alias("gene"), F.col("source_record_id").alias("disease"), hpo_id(F.col("source_term_id")).alias("term"))
    a = _t(spark, d, "annotations").select("disease_id", hpo_id(F.col("term_id")).alias("term"), F.col("annotation_id").alias("ordinal"), (F.col("qualifier") == "NOT").alias("negated"), F.round(S.parse_frequency(F.col("frequency")), 6).alias("share"))
    terms = r.select("symptom", hpo_id(F.col("source_term_id")).alias("term")).where("term is not null and symptom is not null")
    genes = _t(spark, d, "split_items").select(F.col("perturbation_id").alias("gene")).where("gene is not null")
    return B.annotation_reports(triples, a.withColumnRenamed("disease_id", "disease"), terms, genes, F.col("disease").startswith("OMIM:"))


def b_annotation_reports(spark, d):
    return _annotated(spark, d)[0]


def b_annotation_aside(spark, d):
    return _annotated(spark, d)[1]


def b_annotation_records(spark, d):
    return B.annotation_records(_annotated(spark, d)[0])


def _arms(spark, d):
    r = _t(spark, d, "reports").where("perturbation_type = 'drug' and perturbation_id is not null")
    event = F.concat_ws("|", "perturbation_id", "symptom")
    return r.select(event.alias("event"), "perturbation_id", "symptom", F.when(F.col("frequency").isNotNull(), F.col("report_ordinal")).alias("ordinal"), F.col("placebo_flag").alias("placebo"), F.col("frequency").alias("share"))


def b_arm_reports(spark, d):
    a = _arms(spark, d)
    return B.arm_reports(a, a.where("ordinal is not null"))


def b_treatment_shares(spark, d):
    return B.treatment_shares(_arms(spark, d), ["perturbation_id", "symptom"]).withColumn("share", F.round("share", 6))


def _units(spark, d):
    n = _t(spark, d, "drug_targets").groupBy(id_key(F.col("perturbation_id")).alias("unit")).agg(F.count_distinct("target_chembl_id").alias("targets"), F.count_if(F.col("action_type") == "AGONIST").alias("agonist")).where("unit is not null")
    return B.qualified(n, [("no target", F.col("targets") == 0), ("too many targets", F.col("targets") > 12), ("no agonist", F.col("agonist") == 0)])


def b_qualified(spark, d):
    return _units(spark, d).select("unit", "qualifies", "reason")


def _statements(spark, d):
    r = _t(spark, d, "reports").where("perturbation_type = 'drug'").select("report_ordinal", id_key(F.col("perturbation_id")).alias("unit"), (F.col("placebo_flag")).alias("combined"), F.col("frequency").alias("score"))
    return B.statement_reports(r, _units(spark, d), "score")


def b_statement_reports(spark, d):
    return _statements(spark, d)[0].select("report_ordinal", F.round("scaled", 6).alias("scaled"))


def b_statement_drops(spark, d):
    return _statements(spark, d)[1]


def b_relation_reports(spark, d):
    r = _t(spark, d, "ctd_relations").select("relation_id", "pmid", "disease_mesh_id", "symptom")
    dates = _t(spark, d, "reports").where("evidence_date is not null and evidence_date <> ''").select(F.regexp_extract("references", r"PMID:(\d+)", 1).alias("citation"), "evidence_date").where("citation <> ''").groupBy("citation").agg(F.min("evidence_date").alias("date"))
    o = B.ordinal_within(r.where("pmid is not null and disease_mesh_id is not null and symptom is not null"), ["pmid", "disease_mesh_id", "symptom"], "relation_id", "report_id")
    return B.dated(o, dates, "pmid").select("relation_id", "report_id", "date")


def _expanded(spark, d):
    c = _t(spark, d, "ctd_relations").select("relation_id", F.concat_ws("|", "direct_evidence", "relation").alias("evidence"), F.concat_ws("|", "pmid", "chemical_mesh_id").alias("citations"), F.col("disease_name").alias("entered"))
    m = _t(spark, d, "fine_constructs").where("not is_namesake").select(F.initcap(F.regexp_replace("coarse", "_", " ")).alias("entered"), F.col("name").alias("match"))
    return B.expanded_rows(c.where("evidence <> ''"), "evidence", "citations", m, "entered")


def b_expanded(spark, d):
    return _expanded(spark, d)[0].select("relation_id", "evidence", "citations", "match")


def b_expanded_drops(spark, d):
    return _expanded(spark, d)[1]


def _tables(spark, d):
    r = _t(spark, d, "reports").select(id_key(F.col("perturbation_id")).alias("unit"), "symptom", "source_term_id", "relation", "report_value")
    counts = r.where("unit is not null").groupBy("unit", F.col("source_term_id").alias("reaction")).agg(F.count("*").alias("n"), F.count_if(F.col("report_value") == 1).alias("a"))
    terms = r.where("source_term_id is not null").groupBy(F.col("source_term_id").alias("reaction")).agg(F.min("symptom").alias("symptom"))
    v = F.when(F.col("a") * 2 > F.col("n"), 1).when(F.col("a") == 0, 0)
    return B.table_reports(counts, terms, B.indicated_pairs(r), v)


def b_table_reports(spark, d):
    return _tables(spark, d)[0].select("unit", "reaction", "symptom", "report_value")


def b_table_drops(spark, d):
    return _tables(spark, d)[1]


def _exposed(spark, d):
    o = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("m"))
    return B.exposure_reports(o, F.col("m") > 260000, F.col("n"), 110)


def b_exposure_reports(spark, d):
    return _exposed(spark, d)[0].select("c_nationkey", "c_mktsegment", "report_value")


def b_exposure_drops(spark, d):
    return _exposed(spark, d)[1]


def b_largest_arms(spark, d):
    r = _t(spark, d, "reports").where("perturbation_id is not null").select("perturbation_id", "symptom", "placebo_flag", "frequency_denominator", "report_ordinal")
    return B.largest_arms(r, ["perturbation_id", "symptom"], "placebo_flag", "frequency_denominator", "report_ordinal")


def b_matched_rules(spark, d):
    t = _t(spark, d, "drug_targets").select("drug_target_id", "pref_name")
    return B.matched_rules(t, "pref_name", [("mood|sleep", "mind"), ("receptor", "receptor"), ("^[a-m]", "early")], "scale").select("drug_target_id", "scale")


def b_first_analysis(spark, d):
    p = _t(spark, d, "target_pairs").where("score is not null and matched_on is not null").select(id_key(not_placeholder(F.col("left_target_id"))).alias("unit"), "pair_id", F.col("score").alias("effect"), (F.col("score") - 0.1).alias("low"), (F.col("score") + 0.2).alias("high"), "matched_on")
    a = B.first_analysis(p.where("unit is not null"), ["unit"], F.col("matched_on") != "name", "pair_id")
    return a.select("unit", *[F.round(c, 6).alias(c) for c in ("effect", "low", "high")])


def b_supporting(spark, d):
    r = _t(spark, d, "reports").select("perturbation_id", "symptom", "report_value")
    s = _t(spark, d, "split_items").select("item_id", "perturbation_id", "symptom")
    return B.supporting_reports(s, ["perturbation_id", "symptom"], r.where("report_value = 1"), r.where("report_value = 0")).select("item_id")


def b_placement_records(spark, d):
    c = _t(spark, d, "ctd_relations")
    return B.placement_records(c, ["disease_mesh_id", "symptom"], "relation_id", "mesh_descriptor_level", "pmid")


def _signs(spark, d):
    p = _t(spark, d, "target_pairs").select(id_key(not_placeholder(F.col("left_target_id"))).alias("source"), F.coalesce("matched_on", F.lit("none")).alias("relation"), F.when(F.col("pair_id") % 3 == 0, -1).otherwise(1).alias("sign"), "pair_id").where("source is not null")
    return p, B.sign_decisions(p, ["source"], "sign", "relation")


def b_sign_decisions(spark, d):
    return _signs(spark, d)[1]


def b_sign_support(spark, d):
    p, first = _signs(spark, d)
    second = B.sign_decisions(p, ["source"], "sign", "pair_id")
    s = B.sign_support(p, first.where("positive <> negative"), second, ["source"])
    return s.select("pair_id", "support", "basis", B.is_evidenced(F.col("relation") != "name", F.col("support"), 2).alias("evidenced"))


def b_assigned_terms(spark, d):
    o = _t(spark, d, "ontology").select(hpo_id(F.col("child")).alias("term"), F.trim("child_name").alias("name")).where("term is not null and name is not null").groupBy("term").agg(F.min("name").alias("name"))
    f = _t(spark, d, "fine_constructs")
    over = f.select(hpo_id(F.col("hpo_id")).alias("term"), F.col("name").alias("construct")).where("term is not null and construct is not null")
    ph = f.select(F.regexp_replace("coarse", "_", " ").alias("phrase"), F.col("coarse").alias("construct")).union(_t(spark, d, "fine_constructs").select(F.split_part("coarse", F.lit("_"), F.lit(1)), "coarse")).where("phrase is not null").distinct()
    return B.assigned_terms(o, over, ph, "other")


_AN = f"""q AS ({FREQUENCIES}), r AS (SELECT perturbation_id g, source_record_id s, {_hp('source_term_id')} t, symptom FROM reports WHERE perturbation_type = 'gene'),
f AS (SELECT disease_id s, {_hp('term_id')} t, annotation_id o, qualifier = 'NOT' AS n, q.share FROM annotations JOIN q USING (annotation_id)),
x AS (SELECT DISTINCT g, s, t FROM r WHERE g IS NOT NULL AND t IS NOT NULL AND g IN (SELECT perturbation_id FROM split_items)), y AS (SELECT DISTINCT symptom, t FROM r WHERE t IS NOT NULL AND symptom IS NOT NULL), j AS (SELECT * FROM x JOIN y USING (t))"""
_AR = "a AS (SELECT perturbation_id || '|' || symptom AS event, perturbation_id, symptom, CASE WHEN frequency IS NOT NULL THEN report_ordinal END AS ordinal, coalesce(placebo_flag, false) AS p, frequency AS share FROM reports WHERE perturbation_type = 'drug' AND perturbation_id IS NOT NULL)"
_U = f"n AS (SELECT {key('perturbation_id')} AS unit, count(DISTINCT target_chembl_id) k, count(*) FILTER (action_type = 'AGONIST') g FROM drug_targets GROUP BY 1), u AS (SELECT unit, CASE WHEN k = 0 THEN 'no target' WHEN k > 12 THEN 'too many targets' WHEN g = 0 THEN 'no agonist' END AS why FROM n WHERE unit IS NOT NULL)"
_ST = f"{_U}, s AS (SELECT report_ordinal, frequency f, CASE WHEN u.unit IS NULL THEN 'unknown unit' WHEN why IS NOT NULL THEN why WHEN coalesce(placebo_flag, false) THEN 'combination only' END AS reason FROM reports LEFT JOIN u ON u.unit = {key('perturbation_id')} WHERE perturbation_type = 'drug' AND {key('perturbation_id')} IS NOT NULL)"
_EX = "c AS (SELECT relation_id, concat_ws('|', direct_evidence, relation) e, list_filter(string_split(concat_ws('|', pmid, chemical_mesh_id), '|'), lambda x: x <> '') q, disease_name n FROM ctd_relations WHERE concat_ws('|', direct_evidence, relation) <> ''), m AS (SELECT DISTINCT replace(coarse, '_', ' ') n, name FROM fine_constructs WHERE NOT is_namesake)"
_TB = f"r AS (SELECT {key('perturbation_id')} AS unit, symptom, source_term_id, relation, report_value FROM reports), c AS (SELECT unit, source_term_id AS reaction, count(*) n, count(*) FILTER (report_value = 1) a FROM r WHERE unit IS NOT NULL GROUP BY 1, 2), t AS (SELECT source_term_id AS reaction, min(symptom) AS symptom FROM r WHERE source_term_id IS NOT NULL GROUP BY 1), i AS (SELECT DISTINCT unit, symptom FROM r WHERE relation = 'relieves' AND report_value = 1 AND unit IS NOT NULL), j AS (SELECT c.unit, c.reaction, t.symptom, CASE WHEN a * 2 > n THEN 1 WHEN a = 0 THEN 0 END AS report_value FROM c LEFT JOIN t USING (reaction)), x AS (SELECT *, CASE WHEN symptom IS NULL THEN 'unmapped' WHEN EXISTS (SELECT 1 FROM i WHERE i.unit = j.unit AND i.symptom = j.symptom) THEN 'indicated' WHEN report_value IS NULL THEN 'neither' END AS reason FROM j)"
_XP = "x AS (SELECT c_nationkey, c_mktsegment, count(*) n, avg(o_totalprice) m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), v AS (SELECT *, CASE WHEN m > 260000 THEN 1 WHEN n >= 110 THEN 0 END AS report_value FROM x)"
_SG = f"p AS (SELECT * FROM (SELECT {good('left_target_id')} AS source, coalesce(matched_on, 'none') AS relation, CASE WHEN pair_id % 3 = 0 THEN -1 ELSE 1 END AS sign, pair_id FROM target_pairs) WHERE source IS NOT NULL), f AS (SELECT source, count(DISTINCT relation) FILTER (sign > 0) AS positive, count(DISTINCT relation) FILTER (sign < 0) AS negative FROM p GROUP BY 1)"

_AV = f"{_AN}, v AS (SELECT g AS gene, symptom, j.s AS disease, j.t AS term, coalesce(o, -1) AS ordinal, CASE WHEN coalesce(n, false) OR share = 0 THEN 0 ELSE 1 END AS report_value, share AS sh, CASE WHEN o IS NULL THEN 'unjoined' ELSE 'annotated' END AS basis FROM j LEFT JOIN f ON f.s = j.s AND f.t = j.t WHERE j.s LIKE 'OMIM:%')"

SQL = {
    "b_annotation_reports": f"WITH {_AV} SELECT gene, symptom, disease, term, ordinal, report_value, CASE WHEN report_value = 1 THEN sh ELSE 0.0 END AS share, basis FROM v",
    "b_annotation_records": f"WITH {_AV} SELECT gene, symptom, count(DISTINCT disease) AS diseases, count(*) AS rows, max(sh) AS largest FROM v WHERE report_value = 1 GROUP BY 1, 2",
    "b_annotation_aside": f"WITH {_AN} SELECT s AS disease, count(*) AS n FROM j WHERE s IS NULL OR s NOT LIKE 'OMIM:%' GROUP BY 1",
    "b_arm_reports": f"WITH {_AR}, c AS (SELECT event, bool_or(p) c FROM a WHERE ordinal IS NOT NULL GROUP BY 1), e AS (SELECT DISTINCT event FROM a) SELECT e.event, coalesce(t.ordinal, -1) AS ordinal, t.share, CASE WHEN t.ordinal IS NULL THEN 'label_text' WHEN c THEN 'placebo_controlled_frequency' ELSE 'frequency' END AS evidence_code FROM e LEFT JOIN c ON c.event = e.event LEFT JOIN (SELECT * FROM a WHERE NOT p AND ordinal IS NOT NULL) t ON t.event = e.event",
    "b_treatment_shares": f"WITH {_AR} SELECT perturbation_id, symptom, round(avg(share), 6) AS share FROM a WHERE NOT p AND share IS NOT NULL GROUP BY 1, 2",
    "b_qualified": f"WITH {_U} SELECT unit, why IS NULL AS qualifies, coalesce(why, '') AS reason FROM u",
    "b_statement_reports": f"WITH {_ST} SELECT report_ordinal, round((f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ()), 6) AS scaled FROM s WHERE reason IS NULL",
    "b_statement_drops": f"WITH {_ST} SELECT reason, count(*) AS n FROM s WHERE reason IS NOT NULL GROUP BY 1",
    "b_relation_reports": r"""WITH d AS (SELECT regexp_extract("references", 'PMID:(\d+)', 1) c, min(evidence_date) AS date FROM reports WHERE evidence_date IS NOT NULL AND evidence_date <> '' GROUP BY 1) SELECT relation_id, concat_ws('|', pmid, disease_mesh_id, symptom, row_number() OVER (PARTITION BY pmid, disease_mesh_id, symptom ORDER BY relation_id)) AS report_id, date FROM ctd_relations LEFT JOIN d ON d.c = pmid AND d.c <> '' WHERE pmid IS NOT NULL AND disease_mesh_id IS NOT NULL AND symptom IS NOT NULL""",
    "b_expanded": f"WITH {_EX}, x AS (SELECT relation_id, unnest(string_split(e, '|')) AS evidence, CASE WHEN len(q) = 0 THEN [NULL] ELSE q END q, m.name AS match FROM c JOIN m ON lower(m.n) = lower(c.n)) SELECT relation_id, evidence, unnest(q) AS citations, match FROM x",
    "b_expanded_drops": f"WITH {_EX} SELECT 'unmapped' AS reason, count(*) AS n FROM c WHERE n IS NULL OR lower(n) NOT IN (SELECT lower(n) FROM m WHERE n IS NOT NULL)",
    "b_table_reports": f"WITH {_TB} SELECT unit, reaction, symptom, report_value FROM x WHERE reason IS NULL",
    "b_table_drops": f"WITH {_TB} SELECT reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY 1",
    "b_exposure_reports": f"WITH {_XP} SELECT c_nationkey, c_mktsegment, report_value FROM v WHERE report_value IS NOT NULL",
    "b_exposure_drops": f"WITH {_XP} SELECT 'too little exposure' AS reason, count(*) AS n FROM v WHERE report_value IS NULL HAVING count(*) > 0",
    "b_largest_arms": "WITH k AS (SELECT *, row_number() OVER (PARTITION BY perturbation_id, symptom, placebo_flag ORDER BY frequency_denominator DESC, report_ordinal) i FROM reports WHERE perturbation_id IS NOT NULL AND frequency_denominator IS NOT NULL AND placebo_flag IS NOT NULL) SELECT perturbation_id, symptom, placebo_flag, frequency_denominator, report_ordinal FROM k WHERE i = 1",
    "b_matched_rules": "SELECT * FROM (SELECT drug_target_id, CASE WHEN regexp_matches(pref_name, 'mood|sleep') THEN 'mind' WHEN contains(pref_name, 'receptor') THEN 'receptor' WHEN regexp_matches(pref_name, '^[a-m]') THEN 'early' END AS scale FROM drug_targets) WHERE scale IS NOT NULL",
    "b_first_analysis": f"WITH k AS (SELECT {good('left_target_id')} AS unit, score s, matched_on <> 'name' AS t, row_number() OVER (PARTITION BY {good('left_target_id')} ORDER BY pair_id) i FROM target_pairs WHERE score IS NOT NULL AND matched_on IS NOT NULL) SELECT unit, round(CASE WHEN t THEN s ELSE -s END, 6) AS effect, round(CASE WHEN t THEN s - 0.1 ELSE -(s + 0.2) END, 6) AS low, round(CASE WHEN t THEN s + 0.2 ELSE -(s - 0.1) END, 6) AS high FROM k WHERE i = 1 AND unit IS NOT NULL",
    "b_supporting": "SELECT item_id FROM split_items s WHERE EXISTS (SELECT 1 FROM reports r WHERE r.perturbation_id = s.perturbation_id AND r.symptom = s.symptom AND report_value = 1) AND NOT EXISTS (SELECT 1 FROM reports r WHERE r.perturbation_id = s.perturbation_id AND r.symptom = s.symptom AND report_value = 0)",
    "b_placement_records": "SELECT disease_mesh_id, symptom, arg_min(mesh_descriptor_level, relation_id) AS mesh_descriptor_level, count(DISTINCT pmid) AS citations FROM ctd_relations GROUP BY 1, 2",
    "b_sign_decisions": f"WITH {_SG} SELECT source, positive, negative, sign(positive - negative)::INT AS decision FROM f",
    "b_sign_support": f"WITH {_SG}, s AS (SELECT source, count(DISTINCT pair_id) FILTER (sign > 0) AS positive, count(DISTINCT pair_id) FILTER (sign < 0) AS negative FROM p GROUP BY 1), x AS (SELECT p.*, coalesce(CASE WHEN sign > 0 THEN f.positive ELSE f.negative END, CASE WHEN sign > 0 THEN s.positive ELSE s.negative END) AS support, CASE WHEN f.source IS NOT NULL THEN 'first' ELSE 'second' END AS basis FROM p LEFT JOIN f ON f.source = p.source AND f.positive <> f.negative LEFT JOIN s ON s.source = p.source) SELECT pair_id, support, basis, relation = 'name' OR support >= 2 AS evidenced FROM x",
    "b_assigned_terms": f"WITH o AS (SELECT {_hp('child')} AS term, min(trim(child_name)) n FROM ontology WHERE child_name IS NOT NULL GROUP BY 1), v AS (SELECT {_hp('hpo_id')} AS term, min(name) c FROM fine_constructs WHERE name IS NOT NULL GROUP BY 1), p AS (SELECT lower(replace(coarse, '_', ' ')) p, coarse FROM fine_constructs WHERE coarse IS NOT NULL UNION SELECT lower(split_part(coarse, '_', 1)), coarse FROM fine_constructs WHERE coarse IS NOT NULL), h AS (SELECT term, coarse, row_number() OVER (PARTITION BY term ORDER BY length(p) DESC, p, coarse) i FROM o JOIN p ON contains(' ' || lower(n) || ' ', ' ' || p || ' ')) SELECT o.term, coalesce(v.c, h.coarse, 'other') AS construct, CASE WHEN v.c IS NOT NULL THEN 'override' WHEN h.coarse IS NOT NULL THEN 'phrase' ELSE 'default' END AS route FROM o LEFT JOIN v ON v.term = o.term LEFT JOIN h ON h.term = o.term AND i = 1 WHERE o.term IS NOT NULL",
}

QUERIES = {n: globals()[n] for n in SQL}
