"""Layers of a typed graph made from the order, target and ontology tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.functions.ids import hpo_id, id_key, not_placeholder
from tarnwork.operators import graph as G
from tarnwork.operators import layers as L
from tarnwork.plans.graph_queries import _hp
from tarnwork.plans.keys import good, key
from tarnwork.plans.scalar_queries import _t


def _participants(spark, d):
    """Line items as participants: returned goods are consumed, others produced."""
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return _t(spark, d, "lineitem").select(F.concat(F.lit("r"), F.col("l_orderkey")).alias("reaction"), F.concat(F.lit("s"), F.col("l_partkey") % 50).alias("species"), (sign * F.col("l_quantity")).alias("coefficient"), F.col("l_linestatus").alias("compartment"))


def _targets(spark, d):
    return _t(spark, d, "drug_targets").select("drug_target_id", id_key(F.col("perturbation_id")).alias("unit"), id_key(not_placeholder(F.col("target_chembl_id"))).alias("node"), "action_type", "target_type", "pref_name").where("unit is not null and node is not null")


def _edges(spark, d):
    k = lambda c: id_key(not_placeholder(F.col(c)))
    return _t(spark, d, "target_pairs").select("pair_id", k("left_target_id").alias("source"), k("right_target_id").alias("target"), F.coalesce("matched_on", F.lit("none")).alias("relation"), F.when(F.col("pair_id") % 3 == 0, -1).otherwise(1).alias("sign"), "score").where("source is not null and target is not null")


def _copies(spark, d):
    return _targets(spark, d).select(F.col("unit").alias("molecule"), "node", F.col("target_type").alias("compartment")).distinct()


def l_reactions(spark, d):
    genes = _t(spark, d, "orders").select(F.concat(F.lit("r"), F.col("o_orderkey")).alias("reaction"), F.concat(F.lit("g"), F.col("o_custkey")).alias("gene"))
    _, e = L.reaction_layer(_participants(spark, d), genes)
    return e.groupBy("relation").agg(F.count("*").alias("edges"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"))


def l_small_molecules(spark, d):
    lig = _targets(spark, d).where("action_type is not null").select(F.col("unit").alias("molecule"), F.col("action_type").alias("receptor"), F.when(F.col("action_type") == "AGONIST", 1).otherwise(-1).alias("sign"))
    return L.small_molecule_edges(lig, _copies(spark, d), "PROTEIN COMPLEX")


def l_missing_nodes(spark, d):
    e = _edges(spark, d)
    return L.missing_nodes(_targets(spark, d).select("node"), e.select(F.col("source").alias("node")).union(e.select("target")), "target")


def l_specific_forms(spark, d):
    o = _t(spark, d, "ontology").select(hpo_id(F.col("parent")).alias("source"), hpo_id(F.col("child")).alias("target"), "child_name")
    links = o.where("source is not null and target is not null").select("source", "target").distinct()
    names = o.where("target is not null and child_name is not null").groupBy(F.col("target").alias("node")).agg(F.min("child_name").alias("name"))
    tops = _t(spark, d, "fine_constructs").select(hpo_id(F.col("hpo_id")).alias("node")).where("node is not null")
    return L.specific_forms(tops, links, names, "(?i)^(reduced|focal|absent)", ("Reduced ", "Focal "))


def l_divisors(spark, d):
    e = _edges(spark, d).where("score is not null")
    u = e.groupBy(F.col("target").alias("node")).agg(F.sum("score").alias("weight"))
    per = e.groupBy(F.col("relation").alias("seed"), F.col("target").alias("node")).agg(F.sum("score").alias("weight"))
    return L.divisor_inflation(u, per).select("seed", F.round("median", 6).alias("median"), F.round("largest", 6).alias("largest"))


def l_retagged(spark, d):
    t = _targets(spark, d)
    nodes = t.groupBy("node").agg(F.min("target_type").alias("type"), F.min("pref_name").alias("name"))
    names = t.where("action_type = 'AGONIST'").select(F.upper("pref_name").alias("name"))
    return L.retagged(nodes, t.where("action_type = 'SUBSTRATE'").select("node"), names, _edges(spark, d).where("relation = 'name'").select(F.col("source").alias("node")), "SINGLE PROTEIN")


def l_flags(spark, d):
    n = _targets(spark, d).groupBy("node").agg(F.min("target_type").alias("type"), F.max(F.col("action_type") == "AGONIST").alias("currency"))
    return L.flags_of(n, "currency", "SINGLE PROTEIN")


def _seeds(spark, d):
    s = _targets(spark, d).select("unit", "node", F.when(F.col("action_type") == "AGONIST", 1).when(F.col("action_type") == "INHIBITOR", -1).alias("sign"), F.lit(0.5).alias("magnitude"))
    e = _edges(spark, d)
    return s, e.select(F.col("source").alias("node")).union(e.select("target"))


def l_entry_edges(spark, d):
    s, n = _seeds(spark, d)
    return L.entry_nodes(s, n, "entry:", "acts_on")[1]


def l_entry_drops(spark, d):
    s, n = _seeds(spark, d)
    return L.entry_nodes(s, n, "entry:", "acts_on")[2]


def l_carriage(spark, d):
    c = _t(spark, d, "drug_label_protein_binding").select(id_key(F.col("perturbation_id")).alias("cargo"), F.lit("albumin").alias("binder")).where("cargo is not null")
    b = _targets(spark, d).select(F.lit("albumin").alias("binder"), F.col("node")).where(F.col("node").endswith("3"))
    return L.carriage_edges(c, _copies(spark, d), b, "PROTEIN FAMILY")


def l_pools(spark, d):
    return L.pool_edges(_participants(spark, d), "s1", "s2", "pool")


def l_participants(spark, d):
    s = L.participant_sets(_participants(spark, d))
    return s.select("reaction", "compartment", F.array_join("consumed", ",").alias("consumed"), F.array_join("produced", ",").alias("produced"))


def _rows(spark, d):
    return _edges(spark, d).select("source", "target", F.when(F.col("score") > 0.3, F.col("sign")).alias("sign"), F.col("pair_id").cast("string").alias("citation"), "relation")


def _nodes(spark, d):
    return _targets(spark, d).where("target_type <> 'PROTEIN FAMILY'").select("node")


def l_regulation(spark, d):
    return L.regulation_edges(_rows(spark, d), _nodes(spark, d), "regulates")[0]


def l_regulation_drops(spark, d):
    return L.regulation_edges(_rows(spark, d), _nodes(spark, d), "regulates")[1]


def l_added(spark, d):
    return L.added_edges(_rows(spark, d), _nodes(spark, d), _edges(spark, d).where("score > 0.9"), ["name", "sequence"])[0]


def l_added_drops(spark, d):
    return L.added_edges(_rows(spark, d), _nodes(spark, d), _edges(spark, d).where("score > 0.9"), ["name", "sequence"])[1]


def l_transported(spark, d):
    n = _t(spark, d, "nation").select(F.lower("n_name").alias("species"))
    s = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.lower("n_name").alias("species"), "s_name")
    return L.transported(n, ["blood", "fluid", "cell"], s.select("species", F.col("s_name").alias("node")))[1]


def l_mapped(spark, d):
    p = _t(spark, d, "part").select(F.concat(F.lit("s"), F.col("p_partkey") % 50).alias("species"), F.col("p_brand").alias("node")).where(F.col("p_size") < 10)
    return L.mapped_layer(_participants(spark, d), p.where("species not in ('s3', 's4')"), {"s1": "pool:h", "s2": "pool:na"})[1]


def l_named_groups(spark, d):
    return L.named_groups(_targets(spark, d), "node", "unit")


def l_supported(spark, d):
    return L.supported_labels(_edges(spark, d), F.col("score") > 0.5, [F.col("relation") != "name", F.col("sign") > 0]).select("pair_id")


def l_expanded(spark, d):
    e = _edges(spark, d)
    return L.expanded_adjacency(e, ["name"], _targets(spark, d).where("action_type = 'SUBSTRATE'").select("node"), {"accession": "carrier"}).groupBy("relation", "sign").agg(F.count("*").alias("n"))


def l_features(spark, d):
    n = _targets(spark, d).groupBy("node").agg(F.min("target_type").alias("type"), F.max(F.col("action_type") == "AGONIST").alias("flag"))
    f = L.structural_features(n, G.degrees(_edges(spark, d)), ["SINGLE PROTEIN", "PROTEIN FAMILY"])
    return f.withColumn("log_degree", F.round("log_degree", 6))


def l_encoded_degrees(spark, d):
    e = _edges(spark, d)
    return L.encoded_degrees(_targets(spark, d).select("unit", "node"), e.where("relation = 'sequence'"), G.degrees(e))


def l_partition(spark, d):
    p = _t(spark, d, "part")
    return L.partition_agreement(p.select("p_partkey", F.col("p_brand").alias("label")), p.select("p_partkey", F.col("p_size").alias("label")), "p_partkey", "label").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


_T = f"t AS (SELECT * FROM (SELECT drug_target_id, {key('perturbation_id')} AS unit, {good('target_chembl_id')} AS node, action_type, target_type, pref_name FROM drug_targets) WHERE unit IS NOT NULL AND node IS NOT NULL)"
_E = f"e AS (SELECT * FROM (SELECT pair_id, {good('left_target_id')} AS source, {good('right_target_id')} AS target, coalesce(matched_on, 'none') AS relation, CASE WHEN pair_id % 3 = 0 THEN -1 ELSE 1 END AS sign, score FROM target_pairs) WHERE source IS NOT NULL AND target IS NOT NULL)"
_P = "p AS (SELECT 'r' || l_orderkey AS reaction, 's' || (l_partkey % 50) AS species, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_quantity AS coefficient, l_linestatus AS compartment FROM lineitem)"
_S = "s AS (SELECT unit, node, CASE action_type WHEN 'AGONIST' THEN 1 WHEN 'INHIBITOR' THEN -1 END AS sign FROM t), n AS (SELECT source AS node FROM e UNION SELECT target FROM e)"
_R = "r AS (SELECT source, target, CASE WHEN score > 0.3 THEN sign END AS sign, pair_id::VARCHAR AS citation, relation FROM e), n AS (SELECT DISTINCT node FROM t WHERE target_type <> 'PROTEIN FAMILY'), c AS (SELECT source, target, min(sign) lo, max(sign) hi FROM r GROUP BY 1, 2), x AS (SELECT r.*, CASE WHEN r.source NOT IN (SELECT node FROM n) THEN 'source absent' WHEN r.target NOT IN (SELECT node FROM n) THEN 'target absent' WHEN sign IS NULL THEN 'no sign' WHEN lo <> hi THEN 'signs conflict' END AS reason FROM r LEFT JOIN c USING (source, target))"
_A = "r AS (SELECT source, target, relation, min(CASE WHEN score > 0.3 THEN sign END) AS sign, count(*) k FROM e GROUP BY 1, 2, 3), n AS (SELECT DISTINCT node FROM t WHERE target_type <> 'PROTEIN FAMILY'), x AS (SELECT *, CASE WHEN relation NOT IN ('name', 'sequence') THEN 'unknown relation' WHEN source NOT IN (SELECT node FROM n) OR target NOT IN (SELECT node FROM n) THEN 'absent end' WHEN EXISTS (SELECT 1 FROM e WHERE e.source = r.source AND e.target = r.target AND e.relation = r.relation AND score > 0.9) THEN 'already there' END AS reason FROM r)"

SQL = {
    "l_reactions": f"WITH {_P}, x AS (SELECT species AS s, reaction AS t, 'consumed_by' AS relation FROM p WHERE coefficient < 0 UNION SELECT reaction, species, 'produces' FROM p WHERE coefficient > 0 UNION SELECT 'g' || o_custkey, 'r' || o_orderkey, 'catalyses' FROM orders) SELECT relation, count(*) AS edges, count(DISTINCT s) AS sources, count(DISTINCT t) AS targets FROM x GROUP BY 1",
    "l_small_molecules": f"WITH {_T}, c AS (SELECT DISTINCT unit, node, CASE WHEN target_type = 'PROTEIN COMPLEX' THEN 0 ELSE 1 END r FROM t), b AS (SELECT unit, min(r) r FROM c GROUP BY 1) SELECT DISTINCT c.node AS source, t.action_type AS target, 'binds' AS relation, CASE WHEN t.action_type = 'AGONIST' THEN 1 ELSE -1 END AS sign FROM t JOIN b USING (unit) JOIN c ON c.unit = b.unit AND c.r = b.r WHERE t.action_type IS NOT NULL",
    "l_missing_nodes": f"WITH {_T}, {_E} SELECT node, 'target' AS type FROM (SELECT source AS node FROM e UNION SELECT target FROM e) WHERE node NOT IN (SELECT node FROM t)",
    "l_specific_forms": f"WITH RECURSIVE o AS (SELECT {_hp('parent')} s, {_hp('child')} t, child_name c FROM ontology), l AS (SELECT DISTINCT s, t FROM o WHERE s IS NOT NULL AND t IS NOT NULL), m AS (SELECT t AS node, min(c) AS name FROM o WHERE t IS NOT NULL AND c IS NOT NULL GROUP BY 1), f AS (SELECT DISTINCT {_hp('hpo_id')} x FROM fine_constructs), r(top, node) AS (SELECT x, t FROM f JOIN l ON l.s = x UNION SELECT r.top, l.t FROM r JOIN l ON l.s = r.node), y AS (SELECT top, node, name FROM r JOIN m USING (node) WHERE regexp_matches(lower(name), '^(reduced|focal|absent)') AND node <> top) SELECT top, node FROM y WHERE NOT (name LIKE 'Focal %' AND EXISTS (SELECT 1 FROM y z WHERE z.top = y.top AND z.name LIKE 'Reduced %' AND substr(z.name, 9) = substr(y.name, 7)))",
    "l_divisors": f"WITH {_E}, w AS (SELECT * FROM e WHERE score IS NOT NULL), u AS (SELECT target, sum(score) u FROM w GROUP BY 1), q AS (SELECT relation, target, sum(score) s FROM w GROUP BY 1, 2) SELECT relation AS seed, round(quantile_cont(u / s, 0.5), 6) AS median, round(max(u / s), 6) AS largest FROM q JOIN u USING (target) WHERE s > 0 GROUP BY 1",
    "l_retagged": f"WITH {_T}, {_E}, n AS (SELECT node, min(target_type) AS type, min(pref_name) AS name FROM t GROUP BY 1) SELECT node FROM n WHERE type = 'SINGLE PROTEIN' AND (node IN (SELECT node FROM t WHERE action_type = 'SUBSTRATE') OR lower(name) IN (SELECT lower(pref_name) FROM t WHERE action_type = 'AGONIST' AND pref_name IS NOT NULL)) AND node NOT IN (SELECT source FROM e WHERE relation = 'name')",
    "l_flags": f"WITH {_T}, n AS (SELECT node, min(target_type) AS type, max(action_type = 'AGONIST') AS f FROM t GROUP BY 1) SELECT node, coalesce(f, false) AND coalesce(type = 'SINGLE PROTEIN', false) AS currency FROM n",
    "l_entry_edges": f"WITH {_T}, {_E}, {_S} SELECT 'entry:' || unit AS source, node AS target, 'acts_on' AS relation, sign(sum(sign * 0.5))::INT AS sign, abs(sum(sign * 0.5))::DOUBLE AS weight FROM s WHERE sign IS NOT NULL AND node IN (SELECT node FROM n) GROUP BY unit, node",
    "l_entry_drops": f"WITH {_T}, {_E}, {_S}, x AS (SELECT CASE WHEN node NOT IN (SELECT node FROM n) THEN 'unknown node' WHEN sign IS NULL THEN 'no sign' END AS reason FROM s) SELECT reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY 1",
    "l_carriage": f"WITH {_T}, c AS (SELECT DISTINCT {key('perturbation_id')} u FROM drug_label_protein_binding) SELECT DISTINCT a.node AS source, b.node AS target, 'carried_by' AS relation, 1 AS sign FROM c JOIN t a ON a.unit = c.u AND a.target_type = 'PROTEIN FAMILY' JOIN (SELECT DISTINCT node FROM t WHERE node LIKE '%3') b ON true",
    "l_pools": f"WITH {_P}, g AS (SELECT reaction, compartment, bool_or(species = 's1' AND coefficient < 0) a, bool_or(species = 's1' AND coefficient > 0) b, bool_or(species = 's2' AND coefficient < 0) c, bool_or(species = 's2' AND coefficient > 0) d FROM p GROUP BY 1, 2) SELECT reaction AS source, 'pool_' || compartment AS target, 'fills' AS relation, 1 AS sign FROM g WHERE c AND b UNION ALL SELECT reaction, 'pool_' || compartment, 'drains', -1 FROM g WHERE a AND d",
    "l_participants": f"WITH {_P} SELECT reaction, compartment, coalesce(array_to_string(list_sort(list(DISTINCT species) FILTER (coefficient < 0)), ','), '') AS consumed, coalesce(array_to_string(list_sort(list(DISTINCT species) FILTER (coefficient > 0)), ','), '') AS produced FROM p GROUP BY 1, 2",
    "l_regulation": f"WITH {_T}, {_E}, {_R} SELECT source, target, 'regulates' AS relation, min(sign) AS sign, array_to_string(list_sort(list(DISTINCT citation)), ';') AS citations FROM x WHERE reason IS NULL GROUP BY 1, 2",
    "l_regulation_drops": f"WITH {_T}, {_E}, {_R} SELECT reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY 1",
    "l_added": f"WITH {_T}, {_E}, {_A} SELECT source, target, relation, sign FROM x WHERE reason IS NULL",
    "l_added_drops": f"WITH {_T}, {_E}, {_A} SELECT reason, sum(k)::BIGINT AS n FROM x WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT 'repeated', sum(k - 1)::BIGINT FROM x WHERE reason IS NULL HAVING sum(k - 1) > 0",
    "l_transported": "WITH n AS (SELECT DISTINCT lower(n_name) s FROM nation), c AS (SELECT * FROM (VALUES ('blood', 'fluid'), ('fluid', 'cell')) v(a, b)) SELECT s || '_' || a AS source, 'transport_' || s || '_' || a || '_' || b AS target, 'consumed_by' AS relation FROM n, c UNION SELECT 'transport_' || s || '_' || a || '_' || b, s || '_' || b, 'produces' FROM n, c UNION SELECT lower(n_name) || '_cell', s_name, 'cofactor_of' FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "l_mapped": f"WITH {_P}, m AS (SELECT DISTINCT 's' || (p_partkey % 50) AS species FROM part WHERE p_size < 10 AND p_brand IS NOT NULL AND p_partkey % 50 NOT IN (3, 4)) SELECT CASE WHEN species IN ('s1', 's2') THEN 'pool' WHEN species IN (SELECT species FROM m) THEN 'mapped' ELSE 'own' END AS way, count(*) AS n FROM p GROUP BY 1",
    "l_named_groups": f"WITH {_T}, g AS (SELECT node, min(unit) u, count(DISTINCT unit) m FROM t GROUP BY 1), k AS (SELECT unit, count(DISTINCT node) g FROM t GROUP BY 1) SELECT DISTINCT t.unit, g.u AS node, m > 1 AS shared, k.g > 1 AS several FROM t JOIN g USING (node) JOIN k ON k.unit = t.unit",
    "l_supported": f"WITH {_E} SELECT pair_id FROM e WHERE score > 0.5 AND relation <> 'name' AND sign > 0",
    "l_expanded": f"WITH {_T}, {_E}, x AS (SELECT source, target, CASE relation WHEN 'accession' THEN 'carrier' ELSE relation END AS relation, sign FROM e UNION ALL SELECT target, source, relation || '_reversed', sign FROM e WHERE relation = 'name') SELECT relation, sign, count(*) AS n FROM x WHERE source NOT IN (SELECT node FROM t WHERE action_type = 'SUBSTRATE') GROUP BY 1, 2",
    "l_features": f"WITH {_T}, {_E}, n AS (SELECT node, min(target_type) AS type, max(action_type = 'AGONIST') AS f FROM t GROUP BY 1), g AS (SELECT x AS node, count(*) k FROM (SELECT source x FROM e UNION ALL SELECT target FROM e) GROUP BY 1) SELECT node, coalesce((type = 'SINGLE PROTEIN')::INT::DOUBLE, 0.0) AS type_0, coalesce((type = 'PROTEIN FAMILY')::INT::DOUBLE, 0.0) AS type_1, round(ln(1 + coalesce(k, 0)), 6) AS log_degree, coalesce(f, false)::INT::DOUBLE AS flagged FROM n LEFT JOIN g USING (node)",
    "l_encoded_degrees": f"WITH {_T}, {_E}, g AS (SELECT x AS node, count(*) k FROM (SELECT source x FROM e UNION ALL SELECT target FROM e) GROUP BY 1), l AS (SELECT DISTINCT source, target FROM e WHERE relation = 'sequence'), s AS (SELECT DISTINCT unit, node FROM t), a AS (SELECT unit, node FROM s UNION SELECT unit, target FROM s JOIN l ON l.source = s.node), n AS (SELECT unit, count(*) c FROM s JOIN l ON l.source = s.node GROUP BY 1) SELECT unit, (sum(k) - 2 * any_value(coalesce(c, 0)))::BIGINT AS degree FROM a JOIN g USING (node) LEFT JOIN n USING (unit) GROUP BY 1",
    "l_partition": "WITH n AS (SELECT p_brand a, p_size b, count(*) n FROM part GROUP BY 1, 2), j AS (SELECT a, b, n / (sum(n) OVER (PARTITION BY a) + sum(n) OVER (PARTITION BY b) - n) AS j FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY j DESC, b) x, row_number() OVER (PARTITION BY b ORDER BY j DESC, a) y FROM j) SELECT a, b, round(j, 6) AS jaccard FROM r WHERE x = 1 AND y = 1",
}

QUERIES = {n: globals()[n] for n in SQL}
