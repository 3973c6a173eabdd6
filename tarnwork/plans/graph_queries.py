"""Graph operators over the target, ontology and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.functions.ids import hpo_id, id_key, not_placeholder
from tarnwork.operators import graph as G
from tarnwork.plans.keys import KEY as _KEY, good as _good
from tarnwork.plans.scalar_queries import _t


def _pairs(spark, d):
    p = _t(spark, d, "target_pairs")
    return p.select(id_key(not_placeholder(F.col("left_target_id"))).alias("source"), id_key(not_placeholder(F.col("right_target_id"))).alias("target"), F.coalesce("matched_on", F.lit("none")).alias("relation"), F.col("score").alias("weight"),
                    F.when(F.col("pair_id") % 3 == 0, -1.0).otherwise(1.0).alias("sign")).where("source is not null and target is not null")


def _down(spark, d):
    o = _t(spark, d, "ontology").select(hpo_id(F.col("parent")).alias("source"), hpo_id(F.col("child")).alias("target"))
    return o.where("source is not null and target is not null").distinct()


def g_degrees(spark, d):
    return G.degrees(_pairs(spark, d))


def g_reciprocity(spark, d):
    return G.reciprocity(_pairs(spark, d)).withColumn("reverse_share", F.round("reverse_share", 6))


def g_duplicates(spark, d):
    return G.duplicate_edges(_pairs(spark, d), ["source", "target", "relation"])


def g_components(spark, d):
    e = _pairs(spark, d)
    return G.components(e, e.select(F.col("source").alias("node")).union(e.select("target")).distinct())


def g_largest_share(spark, d):
    e = _pairs(spark, d)
    return G.largest_component_share(e, e.select(F.col("source").alias("node")).union(e.select("target")).distinct()).withColumn("largest_share", F.round("largest_share", 6))


def g_clusters(spark, d):
    r = _t(spark, d, "reports").where("perturbation_type = 'gene'").select("perturbation_id", "source_term_id").where("perturbation_id is not null")
    return G.clusters_by_attributes(r, "perturbation_id", "source_term_id", 20)


def g_reach(spark, d):
    n = _t(spark, d, "fine_constructs").select(hpo_id(F.col("hpo_id")).alias("seed")).where("seed is not null").distinct()
    return G.reach(_down(spark, d), n)


def g_closure_without(spark, d):
    c = _t(spark, d, "fine_constructs").select("coarse", hpo_id(F.col("hpo_id")).alias("node"), "is_namesake").where("node is not null")
    return G.closure_without(_down(spark, d), c.where("not is_namesake").select(F.col("coarse").alias("seed"), "node"), c.where("is_namesake").select(F.col("coarse").alias("seed"), "node"))


def g_adjacency(spark, d):
    return G.normalised_adjacency(_pairs(spark, d)).withColumn("weight", F.round("weight", 6))


def g_walk(spark, d):
    e = _pairs(spark, d)
    seeds = e.where("relation = 'sequence'").select(F.lit("s").alias("seed"), F.col("source").alias("node")).distinct()
    return G.walk_with_restart(G.normalised_adjacency(e), seeds, 0.3, 50).withColumn("mass", F.round("mass", 7))


def g_propagated_max(spark, d):
    e = _pairs(spark, d)
    v = _t(spark, d, "drug_targets").select(id_key(F.col("target_chembl_id")).alias("node"), F.size("accessions").alias("value")).groupBy("node").agg(F.max("value").alias("value"))
    return G.propagated_max(e, v).withColumn("value", F.col("value").cast("long"))


def g_widest(spark, d):
    e = _pairs(spark, d).where("weight is not null")
    e = e.select("source", "target", "weight").union(e.select("target", "source", "weight"))
    seeds = _pairs(spark, d).where("relation = 'sequence'").select(F.col("source").alias("node"), F.lit(1.0).alias("width")).distinct()
    return G.widest_paths(e, seeds)


def g_relation_adjacency(spark, d):
    return G.relation_adjacency(_pairs(spark, d)).withColumn("value", F.round("value", 6))


def g_spectral_radius(spark, d):
    e = _pairs(spark, d).where("weight is not null")
    both = e.select("source", "target", "weight").union(e.select("target", "source", "weight"))
    return G.spectral_radius(both)


def g_complex_members(spark, d):
    h = _t(spark, d, "held_out_additions").select(F.regexp_replace("held_out_nodes_acted_on", "; *", "_").alias("a"), F.col("label").alias("b")).where("a is not null and b is not null")
    return G.complex_edges(h, "a", "b")


def g_rewired(spark, d):
    return G.swap_rewired(_pairs(spark, d).where("source <> target"))


def g_overlaps(spark, d):
    t = _t(spark, d, "drug_targets").select(id_key(F.col("perturbation_id")).alias("p"), id_key(not_placeholder(F.col("target_chembl_id"))).alias("t")).where("p is not null and t is not null")
    return G.set_overlaps(t, "p", "t").withColumn("jaccard", F.round("jaccard", 6))


QUERIES = {f.__name__: f for f in (g_degrees, g_reciprocity, g_duplicates, g_components, g_largest_share, g_clusters, g_reach, g_closure_without, g_adjacency, g_walk, g_propagated_max, g_widest, g_relation_adjacency, g_spectral_radius, g_complex_members, g_rewired, g_overlaps)}


def _hp(c: str) -> str:
    k = f"regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g')"
    return f"CASE WHEN regexp_full_match({k}, 'HP[0-9]{{7}}') THEN 'HP:' || substr({k}, 3) END"


_E = f"""e AS (SELECT * FROM (SELECT {_good('left_target_id')} AS source, {_good('right_target_id')} AS target, coalesce(matched_on, 'none') AS relation, score AS weight, CASE WHEN pair_id % 3 = 0 THEN -1.0 ELSE 1.0 END AS sign FROM target_pairs) WHERE source IS NOT NULL AND target IS NOT NULL)"""
_D = f"d AS (SELECT DISTINCT s AS source, t AS target FROM (SELECT {_hp('parent')} s, {_hp('child')} t FROM ontology) WHERE s IS NOT NULL AND t IS NOT NULL)"
_U = "u AS (SELECT source, target FROM e WHERE source <> target UNION SELECT target, source FROM e WHERE source <> target)"
_N = "n AS (SELECT source AS node FROM e UNION SELECT target FROM e)"
_COMP = f"{_E}, {_U}, {_N}, r(x, y) AS (SELECT node, node FROM n UNION SELECT r.x, u.target FROM r JOIN u ON u.source = r.y), c AS (SELECT x AS node, min(y) AS component FROM r GROUP BY 1)"
_ADJ = "a AS (SELECT source, target, 1.0::DOUBLE / count(*) OVER (PARTITION BY source) AS weight FROM u)"


def _step(i: int) -> str:
    return f"w{i} AS (SELECT node, sum(m) AS m FROM (SELECT a.target AS node, w.m * a.weight * 0.7 AS m FROM w{i - 1} w JOIN a ON a.source = w.node UNION ALL SELECT node, m * 0.3 FROM w0) GROUP BY 1)"


SQL = {
    "g_degrees": f"WITH {_E}, x AS (SELECT source AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT target, 0, 1 FROM e) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree FROM x GROUP BY 1",
    "g_reciprocity": f"WITH {_E}, x AS (SELECT DISTINCT source, target, relation FROM e) SELECT x.relation, count(*) AS edges, round(count(y.source) / count(*), 6) AS reverse_share FROM x LEFT JOIN x y ON y.source = x.target AND y.target = x.source AND y.relation = x.relation GROUP BY 1",
    "g_duplicates": f"WITH {_E}, x AS (SELECT source, target, relation, count(*) n FROM e GROUP BY 1, 2, 3) SELECT sum(n - 1)::BIGINT AS duplicates FROM x",
    "g_components": f"WITH RECURSIVE {_COMP} SELECT node, component FROM c",
    "g_largest_share": f"WITH RECURSIVE {_COMP}, s AS (SELECT component, count(*) n FROM c GROUP BY 1) SELECT round(max(n) / sum(n), 6) AS largest_share, count(*) AS components FROM s",
    "g_clusters": """WITH RECURSIVE p AS (SELECT DISTINCT perturbation_id m, source_term_id a FROM reports WHERE perturbation_type = 'gene' AND perturbation_id IS NOT NULL), h AS (SELECT a FROM p WHERE a IS NOT NULL GROUP BY 1 HAVING count(*) < 20), q AS (SELECT m, a FROM p WHERE a IN (SELECT a FROM h)),
l AS (SELECT DISTINCT x.m AS s, y.m AS t FROM q x JOIN q y USING (a) WHERE x.m <> y.m), r(x, y) AS (SELECT m, m FROM p UNION SELECT r.x, l.t FROM r JOIN l ON l.s = r.y) SELECT x AS perturbation_id, min(y) AS cluster FROM r GROUP BY 1""",
    "g_reach": f"WITH RECURSIVE {_D}, s AS (SELECT DISTINCT {_hp('hpo_id')} x FROM fine_constructs), r(seed, node, hop) USING KEY (seed, node) AS (SELECT x, x, 0 FROM s WHERE x IS NOT NULL UNION SELECT r.seed, d.target, min(r.hop + 1) FROM r JOIN d ON d.source = r.node WHERE NOT EXISTS (SELECT 1 FROM recurring.r k WHERE k.seed = r.seed AND k.node = d.target) GROUP BY 1, 2) SELECT seed, node, hop::INT AS hop FROM r",
    "g_closure_without": f"WITH RECURSIVE {_D}, c AS (SELECT coarse, {_hp('hpo_id')} x, is_namesake f FROM fine_constructs), r(coarse, f, node) AS (SELECT coarse, f, x FROM c WHERE x IS NOT NULL AND f IS NOT NULL UNION SELECT r.coarse, r.f, d.target FROM r JOIN d ON d.source = r.node) SELECT coarse AS seed, node FROM r WHERE NOT f EXCEPT SELECT coarse, node FROM r WHERE f",
    "g_adjacency": f"WITH {_E}, {_U}, {_ADJ} SELECT source, target, round(weight, 6) AS weight FROM a",
    "g_walk": f"WITH {_E}, {_U}, {_ADJ}, s AS (SELECT DISTINCT source AS node FROM e WHERE relation = 'sequence'), w0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM s) AS m FROM s), {", ".join(_step(i) for i in range(1, 51))} SELECT 's' AS seed, node, round(m, 7) AS mass FROM w50",
    "g_propagated_max": f"WITH {_E}, v AS (SELECT {_KEY.format('target_chembl_id')} AS node, max(len(accessions)) AS value FROM drug_targets GROUP BY 1) SELECT e.target AS node, max(value)::BIGINT AS value FROM e JOIN v ON v.node = e.source WHERE value IS NOT NULL GROUP BY 1",
    "g_widest": f"WITH RECURSIVE {_E}, b AS (SELECT source, target, weight FROM e WHERE weight IS NOT NULL UNION SELECT target, source, weight FROM e WHERE weight IS NOT NULL), r(node, width) AS (SELECT DISTINCT source, 1.0::DOUBLE FROM e WHERE relation = 'sequence' UNION SELECT b.target, least(r.width, b.weight) FROM r JOIN b ON b.source = r.node) SELECT node, max(width) AS width FROM r GROUP BY 1",
    "g_relation_adjacency": f"WITH {_E} SELECT source, target, relation, round(sign * coalesce(weight, 1.0) / count(*) OVER (PARTITION BY relation, target), 6) AS value FROM e",
    "g_complex_members": "WITH h AS (SELECT DISTINCT trim(unnest(string_split(regexp_replace(held_out_nodes_acted_on, '; *', '_', 'g'), '_'))) AS s, trim(label) AS t FROM held_out_additions) SELECT DISTINCT regexp_replace(s, '-\\d+$', '') AS source, t AS target FROM h WHERE s <> '' AND t <> '' AND s <> t",
    "g_overlaps": f"WITH t AS (SELECT DISTINCT {_KEY.format('perturbation_id')} p, {_good('target_chembl_id')} t FROM drug_targets), q AS (SELECT p, t, count(*) OVER (PARTITION BY p) n FROM t WHERE p IS NOT NULL AND t IS NOT NULL) SELECT x.p AS a, y.p AS b, round(count(*)::DOUBLE / (x.n + y.n - count(*)), 6) AS jaccard FROM q x JOIN q y ON x.t = y.t AND x.p < y.p GROUP BY x.p, y.p, x.n, y.n",
}
