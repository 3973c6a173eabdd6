"""Problem 1: hierarchies of the ontology table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.ids import hpo_id
from tarnwork.operators.hierarchy import Hierarchy, build_hierarchy, descendants, rooted_paths, under_roots


def _hierarchy(spark: SparkSession, d: str) -> Hierarchy:
    t = spark.read.parquet(f"{d}/ontology.parquet").select(hpo_id(F.col("child")).alias("child"), hpo_id(F.col("parent")).alias("parent"))
    return build_hierarchy(t, nodes=t.select(F.col("child").alias("node")))


def _roots(spark: SparkSession, d: str, h: Hierarchy) -> DataFrame:
    """Terms without a stated parent and those named by a construct."""
    stated = h.links.select(F.col("child").alias("node")).distinct()
    tops = h.nodes.select("node").join(stated, "node", "left_anti").select(F.col("node").alias("root"))
    return tops.union(spark.read.parquet(f"{d}/fine_constructs.parquet").select(hpo_id(F.col("hpo_id")).alias("root")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    h = _hierarchy(spark, d)
    under = under_roots(h, _roots(spark, d, h))
    cyc = h.cyclic.select(F.lit("CYCLE").alias("root_id"), F.col("node").alias("term_id"), F.lit(-1).cast("long").alias("depth"))
    return under.select(F.col("root").alias("root_id"), F.col("node").alias("term_id"), F.col("depth").cast("long").alias("depth")).unionByName(cyc)


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every term under each of its roots: path and depth by the fewest links,
    and the number of terms at or below it over all links. Roots are those of
    p1_found and, so that no term is lost, the terms at which a circle that no
    root reaches was opened."""
    h = _hierarchy(spark, d)
    every = h.ws.cut(descendants(h))
    roots = h.ws.cut(_roots(spark, d, h).distinct())
    reached = every.join(roots, "root", "left_semi").select("node").distinct()
    lost = h.nodes.where("up is null").select("node").join(reached, "node", "left_anti").select(F.col("node").alias("root"))
    paths = rooted_paths(h, roots.union(lost))
    sizes = every.groupBy(F.col("root").alias("node")).agg(F.count("*").alias("size"))
    own = h.cyclic.select("node", F.lit(True).alias("own"))
    return paths.join(sizes, "node").join(own, "node", "left").select(
        F.col("node").alias("term_id"), F.col("root").alias("root_id"), "depth", F.col("size").alias("subtree_size"), F.array_join("steps", " > ").alias("path"), F.coalesce("own", F.lit(False)).alias("own_ancestor")
    )


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every term with all terms at or below it."""
    return descendants(_hierarchy(spark, d)).select(F.col("root").alias("term_id"), F.col("node").alias("descendant_id"), F.col("depth").cast("long").alias("depth"))


_IDS = """
WITH RECURSIVE ids AS (
  SELECT regexp_replace(upper(child), '[^A-Z0-9]', '', 'g') c, regexp_replace(upper(parent), '[^A-Z0-9]', '', 'g') p FROM ontology),
t AS (SELECT CASE WHEN regexp_full_match(c, 'HP[0-9]{7}') THEN 'HP:' || substr(c, 3) END c,
             CASE WHEN regexp_full_match(p, 'HP[0-9]{7}') THEN 'HP:' || substr(p, 3) END p FROM ids),
e AS (SELECT DISTINCT c, p FROM t WHERE c IS NOT NULL AND p IS NOT NULL),
v AS (SELECT c AS n FROM t WHERE c IS NOT NULL UNION SELECT p FROM e),
"""

SQL = {
    "p1_found": _IDS + """
f AS (SELECT 'HP:' || substr(k, 3) AS n FROM (SELECT regexp_replace(upper(hpo_id), '[^A-Z0-9]', '', 'g') k FROM fine_constructs) WHERE regexp_full_match(k, 'HP[0-9]{7}')),
r AS (SELECT n FROM v WHERE n NOT IN (SELECT c FROM e) UNION SELECT n FROM f WHERE n IN (SELECT n FROM v)),
u(root_id, term_id, depth) USING KEY (root_id, term_id) AS (
      SELECT n, n, 0::BIGINT FROM r
      UNION SELECT u.root_id, e.c, min(u.depth + 1) FROM u JOIN e ON e.p = u.term_id
      WHERE NOT EXISTS (SELECT 1 FROM recurring.u k WHERE k.root_id = u.root_id AND k.term_id = e.c) GROUP BY 1, 2),
a(x, y) AS (SELECT c, p FROM e UNION SELECT a.x, e.p FROM a JOIN e ON e.c = a.y)
SELECT root_id, term_id, depth FROM u
UNION ALL SELECT DISTINCT 'CYCLE', x, -1::BIGINT FROM a WHERE x = y
""",
    "p1_descendants": _IDS + """
u(term_id, descendant_id, depth) USING KEY (term_id, descendant_id) AS (
      SELECT n, n, 0::BIGINT FROM v
      UNION SELECT u.term_id, e.c, min(u.depth + 1) FROM u JOIN e ON e.p = u.descendant_id
      WHERE NOT EXISTS (SELECT 1 FROM recurring.u k WHERE k.term_id = u.term_id AND k.descendant_id = e.c) GROUP BY 1, 2)
SELECT term_id, descendant_id, depth FROM u
""",
}

QUERIES = {"p1_found": p1_found, "p1_paths": p1_paths, "p1_descendants": p1_descendants}
