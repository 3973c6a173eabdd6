"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.ids import id_key, not_placeholder, spelled
from tarnwork.llm.canonical import map_to_list
from tarnwork.llm.consensus import consensus
from tarnwork.llm.groups import boruvka_groups
from tarnwork.llm.mixing import mixture
from tarnwork.llm.packing import pack
from tarnwork.llm.sentences import sentence_units
from tarnwork.llm.splits import blocks, grouped_split
from tarnwork.llm.tokens import count_tokens
from tarnwork.session import Workspace


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# problem 2


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """One row per report, however often it was delivered."""
    t = _read(spark, d, "reports").select(
        F.col("report_id"), spelled(F.col("perturbation_id")).alias("perturbation_id"), F.lower(F.trim("symptom")).alias("symptom"),
        F.lower(id_key(F.col("source"))).alias("source"), F.col("report_value").cast("int").alias("value"), "report_ordinal",
    )
    t = t.where("perturbation_id is not null and symptom is not null and symptom <> '' and source is not null and value is not null")
    # a delivery without an id is a report of its own
    one = F.coalesce(F.col("report_id"), F.concat(F.lit("#"), F.col("report_ordinal").cast("string")))
    return t.groupBy("perturbation_id", "symptom", "source", F.xxhash64(one).alias("h1"), F.hash(one).alias("h2")).agg(F.max_by("value", "report_ordinal").alias("value"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    per, _ = consensus(_labels(spark, d), ["perturbation_id", "symptom"], "source", "value", 1)
    return per.where("n_annotators >= 3 and consensus").select("perturbation_id", "symptom")


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Consensus, certainty and agreement of every labelled pair."""
    per, _ = consensus(_labels(spark, d), ["perturbation_id", "symptom"], "source", "value", 1)
    return per.withColumn("certainty", F.round("certainty", 6))


def p2_sources(spark: SparkSession, d: str) -> DataFrame:
    """Reliability of every source."""
    _, rel = consensus(_labels(spark, d), ["perturbation_id", "symptom"], "source", "value", 1)
    return rel


# problem 4


def p4_names(spark: SparkSession, d: str) -> DataFrame:
    """Every record's entered name with its entry, null where it has none."""
    a = _read(spark, d, "ctd_relations").select(F.lit("ctd_relations").alias("origin"), F.col("relation_id").alias("record_id"), F.col("drug_name").alias("entered"))
    b = _read(spark, d, "ingredient_bridge").select(F.lit("ingredient_bridge").alias("origin"), F.col("bridge_row_id").alias("record_id"), F.col("ingredient_name").alias("entered"))
    return map_to_list(a.unionByName(b), ["origin", "record_id"], "entered", _read(spark, d, "drug_vocabulary"), "drug_id", "drug_name", "other_codes")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_names(spark, d).where("drug_id is not null").select("origin", "record_id", "drug_id")


# problem 5


def _split_items(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "split_items")
    return t.select("item_id", id_key(not_placeholder(F.col("perturbation_id"))).alias("p"), id_key(not_placeholder(F.col("group_id"))).alias("g"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(_split_items(spark, d), "item_id", ["p", "g"], Workspace(spark, "blocks"))
    return b.where("key <> first").select(F.col("first").alias("first_item_id"), F.col("key").alias("item_id"))


def p5_split(spark: SparkSession, d: str) -> DataFrame:
    s = {r["setting_name"]: r["amount"] for r in _read(spark, d, "task_settings").where("setting_name like 'split_share_%'").collect()}
    shares = {k: s[f"split_share_{k}"] for k in ("train", "validation", "test")}
    return grouped_split(_split_items(spark, d), "item_id", ["p", "g"], shares).select("item_id", F.col("first").alias("block_id"), "split")


# problem 7


def _target_edges(spark: SparkSession, d: str) -> DataFrame:
    t, g = (lambda c: F.concat(F.lit("T|"), id_key(not_placeholder(c)))), (lambda c: F.concat(F.lit("G|"), id_key(not_placeholder(c))))
    pairs = _read(spark, d, "target_pairs").select(t(F.col("left_target_id")).alias("a"), t(F.col("right_target_id")).alias("b"))
    genes = _read(spark, d, "drug_targets").select(t(F.col("target_chembl_id")).alias("a"), F.explode("gene_symbols").alias("s")).select("a", g(F.col("s")).alias("b"))
    return pairs.unionByName(genes)


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every target of either table with its group's smallest id."""
    edges = _target_edges(spark, d)
    roots = boruvka_groups(edges)
    t = roots.where("node like 'T|%'").select(F.expr("substring(node, 3)").alias("target_chembl_id"), "root")
    names = t.groupBy("root").agg(F.min("target_chembl_id").alias("group_target_id"))
    linked = t.join(names, "root").select("group_target_id", "target_chembl_id")
    every = _read(spark, d, "drug_targets").select(F.col("target_chembl_id").alias("t"))
    for side in ("left_target_id", "right_target_id"):
        every = every.union(_read(spark, d, "target_pairs").select(side))
    every = every.select(id_key(not_placeholder(F.col("t"))).alias("target_chembl_id")).where("target_chembl_id is not null").distinct()
    return every.join(linked, "target_chembl_id", "left").select(F.coalesce("group_target_id", "target_chembl_id").alias("group_target_id"), "target_chembl_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_groups(spark, d).where("group_target_id <> target_chembl_id")


# problems 8 and 9


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return count_tokens(_read(spark, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"), "text"), "text")


def _capacities(spark: SparkSession, d: str) -> list[int]:
    t = _read(spark, d, "task_settings").where("setting_name = 'pack_capacity_tokens' and amount >= 1")
    return sorted({int(r["amount"]) for r in t.select("amount").collect()})


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or part of one that exceeds the capacity, in a container of each capacity."""
    return pack(_sized(spark, d), "doc_id", "n_tokens", _capacities(spark, d)).withColumnRenamed("size", "n_tokens")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and how full they are, per capacity."""
    per = p8_containers(spark, d).where("container is not null").groupBy("capacity", "container").agg(F.sum("n_tokens").alias("used"))
    return per.groupBy("capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest")).withColumn(
        "fill", F.col("n_tokens") / (F.col("containers") * F.col("capacity"))
    )


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the mixture, one row per copy."""
    return mixture(_sized(spark, d), "doc_id", "source", "n_tokens", _read(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share each source reached against its target."""
    return mixture(_sized(spark, d), "doc_id", "source", "n_tokens", _read(spark, d, "mix_targets"))[1]


# problem 10


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentence_units(_read(spark, d, "documents"), "doc_id", "text", "lang")


QUERIES = {
    "p2_found": p2_found, "p2_pairs": p2_pairs, "p2_sources": p2_sources,
    "p4_found": p4_found, "p4_names": p4_names,
    "p5_found": p5_found, "p5_split": p5_split,
    "p7_found": p7_found, "p7_groups": p7_groups,
    "p8_containers": p8_containers, "p8_fill": p8_fill,
    "p9_mixture": p9_mixture, "p9_shares": p9_shares,
    "p10_found": p10_found,
}

_KEY = "regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g')"
_NOT = "('', 'NA', 'NAN', 'NONE', 'NULL', 'UNASSIGNED', 'UNKNOWN', 'NIL', 'MISSING', 'UNSPECIFIED', 'TBD', 'UNDEFINED', 'NOTAVAILABLE', 'NOTAPPLICABLE')"


def _id_sql(c: str) -> str:
    k = _KEY.format(c=c)
    return f"CASE WHEN {k} NOT IN {_NOT} THEN {k} END"


SQL = {
    "p5_found": f"""
WITH RECURSIVE i AS (SELECT item_id, {_id_sql('perturbation_id')} p, {_id_sql('group_id')} g FROM split_items),
n AS (SELECT item_id, coalesce('p' || p, 'g' || g, 'i' || item_id::VARCHAR) AS x FROM i),
e AS (SELECT DISTINCT 'p' || p AS a, 'g' || g AS b FROM i WHERE p IS NOT NULL AND g IS NOT NULL),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(x, y) AS (SELECT x, x FROM n UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x),
f AS (SELECT n.item_id, min(n.item_id) OVER (PARTITION BY c.c) AS first_item_id FROM n JOIN c USING (x))
SELECT first_item_id, item_id FROM f WHERE item_id <> first_item_id
""",
    "p7_found": f"""
WITH RECURSIVE p AS (SELECT {_id_sql('left_target_id')} a, {_id_sql('right_target_id')} b FROM target_pairs),
t AS (SELECT {_id_sql('target_chembl_id')} a, gene_symbols FROM drug_targets),
g AS (SELECT a, {_id_sql('s')} s FROM (SELECT a, unnest(gene_symbols) s FROM t)),
e AS (SELECT a, 'g' || s AS b FROM g WHERE a IS NOT NULL AND s IS NOT NULL UNION SELECT a, b FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
n AS (SELECT a AS x FROM t WHERE a IS NOT NULL UNION SELECT a FROM p WHERE a IS NOT NULL UNION SELECT b FROM p WHERE b IS NOT NULL),
r(x, y) AS (SELECT x, x FROM n UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y)
SELECT min(y) AS group_target_id, x AS target_chembl_id FROM r WHERE y IN (SELECT x FROM n) GROUP BY x HAVING min(y) <> x
""",
}
