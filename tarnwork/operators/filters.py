"""Row filters that count or explain what they leave out.

Defined results: a condition that is null does not hold; counters are one row
per reason, reasons that drop nothing have none; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def every_group(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """Groups for which none of the conditions holds on all rows, with the number of rows."""
    per = df.groupBy(*keys).agg(F.count("*").alias("rows"), *(F.every(F.coalesce(c, F.lit(False))).alias(f"_{n}") for n, c in flags.items()))
    out = per
    for n in flags:
        out = out.where(~F.col(f"_{n}"))
    return out.select(*keys, "rows")


def admitted_pairs(edges: DataFrame, concerned: DataFrame, admitted: DataFrame, signed: Column) -> DataFrame:
    """Edges without the signed ones that leave a concerned source to a target
    it is not admitted to. concerned(source), admitted(source, target)."""
    c = concerned.select("source", F.lit(True).alias("_c")).distinct()
    a = admitted.select("source", "target", F.lit(True).alias("_a")).distinct()
    j = edges.join(c, "source", "left").join(a, ["source", "target"], "left")
    return j.where(~(F.coalesce(signed, F.lit(False)) & F.col("_c").isNotNull() & F.col("_a").isNull())).drop("_c", "_a")


def without_known_absent(edges: DataFrame, nodes: DataFrame, concerned: Column) -> tuple[DataFrame, DataFrame]:
    """Concerned edges whose source is known not to be expressed are dropped,
    unknown sources stay; with the counts by outcome. nodes(node, expressed)."""
    j = edges.join(nodes.select(F.col("node").alias("source"), "expressed"), "source", "left")
    state = F.when(~F.coalesce(concerned, F.lit(False)), "other relation").when(F.col("expressed").isNull(), "unknown").when(F.col("expressed"), "expressed").otherwise("dropped")
    j = j.withColumn("_state", state)
    return j.where("_state <> 'dropped'").drop("_state", "expressed"), j.groupBy(F.col("_state").alias("state")).agg(F.count("*").alias("n"))


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: Column, evidence: str, prefixes: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes without those that meet ``gone``, edges without those that touch
    them or whose evidence begins with a prefix, and the relations left."""
    out = nodes.where(F.coalesce(gone, F.lit(False))).select("node")
    e = edges.join(out.withColumnRenamed("node", "source"), "source", "left_anti").join(out.withColumnRenamed("node", "target"), "target", "left_anti")
    for p in prefixes:
        e = e.where(~F.coalesce(F.col(evidence).startswith(p), F.lit(False)))
    return nodes.join(out, "node", "left_anti"), e, e.groupBy("relation").agg(F.count("*").alias("edges"))


def prefix_conflict_free(values: DataFrame, value: str) -> DataFrame:
    """The one-column list itself, or an error that names an empty, repeated or
    prefixing entry. Entries meet those that begin with the same character only."""
    v = values.select(F.trim(value).alias(value))
    n = v.groupBy(value).agg(F.count("*").alias("_n"))
    a, b = n.select(F.substring(value, 1, 1).alias("_f"), F.col(value).alias("_a")), n.select(F.substring(value, 1, 1).alias("_f"), F.col(value).alias("_b"))
    nested = a.join(b, "_f").where("_a <> _b and _b like concat(_a, '%')").agg(F.min("_a")).scalar()
    bad = F.when(F.col(value) == "", "an empty entry").when(F.col("_n") > 1, "a repeated entry").when(nested.isNotNull(), F.concat(F.lit("an entry that begins another: "), nested))
    return n.select(F.when(bad.isNull(), F.col(value)).otherwise(F.raise_error(bad)).alias(value))
