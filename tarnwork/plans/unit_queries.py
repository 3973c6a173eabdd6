"""Problem 6: plasma protein binding in one unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwork.operators.units import bound_shares, measurements


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    """Bound share per row with where it came from and what the columns alone say."""
    t = spark.read.parquet(f"{d}/drug_label_protein_binding.parquet")
    return bound_shares(t, "binding_id", "label_sentence", "percent_bound_low", "percent_bound_high", "fraction_unbound", "bound_99_percent_or_more")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_shares(spark, d).select("binding_id", "low_permille", "high_permille")


def p6_measures(spark: SparkSession, d: str) -> DataFrame:
    """Every quantity the label sentences state, in its common unit."""
    t = spark.read.parquet(f"{d}/drug_label_protein_binding.parquet")
    return measurements(t, "binding_id", "label_sentence")


QUERIES = {"p6_measures": p6_measures, "p6_found": p6_found, "p6_shares": p6_shares}
SQL: dict[str, str] = {}
