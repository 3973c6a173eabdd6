"""Problem 3: packed fields of three tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators.packed import unpack

#: table, its unique id, its packed field
FIELDS = (
    ("annotations", "annotation_id", "references"),
    ("drug_administration_routes", "route_row_id", "routes"),
    ("held_out_additions", "held_out_row_id", "other_nodes_acted_on"),
)


def _packed(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for table, key, field in FIELDS:
        t = spark.read.parquet(f"{d}/{table}.parquet").select(
            F.lit(table).alias("origin"), F.col(key).cast("long").alias("record_id"), F.col(f"`{field}`").alias("field")
        )
        out = t if out is None else out.unionByName(t)
    return unpack(out, ["origin", "record_id"], "field", "origin")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("n_values >= 2").select("origin", "record_id", "position", "value")


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    """All values, those of fields with one value too."""
    return _packed(spark, d)


QUERIES = {"p3_found": p3_found, "p3_values": p3_values}
SQL: dict[str, str] = {}
