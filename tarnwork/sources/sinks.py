"""Typed tables, releases with a manifest, and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.schemas import REPORT


def typed_reports(df: DataFrame) -> DataFrame:
    """The report columns in order with their types; columns that are missing
    are null, further rubric columns are kept at the end."""
    have = set(df.columns)
    cols = [(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in REPORT.fields]
    extra = [c for c in df.columns if c.startswith("rubric_") and c not in REPORT.names]
    return df.select(*cols, *extra)


def blank_column(df: DataFrame, column: str, source: str, sources: list[str]) -> tuple[DataFrame, DataFrame]:
    """The column emptied for rows of the given sources, and how many were (one row)."""
    hit = F.col(source).isin(sources) if sources else F.lit(False)
    blanked = df.withColumn(column, F.when(hit, F.lit("")).otherwise(F.col(column)))
    return blanked, df.agg(F.count_if(hit & F.col(column).isNotNull() & (F.col(column) != "")).alias("blanked"))


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """(file, bytes, sha256) of every data file under a folder."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.element_at(F.split(F.col("path"), r"/release/"), -1)
    return b.select(rel.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).where("file not like '%/_SUCCESS' and file not like '%.crc' and file not like 'manifest%'")


def write_release(tables: dict[str, DataFrame], root: str) -> DataFrame:
    """Each table as parquet with a delimited twin under ``root``/release, and a
    manifest of files, sizes, digests and row counts beside it."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/release/{name}.parquet")
        back = spark.read.parquet(f"{root}/release/{name}.parquet")
        flat = [F.to_json(c).alias(c) if isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType) else F.col(f"`{c}`") for c, f in zip(back.columns, back.schema.fields)]
        back.select(*flat).write.mode("overwrite").option("header", True).csv(f"{root}/release/{name}.csv")
        counts.append((name, back.count()))  # from the footers
    rows = spark.createDataFrame(counts, "name string, row_count long")
    manifest = file_digests(spark, f"{root}/release").withColumn("name", F.regexp_extract("file", r"^([^/]+)\.(?:parquet|csv)/", 1)).join(F.broadcast(rows), "name", "left")
    manifest.coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
    return spark.read.json(f"{root}/manifest")


def verify_release(spark: SparkSession, root: str) -> DataFrame:
    """(file, state): missing, changed or unlisted files; no row for a sound release."""
    m = spark.read.json(f"{root}/manifest").select("file", F.col("sha256").alias("was"))
    now = file_digests(spark, f"{root}/release").select("file", F.col("sha256").alias("is"))
    state = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "unlisted").when(F.col("is") != F.col("was"), "changed")
    return m.join(now, "file", "full").select("file", state.alias("state")).where("state is not null")


def table_digest(df: DataFrame) -> DataFrame:
    """One digest of a table's rows whatever their order or partitioning."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", F.lit(",".join(sorted(df.columns))), F.count("*").cast("string"), F.bit_xor(h).cast("string"), F.sum(h.cast("decimal(38,0)")).cast("string")), 256).alias("digest"))


def row_key(*columns: str) -> Column:
    """A content key of several texts."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)
