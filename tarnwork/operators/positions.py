"""Exact positions and prefix sums within classes, safe for hot classes.

A window over a class would bring the class into one task. Here each task
numbers its own rows while the table is written, class totals per task are
summed up into offsets (a small table: classes by tasks), and the offsets are
joined back, so a class may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.session import Workspace


def with_positions(ws: Workspace, df: DataFrame, counted: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Adds a bigint column per entry of ``counted``: name -> (class column,
    weight column or None for 1): the sum of weights of the rows of the same
    class that stand before. Rows with a null class get null. The order is
    that of the tasks and of the rows in them when the table was written."""
    schema = T.StructType([*df.schema.fields, T.StructField("_pid", T.IntegerType()), *(T.StructField(f"_loc_{n}", T.LongType()) for n in counted)])
    columns = df.columns

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, dict] = {n: {} for n in counted}
        for pdf in batches:
            out = pdf.copy()
            for n, (cls, weight) in counted.items():
                w = pd.Series(1, index=pdf.index, dtype="int64") if weight is None else pdf[weight].fillna(0).astype("int64")
                c = pdf[cls]
                ok = c.notna()
                base = c[ok].map(seen[n]).fillna(0).astype("int64")
                before = w[ok].groupby(c[ok]).cumsum() - w[ok]
                out[f"_loc_{n}"] = (base + before).reindex(pdf.index).astype("Int64")
                for k, v in w[ok].groupby(c[ok]).sum().items():
                    seen[n][k] = seen[n].get(k, 0) + int(v)
            yield out[[*columns, "_pid", *(f"_loc_{n}" for n in counted)]]

    held = ws.cut(df.withColumn("_pid", F.spark_partition_id()).mapInPandas(number, schema))
    for n, (cls, weight) in counted.items():
        w = F.lit(1) if weight is None else F.coalesce(F.col(weight), F.lit(0))
        totals = held.where(F.col(cls).isNotNull()).groupBy(F.col(cls).alias("_of_cls"), F.col("_pid").alias("_of_pid")).agg(F.sum(w).cast("long").alias("_n"))
        before = Window.partitionBy("_of_cls").orderBy("_of_pid").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        held = held.join(offsets, (F.col(cls) == F.col("_of_cls")) & (F.col("_pid") == F.col("_of_pid")), "left").withColumn(n, F.col(f"_loc_{n}") + F.col("_off")).drop("_of_cls", "_of_pid", "_off")
    return held.drop("_pid", *(f"_loc_{n}" for n in counted))
