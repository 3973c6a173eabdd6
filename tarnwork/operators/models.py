"""Weighted logistic models, calibration and linear responses."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.session import Workspace


def fit_logistic(df: DataFrame, features: list[str], label: str, weight: str, ridge: float, minimum: int = 5):
    """A ridge logistic model, or None where either class has fewer rows than
    ``minimum``. ``ridge`` is the penalty per unit of total weight."""
    ok = df.where(F.col(label).isNotNull() & (F.col(weight) > 0)).na.fill(0.0, features)
    n = ok.agg(F.count_if(F.col(label) > 0), F.count_if(F.col(label) <= 0)).first()
    if min(n) < minimum:
        return None
    x = VectorAssembler(inputCols=features, outputCol="_x").transform(ok).withColumn("_y", (F.col(label) > 0).cast("double"))
    return LogisticRegression(featuresCol="_x", labelCol="_y", weightCol=weight, regParam=ridge, maxIter=100, tol=1e-8).fit(x)


def scored(model, df: DataFrame, features: list[str], name: str, held: str | None = None) -> DataFrame:
    """Probability of the class; one feature may be held at its median."""
    full = df.na.fill(0.0, features)
    if held:
        full = full.withColumn("_held", F.col(held)).withColumn(held, full.agg(F.percentile(held, 0.5).alias("_median")).scalar())
    # the model's own expression: no UDF, and nothing of the session is sent along
    odds = sum((float(c) * F.col(f) for c, f in zip(model.coefficients, features)), F.lit(float(model.intercept)))
    out = full.withColumn(name, 1 / (1 + F.exp(-odds)))
    if held:
        out = out.withColumn(held, F.col("_held"))
    return out.select(*df.columns, name)


def scaled(df: DataFrame, features: list[str]) -> DataFrame:
    """Features with mean 0 and deviation 1 (0 for constant ones), as an array column ``scaled``."""
    full = df.na.fill(0.0, features)
    m = full.agg(F.struct(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_samp(f).alias(f"s{i}") for i, f in enumerate(features)]).alias("_")).scalar()
    z = [F.when(m[f"s{i}"] > 0, (F.col(f) - m[f"m{i}"]) / m[f"s{i}"]).otherwise(0.0) for i, f in enumerate(features)]
    return full.withColumn("scaled", F.array(*z))


def feature_columns(df: DataFrame, kind: str, kinds: list[str], lists: dict[str, list[str]], counts: list[str]) -> DataFrame:
    """One-hot of ``kind``, multi-hot of array columns and logs of counts."""
    one = [(F.col(kind) == k).cast("double").alias(f"{kind}_{k}") for k in kinds]
    many = [F.coalesce(F.array_contains(c, v), F.lit(False)).cast("double").alias(f"{c}_{v}") for c, vs in lists.items() for v in vs]
    logs = [F.log1p(F.coalesce(F.col(c), F.lit(0)).cast("double")).alias(f"log_{c}") for c in counts]
    return df.select("*", *one, *many, *logs)


def damped_response(edges: DataFrame, seeds: DataFrame, gain: float = 0.5, rounds: int = 8, tolerance: float = 1e-6) -> DataFrame:
    """(seed, node, value): x = seeds + gain * A x, iterated until the change is
    small against the whole. edges(source, target, value), seeds(seed, node, value)."""
    ws = Workspace(edges.sparkSession, "response")
    start = ws.cut(seeds.groupBy("seed", "node").agg(F.sum("value").alias("value")))
    state = start
    for _ in range(rounds):
        sent = state.join(edges.withColumnRenamed("value", "_a"), state.node == edges.source).select("seed", F.col("target").alias("node"), (gain * F.col("value") * F.col("_a")).alias("value"))
        new = ws.cut(start.unionByName(sent).groupBy("seed", "node").agg(F.sum("value").alias("value")))
        j = new.join(state.withColumnRenamed("value", "_o"), ["seed", "node"], "full").select(F.coalesce("value", F.lit(0.0)).alias("v"), F.coalesce("_o", F.lit(0.0)).alias("o"))
        r = j.agg(F.sum((F.col("v") - F.col("o")) * (F.col("v") - F.col("o"))).alias("d"), F.sum(F.col("v") * F.col("v")).alias("n")).first()
        if state is not start:
            ws.drop(state)
        state = new
        if not r["n"] or (r["d"] / r["n"]) ** 0.5 < tolerance:
            break
    return state


def cone_in_degree(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(seed, node, degree): absolute weight into a node from sources its seed reaches.

    edges(source, target, weight), reached(seed, node)."""
    return reached.join(edges, reached.node == edges.source).groupBy("seed", F.col("target").alias("node")).agg(F.sum(F.abs("weight")).alias("degree"))


def normalised_by_target(edges: DataFrame) -> DataFrame:
    """Weights over the total weight into the target."""
    t = edges.groupBy("target").agg(F.sum(F.abs("weight")).alias("_t"))
    return edges.join(t, "target").withColumn("value", F.when(F.col("_t") > 0, F.col("weight") / F.col("_t")).otherwise(0.0)).drop("_t")


def seed_degrees(seeds: DataFrame, degrees: DataFrame) -> DataFrame:
    """(seed, degree): summed degree of each seed's nodes."""
    return seeds.join(degrees, "node").groupBy("seed").agg(F.sum("degree").alias("degree"))


