"""Joins with precedence, unions with fill, and one-row-per-key rules.

Rules that speak of the first or last row take an explicit order column, since
a distributed table has none; ties are broken by the remaining columns given.
Dimensions are left to the optimizer's size threshold, never forced to be
broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, by partial aggregation:
    no sort and no window, so a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*")


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*")


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of keys with exactly one distinct value."""
    return df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_m")).where(F.col(value) == F.col("_m")).drop("_m")


def inverse(df: DataFrame, key: str, values: str, name: str) -> DataFrame:
    """The inverse of a one-to-many map held in an array column, sorted."""
    return df.select(F.col(key), F.explode(values).alias(name)).groupBy(name).agg(F.sort_array(F.collect_set(key)).alias(key))


def precedence_join(base: DataFrame, routes: list[tuple[str, Column, DataFrame]], value: str) -> DataFrame:
    """``value`` and its route from the first route that finds one.

    A route is (name, key expression on base, frame with ``key`` and ``value``);
    a route's frame must hold each key once.
    """
    out = base
    found = []
    for i, (name, key, dim) in enumerate(routes):
        d = dim.select(F.col("key").alias(f"_k{i}"), F.col("value").alias(f"_v{i}"))
        out = out.withColumn(f"_q{i}", key).join(d, F.col(f"_q{i}") == F.col(f"_k{i}"), "left")
        found.append(F.when(F.col(f"_v{i}").isNotNull(), F.struct(F.col(f"_v{i}").alias("v"), F.lit(name).alias("r"))))
    picked = F.coalesce(*found)
    drop = [f"_{x}{i}" for i in range(len(routes)) for x in "qkv"]
    return out.withColumn(value, picked["v"]).withColumn(f"{value}_route", F.coalesce(picked["r"], F.lit("none"))).drop(*drop)


def salted_left_join(df: DataFrame, few: DataFrame, on: str, by: Column, salts: int = 8) -> DataFrame:
    """Left join with ``few``, which holds each key once and small shares of
    them: its rows are copied to ``salts`` keys, over which the rows of a hot
    key of ``df`` spread by the hash of ``by``."""
    many = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts))).join(many, [on, "_salt"], "left").drop("_salt")


def hot_left_join(df: DataFrame, dim: DataFrame, on: str, hot: DataFrame, by: Column, salts: int = 16) -> DataFrame:
    """Left join with ``dim``, which holds each key once. The rows of the keys in
    ``hot`` spread over ``salts`` keys by the hash of ``by``; ``hot`` is broadcast
    and must be bounded (keys of more than a fixed share of the rows are)."""
    mark = F.broadcast(hot.select(on, F.lit(True).alias("_hot")))
    left = df.join(mark, on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    right = dim.join(mark, on, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [on, "_salt"], "left").drop("_salt")


def fill_union(frames: list[DataFrame], fill: dict[str, object] | None = None) -> DataFrame:
    """Union by name; columns a frame lacks are null or take their fill value."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.na.fill(fill) if fill else out


def undirected(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def flagged(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds whether the row's keys occur in ``other``."""
    mark = other.select(*keys).distinct().withColumn("_f", F.lit(True))
    return df.join(mark, keys, "left").withColumn(name, F.coalesce("_f", F.lit(False))).drop("_f")


def counted_drops(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all rules, and the count of drops by the first rule broken.

    A rule is (reason, condition that drops); null does not drop.
    """
    reason = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules])
    marked = df.withColumn("_reason", reason)
    return marked.where("_reason is null").drop("_reason"), marked.where("_reason is not null").groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))


def compare_tables(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison: keys with added, removed, changed or same."""
    o = old.select(*keys, F.struct(*values).alias("_o"))
    n = new.select(*keys, F.struct(*values).alias("_n"))
    state = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o").eqNullSafe(F.col("_n")), "same").otherwise("changed")
    return o.join(n, keys, "full").select(*keys, state.alias("state"))


def shared_neighbours(left: DataFrame, right: DataFrame, on: str, left_id: str, right_id: str) -> DataFrame:
    """Pairs of a left and a right item sharing at least one value, with how many.

    Values held by items of both sides make the pairs, so the work is that of
    the shared values, not of all pairs.
    """
    a = left.select(F.col(left_id).alias("left_id"), on).distinct()
    b = right.select(F.col(right_id).alias("right_id"), on).distinct()
    return a.join(b, on).groupBy("left_id", "right_id").agg(F.count("*").alias("shared"))
