"""Aggregations over report tables, all with partial aggregation before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.scalars import split_list
from tarnwork.functions.stats import tempered

#: Evidence classes, best first.
CLASS_RANK = {"monogenic": 0, "pharmacological": 1, "open_targets": 2, "human_association": 3, "animal": 4, "literature": 5}


def class_rank(c: Column) -> Column:
    out = None
    for k, v in CLASS_RANK.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(len(CLASS_RANK))


def listed(c: str | Column, sep: str = ";") -> Column:
    """Aggregate: the sorted distinct values, joined."""
    return F.array_join(F.sort_array(F.collect_set(c)), sep)


def observations(reports: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: counts by value, the first report of the best class,
    extremes, sums, dates, sorted distinct sources and reference counts."""
    positive = F.col("report_value") == 1
    refs = reports.where(positive).select(*keys, F.explode(split_list(F.col("references"))).alias("ref")).groupBy(*keys).agg(
        F.countDistinct("ref").alias("distinct_reference_count"), F.countDistinct(F.when(F.col("ref").startswith("PMID:"), F.col("ref"))).alias("distinct_pubmed_reference_count"))
    first = F.min_by(F.struct("evidence_class", "perturbation_type", "perturbation_label"), F.struct(class_rank(F.col("evidence_class")).alias("r"), F.col(order).alias("o")))
    per = reports.groupBy(*keys).agg(
        F.count("*").alias("report_count"), F.count_if(positive).alias("positive_report_count"), F.count_if(F.coalesce(~positive, F.lit(True))).alias("negative_report_count"), first.alias("first"),
        F.max(F.when(positive, F.col("frequency"))).alias("max_frequency"), F.sum(F.when(positive, F.col("frequency_denominator").cast("bigint"))).alias("patient_count"),
        F.min(F.when(positive, F.col("evidence_date"))).alias("evidence_date"), listed("source").alias("sources"),
    )
    return per.join(refs, keys, "left").select(*keys, "first.evidence_class", "first.perturbation_type", "report_count", "positive_report_count", "negative_report_count", "max_frequency", "patient_count", "evidence_date", "sources",
        F.coalesce("distinct_reference_count", F.lit(0)).alias("distinct_reference_count"), F.coalesce("distinct_pubmed_reference_count", F.lit(0)).alias("distinct_pubmed_reference_count"))


def max_of_means(df: DataFrame, keys: list[str], inner: str, value: str, name: str) -> DataFrame:
    """Per key the largest mean over the inner groups."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, inner).agg(F.avg(value).alias("_m")).groupBy(*keys).agg(F.max("_m").alias(name))


def count_matrix(reports: DataFrame, item: list[str], source: str, record: str, value: str, weight: Column) -> DataFrame:
    """(item..., source, positive, negative): the largest weight per record, then summed per source and sign."""
    per = reports.where(F.col(value).isNotNull()).groupBy(*item, source, record, value).agg(F.max(weight).alias("_w"))
    return per.groupBy(*item, source).agg(F.coalesce(F.sum(F.when(F.col(value) == 1, F.col("_w"))), F.lit(0.0)).alias("positive"), F.coalesce(F.sum(F.when(F.col(value) != 1, F.col("_w"))), F.lit(0.0)).alias("negative"))


def implicit_negatives(matrix: DataFrame, items: DataFrame, item: list[str], unit: list[str], source: str, weight: float) -> DataFrame:
    """The matrix with a weak no for items a source covers by their unit but is silent on."""
    covered = matrix.select(*unit, source).distinct()
    silent = items.select(*item).distinct().join(covered, unit).join(matrix.select(*item, source), [*item, source], "left_anti")
    return matrix.unionByName(silent.select(*item, source, F.lit(0.0).alias("positive"), F.lit(float(weight)).alias("negative")))


def record_key(pmid: Column | None, references: Column, source: Column, record: Column, report: Column) -> Column:
    """What makes two reports independent: the paper, else the source's record, else the report."""
    full = lambda c: F.when(F.trim(c) != "", c)
    first = F.trim(F.split_part(references, F.lit(";"), F.lit(1)))
    out = [F.when(first.startswith("PMID:"), first), F.concat(source, F.lit("|"), full(record)), report]
    return F.coalesce(*([F.concat(F.lit("PMID:"), F.trim(full(pmid)))] if pmid is not None else []), *out)


def soft_evidence(reports: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, class and direction: independent records and their sources."""
    r = reports.withColumn("direction", F.when(F.col("report_value") == 1, "positive").otherwise("negative")).withColumn(
        "_rec", record_key(None, F.col("references"), F.col("source"), F.col("source_record_id"), F.col("report_id")))
    return r.groupBy(*keys, "evidence_class", "direction").agg(F.countDistinct("_rec").alias("n_distinct"), listed("source").alias("sources"))


def resolved_pairs(evidence: DataFrame, keys: list[str], tiers: DataFrame, cap: float = 10.0, exponent: float = 0.5) -> DataFrame:
    """One row per key with a tier: the best class of an uncontested direction
    with its tempered strength; contested keys have no class."""
    t = evidence.join(tiers, ["evidence_class", "direction"])
    per = t.groupBy(*keys).agg(
        F.countDistinct("direction").alias("_d"), F.min_by(F.struct("evidence_class", "direction", "n_distinct", "probability", "unit_strength"), F.struct(class_rank(F.col("evidence_class")), F.col("evidence_class"))).alias("_b"))
    ok = F.col("_d") == 1
    return per.select(*keys, (~ok).alias("contested"), F.when(ok, F.col("_b.evidence_class")).alias("evidence_class"), F.when(ok, F.col("_b.direction")).alias("direction"),
        F.when(ok, F.col("_b.probability")).alias("probability"), F.when(ok, F.col("_b.unit_strength") * tempered(F.col("_b.n_distinct"), cap, exponent)).alias("strength"))


def pair_categories(reports: DataFrame, keys: list[str], value: str) -> DataFrame:
    """all_positive, all_negative, conflicting or unstated per key, from extremes."""
    per = reports.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return per.select(*keys, F.when(F.col("_lo").isNull(), "unstated").when(F.col("_lo") == 1, "all_positive").when(F.col("_hi") == 0, "all_negative").otherwise("conflicting").alias("category"))


def summary_counts(df: DataFrame, dims: list[str]) -> DataFrame:
    """Counts by each dimension alone and in total, in one pass of grouping sets.

    Columns: dimension, value, n. Null values are shown as ``<null>``.
    """
    exprs = ", ".join(f"`{d}`" for d in dims)
    sets = ", ".join([*(f"(`{d}`)" for d in dims), "()"])
    name = "CASE " + " ".join(f"WHEN grouping(`{d}`) = 0 THEN '{d}'" for d in dims) + " ELSE 'total' END"
    val = "CASE " + " ".join(f"WHEN grouping(`{d}`) = 0 THEN coalesce(cast(`{d}` AS string), '<null>')" for d in dims) + " ELSE 'all' END"
    return df.sparkSession.sql(f"SELECT {name} AS dimension, {val} AS value, count(*) AS n FROM {{t}} GROUP BY {exprs} GROUPING SETS ({sets})", t=df)


def heavy_values(df: DataFrame, value: str, member: str, least: int, name: str = "n") -> DataFrame:
    """Values with at least ``least`` distinct members."""
    return df.groupBy(value).agg(F.countDistinct(member).alias(name)).where(F.col(name) >= least)


def concentration(df: DataFrame, group: str, cluster: str, member: str, top: int) -> DataFrame:
    """Per group: clusters, distinct members and the share of the largest clusters."""
    per = df.groupBy(group, cluster).agg(F.countDistinct(member).alias("_n"))
    # sizes are few: their counts decide how many clusters of each size are among the largest
    sizes = per.groupBy(group, "_n").agg(F.count("*").alias("_k"))
    w = Window.partitionBy(group).orderBy(F.col("_n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.withColumn("_before", F.coalesce(F.sum("_k").over(w), F.lit(0))).withColumn("_in", F.least("_k", F.greatest(F.lit(0), F.lit(top) - F.col("_before"))))
    return s.groupBy(group).agg(F.sum("_k").alias("clusters"), F.sum(F.col("_k") * F.col("_n")).alias("members"), F.try_divide(F.sum(F.col("_in") * F.col("_n")), F.sum(F.col("_k") * F.col("_n"))).alias("top_share"))


def pivot_max(df: DataFrame, key: str, column: str, values: list, value: str) -> DataFrame:
    return df.groupBy(key).pivot(column, values).agg(F.max(value))


def most_common(df: DataFrame, key: str, value: str, catch_all: str | None = None) -> DataFrame:
    """The most frequent value per key, ties by value; a catch-all only where nothing else is."""
    per = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    low = (F.col(value) == catch_all) if catch_all is not None else F.lit(False)
    return per.groupBy(key).agg(F.min_by(value, F.struct(low, -F.col("_n"), F.col(value))).alias(value))


def equal_shares(df: DataFrame, key: str, values: str) -> DataFrame:
    """Each row counts as one, split equally over its values: (value, share of all)."""
    e = df.where(F.size(values) > 0).select(F.explode(values).alias("value"), (1.0 / F.size(values)).alias("_w"))
    per = e.groupBy("value").agg(F.sum("_w").alias("_s"))
    return per.select("value", (F.col("_s") / F.sum("_s").over(Window.partitionBy())).alias("share"))


def standardised(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """Population z-scores, within ``by`` if given; constant columns and nulls give 0.

    Moments come from one aggregation that is joined back, so no group is
    brought into one task.
    """
    keys = [by] if by else []
    moments = [F.avg(c).alias(f"_m_{c}") for c in columns] + [F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    if by:
        out = df.join(df.groupBy(*keys).agg(*moments), keys)
        part = F.col
    else:
        one = df.agg(F.struct(*moments).alias("_")).scalar()
        out, part = df, lambda n: one[n]
    return out.select(*[c for c in df.columns if c not in columns], *[F.coalesce((F.col(c) - part(f"_m_{c}")) / F.when(part(f"_s_{c}") > 0, part(f"_s_{c}")).otherwise(1.0), F.lit(0.0)).alias(c) for c in columns])


def trimmed_scale_factor(df: DataFrame, value: str, reference: str, log_trim: float = 0.3, level_trim: float = 0.05) -> DataFrame:
    """Double-trimmed mean of log ratios between a sample and its reference (one row)."""
    r = df.where(f"{value} > 0 and {reference} > 0").select(F.log2(F.col(value) / F.col(reference)).alias("m"), (0.5 * F.log2(F.col(value) * F.col(reference))).alias("a"))
    q = r.agg(F.struct(F.percentile("m", log_trim).alias("ml"), F.percentile("m", 1 - log_trim).alias("mh"), F.percentile("a", level_trim).alias("al"), F.percentile("a", 1 - level_trim).alias("ah")).alias("_")).scalar()
    return r.where(F.col("m").between(q["ml"], q["mh"]) & F.col("a").between(q["al"], q["ah"])).agg(F.pow(F.lit(2.0), F.avg("m")).alias("factor"), F.count("*").alias("kept"))
