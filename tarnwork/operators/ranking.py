"""Ranks, bins, strata and ranking metrics, exact under ties.

Metrics first collapse rows to distinct scores per group, so the windows that
follow run over distinct scores, not over rows, and a hot group is reduced
before it is brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_levels(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """(keys, score, tp, n): positives and rows per distinct score; rows without score or label are left out."""
    ok = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return ok.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("tp"), F.count("*").alias("n"))


def _windows(keys: list[str]) -> tuple[Window, Window, Window]:
    part = Window.partitionBy(*keys)
    down = part.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    below = part.orderBy(F.col("score")).rowsBetween(Window.unboundedPreceding, -1)
    return part, down, below


def average_precision(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """(keys, average_precision, positives, rows): step-wise, thresholds at distinct scores; null without positives."""
    _, down, _ = _windows(keys)
    lv = score_levels(df, keys, score, label).withColumn("ctp", F.sum("tp").over(down)).withColumn("cn", F.sum("n").over(down))
    out = lv.groupBy(*keys).agg(F.sum(F.col("tp") * F.col("ctp") / F.col("cn")).alias("_s"), F.sum("tp").alias("positives"), F.sum("n").alias("rows"))
    return out.select(*keys, F.when(F.col("positives") > 0, F.col("_s") / F.col("positives")).alias("average_precision"), "positives", "rows")


def auroc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """(keys, auroc): share of concordant pairs, ties half; null without both classes."""
    _, _, below = _windows(keys)
    lv = score_levels(df, keys, score, label).withColumn("neg", F.col("n") - F.col("tp"))
    lv = lv.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    out = lv.groupBy(*keys).agg(F.sum(F.col("tp") * (F.col("below") + 0.5 * F.col("neg"))).alias("_c"), F.sum("tp").alias("_p"), F.sum("neg").alias("_q"))
    return out.select(*keys, F.when((F.col("_p") > 0) & (F.col("_q") > 0), F.col("_c") / (F.col("_p") * F.col("_q"))).alias("auroc"))


def stratified_auroc(df: DataFrame, keys: list[str], stratum: str, score: str, label: str) -> DataFrame:
    """Concordant pairs within strata over all pairs within strata."""
    k = [*keys, stratum]
    _, _, below = _windows(k)
    lv = score_levels(df, k, score, label).withColumn("neg", F.col("n") - F.col("tp")).withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    per = lv.groupBy(*k).agg(F.sum(F.col("tp") * (F.col("below") + 0.5 * F.col("neg"))).alias("c"), (F.sum("tp") * F.sum("neg")).alias("pairs"))
    return per.groupBy(*keys).agg((F.sum("c") / F.when(F.sum("pairs") > 0, F.sum("pairs"))).alias("stratified_auroc"))


def macro_over(df: DataFrame, keys: list[str], value: str, positives: str, rows: str, least: int) -> DataFrame:
    """Mean over groups with enough positives and at least one negative."""
    ok = df.where((F.col(positives) >= least) & (F.col(rows) > F.col(positives)))
    return ok.groupBy(*keys).agg(F.avg(value).alias(f"macro_{value}"), F.count("*").alias("groups"))


def positive_ranks(df: DataFrame, row: str, score: str, label: str, tie: str, k: int) -> DataFrame:
    """Per row: rank of its best positive by score, ties by ``tie``, and whether
    it is within k: the best positive comes from an aggregation, its rank from
    counting what stands before it, so no row's scores are sorted."""
    scored = df.where(F.col(score).isNotNull())
    best = scored.where(F.col(label) > 0).groupBy(row).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"))).alias("_b"))
    before = F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t")) <= F.col("_b")
    return scored.join(best, row).groupBy(row).agg(F.count_if(before).alias("best_rank")).withColumn("hit", F.col("best_rank") <= k)


def calibration_error(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins, the last one closed (one row)."""
    b = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("b"), F.col(score).alias("s"), F.when(F.col(label) > 0, 1.0).otherwise(0.0).alias("y"))
    per = b.groupBy("b").agg(F.count("*").alias("n"), F.abs(F.avg("s") - F.avg("y")).alias("gap"))
    return per.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("calibration_error"))


def average_rank_share(df: DataFrame, group: str, score: str, name: str = "rank_share") -> DataFrame:
    """Tie-averaged rank over (size + 1) within the group, from distinct scores."""
    lv = df.where(F.col(score).isNotNull()).groupBy(group, score).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    lv = lv.withColumn("_b", F.coalesce(F.sum("_n").over(w), F.lit(0))).withColumn("_t", F.sum("_n").over(Window.partitionBy(group)))
    lv = lv.select(group, score, ((F.col("_b") + (F.col("_n") + 1) / 2) / (F.col("_t") + 1)).alias(name))
    return df.join(lv, [group, score], "left")


def equal_count_bins(df: DataFrame, order: list[Column], bins: int, name: str = "bin") -> DataFrame:
    """floor(position * bins / rows) by the given order, exact at any size: each
    task numbers its own range of the sorted rows."""
    from tarnwork.operators.positions import with_positions
    from tarnwork.session import Workspace

    ws = Workspace(df.sparkSession, "bins")
    placed = with_positions(ws, df.orderBy(*order).withColumn("_one", F.lit(0)), {"_pos": ("_one", None)})
    total = df.agg(F.count("*").alias("_total")).scalar()
    return placed.withColumn(name, F.floor(F.col("_pos") * bins / total)).drop("_one", "_pos")


def quantile_strata(df: DataFrame, value: str, strata: int, name: str = "stratum") -> DataFrame:
    """Number of distinct inner quantile edges not above the value."""
    inner = [i / strata for i in range(1, strata)]
    edges = df.agg(F.percentile(value, inner).alias("_e")).scalar()
    passed = [(edges[i] <= F.col(value)) & (edges[i] != edges[i - 1] if i else F.lit(True)) for i in range(len(inner))]
    return df.withColumn(name, sum((F.when(p, 1).otherwise(0) for p in passed), F.lit(0)))


def order_statistic_flag(df: DataFrame, value: str, share: float, name: str) -> DataFrame:
    """Whether the value reaches the order statistic at floor(share * rows): distinct
    values are counted, and their running count is made in ranges of tasks."""
    from tarnwork.operators.evaluation import ranked_within

    lv = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    run = ranked_within(lv, None, [F.col(value)], "_before", "_n").withColumn("_c", F.col("_before") + F.col("_n"))
    place = F.floor(df.where(F.col(value).isNotNull()).agg(F.count("*")).scalar() * share)
    cut = run.where(F.col("_c") > place).agg(F.min(value)).scalar()
    return df.withColumn(name, F.col(value) >= cut)


def count_label(n: Column, largest: int = 3) -> Column:
    """none, one, two, ... and an open top bucket."""
    return F.when(n.isNull() | (n == 0), "0").when(n <= largest, n.cast("string")).otherwise(f"{largest + 1}+")


def simplex(df: DataFrame, group: str, value: str, name: str = "weight") -> DataFrame:
    """Projection of each group's values onto the probability simplex."""
    w = Window.partitionBy(group).orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, 0)
    lv = df.groupBy(group, value).agg(F.count("*").alias("_n"))
    lv = lv.withColumn("_k", F.sum("_n").over(w)).withColumn("_s", F.sum(F.col("_n") * F.col(value)).over(w))
    tau = lv.where(1 + F.col("_k") * F.col(value) > F.col("_s")).groupBy(group).agg(F.max_by((F.col("_s") - 1) / F.col("_k"), "_k").alias("_tau"))
    return df.join(tau, group).withColumn(name, F.greatest(F.col(value) - F.col("_tau"), F.lit(0.0))).drop("_tau")


def holm(df: DataFrame, p: str, key: str, alpha: float = 0.05) -> DataFrame:
    """Step-down decisions over a small table of hypotheses."""
    w = Window.orderBy(p, key)
    m = F.count("*").over(Window.partitionBy())
    r = df.withColumn("_i", F.row_number().over(w)).withColumn("_level", alpha / (m - F.col("_i") + 1))
    return r.withColumn("rejected", F.min(F.col(p) <= F.col("_level")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_i", "_level")


def bootstrap_macro(df: DataFrame, unit: str, key: str, score: str, label: str, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """Percentile bootstrap of the macro average precision over units: each unit
    gets a Poisson(1) weight per replicate from a hash, so no rows are copied."""
    u = (F.pmod(F.xxhash64(F.col(unit), F.col("replicate"), F.lit(seed)), F.lit(1_000_003)) + 0.5) / 1_000_003
    weight = sum((F.when(u > c, 1).otherwise(0) for c in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)), F.lit(0))
    reps = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    lv = reps.withColumn("_w", weight).where("_w > 0").groupBy("replicate", key, F.col(score).alias("score")).agg(F.sum(F.when(F.col(label) > 0, F.col("_w")).otherwise(0)).alias("tp"), F.sum("_w").alias("n"))
    _, down, _ = _windows(["replicate", key])
    lv = lv.withColumn("ctp", F.sum("tp").over(down)).withColumn("cn", F.sum("n").over(down))
    ap = lv.groupBy("replicate", key).agg(F.sum(F.col("tp") * F.col("ctp") / F.col("cn")).alias("s"), F.sum("tp").alias("p")).where("p > 0")
    return ap.groupBy("replicate").agg(F.avg(F.col("s") / F.col("p")).alias("value"))
