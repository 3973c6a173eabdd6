"""Folds, time splits, hold-outs, permutations and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.operators.positions import with_positions
from tarnwork.session import Workspace


#: Probabilities stay this far from 0 and 1.
EPSILON = 1e-6


def spread(key: Column, seed: int = 0) -> Column:
    """A number in [0, 2^32) that depends on the key and the seed only, the same in other engines."""
    return F.pmod((key.cast("long") + seed) * F.lit(2654435761).cast("long"), F.lit(4294967296).cast("long"))


def grouped_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, fold): groups largest first into the emptiest fold.

    Runs over the histogram of group sizes (a few thousand rows at most), then
    places the groups of a size by their position among them.
    """
    ws = Workspace(df.sparkSession, "folds")
    sized = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_size"))
    placed = ws.cut(with_positions(ws, sized, {"_pos": ("_size", None)}))
    fill = [0] * folds
    ranges = []
    for r in sorted(placed.groupBy("_size").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["_size"]):
        left, got = r["n"], [0] * folds
        while left:
            i = fill.index(min(fill))
            if max(fill) - min(fill) < r["_size"] and left > folds:
                turns = left // folds
                got = [g + turns for g in got]
                fill = [f + turns * r["_size"] for f in fill]
                left -= turns * folds
                continue
            got[i] += 1
            fill[i] += r["_size"]
            left -= 1
        ranges += [(r["_size"], i, sum(got[:i]), sum(got[: i + 1])) for i in range(folds) if got[i]]
    t = df.sparkSession.createDataFrame(ranges, "_s long, fold int, _lo long, _hi long")
    return placed.join(F.broadcast(t), (F.col("_size") == F.col("_s")) & (F.col("_pos") >= F.col("_lo")) & (F.col("_pos") < F.col("_hi"))).select(group, "fold")


def time_split(when: Column, cutoff: str) -> Column:
    """train up to the cutoff, test after it, null without a date."""
    return F.when(when <= F.lit(cutoff), "train").when(when > F.lit(cutoff), "test")


def without_partners(df: DataFrame, group: str, held: str) -> DataFrame:
    """Adds ``trains``: not held out, and no member of the group is."""
    per = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.max(F.col(held).cast("int")).alias("_h"))
    return df.join(per, group, "left").withColumn("trains", ~F.col(held) & (F.coalesce("_h", F.lit(0)) == 0)).drop("_h")


def straddling(df: DataFrame, group: str, inside: str) -> DataFrame:
    """Groups with members on both sides."""
    return df.groupBy(group).agg(F.min(F.col(inside).cast("int")).alias("_a"), F.max(F.col(inside).cast("int")).alias("_b")).where("_a <> _b").select(group)


def ranked_within(df: DataFrame, stratum: str | None, order: list[Column], name: str, weight: str | None = None) -> DataFrame:
    """Adds a row's position in its stratum by the order (or the sum of weights
    before it). The table is sorted in ranges and each task numbers its own rows,
    so a stratum may hold any share of them."""
    ws = Workspace(df.sparkSession, "ranked")
    cls = df.withColumn("_cls", F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit(""))
    return with_positions(ws, cls.orderBy(*order), {name: ("_cls", weight)}).drop("_cls")


def drawn_groups(df: DataFrame, stratum: str, group: str, size: str, share: float, order: Column) -> DataFrame:
    """Per stratum the groups, in the given order, until the share is reached."""
    run = ranked_within(df.select(stratum, group, size, order.alias("_o")), stratum, [F.col("_o"), F.col(group)], "_c", size)
    total = df.groupBy(stratum).agg(F.sum(size).alias("_t"))
    return run.join(total.withColumnRenamed(stratum, "_st"), F.col(stratum).eqNullSafe(F.col("_st"))).where(F.col("_c") < share * F.col("_t")).select(stratum, group, size)


def held_out_values(pairs: DataFrame, item: str, value: str, share: float, order: Column) -> DataFrame:
    """The shortest prefix of values, in the given order, that comes closest to
    touching the share of items: (value, position, items so far)."""
    ws = Workspace(pairs.sparkSession, "held")
    vals = ws.cut(ranked_within(pairs.select(value, order.alias("_o")).distinct(), None, [F.col("_o"), F.col(value)], "_p").select(value, (F.col("_p") + 1).alias("_p")))
    firsts = pairs.join(vals, value).groupBy(item).agg(F.min("_p").alias("_p"))
    n = firsts.groupBy("_p").agg(F.count("*").alias("_n"))
    run = vals.join(n, "_p", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    run = ws.cut(ranked_within(run, None, [F.col("_p")], "_before", "_n").select(value, "_p", (F.col("_before") + F.col("_n")).alias("touched")))
    total = run.agg(F.max("touched")).scalar()
    best = run.withColumn("_gap", F.abs(F.col("touched") - share * total)).agg(F.min_by("_p", F.struct("_gap", "_p")).alias("_best")).scalar()
    return run.where(F.col("_p") <= best).select(value, F.col("_p").alias("position"), "touched")


def permuted_within(df: DataFrame, key: str, stratum: str, columns: list[str], seed: int) -> DataFrame:
    """The columns moved to other rows of the same stratum: rows by key order
    take the values of rows by hashed order."""
    left = ranked_within(df.drop(*columns), stratum, [F.col(key)], "_i").withColumn("_st", F.col(stratum))
    right = ranked_within(df.select(key, stratum, *columns), stratum, [spread(F.col(key), seed), F.col(key)], "_i")
    right = right.select(F.col(stratum).alias("_rt"), *columns, F.col("_i").alias("_ri"))
    return left.join(right, F.col("_st").eqNullSafe(F.col("_rt")) & (F.col("_i") == F.col("_ri"))).drop("_i", "_ri", "_st", "_rt")


def base_rates(df: DataFrame, key: str, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("rate"), F.count("*").alias("n"))


def neighbour_scores(pairs: DataFrame, labels: DataFrame, key: str, shrink: float = 1.0) -> DataFrame:
    """(left_id, key, best, mean, shrunk): labels of neighbours pooled by the
    largest, the weighted mean and the mean shrunk to the base rate.
    ``pairs`` (left_id, right_id, shared), ``labels`` (right_id, key, label)."""
    rate = labels.groupBy(key).agg(F.avg("label").alias("_rate"))
    j = pairs.join(labels, "right_id").join(rate, key)
    return j.groupBy("left_id", key).agg(
        F.max("label").alias("best"), (F.sum(F.col("shared") * F.col("label")) / F.sum("shared")).alias("mean"),
        ((F.sum(F.col("shared") * F.col("label")) + shrink * F.first("_rate")) / (F.sum("shared") + shrink)).alias("shrunk"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa and the exact-match rate of two label columns (one row)."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    ra, rb = F.sum("n").over(Window.partitionBy(a)), F.sum("n").over(Window.partitionBy(b))
    c = t.select(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0).alias("_same"), "n", total.alias("_t"), (F.when(F.col(a) == F.col(b), ra * rb).otherwise(0)).alias("_e"))
    s = c.agg(F.sum("_same").alias("s"), F.max("_t").alias("t"), F.sum("_e").alias("e"))
    po, pe = F.col("s") / F.col("t"), F.col("e") / (F.col("t") * F.col("t"))
    return s.select(po.alias("exact_match"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def class_profiles(df: DataFrame, row: str, dim: str, value: str, cls: str) -> DataFrame:
    """(row, class, cosine) of each row's vector to each class mean, on long vectors."""
    m = df.groupBy(cls, dim).agg(F.sum(value).alias("_m"))
    norm = m.groupBy(cls).agg(F.sqrt(F.sum(F.col("_m") * F.col("_m"))).alias("_nm"))
    rn = df.groupBy(row).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_nr"))
    dots = df.select(row, dim, value).join(m.withColumnRenamed(cls, "class"), dim).groupBy(row, "class").agg(F.sum(F.col(value) * F.col("_m")).alias("_d"))
    return dots.join(rn, row).join(norm.withColumnRenamed(cls, "class"), "class").select(row, "class", F.when((F.col("_nr") > 0) & (F.col("_nm") > 0), F.col("_d") / (F.col("_nr") * F.col("_nm"))).otherwise(0.0).alias("cosine"))


def latent_reliability(
    matrix: DataFrame, item: list[str], source: str, group: str | None = None, rounds: int = 100, hits: tuple[float, float] = (8.0, 2.0), tolerance: float = 1e-6, held: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Posterior per item, sensitivity and specificity per source and prevalence
    per group by MAP expectation-maximisation over ``matrix`` (item, source,
    positive, negative, and the item's ``group`` if given).

    Rounds end once no posterior moves by the tolerance. The specificity of the
    sources in ``held`` stays at the prior's mean; so does that of a source
    whose rates fall to chance or below, and the fit is run again without it
    until there is none. The state is one row per item and source and is
    written every round; an item's rows, one per source, are summed by
    a window, and the sources' rates join by the optimizer's choice.

    Returns (item..., posterior), (source, sensitivity, specificity, held) and
    (group, prevalence).
    """
    ws = Workspace(matrix.sparkSession, "reliability")
    a, b = hits
    kind = F.col(group).cast("string") if group else F.lit("all")
    per = Window.partitionBy(*item)
    pos, neg = F.sum("positive").over(per), F.sum("negative").over(per)
    clip = lambda c: F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), c))
    vote = F.when(pos + neg > 0, pos / (pos + neg)).otherwise(0.5)
    base = ws.cut(matrix.select(*item, F.col(source).alias("_s"), kind.alias("_g"), "positive", "negative", F.count("*").over(per).alias("_k"), clip(vote).alias("_p")))
    fixed = held.select(F.col(source).alias("_s")).distinct() if held is not None else None

    def rates_of(state: DataFrame) -> DataFrame:
        p, both = F.col("_p"), F.col("positive") + F.col("negative")
        r = state.groupBy("_s").agg(
            clip((F.sum(p * F.col("positive")) + a - 1) / (F.sum(p * both) + a + b - 2)).alias("sensitivity"),
            clip((F.sum((1 - p) * F.col("negative")) + a - 1) / (F.sum((1 - p) * both) + a + b - 2)).alias("specificity"))
        if fixed is None:
            return r.withColumn("held", F.lit(False))
        r = r.join(fixed.withColumn("_f", F.lit(True)), "_s", "left").withColumn("held", F.coalesce("_f", F.lit(False))).drop("_f")
        return r.withColumn("specificity", F.when(F.col("held"), clip(F.lit(a / (a + b)))).otherwise(F.col("specificity")))

    def prevalence_of(state: DataFrame) -> DataFrame:
        return state.groupBy("_g").agg(((F.sum(F.col("_p") / F.col("_k")) + 1) / (F.sum(1 / F.col("_k")) + 2)).alias("prevalence"))

    while True:
        state, done = base, 0
        while True:
            j = state.join(rates_of(state), "_s").join(prevalence_of(state), "_g")
            se, sp, v = F.col("sensitivity"), F.col("specificity"), F.col("prevalence")
            told = F.sum(F.col("positive") * F.log(se / (1 - sp)) + F.col("negative") * F.log((1 - se) / sp)).over(per)
            j = j.withColumn("_new", 1 / (1 + F.exp(-(F.log(v / (1 - v)) + told))))
            new, seen = ws.measured(j.select(*item, "_s", "_g", "positive", "negative", "_k", F.col("_new").alias("_p"), F.abs(F.col("_new") - F.col("_p")).alias("_moved")), moved=F.max("_moved"))
            if state is not base:
                ws.drop(state)
            state, done = new, done + 1
            if done >= rounds or (seen["moved"] or 0.0) < tolerance:
                break
        rates, seen = ws.measured(rates_of(state), inverted=F.count_if(~F.col("held") & (F.col("sensitivity") + F.col("specificity") <= 1)))
        if not seen["inverted"]:
            break
        fixed = ws.cut(rates.where(F.col("held") | (F.col("sensitivity") + F.col("specificity") <= 1)).select("_s"))
        ws.drop(rates, state)
    posterior = state.groupBy(*item).agg(F.max("_p").alias("posterior"))
    groups = prevalence_of(state).select(F.col("_g").alias("group"), "prevalence")
    return posterior, rates.select(F.col("_s").alias(source), "sensitivity", "specificity", "held"), groups


def marginal_log_likelihood(matrix: DataFrame, item: list[str], source: str, rates: DataFrame, prevalence: Column) -> DataFrame:
    """Log likelihood of the weighted counts under the rates (one row). ``prevalence`` is an expression over the matrix's columns."""
    j = matrix.withColumn("_v", prevalence).join(rates.select(source, "sensitivity", "specificity"), source)
    clip = lambda c: F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), F.col(c)))
    se, sp = clip("sensitivity"), clip("specificity")
    per = j.groupBy(*item).agg(
        (F.log(F.max("_v")) + F.sum(F.col("positive") * F.log(se) + F.col("negative") * F.log(1 - se))).alias("_t"),
        (F.log(1 - F.max("_v")) + F.sum(F.col("positive") * F.log(1 - sp) + F.col("negative") * F.log(sp))).alias("_f"))
    top = F.greatest("_t", "_f")
    return per.agg(F.sum(top + F.log(F.exp(F.col("_t") - top) + F.exp(F.col("_f") - top))).alias("log_likelihood"))


def shortest_description(candidates: DataFrame, keys: list[str], name: str, parts: list[str]) -> DataFrame:
    """(keys, name, length): the candidate with the least sum of code lengths, ties
    by name; a candidate that lacks a part is none."""
    total = sum((F.col(p) for p in parts), F.lit(0.0))
    ok = candidates.where(total.isNotNull()).select(*keys, name, total.alias("_l"))
    return ok.groupBy(*keys).agg(F.min(F.struct("_l", name)).alias("x")).select(*keys, F.col(f"x.{name}").alias(name), F.col("x._l").alias("length"))


def posterior_weights(posterior: DataFrame, positive: DataFrame, rates: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """(keys, weight): scale times the posterior of pairs with a positive report; a
    fit with a source at or below chance is refused.
    posterior(keys, posterior), positive(keys), rates(source, sensitivity, specificity)."""
    bad = rates.where("sensitivity + specificity <= 1").agg(F.min(F.col("source").cast("string"))).scalar()
    w = F.when(bad.isNull(), F.col("posterior") * scale).otherwise(F.raise_error(F.concat(F.lit("source at or below chance: "), bad)).cast("double"))
    return posterior.join(positive.select(*keys).distinct(), keys, "left_semi").select(*keys, w.alias("weight"))


def module_sides(links: DataFrame, module: str, item: str, value: str, margin: float) -> DataFrame:
    """(item, module, above) where a module's link to an item exceeds the mean of the other modules' by the margin."""
    t = links.where(F.col(value).isNotNull()).groupBy(F.col(item).alias("_i")).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    j = links.join(t, F.col(item) == F.col("_i"))
    rest = F.when(F.col("_n") > 1, (F.col("_s") - F.col(value)) / (F.col("_n") - 1)).otherwise(0.0)
    return j.withColumn("above", F.col(value) - rest).where(F.col("above") > margin).select(item, module, "above")


def module_drivers(activations: DataFrame, module: str, unit: str, value: str, spread_: float, share: float) -> DataFrame:
    """(module, unit, value): units at or above a quantile of modules whose activation spreads by more than the bound."""
    q = activations.where(F.col(value).isNotNull()).groupBy(F.col(module).alias("_m")).agg(F.stddev_pop(value).alias("_sd"), F.percentile(value, share).alias("_q")).where(F.col("_sd") > spread_)
    return activations.join(q, F.col(module) == F.col("_m")).where(F.col(value) >= F.col("_q")).select(module, unit, value)


def checked(statements: DataFrame, predictions: DataFrame, tolerance: float) -> DataFrame:
    """(statement, difference, verdict): the mean difference of two predictions over
    the items a statement reads; judged kinds agree within the tolerance.
    statements(statement, item, reference, other, expected, judged), predictions(unit, item, value)."""
    a = predictions.select(F.col("unit").alias("reference"), "item", F.col("value").alias("_a"))
    b = predictions.select(F.col("unit").alias("other"), "item", F.col("value").alias("_b"))
    per = statements.join(a, ["reference", "item"]).join(b, ["other", "item"]).groupBy("statement").agg(F.avg(F.col("_b") - F.col("_a")).alias("difference"), F.max("expected").alias("_e"), F.max("judged").alias("_j"))
    met = F.when(F.col("_e") > 0, F.col("difference") > tolerance).when(F.col("_e") < 0, F.col("difference") < -tolerance).otherwise(F.abs("difference") <= tolerance)
    return per.select("statement", "difference", F.when(F.coalesce("_j", F.lit(False)), F.when(met, "met").otherwise("not met")).otherwise("not judged").alias("verdict"))


def paired_bootstrap(df: DataFrame, unit: str, key: str, first: str, second: str, label: str, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """(lower, mean, upper, above) of the macro average precision of the second
    score less that of the first, the units having the same weights in both (one row)."""
    from tarnwork.operators.ranking import bootstrap_macro

    ok = df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    a = bootstrap_macro(ok, unit, key, first, label, replicates, seed).withColumnRenamed("value", "_a")
    b = bootstrap_macro(ok, unit, key, second, label, replicates, seed).withColumnRenamed("value", "_b")
    d = a.join(b, "replicate").select((F.col("_b") - F.col("_a")).alias("d"))
    return d.agg(F.percentile("d", 0.025).alias("lower"), F.avg("d").alias("mean"), F.percentile("d", 0.975).alias("upper"), F.avg((F.col("d") > 0).cast("double")).alias("above"))
