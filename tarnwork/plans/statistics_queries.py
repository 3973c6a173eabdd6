"""Statistics of counts, rates and means."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnwork.functions import stats as X
from tarnwork.plans.scalar_queries import _t


def _counts(spark, d):
    """Users by event types with all margins."""
    c = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("a"))
    m = c.groupBy("user_id").agg(F.sum("a").alias("u"))
    r = c.groupBy("event_type").agg(F.sum("a").alias("r"))
    n = c.agg(F.sum("a").alias("n")).scalar()
    return c.join(m, "user_id").join(r, "event_type").withColumn("n", n)


def t_contingency(spark, d):
    c = _counts(spark, d)
    t = X.two_by_two(F.col("a"), F.col("u"), F.col("r"), F.col("n"))
    low, high = X.odds_ratio_interval(*t)
    prr, chi = X.proportional_ratio(*t), X.yates_chi_square(*t)
    return c.select("user_id", "event_type", F.round(prr, 5).alias("prr"), F.round(X.odds_ratio(*t), 5).alias("ror"), F.round(low, 5).alias("ror_low"), F.round(high, 5).alias("ror_high"), F.round(chi, 5).alias("chi_square"),
        F.round(X.expected_count(F.col("u"), F.col("r"), F.col("n")), 5).alias("expected"), X.signal_verdict(F.col("a"), F.col("u"), prr, chi, high, F.lit(False), floor=20).alias("verdict"))


def t_shrunk(spark, d):
    c = _counts(spark, d)
    e = X.expected_count(F.col("u"), F.col("r"), F.col("n"))
    return c.select("user_id", "event_type", F.round(X.shrunk_log_ratio(F.col("a"), e), 5).alias("log_ratio"))


def t_gamma(spark, d):
    c = _counts(spark, d)
    e = X.expected_count(F.col("u"), F.col("r"), F.col("n"))
    return c.select("user_id", "event_type", X.gamma_interval(F.col("a").cast("double"), e).alias("g")).select("user_id", "event_type", "g.*")


def _arms(spark, d):
    li = _t(spark, d, "lineitem").groupBy("l_suppkey")
    r = F.col("l_returnflag") == "R"
    o = F.col("l_linestatus") == "O"
    return li.agg(F.count_if(r & o).alias("a1"), F.count_if(o).alias("n1"), F.count_if(r & ~o).alias("a2"), F.count_if(~o).alias("n2"))


def t_rates(spark, d):
    a1, n1, a2, n2 = (F.col(c) for c in ("a1", "n1", "a2", "n2"))
    (wl, wh), (nd, nl, nh), (le, ll, lh) = X.wilson(a1, n1), X.newcombe(a1, n1, a2, n2), X.log_risk_ratio(a1, n1, a2, n2)
    names = ("wilson_low", "wilson_high", "difference", "difference_low", "difference_high", "log_ratio", "log_ratio_low", "log_ratio_high")
    return _arms(spark, d).select("l_suppkey", *[F.round(x, 5).alias(n) for x, n in zip((wl, wh, nd, nl, nh, le, ll, lh), names)])


def t_welch(spark, d):
    r = F.col("l_returnflag") == "R"
    q = F.col("l_quantity")
    m = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(*[g(F.when(c, q)).alias(f"{n}{i}") for i, c in ((1, r), (2, ~r)) for n, g in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))])
    e, lo, hi = X.welch(*[F.col(f"{n}{i}") for i in (1, 2) for n in "msn"])
    v = X.interval_verdict(lo, hi, lo / F.col("s2"), hi / F.col("s2"), F.lit(True))
    return m.select("l_suppkey", F.round(e, 5).alias("difference"), F.round(lo, 5).alias("low"), F.round(hi, 5).alias("high"), v.alias("verdict"))


def t_regression(spark, d):
    o = _t(spark, d, "part").groupBy("p_brand").agg(F.round(F.regr_slope("p_retailprice", "p_size"), 4).alias("slope"), F.round(F.regr_intercept("p_retailprice", "p_size"), 3).alias("intercept"), F.min("p_size").cast("long").alias("low"), F.max("p_size").cast("long").alias("high"), F.count("*").alias("n"))
    return o


def t_noisy_or(spark, d):
    p = _t(spark, d, "target_pairs").where("left_target_id is not null and score is not null")
    return p.groupBy("left_target_id").agg(F.round(X.noisy_or(F.col("score"), F.lit(0.3)), 6).alias("probability"), F.round(F.max("score") / F.sum("score"), 6).alias("concentration"))


def t_losses(spark, d):
    p = _t(spark, d, "target_pairs").where("score is not null").withColumn("y", F.when(F.col("matched_on") == "sequence", 1).otherwise(0))
    return p.groupBy("y").agg(F.round(X.weighted_cross_entropy(F.col("score"), F.col("y"), F.lit(2.0), 0.95, 0.05), 6).alias("loss"), F.round(F.avg(X.bernoulli_divergence(F.lit(0.7), F.col("score"))), 6).alias("divergence"), F.round(F.sum(X.pseudo_count(F.col("score"))), 4).alias("pseudo"))


def t_median_shift(spark, d):
    f = lambda c: F.percentile(F.when(c, F.col("l_extendedprice")), 0.5)
    r = F.col("l_returnflag") == "R"
    w = lambda c: F.max(F.when(c, F.col("l_discount"))) - F.min(F.when(c, F.col("l_discount")))
    return _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(f(r) - f(~r), 4).alias("median_shift"), F.round(w(r) - w(~r), 6).alias("range_shift"))


def t_normal(spark, d):
    e = _t(spark, d, "events").select("event_id", "event_type", F.col("value"))
    m = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = e.join(m, "event_type").select("event_type", ((F.col("value") - F.col("m")) / F.col("s")).alias("z"))
    return z.groupBy("event_type").agg(F.round(F.avg(X.normal_cdf(F.col("z"))), 5).alias("mean_cdf"), F.round(F.max(X.normal_cdf(F.col("z"))), 5).alias("max_cdf"))


def t_shares_of_total(spark, d):
    c = _t(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    return c.select("l_partkey", F.round(F.col("q") / F.sum("q").over(Window.partitionBy()) * 1e6, 5).alias("per_million"))


QUERIES = {f.__name__: f for f in (t_contingency, t_shrunk, t_gamma, t_rates, t_welch, t_regression, t_noisy_or, t_losses, t_median_shift, t_normal, t_shares_of_total)}

_C = """c AS (SELECT user_id, event_type, count(*)::DOUBLE a FROM events GROUP BY 1, 2), q AS (SELECT *, sum(a) OVER (PARTITION BY user_id) u, sum(a) OVER (PARTITION BY event_type) r, sum(a) OVER () n FROM c),
z AS (SELECT *, u - a AS b, r - a AS c, n - u - r + a AS d FROM q)"""
_ARM = "x AS (SELECT l_suppkey, count_if(l_returnflag = 'R' AND l_linestatus = 'O')::DOUBLE a1, count_if(l_linestatus = 'O')::DOUBLE n1, count_if(l_returnflag = 'R' AND l_linestatus <> 'O')::DOUBLE a2, count_if(l_linestatus <> 'O')::DOUBLE n2 FROM lineitem GROUP BY 1)"


def _wil(a: str, n: str) -> tuple[str, str]:
    z = "1.959964::DOUBLE"
    c = f"(({a}/{n} + {z}*{z}/(2*{n})) / (1 + {z}*{z}/{n}))"
    h = f"({z}*sqrt({a}/{n}*(1-{a}/{n})/{n} + {z}*{z}/(4*{n}*{n}))/(1+{z}*{z}/{n}))"
    return f"greatest(0.0, {c} - {h})", f"least(1.0, {c} + {h})"


_L1, _U1 = _wil("a1", "n1")
_L2, _U2 = _wil("a2", "n2")

SQL = {
    "t_contingency": f"""WITH {_C}, y AS (SELECT *, CASE WHEN a + b <= 0 OR c + d <= 0 THEN NULL WHEN c <= 0 THEN CASE WHEN a > 0 THEN 'inf'::DOUBLE END ELSE (a / (a + b)) / (c / (c + d)) END AS prr, ln((a+.5)*(d+.5)/((b+.5)*(c+.5))) AS l, 1.96 * sqrt(1/(a+.5)+1/(b+.5)+1/(c+.5)+1/(d+.5)) AS h,
  CASE WHEN least(a+b, c+d, a+c, b+d) <= 0 THEN 0 ELSE n * pow(abs(a*d - b*c) - n / 2, 2) / ((a+b)*(c+d)*(a+c)*(b+d)) END AS chi FROM z)
SELECT user_id, event_type, round(prr, 5) AS prr, round(exp(l), 5) AS ror, round(exp(l - h), 5) AS ror_low, round(exp(l + h), 5) AS ror_high, round(chi, 5) AS chi_square, round(u * r / n, 5) AS expected, CASE WHEN prr >= 2 AND chi >= 4 AND a >= 3 THEN 1 WHEN exp(l + h) < 1 AND u >= 20 THEN 0 END AS verdict FROM y""",
    "t_shrunk": f"WITH {_C} SELECT user_id, event_type, round(ln((a + 0.5) / (u * r / n + 0.5)), 5) AS log_ratio FROM z",
    "t_rates": f"""WITH {_ARM}, w AS (SELECT *, {_L1} l1, {_U1} u1, {_L2} l2, {_U2} u2, CASE WHEN least(a1, n1 - a1, a2, n2 - a2) = 0 THEN 0.5 ELSE 0 END AS k FROM x),
v AS (SELECT *, ln(((a1 + k) / (n1 + 2 * k)) / ((a2 + k) / (n2 + 2 * k))) AS e, 1 / (a1 + k) - 1 / (n1 + 2 * k) + 1 / (a2 + k) - 1 / (n2 + 2 * k) AS s FROM w)
SELECT l_suppkey, round(l1, 5) AS wilson_low, round(u1, 5) AS wilson_high, round(a1/n1 - a2/n2, 5) AS difference, round(a1/n1 - a2/n2 - sqrt(pow(a1/n1 - l1, 2) + pow(u2 - a2/n2, 2)), 5) AS difference_low, round(a1/n1 - a2/n2 + sqrt(pow(u1 - a1/n1, 2) + pow(a2/n2 - l2, 2)), 5) AS difference_high,
  round(e, 5) AS log_ratio, round(e - 1.959963984540054 * sqrt(s), 5) AS log_ratio_low, round(e + 1.959963984540054 * sqrt(s), 5) AS log_ratio_high FROM v""",
    "t_welch": """WITH m AS (SELECT l_suppkey, avg(l_quantity) FILTER (l_returnflag = 'R') m1, stddev_samp(l_quantity) FILTER (l_returnflag = 'R') s1, count(*) FILTER (l_returnflag = 'R') n1, avg(l_quantity) FILTER (l_returnflag <> 'R') m2, stddev_samp(l_quantity) FILTER (l_returnflag <> 'R') s2, count(*) FILTER (l_returnflag <> 'R') n2 FROM lineitem GROUP BY 1),
e AS (SELECT *, m1 - m2 AS d, 1.959963984540054 * sqrt(s1*s1/n1 + s2*s2/n2) AS h FROM m)
SELECT l_suppkey, round(d, 5) AS difference, round(d - h, 5) AS low, round(d + h, 5) AS high, CASE WHEN d + h < 0 THEN 'relief' WHEN d - h > 0 THEN 'worsening' WHEN (d - h) / s2 >= -0.2 AND (d + h) / s2 <= 0.2 THEN 'no_effect' ELSE 'undecided' END AS verdict FROM e""",
    "t_regression": "SELECT p_brand, round(regr_slope(p_retailprice, p_size), 4) AS slope, round(regr_intercept(p_retailprice, p_size), 3) AS intercept, min(p_size)::BIGINT AS low, max(p_size)::BIGINT AS high, count(*) AS n FROM part GROUP BY 1",
    "t_noisy_or": "SELECT left_target_id, round(1 - exp(sum(ln(1 - score * 0.3)) + ln(0.99::DOUBLE)), 6) AS probability, round(max(score) / sum(score), 6) AS concentration FROM target_pairs WHERE left_target_id IS NOT NULL AND score IS NOT NULL GROUP BY 1",
    "t_losses": """WITH p AS (SELECT greatest(1e-7, least(1 - 1e-7, score)) q, score, CASE WHEN matched_on = 'sequence' THEN 1 ELSE 0 END y FROM target_pairs WHERE score IS NOT NULL)
SELECT y, round(avg(-(CASE WHEN y = 1 THEN 0.95 ELSE 0.05 END * ln(q) + (1 - CASE WHEN y = 1 THEN 0.95 ELSE 0.05 END) * ln(1 - q))), 6) AS loss, round(avg(0.7 * ln(0.7 / q) + 0.3 * ln(0.3 / (1 - q))), 6) AS divergence, round(sum(CASE WHEN score >= 1 THEN 100 ELSE least(score / (1 - score), 100) END), 4) AS pseudo FROM p GROUP BY 1""",
    "t_median_shift": "SELECT l_suppkey, round((quantile_cont(l_extendedprice, 0.5) FILTER (l_returnflag = 'R')) - (quantile_cont(l_extendedprice, 0.5) FILTER (l_returnflag <> 'R')), 4) AS median_shift, round(((max(l_discount) FILTER (l_returnflag = 'R')) - (min(l_discount) FILTER (l_returnflag = 'R'))) - ((max(l_discount) FILTER (l_returnflag <> 'R')) - (min(l_discount) FILTER (l_returnflag <> 'R'))), 6) AS range_shift FROM lineitem GROUP BY 1",
    "t_shares_of_total": "SELECT l_partkey, round(sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem) * 1e6, 5) AS per_million FROM lineitem GROUP BY 1",
}
