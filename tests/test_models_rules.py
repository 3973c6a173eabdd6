import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.functions import rules as U
from tarnwork.functions import stats as X
from tarnwork.operators import evaluation as V
from tarnwork.operators import evidence as E
from tarnwork.operators import graph as G
from tarnwork.operators import models as M
from tarnwork.operators import ranking as R


def test_gene_rules(spark):
    v = {"a": 1.0, "b": 2.0, "c": 3.0}
    for rule, want in (("a and b or c", 3.0), ("a and (b or c)", 1.0), ("(a or b) and c", 2.0), ("x and b", 2.0), ("x or y", None), ("", None), ("((a))", 1.0), ("a and b and c", 1.0)):
        assert U.rule_value(rule, v) == want
    df = spark.createDataFrame([("a or b", ["a", "b"], [1.0, 4.0]), (None, ["a"], [1.0]), ("a", None, None)], "r string, n array<string>, v array<double>")
    assert [r[0] for r in df.select(U.gene_rule("r", "n", "v")).collect()] == [4.0, None, None]


def test_rules_raise_and_lists(spark):
    df = spark.createDataFrame([("a; b", "1;2")], "x string, y string")
    assert [(z.p, z.q) for z in df.select(U.aligned(F.col("x"), F.col("y"), "p", "q").alias("z")).first().z] == [("a", "1"), ("b", "2")]
    with pytest.raises(Exception, match="unequal length"):
        df.select(U.aligned(F.col("x"), F.lit("1"), "p", "q")).collect()
    with pytest.raises(Exception, match="no rule for"):
        df.select(U.decide([(F.col("x") == "z", 1)], unknown=F.col("x"))).collect()
    g = U.evidence_grade(F.lit("monogenic"), F.lit(True), F.lit(0.0), F.lit(3), F.lit(True), F.lit(1), F.lit(True), F.lit(True))
    assert df.select(g).first()[0] == "C"
    assert df.select(U.statement_type(F.array(F.lit("X-cause")), F.lit("induces")), U.statement_type(F.array(F.lit("CTD-curated")), F.lit("relieves")), U.statement_type(F.array(F.lit("plain")), F.lit("x"))).first()[:] == ("CAUSES", "AFFECTS", "COMENTION")
    with pytest.raises(ValueError, match="missing: q"):
        E.required(df, ["x", "q"])


def test_gamma_interval_against_reference_values(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 5.0), (None, 1.0)], "o double, e double")
    r = [x[0] for x in df.select(X.gamma_interval("o", "e")).collect()]
    # shape 10.5, rate 5.5: simulated quantiles
    s = np.log(np.quantile(np.random.default_rng(1).gamma(10.5, 1 / 5.5, 2_000_000), [0.025, 0.975]))
    assert abs(r[1]["lower"] - s[0]) < 5e-3 and abs(r[1]["upper"] - s[1]) < 5e-3 and 0.96 < r[1]["excess"] < 0.99 and r[2]["lower"] is None
    assert spark.range(1).select(X.normal_cdf(F.lit(1.959964))).first()[0] == pytest.approx(0.975, abs=1e-6)


def test_logistic_and_response(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 2))
    y = (rng.random(800) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(c), 1.0) for i, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, y int, w double")
    m = M.fit_logistic(df, ["a", "b"], "y", "w", 0.0)
    assert m.coefficients[0] > 1.3 and m.coefficients[1] < -0.5
    s = M.scored(m, df, ["a", "b"], "p", held="b")
    assert R.auroc(s, [], "p", "y").first()[0] > 0.75 and s.columns == [*df.columns, "p"]
    assert M.fit_logistic(df.where("y = 1"), ["a", "b"], "y", "w", 0.0) is None
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "source string, target string, value double")
    r = {t.node: t.value for t in M.damped_response(e, spark.createDataFrame([("s", "a", 2.0)], "seed string, node string, value double")).collect()}
    assert r == {"a": 2.0, "b": 1.0, "c": 0.5}
    assert M.feature_columns(spark.createDataFrame([("g", ["x"], 3)], "k string, l array<string>, n int"), "k", ["g", "d"], {"l": ["x", "y"]}, ["n"]).first()[3:] == (1.0, 0.0, 1.0, 0.0, pytest.approx(np.log(4)))


def test_rewiring_keeps_degrees(spark):
    rng = np.random.default_rng(5)
    e = {(f"r{k % 2}", f"s{rng.integers(12)}", f"t{rng.integers(12)}") for k in range(120)}
    df = spark.createDataFrame(list(e), "relation string, source string, target string")
    got = {tuple(r) for r in G.swap_rewired(df, rounds=3).select("relation", "source", "target").collect()}
    assert len(got) == len(e) and got != e and all(s != t for _, s, t in got)
    from collections import Counter

    for i in (1, 2):
        assert Counter((x[0], x[i]) for x in got) == Counter((x[0], x[i]) for x in e)


def test_folds_balance_and_keep_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"g{min(int(rng.exponential(8)), 30)}") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, grp string")
    f = {r.grp: r.fold for r in V.grouped_folds(df, "grp", 4).collect()}
    sizes = np.bincount([f[g] for _, g in rows], minlength=4)
    assert set(f) == {g for _, g in rows} and sizes.max() - sizes.min() <= 90
    assert V.grouped_folds(df.limit(0), "grp", 4).count() == 0


def test_walk_keeps_mass_and_bootstrap_is_stable(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source string, target string")
    w = G.walk_with_restart(G.normalised_adjacency(e), spark.createDataFrame([("s", "a")], "seed string, node string"), rounds=60)
    m = {r.node: r.mass for r in w.collect()}
    assert sum(m.values()) == pytest.approx(1) and m["a"] > m["c"] > m["d"]
    c = {r.node: r.component for r in G.components(e.union(spark.createDataFrame([("x", "y")], "source string, target string"))).collect()}
    assert c == {**dict.fromkeys("abcd", "a"), "x": "x", "y": "x"}
    long = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(100)], "source string, target string")
    assert {r.component for r in G.components(long).collect()} == {"n000"}
    assert G.components(e.limit(0)).count() == 0


def test_scaled_features(spark):
    df = spark.createDataFrame([(1.0, 5.0, "x"), (3.0, 5.0, "y"), (None, 5.0, "z")], "a double, b double, scaled_by string")
    got = np.array([r["scaled"] for r in M.scaled(df, ["a", "b"]).collect()])
    assert np.allclose(got[:, 0], (np.array([1, 3, 0]) - 4 / 3) / np.std([1, 3, 0], ddof=1)) and (got[:, 1] == 0).all()


def test_scoring_after_an_observed_write(spark):
    from tarnwork.session import Workspace

    Workspace(spark, "observed").measured(spark.range(3))
    df = spark.createDataFrame([(float(i % 7), int(i % 7 > 3), 1.0) for i in range(60)], "a double, y int, w double")
    m = M.fit_logistic(df, ["a"], "y", "w", 0.1)
    p = {r["a"]: r["p"] for r in M.scored(m, df, ["a"], "p").collect()}
    assert all(abs(p[a] - 1 / (1 + np.exp(-(m.coefficients[0] * a + m.intercept)))) < 1e-12 for a in p)


def test_malformed_rules_raise_and_normal_tail(spark):
    for bad in ("(a and b", "a and b)", "a and", "or a", "a b", "()", "a and and b", "(a) b"):
        with pytest.raises(ValueError):
            U.rule_value(bad, {"a": 1.0, "b": 2.0})
    assert U.rule_value("", {}) is None and U.rule_value("a OR (b and c)", {"a": 1.0, "b": 5.0, "c": 4.0}) == 4.0
    from math import erf, sqrt

    from pyspark.sql import functions as F

    from tarnwork.functions.stats import normal_cdf

    z = [-3.0, -1.0, 0.0, 0.5, 2.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(normal_cdf(F.col("z"))).collect()]
    assert all(abs(g - 0.5 * (1 + erf(x / sqrt(2)))) < 2e-7 for g, x in zip(got, z))
