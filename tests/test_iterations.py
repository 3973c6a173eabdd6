"""Operators that run to a fixed point, against plain loops."""

import random
from types import SimpleNamespace

import numpy as np
import pytest

from tarnwork.operators.evaluation import latent_reliability, marginal_log_likelihood, ranked_within
from tarnwork.operators.graph import reach, spectral_radius, walk_with_restart, widest_paths
from tarnwork.session import Workspace, shared_dir
from pyspark.sql import functions as F


def plain_fit(pos, neg, groups, rounds=100, tol=1e-6):
    """Expectation-maximisation on dense arrays, with sources at or below chance held."""
    clip = lambda x: np.clip(x, 1e-6, 1 - 1e-6)
    both, s = pos + neg, pos.shape[1]
    held = np.zeros(s, bool)
    while True:
        post = clip(np.where(both.sum(1) > 0, pos.sum(1) / np.maximum(both.sum(1), 1e-9), 0.5))
        for _ in range(rounds):
            prev = {g: (post[groups == g].sum() + 1) / ((groups == g).sum() + 2) for g in set(groups)}
            v = np.array([prev[g] for g in groups])
            se = clip(((post[:, None] * pos).sum(0) + 7) / ((post[:, None] * both).sum(0) + 8))
            sp = clip((((1 - post)[:, None] * neg).sum(0) + 7) / (((1 - post)[:, None] * both).sum(0) + 8))
            sp = np.where(held, 0.8, sp)
            odds = np.log(v / (1 - v)) + (pos * np.log(se / (1 - sp)) + neg * np.log((1 - se) / sp)).sum(1)
            new = 1 / (1 + np.exp(-odds))
            moved, post = np.abs(new - post).max(), new
            if moved < tol:
                break
        bad = ~held & (se + sp <= 1)
        if not bad.any():
            return post, se, sp, held, prev
        held |= bad


def test_reliability_equals_plain_fit(spark):
    rng = np.random.default_rng(3)
    n, skill = 120, [0.9, 0.8, 0.7, 0.15]
    truth, groups = rng.random(n) < 0.4, np.array(["a" if i % 3 else "b" for i in range(n)])
    pos, neg = np.zeros((n, 4)), np.zeros((n, 4))
    rows = []
    for i in range(n):
        for s in range(4):
            says = truth[i] if rng.random() < skill[s] else not truth[i]
            w = float(rng.integers(1, 3))
            (pos if says else neg)[i, s] = w
            rows.append((int(i), f"s{s}", str(groups[i]), float(pos[i, s]), float(neg[i, s]), "x"))
    df = spark.createDataFrame(rows, "item long, who string, kind string, positive double, negative double, held string")
    post, rates, prevalence = latent_reliability(df, ["item"], "who", "kind")
    want, se, sp, held, prev = plain_fit(pos, neg, groups)
    got = {r["item"]: r["posterior"] for r in post.collect()}
    assert max(abs(got[i] - want[i]) for i in range(n)) < 1e-4
    r = {x["who"]: x for x in rates.collect()}
    for s in range(4):
        assert abs(r[f"s{s}"]["sensitivity"] - se[s]) < 1e-3 and abs(r[f"s{s}"]["specificity"] - sp[s]) < 1e-3 and r[f"s{s}"]["held"] == held[s]
    assert all(abs(x["prevalence"] - prev[x["group"]]) < 1e-3 for x in prevalence.collect())
    one = marginal_log_likelihood(df, ["item"], "who", df.select("who").distinct().select("who", F.lit(0.7).alias("sensitivity"), F.lit(0.6).alias("specificity")), F.lit(0.3)).first()[0]
    t = np.log(0.3) + pos.sum(1) * np.log(0.7) + neg.sum(1) * np.log(0.3)
    f = np.log(0.7) + pos.sum(1) * np.log(0.4) + neg.sum(1) * np.log(0.6)
    assert abs(one - np.logaddexp(t, f).sum()) < 1e-6
    assert latent_reliability(df.limit(0), ["item"], "who")[0].count() == 0


def test_radius_walk_widest_and_reach(spark):
    rng = random.Random(8)
    m = np.zeros((12, 12))
    for _ in range(30):
        a, b = rng.sample(range(12), 2)
        m[a, b] = m[b, a] = rng.random()
    e = spark.createDataFrame([(f"n{a}", f"n{b}", float(m[a, b])) for a in range(12) for b in range(12) if m[a, b]], "source string, target string, weight double")
    assert abs(spectral_radius(e).first()[0] - max(abs(np.linalg.eigvalsh(m)))) < 1e-4
    # a path is bipartite, so single steps never settle
    p = np.diag(np.ones(5), 1) + np.diag(np.ones(5), -1)
    path = spark.createDataFrame([(f"p{a}", f"p{b}", 1.0) for a in range(6) for b in range(6) if p[a, b]], "source string, target string, weight double")
    assert abs(spectral_radius(path).first()[0] - max(abs(np.linalg.eigvalsh(p)))) < 1e-4
    t = m / m.sum(1, keepdims=True)
    mass = start = np.eye(12)[0]
    for _ in range(50):
        mass = 0.7 * mass @ t + 0.3 * start
    adj = spark.createDataFrame([(f"n{a}", f"n{b}", float(t[a, b])) for a in range(12) for b in range(12) if m[a, b]], "source string, target string, weight double")
    got = {r["node"]: r["mass"] for r in walk_with_restart(adj, spark.createDataFrame([("s", "n0")], "seed string, node string")).collect()}
    assert all(abs(got.get(f"n{i}", 0.0) - mass[i]) < 1e-6 for i in range(12))
    chain = spark.createDataFrame([(f"c{i:02d}", f"c{i + 1:02d}", 1.0 - i / 1000) for i in range(60)], "source string, target string, weight double")
    wide = {r["node"]: r["width"] for r in widest_paths(chain, spark.createDataFrame([("c00", 2.0)], "node string, width double")).collect()}
    assert len(wide) == 61 and wide["c60"] == 1.0 - 59 / 1000
    assert reach(chain, spark.createDataFrame([("c00",)], "seed string")).where("hop = 60").count() == 1


def test_positions_in_hot_strata(spark):
    df = spark.createDataFrame([(i, "hot" if i % 5 else None, (i * 7919) % 1000) for i in range(1000)], "id int, s string, o int").repartition(4)
    got = {r["id"]: r["k"] for r in ranked_within(df, "s", [F.col("o")], "k").collect()}
    for hot in (True, False):
        order = sorted((i for i in range(1000) if bool(i % 5) == hot), key=lambda i: (i * 7919) % 1000)
        assert [got[i] for i in order] == list(range(len(order)))


def test_workspace_holds_what_is_there(spark):
    ws = Workspace(spark, "held")
    a, b = ws.cut(spark.range(3)), ws.cut(spark.range(4))
    c, seen = ws.measured(spark.range(10), top=F.max("id"))
    assert seen == {"n": 10, "top": 9} and ws.tables == 3
    ws.drop(a.select("id"))  # a derived frame is no table
    assert ws.tables == 3 and a.count() == 3
    ws.drop(a, None, c)
    assert ws.tables == 1 and b.count() == 4


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda k, d="": d)
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
        with pytest.raises(ValueError):
            shared_dir(spark)


def test_paired_bootstrap(spark):
    from tarnwork.operators.evaluation import paired_bootstrap

    rng = random.Random(2)
    rows = [(i, "abc"[i % 3], rng.random(), (y := int(rng.random() < 0.4)), y + rng.random() * 0.9) for i in range(120)]
    df = spark.createDataFrame([(i, k, a, b, y) for i, k, a, y, b in rows], "id int, kind string, a double, b double, y int")
    same = paired_bootstrap(df, "id", "kind", "a", "a", "y", 40).first()
    assert tuple(same) == (0.0, 0.0, 0.0, 0.0)
    better = paired_bootstrap(df, "id", "kind", "a", "b", "y", 40).first()
    assert better["lower"] > 0 and better["above"] == 1.0 and better["lower"] <= better["mean"] <= better["upper"]
