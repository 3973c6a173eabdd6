import random

from tarnwork.llm.consensus import consensus


def rows_of(seed=1, n=1500):
    rng = random.Random(seed)
    skill = {"a": 0.95, "b": 0.9, "c": 0.85, "bad": 0.25, "coin": 0.5}
    truth, rows = {}, []
    for i in range(n):
        truth[i] = rng.random() < 0.5
        seen = {}
        for s in rng.sample(sorted(skill), 4):
            seen[s] = truth[i] if rng.random() < skill[s] else not truth[i]
        if "coin" in seen:  # copies the coin
            seen["copy"] = seen["coin"]
        rows += [(i, s, int(v), "x") for s, v in seen.items()]
    return truth, rows


def test_planted_truth_and_reliability(spark):
    truth, rows = rows_of()
    df = spark.createDataFrame(rows, "item long, who string, label int, votes string")
    per, rel = consensus(df, ["item"], "who", "label", 1)
    got = {r["item"]: r for r in per.collect()}
    assert set(got) == set(truth)
    assert sum(got[i]["consensus"] == t for i, t in truth.items()) / len(truth) > 0.9
    r = {x["annotator"]: x for x in rel.collect()}
    assert r["a"]["reliability"] > 0.85 and r["bad"]["reliability"] < 0.4 and 0.4 < r["coin"]["reliability"] < 0.6
    assert r["coin"]["voice"] == r["copy"]["voice"] != r["a"]["voice"]
    # the majority is misled where the coin and its copy agree
    assert all(0 <= x["agreement"] <= 1 and 0.5 <= x["certainty"] <= 1 for x in got.values())


def test_nulls_ties_and_empty(spark):
    rows = [(1, "a", 1, 0), (1, None, 1, 0), (1, "b", None, 0), (2, "a", 1, 0), (2, "a", 0, 0), (2, "b", 0, 0), (3, "b", None, 0)]
    df = spark.createDataFrame(rows, "item long, who string, label int, extra int")
    per, rel = consensus(df, ["item"], "who", "label", 1)
    got = {r["item"]: r["n_annotators"] for r in per.collect()}
    assert got == {1: 1, 2: 2}
    per, rel = consensus(df.limit(0), ["item"], "who", "label", 1)
    assert per.count() == 0 and rel.count() == 0
