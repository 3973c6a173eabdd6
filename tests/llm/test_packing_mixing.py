import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwork.llm.mixing import expected_copies, mixture
from tarnwork.llm.packing import best_fit, complete, pack, solve
from tarnwork.llm.tokens import count_tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=40))
def test_search_keeps_items_and_capacity(sizes):
    hist = dict(Counter(sizes))
    for way in (best_fit, complete, solve):
        got = Counter()
        for p in way(hist, 20):
            assert p.times > 0 and sum(s * n for s, n in p.items.items()) <= 20
            for s, n in p.items.items():
                got[s] += n * p.times
        assert got == Counter(sizes)
    n = sum(p.times for p in solve(hist, 20))
    assert -(-sum(sizes) // 20) <= n <= sum(p.times for p in best_fit(hist, 20))


def test_bin_completion_beats_best_fit():
    # best fit decreasing needs 3 containers here, 2 suffice
    hist = {6: 1, 5: 1, 4: 2, 3: 2, 2: 1, 1: 1}
    total = sum(s * n for s, n in hist.items())
    assert sum(p.times for p in solve(hist, 14)) == -(-total // 14)


def test_pack_table(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 5, 9, 10, 11, 25, 30, None]), "x") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, n long, capacity string").repartition(6)
    got = pack(df.drop("capacity"), "id", "n", [10, 16]).collect()
    for c in (10, 16):
        part = [r for r in got if r["capacity"] == c]
        per = defaultdict(list)
        for r in part:
            per[r["id"]].append(r)
        assert set(per) == {i for i, *_ in rows}
        for i, n, _ in rows:
            assert sum(r["size"] for r in per[i]) == (n or 0)
            assert len(per[i]) == max(1, -(-(n or 0) // c)) and sorted(r["piece"] for r in per[i]) == list(range(len(per[i])))
            if not n:
                assert per[i][0]["container"] is None
        load = Counter()
        for r in part:
            if r["container"] is not None:
                load[r["container"]] += r["size"]
        assert max(load.values()) <= c and sorted(load) == list(range(len(load)))
    assert pack(df.drop("capacity").limit(0), "id", "n", [10]).count() == 0


def test_expected_copies():
    e = expected_copies({"a": 100, "b": 1000}, {"a": 0.5, "b": 0.5, "none": 0.2}, {"a": 2, "b": 1, "none": 5})
    assert e["a"] == pytest.approx(2) and e["b"] == pytest.approx(0.2)
    e = expected_copies({"a": 100, "b": 1000}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 1}, total=1000)
    assert e["a"] == 2 and e["b"] == pytest.approx(0.8)


def test_mixture(spark):
    rng = random.Random(8)
    rows = [(i, "big" if i % 3 else "small", rng.randrange(1, 40), "x") for i in range(3000)] + [(9001, None, 5, ""), (9002, "big", None, ""), (9003, "other", 3, "")]
    df = spark.createDataFrame(rows, "id long, source string, n long, copy string").repartition(5)
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2), ("absent", 0.1, 3)], "source string, target_share double, max_repeats long")
    emitted, report = mixture(df, "id", "source", "n", t)
    got = emitted.collect()
    per = Counter(r["id"] for r in got)
    src = {i: s for i, s, *_ in rows}
    assert all(per[i] <= (2 if src[i] == "small" else 1) for i in per) and not {9001, 9002, 9003} & set(per)
    rep = {r["source"]: r for r in report.collect()}
    assert abs(rep["big"]["actual_share"] - 0.5) < 0.01 and rep["absent"]["actual_share"] == 0
    assert rep["small"]["emitted_size"] == sum(r["n"] for r in got if r["source"] == "small")
    emitted, report = mixture(df.limit(0), "id", "source", "n", t)
    assert emitted.count() == 0 and report.count() == 3


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "a" * 20000)], "id long, text string")
    got = {r["id"]: r["n_tokens"] for r in count_tokens(df, "text").collect()}
    assert 2 <= got[1] <= 4 and got[2] == 0 and got[3] == 0 and got[4] > 100
