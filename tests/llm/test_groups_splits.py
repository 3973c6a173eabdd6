import random
from collections import Counter, defaultdict

from tarnwork.llm.groups import boruvka_groups, forest_groups
from tarnwork.llm.splits import blocks, greedy_by_size, grouped_split
from tarnwork.session import Workspace


def components(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    out = defaultdict(set)
    for x in list(up):
        out[find(x)].add(x)
    return {frozenset(v) for v in out.values() if len(v) > 1}


def grouped(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r["root"]].add(r["node"])
    assert all(r in m for r, m in out.items())
    return {frozenset(v) for v in out.values()}


def cases():
    rng = random.Random(3)
    yield [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)]
    yield [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(64)]  # a long chain
    yield [("hub", f"s{i}") for i in range(50)] + [("s1", "hub"), ("s1", "s1"), ("z", None), (None, None), ("hub", "s3")]
    yield []


def test_both_ways_equal_brute_force(spark):
    for edges in cases():
        df = spark.createDataFrame([(a, b, 1) for a, b in edges], "a string, b string, node int").repartition(5)
        want = components(edges)
        assert grouped(boruvka_groups(df)) == want
        assert grouped(forest_groups(df)) == want
        assert grouped(forest_groups(df, task_limit=7)) == want  # many ranges


def test_tables_of_earlier_rounds_are_freed(spark):
    df = spark.createDataFrame([(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)], "a string, b string")
    for way in (boruvka_groups, forest_groups):
        ws = Workspace(spark, "freed")
        assert grouped(way(df, ws=ws)) == {frozenset(f"p{i:03d}" for i in range(61))}
        assert ws.tables <= 2


def test_ids_of_any_length_stay_apart(spark):
    long = "x" * 2000
    df = spark.createDataFrame([(long + "1", "a"), (long + "2", "b")], "a string, b string")
    for way in (boruvka_groups, forest_groups):
        assert grouped(way(df)) == {frozenset({long + "1", "a"}), frozenset({long + "2", "b"})}


def test_blocks_and_split(spark):
    rng = random.Random(5)
    rows = [(i, f"p{rng.randrange(150)}" if rng.random() < 0.9 else None, f"g{rng.randrange(60)}" if rng.random() < 0.3 else None, "x") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, p string, g string, key string")
    got = {r["key"]: r["first"] for r in blocks(df, "id", ["p", "g"], Workspace(spark, "t")).collect()}
    want = components([(f"i{i}", f"p{p}") for i, p, _, _ in rows if p] + [(f"i{i}", f"g{g}") for i, _, g, _ in rows if g])
    first = {}
    for c in want:
        items = [int(x[1:]) for x in c if x[0] == "i"]
        first.update({i: min(items) for i in items})
    assert got == {i: first.get(i, i) for i, *_ in rows}
    split = grouped_split(df, "id", ["p", "g"], {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert len(split) == 400 and {r["id"]: r["first"] for r in split} == got
    assert all(len({r["split"] for r in split if r["first"] == f}) == 1 for f in set(got.values()))
    odd = spark.createDataFrame([(None, "p", None), (1, "p", None), (1, "p", None), (2, None, None), (3, None, "p")], "id long, p string, g string")
    assert sorted((r["id"], r["first"]) for r in grouped_split(odd, "id", ["p", "g"], {"a": 0.5, "b": 0.5}).collect()) == [(1, 1), (1, 1), (2, 2), (3, 3)]
    assert grouped_split(df.limit(0), "id", ["p", "g"], {"a": 1.0}).count() == 0


def test_greedy_equals_one_by_one():
    rng = random.Random(2)
    for _ in range(30):
        hist = Counter(rng.randrange(1, 30) for _ in range(rng.randrange(1, 200)))
        shares = [0.8, 0.1, 0.1]
        got = greedy_by_size(dict(hist), shares)
        assert all(sum(v) == hist[s] for s, v in got.items())
        total = sum(s * n for s, n in hist.items())
        need = [x * total for x in shares]
        for s in sorted(hist, reverse=True):
            for _ in range(hist[s]):
                i = need.index(max(need))
                need[i] -= s
        need2 = [x * total - sum(s * v[i] for s, v in got.items()) for i, x in enumerate(shares)]
        assert max(map(abs, need2)) <= max(map(abs, need)) + max(hist)
