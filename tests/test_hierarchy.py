import random
from collections import defaultdict, deque

from tarnwork.operators.hierarchy import build_hierarchy, forest_paths, under_roots


def brute(edges, roots):
    edges = {(c, p) for c, p in edges if c is not None and p is not None}
    down = defaultdict(set)
    for c, p in edges:
        down[p].add(c)
    nodes = {x for e in edges for x in e}
    rows = set()
    for r in set(roots) & nodes:
        seen, q = {r: 0}, deque([r])
        while q:
            v = q.popleft()
            for c in down[v]:
                if c not in seen:
                    seen[c] = seen[v] + 1
                    q.append(c)
        rows |= {(r, t, d) for t, d in seen.items()}
    cyc = set()
    for n in nodes:
        seen, q = set(), deque(down[n])
        while q:
            v = q.popleft()
            if v in seen:
                continue
            seen.add(v)
            q.extend(down[v])
        if n in seen:
            cyc.add(n)
    return rows, cyc


def run(spark, edges, roots):
    h = build_hierarchy(spark.createDataFrame(edges, "child string, parent string, node string"))
    got = under_roots(h, spark.createDataFrame([(r,) for r in roots], "root string"))
    return h, {tuple(r) for r in got.select("root", "node", "depth").collect()}, {r[0] for r in h.cyclic.collect()}


def test_diamond_cycle_self_link_nulls_and_repeats(spark):
    edges = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("e", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("s", "s"), ("b", "a"), (None, "a"), ("q", None), ("y", "d")]
    edges = [(c, p, "extra") for c, p in edges]
    roots = ["a", "x", "nowhere", None]
    _, got, cyc = run(spark, edges, roots)
    want, wcyc = brute([e[:2] for e in edges], roots)
    assert got == want
    assert cyc == wcyc == {"x", "y", "z", "s"}


def test_random_graphs_equal_breadth_first_search(spark):
    rng = random.Random(7)
    names = [f"n{i:02d}" for i in range(40)]
    edges = [(names[i], names[rng.randrange(i)], "") for i in range(1, 40)]
    edges += [(rng.choice(names), rng.choice(names), "") for _ in range(9)]
    roots = names[:6]
    h, got, cyc = run(spark, edges, roots)
    want, wcyc = brute([e[:2] for e in edges], roots)
    assert got == want and cyc == wcyc
    for r in forest_paths(h, "/").collect():
        steps = r["path"].split("/")
        assert steps[-1] == r["node"] and steps[0] == r["root"] and len(steps) == r["depth"] + 1


def test_long_chain_and_empty_table(spark):
    edges = [(f"c{i:03d}", f"c{i - 1:03d}", "") for i in range(1, 70)]
    h, got, cyc = run(spark, edges, ["c000", "c050"])
    assert len(got) == 70 + 20 and ("c050", "c069", 19) in got and not cyc
    assert {r["node"]: r["size"] for r in h.nodes.collect()}["c000"] == 70
    _, none, cyc = run(spark, [], ["a"])
    assert none == set() and cyc == set()
