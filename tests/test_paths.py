"""Paths, depths and descendants over all links, second parents included."""

import random
from collections import defaultdict

from tarnwork.operators.hierarchy import build_hierarchy, descendants, rooted_paths


def test_paths_cover_every_root(spark):
    rng = random.Random(11)
    names = [f"n{i:02d}" for i in range(30)]
    links = {(names[i], names[rng.randrange(i)]) for i in range(3, 30)} | {(rng.choice(names[3:]), rng.choice(names)) for _ in range(14)}
    links = {(c, p) for c, p in links if c != p}
    h = build_hierarchy(spark.createDataFrame(sorted(links), "child string, parent string"))
    roots = [*names[:3], "n10"]
    below = defaultdict(set)
    for c, p in links:
        below[p].add(c)

    def reached(root):
        depth, queue = {root: 0}, [root]
        for n in queue:
            for c in below[n]:
                if c not in depth:
                    depth[c] = depth[n] + 1
                    queue.append(c)
        return depth

    known = {n for link in links for n in link}
    want = {(r, n, k) for r in roots if r in known for n, k in reached(r).items()}
    got = rooted_paths(h, spark.createDataFrame([(r,) for r in roots], "root string")).collect()
    assert {(r["root"], r["node"], r["depth"]) for r in got} == want and len(got) == len(want)
    for r in got:
        s = r["steps"]
        assert s[0] == r["root"] and s[-1] == r["node"] and len(s) == r["depth"] + 1 and all(b in below[a] for a, b in zip(s, s[1:]))
    assert {tuple(r) for r in descendants(h).collect()} == {(r, n, k) for r in known for n, k in reached(r).items()}
