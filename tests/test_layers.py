"""Carriage edges: brute force over shared binders, and no work on edges that are made."""

import random

import pytest

from tarnwork.operators import layers as L
from tarnwork.plans import registry


@pytest.mark.parametrize("spread, size", [(8, 256), (3, 2), (1, 1)])
def test_carriage_equals_brute_force(spark, spread, size):
    rng = random.Random(spread)
    some = lambda p, n: rng.choice([None, *(f"{p}{i}" for i in range(n))])
    carriage = [(some("m", 12), some("b", 4)) for _ in range(30)] * 2
    copies = [(some("m", 12), some("s", 15), rng.choice(["e", "c", None])) for _ in range(80)] * 2
    binders = [(some("b", 4), some("t", 20)) for _ in range(50)] * 2
    want = {(s, t, "carried_by", 1) for m, b in carriage for n, s, c in copies if m is not None and m == n and c == "e" for k, t in binders if b is not None and b == k and s is not None and t is not None}
    frames = spark.createDataFrame(carriage, "cargo string, binder string"), spark.createDataFrame(copies, "molecule string, node string, compartment string"), spark.createDataFrame(binders, "binder string, node string")
    got = [tuple(r) for r in L.carriage_edges(*frames, "e", spread, size).collect()]
    assert len(want) > 50 and len(got) == len(want) and set(got) == want


def test_carriage_neither_shuffles_nor_compares_edges(spark, data):
    """Every exchange and aggregate stands below the row generators, of which the last two make the edges."""
    plan = registry.queries()["l_carriage"](spark, data)._jdf.queryExecution().executedPlan().toString().splitlines()
    above = [x.strip(" :+-").split()[0] for x in plan[1:]]
    first = next(i for i, x in enumerate(above) if "Exchange" in x or "Aggregate" in x or "Join" in x)
    assert above[:first].count("Generate") == 2
