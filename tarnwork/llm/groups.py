"""Groups of records that are linked directly or through others.

Two ways to the same result:

``boruvka_groups`` - deterministic Boruvka hooking: every component selects its
smallest outgoing edge, the trees that arise collapse by pointer doubling,
edges are relabelled and deduplicated, until none remain. The number of
components with edges at least halves each round, so rounds are logarithmic.

``forest_groups`` - distributed union-find: each task reduces its edges to
local forests, which merge in ranges of the nodes' hashes. A range's task joins
the trees of its nodes; what that says of nodes of lower ranges is handed down
to their tasks, until nothing is handed down. Ranges are as many as keep
``task_limit`` edges in a task, so a task's share does not grow with the data.

Defined results: null ends and links of a node to itself link nothing; links
given again or the other way round count once; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.joins import hot_left_join, salted_left_join
from tarnwork.session import Workspace

#: A node with more than this share of the edges is hot; there are at most ``2 / HOT_SHARE`` of them.
HOT_SHARE = 1e-3


def _undirected(edges: DataFrame) -> DataFrame:
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct()


def _collapsed(ws: Workspace, tree: DataFrame) -> DataFrame:
    """(node, up) with every node's ``up`` at the top, by pointer doubling.

    Only tops that are not at the top themselves are looked up, once each, so a
    top of many nodes is no hot key.
    """
    while True:
        further = tree.select(F.col("node").alias("up"), F.col("up").alias("up2")).where("up <> up2")
        moved = tree.select("up").distinct().join(further, "up")
        new = salted_left_join(tree.select("node", "up"), moved, "up", F.col("node")).select("node", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("went"))
        new, seen = ws.measured(new, went=F.count_if("went"))
        ws.drop(tree)
        tree = new
        if not seen["went"]:
            return tree


def boruvka_groups(edges: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is one node of the group."""
    ws = ws or Workspace(edges.sparkSession, "boruvka")
    left, seen = ws.measured(_undirected(edges))
    total: DataFrame | None = None
    while seen["n"]:
        both = left.select(F.col("a").alias("node"), "a", "b").unionByName(left.select(F.col("b").alias("node"), "a", "b"))
        picked = both.groupBy("node").agg(F.min(F.struct("a", "b")).alias("e"), F.count("*").alias("n"))
        hooks = ws.cut(picked.select("node", F.when(F.col("node") == F.col("e.a"), F.col("e.b")).otherwise(F.col("e.a")).alias("up"), (F.col("n") > HOT_SHARE * seen["n"]).alias("hot")))
        # the two that chose each other: the smaller one is the root
        back = hooks.select(F.col("node").alias("up"), F.col("up").alias("node"), F.lit(True).alias("back"))
        tree = ws.cut(hooks.join(back, ["node", "up"], "left").select("node", F.when(F.col("back") & (F.col("node") < F.col("up")), F.col("node")).otherwise(F.col("up")).alias("up")))
        tree = _collapsed(ws, tree)
        hot = hooks.where("hot").select("node")
        new = left
        for end in ("a", "b"):
            other = "b" if end == "a" else "a"
            found = tree.select(F.col("node").alias(end), F.col("up").alias("_up"))
            new = hot_left_join(new, found, end, hot.withColumnRenamed("node", end), F.col(other)).select(F.col("_up").alias(end), other)
        new, seen = ws.measured(_undirected(new))
        ws.drop(left, hooks)
        left = new
        # the maps of the rounds so far are carried as one
        if total is None:
            total = tree.select("node", F.col("up").alias("root"))
            held = tree
        else:
            nxt = tree.select(F.col("node").alias("root"), F.col("up").alias("r"))
            composed = ws.cut(salted_left_join(total, nxt, "root", F.col("node")).select("node", F.coalesce("r", "root").alias("root")))
            ws.drop(held, tree)
            total = held = composed
    if total is None:
        return left.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    ws.drop(left)
    return total


def _local_forest(own: Callable[[str], int] | None, limit: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Union-find over one task's edges; gives each node with its tree's root and
    whether it is handed down to another range. Forests of more than ``limit``
    nodes are given out and begun anew."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[str, str] = {}
        mine: set[int] = set()

        def find(x: str) -> str:
            root = x
            while (p := up[root]) != root:
                root = p
            while (p := up[x]) != root:
                up[x], x = root, p
            return root

        def given() -> Iterator[pd.DataFrame]:
            nodes = [n for n in up if up[n] != n]
            for i in range(0, len(nodes), 50_000):
                part = nodes[i : i + 50_000]
                yield pd.DataFrame({"a": part, "b": [find(n) for n in part], "down": [own is not None and own(n) not in mine for n in part]})

        for pdf in batches:
            for a, b in zip(pdf["a"], pdf["b"]):
                up.setdefault(a, a)
                up.setdefault(b, b)
                ra, rb = find(a), find(b)
                if ra != rb:
                    lo, hi = (ra, rb) if ra < rb else (rb, ra)
                    up[hi] = lo
                if own is not None:
                    mine.add(own(a))
            if own is None and len(up) > limit:
                yield from given()
                up.clear()
        yield from given()

    return run


def _range_of(parts: int) -> Callable[[str], int]:
    return lambda node: int(node[:8], 16) * parts >> 32


def forest_groups(edges: DataFrame, task_limit: int = 1_000_000, ws: Workspace | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b)."""
    ws = ws or Workspace(edges.sparkSession, "forest")
    # a node is written with its hash before it, so that ranges of nodes are even
    keyed = lambda c: F.concat(F.lpad(F.hex(F.xxhash64(F.col(c).cast("string"))), 16, "0"), F.col(c).cast("string"))
    plain = lambda c: F.expr(f"substring({c}, 17)")
    given = edges.where("a is not null and b is not null and a <> b").select(keyed("a").alias("a"), keyed("b").alias("b"))
    ddl = "a string, b string, down boolean"
    forest, seen = ws.measured(given.mapInPandas(_local_forest(None, task_limit), ddl))
    while seen["n"]:
        # the rows of a node are in its range, whose share of the hashes is even
        parts = -(-seen["n"] // task_limit)
        part = F.floor(F.conv(F.substring("a", 1, 8), 16, 10).cast("decimal(20,0)") * parts / 4294967296).cast("int")
        merged = forest.select("a", "b", part.alias("_p")).repartitionById(parts, "_p").select("a", "b").mapInPandas(_local_forest(_range_of(parts), task_limit), ddl)
        new, seen = ws.measured(merged, down=F.count_if("down"))
        ws.drop(forest)
        forest = new
        if not seen["down"]:
            break
    tops = forest.select(F.col("b").alias("node"), F.col("b").alias("up")).distinct().join(forest.select(F.col("a").alias("node")), "node", "left_anti")
    tree = _collapsed(ws, ws.cut(forest.select(F.col("a").alias("node"), F.col("b").alias("up")).unionByName(tops)))
    ws.drop(forest)
    return tree.select(plain("node").alias("node"), plain("up").alias("root"))
