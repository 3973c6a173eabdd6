"""Graph operators over edge tables.

Frontier loops write their state every few rounds instead of keeping lineage,
carry only what changed, and end when nothing does. Edge columns are
``source``, ``target`` and where needed ``relation``, ``weight``, ``sign``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.session import Workspace


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse, distinct, without self loops."""
    e = edges.select("source", "target").where("source <> target")
    return e.union(e.select("target", "source")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, degree) over rows."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"), F.count("*").alias("degree"))


def reciprocity(edges: DataFrame, by: str = "relation") -> DataFrame:
    """Per relation: distinct edges and the share of them that have a reverse."""
    d = edges.select("source", "target", by).distinct()
    back = d.select(F.col("target").alias("source"), F.col("source").alias("target"), by).withColumn("_r", F.lit(1))
    j = d.join(back, ["source", "target", by], "left")
    return j.groupBy(by).agg(F.count("*").alias("edges"), (F.sum(F.coalesce("_r", F.lit(0))) / F.count("*")).alias("reverse_share"))


def duplicate_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows minus distinct rows (one row)."""
    per = edges.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.sum(F.col("n") - 1).alias("duplicates"))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node of the undirected component.

    Alternating large-star and small-star rounds (Kiveris et al. 2014), whose
    number is logarithmic in practice also on long paths. ``nodes`` adds
    isolated nodes.
    """
    ws = Workspace(edges.sparkSession, "components")
    sums = {f"h{i}": F.sum(F.xxhash64(F.lit(i), "u", "v").cast("decimal(38,0)")) for i in (1, 2)}
    cur, seen = ws.measured(edges.select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).where("u <> v").distinct(), **sums)
    while True:
        sym = cur.union(cur.select("v", "u"))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # large star: neighbours above a node go to its smallest neighbour
        large = large.union(cur.join(low.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(low2, "u")
        pairs = j.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low2.select("u", F.col("m").alias("v")))
        new, now = ws.measured(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), **sums)
        ws.drop(cur)
        cur = new
        if now == seen:  # as many links with the same sums of two hashes
            break
        seen = now
    out = cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select("v", "v").distinct())
    if nodes is not None:
        out = out.union(nodes.select("node", F.col("node").alias("component")).join(out.select("node"), "node", "left_anti"))
    return out.distinct()


def largest_component_share(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    sizes = components(edges, nodes).groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg((F.max("n") / F.sum("n")).alias("largest_share"), F.count("*").alias("components"))


def clusters_by_attributes(rows: DataFrame, member: str, attribute: str, hub: int) -> DataFrame:
    """(member, cluster): members that share an attribute, directly or through
    others; attributes of ``hub`` or more members link nothing. The cluster is
    named by its smallest member."""
    pairs = rows.select(F.col(member).alias("m"), F.col(attribute).alias("a")).where("m is not null").distinct()
    sizes = pairs.where("a is not null").groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") < hub)
    e = pairs.join(sizes, "a").select(F.concat(F.lit("m|"), "m").alias("source"), F.concat(F.lit("~|"), F.col("a").cast("string")).alias("target"))
    comp = components(e).where("node like 'm|%'").select(F.expr("substring(node, 3)").alias("m"), "component")
    named = comp.groupBy("component").agg(F.min("m").alias("cluster"))
    found = comp.join(named, "component").select("m", "cluster")
    return pairs.select("m").distinct().join(found, "m", "left").select(F.col("m").alias(member), F.coalesce("cluster", "m").alias("cluster"))


def reach(edges: DataFrame, seeds: DataFrame, steps: int | None = None) -> DataFrame:
    """(seed, node, hop): nodes reached from each seed along edges, the seed at
    hop 0, with the fewest hops; ``steps`` bounds them."""
    ws = Workspace(edges.sparkSession, "reach")
    e = edges.select("source", "target").distinct()
    seen = ws.cut(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop")).distinct())
    front, k = seen, 0
    while steps is None or k < steps:
        k += 1
        nxt = front.join(e, front.node == e.source).select("seed", F.col("target").alias("node")).distinct()
        front, now = ws.measured(nxt.join(seen, ["seed", "node"], "left_anti").withColumn("hop", F.lit(k)))
        if not now["n"]:
            break
        seen = seen.unionByName(front)
        if k % 8 == 0:  # one table again, so that the plan does not grow with the depth
            seen = ws.cut(seen)
    return seen


def closure_without(edges: DataFrame, roots: DataFrame, excluded: DataFrame) -> DataFrame:
    """(seed, node) under each root and not at or under one of its excluded nodes.

    ``edges`` lead downwards; ``roots`` (seed, node), ``excluded`` (seed, node)."""
    def under(r: DataFrame) -> DataFrame:
        tops = r.select(F.col("node").alias("seed")).distinct()
        return r.join(reach(edges, tops).select(F.col("seed").alias("node"), F.col("node").alias("below")), "node").select("seed", F.col("below").alias("node")).distinct()

    return under(roots).join(under(excluded), ["seed", "node"], "left_anti")


def normalised_adjacency(edges: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(source, target, weight): undirected, distinct, each source's weights sum to 1."""
    e = both_ways(edges)
    if excluded is not None:
        x = excluded.select("node")
        e = e.join(x, e.source == x.node, "left_anti").join(x, e.target == x.node, "left_anti")
    d = e.groupBy("source").agg(F.count("*").alias("_d"))
    return e.join(d, "source").select("source", "target", (1.0 / F.col("_d")).alias("weight"))


def walk_with_restart(adjacency: DataFrame, seeds: DataFrame, restart: float = 0.3, rounds: int = 50, dangling: bool = False, tolerance: float = 1e-9) -> DataFrame:
    """(seed, node, mass) after power iterations from ``seeds`` (seed, node).

    Rounds end early once no mass moves by more than the tolerance. With
    ``dangling`` the mass of nodes without a way out returns to the seeds.
    """
    ws = Workspace(adjacency.sparkSession, "walk")
    adjacency = ws.cut(adjacency.select("source", "target", "weight"))
    n = seeds.groupBy("seed").agg(F.count("*").alias("_n"))
    start = ws.cut(seeds.join(n, "seed").select("seed", "node", (1.0 / F.col("_n")).alias("mass")))
    state = start
    none = F.lit(0.0)
    for _ in range(rounds):
        moved = state.join(adjacency, state.node == adjacency.source).select("seed", F.col("target").alias("node"), (F.col("mass") * F.col("weight") * (1 - restart)).alias("mass"), none.alias("was"))
        back = start.select("seed", "node", (F.col("mass") * restart).alias("mass"), none.alias("was"))
        if dangling:
            stuck = state.join(adjacency.select(F.col("source").alias("node")).distinct(), "node", "left_anti").groupBy("seed").agg(F.sum("mass").alias("_m"))
            back = back.unionByName(start.join(stuck, "seed").select("seed", "node", (F.col("mass") * F.col("_m") * (1 - restart)).alias("mass"), none.alias("was")))
        old = state.select("seed", "node", none.alias("mass"), F.col("mass").alias("was"))
        new = moved.unionByName(back).unionByName(old).groupBy("seed", "node").agg(F.sum("mass").alias("mass"), F.sum("was").alias("was"))
        new, seen = ws.measured(new, gap=F.max(F.abs(F.col("mass") - F.col("was"))))
        if state is not start:
            ws.drop(state)
        state = new
        if seen["gap"] is None or seen["gap"] < tolerance:
            break
    return state.select("seed", "node", "mass").where("mass > 0")


def propagated_max(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(node, value): the largest value of a node's sources."""
    return edges.join(values, edges.source == values.node).groupBy(F.col("target").alias("node")).agg(F.max("value").alias("value"))


def widest_paths(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, width): the largest bottleneck of edge weights on a way from the
    seeds (node, width). Rounds end once no width grows."""
    ws = Workspace(edges.sparkSession, "widest")
    cur, seen = ws.measured(seeds.groupBy("node").agg(F.max(F.col("width").cast("double")).alias("width")).withColumn("fresh", F.lit(True)))
    while True:
        sent = cur.where("fresh").join(edges, cur.node == edges.source).select(F.col("target").alias("node"), F.least("width", "weight").alias("width"), F.lit(None).cast("double").alias("was"))
        both = cur.select("node", "width", F.col("width").alias("was")).unionByName(sent)
        new = both.groupBy("node").agg(F.max("width").alias("width"), F.max("was").alias("was")).where("width is not null")
        new, seen = ws.measured(new.select("node", "width", (F.col("was").isNull() | (F.col("width") > F.col("was"))).alias("fresh")), fresh=F.count_if("fresh"))
        ws.drop(cur)
        cur = new
        if not seen["fresh"]:
            return cur.select("node", "width")


def relation_adjacency(edges: DataFrame) -> DataFrame:
    """Signed weight over the number of edges into the target, per relation."""
    n = edges.groupBy("relation", "target").agg(F.count("*").alias("_n"))
    return edges.join(n, ["relation", "target"]).select("source", "target", "relation", (F.col("sign") * F.coalesce("weight", F.lit(1.0)) / F.col("_n")).alias("value"))


def spectral_radius(edges: DataFrame, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """Power iteration on the unsigned weights, started evenly, until the
    radius moves by less than the tolerance (one row). On a graph whose steps
    swing between two values the geometric mean of two steps is the radius."""
    ws = Workspace(edges.sparkSession, "radius")
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    state = ws.cut(nodes.withColumn("x", F.lit(1.0)))
    e = ws.cut(edges.groupBy("source", "target").agg(F.sum(F.abs("weight")).alias("w")))
    norm, last, radius = 1.0, 0.0, float("inf")
    for _ in range(rounds):
        # the state's length is divided out while it is read
        step = e.join(state, e.source == state.node).groupBy(F.col("target").alias("node")).agg(F.sum(F.col("w") * F.col("x") / norm).alias("x"))
        new, seen = ws.measured(step, square=F.sum(F.col("x") * F.col("x")))
        ws.drop(state)
        state, before, norm = new, last, (seen["square"] or 0.0) ** 0.5
        last = norm
        if norm == 0:
            radius = 0.0
            break
        was, radius = radius, (norm * before) ** 0.5
        if abs(radius - was) < tolerance:
            break
    return edges.sparkSession.createDataFrame([(float(radius),)], "radius double")


def complex_edges(interactions: DataFrame, source: str, target: str, sep: str = "_") -> DataFrame:
    """Members of complexes on both sides, exploded, self loops and repeats dropped."""
    from tarnwork.functions.scalars import members

    rest = [c for c in interactions.columns if c not in (source, target)]
    e = interactions.select(F.explode(members(F.col(source), sep)).alias("source"), F.col(target).alias("_t"), *rest).select("source", F.explode(members(F.col("_t"), sep)).alias("target"), *rest)
    return e.where("source <> target").dropDuplicates(["source", "target", *rest])


def swap_rewired(edges: DataFrame, rounds: int = 3, seed: int = 11) -> DataFrame:
    """Degree-preserving rewiring: in each round edges of a relation are paired
    at random, their targets swapped, and swaps dropped that make a self loop, an
    edge that exists, or one proposed twice. In- and out-degrees stay exact.
    """
    ws = Workspace(edges.sparkSession, "rewire")
    cur = ws.cut(edges.select("relation", "source", "target").distinct())
    for r in range(rounds):
        h = F.xxhash64("source", "target", "relation", F.lit(seed * 1000 + r))
        # random buckets of a few edges each, so that no relation is sorted in one task
        per = cur.groupBy("relation").agg(F.count("*").alias("_n"))
        b = cur.join(per, "relation").withColumn("_b", F.pmod(h, F.greatest(F.lit(1).cast("long"), F.col("_n") / 8).cast("long")))
        w = Window.partitionBy("relation", "_b").orderBy(h, "source", "target")
        b = b.withColumn("_r", F.row_number().over(w)).withColumn("_p", F.floor((F.col("_r") - 1) / 2))
        pairs = b.groupBy("relation", "_b", "_p").agg(F.collect_list(F.struct("source", "target")).alias("e")).where("size(e) = 2")
        prop = pairs.select("relation", "_b", "_p", F.explode(F.array(
            F.struct(F.col("e")[0]["source"].alias("source"), F.col("e")[1]["target"].alias("target")), F.struct(F.col("e")[1]["source"].alias("source"), F.col("e")[0]["target"].alias("target")))).alias("x")).select("relation", "_b", "_p", "x.*")
        seen = prop.groupBy("relation", "source", "target").agg(F.count("*").alias("_c"))
        bad = prop.join(seen, ["relation", "source", "target"]).join(cur.withColumn("_have", F.lit(1)), ["relation", "source", "target"], "left").where("_c > 1 or _have = 1 or source = target").select("relation", "_b", "_p").distinct()
        good = prop.join(bad, ["relation", "_b", "_p"], "left_anti")
        done = good.select("relation", "_b", "_p").distinct()
        kept = b.join(done, ["relation", "_b", "_p"], "left_anti").select("relation", "source", "target")
        new = ws.cut(kept.unionByName(good.select("relation", "source", "target")))
        ws.drop(cur)
        cur = new
    return cur


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for an empty union."""
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def set_overlaps(df: DataFrame, group: str, value: str) -> DataFrame:
    """(a, b, jaccard) of groups that share a value, from value co-occurrence."""
    d = df.select(group, value).distinct()
    n = d.groupBy(group).agg(F.count("*").alias("_n"))
    x = d.join(n, group)
    y = x.select(F.col(group).alias("b"), value, F.col("_n").alias("_nb"))
    x = x.select(F.col(group).alias("a"), value, F.col("_n").alias("_na"))
    s = x.join(y, value).where("a < b").groupBy("a", "b").agg(F.count("*").alias("_s"), F.first("_na").alias("_na"), F.first("_nb").alias("_nb"))
    return s.select("a", "b", (F.col("_s") / (F.col("_na") + F.col("_nb") - F.col("_s"))).alias("jaccard"))
