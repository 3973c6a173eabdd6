"""Layers of a typed graph: nodes and edges generated from tables of reactions,
small molecules, regulation and carriage, and the extensions that add to them.

Nodes have ``node`` and ``type``, edges ``source``, ``target``, ``relation`` and
``sign``. Every extension gives the new rows only; repeats are dropped. What is
not placed is counted by reason. Null ends give no edge; an empty table gives
no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.joins import counted_drops


def reaction_layer(participants: DataFrame, genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of reactions: a species with a negative coefficient is
    consumed, one with a positive produced, a gene catalyses.
    participants(reaction, species, coefficient), genes(reaction, gene)."""
    p = participants.where("reaction is not null and species is not null and coefficient <> 0")
    consumed = p.where("coefficient < 0").select(F.col("species").alias("source"), F.col("reaction").alias("target"), F.lit("consumed_by").alias("relation"))
    produced = p.where("coefficient > 0").select(F.col("reaction").alias("source"), F.col("species").alias("target"), F.lit("produces").alias("relation"))
    g = genes.where("reaction is not null and gene is not null").select(F.col("gene").alias("source"), F.col("reaction").alias("target"), F.lit("catalyses").alias("relation"))
    edges = consumed.unionByName(produced).unionByName(g).distinct().withColumn("sign", F.lit(1))
    nodes = p.select(F.col("species").alias("node"), F.lit("metabolite").alias("type")).union(p.select("reaction", F.lit("reaction"))).union(g.select("source", F.lit("gene"))).distinct()
    return nodes, edges


def small_molecule_edges(ligands: DataFrame, copies: DataFrame, preferred: str) -> DataFrame:
    """(source, target, relation, sign): a molecule's copies in the preferred
    compartment if it has any, else all. ligands(molecule, receptor, sign),
    copies(molecule, node, compartment)."""
    rank = F.when(F.col("compartment") == preferred, 0).otherwise(1)
    best = copies.groupBy("molecule").agg(F.min(rank).alias("_b"))
    kept = copies.join(best, "molecule").where(rank == F.col("_b")).select("molecule", "node")
    return ligands.join(kept, "molecule").where("receptor is not null").select(F.col("node").alias("source"), F.col("receptor").alias("target"), F.lit("binds").alias("relation"), "sign").distinct()


def missing_nodes(nodes: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """(node, type) of wanted nodes (column node) the table lacks."""
    return wanted.select("node").where("node is not null").distinct().join(nodes.select("node"), "node", "left_anti").withColumn("type", F.lit(kind))


def specific_forms(tops: DataFrame, links: DataFrame, names: DataFrame, words: str, stereo: tuple[str, str]) -> DataFrame:
    """(top, node): forms below each node whose name matches the pattern; of two
    stereo forms of one name only the first stays. links(source, target), names(node, name)."""
    from tarnwork.operators.graph import reach

    below = reach(links, tops.select(F.col("node").alias("seed")).distinct()).where("hop > 0")
    x = below.join(names.where(F.col("name").rlike(words)), "node").select(F.col("seed").alias("top"), "node", "name")
    first, second = stereo
    bare = lambda p: F.regexp_replace("name", f"^\\Q{p}\\E", "")
    has = x.where(F.col("name").startswith(first)).select("top", bare(first).alias("_n")).distinct()
    x = x.withColumn("_n", F.when(F.col("name").startswith(second), bare(second)))
    return x.join(has.withColumn("_h", F.lit(True)), ["top", "_n"], "left").where("_h is null").select("top", "node")


def divisor_inflation(union: DataFrame, per_seed: DataFrame) -> DataFrame:
    """(seed, median, largest) of in-weight over the union against that of each
    seed's own edges. union(node, weight), per_seed(seed, node, weight)."""
    j = per_seed.where("weight > 0").join(union.select("node", F.col("weight").alias("_u")), "node").withColumn("_r", F.col("_u") / F.col("weight"))
    return j.groupBy("seed").agg(F.percentile("_r", 0.5).alias("median"), F.max("_r").alias("largest"))


def retagged(nodes: DataFrame, tagged: DataFrame, names: DataFrame, protected: DataFrame, kind: str) -> DataFrame:
    """Nodes of the kind that are tagged already or bear a listed name, without
    the protected ones. nodes(node, type, name), tagged(node), names(name), protected(node)."""
    listed = nodes.join(names.select(F.lower("name").alias("_n")).distinct(), F.lower("name") == F.col("_n")).select("node")
    both = nodes.join(tagged.select("node").distinct(), "node", "left_semi").select("node").union(listed)
    return nodes.where(F.col("type") == kind).select("node").distinct().join(both.distinct(), "node", "left_semi").join(protected.select("node"), "node", "left_anti")


def flags_of(nodes: DataFrame, flag: str, kind: str) -> DataFrame:
    """(node, flag): the flag of nodes of the kind, false for the rest and for nulls."""
    return nodes.select("node", (F.coalesce(flag, F.lit(False)) & F.coalesce(F.col("type") == kind, F.lit(False))).alias(flag))


def entry_nodes(seeds: DataFrame, nodes: DataFrame, prefix: str, relation: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An entry node per unit with an edge to each of its seed nodes: nodes,
    edges and drops by reason. seeds(unit, node, sign, magnitude)."""
    known = nodes.select("node", F.lit(True).alias("_known")).distinct()
    j = seeds.join(known, "node", "left")
    kept, drops = counted_drops(j, [("no unit", F.col("unit").isNull()), ("unknown node", F.col("_known").isNull()), ("no sign", F.col("sign").isNull() | (F.col("sign") == 0))])
    e = kept.groupBy(F.concat(F.lit(prefix), "unit").alias("source"), F.col("node").alias("target")).agg(F.sum(F.col("sign") * F.coalesce("magnitude", F.lit(1.0))).alias("_s"))
    e = e.select("source", "target", F.lit(relation).alias("relation"), F.signum("_s").cast("int").alias("sign"), F.abs("_s").alias("weight"))
    return e.select(F.col("source").alias("node"), F.lit("entry").alias("type")).distinct(), e, drops


def _slices(df: DataFrame, item: str, spread: int, size: int) -> DataFrame:
    """(_set, _part, items): each set's items, which are distinct, in arrays of at
    most ``size`` within parts by hash; the same arrays whenever they are made again."""
    parts = df.groupBy("_set", F.pmod(F.xxhash64(item), F.lit(spread)).alias("_part")).agg(F.sort_array(F.collect_list(item)).alias("_all"))
    cuts = F.transform(F.sequence(F.lit(0), F.size("_all") - 1, F.lit(size)), lambda i: F.slice("_all", i + 1, F.lit(size)))
    return parts.select("_set", "_part", F.explode(cuts).alias(f"{item}s"))


def carriage_edges(carriage: DataFrame, copies: DataFrame, binders: DataFrame, compartment: str, spread: int = 8, size: int = 256) -> DataFrame:
    """Edges from the compartment's copies of a cargo to the binder's nodes.
    carriage(cargo, binder), copies(molecule, node, compartment), binders(binder, node).

    A binder of m copies and n nodes has m * n edges, so edges are neither
    shuffled nor compared: each copy is taken once, with the set of its binders,
    the nodes of a set are made distinct, and slices of both are paired and dealt
    out evenly. A task holds the edges of one pair of slices, ``size`` squared."""
    c = copies.where(F.col("compartment") == compartment).select(F.col("molecule").alias("cargo"), F.col("node").alias("source")).where("source is not null")
    b = binders.select("binder", F.col("node").alias("target")).where("target is not null").distinct()
    carried = carriage.where("binder is not null").select("cargo", "binder").distinct().join(c, "cargo").groupBy("source").agg(F.sort_array(F.collect_set("binder")).alias("_set"))
    reached = carried.select("_set").distinct().select("_set", F.explode("_set").alias("binder")).join(b, "binder").select("_set", "target").distinct()
    # the few slices of nodes go to every part of the copies, so that the pairs of a hot set are made in several tasks
    nodes = _slices(reached, "target", spread, size).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
    pairs = _slices(carried, "source", spread, size).join(nodes, ["_set", "_part"]).select("sources", "targets")
    pairs = pairs.repartition(int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = pairs.select(F.explode("sources").alias("source"), "targets").select("source", F.explode("targets").alias("target"))
    return edges.select("source", "target", F.lit("carried_by").alias("relation"), F.lit(1).alias("sign"))


def participant_sets(participants: DataFrame) -> DataFrame:
    """(reaction, compartment, consumed, produced) as sorted sets of species."""
    side = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("species"))))
    return participants.groupBy("reaction", "compartment").agg(side(F.col("coefficient") < 0).alias("consumed"), side(F.col("coefficient") > 0).alias("produced"))


def pool_edges(participants: DataFrame, reduced: str, oxidised: str, pool: str) -> DataFrame:
    """Edges of a pool per compartment: a reaction that turns the oxidised form
    into the reduced one fills it, the other way round drains it."""
    s = participant_sets(participants)
    has = lambda c, x: F.array_contains(c, x)
    fills = has(F.col("consumed"), oxidised) & has(F.col("produced"), reduced)
    drains = has(F.col("consumed"), reduced) & has(F.col("produced"), oxidised)
    node = F.concat(F.lit(f"{pool}_"), "compartment")
    return s.where(fills).select(F.col("reaction").alias("source"), node.alias("target"), F.lit("fills").alias("relation"), F.lit(1).alias("sign")).unionByName(
        s.where(drains).select(F.col("reaction").alias("source"), node.alias("target"), F.lit("drains").alias("relation"), F.lit(-1).alias("sign")))


def regulation_edges(rows: DataFrame, nodes: DataFrame, relation: str) -> tuple[DataFrame, DataFrame]:
    """Edges of curated rows whose ends are nodes, citations merged; and the rows
    left out by reason: absent ends, pairs whose signs conflict.
    rows(source, target, sign, citation)."""
    known = nodes.select("node").distinct().withColumn("_k", F.lit(True))
    j = rows.join(known.select(F.col("node").alias("source"), F.col("_k").alias("_a")), "source", "left").join(known.select(F.col("node").alias("target"), F.col("_k").alias("_b")), "target", "left")
    signs = rows.where("sign is not null").groupBy("source", "target").agg(F.min("sign").alias("_lo"), F.max("sign").alias("_hi"))
    kept, drops = counted_drops(j.join(signs, ["source", "target"], "left"), [
        ("source absent", F.col("_a").isNull()), ("target absent", F.col("_b").isNull()), ("no sign", F.col("sign").isNull()), ("signs conflict", F.col("_lo") != F.col("_hi"))])
    return kept.groupBy("source", "target").agg(F.lit(relation).alias("relation"), F.min("sign").alias("sign"), F.array_join(F.sort_array(F.collect_set("citation")), ";").alias("citations")), drops


def added_edges(rows: DataFrame, nodes: DataFrame, edges: DataFrame, relations: list[str]) -> tuple[DataFrame, DataFrame]:
    """(source, target, relation, sign) that can be added, and counts by reason of
    the rest: unknown relation, absent ends, an edge that is there, repeats."""
    known = nodes.select("node").distinct()
    j = rows.join(known.select(F.col("node").alias("source"), F.lit(1).alias("_a")), "source", "left").join(known.select(F.col("node").alias("target"), F.lit(1).alias("_b")), "target", "left")
    j = j.join(edges.select("source", "target", "relation").distinct().withColumn("_e", F.lit(1)), ["source", "target", "relation"], "left")
    per = j.groupBy("source", "target", "relation").agg(F.min("sign").alias("sign"), F.count("*").alias("_n"), F.max("_a").alias("_a"), F.max("_b").alias("_b"), F.max("_e").alias("_e"))
    why = F.when(~F.coalesce(F.col("relation").isin(relations), F.lit(False)), "unknown relation").when(F.col("_a").isNull() | F.col("_b").isNull(), "absent end").when(F.col("_e").isNotNull(), "already there")
    per = per.withColumn("_why", why)
    drops = per.where("_why is not null").groupBy(F.col("_why").alias("reason")).agg(F.sum("_n").alias("n"))
    repeats = per.where("_why is null").agg(F.lit("repeated").alias("reason"), F.sum(F.col("_n") - 1).alias("n")).where("n > 0")
    return per.where("_why is null").select("source", "target", "relation", "sign"), drops.unionByName(repeats)


def transported(species: DataFrame, compartments: list[str], dependent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copies of a species in each compartment, transport reactions between
    neighbouring ones, and cofactor edges from the last copy to its dependents.
    species(species), dependent(species, node)."""
    copy = lambda c: F.concat("species", F.lit(f"_{c}"))
    nodes = species.select(F.explode(F.array(*[F.struct(copy(c).alias("node"), F.lit("metabolite").alias("type")) for c in compartments], *[
        F.struct(F.concat(F.lit("transport_"), "species", F.lit(f"_{a}_{b}")).alias("node"), F.lit("reaction").alias("type")) for a, b in zip(compartments, compartments[1:])])).alias("x")).select("x.*")
    steps = []
    for a, b in zip(compartments, compartments[1:]):
        t = F.concat(F.lit("transport_"), "species", F.lit(f"_{a}_{b}"))
        steps += [F.struct(copy(a).alias("source"), t.alias("target"), F.lit("consumed_by").alias("relation")), F.struct(t.alias("source"), copy(b).alias("target"), F.lit("produces").alias("relation"))]
    moves = species.select(F.explode(F.array(*steps)).alias("x")).select("x.*")
    cof = dependent.join(species, "species").select(copy(compartments[-1]).alias("source"), F.col("node").alias("target"), F.lit("cofactor_of").alias("relation"))
    return nodes.distinct(), moves.unionByName(cof).distinct()


def mapped_layer(participants: DataFrame, mapping: DataFrame, pools: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """An imported layer's edges in the graph's ids: species by the mapping, listed
    ions by their pool, the rest under their own id; and how many went which way.
    participants(reaction, species, coefficient), mapping(species, node)."""
    from tarnwork.functions.scalars import lookup

    m = mapping.groupBy("species").agg(F.min("node").alias("node"))
    j = participants.join(m, "species", "left").withColumn("_pool", lookup(F.col("species"), pools) if pools else F.lit(None).cast("string"))
    way = F.when(F.col("_pool").isNotNull(), "pool").when(F.col("node").isNotNull(), "mapped").otherwise("own")
    j = j.withColumn("way", way).withColumn("end", F.coalesce("_pool", "node", "species"))
    e = j.select(F.when(F.col("coefficient") < 0, F.col("end")).otherwise(F.col("reaction")).alias("source"), F.when(F.col("coefficient") < 0, F.col("reaction")).otherwise(F.col("end")).alias("target"), F.when(F.col("coefficient") < 0, "consumed_by").otherwise("produces").alias("relation"))
    return e.distinct(), j.groupBy("way").agg(F.count("*").alias("n"))


def named_groups(entities: DataFrame, group: str, member: str) -> DataFrame:
    """(member, node, shared, several): entities of a group under its smallest
    member's name, whether the group has several members and the member several groups."""
    pairs = entities.select(F.col(group).alias("_grp"), F.col(member).alias("_mem")).distinct()
    g = pairs.groupBy("_grp").agg(F.min("_mem").alias("_node"), F.count("*").alias("_m"))
    n = pairs.groupBy("_mem").agg(F.count("*").alias("_g"))
    return pairs.join(g, "_grp").join(n, "_mem").select(F.col("_mem").alias(member), F.col("_node").alias("node"), (F.col("_m") > 1).alias("shared"), (F.col("_g") > 1).alias("several")).distinct()


def supported_labels(edges: DataFrame, rule: Column, optional: list[Column]) -> DataFrame:
    """Edges that meet the rule and every optional clause given."""
    out = edges.where(F.coalesce(rule, F.lit(False)))
    for c in optional:
        out = out.where(F.coalesce(c, F.lit(False)))
    return out


def expanded_adjacency(edges: DataFrame, reversible: list[str], silent: DataFrame, carriers: dict[str, str]) -> DataFrame:
    """Edges with derived reverse relations, without those that leave a silent
    node, carrier relations renamed. silent(node)."""
    from tarnwork.functions.scalars import lookup

    name = F.coalesce(lookup(F.col("relation"), carriers), F.col("relation")) if carriers else F.col("relation")
    e = edges.select("source", "target", name.alias("relation"), "sign")
    back = edges.where(F.col("relation").isin(reversible)).select(F.col("target").alias("source"), F.col("source").alias("target"), F.concat("relation", F.lit("_reversed")).alias("relation"), "sign")
    return e.unionByName(back).join(silent.select(F.col("node").alias("source")), "source", "left_anti").select("source", "target", "relation", "sign")


def structural_features(nodes: DataFrame, degrees: DataFrame, types: list[str]) -> DataFrame:
    """(node, type_..., log_degree, flagged): indicators of the type, log of 1 + degree, the flag. nodes(node, type, flag)."""
    j = nodes.join(degrees, "node", "left")
    return j.select("node", *[F.coalesce((F.col("type") == t).cast("double"), F.lit(0.0)).alias(f"type_{i}") for i, t in enumerate(types)], F.log1p(F.coalesce("degree", F.lit(0)).cast("double")).alias("log_degree"), F.coalesce("flag", F.lit(False)).cast("double").alias("flagged"))


def encoded_degrees(seeds: DataFrame, links: DataFrame, degrees: DataFrame) -> DataFrame:
    """(unit, degree): degrees of a unit's seeds and of their neighbours by the
    linking relation, without the links between them. seeds(unit, node), links(source, target)."""
    s = seeds.select("unit", "node").distinct()
    l = links.select("source", "target").distinct()
    near = s.join(l, s.node == l.source).select("unit", F.col("target").alias("node"))
    every = s.union(near).distinct()
    n = s.join(l, s.node == l.source).groupBy("unit").agg(F.count("*").alias("_l"))
    return every.join(degrees, "node").groupBy("unit").agg(F.sum("degree").alias("_d")).join(n, "unit", "left").select("unit", (F.col("_d") - 2 * F.coalesce("_l", F.lit(0))).alias("degree"))


def partition_agreement(a: DataFrame, b: DataFrame, item: str, label: str) -> DataFrame:
    """(a, b, jaccard) of labels of two partitions that are each other's best match
    by the Jaccard index, ties by the labels: pairs meet through shared items."""
    na, nb = a.groupBy(F.col(label).alias("a")).agg(F.count("*").alias("_na")), b.groupBy(F.col(label).alias("b")).agg(F.count("*").alias("_nb"))
    n = a.select(item, F.col(label).alias("a")).join(b.select(item, F.col(label).alias("b")), item).groupBy("a", "b").agg(F.count("*").alias("_n")).join(na, "a").join(nb, "b")
    n = n.select("a", "b", (F.col("_n") / (F.col("_na") + F.col("_nb") - F.col("_n"))).alias("jaccard"))
    best_a = n.groupBy("a").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    best_b = n.groupBy("b").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    return n.join(best_a, ["a", "b"]).join(best_b, ["a", "b"])
