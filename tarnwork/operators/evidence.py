"""Multi-table evidence operators: statements, mechanisms, arms, edges, parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.operators.aggregates import listed
from tarnwork.operators.joins import first_per_key, undirected


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame itself, or an error that names the columns it lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    return df


def label_statements(effects: DataFrame, terms: DataFrame, labels: DataFrame, ingredients: DataFrame, section: str) -> DataFrame:
    """Statements of labels' sections: effects to terms to labels to
    ingredients, distinct labels and the best score per group, and the share of
    the ingredient's labels of the same country that state it.

    effects(label, section, term, score), terms(term, symptom), labels(label,
    country), ingredients(label, ingredient)."""
    on = labels.join(ingredients.distinct(), "label")
    single = ingredients.distinct().groupBy("label").agg(F.count("*").alias("_i"))
    total = on.groupBy("ingredient", "country").agg(F.countDistinct("label").alias("labels_in_total"))
    said = effects.where(F.col("section") == section).join(terms, "term").join(on, "label").join(single, "label")
    per = said.groupBy("ingredient", "country", "symptom").agg(F.countDistinct("label").alias("labels"), F.max("score").alias("best_score"), listed("term").alias("terms"), F.min("_i").alias("fewest_ingredients"))
    return per.join(total, ["ingredient", "country"], "left").withColumn("share", F.col("labels") / F.col("labels_in_total"))


def lower_to_preferred(concepts: DataFrame) -> DataFrame:
    """(lower, preferred): lower-level and preferred names of one concept.

    concepts(concept, level, name) with level LLT or PT."""
    low = concepts.where("level = 'LLT'").select("concept", F.lower("name").alias("lower"))
    top = concepts.where("level = 'PT'").select("concept", F.lower("name").alias("preferred"))
    return low.join(top, "concept").select("lower", "preferred").distinct()


def prefix_conflicts(prefixes: DataFrame, column: str) -> DataFrame:
    """Entries that are empty, repeated or begin with another entry.

    Every entry is expanded into its own prefixes and joined on equality."""
    p = prefixes.select(F.col(column).alias("v"))
    n = p.groupBy("v").agg(F.count("*").alias("n"))
    cut = n.where("length(v) > 1").select("v", F.explode(F.sequence(F.lit(1), F.length("v") - 1)).alias("k")).select("v", F.expr("substring(v, 1, k)").alias("s"))
    inside = cut.join(n.select(F.col("v").alias("s")), "s").select("v", F.lit("contains another").alias("reason")).distinct()
    return n.where("v is null or trim(v) = ''").select("v", F.lit("empty").alias("reason")).union(n.where("n > 1").select("v", F.lit("repeated").alias("reason"))).union(inside)


def collapse_by_priority(df: DataFrame, key: str, value: str, priority: Column) -> DataFrame:
    """One value per key by priority, then the smallest; the others listed."""
    per = df.groupBy(key).agg(F.min_by(value, F.struct(priority, F.col(value))).alias("chosen"), F.sort_array(F.collect_set(value)).alias("_all"))
    return per.select(key, "chosen", F.array_join(F.filter("_all", lambda x: x != F.col("chosen")), ";").alias("others"))


def both_keys(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Rows repeated under each of two keys, once where they are the same."""
    return df.withColumn(name, F.explode(F.array_distinct(F.array(a, b)))).where(F.col(name).isNotNull())


def mechanisms(direct: DataFrame, links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Type of a (unit, disease) pair: its own, else the one type inherited
    over links; several types conflict.

    direct(unit, disease, kind), links(disease, other), pairs(unit, disease)."""
    own = direct.groupBy("unit", "disease").agg(F.sort_array(F.collect_set("kind")).alias("own"))
    over = links.join(direct.select("unit", F.col("disease").alias("other"), "kind"), "other").groupBy("unit", "disease").agg(F.sort_array(F.collect_set("kind")).alias("inherited"))
    j = pairs.distinct().join(own, ["unit", "disease"], "left").join(over, ["unit", "disease"], "left")
    use = F.coalesce("own", "inherited")
    return j.select("unit", "disease", F.when(F.size(use) == 1, use[0]).alias("kind"), F.when(F.col("own").isNotNull(), "direct").when(F.col("inherited").isNotNull(), "linked").otherwise("none").alias("basis"), F.coalesce(F.size(use) > 1, F.lit(False)).alias("conflict"))


def first_unless_absent(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The first source's value, else the second's, and whether they dispute."""
    a, b = first.select(*keys, F.col(value).alias("_a")), second.select(*keys, F.col(value).alias("_b"))
    return a.join(b, keys, "full").select(*keys, F.coalesce("_a", "_b").alias(value), F.coalesce(F.col("_a") != F.col("_b"), F.lit(False)).alias("disputed"))


def overridden(base: DataFrame, changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values replaced only where the pair is present; the basis keeps the replaced view."""
    j = base.join(changes.select(*keys, F.col(value).alias("_new")), keys, "left")
    basis = F.when(F.col("_new").isNotNull(), F.concat(F.lit("overrides "), F.coalesce(value, F.lit("nothing"))))
    return j.withColumn("basis", F.coalesce(basis, F.lit(""))).withColumn(value, F.coalesce("_new", value)).drop("_new")


def arm_comparison(rows: DataFrame, keys: list[str], entry: str, arm: str, value: str, treated: str, control: str) -> DataFrame:
    """Per key: entries with both arms and how many have the higher mean in the treated one."""
    per = rows.groupBy(*keys, entry).agg(F.avg(F.when(F.col(arm) == treated, F.col(value))).alias("_t"), F.avg(F.when(F.col(arm) == control, F.col(value))).alias("_c")).where("_t is not null and _c is not null")
    return per.groupBy(*keys).agg(F.count("*").alias("entries"), F.count_if(F.col("_t") > F.col("_c")).alias("above"))


def edge_evidence(edges: DataFrame, refs: DataFrame, negatives: DataFrame, undirected_relations: list[str]) -> DataFrame:
    """Edges with their distinct citations, matched as stated and, for
    undirected relations, reversed too; contested where the unordered pair is
    on the negative list.

    edges(source, target, relation), refs(source, target, citation), negatives(a, b)."""
    e = edges.distinct()
    lo, hi = undirected("source", "target")
    flat = F.col("relation").isin(undirected_relations)
    keyed = e.withColumn("_a", F.when(flat, lo).otherwise(F.col("source"))).withColumn("_b", F.when(flat, hi).otherwise(F.col("target")))
    straight = refs.select(F.col("source").alias("_a"), F.col("target").alias("_b"), "citation", F.lit(False).alias("_u"))
    level = refs.select(lo.alias("_a"), hi.alias("_b"), "citation", F.lit(True).alias("_u"))
    cited = straight.union(level).groupBy("_a", "_b", "_u").agg(F.countDistinct("citation").alias("citations"))
    j = keyed.withColumn("_u", flat).join(cited, ["_a", "_b", "_u"], "left")
    bad = negatives.select(F.least("a", "b").alias("_lo"), F.greatest("a", "b").alias("_hi")).distinct().withColumn("_n", F.lit(True))
    j = j.withColumn("_lo", lo).withColumn("_hi", hi).join(bad, ["_lo", "_hi"], "left")
    return j.select("source", "target", "relation", F.coalesce("citations", F.lit(0)).alias("citations"), F.coalesce("_n", F.lit(False)).alias("contested"))


def bulk_citations(df: DataFrame, row: str, citations: str, most: int) -> DataFrame:
    """(row, all, kept): distinct citations, with and without those behind more than ``most`` rows."""
    e = df.select(row, F.explode(citations).alias("c")).distinct()
    bulk = e.groupBy("c").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("c", F.lit(True).alias("_bulk"))
    per = e.join(bulk, "c", "left").groupBy(row).agg(F.count("*").alias("all"), F.count_if(F.col("_bulk").isNull()).alias("kept"))
    return df.select(row).distinct().join(per, row, "left").na.fill(0, ["all", "kept"])


def split_nodes(edges: DataFrame, parts: DataFrame, order: str) -> DataFrame:
    """Edges with both ends replaced by the nodes' parts, repeats dropped (the first by order kept).

    parts(node, part); nodes without parts stay."""
    p = parts.groupBy("node").agg(F.sort_array(F.collect_set("part")).alias("_p"))
    out = edges
    for end in ("source", "target"):
        out = out.join(p.withColumnRenamed("node", end), end, "left").withColumn(end, F.explode(F.coalesce("_p", F.array(end)))).drop("_p")
    return first_per_key(out, ["source", "target", "relation"], [F.col(order)])


def disjoint_parts(parts: DataFrame, group: str) -> DataFrame:
    """Nodes named by several parts of a group: signed magnitudes summed, held
    by the first part that names them; exact cancelling keeps the first sign
    with magnitude 0. parts(group, ordinal, node, sign, magnitude)."""
    per = parts.groupBy(group, "node").agg(F.min("ordinal").alias("part"), F.sum(F.col("sign") * F.col("magnitude")).alias("_s"), F.min_by("sign", "ordinal").alias("_f"), F.count_distinct("ordinal").alias("parts"))
    return per.select(group, "node", "part", F.when(F.col("_s") == 0, F.col("_f")).otherwise(F.signum("_s")).alias("sign"), F.abs("_s").alias("magnitude"), (F.col("parts") > 1).alias("shared"))


def expression_minimum(members: DataFrame, levels: DataFrame) -> DataFrame:
    """(complex, sample, level): the smallest known level of a complex's members."""
    return members.join(levels, "member").where("level is not null").groupBy("complex", "sample").agg(F.min("level").alias("level"))


def relative_levels(long: DataFrame, key: str, value: str, half: float) -> DataFrame:
    """x / (largest of the key + half)."""
    m = long.groupBy(key).agg(F.max(value).alias("_m"))
    return long.join(m, key).withColumn(value, F.col(value) / (F.col("_m") + half)).drop("_m")


def recurring_pairs(participants: DataFrame, least: int) -> DataFrame:
    """Substrate and product pairs that recur in at least ``least`` reactions.

    participants(reaction, species, side): pairs arise within a reaction, whose
    participants are few, never across the table."""
    s, p = participants.where("side = 'in'").select("reaction", F.col("species").alias("substrate")), participants.where("side = 'out'").select("reaction", F.col("species").alias("product"))
    return s.join(p, "reaction").where("substrate <> product").groupBy("substrate", "product").agg(F.countDistinct("reaction").alias("reactions")).where(F.col("reactions") >= least)


def unanimous(df: DataFrame, keys: list[str], value: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Keys with one value, their texts merged; and the keys in conflict."""
    per = df.groupBy(*keys).agg(F.countDistinct(value).alias("_n"), F.min(value).alias(value), listed(text).alias(text))
    return per.where("_n = 1").drop("_n"), per.where("_n > 1").select(*keys)


def apply_priors(cells: DataFrame, priors: DataFrame, keys: list[str]) -> DataFrame:
    """Target and weight of eligible cells overwritten by their prior; absences keep the larger weight.

    cells(keys, outcome, weight, eligible), priors(keys, probability, strength)."""
    j = cells.join(priors.select(*keys, "probability", "strength"), keys, "left")
    use = F.coalesce(F.col("eligible") & F.col("probability").isNotNull(), F.lit(False))
    return j.withColumn("target", F.when(use, F.col("probability")).otherwise(F.col("outcome").cast("double"))).withColumn(
        "weight", F.when(use & (F.col("probability") == 0), F.greatest("weight", "strength")).when(use, F.col("strength")).otherwise(F.col("weight"))).drop("probability", "strength")


def balanced_weights(df: DataFrame, slot: str, positive: str, weight: str) -> DataFrame:
    """Weights scaled so that each slot of a sign carries the mean count of slots."""
    n = df.groupBy(slot, positive).agg(F.count("*").alias("_n"))
    m = n.groupBy(positive).agg(F.avg("_n").alias("_m"))
    return df.join(n, [slot, positive]).join(m, positive).withColumn(weight, F.col(weight) * F.col("_m") / F.col("_n")).drop("_n", "_m")


def vector_correlations(long: DataFrame, key: str, dim: str, value: str) -> DataFrame:
    """(a, b, distance): 1 - Pearson over shared dimensions of two keys; 1 for a constant one.

    Meant for few keys (profiles of classes): pairs of keys meet per dimension."""
    x = long.select(F.col(key).alias("a"), dim, F.col(value).alias("_x"))
    y = long.select(F.col(key).alias("b"), dim, F.col(value).alias("_y"))
    return x.join(y, dim).where("a < b").groupBy("a", "b").agg((1 - F.coalesce(F.nanvl(F.corr("_x", "_y"), F.lit(None)), F.lit(0.0))).alias("distance"))


def best_phrase(terms: DataFrame, term: str, stems: str, vocabulary: DataFrame, name: str, vocabulary_stems: str, default: str) -> DataFrame:
    """Each term's vocabulary name by the unique largest overlap of stems, else the default.

    Stems are joined on equality, so only names that share a stem meet a term."""
    a = terms.select(term, F.explode(stems).alias("_s")).distinct()
    b = vocabulary.select(name, F.explode(vocabulary_stems).alias("_s")).distinct()
    o = a.join(b, "_s").groupBy(term, name).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(term)
    top = o.withColumn("_m", F.max("_n").over(w)).where("_n = _m").groupBy(term).agg(F.count("*").alias("_k"), F.min(name).alias(name)).where("_k = 1").drop("_k")
    return terms.select(term).distinct().join(top, term, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def cards(df: DataFrame, key: str, order: list[Column], fields: list[str], top: int) -> DataFrame:
    """One text card per key of its first rows by the ascending order columns.

    Each task keeps the first rows of its own part of a key (the rows are spread
    over ``64`` parts by their hash), so a hot key is cut down before it comes together."""
    line = F.concat_ws(" | ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    x = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("l"))
    parts = df.select(F.col(key), F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(64)).alias("_part"), x.alias("x"))
    w = Window.partitionBy(key, "_part").orderBy("x")
    few = parts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    return few.groupBy(key).agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list("x")), 1, top), lambda x: x["l"]), "\n").alias("card"))
