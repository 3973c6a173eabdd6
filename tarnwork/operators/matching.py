"""Matches over several routes, targets of compounds, and rule cascades.

Rules that speak of the first or last row take an ``ordinal`` column. Defined
results: null keys match nothing; a route that finds nothing leaves the next
one its turn; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.joins import first_per_key, last_per_key, precedence_join, unambiguous


def mapped_genes(nodes: DataFrame, ids: DataFrame, symbols: DataFrame, current: DataFrame, previous: DataFrame, aliases: DataFrame) -> DataFrame:
    """Nodes with ``gene`` and the route that found it: by id, by symbol, by the
    current symbol's table, by the one gene that had the symbol before, by the one
    that has it as an alias. nodes(id, symbol), the tables hold (key, value)."""
    one = lambda t: t.where("key is not null and value is not null").groupBy("key").agg(F.min("value").alias("value"))
    routes = [("id", F.col("id"), one(ids)), ("symbol", F.col("symbol"), one(symbols)), ("current", F.col("symbol"), one(current)), ("previous", F.col("symbol"), unambiguous(previous, "key", "value")), ("alias", F.col("symbol"), unambiguous(aliases, "key", "value"))]
    return precedence_join(nodes, routes, "gene")


def first_candidate(wanted: DataFrame, candidates: DataFrame, kind: str) -> DataFrame:
    """(key, id): the first candidate of the kind whose name is the wanted one,
    else the first whose synonym is. wanted(key, name), candidates(key, ordinal,
    id, kind, name, synonym)."""
    j = candidates.where(F.col("kind") == kind).withColumnRenamed("name", "_n").join(wanted, "key")
    rank = F.when(F.col("_n") == F.col("name"), 0).when(F.col("synonym") == F.col("name"), 1)
    return first_per_key(j.withColumn("_rank", rank).where("_rank is not null").select("key", "id", "_rank", "ordinal"), ["key"], [F.col("_rank"), F.col("ordinal")]).select("key", "id")


def parent_molecules(molecules: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(child, parent): the first source's parent, else the second's, else the
    molecule itself. Sources (child, parent) hold a child once."""
    a, b = first.select("child", F.col("parent").alias("_a")), second.select("child", F.col("parent").alias("_b"))
    return molecules.select("child").where("child is not null").distinct().join(a, "child", "left").join(b, "child", "left").select("child", F.coalesce("_a", "_b", "child").alias("parent"))


def mechanism_targets(molecules: DataFrame, mechanisms: DataFrame, targets: DataFrame, organism: str | None = None) -> DataFrame:
    """(unit, target, action): targets of a unit's molecules, the last mechanism
    of a target holds; with ``organism`` targets known to be of another one are
    left out, unknown ones stay. molecules(unit, molecule), mechanisms(molecule,
    target, action, ordinal), targets(target, organism)."""
    j = molecules.distinct().join(mechanisms, "molecule").join(targets, "target", "left")
    if organism is not None:
        j = j.where(F.coalesce(F.col("organism") == organism, F.lit(True)))
    return last_per_key(j.select("unit", "target", "action", "ordinal"), ["unit", "target"], [F.col("ordinal")]).drop("ordinal")


def with_fallback(units: DataFrame, routes: list[DataFrame]) -> DataFrame:
    """(unit, target, route): each unit's targets by the first route that has any;
    route 0 for a unit without. Routes are (unit, target)."""
    found = None
    for i, r in enumerate(routes, 1):
        x = r.select("unit", "target").where("target is not null").distinct().withColumn("route", F.lit(i))
        found = x if found is None else found.unionByName(x)
    best = found.groupBy("unit").agg(F.min("route").alias("route"))
    return units.select("unit").distinct().join(best, "unit", "left").join(found, ["unit", "route"], "left").select("unit", "target", F.coalesce("route", F.lit(0)).alias("route"))


def only_target(pairs: DataFrame, target: str, sign: int) -> DataFrame:
    """Units whose one target is the given one with the given sign. pairs(unit, target, sign)."""
    per = pairs.where("target is not null").groupBy("unit").agg(F.min("target").alias("_a"), F.max("target").alias("_b"), F.min("sign").alias("_s"), F.max("sign").alias("_t"))
    return per.where((F.col("_a") == target) & (F.col("_b") == target) & (F.col("_s") == sign) & (F.col("_t") == sign)).select("unit")


def replaced_complexes(rows: DataFrame, specific: DataFrame, least: int = 2) -> DataFrame:
    """(unit, gene, basis): rows of one gene stay; rows of several are replaced by
    the genes the specific source names, where it names ``least`` of them, and
    stay whole otherwise. rows(unit, row, genes), specific(unit, gene)."""
    e = rows.select("unit", "row", F.explode(F.array_distinct("genes")).alias("gene")).where("gene is not null")
    n = e.groupBy("unit", "row").agg(F.count("*").alias("_n"))
    named = specific.select("unit", "gene").distinct().withColumn("_named", F.lit(1))
    j = e.join(n, ["unit", "row"]).join(named, ["unit", "gene"], "left")
    k = j.groupBy("unit", "row").agg(F.count("_named").alias("_k"))
    j = j.join(k, ["unit", "row"])
    basis = F.when(F.col("_n") == 1, "single").when(F.col("_k") >= least, F.when(F.col("_named").isNotNull(), "specific")).otherwise("complex")
    return j.withColumn("basis", basis).where("basis is not null").groupBy("unit", "gene").agg(F.min("basis").alias("basis"))


def rewritten_keys(reports: DataFrame, mechanisms: DataFrame, named: DataFrame) -> DataFrame:
    """Reports with ``key`` rewritten: a pair with a gain or loss mechanism takes
    the gene with the mechanism, a gene with a named variant takes that variant.
    reports(gene, disease, ...), mechanisms(gene, disease, kind), named(gene, kind, variant)."""
    j = reports.join(mechanisms.select("gene", "disease", F.col("kind").alias("_kind")), ["gene", "disease"], "left").join(named.select("gene", F.col("kind").alias("_kind"), "variant"), ["gene", "_kind"], "left")
    return j.withColumn("key", F.coalesce("variant", F.when(F.col("_kind").isNotNull(), F.concat("gene", F.lit("|"), "_kind")), "gene")).drop("_kind", "variant")


def placements(statements: DataFrame, rules: list[tuple[str, DataFrame, list[str], bool]]) -> DataFrame:
    """Statements with the first rule that places them, in the order given, else
    ``unplaced``. A rule is (name, table, keys, wanted): whether the keys must or
    must not occur in the table."""
    out, cases = statements, []
    for i, (name, table, keys, wanted) in enumerate(rules):
        out = out.join(table.select(*keys).where(" and ".join(f"{k} is not null" for k in keys)).distinct().withColumn(f"_f{i}", F.lit(True)), keys, "left")
        cases.append(F.when(F.col(f"_f{i}").isNotNull() if wanted else F.col(f"_f{i}").isNull(), F.lit(name)))
    return out.withColumn("placement", F.coalesce(*cases, F.lit("unplaced"))).drop(*(f"_f{i}" for i in range(len(rules))))


def mapped_definition(definitions: DataFrame, equivalent: DataFrame, manual: DataFrame, specific: DataFrame, most: int) -> DataFrame:
    """(definition, node, route): by equivalence, else by hand, else by specific
    forms, and none where a definition meets more than ``most`` nodes."""
    all_ = with_fallback(definitions.select(F.col("definition").alias("unit")), [r.select(F.col("definition").alias("unit"), F.col("node").alias("target")) for r in (equivalent, manual, specific)])
    n = all_.groupBy("unit").agg(F.count("target").alias("_n"))
    return all_.join(n, "unit").where((F.col("_n") <= most) & (F.col("_n") > 0)).select(F.col("unit").alias("definition"), F.col("target").alias("node"), "route")


def annotated_levels(nodes: DataFrame, by_id: DataFrame, by_symbol: DataFrame, least: float) -> DataFrame:
    """(node, level, known, expressed): the highest level by id, else by symbol."""
    a = by_id.groupBy("id").agg(F.max("level").alias("_a"))
    b = by_symbol.groupBy("symbol").agg(F.max("level").alias("_b"))
    level = F.coalesce("_a", "_b")
    return nodes.join(a, "id", "left").join(b, "symbol", "left").select("node", level.alias("level"), level.isNotNull().alias("known"), F.coalesce(level >= least, F.lit(False)).alias("expressed"))


def never_trained(held: DataFrame, trained: DataFrame, unit: str, value: str) -> DataFrame:
    """(unit, values, unseen): how many of a held-out unit's values no training unit has."""
    seen = trained.select(value).where(F.col(value).isNotNull()).distinct().withColumn("_s", F.lit(1))
    return held.select(unit, value).where(F.col(value).isNotNull()).distinct().join(seen, value, "left").groupBy(unit).agg(F.count("*").alias("values"), F.count_if(F.col("_s").isNull()).alias("unseen"))


def grouped_entries(entries: DataFrame, group: str, entry: str, record: str, name: str) -> DataFrame:
    """(group, entry, part): entries of a group with the same set of records form
    a part, named by its smallest name; a group with fewer than two named parts is one part."""
    sets = entries.groupBy(group, entry).agg(F.sort_array(F.collect_set(record)).alias("_r"), F.min(name).alias("_n"))
    parts = sets.groupBy(group, "_r").agg(F.min("_n").alias("_p"))
    named = parts.groupBy(group).agg(F.count("_p").alias("_k"), F.min("_p").alias("_first"))
    j = sets.join(parts, [group, "_r"]).join(named, group)
    return j.select(group, entry, F.when(F.col("_k") < 2, F.col("_first")).otherwise(F.col("_p")).alias("part"))


def resolved_symbols(symbols: DataFrame, entries: DataFrame, previous: DataFrame) -> DataFrame:
    """(symbol, entry, route): the entry of the symbol itself, of the accession it
    is, of the one entry that had it before, else none. entries(symbol, entry),
    previous(symbol, entry)."""
    e = entries.where("symbol is not null").groupBy("symbol").agg(F.min("entry").alias("_d"))
    own = entries.select(F.col("entry").alias("symbol"), F.col("entry").alias("_o")).where("symbol is not null").distinct()
    p = previous.where("symbol is not null").groupBy("symbol").agg(F.min("entry").alias("_p"), F.max("entry").alias("_q")).where("_p = _q").drop("_q")
    j = symbols.select("symbol").where("symbol is not null").distinct().join(e, "symbol", "left").join(own, "symbol", "left").join(p, "symbol", "left")
    return j.select("symbol", F.coalesce("_d", "_o", "_p").alias("entry"), F.when(F.col("_d").isNotNull(), "direct").when(F.col("_o").isNotNull(), "accession").when(F.col("_p").isNotNull(), "previous").otherwise("none").alias("route"))


def common_prefix_label(df: DataFrame, key: str, source: str, prefix: str, label: str) -> DataFrame:
    """(key, label): the given label where every source has the prefix, else the sources in order."""
    return df.where(F.col(source).isNotNull()).groupBy(key).agg(
        F.when(F.every(F.col(source).startswith(prefix)), F.lit(label)).otherwise(F.array_join(F.sort_array(F.collect_set(source)), ";")).alias("label"))


def directed_records(records: DataFrame, key: list[str], up: Column, down: Column, grade: str) -> DataFrame:
    """(key, direction, grade, records): a record gives a row for each direction it supports."""
    d = F.explode(F.array_compact(F.array(F.when(up, "present"), F.when(down, "absent"))))
    return records.select(*key, grade, d.alias("direction")).groupBy(*key, "direction", grade).agg(F.count("*").alias("records"))


def popularity(keys: DataFrame, reports: DataFrame, key: str, citation: str) -> DataFrame:
    """(key, papers): distinct citations per key, 0 for a key without."""
    n = reports.where(F.col(citation).isNotNull() & (F.col(citation) != "")).groupBy(key).agg(F.countDistinct(citation).alias("papers"))
    return keys.select(key).where(F.col(key).isNotNull()).distinct().join(n, key, "left").na.fill(0, ["papers"])


def collected_tests(rows: DataFrame, keys: list[str], p: str, term: str, count: str, level: float) -> DataFrame:
    """Per key: tests, the smallest p, the largest count and the terms significant at the level."""
    return rows.groupBy(*keys).agg(F.count("*").alias("tests"), F.min(p).alias("least_p"), F.max(count).alias("most"), F.array_join(F.sort_array(F.collect_set(F.when(F.col(p) < level, F.col(term)))), "|").alias("significant"))


def tested_reports(positives: DataFrame, tested: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """(keys, report_value): 1 for asserted pairs, 0 for pairs of a tested group
    without an assertion. positives(keys), tested(keys), ``group`` within keys."""
    yes = positives.select(*keys).distinct()
    no = tested.select(*keys).distinct().join(yes, keys, "left_anti")
    return yes.withColumn("report_value", F.lit(1)).unionByName(no.withColumn("report_value", F.lit(0)))


def classified_arms(arms: DataFrame, text: str, drug: Column, others: list[str], control: str = "placebo") -> DataFrame:
    """Adds ``arm``: excluded where another drug is named, control, drug or other, by whole words of the text."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    word = lambda w: F.rlike(low, F.concat(F.lit("(?<![a-z0-9])\\Q"), F.lower(w), F.lit("\\E(?![a-z0-9])")))
    excluded = F.lit(False)
    for o in others:
        excluded = excluded | (word(F.lit(o)) & (F.lower(drug) != o.lower()))
    return arms.withColumn("arm", F.when(excluded, "excluded").when(word(F.lit(control)), "control").when(F.coalesce((F.trim(drug) != "") & word(drug), F.lit(False)), "drug").otherwise("other"))


def species_counts(rows: DataFrame, row: str, ids: str, species: DataFrame, human: str) -> DataFrame:
    """(row, known, human): how many of a row's ids have a known species, and the human one. species(id, species)."""
    e = rows.select(row, F.explode_outer(F.array_distinct(ids)).alias("id")).join(species, "id", "left")
    return e.groupBy(row).agg(F.count("species").alias("known"), F.count_if(F.col("species") == human).alias("human"))


def typed_weights(nodes: DataFrame, tables: dict[str, DataFrame], classes: DataFrame, default: float = 1.0) -> DataFrame:
    """(node, class, weight): a node's weight per class from the table of its
    type, ``default`` where that has none. nodes(node, type), tables(node, class, weight), classes(class): few rows."""
    w = None
    for t, table in tables.items():
        x = table.select("node", "class", "weight").withColumn("type", F.lit(t))
        w = x if w is None else w.unionByName(x)
    per = classes.agg(F.sort_array(F.collect_set("class"))).scalar()
    return nodes.select("node", "type", F.explode(per).alias("class")).join(w, ["node", "type", "class"], "left").select("node", "class", F.coalesce("weight", F.lit(default)).alias("weight"))


def strongest_rows(df: DataFrame, keys: list[str], p: str, columns: list[str]) -> DataFrame:
    """Per key the row with the smallest p; a row without one counts as the weakest; ties by the columns."""
    order = [F.coalesce(F.col(p), F.lit(float("inf"))), *(F.col(c) for c in columns)]
    return first_per_key(df.select(*keys, p, *columns), keys, order)


def gain_only(types: DataFrame, gene: str, kind: str, causal: str, wanted: str) -> DataFrame:
    """Genes whose causal association types are the wanted one only."""
    return types.where(F.col(causal)).groupBy(gene).agg(F.every(F.col(kind) == wanted).alias("_e")).where("_e").select(gene)


def seen_share(held: DataFrame, trained: DataFrame, unit: str, value: str) -> DataFrame:
    """(unit, share): share of a held-out unit's values that a training unit has."""
    n = never_trained(held, trained, unit, value)
    return n.select(unit, (1 - F.col("unseen") / F.col("values")).alias("share"))


def combined_evidence(base: DataFrame, more: DataFrame, required: list[str], defaults: dict[str, object]) -> DataFrame:
    """Both tables in the base's columns; columns the second lacks take typed
    defaults; a required column missing from either is an error."""
    lacking = [c for c in required if c not in base.columns or c not in more.columns]
    if lacking:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    types = dict(base.dtypes)
    m = more.select(*[(F.col(c) if c in more.columns else F.lit(defaults.get(c))).cast(types[c]).alias(c) for c in base.columns])
    return base.unionByName(m)


def anchored(seeds: DataFrame, members: DataFrame) -> DataFrame:
    """(unit, module): units with a seed in the module. seeds(unit, node), members(module, node)."""
    return seeds.join(members, "node").select("unit", "module").distinct()


def holdout_modules(seeds: DataFrame, members: DataFrame, positives: DataFrame, least: int) -> DataFrame:
    """(module, unit) of modules whose anchored units have at least ``least`` positives. positives(unit, n)."""
    a = anchored(seeds, members).join(positives, "unit", "left")
    keep = a.groupBy("module").agg(F.sum(F.coalesce("n", F.lit(0))).alias("_n")).where(F.col("_n") >= least).select("module")
    return a.join(keep, "module", "left_semi").select("module", "unit")


def lockbox(units: DataFrame, listed: DataFrame, unit: str, group: str) -> DataFrame:
    """The listed units; an error for a listed unit that is missing and for a
    group with members on both sides."""
    mark = listed.select(unit).distinct().withColumn("_in", F.lit(True))
    j = units.join(mark, unit, "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    missing = mark.join(units.select(unit), unit, "left_anti").agg(F.min(F.col(unit).cast("string"))).scalar()
    sides = j.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(F.col("_in").cast("int")).alias("a"), F.max(F.col("_in").cast("int")).alias("b")).where("a <> b")
    split = sides.agg(F.min(F.col(group).cast("string"))).scalar()
    bad = F.when(missing.isNotNull(), F.concat(F.lit("listed but missing: "), missing)).when(split.isNotNull(), F.concat(F.lit("group on both sides: "), split))
    return j.where("_in").select(unit, F.when(bad.isNull(), F.col(group)).otherwise(F.raise_error(bad)).alias(group))


def masked_by_grade(records: DataFrame, keys: list[str], grade: str, soft: list[str]) -> DataFrame:
    """Keys all of whose records have a soft grade."""
    return records.groupBy(*keys).agg(F.every(F.coalesce(F.col(grade).isin(soft), F.lit(False))).alias("_m")).where("_m").select(*keys)


def selected_pairs(records: DataFrame, keys: list[str], label: str, above: DataFrame, as_negative: bool) -> DataFrame:
    """(keys, use, reason) of pairs: kept with a positive, set aside (or taken as
    negative) where no arm was above its control, negative without a positive. above(keys, entries, above)."""
    per = records.groupBy(*keys).agg(F.max(label).alias("_y")).join(above, keys, "left")
    never = (F.col("entries") > 0) & (F.col("above") == 0)
    use = F.when((F.col("_y") == 1) & F.coalesce(never, F.lit(False)), "negative" if as_negative else "set aside").when(F.col("_y") == 1, "kept").when(F.col("_y") == 0, "negative").otherwise("set aside")
    why = F.when((F.col("_y") == 1) & F.coalesce(never, F.lit(False)), "never above control").when(F.col("_y") == 1, "reported").when(F.col("_y") == 0, "reported absent").otherwise("no value")
    return per.select(*keys, use.alias("use"), why.alias("reason"))


def sufficiency(activations: DataFrame, unit: str, module: str, value: str) -> DataFrame:
    """(module, units, mean): units by the module that contributes most, ties by its name."""
    top = activations.where(F.col(value).isNotNull()).groupBy(unit).agg(F.min_by(module, F.struct(-F.col(value), F.col(module))).alias(module), F.max(value).alias("_v"))
    return top.groupBy(module).agg(F.count("*").alias("units"), F.avg("_v").alias("mean"))
