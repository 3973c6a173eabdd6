"""Builders of report rows: source rows joined, mapped and graded, with every
row that is left out counted by its reason.

Defined results: null keys join nothing and are counted as unmapped; ordinals
decide every first-row rule; an empty source gives no report and no count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.joins import counted_drops, first_per_key


def annotation_reports(triples: DataFrame, annotations: DataFrame, terms: DataFrame, genes: DataFrame, known: Column) -> tuple[DataFrame, DataFrame]:
    """Reports of (gene, disease, term) triples: genes of the graph only, each
    symptom of the term, each annotation row of the disease and term, and one
    report without a row where there is none. Diseases whose id prefix is not
    ``known`` go to the second frame (disease, n).

    triples(gene, disease, term), annotations(disease, term, ordinal, negated,
    share), terms(symptom, term), genes(gene)."""
    t = triples.select("gene", "disease", "term").where("gene is not null and term is not null").distinct().join(genes.select("gene").distinct(), "gene", "left_semi")
    j = t.join(terms.select("symptom", "term").distinct(), "term")
    aside = j.where(~F.coalesce(known, F.lit(False))).groupBy("disease").agg(F.count("*").alias("n"))
    j = j.where(known).join(annotations.select("disease", "term", "ordinal", "negated", "share"), ["disease", "term"], "left")
    value = F.when(F.coalesce(F.col("negated"), F.lit(False)) | (F.col("share") == 0), 0).otherwise(1)
    basis = F.when(F.col("ordinal").isNull(), "unjoined").otherwise("annotated")
    return j.select("gene", "symptom", "disease", "term", F.coalesce("ordinal", F.lit(-1)).alias("ordinal"), value.cast("int").alias("report_value"), F.when(value == 1, F.col("share")).otherwise(F.lit(0.0)).alias("share"), basis.alias("basis")), aside


def annotation_records(reports: DataFrame) -> DataFrame:
    """(gene, symptom, diseases, rows, largest): the older aggregate of positive reports."""
    return reports.where("report_value = 1").groupBy("gene", "symptom").agg(F.count_distinct("disease").alias("diseases"), F.count("*").alias("rows"), F.max("share").alias("largest"))


def arm_reports(events: DataFrame, arms: DataFrame) -> DataFrame:
    """One report per treatment arm of an event, whose code depends on whether the
    event has a control arm, else one report from the text.
    events(event, ...), arms(event, ordinal, placebo, share)."""
    a = arms.withColumn("_p", F.coalesce("placebo", F.lit(False)))
    control = a.groupBy("event").agg(F.max("_p").alias("_control"))
    t = a.where("not _p").select("event", "ordinal", "share")
    j = events.select("event").distinct().join(control, "event", "left").join(t, "event", "left")
    code = F.when(F.col("ordinal").isNull(), "label_text").when(F.col("_control"), "placebo_controlled_frequency").otherwise("frequency")
    return j.select("event", F.coalesce("ordinal", F.lit(-1)).alias("ordinal"), "share", code.alias("evidence_code"))


def treatment_shares(arms: DataFrame, keys: list[str]) -> DataFrame:
    """Mean share over treatment arms, control arms left out."""
    return arms.where(~F.coalesce("placebo", F.lit(False)) & F.col("share").isNotNull()).groupBy(*keys).agg(F.avg("share").alias("share"))


def qualified(units: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``qualifies`` and the reason of the first rule that fails."""
    reason = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules])
    return units.withColumn("reason", F.coalesce(reason, F.lit(""))).withColumn("qualifies", reason.isNull())


def statement_reports(statements: DataFrame, units: DataFrame, score: str) -> tuple[DataFrame, DataFrame]:
    """Statements of qualified units with the score scaled to the span of all
    kept statements, and counts of what was left out by reason.
    statements(unit, combined, score, ...), units(unit, qualifies, reason)."""
    j = statements.join(units.select("unit", "qualifies", "reason"), "unit", "left")
    why = F.when(F.col("qualifies").isNull(), "unknown unit").when(~F.col("qualifies"), F.col("reason")).when(F.coalesce("combined", F.lit(False)), "combination only")
    j = j.withColumn("_why", why)
    kept = j.where("_why is null").drop("_why", "qualifies", "reason")
    span = kept.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi")).alias("_")).scalar()
    scaled = F.when(span["hi"] > span["lo"], (F.col(score) - span["lo"]) / (span["hi"] - span["lo"])).otherwise(F.lit(1.0))
    return kept.withColumn("scaled", scaled), j.where("_why is not null").groupBy(F.col("_why").alias("reason")).agg(F.count("*").alias("n"))


def ordinal_within(rows: DataFrame, keys: list[str], ordinal: str, name: str) -> DataFrame:
    """Adds a row's place among the rows of its keys by the ordinal, from the
    sorted ordinals of the key joined back, and a stable id from both."""
    per = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(ordinal)).alias("_o"))
    placed = per.select(*keys, F.posexplode("_o").alias("_k", ordinal))
    return rows.join(placed, [*keys, ordinal]).withColumn(name, F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], (F.col("_k") + 1).cast("string"))).drop("_k")


def dated(rows: DataFrame, dates: DataFrame, citation: str) -> DataFrame:
    """Rows with the date of their citation where it is known. dates(citation, date)."""
    return rows.join(dates.select(F.col("citation").alias(citation), "date").dropDuplicates([citation]), citation, "left")


def expanded_rows(rows: DataFrame, evidence: str, citations: str, matches: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Rows times their evidence values, matches and citations, a row without a
    citation once with none; and the number of rows without a match.
    matches(on, match)."""
    m = matches.select(on, "match").distinct()
    unmapped = rows.join(m.select(on).distinct(), on, "left_anti").agg(F.lit("unmapped").alias("reason"), F.count("*").alias("n"))
    e = rows.join(m, on).withColumn("_e", F.explode(F.split(evidence, r"\|"))).withColumn("_c", F.explode_outer(F.filter(F.split(citations, r"\|"), lambda x: x != "")))
    return e.withColumn(evidence, F.col("_e")).withColumn(citations, F.col("_c")).drop("_e", "_c"), unmapped


def table_reports(counts: DataFrame, terms: DataFrame, indicated: DataFrame, verdict: Column) -> tuple[DataFrame, DataFrame]:
    """Reports of 2x2 tables: mapped reactions, pairs that are indications left
    out, the verdict 1 or 0, none dropped; with counts by reason.
    counts(unit, reaction, ...), terms(reaction, symptom), indicated(unit, symptom)."""
    j = counts.join(terms, "reaction", "left").join(indicated.select("unit", "symptom").distinct().withColumn("_i", F.lit(True)), ["unit", "symptom"], "left")
    kept, drops = counted_drops(j.withColumn("report_value", verdict), [("unmapped", F.col("symptom").isNull()), ("indicated", F.col("_i").isNotNull()), ("neither", F.col("report_value").isNull())])
    return kept.drop("_i"), drops


def indicated_pairs(reports: DataFrame) -> DataFrame:
    """(unit, symptom) of positive reports that relieve."""
    return reports.where("relation = 'relieves' and report_value = 1 and unit is not null").select("unit", "symptom").distinct()


def exposure_reports(comparisons: DataFrame, excess: Column, exposed: Column, floor: int) -> tuple[DataFrame, DataFrame]:
    """1 for an excess, 0 for none above the exposure floor, the rest counted."""
    v = F.when(F.coalesce(excess, F.lit(False)), 1).when(F.coalesce(exposed >= floor, F.lit(False)), 0)
    c = comparisons.withColumn("report_value", v)
    return c.where("report_value is not null"), c.where("report_value is null").agg(F.lit("too little exposure").alias("reason"), F.count("*").alias("n")).where("n > 0")


def largest_arms(arms: DataFrame, keys: list[str], side: str, n: str, ordinal: str) -> DataFrame:
    """Per key and side the arm with most people, the first on ties."""
    return first_per_key(arms.where(F.col(n).isNotNull() & F.col(side).isNotNull()), [*keys, side], [-F.col(n), F.col(ordinal)])


def matched_rules(rows: DataFrame, text: str, rules: list[tuple[str, str]], value: str) -> DataFrame:
    """Adds the value of the first rule whose pattern the text contains; rows that meet none are left out."""
    hit = F.coalesce(*[F.when(F.col(text).rlike(p), F.lit(v)) for p, v in rules])
    return rows.withColumn(value, hit).where(F.col(value).isNotNull())


def first_analysis(analyses: DataFrame, keys: list[str], treated: Column, ordinal: str) -> DataFrame:
    """(keys, effect, low, high) of a key's first analysis, the sign and the limits
    swapped where the control comes first. analyses(keys, ordinal, effect, low, high)."""
    a = first_per_key(analyses.withColumn("_t", F.coalesce(treated, F.lit(True))).select(*keys, ordinal, "effect", "low", "high", "_t"), keys, [F.col(ordinal)])
    s = F.when(F.col("_t"), 1).otherwise(-1)
    return a.select(*keys, (s * F.col("effect")).alias("effect"), F.when(F.col("_t"), F.col("low")).otherwise(-F.col("high")).alias("low"), F.when(F.col("_t"), F.col("high")).otherwise(-F.col("low")).alias("high"))


def supporting_reports(statements: DataFrame, keys: list[str], positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Statements of pairs that have a positive report and are no evidenced negative."""
    ok = [F.col(k).isNotNull() for k in keys]
    p, n = positive, negative
    for c in ok:
        p, n = p.where(c), n.where(c)
    return statements.join(p.select(*keys).distinct(), keys, "left_semi").join(n.select(*keys).distinct(), keys, "left_anti")


def placement_records(placements: DataFrame, keys: list[str], ordinal: str, placement: str, citation: str) -> DataFrame:
    """(keys, placement, citations): a pair's first placement and its distinct citations."""
    return placements.groupBy(*keys).agg(F.min_by(placement, ordinal).alias(placement), F.count_distinct(citation).alias("citations"))


def sign_decisions(rows: DataFrame, keys: list[str], sign: str, citation: str) -> DataFrame:
    """(keys, positive, negative, decision): distinct citations on each side and the sign that has more, 0 where equal."""
    p, n = F.count_distinct(F.when(F.col(sign) > 0, F.col(citation))), F.count_distinct(F.when(F.col(sign) < 0, F.col(citation)))
    per = rows.groupBy(*keys).agg(p.alias("positive"), n.alias("negative"))
    return per.withColumn("decision", F.signum(F.col("positive") - F.col("negative")).cast("int"))


def sign_support(edges: DataFrame, first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with the citations on the side of their sign, by the first table,
    else the second, and which it was."""
    side = lambda p: F.when(F.col("sign") > 0, F.col(f"{p}p")).when(F.col("sign") < 0, F.col(f"{p}n"))
    a = first.select(*keys, F.col("positive").alias("ap"), F.col("negative").alias("an"))
    b = second.select(*keys, F.col("positive").alias("bp"), F.col("negative").alias("bn"))
    j = edges.join(a, keys, "left").join(b, keys, "left")
    return j.withColumn("support", F.coalesce(side("a"), side("b"), F.lit(0))).withColumn("basis", F.when(F.col("ap").isNotNull(), "first").when(F.col("bp").isNotNull(), "second").otherwise("none")).drop("ap", "an", "bp", "bn")


def is_evidenced(concerned: Column, support: Column, least: int) -> Column:
    """True for rows the rule does not concern, else whether the support reaches the least."""
    return F.when(~F.coalesce(concerned, F.lit(False)), True).otherwise(F.coalesce(support >= least, F.lit(False)))


def assigned_terms(terms: DataFrame, overrides: DataFrame, phrases: DataFrame, default: str) -> DataFrame:
    """(term, construct, route): by override, else by the longest phrase the name
    contains, else the default. terms(term, name), overrides(term, construct),
    phrases(phrase, construct): phrases meet the names that have their first word."""
    first = lambda c: F.split_part(F.lower(c), F.lit(" "), F.lit(1))
    words = terms.select("term", F.lower("name").alias("_name"), F.explode(F.array_distinct(F.split(F.lower("name"), " "))).alias("_w"))
    p = phrases.select(F.lower("phrase").alias("_p"), "construct", first(F.col("phrase")).alias("_w")).where("_w <> ''")
    hit = words.join(p, "_w").where(F.expr("contains(concat(' ', _name, ' '), concat(' ', _p, ' '))"))
    best = hit.groupBy("term").agg(F.min_by("construct", F.struct(-F.length("_p"), F.col("_p"), F.col("construct"))).alias("_c"))
    o = overrides.groupBy("term").agg(F.min("construct").alias("_o"))
    j = terms.select("term").distinct().join(o, "term", "left").join(best, "term", "left")
    return j.select("term", F.coalesce("_o", "_c", F.lit(default)).alias("construct"), F.when(F.col("_o").isNotNull(), "override").when(F.col("_c").isNotNull(), "phrase").otherwise("default").alias("route"))
