"""Scalar rules over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions import scalars as S


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def s_frequency(spark, d):
    f = F.col("frequency")
    return _t(spark, d, "annotations").select("annotation_id", F.round(S.parse_frequency(f), 6).alias("share"), S.is_zero_fraction(f).alias("zero_of_n"), S.frequency_denominator(f).alias("denominator"))


def s_rubric_weight(spark, d):
    r = _t(spark, d, "reports")
    w = S.rubric_weight(F.col("evidence_code"), F.col("frequency_denominator"))
    return r.select("report_ordinal", F.round(w, 6).alias("rubric_weight"), F.round(S.frequency_scaled(w, F.col("frequency"), 4.0, 0.25), 6).alias("scaled_weight"))


def s_provenance(spark, d):
    a = _t(spark, d, "annotations")
    dates = S.bracketed_dates(F.col("biocuration"))
    when = S.availability(F.when(F.col("disease_id").startswith("OMIM:"), dates), F.lit(None).cast("array<date>"))
    return a.select("annotation_id", S.provenance(F.col("disease_id")).alias("provenance"), when["date"].cast("string").alias("available"), when["source"].alias("date_source"))


def s_limitations(spark, d):
    r = _t(spark, d, "reports")
    n = F.col("frequency_denominator")
    c = S.joined_clauses(
        F.when(F.col("frequency").isNull(), "no frequency reported").when(n.isNull(), "frequency without a patient count"), F.when(n < 10, F.concat(F.lit("n = "), n.cast("string"))),
        F.when(F.col("evidence_code") == "IEA", "inferred electronically"), F.when(F.col("pubmed_reference_count") == 0, "no PubMed reference"))
    return r.select("report_ordinal", c.alias("clauses"))


def s_dates(spark, d):
    e = F.col("evidence_date")
    return _t(spark, d, "reports").select("report_ordinal", S.iso_date(e).cast("string").alias("full_date"), S.published_on(e).cast("string").alias("earliest_date"))


def s_names(spark, d):
    c = _t(spark, d, "ctd_relations")
    return c.select("relation_id", S.normalised_name(F.col("disease_name")).alias("name"), S.slug(F.col("disease_name")).alias("slug"), S.without_prefix(F.col("stitch_flat_id"), "CID1").alias("number"),
                    S.flat_id(F.col("relation_id")).alias("flat_id"))


def s_lists(spark, d):
    r = _t(spark, d, "reports")
    return r.select("report_ordinal", F.array_join(S.split_list(F.col("references")), "|").alias("parts"), F.size(S.split_list(F.col("references"))).cast("long").alias("n"))


def s_prefix_family(spark, d):
    p = [("CID1", "compound"), ("RXCUI:", "ingredient"), ("CHEMBL", "molecule")]
    return _t(spark, d, "split_items").select("item_id", S.first_prefix(F.upper(F.trim("perturbation_id")), p, "gene").alias("family"))


def s_occupancy(spark, d):
    b = _t(spark, d, "target_pairs")
    return b.select("pair_id", F.round(S.occupancy(F.col("score"), 5.0 + F.col("score")), 6).alias("occupancy"), F.round(S.nernst_millivolts(F.col("score") + 1.0, F.col("score") + 10.0, F.lit(1.0)), 6).alias("potential"))


QUERIES = {f.__name__: f for f in (s_frequency, s_rubric_weight, s_provenance, s_limitations, s_dates, s_names, s_lists, s_prefix_family, s_occupancy)}

_W = """least(1.0, greatest(0.1, CASE evidence_code WHEN 'PCS' THEN 1.0 WHEN 'TAS' THEN 0.8 WHEN 'IEA' THEN 0.6 WHEN 'placebo_controlled_frequency' THEN 1.0 WHEN 'frequency' THEN 0.9 WHEN 'label_text' THEN 0.8 ELSE 0.7 END
 * coalesce(0.5 + 0.5 * least(1.0, ln(1 + frequency_denominator::DOUBLE) / ln(21.0::DOUBLE)), 1.0)))::DOUBLE"""

SQL = {
    "s_frequency": r"""
WITH f AS (SELECT annotation_id, trim(frequency, chr(32) || chr(9) || chr(10) || chr(13)) AS t FROM annotations),
p AS (SELECT *, contains(t, '/') AS s, CASE WHEN regexp_full_match(split_part(t, '/', 1), '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*') THEN try_cast(trim(split_part(t, '/', 1)) AS DOUBLE) END AS a,
  CASE WHEN contains(t, '/') AND regexp_full_match(substr(t, instr(t, '/') + 1), '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*') THEN try_cast(trim(substr(t, instr(t, '/') + 1)) AS DOUBLE) END AS b,
  CASE WHEN contains(t, '/') AND regexp_full_match(substr(t, instr(t, '/') + 1), '\s*[+-]?[0-9]+\s*') THEN try_cast(trim(substr(t, instr(t, '/') + 1)) AS BIGINT) END AS n,
  CASE WHEN NOT contains(t, '/') AND ends_with(t, '%') AND regexp_full_match(rtrim(t, '%'), '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*') THEN try_cast(trim(rtrim(t, '%')) AS DOUBLE) END AS c FROM f)
SELECT annotation_id, round(coalesce(CASE t WHEN 'HP:0040280' THEN 1.0 WHEN 'HP:0040281' THEN 0.895 WHEN 'HP:0040282' THEN 0.545 WHEN 'HP:0040283' THEN 0.17 WHEN 'HP:0040284' THEN 0.025 WHEN 'HP:0040285' THEN 0.0 END::DOUBLE,
  CASE WHEN s AND b > 0 AND a IS NOT NULL THEN least(1.0, greatest(0.0, a / b)) END, CASE WHEN c IS NOT NULL THEN least(1.0, greatest(0.0, c / 100)) END), 6) AS share,
  coalesce(s AND a = 0 AND b > 0, false) AS zero_of_n, n AS denominator FROM p""",
    "s_rubric_weight": f"""SELECT report_ordinal, round({_W}, 6) AS rubric_weight, round(CASE WHEN frequency IS NULL THEN {_W} ELSE {_W} * greatest(0.25, least(1.0, frequency * 4.0)) END, 6) AS scaled_weight FROM reports""",
    "s_provenance": r"""
WITH x AS (SELECT annotation_id, disease_id, list_min(list_filter(list_transform(regexp_extract_all(biocuration, '\[(\d{4}-\d{2}-\d{2})\]', 1), lambda s: try_cast(s AS DATE)), lambda s: s IS NOT NULL)) AS m FROM annotations)
SELECT annotation_id, CASE WHEN starts_with(disease_id, 'OMIM:') THEN 'HPO-OMIM' WHEN starts_with(disease_id, 'ORPHA:') THEN 'HPO-Orphanet' END AS provenance,
  CASE WHEN starts_with(disease_id, 'OMIM:') THEN m END::VARCHAR AS available, CASE WHEN starts_with(disease_id, 'OMIM:') AND m IS NOT NULL THEN 'biocuration' END AS date_source FROM x""",
    "s_limitations": """SELECT report_ordinal, concat_ws('; ', CASE WHEN frequency IS NULL THEN 'no frequency reported' WHEN frequency_denominator IS NULL THEN 'frequency without a patient count' END,
  CASE WHEN frequency_denominator < 10 THEN 'n = ' || frequency_denominator END, CASE WHEN evidence_code = 'IEA' THEN 'inferred electronically' END, CASE WHEN pubmed_reference_count = 0 THEN 'no PubMed reference' END) AS clauses FROM reports""",
    "s_dates": r"""
WITH p AS (SELECT report_ordinal, evidence_date e, nullif(try_cast(regexp_extract(evidence_date, '^\s*(\d{4})', 1) AS INT), 0) y, regexp_extract(evidence_date, '^\s*\d{4}[\s/-]*(.*)$', 1) r FROM reports),
q AS (SELECT *, coalesce(CASE lower(regexp_extract(r, '^([A-Za-z]{3})', 1)) WHEN 'jan' THEN 1 WHEN 'feb' THEN 2 WHEN 'mar' THEN 3 WHEN 'apr' THEN 4 WHEN 'may' THEN 5 WHEN 'jun' THEN 6 WHEN 'jul' THEN 7 WHEN 'aug' THEN 8 WHEN 'sep' THEN 9 WHEN 'oct' THEN 10 WHEN 'nov' THEN 11 WHEN 'dec' THEN 12 END,
  try_cast(regexp_extract(r, '^(\d{1,2})(?:\D|$)', 1) AS INT)) m0, try_cast(regexp_extract(r, '^(?:[A-Za-z]+|\d{1,2})[\s/-]+(\d{1,2})(?:\D|$)', 1) AS INT) d0 FROM p),
z AS (SELECT *, CASE WHEN m0 BETWEEN 1 AND 12 THEN m0 END m FROM q)
SELECT report_ordinal, CASE WHEN regexp_full_match(e, '\d{4}-\d{2}-\d{2}') THEN try_cast(e AS DATE) END::VARCHAR AS full_date,
  coalesce(CASE WHEN m IS NOT NULL AND d0 BETWEEN 1 AND 31 THEN try_cast(printf('%04d-%02d-%02d', y, m, d0) AS DATE) END, CASE WHEN y IS NOT NULL THEN try_cast(printf('%04d-%02d-01', y, coalesce(m, 1)) AS DATE) END)::VARCHAR AS earliest_date FROM z""",
    "s_names": r"""SELECT relation_id, lower(trim(regexp_replace(disease_name, '\s+', ' ', 'g'))) AS name, regexp_replace(regexp_replace(lower(disease_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
  regexp_replace(stitch_flat_id, '^CID1', '', 'i') AS number, 'CID1' || substr(lpad(relation_id::VARCHAR, 8, '0'), 1, 8) AS flat_id FROM ctd_relations""",
    "s_lists": """SELECT report_ordinal, array_to_string(list_filter(list_transform(string_split("references", ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts,
  len(list_filter(list_transform(string_split("references", ';'), lambda x: trim(x)), lambda x: x <> ''))::BIGINT AS n FROM reports""",
    "s_prefix_family": """SELECT item_id, CASE WHEN starts_with(upper(trim(perturbation_id)), 'CID1') THEN 'compound' WHEN starts_with(upper(trim(perturbation_id)), 'RXCUI:') THEN 'ingredient' WHEN starts_with(upper(trim(perturbation_id)), 'CHEMBL') THEN 'molecule' ELSE 'gene' END AS family FROM split_items""",
    "s_occupancy": """SELECT pair_id, round(score / (score + pow(10.0, 6.0 - (5.0 + score))), 6) AS occupancy, round(1000 * 8.314462618 * 310.15 / 96485.33212 * ln((score + 1.0) / (score + 10.0)), 6) AS potential FROM target_pairs""",
}
