"""Readers, each over a whole table written in the format it reads."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.ids import hpo_id
from tarnwork.operators.evidence import required
from tarnwork.plans.graph_queries import _hp
from tarnwork.plans.scalar_queries import _t
from tarnwork.session import Workspace
from tarnwork.sources import readers as R

_PLAIN = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n\"\\]", " ")


def _text(spark: SparkSession, name: str, lines: DataFrame, sep: str = "\n") -> str:
    """The folder a one-column table is written to as text."""
    path = f"{Workspace(spark, name).root}/text"
    lines.write.option("lineSep", sep).text(path)
    return path


def _tsv(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.concat_ws("\t", *[_PLAIN(c) for c in columns]).alias("value"))


def i_tsv(spark, d):
    path = _text(spark, "tsv", _tsv(_t(spark, d, "target_pairs"), ["pair_id", "left_target_id", "matched_on"]))
    r = R.read_tsv(spark, path, ["pair_id", "target", "matched_on", "padded"])
    return r.select(F.col("pair_id").cast("long").alias("pair_id"), F.nullif("target", F.lit("")).alias("target"), F.nullif("matched_on", F.lit("")).alias("matched_on"), "padded")


def i_annotations(spark, d):
    a = _t(spark, d, "annotations").select(*[F.col(c) for c in R.ANNOTATION_COLUMNS])
    path = _text(spark, "annotations", _tsv(a, R.ANNOTATION_COLUMNS))
    return R.read_annotations(spark, path).groupBy("disease_id", "term_id").agg(F.count("*").alias("rows"), F.max("pair_ordinal").cast("long").alias("last"))


def i_ragged(spark, d):
    t = _t(spark, d, "drug_targets").select(F.concat_ws("\t", F.col("drug_target_id"), _PLAIN("pref_name"), "accessions").alias("value"))
    r = R.read_ragged(spark, _text(spark, "ragged", t), ["id", "name", "accession"])
    return r.select(F.col("id").cast("long").alias("id"), "name", "accession")


def _stanzas(spark, d):
    o = _t(spark, d, "ontology").select(hpo_id(F.col("child")).alias("c"), hpo_id(F.col("parent")).alias("p"), _PLAIN("child_name").alias("n")).where("c is not null")
    per = o.groupBy("c").agg(F.min("n").alias("n"), F.sort_array(F.collect_set("p")).alias("p"))
    s = per.select(F.concat(F.lit("[Term]\nid: "), "c", F.lit("\nname: "), "n", F.array_join(F.transform("p", lambda x: F.concat(F.lit("\nis_a: "), x, F.lit(" ! parent"))), ""), F.when(F.col("c").endswith("7"), "\nis_obsolete: true").otherwise(""), F.lit('\nproperty_value: charge "'), F.substring("c", -1, 1), F.lit('" xsd:string')).alias("value"))
    return R.read_stanzas(spark, _text(spark, "stanzas", s, "\n\n"))


def i_stanza_names(spark, d):
    return _stanzas(spark, d).select("id", F.trim("name").alias("name"), "obsolete")


def i_stanza_links(spark, d):
    return R.ontology_links(_stanzas(spark, d), prefix="HP:").select("child", "parent")


def i_stanza_charges(spark, d):
    return R.ontology_property(_stanzas(spark, d), "charge")


def i_crosswalk(spark, d):
    f = _t(spark, d, "fine_constructs").where("name is not null")
    path = f"{Workspace(spark, 'crosswalk').root}/csv"
    f.select(F.col("name").alias("symptom"), F.concat("hpo_id", F.lit("; ")).alias("roots"), F.concat("coarse", F.lit(" ;"), "name").alias("terms")).write.option("header", True).csv(path)
    return R.read_crosswalk(spark, path).select("symptom", F.array_join("roots", "|").alias("roots"), F.array_join("terms", "|").alias("terms"))


def i_publication_dates(spark, d):
    c = _t(spark, d, "ctd_relations").where("pmid is not null").groupBy("pmid").agg(F.min("relation_id").alias("i"))
    one = F.concat(F.lit('"'), "pmid", F.lit('": {"year": '), 1990 + F.col("i") % 30, F.when(F.col("i") % 3 > 0, F.concat(F.lit(', "month": '), 1 + F.col("i") % 12)).otherwise(""), F.lit("}"))
    files = c.groupBy((F.col("i") % 16).alias("k")).agg(F.concat(F.lit('{"publication_dates_by_pmid": {'), F.array_join(F.collect_list(one), ", "), F.lit("}}")).alias("value"))
    path = f"{Workspace(spark, 'dates').root}/json"
    files.repartitionByRange(16, "k").select("value").write.text(path)
    return R.read_publication_dates(spark, path).select("pmid", F.col("published").cast("string").alias("published"))


def i_json_list(spark, d):
    b = _t(spark, d, "ingredient_bridge").select("bridge_row_id", "ingredient_id", "bridge_method", "unified_with_sider")
    path = f"{Workspace(spark, 'list').root}/json"
    b.groupBy((F.col("bridge_row_id") % 8).alias("k")).agg(F.to_json(F.collect_list(F.struct(*b.columns))).alias("value")).repartitionByRange(8, "k").select("value").write.text(path)
    return R.read_json_list(spark, path, b.schema.simpleString()[7:-1].replace(":", " "))


def i_xml_rows(spark, d):
    n = _t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = f"{Workspace(spark, 'xml').root}/xml"
    n.write.format("xml").option("rootTag", "Nations").option("rowTag", "Nation").save(path)
    return R.read_xml_rows(spark, path, "Nation", "n_nationkey int, n_name string, n_regionkey int")


def i_matrix(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    header = spark.createDataFrame([("#1.2\nrows\tcolumns\nid\tname\tbrain_a\tbrain_b\tliver",)], "value string")
    rows = p.select(F.concat_ws("\t", "p_partkey", F.concat(F.lit("p"), "p_partkey"), "p_retailprice", "p_size", F.col("p_size") * 2).alias("value"))
    # one file, as such matrices come, with its header lines first
    path = _text(spark, "matrix", header.withColumn("o", F.lit(0)).unionByName(rows.withColumn("o", F.lit(1))).coalesce(1).sortWithinPartitions("o").select("value"))
    long = R.read_matrix(spark, path, ["id", "name"])
    return R.matrix_extremes(long, "id", "brain").select(F.col("id").cast("long").alias("id"), "inside_max", "inside_mean", "rest_max")


def i_term_annotations(spark, d):
    a = _t(spark, d, "annotations").select(F.lit("db").alias("db"), F.col("disease_id").alias("object"), F.lit("").alias("symbol"), "qualifier", F.col("term_id").alias("term"), F.lit("").alias("reference"), "evidence", F.lit("").alias("with_from"), "aspect", *[F.lit("").alias(c) for c in R.GAF[9:]])
    return R.read_term_annotations(spark, _text(spark, "gaf", _tsv(a, R.GAF)), ["IEA"]).where("object is not null and term is not null").select("object", "term", "aspect")


def i_propagated(spark, d):
    r = _t(spark, d, "reports").select("symptom", hpo_id(F.col("source_term_id")).alias("term")).where("term is not null").distinct()
    o = _t(spark, d, "ontology").select(hpo_id(F.col("child")).alias("child"), hpo_id(F.col("parent")).alias("parent")).where("child is not null and parent is not null").distinct()
    return R.propagated_terms(r.select(F.col("symptom").alias("object"), "term", F.lit("P").alias("aspect")), o).select("object", "term")


def i_interaction_pairs(spark, d):
    p = _t(spark, d, "target_pairs").where("left_target_id is not null and right_target_id is not null")
    acc = lambda c: F.concat(F.lit("uniprotkb:"), F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", "")))
    tax = lambda k: F.when(F.col("pair_id") % k == 0, "taxid:10090(mouse)").otherwise("taxid:9606(human)")
    line = p.select(F.concat_ws("\t", acc("left_target_id"), acc("right_target_id"), *[F.lit("-")] * 7, tax(5), tax(7)).alias("value"))
    return R.read_interaction_pairs(spark, _text(spark, "mitab", line))


def i_zipped(spark, d):
    p = _t(spark, d, "part").select(F.coalesce(F.col("p_partkey").cast("string"), F.lit("")).alias("key"), _PLAIN("p_brand").alias("brand"))
    path = f"{Workspace(spark, 'zip').root}/zips"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = io.BytesIO()
            with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("table.tsv", "key\tbrand\n" + "".join(f"{k}\t{b}\n" for k, b in zip(pdf["key"], pdf["brand"])))
            yield pd.DataFrame({"content": [raw.getvalue()]})

    p.mapInPandas(pack, "content binary").write.parquet(path)
    rows = R.unzipped(spark.read.parquet(path), "table.tsv", ["key", "brand"])
    return rows.select(F.col("key").try_cast("long").alias("key"), "brand")


def i_wanted_codes(spark, d):
    """Rows of the wanted codes of a CSV, after a check of its columns."""
    a = _t(spark, d, "annotations").select("annotation_id", "evidence", "aspect")
    path = f"{Workspace(spark, 'codes').root}/csv"
    a.write.option("header", True).csv(path)
    t = spark.read.schema("annotation_id long, evidence string, aspect string").option("header", True).csv(path)
    return required(t, ["annotation_id", "evidence"]).where(F.col("evidence").isin("PCS", "TAS"))


_O = f"o AS (SELECT {_hp('child')} c, {_hp('parent')} p, trim(regexp_replace(coalesce(child_name, ''), '[\\t\\r\\n\"\\\\]', ' ', 'g')) n FROM ontology), q AS (SELECT * FROM o WHERE c IS NOT NULL)"

SQL = {
    "i_tsv": r"""SELECT pair_id, nullif(regexp_replace(left_target_id, '[\t\r\n"\\]', ' ', 'g'), '') AS target, nullif(matched_on, '') AS matched_on, NULL::VARCHAR AS padded FROM target_pairs""",
    "i_annotations": "SELECT nullif(disease_id, '') AS disease_id, nullif(term_id, '') AS term_id, count(*) AS rows, count(*) AS last FROM annotations GROUP BY nullif(disease_id, ''), nullif(term_id, '') HAVING nullif(disease_id, '') IS NOT NULL AND nullif(term_id, '') IS NOT NULL",
    "i_ragged": r"""SELECT drug_target_id AS id, regexp_replace(coalesce(pref_name, ''), '[\t\r\n"\\]', ' ', 'g') AS name, list_filter(accessions, lambda x: x IS NOT NULL)[1] AS accession FROM drug_targets WHERE len(list_filter(accessions, lambda x: x IS NOT NULL)) > 0""",
    "i_stanza_names": f"WITH {_O} SELECT c AS id, nullif(min(n), '') AS name, c LIKE '%7' AS obsolete FROM q GROUP BY 1, 3",
    "i_stanza_links": f"WITH {_O} SELECT DISTINCT c AS child, p AS parent FROM q WHERE p IS NOT NULL AND c NOT LIKE '%7'",
    "i_stanza_charges": f"WITH {_O} SELECT DISTINCT c AS id, right(c, 1) AS value FROM q",
    "i_crosswalk": "SELECT name AS symptom, coalesce(trim(hpo_id), '') AS roots, concat_ws('|', nullif(trim(coarse), ''), trim(name)) AS terms FROM fine_constructs WHERE name IS NOT NULL",
    "i_publication_dates": "WITH c AS (SELECT pmid, min(relation_id) i FROM ctd_relations WHERE pmid IS NOT NULL GROUP BY 1) SELECT pmid, make_date(1990 + i % 30, CASE WHEN i % 3 > 0 THEN 1 + i % 12 ELSE 1 END, 1)::VARCHAR AS published FROM c",
    "i_json_list": "SELECT bridge_row_id, ingredient_id, bridge_method, unified_with_sider FROM ingredient_bridge",
    "i_xml_rows": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "i_matrix": "SELECT p_partkey AS id, greatest(p_retailprice, p_size) AS inside_max, (p_retailprice + p_size) / 2 AS inside_mean, (p_size * 2)::DOUBLE AS rest_max FROM part",
    "i_term_annotations": "SELECT DISTINCT disease_id AS object, term_id AS term, nullif(aspect, '') AS aspect FROM annotations WHERE coalesce(qualifier, '') NOT LIKE '%NOT%' AND evidence <> 'IEA' AND evidence <> '' AND disease_id <> '' AND term_id <> ''",
    "i_propagated": f"WITH RECURSIVE r AS (SELECT DISTINCT symptom, {_hp('source_term_id')} t FROM reports), o AS (SELECT DISTINCT {_hp('child')} c, {_hp('parent')} p FROM ontology), u(object, term) AS (SELECT symptom, t FROM r WHERE t IS NOT NULL UNION SELECT u.object, o.p FROM u JOIN o ON o.c = u.term WHERE o.p IS NOT NULL) SELECT object, term FROM u",
    "i_interaction_pairs": "WITH p AS (SELECT regexp_replace(upper(left_target_id), '[^A-Z0-9]', '', 'g') x, regexp_replace(upper(right_target_id), '[^A-Z0-9]', '', 'g') y FROM target_pairs WHERE left_target_id IS NOT NULL AND right_target_id IS NOT NULL AND pair_id % 5 <> 0 AND pair_id % 7 <> 0) SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM p WHERE x <> '' AND y <> ''",
    "i_zipped": "SELECT p_partkey AS key, p_brand AS brand FROM part",
    "i_wanted_codes": "SELECT annotation_id, evidence, nullif(aspect, '') AS aspect FROM annotations WHERE evidence IN ('PCS', 'TAS')",
}

QUERIES = {n: globals()[n] for n in SQL}
