"""Readers of the file formats the evidence tables come in.

Every reader declares its schema, and those whose rows have an order give an
``ordinal`` column: file order matters to first-row rules downstream. Ordinals
come from the position of the row's partition and in it, so they are unique
and follow the order in the files without a global sort.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.functions.scalars import split_list

ANNOTATION_COLUMNS = "disease_id disease_name qualifier term_id references evidence onset frequency sex modifier aspect biocuration".split()


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    return df.withColumn(name, F.monotonically_increasing_id())


def read_tsv(spark: SparkSession, path: str, columns: list[str], comment: str | None = None, header: bool = False, sep: str = "\t", quote: str = "") -> DataFrame:
    """Delimited text with a fixed schema; short rows are padded with nulls."""
    r = spark.read.schema(_strings(columns)).option("sep", sep).option("quote", quote).option("header", header).option("mode", "PERMISSIVE").option("enforceSchema", True)
    if comment:
        r = r.option("comment", comment)
    return with_ordinal(r.csv(path))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Disease annotations: comment lines skipped, the header line left out, an
    ordinal per file and one per (disease, term)."""
    df = read_tsv(spark, path, ANNOTATION_COLUMNS, comment="#").where("lower(disease_id) <> 'database_id'")
    first = df.groupBy("disease_id", "term_id").agg(F.sort_array(F.collect_list("ordinal")).alias("_o"))
    return df.join(first, ["disease_id", "term_id"]).withColumn("pair_ordinal", F.array_position("_o", F.col("ordinal"))).drop("_o")


def read_ragged(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """Lines with at least as many fields as columns; further fields are dropped."""
    t = with_ordinal(spark.read.text(path)).withColumn("_p", F.split("value", sep))
    return t.where(F.size("_p") >= len(columns)).select("ordinal", *[F.col("_p")[i].alias(c) for i, c in enumerate(columns)])


def read_stanzas(spark: SparkSession, path: str) -> DataFrame:
    """(kind, id, name, obsolete, body) of an ontology file's stanzas."""
    s = spark.read.option("lineSep", "\n\n").text(path).withColumn("body", F.regexp_replace("value", r"^\s+", ""))
    one = lambda tag: F.nullif(F.regexp_extract("body", rf"(?m)^{tag}: *(.*?)(?: *! .*)?$", 1), F.lit(""))
    return s.select(F.regexp_extract("body", r"^\[(\w+)\]", 1).alias("kind"), one("id").alias("id"), one("name").alias("name"), (F.coalesce(one("is_obsolete"), F.lit("false")) == "true").alias("obsolete"), "body").where("kind <> ''")


def ontology_links(stanzas: DataFrame, relations: list[str] | None = None, prefix: str = "") -> DataFrame:
    """(child, parent, relation) of live terms: is_a and the named relationships."""
    live = stanzas.where((F.col("kind") == "Term") & ~F.col("obsolete") & F.col("id").startswith(prefix))
    isa = live.select(F.col("id").alias("child"), F.explode(F.regexp_extract_all("body", F.lit(r"(?m)^is_a: *(\S+)"), F.lit(1))).alias("parent"), F.lit("is_a").alias("relation"))
    out = isa
    for r in relations or []:
        out = out.union(live.select(F.col("id").alias("child"), F.explode(F.regexp_extract_all("body", F.lit(rf"(?m)^relationship: {r} (\S+)"), F.lit(1))).alias("parent"), F.lit(r).alias("relation")))
    return out.where(F.col("parent").startswith(prefix))


def ontology_property(stanzas: DataFrame, tag: str) -> DataFrame:
    """(id, value) of a property such as a charge."""
    return stanzas.select("id", F.nullif(F.regexp_extract("body", rf'(?m)^property_value: \S*{tag} "?([^"\s]+)', 1), F.lit("")).alias("value")).where("value is not null")


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """(symptom, roots, excluded, terms): list columns separated by semicolons."""
    df = spark.read.option("header", True).option("quote", '"').csv(path)
    pick = lambda *names: next((split_list(F.col(n)) for n in names if n in df.columns), F.array().cast("array<string>"))
    return with_ordinal(df).select("ordinal", F.col(df.columns[0]).alias("symptom"), pick("roots", "hpo_ids").alias("roots"), pick("excluded", "excluded_hpo_ids").alias("excluded"), pick("terms", "label_terms").alias("terms"))


def read_publication_dates(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, published) of a JSON object of year, month and day; parts that are missing are 1."""
    whole = spark.read.option("wholetext", True).text(path)
    entry = T.MapType(T.StringType(), T.StructType([T.StructField(p, T.IntegerType()) for p in ("year", "month", "day")]))
    inner = F.get_json_object("value", "$.publication_dates_by_pmid")
    e = whole.select(F.explode(F.from_json(F.coalesce(inner, F.col("value")), entry)).alias("pmid", "d")).where("d.year > 0")
    return e.select("pmid", F.make_date("d.year", F.coalesce("d.month", F.lit(1)), F.coalesce("d.day", F.lit(1))).alias("published"))


def read_json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of one JSON list per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_xml_rows(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def read_matrix(spark: SparkSession, path: str, id_columns: list[str], skip: int = 2) -> DataFrame:
    """(id columns..., sample, value) of a wide expression matrix with ``skip`` lines before its header."""
    lines = spark.read.text(path)
    header = lines.take(skip + 1)[-1]["value"].split("\t")
    n, width = len(id_columns), len(header)
    c = lines.where(F.col("value") != "\t".join(header)).select(F.split("value", "\t").alias("c")).where(F.size("c") == width)
    samples = F.array(*[F.lit(h) for h in header[n:]])
    return c.select(*[F.col("c")[i].alias(x) for i, x in enumerate(id_columns)], F.explode(F.arrays_zip(samples.alias("s"), F.slice("c", n + 1, width).alias("v"))).alias("z")).select(
        *id_columns, F.col("z.s").alias("sample"), F.col("z.v").try_cast("double").alias("value"))


def matrix_extremes(long: DataFrame, key: str, prefix: str) -> DataFrame:
    """Per key the largest value over samples with the prefix and over the rest, and the mean of the former."""
    inside = F.col("sample").startswith(prefix)
    return long.groupBy(key).agg(F.max(F.when(inside, F.col("value"))).alias("inside_max"), F.avg(F.when(inside, F.col("value"))).alias("inside_mean"), F.max(F.when(~inside, F.col("value"))).alias("rest_max"))


GAF = "db object symbol qualifier term reference evidence with_from aspect name synonym type taxon date assigned_by extension form".split()


def read_term_annotations(spark: SparkSession, path: str, excluded_codes: list[str]) -> DataFrame:
    """(object, term, aspect): negated rows and excluded evidence codes are dropped."""
    df = read_tsv(spark, path, GAF, comment="!")
    keep = ~F.coalesce(F.col("qualifier"), F.lit("")).contains("NOT")
    return df.where(keep & ~F.col("evidence").isin(excluded_codes) if excluded_codes else keep).select("object", "term", "aspect").distinct()


def read_interaction_pairs(spark: SparkSession, path: str, taxon: str = "9606") -> DataFrame:
    """(a, b) accessions of both partners where both are of the taxon; unordered and distinct."""
    df = read_ragged(spark, path, ["a", "b", *[f"c{i}" for i in range(7)], "ta", "tb"])
    acc = lambda c: F.regexp_extract(c, r"uniprotkb:([A-Z0-9]+)", 1)
    of = lambda c: F.col(c).contains(f"taxid:{taxon}(") | F.col(c).endswith(f"taxid:{taxon}")
    p = df.where(of("ta") & of("tb")).select(acc("a").alias("x"), acc("b").alias("y")).where("x <> '' and y <> ''")
    return p.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def read_zipped(spark: SparkSession, path: str, member: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """Rows of one delimited member of each zip file, its header line left out."""
    return unzipped(spark.read.format("binaryFile").load(path), member, columns, sep)


def unzipped(archives: DataFrame, member: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """Rows of one delimited member of each archive in the column ``content``."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                    text = io.TextIOWrapper(f, "utf-8")
                    next(text, None)
                    block = []
                    for line in text:
                        parts = line.rstrip("\r\n").split(sep)
                        block.append((parts + [None] * len(columns))[: len(columns)])
                        if len(block) == 50_000:
                            yield pd.DataFrame(block, columns=columns)
                            block = []
                    if block:
                        yield pd.DataFrame(block, columns=columns)

    return archives.select("content").mapInPandas(rows, _strings(columns))


def propagated_terms(annotations: DataFrame, links: DataFrame) -> DataFrame:
    """Annotations with all ancestors of their terms, the terms included."""
    from tarnwork.operators.graph import reach

    up = reach(links.select(F.col("child").alias("source"), F.col("parent").alias("target")), annotations.select(F.col("term").alias("seed")).distinct())
    return annotations.join(up.select(F.col("seed").alias("term"), F.col("node").alias("ancestor")), "term").select("object", F.col("ancestor").alias("term"), "aspect").distinct()
