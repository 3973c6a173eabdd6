import json
import zipfile

from pyspark.sql import functions as F

from tarnwork.sources import readers as R
from tarnwork.sources import sinks as S
from tarnwork.streaming import contingency as C

OBO = """format-version: 1.2

[Term]
id: HP:0000001
name: All

[Term]
id: HP:0000002
name: A ! thing
is_a: HP:0000001 ! All

[Term]
id: HP:0000003
name: Old
is_a: HP:0000001
is_obsolete: true

[Term]
id: HP:0000004
name: B
is_a: HP:0000002 ! A
relationship: part_of HP:0000001 ! All
property_value: http://x/charge "-1" xsd:string

[Typedef]
id: part_of
"""


def test_ontology(spark, tmp_path):
    (tmp_path / "o.obo").write_text(OBO)
    s = R.read_stanzas(spark, str(tmp_path / "o.obo"))
    got = {tuple(r) for r in R.ontology_links(s, ["part_of"], "HP:").collect()}
    assert got == {("HP:0000002", "HP:0000001", "is_a"), ("HP:0000004", "HP:0000002", "is_a"), ("HP:0000004", "HP:0000001", "part_of")}
    assert {(r.id, r.value) for r in R.ontology_property(s, "charge").collect()} == {("HP:0000004", "-1")}


def test_annotations_and_ragged(spark, tmp_path):
    head = "\t".join(["database_id", *R.ANNOTATION_COLUMNS[1:]])
    rows = ["\t".join([d, "n", "", t, "PMID:1", "PCS", "", f, "", "", "P", ""]) for d, t, f in (("OMIM:1", "HP:1", "3/5"), ("OMIM:1", "HP:2", "-"), ("OMIM:1", "HP:1", '0/35"'))]
    (tmp_path / "p.hpoa").write_text("\n".join(["#version", head, *rows]) + "\n")
    a = R.read_annotations(spark, str(tmp_path / "p.hpoa")).orderBy("ordinal").collect()
    assert [(r.term_id, r.pair_ordinal, r.frequency) for r in a] == [("HP:1", 1, "3/5"), ("HP:2", 1, "-"), ("HP:1", 2, '0/35"')]
    (tmp_path / "r.tsv").write_text("a\tb\tc\td\ne\tf\ng\th\ti\tj\tk\n")
    assert [(r.w, r.z) for r in R.read_ragged(spark, str(tmp_path / "r.tsv"), list("wxyz")).collect()] == [("a", "d"), ("g", "j")]


def test_json_xml_matrix_zip(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"publication_dates_by_pmid": {"7": {"year": 2001, "month": 5}, "8": {"year": None}, "9": {"year": 1999, "month": 2, "day": 3}}}))
    assert {(r.pmid, str(r.published)) for r in R.read_publication_dates(spark, str(tmp_path / "d.json")).collect()} == {("7", "2001-05-01"), ("9", "1999-02-03")}
    (tmp_path / "l.json").write_text('[{"id": "a", "n": 1}, {"id": "b"}]')
    assert R.read_json_list(spark, str(tmp_path / "l.json"), "id string, n long").count() == 2
    (tmp_path / "x.xml").write_text("<r><D><id>1</id><m>a</m><m>b</m></D><D><id>2</id></D></r>")
    assert {(r.id, len(r.m or [])) for r in R.read_xml_rows(spark, str(tmp_path / "x.xml"), "D", "id string, m array<string>").collect()} == {("1", 2), ("2", 0)}
    (tmp_path / "g.gct").write_text("#1.2\n2\t3\nName\tDescription\tBrain - a\tBrain - b\tLiver\ng1\tS\t1\t3\t9\ng2\tT\t0\t0\t\n")
    m = R.matrix_extremes(R.read_matrix(spark, str(tmp_path / "g.gct"), ["Name", "Description"]), "Name", "Brain")
    assert {(r.Name, r.inside_max, r.inside_mean, r.rest_max) for r in m.collect()} == {("g1", 3.0, 2.0, 9.0), ("g2", 0.0, 0.0, None)}
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t.tsv", "a\tb\n1\t2\n3\n")
    assert [tuple(r) for r in R.read_zipped(spark, str(tmp_path / "t.zip"), "t.tsv", ["a", "b"]).collect()] == [("1", "2"), ("3", None)]


def test_term_annotations(spark, tmp_path):
    def row(o, q, t, e):
        return "\t".join(["U", o, "s", q, t, "r", e, "", "F"] + [""] * 8)

    (tmp_path / "g.gaf").write_text("!gaf\n" + "\n".join([row("P1", "", "T:2", "EXP"), row("P1", "NOT|x", "T:3", "EXP"), row("P2", "", "T:2", "ND")]) + "\n")
    a = R.read_term_annotations(spark, str(tmp_path / "g.gaf"), ["ND"])
    links = spark.createDataFrame([("T:2", "T:1", "is_a")], "child string, parent string, relation string")
    assert {(r.object, r.term) for r in R.propagated_terms(a, links).collect()} == {("P1", "T:1"), ("P1", "T:2")}


def test_crosswalk_and_pairs(spark, tmp_path):
    (tmp_path / "c.csv").write_text('symptom,roots,excluded,terms\ntremor,HP:1; HP:2,,"shaking;tremor "\n')
    r = R.read_crosswalk(spark, str(tmp_path / "c.csv")).first()
    assert r.roots == ["HP:1", "HP:2"] and r.terms == ["shaking", "tremor"] and not r.excluded
    line = lambda a, b, ta: "\t".join([f"uniprotkb:{a}", f"uniprotkb:{b}", *["x"] * 7, ta, "taxid:9606(human)"])
    (tmp_path / "n.txt").write_text("\n".join([line("Q2", "P1", "taxid:9606(human)"), line("P1", "Q2", "taxid:9606(human)"), line("P1", "M1", "taxid:10090(mouse)")]) + "\n")
    assert [tuple(x) for x in R.read_interaction_pairs(spark, str(tmp_path / "n.txt")).collect()] == [("P1", "Q2")]


def test_release_and_digest(spark, tmp_path, data):
    r = spark.read.parquet(f"{data}/reports.parquet")
    m = S.write_release({"reports": S.typed_reports(r), "targets": spark.read.parquet(f"{data}/drug_targets.parquet")}, f"file://{tmp_path}")
    assert {x.name: x.row_count for x in m.select("name", "row_count").distinct().collect()}["reports"] == r.count()
    assert S.verify_release(spark, f"file://{tmp_path}").count() == 0
    victim = next(p for p in (tmp_path / "release/targets.csv").iterdir() if p.suffix == ".csv")
    victim.write_text(victim.read_text() + "x\n")
    (tmp_path / "release/targets.csv" / ("." + victim.name + ".crc")).unlink(missing_ok=True)
    assert [x.state for x in S.verify_release(spark, f"file://{tmp_path}").collect()] == ["changed"]
    a = S.table_digest(r).first().digest
    assert a == S.table_digest(r.repartition(7)).first().digest != S.table_digest(r.limit(10)).first().digest
    b, n = S.blank_column(r, "source_term_label", "source", ["trial-arm"])
    assert n.first().blanked == b.where("source = 'trial-arm' and source_term_label = ''").count() - r.where("source = 'trial-arm' and source_term_label = ''").count()


def _run(df, name):
    q = df.writeStream.format("memory").outputMode("append").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_streams(spark, data, tmp_path):
    spark.read.parquet(f"{data}/events.parquet").repartition(1).write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    got = _run(C.windowed_counts(s, "ts", "user_id", "event_type", "1 day"), "w")
    batch = e.groupBy(F.window("ts", "1 day").alias("w"), "user_id", "event_type").count()
    closed = got.agg(F.max("start")).first()[0]
    assert got.count() == batch.where(F.col("w.start") <= F.lit(closed)).count() > 0
    twice = e.union(e)
    twice.repartition(1).write.parquet(str(tmp_path / "t"))
    d = _run(C.first_deliveries(spark.readStream.schema(e.schema).parquet(str(tmp_path / "t")), "event_id", "ts"), "d")
    assert d.count() == e.count()
    assert _run(C.sessions(s, "ts", "user_id"), "s").where("end <= start").count() == 0
