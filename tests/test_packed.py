import pytest

from tarnwork.operators.packed import packed_list, segment, shape, unpack, unquoted


def values(text, known=()):
    listed = packed_list(text.strip())
    if listed is not None:
        return listed
    flat, spans, quoted = unquoted(text.strip())
    hits = {(flat.find(k), flat.find(k) + len(k)) for k in known} | set(quoted)
    return segment(flat, spans, hits)


@pytest.mark.parametrize("text, want", [
    ("PMID:1; PMID:2", ["PMID:1", "PMID:2"]),
    ("PMID:1;;PMID:2; ;", ["PMID:1", "PMID:2"]),
    ('"A registry, report 3"; PMID:2', ["A registry, report 3", "PMID:2"]),
    ('"A ""final"" 2" | PMID:2', ['A "final" 2', "PMID:2"]),
    ("“A; table 1”|PMID:2\nPMID:3", ["A; table 1", "PMID:2", "PMID:3"]),
    ("A\\, report 1, PMID:2", ["A, report 1", "PMID:2"]),
    ('["x", "y; z", "x"]', ["x", "y; z", "x"]),
    ("1) ORAL (2) 2) NASAL (3)", ["ORAL (2)", "NASAL (3)"]),
    ("(1) a\n(2) b", ["a", "b"]),
    ("ORAL (1,234); NASAL", ["ORAL (1,234)", "NASAL"]),
    ("A, B, and C", ["A", "B", "C"]),
    ("A；B、C\tD & E and F", ["A", "B", "C", "D", "E", "F"]),
    ("“A” “B”", ["A", "B"]),
    ("a single value with words", ["a single value with words"]),
    ('an "odd quote; b', ['an "odd quote', "b"]),
    ("   ", []),
])
def test_packings(text, want):
    assert values(text) == want


def test_known_value_protects_its_delimiter():
    assert values("INTRAVENOUS, SLOW (2), ORAL (1)", ["INTRAVENOUS, SLOW (2)", "ORAL (1)"]) == ["INTRAVENOUS, SLOW (2)", "ORAL (1)"]


def test_blank_divides_known_values_only():
    flat = "AAAAA1 BBBBB2"
    assert segment(flat, [], {(0, 6), (7, 13)}) == ["AAAAA1", "BBBBB2"]
    assert segment(flat, [], {(0, 6)}) == [flat]


def test_shape_masks_digits_and_codes():
    assert shape("PMID:123") == "pmid:000" and shape("ABCDE1/x") == "AAAAA0/x"


def test_unpack_table(spark):
    rows = [(1, "t", "A; B", "n"), (2, "t", None, "n"), (3, "t", "", "n"), (4, "t", "  ", None), (5, "t", "B", "n"), (6, "t", "A;A;B", "n"), (6, "t", "A;A;B", "n")]
    df = spark.createDataFrame(rows, "id long, kind string, field string, position string")
    got = sorted(tuple(r) for r in unpack(df.drop("position"), ["id"], "field", "kind").collect())
    assert got == [(1, 1, "A", 2), (1, 2, "B", 2), (5, 1, "B", 1), *[(6, 1, "A", 3)] * 2, *[(6, 2, "A", 3)] * 2, *[(6, 3, "B", 3)] * 2]
    # dictionary shards give the same
    assert got == sorted(tuple(r) for r in unpack(df.drop("position"), ["id"], "field", "kind", support=1, shard=1).collect())
    assert unpack(df.limit(0), ["id"], "field", "kind").count() == 0


def test_very_long_field():
    text = "; ".join(f"PMID:{i}" for i in range(5000))
    assert len(values(text)) == 5000


def test_a_known_value_with_many_delimiters_stays_whole():
    from tarnwork.operators.packed import segment

    whole = ", ".join(f"part{chr(97 + i)}" for i in range(20))
    text = f"first; {whole}; last"
    at = text.index(whole)
    assert segment(text, [], {(at, at + len(whole))}) == ["first", whole, "last"]
    assert segment(whole, [], set()) == whole.split(", ")
