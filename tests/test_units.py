import pytest

from tarnwork.operators.units import Finder, bound_shares, read_text

F = Finder()


@pytest.mark.parametrize("text, want", [
    ("X is 94 percent bound to plasma proteins.", ("bound", "percent", 94, 94)),
    ("Binding of X was 91–96% in vitro.", ("bound", "percent", 91, 96)),
    ("Binding of X was between 97 and 99% .", ("bound", "percent", 97, 99)),
    ("About 22 % of X circulates unbound.", ("free", "percent", 22, 22)),
    ("The unbound fraction (fu) of X is 0,05.", ("free", "fraction", 0.05, 0.05)),
    ("A bound fraction of 0.84 to 0.85 was measured for X.", ("bound", "fraction", 0.84, 0.85)),
    ("X is bound to plasma proteins at 732 per mille.", ("bound", "permille", 732, 732)),
    ("Protein binding of X amounts to eighty-six per cent.", ("bound", "percent", 86, 86)),
    ("Out of 100 parts of X in plasma, 87 are protein-bound.", ("bound", "permille", 870, 870)),
    ("9 of every 10 molecules of X are bound to plasma protein.", ("bound", "permille", 900, 900)),
    ("X binds to plasma proteins in a ratio of 87:100 (bound to total).", ("bound", "permille", 870, 870)),
    ("Its main metabolite, M5, is 35% bound.", None),
    ("Oral bioavailability is about 66%.", None),
    ("X is highly bound to plasma proteins.", None),
    ("", None),
    (None, None),
])
def test_statements(text, want):
    assert read_text(F, text) == want


def test_metabolite_clause_does_not_hide_the_drug():
    assert read_text(F, "Its main metabolite, M5, is 35% bound. X is 80% bound.") == ("bound", "percent", 80, 80)


def shares(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string, lo double, hi double, fu double, b99 boolean, unit string")
    return {r[0]: (r[1], r[2]) for r in bound_shares(df, "id", "text", "lo", "hi", "fu", "b99").select("id", "low_permille", "high_permille").collect()}


def test_columns_and_text(spark):
    nan = float("nan")
    rows = [
        (1, None, 86.0, None, 0.14, False, "z"), (2, "", 0.5, 0.52, None, None, ""), (3, None, 870.0, 880.0, None, None, None),
        (4, "X: fu = 0.25 in human plasma.", 25.0, 25.0, None, None, ""), (5, None, None, None, 75.0, False, ""), (6, None, 1.0, 1.0, None, True, ""),
        (7, None, 60.0, 60.0, 0.94, False, ""), (8, None, None, None, None, None, ""), (9, None, nan, nan, nan, None, ""), (10, "x " * 50_000 + "X is 12% bound.", None, None, None, None, ""),
    ]
    assert shares(spark, rows) == {1: (860, 860), 2: (500, 520), 3: (870, 880), 4: (750, 750), 5: (250, 250), 6: (990, 990), 7: (60, 60), 10: (120, 120)}
    assert shares(spark, rows[:0]) == {}


def test_measurements_of_any_quantity(spark):
    from tarnwork.operators.units import measurements

    texts = {
        1: "A dose of 1,200 mg in 2.5 l over 90 min.", 2: "Eine Gabe von 1,5 g; danach 1,200 mg.", 3: "levels of 10 to 20 mg/l after 3h", 4: "kept at 98.6 °F or 37 °C", 5: "50% of 250 micrograms", 6: None, 7: "", 8: "no unit 12, no number mg", 9: "twenty mg", 10: "5 M solution of 7 L",
    }
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "id int, body string, unit string")
    got = {}
    for r in measurements(df, "id", "body").collect():
        got.setdefault(r["id"], []).append((r["quantity"], round(r["common_low"], 6), round(r["common_high"], 6)))
    got = {k: sorted(v) for k, v in got.items()}
    assert got[1] == [("mass", 1.2, 1.2), ("time", 1.5, 1.5), ("volume", 2.5, 2.5)]
    assert got[2] == [("mass", 0.0012, 0.0012), ("mass", 1.5, 1.5)]
    assert got[3] == [("concentration", 10.0, 20.0), ("time", 3.0, 3.0)]
    assert got[4] == [("temperature", 37.0, 37.0), ("temperature", 37.0, 37.0)]
    assert got[5] == [("mass", 0.00025, 0.00025), ("share", 0.5, 0.5)]
    assert got[9] == [("mass", 0.02, 0.02)] and got[10] == [("volume", 7.0, 7.0)]
    assert set(got) == {1, 2, 3, 4, 5, 9, 10}
    assert measurements(df.limit(0), "id", "body").count() == 0
