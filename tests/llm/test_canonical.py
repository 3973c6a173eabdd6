import random
from collections import Counter

import numpy as np

from tarnwork.llm.canonical import BKTree, Matcher, WordBatch, _levenshtein, alignment_distance, map_to_list

ENTRIES = [(1, "zhuflisbumorbate", ["GCJ-68015"]), (2, "celyaxin", []), (3, "celyaxin pamoate", None), (4, "crumskiaxthurel", []), (5, "crumskioxthulel", [])]


def test_bit_parallel_distance_and_tree_equal_brute_force():
    rng = random.Random(4)
    words = list({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(150)})
    queries = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    batch = WordBatch(queries, {c: i for i, c in enumerate("abcd", 1)})
    for w in words[:20]:
        assert list(batch.distances(w, np.arange(60))) == [_levenshtein(w, q) for q in queries]
    tree = BKTree(words)
    for q, got in zip(queries, tree.within(queries, 2)):
        assert sorted(got) == sorted(w for w in words if _levenshtein(w, q) <= 2)
    assert alignment_distance("abcd", "acbd") == 1


def test_spellings():
    m = Matcher(ENTRIES)
    want = {
        "Zhuflisbumorbate": 1, "zhuflisbumorbste maleate": 1, "gcj 68015": 1, "GCJ68015": 1, "zhuflis bumorbate 5mg tab": 1, "zhuflis­bumorbáte": 1, "zhufl-isbumorbate": 1,
        "celyaxin": 2, "CELYAXIN hydrochloride": 2, "pamoate, celyaxin": 3, "celyaxin pamoate 50 mg depot": 3, "celiaxin": 2, "crumskiaxthurle": 4, "crumskioxthulel": 5,
        "tap water": None, "": None, "?": None, "quamtreithdranol 10 mg": None, "x" * 5000: None,
    }
    got = dict(zip(want, m.match(list(want))))
    assert {k: v[-1] if v else None for k, v in got.items()} == want


def test_long_words_and_other_scripts():
    long = "abcdefghij" * 9
    m = Matcher([(1, long, []), (2, "парацетамол", []), (3, "アスピリン", []), (4, "Løvenørsmid", [])])
    want = {long: 1, long[:-2] + "x": 1, "Парацетамол 500 мг": 2, "парацетомол": 2, "アスピリン": 3, "アスピソン": 3, "løvenørsmid": 4, "lovenorsmid": 4, "z" * 90: None}
    got = dict(zip(want, m.match(list(want))))
    assert {k: v[-1] if v else None for k, v in got.items()} == want
    rng = random.Random(6)
    for _ in range(50):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 90))) for _ in range(2))
        old = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y)))
            old = new
        assert _levenshtein(a, b) == old[-1]


def test_table_and_shards(spark):
    rows = [(1, "celyaxin", 0), (2, None, 0), (3, "  ", 0), (4, "celyaxim", 0), (4, "celyaxim", 0), (5, "water", 0)]
    df = spark.createDataFrame(rows, "id long, v string, drug_name int")
    e = spark.createDataFrame([(i, n, c or []) for i, n, c in ENTRIES], "drug_id long, drug_name string, codes array<string>")
    def run(**limits):
        return Counter((r["id"], r["v"], r["drug_id"], r["slips"]) for r in map_to_list(df, ["id"], "v", e, "drug_id", "drug_name", "codes", **limits).collect())

    whole = run()
    assert whole == Counter({(1, "celyaxin", 2, 0): 1, (2, None, None, None): 1, (3, "  ", None, None): 1, (4, "celyaxim", 2, 1): 2, (5, "water", None, None): 1})
    assert run(shard=2) == run(shard=1, per_task=1) == whole
    assert map_to_list(df, ["id"], "v", e.limit(0), "drug_id", "drug_name", "codes").where("drug_id is not null").count() == 0
    assert map_to_list(df.limit(0), ["id"], "v", e, "drug_id", "drug_name").count() == 0


def test_any_shards_give_the_same(spark):
    rng = random.Random(9)
    heads = ["".join(rng.choice("aeiou" if k % 2 else "bdklmnrst") for k in range(rng.randrange(5, 13))) for _ in range(25)]
    quals = ["pamoate", "sulfate", "xr", "depot"]
    entries = [(100 - i, " ".join([rng.choice(heads), *rng.sample(quals, rng.randrange(3))]), [f"AB-{rng.randrange(12)}"]) for i in range(40)]
    entries.append((1, "imipramine", []))
    entries.append((2, "imipramine pamoate", []))

    def typed():
        w = list(rng.choice(entries)[1])
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [rng.choice("abcdeimnt")], [w[i], "s"]])
        return "".join(w) + rng.choice(["", " 5 mg", f" ab{rng.randrange(12)}"])

    rows = [(rng.choice([None, 1, 2, 3]), typed()) for _ in range(150)] + [(1, "imipramine pamoate")] * 3
    df = spark.createDataFrame(rows, "id int, v string")
    e = spark.createDataFrame(entries, "drug_id long, drug_name string, codes array<string>")
    runs = [Counter(map(tuple, map_to_list(df, ["id"], "v", e, "drug_id", "drug_name", "codes", shard=n).collect())) for n in (7, 19, 100_000)]
    assert runs[0] == runs[1] == runs[2] and sum(runs[0].values()) == len(rows)
    assert runs[0][(1, "imipramine pamoate", 2, 0)] >= 3
