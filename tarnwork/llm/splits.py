"""Train, validation and test splits that keep related records together.

Blocks come from the distributed union-find of ``groups.forest_groups``. Blocks
are assigned greedily, largest first, each to the split furthest below its
target. The greedy runs over the histogram of block sizes: blocks of one size
are alike, so the driver holds one row per distinct size (at most the square
root of twice the number of records), and the blocks themselves are matched to
the outcome by their exact position among the blocks of their size.

Defined results: a record without any link is a block of its own; null links
link nothing (blanks and placeholders are to be null); a record with a null
key cannot be named and gives no row; repeated records give repeated rows;
splits of equal need are taken in the order given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.groups import forest_groups
from tarnwork.operators.positions import with_positions
from tarnwork.session import Workspace


def blocks(df: DataFrame, key: str, links: list[str], ws: Workspace) -> DataFrame:
    """(key, first): the smallest key of each record's block. ``links`` are
    columns with normalised ids; records that share a value of one of them
    belong together."""
    tagged = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{i}|"), F.col(c).cast("string"))) for i, c in enumerate(links)]
    base = ws.cut(df.select(F.col(key).alias("key"), *(t.alias(f"k{i}") for i, t in enumerate(tagged))).where("key is not null"))
    ks = [f"k{i}" for i in range(len(links))]
    pairs = [base.select(F.col(a).alias("a"), F.col(b).alias("b")).where(f"{a} is not null and {b} is not null").distinct() for i, a in enumerate(ks) for b in ks[i + 1 :]]
    rooted = base.withColumn("node", F.coalesce(*ks, F.concat(F.lit("own|"), F.col("key").cast("string"))))
    if pairs:
        roots = forest_groups(reduce(DataFrame.unionByName, pairs), ws=ws)
        rooted = rooted.join(roots, "node", "left")
    else:
        rooted = rooted.withColumn("root", F.lit(None).cast("string"))
    rooted = ws.cut(rooted.select("key", F.coalesce("root", "node").alias("root")))
    firsts = rooted.groupBy("root").agg(F.min("key").alias("first"))
    return rooted.join(firsts, "root").select("key", "first")


def greedy_by_size(histogram: dict[int, int], shares: list[float]) -> dict[int, list[int]]:
    """How many blocks of each size go to each split, largest size first."""
    total = sum(s * n for s, n in histogram.items())
    need = [x / sum(shares) * total for x in shares]
    out: dict[int, list[int]] = {}
    k = len(shares)
    for size in sorted(histogram, reverse=True):
        left, got = histogram[size], [0] * k
        while left:
            if max(need) - min(need) < size and left > k:
                turns = left // k
                for i in range(k):
                    got[i] += turns
                    need[i] -= turns * size
                left -= turns * k
                continue
            i = need.index(max(need))
            rest = max((d for j, d in enumerate(need) if j != i), default=need[i])
            n = min(left, max(1, int((need[i] - rest) / size)))
            got[i] += n
            need[i] -= n * size
            left -= n
        out[size] = got
    return out


def grouped_split(df: DataFrame, key: str, links: list[str], shares: dict[str, float]) -> DataFrame:
    """(key, first, split) for every record."""
    ws = Workspace(df.sparkSession, "split")
    member = ws.cut(blocks(df, key, links, ws))
    sized = member.groupBy("first").agg(F.count("*").alias("size"))
    placed = ws.cut(with_positions(ws, sized, {"pos": ("size", None)}))
    histogram = {r["size"]: r["n"] for r in placed.groupBy("size").agg(F.count("*").alias("n")).toLocalIterator()}
    names = list(shares)
    ranges = [
        (size, name, sum(got[:i]), sum(got[: i + 1]))
        for size, got in greedy_by_size(histogram, [shares[n] for n in names]).items()
        for i, name in enumerate(names)
        if got[i]
    ]
    # one row per distinct size and split; whether it is broadcast is left to its size
    table = df.sparkSession.createDataFrame(ranges, "size long, split string, lo long, hi long")
    outcome = placed.join(table, "size").where("pos >= lo and pos < hi").select("first", "split")
    return member.join(outcome, "first").select(F.col("key").alias(key), "first", "split")
