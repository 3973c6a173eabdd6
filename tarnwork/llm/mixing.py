"""Records of several sources combined so that each has a target share.

Method: systematic sampling. Every record of a source is expected the same
number of times; within the source the expected copies are summed up in order,
one random offset is added, and a record is emitted once per whole number its
interval crosses. Within a source the order runs through classes of similar
size, so the emitted size stays close to the expected one. The sums are exact
over tasks (positions per class), so a source may hold any share of the rows.

The total is the largest at which every source in stock reaches its share
without exceeding its cap, unless a total is given; then a source that would
exceed its cap gives its cap, and the rest is shared among the others.

Defined results: sources without a target give nothing; a target without
records gives a share of 0 and its share goes to the others in proportion;
records of no size are never emitted; null sources have no target.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.operators.positions import with_positions
from tarnwork.session import Workspace


def expected_copies(sizes: dict[str, int], shares: dict[str, float], caps: dict[str, float], total: float | None = None) -> dict[str, float]:
    """Expected copies of each record, by source."""
    live = {s: w for s, w in shares.items() if sizes.get(s, 0) > 0 and w > 0 and caps[s] > 0}
    if not live:
        return {}
    norm = sum(live.values())
    if total is None:
        total = min(caps[s] * sizes[s] * norm / w for s, w in live.items())
    out: dict[str, float] = {}
    left, open_ = total, dict(live)
    while open_:
        weight = sum(open_.values())
        full = [s for s, w in open_.items() if left * w / weight > caps[s] * sizes[s] * (1 + 1e-12)]
        if not full:
            out.update({s: left * w / weight / sizes[s] for s, w in open_.items()})
            break
        for s in full:
            out[s] = float(caps[s])
            left -= caps[s] * sizes[s]
            del open_[s]
    return out


def mixture(records: DataFrame, key: str, source: str, size: str, targets: DataFrame, total: float | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(key, source, copy, size) per emitted copy, and the report per source.

    ``targets`` (one row per source, a small table): source, target_share, max_repeats.
    """
    spark = records.sparkSession
    ws = Workspace(spark, "mixing")
    aims = {r["source"]: (float(r["target_share"]), float(r["max_repeats"])) for r in targets.select("source", "target_share", "max_repeats").collect()}
    base = records.select(F.col(key).alias("_key"), F.col(source).alias("_src"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    base = base.where(F.col("_src").isin(list(aims)) & (F.col("_size") > 0))
    base = base.withColumn("_cls", F.concat_ws("|", "_src", F.lpad(F.floor(F.log2("_size") * 4).cast("string"), 4, "0")))
    placed = ws.cut(with_positions(ws, base, {"_pos": ("_cls", None)}))
    classes = placed.groupBy("_src", "_cls").agg(F.count("*").alias("n"), F.sum("_size").alias("size")).collect()  # sources by size classes
    sizes: dict[str, int] = {}
    before: dict[str, int] = {}
    starts = []
    for r in sorted(classes, key=lambda r: r["_cls"]):
        sizes[r["_src"]] = sizes.get(r["_src"], 0) + r["size"]
        starts.append((r["_cls"], before.get(r["_src"], 0)))
        before[r["_src"]] = before.get(r["_src"], 0) + r["n"]
    copies = expected_copies(sizes, {s: a[0] for s, a in aims.items()}, {s: a[1] for s, a in aims.items()}, total)
    rng = random.Random(seed)
    offsets = {s: rng.random() for s in sorted(copies)}
    table = [(c, n, copies.get(c.rsplit("|", 1)[0], 0.0), offsets.get(c.rsplit("|", 1)[0], 0.0)) for c, n in starts]
    aim = spark.createDataFrame(table, "_cls string, _start long, _each double, _off double")
    at = F.col("_start") + F.col("_pos")
    crossed = placed.join(F.broadcast(aim), "_cls").withColumn("_n", (F.floor(F.col("_off") + F.col("_each") * (at + 1)) - F.floor(F.col("_off") + F.col("_each") * at)).cast("long"))
    emitted = crossed.where("_n > 0").select(F.col("_key").alias(key), F.col("_src").alias(source), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("copy"), F.col("_size").alias(size))
    used = crossed.groupBy("_src").agg(F.sum(F.col("_size") * F.col("_n")).alias("emitted_size"), F.sum("_n").alias("emitted_records"), F.max("_n").alias("most_copies"), F.sum("_size").alias("stock_size"))
    stock = spark.createDataFrame([(s, a[0], int(a[1]), copies.get(s, 0.0)) for s, a in aims.items()], "source string, target_share double, max_repeats long, expected_copies double")
    rep = stock.join(used, stock.source == used._src, "left").na.fill(0, ["emitted_size", "emitted_records", "most_copies", "stock_size"]).drop("_src")
    whole = F.sum("emitted_size").over(Window.partitionBy())  # one row per source
    rep = rep.withColumn("actual_share", F.coalesce(F.col("emitted_size") / whole, F.lit(0.0)))
    return emitted, rep
