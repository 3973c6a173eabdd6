"""Consensus labels, agreement and annotator reliability from disagreeing labels.

Method: bipartite message passing on label edges, one class against the rest.
An item tells each of its annotators how likely the class is by the votes of
the others; an annotator tells each of its items how much its vote for or
against the class is worth by how it fared on its other items. Messages leave
out the receiver, and are iterated until they move no more. They are rows, one
per edge, and are summed by item and by annotator, so neither the number of
annotators nor that of an item's labels is bounded.

Annotators that copy each other would confirm one another, so annotators whose
agreement is far above what their reliabilities explain form one voice: their
votes are summed before they speak, and neither hears the other.

Items with the same votes send the same messages, so items are collapsed into
distinct vote patterns with multiplicities before the iteration; results do
not change by it.

Defined results: null labels and null annotators give no vote; an annotator's
several labels of one item count as its more frequent one, and as no vote for
the message passing where they tie; an item whose votes balance exactly gets the
class; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm.groups import boruvka_groups
from tarnwork.operators.joins import hot_left_join
from tarnwork.session import Workspace

#: Pseudo-counts for an annotator's hit rates: worth this many votes of an even guesser.
PRIOR = 2.0
#: Two annotators are one voice if they agree on this share of what independent ones of their reliability would
#: disagree on, by more than so many standard errors, over at least so many items.
COPY_SHARE, COPY_ERRORS, COPY_SUPPORT = 0.4, 4.0, 30
#: A voice with more than this share of the edges is hot; there are at most ``1 / HOT_SHARE`` of them.
HOT_SHARE = 1e-3
#: Fits of reliabilities a table is written for.
STEPS = 3
#: Edges of one pattern that one task may sum by a window.
WIDE = 10_000


def vote_patterns(ws: Workspace, votes: DataFrame, items: list[str]) -> tuple[DataFrame, DataFrame]:
    """(items..., pattern, n_annotators) and the edges (pattern, n, annotator, vote).

    A pattern is named by two hashes summed over its votes, so that no item's
    votes are gathered; its edges are those of its smallest item.
    """
    vote = F.struct("annotator", "vote")
    name = F.concat_ws(".", F.count("*").cast("string"), F.bit_xor(F.xxhash64(vote)).cast("string"), F.sum(F.xxhash64(F.lit(7), vote).cast("decimal(38,0)")).cast("string"))
    per_item = ws.cut(votes.groupBy(*items).agg(name.alias("pattern"), F.count("*").alias("n_annotators")))
    patterns = per_item.groupBy("pattern").agg(F.count("*").alias("n"), F.min(F.struct(*items)).alias("_i")).select("pattern", "n", "_i.*")
    return per_item, ws.cut(votes.join(patterns, items).select("pattern", "n", "annotator", F.col("vote").cast("int").alias("vote")))


def _pairs(edges: DataFrame) -> DataFrame:
    """(i, j, c, both), both ways: how far two annotators agree over the items
    both labelled, for pairs with enough of them. It is made by pattern, of
    annotators that have enough items at all."""
    e = edges.where("vote <> 0")
    often = e.groupBy("annotator").agg(F.sum("n").alias("_m")).where(F.col("_m") >= COPY_SUPPORT).select("annotator")
    e = e.join(often, "annotator", "left_semi")
    a, b = e.select("pattern", "n", F.col("annotator").alias("i"), F.col("vote").alias("vi")), e.select("pattern", F.col("annotator").alias("j"), F.col("vote").alias("vj"))
    p = a.join(b, "pattern").where("i < j").groupBy("i", "j").agg(F.sum(F.col("n") * F.col("vi") * F.col("vj")).alias("agree"), F.sum("n").alias("both"))
    p = p.where(F.col("both") >= COPY_SUPPORT).select("i", "j", (F.col("agree") / F.col("both")).alias("c"), "both")
    return p.unionByName(p.select(F.col("j").alias("i"), F.col("i").alias("j"), "c", "both"))


def _fit(ws: Workspace, pairs: DataFrame, start: DataFrame | None, steps: int = STEPS, tol: float = 1e-3) -> DataFrame:
    """(j, r): reliabilities whose products fit the pairs' agreement best."""
    r = start if start is not None else pairs.select("j").distinct().withColumn("r", F.lit(0.5))
    held: DataFrame | None = None
    while True:
        new = r.withColumn("was", F.col("r"))
        for _ in range(steps):
            s = pairs.join(new.select("j", "r"), "j").groupBy("i").agg((F.sum(F.col("both") * F.col("c") * F.col("r")) / F.greatest(F.sum(F.col("both") * F.col("r") * F.col("r")), F.lit(1e-9))).alias("f"))
            f = F.least(F.greatest(F.col("f"), F.lit(-0.99)), F.lit(0.99))
            new = new.join(s.withColumnRenamed("i", "j"), "j").select("j", ((F.col("r") + f) / 2).alias("r"), "was")
        table, seen = ws.measured(new, moved=F.max(F.abs(F.col("r") - F.col("was"))))
        ws.drop(held)
        r, held = table.select("j", "r"), table
        if (seen["moved"] or 0.0) <= tol:
            return r


def _copies(ws: Workspace, edges: DataFrame) -> DataFrame | None:
    """(annotator, voice) of annotators that copy each other, or none. The
    agreement of independent annotators is the product of their reliabilities;
    pairs far above it are copies, the clearest first, the rest being fitted anew."""
    pairs, seen = ws.measured(_pairs(edges))
    flagged: DataFrame | None = None
    r: DataFrame | None = None
    while seen["n"]:
        r = _fit(ws, pairs, r)
        apart = F.col("ri") * F.col("rj")
        far = F.col("c") - apart > COPY_ERRORS * F.sqrt((1 - apart * apart) / F.col("both"))
        shared = pairs.join(r.select(F.col("j").alias("i"), F.col("r").alias("ri")), "i").join(r.select("j", F.col("r").alias("rj")), "j")
        shared, seen = ws.measured(shared.select("i", "j", "c", "both", F.when(far, (F.col("c") - apart) / (1 - apart)).otherwise(0.0).alias("share")), top=F.max("share"))
        if not seen["n"] or seen["top"] <= COPY_SHARE:
            break
        clear = (COPY_SHARE + seen["top"]) / 2
        found = shared.where(F.col("share") >= clear).select(F.col("i").alias("a"), F.col("j").alias("b"))
        flagged = found if flagged is None else flagged.unionByName(found)
        pairs, seen = ws.measured(shared.where(F.col("share") < clear).select("i", "j", "c", "both"))
    if flagged is None:
        return None
    groups = boruvka_groups(flagged)
    return ws.cut(groups.select(F.col("node").alias("annotator"), F.col("root").alias("voice")))


def _chance(odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-30.0)), F.lit(30.0))))


def _worth(state: DataFrame, hot: DataFrame | None) -> DataFrame:
    """The edges with ``w``, the log odds the vote adds by how its voice fared on its other items."""
    yes, msg = (F.col("vote") > 0).cast("double"), F.col("msg")
    parts = (msg * yes, msg, (1 - msg) * yes, 1 - msg)
    counts = state.groupBy("voice").agg(*(F.sum(F.col("n") * p).alias(f"c{k}") for k, p in enumerate(parts)))
    # few voices are broadcast, more are joined with the hot ones spread
    e = state.join(F.broadcast(counts), "voice") if hot is None else hot_left_join(state, counts, "voice", hot, F.col("pattern"))
    rate = lambda k: F.least(F.greatest((F.col(f"c{k}") - parts[k] + PRIOR / 2) / (F.col(f"c{k + 1}") - parts[k + 1] + PRIOR), F.lit(1e-4)), F.lit(1 - 1e-4))
    a, b = rate(0), rate(2)
    return e.withColumn("w", F.when(F.col("vote") > 0, F.log(a / b)).otherwise(F.log((1 - a) / (1 - b)))).drop("c0", "c1", "c2", "c3")


def consensus(labels: DataFrame, items: list[str], annotator: str, label: str, positive: object, rounds: int = 60, tol: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """``labels``: one row per label, already without repeated deliveries.

    Returns per item (items..., n_annotators, consensus boolean, certainty,
    agreement) and per annotator (annotator, n_items, sensitivity, specificity,
    reliability, voice). ``positive`` is the class set against the rest; for
    more than two classes call once per class and take the most certain.
    """
    ws = Workspace(labels.sparkSession, "consensus")
    value = F.when(F.col(label) == F.lit(positive), 1).otherwise(-1)
    votes = ws.cut(
        labels.where(F.col(label).isNotNull() & F.col(annotator).isNotNull())
        .groupBy(*items, F.col(annotator).cast("string").alias("annotator")).agg(F.signum(F.sum(value)).cast("int").alias("vote"))
    )
    per_item, edges = vote_patterns(ws, votes, items)
    copies = _copies(ws, edges)
    named = edges.withColumn("voice", F.col("annotator"))
    if copies is not None:
        named = edges.join(copies, "annotator", "left").withColumn("voice", F.coalesce("voice", "annotator"))
    # a voice says the sign of its members' sum, and nothing where they balance
    spoken = named.groupBy("pattern", "voice").agg(F.max("n").alias("n"), F.signum(F.sum("vote")).cast("int").alias("vote")).where("vote <> 0")
    spoken, seen = ws.measured(spoken)
    most = F.lit(HOT_SHARE * seen["n"])
    voices, known = ws.measured(spoken.groupBy("voice").agg(F.count("*").alias("_m")))
    hot = None if known["n"] <= 2 / HOT_SHARE else ws.cut(voices.where(F.col("_m") > most).select("voice"))
    wide, known = ws.measured(spoken.groupBy("pattern").agg(F.count("*").alias("_m")).where(F.col("_m") > F.greatest(most, F.lit(WIDE))).select("pattern"))

    def in_items(e: DataFrame, **sums: Column) -> DataFrame:
        """The sums over each edge's pattern. Where a pattern is too wide for a task, sums are joined."""
        if not known["n"]:
            return e.select("*", *(F.sum(c).over(Window.partitionBy("pattern")).alias(k) for k, c in sums.items()))
        return hot_left_join(e, e.groupBy("pattern").agg(*(F.sum(c).alias(k) for k, c in sums.items())), "pattern", wide, F.col("voice"))

    # the first message is the share of the others' votes for the class
    yes = (F.col("vote") > 0).cast("double")
    state = in_items(spoken, k=F.lit(1), yes=yes).select("pattern", "n", "voice", "vote", "k", ((F.col("yes") - yes + 0.5) / F.col("k")).alias("msg"), F.lit(1.0).alias("moved"))
    # each edge carries its item's part of the class's share, so that the share is observed while writing
    figures = {"moved": F.max("moved"), "mass": F.sum(F.col("n") * F.col("msg") / F.col("k")), "all_": F.sum(F.col("n") / F.col("k"))}
    state, seen = ws.measured(state, **figures)
    done, prior = 0, 0.0
    while seen["n"]:
        share = min(max(seen["mass"] / seen["all_"], 0.02), 0.98)
        prior = share / (1 - share)
        if done >= rounds or seen["moved"] <= tol:
            break
        told = in_items(_worth(state, hot), sum_w=F.col("w"))
        msg = _chance(F.log(F.lit(prior)) + F.col("sum_w") - F.col("w"))
        new, seen = ws.measured(told.select("pattern", "n", "voice", "vote", "k", msg.alias("msg"), F.abs(msg - F.col("msg")).alias("moved")), **figures)
        ws.drop(state)
        state, done = new, done + 1

    odds = _worth(state, hot).groupBy("pattern").agg(F.sum("w").alias("odds"))
    odds = per_item.select("pattern").distinct().join(odds, "pattern", "left").select("pattern", (F.coalesce("odds", F.lit(0.0)) + (F.log(F.lit(prior)) if prior else F.lit(0.0))).alias("odds"))
    decided = ws.cut(odds.select("pattern", (F.col("odds") >= 0).alias("consensus"), _chance(F.abs("odds")).alias("certainty")))
    truth = ws.cut(hot_left_join(edges, decided, "pattern", wide, F.col("annotator")))
    agreed = truth.where("vote <> 0").groupBy("pattern").agg(F.avg(((F.col("vote") > 0) == F.col("consensus")).cast("double")).alias("agreement"))
    decided = decided.join(agreed, "pattern", "left").select("pattern", "consensus", "certainty", F.coalesce("agreement", F.lit(0.0)).alias("agreement"))
    per = per_item.join(decided, "pattern").select(*items, "n_annotators", "consensus", "certainty", "agreement")

    n, yes, said = F.col("n"), F.col("consensus"), F.col("vote")
    rates = truth.groupBy("annotator").agg(
        F.sum("n").alias("n_items"),
        F.sum(F.when(yes & (said > 0), n).otherwise(0)).alias("tp"), F.sum(F.when(yes & (said != 0), n).otherwise(0)).alias("p"),
        F.sum(F.when(~yes & (said < 0), n).otherwise(0)).alias("tn"), F.sum(F.when(~yes & (said != 0), n).otherwise(0)).alias("q"),
    )
    if copies is not None:
        rates = rates.join(copies, "annotator", "left")
    else:
        rates = rates.withColumn("voice", F.lit(None).cast("string"))
    rel = rates.select(
        "annotator", "n_items", ((F.col("tp") + PRIOR / 2) / (F.col("p") + PRIOR)).alias("sensitivity"), ((F.col("tn") + PRIOR / 2) / (F.col("q") + PRIOR)).alias("specificity"),
        ((F.col("tp") + F.col("tn") + PRIOR / 2) / (F.col("p") + F.col("q") + PRIOR)).alias("reliability"), F.coalesce("voice", "annotator").alias("voice"),
    )
    return per, rel
