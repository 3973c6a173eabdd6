"""Containers of fixed capacity filled with items of varying length.

Method: bin completion. Around the largest item left, the undominated fillings
of the rest of the container are enumerated by branch and bound (fuller first,
branches cut by the waste they can still reach), and the search goes back over
them; a best-fit-decreasing solution is the incumbent, and the search over
fillings is cut by the waste an improvement could have. A search that neither
proves its result nor reaches the lower bound ends after STEPS branches with
the best packing found. Sizes are whole numbers up to the capacity, so the
search runs over the histogram of sizes (at most one row per size), and a
filling found is used as often as its items last. The items themselves are
matched to the containers by their exact position among the items of their
size, so no task and no driver ever holds the items.

Defined results: an item larger than the capacity fills whole containers and
its rest is packed as an item; an item of no size takes no container (container
null); items of equal size are alike and taken in the order of the tasks that read them; a null size
counts as none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.positions import with_positions
from tarnwork.session import Workspace

#: Branches after which a search whose result is not yet proven ends.
STEPS = 100_000
#: Positions of one size in one part of the join of items and containers.
STRETCH = 1024


@dataclass
class Pattern:
    """So many alike containers, each holding ``items`` (size -> how many)."""

    times: int
    items: dict[int, int]


def _sums(counts: dict[int, int], sizes: list[int], room: int) -> list[int]:
    """For each place in ``sizes`` the sums up to ``room`` that the sizes from there on can make, as bits."""
    mask, out = (1 << (room + 1)) - 1, [1]
    for s in reversed(sizes):
        bits, left, step = out[-1], min(counts[s], room // s), 1
        while left:
            step = min(step, left)
            bits |= (bits << (s * step)) & mask
            left -= step
            step *= 2
        out.append(bits)
    return out[::-1]


def _making(counts: dict[int, int], sizes: list[int], sums: list[int], at: int, need: int) -> Iterator[tuple[int, ...]]:
    """All ways to make exactly ``need`` from ``sizes[at:]``; no branch without one is entered."""
    if need == 0:
        yield ()
        return
    while at < len(sizes) and sums[at] >> need & 1:
        s = sizes[at]
        for n in range(min(counts[s], need // s), 0, -1):
            if sums[at + 1] >> (need - n * s) & 1:
                for rest in _making(counts, sizes, sums, at + 1, need - n * s):
                    yield (s,) * n + rest
        at += 1


def fillings(counts: dict[int, int], room: int, allowance: Callable[[], int]) -> Iterator[tuple[int, ...]]:
    """All fillings of ``room`` that waste at most ``allowance()``, fullest first.

    The waste a branch can still reach is known exactly, so none is entered
    that leads to no filling. A filling that leaves room for a size still there
    is dominated by that with the size added. ``counts`` may change between
    two fillings, if it is again as before when the next is asked for.
    """
    first = _exact(counts, room) if room else ()
    if first is not None:
        yield first
    sizes = _available(counts, room)
    sums = _sums(counts, sizes, room)
    waste = 0
    while waste <= min(room, allowance()):
        for got in _making(counts, sizes, sums, 0, room - waste) if sums[0] >> (room - waste) & 1 else ():
            if waste > allowance():
                return
            if got != first and all(got.count(s) == counts[s] for s in sizes if s <= waste):
                yield got
        waste += 1


def _available(counts: dict[int, int], room: int) -> list[int]:
    return sorted((s for s, n in counts.items() if n and s <= room), reverse=True)


def _exact(counts: dict[int, int], room: int) -> tuple[int, ...] | None:
    """One to three items that fill the room exactly, largest first, if any:
    a filling without waste dominates all others, so no search is needed."""
    have = counts.get
    if have(room):
        return (room,)
    for a in range(room - 1, (room - 1) // 2, -1):
        if have(a) and have(room - a) and (2 * a != room or counts[a] > 1):
            return (a, room - a)
    for a in range(room - 2, (room - 1) // 3, -1):
        if not have(a):
            continue
        for b in range(min(a, room - a - 1), (room - a - 1) // 2, -1):
            c = room - a - b
            if have(b) and have(c) and counts[c] > (c == a) + (c == b) and (a != b or counts[a] > 1 + (c == a)):
                return (a, b, c)
    return None


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Containers that any packing needs: items above capacity - k stand without
    those of at least k, items above half the capacity without each other."""
    number = list(accumulate(histogram.get(s, 0) for s in range(capacity + 1)))
    total = list(accumulate(s * histogram.get(s, 0) for s in range(capacity + 1)))
    middle = capacity // 2
    best = -(-total[-1] // capacity)
    for k in range(middle + 1):
        half = number[capacity - k] - number[middle]
        free = capacity * half - (total[capacity - k] - total[middle])
        rest = total[middle] - (total[k - 1] if k else 0)
        best = max(best, number[-1] - number[middle] + max(0, -(-(rest - free) // capacity)))
    return best


def search(histogram: dict[int, int], capacity: int, incumbent: list[Pattern] | None = None, steps: int = STEPS) -> tuple[list[Pattern], bool]:
    """The best packing found and whether none can be better.

    Around the largest size left, every undominated filling and every number
    of containers alike is a branch, fullest first and as often as its items
    last. A branch is cut once its waste is beyond what a packing better than
    the incumbent can have. After ``steps`` branches it ends unproven.
    """
    counts = dict(histogram)
    order = sorted(histogram, reverse=True)
    total = sum(s * n for s, n in histogram.items())
    bound = lower_bound(histogram, capacity)
    best, fewest = incumbent, sum(p.times for p in incumbent) if incumbent is not None else None
    taken: list[Pattern] = []
    wasted = used = 0
    allowed = lambda: capacity if fewest is None else (fewest - 1) * capacity - total - wasted

    def change(p: Pattern, sign: int) -> None:
        nonlocal wasted, used
        for s, n in p.items.items():
            counts[s] -= sign * n * p.times
        wasted += sign * p.times * (capacity - sum(s * n for s, n in p.items.items()))
        used += sign * p.times

    def branch(at: int, last: dict[int, int] | None) -> Iterator[Pattern]:
        size = order[at]
        counts[size] -= 1  # only while the fillings are looked for
        options = fillings(counts, capacity - size, allowed)
        while True:
            got = next(options, None)
            counts[size] += 1
            if got is None:
                return
            items = {size: 1}
            for s in got:
                items[s] = items.get(s, 0) + 1
            waste = capacity - sum(s * n for s, n in items.items())
            # the filling just used is a branch of its own with one container more
            for times in range(min(counts[s] // n for s, n in items.items()), 0, -1) if items != last else ():
                if waste * times <= allowed() or fewest is None:
                    yield Pattern(times, items)
            counts[size] -= 1

    stack: list[tuple[int, Iterator[Pattern]]] = [(0, branch(0, None))] if order else []
    while stack:
        at, options = stack[-1]
        if len(taken) == len(stack):
            change(taken.pop(), -1)
        if fewest is not None and steps <= 0:
            return best or [], False
        steps -= 1
        p = next(options, None)
        if p is None:
            stack.pop()
            continue
        taken.append(p)
        change(p, 1)
        while at < len(order) and not counts[order[at]]:
            at += 1
        if at < len(order):
            stack.append((at, branch(at, p.items)))
        elif fewest is None or used < fewest:
            best, fewest = list(taken), used
            if fewest <= bound:
                break
    return best or [], True


def best_fit(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over the histogram: the incumbent."""
    by_room: dict[int, dict[tuple[tuple[int, int], ...], int]] = {}

    def put(items: tuple[tuple[int, int], ...], room: int, n: int) -> None:
        d = by_room.setdefault(room, {})
        d[items] = d.get(items, 0) + n

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            room = min((r for r, d in by_room.items() if r >= size and d), default=None)
            if room is None:
                each = capacity // size
                full, rest = divmod(left, each)
                if full:
                    put(((size, each),), capacity - each * size, full)
                if rest:
                    put(((size, rest),), capacity - rest * size, 1)
                break
            d = by_room[room]
            items, n = next(iter(d.items()))
            each = room // size
            if left < each:
                each = left
            used = min(n, left // each)
            d[items] -= used
            if not d[items]:
                del d[items]
            put((*items, (size, each)), room - each * size, used)
            left -= used * each
    out = []
    for d in by_room.values():
        for items, n in d.items():
            merged: dict[int, int] = {}
            for s, k in items:
                merged[s] = merged.get(s, 0) + k
            out.append(Pattern(n, merged))
    return out


def complete(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Bin completion without an incumbent."""
    return search(histogram, capacity)[0]


def solve(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """The better of the incumbent and bin completion, which is tried only where
    the incumbent is above the lower bound."""
    if not histogram:
        return []
    best = best_fit(histogram, capacity)
    if sum(p.times for p in best) <= lower_bound(histogram, capacity):
        return best
    return search(histogram, capacity, best)[0]


def pack(items: DataFrame, key: str, size: str, capacities: list[int]) -> DataFrame:
    """(capacity, container, key, piece, size): every item in a container of
    each capacity. ``piece`` counts from 0 over the parts of a split item."""
    spark = items.sparkSession
    ws = Workspace(spark, "packing")
    base = items.select(F.col(key).alias("_key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    counted: dict[str, tuple[str, str | None]] = {}
    for c in capacities:
        over = F.col("_size") > c
        base = base.withColumn(f"_full{c}", F.when(F.col("_size") >= c, F.floor(F.col("_size") / c)).otherwise(0).cast("long"))
        rest = F.when(over | (F.col("_size") == c), F.col("_size") % c).otherwise(F.col("_size"))
        base = base.withColumn(f"_rest{c}", F.when(rest > 0, rest).cast("long")).withColumn(f"_one{c}", F.when(F.col(f"_full{c}") > 0, F.lit(0)).cast("long"))
        counted[f"_pos{c}"] = (f"_rest{c}", None)
        counted[f"_fullpos{c}"] = (f"_one{c}", f"_full{c}")
    placed = with_positions(ws, base, counted)
    placed = ws.cut(placed)
    out = None
    for c in capacities:
        hist = {r["s"]: r["n"] for r in placed.where(f"_rest{c} is not null").groupBy(F.col(f"_rest{c}").alias("s")).agg(F.count("*").alias("n")).collect()}  # at most c rows
        ranges, at, start = [], {}, 0
        for p in solve(hist, c):
            for s, n in p.items.items():
                lo = at.get(s, 0)
                ranges.append((s, lo, lo + n * p.times, n, start))
                at[s] = lo + n * p.times
            start += p.times
        # ranges of positions meet the items by size and stretch of positions, so that neither side need be small
        table = spark.createDataFrame(ranges, "_s long, _lo long, _hi long, _each long, _start long")
        table = table.withColumn("_part", F.explode(F.sequence(F.floor(F.col("_lo") / STRETCH), F.floor((F.col("_hi") - 1) / STRETCH))))
        item = placed.where(f"_rest{c} is not null").withColumn("_s", F.col(f"_rest{c}")).withColumn("_part", F.floor(F.col(f"_pos{c}") / STRETCH))
        rests = item.join(table, ["_s", "_part"]).where((F.col(f"_pos{c}") >= F.col("_lo")) & (F.col(f"_pos{c}") < F.col("_hi")))
        rests = rests.select((F.col("_start") + F.floor((F.col(f"_pos{c}") - F.col("_lo")) / F.col("_each"))).cast("long").alias("container"), "_key", F.col(f"_full{c}").alias("piece"), F.col(f"_rest{c}").alias("_size"))
        fulls = placed.where(f"_full{c} > 0").select("_key", f"_fullpos{c}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_full{c}") - 1)).alias("piece"))
        fulls = fulls.select((F.lit(start) + F.col(f"_fullpos{c}") + F.col("piece")).cast("long").alias("container"), "_key", "piece", F.lit(c).cast("long").alias("_size"))
        none = placed.where("_size <= 0").select(F.lit(None).cast("long").alias("container"), "_key", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("_size"))
        part = rests.unionByName(fulls).unionByName(none).select(F.lit(c).cast("long").alias("capacity"), "container", F.col("_key").alias(key), "piece", F.col("_size").alias("size"))
        out = part if out is None else out.unionByName(part)
    return out
