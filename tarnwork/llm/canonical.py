"""Free-entered values mapped to a canonical list, the rest reported.

Method: a BK-tree over the list's words under the Levenshtein distance, a true
metric, so the triangle inequality prunes without losing an entry within the
radius. Whole batches of words descend the tree together, each node's
distances to the batch being computed bit-parallel (Myers 1999). What the tree
returns is ranked by the Damerau-Levenshtein distance, which counts a swap as
one slip, then by the length of what it explains and a sound-alike distance. The list is
held in shards of at most ``shard`` entries; each shard gives its best entry
with its whole rank and the shards' winners merge by it, so a list of any
length is searched whole and its division into shards changes nothing.

An entry's longest word is its head; its other words qualify it ("x pamoate"
is more specific than "x"). A value means an entry if a word of the value, or
two or three neighbouring ones written together, is the head within the
allowed slips and all qualifiers are there; the closest head wins, then the
entry with more qualifiers. Codes of an entry that name one head count as exact
heads. Words are of letters and figures of any script.

Defined results: null, blank and symbol-only values have no entry; equally
close entries are decided by the sound-alike distance, then by the smaller id;
an empty list matches nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.joins import hot_left_join
from tarnwork.session import Workspace

#: Slips a head may have, by its length, and the radius that covers them in plain edits (a swap is two).
SLIPS = ((12, 2), (8, 2), (5, 1))
RADIUS = 4
#: Least length of a head for a sound-alike match, and the plain slips it may have.
SOUND_LENGTH, SOUND_SLIPS = 9, 4
#: Values remembered per worker.
MEMO = 200_000

#: Letters of other scripts that look like Latin ones.
_ALIKE = str.maketrans("авекмнорстухіјѕοαερνιτκυ", "abekmhopctyxijsoaepvitky") | str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"})
_SOUND = (("ph", "f"), ("qu", "kw"), ("ks", "x"), ("ck", "k"), ("c", "k"), ("y", "i"), ("z", "s"), ("th", "t"), ("w", "v"), ("rn", "m"))
_TOKEN = re.compile(r"[a-z0-9]+")
_ANY_TOKEN = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*")


def plain(text: str) -> str:
    """Small letters without accents, invisible characters and look-alikes."""
    t = unicodedata.normalize("NFKD", text).lower().translate(_ALIKE)
    return t if t.isascii() else "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


@lru_cache(100_000)
def sound(word: str) -> str:
    for a, b in _SOUND:
        word = word.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", word)


def alignment_distance(a: str, b: str) -> int:
    """The unrestricted Damerau-Levenshtein distance, a true metric:
    insertions, deletions, substitutions and swaps, the letters of a swap
    possibly with others put in or left out between them."""
    top = len(a) + len(b)
    last: dict[str, int] = {}
    rows = [[top] * (len(b) + 2), [top, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        new, seen = [top, i], 0
        before = rows[i]
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), seen
            cost = x != y
            if not cost:
                seen = j
            new.append(min(before[j] + cost, new[j] + 1, before[j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        last[x] = i
        rows.append(new)
    return rows[-1][-1]


class WordBatch:
    """Words as a matrix of letter codes, so that one word is compared with all
    at once. Letters outside the alphabet have code 0, which equals no letter."""

    def __init__(self, words: list[str], alphabet: dict[str, int]):
        self.alphabet = alphabet
        self.words = words
        self.length = np.array([len(w) for w in words], np.int64)
        width = int(self.length.max()) if len(words) else 0
        self.codes = np.zeros((width, len(words)), np.int32)
        for i, w in enumerate(words):
            self.codes[: len(w), i] = [alphabet.get(c, 0) for c in w]

    def distances(self, word: str, which: np.ndarray) -> np.ndarray:
        """Levenshtein distance of ``word`` to the chosen words."""
        m = len(word)
        if m > 64 or len(which) <= 48:  # longer than a machine word, or too few for a pass over all
            return np.array([_levenshtein(word, self.words[i]) for i in which], np.int64)
        peq = np.zeros(len(self.alphabet) + 1, np.uint64)
        for i, c in enumerate(word):
            peq[self.alphabet[c]] |= np.uint64(1 << i)
        length = self.length[which]
        pv, mv = np.full(len(which), 2**m - 1 if m < 64 else 2**64 - 1, np.uint64), np.zeros(len(which), np.uint64)
        score, top, one = np.full(len(which), m, np.int64), np.uint64(1 << (m - 1)), np.uint64(1)
        for j in range(int(length.max()) if len(which) else 0):
            eq = peq[self.codes[j, which]]
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            step = ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0)
            score += np.where(j < length, step, 0)
            ph, mh = (ph << one) | one, mh << one
            pv, mv = mh | ~(xv | ph), ph & xv
        return np.where(length == 0, m, score)


class BKTree:
    def __init__(self, words: list[str]):
        self.words = sorted({w for w in words if w})
        self.longest = max(map(len, self.words), default=0)
        self.alphabet = {c: i for i, c in enumerate(sorted({c for w in self.words for c in w}), 1)}
        self.kids: list[dict[int, int]] = []
        for i, w in enumerate(self.words):
            self.kids.append({})
            at = 0
            while i:
                d = _levenshtein(self.words[at], w)
                nxt = self.kids[at].get(d)
                if nxt is None:
                    self.kids[at][d] = i
                    break
                at = nxt

    def within(self, queries: list[str], radius: int) -> list[list[str]]:
        """Every word of the tree within ``radius`` of each query."""
        found: list[list[str]] = [[] for _ in queries]
        # a query longer than every word by more than the radius has none
        asked = [i for i, q in enumerate(queries) if len(q) <= self.longest + radius]
        if not self.words or not asked:
            return found
        batch = WordBatch([queries[i] for i in asked], self.alphabet)
        stack = [(0, np.arange(len(asked)))]
        while stack:
            at, active = stack.pop()
            d = batch.distances(self.words[at], active)
            for q in active[d <= radius]:
                found[asked[q]].append(self.words[at])
            for edge, kid in self.kids[at].items():
                if len(left := active[np.abs(d - edge) <= radius]):
                    stack.append((kid, left))
        return found


def _levenshtein(a: str, b: str) -> int:
    """Bit-parallel over whole numbers of any width."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    pv, mv = full, 0
    for c in b:
        eq = at.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += (ph & top > 0) - (mh & top > 0)
        ph, mh = ph << 1 | 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
    return score


def words_of(text: str) -> list[str]:
    """Words of letters and figures of any script, as ``plain`` writes them."""
    t = plain(text)
    return _TOKEN.findall(t) if t.isascii() else _ANY_TOKEN.findall(t)


def _head(words: list[str]) -> str:
    return max(words, key=len)


#: How a value was found and how well: tier, slips, minus the letters explained,
#: sound distance, minus the qualifiers, entry. The smallest is the best.
Rank = tuple[int, int, int, int, int, int]


class Matcher:
    """One shard of the list. ``codes`` must name one head each."""

    def __init__(self, entries: list[tuple[int, str, list[str]]]):
        self.by_head: dict[str, list[tuple[int, tuple[str, ...]]]] = {}
        self.codes: dict[str, str] = {}
        for key, name, codes in entries:
            words = words_of(name or "")
            if not words:
                continue
            head = _head(words)
            rest = list(words)
            rest.remove(head)
            self.by_head.setdefault(head, []).append((key, tuple(rest)))
            for c in codes or ():
                if k := "".join(words_of(c or "")):
                    self.codes[k] = head
        self.tree = BKTree(list(self.by_head))
        self.memo: dict[str, Rank | None] = {}

    def _pick(self, tier: int, heads: list[tuple[tuple[int, int, int], str]], tokens: list[str]) -> Rank | None:
        """The rank of the closest head's most specific entry whose qualifiers are there."""
        best: Rank | None = None
        for score, head in heads:
            for key, rest in self.by_head[head]:
                cand = (tier, *score, -len(rest), key)
                if (best is None or cand < best) and all(any(t == q or (len(q) > 4 and abs(len(t) - len(q)) <= 1 and _levenshtein(t, q) <= 2 and alignment_distance(t, q) <= 1) for t in tokens) for q in rest):
                    best = cand
        return best

    def match(self, values: list[str]) -> list[Rank | None]:
        out: dict[str, Rank | None] = {}
        hard: list[tuple[str, list[str], list[str]]] = []
        for v in dict.fromkeys(values):
            if v in self.memo:
                out[v] = self.memo[v]
                continue
            tokens = words_of(v)
            joined = [a + b for a, b in zip(tokens, tokens[1:])]
            three = [a + b + c for a, b, c in zip(tokens, tokens[1:], tokens[2:])]
            # whole words, then words written together, then codes; the first that gives an entry holds
            for tier, heads in enumerate((tokens, joined + three, [self.codes.get(t, "") for t in [*tokens, *joined]])):
                out[v] = self._pick(tier, [((0, 0, 0), h) for h in heads if h in self.by_head], tokens)
                if out[v]:
                    break
            else:
                windows = [w for w in dict.fromkeys(tokens + joined + three) if len(w) >= SLIPS[-1][0] and sum(c.isdigit() for c in w) * 2 < len(w)]
                hard.append((v, tokens, windows))
        words = list(dict.fromkeys(w for _, _, ws in hard for w in ws))
        near: dict[str, list[tuple[tuple[int, int, int], str]]] = {}
        for i in range(0, len(words), 32_768):
            part = words[i : i + 32_768]
            for w, heads in zip(part, self.tree.within(part, RADIUS)):
                good = []
                for h in heads:
                    n = min(len(w), len(h))
                    allowed = next((s for least, s in SLIPS if n >= least), 0)
                    # a slip is at most two plain edits, so most heads are out by the faster distance
                    if _levenshtein(w, h) > 2 * allowed and not (n >= SOUND_LENGTH and _levenshtein(sound(w), sound(h)) <= 2):
                        continue
                    d = alignment_distance(w, h)
                    if d <= SOUND_SLIPS:
                        s = alignment_distance(sound(w), sound(h))
                        if d <= allowed or (n >= SOUND_LENGTH and s <= 1):
                            good.append(((d, -len(w), s), h))
                if good:
                    near[w] = good
        for v, tokens, windows in hard:
            out[v] = self._pick(3, [g for w in windows for g in near.get(w, ())], tokens)
        if len(self.memo) + len(out) > MEMO:
            self.memo.clear()
        self.memo.update(out)
        return [out[v] for v in values]


#: The worker's last matcher, by the list's place; the next task of the same shard takes it.
_BUILT: dict[str, Matcher] = {}


def _clear_codes(entries: DataFrame, entry_id: str, entry_name: str, entry_codes: str | None) -> DataFrame:
    """(i, n, c): the entries with those of their codes that name one head in the whole list."""
    e = entries.where(F.col(entry_name).isNotNull() & F.col(entry_id).isNotNull()).select(F.col(entry_id).cast("long").alias("i"), F.col(entry_name).alias("n"), (F.col(entry_codes) if entry_codes else F.array().cast("array<string>")).alias("c"))
    if not entry_codes:
        return e

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(i, _head(w), ["".join(words_of(x or "")) for x in (() if c is None else c)]) for i, n, c in zip(pdf["i"], pdf["n"], pdf["c"]) if (w := words_of(n))]
            yield pd.DataFrame(got, columns=["i", "h", "k"])

    heads = e.mapInPandas(spell, "i long, h string, k array<string>")
    codes = heads.select("h", F.explode("k").alias("k")).where("k <> ''").groupBy("k").agg(F.min("h").alias("h"), F.max("h").alias("b")).where("h = b")
    # a code stands for the head, so every entry of the head has it, in whichever shard it is
    kept = heads.select("i", "h").join(codes.groupBy("h").agg(F.collect_set("k").alias("c")), "h").groupBy("i").agg(F.flatten(F.collect_set("c")).alias("c"))
    return e.drop("c").join(kept, "i", "left")


def map_to_list(df: DataFrame, keys: list[str], value: str, entries: DataFrame, entry_id: str, entry_name: str, entry_codes: str | None = None, shard: int = 100_000, per_task: int = 20_000) -> DataFrame:
    """(keys..., value, entry_id or null, slips or null), one row per row of ``df``.

    Distinct values are matched once, ``per_task`` of them in a task; each shard
    of the list keeps the best rank so far, so the shards' order and size do not matter.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "canonical")
    base = df.select(*keys, F.col(value).alias("_value"))
    counts, seen = ws.measured(base.where(F.col("_value").isNotNull()).groupBy("_value").agg(F.count("*").alias("_n")), rows=F.sum("_n"))
    state = counts.select("_value").repartition(max(1, -(-seen["n"] // per_task))).withColumn("_rank", F.lit(None).cast("array<long>"))
    block: list[tuple[int, str, list[str]]] = []

    def search(state: DataFrame, block: list[tuple[int, str, list[str]]], place: str) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = _BUILT.get(place)
            if m is None:
                _BUILT.clear()
                m = _BUILT[place] = Matcher(shared.value)
            for pdf in batches:
                ranks = [g if h is None or (g is not None and g < tuple(h)) else h for g, h in zip(m.match(pdf["_value"].tolist()), pdf["_rank"])]
                yield pd.DataFrame({"_value": pdf["_value"], "_rank": ranks})

        return state.mapInPandas(find, state.schema)

    for r in _clear_codes(entries, entry_id, entry_name, entry_codes).toLocalIterator():
        block.append((r["i"], r["n"], list(r["c"] or [])))
        if len(block) == shard:
            state, block = search(state, block, f"{ws.root}/{r['i']}"), []
    if block:
        state = search(state, block, f"{ws.root}/last")
    found = ws.cut(state.where("_rank is not null").select("_value", F.col("_rank")[5].alias(entry_id), F.col("_rank")[1].cast("int").alias("slips")))
    # values of more than a thousandth of the rows, of which there are at most a thousand
    hot = counts.where(F.col("_n") > F.lit((seen["rows"] or 0) / 1000)).select("_value")
    return hot_left_join(base, found, "_value", hot, F.struct(*keys)).select(*keys, F.col("_value").alias(value), entry_id, "slips")
