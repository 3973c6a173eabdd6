"""Quantities recorded in different units, brought to one unit.

Method: a multi-pattern automaton finds unit aliases, cue words and number
words in running text (longest match wins, so "unbound" hides "bound" and
"per cent" hides "per"); numbers next to an alias become readings of a clause;
the clause's cues say which quantity it is and from which side it is stated;
conversion factors come from a small broadcast table joined on the unit. Where
the text states nothing, the numeric columns are read, with the other columns
as context for their scale and side.

``measurements`` does the same for every quantity of a table of units (mass,
volume, time, temperature, share, concentration, or the caller's own), whatever
it is stated about; ``bound_shares`` reads one quantity with its side and its
numeric columns.

Defined results: null or empty text is no statement; a text that states other
quantities only is no statement; where the text states the quantity more than
once, the first statement holds; a statement and columns that disagree are
decided for the statement.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unit -> thousandths of the whole.
UNIT_FACTORS = {"percent": 10.0, "permille": 1.0, "fraction": 1000.0}

#: Aliases found in text, with what they mean.
ALIASES = {
    "unit:percent": ("%", "percent", "per cent", "pct", "％", "percentage", "per hundred", "p.c."),
    "unit:permille": ("‰", "permille", "per mille", "per mil", "per thousand", "per mill"),
    "unit:fraction": ("bound fraction", "fraction bound", "fraction unbound", "unbound fraction", "fb", "fu"),
    "side:free": ("unbound", "free fraction", "free form", "fu", "free", "not bound", "fraction unbound", "unbound fraction"),
    "side:bound": ("bound", "binding", "binds", "fb", "bound fraction", "fraction bound"),
    "other": (
        "metabolite", "bioavailability", "of the dose", "recovered", "clearance", "half-life", "volume of distribution",
        "peak level", "peak levels", "was studied", "excreted", "absorbed", "eliminated", "auc", "cmax",
    ),
    "under": ("less than", "below", "under", "at most", "no more than", "not more than", "up to", "<", "≤", "fewer than", "maximum of"),
    "over": ("more than", "greater than", "over", "above", "at least", "no less than", "not less than", ">", "≥", "exceeds", "exceeding", "minimum of"),
}
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def number_words() -> dict[str, int]:
    """Words for 0 to 100, written with blank or hyphen."""
    words = {w: i for i, w in enumerate(_ONES)}
    for t, ten in enumerate(_TENS, 2):
        words[ten] = 10 * t
        for i in range(1, 10):
            words[f"{ten}-{_ONES[i]}"] = words[f"{ten} {_ONES[i]}"] = 10 * t + i
    return words | {"one hundred": 100, "hundred": 100}


_FIGURE = re.compile(r"(?<![A-Za-z0-9.,])(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:[.,]\d+)?)(?![A-Za-z0-9])")
#: A figure that its unit may follow without a blank.
_FIGURE_UNIT = re.compile(r"(?<![A-Za-z0-9.,])(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:[.,]\d+)?)(?![\d])")
_GROUPED = re.compile(r"[1-9]\d{0,2}(?:,\d{3})+(?:\.\d+)?")
#: A comma that can only be a decimal mark.
_DECIMAL_COMMA = re.compile(r"(?<![\d.,])(?:0,\d+|\d+,\d{1,2}|\d+,\d{4,})(?![\d.,])")
_CLAUSE = re.compile(r"(?<=[.;!?])\s+(?=[A-Z\"'(]|\S+ (?:is|are|was|has)\b|[<>≥≤]?\d)")
_BETWEEN = re.compile(r"\s*(?:%|‰|percent|per cent|per mille|per thousand)?\s*(?:-|–|—|to|and|bis|through)\s*", re.IGNORECASE)
_NUM = r"(\d+(?:[.,]\d+)?|hundred|a hundred|one hundred|thousand|a thousand|one thousand)"
#: A part of a whole, part first or whole first.
_PART_FIRST = re.compile(rf"(?i)\b{_NUM} (?:(?:parts?|molecules|units) )?(?:out of|of every|in every|of each|in) (?:every |each )?{_NUM}\b|ratio of {_NUM} ?(?:[:/]|to) ?{_NUM}")
_WHOLE_FIRST = re.compile(rf"(?i)\b(?:out )?of (?:every |each )?{_NUM} (?:parts|molecules|units)\b[^.]*?,? (?<![\d.,]){_NUM}\b")
_WORD = re.compile(r"\w")


def figure(text: str, decimal_comma: bool) -> float:
    """The number written: groups of three after commas are thousands, unless the
    field's other figures have decimal commas."""
    if "," in text and _GROUPED.fullmatch(text) and not decimal_comma:
        return float(text.replace(",", ""))
    return float(text.replace(",", "."))


class Finder:
    """The automaton over all aliases (meaning -> names) and number words."""

    def __init__(self, aliases: dict[str, tuple[str, ...]] = ALIASES) -> None:
        self.a = ahocorasick.Automaton()
        found: dict[str, list[str]] = {}
        for meaning, names in aliases.items():
            for n in names:
                found.setdefault(n, []).append(meaning)
        for w, v in number_words().items():
            found.setdefault(w, []).append(f"number:{v}")
        for n, meanings in found.items():
            self.a.add_word(n, (n, meanings))
        self.a.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, list[str]]]:
        """Longest matches at word bounds, left to right, none inside another."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        hits = []
        for e, (n, meanings) in self.a.iter(low):
            s, e = e + 1 - len(n), e + 1
            if _WORD.match(n[0]) and s and _WORD.match(low[s - 1]) and not low[s - 1].isdigit():
                continue
            if _WORD.match(n[-1]) and e < len(low) and _WORD.match(low[e]):
                continue
            hits.append((s, e, meanings))
        hits.sort(key=lambda h: (h[0] - h[1], h[0]))
        kept: list[tuple[int, int, list[str]]] = []
        for h in hits:
            if not any(h[0] < k[1] and k[0] < h[1] for k in kept):
                kept.append(h)
        return sorted(kept)


def part_of_whole(text: str) -> float | None:
    """Thousandths stated as "87 of every 100", "out of 100 parts, 87" or "a ratio of 87:100"."""
    def value(w: str) -> float:
        w = w.lower().split()[-1]
        return {"hundred": 100.0, "thousand": 1000.0}.get(w) or float(w.replace(",", "."))

    if m := _PART_FIRST.search(text):
        part, whole = (value(g) for g in m.groups() if g)
        if re.search(r"(?i)\bto (?:free|unbound)\b", text):
            whole += part
    elif m := _WHOLE_FIRST.search(text):
        whole, part = value(m.group(1)), value(m.group(2))
    else:
        return None
    return 1000 * part / whole if 0 <= part <= whole and whole else None


def read_clause(finder: Finder, text: str) -> tuple[str, str, float, float] | None:
    """(side, unit, low, high) of the binding statement of one clause, or None."""
    hits = finder.find(text)
    meanings = [m for h in hits for m in h[2]]
    if "other" in meanings or not any(m.startswith("side:") for m in meanings):
        return None
    side = "free" if "side:free" in meanings else "bound"
    comma = _DECIMAL_COMMA.search(text) is not None
    numbers = [(m.start(), m.end(), figure(m.group(), comma)) for m in _FIGURE.finditer(text)]
    numbers += [(s, e, float(x[7:])) for s, e, ms in hits for x in ms if x.startswith("number:")]
    if (share := part_of_whole(text)) is not None:
        return side, "permille", share, share
    numbers.sort()
    units = [(s, e, m[5:]) for s, e, ms in hits for m in ms if m.startswith("unit:") and m != "unit:fraction"]
    readings = []
    for k, (s, e, v) in enumerate(numbers):
        unit = next((u for us, _, u in units if us >= e and us - e <= 2 and not text[e:us].strip(" -")), "")
        pair = numbers[k + 1] if k + 1 < len(numbers) and _BETWEEN.fullmatch(text[e : numbers[k + 1][0]]) else None
        readings.append((s, e, v, unit, pair))
    fraction = "unit:fraction" in meanings or re.search(r"(?i)\bfraction\b", text) is not None
    for _, _, v, unit, pair in readings:
        if pair is not None:
            unit = unit or next((u for us, _, u in units if us >= pair[1] and us - pair[1] <= 2 and not text[pair[1] : us].strip(" -")), "")
        if not unit and not (fraction and v <= 1 and (pair is None or pair[2] <= 1)):
            continue
        return side, unit or "fraction", v, pair[2] if pair is not None else v
    return None


def read_text(finder: Finder, text: str | None) -> tuple[str, str, float, float] | None:
    if not text or not text.strip():
        return None
    for clause in _CLAUSE.split(text):
        got = read_clause(finder, clause)
        if got:
            return got
    return None


def stated_shares(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, side, unit, low, high) of each row whose text states a bound or free share."""
    ddl = f"`{key}` {df.schema[key].dataType.simpleString()}, side string, unit string, low double, high double"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder()
        for pdf in batches:
            got = [(k, *g) for k, t in zip(pdf[key], pdf[text]) if (g := read_text(finder, t))]
            yield pd.DataFrame(got, columns=[key, "side", "unit", "low", "high"])

    return df.select(key, text).where(F.col(text).isNotNull()).mapInPandas(read, ddl)


#: Quantity -> unit -> (aliases, factor, offset) into the quantity's common unit, which has factor 1.
QUANTITIES = {
    "mass": {
        "g": (("g", "gram", "grams", "gramme", "grammes", "gm"), 1.0, 0.0), "kg": (("kg", "kilogram", "kilograms", "kilo", "kilos"), 1e3, 0.0), "mg": (("mg", "milligram", "milligrams", "mgs"), 1e-3, 0.0),
        "ug": (("µg", "μg", "ug", "mcg", "microgram", "micrograms"), 1e-6, 0.0), "ng": (("ng", "nanogram", "nanograms"), 1e-9, 0.0),
    },
    "volume": {
        "l": (("l", "litre", "litres", "liter", "liters"), 1.0, 0.0), "dl": (("dl", "decilitre", "deciliter"), 0.1, 0.0), "ml": (("ml", "millilitre", "millilitres", "milliliter", "milliliters", "cc"), 1e-3, 0.0), "ul": (("µl", "μl", "ul", "microlitre", "microliter"), 1e-6, 0.0),
    },
    "time": {
        "h": (("h", "hr", "hrs", "hour", "hours"), 1.0, 0.0), "min": (("min", "mins", "minute", "minutes"), 1 / 60, 0.0), "s": (("s", "sec", "second", "seconds"), 1 / 3600, 0.0),
        "d": (("d", "day", "days"), 24.0, 0.0), "week": (("week", "weeks", "wk", "wks"), 168.0, 0.0), "year": (("year", "years", "yr", "yrs"), 8766.0, 0.0),
    },
    "temperature": {"C": (("°c", "degrees celsius", "celsius"), 1.0, 0.0), "F": (("°f", "degrees fahrenheit", "fahrenheit"), 5 / 9, -160 / 9)},
    "share": {"percent": (("%", "percent", "per cent", "pct", "％"), 0.01, 0.0), "permille": (("‰", "per mille", "permille", "per thousand"), 0.001, 0.0)},
    "concentration": {
        "mg/l": (("mg/l", "µg/ml", "μg/ml", "ug/ml", "mcg/ml", "micrograms per millilitre", "micrograms per milliliter"), 1.0, 0.0), "ng/ml": (("ng/ml", "µg/l", "μg/l", "ug/l", "mcg/l", "nanograms per milliliter"), 1e-3, 0.0),
        "g/l": (("g/l", "mg/ml"), 1e3, 0.0), "mg/dl": (("mg/dl",), 10.0, 0.0),
    },
}
_RANGE = re.compile(r"\s*(?:-|–|—|to|and|through|bis)\s*", re.IGNORECASE)


def unit_factors(quantities: dict = QUANTITIES) -> list[tuple[str, str, float, float]]:
    """(quantity, unit, factor, offset): a few dozen rows."""
    return [(q, u, f, o) for q, units in quantities.items() for u, (_, f, o) in units.items()]


def measurements(df: DataFrame, key: str, text: str, quantities: dict = QUANTITIES) -> DataFrame:
    """(key, position, quantity, unit, low, high, common_low, common_high): every
    number of the text with a unit after it, as written and in the quantity's
    common unit.

    The longest alias at a place holds, so "mg/l" is no mass; a range takes the
    unit of its second number; a unit of one letter counts only in small letters
    and after a figure. Null texts, numbers without a unit and units without a
    number give no row; repeated statements count each.
    """
    ddl = f"`{key}` {df.schema[key].dataType.simpleString()}, position int, quantity string, unit string, low double, high double"
    aliases = {f"{q}|{u}": names for q, units in quantities.items() for u, (names, _, _) in units.items()}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(aliases)
        for pdf in batches:
            rows = [(k, i, *m) for k, t in zip(pdf["_key"], pdf["_text"]) for i, m in enumerate(_measured(finder, t), 1)]
            yield pd.DataFrame(rows, columns=[key, "position", "quantity", "unit", "low", "high"])

    found = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_text").isNotNull()).mapInPandas(read, ddl)
    factors = F.broadcast(df.sparkSession.createDataFrame(unit_factors(quantities), "quantity string, unit string, factor double, offset double"))
    a, b = (F.col(c) * F.col("factor") + F.col("offset") for c in ("low", "high"))
    return found.join(factors, ["quantity", "unit"]).select(key, "position", "quantity", "unit", "low", "high", F.least(a, b).alias("common_low"), F.greatest(a, b).alias("common_high"))


def _measured(finder: Finder, text: str) -> Iterator[tuple[str, str, float, float]]:
    hits = finder.find(text)
    comma = _DECIMAL_COMMA.search(text) is not None
    figures = [(m.start(), m.end(), figure(m.group(), comma)) for m in _FIGURE_UNIT.finditer(text)]
    words = [(s, e, float(m[7:])) for s, e, ms in hits for m in ms if m.startswith("number:")]
    numbers = sorted(figures + words)
    units = {s: m.split("|") for s, _, ms in hits for m in ms[:1] if "|" in m}
    ends = {s: e for s, e, _ in hits}
    before: tuple[int, int, float] | None = None
    for n in numbers:
        s, e, v = n
        at = e + (len(text[e:]) - len(text[e:].lstrip(" -\u00a0")))
        got = units.get(at) if at - e <= 2 else None
        if got and ends[at] - at == 1 and text[at].isalpha() and (text[at].isupper() and text[at] != "L"):
            got = None
        if got:
            low = before[2] if before is not None and _RANGE.fullmatch(text[before[1] : s]) and before[2] <= v else v
            yield got[0], got[1], low, v
        before = n


def to_permille(side: Column, factor: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Thousandths bound, low and high end, rounded; a free share counts from the other side."""
    a, b = low * factor, high * factor
    lo = F.when(side == "free", 1000.0 - F.greatest(a, b)).otherwise(F.least(a, b))
    hi = F.when(side == "free", 1000.0 - F.least(a, b)).otherwise(F.greatest(a, b))
    return F.floor(lo + 0.5 + 1e-6).cast("long"), F.floor(hi + 0.5 + 1e-6).cast("long")


def scale_of(v: Column) -> Column:
    """The unit a bare number between 0 and 1000 is most likely in."""
    return F.when(v <= 1, "fraction").when(v <= 100, "percent").when(v <= 1000, "permille")


def bound_shares(df: DataFrame, key: str, text: str, low: str, high: str, free: str, sure99: str) -> DataFrame:
    """(key, low_permille, high_permille), one row per row that states how much
    of the drug is bound, from the text or else from the numeric columns.

    Columns: a bare number up to 1 is a fraction, up to 100 percent, above it
    thousandths. The free share decides the side of ``low``: where both say
    the same and do not add up to the whole, ``low`` holds the free share.
    """
    spark = df.sparkSession
    factors = F.broadcast(spark.createDataFrame(list(UNIT_FACTORS.items()), "unit string, factor double"))
    said = stated_shares(df, key, text).join(factors, "unit")
    s_lo, s_hi = to_permille(F.col("side"), F.col("factor"), F.col("low"), F.col("high"))
    said = said.select(key, s_lo.alias("t_low"), s_hi.alias("t_high"))

    clean = lambda c: F.when(~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) <= 1000), F.col(c))
    cols = df.select(key, clean(low).alias("lo"), clean(high).alias("hi"), clean(free).alias("fu"), F.col(sure99).alias("b99"))
    cols = cols.withColumn("top", F.coalesce(F.greatest("lo", "hi"), "lo", "hi")).withColumn("lo", F.coalesce(F.least("lo", "hi"), "lo", "hi"))
    # both ends share the scale of the larger one, unless another one makes bound and free add up
    u_unit = F.when((F.col("fu") == 1), "percent").otherwise(scale_of(F.col("fu")))
    cols = cols.withColumn("unit", u_unit).join(factors, "unit", "left").withColumn("u", F.col("fu") * F.col("factor")).drop("unit", "factor")
    adds_up = [F.when(F.abs((F.col("lo") + F.col("top")) / 2 * f + F.col("u") - 1000) <= 6, u) for u, f in UNIT_FACTORS.items()]
    one = (F.col("top") == 1) & F.coalesce("b99", F.lit(False))
    cols = cols.withColumn("unit", F.coalesce(*adds_up, F.when(one, "percent"), scale_of(F.col("top")))).join(factors, "unit", "left")
    a, b, u = F.col("lo") * F.col("factor"), F.col("top") * F.col("factor"), F.col("u")
    mid = (a + b) / 2
    same = (F.abs(mid - u) <= 2) & (F.abs(mid + u - 1000) > 4)
    swapped = F.coalesce(same, F.lit(False)) | (F.coalesce("b99", F.lit(False)) & (b <= 10))
    free_only = 1000.0 - u
    c_lo = F.when(swapped, 1000.0 - b).otherwise(F.coalesce(a, free_only))
    c_hi = F.when(swapped, 1000.0 - a).otherwise(F.coalesce(b, free_only))
    cols = cols.select(key, F.floor(c_lo + 0.5 + 1e-6).cast("long").alias("c_low"), F.floor(c_hi + 0.5 + 1e-6).cast("long").alias("c_high"))
    both = cols.join(said, key, "left").select(
        key, F.coalesce("t_low", "c_low").alias("low_permille"), F.coalesce("t_high", "c_high").alias("high_permille"), F.col("t_low").isNotNull().alias("from_text"), "c_low", "c_high"
    )
    return both.where(F.col("low_permille").isNotNull())
