"""Scalar parsing and cleaning rules as column expressions.

All of them return null for null or unreadable input unless said otherwise,
and none needs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frequency qualifier codes and the middle of their range.
QUALIFIER_MIDPOINTS = {
    "HP:0040280": 1.0, "HP:0040281": 0.895, "HP:0040282": 0.545, "HP:0040283": 0.17, "HP:0040284": 0.025, "HP:0040285": 0.0,
}
#: Weight factor of each evidence code; "other" for the rest.
CODE_FACTORS = {"PCS": 1.0, "TAS": 0.8, "IEA": 0.6, "placebo_controlled_frequency": 1.0, "frequency": 0.9, "label_text": 0.8, "other": 0.7}
#: Provenance of disease ids by prefix.
PROVENANCE = {"OMIM:": "HPO-OMIM", "ORPHA:": "HPO-Orphanet"}
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_FLOAT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def lookup(c: Column, table: dict, default: object = None) -> Column:
    """A small fixed table as a chain of cases."""
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def number(c: Column) -> Column:
    """The double a text writes out, null for anything else (nan and inf too)."""
    return F.when(c.rlike(_FLOAT), F.trim(c).try_cast("double"))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def _parts(raw: Column) -> tuple[Column, Column, Column, Column]:
    text = F.trim(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    slash = F.instr(text, "/")
    return text, slash, number(F.substring_index(text, "/", 1)), F.when(slash > 0, F.substr(text, slash + 1))


def parse_frequency(raw: Column) -> Column:
    """Qualifier code, ``a/b`` or ``p%`` -> share in [0, 1]; the rest -> null."""
    text, slash, top, below = _parts(raw)
    bottom = number(below)
    share = F.when((slash > 0), F.when(bottom > 0, clip(top / bottom, 0, 1)))
    percent = F.when((slash == 0) & text.endswith("%"), clip(number(F.regexp_replace(text, "%$", "")) / 100.0, 0, 1))
    return F.coalesce(lookup(text, QUALIFIER_MIDPOINTS), share, percent)


def is_zero_fraction(raw: Column) -> Column:
    """True for 0 of n with n > 0, else false (for null too)."""
    _, slash, top, below = _parts(raw)
    return F.coalesce((slash > 0) & (top == 0) & (number(below) > 0), F.lit(False))


def frequency_denominator(raw: Column) -> Column:
    """n of ``a/n`` as a whole number."""
    _, slash, _, below = _parts(raw)
    return F.when((slash > 0) & below.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(below).try_cast("bigint"))


def provenance(disease_id: Column) -> Column:
    out = None
    for k, v in PROVENANCE.items():
        out = F.when(disease_id.startswith(k), v) if out is None else out.when(disease_id.startswith(k), v)
    return out


def code_factor(code: Column) -> Column:
    return F.coalesce(lookup(code, {k: v for k, v in CODE_FACTORS.items() if k != "other"}), F.lit(CODE_FACTORS["other"]))


def sample_size_factor(n: Column, reference: int = 20, unknown: float = 1.0) -> Column:
    """Half to one, growing with the log of the number of cases; 1 for an unknown number."""
    return F.coalesce(0.5 + 0.5 * F.least(F.lit(1.0), F.log1p(n.cast("double")) / F.log1p(F.lit(float(reference)))), F.lit(unknown))


def rubric_weight(code: Column, n: Column, floor: float = 0.1) -> Column:
    return clip(code_factor(code) * sample_size_factor(n), floor, 1.0)


def frequency_scaled(base: Column, frequency: Column, scale: float, floor: float) -> Column:
    """The base weight times the clipped frequency; without a frequency the base weight."""
    return F.when(frequency.isNull(), base).otherwise(base * F.greatest(F.lit(floor), F.least(F.lit(1.0), frequency * scale)))


def joined_clauses(*clauses: Column, sep: str = "; ") -> Column:
    """Conditional clauses in order, those that are null left out."""
    return F.concat_ws(sep, *clauses)


def published_on(text: Column) -> Column:
    """Leading year, month name or number and day -> date; missing or impossible parts are 1, no year -> null."""
    year = F.regexp_extract(text, r"^\s*(\d{4})", 1).try_cast("int")
    year = F.when(year > 0, year)
    rest = F.regexp_extract(text, r"^\s*\d{4}[\s/-]*(.*)$", 1)
    word = F.lower(F.regexp_extract(rest, r"^([A-Za-z]{3})", 1))
    month = F.coalesce(lookup(word, MONTHS), F.regexp_extract(rest, r"^(\d{1,2})(?!\d)", 1).try_cast("int"))
    month = F.when((month >= 1) & (month <= 12), month)
    day = F.regexp_extract(rest, r"^(?:[A-Za-z]+|\d{1,2})[\s/-]+(\d{1,2})(?!\d)", 1).try_cast("int")
    base = F.try_make_timestamp(year, F.coalesce(month, F.lit(1)), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    exact = F.when(month.isNotNull() & day.between(1, 31), F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date"))
    return F.coalesce(exact, base)


def iso_date(text: Column) -> Column:
    """A full ISO date that exists, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def bracketed_dates(text: Column) -> Column:
    """All ``[yyyy-mm-dd]`` of a text as an array of dates that exist."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{4}-\d{2}-\d{2})\]"), F.lit(1)), lambda x: x.try_cast("date")), lambda x: x.isNotNull())


def availability(curated: Column, published: Column) -> Column:
    """struct(date, source): the earliest date of two arrays; a publication wins a tie; null without dates."""
    c, p = F.array_min(curated), F.array_min(published)
    return F.when(p.isNotNull() & (c.isNull() | (p <= c)), F.struct(p.alias("date"), F.lit("publication").alias("source"))).when(
        c.isNotNull(), F.struct(c.alias("date"), F.lit("biocuration").alias("source")))


def split_list(text: Column, sep: str = ";") -> Column:
    """Trimmed parts without empties; null for null."""
    return F.filter(F.transform(F.split(text, F.lit(f"\\Q{sep}\\E")), lambda x: F.trim(x)), lambda x: x != "")


def normalised_name(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def without_prefix(c: Column, prefix: str) -> Column:
    return F.regexp_replace(c, f"(?i)^\\Q{prefix}\\E", "")


def entity(c: Column) -> Column:
    """``Type|MESH:a;b`` -> struct(kind, ids)."""
    return F.struct(F.split_part(c, F.lit("|"), F.lit(1)).alias("kind"), F.transform(split_list(F.split_part(c, F.lit("|"), F.lit(2))), lambda x: without_prefix(x, "MESH:")).alias("ids"))


def flat_id(cid: Column) -> Column:
    """A compound number as the padded id of its flat form."""
    return F.when(cid.isNotNull(), F.concat(F.lit("CID1"), F.lpad(cid.cast("string"), 8, "0")))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def stem(c: Column) -> Column:
    """A light suffix stripper: plural and ing, ed, ness, ity, al endings of words of five letters or more."""
    w = F.lower(c)
    return F.when(F.length(w) < 5, w).otherwise(F.regexp_replace(F.regexp_replace(w, "(ies)$", "y"), "(?<=[a-z]{3})(ings?|ed|ness|ity|al|es|s)$", ""))


def names_word(text: Column, name: Column) -> Column:
    """Whether the name stands in the text as a word of its own."""
    return F.rlike(F.lower(text), F.concat(F.lit("(?<![a-z0-9])\\Q"), F.lower(name), F.lit("\\E(?![a-z0-9])")))


def without_suffix(c: Column, pattern: str = r"\[[a-z]\]$|_[a-z]$") -> Column:
    return F.regexp_replace(c, pattern, "")


def spellings(c: Column) -> Column:
    """The distinct normalised spellings of a name: as is, without blanks, without marks."""
    low = normalised_name(c)
    return F.array_distinct(F.array(low, F.regexp_replace(low, " ", ""), F.regexp_replace(low, "[^a-z0-9]", "")))


def members(c: Column, sep: str = "_") -> Column:
    """Members of a complex; isoform numbers are taken off."""
    return F.transform(split_list(c, sep), lambda x: F.regexp_replace(x, r"-\d+$", ""))


def citations(c: Column, excluded: list[str]) -> Column:
    """``Resource:PMID;...`` -> struct(kept, excluded), both distinct PMIDs in order."""
    parts = split_list(c)
    pmid = lambda x: F.substring_index(x, ":", -1)
    out = F.array(*[F.lit(e) for e in excluded]).cast("array<string>")
    is_out = lambda x: F.array_contains(out, F.substring_index(x, ":", 1))
    return F.struct(F.array_distinct(F.transform(F.filter(parts, lambda x: ~is_out(x)), pmid)).alias("kept"), F.array_distinct(F.transform(F.filter(parts, is_out), pmid)).alias("excluded"))


def first_prefix(c: Column, prefixes: list[tuple[str, str]], default: str = "other") -> Column:
    """The label of the first prefix, in order, that the value begins with."""
    out = None
    for p, label in prefixes:
        out = F.when(c.startswith(p), label) if out is None else out.when(c.startswith(p), label)
    return out.otherwise(default)


def starts_with_any(values: Column, prefixes: list[str]) -> Column:
    """Whether any value of the array begins with any prefix; false for null."""
    test = lambda v: F.coalesce(*[F.when(v.startswith(p), True) for p in prefixes], F.lit(False))
    return F.coalesce(F.exists(values, test), F.lit(False))


def occupancy(concentration: Column, p_affinity: Column) -> Column:
    return concentration / (concentration + F.pow(F.lit(10.0), 6.0 - p_affinity))


def nernst_millivolts(outside: Column, inside: Column, charge: Column, kelvin: float = 310.15) -> Column:
    """Equilibrium potential of an ion."""
    return F.lit(1000 * 8.314462618 * kelvin / 96485.33212) / charge * F.log(outside / inside)


def bounded_count(n: Column, most: int) -> Column:
    """Whether a count lies between one and the most allowed."""
    return F.coalesce(n.between(1, most), F.lit(False))


def node_symbol(c: Column) -> Column:
    """A node's symbol: what stands between the type prefix and the accession after the last bar."""
    return F.regexp_replace(F.regexp_replace(c, "^[A-Za-z]+:", ""), r"\|[^|]*$", "")


def calibrated_concentration(p_affinity: Column, low: float, high: float, slope: float, offset: float) -> Column:
    """10 to an affine function of the clamped affinity."""
    return F.pow(F.lit(10.0), offset + slope * F.greatest(F.lit(low), F.least(F.lit(high), p_affinity)))


def pseudo_count(p: Column, most: float) -> Column:
    """Odds of a posterior, capped."""
    return F.when(p >= 1, F.lit(most)).otherwise(F.least(F.lit(most), p / (1 - p)))
