"""Decision tables, aligned lists and boolean rule texts."""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.functions.scalars import frequency_scaled, lookup, split_list

#: Base weight of each grade, and of literature statements by type.
GRADE_WEIGHTS = {"A": 1.0, "B": 0.6, "C": 0.0, "D": 0.2, "E": 0.05}
STATEMENT_WEIGHTS = {"CAUSES": 0.10, "DISRUPTS": 0.08, "PREDISPOSES": 0.08, "AFFECTS": 0.08, "ASSOCIATED_WITH": 0.05, "COMENTION": 0.02}


def decide(rules: list[tuple[Column, object]], otherwise: object | None = None, unknown: Column | None = None) -> Column:
    """The value of the first rule that holds; null conditions do not hold.

    With ``unknown``, rows no rule decides raise an error naming its value.
    """
    out = None
    for condition, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, v) if out is None else out.when(condition, v)
    if unknown is not None:
        return out.otherwise(F.raise_error(F.concat(F.lit("no rule for "), F.coalesce(unknown, F.lit("null")))))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def evidence_grade(cls: Column, typed: Column, causal: Column, series: Column, synopsis: Column, entries: Column, penetrant: Column, dominant: Column, strict: bool = False) -> Column:
    """A to E by class and provenance; ``strict`` asks for two series or a synopsis."""
    strong = (series >= 2) | synopsis
    return decide([
        ((cls == "monogenic") & typed & (causal == 0), "C"),
        ((cls == "monogenic") & (strong if strict else strong | (entries > 0)), "A"),
        (cls == "monogenic", "C"),
        ((cls == "pharmacological") & penetrant & dominant, "B"),
        (cls == "pharmacological", "E"),
        (cls == "open_targets", "B"),
        (cls == "human_association", "C"),
        (cls == "animal", "D"),
        (cls == "literature", "E"),
    ], unknown=cls)


def grade_weight(grade: Column, cls: Column, frequency: Column, statement: Column) -> Column:
    """Base weight of the grade, scaled by frequency for A and B, by statement type for E."""
    base = lookup(grade, GRADE_WEIGHTS)
    return decide([
        (cls == "open_targets", 0.45),
        ((grade == "A") & (cls == "monogenic"), frequency_scaled(base, frequency, 4.0, 0.25)),
        (grade == "B", frequency_scaled(base, frequency, 10.0, 0.25)),
        ((grade == "E") & statement.isNotNull(), F.coalesce(lookup(F.upper(statement), STATEMENT_WEIGHTS), F.lit(STATEMENT_WEIGHTS["COMENTION"]))),
    ], base)


def statement_type(sources: Column, relation: Column) -> Column:
    """Type of a literature statement from the extraction types its sources' names carry."""
    kinds = F.transform(sources, lambda s: F.lower(F.when(F.contains(s, F.lit("-")), F.substr(s, F.instr(s, "-") + 1)).otherwise(s)))
    has = lambda *k: F.arrays_overlap(kinds, F.array(*[F.lit(x) for x in k]))
    return decide([
        (has("cause") | (has("curated") & (relation == "induces")), "CAUSES"),
        (has("treat", "prevent", "curated"), "AFFECTS"),
        (has("associate", "association", "stimulate", "inhibit", "positive_correlation", "negative_correlation", "positive_correlate", "negative_correlate"), "ASSOCIATED_WITH"),
    ], "COMENTION")


def aligned(a: Column, b: Column, first: str, second: str) -> Column:
    """Two lists of equal length as an array of structs; unequal lengths raise."""
    x, y = split_list(a), split_list(b)
    zipped = F.zip_with(x, y, lambda p, q: F.struct(p.alias(first), q.alias(second)))
    return F.when(F.size(x) == F.size(y), zipped).otherwise(F.raise_error(F.concat(F.lit("lists of unequal length: "), F.coalesce(a, F.lit("")), F.lit(" / "), F.coalesce(b, F.lit("")))).cast(f"array<struct<{first}:string,{second}:string>>"))


def demoted(relation: Column, level: Column, general: str = "associated_with") -> tuple[Column, Column]:
    """A directional relation on a descriptor of mixed polarity loses its direction; (relation, flag)."""
    hit = (level == "mixed") & relation.isin("induces", "relieves")
    return F.when(hit, F.lit(general)).otherwise(relation), F.coalesce(hit, F.lit(False))


def study_design(kinds: Column, human: Column, animal: Column) -> Column:
    """Design by priority over publication types."""
    has = lambda *k: F.coalesce(F.arrays_overlap(kinds, F.array(*[F.lit(x) for x in k])), F.lit(False))
    return decide([
        (has("Review", "Systematic Review", "Meta-Analysis"), "review"), (animal & ~human, "animal"), (has("Randomized Controlled Trial", "Clinical Trial"), "trial"),
        (has("Observational Study", "Cohort Study"), "cohort"), (has("Case Reports"), "case_report"),
    ], "other")


def indicator_columns(c: Column, values: list[str], prefix: str) -> list[Column]:
    return [F.coalesce((c == v).cast("double"), F.lit(0.0)).alias(f"{prefix}_{v}") for v in values]


_RULE = re.compile(r"\(|\)|[^\s()]+")


@cache
def rule_postfix(rule: str) -> tuple[str, ...]:
    """The rule's names and operators in the order of their evaluation. A
    bracket without its partner, an operator without a name on both sides and
    names without an operator between them raise."""
    order = {"or": 1, "and": 2}
    out: list[str] = []
    ops: list[str] = []
    name_next = True
    for t in _RULE.findall(rule):
        low = t.lower()
        if name_next == (low in order or t == ")"):
            raise ValueError(f"malformed rule, at {t!r}: {rule}")
        if low in order:
            while ops and ops[-1] != "(" and order[ops[-1]] >= order[low]:
                out.append(ops.pop())
            ops.append(low)
            name_next = True
        elif t == "(":
            ops.append(t)
        elif t == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                raise ValueError(f"malformed rule, bracket closed but not opened: {rule}")
            ops.pop()
        else:
            out.append(f"={t}")
            name_next = False
    if "(" in ops or (name_next and (out or ops)):
        raise ValueError(f"malformed rule, unfinished: {rule}")
    return (*out, *reversed(ops))


def rule_value(rule: str, values: dict[str, float]) -> float | None:
    """``and`` takes the smallest known value, ``or`` the largest; unknown names
    are left out; ``and`` binds stronger; parentheses nest to any depth. An
    empty rule has no value, a malformed one raises."""
    pick = {"and": min, "or": max}
    stack: list[float | None] = []
    for t in rule_postfix(rule or ""):
        if t[0] == "=":
            stack.append(values.get(t[1:]))
        else:
            known = [x for x in (stack.pop(), stack.pop()) if x is not None]
            stack.append(pick[t](known) if known else None)
    return stack[0] if stack else None


@F.pandas_udf(T.DoubleType())
def gene_rule(rule: pd.Series, names: pd.Series, levels: pd.Series) -> pd.Series:
    """The rule's value with the row's own names and levels; each distinct rule is read once."""
    return pd.Series([rule_value(r, dict(zip(n, v))) if r is not None and n is not None else None for r, n, v in zip(rule, names, levels)], dtype="float64")


def mapped_relation(kind: Column, partner: Column, table: dict[str, tuple[str, int]], partners: list[str]) -> Column:
    """struct(relation, value) of a relation type, null for types the table
    lacks and for partners of another type."""
    out = None
    for k, (relation, value) in table.items():
        v = F.struct(F.lit(relation).alias("relation"), F.lit(value).alias("value"))
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return F.when(partner.isin(partners), out)


def association(disease: Column, first: Column, second: Column, causal: list[str], other: list[str], prefix: str = "ORPHA:") -> Column:
    """struct(type, causal): ids with the prefix read the first source and fall
    back to the second, others read the second; causal is null for unlisted types."""
    t = F.when(disease.startswith(prefix), F.coalesce(first, second)).otherwise(second)
    return F.struct(t.alias("type"), F.when(t.isin(causal), True).when(t.isin(other), False).alias("causal"))


def metadata_weight(design: Column, table: dict[str, float], diagnosed: Column, factor: float, floor: float = 0.05) -> Column:
    """Weight of a study's design, reduced where the outcome is a diagnosis, clipped."""
    w = F.coalesce(lookup(design, table), F.lit(floor)) * F.when(F.coalesce(diagnosed, F.lit(False)), factor).otherwise(1.0)
    return F.greatest(F.lit(floor), F.least(F.lit(1.0), w))


def flag_sign(raises: Column, lowers: Column, relation: str = "regulates", plain: str = "binds") -> Column:
    """struct(relation, sign) of two flags: one of them gives its sign, both or none give 0."""
    up, down = F.coalesce(raises, F.lit(False)), F.coalesce(lowers, F.lit(False))
    sign = F.when(up & ~down, 1).when(down & ~up, -1).otherwise(0)
    return F.struct(F.when(up | down, relation).otherwise(plain).alias("relation"), sign.alias("sign"))


def action_sign(action: Column, raising: list[str], lowering: list[str]) -> Column:
    """1, -1 or null for an action outside both vocabularies."""
    a = F.upper(F.trim(action))
    return F.when(a.isin(raising), 1).when(a.isin(lowering), -1)
