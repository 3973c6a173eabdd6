"""Keys of loosely written ids and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_key(c: Column) -> Column:
    """Letters and digits in capitals; null where nothing is left."""
    k = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    return F.when(k != "", k)


def spelled(c: Column) -> Column:
    """The id in capitals without blanks; null where nothing is left."""
    k = F.regexp_replace(F.upper(c), r"\s+", "")
    return F.when(k != "", k)


def not_placeholder(c: Column) -> Column:
    """Null for the usual words that stand for no id."""
    return F.when(~F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", "")).isin("na", "nan", "none", "null", "unassigned", "unknown", "nil", "missing", "unspecified", "tbd", "undefined", "notavailable", "notapplicable", ""), c)


def hpo_id(c: Column) -> Column:
    """``HP:`` and seven digits, or null for anything that is no such id."""
    k = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    return F.when(k.rlike("^HP[0-9]{7}$"), F.concat(F.lit("HP:"), F.substring(k, 3, 7)))
