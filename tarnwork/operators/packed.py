"""Several values packed in one field: one row per value, position kept.

Method: dictionary-guided segmentation. A first pass over the data learns the
shapes of known whole values (digits masked, letters of code-like words masked,
so the dictionary does not grow with the data). A multi-pattern automaton then
finds known whole values in each field, and dynamic programming picks the
cheapest cover of the field by known values, plain pieces and cuts, so that
delimiters inside a legitimate value are not cut even where it is not quoted.

The dictionary is broadcast in shards of at most ``shard`` shapes; each shard
adds its hits in its own pass, so no shape is dropped however many there are.

Defined results: null, empty and blank fields give no row; a field with one
value gives one row at position 1; empty values between delimiters take no
position; repeated values count each time; unbalanced quotes are ordinary
characters.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STRONG, _WEAK, _SPACE = 0, 1, 2
#: Cost of a known value, of an unknown piece, and of each uncut delimiter in an unknown piece.
_KNOWN, _PIECE, _KEPT = 1.0, 3.0, (5.0, 4.0, 0.0)

_DELIMITER = re.compile(
    r"(?P<s>\s*[;；](?:\s*and\s)?\s*|\s*\|\s*|\s*[\r\n]+\s*|\s*\t\s*|\s*、\s*)"
    r"|(?P<w>\s*[,，](?:\s*and\s)?\s*|\s+(?:and|&|/|\+)\s+)"
    r"|(?P<p> +)"
)
_BRACKETED = re.compile(r"\([^()]*\)")
_NUMBERED = re.compile(r"(?:(?<=^)|(?<=[\s;,|；、]))(\(\d{1,3}\)|\d{1,3}[.)])\s+")
_CODE = re.compile(r"[a-z0-9]*(?:[a-z][0-9]|[0-9][a-z])[a-z0-9]*")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
_UPPER_A = str.maketrans("abcdefghijklmnopqrstuvwxyz", "A" * 26)
_PAIRS = {'"': '"', "“": "”", "„": "“", "«": "»", "「": "」"}


def shape(text: str) -> str:
    """The text with as many characters, digits as 0, code-like words as A and 0."""
    t = text.translate(_LOWER)
    return _CODE.sub(lambda m: m.group().translate(_UPPER_A), t) if "0" in t else t


def unquoted(text: str) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """The text without quoting and escaping, the spans these protected, and
    those of them that were quoted values.

    A quote opens only at the start of a value and closes only before a
    delimiter or the end; a doubled quote inside stands for one.
    """
    out: list[str] = []
    spans: list[tuple[int, int]] = []
    quoted: list[tuple[int, int]] = []
    n, i, length, at_start = len(text), 0, 0, True
    while i < n:
        c = text[i]
        if c == "\\" and i + 1 < n and not text[i + 1].isalnum():
            spans.append((length, length + 1))
            out.append(text[i + 1])
            length, i, at_start = length + 1, i + 2, False
            continue
        close = _PAIRS.get(c) if at_start else None
        if close:
            j, inner = i + 1, []
            while j < n:
                if text[j] == close:
                    if close == '"' and j + 1 < n and text[j + 1] == '"':
                        inner.append('"')
                        j += 2
                        continue
                    break
                inner.append(text[j])
                j += 1
            rest = text[j + 1 : j + 6]
            if j < n and (not rest or _DELIMITER.match(rest) or rest[0] in "])"):
                body = "".join(inner)
                body = body.strip()
                if body:
                    spans.append((length, length + len(body)))
                    quoted.append(spans[-1])
                    out.append(body)
                    length += len(body)
                i, at_start = j + 1, False
                continue
        out.append(c)
        length += 1
        at_start = c in " \t\r\n;；,，|、&/)+" or (at_start and c in "([") or (c == "." and length > 1 and out[-2].isdigit())
        if c in "d" and length >= 4 and "".join(out[-4:]) == " and":
            at_start = True
        i += 1
    return "".join(out), spans, quoted


def packed_list(text: str) -> list[str] | None:
    """The values of a field written as a list in brackets, or None."""
    if text[:1] != "[" or text[-1:] != "]":
        return None
    try:
        got = json.loads(text)
    except ValueError:
        return None
    return [str(x).strip() for x in got if x is not None and str(x).strip()] if isinstance(got, list) else None


def _numbered(text: str) -> list[tuple[int, int]]:
    """Spans of list numbers, where they run 1, 2, 3 from the start of the text."""
    got, want, style = [], 1, ""
    for m in _NUMBERED.finditer(text):
        mark = re.sub(r"\d+", "0", m.group(1))  # (1), 1) and 1. are not mixed in one list
        if int(re.sub(r"\D", "", m.group(1))) == want and (mark == style if want > 1 else m.start() == 0):
            got.append((m.start(), m.end()))
            want, style = want + 1, mark
    return got if len(got) > 1 else []


def _inside(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    return any(s < b and a < e for s, e in spans)


def cuts_of(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of every place outside quotes where a value may end."""
    numbers = _numbered(text)
    got = [(a, b, -1) for a, b in numbers]
    if "(" in text:  # a comma in brackets, as in a count, divides nothing
        spans = [*spans, *(m.span() for m in _BRACKETED.finditer(text) if "," in m.group())]
    for m in _DELIMITER.finditer(text):
        a, b = m.span()
        kind = _STRONG if m.lastgroup == "s" else _WEAK if m.lastgroup == "w" else _SPACE
        if not _inside(spans, a, b) and not any(s < b and a < e for s, e in numbers):
            got.append((a, b, kind))
    return sorted(got)


def segment(text: str, spans: list[tuple[int, int]], known: set[tuple[int, int]]) -> list[str]:
    """The cheapest cover of the text. ``known``: spans of known whole values."""
    cuts = cuts_of(text, spans)
    if not cuts:
        return [v] if (v := text.strip()) else []
    k = len(cuts)
    left = [0, *(b for _, b, _ in cuts)]  # a piece from bound i to bound j is text[left[i]:right[j]]
    right = [*(a for a, _, _ in cuts), len(text)]
    kinds = [c[2] for c in cuts]
    earliest: dict[int, int] = {}  # where the longest known value that ends at a place begins
    for a, b in known:
        earliest[b] = min(a, earliest.get(b, a))
    best: list[tuple[float, int, bool]] = [(0.0, -1, True)]
    for j in range(k + 1):
        choice = (float("inf"), -1, True)
        kept, first = 0.0, earliest.get(right[j], len(text))
        for i in range(j, -1, -1):
            if i < j:
                if kinds[i] == -1:  # list numbers always divide
                    break
                kept += _KEPT[kinds[i]]
                # no known value begins further left, and an unknown piece only gets dearer
                if left[i] < first and _PIECE + kept >= choice[0]:
                    break
            a, b = left[i], right[j]
            if b <= a or not text[a:b].strip():
                cost, sure = (0.0, True) if i == j else (float("inf"), False)
            elif (a, b) in known:
                cost, sure = _KNOWN, True
            else:
                cost, sure = _PIECE + kept, False
            # at a blank only known values may meet
            before = best[i]
            if i and kinds[i - 1] == _SPACE and not (sure and before[2]) or j < k and kinds[j] == _SPACE and not sure:
                continue
            if before[0] + cost < choice[0]:
                choice = (before[0] + cost, i, sure)
        best.append(choice)
    out, j = [], k + 1
    while j > 0:
        i = best[j][1]
        if i < 0:  # no cover with cuts at blanks: take what lies before as one piece
            i = 0
        v = text[left[i] : right[j - 1]].strip()
        if v:
            out.append(v)
        j = i
    return out[::-1]


def _learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shapes of values that stand alone between sure delimiters or in quotes."""
    for pdf in batches:
        counts: dict[tuple[str, bool], int] = {}
        for raw in pdf["field"]:
            text = raw.strip()
            listed = packed_list(text)
            if listed is not None:
                for v in listed:
                    key = (shape(v), True)
                    counts[key] = counts.get(key, 0) + 1
                continue
            flat, spans, _ = unquoted(text)
            at = 0
            for a, b, kind in [*cuts_of(flat, spans), (len(flat), len(flat), _STRONG)]:
                if kind == _SPACE or kind == _WEAK:
                    continue
                piece, p0 = flat[at:a], at
                at = b
                v = piece.strip()
                if not v:
                    continue
                p0 += len(piece) - len(piece.lstrip())
                whole = any(s <= p0 and e >= p0 + len(v) for s, e in spans)
                if not whole and (_inside(spans, p0, p0 + len(v)) or any(m.lastgroup != "p" for m in _DELIMITER.finditer(v))):
                    whole = bool(spans) and not cuts_only_blank(v, spans, p0)
                    if not whole:
                        continue
                key = (shape(v), whole)
                counts[key] = counts.get(key, 0) + 1
        if counts:
            yield pd.DataFrame([(s, w, n) for (s, w), n in counts.items()], columns=["shape", "whole", "n"])


def cuts_only_blank(value: str, spans: list[tuple[int, int]], at: int) -> bool:
    """True where an unprotected delimiter is left in the value."""
    return any(m.lastgroup != "p" and not _inside(spans, at + m.start(), at + m.end()) for m in _DELIMITER.finditer(value))


def known_shapes(fields: DataFrame, support: int = 3) -> DataFrame:
    """(kind, shape) of known whole values of each kind of field, seen at least
    ``support`` times. ``fields`` has kind and field."""
    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for kind, part in pdf.groupby("kind"):
                for got in _learn(iter([part])):
                    yield got.assign(kind=kind)

    seen = fields.where("field is not null and trim(field) <> ''").mapInPandas(learn, "shape string, whole boolean, n long, kind string")
    return seen.groupBy("kind", "shape").agg(F.sum("n").alias("n")).where(F.col("n") >= support).select("kind", "shape")


def unpack(df: DataFrame, ids: list[str], field: str, kind: str, support: int = 3, shard: int = 50_000) -> DataFrame:
    """(ids..., position, value, n_values), one row per value of ``field``.

    ``kind`` is a column naming which fields share a dictionary.
    """
    spark = df.sparkSession
    fields = df.select(*ids, F.col(kind).alias("kind"), F.col(field).alias("field")).where("field is not null and trim(field) <> ''")
    shapes = known_shapes(fields.select("kind", "field"), support).toLocalIterator()
    id_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.select(*ids).schema)
    held = fields.withColumn("hits", F.array().cast("array<bigint>"))
    block: list[tuple[str, str]] = []

    def add(held: DataFrame, block: list[tuple[str, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            by_kind: dict[str, ahocorasick.Automaton] = {}
            for k, s in shared.value:
                by_kind.setdefault(k, ahocorasick.Automaton()).add_word(s, len(s))
            for a in by_kind.values():
                a.make_automaton()
            for pdf in batches:
                hits = []
                for k, raw, had in zip(pdf["kind"], pdf["field"], pdf["hits"]):
                    text = raw.strip()
                    got = list(had)
                    if k in by_kind and text[:1] != "[":
                        flat, _, _ = unquoted(text)
                        for e, n in by_kind[k].iter(shape(flat)):
                            got.append(((e + 1 - n) << 32) | (e + 1))
                    hits.append(got)
                pdf = pdf.copy()
                pdf["hits"] = hits
                yield pdf

        return held.mapInPandas(find, held.schema)

    for row in shapes:
        block.append((row["kind"], row["shape"]))
        if len(block) == shard:
            held, block = add(held, block), []
    if block:
        held = add(held, block)

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, pos, val, num = [], [], [], []
            for r, (raw, hits) in enumerate(zip(pdf["field"], pdf["hits"])):
                text = raw.strip()
                values = packed_list(text)
                if values is None:
                    flat, spans, quoted = unquoted(text)
                    known = {(h >> 32, h & 0xFFFFFFFF) for h in map(int, hits)}
                    known.update(quoted)  # quoted values are known ones
                    values = segment(flat, spans, known)
                at += [r] * len(values)
                pos += range(1, len(values) + 1)
                val += values
                num += [len(values)] * len(values)
            out = pdf[ids].iloc[at].reset_index(drop=True)
            out["position"], out["value"], out["n_values"] = pos, val, num
            yield out.astype({"position": "int64", "n_values": "int64"})

    return held.mapInPandas(cover, f"{id_ddl}, position long, value string, n_values long")
