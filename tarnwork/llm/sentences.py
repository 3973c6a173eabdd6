"""Sentence units of running text in any script.

Method: the standard sentence-break character properties give the terminators
of all scripts, the closing marks that belong to them and the letters that can
or cannot begin a sentence. On top of them: the abbreviations of the text's
languages are suppressed (those whose function words the text uses, its script
allows and its ``lang`` names; of all languages where nothing tells), a terminator inside quotation marks divides only where the
quotation stands alone and ends, and line breaks are told apart into hard
breaks (headings, list entries, paragraphs) and wrapped lines. Thai, which
writes no terminators, is divided at blanks between Thai letters.

Defined results: null and empty texts and texts of white space give no unit;
unbalanced quotation marks are ordinary characters; every other character
outside surrounding white space lies in exactly one unit.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ALL = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF)))
#: Terminators that always can end a sentence, by character property.
STERM = "".join(regex.findall(r"\p{Sentence_Break=STerm}", _ALL))
ATERM = "".join(regex.findall(r"\p{Sentence_Break=ATerm}", _ALL))
#: Closing marks and quotes that go with a terminator.
CLOSE = "".join(c for c in regex.findall(r"[\p{Sentence_Break=Close}&&[\p{Pe}\p{Pf}\p{Pi}\p{Po}]]", _ALL, flags=regex.V1)) + "]"
del _ALL
_FULL = set("。！？｡．")
#: Marks that may follow a terminator within its sentence.
_AFTER = frozenset(CLOSE) - set("«「『“„([（")
_ELLIPSIS = "…‥"

#: A full stop within a figure, a word or an address is no terminator. The
#: class stands first, so that the scan skips other characters at C speed.
_MARKS = re.escape(STERM + ATERM + _ELLIPSIS)
_TERM = re.compile(rf"[{_MARKS}](?:(?<!\.)|(?![0-9a-z])|(?<=[^\x00-\x7f]\.))[{_MARKS}]*")
_BREAKS = re.compile(r"\r\n|[\n\r\u0085  \x0b\x0c]")
_WORD_BEFORE = re.compile(r"[^\s\"“”«»„「」『』（(\[]*$")
_THAI_GAP = re.compile(r"(?<=[฀-๿])[  　]+(?=[฀-๿])|(?<=[฀-๿]) +(?=[A-ZÀ-ÞА-Я][^\W\d_]* )")
_THAI = re.compile(r"[฀-๿]")
_LIST = re.compile(r"(?:[-*•‣▪·–—◦●]\s+|\(?\d{1,3}[.)]\s+|\(?[a-z]\)\s+)")
_NUMBER_MARK = re.compile(r"\(?\d{1,3}[.)]\s+")
_NUMBERED_HEADING = re.compile(r"\d{1,3}(?:\.\d{1,3})*\.?\s+[^\W\d_]")
_OPEN = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "‹": "›", '"': '"', "‚": "‘", "»": "", "＂": "＂"}
_QUOTES = re.compile("[\"“”„«»「」『』‹›＂]")

#: Abbreviations, without the last full stop, in lower case.
#: Never at the end of a sentence.
NEVER = {
    "en": "dr mr mrs ms prof st vs cf viz e.g i.e approx fig figs sec eq ref refs ver messrs rev hon gen col capt ext dept",
    "de": "dr prof st vgl z.b d.h bzw ca abb tab evtl ggf inkl max min sog u.a z.t o.g s.o s.u hr fr frl dipl ing bspw insb",
    "fr": "dr prof vs fig tabl m mm mme mlle p.ex c.-à-d env av apr cf boul éd",
    "es": "dr prof vs sr sra srta dra p.ej aprox núm pág págs fig cap ee ud uds d.ª",
    "ru": "т.е т.к т.н напр прим см рис табл ср гл акад им ул проф доц тел",
    "ar": "د أ م ص",
    "hi": "डॉ श्री प्रो",
}
#: Not at the end where a figure follows.
BEFORE_FIGURE = {
    "en": "no nos p pp vol ch art item", "de": "nr s bd kap art", "fr": "no p art chap", "es": "no p art", "ru": "с стр п т № гл ст",
}
#: At the end only where a capital follows.
MAY = {"en": "inc ltd corp etc resp incl excl est min max avg std hrs mos yrs wks jan feb mar apr jun jul aug sep sept oct nov dec", "de": "usw tel", "fr": "etc", "es": "etc", "ru": "нед мес"}
#: German words before an ordinal.
ORDINAL_AFTER = set("am die der das dem den des im vom zum zur bis ab seit jede jeder jedes ihre ihr seine sein eine einer einem jeden".split())
#: Abbreviations that are ordinary words unless written with a capital.
TITLES = set("rev hon gen col capt prof".split())
#: Words that begin a sentence and no name.
STARTERS = {
    "en": "the a an it he she they we you i this that these those there then but and so if when while after before his her its their our my in on at for with as no not nobody everyone he's she's it's we're they're",
    "de": "der die das ein eine er sie es wir ihr ich dann danach aber und wenn als nach vor im in am auf bei mit es",
    "fr": "le la les un une il elle ils elles nous vous je on ce cette ces puis mais et si quand après avant dans sur en pour avec",
    "es": "el la los las un una él ella ellos ellas nosotros yo este esta estos estas luego pero y si cuando después antes en para con",
    "ru": "он она оно они мы вы я это эта этот эти затем потом но и а если когда после в на с по не",
}
#: Function words and letters that tell the languages of one script apart; none of the words is one of another language here.
FUNCTION = {
    "en": "the and of to was is with for that at by he she they his this then had were", "de": "der das und ist mit nicht ein eine zu im von bei auf seit nach kein keine keinen einen sich auch wurde", "fr": "le les des et une est dans pour au du", "es": "el los las una que por del al su y",
}
LETTERS = {"de": "äöüß", "fr": "àâçéèêëîïôœùû", "es": "ñ¿¡áéíóú"}
_FUNCTION = {k: frozenset(ws.split()) for k, ws in FUNCTION.items()}
_SCRIPTS = tuple((k, frozenset(map(chr, range(a, b + 1)))) for k, a, b in (("ru", 0x430, 0x451), ("ar", 0x620, 0x64A), ("hi", 0x905, 0x939)))


@dataclass(frozen=True)
class Rules:
    """The word lists of the languages of a text."""

    never: frozenset[str]
    may: frozenset[str]
    figure: frozenset[str]
    starters: frozenset[str]


@cache
def rules_for(languages: frozenset[str]) -> Rules:
    pick = lambda table: frozenset(w for k, ws in table.items() if k in languages for w in ws.split())
    return Rules(pick(NEVER), pick(MAY), pick(BEFORE_FIGURE), pick(STARTERS))


#: The article before a noun, which German writes with a capital.
_GERMAN_DIE = re.compile("\\bdie [A-ZÄÖÜ][a-zäöüß]")


def languages_of(text: str, lang: str | None) -> frozenset[str]:
    """Languages the text is written in, as far as they have word lists: those
    whose function words it uses, those of its scripts, and the named one unless
    the text uses only words of others."""
    low = text.lower()
    words, letters = set(low.split()), set(low)
    found = {k for k, script in _SCRIPTS if not letters.isdisjoint(script)}
    latin = {k for k, ws in _FUNCTION.items() if not words.isdisjoint(ws) or not letters.isdisjoint(LETTERS.get(k, ""))}
    if _GERMAN_DIE.search(text):
        latin.add("de")
    named = (lang or "").strip().lower()[:2]
    if named in FUNCTION and not latin:
        latin.add(named)
    return frozenset(found | (latin or set(FUNCTION)))


#: Parts of abbreviations written with blanks between.
_PAIRS = {("z", "b"), ("d", "h"), ("p", "ej"), ("p", "ex"), ("т", "е"), ("т", "к"), ("т", "н"), ("u", "a"), ("ee", "uu"), ("i", "e"), ("e", "g"), ("c", "d"), ("м", "д")}
#: Words a wrapped line may end with, but no heading.
_LINKING = set(
    "a an the as at by of in on to for from with and or than was were is are see that this before after during until while about over under no week visit arm version study table dr fig sec item "
    "der die das und oder von mit bei le la les de du des et el los las y con por и в на с не".split()
)


def _cased(c: str) -> bool:
    return c.lower() != c.upper()


def _begins_upper(text: str, i: int, end: int) -> bool:
    """A capital, or a word such as pH or mRNA that has one within."""
    c = text[i]
    if c.isupper() or c.istitle():
        return True
    if not c.islower():
        return False
    j = i + 1
    while j < end and j < i + 4 and text[j].isalpha():
        if text[j].isupper():
            return True
        j += 1
    return False


def quote_spans(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """(start, end) of quotations, marks included, none within another."""
    spans: list[tuple[int, int]] = []
    start, close = -1, ""
    for m in _QUOTES.finditer(text, a, b):
        i, c = m.start(), m.group()
        if start < 0:
            if c in _OPEN and _OPEN[c] and (c != '"' or i == a or not text[i - 1].isalnum() or not _cased(text[i - 1]) or text[i - 1].isspace()):
                start, close = i, _OPEN[c]
        elif c in close:
            spans.append((start, i + 1))
            start = -1
    return spans


_DOTTED = re.compile(r"\(?(?:[^\W\d_]\.)+[^\W\d_]")
_NEXT_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def _starts(text: str, k: int, rules: Rules) -> bool:
    """The word at ``k`` is one that begins sentences."""
    m = _NEXT_WORD.match(text, k)
    return m is not None and m.group().lower() in rules.starters


def _suppressed(text: str, cur: int, t: int, k: int, nxt: str, rules: Rules) -> bool:
    """The full stop at ``t`` belongs to an abbreviation, initial or ordinal."""
    lo = max(cur, t - 24)
    at = max(text.rfind(" ", lo, t), text.rfind("\n", lo, t)) + 1 or lo
    if t - at > 12 and text[at:t].isalpha():
        return False  # too long for an abbreviation
    m = _WORD_BEFORE.search(text, at, t)
    word = m.group()
    low = word.lower().lstrip("([¿¡'’-–—")
    if not low:
        return False
    if low in rules.never and not (low in TITLES and word[:1].islower() and nxt.isupper()):
        return True
    digit = nxt.isdigit()
    if digit and low in rules.figure:
        return True
    before = text[max(cur, m.start() - 16) : m.start()].split()
    last = before[-1].rstrip(".").lower() if before else ""
    if before and before[-1].endswith(".") and (last, low) in _PAIRS and low not in ("uu",):
        return True
    if len(low) == 1 and low.isalpha():
        if any(low == p for p, _ in _PAIRS) and re.match(r"\.\s*(?:[^\W\d_]{1,2})\.", text[t : t + 6]):
            return True
        if word.lstrip("(").isupper() and _cased(low):  # an initial, but no name begins with a word that begins sentences
            return not digit and nxt != "" and not (before and before[-1].islower() and _starts(text, k, rules))
        if not _cased(low):
            return True
    if _DOTTED.fullmatch(word) and nxt.isupper() and word.replace(".", "").lstrip("(").isupper():
        return not _starts(text, k, rules)
    if low.isdigit() and len(low) <= 2 and last in ORDINAL_AFTER and (nxt.isupper() or nxt.islower()):
        return True
    return False


def _short(text: str, cur: int, t: int, nxt: str, k: int, b: int, rules: Rules) -> bool:
    """Before a small letter only a full word ends a sentence (as people write
    in forums), not an abbreviation, a unit, a figure or a word with full stops."""
    if nxt == "i" and not text[k + 1 : k + 2].isalpha():
        return False
    word = _WORD_BEFORE.search(text, max(cur, t - 24), t).group()
    low = word.lower().strip(")]%")
    return len(low) < 3 or not low.isalpha() or low in rules.never or low in rules.may or low in rules.figure


def _block(text: str, a: int, b: int, out: list[tuple[int, int]], thai: bool, rules: Rules) -> None:
    """Units of text[a:b], which holds no hard line break."""
    cur = a
    while cur < b and text[cur].isspace():
        cur += 1
    first = cur
    spans = quote_spans(text, a, b) if _QUOTES.search(text, a, b) else []
    qi = 0
    stops: list[int] = []
    skip = -1
    brackets = text.find("(", a, b) >= 0
    for m in _TERM.finditer(text, cur, b):
        t, e = m.span()
        if t < skip:
            continue
        run = m.group()
        dot = run == "."
        nc = text[e] if e < b else ""
        if dot and nc == " " and not spans and e + 1 < b and "A" <= text[e + 1] <= "Z" and (not brackets or text.rfind("(", cur, t) <= text.rfind(")", cur, t)):
            # the common case: a full word before, one blank and a capital after
            word = text[max(text.rfind(" ", cur, t) + 1, cur) : t]
            if len(word) > 2 and word.isascii() and word.isalpha() and word.islower() and (word not in rules.never or word in TITLES) and word not in rules.figure:
                stops.append(e)
                out.append((cur, e))
                cur = skip = e + 1
                continue
        if dot and nc:
            # inside a number, a word, an address
            if nc.isalnum() and not nc.isupper() and (text[t - 1 : t].isascii() or nc.isdigit()):
                continue
            if nc in "-_/@º°,;:":
                continue
        while qi < len(spans) and spans[qi][1] <= t:
            qi += 1
        alone = quoted = False
        if qi < len(spans) and spans[qi][0] < t:
            qs, qe = spans[qi]
            if text[e : qe - 1].strip():
                continue  # more follows within the quotation
            alone, quoted, e = qs <= cur, True, qe
        k = e
        while k < b and text[k] in _AFTER:
            if spans and text[k] in _OPEN and _OPEN[text[k]] and any(s == k for s, _ in spans):
                break
            k += 1
        if brackets and (o := text.rfind("(", cur, t)) >= 0 and text.rfind(")", o, t) < 0 and 0 <= text.find(")", k, min(b, k + 200)):
            continue  # within brackets
        e = k
        while k < b and text[k].isspace():
            k += 1
        if k >= b:
            break
        nxt, gap = text[k], k > e
        p = t - 1
        while p > cur and not text[p].isalnum():
            p -= 1
        prev = text[p] if p >= cur else ""
        if "a" <= prev <= "z":
            cased = True
        else:
            while p > cur and not text[p].isalpha() and p > t - 16:
                p -= 1
            cased = _cased(text[p]) if text[p].isalpha() else prev.isdigit()
        full = not dot and any(c in _FULL for c in run)
        upper = nxt.isupper() or _begins_upper(text, k, b)
        lower = not upper and nxt.islower()
        if quoted:
            # a quotation alone is a unit; one within a sentence ends it only before a new start
            if nxt in ",;:，、；：—–-)":
                continue
            if alone:
                if not gap and nxt in "とっ라고는이가도과":
                    continue
                if lower and cased and gap and _cased(nxt):
                    continue
            elif not (upper and gap and cased) and nxt not in "¿¡":
                continue
        elif full:
            if nxt in "，、；：）)":
                continue
        elif dot:
            if "ऀ" <= prev <= "෿" or "฀" <= prev <= "໿":
                continue  # scripts whose sentences do not end in a full stop
            if nxt in ",;:)–—]":
                continue
            if not gap and e == t + 1:
                # no blank: a new sentence only as a capital word after small letters, figures or closing marks
                q = text[t - 1]
                if cased and not (upper and (q.islower() or q.isdigit() or q in ")]%") and (k + 1 >= b or text[k + 1].islower() or not text[k + 1].isalnum())):
                    continue
                if not cased and not nxt.isalpha():
                    continue
            if lower and cased and _cased(nxt) and _short(text, cur, t, nxt, k, b, rules):
                continue
            if t - first <= 4 and text[first:t].strip("(").isdigit():
                continue  # the number of a list entry or heading
            if _suppressed(text, cur, t, k, nxt, rules):
                continue
        elif not run.strip(_ELLIPSIS + "."):
            if not (upper and cased):
                continue
        else:
            if nxt in ",;:)" or (not gap and nxt.isascii() and nxt.isalnum() and not upper and cased):
                continue
        stops.append(e)
        out.append((cur, e))
        cur = skip = k
    if cur < b:
        out.append((cur, b))
    if thai:
        at = len(out)
        parts = out[-(len(stops) + 1) :] if cur < b else out[-len(stops) :]
        del out[at - len(parts) :]
        for s, e in parts:
            for g in _THAI_GAP.finditer(text, s, e):
                out.append((s, g.start()))
                s = g.end()
            out.append((s, e))


def _hard(p: str, n: str, wrapped: bool) -> bool:
    """The break between two lines that are not blank ends a unit.

    ``p`` and ``n`` are stripped; ``wrapped``: the text has lines that break
    within sentences.
    """
    last = p[-1]
    marked = _LIST.match(n)
    if marked:
        if n[0] not in "-–—" and not _NUMBER_MARK.match(n):
            return True
        if last in ".:!?" + STERM or _LIST.match(p) or not wrapped:
            return True
        return _heading(p, n)
    if _LIST.match(p) and not _TERM.search(last):
        return not (wrapped and (n[0].islower() or n[0].isdigit()))
    tail = p.rstrip(CLOSE + "\"'") or p
    if tail[-1] in STERM + ATERM:
        return not wrapped and not tail.endswith(".") or bool(_THAI.match(tail[-1]))
    letter = next((c for c in reversed(p) if c.isalpha()), "")
    if n[0] == "(" or (n[0].isdigit() and len(p.split()) > 1 and letter and _cased(letter) and not _heading(p, n)):
        return False
    if (last == ":" or last == "：") and n[0].islower() and not _begins_upper(n, 0, len(n)):
        return False
    if last == ":" or last == "：":
        return not wrapped or n[0] not in _OPEN
    if letter and not _cased(letter):
        return True
    if n[0].islower() and not _begins_upper(n, 0, len(n)):
        return False
    if not wrapped:
        return p.split()[-1].lower() not in _LINKING
    return _heading(p, n)


def _heading(p: str, n: str) -> bool:
    words = p.split()
    if len(words) > 7 or n[0].islower() and not _begins_upper(n, 0, len(n)):
        return False
    if words[-1].strip(".,;").lower() in _LINKING or p[-1] in ",;(":
        return False
    letters = [w for w in words if any(c.isalpha() for c in w)]
    if letters and all(w.upper() == w and w.lower() != w for w in letters) and any(len(w) >= 4 for w in letters):
        return True
    if _NUMBERED_HEADING.match(p) or re.fullmatch(r"[^\W\d_]{3,} \d{1,4}", p) :
        return True
    return len(words) > 1 and all(w[0].isupper() and len(w) > 3 and w.isalpha() for w in words)


def sentences(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every unit, in code points, end exclusive."""
    if not text or text.isspace():
        return []
    out: list[tuple[int, int]] = []
    thai = _THAI.search(text) is not None
    rules = rules_for(languages_of(text, lang) if "." in text else frozenset())
    breaks = [m.span() for m in _BREAKS.finditer(text)]
    if not breaks:
        _block(text, 0, len(text), out, thai, rules)
        return _trimmed(text, out)
    lines, at = [], 0
    for s, e in breaks:
        lines.append((at, s))
        at = e
    lines.append((at, len(text)))
    stripped = [text[s:e].strip() for s, e in lines]
    wrapped = False
    for p, n in zip(stripped, stripped[1:]):
        if p and n and n[0].islower() and not _begins_upper(n, 0, len(n)) and not _LIST.match(n) and not _LIST.match(p) and p[-1] != ":" and p[-1].isalnum():
            letter = next((c for c in reversed(p) if c.isalpha()), "")
            if letter and _cased(letter) and len(p.split()) > 0:
                wrapped = True
                break
    start = 0
    for i in range(1, len(lines)):
        p, n = stripped[i - 1], stripped[i]
        if not p or not n or _hard(p, n, wrapped):
            _block(text, lines[start][0], lines[i - 1][1], out, thai, rules)
            start = i
    _block(text, lines[start][0], lines[-1][1], out, thai, rules)
    return _trimmed(text, out)


def _trimmed(text: str, units: list[tuple[int, int]]) -> list[tuple[int, int]]:
    got = []
    for s, e in units:
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s < e:
            got.append((s, e))
    return got


def sentence_units(df: DataFrame, key: str, text: str, lang: str | None = None) -> DataFrame:
    """(key, start_char, end_char), one row per unit. ``lang`` may name the text's language, loosely."""
    ddl = f"`{key}` {df.schema[key].dataType.simpleString()}, start_char long, end_char long"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, starts, ends = [], [], []
            for k, t, g in zip(pdf["_key"], pdf["_text"], pdf["_lang"]):
                for s, e in sentences(t, g):
                    keys.append(k)
                    starts.append(s)
                    ends.append(e)
            yield pd.DataFrame({key: pd.Series(keys, dtype=pdf["_key"].dtype), "start_char": pd.Series(starts, dtype="int64"), "end_char": pd.Series(ends, dtype="int64")})

    named = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), named.alias("_lang")).where(F.col("_text").isNotNull()).mapInPandas(cut, ddl)
