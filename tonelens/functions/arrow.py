"""The few text functions Spark has no expression for, as Arrow UDFs over whole batches."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .porter import stem

# Elements whose text isn't shown.
HIDDEN = ("script", "style", "head", "noscript")
#: Words before a full stop that doesn't end a sentence; single letters are others.
ABBREVIATIONS = frozenset("mr mrs ms dr prof st vs etc inc ltd co corp no jan feb mar apr jun jul aug sep sept oct nov dec e.g i.e u.s p.m a.m".split())


def to_ascii(text: str | None) -> str | None:
    """Compatibility forms resolved, accents dropped, what isn't ASCII then removed; null stays null."""
    return text if text is None or text.isascii() else unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


def html_text(text: str | None) -> str | None:
    """Text of an HTML page, entities resolved, pieces joined by spaces; null stays null.

    Scripts, styles and heads are left out up to the end of the outermost of them, so one inside another hides no less.
    """
    if text is None:
        return None
    shown: list[str] = []
    open_hidden = 0

    def step(change: int, tag: str) -> None:
        nonlocal open_hidden
        if tag in HIDDEN:
            open_hidden = max(0, open_hidden + change)

    parser = HTMLParser()
    parser.handle_starttag = lambda tag, attributes: step(1, tag)
    parser.handle_endtag = lambda tag: step(-1, tag)
    parser.handle_data = lambda piece: None if open_hidden else shown.append(piece)
    parser.feed(text)
    parser.close()
    return " ".join(shown)


_RULES = [
    (re.compile(r'^"|(?<=[ (\[{<])"'), " `` "),
    (re.compile(r"([:,])(?=\D|$)"), r" \1 "),
    (re.compile(r"\.\.+"), r" \g<0> "),
    (re.compile(r"[;@#$%&]"), r" \g<0> "),
    (re.compile(r"([^.])(\.)([\])}>\"']*)\s*$"), r"\1 \2 \3 "),
    (re.compile(r"[?!]"), r" \g<0> "),
    (re.compile(r"([^'])' "), r"\1 ' "),
    (re.compile(r"[*]"), r" \g<0> "),
    (re.compile(r"[\]\[(){}<>]"), r" \g<0> "),
    (re.compile(r"--"), " -- "),
    (re.compile(r'"'), " '' "),
    (re.compile(r"([^' ])('s|'m|'d|') "), r"\1 \2 "),
    (re.compile(r"([^' ])('ll|'re|'ve|n't) "), r"\1 \2 "),
    (re.compile(r"\b(can)(not)\b|\b(d)('ye)\b|\b(gim)(me)\b|\b(gon)(na)\b|\b(got)(ta)\b|\b(lem)(me)\b|\b(more)('n)\b|\b(wan)(na)\b"), lambda m: " " + " ".join(g for g in m.groups() if g) + " "),
    (re.compile(r" ('t)(is|was)\b"), r" \1 \2 "),
]
_SENTENCE = re.compile(r"(\S+)([.!?][\"')\]]*)(?=\s)")


def _sentences(text: str) -> list[str]:
    out, start = [], 0
    for m in _SENTENCE.finditer(text):
        word = m[1].lstrip("\"'([{").lower()
        if m[2][0] == "." and (word in ABBREVIATIONS or (len(word) == 1 and word.isalpha())):
            continue
        out.append(text[start : m.end()])
        start = m.end()
    return [*out, text[start:]]


def treebank_tokens(text: str | None) -> list[str]:
    """Lower-cased words of letters only, cut by the public Treebank rules; sentences end at full stops except
    after known abbreviations and single letters. Null and blank text give none."""
    if text is None or not text.strip():
        return []
    out = []
    for s in _sentences(text.lower()):
        s = f" {s.strip()} "
        for pattern, to in _RULES:
            s = pattern.sub(to, s if s.endswith(" ") else s + " ")
        out += [t for t in s.split() if t.isalpha()]
    return out


@F.pandas_udf(T.StringType())
def to_ascii_udf(s: pd.Series) -> pd.Series:
    return s.map(to_ascii, na_action="ignore")


@F.pandas_udf(T.StringType())
def html_text_udf(s: pd.Series) -> pd.Series:
    return s.map(html_text, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def treebank_tokens_udf(s: pd.Series) -> pd.Series:
    return s.map(treebank_tokens)


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems_udf(s: pd.Series) -> pd.Series:
    """Stems of arrays of tokens; each distinct word is stemmed once in a task."""
    return s.map(lambda tokens: [] if tokens is None else [stem(t) for t in tokens])
