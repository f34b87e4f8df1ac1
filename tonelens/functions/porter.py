"""Porter's stemmer (Program 14(3), 1980) with the widely used later refinements: irregular words, ies and
ied of short words, y after a consonant only, and the suffixes bli, alli, fulli and logi."""

from __future__ import annotations

from functools import lru_cache

# Irregular stems.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    shape = _shape(word)
    return (shape.endswith("cvc") and word[-1] not in "wxy") or shape == "vc"


def _swap(word: str, rules, ok) -> str:
    """The first suffix that fits decides, whether or not its condition holds."""
    for suffix, to in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + to if ok(stem) else word
    return word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a word, lower-cased; words of one or two letters stay as they are."""
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    return _last(_four(_swap(_two(_end_y(_one_b(_one_a(w)))), STEP3, lambda s: _measure(s) > 0)))


def _one_a(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _one_b(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix) and "v" in _shape(w[: -len(suffix)]):
            s = w[: -len(suffix)]
            if s.endswith(("at", "bl", "iz")):
                return s + "e"
            if _double(s):
                return s if s[-1] in "lsz" else s[:-1]
            return s + "e" if _measure(s) == 1 and _short_end(s) else s
    return w


def _end_y(w: str) -> str:
    return w[:-1] + "i" if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c" else w


def _two(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _two(w[:-2])
    if w.endswith("logi"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    return _swap(w, sorted(STEP2, key=lambda r: -len(r[0])), lambda s: _measure(s) > 0)


def _four(w: str) -> str:
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            s = w[: -len(suffix)]
            return s if _measure(s) > 1 and (suffix != "ion" or s.endswith(("s", "t"))) else w
    return w


def _last(w: str) -> str:
    if w.endswith("e"):
        s = w[:-1]
        if _measure(s) > 1 or (_measure(s) == 1 and not _short_end(s)):
            w = s
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w
