"""Visually identical text with different characters (problem 1).

Strings and code points that look alike are joined into transitive classes by union-find: compatibility
forms with what they stand for, letters and accents apart with the letter in one, and foreign and
unusual letters with the common ones, by a short list and by the public table of confusable characters that
comes with Spark (ICU). Of each class the member most frequent in the corpus stands for it, one for each
script. Text is rewritten greedily, longest match first, by multi-pattern automata: one over the
members that are rewritten anywhere and, for words that mix scripts, one for each script. Then accents are
composed over whole sequences, and all of it repeats until nothing changes, so a text in one form stays as it is.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import garbled as garble
from .shared import table
from .textkit import LAST, Codes, slices

# Letters of other scripts and unusual Latin letters, each before the letter it looks like.
ALIKE = tuple((
    "аa вb еe ѕs іi јj оo рp сc уy хx һh ԁd ԛq ԝw ɡg ɑa ıi ɩi ʏy ɴn ʀr "
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX Һh ҮY ԚQ ԜW "
    "αa οo ρp νv υu γy ιi κk ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX "
    "ӏl ⅼl ɪI ʜH ƅb ցg օo ոn ѵv"
).split())
LATIN, CYRILLIC, GREEK, OTHER = 1, 2, 3, 4


def invisible(c: str) -> bool:
    return unicodedata.category(c) == "Cf" or c in "͏ᅟᅠ឴឵ㅤﾠ︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️"


def odd_space(c: str) -> bool:
    return unicodedata.category(c) == "Zs" and c != " "


@lru_cache(1)
def script() -> np.ndarray:
    """Script of each letter; 0 for what isn't one."""
    out = np.zeros(LAST, np.uint8)
    for c in range(LAST):
        if unicodedata.category(chr(c))[0] == "L":
            name = unicodedata.name(chr(c), "")
            out[c] = LATIN if name.startswith("LATIN") or c in (0xAA, 0xBA) else CYRILLIC if name.startswith("CYRILLIC") else GREEK if name.startswith("GREEK") else OTHER
    return out


class Classes:
    """Union-find over strings."""

    def __init__(self):
        self.up: dict[str, str] = {}

    def root(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: str, y: str) -> None:
        self.up[self.root(x)] = self.root(y)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.root(x), []).append(x)
        return out


def public_alike(spark) -> tuple[str, ...]:
    """A letter outside the texts' own alphabets, and after it the letter or letters it looks like, by ICU's confusables.

    Letters look alike if ICU gives them one skeleton, which needn't be a letter of theirs: that of Greek and Russian т is ᴛ. One
    that looks like no single letter may look like several, as ꜳ. Digits and signs are no letters, so those that look like one
    aren't taken; capitals that look like l are taken for I. Without ICU this is an error, not a shorter table.
    """
    try:
        skeleton = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton
        own = [c for c in map(chr, range(0x41, 0x460)) if _own(c) and unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFKD", c) == c]
        letters = [c for c in map(chr, range(0x80, LAST)) if unicodedata.category(c)[0] == "L" and not _own(c) and unicodedata.normalize("NFKC", c) == c and script()[ord(c)]]
        shapes = skeleton("\n".join(own + letters)).split("\n")
    except Exception as e:  # a session without a JVM at hand, or Spark without ICU
        raise RuntimeError("letters that look alike are told by ICU's table in Spark's JVM, which isn't there") from e
    # of own letters with one skeleton a Russian one stands for it, then the first
    like: dict[str, str] = {}
    for c, shape in sorted(zip(own, shapes), key=lambda x: (x[0] < "Ѐ", x[0])):
        like.setdefault(shape, c)
    out = []
    for c, shape in zip(letters, shapes[len(own) :]):
        common = lambda x: x.isalpha() and (x.isascii() or all("а" <= y <= "я" for y in x))
        seen = shape if len(shape) == 1 and common(shape) else like.get(shape) or (shape if common(shape) else "")
        if seen and seen != c:
            out.append(c + (seen.replace("l", "I") if c.isupper() else seen))
    return tuple(out)


def alike_pairs(spark) -> tuple[str, ...]:
    """The short list and the public pairs. Where both have a letter in words of one script, the short list holds."""
    listed = {(p[0], int(script()[ord(p[1])])) for p in ALIKE}
    return (*ALIKE, *(p for p in public_alike(spark) if (p[0], int(script()[ord(p[1])])) not in listed))


def _own(c: str) -> bool:
    """Letters of Western Europe and of Russian, which are right in their own words and look like others by ALIKE only."""
    return ord(c) < 0x180 or "Ѐ" <= c <= "ё" or c == "ẞ"


@lru_cache(2)
def classes(alike: tuple[str, ...] = ALIKE) -> Classes:
    made = Classes()
    for c in map(chr, range(sys.maxunicode + 1)):
        kind = unicodedata.category(c)
        if kind in ("Cs", "Cn", "Co"):
            continue
        if invisible(c):
            made.join(c, "")
        elif odd_space(c):
            made.join(c, " ")
        elif not c.isascii():
            flat = unicodedata.normalize("NFKC", c)
            apart = unicodedata.normalize("NFD", c)
            if flat != c and kind[0] in "LN" and flat.isalnum():
                made.join(c, flat)
            elif apart != c and unicodedata.normalize("NFC", apart) == c:
                made.join(apart, c)
            elif flat != c and 0xFF00 < ord(c) < 0xFFF0:
                made.join(c, flat)
    for pair in alike:
        if len(pair) == 2 and pair not in further(alike):
            made.join(pair[0], pair[1])
    return made


@lru_cache(2)
def further(alike: tuple[str, ...] = ALIKE) -> frozenset:
    """Pairs of a letter that an earlier pair has: what it looks like in words of another script only."""
    first: dict[str, str] = {}
    return frozenset(p for p in alike if first.setdefault(p[0], p) != p)


def representatives(counts: np.ndarray, alike: tuple[str, ...] = ALIKE) -> tuple[dict[str, str], dict[int, dict[str, str]]]:
    """(member -> representative, anywhere; script -> letter -> representative, inside a word of the script).

    counts: occurrences of each code point in the corpus. Of a class the most frequent single character of a
    script stands for it in that script; where the script isn't known by a word, a Latin one if there is one, as
    compatibility forms stand for those. Letters of ``alike`` are rewritten by their word only, those that look like
    several letters in words of these letters' script.
    """
    kinds, keep, unusual = script(), frozenset(p[0] for p in alike), unusual_letters(alike)
    anywhere: dict[str, str] = {}
    inside: dict[int, dict[str, str]] = {LATIN: {}, CYRILLIC: {}}
    for group in classes(alike).members().values():
        if len(group) == 1:
            continue
        if "" in group or " " in group:
            anywhere |= {m: "" if "" in group else " " for m in group if m not in ("", " ")}
            continue
        plain = [m for m in group if len(m) == 1 and (m.isascii() or (unicodedata.normalize("NFKC", m) == m and m not in unusual))]
        if not plain:
            plain = [m for m in group if unicodedata.normalize("NFKC", m) == m] or group
        seen = lambda m: (sum(int(counts[ord(x)]) for x in m) / max(1, len(m)), m.isascii(), -ord(m[0]) if m else 0)
        latin = [m for m in plain if kinds[ord(m[0])] in (0, LATIN)]
        top = max(latin or plain, key=seen)
        for m in group:
            if m != top and m not in keep and not (len(m) == 1 and m in plain):
                anywhere[m] = top
        for s in inside:
            own = [m for m in plain if len(m) == 1 and kinds[ord(m)] == s and m not in keep] or [m for m in plain if len(m) == 1 and kinds[ord(m)] == s]
            if own:
                best = max(own, key=seen)
                inside[s] |= {m: best for m in group if len(m) == 1 and m != best and kinds[ord(m)] and (kinds[ord(m)] != s or m in unusual)}
    for p in alike:
        if len(p) > 2 or p in further(alike):  # several letters, all of one script
            inside[int(kinds[ord(p[1])])][p[0]] = p[1:]
    return anywhere, inside


@lru_cache(2)
def unusual_letters(alike: tuple[str, ...] = ALIKE) -> frozenset:
    """Latin letters that pose as common ones, rewritten in words of Latin letters as well."""
    return frozenset(p[0] for p in alike if script()[ord(p[0])] == LATIN)


def greedy(made: ahocorasick.Automaton, text: str) -> tuple[str, int]:
    """(text with the members replaced, longest first from the left; replacements that count)."""
    out, at, n = [], 0, 0
    for end, (length, r, counts) in made.iter_long(text):
        start = end - length + 1
        out += [text[at:start], r]
        at, n = end + 1, n + counts
    return ("".join(out) + text[at:], n) if out else (text, 0)


def _automaton(members: dict[str, str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for m, r in members.items():
        made.add_word(m, (len(m), r, r in ("", " ") or r.isalnum()))
    made.make_automaton()
    return made


class Rewriter:
    def __init__(self, anywhere: dict, inside: dict, unusual: frozenset):
        self.anywhere, self.inside, self.unusual = anywhere, inside, unusual
        self.made, self.within = _automaton(self.anywhere), {k: _automaton(t) for k, t in self.inside.items()}
        self.alone = np.zeros(LAST, bool)
        for m in self.anywhere:
            # of letters and accents apart, the accent is looked for
            self.alone[ord(m[-1]) if len(m) > 1 and unicodedata.combining(m[-1]) else ord(m[0])] = len(m) == 1 or bool(unicodedata.combining(m[-1]))
        for m in self.unusual:
            self.alone[ord(m)] = True
        self.kinds = script()
        self.changing = frozenset(m for t in self.inside.values() for m in t)
        self.letters = re.compile(r"[^\W\d_]+")

    def suspects(self, texts: list) -> np.ndarray:
        """Texts with a character to rewrite or neighbouring letters of two scripts; by array operations."""
        codes = Codes(texts)
        kinds = self.kinds[codes.cp]
        odd = self.alone[codes.cp]
        odd[1:] |= (kinds[1:] != kinds[:-1]) & (kinds[1:] > 0) & (kinds[:-1] > 0)
        return np.unique(np.searchsorted(codes.starts, np.flatnonzero(odd), "right") - 1)

    def rewrite(self, text: str) -> tuple[str, int]:
        """(text in one form, replacements of letters, digits, accents, spaces and invisible characters); those of
        punctuation in full width aren't counted. The form itself comes back unchanged."""
        total = 0
        while True:
            new, n = self._pass(text)
            total += n
            if new == text:
                return text, total
            text = new

    def _pass(self, text: str) -> tuple[str, int]:
        text, n = greedy(self.made, text)
        whole = text if text.isascii() else unicodedata.normalize("NFC", text)
        n += max(0, len(text) - len(whole))
        mixed = 0

        def word(m: re.Match) -> str:
            nonlocal mixed
            w = m.group()
            if w.isascii():
                return w
            kinds = [int(self.kinds[ord(c)]) for c in w]
            if len(set(kinds)) == 1 and not self.unusual & set(w):
                return w
            sure = [k for k, c in zip(kinds, w) if c not in self.changing]
            votes = sure or kinds
            own = LATIN if votes.count(LATIN) >= votes.count(CYRILLIC) else CYRILLIC
            new, changed = greedy(self.within[own], w)
            mixed += changed
            return new

        text = self.letters.sub(word, whole)
        if mixed:
            # where letters pose inside words, words wholly of posing letters do as well
            kinds = self.kinds[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
            latin, cyrillic = np.count_nonzero(kinds == LATIN), np.count_nonzero(kinds == CYRILLIC)
            own, foreign = (LATIN, CYRILLIC) if latin >= cyrillic else (CYRILLIC, LATIN)
            if min(latin, cyrillic) * 20 <= max(latin, cyrillic):
                posing = {c for c in self.inside[own] if self.kinds[ord(c)] in (foreign, GREEK)}

                def all_posing(m: re.Match) -> str:
                    nonlocal mixed
                    w = m.group()
                    if not posing.issuperset(w):
                        return w
                    mixed += len(w)
                    return greedy(self.within[own], w)[0]

                text = self.letters.sub(all_posing, text)
        return text, n + mixed


def _count(batches):
    total = np.zeros(LAST, np.int64)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts):
            part = np.bincount(Codes(texts[a:b]).cp)
            total[: len(part)] += part
    there = np.flatnonzero(total)
    there = there[there > 0]
    yield pa.record_batch({"code": pa.array(there), "n": pa.array(total[there])})


def code_counts(df: DataFrame, text_column: str) -> np.ndarray:
    """Occurrences of every code point in the whole corpus: one row a code point and task is shuffled, and
    at most 0x110000 numbers come to the driver whatever the corpus."""
    rows = df.select(F.col(text_column).cast("string").alias("text")).mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    out = np.zeros(LAST, np.int64)
    got = rows.toPandas()
    out[got["code"].to_numpy()] = got["n"].to_numpy()
    return out


def _mapper(form: tuple, plausible: garble.Plausible | None, all_rows: bool):
    def run(batches):
        writer = Rewriter(*form)
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            for a, b in slices(texts):
                new, n, bad = list(texts[a:b]), np.zeros(b - a, np.int64), np.zeros(b - a, bool)
                for i in writer.suspects(texts[a:b]).tolist():
                    t, bad[i] = texts[a + i], False
                    if plausible is not None:
                        broken, fixed = garble.repair(t, plausible)
                        bad[i] = broken >= garble.LEAST
                    new[i], n[i] = writer.rewrite(t)
                if all_rows:
                    yield pa.record_batch({"id": pa.array(ids[a:b], pa.int64()), "changes": pa.array(n), "garbled": pa.array(bad), "unified": pa.array(new, pa.string())})
                elif n.any():
                    at = np.flatnonzero(n)
                    yield pa.record_batch({"id": pa.array([ids[a + i] for i in at], pa.int64()), "changes": pa.array(n[at]), "garbled": pa.array(bad[at])})

    return run


def unified(df: DataFrame, id_column: str, text_column: str, samples: DataFrame | None = None, all_rows: bool = True) -> DataFrame:
    """``id, changes, garbled[, unified]``: each text in one form and its number of replacements.

    Null stays null, with no changes. With clean ``samples``, garbled tells the cases of problem 6.
    Two scans, the first for the counts; without ``all_rows`` only rows that change, without text.
    """
    alike = alike_pairs(df.sparkSession)
    # made once, of at most as many members as there are characters, and sent to the tasks
    form = (*representatives(code_counts(df, text_column), alike), unusual_letters(alike))
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    plausible = None if samples is None else garble.learned(samples)
    return rows.mapInArrow(_mapper(form, plausible, all_rows), "id long, changes long, garbled boolean" + ", unified string" * all_rows)


def p1_found(spark, sf_dir: str) -> DataFrame:
    rows = unified(table(spark, sf_dir, "speeches"), "speech_id", "text", table(spark, sf_dir, "lang_samples"), all_rows=False)
    return rows.where("changes > 0 AND NOT garbled").select(F.col("id").alias("speech_id"))


def p1_unified(spark, sf_dir: str) -> DataFrame:
    return unified(table(spark, sf_dir, "speeches"), "speech_id", "text").select(F.col("id").alias("speech_id"), "changes", "unified")


def p1_plain(spark, sf_dir: str) -> DataFrame:
    """Speeches whose one form is ASCII without a change: those that were ASCII."""
    rows = unified(table(spark, sf_dir, "speeches"), "speech_id", "text")
    return rows.where((F.col("changes") == 0) & ~F.col("unified").rlike(r"[^\x00-\x7F]")).select(F.col("id").alias("speech_id"))
