"""Garbled text from wrong character encodings (problem 6).

The garbled form of every letter and sign of the texts' alphabets is computed beforehand for all pairs
of a true and a wrongly assumed encoding, twice-wrong decoding included; one multi-pattern automaton
finds them, longest first, and only matched spans are replaced. Pairs of one-byte encodings garble
letter by letter, and a single letter is no evidence, so their spans are words (runs of Cyrillic letters)
that are implausible as they stand and plausible once restored, by letter pairs learned from clean
passages of each language; a pair is taken for a text only if most of the implausible words with its letters become
plausible, so names in languages without passages stay. Characters lost for good (U+FFFD) are counted and left.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table

LEAST = 3
LOST = "�"
#: Decodings taken for UTF-8 by mistake, and one-byte encodings taken for one another.
WIDE = ("cp1252", "latin-1", "cp1251", "cp1250", "cp437", "cp850", "mac_roman", "koi8-r", "cp866")
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5")
LATIN_TAKEN = ("cp1252", "latin-1")
#: Western encodings, and those taken for them.
WESTERN = {
    "cp1252": ("cp1250", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "cp866"),
    "mac_roman": LATIN_TAKEN, "cp437": LATIN_TAKEN, "cp850": LATIN_TAKEN,
}
#: Signs that stand beside and between words in order.
JOINING = "’‘–—\xa0"
BETWEEN = "“”„‚«»‹›…•€£©®°§¿¡™"
# Cyrillic letters that look like Latin ones.
POSING = frozenset("аеорсухікАВЕКМНОРСТУХІ")
#: Share of implausible words that a pair makes plausible, from which the text is taken for one garbled so.
SURE = 0.5
SIGNS = "’‘“”„‚«»‹›–—…•€£©®°§№½¼¾ªº¿¡·\xa0ŒœŸŠšŽž™"
FOUND = "id long, field string, garbled long"
RESTORED = "id long, field string, garbled long, restored string"


def alphabet() -> list[str]:
    """Letters of Latin-1 and Russian, and the usual signs."""
    latin = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
    return latin + [chr(c) for c in range(0x410, 0x450)] + ["Ё", "ё"] + list(SIGNS)


def central_letters() -> list[str]:
    """Letters of Latin Extended-A and Romanian that the alphabet lacks; their forms count beside Latin letters only."""
    own = set(alphabet())
    return [c for c in map(chr, [*range(0x100, 0x180), *range(0x218, 0x21C)]) if c.isalpha() and c not in own]


def decoded(data: bytes, encoding: str) -> str | None:
    """What a lenient reader makes of the bytes; those that Windows code pages don't use become C1 controls."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@lru_cache(1)
def wide_forms() -> dict[str, str]:
    """Garbled form (two characters or more) -> character."""
    forms: dict[str, str] = {}
    for c in alphabet():
        for d in WIDE:
            if c == "\xa0" and d not in LATIN_TAKEN:
                continue  # its form there is an ordinary letter before the same space
            once = decoded(c.encode("utf-8"), d)
            forms.setdefault(once, c)
            if d in LATIN_TAKEN:
                for e in LATIN_TAKEN:
                    forms.setdefault(decoded(once.encode("utf-8"), e), c)
    for c in central_letters():
        for d in LATIN_TAKEN:
            forms.setdefault(decoded(c.encode("utf-8"), d), c)
    return {g: c for g, c in forms.items() if len(g) > 1}


def doubtful(form: str, meant: str) -> bool:
    """Whether a form counts beside Latin letters only: one that can be ordinary Russian, as that of e with grave
    accent, and those of letters of other alphabets."""
    russian = all("А" <= x <= "я" or x in "Ёё" for x in form) and form[0] not in "РС"
    return russian or 0x100 <= ord(meant) < 0x220 and meant not in SIGNS


@lru_cache(1)
def automaton() -> tuple[ahocorasick.Automaton, re.Pattern]:
    made = ahocorasick.Automaton()
    for g, c in wide_forms().items():
        made.add_word(g, (len(g), c, doubtful(g, c), g[0] == "Ă" and g.isalpha() and g.isupper()))
    made.make_automaton()
    first = "".join(sorted({g[0] for g in wide_forms()}))
    second = "".join(sorted({g[1] for g in wide_forms()}))
    return made, re.compile(f"[{re.escape(first)}][{re.escape(second)}]")


def narrow_map(true: str, taken: str) -> dict[str, str]:
    """Character seen -> character meant, where bytes of one encoding were read as another."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            meant = bytes([b]).decode(true)
        except UnicodeDecodeError:
            continue
        seen = decoded(bytes([b]), taken)
        if seen != meant:
            out[seen] = meant
    return out


@lru_cache(1)
def narrow_pairs() -> list[tuple[dict[str, str], re.Pattern]]:
    pairs = []
    for true in CYRILLIC:
        for taken in (*LATIN_TAKEN[:1], *CYRILLIC, "mac_roman"):
            if taken != true:
                m = {s: t for s, t in narrow_map(true, taken).items() if t.isalpha() and not s.isspace()}
                pairs.append((m, re.compile("[" + re.escape("".join(sorted(m))) + "]+")))
    return pairs


@lru_cache(1)
def western_pairs() -> list[tuple[dict[str, str], dict[int, str], re.Pattern]]:
    """(letter seen -> letter meant, the same for translate, words) of each pair of a Western encoding and one taken for
    it. Signs that stand beside words in order count between two letters only, those that join words, as the apostrophe, not at all."""
    pairs = []
    for true, takens in WESTERN.items():
        for taken in takens:
            m = {s: t for s, t in narrow_map(true, taken).items() if t.isalpha() and t not in "ªºƒ" and s not in JOINING and not s.isspace() and not s.isascii()}
            letters = "[A-Za-zÀ-ÖØ-öø-ÿ" + re.escape("".join(sorted(set(m) - set(BETWEEN)))) + "]+"
            signs = re.escape("".join(sorted(set(m) & set(BETWEEN))))
            pairs.append((m, str.maketrans(m), re.compile(f"{letters}(?:[{signs}]{letters})*" if signs else letters)))
    return pairs


@lru_cache(1)
def odd_latin() -> re.Pattern:
    """Where a text may hold Western words read in another one-byte encoding: a sign or letter of no language here beside a
    Latin letter, a capital after a small letter, letters of two scripts."""
    own = set(alphabet())
    odd = re.escape("".join(sorted({c for m, _, _ in western_pairs() for c in m if c not in own})))
    return re.compile(f"[A-Za-z][{odd}]|[{odd}][A-Za-z]|[ ][{odd}][ ]|[a-zß-öø-ÿ][À-ÖØ-ÞŒŠŽŸ]|[A-Za-z][А-яЁё]|[А-яЁё][A-Za-z]")


LATIN_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")
LATIN_RUN = re.compile("[à-ÿ]{4}")
SUSPECT = re.compile("[À-ÿ¸¨]{3}|[а-яё][А-ЯЁ]|[А-ЯЁ]{4}|[─-╿]")


def letter_pairs(lang: str, passage: str | None):
    """Neighbouring letters of a passage's words, their ends as spaces; of Russian ones the Russian words."""
    for w in re.findall("[а-яё]+" if lang == "ru" else r"[^\W\d_]+", (passage or "").lower()):
        yield from zip(" " + w, w + " ")


@lru_cache(1)
def asked_letters() -> frozenset:
    """Letters of the words whose plausibility is asked for, in lower case; pairs of others needn't be kept."""
    seen = {c for m, _, _ in western_pairs() for x in m.items() for c in x} | {chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]}
    return frozenset(x for c in seen | set("ς ") | set("абвгдеёжзийклмнопрстуфхцчшщъыьэюя") for x in c.lower())


def _pair_counts(batches):
    counts: Counter = Counter()
    letters = asked_letters()
    for batch in batches:
        for lang, p in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts.update((lang, a, b) for a, b in letter_pairs(lang, p) if a in letters and b in letters)
    if counts:
        lang, a, b = zip(*counts)
        yield pa.record_batch({"lang": pa.array(lang), "a": pa.array(a), "b": pa.array(b), "n": pa.array(list(counts.values()), pa.int64())})


def learned(samples: DataFrame, lang_column: str = "lang", text_column: str = "text") -> Plausible:
    """From all clean passages. They are counted where they lie; at most the pairs of some hundred letters come to the
    driver for each language."""
    rows = samples.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts: dict[str, Counter] = {}
    for lang, a, b, n in rows.mapInArrow(_pair_counts, "lang string, a string, b string, n long").groupBy("lang", "a", "b").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(lang, Counter())[a, b] = n
    return Plausible.counted(counts)


class Plausible:
    """How likely letters follow one another, by clean passages ``(language, text)``: for Russian in bits a letter,
    smoothed; for languages in Latin letters whether a pair of letters was seen."""

    def __init__(self, passages: list[tuple[str, str]]):
        counts: dict[str, Counter] = {}
        for lang, p in passages:
            counts.setdefault(lang, Counter()).update(letter_pairs(lang, p))
        self._learn(counts)

    @classmethod
    def counted(cls, counts: dict[str, Counter]) -> Plausible:
        """By the counts of each language's letter pairs."""
        made = cls([])
        made._learn(counts)
        return made

    def _learn(self, counts: dict[str, Counter]) -> None:
        pairs = counts.get("ru", Counter())
        self.known: dict[str, set] = {lang: set(n) for lang, n in counts.items() if lang != "ru"}
        ones: Counter = Counter()
        for (a, _), n in pairs.items():
            ones[a] += n
        self.bits = {k: math.log2((n + 0.1) / (ones[k[0]] + 3.4)) for k, n in pairs.items()}
        self.least = -10.0
        self.seen: dict[str, int] = {}

    def of(self, word: str) -> float:
        w = word.lower()
        return sum(self.bits.get(p, self.least) for p in zip(" " + w, w + " ")) / (len(w) + 1)

    def unknown(self, word: str) -> int:
        """Pairs of letters that the language which knows most of them doesn't know; a capital after a small letter is one."""
        n = self.seen.get(word)
        if n is None:
            if len(self.seen) > 1 << 18:
                self.seen.clear()
            w = word.lower()
            pairs = list(zip(" " + w, w + " "))
            mixed = sum(a.islower() and b.isupper() for a, b in zip(word, word[1:]))
            n = self.seen[word] = mixed + min((sum(p not in own for p in pairs) for own in self.known.values()), default=len(pairs))
        return n


def _western(text: str, plausible: Plausible) -> tuple[int, str]:
    """Restores the words that one Western pair makes plausible, for the pair that restores most."""
    best, chosen = 0, []
    for mapping, table, words in western_pairs():
        sure, rest, maybe, total = [], [], [], 0
        for m in words.finditer(text):
            seen = m.group()
            if seen.isascii() or not any(c in mapping for c in seen) or not (was := plausible.unknown(seen)):
                continue
            meant = seen.translate(table)
            now = plausible.unknown(meant)
            # letters that pose as Latin ones are another problem's, and no evidence here
            posing = all(c in POSING for c in seen if c in mapping)
            (maybe if posing else rest if now else sure).append((m.start(), m.end(), meant, now < was))
            total += 0 if now or posing else sum(a != b for a, b in zip(seen, meant))
        if total > best and len(sure) >= SURE * (len(sure) + len(rest)):
            best, chosen = total, sure + [r for r in rest + maybe if r[3]]
    if not chosen:
        return 0, text
    out, at, count = [], 0, 0
    for a, b, meant, _ in sorted(chosen):
        count += sum(x != y for x, y in zip(text[a:b], meant))
        out += [text[at:a], meant]
        at = b
    return count, "".join(out) + text[at:]


def _narrow(text: str, plausible: Plausible) -> tuple[int, str]:
    """Restores the runs of the one-byte pair that makes most of them plausible."""
    best, chosen = 0, None
    for mapping, run in narrow_pairs():
        spans, near, total = [], [], 0
        for m in run.finditer(text):
            seen = m.group()
            meant = "".join(map(mapping.__getitem__, seen))
            if len(seen) < 3:
                near.append((m.start(), m.end(), meant))
                continue
            gain = plausible.of(meant) - (plausible.of(seen) if re.fullmatch("[А-Яа-яЁё]+", seen) else plausible.least)
            if gain > 1.5 and plausible.of(meant) > -5.5:
                spans.append((m.start(), m.end(), meant))
                total += len(seen)
        if spans and total > best:
            # short words go with a garbled neighbour
            edges = [x for s in spans for x in s[:2]]
            spans += [n for n in near if any(abs(n[0] - e) <= 2 or abs(n[1] - e) <= 2 for e in edges)]
            best, chosen = total, spans
    if not chosen:
        return 0, text
    out, at, count = [], 0, 0
    for a, b, meant in sorted(chosen):
        out += [text[at:a], meant]
        at, count = b, count + b - a
    return count, "".join(out) + text[at:]


def repair(text: str, plausible: Plausible) -> tuple[int, str]:
    """(characters garbled or lost, text with garbled spans restored). Text in order comes back as it is."""
    made, begin = automaton()
    count = text.count(LOST)
    letters = bool(LATIN_RUN.search(text))
    if letters:  # Russian letter by letter as Western ones, before pairs of these are taken for forms of one
        n, text = _narrow(text, plausible)
        count += n
    if begin.search(text):
        out, at = [], 0
        for end, (n, c, doubt, capitals) in made.iter_long(text):
            start = end - n + 1
            beside = text[max(0, start - 1) : start] + text[end + 1 : end + 2]
            # Romanian capitals among capitals are a word in order
            if doubt and not LATIN_LETTER.search(beside) or capitals and any(x.isupper() for x in beside):
                continue
            out += [text[at:start], c]
            at, count = end + 1, count + 1
        text = "".join(out) + text[at:]
    if odd_latin().search(text):
        n, text = _western(text, plausible)
        count += n
    if not letters and SUSPECT.search(text):
        n, text = _narrow(text, plausible)
        count += n
    return count, text


def _mapper(fields: list[str], plausible: Plausible, least: int, restored: bool):
    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for field in fields:
                rows = []
                for i, t in zip(ids, batch.column(field).to_pylist()):
                    if t and not t.isascii():
                        n, fixed = repair(t, plausible)
                        if n >= least:
                            rows.append((i, n, fixed))
                if rows:
                    i, n, fixed = zip(*rows)
                    cols = {"id": pa.array(i, pa.int64()), "field": pa.array([field] * len(i)), "garbled": pa.array(n, pa.int64())}
                    yield pa.record_batch(cols | ({"restored": pa.array(fixed, pa.string())} if restored else {}))

    return run


def garbled(df: DataFrame, id_column: str, fields: list[str], samples: DataFrame, least: int = LEAST, restored: bool = False) -> DataFrame:
    """``id, field, garbled[, restored]`` of the texts with at least ``least`` garbled or lost characters.

    A narrow map; null and empty texts give nothing, a null id stays null.
    """
    rows = df.select(F.col(id_column).cast("long").alias("id"), *[F.col(f).cast("string").alias(f) for f in fields])
    return rows.mapInArrow(_mapper(fields, learned(samples), least, restored), RESTORED if restored else FOUND)


def p6_found(spark, sf_dir: str) -> DataFrame:
    found = garbled(table(spark, sf_dir, "speeches"), "speech_id", ["text", "text_original"], table(spark, sf_dir, "lang_samples"))
    return found.select(F.col("id").alias("speech_id"), "field")


def p6_restored(spark, sf_dir: str) -> DataFrame:
    found = garbled(table(spark, sf_dir, "speeches"), "speech_id", ["text", "text_original"], table(spark, sf_dir, "lang_samples"), restored=True)
    return found.withColumnRenamed("id", "speech_id")


def p6_lost(spark, sf_dir: str) -> DataFrame:
    """Fields found of which LEAST characters or more are lost for good: restored, they still lack them."""
    found = garbled(table(spark, sf_dir, "speeches"), "speech_id", ["text", "text_original"], table(spark, sf_dir, "lang_samples"), restored=True)
    lost = F.length("restored") - F.length(F.replace("restored", F.lit(LOST), F.lit("")))
    return found.where(lost >= LEAST).select(F.col("id").alias("speech_id"), "field")
