"""Languages of documents and passages by prediction by partial matching (problem 2).

For each language a context tree over bytes (orders 0 to 4, escape method C) is learned from clean
passages and frozen; a word's exact code length is the sum over its bytes and the space after it, each
coded in the longest context known, with an escape for every context that lacks it. Code lengths of words
are kept in a table, so a text costs a look-up for each word. A sentence has the language that codes
it in the fewest bits; sentences with little evidence follow their document.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import garbled as garble
from .shared import table
from .textkit import U64, Codes, Words, slices

ORDER = 4
SHARE = 0.15
SAMPLE_ROWS = 10_000
#: A word that no language codes in fewer bits a byte is a name or a slip; it counts for none.
UNKNOWN_BITS = 3.6
#: Evidence of a sentence of its own: known words, and bits over the document's language.
LEAST_WORDS, LEAST_BITS = 4, 10.0
#: Bits are weighed down for the confidence, as neighbouring words aren't independent.
TEMPER = 0.25
# Codes and English names of the languages.
NAMES = {
    "en": "en eng english", "fr": "fr fra fre french", "de": "de deu ger german", "es": "es spa spanish",
    "it": "it ita italian", "pt": "pt por portuguese", "ru": "ru rus russian",
}


class ContextTree:
    """Counts of bytes in their contexts of up to ORDER bytes, within words and the spaces around them."""

    def __init__(self, passages: list[str]):
        counts: Counter = Counter()
        for p in passages:
            for w in _words(p or ""):
                data = b" " + w.encode() + b" "
                for i in range(1, len(data)):
                    for o in range(min(ORDER, i) + 1):
                        counts[data[i - o : i], data[i]] += 1
        self.total: Counter = Counter()
        self.kinds: Counter = Counter()
        for (context, _), n in counts.items():
            self.total[context] += n
            self.kinds[context] += 1
        self.counts = dict(counts)

    def bits(self, context: bytes, byte: int) -> float:
        out = 0.0
        for o in range(len(context) + 1):
            c = context[o:]
            n = self.total.get(c, 0)
            if not n:
                continue
            room = n + self.kinds[c]
            if hit := self.counts.get((c, byte)):
                return out - math.log2(hit / room)
            out -= math.log2(self.kinds[c] / room)
        return out + 8.0


def _words(text: str) -> list[str]:
    w = Words(Codes([text]))
    return [w.word(i) for i in range(len(w))]


class Coder:
    """Code lengths of words in every language, kept by word hash."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in samples})
        self.trees = [ContextTree([t for lang, t in samples if lang == x]) for x in self.langs]
        self.steps: dict[tuple[bytes, int], np.ndarray] = {}
        self.hashes, self.table = np.zeros(0, U64), np.zeros((0, len(self.langs)), np.float32)

    def of_word(self, word: str) -> np.ndarray:
        data = b" " + word.encode("utf-8", "replace") + b" "
        out = np.zeros(len(self.langs), np.float32)
        for i in range(1, len(data)):
            key = (data[max(0, i - ORDER) : i], data[i])
            step = self.steps.get(key)
            if step is None:
                step = self.steps[key] = np.array([t.bits(*key) for t in self.trees], np.float32)
            out += step
        if any(c.isdigit() for c in word) or out.min() > UNKNOWN_BITS * (len(data) - 1):
            out[:] = 0  # no evidence for any
        return out

    def of(self, words: Words) -> np.ndarray:
        """(word, language) bits; rows of zeros for words that count for no language."""
        seen, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, seen)
        known = np.zeros(len(seen), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == seen[inside]
        if not known.all():
            if len(self.hashes) > 1 << 19:  # forgets, so memory stays bounded
                self.hashes, self.table = self.hashes[:0], self.table[:0]
                self.steps.clear()
                known[:] = False
            new = np.array([self.of_word(words.word(i)) for i in first[~known].tolist()], np.float32).reshape(-1, len(self.langs))
            hashes = np.concatenate([self.hashes, seen[~known]])
            order = np.argsort(hashes)
            self.hashes, self.table = hashes[order], np.concatenate([self.table, new])[order]
            at = np.searchsorted(self.hashes, seen)
        return self.table[at][back]


def sentence_starts(codes: Codes) -> np.ndarray:
    """Positions at which a sentence can begin: each text, and after a stop and space, or an empty line."""
    cp = codes.cp
    stop = np.isin(cp, np.array([ord(c) for c in ".!?"], np.uint32))
    space = np.isin(cp, np.array([32, 10, 13, 160], np.uint32))
    line = cp == 10
    begin = np.zeros(len(cp) + 1, bool)
    begin[2:][stop[:-1] & space[1:]] = True
    begin[2:][line[:-1] & line[1:]] = True
    # a line that ends without a stop, before a capital: a heading or a line of the site
    begin[codes.starts] = True
    return np.flatnonzero(begin[:-1])


def prepared(texts: list, plausible: garble.Plausible) -> tuple[list, np.ndarray, np.ndarray]:
    """(texts as they are labelled, their sentences' starts in the texts laid end to end, the same sentences' starts in the
    stored texts).

    A garbled text has the language it had before, and so has one in compatibility forms. Where that joins or parts
    sentences, the stored text's own sentences are restored one by one.
    """
    plain = [t if not t or t.isascii() else unicodedata.normalize("NFKC", garble.repair(t, plausible)[1]) for t in texts]
    stored, codes = Codes(texts), Codes(plain)
    was, now = sentence_starts(stored), sentence_starts(codes)
    of = lambda c, at: np.diff(np.searchsorted(at, c.starts))
    odd = np.flatnonzero(of(stored, was) != of(codes, now))
    if not len(odd):
        return plain, now, was - stored.starts[stored.doc_of(was)]
    starts = [part - c for part, c in zip(np.split(now, np.searchsorted(now, codes.starts[1:-1])), codes.starts)]
    cut = np.searchsorted(was, stored.starts)
    for d in odd.tolist():
        own = was[cut[d] : cut[d + 1]] - stored.starts[d]
        ends = [*own[1:].tolist(), len(texts[d])]
        pieces = [unicodedata.normalize("NFKC", garble.repair(texts[d][i:j], plausible)[1]) for i, j in zip(own.tolist(), ends)]
        plain[d], starts[d] = "".join(pieces), np.cumsum([0, *map(len, pieces[:-1])])
    codes = Codes(plain)
    return plain, np.concatenate([s + c for s, c in zip(starts, codes.starts)]), was - stored.starts[stored.doc_of(was)]


def _sure(cost: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Probability of a language by code lengths, of all languages alike before."""
    return 1 / np.exp2(np.clip((cost[np.arange(len(cost)), lang][:, None] - cost) * TEMPER, -60, 60)).sum(axis=1)


def label(texts: list, coder: Coder, starts: np.ndarray | None = None):
    """For each sentence: text, start, end, language, known words, code lengths and confidence; and each text's language
    and confidence. starts: where sentences begin in the texts laid end to end."""
    codes = Codes(texts)
    words = Words(codes)
    starts = sentence_starts(codes) if starts is None else starts
    ends = np.append(starts[1:], len(codes.cp))
    bits = coder.of(words)
    known = bits.any(axis=1)
    edges = np.searchsorted(words.start, np.append(starts, len(codes.cp)))
    total = np.concatenate([np.zeros((1, bits.shape[1])), np.cumsum(bits, axis=0, dtype=np.float64)])
    count = np.concatenate([[0], np.cumsum(known)])
    cost, n = total[edges[1:]] - total[edges[:-1]], count[edges[1:]] - count[edges[:-1]]
    doc = np.searchsorted(codes.starts, starts, "right") - 1
    whole = total[words.first[1:]] - total[words.first[:-1]]
    top = whole.argmin(axis=1)
    own = cost.argmin(axis=1)
    rows = np.arange(len(own))
    weak = (n < LEAST_WORDS) | (cost[rows, top[doc]] - cost[rows, own] < LEAST_BITS)
    own = np.where(weak, top[doc], own)
    return {"doc": doc, "start": starts - codes.starts[doc], "end": np.minimum(ends - codes.starts[doc], codes.lengths[doc]), "lang": own, "words": n, "cost": cost, "confidence": _sure(cost, own)}, top, _sure(whole, top)


def _passages(batches, samples):
    coder, plausible = Coder(samples), garble.Plausible(samples)
    langs = np.array(coder.langs)
    for batch in batches:
        ids, texts = batch.column("id"), batch.column("text").to_pylist()
        for a, b in slices(texts):
            plain, starts, stored = prepared(texts[a:b], plausible)
            s, _, _ = label(plain, coder, starts)
            lengths = np.array([len(t or "") for t in texts[a:b]])
            end = np.append(stored[1:], 0)
            last_of = np.append(s["doc"][1:] != s["doc"][:-1], True)
            end = np.where(last_of, lengths[s["doc"]], end)
            # neighbouring sentences of one language are one passage
            new = np.ones(len(s["doc"]), bool)
            new[1:] = (s["doc"][1:] != s["doc"][:-1]) | (s["lang"][1:] != s["lang"][:-1])
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(new)) - 1
            words = np.add.reduceat(s["words"], at)
            sure = _sure(np.add.reduceat(s["cost"], at, axis=0), s["lang"][at])
            keep = words > 0
            at, last, words, sure = at[keep], last[keep], words[keep], sure[keep]
            yield pa.record_batch({"id": ids.take(pa.array(s["doc"][at] + a)), "start": pa.array(stored[at]), "end": pa.array(end[last]), "lang": pa.array(langs[s["lang"][at]]), "words": pa.array(words), "confidence": pa.array(sure)})


def _shares(batches, samples, least: float = 0.0, cases: bool = False):
    """Rows of the languages of each text with at least a share of its words; for cases only those of texts whose label
    ``stated`` isn't the one such language."""
    coder, plausible = Coder(samples), garble.Plausible(samples)
    langs, k = np.array(coder.langs), len(coder.langs)
    for batch in batches:
        ids, texts = batch.column("id"), batch.column("text").to_pylist()
        stated = batch.column("stated").to_pylist() if cases else None
        for a, b in slices(texts):
            plain, starts, _ = prepared(texts[a:b], plausible)
            s, _, _ = label(plain, coder, starts)
            key = s["doc"] * k + s["lang"]
            words = np.bincount(key, s["words"], (b - a) * k).reshape(-1, k)
            share = words / np.maximum(words.sum(axis=1, keepdims=True), 1)
            d, i = np.nonzero((share > 0) & (share >= least))
            # a language's confidence is its coder's probability over the sentences that have it
            cost = np.stack([np.bincount(key, s["cost"][:, j], (b - a) * k) for j in range(k)], 1)
            sure = _sure(cost[d * k + i], i)
            if cases:
                single = np.bincount(d, minlength=b - a) == 1
                right = single[d] & np.array([stated[a + x] == langs[y] for x, y in zip(d.tolist(), i.tolist())], bool)
                d, i, sure = d[~right], i[~right], sure[~right]
            yield pa.record_batch({"id": ids.take(pa.array(d + a)), "lang": pa.array(langs[i]), "words": pa.array(words[d, i].astype(np.int64)), "share": pa.array(share[d, i]), "confidence": pa.array(sure)})


def fit_samples(samples: DataFrame, lang_column: str = "lang", text_column: str = "text") -> list[tuple[str, str]]:
    """Labelled passages for the trees; at most SAMPLE_ROWS rows, a documented bound of the fit."""
    rows = samples.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(lang_column, text_column)
    return [tuple(r) for r in rows.limit(SAMPLE_ROWS).collect()]


def _texts(df: DataFrame, id_column: str, text_column: str, *more) -> DataFrame:
    return df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).where(F.col("text").isNotNull())


SHARES = "id long, lang string, words long, share double, confidence double"


def language_shares(df: DataFrame, id_column: str, text_column: str, samples: DataFrame) -> DataFrame:
    """``id, lang, words, share, confidence`` of each document's languages; texts without known words give no row.

    confidence: the probability of the language, by code lengths, for the sentences that have it.
    """
    fit = fit_samples(samples)
    return _texts(df, id_column, text_column).mapInArrow(lambda b: _shares(b, fit), SHARES)


def language_cases(df: DataFrame, id_column: str, text_column: str, language_column: str, samples: DataFrame, least: float = SHARE) -> DataFrame:
    """The rows of ``language_shares`` with a share of ``least`` or more, of documents whose label names no language, or
    another one, or that have more than one such language. One map; nothing is shuffled."""
    fit = fit_samples(samples)
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"), stated_language(F.col(language_column).cast("string")).alias("stated"))
    return rows.where(F.col("text").isNotNull()).mapInArrow(lambda b: _shares(b, fit, least, True), SHARES)


def language_passages(df: DataFrame, id_column: str, text_column: str, samples: DataFrame) -> DataFrame:
    """``id, start, end, lang, words, confidence`` of runs of sentences in one language, in characters."""
    fit = fit_samples(samples)
    return _texts(df, id_column, text_column).mapInArrow(lambda b: _passages(b, fit), "id long, start long, end long, lang string, words long, confidence double")


def stated_language(column):
    """The code a label names, however spelled; null where it names none."""
    key = F.regexp_extract(F.lower(F.trim(column)), "^([a-z]+)", 1)
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(key.isin(names.split()), F.lit(code)).otherwise(out)
    return out


def p2_found(spark, sf_dir: str) -> DataFrame:
    cases = language_cases(table(spark, sf_dir, "speeches"), "speech_id", "text", "Language", table(spark, sf_dir, "lang_samples"))
    return cases.select(F.col("id").alias("speech_id"), "lang")


def p2_languages(spark, sf_dir: str) -> DataFrame:
    return language_shares(table(spark, sf_dir, "speeches"), "speech_id", "text", table(spark, sf_dir, "lang_samples")).withColumnRenamed("id", "speech_id")


def p2_passages(spark, sf_dir: str) -> DataFrame:
    return language_passages(table(spark, sf_dir, "speeches"), "speech_id", "text", table(spark, sf_dir, "lang_samples")).withColumnRenamed("id", "speech_id")
