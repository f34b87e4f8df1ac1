"""Noise in text from scanned pages (problem 4).

Words are counted over the whole corpus and skip-gram vectors (negative sampling) are learned from
it. A word that is rare next to a frequent word from which misreadings of glyphs lead to it is linked
to that word. Whether it is taken for a misreading where it stands is decided by the vectors: the frequent word must
fit the words around it, and the shorter the word the better, as short words are one edit from many. Of several
frequent words the one that fits best is meant. Words parted at line ends are joined, running heads and page
numbers removed, and the lines of a page reflowed into paragraphs.

Only frequent words are sent to the tasks, those with at least ``max(LEAST_COUNT, SHARE of all words)``
occurrences, so at most 1 / SHARE of them, whatever the corpus; and of rarer words those that are too frequent, next to a
word they could be a misreading of, to be one: one for each glyph edit of a frequent word at most.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table, written
from .textkit import U64, Codes, Words, mix, slices

LEAST_COUNT = 5
SHARE = 2e-6
#: A linked word is this much rarer than the word it stands for.
RATIO = 0.1
#: Fit to the words around, in standard deviations over chance, that a word of NEUTRAL letters needs; each letter more
#: lowers it by SLOPE.
NEUTRAL, SLOPE = 3, 0.75
#: In a text that shows another trace a misreading is likelier, and the fit may be so much less.
PRIOR = 2.0
NEIGHBOUR_COUNT = 20
DIM, NEGATIVES, BATCH, RATE, SUBSAMPLE = 24, 16, 4096, 0.3, 1e-5
#: Vectors are learned for words of this share of all words or more, at most 1 / VECTOR_SHARE.
VECTOR_SHARE = 2e-5
LEAST_WORDS, LEAST_HYPHENS, LEAST_FURNITURE = 2, 2, 1
# What is seen, and what may have stood on the page.
GLYPHS = (
    ("c", "e"), ("e", "c"), ("u", "a"), ("a", "u"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("0", "o"), ("5", "s"),
    ("1", "l"), ("1", "i"), ("9", "g"), ("6", "b"), ("6", "é"), ("8", "b"), ("ri", "n"), ("rn", "m"), ("m", "rn"), ("li", "h"),
    ("h", "li"), ("vv", "w"), ("d", "cl"), ("cl", "d"), ("0", "о"), ("3", "з"), ("6", "б"), ("8", "в"), ("н", "и"), ("и", "н"),
)
PAGE = re.compile(r"\W*(?:(?:page|p\.|pg\.|seite|s\.|página|pagina|pág\.|стр\.)\s*)\d{1,4}(?:\s*(?:of|/|de|von|di|из)\s*\d{1,4})?\W*|[-–—\[(]\s*\d{1,4}\s*[-–—\])]|\d{1,4}\s*/\s*\d{1,4}|\d{1,4}|[ivxl]{1,7}", re.I)
GAP = re.compile(r"\s{2,}")
SPLIT = re.compile(r"([^\W\d_][^\W_]*|[^\W_]+)-\n([^\W_]+)")
FOUND = "id long, hyphens int, misread int, furniture int"
STOPPED = re.compile(r"[.!?…:;][\"”»’)\]]*$")


def glyph_edits(word: str) -> set[str]:
    """Words that one misreading turns into ``word``."""
    out = set()
    for seen, meant in GLYPHS:
        at = word.find(seen)
        while at >= 0:
            out.add(word[:at] + meant + word[at + len(seen) :])
            at = word.find(seen, at + 1)
    out.discard(word)
    return out


class Lexicon:
    """Frequent words, and the links from words to those they may be misreadings of."""

    def __init__(self, words: list[str], counts: np.ndarray, vectors: dict | None = None, rare: dict | None = None):
        self.count = dict(zip(words, counts.tolist()))
        self.rare = rare or {}
        self.vectors = vectors or {}
        self.linked: dict[str, list[str]] = {}
        if self.vectors:
            # context vectors as they come by chance, for the fit
            share = np.array([self.count[w] for w in self.vectors], float)
            share /= share.sum()
            context = np.array([v[DIM:] for v in self.vectors.values()], float)
            self.mean = share @ context
            self.spread = ((context - self.mean) * share[:, None]).T @ (context - self.mean)

    def link(self, word: str) -> list[str]:
        """Frequent words that one misreading, or in longer words two, turn into ``word``; most frequent first."""
        if word in self.linked:
            return self.linked[word]
        out: list[str] = []
        own = self.count.get(word) or self.rare.get(word, 0)
        if len(word) >= 2 and not word.isdigit():
            ones = glyph_edits(word)
            fits = lambda w: self.count.get(w, 0) >= max(NEIGHBOUR_COUNT, own / RATIO)
            out = [w for w in ones if fits(w)]
            known = word in self.count
            if not out and len(word) >= 6 and not known:
                out = [w for x in ones for w in glyph_edits(x) if fits(w)]
            if not out and not known and any(c.isdigit() for c in word) and any(c.isalpha() for c in word):
                # a digit inside a word that is itself rare, as a name: the misreading is plain, the word isn't known
                plain = [x for x in ones if not any(c.isdigit() for c in x)]
                out = plain[:1] if word[0].isalpha() and word[-1].isalpha() else []
        out = sorted(set(out), key=lambda w: (-self.count.get(w, 0), w))
        self.linked[word] = out
        return out

    def fit(self, word: str, around: list) -> float | None:
        """How well a word goes with the context vectors around, in standard deviations over words met by chance; None
        if either is unknown."""
        v = self.vectors.get(word)
        if v is None or not around:
            return None
        own = v[:DIM].astype(float)
        return float((own @ np.mean(around, axis=0) - own @ self.mean) / max(1e-6, math.sqrt(own @ self.spread @ own / len(around))))


def _count_words(batches):
    seen: dict[int, list] = {}
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts):
            words = Words(Codes(texts[a:b]))
            h, first, n = np.unique(words.hash, return_index=True, return_counts=True)
            for key, i, k in zip(h.tolist(), first.tolist(), n.tolist()):
                if key in seen:
                    seen[key][1] += k
                else:
                    seen[key] = [words.word(i), k]
            if len(seen) > 1 << 18:
                yield _counted(seen)
                seen = {}
    yield _counted(seen)


def _counted(seen: dict) -> pa.RecordBatch:
    return pa.record_batch({"word": pa.array([v[0] for v in seen.values()], pa.string()), "n": pa.array([v[1] for v in seen.values()], pa.int64())})


def word_counts(df: DataFrame, text_column: str) -> DataFrame:
    """``word, n`` over all texts; combined in each task before the shuffle."""
    rows = df.select(F.col(text_column).cast("string").alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _too_frequent(words: list[str], counts: np.ndarray):
    def check(batches):
        count = dict(zip(words, counts.tolist()))
        for batch in batches:
            keep = [i for i, (w, n) in enumerate(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist())) if len(w) >= 2 and any(RATIO * count.get(x, 0) < n for x in glyph_edits(w) if x in count)]
            yield batch.take(pa.array(keep, pa.int64()))

    return check


def frequent_words(df: DataFrame, text_column: str) -> tuple[list[str], np.ndarray, int, dict]:
    """(words, counts, all words, counts of rarer words too frequent to be misreadings of some frequent word).

    The frequent words are at most 1 / SHARE by their definition; the others are glyph edits of them.
    """
    counts = written(word_counts(df, text_column), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_COUNT, SHARE * total)
    got = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").toPandas()
    words, n = got["word"].tolist(), got["n"].to_numpy(np.int64)
    rare = counts.where((F.col("n") < least) & (F.col("n") > RATIO * least)).mapInArrow(_too_frequent(words, n), "word string, n long").toPandas()
    return words, n, int(total), dict(zip(rare["word"].tolist(), rare["n"].tolist()))


def _hash_of(words: list[str]) -> np.ndarray:
    w = Words(Codes(words))
    return w.hash[w.first[:-1]]


def _start(hashes: np.ndarray) -> np.ndarray:
    """First vectors, the same in every task, so those learned apart can be averaged."""
    grid = mix(hashes[:, None] + np.arange(1, DIM + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return ((grid >> U64(11)).astype(np.float64) / 2**53 - 0.5).astype(np.float32) / DIM**0.5


def _sum_rows(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(ids, rows[:, d], n) for d in range(rows.shape[1])], 1).astype(np.float32)


def _trainer(words: list[str], counts: np.ndarray, total: int):
    def train(batches):
        hashes = _hash_of(words)
        order = np.argsort(hashes)
        known = hashes[order]
        enter, leave = _start(hashes), _start(mix(hashes))
        rng = np.random.default_rng(7)
        keep = np.minimum(1, np.sqrt(SUBSAMPLE * total / np.maximum(counts, 1)))
        noise = counts**0.75 / (counts**0.75).sum()
        seen = np.zeros(len(words))
        centres, around = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def learn(c, o):
            negative = rng.choice(len(words), NEGATIVES, p=noise)
            x, y, z = enter[c], leave[o], leave[negative]
            good = 1 / (1 + np.exp(-(x * y).sum(1))) - 1
            bad = 1 / (1 + np.exp(-(x @ z.T))) * (5 / NEGATIVES)
            seen_c, seen_o = np.bincount(c, minlength=len(words)), np.bincount(o, minlength=len(words))
            enter[:] -= RATE * _sum_rows(c, good[:, None] * y + bad @ z, len(words)) / np.maximum(seen_c, 1)[:, None]
            leave[:] -= RATE * _sum_rows(o, good[:, None] * x, len(words)) / np.maximum(seen_o, 1)[:, None]
            leave[negative] -= RATE * (bad.T @ x) / len(c)

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                w = Words(Codes(texts[a:b]))
                at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
                ids = np.where(known[at] == w.hash, order[at], -1)
                held = np.flatnonzero((ids >= 0) & (rng.random(len(ids)) < keep[ids]))
                ids, doc = ids[held], w.doc[held]
                if len(ids) < 2:
                    continue
                np.add.at(seen, ids, 1)
                for step in (1, 2):
                    same = np.flatnonzero(doc[step:] == doc[:-step])
                    centres = np.concatenate([centres, ids[same], ids[same + step]])
                    around = np.concatenate([around, ids[same + step], ids[same]])
                if len(centres) >= BATCH:
                    mixed = rng.permutation(len(centres))
                    centres, around = centres[mixed], around[mixed]
                    cut = len(centres) // BATCH * BATCH
                    for s in range(0, cut, BATCH):
                        learn(centres[s : s + BATCH], around[s : s + BATCH])
                    centres, around = centres[cut:], around[cut:]
        if len(centres):
            learn(centres, around)
        some = np.flatnonzero(seen)
        yield pa.record_batch({"word": pa.array(some, pa.int64()), "seen": pa.array(seen[some]), "vector": pa.array([(enter[i] * seen[i]).tolist() + (leave[i] * seen[i]).tolist() for i in some], pa.list_(pa.float32()))})

    return train


def skip_gram(df: DataFrame, text_column: str, words: list[str], counts: np.ndarray, total: int) -> dict[str, np.ndarray]:
    """Word -> (own vector, context vector), learned in every task from common starts and averaged by
    how often the word was seen. Words are subsampled as skip-gram has it, over all texts."""
    some = np.flatnonzero(counts >= VECTOR_SHARE * total)
    if not len(some):
        return {}
    rows = df.select(F.col(text_column).cast("string").alias("text")).where(F.col("text").isNotNull())
    parts = rows.mapInArrow(_trainer([words[i] for i in some], counts[some], total), "word long, seen double, vector array<float>")
    sums = [F.sum(F.col("vector")[i]).alias(f"v{i}") for i in range(2 * DIM)]
    got = parts.groupBy("word").agg(F.sum("seen").alias("seen"), *sums).toPandas()
    vectors = got[[f"v{i}" for i in range(2 * DIM)]].to_numpy() / got["seen"].to_numpy()[:, None]
    return {words[some[w]]: v.astype(np.float32) for w, v in zip(got["word"].tolist(), vectors)}


class Reader:
    """Finds and repairs the traces of scanned pages in texts."""

    def __init__(self, lexicon: Lexicon):
        self.lex = lexicon
        self.suspect: dict[int, bool] = {}

    def suspects(self, words: Words) -> np.ndarray:
        """Words with a link; each distinct word is looked at once in a task."""
        seen, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        hit = np.zeros(len(seen), bool)
        for i, (h, f) in enumerate(zip(seen.tolist(), first.tolist())):
            known = self.suspect.get(h)
            if known is None:
                if len(self.suspect) > 1 << 20:
                    self.suspect.clear()
                    self.lex.linked.clear()
                known = self.suspect[h] = bool(self.lex.link(words.word(f)))
            hit[i] = known
        return np.flatnonzero(hit[back])

    def meant(self, words: Words, i: int) -> tuple[str, float]:
        """(word meant at i, by how much it fits the words around better than it must). Without vectors for them the
        glyphs decide: the most frequent word, by 0."""
        word = words.word(i)
        options = self.lex.link(word)
        lo, hi = max(int(words.first[words.doc[i]]), i - 3), min(int(words.first[words.doc[i] + 1]), i + 4)
        around = [v[DIM:] for j in range(lo, hi) if j != i and (v := self.lex.vectors.get(words.word(j))) is not None]
        fits = {w: self.lex.fit(w, around) for w in options}
        best = max(options, key=lambda w: (round(fits[w] or 0.0, 3), self.lex.count.get(w, 0)))
        return best, 0.0 if fits[best] is None else fits[best] - SLOPE * (NEUTRAL - len(word))

    def parted(self, a: str, b: str) -> bool:
        """Whether a hyphen at a line end parts one word, other than in a compound."""
        count = self.lex.count
        whole = (a + b).lower()
        if count.get(whole, 0) or self.lex.link(whole):
            return True
        return not (count.get(a.lower(), 0) >= NEIGHBOUR_COUNT and count.get(b.lower(), 0) >= NEIGHBOUR_COUNT)

    def measure(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
        """(hyphens, misread words, furniture lines) of each text, and its corrections {text: [(start, end, word)]}."""
        n = len(texts)
        codes = Codes(texts)
        words = Words(codes)
        hyphens, misread, furniture = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        cp = codes.cp
        ends = np.flatnonzero((cp[:-1] == 45) & (cp[1:] == 10))
        broken = np.unique(np.searchsorted(codes.starts, ends, "right") - 1)
        halves = set()
        for d in broken.tolist():
            halves.update(int(codes.starts[d]) + m.start(i) for m in SPLIT.finditer(texts[d]) for i in (1, 2))
            hyphens[d] = sum(self.parted(m[1], m[2]) for m in SPLIT.finditer(without_furniture(texts[d])))
        fixes: dict[int, list] = {}
        doubtful = []
        for i in self.suspects(words).tolist():
            if int(words.start[i]) in halves:
                continue
            d, (to, margin) = int(words.doc[i]), self.meant(words, i)
            place = (int(words.start[i] - codes.starts[d]), int(words.end[i] - codes.starts[d]), to)
            if margin >= 0:
                misread[d] += 1
                fixes.setdefault(d, []).append(place)
            elif margin >= -PRIOR:
                doubtful.append((d, place))
        traced = (misread > 0) | (hyphens >= LEAST_HYPHENS)
        for d, place in doubtful:
            if traced[d]:
                misread[d] += 1
                fixes.setdefault(d, []).append(place)
        for d in np.flatnonzero((hyphens >= LEAST_HYPHENS) | (misread >= LEAST_WORDS)).tolist():
            for m in SPLIT.finditer(without_furniture(texts[d])):
                whole = (m[1] + m[2]).lower()
                if not self.lex.count.get(whole) and self.lex.link(whole):
                    misread[d] += 1
            furniture[d] = len(furniture_lines(texts[d].split("\n")))
        return hyphens, misread, furniture, fixes

    def repair(self, text: str, fixes: list) -> str:
        """Corrected words, without furniture, hyphens joined, reflowed."""
        out, at = [], 0
        for a, b, word in sorted(fixes):
            seen = text[a:b]
            out += [text[at:a], word.upper() if seen.isupper() and len(seen) > 1 else word[:1].upper() + word[1:] if seen[:1].isupper() or (seen[:1].isdigit() and seen[1:2].isupper()) else word]
            at = b
        text = "".join(out) + text[at:]
        def joined(m: re.Match) -> str:
            if not self.parted(m[1], m[2]):
                return f"{m[1]}-{m[2]}"
            whole = m[1] + m[2]
            if not self.lex.count.get(whole.lower()) and (options := self.lex.link(whole.lower())):
                whole = options[0][:1].upper() + options[0][1:] if whole[0].isupper() else options[0]
            return whole

        return reflow(SPLIT.sub(joined, without_furniture(text)))


def furniture_lines(lines: list[str]) -> set[int]:
    """Page numbers, alone or set off in a line with a running head, and running heads: short lines that
    come again and break into a sentence or stand beside a page number or a page break."""
    out, heads = set(), {}
    for i, line in enumerate(lines):
        t = line.replace("\f", "").strip()
        if not t:
            if "\f" in line:
                out.add(i)
        elif len(t) <= 100:
            parts = GAP.split(t)
            if PAGE.fullmatch(t) or (len(parts) > 1 and (PAGE.fullmatch(parts[-1]) or PAGE.fullmatch(parts[0]))):
                out.add(i)
            elif len(t) < 60 and not STOPPED.search(t):
                heads.setdefault(t.lower(), []).append(i)
    for at in heads.values():
        if len(at) > 1 and any({i - 1, i + 1} & out or (i and lines[i - 1].strip() and not STOPPED.search(lines[i - 1].strip())) for i in at):
            out.update(at)
    return out


def without_furniture(text: str) -> str:
    lines = text.split("\n")
    gone = furniture_lines(lines)
    return "\n".join(x.replace("\f", "") for i, x in enumerate(lines) if i not in gone)


def reflow(text: str) -> str:
    """Lines of one paragraph joined by spaces; empty lines and lines that end a sentence well short of the
    page's width part paragraphs."""
    lines = text.split("\n")
    width = max((len(x) for x in lines), default=0)
    out, current = [], []
    for line in lines:
        t = line.strip()
        if t:
            current.append(t)
        if current and (not t or (STOPPED.search(t) and len(t) < 0.75 * width)):
            out.append(" ".join(current))
            current = []
    if current:
        out.append(" ".join(current))
    return "\n\n".join(out)


def _mapper(words, counts, vectors, rare, restored: bool):
    def run(batches):
        reader = Reader(Lexicon(words, counts, vectors, rare))
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            for a, b in slices(texts):
                h, m, f, fixes = reader.measure(texts[a:b])
                traces = (h >= LEAST_HYPHENS).astype(int) + (m >= LEAST_WORDS) + (f >= LEAST_FURNITURE)
                at = np.flatnonzero(traces >= 2)
                if len(at):
                    cols = {"id": pa.array([ids[a + i] for i in at], pa.int64()), "hyphens": pa.array(h[at]), "misread": pa.array(m[at]), "furniture": pa.array(f[at])}
                    yield pa.record_batch(cols | ({"repaired": pa.array([reader.repair(texts[a + i], fixes.get(i, [])) for i in at.tolist()])} if restored else {}))

    return run


def scanned(df: DataFrame, id_column: str, text_column: str, restored: bool = False) -> DataFrame:
    """``id, hyphens, misread, furniture[, repaired]`` of texts with at least two traces of scanned pages.

    Three scans: word counts, vectors, and the texts themselves. Null texts give nothing.
    """
    words, counts, total, rare = frequent_words(df, text_column)
    vectors = skip_gram(df, text_column, words, counts, total)
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(_mapper(words, counts, vectors, rare, restored), FOUND + ", repaired string" * restored)


def p4_found(spark, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "speeches"), "speech_id", "text").select(F.col("id").alias("speech_id"))


def p4_repaired(spark, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "speeches"), "speech_id", "text", restored=True).withColumnRenamed("id", "speech_id")
