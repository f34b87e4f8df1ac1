"""Repetition inside a single document, with risk-controlled cutoffs (problem 10).

Five shares are measured for each document: words in runs of eight words that began before, which is the
definition of a case and so the label; and, to be cut, words in repeated phrases of five words and in sentences, lines
and paragraphs that stood before. For each of the latter four and each stratum of length a cutoff is
chosen on all labelled documents: cutoffs are tested from the strictest down, in fixed sequence, and the
lowest is kept for which an exact binomial (Clopper-Pearson) upper bound on the share of good documents
it rejects stays at or below ``alpha``; the error budget is divided over shares and strata
(Bonferroni), so all kept cutoffs hold together with probability 1 - ``delta``. A run of eight words holds phrases
of five, so a phrase cutoff of at most the case's share loses no case: it is lowered to that, certified or not, and
rejected documents are cases if their label says so.
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

RUN, PHRASE = 8, 5
CASE = 0.3
SHARES = ("phrase_share", "sentence_share", "line_share", "paragraph_share")
#: Strictest first.
GRID = tuple(i / 20 for i in range(20, 0, -1))
STRATA = (60, 250, 1000)
MEASURED = "id long, words long, run_share double, phrase_share double, sentence_share double, line_share double, paragraph_share double"
UNITS = {"sentence_share": re.compile(r"[^.!?\n]+"), "line_share": re.compile(r"[^\n]+"), "paragraph_share": re.compile(r"(?:[^\n]|\n(?!\s*\n))+")}


def run_shares(texts: list, *runs: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(words, for each length of run the words inside a run that also began earlier in the text) of each text."""
    words = Words(Codes(texts))
    out = []
    for run in runs or (RUN,):
        at, h = words.windows(run)
        covered = np.zeros(len(words) + 1, np.int64)
        key = mix(h + words.doc[at].astype(U64) * U64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        np.add.at(covered, at[again], 1)
        np.add.at(covered, at[again] + run, -1)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
        out.append(inside[words.first[1:]] - inside[words.first[:-1]])
    return np.diff(words.first), out


def unit_shares(text: str) -> list[float]:
    out = []
    for unit in UNITS.values():
        seen, total, again = set(), 0, 0
        for part in unit.findall(text):
            key = " ".join(part.split()).lower()
            if not key:
                continue
            n = key.count(" ") + 1
            total += n
            if key in seen:
                again += n
            seen.add(key)
        out.append(again / total if total else 0.0)
    return out


def _measure(batches):
    for batch in batches:
        ids, texts = batch.column("id"), batch.column("text").to_pylist()
        for a, b in slices(texts):
            n, (runs, phrases) = run_shares(texts[a:b], RUN, PHRASE)
            units = np.array([unit_shares(t or "") for t in texts[a:b]]).reshape(-1, 3)
            cols = {"id": ids.slice(a, b - a), "words": pa.array(n), "run_share": pa.array(runs / np.maximum(n, 1)), "phrase_share": pa.array(phrases / np.maximum(n, 1))}
            yield pa.record_batch(cols | {s: pa.array(units[:, i]) for i, s in enumerate(UNITS)})


def repetition(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row a document: ``id, words`` and the five shares, 0 for null, empty or short texts. A narrow map over whole texts."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(_measure, MEASURED)


def stratum(words):
    out = F.lit(0)
    for s in STRATA:
        out = out + (words >= s).cast("int")
    return out


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact binomial upper confidence bound for k events in n trials."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    for _ in range(60):
        p = (low + high) / 2
        tail = sum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(logs))
        low, high = (p, high) if tail > delta else (low, p)
    return high


def certified(k: int, n: int, alpha: float, delta: float) -> bool:
    """Whether ``upper_bound`` is at most ``alpha``; summed from k down until the terms vanish, so large counts take no longer."""
    if k >= n * alpha:
        return False
    term, total = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(alpha) + (n - k) * math.log1p(-alpha)), 0.0
    while k >= 0 and term > total * 1e-17:
        total += term
        term *= k / (n - k + 1) * (1 - alpha) / alpha
        k -= 1
    return total <= delta


def cutoffs(counts: dict, alpha: float, delta: float, strata: int = len(STRATA) + 1) -> dict:
    """(share, stratum) -> lowest certified cutoff. counts: (share, stratum) -> (good documents, of these at or above each
    cutoff of GRID). A stratum whose strictest cutoff can't be certified, as with too few good documents, has None."""
    each, out = delta / (len(SHARES) * strata), {}
    for s in SHARES:
        for t in range(strata):
            good, above = counts.get((s, t), (0, [0] * len(GRID)))
            kept = None
            for cut, k in zip(GRID, above):
                if not certified(int(k), int(good), alpha, each):
                    break
                kept = cut
            out[s, t] = kept
    return out


def flagged(df: DataFrame, id_column: str, text_column: str, alpha: float = 0.02, delta: float = 0.05, case: float = CASE) -> tuple[DataFrame, DataFrame]:
    """(shares of each document with ``stratum`` and ``rejected_by``, table of cutoffs ``share, stratum, cutoff, certified,
    good, rejected``).

    A document is good if less than ``case`` of its words lie in repeated runs. All documents are
    labelled and measured once; only counts by stratum, share and cutoff, a fixed number, come to the driver.
    """
    measured = written(repetition(df, id_column, text_column), "shares").withColumn("stratum", stratum(F.col("words")))
    held = measured.where((F.col("run_share") < case) & (F.col("words") > 0))
    sums = [F.sum((F.col(s) >= c).cast("long")).alias(f"{s}_{i}") for s in SHARES for i, c in enumerate(GRID)]
    rows = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("good"), *sums).collect()
    counts = {(s, r["stratum"]): (r["good"], [r[f"{s}_{i}"] for i in range(len(GRID))]) for r in rows for s in SHARES}
    found = cutoffs(counts, alpha, delta)
    used = {(s, t): min(c if c is not None else case, case) if s == "phrase_share" else c for (s, t), c in found.items()}
    table_rows = []
    for (s, t), c in sorted(used.items()):
        good, above = counts.get((s, t), (0, [0] * len(GRID)))
        at = min(range(len(GRID)), key=lambda i: abs(GRID[i] - c)) if c is not None else None
        table_rows.append((s, t, c, c is not None and c == found[s, t], good, None if at is None else int(above[at])))
    cuts = df.sparkSession.createDataFrame(table_rows, "share string, stratum int, cutoff double, certified boolean, good long, rejected long")

    def rejects(s: str):
        at = F.lit(None).cast("double")
        for t in range(len(STRATA) + 1):
            if used[s, t] is not None:
                at = F.when(F.col("stratum") == t, F.lit(used[s, t])).otherwise(at)
        return F.when((F.col(s) >= at) & (F.col("words") > 0), F.lit(s))

    return measured.withColumn("rejected_by", F.array_compact(F.array(*[rejects(s) for s in SHARES]))), cuts


def p10_found(spark, sf_dir: str) -> DataFrame:
    docs, _ = flagged(table(spark, sf_dir, "documents"), "doc_id", "text")
    return docs.where((F.size("rejected_by") > 0) & (F.col("run_share") >= CASE)).select(F.col("id").alias("doc_id"))


def p10_shares(spark, sf_dir: str) -> DataFrame:
    docs, _ = flagged(table(spark, sf_dir, "documents"), "doc_id", "text")
    return docs.select(F.col("id").alias("doc_id"), "words", "run_share", *SHARES, "stratum", F.array_join("rejected_by", ",").alias("rejected_by"))


def p10_cutoffs(spark, sf_dir: str) -> DataFrame:
    return flagged(table(spark, sf_dir, "documents"), "doc_id", "text")[1]
