"""Token counts: a public tokenizer, and token budgets estimated from cheap features (problem 3).

For each language a linear regression predicts a text's tokens from its bytes, words, digits,
punctuation and letters by script. It is fitted on a bounded tokenized sample, applied to every text,
and its bias corrected by the ratio of true to predicted tokens in a tokenized holdout.
"""

from __future__ import annotations

import base64
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import stated_language
from .lookalike import CYRILLIC, LATIN, script
from .shared import table
from .textkit import LAST, Codes, alnum, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Public pattern of byte-level BPE tokenizers.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows tokenized for the fit, and as many again for the holdout; a bound of the fit, whatever the input.
SAMPLE_ROWS = 3000
FIT_TASKS = 32
LEAST_LANGUAGE_ROWS = 40
FEATURES = ("bytes", "words", "digits", "punctuation", "spaces", "upper", "latin", "latin_wide", "cyrillic", "other")


def vocabulary(path: str = VOCABULARY) -> bytes:
    """The file's bytes, read on the driver and sent to the tasks; a vocabulary's size is fixed."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(2)
def encoder(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list, data: bytes) -> np.ndarray:
    e = encoder(data)
    return np.fromiter((len(e.encode_ordinary(t)) if t else 0 for t in texts), np.int64, len(texts))


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Feature of each code point: 2 digit, 3 punctuation, 4 space, 5 upper case, 6.. letters by script."""
    out = np.full(LAST, 3, np.uint8)
    letters = script()
    out[letters > 0] = 9
    out[letters == CYRILLIC] = 8
    out[letters == LATIN] = 7
    out[97:123] = 6
    for c in np.flatnonzero(alnum() & (letters == 0)).tolist():
        out[c] = 2
    for c in range(0x3001):
        if chr(c).isspace():
            out[c] = 4
        elif letters[c] and chr(c).isupper():
            out[c] = 5
    return out


def features(texts: list) -> np.ndarray:
    """(text, FEATURES) counts, by array operations."""
    codes = Codes(texts)
    cp = codes.cp
    kinds = _kinds()[cp].astype(np.int64)
    ends = codes.starts[1:] - 1
    inside = np.ones(len(cp), bool)
    inside[ends] = False
    doc = codes.doc_of(np.arange(len(cp)))
    table = np.bincount(doc[inside] * 10 + kinds[inside], minlength=codes.n * 10).reshape(-1, 10).astype(float)
    width = 1 + (cp > 0x7F) + (cp > 0x7FF).astype(np.int64) + (cp > 0xFFFF)
    table[:, 0] = np.bincount(doc[inside], width[inside], codes.n)
    word = alnum()[cp] & inside
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    table[:, 1] = np.bincount(doc[begins], minlength=codes.n)
    return table


class Model:
    """Coefficients and bias ratio of each language; languages with few rows use those of all."""

    def __init__(self, langs: list, x: np.ndarray, tokens: np.ndarray, held: np.ndarray):
        self.by: dict = {}
        langs = np.array([lang or "" for lang in langs])
        for lang in ["*", *sorted(set(langs))]:
            own = np.ones(len(x), bool) if lang == "*" else langs == lang
            fit, hold = own & ~held, own & held
            if min(fit.sum(), hold.sum()) < (1 if lang == "*" else LEAST_LANGUAGE_ROWS):
                continue
            ridge = np.eye(x.shape[1]) * 1e-3 * max(1.0, float((x[fit] ** 2).mean()))
            beta = np.linalg.solve(x[fit].T @ x[fit] + ridge, x[fit].T @ tokens[fit])
            guess = np.maximum(x[hold] @ beta, 0).sum()
            self.by[lang] = (beta, float(tokens[hold].sum() / guess) if guess else 1.0)

    def predict(self, langs: list, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        keys = np.array([lang if lang in self.by else "*" for lang in langs], object)
        for lang in set(keys.tolist()):
            beta, ratio = self.by.get(lang, (np.zeros(x.shape[1]), 1.0))
            at = keys == lang
            out[at] = np.maximum(x[at] @ beta, 0) * ratio
        out[x[:, 0] == 0] = 0
        return out


def _sampled(batches, data):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts):
            x = features(texts[a:b])
            yield pa.record_batch({"lang": batch.column("lang").slice(a, b - a), "held": batch.column("held").slice(a, b - a), "x": pa.array(x.tolist(), pa.list_(pa.float64())), "tokens": pa.array(count_tokens(texts[a:b], data))})


def fit(rows: DataFrame, data: bytes) -> Model:
    """rows: ``id, text, lang``. The sample is every distinct row whose hash is 0 (fit) or 1 (holdout)
    modulo a number by which there are about SAMPLE_ROWS of each; it is tokenized in FIT_TASKS tasks."""
    total = rows.count()
    every = max(1, total // (2 * SAMPLE_ROWS))
    tagged = rows.withColumn("h", F.xxhash64("id", "text"))
    place = F.pmod("h", F.lit(2 * every))
    # copies of one row are one, so a third of all rows being copies doesn't swell the sample
    sample = tagged.where(place < 2).dropDuplicates(["h"]).withColumn("held", place == 1).repartition(FIT_TASKS, "h")
    got = sample.select("text", "lang", "held").mapInArrow(partial(_sampled, data=data), "lang string, held boolean, x array<double>, tokens long").toPandas()
    if not len(got):
        return Model([], np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(0, bool))
    return Model(got["lang"].tolist(), np.array(got["x"].tolist()), got["tokens"].to_numpy(float), got["held"].to_numpy(bool))


def _predicted(batches, model: Model):
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for a, b in slices(texts):
            tokens = model.predict(langs[a:b], features(texts[a:b]))
            yield pa.record_batch({"id": batch.column("id").slice(a, b - a), "tokens": pa.array(tokens)})


def estimated_tokens(df: DataFrame, id_column: str, text_column: str, language_column: str, path: str = VOCABULARY) -> DataFrame:
    """``id, tokens`` (double) of every row; null and empty texts have 0."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"), stated_language(F.col(language_column)).alias("lang"))
    model = fit(rows.where(F.col("id").isNotNull() & F.col("text").isNotNull()), vocabulary(path))
    return rows.mapInArrow(partial(_predicted, model=model), "id long, tokens double")


def token_budget(df: DataFrame, id_column: str, text_column: str, language_column: str, bank_column: str, source_column: str, url_column: str, path: str = VOCABULARY) -> DataFrame:
    """``dimension, value, speeches, tokens``: estimated totals by bank, language, source and host.

    One pass over the texts; the few columns of each row then go through grouping sets, combined before
    the shuffle. Null values are a group of their own, value null.
    """
    rows = df.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"), stated_language(F.col(language_column)).alias("lang"),
        F.col(bank_column).cast("string").alias("bank"), F.col(source_column).cast("string").alias("source"),
        F.nullif(F.regexp_extract(F.col(url_column).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1), F.lit("")).alias("host"),
    )
    model = fit(rows.select("id", "text", "lang").where(F.col("id").isNotNull() & F.col("text").isNotNull()), vocabulary(path))
    counted = rows.mapInArrow(partial(_with_groups, model=model), "lang string, bank string, source string, host string, tokens double")
    names = ("bank", "lang", "source", "host")
    sets = counted.groupingSets([[n] for n in names], *names).agg(F.count(F.lit(1)).alias("speeches"), F.sum("tokens").alias("tokens"), *[F.grouping(n).alias(f"g_{n}") for n in names])
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n in names:
        which = F.when(F.col(f"g_{n}") == 0, F.lit(n)).otherwise(which)
        value = F.when(F.col(f"g_{n}") == 0, F.col(n)).otherwise(value)
    return sets.select(which.alias("dimension"), value.alias("value"), "speeches", F.round("tokens").cast("long").alias("tokens"))


def _with_groups(batches, model: Model):
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for a, b in slices(texts):
            tokens = model.predict(langs[a:b], features(texts[a:b]))
            yield pa.record_batch({n: batch.column(n).slice(a, b - a) for n in ("lang", "bank", "source", "host")} | {"tokens": pa.array(tokens)})


def _tokenized(batches, data):
    for batch in batches:
        yield pa.record_batch({"id": batch.column("id"), "tokens": pa.array(count_tokens(batch.column("text").to_pylist(), data))})


def exact_tokens(df: DataFrame, id_column: str, text_column: str, path: str = VOCABULARY) -> DataFrame:
    """``id, tokens`` by the tokenizer itself; null and empty texts have 0."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(partial(_tokenized, data=vocabulary(path)), "id long, tokens long")


def p3_tokens(spark, sf_dir: str) -> DataFrame:
    return estimated_tokens(table(spark, sf_dir, "speeches"), "speech_id", "text", "Language").withColumnRenamed("id", "speech_id")


def p3_totals(spark, sf_dir: str) -> DataFrame:
    return token_budget(table(spark, sf_dir, "speeches"), "speech_id", "text", "Language", "CentralBank", "Source", "URL")


def p3_slices(spark, sf_dir: str) -> DataFrame:
    """Speeches of each slice of the budget."""
    return p3_totals(spark, sf_dir).select("dimension", "value", "speeches")
