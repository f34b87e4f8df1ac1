"""Dictionary scores of documents.

The wide scorer is one narrow pass over the text for all dictionaries and methods: tokens that are terms
of any dictionary are kept first, and the counts, word maps and scores are made from that short list.
Nothing is shuffled and no join is made. It takes lexicons of up to ``MOST_TERMS`` terms as literals;
with larger ones tokens meet the lexicon in an equi-join, and the counts come back to the documents by their id.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ScoreError
from ..functions.stopwords import stop_words
from ..functions.text import word_tokens

MOST_TERMS = 50_000
METHODS = ("posneg", "allwords")
log = logging.getLogger(__name__)


def lexicon_rows(lexicon: DataFrame) -> list | None:
    """Terms on the driver; None if there are more than MOST_TERMS."""
    rows = lexicon.select("dictionary", "polarity", "term", "pos").limit(MOST_TERMS + 1).collect()
    return None if len(rows) > MOST_TERMS else rows


def _lists(rows: Iterable, dictionary: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {"positive": [], "negative": [], "neutral": []}
    for r in sorted((r for r in rows if r["dictionary"] == dictionary), key=lambda r: r["pos"]):
        out.setdefault(r["polarity"], []).append(r["term"])
    return out


def _in(t: Column, terms: list[str]) -> Column:
    return t.isin(*terms) if terms else F.lit(False)


def _among(tokens: str, terms: list[str]) -> Column:
    return F.filter(tokens, lambda t: _in(t, terms))


def posneg(p: Column, n: Column) -> Column:
    """1 + (P - N) / (P + N), and 1 without hits."""
    return F.when(p + n > 0, 1 + (p - n).cast("double") / (p + n)).otherwise(F.lit(1.0))


def allwords(p: Column, n: Column, total: Column) -> Column:
    """1 + (P - N) / T, and 1 without words."""
    return F.when(total > 0, 1 + (p - n).cast("double") / total).otherwise(F.lit(1.0))


def total_words(text: Column) -> Column:
    """Words of a raw text that aren't stop words."""
    return F.size(F.filter(word_tokens(text), lambda t: ~t.isin(*stop_words()))).cast("long")


def word_map(hits: Column, terms: list[str]) -> Column:
    """{term: count} of the hits, in the dictionary's order; empty without hits. Only words that are there are looked at."""
    if not terms:
        return F.create_map().cast("map<string,bigint>")
    order = F.array(*[F.lit(x) for x in terms])
    entry = lambda t: F.struct(F.array_position(order, t).alias("pos"), t.alias("term"), F.size(F.filter(hits, lambda h: h == t)).cast("long").alias("n"))
    there = F.array_sort(F.transform(F.array_distinct(hits), entry))
    return F.map_from_arrays(F.transform(there, lambda x: x["term"]), F.transform(there, lambda x: x["n"]))


#: Score of a method from positive hits, negative hits and words; more are added by ``add_method``.
FORMULAS: dict[str, Callable[[Column, Column, Column], Column]] = {"posneg": lambda p, n, total: posneg(p, n), "allwords": allwords}
#: Methods that also give the number of words.
WITH_TOTAL = {"allwords"}


def add_method(name: str, formula: Callable[[Column, Column, Column], Column], total: bool = False) -> None:
    """Makes ``formula(positive, negative, words)`` known to ``score`` as a method; total: it divides by the words."""
    FORMULAS[name] = formula
    (WITH_TOTAL.add if total else WITH_TOTAL.discard)(name)


def _from_literals(df: DataFrame, lists: dict, text_column: str, maps: bool) -> DataFrame:
    """``df`` with ``__d_polarity`` counts and ``__d_polarity_map`` for each dictionary d, in one narrow pass."""
    wanted = sorted({t for x in lists.values() for p in ("positive", "negative") for t in x[p]})
    tagged = df.withColumn("__hits", F.filter(word_tokens(F.col(text_column)), lambda t: _in(t, wanted)))
    hits = {f"__{d}_{p}_hits": _among("__hits", x[p]) for d, x in lists.items() for p in ("positive", "negative")}
    tagged = tagged.withColumns(hits) if hits else tagged
    parts = {}
    for d, x in lists.items():
        for p in ("positive", "negative"):
            own = f"__{d}_{p}_hits"
            parts[f"__{d}_{p}"] = F.greatest(F.size(own).cast("long"), F.lit(0).cast("long"))
            if maps:
                parts[f"__{d}_{p}_map"] = word_map(F.col(own), x[p])
    return tagged.withColumns(parts) if parts else tagged


def _from_join(df: DataFrame, lexicon: DataFrame, dictionaries: list[str], text_column: str, maps: bool, id_column: str | None) -> DataFrame:
    """The same by the long form: counts of a document come back to it by its id, which must be unique."""
    if id_column is None:
        raise ScoreError(f"lexicons of more than {MOST_TERMS} terms need id_column, a unique id of the rows")
    hits = term_hits(df, lexicon.where(F.col("dictionary").isin(dictionaries)), id_column, text_column)
    aggs = []
    for d in dictionaries:
        for p in ("positive", "negative"):
            own = (F.col("dictionary") == d) & (F.col("polarity") == p)
            aggs.append(F.sum(F.when(own, F.col("n"))).alias(f"__{d}_{p}"))
            if maps:
                aggs.append(F.array_sort(F.collect_list(F.when(own, F.struct("pos", "term", "n")))).alias(f"__{d}_{p}_list"))
    sums = hits.groupBy(F.col(id_column).alias("__id")).agg(*aggs)
    out = df.join(sums, F.col(id_column) == F.col("__id"), "left")
    parts = {}
    for d in dictionaries:
        for p in ("positive", "negative"):
            parts[f"__{d}_{p}"] = F.coalesce(f"__{d}_{p}", F.lit(0)).cast("long")
            if maps:
                x = F.col(f"__{d}_{p}_list")
                parts[f"__{d}_{p}_map"] = F.map_from_arrays(F.transform(x, lambda e: e["term"]), F.transform(x, lambda e: e["n"]))
    return out.withColumns(parts)


def score(df: DataFrame, lexicon: DataFrame, dictionaries: Iterable[str], methods: Iterable[str] = METHODS, text_column: str = "text", raw_column: str = "text", suffix: str = "", maps: bool = True, id_column: str | None = None) -> DataFrame:
    """``df`` with, for each dictionary d and method m: ``d_counttoken_positive_m``, ``d_counttoken_negative_m``,
    ``d_words_positive_m``, ``d_words_negative_m``, for allwords ``d_counttoken_total_allwords``, and
    ``d_sentiment_m``, each with the suffix.

    text_column is scored; allwords divides by the words of raw_column, whatever is scored. Rows with null
    raw text get null in every new column, blank ones score 1. An unknown method gives counts without a
    score, and a warning; an unknown dictionary is a KeyError. Columns of df that bear a new name are an error.
    id_column: a unique id, for lexicons of more than MOST_TERMS terms.
    """
    for c in (text_column, raw_column):
        if c not in df.columns:
            raise ValueError(f"Text column '{c}' isn't in the data")
    rows, dictionaries, methods = lexicon_rows(lexicon), list(dictionaries), list(methods)
    known = {r["dictionary"] for r in (rows if rows is not None else lexicon.where(F.col("dictionary").isin(dictionaries)).select("dictionary").distinct().collect())}
    if missing := [d for d in dictionaries if d not in known]:
        raise KeyError(f"no dictionary named {', '.join(missing)}")
    kept = list(df.columns)
    if rows is not None:
        tagged = _from_literals(df, {d: _lists(rows, d) for d in dictionaries}, text_column, maps)
    else:
        tagged = _from_join(df, lexicon, dictionaries, text_column, maps, id_column)
    if any(m in WITH_TOTAL for m in methods):
        tagged = tagged.withColumn("__total", total_words(F.col(raw_column)))
    none, there = F.create_map().cast("map<string,bigint>"), F.col(raw_column).isNotNull()
    new: dict[str, Column] = {}
    for m in methods:
        if m not in FORMULAS:
            log.warning("unknown method %s: hits are counted and no score is made", m)
    for d in dictionaries:
        p, n = F.col(f"__{d}_positive"), F.col(f"__{d}_negative")
        for m in methods:
            new |= {f"{d}_counttoken_positive_{m}{suffix}": p, f"{d}_counttoken_negative_{m}{suffix}": n}
            if maps:
                new |= {f"{d}_words_{x}_{m}{suffix}": F.coalesce(F.col(f"__{d}_{x}_map"), none) for x in ("positive", "negative")}
            if m in WITH_TOTAL:
                new[f"{d}_counttoken_total_{m}{suffix}"] = F.col("__total")
            if m in FORMULAS:
                new[f"{d}_sentiment_{m}{suffix}"] = FORMULAS[m](p, n, F.col("__total") if m in WITH_TOTAL else F.lit(None))
    if clash := sorted(set(new) & set(kept)):
        raise ValueError(f"the data already has {', '.join(clash)}")
    return tagged.select(*kept, *[F.when(there, c).alias(name) for name, c in new.items()])


def score_prefix(df: DataFrame, lexicon: DataFrame, dictionary: str, text_column: str = "text") -> DataFrame:
    """``df`` with ``positive``, ``negative`` and ``sentiment``: terms are beginnings of words (an extension)."""
    rows = lexicon_rows(lexicon.where(F.col("dictionary") == dictionary))
    if rows is None:
        raise ScoreError(f"a dictionary of word beginnings may have {MOST_TERMS} terms")
    lists = _lists(rows, dictionary)

    def hits(terms: list[str]) -> Column:
        if not terms:
            return F.lit(0).cast("long")
        quoted = "|".join("\\Q" + t + "\\E" for t in terms)
        return F.size(F.filter(word_tokens(F.col(text_column)), lambda t: t.rlike(f"^(?:{quoted})"))).cast("long")

    out = df.withColumns({"positive": hits(lists["positive"]), "negative": hits(lists["negative"])})
    return out.withColumn("sentiment", posneg(F.col("positive"), F.col("negative")))


def term_hits(df: DataFrame, lexicon: DataFrame, id_column: str, text_column: str = "text") -> DataFrame:
    """``id_column, dictionary, polarity, term, pos, n``: the long form, for lexicons of any size.

    Tokens meet the lexicon in an equi-join; Spark sends the lexicon to every task while it is small and
    shuffles by term when it isn't. The counts of a document are combined before their shuffle.
    """
    tokens = df.select(id_column, F.explode(word_tokens(F.col(text_column))).alias("term"))
    return tokens.join(lexicon.select("dictionary", "polarity", "term", "pos"), "term").groupBy(id_column, "dictionary", "polarity", "term", "pos").agg(F.count(F.lit(1)).alias("n"))


def score_hits(hits: DataFrame, id_column: str) -> DataFrame:
    """``id_column, dictionary, positive, negative, sentiment`` of documents with hits, from the long form."""
    signed = lambda p: F.sum(F.when(F.col("polarity") == p, F.col("n")).otherwise(0))
    sums = hits.groupBy(id_column, "dictionary").agg(signed("positive").alias("positive"), signed("negative").alias("negative"))
    return sums.withColumn("sentiment", posneg(F.col("positive"), F.col("negative")))


def map_text(c: Column) -> Column:
    """A word map as text, ``term:n`` in the map's order."""
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), " ")
