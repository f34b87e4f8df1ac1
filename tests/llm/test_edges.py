"""Every operator on awkward rows and on no rows at all."""

import pytest
from pyspark.sql import functions as F

from tonelens.llm import boilerplate, garbled, language, leaks, lookalike, neardup, packing, repetition, scanned, tokens
from tonelens.llm.queries import QUERIES, SQL

LONG = ("The output gap widened again in March. " * 9000) + "End"
COLUMNS = "key long, body string, bank string, label string, link string, id string, text string, source string, line string, cls string, tokens string, salt string, range string, word string, n string"
ROWS = [
    (1, "The board raised the rate by ten points after the review of the year.\nSame line", "A", "en", "https://a.example/x"),
    (1, "The board raised the rate by ten points after the review of the year.\nSame line", "A", "en", "https://a.example/x"),
    (2, "The board raised the rate by ten points after the review of the year.\nSame line", "A", None, "not a url"),
    (3, None, "A", "fr", None),
    (4, "", None, "", ""),
    (5, " \n\t", "B", "-", "https://b.example"),
    (None, "A text without an id, which is rather short.", None, None, None),
    (6, LONG, "B", "en", "https://b.example/long"),
    (7, "one", "B", "xx", None),
    (8, "﻿\U0001d400́​ ��� \U0001f600", None, None, None),
    (9, "\0nul \0 inside\n\n\n-\n", "B", None, None),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, *["clash"] * 10) for r in ROWS], COLUMNS)


@pytest.fixture(scope="module")
def samples(spark, sf):
    return spark.read.parquet(f"{sf}/lang_samples.parquet")


def operators(df, samples):
    items = df.select(F.col("key").alias("key"), "body", "id", "text")
    sizes = df.select(F.col("key").alias("id"), F.length("body").cast("long").alias("tokens"), "text")
    return {
        "lookalike": lambda: lookalike.unified(df, "key", "body", samples),
        "shares": lambda: language.language_shares(df, "key", "body", samples),
        "passages": lambda: language.language_passages(df, "key", "body", samples),
        "tokens": lambda: tokens.estimated_tokens(df, "key", "body", "label"),
        "budget": lambda: tokens.token_budget(df, "key", "body", "label", "bank", "source", "link"),
        "exact": lambda: tokens.exact_tokens(df, "key", "body"),
        "scanned": lambda: scanned.scanned(df, "key", "body", restored=True),
        "pairs": lambda: neardup.similar_pairs(df, "key", "body", 0.5),
        "groups": lambda: neardup.similar_groups(df, "key", "body"),
        "garbled": lambda: garbled.garbled(df, "key", ["body", "text"], samples, restored=True),
        "lines": lambda: boilerplate.lines_to_remove(df, "key", "body", "bank", 2),
        "without": lambda: boilerplate.without_lines(df, "key", "body", "bank", 2),
        "packed": lambda: packing.packed(sizes, 512),
        "leaked": lambda: leaks.leaked(df, "key", "body", items, "key", "body"),
        "similar": lambda: leaks.similar(df, "key", "body", items, "key", "body"),
        "repeated": lambda: repetition.flagged(df, "key", "body")[0],
    }


NAMES = sorted(operators_name for operators_name in ("lookalike", "shares", "passages", "tokens", "budget", "exact", "scanned", "pairs", "groups", "garbled", "lines", "without", "packed", "leaked", "similar", "repeated"))
#: Rows out for the rows above; the others depend on more than the rows.
EXPECTED = {"lookalike": 11, "tokens": 11, "exact": 11, "repeated": 11, "without": 10, "pairs": 1, "garbled": 1, "lines": 4}


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(awkward, samples, name):
    got = operators(awkward, samples)[name]().collect()
    if name == "pairs":  # rows 1 and 2 only: a row with a repeated id is the same record
        assert [tuple(r) for r in got] == [(1, 2)]
    elif name == "without":
        assert len(got) == 11 and {r.kept for r in got if r.id in (1, 2)} == {""}
    elif name == "lines":  # lines of records 1 and 2, the former standing twice
        assert {(r.id, r.line_no) for r in got} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    elif name in EXPECTED:
        assert len(got) == EXPECTED[name]


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(awkward, samples, name):
    assert operators(awkward.limit(0), samples)[name]().count() == 0


def test_query_names():
    assert {f"p{n}_found" for n in (1, 2, 4, 5, 6, 7, 9, 10)} <= set(QUERIES) and set(SQL) <= set(QUERIES)
    assert any(q.startswith("p3_") for q in QUERIES) and any(q.startswith("p8_") for q in QUERIES)
