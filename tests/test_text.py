import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonelens.config import CleanConfig
from tonelens.errors import ConfigError
from tonelens.functions import text as t
from tonelens.functions.arrow import html_text, to_ascii, treebank_tokens
from tonelens.functions.porter import stem
from tonelens.functions.stopwords import stop_words
from tonelens.operators.clean import clean, clean_expression

CLEANED = {
    "The Committee\u2019s \u201cgoal\u201d is 5\u00bd percent\u2014roughly.": "The Committees goal is 512%roughly.",
    "rate at 5-1/4 to 5-1/2 percent.": "rate at 5-. 25 to 5-. 5%.",
    "by 1/2 percentage point": "by. 5% point",
    "Rose 5.25 per cent!!  Really?? Yes.....": "Rose 5. 25%! Really? Yes. . .",
    "<p>Hello&amp;</p><b>World</b>": "Hello&amp;World",
    "a\r\nb\n\n<br>c ,, d;;; e-----f": "a b c , d; e---f",
    "caf\u00e9 \ufb01nance x\u00b2 \u20ac5\u2122 na\u00efve": "cafe finance x2 5TM naive",
    "   ": "",
    "": "",
    "U.S. Committee, July 31/23": "U. S. Committee, July 3. 53",
}


def apply(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.select("i", f(F.col("c")).alias("x")).orderBy("i").select("x").collect()]


def test_cleaned_as_expected(spark):
    got = apply(spark, [*CLEANED, None], lambda c: clean_expression(c, CleanConfig()))
    assert got == [*CLEANED.values(), None]


def test_encoding_quotes_and_spelling(spark):
    assert apply(spark, ["itâ€™s 5Â°, cafÃ©, voilÃ lÃ\xado"], t.fix_encoding) == ["it's 5°, café, voilàlío"]
    assert apply(spark, ["`a` „b"], t.standardize_quotes) == ["'a' \"b"]
    assert apply(spark, ["the Labour programme"], lambda c: F.array_join(t.american(t.word_tokens(c)), " ")) == ["the labor program"]


def test_header_and_footer(spark):
    header = lambda c: t.remove_header(c, ["Second (x)", "FIRST"])
    assert apply(spark, ["first  second (X) body", "SECOND (X)  first", "none", None, "second (x)"], header) == ["second (X) body", "first", "none", None, ""]
    assert apply(spark, ["body The End\n", "The end body"], lambda c: t.remove_footer(c, ["the end"])) == ["body", "The end body"]


def test_names_sentences_and_blanks(spark):
    assert apply(spark, ["_Bank of: X / Y?.", "ECB"], t.sanitize_name) == ["bank_of_x_y", "ecb"]
    assert apply(spark, ["One. Two demand. Three demand.", "none", None], lambda c: t.first_sentence_with(c, "demand")) == [" Two demand", None, None]
    assert apply(spark, [None, "", " \n\u00a0", "x"], t.is_blank) == [True, True, True, False]


STEPS = {
    t.collapse_punctuation: {"a!!b??c,,d;;e..f...g--h---i----": "a!b?c,d;e...f...g--h---i---", "!?!?": "!?!?", ":::": ":::"},
    t.normalize_whitespace: {" a\r\nb\u00a0\u3000c . d!e ": "a b c. d! e", "3.5": "3. 5"},
    t.numbers_and_percentages: {"5 1/2 percent, 3 \u00a0% or ⅜ per cent": "5 .5%, 3% or .375%", "12percentage": "12%"},
    t.strip_tags: {"<a\nb> <i>x</i>\t y": "<a b> x y", "1 < 2 > 3": "1 3"},
}


@pytest.mark.parametrize("step", STEPS, ids=lambda f: f.__name__)
def test_steps_as_expected(spark, step):
    assert apply(spark, list(STEPS[step]), step) == list(STEPS[step].values())


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab.,;!?-<>% 15/24½é“\n\r\t\u00a0\u3000", max_size=40).filter(str.strip), min_size=40, max_size=60))
def test_cleaned_texts_have_one_form(spark, values):
    """Cleaned text is ASCII on one line, trimmed, with single spaces, no repeated marks and no fractions of the list."""
    for x in apply(spark, values, lambda c: clean_expression(c, CleanConfig())):
        assert x.isascii() and x == x.strip() and "\n" not in x and "  " not in x
        assert not any(m * 2 in x for m in t.ONCE) and "1/2" not in x and "½" not in x


def test_tokens_and_stems():
    assert treebank_tokens("Don't say the Committee's cannot. Long-term 2% growth (one) ended.") == ["do", "say", "the", "committee", "can", "not", "growth", "one", "ended"]
    assert treebank_tokens(None) == treebank_tokens("  ") == []
    stems = {"caresses": "caress", "ponies": "poni", "happy": "happi", "enjoy": "enjoy", "generalizations": "gener", "dies": "die", "flies": "fli", "filing": "file", "news": "news", "skies": "sky", "is": "is"}
    assert {w: stem(w) for w in stems} == stems


def test_html_and_ascii():
    assert html_text("<head><title>x</title></head><p>a &amp; b</p><script>s</script><p>c</p>") == "a & b c"
    assert to_ascii("½ ² ﬁ ™ ß é") == "12 2 fi TM  e"
    assert html_text("<style>a<script>b</script>c</style>d<noscript><p>e</p></noscript> f") == "d  f" and html_text("</head>a") == "a"
    assert html_text(None) is None and to_ascii(None) is None


def test_stop_words():
    assert len(stop_words()) == 318 and {"the", "yourselves", "amoungst", "bill"} <= set(stop_words()) and "just" not in stop_words()


def test_clean_options(spark):
    df = spark.createDataFrame([(2, "Rates rose."), (1, None), (3, "")], "k int, text string")
    rows = clean(df, "text", {"stem": True, "remove_headers": ["rates"]}, "k").orderBy("id_text").collect()
    assert [(r.id_text, r.text_clean, r.text_tokens_str, r.text_stems) for r in rows] == [(1, None, "", ""), (2, "rose.", "rose", "rose"), (3, "", "", "")]
    with pytest.raises(ValueError, match="Text column"):
        clean(df, "nope")
    with pytest.raises(ConfigError):
        CleanConfig.of({"no_such": True})
