"""Queries over the test tables, and for each that SQL can express the SQL that gives the same rows.

Every query runs over its whole tables.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.arrow import ABBREVIATIONS, html_text_udf, stems_udf, to_ascii_udf, treebank_tokens_udf
from ..functions.stopwords import stop_words
from ..operators import preview as look
from ..operators import score as sc
from ..operators import series as ts
from ..operators import summary as sm
from ..operators.clean import clean
from ..operators.ids import dense_ids
from ..sources import readers, sinks
from ..sources.shared import new_path
from ..streaming import live
from . import banks
from .pipeline import TonePipeline

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Tables with long texts, whose rows are worth spreading over the cores.
TEXTS = ("speeches", "documents")
HEADERS = ("Check against delivery", "Introduction")
FOOTERS = ("Back to all speeches", "Share this page")
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return readers.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")) if name in TEXTS else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Scores -------------------------------------------------------------------------------------------------------------


def _hits_sql(of: str, key: str, dictionary: str) -> str:
    return f"""t AS (SELECT {key}, unnest({TOKENS.format("text")}) AS term FROM {of} WHERE text IS NOT NULL),
h AS (SELECT {key}, sum(CASE WHEN polarity = 'positive' THEN 1 ELSE 0 END) AS p, sum(CASE WHEN polarity = 'negative' THEN 1 ELSE 0 END) AS n
      FROM t JOIN lexicon l ON l.term = t.term AND l.dictionary = '{dictionary}' GROUP BY {key}),
w AS (SELECT {key}, count(*) AS total FROM t WHERE term NOT IN ({", ".join(map(quoted, stop_words()))}) GROUP BY {key}),
s AS (SELECT x.{key}, coalesce(p, 0)::BIGINT AS p, coalesce(n, 0)::BIGINT AS n, coalesce(total, 0)::BIGINT AS total
      FROM {of} x LEFT JOIN h USING ({key}) LEFT JOIN w USING ({key}) WHERE x.text IS NOT NULL)"""


POSNEG = "CASE WHEN p + n > 0 THEN 1 + (p - n)::DOUBLE / (p + n) ELSE 1.0::DOUBLE END"
ALLWORDS = "CASE WHEN total > 0 THEN 1 + (p - n)::DOUBLE / total ELSE 1.0::DOUBLE END"


def _scored(spark, d, of: str, key: str, dictionary: str, method: str) -> DataFrame:
    df = readers.with_text(table(spark, d, of).select(key, "text"))
    out = sc.score(df, table(spark, d, "lexicon"), [dictionary], [method], maps=False)
    cols = [F.col(f"{dictionary}_counttoken_positive_{method}").alias("positive"), F.col(f"{dictionary}_counttoken_negative_{method}").alias("negative")]
    if method == "allwords":
        cols.append(F.col(f"{dictionary}_counttoken_total_allwords").alias("total"))
    return out.select(key, *cols, F.col(f"{dictionary}_sentiment_{method}").alias("sentiment"))


for _name, _of, _key, _dict, _method in (
    ("posneg_table_lexicon", "statements", "statement_id", "tone_a", "posneg"),
    ("posneg_tone_a", "speeches", "speech_id", "tone_a", "posneg"),
    ("posneg_tone_b", "speeches", "speech_id", "tone_b", "posneg"),
    ("allwords_tone_a", "speeches", "speech_id", "tone_a", "allwords"),
    ("allwords_tone_b", "speeches", "speech_id", "tone_b", "allwords"),
    ("posneg_documents", "documents", "doc_id", "tone_a", "posneg"),
):
    _more = ", total" if _method == "allwords" else ""
    QUERIES[_name] = partial(_scored, of=_of, key=_key, dictionary=_dict, method=_method)
    SQL[_name] = f"WITH {_hits_sql(_of, _key, _dict)} SELECT {_key}, p AS positive, n AS negative{_more}, {ALLWORDS if _more else POSNEG} AS sentiment FROM s"


@query("score_all_wide")
def score_all_wide(spark, d):
    """All dictionaries for tokens and both methods in one pass."""
    df = readers.with_text(table(spark, d, "speeches").select("speech_id", "text"))
    return sc.score(df, table(spark, d, "lexicon"), ["tone_a", "tone_b"], maps=False).drop("text")


def _wide_sql() -> str:
    cols = []
    for x in ("tone_a", "tone_b"):
        p, n = (f"coalesce(sum(CASE WHEN l.dictionary = '{x}' AND l.polarity = '{y}' THEN 1 ELSE 0 END), 0)::BIGINT AS {x}_{y[0]}" for y in ("positive", "negative"))
        cols += [p, n]
    out = []
    for x in ("tone_a", "tone_b"):
        for m, formula in (("posneg", POSNEG), ("allwords", ALLWORDS)):
            out += [f"{x}_p AS {x}_counttoken_positive_{m}", f"{x}_n AS {x}_counttoken_negative_{m}"]
            if m == "allwords":
                out.append(f"total AS {x}_counttoken_total_allwords")
            out.append(formula.replace("(p - n)", f"({x}_p - {x}_n)").replace("p + n", f"{x}_p + {x}_n") + f" AS {x}_sentiment_{m}")
    return f"""WITH t AS (SELECT speech_id, unnest({TOKENS.format("text")}) AS term FROM speeches WHERE text IS NOT NULL),
h AS (SELECT speech_id, {", ".join(cols)} FROM t JOIN lexicon l USING (term) GROUP BY speech_id),
w AS (SELECT speech_id, count(*) AS total FROM t WHERE term NOT IN ({", ".join(map(quoted, stop_words()))}) GROUP BY speech_id),
s AS (SELECT x.speech_id, {", ".join(f"coalesce({a}_{b}, 0)::BIGINT AS {a}_{b}" for a in ("tone_a", "tone_b") for b in "pn")}, coalesce(total, 0)::BIGINT AS total
      FROM speeches x LEFT JOIN h USING (speech_id) LEFT JOIN w USING (speech_id) WHERE x.text IS NOT NULL)
SELECT speech_id, {", ".join(out)} FROM s"""


SQL["score_all_wide"] = _wide_sql()


def _word_map(spark, d, polarity: str) -> DataFrame:
    df = readers.with_text(table(spark, d, "speeches").select("speech_id", "text"))
    out = sc.score(df, table(spark, d, "lexicon"), ["tone_a"], ["posneg"])
    return out.select("speech_id", sc.map_text(F.col(f"tone_a_words_{polarity}_posneg")).alias("words"))


for _polarity in ("positive", "negative"):
    QUERIES[f"word_map_{_polarity}"] = partial(_word_map, polarity=_polarity)
    SQL[f"word_map_{_polarity}"] = f"""WITH t AS (SELECT speech_id, unnest({TOKENS.format("text")}) AS term FROM speeches WHERE text IS NOT NULL),
c AS (SELECT speech_id, l.term, l.pos, count(*) AS n FROM t JOIN lexicon l ON l.term = t.term AND dictionary = 'tone_a' AND polarity = '{_polarity}' GROUP BY ALL),
m AS (SELECT speech_id, string_agg(term || ':' || n, ' ' ORDER BY pos) AS words FROM c GROUP BY speech_id)
SELECT s.speech_id, coalesce(words, '') AS words FROM speeches s LEFT JOIN m USING (speech_id) WHERE s.text IS NOT NULL"""


def _term_freq(spark, d, dictionary: str) -> DataFrame:
    lexicon = table(spark, d, "lexicon").where(F.col("dictionary") == dictionary)
    return sc.term_hits(table(spark, d, "speeches"), lexicon, "speech_id").select("speech_id", "polarity", "term", "n")


for _dict in ("tone_a", "tone_b"):
    QUERIES[f"term_freq_{_dict}"] = partial(_term_freq, dictionary=_dict)
    SQL[f"term_freq_{_dict}"] = f"""WITH t AS (SELECT speech_id, unnest({TOKENS.format("text")}) AS term FROM speeches WHERE text IS NOT NULL)
SELECT speech_id, polarity, t.term, count(*)::BIGINT AS n FROM t JOIN lexicon l ON l.term = t.term AND dictionary = '{_dict}' GROUP BY ALL"""


@query("score_long", f"""WITH t AS (SELECT speech_id, unnest({TOKENS.format("text")}) AS term FROM speeches WHERE text IS NOT NULL),
s AS (SELECT speech_id, dictionary, sum(CASE WHEN polarity = 'positive' THEN 1 ELSE 0 END)::BIGINT AS p, sum(CASE WHEN polarity = 'negative' THEN 1 ELSE 0 END)::BIGINT AS n FROM t JOIN lexicon USING (term) GROUP BY ALL)
SELECT speech_id, dictionary, p AS positive, n AS negative, {POSNEG} AS sentiment FROM s""")  # fmt: skip
def score_long(spark, d):
    return sc.score_hits(sc.term_hits(table(spark, d, "speeches"), table(spark, d, "lexicon"), "speech_id"), "speech_id")


@query("total_tokens", f"""SELECT speech_id, len(list_filter({TOKENS.format("text")}, lambda x: x NOT IN ({", ".join(map(quoted, stop_words()))})))::BIGINT AS total FROM speeches WHERE text IS NOT NULL""")
def total_tokens(spark, d):
    return readers.with_text(table(spark, d, "speeches")).select("speech_id", sc.total_words(F.col("text")).alias("total"))


@query("posneg_prefix_tone_c", f"""WITH t AS (SELECT speech_id, unnest({TOKENS.format("text")}) AS word FROM speeches WHERE text IS NOT NULL),
u AS (SELECT DISTINCT word, polarity FROM (SELECT DISTINCT word FROM t) JOIN lexicon ON dictionary = 'tone_c' AND starts_with(word, term)),
h AS (SELECT speech_id, sum(CASE WHEN polarity = 'positive' THEN 1 ELSE 0 END) AS p, sum(CASE WHEN polarity = 'negative' THEN 1 ELSE 0 END) AS n FROM t JOIN u USING (word) GROUP BY speech_id),
s AS (SELECT x.speech_id, coalesce(p, 0)::BIGINT AS p, coalesce(n, 0)::BIGINT AS n FROM speeches x LEFT JOIN h USING (speech_id) WHERE x.text IS NOT NULL)
SELECT speech_id, p AS positive, n AS negative, {POSNEG} AS sentiment FROM s""")  # fmt: skip
def posneg_prefix_tone_c(spark, d):
    return sc.score_prefix(readers.with_text(table(spark, d, "speeches").select("speech_id", "text")), table(spark, d, "lexicon"), "tone_c").drop("text")


@query("score_stems_tone_c")
def score_stems_tone_c(spark, d):
    """Stems of cleaned speeches against the dictionary of word beginnings, by exact match."""
    cleaned = clean(readers.with_text(table(spark, d, "speeches").select("speech_id", "text")), "text", {"stem": True})
    return sc.score(cleaned, table(spark, d, "lexicon"), ["tone_c"], text_column="text_stems", suffix="_stem", maps=False).drop("text_tokens", "text", "text_clean")


# Cleaning -----------------------------------------------------------------------------------------------------------


def _replaced(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, {quoted(old)}, {quoted(new)})"
    return x


def _re(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(to)}, 'g')"


def _strip_sql(x: str) -> str:
    return _re(x, f"^{SPACE}+|{SPACE}+$", "")


def _first_sql(x: str, patterns, make) -> str:
    import re

    cases = " ".join(f"WHEN regexp_matches({x}, {quoted('(?is)' + make(re.escape(p)))}) THEN {_strip_sql(f'regexp_replace({x}, {quoted("(?is)" + make(re.escape(p)))}, {quoted("")})')}" for p in patterns)
    return f"CASE {cases} ELSE {x} END"


def _punct_sql(x: str) -> str:
    for mark, least, left in (*((m, 2, 1) for m in t.ONCE), *((m, n, 3) for m, n in t.THRICE)):
        x = _re(x, f"[{mark}]{{{least},}}", mark * left)
    return x


@lru_cache(1)
def _ascii_map() -> str:
    """Every character that stands for ASCII ones, by Unicode's compatibility decomposition, as a DuckDB map."""
    pairs = {chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000}
    return "MAP {" + ", ".join(f"{quoted(c)}: {quoted(a)}" for c, a in pairs.items() if a) + "}"


def _ascii_sql(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: CASE WHEN c < chr(128) THEN c ELSE coalesce(({_ascii_map()})[c], '') END), '')"


def _tokens_sql(x: str) -> str:
    """Treebank tokens of letters only, of text with normalised white space, as one text: marks are dropped, so they
    part words as spaces do, and what stays in a word with a digit or sign drops the word."""
    x = f"replace(lower({x}), ' ', '  ')"
    x = _re(x, rf"(^| )([\"'(\[{{]*)(?:{'|'.join(sorted(a for a in ABBREVIATIONS if '.' not in a))}|\p{{L}})\. ", r"\1\2 0 ")
    x = _re(_re(x, r"\.( |$)", r" \1"), r"[:,](\p{Nd})", r"0\1")
    x = _re(_re(x, r"[:,;@#$%&?!*\[\](){}<>\"]|--", " ") + " || ' '", r"([^'])' ", r"\1 ' ")
    x = _re(_re(x, r"([^' ])(?:'s|'m|'d|') ", r"\1 "), r"([^' ])(?:'ll|'re|'ve|n't) ", r"\1 ")
    x = _re(x, r"\b(can|gim|gon|got|lem|wan)(not|me|na|ta)\b", r"\1 \2")
    return f"array_to_string(list_filter(regexp_split_to_array({x}, ' +'), lambda w: regexp_full_match(w, '\\p{{L}}+')), ' ')"


STEPS = {
    "encoding": (t.fix_encoding, lambda x: _replaced(x, t.ENCODING_FIXES)),
    "html_tags": (t.strip_tags, lambda x: _strip_sql(_re(_re(x, r"<[^\n]*?>", ""), f"{SPACE}+", " "))),
    "quotes": (t.standardize_quotes, lambda x: f"translate({x}, '`„', '''\"')"),
    "numbers": (t.numbers_and_percentages, lambda x: _strip_sql(_re(_replaced(x, (*t.FRACTIONS, ("percentage", "%"), ("percent", "%"), ("per cent", "%"))), rf"(\p{{Nd}}+){SPACE}*%", r"\1%"))),
    "punct": (t.collapse_punctuation, _punct_sql),
    "ws": (t.normalize_whitespace, lambda x: _strip_sql(_re(_re(x, f"{SPACE}+", " "), rf"{SPACE}*([.!?]){SPACE}*", r"\1 "))),
    "header": (lambda c: t.remove_header(c, HEADERS), lambda x: _first_sql(x, HEADERS, lambda p: "^" + p)),
    "footer": (lambda c: t.remove_footer(c, FOOTERS), lambda x: _first_sql(x, FOOTERS, lambda p: p + r"\n?\z")),
}


def _step(spark, d, name: str) -> DataFrame:
    return table(spark, d, "speeches").select("speech_id", STEPS[name][0](F.col("text")).alias("text_clean"))


for _name in STEPS:
    QUERIES[f"clean_{_name}"] = partial(_step, name=_name)
    SQL[f"clean_{_name}"] = f"SELECT speech_id, {STEPS[_name][1]('text')} AS text_clean FROM speeches"


def _chain_sql(x: str) -> str:
    for name in ("encoding", "ascii", "html_tags", "quotes", "numbers", "punct", "ws"):
        x = _ascii_sql(x) if name == "ascii" else STEPS[name][1](x)
    return x


@query("clean_full", f"SELECT speech_id, {_chain_sql('text')} AS text_clean FROM speeches")
def clean_full(spark, d):
    return clean(table(spark, d, "speeches").select("speech_id", "text")).drop("text")


@query("normalize_unicode", f"SELECT speech_id, {_ascii_sql('text')} AS text_ascii FROM speeches")
def normalize_unicode(spark, d):
    return table(spark, d, "speeches").select("speech_id", to_ascii_udf("text").alias("text_ascii"))


@query("html_text", "SELECT speech_id, array_to_string(list_append(list_filter(string_split(text, chr(10)), lambda x: x <> ''), '& more'), ' ') AS text FROM speeches WHERE text IS NOT NULL")
def html_text(spark, d):
    """Speeches as pages, and the text read from them; their texts have no marks of HTML."""
    page = F.concat(F.lit("<html><head><title>x</title></head><body><p>"), F.replace(F.col("text"), F.lit("\n"), F.lit("</p><p>")), F.lit("</p><script>var a = 1;</script>&amp; more</body></html>"))
    return readers.with_text(table(spark, d, "speeches")).select("speech_id", html_text_udf(page).alias("text"))


@query("tokenize", f"SELECT speech_id, {_tokens_sql('x')} AS tokens FROM (SELECT speech_id, {STEPS['ws'][1]('text')} AS x FROM speeches WHERE text IS NOT NULL)")
def tokenize(spark, d):
    return readers.with_text(table(spark, d, "speeches")).select("speech_id", F.array_join(treebank_tokens_udf(t.normalize_whitespace(F.col("text"))), " ").alias("tokens"))


@query("stem")
def stem(spark, d):
    return table(spark, d, "speeches").select("speech_id", F.array_join(stems_udf(treebank_tokens_udf(F.col("text"))), " ").alias("stems"))


@query("spelling_american", f"""WITH m(b, a) AS (VALUES {", ".join(f"({quoted(b)}, {quoted(a)})" for b, a in t.SPELLINGS.items())}),
w AS (SELECT doc_id, unnest({TOKENS.format("text")}) AS word FROM documents WHERE text IS NOT NULL)
SELECT doc_id, a AS word, count(*)::BIGINT AS n FROM w JOIN m ON word = b GROUP BY ALL""")  # fmt: skip
def spelling_american(spark, d):
    """American spellings that replace British ones, by document."""
    words = table(spark, d, "documents").select("doc_id", t.word_tokens(F.col("text")).alias("w"))
    both = words.select("doc_id", F.explode(F.arrays_zip(F.col("w").alias("was"), t.american(F.col("w")).alias("now"))).alias("x"))
    return both.where("x.was <> x.now").groupBy("doc_id", F.col("x.now").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("sanitize_name", r"""SELECT "CentralBank", lower(regexp_replace(regexp_replace("CentralBank", '[<>:"/\\|?*\s]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g')) AS file_key, count(*)::BIGINT AS n FROM speeches WHERE "CentralBank" IS NOT NULL GROUP BY ALL""")
def sanitize_name(spark, d):
    rows = table(spark, d, "speeches").where(F.col("CentralBank").isNotNull())
    return rows.groupBy("CentralBank", t.sanitize_name(F.col("CentralBank")).alias("file_key")).agg(F.count(F.lit(1)).alias("n"))


# Filters and projections --------------------------------------------------------------------------------------------


@query("filter_nonnull", "SELECT speech_id FROM speeches WHERE text IS NOT NULL")
def filter_nonnull(spark, d):
    return readers.with_text(table(spark, d, "speeches")).select("speech_id")


@query("filter_nonblank", f"SELECT speech_id FROM speeches WHERE text IS NOT NULL AND regexp_matches(text, '[^{SPACE[1:]}')")
def filter_nonblank(spark, d):
    return readers.with_nonblank_text(table(spark, d, "speeches")).select("speech_id")


@query("filter_id", "SELECT strftime(date, '%Y-%m-%d') AS title, text AS original, NULL::VARCHAR AS cleaned FROM statements WHERE statement_id = 7")
def filter_id(spark, d):
    return look.TextPreview(table(spark, d, "statements"), "text", "date", "statement_id").compare(7)


@query("filter_bank", """SELECT speech_id, "CentralBank", iso2 FROM speeches LEFT JOIN iso_map ON "Country" = iso3 WHERE "CentralBank" = 'Bank of Siamel' AND regexp_matches(coalesce(text, ''), '\\S')""")
def filter_bank(spark, d):
    return banks.prepare(table(spark, d, "speeches"), table(spark, d, "iso_map"), "Bank of Siamel").select("speech_id", "CentralBank", "iso2")


@query("preview_500", "SELECT statement_id, date, substr(text, 1, 500) AS preview FROM statements")
def preview_500(spark, d):
    return look.TextPreview(table(spark, d, "statements"), "text", "date", "statement_id").previews()


@query("id_bounds", "SELECT min(statement_id) AS least, max(statement_id) AS largest FROM statements")
def id_bounds(spark, d):
    return look.TextPreview(table(spark, d, "statements"), "text", "date", "statement_id").bounds()


@query("sentence_with_word", "SELECT statement_id, list_filter(string_split(text, '.'), lambda x: contains(x, 'demand'))[1] AS sentence FROM statements")
def sentence_with_word(spark, d):
    return table(spark, d, "statements").select("statement_id", t.first_sentence_with(F.col("text"), "demand").alias("sentence"))


@query("columns_from", 'SELECT "Filename", "Language", "Source", loaded_at FROM speeches')
def columns_from(spark, d):
    return look.columns_from(table(spark, d, "speeches"), "Filename")


@query("country_iso_map", 'SELECT speech_id, "Country", iso2 FROM speeches LEFT JOIN iso_map ON "Country" = iso3')
def country_iso_map(spark, d):
    return look.map_codes(table(spark, d, "speeches").select("speech_id", "Country"), "Country", table(spark, d, "iso_map"), "iso3", "iso2", "iso2")


@query("union_by_name", "SELECT doc_id, text, lang FROM documents WHERE lang = 'en' UNION ALL BY NAME SELECT doc_id, source FROM documents WHERE lang IS NULL OR lang <> 'en'")
def union_by_name(spark, d):
    docs = table(spark, d, "documents")
    return look.union_by_name(docs.where("lang = 'en'").select("doc_id", "text", "lang"), docs.where("lang IS NULL OR lang <> 'en'").select("doc_id", "source"))


# Summaries ----------------------------------------------------------------------------------------------------------


@query("group_counts", 'SELECT "CentralBank" AS "group", count(*)::BIGINT AS count FROM speeches WHERE "CentralBank" IS NOT NULL GROUP BY ALL')
def group_counts(spark, d):
    return sm.group_counts(table(spark, d, "speeches"), "CentralBank")


@query("text_stats", """WITH g AS (SELECT source AS "group", sum(length(text))::BIGINT AS total, min(length(text))::INTEGER AS min, max(length(text))::INTEGER AS max, count(text)::BIGINT AS count FROM documents WHERE source IS NOT NULL GROUP BY ALL)
SELECT "group", round_even(total / count, 2) AS mean, min, max, count FROM g""")  # fmt: skip
def text_stats(spark, d):
    return sm.text_stats(table(spark, d, "documents"), "source")


@query("time_span", """WITH x AS (SELECT min(date) AS a, max(date) AS b, count(*) AS n FROM statements)
SELECT 'start_date' AS metric, strftime(a, '%Y-%m-%d') AS value FROM x UNION ALL SELECT 'end_date', strftime(b, '%Y-%m-%d') FROM x
UNION ALL SELECT 'total_days', floor((epoch(b) - epoch(a)) / 86400)::BIGINT::VARCHAR FROM x UNION ALL SELECT 'total_records', n::VARCHAR FROM x""")  # fmt: skip
def time_span(spark, d):
    return sm.time_span(table(spark, d, "statements"))


@query("date_ranges", """SELECT "CentralBank" AS "group", strftime(min("Date"), '%Y-%m-%d') AS start_date, strftime(max("Date"), '%Y-%m-%d') AS end_date FROM speeches WHERE "CentralBank" IS NOT NULL GROUP BY ALL""")
def date_ranges(spark, d):
    return sm.date_ranges(table(spark, d, "speeches"), "CentralBank", "Date")


@query("distinct_count", 'SELECT count(DISTINCT "CentralBank")::BIGINT AS n FROM speeches')
def distinct_count(spark, d):
    return sm.distinct_count(table(spark, d, "speeches"), "CentralBank")


@query("distinct_values", 'SELECT DISTINCT "Language" FROM speeches')
def distinct_values(spark, d):
    return sm.distinct_values(table(spark, d, "speeches"), "Language")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _describe_sql(of: str, columns) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS \"column\", count({x})::BIGINT AS count, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, round(quantile_cont({x}, 0.25), 6) AS p25, round(quantile_cont({x}, 0.5), 6) AS p50, round(quantile_cont({x}, 0.75), 6) AS p75, round(max({x}), 6) AS max FROM {of}" for name, x in columns)


@query("describe_values", _describe_sql("orders", [("o_totalprice", "o_totalprice")]))
def describe_values(spark, d):
    return _rounded(sm.describe(table(spark, d, "orders"), ["o_totalprice"]))


@query("describe_scores", f"WITH {_hits_sql('speeches', 'speech_id', 'tone_a')}, r AS (SELECT {POSNEG} AS a, {ALLWORDS} AS b FROM s) " + _describe_sql("r", [("tone_a_sentiment_posneg", "a"), ("tone_a_sentiment_allwords", "b")]))
def describe_scores(spark, d):
    scored = sc.score(readers.with_text(table(spark, d, "speeches").select("speech_id", "text")), table(spark, d, "lexicon"), ["tone_a"], maps=False)
    return _rounded(sm.describe(scored, t.score_columns(scored.columns)))


@query("score_means", f"WITH {_hits_sql('speeches', 'speech_id', 'tone_a')} SELECT round(avg({POSNEG}), 6) AS tone_a_sentiment_posneg, round(avg({ALLWORDS}), 6) AS tone_a_sentiment_allwords FROM s")
def score_means(spark, d):
    scored = sc.score(readers.with_text(table(spark, d, "speeches").select("speech_id", "text")), table(spark, d, "lexicon"), ["tone_a"], maps=False)
    return _rounded(sm.column_means(scored, t.score_columns(scored.columns)))


@query("histogram_30", """WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events WHERE value IS NOT NULL),
c AS (SELECT least(floor((value - a) / ((b - a) / 30)), 29)::INTEGER AS bin, count(*)::BIGINT AS n FROM events, e WHERE value IS NOT NULL GROUP BY ALL)
SELECT g.bin::INTEGER AS bin, round(a + g.bin * ((b - a) / 30), 6) AS low, round(a + (g.bin + 1) * ((b - a) / 30), 6) AS high, coalesce(n, 0)::BIGINT AS n FROM range(30) g(bin) CROSS JOIN e LEFT JOIN c ON c.bin = g.bin""")  # fmt: skip
def histogram_30(spark, d):
    return _rounded(sm.histogram(table(spark, d, "events"), "value"))


# Series -------------------------------------------------------------------------------------------------------------

MONTHS = """m AS (SELECT last_day(o_orderdate) AS month, avg(o_totalprice) AS value FROM orders GROUP BY ALL),
c AS (SELECT last_day(x) AS month FROM (SELECT unnest(generate_series(date_trunc('month', min(month)), date_trunc('month', max(month)), INTERVAL 1 MONTH)) AS x FROM m)),
f AS (SELECT c.month, value FROM c LEFT JOIN m USING (month))"""
BANK_MONTHS = """m AS (SELECT "CentralBank" AS bank, last_day("Date") AS month, avg(length(text)) AS value FROM speeches WHERE "Date" IS NOT NULL GROUP BY ALL),
c AS (SELECT bank, last_day(x) AS month FROM (SELECT bank, unnest(generate_series(date_trunc('month', min(month)), date_trunc('month', max(month)), INTERVAL 1 MONTH)) AS x FROM m GROUP BY bank)),
f AS (SELECT c.bank, c.month, value FROM c LEFT JOIN m ON c.bank IS NOT DISTINCT FROM m.bank AND c.month = m.month)"""


def _bank_months(spark, d) -> DataFrame:
    speeches = table(spark, d, "speeches").select(F.col("CentralBank").alias("bank"), "Date", F.length("text").alias("n"))
    return ts.monthly_mean(speeches, "Date", "n", "bank")


@query("monthly_mean", f"WITH {MONTHS} SELECT month, round(value, 6) AS value FROM f")
def monthly_mean(spark, d):
    return _rounded(ts.monthly_mean(table(spark, d, "orders"), "o_orderdate", "o_totalprice"))


@query("monthly_mean_bank", f"WITH {BANK_MONTHS} SELECT bank, month, round(value, 6) AS value FROM f")
def monthly_mean_bank(spark, d):
    return _rounded(_bank_months(spark, d))


@query("rolling4_strict", f"WITH {BANK_MONTHS} SELECT bank, month, round(CASE WHEN count(value) OVER w = 4 THEN avg(value) OVER w END, 6) AS value FROM f WINDOW w AS (PARTITION BY bank ORDER BY month ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def rolling4_strict(spark, d):
    return _rounded(_bank_months(spark, d).withColumn("value", ts.trailing("value", "month", 4, partition_by="bank")))


@query("rolling6_lenient", f"WITH {MONTHS} SELECT month, round(avg(value) OVER (ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS value FROM f")
def rolling6_lenient(spark, d):
    months = ts.monthly_mean(table(spark, d, "orders"), "o_orderdate", "o_totalprice")
    return _rounded(months.withColumn("value", ts.trailing("value", "month", 6, 1)))


@query("id_text", "SELECT statement_id, row_number() OVER (ORDER BY date NULLS FIRST, statement_id)::BIGINT AS id_text FROM statements")
def id_text(spark, d):
    return dense_ids(table(spark, d, "statements").select("statement_id", "date"), ["date", "statement_id"], "id_text").drop("date")


@query("id_text_per_bank", 'SELECT speech_id, "CentralBank", row_number() OVER (PARTITION BY "CentralBank" ORDER BY speech_id)::BIGINT AS id_text FROM speeches')
def id_text_per_bank(spark, d):
    return dense_ids(table(spark, d, "speeches").select("speech_id", "CentralBank"), ["speech_id"], "id_text", "CentralBank")


@query("sort_date", "SELECT statement_id, date FROM statements ORDER BY date, statement_id")
def sort_date(spark, d):
    return ts.in_date_order(table(spark, d, "statements"), "date", "statement_id").select("statement_id", "date")


@query("latest_row", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_row(spark, d):
    return ts.latest(table(spark, d, "orders"), "o_orderdate", tie="o_orderkey").select("o_orderkey", "o_orderdate")


@query("head_n", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5")
def head_n(spark, d):
    return ts.first_rows(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_orderdate")


@query("lexicon_sizes", "SELECT dictionary, polarity, count(*)::BIGINT AS terms FROM lexicon GROUP BY ALL")
def lexicon_sizes(spark, d):
    return look.lexicon_sizes(readers.checked_lexicon(table(spark, d, "lexicon")))


@query("lexicon_preview", "SELECT dictionary, polarity, array_to_string(list(term ORDER BY pos)[1:10], ' ') AS first_terms, count(*)::INTEGER AS terms FROM lexicon GROUP BY ALL")
def lexicon_preview(spark, d):
    return look.lexicon_preview(table(spark, d, "lexicon"))


# Whole pipelines ----------------------------------------------------------------------------------------------------


def _cleaned_sql(of: str) -> str:
    """CTEs over ``of``: ``c`` with text_clean and text_tokens_str, ``s`` with the scores of tone_a by both methods."""
    return f"""q AS (SELECT *, {_chain_sql('text')} AS text_clean FROM {of}),
c AS (SELECT *, coalesce({_tokens_sql('text_clean')}, '') AS text_tokens_str FROM q),
t AS (SELECT speech_id, unnest({TOKENS.format("text_tokens_str")}) AS term FROM c),
h AS (SELECT speech_id, sum(CASE WHEN polarity = 'positive' THEN 1 ELSE 0 END) AS hp, sum(CASE WHEN polarity = 'negative' THEN 1 ELSE 0 END) AS hn
      FROM t JOIN lexicon l ON l.term = t.term AND l.dictionary = 'tone_a' GROUP BY speech_id),
r AS (SELECT speech_id, unnest({TOKENS.format("text")}) AS term FROM c),
w AS (SELECT speech_id, count(*) AS words FROM r WHERE term NOT IN ({", ".join(map(quoted, stop_words()))}) GROUP BY speech_id),
k AS (SELECT c.*, coalesce(hp, 0)::BIGINT AS p, coalesce(hn, 0)::BIGINT AS n, coalesce(words, 0)::BIGINT AS total FROM c LEFT JOIN h USING (speech_id) LEFT JOIN w USING (speech_id)),
s AS (SELECT *, CASE WHEN text IS NOT NULL THEN {POSNEG} END AS tone_a_sentiment_posneg, CASE WHEN text IS NOT NULL THEN {ALLWORDS} END AS tone_a_sentiment_allwords FROM k)"""


BANKS_SQL = f"""WITH f AS (SELECT speech_id, "CentralBank", iso2, text, row_number() OVER (PARTITION BY "CentralBank" ORDER BY speech_id)::BIGINT AS id_text
FROM speeches LEFT JOIN iso_map ON "Country" = iso3 WHERE regexp_matches(coalesce(text, ''), '[^{SPACE[1:]}')), {_cleaned_sql("f")}
SELECT speech_id, "CentralBank", iso2, id_text, tone_a_sentiment_posneg, tone_a_sentiment_allwords FROM s"""


def _banks(spark, d, dictionaries: dict, out: str | None = None) -> DataFrame:
    scored = banks.score_banks(spark, table(spark, d, "speeches"), table(spark, d, "iso_map"), table(spark, d, "lexicon"), {"tokenize": True, "stem": bool(dictionaries.get("stemmed"))}, dictionaries, out=out)
    return scored.select("speech_id", "CentralBank", "iso2", "id_text", *t.score_columns(scored.columns))


@query("score_banks", BANKS_SQL)
def score_banks(spark, d):
    """The batch driver over all banks: cleaned, tokenized, scored, numbered bank by bank."""
    return _banks(spark, d, {"unstemmed": ["tone_a"]})


@query("score_banks_stems")
def score_banks_stems(spark, d):
    """The same with stems and all dictionaries."""
    return _banks(spark, d, {"unstemmed": ["tone_a", "tone_b"], "stemmed": ["tone_c"]})


@query("merged_banks", BANKS_SQL)
def merged_banks(spark, d):
    """The merged table as it was written."""
    path = new_path(spark, "merged")
    columns = _banks(spark, d, {"unstemmed": ["tone_a"]}, path).columns
    return readers.read_folder(spark, path).select(*columns)


EXPORTS_SQL = f"""WITH f AS (SELECT speech_id, text, row_number() OVER (ORDER BY "Date" NULLS FIRST, speech_id)::BIGINT AS id_text FROM speeches), {_cleaned_sql("f")} """


def _exported(spark, d, name: str) -> DataFrame:
    """One of the files that a run of the pipeline writes."""
    path = new_path(spark, "export")
    # numbered by the date, and by the id among speeches of one date
    speeches = table(spark, d, "speeches").select("speech_id", "text", "Date")
    pipe = TonePipeline(spark, speeches, table(spark, d, "lexicon"), "text", "Date", path, order_by=["date", "speech_id"])
    pipe.run({"tokenize": True}, ["tone_a"], export_results=True)
    return readers.read_file(spark, f"{path}/{name}.parquet")


@query("export_cleaned", EXPORTS_SQL + "SELECT speech_id, id_text, text_clean, text_tokens_str FROM s")
def export_cleaned(spark, d):
    return _exported(spark, d, "cleaned").select("speech_id", "id_text", "text_clean", "text_tokens_str")


@query("export_lexical", EXPORTS_SQL + "SELECT id_text, p AS tone_a_counttoken_positive_posneg, n AS tone_a_counttoken_negative_posneg, total AS tone_a_counttoken_total_allwords, tone_a_sentiment_posneg, tone_a_sentiment_allwords FROM s WHERE text IS NOT NULL")
def export_lexical(spark, d):
    return _exported(spark, d, "sentiment_lexical").select("id_text", "tone_a_counttoken_positive_posneg", "tone_a_counttoken_negative_posneg", "tone_a_counttoken_total_allwords", "tone_a_sentiment_posneg", "tone_a_sentiment_allwords")


@query("combined_export", EXPORTS_SQL + "SELECT speech_id, id_text, text_clean, text_tokens_str, tone_a_sentiment_posneg, tone_a_sentiment_allwords FROM s")
def combined_export(spark, d):
    """Cleaned speeches with their scores; those without text have null scores."""
    return _exported(spark, d, "sentiment_all_results").select("speech_id", "id_text", "text_clean", "text_tokens_str", "tone_a_sentiment_posneg", "tone_a_sentiment_allwords")


# Sources and sinks --------------------------------------------------------------------------------------------------


@query("csv_corpus", "SELECT statement_id, text, date FROM statements")
def csv_corpus(spark, d):
    """Statements written as CSV under other column names, and loaded as a corpus."""
    path = new_path(spark, "statements") + ".csv"
    sinks.write_csv(table(spark, d, "statements").select("statement_id", F.col("text").alias("body"), F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("published")), path)
    return readers.load_corpus(spark, path, "body", "published", "statement_id bigint, body string, published string").select("statement_id", "text", "date")


@query("parquet_corpus", 'SELECT speech_id, text, "Date" AS date FROM speeches')
def parquet_corpus(spark, d):
    path = new_path(spark, "speeches") + ".parquet.gzip"
    sinks.write_parquet(table(spark, d, "speeches").select("speech_id", F.col("text").alias("body"), F.col("Date").alias("published")), path)
    return readers.load_corpus(spark, path, "body", "published").select("speech_id", "text", "date")


@query("partitioned_folders", r"""SELECT speech_id, "CentralBank", lower(regexp_replace(regexp_replace("CentralBank", '[<>:"/\\|?*\s]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g')) AS file_key FROM speeches WHERE "CentralBank" IS NOT NULL""")
def partitioned_folders(spark, d):
    """One folder for each bank, read again as one table."""
    path = new_path(spark, "banks")
    sinks.write_partitioned(table(spark, d, "speeches").select("speech_id", "CentralBank", "text"), path)
    return readers.read_folder(spark, path).select("speech_id", F.col("CentralBank").cast("string").alias("CentralBank"), "file_key")


@query("scores_csv", f"WITH {_hits_sql('speeches', 'speech_id', 'tone_a')} SELECT speech_id, p AS positive, n AS negative, {POSNEG} AS sentiment FROM s")
def scores_csv(spark, d):
    """Scores exported as CSV, with word maps as JSON, and read again."""
    path = new_path(spark, "scores") + ".csv"
    scored = sc.score(readers.with_text(table(spark, d, "speeches").select("speech_id", "text")), table(spark, d, "lexicon"), ["tone_a"], ["posneg"]).drop("text")
    sinks.write_csv(scored, path)
    back = readers.read_file(spark, path, ", ".join(f"{c} {'string' if kind.startswith('map') else kind}" for c, kind in scored.dtypes))
    return back.select("speech_id", F.col("tone_a_counttoken_positive_posneg").alias("positive"), F.col("tone_a_counttoken_negative_posneg").alias("negative"), F.col("tone_a_sentiment_posneg").alias("sentiment"))


@query("lexicon_lists", "SELECT dictionary, polarity, term FROM lexicon")
def lexicon_lists(spark, d):
    """The lexicon as nested lists, as in its YAML file, and as a table again."""
    spec: dict = {}
    for r in sorted(sc.lexicon_rows(table(spark, d, "lexicon")) or [], key=lambda r: r["pos"]):
        spec.setdefault(r["dictionary"], {}).setdefault(r["polarity"], []).append(r["term"])
    return readers.checked_lexicon(spark.createDataFrame(readers.flatten_lexicon(spec), readers.LEXICON)).select("dictionary", "polarity", "term")


@query("bank_names", 'SELECT count(DISTINCT "CentralBank")::BIGINT AS banks, 1::BIGINT AS probed FROM speeches')
def bank_names(spark, d):
    """Banks of the table, and whether the probe of one value gives one of them."""
    speeches = table(spark, d, "speeches").where(F.col("CentralBank").isNotNull())
    probe = readers.partition_probe(speeches).select(F.col("CentralBank").alias("one"))
    return sm.distinct_count(speeches, "CentralBank").withColumnRenamed("n", "banks").crossJoin(F.broadcast(probe)).select("banks", F.col("one").isNotNull().cast("bigint").alias("probed"))


# Streams ------------------------------------------------------------------------------------------------------------


@query("stream_windowed_events", """SELECT date_trunc('hour', ts) AS start, event_type AS kind, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY ALL""")
def stream_windowed_events(spark, d):
    """Tumbling windows over the events as a stream, drained once: those that the watermark has closed."""
    stream = live.read_stream(spark, d, table(spark, d, "events").schema, "events.parquet")
    rows = live.drain(live.windowed_events(stream))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n", F.round("total", 4).alias("total"))


@query("stream_scores", SQL["posneg_table_lexicon"])
def stream_scores(spark, d):
    """Statements scored as a stream."""
    stream = live.read_stream(spark, d, table(spark, d, "statements").schema, "statements.parquet").where("text IS NOT NULL")
    scored = sc.score(stream, table(spark, d, "lexicon"), ["tone_a"], ["posneg"], maps=False)
    return live.drain(scored.select("statement_id", F.col("tone_a_counttoken_positive_posneg").alias("positive"), F.col("tone_a_counttoken_negative_posneg").alias("negative"), F.col("tone_a_sentiment_posneg").alias("sentiment")))
