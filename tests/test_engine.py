import datetime
import os

import pytest
from pyspark.sql import functions as F

import tonelens
from tonelens.config import default_params_path, load_yaml, package_path
from tonelens.errors import ConfigError, LoadError, ScoreError
from tonelens.operators import series, summary
from tonelens.operators.ids import dense_ids
from tonelens.operators.preview import TextPreview, map_codes, union_by_name
from tonelens.operators.score import add_method, map_text, score, score_hits, score_prefix, term_hits
from tonelens.plans.banks import download, prepare, score_banks, to_partitions
from tonelens.plans.pipeline import TonePipeline
from tonelens.sources import readers, sinks
from tonelens.sources.shared import shared_dir, written
from tonelens.streaming import live

TERMS = [("d", "positive", "gain", 1), ("d", "positive", "high-low", 2), ("d", "negative", "loss", 3), ("d", "negative", "against", 4), ("d", "neutral", "rate", 5), ("e", "positive", "loss", 1), ("s", "positive", "increas", 1)]
ROWS = [(1, "Gain gain, loss! The RATE of a gain_x", "a"), (2, None, "a"), (3, "", "b"), (4, "the of and", "b"), (5, "against against", None)]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(TERMS, readers.LEXICON)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(ROWS, "id long, text string, g string")


def test_scores(corpus, lexicon):
    got = {r.id: r for r in score(corpus, lexicon, ["d", "e"]).collect()}
    one = got[1]
    assert (one.d_counttoken_positive_posneg, one.d_counttoken_negative_posneg, one.d_counttoken_total_allwords) == (2, 1, 5)
    assert one.d_sentiment_posneg == pytest.approx(1 + 1 / 3) and one.d_sentiment_allwords == pytest.approx(1 + 1 / 5)
    assert one.d_words_positive_posneg == {"gain": 2} and one.d_words_negative_posneg == {"loss": 1} and one.e_words_positive_posneg == {"loss": 1}
    assert got[2].d_sentiment_posneg is None and got[2].d_words_positive_posneg is None
    assert got[3].d_sentiment_posneg == got[3].d_sentiment_allwords == got[4].d_sentiment_allwords == 1.0 and got[3].d_words_positive_posneg == {}
    # a stop word counts as a hit and not as a word
    assert got[5].d_sentiment_posneg == 0.0 and got[5].d_sentiment_allwords == 1.0 and got[5].d_counttoken_negative_posneg == 2


def test_score_columns_and_errors(corpus, lexicon):
    names = [c for c in score(corpus, lexicon, ["s"], ["posneg"], suffix="_stem").columns if c not in corpus.columns]
    assert names == ["s_counttoken_positive_posneg_stem", "s_counttoken_negative_posneg_stem", "s_words_positive_posneg_stem", "s_words_negative_posneg_stem", "s_sentiment_posneg_stem"]
    assert not [c for c in score(corpus, lexicon, ["d"], ["other"]).columns if "sentiment" in c]
    with pytest.raises(KeyError):
        score(corpus, lexicon, ["nope"])
    with pytest.raises(ValueError):
        score(corpus.withColumn("d_sentiment_posneg", F.lit(1)), lexicon, ["d"])


def test_long_form_agrees_with_wide(corpus, lexicon):
    wide = {r.id: (r.d_counttoken_positive_posneg, r.d_counttoken_negative_posneg) for r in score(corpus, lexicon, ["d"]).collect()}
    long = {r.id: (r.positive, r.negative) for r in score_hits(term_hits(corpus, lexicon, "id"), "id").where("dictionary = 'd'").collect()}
    assert long == {k: v for k, v in wide.items() if v[0] or k in (1, 5)}
    assert score(corpus, lexicon, ["d"]).where("id = 1").select(map_text(F.col("d_words_positive_posneg"))).first()[0] == "gain:2"


def test_large_lexicons_by_join(spark, corpus, lexicon, monkeypatch):
    want = score(corpus, lexicon, ["d", "e"])
    monkeypatch.setattr("tonelens.operators.score.MOST_TERMS", 3)
    with pytest.raises(ScoreError, match="id_column"):
        score(corpus, lexicon, ["d"])
    with pytest.raises(KeyError):
        score(corpus, lexicon, ["nope"], id_column="id")
    got = score(corpus, lexicon, ["d", "e"], id_column="id")
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    rows = TonePipeline(spark, corpus.select(F.col("text"), F.lit("2024-01-01").alias("date")), lexicon).run({"tokenize": True}, ["d"])[2]
    assert rows.count() == 4 and rows.where("d_sentiment_posneg > 1").count() == 1


def test_methods_can_be_added(corpus, lexicon, caplog):
    add_method("difference", lambda p, n, total: (p - n).cast("double"))
    got = {r.id: r.d_sentiment_difference for r in score(corpus, lexicon, ["d"], ["difference"]).collect()}
    assert got == {1: 1.0, 2: None, 3: 0.0, 4: 0.0, 5: -2.0}
    score(corpus, lexicon, ["d"], ["no such method"])
    assert "no such method" in caplog.text


def test_prefix(spark, lexicon):
    df = spark.createDataFrame([("increase increasing creas",)], "text string")
    assert score_prefix(df, lexicon, "s").first().positive == 2


def test_lexicon_checks(spark, tmp_path):
    (tmp_path / "l.yaml").write_text("d:\n  positive: [up, 'False']\n  negative: [down]\n")
    assert [tuple(r) for r in readers.load_lexicon(spark, str(tmp_path / "l.yaml")).orderBy("pos").collect()] == [("d", "positive", "up", 1), ("d", "positive", "False", 2), ("d", "negative", "down", 3)]
    with pytest.raises(ConfigError, match="more than once"):
        readers.checked_lexicon(spark.createDataFrame([("d", "positive", "x", 1), ("d", "negative", "x", 2)], readers.LEXICON))
    (tmp_path / "bad.yaml").write_text("a: [")
    with pytest.raises(ConfigError):
        load_yaml(str(tmp_path / "bad.yaml"))
    with pytest.raises(FileNotFoundError):
        load_yaml(str(tmp_path / "none.yaml"))


def test_loader(spark, tmp_path):
    (tmp_path / "c.csv").write_text('body,published,more\n"He said ""up"",\nyes",2024-07-31,1\nb,2024-09-18,2\n')
    df = readers.load_corpus(spark, str(tmp_path / "c.csv"), "body", "published")
    assert dict(df.dtypes)["date"] == "timestamp_ntz" and {"text", "date", "more"} == set(df.columns)
    assert sorted(r.text for r in df.collect()) == ['He said "up",\nyes', "b"]
    with pytest.raises(ValueError, match="Text column"):
        readers.load_corpus(spark, str(tmp_path / "c.csv"), "nope", "published")
    with pytest.raises(ValueError, match="Date column"):
        readers.load_corpus(spark, str(tmp_path / "c.csv"), "body", "nope")
    with pytest.raises(ValueError, match="Unsupported file format"):
        readers.load_corpus(spark, "x.jsonl")
    with pytest.raises(ValueError, match="Error converting date"):
        readers.standardized(spark.createDataFrame([("a", "not a day")], "text string, date string"))
    df.write.parquet(str(tmp_path / "c.parquet.gzip"))
    assert readers.load_corpus(spark, str(tmp_path / "c.parquet.gzip")).count() == 2
    with pytest.raises((LoadError, FileNotFoundError)):
        readers.read_file(spark, str(tmp_path / "c.xlsx"))


def test_folders(spark, corpus, tmp_path):
    corpus.where("id < 3").write.parquet(str(tmp_path / "f" / "a"))
    corpus.where("id > 2").drop("g").write.parquet(str(tmp_path / "f" / "b"))
    df = readers.read_folder(spark, str(tmp_path / "f"), recursive=True)
    assert df.count() == 5 and set(df.columns) == {"id", "text", "g"} and readers.partition_probe(df, "id").count() == 1
    with pytest.raises(LoadError):
        readers.read_folder(spark, str(tmp_path / "f"), "*.orc", recursive=True)
    with pytest.raises(LoadError):
        readers.read_folder(spark, str(tmp_path / "none"))


def test_command_line(spark, lexicon, tmp_path, capsys):
    from tonelens import cli

    assert cli.main(["--test"]) == 0 and "demo_sentiment_posneg" in capsys.readouterr().out
    (tmp_path / "in.csv").write_text("body,day\nA gain and a loss.,2024-01-01\nA gain.,2024-01-02\n")
    lexicon.write.parquet(str(tmp_path / "lexicon.parquet"))
    (tmp_path / "params.yaml").write_text(f"""
input: {{file_path: {tmp_path}/in.csv, text_column: body, date_column: day}}
output: {{export_path: {tmp_path}/out, export_results: true}}
models: {{lexical: {{lexicon_path: {tmp_path}/lexicon.parquet, dictionaries: {{unstemmed: [d], stemmed: [s]}}, aggregation_methods: [posneg]}}}}
cleaning: {{tokenize: true, stem: true}}
""")
    assert cli.main(["--config", str(tmp_path / "params.yaml")]) == 0
    rows = spark.read.parquet(str(tmp_path / "out/sentiment_all_results.parquet")).orderBy("id_text").collect()
    assert [(r.id_text, r.d_sentiment_posneg, r.s_sentiment_posneg_stem) for r in rows] == [(1, 1.0, 1.0), (2, 2.0, 1.0)]


def test_filters(corpus):
    assert {r.id for r in readers.with_text(corpus).collect()} == {1, 3, 4, 5}
    assert {r.id for r in readers.with_nonblank_text(corpus).collect()} == {1, 4, 5}


def test_pipeline(spark, lexicon, tmp_path):
    source = spark.createDataFrame([("Rates <b>increased</b>; a gain.", "2024-01-02", "x"), (None, "2024-01-01", "y")], "body string, day string, film string")
    pipe = TonePipeline(spark, source, lexicon, "body", "day", str(tmp_path / "out"))
    raw, cleaned, scored = pipe.run({"stem": True}, {"unstemmed": ["d"], "stemmed": ["s"]}, export_results=True)
    assert raw.count() == cleaned.count() == 2 and scored.count() == 1
    row = scored.first()
    assert row.id_text == 2 and row.d_sentiment_posneg == 2.0 and row.s_sentiment_posneg_stem == 2.0 and row.film == "x"
    out = spark.read.parquet(str(tmp_path / "out/sentiment_all_results.parquet"))
    assert out.count() == 2 and "text" not in out.columns and "d_counttoken_positive_posneg" not in out.columns
    assert out.where("id_text = 1").first().d_sentiment_posneg is None
    assert "film" not in spark.read.parquet(str(tmp_path / "out/sentiment_lexical.parquet")).columns
    assert TonePipeline(spark, source, lexicon, "body", "day").run({}, {"unstemmed": [], "stemmed": []})[2] is None
    with pytest.raises(ScoreError, match="tokenize"):
        TonePipeline(spark, source, lexicon, "body", "day").run({}, ["d"])
    with pytest.raises(LoadError):
        TonePipeline(spark, source, lexicon, "nope", "day").load()


def test_sinks(spark, corpus, lexicon, tmp_path):
    sinks.write_partitioned(corpus, str(tmp_path / "p"), "g")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    sinks.write_csv(score(corpus, lexicon, ["d"]), str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 5
    with pytest.raises(ScoreError):
        sinks.write_csv(None, "x")


@pytest.mark.parametrize("rows", [1, 100])
def test_dense_ids_over_ranges(spark, rows):
    df = spark.range(0, 1000).withColumn("g", F.col("id") % 3).withColumn("id", F.when(F.col("id") > 990, None).otherwise(F.col("id") % 400))
    got = dense_ids(df, ["id", "g"], "n", range_keys=rows if rows > 1 else 10**6)
    assert sorted(r.n for r in got.collect()) == list(range(1, 1001))
    ordered = [r.id for r in got.orderBy("n").collect()]
    assert ordered == sorted(ordered, key=lambda x: (x is not None, x))
    per = dense_ids(df, ["id"], "n", "g", range_keys=rows if rows > 1 else 10**6)
    assert all(sorted(r.n for r in part) == list(range(1, len(part) + 1)) for part in ([r for r in per.collect() if r.g == g] for g in range(3)))


def test_dense_ids_by_text(spark):
    words = [None, "", "a", "ab", "zoë", "Ж", "a" * 9, "😀", "b", "a" * 8 + "b"] * 30
    got = dense_ids(spark.createDataFrame([(w,) for w in words], "w string"), "w", "n", range_keys=20).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, len(words) + 1))
    assert [r.w for r in got] == sorted(words, key=lambda w: (w is not None, (w or "").encode()))
    with pytest.raises(ValueError):
        dense_ids(spark.range(1).select(F.array("id").alias("a")), "a", "n")


def test_summary(spark):
    df = spark.createDataFrame([("a", "xx", datetime.datetime(2024, 1, 1)), ("a", "xxx", datetime.datetime(2024, 1, 3, 12)), ("b", None, None), (None, "x", datetime.datetime(2023, 1, 1))], "g string, text string, date timestamp_ntz")
    counts, stats, span, ranges = summary.summary(df, "g")
    assert [tuple(r) for r in counts.collect()] == [("a", 2), ("b", 1)]
    assert {tuple(r) for r in stats.collect()} == {("a", 2.5, 2, 3, 2), ("b", None, None, None, 0)}
    assert dict(map(tuple, span.collect())) == {"start_date": "2023-01-01", "end_date": "2024-01-03", "total_days": "367", "total_records": "4"}
    assert ("a", "2024-01-01", "2024-01-03") in {tuple(r) for r in ranges.collect()}
    assert summary.summary(df.limit(0), "g") is None
    with pytest.raises(ValueError):
        summary.summary(df, "nope")


def test_histogram_and_describe(spark):
    df = spark.createDataFrame([(float(i),) for i in range(31)] + [(None,)], "v double")
    rows = summary.histogram(df, "v", 30).orderBy("bin").collect()
    assert len(rows) == 30 and sum(r.n for r in rows) == 31 and rows[-1].n == 2 and rows[0].low == 0
    assert sum(r.n for r in summary.histogram(df.where("v = 3"), "v", 5).collect()) == 1
    assert summary.histogram(df.limit(0), "v").count() == 0
    d = summary.describe(df, ["v"]).first()
    assert (d["count"], d.mean, d.p25, d.p50, d.max) == (31, 15.0, 7.5, 15.0, 30.0)


@pytest.mark.parametrize("kind", ["spread", "ties"])
def test_quartiles_between_bounds(spark, monkeypatch, kind):
    """Exact quartiles where the sketch gives bounds only, also with a third of all rows alike."""
    monkeypatch.setattr(summary, "ACCURACY", 50)
    df = spark.range(2000).select(((F.col("id") * 7919) % 2003 / 7.0).alias("v"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id").cast("double")).alias("w"))
    if kind == "ties":
        df = df.withColumn("v", F.when(F.col("v") < 100, 42.0).otherwise(F.col("v")))
    rows = {r.column: r for r in summary.describe(df, ["v", "w"]).collect()}
    for c in ("v", "w"):
        want = df.select(F.percentile(c, [0.25, 0.5, 0.75])).first()[0]
        assert [rows[c].p25, rows[c].p50, rows[c].p75] == pytest.approx(want)
    assert summary.describe(df.limit(0), ["v"]).first()["count"] == 0


def test_series(spark):
    days = ["2024-01-05", "2024-01-06", "2024-04-01", "2024-05-01", "2024-06-30"]
    df = spark.createDataFrame([(datetime.date.fromisoformat(d), float(i)) for i, d in enumerate(days)] + [(None, 9.0)], "d date, v double")
    months = series.monthly_mean(df, "d", "v")
    assert [(str(r.month), r.value) for r in months.orderBy("month").collect()] == [("2024-01-31", 0.5), ("2024-02-29", None), ("2024-03-31", None), ("2024-04-30", 2.0), ("2024-05-31", 3.0), ("2024-06-30", 4.0)]
    rolled = months.withColumn("strict", series.trailing("value", "month", 3)).withColumn("lenient", series.trailing("value", "month", 3, 1)).orderBy("month").collect()
    assert [r.strict for r in rolled] == [None] * 5 + [3.0] and rolled[2].lenient == 0.5 and rolled[3].lenient == 2.0
    assert series.monthly_mean(df.limit(0), "d", "v").count() == 0


def test_previews_and_maps(spark):
    df = spark.createDataFrame([(1, "x" * 600, datetime.datetime(2024, 1, 1), "XAA")], "id int, text string, date timestamp_ntz, c string")
    view = TextPreview(df, "text", "date", "id")
    assert len(view.previews().first().preview) == 500 and view.compare(1).first().title == "2024-01-01"
    assert tuple(view.compare(2).first()) == ("Error: Text ID '2' not found", "", "")
    with pytest.raises(TypeError):
        TextPreview([], "text", "date")
    with pytest.raises(ValueError):
        TextPreview(df, "nope", "date")
    codes = spark.createDataFrame([("XAA", "XA"), ("XAA", "XA")], "iso3 string, iso2 string")
    assert [r.iso2 for r in map_codes(df, "c", codes, "iso3", "iso2", "iso2").collect()] == ["XA"]
    assert union_by_name(df, df.drop("c")).where("c IS NULL").count() == 1


def test_banks(spark, sf):
    lex = spark.read.parquet(f"{sf}/lexicon.parquet")
    out = score_banks(spark, spark.read.parquet(f"{sf}/speeches.parquet"), spark.read.parquet(f"{sf}/iso_map.parquet"), lex, {"tokenize": True}, ["tone_a"])
    rows = out.select("CentralBank", "id_text", "tone_a_sentiment_posneg").collect()
    by_bank = {}
    for r in rows:
        by_bank.setdefault(r.CentralBank, []).append(r.id_text)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by_bank.values()) and all(0 <= r.tone_a_sentiment_posneg <= 2 for r in rows)


def test_streams(spark, sf, lexicon):
    docs = spark.read.parquet(f"{sf}/statements.parquet")
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", "statements.parquet").parquet(sf)
    got = live.drain(live.score_stream(stream, lexicon, ["d"]).select("statement_id", "d_sentiment_posneg"))
    assert got.count() == docs.count()


def test_stream_goes_on_where_it_ended_and_drops_what_is_late(spark, tmp_path):
    def put(name, *hours):
        day = datetime.datetime(2024, 1, 1)
        spark.createDataFrame([(day + datetime.timedelta(hours=h), "a", 1.0) for h in hours], "ts timestamp_ntz, event_type string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put("one", 0, 0.5, 3, 9)
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    drained = lambda: live.drain(live.windowed_events(live.read_stream(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {(r.start.hour, r.n) for r in drained().collect()} == {(0, 2), (3, 1)}
    put("two", 1, 8.5, 20)  # the first is late by more than two hours
    assert {(r.start.hour, r.n) for r in drained().collect()} == {(0, 2), (3, 1), (8, 1), (9, 1)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_shuffles_nothing_and_reads_only_its_columns(spark, sf):
    speeches, lex = spark.read.parquet(f"{sf}/speeches.parquet"), spark.read.parquet(f"{sf}/lexicon.parquet")
    scored = plan(score(speeches.select("speech_id", "text"), lex, ["tone_a", "tone_b"]).select("speech_id", "tone_a_sentiment_allwords"))
    assert "Exchange" not in scored and "Join" not in scored and "ReadSchema: struct<speech_id:bigint,text:string>" in scored
    long = plan(term_hits(speeches, lex, "speech_id"))
    assert "BroadcastHashJoin" in long and "CartesianProduct" not in long


def test_bank_filter_is_pushed_down(spark, sf, tmp_path):
    speeches, iso = spark.read.parquet(f"{sf}/speeches.parquet"), spark.read.parquet(f"{sf}/iso_map.parquet")
    assert "EqualTo(CentralBank,Bank of Siamel)" in plan(prepare(speeches, iso, "Bank of Siamel"))
    sinks.write_partitioned(speeches, str(tmp_path / "p"))
    assert "PartitionFilters: [isnotnull(CentralBank" in plan(prepare(spark.read.parquet(str(tmp_path / "p")), iso, "Bank of Siamel"))


def test_download_keeps_what_is_there(tmp_path):
    source, target = tmp_path / "a.csv", tmp_path / "d/b.csv"
    source.write_text("x")
    assert download(source.as_uri(), str(target)) == str(target) and target.read_text() == "x"
    source.write_text("y")
    assert open(download(source.as_uri(), str(target))).read() == "x"


def test_downloaded_file_to_bank_folders(spark, tmp_path):
    (tmp_path / "all.csv").write_text('CentralBank,text,Date\n"Bank of A","One, ""two""\nthree",2024-01-01\n,lost,2024-01-01\nBank: B,four,2024-01-02\n')
    path = download((tmp_path / "all.csv").as_uri(), str(tmp_path / "got" / "all.csv"))
    assert to_partitions(spark, path, str(tmp_path / "banks"), "CentralBank string, text string, Date string").count() == 3
    rows = readers.read_folder(spark, str(tmp_path / "banks")).collect()
    assert {(r.CentralBank, r.text, r.file_key) for r in rows} == {("Bank of A", 'One, "two"\nthree', "bank_of_a"), ("Bank: B", "four", "bank_b")}


def test_paths(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert default_params_path() == str(tmp_path / "params.yaml") and os.path.exists(package_path("config.py"))


def test_csv_keeps_texts_as_they_are(spark, tmp_path):
    texts = ["a, b", 'he said "x"', " lead", "trail ", "two\nlines", "", None, "back\\slash", "ümlaut"]
    sinks.write_csv(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), str(tmp_path / "t.csv"))
    assert {r.i: r.t for r in readers.read_file(spark, str(tmp_path / "t.csv"), "i int, t string").collect()} == {i: t or None for i, t in enumerate(texts)}


def test_shared_folder_is_asked_for_on_a_cluster(spark, tmp_path, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://shared/"}
    assert shared_dir(Session()) == "hdfs://shared"
    df = written(spark.range(3), "three")
    assert df.count() == 3 and df.columns == ["id"]


def test_row_numbers_sort_no_texts(spark, sf):
    """The text is shuffled once, to meet its number, and no window or sort without partitions sees it."""
    numbered = plan(dense_ids(spark.read.parquet(f"{sf}/speeches.parquet").select("speech_id", "text", "Date"), ["Date", "speech_id"], "n"))
    assert "SinglePartition" not in "".join(x for x in numbered.split("\n") if "text" in x)
    assert sum("Exchange" in x and "text#" in x for x in numbered.split("\n")) <= 1


def test_names():
    assert tonelens.__version__ and all(getattr(tonelens, n) for n in tonelens.__all__)


def test_exports_clean_the_rows_once(spark, tmp_path):
    """What is scored and exported after the cleaned rows is made from their export, not from the texts once more."""
    source = spark.createDataFrame([("Growth improved.", "2024-01-01"), (None, None), ("Loss of growth", "2024-01-01")], "body string, day string")
    lexicon = spark.createDataFrame([("d", "positive", "growth", 1), ("d", "negative", "loss", 2)], "dictionary string, polarity string, term string, pos int")
    pipe = TonePipeline(spark, source, lexicon, "body", "day", str(tmp_path / "out"), order_by=["date", "text"])
    _, cleaned, scored = pipe.run({"tokenize": True}, ["d"], export_results=True)
    for df in (cleaned, scored, pipe.full):
        shown = df._jdf.queryExecution().toString()
        assert "ArrowEvalPython" not in shown and "Exchange" not in shown
    rows = spark.read.parquet(str(tmp_path / "out" / "sentiment_all_results.parquet")).orderBy("id_text").collect()
    assert [(r.id_text, r.text_clean, r.d_sentiment_posneg) for r in rows] == [(1, None, None), (2, "Growth improved.", 2.0), (3, "Loss of growth", 1.0)]
