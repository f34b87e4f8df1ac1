"""Summaries of corpora and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_counts(df: DataFrame, group: str) -> DataFrame:
    """``group, count``; null groups are left out."""
    return df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "group")


def text_stats(df: DataFrame, group: str, text_column: str = "text") -> DataFrame:
    """``group, mean, min, max, count`` of text lengths in characters; null groups are left out, null texts not counted."""
    n = F.length(text_column)
    return df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(F.bround(F.avg(n), 2).alias("mean"), F.min(n).alias("min"), F.max(n).alias("max"), F.count(n).alias("count"))


def time_span(df: DataFrame, date_column: str = "date") -> DataFrame:
    """``metric, value``: start_date, end_date, total_days (whole days between) and total_records."""
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    one = df.agg(F.min(date_column).alias("a"), F.max(date_column).alias("b"), F.count(F.lit(1)).alias("n"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    days = F.floor((seconds(F.col("b")) - seconds(F.col("a"))) / 86400)
    cells = [F.struct(F.lit(k).alias("metric"), v.cast("string").alias("value")) for k, v in (("start_date", day("a")), ("end_date", day("b")), ("total_days", days), ("total_records", F.col("n")))]
    return one.select(F.inline(F.array(*cells)))


def date_ranges(df: DataFrame, group: str, date_column: str = "date") -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(day(F.min(date_column)).alias("start_date"), day(F.max(date_column)).alias("end_date"))


def summary(df: DataFrame, group: str, text_column: str = "text", date_column: str = "date") -> tuple | None:
    """(counts, text stats, time span, date ranges); None for an empty table, ValueError for an unknown group."""
    if group not in df.columns:
        raise ValueError(f"Group column '{group}' isn't in the data")
    if df.isEmpty():
        return None
    return group_counts(df, group), text_stats(df, group, text_column), time_span(df, date_column), date_ranges(df, group, date_column)


#: Ranks are off by one in so many rows at most in the sketch that bounds the quartiles; a row in so many is then ranked.
ACCURACY = 10_000
QUARTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, count, mean, std, min, p25, p50, p75, max``; exact percentiles, linear between ranks.

    Two passes for all columns. The first gives the moments and, by a sketch of known error, bounds around each
    quartile; the second counts the values below the bounds and ranks those between them, a few in
    ``ACCURACY``, combined by value first, so no task holds all values. Nulls and NaN are left out.
    """
    values = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    near = [min(1.0, max(0.0, q + e)) for q in QUARTILES for e in (-4 / ACCURACY, 4 / ACCURACY)]
    aggs = []
    for c in columns:
        v = values[c]
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.percentile_approx(v, near, ACCURACY).alias("near")))
    # one row of bounds for each column
    stats = [r for r in df.agg(F.array(*aggs).alias("r")).select(F.inline("r")).collect()]
    cells = []
    for r in stats:
        for i in range(len(QUARTILES) if r["count"] else 0):
            low, high = r["near"][2 * i], r["near"][2 * i + 1]
            # the sketch's error is less than a rank there
            low, high = (r["min"], r["max"]) if r["count"] < ACCURACY else (low, high)
            v = values[r["column"]]
            cells.append(F.when(v <= high, F.struct(F.lit(r["column"]).alias("column"), F.lit(i).alias("q"), F.when(v >= low, v).alias("v"))))
    kind = "column string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double"
    if not cells:
        return df.sparkSession.createDataFrame([(r["column"], 0, None, None, None, None, None, None, None) for r in stats], kind)
    counts = df.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).groupBy("x.column", "x.q", "x.v").agg(F.count(F.lit(1)).alias("n"))
    # values below the bounds come first, as one null
    window = Window.partitionBy("column", "q").orderBy(F.col("v").asc_nulls_first())
    ranked = counts.withColumn("upto", F.sum("n").over(window))
    place = F.lit(None).cast("double")
    for r in stats:
        for i, q in enumerate(QUARTILES):
            place = F.when((F.col("column") == r["column"]) & (F.col("q") == i), F.lit(q * max(0, r["count"] - 1))).otherwise(place)
    at = ranked.withColumn("place", place)
    pick = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    found = at.groupBy("column", "q").agg(pick(F.floor("place")).alias("a"), pick(F.ceil("place")).alias("b"), F.first("place").alias("place"))
    part = F.col("place") - F.floor("place")
    found = found.select("column", "q", (F.col("a") + (F.col("b") - F.col("a")) * part).alias("value"))
    wide = found.groupBy("column").agg(*[F.max(F.when(F.col("q") == i, F.col("value"))).alias(p) for i, p in enumerate(("p25", "p50", "p75"))])
    base = df.sparkSession.createDataFrame([(r["column"], r["count"], r["mean"], r["std"], r["min"], r["max"]) for r in stats], "column string, count long, mean double, std double, min double, max double")
    return base.join(wide, "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``bin, low, high, n``: equal widths between the least and largest value, the largest in the last bin; empty
    bins have 0, nulls are left out. All values equal: width 1 around them."""
    v = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    ends = v.agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a IS NOT NULL").select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    # one row of ends: a side of proven size
    counted = v.join(F.broadcast(ends)).select(F.least(F.floor((F.col("v") - F.col("a")) / ((F.col("b") - F.col("a")) / bins)), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "a", "b")
    width = (F.col("b") - F.col("a")) / bins
    return grid.join(counted, "bin", "left").select("bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def column_means(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in columns])


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.countDistinct(column).alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
