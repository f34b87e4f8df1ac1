"""Looking at single texts, lexicons and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview


class TextPreview:
    """Raw and cleaned text side by side; checks its columns when made."""

    def __init__(self, df: DataFrame, text_column: str, date_column: str, id_column: str | None = None, cleaned_column: str = "text_clean"):
        if not isinstance(df, DataFrame):
            raise TypeError("the data must be a DataFrame")
        if missing := [c for c in (text_column, date_column, id_column) if c and c not in df.columns]:
            raise ValueError(f"columns missing from the data: {', '.join(missing)}")
        self.df, self.text, self.date, self.id, self.cleaned = df, text_column, date_column, id_column, cleaned_column

    def previews(self, n: int = 500) -> DataFrame:
        return self.df.select(*([self.id] if self.id else []), F.col(self.date), preview(F.col(self.text), n).alias("preview"))

    def bounds(self) -> DataFrame:
        return self.df.agg(F.min(self.id).alias("least"), F.max(self.id).alias("largest"))

    def compare(self, text_id) -> DataFrame:
        """``title, original, cleaned`` of one row; of an unknown id a title that says so, and empty texts."""
        cleaned = F.col(self.cleaned) if self.cleaned in self.df.columns else F.lit(None).cast("string")
        row = self.df.where(F.col(self.id) == text_id).select(F.lit(0).alias("__at"), F.date_format(self.date, "yyyy-MM-dd").alias("title"), F.col(self.text).alias("original"), cleaned.alias("cleaned")).limit(1)
        one = self.df.sparkSession.range(1).select(F.lit(0).alias("__one"))
        there = F.col("__at").isNotNull()
        title = F.when(there, F.col("title")).otherwise(F.lit(f"Error: Text ID '{text_id}' not found"))
        return one.join(row, F.col("__one") == F.col("__at"), "left").select(title.alias("title"), *[F.when(there, F.col(c)).otherwise(F.lit("")).alias(c) for c in ("original", "cleaned")])


def columns_from(df: DataFrame, first: str) -> DataFrame:
    return df.select(*df.columns[df.columns.index(first) :])


def lexicon_sizes(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("dictionary", "polarity").agg(F.count(F.lit(1)).alias("terms"))


def lexicon_preview(lexicon: DataFrame, n: int = 10) -> DataFrame:
    """The first terms of every list, in its order, as one text."""
    lists = lexicon.groupBy("dictionary", "polarity").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("all"))
    return lists.select("dictionary", "polarity", F.array_join(F.transform(F.slice("all", 1, n), lambda x: x["term"]), " ").alias("first_terms"), F.size("all").alias("terms"))


def map_codes(df: DataFrame, column: str, codes: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the code's value in the map, null where it has none. Spark sends a small map to all tasks."""
    pairs = codes.select(F.col(key).alias("__key"), F.col(value).alias(name)).dropDuplicates(["__key"])
    return df.join(pairs, F.col(column) == F.col("__key"), "left").drop("__key")


def union_by_name(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
