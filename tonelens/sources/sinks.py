"""Writers. All replace what was there and write Parquet compressed by gzip unless named otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ScoreError
from ..functions.text import sanitize_name, score_columns

NOT_EXPORTED = ("Unnamed: 0", "text")


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").parquet(path)


def write_partitioned(df: DataFrame, path: str, key: str = "CentralBank") -> None:
    """One folder for each value of the key; rows without one are left out. The folder's name keeps the value,
    so values that would be sanitized alike stay apart; ``file_key`` has the sanitized form."""
    rows = df.where(F.col(key).isNotNull()).withColumn("file_key", sanitize_name(F.col(key)))
    rows.write.mode("overwrite").option("compression", "gzip").partitionBy(key).parquet(path)


def write_csv(df: DataFrame | None, path: str) -> None:
    """A folder of CSV files that ``read_file`` reads as they were: quotes doubled, white space kept; maps,
    arrays and structs as JSON. An empty text is read as null, which CSV has no other sign for."""
    if df is None:
        raise ScoreError("there is no result to export yet")
    maps = [c for c, kind in df.dtypes if kind.startswith(("map", "array", "struct"))]
    writer = df.withColumns({c: F.to_json(c) for c in maps}).write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def combined(cleaned: DataFrame, scored: DataFrame | None, key: str = "id_text", complete: bool = False) -> DataFrame:
    """Cleaned columns (without the raw text) and the sentiment scores; rows that weren't scored have null scores.

    complete: scored has every cleaned row with its columns, as ``score`` itself gives, so no join is needed.
    """
    left = cleaned.drop(*NOT_EXPORTED)
    if scored is None:
        return left
    names = [c for c in score_columns(scored.columns) if c not in left.columns]
    if complete:
        return scored.select(*left.columns, *names)
    return left.join(scored.select(key, *names), key, "left")


def export_all(cleaned: DataFrame, scored: DataFrame | None, folder: str, results: bool = True, full: DataFrame | None = None) -> None:
    """``cleaned``, and with results ``sentiment_lexical`` and ``sentiment_all_results``, in a folder. full: the scores of
    all cleaned rows, beside their columns."""
    export_cleaned(cleaned, folder)
    if results and scored is not None:
        export_scores(cleaned, scored, folder, full)


def export_cleaned(cleaned: DataFrame, folder: str) -> DataFrame:
    """``cleaned`` written to a folder, and read again, so what follows doesn't number, clean and tokenize the rows once more."""
    path = f"{folder.rstrip('/')}/cleaned.parquet"
    write_parquet(cleaned, path)
    return cleaned.sparkSession.read.schema(cleaned.schema).parquet(path)


def export_scores(cleaned: DataFrame, scored: DataFrame, folder: str, full: DataFrame | None = None) -> None:
    folder = folder.rstrip("/")
    write_parquet(scored.drop(*[c for c in cleaned.columns if c != "id_text"]), f"{folder}/sentiment_lexical.parquet")
    write_parquet(combined(cleaned, scored if full is None else full, complete=full is not None), f"{folder}/sentiment_all_results.parquet")
