"""Corpora, lexicons and maps as DataFrames."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, LoadError
from ..functions.text import is_blank

PARQUET = (".parquet", ".parquet.gzip", ".parquet.gz")
LEXICON = "dictionary string, polarity string, term string, pos int"
POLARITIES = ("positive", "negative", "neutral")


def read_file(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV, Excel or Parquet file or folder, told by its name's end.

    Give CSV files a schema at scale: without one the file is read twice, to infer it.
    """
    if path.endswith(".csv"):
        reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
        return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    if path.endswith((".xlsx", ".xls")):
        import pandas as pd

        try:
            return spark.createDataFrame(pd.read_excel(path))
        except ImportError as e:
            raise LoadError(f"reading {path} needs an Excel reader, which isn't installed: {e}") from e
    if path.endswith(PARQUET):
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported file format: {path}")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer tasks than there are cores, as one small file does.

    What is moved is at most ``spark.sql.files.maxPartitionBytes`` for each core; a scan that fills the cluster by itself
    stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def standardized(df: DataFrame, text_column: str = "text", date_column: str = "date", check_dates: bool = True) -> DataFrame:
    """The same rows with the text as ``text`` and the date, parsed, as ``date``; other columns are kept.

    A column in the way of the new names is an error. check_dates counts unparsable dates, which
    takes a pass over that column; without it they become null.
    """
    for what, name in (("Text", text_column), ("Date", date_column)):
        if name not in df.columns:
            raise ValueError(f"{what} column '{name}' isn't in the data")
    for name, target in ((text_column, "text"), (date_column, "date")):
        if name != target and target in df.columns and target not in (text_column, date_column):
            raise ValueError(f"the data already has a column '{target}'")
    df = df.withColumnsRenamed({text_column: "text", date_column: "date"})
    kind = df.schema["date"].dataType
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return df
    parsed = df.withColumn("date", F.col("date").try_cast("timestamp_ntz"))
    if check_dates:
        bad = df.where(F.col("date").isNotNull() & F.col("date").try_cast("timestamp_ntz").isNull()).limit(1)
        if not bad.isEmpty():
            raise ValueError(f"Error converting date column '{date_column}'")
    return parsed


def load_corpus(spark: SparkSession, path: str, text_column: str = "text", date_column: str = "date", schema=None) -> DataFrame:
    return standardized(read_file(spark, path, schema), text_column, date_column)


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.parquet*", recursive: bool = False) -> DataFrame:
    """Every matching file of a folder as one table, columns by name; LoadError if there is none."""
    try:
        return spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).option("mergeSchema", True).parquet(folder)
    except AnalysisException as e:
        raise LoadError(f"no {pattern} in {folder}: {e}") from e


def partition_probe(df: DataFrame, column: str = "CentralBank") -> DataFrame:
    """One value of a column; only that column is read."""
    return df.select(column).limit(1)


def with_text(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows whose text isn't null."""
    return df.where(F.col(column).isNotNull())


def with_nonblank_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.where(~is_blank(F.col(column)))


def flatten_lexicon(spec: dict) -> list[tuple[str, str, str, int]]:
    """Rows of ``{dictionary: {polarity: [terms]}}``; pos numbers a dictionary's terms in order."""
    rows = []
    for dictionary, lists in spec.items():
        pos = 0
        for polarity in POLARITIES:
            for term in (lists or {}).get(polarity) or []:
                pos += 1
                rows.append((str(dictionary), polarity, str(term), pos))
    return rows


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``dictionary, polarity, term, pos`` from a YAML file of word lists or a Parquet table, checked."""
    if path.endswith((".yaml", ".yml")):
        from ..config import load_yaml

        return checked_lexicon(spark.createDataFrame(flatten_lexicon(load_yaml(path)), LEXICON))
    return checked_lexicon(spark.read.parquet(path).select(*[F.col(c) for c in ("dictionary", "polarity", "term", "pos")]))


def checked_lexicon(lexicon: DataFrame) -> DataFrame:
    """The lexicon itself, unless a term stands twice in one dictionary."""
    twice = lexicon.groupBy("dictionary", "term").count().where("count > 1").limit(1).collect()
    if twice:
        raise ConfigError(f"term '{twice[0]['term']}' stands more than once in dictionary '{twice[0]['dictionary']}'")
    return lexicon


def demo_corpus(spark: SparkSession) -> DataFrame:
    """Two short policy statements, to try things out."""
    rows = [("Growth improved and the labour market supported demand, the board said.", "2024-07-31"), ("Higher rates weakened demand and constrained lending.", "2024-09-18")]
    return spark.createDataFrame(rows, "text string, date string")
