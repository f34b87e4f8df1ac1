"""The per-document operators on streams, and windowed counts of late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean
from ..operators.score import METHODS, score
from ..sources.shared import new_path


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_a_trigger: int = 100) -> DataFrame:
    """The Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).option("pathGlobFilter", pattern).parquet(folder)


def score_stream(stream: DataFrame, lexicon: DataFrame, dictionaries: list[str], methods=METHODS, text_column: str = "text", options: dict | None = None) -> DataFrame:
    """Cleaned and scored rows as they come; stateless, so a restart repeats nothing. Rows bring their own id."""
    cleaned = clean(stream, text_column, options or {"tokenize": True})
    return score(cleaned, lexicon, dictionaries, methods, "text_tokens_str" if "text_tokens_str" in cleaned.columns else "text_clean", text_column)


def windowed_events(events: DataFrame, time_column: str = "ts", kind_column: str = "event_type", value_column: str = "value", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, kind, n, total`` of tumbling windows. In append mode a window comes once the watermark is past its end,
    and its state is dropped; events later than that are left out."""
    stamped = events.withColumn("__t", F.col(time_column).cast("timestamp")).withWatermark("__t", late)
    return stamped.groupBy(F.window("__t", size).alias("w"), F.col(kind_column).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(value_column).alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")


def drain(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there now, appends its rows to a Parquet table and returns that table.

    Table and checkpoint lie in the shared folder unless paths are given; with the same two paths a later
    call goes on where this one ended.
    """
    spark = stream.sparkSession
    path, checkpoint = path or new_path(spark, "stream"), checkpoint or new_path(spark, "checkpoint")
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
