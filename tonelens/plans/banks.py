"""The speeches of many banks in one job: one table, one pass, rows numbered bank by bank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.preview import map_codes
from ..operators.score import METHODS
from ..sources.readers import read_folder, with_nonblank_text
from ..sources.sinks import write_parquet, write_partitioned
from .pipeline import TonePipeline


def prepare(speeches: DataFrame, iso_map: DataFrame, bank: str | None = None, text_column: str = "text") -> DataFrame:
    """Rows with text, of one bank if named (a filter on the partition column, so other files aren't read), with
    ``iso2`` of the country."""
    rows = speeches if bank is None else speeches.where(speeches["CentralBank"] == bank)
    return map_codes(with_nonblank_text(rows, text_column), "Country", iso_map, "iso3", "iso2", "iso2")


def download(url: str, path: str) -> str:
    """The file at an address, fetched to a path once; a file already there is kept."""
    import os
    import urllib.request

    if not os.path.exists(path):
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        urllib.request.urlretrieve(url, path)
    return path


def to_partitions(spark: SparkSession, csv_path: str, folder: str, schema=None) -> DataFrame:
    """A downloaded CSV as one folder for each bank; rows without a bank are left out."""
    from ..sources.readers import read_file

    df = read_file(spark, csv_path, schema)
    write_partitioned(df, folder)
    return df


def score_banks(spark: SparkSession, speeches: DataFrame | str, iso_map: DataFrame, lexicon: DataFrame, options: dict, dictionaries: dict | list, methods=METHODS, bank: str | None = None, out: str | None = None, order_by: str = "speech_id") -> DataFrame:
    """All banks' speeches scored; with ``out`` also written, one merged table. Failures stop the job. order_by: a unique id."""
    table = read_folder(spark, speeches) if isinstance(speeches, str) else speeches
    ready = prepare(table, iso_map, bank).withColumnsRenamed({"Date": "date"})
    pipe = TonePipeline(spark, ready, lexicon, order_by=order_by, partition_by="CentralBank", id_column=order_by)
    pipe.load()
    pipe.clean(options)
    scored = pipe.score(dictionaries, methods)
    if out:
        write_parquet(scored, out)
    return scored
