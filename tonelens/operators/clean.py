"""The cleaner: text in, cleaned text, tokens and stems out; a narrow stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CleanConfig
from ..functions import text as t
from ..functions.arrow import stems_udf, to_ascii_udf, treebank_tokens_udf
from .ids import dense_ids


def clean_expression(c: Column, config: CleanConfig) -> Column:
    """The cleaning steps in their fixed order. Null stays null, blank text becomes empty."""
    out = c
    if config.fix_encoding:
        out = t.fix_encoding(out)
    if config.normalize_unicode:
        out = to_ascii_udf(out)
    if config.clean_html:
        out = t.strip_tags(out)
    if config.standardize_quotes:
        out = t.standardize_quotes(out)
    if config.clean_numbers_percentages:
        out = t.numbers_and_percentages(out)
    if config.remove_extra_punctuation:
        out = t.collapse_punctuation(out)
    if config.normalize_whitespace:
        out = t.normalize_whitespace(out)
    out = t.remove_header(out, config.header_patterns)
    out = t.remove_footer(out, config.footer_patterns)
    return F.when(c.isNull(), None).when(t.is_blank(c), F.lit("")).otherwise(t.strip(out))


def clean(df: DataFrame, text_column: str = "text", options: dict | CleanConfig | None = None, order_by: str | list | None = None, partition_by: str | None = None) -> DataFrame:
    """``df`` with ``text_clean`` and, as configured, ``text_tokens``, ``text_tokens_str`` and ``text_stems``.

    order_by: key of the dense row number ``id_text``; without it no id is made, as rows have no order.
    """
    if text_column not in df.columns:
        raise ValueError(f"Text column '{text_column}' isn't in the data")
    config = CleanConfig.of(options)
    out = df
    if order_by is not None:
        out = dense_ids(out, order_by, "id_text", partition_by)
    out = out.withColumn("text_clean", clean_expression(F.col(text_column), config))
    if config.tokenize:
        out = out.withColumn("text_tokens", treebank_tokens_udf(F.col("text_clean"))).withColumn("text_tokens_str", F.array_join("text_tokens", " "))
    if config.stem:
        out = out.withColumn("text_stems", F.array_join(stems_udf(F.col("text_tokens")), " "))
    return out
