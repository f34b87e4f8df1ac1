"""Time series of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def monthly_mean(df: DataFrame, date_column: str, value_column: str, partition_by: str | None = None) -> DataFrame:
    """``[partition,] month, value``: means by month, labelled by the month's last day; months between the first and
    last without rows are there, with null. Rows without a date are left out."""
    keys = [partition_by] if partition_by else []
    rows = df.where(F.col(date_column).isNotNull())
    months = rows.groupBy(*keys, F.last_day(F.col(date_column).cast("date")).alias("month")).agg(F.avg(value_column).alias("value"))
    ends = months.groupBy(*keys).agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a IS NOT NULL")
    steps = F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))
    calendar = ends.select(*keys, F.explode(steps).alias("first")).select(*keys, F.last_day("first").alias("month"))
    same = F.col("c.month") == F.col("m.month")
    for k in keys:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"m.{k}"))
    return calendar.alias("c").join(months.alias("m"), same, "left").select(*[F.col(f"c.{k}") for k in keys], "c.month", "m.value")


def trailing(column: str, order_by: str, size: int, least: int | None = None, partition_by: str | None = None) -> Column:
    """Mean of the last ``size`` rows, null where fewer than ``least`` (default: all) of them have a value."""
    window = (Window.partitionBy(partition_by) if partition_by else Window.partitionBy(F.lit(0))).orderBy(order_by).rowsBetween(1 - size, 0)
    return F.when(F.count(column).over(window) >= (size if least is None else least), F.avg(column).over(window))


def in_date_order(df: DataFrame, date_column: str = "date", tie: str | None = None) -> DataFrame:
    return df.orderBy(date_column, *([tie] if tie else []))


def latest(df: DataFrame, order_by: str, n: int = 1, tie: str | None = None) -> DataFrame:
    """The last rows of an order, as a top-k: no full sort."""
    return df.orderBy(F.desc(order_by), *([F.desc(tie)] if tie else [])).limit(n)


def first_rows(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order_by).limit(n)
