"""Dense row numbers without sorting texts, and without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Distinct keys numbered together, about.
RANGE_KEYS = 1_000_000


def dense_ids(df: DataFrame, order_by: str | list, name: str = "id", partition_by: str | None = None, range_keys: int = RANGE_KEYS) -> DataFrame:
    """``df`` with 1, 2, ... by the key, in each partition if one is named; nulls of the key come first.

    Only keys are sorted, not the rows: equal keys are counted first, cut into as many salted parts as there
    are ranges, so rows without a date are no single task's; ranges of keys are numbered apart and moved up by the
    rows of the ranges before. The rows then meet their key's first number in one join on the key. Rows
    of one key keep an arbitrary order among themselves; give a unique key where it matters.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    if missing := [k for k in keys if k not in df.columns]:
        raise ValueError(f"no column {', '.join(missing)} to number the rows by")
    if odd := [k for k in keys if df.schema[k].dataType.typeName() in ("array", "map", "struct", "binary", "variant")]:
        raise ValueError(f"rows can't be numbered by {', '.join(odd)}")
    groups = [partition_by] if partition_by else []
    by = list(dict.fromkeys([*groups, *keys]))
    ranges = max(1, -(-df.count() // range_keys))
    plain = [c for c, kind in df.dtypes if not kind.startswith("map")]
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*plain), F.lit(ranges)) if ranges > 1 else F.lit(0).cast("long"))
    order = [*by, "__salt"]
    counts = salted.groupBy(*order).agg(F.count(F.lit(1)).alias("__n"))
    if ranges > 1:
        parts = written(counts.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "keys")
        before = parts.groupBy("__range").agg(F.sum("__n").alias("__n")).withColumn("__before", F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__range")) - F.col("__n"))
        inside = F.sum("__n").over(Window.partitionBy("__range").orderBy(*order)) - F.col("__n")
        first = parts.withColumn("__inside", inside).join(before.select("__range", "__before"), "__range")
        first = first.select(*order, (F.col("__inside") + F.col("__before")).alias("__first"))
        if groups:
            start = first.groupBy(*groups).agg(F.min("__first").alias("__start"))
            same = F.col(f"f.{groups[0]}").eqNullSafe(F.col(f"s.{groups[0]}"))
            first = first.alias("f").join(start.alias("s"), same).select(*[F.col(f"f.{c}") for c in order], (F.col("f.__first") - F.col("s.__start")).alias("__first"))
    else:
        window = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(*order)
        first = counts.select(*order, (F.sum("__n").over(window) - F.col("__n")).alias("__first"))
    # both sides of the join and the numbers inside a key by 128 bits of it, so rows are shuffled once, nulls or not
    bits = {"__low": F.xxhash64(F.lit(1), *order), "__high": F.xxhash64(F.lit(2), *order)}
    met = salted.withColumns(bits).join(first.withColumns(bits).select(*bits, "__first"), list(bits))
    number = F.row_number().over(Window.partitionBy(*bits).orderBy(F.lit(0))) + F.col("__first")
    return met.withColumn(name, number.cast("long")).select(*df.columns, name)
