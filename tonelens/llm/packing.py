"""Filling fixed-capacity containers with items (problem 8).

The plan is made on the counts of lengths, of which there are at most ``capacity``: from the longest
length down, a container's gap is closed by a single length, a pair or a triple whose sum is exactly
the gap, looked up in an index of sums under the counts still available, and else by best fit; each
pattern is used as often as the counts allow. The plan's size depends on the capacity alone. Items
then take their places in it by their rank among the items of their length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import table, written
from .tokens import VOCABULARY, exact_tokens

CAPACITY = 2048
ROWS_A_BUCKET = 250_000


class Sums:
    """Sums of two available lengths. Lengths only run out, so an index some steps old names every sum there is
    and a few that are gone; it is made again once it misleads."""

    def __init__(self, left: np.ndarray):
        self.left = left
        self.renew()

    def renew(self) -> None:
        there = (self.left > 0).astype(np.float32)
        self.pairs = np.convolve(there, there)[: len(there)] > 0.5
        self.misled = 0

    def pair(self, gap: int) -> list[int] | None:
        """Two available lengths with this sum; the longest first length wins."""
        if gap < 2 or not self.pairs[gap]:
            return None
        left = self.left
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        ok = (left[a] > 0) & (left[gap - a] > 0)
        if gap % 2 == 0 and left[gap // 2] < 2:
            ok[-1] = False
        at = int(ok.argmax())
        if ok[at]:
            return [int(a[at]), gap - int(a[at])]
        self.misled += 1
        return None

    def exact(self, gap: int) -> list[int] | None:
        """One, two or three available lengths that fill the gap exactly."""
        if self.left[gap]:
            return [gap]
        if two := self.pair(gap):
            return two
        if gap < 3:
            return None
        a = np.arange(gap - 2, 0, -1)
        for x in a[(self.left[a] > 0) & self.pairs[gap - a]].tolist():
            self.left[x] -= 1
            two = self.pair(gap - x)
            self.left[x] += 1
            if two:
                return [x, *two]
            if self.misled > 16:
                self.renew()
                return self.exact(gap)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in the container, number of such containers); uses every item of 1..capacity once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    left[0] = 0
    sums = Sums(left)
    out = []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        pattern, gap = [top], capacity - top
        left[top] -= 1
        taken = [top]
        while gap:
            more = sums.exact(gap)
            if more is None:
                fits = np.flatnonzero(left[1 : gap + 1])
                if not len(fits):
                    break
                more = [int(fits[-1]) + 1]
            for x in more:
                left[x] -= 1
                taken.append(x)
                gap -= x
        pattern = tuple(sorted(taken, reverse=True))
        use = {x: pattern.count(x) for x in pattern}
        times = 1 + min(int(left[x]) // n for x, n in use.items())
        for x, n in use.items():
            left[x] -= n * (times - 1)
        out.append((pattern, times))


def packed(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``id, piece, tokens, container`` for ``sizes`` (``id, tokens``).

    A document longer than the capacity is cut into full pieces and a rest; no other is split.
    Documents without tokens take no space and have container null, as have null sizes. Every row of
    ``sizes`` is an item, also where ids repeat.
    """
    pieces = sizes.select("id", F.coalesce("tokens", F.lit(0)).alias("whole")).withColumn("pieces", F.greatest(F.ceil(F.col("whole") / F.lit(capacity)), F.lit(1)).cast("int"))
    pieces = pieces.select("id", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "whole")
    pieces = written(pieces.select("id", "piece", F.least(F.col("whole") - F.col("piece").cast("long") * capacity, F.lit(capacity).cast("long")).alias("tokens")), "pieces")
    counts = {r[0]: r[1] for r in pieces.where("tokens > 0").groupBy("tokens").count().collect()}
    rows, base, used = [], 0, {}
    for pattern, times in plan(counts, capacity):
        for length in dict.fromkeys(pattern):
            each = pattern.count(length)
            start = used.get(length, 0)
            rows.append((length, start, start + each * times, each, base))
            used[length] = start + each * times
        base += times
    spark = sizes.sparkSession
    places = spark.createDataFrame(rows, "tokens long, start long, stop long, each long, base long")
    # ranks by hashed buckets of a length, so a length that many items share is no single task's
    buckets = max(8, sum(counts.values()) // ROWS_A_BUCKET)
    keyed = pieces.where("tokens > 0").withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    sums = keyed.groupBy("tokens", "bucket").count()
    before = sums.withColumn("before", F.sum("count").over(Window.partitionBy("tokens").orderBy("bucket")) - F.col("count")).select("tokens", "bucket", "before")
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("tokens", "bucket").orderBy("id", "piece")) - 1)
    ranked = ranked.join(before, ["tokens", "bucket"]).withColumn("rank", (F.col("rank") + F.col("before")).cast("long")).drop("before", "bucket")
    # the plan has at most a few rows a length, by the capacity: it may be sent to all tasks
    placed = ranked.join(F.broadcast(places) if len(rows) <= 64 * capacity else places, "tokens").where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("stop")))
    placed = placed.select("id", "piece", "tokens", (F.col("base") + F.floor((F.col("rank") - F.col("start")) / F.col("each"))).cast("long").alias("container"))
    return placed.unionByName(pieces.where("tokens <= 0").select("id", "piece", "tokens", F.lit(None).cast("long").alias("container")))


def p8_containers(spark, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    return packed(exact_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", path)).withColumnRenamed("id", "doc_id")


def p8_usage(spark, sf_dir: str) -> DataFrame:
    """``containers, tokens, unused_share`` of the packing."""
    rows = p8_containers(spark, sf_dir).where("container IS NOT NULL")
    return rows.agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens")).withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * CAPACITY))


def p8_checks(spark, sf_dir: str) -> DataFrame:
    """``documents, packed, overfull, split``: all documents, those with text in a container, containers beyond the
    capacity, and documents in several pieces that fit into one container."""
    rows = p8_containers(spark, sf_dir)
    docs = rows.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.count("container").alias("placed"))
    fill = rows.where("container IS NOT NULL").groupBy("container").agg(F.sum("tokens").alias("tokens")).agg(F.count(F.when(F.col("tokens") > CAPACITY, 1)).alias("overfull"))
    counts = docs.agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("placed") == F.col("pieces"), 1)).alias("packed"), F.count(F.when((F.col("pieces") > 1) & (F.col("tokens") <= CAPACITY), 1)).alias("split"))
    # one row each
    return counts.crossJoin(F.broadcast(fill)).select("documents", "packed", "overfull", "split")
