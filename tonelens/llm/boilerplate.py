"""Lines repeated across one source's documents (problem 7).

Blocks of lines are found in the suffix array over each source's concatenated line identifiers: two
neighbouring suffixes share a block as long as their common prefix, and a block stands in all
documents of the run of suffixes that share it. A line in too few documents can't be in a block, so
identifiers are counted first (combined on the map side) and only runs of frequent ones go into
suffixes; documents with equal runs go in once, with their number. The array is sorted in shards, one
for each source and first line, which are its contiguous ranges: no task holds a whole source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import table, written

LEAST_DOCS = 6
LEAST_SHARE = 0.1
#: White space as in Python's str.isspace().
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
BLOCKS = "source string, line long, block array<long>, docs long"


def normal_line(line):
    """Trimmed, lower-cased, runs of white space as one space, runs of the digits 0-9 as one mark."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, SPACE + "+", " "))), "[0-9]+", "#")


def _rows(df: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(source_column).cast("string").alias("source"), F.col(text_column).cast("string").alias("text"))
    return rows.where(F.col("id").isNotNull() & F.col("source").isNotNull() & F.col("text").rlike("[^" + SPACE[1:]))


def _line_ids():
    """Identifiers of a text's lines, in order; that of the empty line for blank ones."""
    return F.transform(F.split("text", "\n", -1), lambda x: F.xxhash64(normal_line(x)))


def line_table(df: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """``id, source, lines`` of rows with a source and text: their line identifiers, made once and written."""
    return written(_rows(df, id_column, text_column, source_column).select("id", "source", _line_ids().alias("lines")), "lines")


def _enough(least: int, share: float):
    return F.greatest(F.lit(least), F.ceil(F.col("all_docs") * F.lit(share) - F.lit(1e-9)))


def frequent_lines(lines: DataFrame, least: int, share: float, block_share: float | None = None) -> DataFrame:
    """``source, line, docs, least, least_block`` of the lines that stand in enough documents of their source to be
    part of a block; ``least`` is for blocks of one line, ``least_block`` for longer ones."""
    sources = lines.groupBy("source").agg(F.count(F.lit(1)).alias("all_docs"))
    each = lines.select("source", F.explode(F.array_distinct("lines")).alias("line")).where(F.col("line") != F.xxhash64(F.lit("")))
    counted = each.groupBy("source", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= least)
    block = share if block_share is None else min(share, block_share)
    enough = counted.join(sources, "source").select("source", "line", "docs", _enough(least, share).alias("least"), _enough(least, block).alias("least_block"))
    return enough.where("docs >= least_block")


def occurrences(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """``id, source, line_no, nth, line``: frequent lines where they stand; nth counts non-blank lines."""
    numbered = F.transform("lines", lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), x.alias("line")))
    rows = lines.select("id", "source", F.posexplode(F.filter(numbered, lambda x: x["line"] != F.xxhash64(F.lit("")))).alias("nth", "at"))
    return rows.select("id", "source", "at.line_no", "nth", "at.line").join(frequent.select("source", "line", "least", "least_block"), ["source", "line"])


def blocks_of_shard(runs: list, owner: np.ndarray, docs: np.ndarray, least: int, least_block: int | None = None) -> dict:
    """{block: documents} of suffixes with one first line: the common prefixes of neighbours in sorted
    order that stand in ``least`` documents or more (of two lines or more: ``least_block``) and don't extend to one that
    stands in as many. Suffixes of one owner (documents with equal runs) count once."""
    least_block = least if least_block is None else least_block
    order = sorted(range(len(runs)), key=runs.__getitem__)
    common = [0] * len(order)
    for i in range(1, len(order)):
        a, b = runs[order[i - 1]], runs[order[i]]
        n = 0
        while n < len(a) and n < len(b) and a[n] == b[n]:
            n += 1
        common[i] = n
    out, live, length = {}, [(0, len(order))], 1
    while live:
        longer = []
        for start, end in live:
            i = start
            while i < end:
                if len(runs[order[i]]) < length:
                    i += 1
                    continue
                j = i + 1
                while j < end and common[j] >= length:
                    j += 1
                who = {int(owner[order[x]]): int(docs[order[x]]) for x in range(i, j)}
                total = sum(who.values())
                if total >= min(least, least_block):
                    block = tuple(runs[order[i]][:length])
                    if total >= (least if length == 1 else least_block):
                        if length > 1 and out.get(block[:-1]) == total:
                            del out[block[:-1]]
                        out[block] = total
                    longer.append((i, j))
                i = j
        live, length = longer, length + 1
    return out


def _shard(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    found = blocks_of_shard(rows.column("run").to_pylist(), rows.column("owner").to_numpy(), rows.column("docs").to_numpy(), int(rows.column("least")[0].as_py()), int(rows.column("least_block")[0].as_py()))
    n = len(found)
    return pa.table({
        "source": pa.array([key[0].as_py()] * n, pa.string()), "line": pa.array([key[1].as_py()] * n, pa.int64()),
        "block": pa.array([list(b) for b in found], pa.list_(pa.int64())), "docs": pa.array(list(found.values()), pa.int64()),
    })


def line_blocks(df: DataFrame, id_column: str, text_column: str, source_column: str, least: int = LEAST_DOCS, share: float = LEAST_SHARE, block_share: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(occurrences of lines that can be part of a block, blocks ``source, line, block, docs``).

    A block is a list of line identifiers that stands, line after line with blank lines apart, in at
    least ``least`` documents and ``share`` of its source's documents with text (of two lines or more:
    ``block_share``, if given); line is its first. Rows with a null id, text or source and blank texts give nothing;
    rows with one id are one document.
    """
    lines = line_table(df, id_column, text_column, source_column)
    frequent = written(frequent_lines(lines, least, share, block_share), "frequent")
    held = written(occurrences(lines, frequent), "held")
    runs = _runs(held).select("source", "id", "least", "least_block", F.transform("run", lambda x: x["line"]).alias("run"))
    docs = runs.groupBy("source", "id").agg(F.sort_array(F.collect_list("run")).alias("runs"), F.first("least").alias("least"), F.first("least_block").alias("least_block"))
    docs = docs.groupBy("source", "runs").agg(F.count(F.lit(1)).alias("docs"), F.first("least").alias("least"), F.first("least_block").alias("least_block")).withColumn("owner", F.xxhash64("source", "runs"))
    each = docs.select("source", "owner", "docs", "least", "least_block", F.explode("runs").alias("whole"))
    suffixes = each.select("source", "owner", "docs", "least", "least_block", F.explode(F.transform("whole", lambda x, i: F.slice("whole", i + 1, F.size("whole")))).alias("run")).withColumn("line", F.col("run")[0])
    return held, suffixes.groupBy("source", "line").applyInArrow(_shard, BLOCKS)


def _runs(held: DataFrame) -> DataFrame:
    """``source, id, run``: neighbouring lines of ``held``, in order, with their numbers."""
    island = F.col("nth") - F.row_number().over(Window.partitionBy("source", "id").orderBy("nth"))
    return held.withColumn("island", island).groupBy("source", "id", "island").agg(F.array_sort(F.collect_list(F.struct("nth", "line", "line_no"))).alias("run"), F.first("least").alias("least"), F.first("least_block").alias("least_block"))


def lines_to_remove(df: DataFrame, id_column: str, text_column: str, source_column: str, least: int = LEAST_DOCS, share: float = LEAST_SHARE, block_share: float | None = None) -> DataFrame:
    """``id, source, line_no, line`` of every line covered by a block, each once.

    Without ``block_share`` each line of a block begins a suffix of it, which is a block as well, so the first lines of
    blocks are all of their lines. With it a line goes where it stands in a block of several lines, though alone it
    stays.
    """
    held, blocks = line_blocks(df, id_column, text_column, source_column, least, share, block_share)
    if block_share is None or block_share >= share:
        return held.join(blocks.select("source", "line").distinct(), ["source", "line"], "left_semi").select("id", "source", "line_no", "line")
    whole = _runs(held).select("source", "id", "run", F.transform("run", lambda x: x["line"]).alias("ids"))
    begun = whole.select("source", "id", "run", "ids", F.posexplode("ids").alias("at", "line")).join(blocks.select("source", "line", "block"), ["source", "line"])
    match = begun.where(F.slice("ids", F.col("at") + 1, F.size("block")) == F.col("block"))
    return match.select("id", "source", F.explode(F.slice("run", F.col("at") + 1, F.size("block"))).alias("x")).select("id", "source", "x.line_no", "x.line").distinct()


def without_lines(df: DataFrame, id_column: str, text_column: str, source_column: str, least: int = LEAST_DOCS, share: float = LEAST_SHARE, block_share: float | None = None) -> DataFrame:
    """``id, kept, removed``: every row's text without the blocks' lines; a null text stays null."""
    gone = lines_to_remove(df, id_column, text_column, source_column, least, share, block_share).groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).join(gone, "id", "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<bigint>")), (i + 1).cast("long"))), "\n")
    return rows.select("id", kept.alias("kept"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))


def p7_found(spark, sf_dir: str) -> DataFrame:
    lines = lines_to_remove(table(spark, sf_dir, "speeches"), "speech_id", "text", "CentralBank")
    return lines.select(F.col("id").alias("speech_id"), "line_no")


def p7_blocks(spark, sf_dir: str) -> DataFrame:
    _, blocks = line_blocks(table(spark, sf_dir, "speeches"), "speech_id", "text", "CentralBank")
    return blocks.select(F.col("source").alias("CentralBank"), F.size("block").alias("lines"), F.array_join(F.transform("block", lambda x: F.hex(x)), " ").alias("block"), "docs")


def p7_clean(spark, sf_dir: str) -> DataFrame:
    return without_lines(table(spark, sf_dir, "speeches"), "speech_id", "text", "CentralBank").withColumnRenamed("id", "speech_id")


def p7_block_lines(spark, sf_dir: str) -> DataFrame:
    """Lines of blocks of one line, and of blocks of two or more that stand in LEAST_DOCS documents, whatever their share."""
    lines = lines_to_remove(table(spark, sf_dir, "speeches"), "speech_id", "text", "CentralBank", block_share=0.0)
    return lines.select(F.col("id").alias("speech_id"), "line_no")
