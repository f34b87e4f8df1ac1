"""Evaluation texts leaking into training text: SimHash windows with multi-index blocks (problem 9).

``similar`` looks for whole items with small edits: windows of exactly an item's number of words get a
128-bit SimHash of their words. Fingerprints are cut into ``radius + 1`` blocks; two that differ in at most ``radius``
bits agree in one block, so an equi-join on (words, block, its bits) finds every fingerprint within the radius, and the
weighted 5-word shingles of item and window verify it exactly. Every window that can reach the similarity is looked at;
a run of them holds its shingles once, and of its fingerprints' blocks only those that an item may have are joined. ``leaked`` asks for runs of 13 equal
words anywhere in an item; its windows have 13 words, equal runs have equal fingerprints (radius 0), and
the words' own hashes verify them.

The documents are scanned once, whatever the number of items. A Bloom filter over what the items hold, of at most
2 ** ``BLOOM_BITS`` bits, is sent to the tasks, and only windows that pass it are shuffled to the
items. Neither items nor fingerprints come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table, written
from .textkit import U64, Codes, Words, mix, slices

RUN = 13
RADIUS = 10
PRINT = 128
#: The filter's size: 16 bits a key up to this power of two (32 MB). With more keys it lets more pass, and none is lost.
BLOOM_BITS = 28
CHUNK = 18
#: Words taken together when the bits of words are summed.
STEP = 1 << 15
SALT = 0x9E3779B97F4A7C15
ITEM = "item long, words int, low long, high long, shingles array<long>"
WINDOWS = "doc long, words int, low array<long>, high array<long>, hits array<array<int>>, shingles array<long>"
#: Windows of a run that are kept in one row at most.
PIECE = 1 << 12


def window_simhash(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the ``size`` words from each ascending position: a bit is set if more than half of the words set it."""
    out = np.zeros(len(at), U64)
    for lo in range(0, len(at), STEP):
        part = at[lo : lo + STEP]
        a, b = int(part[0]), int(part[-1]) + size
        bits = np.unpackbits(hashes[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
        kind = np.uint16 if size < 1 << 16 else np.uint32
        total = np.zeros((b - a + 1, 64), kind)
        np.cumsum(bits, axis=0, dtype=kind, out=total[1:])
        votes = total[part - a + size] - total[part - a]
        out[lo : lo + STEP] = np.packbits(votes > size // 2, axis=1).view("<u8").ravel()
    return out


def prints(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the windows' 128-bit SimHash."""
    first = int(at[0])
    hashes, at = hashes[first : int(at[-1]) + size], at - first
    return window_simhash(hashes, at, size), window_simhash(mix(hashes ^ U64(SALT)), at, size)


class Bloom:
    """Membership of 64-bit hashes in packed bits; no false negatives."""

    def __init__(self, bits: int, chunks: dict[int, bytes]):
        self.bits = bits
        self.data = np.zeros(1 << max(0, bits - 3), np.uint8)
        for c, data in chunks.items():
            self.data[c << (CHUNK - 3) : (c << (CHUNK - 3)) + len(data)] = np.frombuffer(data, np.uint8)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for shift in (0, 32):
            p = (keys >> U64(shift)) & U64((1 << self.bits) - 1)
            out &= (self.data[p >> U64(3)] >> (p & U64(7)).astype(np.uint8)) & 1 == 1
        return out


def _packed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    bits = np.zeros(1 << CHUNK, bool)
    bits[rows.column("at").to_numpy() & ((1 << CHUNK) - 1)] = True
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def bloom_of(keys: DataFrame, column: str) -> Bloom:
    """The filter of a column of 64-bit hashes. Distinct bit positions are packed chunk by chunk in the tasks; at most
    2 ** BLOOM_BITS bits come to the driver."""
    count = keys.count()
    bits = min(BLOOM_BITS, max(CHUNK, (16 * max(1, count) - 1).bit_length()))
    places = [F.shiftrightunsigned(F.col(column), s).bitwiseAND((1 << bits) - 1) for s in (0, 32)]
    at = keys.select(F.explode(F.array(*places)).alias("at")).distinct().withColumn("chunk", F.shiftright("at", CHUNK))
    packed = at.groupBy("chunk").applyInArrow(_packed, "chunk long, data binary").collect()
    return Bloom(bits, {r["chunk"]: r["data"] for r in packed})


def _rows(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.where(F.col("id").isNotNull() & F.col("text").isNotNull())


# Runs of equal words -------------------------------------------------------------------------------------------------


def _runs(run: int, bloom: Bloom | None):
    """``id, print, exact`` of the distinct windows of each text, for documents of those that pass the filter."""

    def find(batches):
        for batch in batches:
            ids, texts = batch.column("id").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
            for a, b in slices(texts):
                words = Words(Codes(texts[a:b]))
                at, exact = words.windows(run)
                if not len(at):
                    continue
                seen = window_simhash(words.hash, at, run)
                if bloom is not None:
                    some = np.flatnonzero(bloom.holds(mix(seen)))
                    at, exact, seen = at[some], exact[some], seen[some]
                own = np.unique(np.stack([words.doc[at].astype(U64), seen, exact], 1), axis=0)
                yield pa.record_batch({"id": pa.array(ids[a:b][own[:, 0].astype(np.int64)]), "print": pa.array(own[:, 1].astype(np.int64)), "exact": pa.array(own[:, 2].astype(np.int64)), "key": pa.array(mix(own[:, 1]).astype(np.int64))})

    return find


RUNS = "id long, print long, exact long, key long"


def leaked(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, run: int = RUN) -> DataFrame:
    """``item, doc`` with at least ``run`` consecutive words in common, each pair once.

    Null ids or texts give nothing, nor do texts of fewer words. Equal runs have equal fingerprints, so none is
    missed; the hashes of the words themselves decide.
    """
    asked = written(_rows(items, item_id, item_text).mapInArrow(_runs(run, None), RUNS), "items")
    bloom = bloom_of(asked.select("key"), "key")
    seen = _rows(docs, doc_id, doc_text).mapInArrow(_runs(run, bloom), RUNS)
    both = seen.select(F.col("id").alias("doc"), "print", "exact").join(asked.select(F.col("id").alias("item"), "print", "exact").distinct(), ["print", "exact"])
    return both.select("item", "doc").distinct()


# Whole items with small edits ----------------------------------------------------------------------------------------


def _item_rows(k: int):
    def make(batches):
        for batch in batches:
            ids, texts = batch.column("id").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
            for a, b in slices(texts):
                words = Words(Codes(texts[a:b]))
                at, h = words.windows(k)
                out = []
                for d in range(b - a):
                    first, size = int(words.first[d]), int(words.first[d + 1] - words.first[d])
                    if size >= k:
                        low, high = prints(words.hash, np.array([first]), size)
                        lo, hi = np.searchsorted(at, [first, first + size])
                        out.append((int(ids[a + d]), size, int(low.astype(np.int64)[0]), int(high.astype(np.int64)[0]), np.unique(h[lo:hi]).astype(np.int64).tolist()))
                if out:
                    i, n, low, high, s = zip(*out)
                    yield pa.record_batch({"item": pa.array(i, pa.int64()), "words": pa.array(n, pa.int32()), "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64()), "shingles": pa.array(s, pa.list_(pa.int64()))})

    return make


def cuts(radius: int) -> list[tuple[bool, int, int]]:
    """(high half, first bit, end) of the blocks of a 128-bit fingerprint: radius + 1 that don't cross the halves; an odd
    number leaves one half a block less."""
    n = radius + 1
    return [(high, 64 * i // own, 64 * (i + 1) // own) for high, own in ((False, n - n // 2), (True, n // 2)) for i in range(own)]


def block_keys(words: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int) -> np.ndarray:
    """A hash of number of words, block and its bits for each fingerprint (rows) and block (columns)."""
    own = mix(words.astype(U64))
    if radius < 1:
        return mix(own ^ mix(low) ^ mix(high ^ U64(SALT)))[:, None]
    bits = np.stack([((high if upper else low) >> U64(start) & U64((1 << (stop - start)) - 1)) ^ U64(i * SALT % 2**64) for i, (upper, start, stop) in enumerate(cuts(radius))], 1)
    return mix(own[:, None] ^ mix(bits))


def _item_keys(radius: int):
    def make(batches):
        for batch in batches:
            words, low, high = (batch.column(c).to_numpy() for c in ("words", "low", "high"))
            yield pa.record_batch({"key": pa.array(mix(block_keys(words, low.astype(U64), high.astype(U64), radius).ravel()).astype(np.int64))})

    return make


def place_before(doc: np.ndarray, h: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Of each shingle that doesn't pass the filter, where its text had it last; -1 for the first, -2 for those that pass."""
    out = np.where(hit, -2, -1)
    at = np.flatnonzero(~hit)
    at = at[np.lexsort((h[at], doc[at]))]
    again = np.flatnonzero((h[at[1:]] == h[at[:-1]]) & (doc[at[1:]] == doc[at[:-1]])) + 1
    out[at[again]] = at[again - 1]
    return out


def others(before: np.ndarray, m: int) -> np.ndarray:
    """Distinct shingles that don't pass the filter in each run of ``m`` of a text's shingles, by their places before."""
    at = np.flatnonzero(before > -2)
    # one counts in the runs that begin after its last place before, and hold it
    begin = np.maximum(np.maximum(before[at] + 1, at - m + 1), 0)
    return np.cumsum(np.bincount(begin, minlength=len(before) + 1) - np.bincount(at + 1, minlength=len(before) + 1))[: len(before) - m + 1]


def _windows(k: int, sizes: list[int], shingles: Bloom, prints_of_items: Bloom, least: float, radius: int):
    """All item-sized windows of each document that can reach the similarity and agree with an item in a block: at most a
    share of 1 / least - 1 of an item's shingles may be others than those that pass the filter, as each counts in full
    against the item, and one must pass. One row for a run of windows, with its shingles in order."""

    def find(batches):
        for batch in batches:
            ids, texts = batch.column("id").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
            for a, b in slices(texts):
                words = Words(Codes(texts[a:b]))
                at, h = words.windows(k)
                hit = shingles.holds(mix(h))
                held = np.bincount(words.doc[at[hit]], minlength=b - a) if len(at) else np.zeros(b - a, np.int64)
                before = place_before(words.doc[at], h, hit)
                # others that come again count once
                enough = held + np.bincount(words.doc[at[before >= 0]], minlength=b - a)
                share, out = 2 - 1 / least, []
                for d in np.flatnonzero((held > 0) & (enough >= share * (sizes[0] - k + 1) - 1e-9)).tolist():
                    first, n = int(words.first[d]), int(words.first[d + 1] - words.first[d])
                    lo = int(np.searchsorted(at, first))
                    own, last = h[lo : lo + n - k + 1], before[lo : lo + n - k + 1]
                    last = np.where(last < 0, last, last - lo)
                    count = np.concatenate([[0], np.cumsum(hit[lo : lo + n - k + 1])])
                    for size in sizes:
                        m = size - k + 1
                        if size > n or enough[d] < share * m - 1e-9:
                            break
                        inside = count[m:] - count[:-m]
                        if inside.max() + enough[d] - held[d] < share * m - 1e-9:
                            continue
                        good = np.flatnonzero((others(last, m) <= (1 / least - 1) * m + 1e-9) & (inside > 0))
                        if not len(good):
                            continue
                        for run in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1):
                            for i in range(0, len(run), PIECE):
                                starts = run[i : i + PIECE]
                                low, high = prints(words.hash, first + starts, size)
                                keys = block_keys(np.full(len(starts), size), low, high, radius)
                                near = prints_of_items.holds(mix(keys.ravel())).reshape(keys.shape)
                                if near.any():
                                    which = [np.flatnonzero(x).tolist() if any_of else [] for x, any_of in zip(near, near.any(1).tolist())]
                                    out.append((int(ids[a + d]), size, low.astype(np.int64), high.astype(np.int64), which, own[starts[0] : starts[-1] + m].astype(np.int64)))
                if out:
                    i, n, low, high, hits, s = zip(*out)
                    longs = pa.list_(pa.int64())
                    yield pa.record_batch({"doc": pa.array(i, pa.int64()), "words": pa.array(n, pa.int32()), "low": pa.array(low, longs), "high": pa.array(high, longs), "hits": pa.array(hits, pa.list_(pa.list_(pa.int32()))), "shingles": pa.array(s, longs)})

    return find


def blocks(low, high, radius: int):
    """``(block, bits)`` of a 128-bit fingerprint in two columns, by ``cuts``."""
    if radius < 1:
        return F.array(F.struct(F.lit(0).alias("block"), F.xxhash64(low, high).alias("bits")))
    out = []
    for i, (upper, start, stop) in enumerate(cuts(radius)):
        half = high if upper else low
        bits = F.shiftrightunsigned(half, start).bitwiseAND((1 << (stop - start)) - 1) if stop - start < 64 else half
        out.append(F.struct(F.lit(i).alias("block"), bits.alias("bits")))
    return F.array(*out)


def similar(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, radius: int = RADIUS, k: int = 5, least: float = 0.8) -> DataFrame:
    """``item, doc, similarity``: documents with an item-sized window near the item by fingerprint whose weighted
    k-word shingles agree at ``least`` or more; the best window's similarity.

    A shingle weighs 1 by the number of items that hold it, one of no item 1. Null ids or texts give nothing, nor do
    items of fewer than ``k`` words. Rows with one item id are apart, and the best counts.
    """
    asked = _rows(items, item_id, item_text).mapInArrow(_item_rows(k), ITEM)
    asked = written(asked.withColumn("row", F.monotonically_increasing_id()), "items")
    spread = asked.select("row", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("items"))
    spread = written(spread.withColumn("weight", 1 / F.col("items")), "spread")
    # of item sizes there are as many as the longest item has words, at most
    sizes = sorted(r[0] for r in asked.select("words").distinct().collect())
    if not sizes:
        return asked.sparkSession.createDataFrame([], "item long, doc long, similarity double")
    key = bloom_of(written(spread.select(F.col("shingle")).mapInArrow(_mixed, "key long"), "keys"), "key")
    fit = bloom_of(written(asked.select("words", "low", "high").mapInArrow(_item_keys(radius), "key long"), "blocks"), "key")
    runs = written(_rows(docs, doc_id, doc_text).mapInArrow(_windows(k, sizes, key, fit, least, radius), WINDOWS).withColumn("run", F.monotonically_increasing_id()), "windows")
    # a window of a run is known by its place there
    seen = runs.select("run", "words", F.posexplode(F.arrays_zip("low", "high", "hits")).alias("place", "w")).select("run", "place", "words", "w.*")
    at = lambda df, some, *more: df.select(*more, "words", "low", "high", F.inline(some(blocks(F.col("low"), F.col("high"), radius))))
    x = at(seen.where(F.size("hits") > 0), lambda all_of: F.filter(all_of, lambda b: F.array_contains("hits", b["block"])), "run", "place").alias("x")
    y = at(asked, lambda all_of: all_of, "row").alias("y")
    apart = F.bit_count(F.col("x.low").bitwiseXOR(F.col("y.low"))) + F.bit_count(F.col("x.high").bitwiseXOR(F.col("y.high")))
    same = (F.col("x.words") == F.col("y.words")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.bits") == F.col("y.bits"))
    near = x.join(y, same).where(apart <= radius).select("run", "place", "row").distinct()
    # weights of the items' shingles; those of no item weigh 1
    total = asked.select("row", F.explode("shingles").alias("shingle")).hint("merge").join(spread, "shingle")
    own = total.groupBy("row").agg(F.sum("weight").alias("own"))
    # exploded arrays are larger than their files let expect, so they are never sent whole to the tasks
    held = F.array_distinct(F.slice("shingles", F.col("place") + 1, F.col("words") - (k - 1)))
    inside = near.join(runs.select("run", "doc", "words", "shingles"), "run").select("run", "place", "doc", "row", F.explode(held).alias("shingle"))
    inside = inside.hint("merge").join(spread.select("shingle", "weight"), "shingle", "left")
    shared = inside.hint("merge").join(total.select("row", "shingle", F.lit(True).alias("both")).hint("merge"), ["row", "shingle"], "left")
    weight = F.coalesce("weight", F.lit(1.0))
    sums = shared.groupBy("run", "place", "row", "doc").agg(F.sum(F.when(F.col("both"), weight).otherwise(0.0)).alias("both"), F.sum(F.when(F.col("both"), 0.0).otherwise(weight)).alias("other"))
    scored = sums.join(own, "row").withColumn("similarity", F.col("both") / (F.col("own") + F.col("other"))).where(F.col("similarity") >= least - 1e-9)
    return scored.join(asked.select("row", "item"), "row").groupBy("item", "doc").agg(F.max("similarity").alias("similarity"))


def _mixed(batches):
    for batch in batches:
        yield pa.record_batch({"key": pa.array(mix(batch.column(0).to_numpy().astype(U64)).astype(np.int64))})


def p9_found(spark, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return leaked(docs, "doc_id", "text", items, "item_id", "text").select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"))


def p9_similar(spark, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return similar(docs, "doc_id", "text", items, "item_id", "text").select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"), "similarity")
