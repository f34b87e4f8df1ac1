"""Near-duplicate records: set-similarity join by least shingles, verified exactly (problem 5).

A text is the set of its distinct k-word shingles. Under a random order of all shingles two sets have the same least one with
a chance of their Jaccard similarity. A signature is the least shingles under a few orders, so texts that share no more than
phrases rarely agree in one. (The universe partition named for the problem, whose signatures are the subsets of a set
in segments of the universe, let such texts agree wherever two common shingles fell into one segment, and their number grew much
faster than the input; README, "Problem 5".) The number of signatures is
the smallest for which a pair exactly at the threshold agrees in fewer than ``NEED`` and ``DROPS`` of them together with a
probability of at most ``miss`` under the random orders, whatever the texts are; it is the same for texts of any length. Small
sets, and those of the next band for their sake, are indexed by each of their shingles, which is exact. Every candidate is verified exactly on the
shingle sets.

Texts with the same set are one class; a class is indexed once, so copies make no pairs among
themselves. A first pass names the classes and the text that stands for each; a filter of those is sent to the second,
which indexes what passes. Its signatures name a text by its place among the texts signed with it, one byte as a rule, so a
signature takes about five bytes however many ranges they are cut into. Allocation by cost: signatures that more than ``HOT`` classes share make no pairs by themselves. A text
with at most ``DROPS`` of them leaves them out, which the number of signatures allows for; so every pair with such a text is found by the
others. Texts with more, as those made of common lines for a good part, are paired among each other by their shingles
instead: by the prefix principle two sets reach the threshold only if they share one of their rarest shingles, of which each
lists as many as it may lack, and one more. Common lines come last in that order, so texts that share a notice of less than
the threshold's part of them never meet by it. What many texts list all the same meets in blocks of about ``BLOCK``, so no
task holds an unbounded group.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .leaks import Bloom, bloom_of
from .shared import table, written
from .textkit import U64, Codes, Words, first_of, mix, slices

NEED = 3
HOT = 64
#: Hot signatures a text leaves out in a band at most, and their share of all its signatures, which bounds it for small sets.
DROPS = 4
DROP_SHARE = 0.05
BLOCK = 1024
#: Rows of two numbers sent to every task at most.
SENT_ROWS = 1_000_000
SMALL_BAND = 5
#: Orders of the shingles whose least one is taken, at most.
FUNCTIONS = 520
FLUSH = 1 << 21
#: Texts whose signatures are merged together, and tasks for them at most; a task takes one range after the other.
ROWS_A_RANGE = 5_000
MOST_TASKS = 20_000

#: Bits of a text's number below those of its task.
TASK_SHIFT = 40

NAMED = "cls long, id long, key long"
SIGNED = "range int, base long, sig binary, doc binary"
MERGED = "kind int, a long, b long, n long"


@lru_cache(16)
def plan(threshold: float, miss: float) -> tuple[int, int]:
    """(least shingles in a signature, signatures of a text): as many in one as ``FUNCTIONS`` allow."""

    def enough(r: int) -> int:
        p, s = threshold**r, NEED + DROPS
        while sum(math.comb(s, i) * p**i * (1 - p) ** (s - i) for i in range(NEED + DROPS)) > miss:
            s += 1
        return s

    r = 1
    while (r + 1) * enough(r + 1) <= FUNCTIONS:
        r += 1
    return r, enough(r)


@lru_cache(4)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and masks of n orders of the shingles."""
    i = np.arange(1, 2 * n + 1, dtype=U64)
    return mix(i[:n] * U64(0xD1B54A32D192ED03)) | U64(1), mix(i[n:] * U64(0x9E3779B97F4A7C15))


def shingle_sets(texts: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of the distinct k-word shingles, by text and hash; and the number of each text's
    shingles. A text of one to k-1 words has one shingle, all its words."""
    words = Words(Codes(texts))
    at, h = words.windows(k)
    d = words.doc[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = np.zeros(len(short), U64)
        for j in range(k - 1):
            has = count[short] > j
            whole[has] = mix(whole[has] * U64(31) + words.hash[words.first[short[has]] + j])
        d, h = np.concatenate([d, short]), np.concatenate([h, whole])
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    d, h = d[keep], h[keep]
    return d, h, np.bincount(d, minlength=len(texts))


def set_classes(d: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """A 63-bit hash of each text's shingle set."""
    out = np.zeros(n, U64)
    at = first_of(d)
    if len(at):
        out[d[at]] = mix(np.add.reduceat(mix(h), at))
    return out >> U64(1)


def _low_bits(band: int) -> np.uint64:
    """Odd and even tell a text's two bands apart, least shingles being the band above the small ones; below 2 one signature makes a candidate."""
    return U64(band if band < 2 else 2 + band % 2)


def signatures(d: np.ndarray, h: np.ndarray, n: np.ndarray, threshold: float, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature): of small sets their shingles, for their own bands and the bands below; of others least shingles."""
    band = np.frexp(np.maximum(n, 1).astype(float))[1] - 1
    docs, sigs = [], []
    for b in range(max(0, int(band.min(initial=0)) - 1), min(SMALL_BAND - 1, int(band.max(initial=0))) + 1):
        use = ((band == b) | (band == b + 1))[d]
        if use.any():
            docs.append(d[use])
            sigs.append(mix(h[use] ^ U64(b + 1)) << U64(2) | _low_bits(b))
    large = (band >= SMALL_BAND)[d]
    own, hashes = d[large], h[large]
    at = first_of(own)
    if len(at):
        r, s = plan(threshold, miss)
        factors, masks = _functions(r * s)
        which, x = own[at].astype(np.int64), np.empty_like(hashes)
        for j in range(s):
            total = np.full(len(at), j + 1, U64)
            for i in range(j * r, j * r + r):
                np.bitwise_xor(hashes, masks[i], out=x)
                np.multiply(x, factors[i], out=x)
                total = mix(total + np.minimum.reduceat(x, at))
            docs.append(which)
            sigs.append(total << U64(2) | _low_bits(SMALL_BAND))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(docs), np.concatenate(sigs)


class _Out:
    """Signatures of a task, sent as blocks, one for each range of signatures; its texts are numbered from ``base``."""

    def __init__(self, ranges: int, base: int):
        self.ranges, self.base, self.sent = ranges, base, base >> TASK_SHIFT
        self._clear()

    def _clear(self):
        self.sig, self.doc, self.cls, self.n, self.rows, self.texts = [], [], [], [], 0, 0

    def add(self, sig: np.ndarray, doc: np.ndarray, cls: np.ndarray, n: np.ndarray):
        """Signatures with the places of their texts, and class and number of signatures of each text."""
        self.sig.append(sig)
        self.doc.append(doc + self.texts)
        self.cls.append(cls)
        self.n.append(n)
        self.rows += len(sig)
        self.texts += len(cls)

    def batches(self):
        if not self.texts:
            return
        sig, doc, cls, n = (np.concatenate(x) for x in (self.sig, self.doc, self.cls, self.n))
        yield _block([-1 - self.sent % self.ranges], self.base, cls, n.astype(np.int64), np.array([0, len(cls)]))
        if len(sig):
            part = (((sig >> U64(34)) * U64(self.ranges)) >> U64(30)).astype(np.int64)
            order = np.argsort(part << 32 | doc, kind="stable")
            part, doc = part[order], doc[order]
            at = first_of(part)
            step = np.diff(doc, prepend=0)
            step[at] = doc[at]
            top = int(step.max())
            step = step.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)
            # the range has the bits above
            yield _block(part[at], self.base, sig[order].astype("<u4"), step, np.append(at, len(part)))
        self.base, self.sent = self.base + self.texts, self.sent + 1
        self._clear()


def _block(parts, base: int, sig: np.ndarray, doc: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
    """One row for each range, with its stretch of both arrays as bytes."""
    cut = lambda x: pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * x.itemsize).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])
    return pa.record_batch({"range": pa.array(parts, pa.int32()), "base": pa.array([base] * len(parts), pa.int64()), "sig": cut(sig), "doc": cut(doc)})


def class_keys(cls: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix(cls.astype(U64) ^ mix(ids.astype(np.int64).astype(U64)))


def _classer(k: int):
    """Class, id and key of the texts with words."""

    def classes(batches):
        for batch in batches:
            ids, texts = batch.column("id").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
            for a, b in slices(texts):
                d, h, n = shingle_sets(texts[a:b], k)
                has = np.flatnonzero(n > 0)
                cls, own = set_classes(d, h, b - a)[has], ids[a:b][has]
                yield pa.record_batch({"cls": pa.array(cls.astype(np.int64)), "id": pa.array(own.astype(np.int64)), "key": pa.array(class_keys(cls, own).astype(np.int64))})

    return classes


def _signer(k: int, threshold: float, miss: float, ranges: int, leads: Bloom):
    """Signatures of the texts that stand for a class, by the filter of their keys; a copy that passes it is indexed as well."""

    def sign(batches):
        out, taken = _Out(ranges, TaskContext.get().partitionId() << TASK_SHIFT), set()
        for batch in batches:
            ids, texts = batch.column("id").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
            for a, b in slices(texts):
                d, h, n = shingle_sets(texts[a:b], k)
                cls = set_classes(d, h, b - a)
                has = np.flatnonzero(n > 0)
                has = has[leads.holds(class_keys(cls[has], ids[a:b][has]))]
                # copies within the task are indexed once
                has = np.array([i for i in has.tolist() if (c := int(cls[i])) not in taken and not taken.add(c)], np.int64)
                lead = np.zeros(b - a, bool)
                lead[has] = True
                doc, sig = signatures(d[lead[d]], h[lead[d]], n, threshold, miss)
                out.add(sig, (np.cumsum(lead) - 1)[doc], cls[has], np.bincount(doc, minlength=b - a)[has])
                if out.rows >= FLUSH:
                    yield from out.batches()
        yield from out.batches()

    return sign


def _rows(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> dict:
    return {"kind": np.full(len(a), kind, np.int32), "a": a.astype(np.int64), "b": b.astype(np.int64), "n": n.astype(np.int64)}


def pairs_within(sig: np.ndarray, cls: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(a < b, signatures shared) of classes with a signature in common, and (signature, class) of
    signatures that more than ``hot`` classes share; those give no pairs."""
    order = np.lexsort((cls, sig))
    sig, cls = sig[order], cls[order]
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
    sig, cls = sig[keep], cls[keep]
    at = first_of(sig)
    size = np.diff(np.append(at, len(sig)))
    weight = np.where((sig[at] & U64(3)) >= U64(2), 1, NEED) if len(at) else size
    left, right, n, hots = [], [], [], []
    for length in np.unique(size[size > 1]).tolist():
        which = at[size == length]
        if length > hot:
            for s in which.tolist():
                hots.append((sig[s : s + length], cls[s : s + length]))
            continue
        i, j = np.triu_indices(length, 1)
        for s in range(0, len(which), step := max(1, (1 << 20) // len(i))):
            block = which[s : s + step]
            left.append(cls[(block[:, None] + i).ravel()])
            right.append(cls[(block[:, None] + j).ravel()])
            n.append(np.repeat(weight[np.searchsorted(at, block)], len(i)))
    if not left:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), hots
    a, b, n = np.concatenate(left), np.concatenate(right), np.concatenate(n)
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[at], b[at], np.add.reduceat(n, at), hots


def merge(rows: pa.Table) -> pa.Table:
    """Of one range: kind 0 texts (number, class, signatures), 1 pairs (a, b, shared), 2 hot (signature, number, texts)."""
    parts = []
    cols = [rows.column(c).to_pylist() for c in ("range", "base", "sig", "doc")]
    if cols[0][0] < 0:
        for _, base, c, n in zip(*cols):
            parts.append(_rows(0, base + np.arange(len(c) // 8), np.frombuffer(c, U64), np.frombuffer(n, np.int64)))
    else:
        sigs, texts = [], []
        for _, base, s, d in zip(*cols):
            sigs.append(np.frombuffer(s, "<u4").astype(U64))
            texts.append(base + np.cumsum(np.frombuffer(d, {4: np.uint8, 2: np.uint16, 1: np.uint32}[len(s) // len(d)]), dtype=np.int64))
        a, b, n, hots = pairs_within(np.concatenate(sigs), np.concatenate(texts), HOT)
        parts.append(_rows(1, a, b, n))
        for s, c in hots:
            parts.append(_rows(2, s | U64((cols[0][0] & 0x7FFFFF) << 40), c, np.full(len(c), len(c))))
    return pa.table({x: np.concatenate([p[x] for p in parts]) for x in ("kind", "a", "b", "n")})


def _block_pairs(threshold: float):
    """Pairs of the classes of two blocks that list one shingle, or of one block with itself, as far as their sizes allow."""

    def pairs(rows: pa.Table) -> pa.Table:
        cls, size, block, other = (rows.column(c).to_numpy() for c in ("cls", "size", "block", "other"))
        if block.min() == block.max() and other[0] == block[0]:
            order = np.argsort(size, kind="stable")
            left, right, own = cls[order], cls[order], True
            small, large = size[order], size[order]
        else:
            x, y = block < other, block > other
            x, y = np.flatnonzero(x)[np.argsort(size[x], kind="stable")], np.flatnonzero(y)[np.argsort(size[y], kind="stable")]
            left, right, own, small, large = cls[x], cls[y], False, size[x], size[y]
        # of sizes in order, those that can reach the threshold are a stretch
        lo, hi = np.searchsorted(large, np.ceil(small * threshold - 1e-9)), np.searchsorted(large, np.floor(small / threshold + 1e-9), "right")
        if own:
            lo = np.maximum(lo, np.arange(len(left)) + 1)
        n = np.maximum(hi - lo, 0)
        a, b = np.repeat(left, n), right[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "n": np.full(len(a), NEED, np.int64)})

    return pairs


def heavy_classes(hot: DataFrame, numbers: DataFrame, leads: DataFrame) -> DataFrame:
    """``cls, id`` of the classes with more hot signatures in a band than a text may leave out.

    hot: ``sig, number``; numbers: ``number, cls, sigs``; leads: ``cls, id``.
    """
    counts = hot.groupBy("number", F.col("sig").bitwiseAND(1).alias("band")).agg(F.count(F.lit(1)).alias("hot")).join(numbers, "number")
    return counts.where(F.col("hot") > F.least(F.lit(DROPS), F.floor(F.col("sigs") * DROP_SHARE))).select("cls").distinct().join(leads, "cls")


def prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """``a, b, n`` of the classes of ``sets`` (``cls, shingles``) that share one of their rarest shingles and whose sizes
    can reach the threshold; exact candidates."""
    listed = sets.mapInArrow(_lister, "cls long, size long, shingle array<long>").select("cls", "size", F.explode("shingle").alias("shingle"))
    counts = listed.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    known = listed.join(counts, "shingle")
    # shingles of one text come first in the order and pair nothing
    rank = F.row_number().over(Window.partitionBy("cls").orderBy("texts", "shingle")) + F.col("size") - F.count(F.lit(1)).over(Window.partitionBy("cls"))
    prefix = written(known.withColumn("rank", rank).where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).select("shingle", "cls", "size"), "prefix")
    blocks = prefix.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("shingle", F.ceil(F.col("texts") / BLOCK).cast("int").alias("blocks"))
    placed = prefix.join(blocks, "shingle").withColumn("block", F.pmod(F.hash("cls"), F.col("blocks")))
    met = placed.select("shingle", "cls", "size", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return met.groupBy("shingle", "low", "high").applyInArrow(_block_pairs(threshold), "a long, b long, n long").distinct()


def _lister(batches):
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
        yield pa.record_batch({"cls": batch.column("cls"), "size": pa.array([len(x) for x in sets], pa.int64()), "shingle": pa.array(sets, pa.list_(pa.int64()))})


def _verifier(threshold: float):
    def verify(batches):
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            both, size = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
            for i, (x, y) in enumerate(zip(left, right)):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                at = np.searchsorted(y, x)
                both[i] = np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)
                size[i] = len(x) + len(y) - both[i]
            ok = both >= threshold * size - 1e-9
            yield pa.record_batch({"a": pa.array(a[ok]), "b": pa.array(b[ok]), "jaccard": pa.array(both[ok] / size[ok])})

    return verify


def _setter(k: int):
    def sets(batches):
        for batch in batches:
            texts, cls = batch.column("text").to_pylist(), batch.column("cls").to_numpy()
            for s, e in slices(texts):
                d, h, n = shingle_sets(texts[s:e], k)
                ends = np.concatenate([[0], np.cumsum(n)])
                yield pa.record_batch({"cls": pa.array(cls[s:e]), "shingles": pa.array([h[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])], pa.binary())})

    return sets


def _sets(base: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``cls, shingles`` of the classes asked for (``cls, id``), from their texts. Few are sent to the texts; of many, the
    texts are shuffled to them."""
    few = asked.count() <= SENT_ROWS
    return base.join(F.broadcast(asked) if few else asked, "id").select("cls", "text").mapInArrow(_setter(k), "cls long, shingles binary").dropDuplicates(["cls"])


def similar_classes(df: DataFrame, id_column: str, text_column: str, threshold: float = 0.8, k: int = 5, miss: float = 5e-5) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of near-duplicate texts.

    members: ``cls, id``, the class of every text with at least one word (texts with one set of
    shingles have one class). pairs: ``a, b, jaccard`` of classes whose similarity reaches
    ``threshold``, a < b. Null, empty and word-less texts belong to no class; repeated ids are
    kept as often as they come. The work is in proportion to the texts and the candidates found.
    """
    base = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    named = written(base.mapInArrow(_classer(k), NAMED), "named")
    members = named.select("cls", "id")
    first = written(named.groupBy("cls").agg(F.min(F.struct("id", "key")).alias("first")).select("cls", "first.id", "first.key"), "first")
    leads = first.select("cls", "id")
    ranges = int(max(2, members.count() // ROWS_A_RANGE))
    signed = base.mapInArrow(_signer(k, threshold, miss, ranges, bloom_of(first, "key")), SIGNED).repartition(min(2 * ranges, MOST_TASKS), "range")
    merged = written(signed.groupBy("range").applyInArrow(merge, MERGED), "merged")
    numbers = merged.where("kind = 0").select(F.col("a").alias("number"), F.col("b").alias("cls"), F.col("n").alias("sigs"))
    of = lambda x: numbers.select(F.col("number").alias(x), F.col("cls").alias(f"cls_{x}"))
    met = merged.where("kind = 1").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= NEED)
    # a class that was indexed twice meets itself
    shared = met.join(of("a"), "a").join(of("b"), "b").where("cls_a <> cls_b").select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b"))
    hot = merged.where("kind = 2").select(F.col("a").alias("sig"), F.col("b").alias("number"))
    if not hot.isEmpty():
        heavy = written(heavy_classes(hot, numbers, leads), "heavy")
        if not heavy.isEmpty():
            shared = shared.unionByName(prefix_pairs(_sets(base, heavy, k), threshold).select("a", "b"))
    close = written(shared.distinct(), "close")
    asked = written(close.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(leads, "cls").select("cls", "id"), "asked")
    sets = _sets(base, asked, k)
    pairs = (
        close.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("left")), "a")
        .join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("right")), "b")
        .select("a", "b", "left", "right")
        .mapInArrow(_verifier(threshold), "a long, b long, jaccard double")
    )
    return members, pairs


def similar_pairs(df: DataFrame, id_column: str, text_column: str, threshold: float, k: int = 5) -> DataFrame:
    """``id_a, id_b`` (id_a < id_b) of all pairs of rows at the threshold or above, copies included.

    The result itself is as large as its number of pairs; ``similar_groups`` reports the same links
    without expanding copies.
    """
    members, pairs = similar_classes(df, id_column, text_column, threshold, k)
    own = members.select("cls", "id").distinct()
    pairs = written(pairs, "pairs")
    across = pairs.join(own.select(F.col("cls").alias("a"), F.col("id").alias("x")), "a").join(own.select(F.col("cls").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    many = own.join(own.groupBy("cls").count().where("count > 1").select("cls"), "cls", "left_semi")
    copies = many.select("cls", F.col("id").alias("x")).join(many.select("cls", F.col("id").alias("y")), "cls").where("x < y").select("x", "y")
    return across.unionByName(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the connected nodes of ``a, b``: each round joins every node to the least
    neighbour seen and halves paths (alternating large-star, small-star); edges stay distributed
    and every round is written to the shared folder."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for i in count():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u")
        next_edges = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_low.select("u", F.col("m").alias("v"))).where("u <> v")
        next_edges = written(next_edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"edges{i}")
        changed = next_edges.exceptAll(edges).isEmpty() and edges.exceptAll(next_edges).isEmpty()
        edges = next_edges
        if changed:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def similar_groups(df: DataFrame, id_column: str, text_column: str, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """One row for each text with words: ``id, class_id, copies, links, group_id``.

    class_id: least id among exact copies (equal shingle sets); links: number of other classes at
    the threshold or above; group_id: least id in the connected group of classes.
    """
    members, pairs = similar_classes(df, id_column, text_column, threshold, k)
    leads = members.groupBy("cls").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    pairs = written(pairs, "pairs")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    named = pairs.join(leads.select(F.col("cls").alias("a"), F.col("class_id").alias("x")), "a").join(leads.select(F.col("cls").alias("b"), F.col("class_id").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    groups = components(named).select(F.col("node").alias("class_id"), "root")
    return (
        members.select("cls", "id").join(leads, "cls").join(degree, "cls", "left").join(groups, "class_id", "left")
        .select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "class_id").alias("group_id"))
    )


def p5_found(spark, sf_dir: str) -> DataFrame:
    speeches = table(spark, sf_dir, "speeches").select("speech_id", "text")
    return similar_pairs(speeches, "speech_id", "text", 0.5).select(F.col("id_a").alias("speech_id_a"), F.col("id_b").alias("speech_id_b"))


def p5_groups(spark, sf_dir: str) -> DataFrame:
    speeches = table(spark, sf_dir, "speeches").select("speech_id", "text")
    return similar_groups(speeches, "speech_id", "text", 0.5).withColumnRenamed("id", "speech_id")
