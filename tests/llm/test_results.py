"""Operators against brute force, round trips and held-out accuracy."""

import collections
import glob
import itertools
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonelens.llm import boilerplate, garbled, language, leaks, lookalike, neardup, packing, repetition, scanned, tokens
from tonelens.llm.queries import QUERIES, SQL
from tonelens.llm.textkit import LAST, Codes, Words

WORD = re.compile(r"[^\W_]+")


def words_of(text):
    return WORD.findall((text or "").lower())


def grams(w, k):
    return list(zip(*[w[i:] for i in range(k)]))


@pytest.fixture(scope="module")
def speeches(spark, sf):
    return spark.read.parquet(f"{sf}/speeches.parquet")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def samples(spark, sf):
    return spark.read.parquet(f"{sf}/lang_samples.parquet")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1é_-' \n\0Ж", max_size=30)), max_size=6))
def test_words_equal_regex(texts):
    w = Words(Codes(texts))
    for d, t in enumerate(texts):
        assert [w.word(i) for i in range(w.first[d], w.first[d + 1])] == words_of(t)
    pairs = collections.defaultdict(set)
    for i in range(len(w)):
        pairs[w.word(i)].add(int(w.hash[i]))
    assert all(len(v) == 1 for v in pairs.values()) and len({v for s in pairs.values() for v in s}) == len(pairs)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted((tuple(r[n] for n in names) for r in QUERIES[name](spark, sf).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_tiny_texts_with_hot_signatures(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 2)
    texts = [f"a b c d e x{i}" for i in range(6)] + ["a b c d e"] + [f"q{i} a b c d e" for i in range(3)]
    got = neardup.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t", 0.5)
    assert set(map(tuple, got.collect())) == brute_pairs(texts, 0.5)


# Near duplicates


def planted(seed=3, groups=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 12, 30, 80, 200, 500]))]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[at], "x"]])
            out.append(" ".join(copy))
    return out + ["same short", "same short", "legal line " * 3] * 3


def brute_pairs(texts, threshold, k=5):
    sets = [set(grams(words_of(t), k)) or ({tuple(words_of(t))} if words_of(t) else set()) for t in texts]
    return {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_pairs_equal_brute_force(spark, threshold):
    texts = planted()
    got = neardup.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t", threshold).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute_pairs(texts, threshold)


@pytest.mark.parametrize("shared, own, threshold", [(40, 20, 0.4), (30, 200, 0.5)])
def test_hot_signatures(spark, monkeypatch, shared, own, threshold):
    """Texts made of common lines for the larger part, and texts with a few of them; some of these similar."""
    monkeypatch.setattr(neardup, "HOT", 3)
    monkeypatch.setattr(neardup, "BLOCK", 5)
    common = " ".join(f"c{i}" for i in range(shared))
    texts = [f"{common} " + " ".join(f"t{i - i % 2 * (own > 100)}x{j if j % 50 else i}" for j in range(own)) for i in range(12)]
    want = brute_pairs(texts, threshold)
    got = neardup.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t", threshold)
    assert set(map(tuple, got.collect())) == want and len(want) == (66 if own == 20 else 6)


def test_many_variants_and_texts_that_contain_them(spark):
    """Variants of one text share signatures in more than HOT classes; texts nearly twice as long agree in no others."""
    base = [f"b{i}" for i in range(258)]
    texts = [" ".join(base[:at] + [f"v{at}"] + base[at + 1 :]) for at in range(10, 248, 2)]
    texts += [" ".join(base + [f"o{i}x{j}" for j in range(236)]) for i in range(12)]
    want = brute_pairs(texts, 0.5)
    got = neardup.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t", 0.5)
    assert set(map(tuple, got.collect())) == want and sum(b >= 119 for a, b in want) == 119 * 12


def test_groups(spark):
    texts = planted(5)
    rows = {r.id: r for r in neardup.similar_groups(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t").collect()}
    up = {i: i for i in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in brute_pairs(texts, 0.8):
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert set(rows) == {i for i, t in enumerate(texts) if words_of(t)} and {i: r.group_id for i, r in rows.items()} == {i: root(i) for i in rows}


def test_p5_found(spark, sf, speeches):
    rows = [(r.speech_id, r.text) for r in speeches.where("trim(text) <> ''").select("speech_id", "text").collect()]
    want = {tuple(sorted((rows[i][0], rows[j][0]))) for i, j in brute_pairs([t for _, t in rows], 0.5)}
    assert set(map(tuple, QUERIES["p5_found"](spark, sf).collect())) == want and want


# Lines


def test_p7_found(spark, sf, speeches):
    line = lambda x: re.sub("[0-9]+", "#", " ".join(x.split()).lower())
    rows = [r for r in speeches.collect() if r.text and r.text.strip() and r.CentralBank is not None]
    total, seen = collections.Counter(r.CentralBank for r in rows), collections.Counter()
    for r in rows:
        seen.update({(r.CentralBank, line(x)) for x in r.text.split("\n") if line(x)})
    want = {(r.speech_id, i + 1) for r in rows for i, x in enumerate(r.text.split("\n")) if line(x) and seen[r.CentralBank, line(x)] >= max(6, 0.1 * total[r.CentralBank])}
    assert set(map(tuple, QUERIES["p7_found"](spark, sf).collect())) == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=5), min_size=1, max_size=8))
def test_blocks_equal_brute_force(runs):
    runs = [[1, *r] for r in runs]
    got = boilerplate.blocks_of_shard(runs, np.arange(len(runs)), np.ones(len(runs), int), 2)
    count = collections.Counter(tuple(r[:n]) for r in runs for n in range(1, len(r) + 1))
    frequent = {b: n for b, n in count.items() if n >= 2}
    assert got == {b: n for b, n in frequent.items() if not any(c[:-1] == b and m == n for c, m in frequent.items())}


def test_lines_removed(spark):
    rows = [(i, "S", f"Share this\n  page {i}\n\nOwn text of {chr(97 + i)}.\nBACK  to all") for i in range(8)] + [(9, "T", "Share this"), (10, None, "Share this")]
    df = spark.createDataFrame(rows, "k long, s string, t string")
    kept = {r.id: r.kept for r in boilerplate.without_lines(df, "k", "t", "s").collect()}
    assert kept[0] == "\nOwn text of a." and kept[9] == kept[10] == "Share this"
    blocks = boilerplate.line_blocks(df, "k", "t", "s")[1].collect()
    assert {(len(b.block), b.docs) for b in blocks} == {(2, 8), (1, 8)}


def test_blocks_of_several_lines(spark):
    """A notice of two lines in 7 of 100 documents goes where it stands whole; its lines stay where they stand alone."""
    rows = [(i, "S", f"Own text {chr(97 + i % 26)}{'z' * (i // 26)}.\n" + ("All rights reserved\n\nWrite to us" if i < 7 else "Write to us" if i < 9 else "Nothing")) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, s string, t string")
    of = lambda **more: {(r.id, r.line_no) for r in boilerplate.lines_to_remove(df, "k", "t", "s", share=0.95, **more).collect()}
    assert of() == set() and of(block_share=0.05) == {(i, n) for i in range(7) for n in (2, 4)}


# Leaks and repetition


def test_p9_found(spark, sf, documents):
    items = spark.read.parquet(f"{sf}/eval_items.parquet").collect()
    index = collections.defaultdict(set)
    for r in items:
        for g in grams(words_of(r.text), 13):
            index[g].add(r.item_id)
    want = {(i, r.doc_id) for r in documents.collect() for g in grams(words_of(r.text), 13) for i in index.get(g, ())}
    assert set(map(tuple, QUERIES["p9_found"](spark, sf).collect())) == want and want


def test_one_run_in_many_items(spark):
    base = " ".join(f"tok{i}" for i in range(40))
    items = spark.createDataFrame([(i, f"{base} own{i} " + " ".join(f"z{i}q{j}" for j in range(20))) for i in range(5)], "k long, t string")
    docs = spark.createDataFrame([(1, "before " + base + " after"), (2, "nothing in common here at all")], "d long, x string")
    assert set(map(tuple, leaks.leaked(docs, "d", "x", items, "k", "t").collect())) == {(i, 1) for i in range(5)}
    whole = spark.createDataFrame([(1, f"before {base} own1 " + " ".join(f"z1q{j}" for j in range(20)) + " after")], "d long, x string")
    near = leaks.similar(whole, "d", "x", items, "k", "t").collect()
    assert [(r.item, r.doc, r.similarity) for r in near] == [(1, 1, 1.0)]


def test_bloom_has_no_false_negatives(spark):
    keys = [random.Random(5).getrandbits(63) for _ in range(5000)]
    held = leaks.bloom_of(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    assert held.holds(np.array(keys, np.uint64)).all()
    assert held.holds(np.array([random.Random(6).getrandbits(64) for _ in range(5000)], np.uint64)).mean() < 0.05


@pytest.mark.parametrize("radius", [0, 3, 10])
def test_blocks_find_all_within_radius(spark, radius):
    """Fingerprints within the radius agree in a block; blocks have all bits once."""
    rng = random.Random(radius)
    rows = []
    for i in range(200):
        x = rng.getrandbits(128)
        y = x
        for bit in rng.sample(range(128), rng.randint(0, radius)):
            y ^= 1 << bit
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        rows.append((i, *[signed(v & (2**64 - 1)) for v in (x, x >> 64, y, y >> 64)]))
    df = spark.createDataFrame(rows, "i long, a long, b long, c long, d long")
    got = df.select("i", leaks.blocks(F.col("a"), F.col("b"), radius).alias("x"), leaks.blocks(F.col("c"), F.col("d"), radius).alias("y"))
    assert got.where(F.size(F.array_intersect("x", "y")) > 0).count() == 200
    assert all(len(r.x) == (radius + 1 if radius else 1) for r in got.collect())


def test_similar_recall(spark, documents):
    """Items with words changed, put in, left out and cut off at the ends, against brute force over all windows."""
    rng = random.Random(4)
    items = [(i, [f"v{rng.randrange(400)}" for _ in range(rng.choice([12, 30, 60, 110]))]) for i in range(40)]
    hosts = [words_of(r.text) for r in documents.collect()]
    docs = []
    for i, w in items:
        for _ in range(5):
            w2, host = list(w), rng.choice(hosts)
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(w2))
                w2[at : at + 1] = rng.choice([[], ["other"], [w2[at], "more"]])
            w2, at = w2[rng.choice([0, 0, 2]) :], rng.randrange(len(host) + 1)
            docs.append((len(docs), i, host[:at] + w2 + host[at:]))
    spread = collections.Counter(g for _, w in items for g in set(grams(w, 5)))
    want = set()
    for d, i, x in docs:
        w = items[i][1]
        own, m = set(grams(w, 5)), len(w) - 4
        total = sum(1 / spread[g] for g in own)
        g = grams(x, 5)
        for at in range(max(0, len(g) - m + 1)):
            there = set(g[at : at + m])
            if sum(1 / spread[x] for x in there & own) >= 0.8 * (total + sum(1 / spread[x] if x in spread else 1 for x in there - own)) - 1e-9:
                want.add((i, d))
    got = leaks.similar(spark.createDataFrame([(d, " ".join(x)) for d, _, x in docs], "d long, x string"), "d", "x", spark.createDataFrame([(i, " ".join(w)) for i, w in items], "k long, t string"), "k", "t")
    got = {(r.item, r.doc) for r in got.collect()}
    assert len(want) > 100 and len(want & got) >= 0.95 * len(want)


def test_p10_found(spark, sf, documents):
    want = set()
    for r in documents.collect():
        w, seen = words_of(r.text), set()
        inside = [False] * len(w)
        for i, g in enumerate(grams(w, 8)):
            if g in seen:
                inside[i : i + 8] = [True] * 8
            seen.add(g)
        if w and sum(inside) >= 0.3 * len(w):
            want.add(r.doc_id)
    assert {r.doc_id for r in QUERIES["p10_found"](spark, sf).collect()} == want and want


def test_binomial_bound_and_cutoffs():
    for k, n in ((0, 50), (3, 40), (10, 100)):
        p = repetition.upper_bound(k, n, 0.05)
        assert sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(0.05, abs=1e-6)
    assert repetition.upper_bound(5, 5, 0.05) == repetition.upper_bound(0, 0, 0.05) == 1.0
    grid = len(repetition.GRID)
    counts = {("phrase_share", 0): (5000, [0] * grid), ("line_share", 0): (5000, [0] * 3 + [4000] * (grid - 3)), ("line_share", 1): (5, [0] * grid)}
    cut = repetition.cutoffs(counts, 0.02, 0.05)
    assert cut["phrase_share", 0] == repetition.GRID[-1] and cut["line_share", 0] == repetition.GRID[2] and cut["line_share", 1] is None


def test_cutoffs_hold_on_documents_not_seen(spark):
    """Cutoffs of one half of the documents reject at most about alpha of the good ones of the other half; phrases that
    good documents repeat move the phrase cutoff up, and no case is lost."""
    rng = random.Random(3)

    def text(i):
        w = [f"w{i}x{j}" for j in range(120)]
        phrase = [f"p{i}x{j}" for j in range(6)]  # repeated phrases too short to be runs of eight
        for _ in range(rng.choice([0, 0, 0, 1, 3])):
            at = rng.randrange(len(w))
            w[at:at] = phrase
        return " ".join(w * 2 if i % 40 == 0 else w)

    rows = [(i, text(i)) for i in range(3000)]
    halves = [spark.createDataFrame(rows[h::2], "k long, t string") for h in (0, 1)]
    cut = {(r.share, r.stratum): r for r in repetition.flagged(halves[0], "k", "t")[1].collect()}
    docs = repetition.flagged(halves[1], "k", "t")[0].collect()
    good = [d for d in docs if d.run_share < 0.3]
    for s in repetition.SHARES:
        c = cut[s, 1]
        assert c.certified and sum(d[s] >= c.cutoff for d in good if d.stratum == 1) <= 0.03 * len(good)
    assert 0.05 < cut["phrase_share", 1].cutoff <= 0.3
    docs = repetition.flagged(halves[0], "k", "t")[0].collect()
    assert {d.id for d in docs if d.run_share >= 0.3} == {d.id for d in docs if d.rejected_by and d.run_share >= 0.3} == {i for i in range(0, 3000, 40)}


def test_cutoffs_rest_on_all_documents(spark):
    """600 documents certify all shares; an eighth of them would certify none."""
    texts = [" ".join(f"w{i}x{j}" for j in range(70)) for i in range(600)]
    again = "Own line\n" * 30 + " ".join(f"y{j}" for j in range(70))
    df = spark.createDataFrame([*enumerate(texts), (600, again)], "k long, t string")
    docs, cuts = repetition.flagged(df, "k", "t")
    assert {(r.share, r.certified) for r in cuts.where("stratum = 1").collect()} == {(s, True) for s in repetition.SHARES}
    assert [r.id for r in docs.where("array_contains(rejected_by, 'line_share')").collect()] == [600]


@pytest.mark.parametrize("k, n", [(0, 50), (0, 400), (3, 900), (10, 900), (18, 1000), (40, 2000)])
def test_certified_equals_the_bound(k, n):
    assert repetition.certified(k, n, 0.02, 0.003) == (repetition.upper_bound(k, n, 0.003) <= 0.02)


# Encodings, look-alikes, languages


def test_garbling_round_trip(samples):
    rows = samples.collect()
    plausible = garbled.Plausible([(r.lang, r.text) for r in rows])
    for r in rows:
        assert garbled.repair(r.text, plausible) == (0, r.text)
        wide = ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251") if r.lang != "ru" else ("cp1252", "latin-1", "cp1251")
        for taken in wide:
            broken = garbled.decoded(r.text.encode("utf-8"), taken)
            n, fixed = garbled.repair(broken, plausible)
            assert fixed == r.text and n == sum(not c.isascii() for c in r.text), (taken, r.lang)
        if r.lang == "ru":
            for true, taken in (("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r")):
                n, fixed = garbled.repair(r.text.encode(true).decode(taken), plausible)
                letters = [a == b for a, b in zip(fixed, r.text) if "а" <= b.lower() <= "я"]
                assert sum(letters) > 0.97 * len(letters) and n > 50
    for taken in garbled.WESTERN["cp1252"]:
        letters = []
        for r in rows:
            if r.lang != "ru":
                true = r.text.encode("cp1252", "ignore")
                seen = garbled.decoded(true, taken)
                letters += [a == b for a, b, c in zip(garbled.repair(seen, plausible)[1], true.decode("cp1252"), seen) if not b.isascii() and b.isalpha() and b != c]
        assert sum(letters) >= 0.95 * len(letters), taken
    lost = "a�b�c�"
    assert garbled.repair(lost, plausible) == (3, lost)


def test_text_in_other_languages_stays(samples):
    plausible = garbled.Plausible([(r.lang, r.text) for r in samples.collect()])
    for x in (
        "Łukasz Dvořák of Łódź met Jiří Čapek and Ştefan", "Wałęsa spoke in Gdańsk about inflation",
        "Příliš žluťoučký kůň úpěl ďábelské ódy. Česká národní banka ponechala úrokové sazby beze změny.",
        "Zażółć gęślą jaźń. Narodowy Bank Polski utrzymał stopy procentowe, a członkowie Rady będą się spotykać.",
        "Türkiye Cumhuriyet Merkez Bankası, enflasyon görünümünü değerlendirdi; İstanbul'da çalıştı, şu ağır kış.",
        "Banca Naţională a României a menţinut rata dobânzii şi a spus că ţintele sunt îndeplinite. CĂŞTIGUL ŢĂRII",
        "Magyar Nemzeti Bank elnöke: a jegybanki alapkamat változatlan, őszinte hűség és törődés.",
    ):
        assert garbled.repair(x, plausible) == (0, x)
    mixed = "Président Dvořák : aprčs la réunion, le progrčs est dčs lors décidé ŕ Łódź et trčs net."
    assert garbled.repair(mixed, plausible) == (5, "Président Dvořák : après la réunion, le progrès est dès lors décidé à Łódź et très net.")
    assert garbled.repair("Wrocław i ŁódÅº, Å‚adnie", plausible)[1] == "Wrocław i Łódź, ładnie"


@pytest.fixture(scope="module")
def alike(spark):
    public = lookalike.public_alike(spark)
    assert len(public) > 300 and {"ꓐB", "ᏢP"} <= set(public)
    return (*lookalike.ALIKE, *(p for p in public if p[0] not in {x[0] for x in lookalike.ALIKE}))


def writer_of(alike):
    counts = np.zeros(LAST, np.int64)
    for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789éабвгдежзийклмнопрстуфхцчшщъыьэюя":
        counts[ord(c)] = 100
    return lookalike.Rewriter(*lookalike.representatives(counts, alike), lookalike.unusual_letters(alike))


def test_classes_hold_one_plain_character(alike):
    for group in lookalike.classes(alike).members().values():
        assert len({m for m in group if len(m) == 1 and m.isascii()}) <= 1, group


def test_lookalikes(alike):
    writer = writer_of(alike)
    cases = {
        "ｆｕｌｌ １２": "full 12", "cafe\u0301": "café", "zero\u200bwidth\u00adsoft\ufeff": "zerowidthsoft", "a\u00a0b\u3000c": "a b c", "ﬁne 𝐛𝐨𝐥𝐝": "fine bold",
        "pаyment ѕystem rıѕk": "payment system risk", "внyтpеннюю": "внутреннюю", "exchɑnɡe": "exchange", "и\u0306": "й",
        "cafe\u200b\u0301": "café", "caf\uff45\u0301": "café", "ê\u0301": "ế", "ꓐank ꮯredit ᏢRICE": "Bank credit PRICE",
    }
    for x, want in cases.items():
        got, n = writer.rewrite(x)
        assert got == want and n > 0 and writer.suspects([x]).tolist() == [0]
    assert writer.rewrite("слово，") == ("слово,", 0)
    for x in ("plain text", "café – “quoted” © €5\n\f", "слово word", "Москва", "naïve façade", "ꓐꓮꓠꓗ", "Łódź Dvořák"):
        assert writer.rewrite(x) == (x, 0) and not len(writer.suspects([x]))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeoıcpyxABEKn 1аеорсухАВКгджαορΑｅａ\u0301\u0308\u0323\u200b\u00ad\ufb01êếꓐᏢɑɡ\u00a0\n-", max_size=24))
def test_one_form_stays(alike, text):
    global _WRITER
    try:
        writer = _WRITER
    except NameError:
        writer = _WRITER = writer_of(alike)
    once, _ = writer.rewrite(text)
    assert writer.rewrite(once) == (once, 0)
    assert len(writer.suspects([text])) or once == text


def test_language_held_out(samples):
    rows = sorted(samples.collect(), key=lambda r: r.sample_id)
    coder = language.Coder([(r.lang, r.text) for r in rows if r.sample_id % 5])
    held = [r for r in rows if r.sample_id % 5 == 0]
    _, top, sure = language.label([r.text for r in held], coder)
    assert np.mean([coder.langs[t] == r.lang for t, r in zip(top, held)]) == 1.0 and min(sure) > 0.9
    mixed = held[0].text + "\n\n" + next(r.text for r in held if r.lang not in (held[0].lang, "ru"))
    s, _, _ = language.label([mixed], coder)
    assert {coder.langs[i] for i in s["lang"]} == {held[0].lang, next(r.lang for r in held if r.lang not in (held[0].lang, "ru"))}


def test_passages_and_documents_agree(spark, samples):
    """Passages lie in the stored text, also where it is garbled, and have the languages of the documents' shares."""
    of = {r.lang: r.text for r in samples.collect()}
    texts = [of["ru"].encode("cp1251").decode("latin-1"), of["fr"].encode().decode("cp1252", "replace") + "\n\n" + of["de"], of["en"] + "\n\n" + of["ru"], "", "12 34", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    shares = {(r.id, r.lang): r for r in language.language_shares(df, "k", "t", samples).collect()}
    assert set(shares) == {(0, "ru"), (1, "fr"), (1, "de"), (2, "en"), (2, "ru")} and all(r.confidence > 0.9 for r in shares.values())
    words = collections.Counter()
    for r in language.language_passages(df, "k", "t", samples).collect():
        assert 0 <= r.start < r.end <= len(texts[r.id]) and 0.5 < r.confidence <= 1
        words[r.id, r.lang] += r.words
    assert words == {k: r.words for k, r in shares.items()}
    assert language.language_passages(df, "k", "t", samples).where("id = 2 AND lang = 'ru'").first().start >= len(of["en"])


def test_code_lengths_are_exact():
    tree = language.ContextTree(["aab ab"])
    for context in (b" ", b"a", b"zz", b" aa"):
        assert sum(2 ** -tree.bits(context, b) for b in range(256)) <= 1.0 + 1e-9
    assert tree.bits(b" ", ord("a")) < tree.bits(b" ", ord("b"))


def test_stated_language(spark):
    df = spark.createDataFrame([("EN-gb",), ("German",), (" fra ",), ("unknown",), ("und",), ("-",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(language.stated_language(F.col("c"))).collect()] == ["en", "de", "fr", None, None, None, None, None]


# Scanned pages


def test_scanned_pages(spark):
    rng = random.Random(1)
    nouns = "market output demand inflation exchange credit growth policy housing harvest".split()
    sentence = lambda: f"The {rng.choice(nouns)} supported the {rng.choice(nouns)} while the {rng.choice(nouns)} weakened."
    clean = [(i, "\n\n".join(" ".join(sentence() for _ in range(4)) for _ in range(3))) for i in range(400)]
    noisy = "The exchange markef supp-\norted the out-\nput while thc demand\nweakened.\n\n- 3 -\n\nThe infla-\ntion weakened the\nharvest."
    wrapped = "The market supported the\ndemand while the output\nweakened."
    df = spark.createDataFrame([*clean, (1000, noisy), (1001, wrapped), (1002, None)], "k long, t string")
    rows = scanned.scanned(df, "k", "t", restored=True).collect()
    assert [r.id for r in rows] == [1000] and rows[0].hyphens == 3 and rows[0].misread == 2 and rows[0].furniture == 1
    assert rows[0].repaired == "The exchange market supported the output while the demand weakened.\n\nThe inflation weakened the harvest."


def test_vectors_decide(spark):
    """A rare word one glyph from a frequent one is a misreading where the frequent word is at home, and not where other
    words stand around; without vectors the glyphs alone would take both."""
    rng = random.Random(2)
    sea, bank = "ships sail over calm waters near the harbour wall".split(), "rates rise when credit grows and lenders expand".split()
    lines = lambda topic, word: " ".join(" ".join([*rng.sample(topic, 4), word, *rng.sample(topic, 4)]) for _ in range(12))
    rows = [(i, lines(sea, "tide") if i % 2 else lines(bank, "loan")) for i in range(400)]
    # "tidc" among ships is a misread "tide"; "tidc" among lenders is none
    right, wrong = " ".join(rng.sample(sea, 4) + ["tidc"] + rng.sample(sea, 4)), " ".join(rng.sample(bank, 4) + ["tidc"] + rng.sample(bank, 4))
    df = spark.createDataFrame(rows, "k long, t string")
    words, counts, total, rare = scanned.frequent_words(df, "t")
    vectors = scanned.skip_gram(df, "t", words, counts, total)
    of = lambda v, t: int(scanned.Reader(scanned.Lexicon(words, counts, v, rare)).measure([t])[1][0])
    assert (of(vectors, right), of(vectors, wrong)) == (1, 0) and (of({}, right), of({}, wrong)) == (1, 1)


def test_words_too_frequent_to_be_misread(spark):
    rows = [(i, "the rate of the market and the rafe of the harbour") for i in range(300)] + [(1000 + i, "the market") for i in range(3000)] + [(9999, "the markef fell")]
    words, counts, total, rare = scanned.frequent_words(spark.createDataFrame(rows, "k long, t string"), "t")
    lexicon = scanned.Lexicon(words, counts, {}, rare)
    assert lexicon.link("rafe") == [] and lexicon.link("markef") == ["market"]


def test_furniture():
    lines = ["Bank of X   12", "text goes on", "Page 3 of 9", "[4]", "xii", "29.", "In 2013", "A head", "which breaks", "A head", "the sentence"]
    assert scanned.furniture_lines(lines) == {0, 2, 3, 4, 7, 9}


# Tokens and packing


def test_token_estimates(spark, sf, speeches):
    got = {r.speech_id: r.tokens for r in QUERIES["p3_tokens"](spark, sf).collect()}
    rows = speeches.select("speech_id", "text").collect()
    true = dict(zip([r.speech_id for r in rows], tokens.count_tokens([r.text for r in rows], tokens.vocabulary()).tolist()))
    assert set(got) == set(true) and sum(got.values()) == pytest.approx(sum(true.values()), rel=0.03)
    assert np.median([abs(got[i] - n) / n for i, n in true.items() if n]) < 0.08
    totals = QUERIES["p3_totals"](spark, sf).collect()
    for dimension in ("bank", "lang", "source", "host"):
        own = [r for r in totals if r.dimension == dimension]
        assert sum(r.speeches for r in own) == len(rows) and sum(r.tokens for r in own) == pytest.approx(sum(got.values()), rel=1e-3)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=20))
def test_plan_uses_every_item_once(counts):
    made = packing.plan(counts, 32)
    used = collections.Counter()
    for pattern, times in made:
        assert sum(pattern) <= 32 and times > 0
        for x in pattern:
            used[x] += times
    assert used == collections.Counter(counts)
    total, bins = sum(k * n for k, n in counts.items()), sum(t for _, t in made)
    assert bins <= 2 * math.ceil(total / 32) + 1


def test_packed(spark):
    sizes = [(i, 1 + (i * 37) % 900) for i in range(3000)] + [(5000, 2500), (5001, 1024), (5002, 0), (5003, None), (None, 7)]
    rows = packing.packed(spark.createDataFrame(sizes, "id long, tokens long"), 1024).collect()
    fill = collections.Counter()
    for r in rows:
        if r.container is not None:
            fill[r.container] += r.tokens
    assert max(fill.values()) <= 1024 and sum(fill.values()) == sum(n or 0 for _, n in sizes)
    assert sorted(r.tokens for r in rows if r.id == 5000) == [452, 1024, 1024]
    assert all(n == 1 for i, n in collections.Counter(r.id for r in rows).items() if i != 5000)
    assert len(fill) <= 1.01 * sum(fill.values()) / 1024 + 1
    assert {r.id for r in rows if r.container is None} == {5002, 5003}
