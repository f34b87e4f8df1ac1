"""The whole job: nothing is left out by a sample or a choice of positions, and what is shuffled follows the input."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelens.llm import garbled, leaks, lookalike, neardup

RUSSIAN = "Председатель банка сообщил, что инфляция остаётся высокой и ставка будет сохранена."


@pytest.fixture(scope="module")
def passages(spark, sf):
    """More clean passages than any one language has, the others after them."""
    first = spark.range(10_001).select(F.lit("en").alias("lang"), F.lit("plain words of one language").alias("text")).coalesce(1)
    return first.unionByName(spark.read.parquet(f"{sf}/lang_samples.parquet").select("lang", "text"))


def test_signatures_take_no_more_room_in_more_ranges(spark, monkeypatch, tmp_path):
    """A corpus of more rows cuts its signatures into more ranges."""
    real = neardup._signer
    texts = [" ".join(f"t{i}x{j}" for j in range(160)) for i in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")

    def sent(rows_a_range):
        at = str(tmp_path / str(rows_a_range))
        os.mkdir(at)

        def measured(*args):
            sign = real(*args)

            def run(batches):
                total = 0
                for batch in sign(batches):
                    total += batch.nbytes
                    yield batch
                with open(f"{at}/{os.getpid()}-{id(batches)}", "w") as f:
                    f.write(str(total))

            return run

        monkeypatch.setattr(neardup, "_signer", measured)
        monkeypatch.setattr(neardup, "ROWS_A_RANGE", rows_a_range)
        _, pairs = neardup.similar_classes(df, "k", "t", 0.5)
        assert pairs.count() == 0
        return sum(int(open(f).read()) for f in glob.glob(f"{at}/*"))

    assert sent(1) < 1.2 * sent(400)


def test_phrases_in_common_make_few_pairs():
    """Texts that share a tenth of their shingles, as phrases of the trade are, aren't written as pairs for it, and a text of
    any length has few signatures."""
    rng = np.random.default_rng(5)
    phrases = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.integers(0, 1 << 63, 270, dtype=np.uint64), rng.choice(phrases, 30, False)])) for _ in range(400)]
    n = np.array([len(x) for x in sets])
    doc, sig = neardup.signatures(np.repeat(np.arange(400), n), np.concatenate(sets), n, 0.5, 5e-5)
    left, _, _, hots = neardup.pairs_within(sig, doc, neardup.HOT)
    assert len(sig) <= 200 * 400 and len(left) < 100 and not hots


@pytest.mark.parametrize("size", [32, 300])
def test_pairs_at_the_threshold_share_signatures(size):
    """Of pairs exactly at the threshold, as many signatures are shared as the plan counts on."""
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(400):
        both = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
        sets += [np.sort(both[: size * 3 // 2]), np.sort(both[size // 2 :])]
    n = np.array([len(x) for x in sets])
    doc, sig = neardup.signatures(np.repeat(np.arange(800), n), np.concatenate(sets), n, 0.5, 5e-5)
    least, signed = neardup.plan(0.5, 5e-5)
    at = doc.argsort(kind="stable")
    sig = sig[at][(sig[at] & np.uint64(3)) == 3].reshape(800, signed)
    shared = (sig[::2] == sig[1::2]).sum(1)
    assert abs(shared.mean() - signed * 0.5**least) < 1 and shared.min() >= neardup.NEED


def test_one_form_tells_garbled_texts_by_all_passages(spark, passages):
    seen = RUSSIAN.encode("cp1251").decode("cp1252")
    df = spark.createDataFrame([(1, seen + "\u200b"), (2, RUSSIAN + "\u200b")], "k long, t string")
    got = {r.id: (r.changes > 0, r.garbled) for r in lookalike.unified(df, "k", "t", passages, all_rows=False).collect()}
    assert got == {1: (True, True), 2: (True, False)}


def test_letters_of_one_shape(spark):
    """Letters look alike by their shape in ICU's table, be it a letter of the texts, another one or several."""
    posing = {
        1: ("Straβe", "Straße"), 2: ("сτавκа", "ставка"), 3: ("Γлава", "Глава"), 4: ("миʜисτр", "министр"), 5: ("gꝏd bꝏk", "good book"), 6: ("Cӕsar", "Cæsar"),
        7: ("nuꮯlear Ꜳchen", "nuclear AAchen"), 8: ("paymenʦ", "payments"), 9: ("𑜀oney", "money"), 10: ("Φирма", "Фирма"),
    }
    order = {11: "STRAẞE", 12: "πρώτα Γάμμα", 13: "Ћирилица", 14: "Straße", 15: "Ǎn Ơ ɓ"}
    df = spark.createDataFrame([(k, v[0]) for k, v in posing.items()] + list(order.items()), "k long, t string")
    got = {r.id: (r.changes > 0, r.unified) for r in lookalike.unified(df, "k", "t").collect()}
    assert got == {k: (True, v[1]) for k, v in posing.items()} | {k: (False, v) for k, v in order.items()}


def test_no_shorter_table_without_icu():
    with pytest.raises(RuntimeError, match="ICU"):
        lookalike.public_alike(object())


def test_letter_pairs_of_all_passages(spark, passages, sf):
    """Counted where they lie, pairs are those of the passages read one by one."""
    rows = [tuple(r) for r in passages.collect()]
    got, want = garbled.learned(passages), garbled.Plausible(rows)
    letters = garbled.asked_letters()
    assert got.bits == want.bits and len(got.bits) > 100
    assert {k: v for k, v in got.known.items() if v} == {k: v for k, own in want.known.items() if (v := {p for p in own if letters.issuperset(p)})}


def test_restored_by_all_passages(spark, passages):
    seen = RUSSIAN.encode("cp1251").decode("cp1252")
    n, want = garbled.repair(seen, garbled.Plausible([tuple(r) for r in passages.collect()]))
    got = garbled.garbled(spark.createDataFrame([(1, seen), (2, RUSSIAN)], "k long, t string"), "k", ["t"], passages, restored=True).collect()
    assert [(r.id, r.garbled, r.restored) for r in got] == [(1, n, want)] and want.startswith("Председатель банка")


def test_similar_looks_at_every_window(spark):
    """Items one after the other make one run of windows, and so do items in which a part comes again."""
    items = [(i, " ".join(f"v{i}x{j}" for j in range(40))) for i in range(5)]
    again = " ".join(f"r{j}" for j in range(30))
    items.append((5, again + " so it goes" * 10))
    docs = [(1, " ".join(t for _, t in items[:5])), (2, "before " + items[5][1] + " after"), (3, again + " on and on" * 10)]
    frame = lambda rows: spark.createDataFrame(rows, "k long, t string")
    got = {(r.item, r.doc): r.similarity for r in leaks.similar(frame(docs), "k", "t", frame(items), "k", "t").collect()}
    assert got == {(i, 1): 1.0 for i in range(5)} | {(5, 2): 1.0}


def test_others_are_counted_once_in_each_run():
    rng = np.random.default_rng(3)
    for n, m in [(1, 1), (30, 1), (30, 7), (30, 30)]:
        h = rng.integers(0, 8, n).astype(np.uint64)
        hit = np.isin(h, [1, 5])
        before = leaks.place_before(np.zeros(n), h, hit)
        assert leaks.others(before, m).tolist() == [len(set(h[s : s + m][~hit[s : s + m]].tolist())) for s in range(n - m + 1)]
