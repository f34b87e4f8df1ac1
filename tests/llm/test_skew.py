"""One text, one source or one length holds a third of all rows."""

import collections

import pytest

from tonelens.llm import boilerplate, neardup, packing


def test_a_third_are_copies(spark):
    copy = " ".join(f"w{i}" for i in range(60))
    rows = [(i, copy if i % 3 == 0 else " ".join(f"t{i}x{j}" for j in range(40))) for i in range(900)]
    rows += [(1000, copy + " tail"), (1001, copy + " end")]
    got = {r.id: r for r in neardup.similar_groups(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    assert len(got) == 902 and got[0].copies == 300 and got[897].class_id == 0 and got[0].links == 2 and got[1001].group_id == 0 and got[1].links == 0


def notices(texts, shared, own):
    """Texts with a common notice of ``shared`` words and ``own`` words of their own; every tenth is an edit of the one before."""
    notice, out = [f"n{i}" for i in range(shared)], []
    for i in range(texts):
        j = i - 1 if i % 10 == 9 else i
        body = [f"t{j}x{w}" for w in range(own)]
        if j != i:
            body[own // 2] = "edit"
        out.append(" ".join(body + notice))
    return out


@pytest.mark.parametrize("shared, own", [(100, 200), (120, 130), (6, 40), (5, 24)])
def test_a_notice_in_every_text(spark, monkeypatch, shared, own):
    """A notice that is a third or nearly half of each text, or a tenth or more of each short text, makes no candidates of
    texts that have nothing else in common."""
    monkeypatch.setattr(neardup, "HOT", 8)
    made = []
    real = neardup.prefix_pairs
    monkeypatch.setattr(neardup, "prefix_pairs", lambda *a: made.append(real(*a)) or made[-1])
    texts = notices(400, shared, own)
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    _, pairs = neardup.similar_classes(df, "k", "t", 0.5)
    assert pairs.count() == 40 and all(r.jaccard > 0.6 for r in pairs.collect())
    assert sum(m.count() for m in made) <= 400


def test_a_third_are_one_source(spark):
    rows = [(i, "big" if i % 3 == 0 else f"s{i % 30}", f"Legal notice\nOwn line {chr(97 + i % 26)}{i // 26 * 'z'}\nSee also page {i}") for i in range(600)]
    got = boilerplate.lines_to_remove(spark.createDataFrame(rows, "k long, s string, t string"), "k", "t", "s").collect()
    assert collections.Counter(r.line_no for r in got) == {1: 600, 3: 600}


def test_a_third_have_one_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_A_BUCKET", 40)
    sizes = [(i, 100 if i % 3 == 0 else 1 + i % 97) for i in range(1500)]
    rows = packing.packed(spark.createDataFrame(sizes, "id long, tokens long"), 256).collect()
    fill = collections.Counter()
    for r in rows:
        fill[r.container] += r.tokens
    assert len(rows) == 1500 and max(fill.values()) <= 256 and sum(fill.values()) == sum(n for _, n in sizes)
    assert len({(r.id, r.piece) for r in rows}) == 1500
