"""Benchmark copies against a plain alignment of every document with every item."""

from __future__ import annotations

import random

from helpers import documents, odd_rows, prose

from tapecheck.llm import decontaminate as d


def plain_score(item, window):
    """Smith-Waterman, cell by cell."""
    h = [[0] * (len(window) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(window, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best / (2 * len(item))


def test_alignment_equals_the_plain_one():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 15))] for _ in range(2))
        assert d.smith_waterman(a, b, d.Alignment()) == plain_score(a, b)
    assert d.smith_waterman([], ["a"], d.Alignment()) == 0


def edited(rng, words, rate):
    out = []
    for w in words:
        x = rng.random()
        if x > rate:
            out.append(w)
        elif x > rate * 0.6:
            out.append("other")
        elif x > rate * 0.3:
            out += [w, "more"]
    return out


def test_copies_are_found_and_others_left(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randint(15, 50))) for i in range(20)] + [(90, None), (91, ""), (92, "tiny"), (0, None)]
    items.append(items[3])
    rows = []
    for i in range(60):
        inside = edited(rng, items[i % 20][1].split(), (0, 0.1, 0.2)[i % 3])
        rows.append((i, prose(rng, 80) + ". " + " ".join(inside).upper() + "! " + prose(rng, 80)))
    rows += [(100 + i, prose(rng, 200)) for i in range(40)]
    got = d.contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = set()
    for i, text in rows:
        for item, body in items:
            if body and plain_score(d.words_of(body), d.words_of(text)) >= 0.6:
                want.add((i, item))
    assert {(r.doc_id, r.item_id) for r in got} == want and {i for i, _ in want} == set(range(60))


def test_frequent_seeds_do_not_hide_a_copy(spark):
    rng = random.Random(3)
    shared = prose(rng, 30)
    rows = [(i, f"{prose(rng, 20)} {shared} {prose(rng, 20)}") for i in range(300)]
    bench = spark.createDataFrame([(1, shared + " end")], "item_id long, text string")
    got = d.mark_contaminated(documents(spark, rows), bench).collect()
    assert len(got) == 300 and all(r.contaminated and r.best_item == 1 for r in got)


def test_a_large_insertion_is_bridged_at_every_place(spark):
    rng = random.Random(4)
    item = prose(rng, 100).split()
    rows = [(i, " ".join(prose(rng, 90 + 5 * i).split() + item[:50] + prose(rng, 60).split() + item[50:] + prose(rng, 90).split())) for i in range(24)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in d.contamination(documents(spark, rows), bench).collect()}
    assert set(got) == set(range(24)) and all(score >= 0.7 for score in got.values())


def test_sparse_and_frequent_seeds_leave_no_copy_out(spark):
    rng = random.Random(7)
    item, quoted = prose(rng, 60).split(), prose(rng, 28).split()
    rare = prose(rng, 32).split()
    inserted = [x for i, w in enumerate(item) for x in ([w, "extra"] if i % 3 == 2 else [w])]
    replaced = ["extra" if i % 4 == 3 else w for i, w in enumerate(item)]
    tail = ["extra" if i % 4 == 3 else w for i, w in enumerate(rare)]
    texts = [inserted, replaced, quoted + tail] + [quoted + rare] * 3 + [quoted] * 60
    rows = [(i, " ".join(prose(rng, 40).split() + t + prose(rng, 40).split())) for i, t in enumerate(texts)]
    rows += [(200 + i, prose(rng, 100)) for i in range(60)]
    items = [(1, " ".join(item)), (2, " ".join(quoted + rare)), (3, "aa bb cc dd ee"), (4, "ff")]
    rows += [(300, "aa x bb y cc z dd w ee"), (301, "aa x bb"), (302, "only ff here")]
    want = {(i, k) for i, t in rows for k, b in items if plain_score(d.words_of(b), d.words_of(t)) >= 0.6}
    got = d.contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want >= {(0, 1), (1, 1), (2, 2), (300, 3), (302, 4)}


def test_odd_rows(spark):
    docs = documents(spark, odd_rows())
    bench = spark.createDataFrame([(1, "call 1 743 555 3824"), (2, "alone"), (None, "two words")], "item_id long, text string")
    bench = bench.selectExpr("*", "1 AS seed", "'p' AS passage")
    got = d.mark_contaminated(docs, bench).collect()
    assert len(got) == len(odd_rows())
    assert sorted(str(r.doc_id) for r in got if r.contaminated) == ["11", "11", "6", "None"]
    left = d.without_contaminated(docs, bench)
    rows = left.collect()
    assert left.columns == docs.columns and {6, 11}.isdisjoint(r.doc_id for r in rows)
    assert sorted(str(r.text) for r in rows if r.doc_id is None) == ["None", "One"]  # by id and text, not by id
    twins = documents(spark, [(1, "call 1 743 555 3824"), (1, "clean text")])
    assert [r.text for r in d.without_contaminated(twins, bench).collect()] == ["clean text"]
    assert d.mark_contaminated(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in d.mark_contaminated(docs, bench.limit(0)).collect())


def test_many_items_cost_little_more_than_few(spark):
    """Every item shares its common pairs with all others and with all passages; only rare ones are looked for."""
    import time

    rng = random.Random(9)
    common = prose(rng, 6)
    items = [(i, f"{prose(rng, 20)} {common} {prose(rng, 20)}") for i in range(3000)]
    rows = [(i, f"{prose(rng, 60)} {common} {prose(rng, 60)}") for i in range(400)] + [(1000, items[7][1])]
    docs = documents(spark, rows)
    took = []
    for n in (30, 3000):
        start = time.time()
        got = d.contamination(docs, spark.createDataFrame(items[:n], "item_id long, text string")).collect()
        took.append(time.time() - start)
        assert {(r.doc_id, r.item_id) for r in got} == {(1000, 7)}
    assert took[1] < 5 * took[0]
