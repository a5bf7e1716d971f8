"""Prefix signatures and the join on them against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import documents, near_components, odd_rows, prose

from tapecheck.llm import linking, near, ngram_join, prefixes
from tapecheck.llm.prefixes import Prefixes

from test_near import copies  # noqa: I001

CLASSES = ((12, 2), (1 << 62, 3))


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_signature(percent):
    """Sets at and above the limit, with tokens of all classes, always meet."""
    rng = random.Random(percent)
    how = Prefixes(percent=percent, rare=4, frequent=CLASSES)
    many = {t: rng.choice([2, 3, 4, 5, 8, 12, 13, 40]) for t in range(4000)}
    order = lambda s: sorted(s, key=lambda t: (many[t], t))

    def signed(s):
        ordered = order(s)
        return set(prefixes.set_signatures(len(s), np.array([many[t] for t in ordered]), np.array(ordered, np.uint64), how))

    met = 0
    for _ in range(400):
        size = rng.choice([1, 5, 10, 11, 19, 20, 40, 63, 64, 100, 300])
        pool = [t for t in many if many[t] > rng.choice([0, 4, 12])]
        left = set(rng.sample(pool, min(size, len(pool))))
        right = set(left)
        while True:
            nxt = set(right)
            if rng.random() < 0.5:
                nxt.discard(rng.choice(sorted(nxt)))
            if rng.random() < 0.6:
                nxt.add(rng.choice(pool))
            if not nxt or 100 * len(left & nxt) < percent * len(left | nxt):
                break
            right = nxt
            if rng.random() < 0.02:
                break
        if left != right:
            met += 1
            assert signed(left) & signed(right)
    assert met > 200


def test_signatures_grow_with_the_set():
    how = Prefixes(percent=90)
    for size in (100, 1000, 10_000):
        tokens = np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        assert len(prefixes.set_signatures(size, np.full(size, 100), tokens, how)) < 2 * size


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_classes_equal_brute_force(spark, size, percent, monkeypatch):
    monkeypatch.setattr(linking, "SLICE_NODES", 4)  # so that buckets are cut
    monkeypatch.setattr(ngram_join, "CHUNK", 500)
    rows = copies(size)
    for rare in (2, 64):
        how = ngram_join.Joining(size, Prefixes(percent=percent, rare=rare, frequent=CLASSES))
        got = ngram_join.ngram_classes(documents(spark, rows), how).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_components(rows, size, percent)


def test_texts_that_share_a_passage_do_not_meet(spark):
    """Thousands of texts, half of each the same: no signature is shared, so nothing is compared."""
    rng = random.Random(3)
    common = prose(rng, 40)
    rows = [(i, common + " " + prose(rng, 42)) for i in range(1500)]
    how = ngram_join.Joining()
    sets = near.shingle_sets(documents(spark, rows), how)
    assert prefixes.signatures(sets, how.prefixes).count() < 30
    got = ngram_join.ngram_classes(documents(spark, rows), how).collect()
    assert all(r.component_id == r.doc_id for r in got)


def test_odd_rows(spark):
    rows = odd_rows()
    got = ngram_join.ngram_classes(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == 0 and by[3].component_id == 3 and by[5].component_id == 4
    assert {by[20 + i].component_id for i in range(5)} == {20}
    assert [r.component_id for r in got if r.doc_id is None and r.n_shingles == 1].count(4) == 1
    assert ngram_join.ngram_classes(documents(spark, [])).count() == 0


def test_a_set_inside_a_slightly_larger_one_is_linked(spark):
    """Nine shingles of which a text of ten has all: at 90 percent, with nothing to spare on the smaller side."""
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(5, " ".join(words[:12])), (3, " ".join(words[:11])), (7, " ".join(words[1:12])), (1, " ".join(words[20:31]))], "doc_id long, text string")
    got = ngram_join.ngram_classes(docs, ngram_join.Joining(words=3, prefixes=Prefixes(percent=90)))
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == {(5, 10, 3), (3, 9, 3), (7, 9, 3), (1, 9, 1)}


def test_the_screen_marks_both_of_similar_sets():
    """By counting, for all sizes: what either shows of the shared shingles covers what the other asks for."""
    for percent in (50, 66, 80, 90, 95):
        how = ngram_join.Joining(words=3, prefixes=Prefixes(percent=percent))
        least = [ngram_join._least(n, how) for n in range(400)]
        r = [ngram_join._shown(n, how) for n in range(400)]
        head = [n - how.prefixes.least_shared(n) + r[n] if r[n] else 0 for n in range(400)]
        for m in range(1, 200):
            for n in range(m, m * 100 // percent + 1):
                c = -(-percent * (m + n) // (100 + percent))
                if m == n == c:
                    continue
                for shared in range(c, m + (m < n)):
                    seen = min(head[m] - (m - shared), head[n] - (n - shared))
                    assert seen >= max(least[m], least[n]) > 0, (percent, m, n, shared)
