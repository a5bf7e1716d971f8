"""Near duplicates and components against all pairs."""

from __future__ import annotations

import random

import pytest
from helpers import documents, near_components, odd_rows, prose

from tapecheck.llm import linking, near
from tapecheck.llm.graph import components


def copies(seed, groups=6, each=25):
    """Groups whose members are edited at rates that lie on both sides of the limit."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = prose(rng, rng.choice([8, 60, 150])).split()
        for _ in range(each):
            text = [w if rng.random() > 0.03 else "edit" + str(rng.randint(0, 9)) for w in base]
            rows.append((len(rows), " ".join(text).upper() if rng.random() < 0.3 else " ".join(text)))
    return rows + [(len(rows) + i, prose(rng, rng.randint(0, 6))) for i in range(40)]


@pytest.mark.parametrize("size,few", [(4, 64), (5, 1)])
def test_components_equal_brute_force(spark, size, few, monkeypatch):
    monkeypatch.setattr(linking, "FEW", few)
    monkeypatch.setattr(linking, "SLICE_NODES", 4)  # so that buckets are cut
    rows = copies(size)
    got = near.near_duplicates(documents(spark, rows), near.Sketching(words=size)).collect()
    want = near_components(rows, size, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark):
    rows = odd_rows()
    docs = documents(spark, rows)
    got = near.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == 0 and by[1].kept and by[3].component_id == 3
    assert by[5].component_id == 4 and not by[5].kept
    assert {by[20 + i].component_id for i in range(5)} == {20}
    assert sorted((r.kept, r.component_id) for r in got if r.doc_id is None and r.component_id) == [(False, 4)]
    left = near.without_near_duplicates(docs)
    assert left.columns == docs.columns and {21, 22, 23, 24, 5}.isdisjoint(r.doc_id for r in left.collect())
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_estimate_is_corrected_for_collisions():
    import numpy as np

    rng, how = np.random.default_rng(1), near.Sketching()
    factors = near.multipliers(how.minima)
    both, apart = rng.integers(0, 2**63, 6000, dtype=np.uint64), rng.integers(0, 2**63, (2, 1000), dtype=np.uint64)
    sets = [np.unique(np.concatenate([both, x])) for x in apart]
    sig = near.pack_low_bits(np.stack([near.minima(s, factors) for s in sets]), how.bits).reshape(2, how.bits, -1)
    differing = int(np.bitwise_count(np.bitwise_or.reduce(sig[0] ^ sig[1], axis=0)).sum())
    estimate = 1 - differing / how.minima / (1 - 0.5**how.bits)
    assert abs(estimate - 6000 / 8000) < 0.15


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(7, 7), (1, 0)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in edges for n in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_template_links_nothing(spark):
    """Texts that share half their shingles meet in one bucket; prefixes of rare shingles never bring them together."""
    from tapecheck.llm.prefixes import Prefixes, signatures

    rng = random.Random(11)
    template = prose(rng, 70)
    rows = [(i, template + " " + prose(rng, 70)) for i in range(800)]
    rows += [(5000 + i, rows[0][1] + f" tail{i}") for i in range(3)]
    docs = documents(spark, rows)
    assert signatures(near.shingle_sets(docs, near.Sketching()), Prefixes(percent=80)).select("node").distinct().count() < 20
    got = {r.doc_id: r.component_id for r in near.near_duplicates(docs).collect()}
    assert {got[5000 + i] for i in range(3)} == {0} and all(got[i] == i for i in range(800))


def test_rows_that_share_an_id_are_judged_apart(spark):
    rng = random.Random(12)
    base, other = prose(rng, 80), prose(rng, 80)
    rows = [(1, base), (1, other), (2, base + " more"), (None, other + " x"), (3, base)]
    left = near.without_near_duplicates(documents(spark, rows)).collect()
    # 1 is one node, so its texts form one class with their copies, of which one row stays; the row without id stays
    assert sorted((str(r.doc_id), r.text) for r in left)[-1] == ("None", other + " x") and len(left) == 2
