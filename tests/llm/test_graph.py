"""Components against a search, and how many tasks their rounds take."""

import random

import pytest
from tapecheck.llm import graph


def searched(edges):
    root = {n: n for edge in edges for n in edge}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(root[a], root[b])
            moved |= (root[a], root[b]) != (low, low)
            root[a] = root[b] = low
    return root


@pytest.mark.parametrize("task_edges", [100_000, 7])
def test_rounds_take_as_many_tasks_as_there_are_edges_for(spark, monkeypatch, task_edges):
    """Few edges dealt over many partitions wrote more files a round than there were edges."""
    dealt = random.Random(5)
    edges = [(dealt.randrange(60), dealt.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)]
    stored = graph.materialize
    parts = []

    def watched(df):
        out = stored(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(graph, "materialize", watched)
    monkeypatch.setattr(graph, "TASK_EDGES", task_edges)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for key, value in zip(before, ("40", "false")):
            spark.conf.set(key, value)
        rows = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    want = {n: r for n, r in searched([e for e in edges if e[0] != e[1]]).items()}
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)
    if task_edges == 100_000:
        assert set(parts[1:]) == {1}


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert graph.components(spark.createDataFrame([(3, 3)], "a long, b long")).collect() == []
