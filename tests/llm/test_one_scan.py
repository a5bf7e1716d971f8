"""Decontamination cuts every text once, and aligns equal texts once."""

from __future__ import annotations

import random

import pyarrow as pa
from helpers import documents, odd_rows, prose

from tapecheck.llm import decontaminate as d


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def scans(frame) -> int:
    """Files that a plan reads besides what is materialised."""
    return frame._jdf.queryExecution().optimizedPlan().toString().count("parquet")


def test_marks_read_the_texts_only_for_what_is_aligned(spark, tmp_path):
    rng = random.Random(11)
    items = [(i, prose(rng, 30)) for i in range(12)]
    rows = [(i, prose(rng, 60) + (" " + items[i % 12][1] if i % 3 == 0 else "")) for i in range(90)]
    documents(spark, rows).write.parquet(str(tmp_path / "docs"))
    marks = d.mark_contaminated(spark.read.parquet(str(tmp_path / "docs")), bench(spark, items))
    got = {r.doc_id: (r.contaminated, r.best_item, r.score) for r in marks.collect()}
    assert got == {i: (True, i % 12, 1.0) if i % 3 == 0 else (False, None, None) for i, _ in rows}
    assert scans(marks) == 1


def test_every_row_is_kept_by_the_scan(spark):
    docs = documents(spark, odd_rows() + odd_rows())
    for items in ([(1, "one two three four five six")], []):
        marks = d.mark_contaminated(docs, bench(spark, items))
        assert marks.count() == docs.count()
        assert sorted(str(r.doc_id) for r in marks.collect()) == sorted(str(r.doc_id) for r in docs.collect())


def test_equal_texts_and_items_are_aligned_once(spark):
    rng = random.Random(5)
    item = prose(rng, 25)
    body = f"{prose(rng, 40)} {item} {prose(rng, 40)}"
    docs = documents(spark, [(i, body) for i in range(20)] + [(99, prose(rng, 80))])
    got = {(r.doc_id, r.item_id): r.score for r in d.contamination(docs, bench(spark, [(7, item), (8, item)])).collect()}
    assert got == {(i, k): 1.0 for i in range(20) for k in (7, 8)}


def test_cut_words_are_the_raw_ones():
    texts = ["Ein Wort, zwei_Wörter; ÀB-c", None, "", " x y", "A a A"]
    found = [[] for _ in texts]
    for start, _, known, word, text in d._cut(pa.array(texts)):
        for w, t in zip(known[word].tolist(), text.tolist()):
            found[start + t].append(w)
    assert found == [d.raw_words(t) for t in texts]
