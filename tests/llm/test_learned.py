"""Toxicity, quality and personal data: held-out accuracy, brute force, odd cases."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import base_spans, documents, odd_rows, prose
from pyspark.sql import functions as F

from tapecheck.llm import pii, quality, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def given(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_on_rows_that_were_not_fitted(given):
    docs, labels = given
    seen = F.pmod(F.col("doc_id"), F.lit(3)) != 1
    model = toxicity.fit(docs, labels, fits=seen)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    marks = toxicity.score(docs, model).withColumnRenamed("toxic", "found").join(labels.filter(~seen), "doc_id").collect()
    toxic, clean = [r for r in marks if r.toxic == 1], [r for r in marks if r.toxic == 0]
    assert sum(r.found for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.found for r in clean) <= 0.005 * len(clean)
    assert all(0 <= r.severity <= 3 and r.p_toxic >= r.severity / 3 - 1e-9 for r in marks)


def test_ordinal_weights_are_shared_and_thresholds_ordered():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    grades = np.digitize(x @ [2.0, -1.0, 0.0] + rng.logistic(size=3000), [0.5, 2.0])
    rows, columns = np.repeat(np.arange(3000), 3), np.tile(np.arange(3), 3000)
    weights, thresholds = toxicity.fit_ordinal((rows, columns, x.ravel()), grades, 3)
    assert np.allclose(weights, [2, -1, 0], atol=0.2) and np.allclose(thresholds, [0.5, 2], atol=0.2)


def graded(rng, n):
    """Texts whose given grade follows from the worst kind of word they hold, however often and however long they are."""
    kinds, rows = (["hm"], ["darnit", "blast"], ["vilest", "scumbag"], ["slaughterx", "obliterate"]), []
    for i in range(n):
        grade = i % 4
        words = prose(rng, rng.randint(20, 200)).split()
        for _ in range(rng.randint(1, 6)):
            words.insert(rng.randrange(len(words)), rng.choice(kinds[grade]))
        rows.append((i, " ".join(words), grade))
    return rows


def test_given_grades_and_scores_by_brute_force(spark):
    rows = graded(random.Random(4), 800)
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.filter("doc_id < 600"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    new = [(got[i], g, t) for i, t, g in rows if i >= 600]
    assert sum(round(r.severity) == g for r, g, _ in new) >= 0.9 * len(new)
    assert sum(r.toxic == (g > 0) for r, g, _ in new) >= 0.95 * len(new)
    for r, _, text in new:  # the same sums, word by word
        many, words = Counter(), re.findall(r"[^\W\d_]+", text.lower())
        for w in words:
            many.update({zlib.crc32(f"={w}".encode()) % 2**20, *(zlib.crc32(f"{w[:k]}*".encode()) % 2**20 for k in range(3, 8) if len(w) >= k)})
        x = {f: np.log1p(max(1000 * n / len(words), 0.5)) for f, n in many.items()}
        total = sum(w * x.get(f, 0) for f, w in zip(model.features.tolist(), model.weights.tolist()))
        p = [1 / (1 + np.exp(-min(max(total - t, -40), 40))) for t in model.thresholds]
        assert abs(r.severity - sum(p)) < 1e-9 and abs(r.p_toxic - p[0]) < 1e-9


def test_severity_does_not_follow_length(given, spark):
    docs, labels = given
    model = toxicity.fit(docs, labels)
    some = docs.join(labels.filter("toxic = 1"), "doc_id").select("doc_id", "text").limit(60)
    once = {r.doc_id: r.severity for r in toxicity.score(some, model).collect()}
    five = toxicity.score(some.withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 5)), model).collect()
    assert all(abs(once[r.doc_id] - r.severity) < 1e-9 for r in five)
    assert len({round(s) for s in once.values()}) > 1


def test_toxicity_odd_rows(spark):
    docs = documents(spark, odd_rows())
    labels = spark.createDataFrame([(7, 1, 0), (11, 1, 1), (None, 1, 1), (4, 0, None), (9, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).count() == len(odd_rows())
    left = toxicity.without_toxic(docs, model)
    assert left.schema == docs.schema
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.fit(docs, labels.limit(0))
    assert toxicity.without_toxic(docs, nothing).count() == len(odd_rows())


def test_quality_on_held_out_rows(given):
    docs, labels = given
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.98 * len(rows)
    marks = quality.score(docs, model).select("doc_id", "held_out").collect()
    assert len(marks) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in marks)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_linear_time_pairs_equal_all_pairs():
    rng = np.random.default_rng(3)
    m = quality.FactorisationMachine(np.empty(0), 0.1, rng.normal(size=6), rng.normal(size=(6, 2)))
    x = rng.normal(size=(5, 6))
    pairs = [sum(m.factors[i] @ m.factors[j] * r[i] * r[j] for i in range(6) for j in range(i)) for r in x]
    assert np.allclose(m.scores(x), 1 / (1 + np.exp(-(0.1 + x @ m.linear + pairs))))


def test_quality_odd_rows(spark):
    docs = documents(spark, odd_rows())
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 12)], "doc_id long, quality int, toxic int")
    for model in (quality.fit(docs, labels), quality.fit(docs, labels.limit(0))):
        got = quality.score(docs, model).collect()
        assert len(got) == len(odd_rows()) and all(np.isfinite(r.score) for r in got)
    assert {r.score for r in got} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_base_spans_equal_plain_patterns():
    rng = random.Random(3)
    for _ in range(8000):
        text = "".join(rng.choice(rng.choice(["ab@.-+", "0123. -+()", "a@b.c1", "12.3 4+", "é@a.b%_"])) for _ in range(rng.randint(0, 40)))
        assert [(pii.KINDS[k], s, e) for k, s, e, ok in pii.base_matches(text) if ok] == base_spans(text)


def test_patterns_are_linear():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + " " * 400_000, "a@" * 100_000, "1-" * 200_000):
        pii.proposals(text)


def test_personal_data(spark, given):
    docs, _ = given
    model = pii.fit(docs, sample_rows=4000)
    x = "Write to john.doe (at) example (dot) com or call (415) 555-2671, card 4111.1111.1111.1111 but not 1234.5678.9012.3456"
    base, every = pii.spans_of(x, model)
    assert not base and {pii.KINDS[k] for k, _, _ in every} == {"email", "phone", "card"} and len(every) == 3
    assert pii.redact(x, pii._joined(every)).startswith("Write to [email] or call [phone], card [card] but")
    rows = odd_rows() + [(99, "a@b.cd " + x)]
    got = pii.find_personal_data(documents(spark, rows), model).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, *_ in rows if i == r.doc_id) if r.doc_id is not None else None
        want = base_spans(text) if r.doc_id is not None else []
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in pii.KINDS]
        joined = [f"{k}:{s}:{e}" for k, s, e in want]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r.spans.split(",")) | {""}
    assert pii.find_personal_data(documents(spark, []), pii.fit(documents(spark, []))).count() == 0


def test_common_loose_spans_are_not_learned_as_wrong(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        phone = f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        mail = (f"user{i}@mail.example", f"user{i} (at) mail (dot) example")[i % 2]
        fake = f"{rng.randint(10**19, 10**20 - 1)}"
        rows.append((i, f"call {'+1 ' * (i % 2)}{phone} or write to {mail} about {fake} today"))
    model = pii.fit(documents(spark, rows))
    base, every = pii.spans_of("call (415) 555-2671 or write to jane (at) mail (dot) example soon", model)
    assert not base and [pii.KINDS[k] for k, _, _ in every] == ["email", "phone"]


def test_valid_spans_inside_longer_matches_are_proposed():
    for text, kind, inner in (
        ("on 2024-05-01 4111111111111111 was", "card", "4111111111111111"),
        ("row 7 4111111111111111 x", "card", "4111111111111111"),
        ("2024 4111 1111 1111 1111", "card", "4111 1111 1111 1111"),
        ("7536784127813051 4845168114407329", "card", "4845168114407329"),
        ("v 10.999.10.20.30.40 x", "ip", "10.20.30.40"),
        ("+1 (826) 555-4081 190.137.223.204", "phone", "+1 (826) 555-4081"),
        ("415 555 2671 415 555 2672", "phone", "415 555 2672"),
    ):
        start = text.index(inner)
        assert ((pii.KINDS.index(kind), start, start + len(inner)), False) in pii.proposals(text)
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice("0123456789012345678901234567 -") for _ in range(rng.randint(13, 40))).strip(" -")
        got = {(s, e) for (k, s, e), _ in pii.proposals(text) if k == 2}
        failing = [(s, e) for k, s, e, ok in pii.base_matches(text) if k == 2 and not ok]
        for s in range(len(text)):
            for e in range(s + 13, len(text) + 1):
                part = text[s:e].replace(" ", "").replace("-", "")
                whole = (text[s - 1 : s] + text[e : e + 1]).strip(" -") == "" and text[s].isdigit() and text[e - 1].isdigit()
                if whole and any(a <= s and e <= b for a, b in failing) and 13 <= len(part) <= 19 and pii.luhn(part):
                    assert (s, e) in got


def test_a_card_beside_another_number_is_selected(given):
    docs, _ = given
    model = pii.fit(docs, sample_rows=4000)
    for text in ("2024-05-01 4111111111111111", "7 4111111111111111 paid", "2024 4111 1111 1111 1111"):
        assert text.index("4111") in {s for k, s, _ in pii.spans_of(text, model)[1] if k == 2}


def hard_cases(rng):
    """``text, kind, start, right`` that the fit has not seen: numbers in context, all of them passing their check."""
    out = []
    for i in range(120):
        area, three, four = rng.randint(201, 989), rng.randint(200, 999), rng.randint(1000, 9999)
        number = (f"({area}) {three}-{four}", f"{area} {three} {four}", f"{area}-{three}-{four}")[i % 3]
        card = f"{rng.randint(4000, 4999)}{rng.randint(10**10, 10**11 - 1)}"
        card += next(str(d) for d in range(10) if pii.luhn(card + str(d)))
        card = ". -"[i % 3].join(card[j : j + 4] for j in range(0, 16, 4))
        filler = prose(rng, 6)
        for cue, right in (("please call me at ", True), ("her mobile is ", True), ("see order ", False), ("our invoice ", False), ("in version ", False)):
            out.append((f"{filler} {cue}{number} {filler}", "phone", len(filler) + 1 + len(cue), right))
        if ". -"[i % 3] == ".":
            for cue, right in (("charge my card ", True), ("serial number ", False), ("ticket ", False)):
                out.append((f"{filler} {cue}{card} {filler}", "card", len(filler) + 1 + len(cue), right))
    return out


def test_trees_weigh_format_and_context(given):
    docs, _ = given
    model = pii.fit(docs, sample_rows=4000)
    used = {pii.FEATURES[f] for f, c in zip(model.feature.ravel(), model.cut.ravel()) if np.isfinite(c)}
    assert used & {"hint", "other hint"} and used & {"length", "digits", "groups", "separators", "brackets", "longest group", "least group"}
    assert len(used) >= 5
    assert not pii.spans_of("your order 123 456 7890 is ready", model)[1]
    assert [s[0] for s in pii.spans_of("call (415) 555-2671 now", model)[1]] == [3]
    right = wrong = missed = 0
    for text, kind, start, real in hard_cases(random.Random(77)):
        found = any(pii.KINDS[k] == kind and s <= start < e for k, s, e in pii.spans_of(text, model)[1])
        right, wrong, missed = right + (found and real), wrong + (found and not real), missed + (real and not found)
    assert right >= 0.95 * (right + missed) and right >= 0.95 * (right + wrong), (right, wrong, missed)


def test_every_document_teaches(spark, monkeypatch):
    """Twice the documents are twice the lessons, and sums in tasks give the trees that sums in the driver give."""
    text = "call +1 415 555 {0} now or write to u{0}@mail.example, order 4111.1111.1111.{0}"
    rows = [(i, text.format(1000 + i)) for i in range(300)]
    counted, keep = [], pii._adder
    monkeypatch.setattr(pii, "_adder", lambda r: counted.append(r.agg(F.sum("w")).first()[0]) or keep(r))
    here = pii.fit(documents(spark, rows))
    pii.fit(documents(spark, rows + [(1000 + i, t) for i, t in rows]))
    assert counted[2:] == [2 * n for n in counted[:2]] and sum(counted) > 3 * 2 * len(rows)
    monkeypatch.setattr(pii, "LOCAL_LESSONS", 0)
    far = pii.fit(documents(spark, rows))
    assert np.array_equal(here.feature, far.feature) and np.array_equal(here.cut, far.cut)
    assert np.allclose(here.leaf, far.leaf) and here.threshold == far.threshold
