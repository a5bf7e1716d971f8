"""Distances of sources against plain sums, with cells so small that every axis is cut."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from helpers import WORDS, documents, odd_rows

from tapecheck.llm import divergence


def plain(rows, how):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    found, held, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        low = (text or "").encode().translate(lower).decode()
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        found[lang, source].update(terms)
        held[lang].update(set(terms))
        langs[lang].add(source)
    out = set()
    for lang, sources in langs.items():
        kept = [t for t, n in held[lang].items() if n >= how.least_documents]
        total = Counter()
        for s in sources:
            total.update(found[lang, s])

        def shares(count, kept=kept):
            whole = sum(count[t] for t in kept) + how.smoothing * len(kept)
            return {t: 1 + how.scale * (count[t] + how.smoothing) // whole for t in kept}

        p, q = {s: shares(found[lang, s]) for s in sources}, shares(total)
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            more = [(q[t] - p[s][t], t.encode()) for t in kept if found[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(more)[: how.top_terms])):
                out |= {(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(items, 1)}
    return out


def rows_of(seed):
    rng, rows = random.Random(seed), []
    for i in range(400):
        lang = rng.choice(["en", "en", "de", None, ""])
        source = "hot" if rng.random() < 0.4 else f"s{rng.randint(0, 13)}"
        text = " ".join(rng.choice(WORDS[: rng.choice([3, 9, 28])]) + rng.choice(["", "É", "é", "ß", "日"]) for _ in range(rng.randint(0, 25)))
        rows.append((i, rng.choice([text, text.upper(), text.replace(" ", "-7_")]), lang, None if source == "s3" else source, len(text)))
    return [*rows, (900, "", "rare", "one", 0), (901, None, "rare", "two", 0), (902, "x", "rare", "three", 1), (None, "the the", "en", "terse", 7)]


def test_equal_to_plain_sums(spark):
    rows = rows_of(4)
    for how in (divergence.Audit(least_documents=12, least_sources=2, most_sources=3, terms=5, top_terms=6), divergence.Audit()):
        got = [tuple(r) for r in divergence.source_divergence(documents(spark, rows), how).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(rows, how)


def test_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, whole = 3 * 10**17, 7 * 10**17
    df = spark.createDataFrame([(n, whole)], "n long, whole long")
    assert df.select(divergence._share("n", "whole", divergence.Audit())).first()[0] == 1 + 10**9 * (n + 5) // whole
    assert df.select(divergence._share(F.lit(0), "whole", divergence.Audit())).first()[0] == 1


def test_odd_rows(spark):
    how = divergence.Audit(least_documents=1)
    got = {tuple(r) for r in divergence.source_divergence(documents(spark, odd_rows()), how).collect()}
    assert got == plain(odd_rows(), how)
    assert divergence.source_divergence(documents(spark, [])).count() == 0
