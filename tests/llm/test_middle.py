"""Fill-in-middle: bit tricks against plain loops, and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from helpers import documents, odd_rows, prose

from tapecheck.llm import middle


def plain(doc_id, text, how=middle.Cutting()):
    """By lists of lines."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in (how.prefix, how.suffix, how.middle)) or h[2] % 100 >= how.cut_percent:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < how.suffix_first_percent:
        return len(units), "spm", len(p), len(m), how.suffix + s + how.prefix + p + how.middle + m
    return len(units), "psm", len(p), len(m), how.prefix + p + how.suffix + s + how.middle + m


def texts():
    rng = random.Random(12)
    out = ["\n", "\n\n\n", "a", "a\n", "\na", "<P>x\ny", "x <S>\n", "<M>", "é\nß\n😀\n日本", "<P\n>\n<\nM>\n<", "\r\n\r\n", "\x8a\x0a\x0b\x09\n", "ÿ\n\x7f\n\x00\n"]
    for _ in range(300):
        out.append("".join(rng.choice(["\n", "x", "é", "日", "😀", "<", "word "]) for _ in range(rng.randint(0, 60))))
    return [*out, "\n" * 100_000, prose(rng, 60_000).replace(" ", "\n"), "x" * 300_000]


def test_equal_to_lists_of_lines(spark, monkeypatch):
    monkeypatch.setattr(middle, "BATCH_BYTES", 1000)
    rows = [(i * 7919, t) for i, t in enumerate(texts())] + [(None, "a\nb\nc\n"), (5, None)]
    for how in (middle.Cutting(), middle.Cutting(seed=11, cut_percent=60, suffix_first_percent=20, prefix="[[pre]]", suffix="[[suf]]", middle="[[mid]]")):
        got = middle.with_restored(middle.fill_in_middle(documents(spark, rows), how), how).collect()
        key = lambda x: (x[0] is None, x[0] or 0, x[1:])
        have = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.text) for r in got]
        want = [(i, *plain(i, t, how), t or "") for i, t in rows]
        assert sorted(have, key=key) == sorted(want, key=key)
        assert {x[2] for x in want} == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    rows = odd_rows()
    got = middle.with_restored(middle.fill_in_middle(documents(spark, rows))).collect()
    assert sorted(r.text for r in got) == sorted(t or "" for _, t, *_ in rows)
    assert middle.fill_in_middle(documents(spark, [])).count() == 0


def test_rank_and_select():
    rng = np.random.default_rng(2)
    data = rng.choice(np.array([0x0A, 0x0B, 0x8A, 0x00, 0xFF, 0x09, 0xBF, 0xC3], np.uint8), 5000)
    ends = middle.Marks(middle.equal_bytes(middle.as_words(data), 0x0A))
    where = np.flatnonzero(data == 0x0A)
    assert (ends.select(np.arange(len(where))) == where).all()
    at = np.arange(len(data) + 1)
    assert (ends.rank(at) == np.concatenate([[0], np.cumsum(data == 0x0A)])).all()
    inner = middle.Marks(middle.continuation_bytes(middle.as_words(data)))
    assert (inner.rank(at) == np.concatenate([[0], np.cumsum(data & 0xC0 == 0x80)])).all()
