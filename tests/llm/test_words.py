"""What is worked out once for every distinct word of a slice, against the same text by text."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tapecheck.llm import quality, samples, text, toxicity

#: Every letter, mark and blank there is, inside words and between them, in many short texts.
ANY = [f"a{chr(c)}Bcd{chr(c)} {chr(c)}" for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
TEXTS = [" ".join(ANY[i : i + 40]) for i in range(0, len(ANY), 40)]
TEXTS += ["", None, " ", "ΟΔΟΣ'Α ΑΣ.Α Α'Σ ΣΑΣ", "İSTANBUL’I ﬁX_ß9ẞ", "the The THE thematic, the" * 3]


def toxic_features(body: str | None) -> Counter:
    many = Counter()
    for w in re.findall(r"[^\W\d_]+", (body or "").lower()):
        names = [f"={w}", *(f"{w[:k]}*" for k in range(3, 8) if len(w) >= k)]
        many.update({zlib.crc32(n.encode()) % 2**20 for n in names})
    return many


def test_toxic_features_are_those_of_every_word(monkeypatch):
    monkeypatch.setattr(text, "SLICE_BYTES", 1 << 14)
    want = [toxic_features(t) for t in TEXTS]
    got = [x.tolist() for x in map(np.concatenate, zip(*toxicity.text_features(pa.array(TEXTS))))]
    assert sorted(zip(*got)) == sorted((row, i) for row, many in enumerate(want) for i in many)
    chosen = np.unique([i for many in want for i in many])[::3]
    rows, columns, values = toxicity.vectors(pa.array(TEXTS), chosen)
    sizes = [len(re.findall(r"[^\W\d_]+", (t or "").lower())) for t in TEXTS]
    found = dict(zip(zip(rows.tolist(), chosen[columns].tolist()), values.tolist()))
    held = set(chosen.tolist())
    assert found == {
        (row, i): np.log1p(max(n * 1000 / sizes[row], 0.5)) for row, many in enumerate(want) for i, n in many.items() if i in held
    }


def hashes(monkeypatch, run) -> int:
    calls = []
    with monkeypatch.context() as patch:
        patch.setattr(samples.zlib, "crc32", lambda *a, real=zlib.crc32: calls.append(a) or real(*a))
        run()
    return len(calls)


def test_toxic_words_are_hashed_once_a_slice(monkeypatch):
    chosen = np.arange(0, 2**20, 64)
    once, often = (pa.array(TEXTS[:50] * n) for n in (1, 20))
    few = hashes(monkeypatch, lambda: toxicity.vectors(once, chosen))
    assert 0 < few == hashes(monkeypatch, lambda: toxicity.vectors(often, chosen))


def quality_row(body: str, stated: int | None, chosen: dict[int, int]) -> list[float]:
    words, lines, n = body.split(), [x for x in body.split("\n") if x.strip()], max(len(body), 1)
    many, counts, shares = max(len(words), 1), Counter(words), [0] * len(chosen)
    for word in words:
        for name in (word.lower(), f"*{word.lower()[-3:]}"):
            place = chosen.get(zlib.crc32(name.encode()) % 2**20)
            if place is not None:
                shares[place] += 1
    small, capital, digit, stop = (sum(x in some for x in body) for some in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"()-_"))
    letter = small + capital + sum(ord(x) >= 192 for x in body)
    return [
        letter / n, capital / n, digit / n, (len(body) - letter - digit - stop - sum(x <= " " for x in body)) / n, stop / n,
        min(sum(map(len, words)) / many / 20, 1),
        sum(len(w) > 15 for w in words) / many,
        sum(not w[-1].isalnum() and w[-1] not in ".,;:?!" for w in words) / many,
        sum(len(w) > 1 and w.isupper() for w in words) / many,
        len(counts) / many, max(counts.values(), default=0) / many,
        sum(a == b for a, b in zip(words, words[1:])) / many,
        min(len(body) / max(len(lines), 1) / 500, 1), len(set(lines)) / max(len(lines), 1),
        np.log1p(len(words)) / 10, np.log1p(len(body)) / 12, np.log1p(max(len(body) if stated is None else stated, 0)) / 12,
        float(not words), *(np.log1p(100 * x / many) / 3 for x in shares),
    ]


def test_quality_vectors_are_those_of_every_text(monkeypatch):
    monkeypatch.setattr(quality, "SLICE_BYTES", 1 << 14)
    monkeypatch.setattr(quality, "ROWS", 7)
    bodies = [*TEXTS, "\nAB AB Ab\n\nx x\nx x\n", "Ω" * 30, "\u3000a\u2003b\x1cc\x85d\u200be", "(well) ALL, caps!"]
    want = [{zlib.crc32(n.encode()) % 2**20 for w in (t or "").lower().split() for n in (w, f"*{w[-3:]}")} for t in bodies]
    got = [x.tolist() for x in map(np.concatenate, zip(*quality.word_features(pa.array(bodies))))]
    assert sorted(zip(*got)) == sorted((row, i) for row, ids in enumerate(want) for i in ids)
    chosen = np.unique([i for ids in want for i in ids])[::400]
    stated = [None if i % 3 == 0 else i - 5 for i in range(len(bodies))]
    rows = np.concatenate([*quality.vectors(pa.array(bodies), pa.array(stated, pa.int64()), chosen)])
    at = {int(f): i for i, f in enumerate(chosen)}
    assert np.allclose(rows, [quality_row(t or "", n, at) for t, n in zip(bodies, stated)], rtol=0, atol=1e-12)


def test_quality_words_are_hashed_once_a_slice(monkeypatch):
    chosen = np.arange(0, 2**20, 2048)
    tables = [(pa.array(TEXTS[:50] * n), pa.nulls(50 * n, pa.int64())) for n in (1, 20)]
    few, as_few = (hashes(monkeypatch, lambda: [*quality.vectors(*table, chosen)]) for table in tables)
    assert 0 < few == as_few
