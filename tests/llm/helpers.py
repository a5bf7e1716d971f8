"""Small inputs that hold every odd case, and brute-force versions to compare with."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

WORDS = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, node long, same string, item string, vslot int, piece long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty and blank texts, a very long one, repeated rows and ids, columns with clashing names."""
    rng = random.Random(5)
    texts = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "Two words"), (None, None), (None, "One"),
        (7, prose(rng, 300)), (8, prose(rng, 40_000)), (9, "É É ß 😀 " + "x" * 50_000), (10, None),
        (11, "call +1 (743) 555-3824"), (11, "call +1 (743) 555-3824"), (12, "a"), (12, "b"), (None, "alone"),
    ]
    base = prose(rng, 120)
    texts += [(20 + i, base + f" tail{i}") for i in range(5)]
    return [(i, t, None, "s", None if t is None else len(t), "d", 7, None, "x", 3, 9) for i, t in texts]


def documents(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * (11 - len(r))) for r in rows], SCHEMA)


def words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))


def near_components(rows: list[tuple], size: int, percent: int) -> dict[int, tuple[int, int]]:
    """``doc_id: (set size, component)`` from all pairs."""
    sets: dict[int, set] = {}
    for i, text, *_ in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and both * 100 >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Personal data by the plain patterns."""
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d: str) -> bool:
        doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d))]
        return sum(x // 10 + x % 10 for x in doubled) % 10 == 0

    for kind, pattern, valid in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if valid(m[0])]
    return out


def maximal(rows: list[tuple]) -> dict[int, tuple[int, int]]:
    """``conv_id: (turns, copies)`` of conversations that no other one continues."""
    turns = defaultdict(set)
    for conv, turn, role, text in rows:
        turns[conv].add((turn is not None, turn or 0, role or "", text or ""))
    whole = {c: tuple(sorted(t)) for c, t in turns.items()}
    groups = Counter(whole.values())
    first = {}
    for c in sorted(whole, key=lambda x: (x is None, x or 0)):
        first.setdefault(whole[c], c)
    prefixes = {w[:k] for w in groups for k in range(1, len(w))}
    return {first[w]: (len(w), n) for w, n in groups.items() if w not in prefixes}
