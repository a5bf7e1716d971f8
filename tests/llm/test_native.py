"""Exact dedup, sharding, chats, licences and packing against brute force, odd cases included."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import documents, maximal, odd_rows, words
from pyspark.sql import functions as F

from tapecheck.llm import chat, exact, licences, packing, shards
from tapecheck.operators.blocks import new_folder


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(spark, weak):
    rows = odd_rows()
    digest = (lambda t: F.unhex(F.md5(F.length(t).cast("string")))) if weak else exact.content_digest
    got = exact.exact_duplicates(documents(spark, rows), "largest", digest).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[lower(t)].append(i)
    assert len(got) == len(rows)
    want = Counter()
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        sha = hashlib.sha256(text.encode()).hexdigest()
        for i in ids:
            want[(i, max(named, default=None), len(ids), sha)] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_filter_keeps_one_row_of_each_text(spark):
    docs = documents(spark, odd_rows())
    left = exact.without_exact_duplicates(docs, "largest")
    assert left.columns == docs.columns
    assert sorted(lower(r.text) for r in left.collect()) == sorted({lower(t) for _, t, *_ in odd_rows()})
    assert exact.without_exact_duplicates(docs.limit(0)).count() == 0


def test_exact_keeps_smallest(spark):
    got = exact.exact_duplicates(documents(spark, [(3, "a"), (2, "A"), (5, "b")])).collect()
    assert sorted(r.doc_id for r in got if r.kept) == [2, 5]


def test_shards(spark):
    rows = odd_rows() * 3
    path = new_folder(spark)
    got = shards.shard_by_bytes(documents(spark, rows), shards=4, slots=64, store=path).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    by_shard = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    latest = shards.SlotMap.load(spark, path)
    assert latest.version == 1 and shards.SlotMap.load(spark, path, 0).owner == shards.SlotMap.even(64, 4).owner
    assert shards.shard_by_bytes(documents(spark, [])).count() == 0


def test_slot_map_edits():
    rng = random.Random(2)
    load = {i: rng.randint(1, 1000) for i in range(4096)}
    start = shards.SlotMap.even(4096, 8)
    even = start.rebalanced(load)
    totals = Counter()
    for slot, size in load.items():
        totals[even.owner[slot]] += size
    assert max(totals.values()) - min(totals.values()) <= min(load.values()) + 1
    moved = sum(a != b for a, b in zip(start.owner, even.owner))
    assert 0 < moved < 400
    grown = even.rebalanced(load, 9)
    assert grown.version == 2 and sum(a != b for a, b in zip(even.owner, grown.owner)) < 4096 / 9 * 1.5


def conversation_rows():
    rng = random.Random(4)
    rows = []
    for c in range(40):
        turns = [("user" if i % 2 == 0 else "assistant", f"t{rng.randint(0, 2)}") for i in range(rng.randint(1, 4))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(50, i, "user", f"line {i} <|end|>") for i in range(2500)]
    rows += [(51, i, "user", f"line {i} <|end|>") for i in range(2000)]
    rows += [(52, 0, None, None), (53, 0, "", ""), (54, None, "user", "x"), (None, 0, "user", "nobody")]
    rows += [(55, 0, "user", "twice"), (55, 0, "user", "twice"), (56, 0, "user", "a"), (56, 0, "assistant", "b")]
    return rows


def test_chats(spark):
    rows = conversation_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("clash"))
    got = chat.render_chats(df).collect()
    want = maximal(rows)
    assert {r.conv_id: (r.n_turns, r.copies) for r in got} == want
    long = sorted((r.part, r.text) for r in got if r.conv_id == 50)
    assert [p for p, _ in long] == [0, 1, 2]
    assert "".join(t for _, t in long) == "".join(f"<|user|>\nline {i} < |end|><|end|>\n" for i in range(2500))
    assert chat.render_chats(df.limit(0)).count() == 0


def test_a_piece_of_any_size_is_rendered_in_slices(spark, monkeypatch):
    rows = [(None, None, "user", f"line {i:05d}") for i in range(3000)] * 2
    rows += [(5, 7, "user" if i % 2 else None, f"text {i:05d}") for i in range(2500)] + [(5, 7000, "user", "end")]
    rows += [(6, 1, "user", "short"), (6, 1, "user", "other")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for chars in (chat.SLICE_CHARS, 5000):
        monkeypatch.setattr(chat, "SLICE_CHARS", chars)
        got = chat.render_chats(df).collect()
        for conv in (None, 5, 6):
            turns = sorted({(t or 0, r or "", x) for c, t, r, x in rows if c == conv})
            parts = sorted((r.part, r.text) for r in got if r.conv_id == conv)
            assert [p for p, _ in parts] == list(range(len(parts)))
            assert "".join(t for _, t in parts) == "".join(f"<|{r}|>\n{x}<|end|>\n" for _, r, x in turns)
            assert max(t.count("<|end|>") for _, t in parts) <= 1024
            assert all(r.n_turns == len(turns) and r.copies == 1 for r in got if r.conv_id == conv)



def test_licences(spark):
    mit = licences.KNOWN[0][1]
    messy = "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.replace("sublicense", "sub-licence").upper().replace(" ", "\n ")
    rows = [
        (1, messy), (2, "Prose here.\nReleased under the MIT Licence!\nmore\nLicensed under CC BY-NC 4.0."),
        (3, None), (4, ""), (5, "mentions the MIT License in passing"), (None, "MIT  LICENSE"), (6, "a" * 200_000), (1, messy),
    ]
    got = {(r.doc_id, r.license, r.line_licenses, r.n_license_lines) for r in licences.scan_licences(documents(spark, rows)).collect()}
    assert got == {
        (1, "MIT", "", 0), (2, None, "CC-BY-NC-4.0,MIT", 2), (3, None, "", 0), (4, None, "", 0), (5, None, "", 0),
        (None, "MIT", "MIT", 1), (6, None, "", 0),
    }
    assert licences.scan_licences(documents(spark, [])).count() == 0


def naive_bins(lengths, capacities):
    """Best fit, piece by piece, opening by the same rule, from the largest piece down."""
    lengths, bins = sorted(lengths, reverse=True), []
    for at, n in enumerate(lengths):
        fitting = [b for b in bins if b[1] >= n]
        if fitting:
            best = min(fitting, key=lambda b: b[1])
            best[1] -= n
            best[2].append(n)
        else:
            cap = packing._opening(n, sorted(set(lengths[at:])), capacities, packing.default_cost)
            bins.append([cap, cap - n, [n]])
    return Counter((min(c for c in capacities if c >= sum(b[2])), sum(b[2])) for b in bins)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_best_fit(seed):
    rng, capacities = random.Random(seed), (16, 40, 100)
    lengths = [min(100, int(rng.expovariate(1 / 20)) + 1) for _ in range(400)]
    plan = packing.plan_bins(Counter(lengths), capacities)
    want = naive_bins(lengths, capacities)
    got = Counter()
    for _, count, used, capacity in plan.bins:
        got[(capacity, used)] += count
    assert sum(c * u for (c, u), n in got.items() for c in (n,)) == sum(lengths)
    assert sum(cap * n for (cap, _), n in got.items()) == sum(cap * n for (cap, _), n in want.items())


def test_packing(spark):
    rows = [r for r in odd_rows()] + [(1000 + i, "w " * (i % 37 + 1)) for i in range(500)]
    capacities = (16, 64, 256)
    got = packing.pack(documents(spark, rows), capacities).collect()
    lengths = Counter()
    for i, t, *_ in rows:
        lengths[i] += len(words(t))
    found, bins = Counter(), defaultdict(list)
    for r in got:
        assert r.start == r.piece * 256
        found[r.doc_id] += r.length
        bins[r.bin_id].append(r)
    assert +found == +lengths
    for pieces in bins.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        used, capacity = pieces[0].used, pieces[0].capacity
        assert at == used and capacity == min(c for c in capacities if c >= used)
    assert sorted(bins) == list(range(len(bins)))
    assert packing.pack(documents(spark, []), capacities).count() == 0
    assert packing.pack(documents(spark, [(1, None)]), capacities).count() == 0


def test_equal_rows_without_id_are_spread(spark, monkeypatch):
    """A third and more of all rows alike: no shard, group or length takes them all."""
    monkeypatch.setattr(shards, "REPEATS", 50)
    rows = [(None, "the same text")] * 1200 + [(7, "one id, one text")] * 600 + [(100 + i, "text " * (i % 9 + 1)) for i in range(900)]
    docs = documents(spark, rows)
    got = shards.shard_by_bytes(docs, slots=256).collect()
    size = {s: sum(r.size for r in got if r.shard == s) for s in range(8)}
    assert len(got) == len(rows) and max(size.values()) - min(size.values()) <= 0.05 * max(size.values())
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    marks = exact.exact_duplicates(docs).collect()
    assert len(marks) == len(rows) and sum(r.kept for r in marks) == len({t for _, t in rows})
    left = exact.without_exact_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == sorted({t for _, t in rows})
    packed = packing.pack(docs, capacities=(8, 16)).collect()
    assert sum(r.length for r in packed) == sum(len(t.split()) for _, t in rows)
    cells = [(r.bin_id, r.offset + k) for r in packed for k in range(r.length)]
    assert len(cells) == len(set(cells))


def test_copyright_lines_and_given_texts(spark):
    mit = licences.KNOWN[0][1]
    heads = (
        "Copyright Jane Doe 2021", "# Copyright (c) 2020 Jane Doe", " * Copyright 2019-2021 The X Authors", "// Copyright The X Authors",
        "Copyright (C) Jane Doe, 2001\n  All rights reserved.", "(c) 1999 J. Doe",
    )
    rows = [(i, f"{h}\n\n{mit}") for i, h in enumerate(heads)]
    wrapped = mit.replace("above copyright notice and", "above\ncopyright notice and").replace("AUTHORS OR COPYRIGHT", "AUTHORS OR\nCOPYRIGHT")
    rows += [(50, wrapped), (51, "copyright law of 2021 or so\n" + mit[:200]), (60, "A whole licence, version 9.\nIt is long."), (61, "copyright")]
    docs = documents(spark, rows)
    texts = spark.createDataFrame([("LONG-9", "# Copyright 2000 Someone\n# A whole licence, version 9!\n# It is long.")], "license string, text string")
    got = {r.doc_id: r.license for r in licences.scan_licences(docs, texts=texts).collect()}
    assert {got[i] for i in range(len(heads))} == {"MIT"} and got[50] == "MIT"
    assert got[51] is None and got[60] == "LONG-9" and got[61] is None


def test_few_huge_turns_are_cut(spark, monkeypatch):
    monkeypatch.setattr(chat, "SLICE_CHARS", 3000)
    rows = [(1, t, "user", f"{t} " + "x" * 1000) for t in range(20)] + [(2, 0, "user", "hi")]
    got = chat.render_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    parts = sorted((r.part, r.text) for r in got if r.conv_id == 1)
    assert [p for p, _ in parts] == list(range(len(parts))) and len(parts) >= 5
    assert max(len(t) for _, t in parts) < 6000
    assert "".join(t for _, t in parts) == "".join(f"<|user|>\n{x}<|end|>\n" for _, _, _, x in rows[:20])
