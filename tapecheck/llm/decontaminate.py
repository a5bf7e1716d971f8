"""Benchmark decontamination: rare word pairs of the items are joined with the passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapecheck.llm.near import run_hashes
from tapecheck.llm.text import text_digest, without_rows, word_slices
from tapecheck.operators.blocks import materialize

#: ASCII characters that are no letter, digit or underscore end a word; the rest stays.
_KEPT = np.array([c if c >= 128 or chr(c).isalnum() or c == 95 else 0 for c in range(256)], np.uint8)
_BREAKS = bytes(c or 32 for c in _KEPT.tolist())
#: Bits of the table that rules out word pairs of no item: 8 MB at any number of items.
FILTER_BITS = 1 << 26
#: Parts into which the places of one word pair are dealt.
PARTS = 8


@dataclass(frozen=True)
class Alignment:
    """Scores of the alignment, and the share of an item's own score that counts."""

    match: int = 2
    mismatch: int = -1
    gap: int = -1
    least: float = 0.6

    def most_inserted(self, n_words: int, matches: int | None = None) -> int:
        """Words that may be inserted into a copy of so many words before its score falls below ``least``.

        An alignment that counts lies at most so far before the place where any of its matches
        puts the item, and at most so far beyond its end.
        """
        spare = self.match * (n_words if matches is None else matches) - self.least * self.match * n_words
        return max(0, math.floor(spare / -self.gap + 1e-9))

    def least_matches(self, n_words: int) -> int:
        """Words of the item that an alignment that counts matches at least."""
        return max(1, math.ceil(self.least * n_words - 1e-9))

    def least_pairs(self, n_words: int) -> int:
        """Neighbours in the item that are matched and neighbours in such an alignment, at least.

        A word without a match parts two pairs, an inserted word one.
        """
        matches = range(self.least_matches(n_words), n_words + 1)
        return min(2 * m - n_words - 1 - self.most_inserted(n_words, m) for m in matches)


def raw_words(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of letters, digits, underscores and anything beyond ASCII."""
    return pc.utf8_lower(pa.scalar(text or "", pa.large_string())).as_py().encode().translate(_BREAKS).split()


def words_of(text: str | None) -> list[str]:
    return [w.decode("utf-8", "replace") for w in raw_words(text)]


def _hashes(words: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _cut(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices ``start, stop`` of a column of texts: distinct words, and of every place in them the number of its word and text."""
    lowered = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    for start, stop, words, text in word_slices(lowered, _KEPT):
        yield start, stop, words.dictionary.to_numpy(zero_copy_only=False), words.indices.to_numpy(), text


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """``np.isin`` for a few sorted numbers, in a ninth of its time."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def smith_waterman(item: list[str], window: list[str], how: Alignment) -> float:
    """Best local alignment of two word lists, as a share of the item's alignment with itself.

    One row of the matrix at a time; gaps along the row are a running maximum.
    """
    if not item or not window:
        return 0.0
    ids: dict[str, int] = {}
    a = [ids.setdefault(w, len(ids)) for w in item]
    b = np.array([ids.get(w, -1) for w in window])
    drift = how.gap * np.arange(len(b))
    above, best = np.zeros(len(b) + 1, np.int64), 0
    for word in a:
        cell = np.maximum(above[:-1] + np.where(b == word, how.match, how.mismatch), above[1:] + how.gap)
        np.maximum(cell, 0, out=cell)
        above[1:] = np.maximum.accumulate(cell - drift) + drift
        best = max(best, int(above.max()))
    return best / (how.match * len(item))


class _Item:
    """One item, with the runs of one or two words that a copy that counts must keep a number of."""

    def __init__(self, words: list[bytes], how: Alignment):
        self.words, self.how = words, how
        self.hashes = _hashes(words)
        self.matches = how.least_matches(len(words))
        self.reach = len(words) + how.most_inserted(len(words))
        pairs = how.least_pairs(len(words))
        self.need, self.size = (pairs, 2) if pairs > 0 else (self.matches, 1)
        self.runs = run_hashes(self.hashes, self.size)
        self.known, self.known_runs = np.sort(self.hashes), np.sort(self.runs)

    def least_seeds(self) -> int:
        """How many of its seeds a copy has at least: the rest of what it needs may be left to common runs."""
        return min(2, self.need)

    def seeds(self, docs: dict[int, int]) -> list[int]:
        """The rarest runs by the number of texts that hold them, without the commonest that a copy may do with alone."""
        runs, times = np.unique(self.runs, return_counts=True)
        rank = sorted(zip(runs.tolist(), times.tolist()), key=lambda x: (-docs.get(x[0], 0), x[0]))
        spare, kept = self.need - self.least_seeds(), []
        for run, many in rank:
            if many <= spare and not kept:
                spare -= many
            else:
                kept.append(run)
        return [run for run in kept if docs.get(run, 0)]

    def score(self, words: list[bytes], each: np.ndarray) -> float:
        """Best alignment with any stretch of a text that counts, 0 if none does; ``each`` is the hash of every word."""
        if len(each) < self.size:
            return 0.0
        place = np.flatnonzero(_among(run_hashes(each, self.size), self.known_runs))
        last = np.arange(len(place)) + self.need - 1
        at = np.flatnonzero(last < len(place))
        at = at[place[last[at]] - place[at] <= self.reach]
        if not len(at):
            return 0.0
        low, high = place[at], place[last[at]]
        # an alignment that holds these runs lies within the reach of them; stretches that overlap are one
        cut = np.flatnonzero(low[1:] - high[:-1] > 2 * self.reach) + 1
        best = 0.0
        for one, two in zip([0, *cut], [*cut, len(low)]):
            first = max(0, int(low[one] - self.reach))
            end = int(high[two - 1] + self.reach) + 2
            known = np.cumsum(np.concatenate([[0], _among(each[first:end], self.known)]))
            width = min(self.reach, len(known) - 1)
            if (known[width:] - known[: len(known) - width]).max() >= self.matches:
                best = max(best, smith_waterman(self.words, words[first:end], self.how))
        return best if best >= self.how.least else 0.0


def _items(benchmark: DataFrame, how: Alignment) -> DataFrame:
    """``form, item_ids, text, size, runs``: items with equal words are one form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = raw_words(text)
                if words:
                    item = _Item(words, how)
                    rows.append((xxhash.xxh128_digest(b" ".join(words)), item_id, text, item.size, np.unique(item.runs).view(np.int64)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["form", "item_id", "text", "size", "runs"])

    cut = benchmark.select(F.col("item_id").cast("long"), "text").distinct().mapInArrow(
        run, "form binary, item_id long, text string, size int, runs array<long>"
    )
    named = F.collect_set(F.struct("item_id")).alias("item_ids")  # in a struct, so that NULL is kept
    return cut.groupBy("form").agg(named, F.min("text").alias("text"), F.first("size").alias("size"), F.first("runs").alias("runs"))


def _filter(runs: DataFrame) -> np.ndarray:
    """A table of :data:`FILTER_BITS` bits in which those of ``runs (run)`` are set; never more, so it may travel."""
    slot = F.pmod("run", F.lit(FILTER_BITS))
    words = runs.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(run, 64) as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def _passing(table: np.ndarray, runs: np.ndarray) -> np.ndarray:
    slot = runs & np.uint64(FILTER_BITS - 1)
    return np.flatnonzero(table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))


def _places(column: pa.Array, sizes: list[int], table: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices ``first, end`` of a column of texts: the text, place and hash of every run in the table."""
    for start, stop, known, word, text in _cut(column):
        each = _hashes(known)[word]
        first = np.searchsorted(text, np.arange(stop - start))
        found = []
        for size in sizes:
            if len(each) >= size:
                runs = run_hashes(each, size)
                hit = _passing(table, runs)
                hit = hit[text[hit] == text[hit + size - 1]]  # not across the end of a text
                found.append((text[hit], hit - first[text[hit]], runs[hit]))
        empty = np.empty(0, np.int64)
        texts, places, runs = (np.concatenate(x) for x in zip(*found)) if found else (empty, empty, empty.view(np.uint64))
        order = np.lexsort((places, texts))
        yield start, stop, texts[order], places[order], runs[order]


def _seeds(items: DataFrame, counts: DataFrame, how: Alignment) -> DataFrame:
    """``run, form, least, reach``: the seeds of every item, how many a copy has and how close together."""
    runs = items.select("form", F.explode("runs").alias("run")).join(counts, "run")
    counted = runs.groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("run", "docs"))).alias("docs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for form, text, docs in zip(*(batch.column(c).to_pylist() for c in ("form", "text", "docs"))):
                item = _Item(raw_words(text), how)
                held = {r & 0xFFFFFFFFFFFFFFFF: n for r, n in docs}
                rows += [(r - (r >> 63 << 64), form, item.least_seeds(), item.reach) for r in item.seeds(held)]
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["run", "form", "least", "reach"])

    return items.select("form", "text").join(counted, "form").mapInArrow(run, "run long, form binary, least int, reach long")


def _key() -> Column:
    """Names a row by its id, which may be NULL, and its text."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex("digest"))))


def _keyed(docs: DataFrame) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long"), "text", text_digest().alias("digest"))
    return texts.withColumn("key", _key())


def _lists(cuts: np.ndarray, *columns: np.ndarray) -> list[pa.ListArray]:
    return [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x)) for x in columns]


def _scanned(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, key, runs, places``: every row with the runs of items that stand in it, by place; texts are cut this once."""
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # 1 and 2 at most
    table = _filter(items.select(F.explode("runs").alias("run")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, texts, places, runs in _places(batch.column("text"), sizes, table):
                cuts = np.searchsorted(texts, np.arange(stop - start + 1))
                rows = batch.slice(start, stop - start).select(["doc_id", "key"])
                lists = _lists(cuts, runs.view(np.int64), places.astype(np.int32))
                yield pa.RecordBatch.from_arrays([*rows.columns, *lists], ["doc_id", "key", "runs", "places"])

    schema = "doc_id long, key binary, runs array<long>, places array<int>"
    return materialize(_keyed(docs).select("doc_id", "key", "text").mapInArrow(run, schema))


def _copies(docs: DataFrame, benchmark: DataFrame, how: Alignment) -> tuple[DataFrame, DataFrame]:
    """``doc_id, digest, item_id, score``: one row per text with its id, and item; and all rows as in :func:`_scanned`."""
    items = materialize(_items(benchmark, how))
    scanned = _scanned(docs, items)
    held = scanned.select(F.explode(F.array_distinct("runs")).alias("run"))
    counts = materialize(held.groupBy("run").agg(F.count("*").alias("docs")))
    seeds = materialize(_seeds(items, counts, how))
    table = _filter(seeds.select("run").distinct())
    fewest = seeds.agg(F.min("least")).first()[0] or 1

    def touch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("runs")
            runs, places = lists.flatten().to_numpy(), batch.column("places").flatten().to_numpy()
            text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            hit = _passing(table, runs.view(np.uint64))
            many = np.bincount(text[hit], minlength=len(lists))
            rows = np.flatnonzero(many >= fewest)
            hit = hit[many[text[hit]] >= fewest]
            cuts = np.concatenate([[0], np.cumsum(many[rows])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(rows)), *_lists(cuts, runs[hit], places[hit])], ["key", "runs", "places"]
            )

    schema = "key binary, runs array<long>, places array<int>"
    touched = scanned.where("size(runs) > 0").select("key", "runs", "places").mapInArrow(touch, schema)
    hits = touched.select("key", F.inline(F.arrays_zip(F.col("runs").alias("run"), F.col("places").alias("place"))))
    hits = hits.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int"))
    dealt = seeds.withColumn("part", F.explode(F.array(*[F.lit(i) for i in range(PARTS)])))
    near = "least = 1 or exists(sequence(1, greatest(size(p) - 1, 1)), i -> i < size(p) and p[i] - p[i - 1] <= reach)"
    candidates = (
        hits.join(dealt, ["run", "part"])
        .groupBy("key", "form", "least", "reach")
        .agg(F.array_sort(F.collect_set("place")).alias("p"))
        .where(near)
        .select("key", "form")
    )
    candidates = materialize(candidates)  # few, against all texts below

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_of = lru_cache(1024)(lambda text: _Item(raw_words(text), how))
        for batch in batches:
            # Equal texts are cut once, pairs of equal texts and items aligned once.
            texts, items_of = (batch.column(c).dictionary_encode() for c in ("text", "item"))
            pairs = texts.indices.to_numpy() * np.int64(len(items_of.dictionary)) + items_of.indices.to_numpy()
            pairs, pair_of = np.unique(pairs, return_inverse=True)
            text_of, item_at = np.divmod(pairs, max(len(items_of.dictionary), 1))
            named, of_pair = items_of.dictionary.to_pylist(), np.zeros(len(pairs))
            for start, stop, known, word, text in _cut(texts.dictionary):
                each = _hashes(known)[word]
                for i in range(*np.searchsorted(text_of, [start, stop])):
                    a, b = np.searchsorted(text, [text_of[i] - start, text_of[i] - start + 1])
                    of_pair[i] = item_of(named[item_at[i]]).score(known[word[a:b]].tolist(), each[a:b])
            scores = of_pair[pair_of].tolist()
            kept = [i for i, s in enumerate(scores) if s]
            part = batch.select(["doc_id", "digest", "item_ids"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([scores[i] for i in kept], pa.float64())], ["doc_id", "digest", "item_ids", "score"]
            )

    both = (
        _keyed(docs)
        .join(candidates, "key")
        .join(items.select("form", "item_ids", F.col("text").alias("item")), "form")
        .select("doc_id", "digest", "text", "item", "item_ids")
    )
    schema = "doc_id long, digest binary, item_ids array<struct<item_id: bigint>>, score double"
    return both.mapInArrow(align, schema).select("doc_id", "digest", F.inline("item_ids"), "score"), scanned


def contamination(docs: DataFrame, benchmark: DataFrame, how: Alignment = Alignment()) -> DataFrame:
    """``doc_id, item_id, score``: documents that hold a copy of a benchmark item, one row per pair.

    ``score`` is the best alignment as a share of a verbatim copy's, and at least ``how.least``;
    the candidates leave none out. An alignment that counts has so many matches and so few
    edits that a number of pairs of neighbouring words must be left in it
    (:meth:`Alignment.least_pairs`; of items too short for that a number of single words).

    1. Every passage is cut once, and the word pairs of items in it are kept with their places, 12 bytes each. It is
       counted how many passages hold each pair. The rarest pairs of an item are its
       seeds; the commonest are left out, as many as a copy could still do without having two seeds.
    2. Seeds and the places where they stand in passages meet in a join, dealt into parts so that a seed in very many
       passages spreads out. A fixed table of bits keeps what is no seed from being sent.
    3. A passage and an item of which enough seeds lie within the longest alignment that counts are aligned, where
       enough of all its pairs and words stand.

    Items are a table like the passages and never on the driver. NULL and empty texts match nothing; a text of any
    length is read whole; NULL ids are kept, equal pairs are merged, with the best score. An empty benchmark or table
    gives an empty result; extra columns are not read.
    """
    return _copies(docs, benchmark, how)[0].groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, how: Alignment = Alignment()) -> DataFrame:
    """``doc_id, contaminated, n_items, best_item, score`` for every row of ``docs``.

    ``best_item`` is the item with the best score, of equal scores the smallest id; it and the
    score are NULL for clean documents. Marks go by id and text, so of rows that share an id only those that hold a copy
    are marked. An empty table gives an empty result.
    """
    copies, scanned = _copies(docs, benchmark, how)
    by_row = (
        copies.groupBy(_key().alias("key"))
        .agg(
            F.count("*").alias("n_items"),
            F.min(F.struct((-F.col("score")).alias("minus"), "item_id")).alias("best"),
        )
    )
    return scanned.select("doc_id", "key").join(by_row, "key", "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.col("best.item_id").alias("best_item"),
        (-F.col("best.minus")).alias("score"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, how: Alignment = Alignment()) -> DataFrame:
    """``docs`` without the rows whose text holds a copy of a benchmark item, columns unchanged.

    Decided by id and text: a clean row that shares its id with a copy stays, and a copy without id goes. NULL and empty
    texts stay. An empty table gives an empty result; extra columns may have any name.
    """
    return without_rows(docs, _copies(docs, benchmark, how)[0].select("doc_id", "digest"))
