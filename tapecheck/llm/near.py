"""Near duplicates by b-bit MinHash: bands propose, packed signatures estimate, full sets confirm."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapecheck.llm import linking
from tapecheck.llm.graph import components
from tapecheck.llm.text import text_digest, without_rows
from tapecheck.operators.blocks import materialize


@dataclass(frozen=True)
class Sketching:
    """Shingle length, similarity in percent, and the shape of a signature.

    With 24 bands of 4 minima, a pair at similarity 0.8 shares no band with probability
    (1 - 0.8**4)**24, about three in a million. ``slack`` is how far below the wanted similarity an
    estimate may lie, some five standard deviations of 96 minima.
    """

    words: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4
    bits: int = 4
    slack: float = 0.22

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def most_differing(self) -> int:
        """Differing places of two signatures up to which a pair is worth a look.

        Places agree with probability J + (1 - J) / 2**bits, for unequal minima collide in
        their low bits; the bound takes that share out.
        """
        return int((1 - (self.percent / 100 - self.slack)) * (1 - 0.5**self.bits) * self.minima)


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def run_hashes(each: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` hashed words, in order."""
    many = len(each) - size + 1
    run = np.full(many, size, np.uint64)
    for i in range(size):
        run ^= each[i : i + many]
        run *= np.uint64(0x9E3779B97F4A7C15)
        run ^= run >> np.uint64(29)
    run *= np.uint64(0xBF58476D1CE4E5B9)
    run ^= run >> np.uint64(32)
    return run


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words, or of the whole shorter text."""
    if not words:
        return np.empty(0, np.uint64)
    run = run_hashes(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), min(size, len(words)))
    run.sort()
    return run[np.concatenate([[True], run[1:] != run[:-1]])]


def minima(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    best = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        product = multipliers[:, None] * shingles[None, at : at + 1024]
        np.minimum(best, product.min(axis=1), out=best)
    return best >> np.uint64(16)


def multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def pack_low_bits(mins: np.ndarray, bits: int) -> np.ndarray:
    """Rows of minima as ``bits`` planes of words of 64 places each."""
    rows, count = mins.shape
    words = -(-count // 64)
    out = np.zeros((rows, bits, words), np.uint64)
    for place in range(count):
        for bit in range(bits):
            out[:, bit, place // 64] |= ((mins[:, place] >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place % 64)
    return out.reshape(rows, bits * words)


def _lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = pa.array(np.arange(0, (rows + 1) * width, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1).view(np.int64)))


def sketch(docs: DataFrame, how: Sketching) -> DataFrame:
    """``doc_id, digest, n_shingles, same, sig, bands`` for every row; ``same`` names the shingle set.

    Texts without words have no shingles, and NULL for the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers(how.minima)
        salt = np.arange(1, how.bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            sizes, names, mins = [], [], np.zeros((batch.num_rows, how.minima), np.uint64)
            for i, text in enumerate(batch.column("text")):
                found = shingle_set(split_words(text.as_py()), how.words)
                sizes.append(len(found))
                names.append(xxhash.xxh128_digest(found.tobytes()) if len(found) else None)
                if len(found):
                    mins[i] = minima(found, factors)
            bands = np.repeat(salt[None, :], batch.num_rows, axis=0)
            for r in range(how.rows):
                bands ^= mins[:, r :: how.rows]
                bands *= np.uint64(0x9E3779B97F4A7C15)
                bands ^= bands >> np.uint64(31)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("digest"),
                    pa.array(sizes, pa.int64()),
                    pa.array(names, pa.binary()),
                    _lists(pack_low_bits(mins, how.bits)),
                    _lists(bands),
                ],
                ["doc_id", "digest", "n_shingles", "same", "sig", "bands"],
            )

    return docs.select("doc_id", "text", text_digest().alias("digest")).mapInArrow(
        run, "doc_id long, digest binary, n_shingles long, same binary, sig array<long>, bands array<long>"
    )


def shingle_sets(docs: DataFrame, how: Sketching) -> DataFrame:
    """``node, same, shingles``: the full sets, for exact comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounded output batches
                part = batch.slice(at, 256)
                sets = [shingle_set(split_words(t.as_py()), how.words) for t in part.column("text")]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    ],
                    ["node", "same", "shingles"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "node long, same binary, shingles array<long>")


def _differing(how: Sketching, a: str, b: str) -> Column:
    """Places where two packed signatures differ: planes are compared and the differences counted."""
    words = -(-how.minima // 64)
    counts = []
    for w in range(words):
        apart = None
        for bit in range(how.bits):
            at = bit * words + w
            x = F.col(a)[at].bitwiseXOR(F.col(b)[at])
            apart = x if apart is None else apart.bitwiseOR(x)
        counts.append(F.bit_count(apart))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return total


def near_duplicates(docs: DataFrame, how: Sketching = Sketching()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when the distinct shingles they share are at least ``how.percent``
    of those that either has. ``component_id`` is the smallest ``doc_id`` reachable over
    links; ``kept`` marks that document.

    1. Rows with equal shingle sets become one node, aggregated before the shuffle.
    2. Nodes that share a band are candidates. Within a bucket all are compared to one pivot
       only, the node with the most partners over all its buckets (of copies edited at random
       the least edited), so that a bucket of n nodes costs n comparisons. Estimates discard.
    3. Members of a bucket that these links leave in different components are compared with each other: as pairs in a small
       bucket, where each has few partners, and in slices in a large one (:func:`tapecheck.llm.linking.remaining_links`),
       whose packed signatures discard nearly all at once.
    4. Links are confirmed on full sets.

    Texts without words (NULL, empty) are linked with nothing and stay. Rows without
    ``doc_id`` belong to the component of an equal set if there is one with an id;
    otherwise they have no ``component_id`` and stay. Rows that repeat a ``doc_id`` are one
    node, linked where any of their texts is. Texts of any length are read whole. Extra columns are not read; an empty table
    gives an empty result.
    """
    return _marked(docs, how).select("doc_id", "n_shingles", "component_id", "kept")


def _marked(docs: DataFrame, how: Sketching) -> DataFrame:
    """The rows of :func:`near_duplicates` with the ``digest`` of their text."""
    sketched = materialize(sketch(docs, how))
    nodes = materialize(
        sketched.filter("same IS NOT NULL")
        .groupBy("same")
        .agg(
            F.min("doc_id").alias("node"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sig").alias("sig"),
            F.first("bands").alias("bands"),
        )
    )
    named = nodes.filter("node IS NOT NULL")
    banded = named.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialize(linking.with_pivots(materialize(banded.join(buckets, "band"))))
    involved = members.select(F.col("node").alias("doc_id")).distinct()
    sets = linking.one_set_each(shingle_sets(docs.select("doc_id", "text").join(involved, "doc_id", "left_semi"), how))
    facts = named.select("node", "n_shingles", "sig")

    def likely(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose packed signatures and sizes allow the wanted similarity, each once."""
        return (
            pairs.join(facts.select(F.col("node").alias("a"), F.col("n_shingles").alias("m"), F.col("sig").alias("x")), "a")
            .join(facts.select(F.col("node").alias("b"), F.col("n_shingles").alias("n"), F.col("sig").alias("y")), "b")
            .filter(linking.may_match(how.percent, "m", "n") & (_differing(how, "x", "y") <= how.most_differing))
            .select("a", "b")
            .distinct()
        )

    links = materialize(linking.confirmed(likely(linking.star(members)), sets, how.percent))
    found = materialize(components(links))
    mixed = linking.mixed_members(members, found)
    mixed = materialize(mixed.join(mixed.groupBy("band").agg(F.count("*").alias("n")), "band"))
    more = materialize(linking.confirmed(likely(linking.pairs_of_few(mixed)), sets, how.percent))
    if not more.isEmpty():
        links = links.unionByName(more)
        found = materialize(components(links))
    large = mixed.filter(F.col("n") > linking.FEW).select("band", "node")
    apart = linking.mixed_members(large, found).join(named.select("node", "same", "n_shingles", "sig"), "node")
    planes = (how.bits, -(-how.minima // 64), how.most_differing)
    late = materialize(linking.remaining_links(apart, sets, how.percent, planes))
    if not late.isEmpty():  # else the components are complete
        found = components(links.unionByName(late))
    return (
        sketched.select("doc_id", "digest", "n_shingles", "same")
        .join(nodes.select("same", "node"), "same", "left")
        .join(found, "node", "left")
        .select(
            "doc_id",
            "digest",
            "n_shingles",
            F.coalesce("component", "node", "doc_id").alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def without_near_duplicates(docs: DataFrame, how: Sketching = Sketching()) -> DataFrame:
    """``docs`` with one row of each component of :func:`near_duplicates`, columns unchanged.

    The row with the smallest id stays; where rows with that id differ in their text, the one with the least digest.
    Rows that repeat id and text stay or go together. Texts without words (NULL, empty) stay, and so do rows without id but those
    whose set equals that of a row with one. Decided by id and text, so a row that shares an id with a copy is no
    copy itself. An empty table gives an empty result; extra columns may have any name.
    """
    marks = materialize(_marked(docs, how).filter("n_shingles > 0 AND component_id IS NOT NULL"))
    first = (
        marks.filter("doc_id IS NOT NULL")
        .groupBy("component_id")
        .agg(F.min(F.struct("doc_id", "digest")).alias("best"))
        .select("best.doc_id", "best.digest")
    )
    return without_rows(docs, marks.select("doc_id", "digest").join(first, ["doc_id", "digest"], "left_anti"))
