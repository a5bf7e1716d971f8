"""Bounded labelled samples, and hashed features chosen by what they tell about a label."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the hash space of text features.
SPACE = 1 << 20


def feature_id(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & (SPACE - 1)


def feature_ids(mark: str, names: pa.Array, end: str = "") -> np.ndarray:
    """:func:`feature_id` of all ``names`` between ``mark`` and ``end``; equal names are hashed once."""
    found = pc.binary_join_element_wise(mark, names, end, "").dictionary_encode()
    hashes = map(zlib.crc32, found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False))
    known = np.fromiter(hashes, np.int64, len(found.dictionary)) & (SPACE - 1)
    return known[found.indices.to_numpy()]


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, fits: Column | None = None
) -> DataFrame:
    """``text, n_chars, label`` of at most ``rows`` labelled documents, chosen by a hash of the id.

    The chosen ids are a table of at most ``rows`` narrow rows, hence broadcast. Of rows that share an id the one
    with the least text counts, so the sample is bounded however often an id is repeated. Labels that are
    NULL, or that are given twice for one id with different values, are left out.
    """
    once = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("__high"))
        .filter("label = __high")
    )
    if fits is not None:
        once = once.filter(fits)
    chosen = (
        once.orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .select(F.col("doc_id").alias("__id"), F.col("label").cast("int").alias("label"))
    )
    size = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    narrow = docs.select("doc_id", "text", size.alias("n_chars"))
    found = narrow.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    once = found.groupBy("doc_id").agg(F.min(F.struct("text", "n_chars")).alias("row"), F.first("label").alias("label"))
    return once.select("row.text", "row.n_chars", "label")


def feature_counts(
    sample: DataFrame, features: Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]]
) -> DataFrame:
    """``feature, n0, n1``: in how many texts of either label each hashed feature occurs.

    ``features`` gives texts of a column, by number, and the features that each has, every pair once. Every task adds
    up in two arrays of the hash space and sends what is not zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, SPACE), np.int64)
        for batch in batches:
            high = batch.column("label").to_numpy() > 0
            for texts, ids in features(batch.column("text")):
                for k in (0, 1):
                    seen[k] += np.bincount(ids[high[texts] == k], minlength=SPACE)
        used = np.flatnonzero(seen.sum(axis=0))
        for at in range(0, len(used), 50_000):
            some = used[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array(seen[0, some]), pa.array(seen[1, some])], ["feature", "n0", "n1"]
            )

    return (
        sample.mapInArrow(run, "feature long, n0 long, n1 long")
        .groupBy("feature")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    )


def telling_features(counts: DataFrame, most: int, least_texts: int = 4) -> np.ndarray:
    """Ids of the ``most`` features with the largest likelihood-ratio statistic, ascending."""
    rows = counts.filter(F.col("n0") + F.col("n1") >= least_texts).toArrow()
    feature = rows.column("feature").to_numpy()
    a, b = (rows.column(c).to_numpy().astype(float) for c in ("n1", "n0"))
    if not len(feature):
        return np.empty(0, np.int64)
    share = a.sum() / max((a + b).sum(), 1)

    def part(seen: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(wanted, 1e-9)), 0)

    strength = part(a, (a + b) * share) + part(b, (a + b) * (1 - share))
    best = np.lexsort((feature, -strength))[:most]
    return np.sort(feature[best])


class Adam:
    """Steps for arrays that are changed in place."""

    def __init__(self, *arrays: np.ndarray, rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m = [np.zeros_like(a) for a in arrays]
        self.v = [np.zeros_like(a) for a in arrays]

    def step(self, *slopes: np.ndarray) -> None:
        self.t += 1
        for a, g, m, v in zip(self.arrays, slopes, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
