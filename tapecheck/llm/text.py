"""Text helpers shared by the operators of this package."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bytes of text that a task cuts into words at once.
SLICE_BYTES = 4 << 20


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; NULL becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def text_digest() -> Column:
    """128 bits that tell a row's text from others; NULL counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id and text are those of ``dropped (doc_id, digest)``, columns unchanged."""
    gone = dropped.select(F.col("doc_id").alias("__gone"), F.col("digest").alias("__gone_digest")).distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__id"), text_digest().alias("__digest"))
    same = F.col("__id").eqNullSafe(F.col("__gone")) & (F.col("__digest") == F.col("__gone_digest"))
    left = keyed.join(gone, same, "left_anti")
    return left.select("__row.*")


def bodies(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and where each text starts (and the last one ends); NULL is empty."""
    filled = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = filled.buffers()
    at = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def byte_slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes, or one longer text."""
    start = 0
    while start < len(offsets) - 1:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, stop
        start = stop


def cut_words(body: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of a run of texts that lie one behind the other, and the text of each.

    ``table`` maps every byte to the one it becomes in a word, or to zero where it ends words.
    """
    letters = table[body]
    inside = letters != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = at[:-1][(at[:-1] < at[1:])]
    begins[edges] |= inside[edges]  # a text that begins inside a word begins one
    starts = np.flatnonzero(begins)
    kept = np.cumsum(inside, dtype=np.int32)
    offsets = np.append(kept[starts] - 1, kept[-1] if len(kept) else 0).astype(np.int32)
    words = pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters[inside].tobytes())]
    )
    return words.dictionary_encode(), np.searchsorted(at, starts, side="right") - 1


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted; ``np.unique`` sorts where it counts too, else it hashes, which took 40 times as long for two million numbers."""
    return np.unique(values, return_counts=True)[0]


def word_slices(column: pa.Array, table: np.ndarray) -> Iterator[tuple[int, int, pa.DictionaryArray, np.ndarray]]:
    """For slices ``start, stop`` of a column of texts: all words, as in :func:`cut_words`, and the text of each, from 0 on."""
    body, at = bodies(column)
    for start, stop in byte_slices(at, SLICE_BYTES):
        part = at[start : stop + 1]
        yield start, stop, *cut_words(body[part[0] : part[-1]], part - part[0], table)
