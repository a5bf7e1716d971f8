"""Text quality by a factorisation machine over hashed words, structure and size."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapecheck.llm.samples import SPACE, Adam, feature_counts, feature_ids, labelled_sample, sigmoid, telling_features
from tapecheck.llm.text import SLICE_BYTES, bodies, byte_slices, distinct
from tapecheck.operators.blocks import materialize

SAMPLE_ROWS = 6_000
WORDS = 512
FACTORS = 8

STRUCTURE = (
    "letters",
    "capitals",
    "digits",
    "marks",
    "stops",
    "word length",
    "long words",
    "words with marks",
    "shouted words",
    "distinct words",
    "commonest word",
    "repeated neighbours",
    "line length",
    "distinct lines",
    "words",
    "characters",
    "stated characters",
    "nothing",
)


#: Kind of a character by its first byte: nothing (later bytes too), small and other letters, capitals, digits, marks, stops.
_NOTHING, _LETTER, _CAPITAL, _DIGIT, _MARK, _STOP = range(6)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[:33], _KIND[128:192], _KIND[0xC3:] = _NOTHING, _NOTHING, _LETTER
for _kind, _characters in ((_LETTER, string.ascii_lowercase), (_CAPITAL, string.ascii_uppercase), (_DIGIT, string.digits), (_STOP, ".,;:?'\"()-_")):
    _KIND[list(_characters.encode())] = _kind
#: Rows of a vector table at most.
ROWS = 2000


def _words(column: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """For slices ``start, stop`` of a column of texts: distinct words, and of every place in them the number of its word and text."""
    _, at = bodies(column)
    for start, stop in byte_slices(at, SLICE_BYTES):
        for first in range(start, stop, ROWS):
            part = pc.fill_null(column.slice(first, min(ROWS, stop - first)), "")
            lists = pc.utf8_split_whitespace(part)
            words = lists.flatten().dictionary_encode()
            word, text = words.indices.to_numpy(), np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())
            there = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)[word]  # blanks at an end leave an empty word
            yield first, first + len(part), words.dictionary, word[there], text[there]


def _features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of their last three characters, in small letters."""
    low = pa.array([w.lower() for w in words.to_numpy(zero_copy_only=False)], pa.string())
    return feature_ids("", low), feature_ids("*", pc.utf8_slice_codeunits(low, -3))


def word_features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of texts and the features of the words that each has, every pair once."""
    for start, _, words, word, text in _words(column):
        text, ids = np.divmod(distinct(np.concatenate([text * SPACE + ids[word] for ids in _features(words)])), SPACE)
        yield start + text, ids


def _marked(words: pa.Array) -> np.ndarray:
    """Whether words end in a character that neither letters and digits nor sentences end in."""
    ends = pc.utf8_slice_codeunits(words, -1).dictionary_encode()
    odd = [not end.isalnum() and end not in ".,;:?!" for end in ends.dictionary.to_pylist()]
    return np.array(odd, bool)[ends.indices.to_numpy()]


def vectors(column: pa.Array, stated: pa.Array, chosen: np.ndarray) -> Iterator[np.ndarray]:
    """A row for each text, in slices: shares and sizes of a whole text, then the shares of chosen words.

    ``stated`` are the sizes that the metadata gives; without one the real one is used.
    """
    place = np.full(SPACE, -1)
    place[chosen] = np.arange(len(chosen))
    for start, stop, words, word, text in _words(column):
        n, texts = stop - start, column.slice(start, stop - start)
        body, at = bodies(texts)
        kinds = np.bincount(np.repeat(np.arange(n) * 6, np.diff(at)) + _KIND[body], minlength=n * 6).reshape(n, 6)
        size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy()
        given = pc.coalesce(stated.slice(start, n), pa.array(size, pa.int64())).to_numpy()
        lines = [[x for x in t.split("\n") if x.strip()] if t else [] for t in texts.to_pylist()]
        n_lines = np.maximum([len(x) for x in lines], 1)

        lengths = pc.utf8_length(words).to_numpy()
        shouts = np.array([w.isupper() for w in words.to_numpy(zero_copy_only=False)], bool) & (lengths > 1)
        n_words = np.bincount(text, minlength=n)
        many = np.maximum(n_words, 1)
        again = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
        of_text, times = np.unique(text * len(words) + word, return_counts=True)
        of_text, word_of = np.divmod(of_text, max(len(words), 1))
        commonest = np.zeros(n, np.int64)
        np.maximum.at(commonest, of_text, times)

        shares = np.zeros(n * len(chosen))
        for ids in _features(words):
            column_of = place[ids][word_of]
            hit = np.flatnonzero(column_of >= 0)
            shares += np.bincount(of_text[hit] * len(chosen) + column_of[hit], times[hit], len(shares))
        structure = [
            *(x / np.maximum(size, 1) for x in (kinds[:, _LETTER] + kinds[:, _CAPITAL], *kinds[:, _CAPITAL:].T)),
            np.minimum(np.bincount(text, lengths[word], n) / many / 20, 1),
            *(np.bincount(text[x[word]], minlength=n) / many for x in (lengths > 15, _marked(words), shouts)),
            np.bincount(of_text, minlength=n) / many,
            commonest / many,
            np.bincount(text[1:][again], minlength=n) / many,
            np.minimum(size / n_lines / 500, 1),
            np.array([len(set(x)) for x in lines]) / n_lines,
            np.log1p(n_words) / 10,
            np.log1p(size) / 12,
            np.log1p(np.maximum(given, 0)) / 12,
            n_words == 0,
        ]
        shares = np.log1p(shares.reshape(n, -1) * (100 / many)[:, None]) / 3
        yield np.column_stack([*structure, shares])


@dataclass(frozen=True)
class FactorisationMachine:
    """``bias + w.x + (|sum v_i x_i|**2 - sum |v_i x_i|**2) / 2``: all pairs in linear time."""

    words: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        mixed = x @ self.factors
        pairs = 0.5 * ((mixed**2).sum(axis=1) - (x**2) @ (self.factors**2).sum(axis=1))
        return sigmoid(self.bias + x @ self.linear + pairs)


def fit_machine(
    x: np.ndarray, y: np.ndarray, words: np.ndarray, factors: int = FACTORS, steps: int = 200, l2: float = 1e-4
) -> FactorisationMachine:
    """Least penalised logistic loss, rare and common labels weighing the same."""
    v = np.random.default_rng(7).normal(0, 0.05, (x.shape[1], factors))
    w, bias = np.zeros(x.shape[1]), np.zeros(1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y)
    adam, squared = Adam(w, v, bias, rate=0.05), x**2
    for _ in range(steps):
        mixed = x @ v
        pairs = 0.5 * ((mixed**2).sum(axis=1) - squared @ (v**2).sum(axis=1))
        slope = weight * (sigmoid(bias[0] + x @ w + pairs) - y)
        adam.step(
            x.T @ slope + l2 * w,
            x.T @ (slope[:, None] * mixed) - v * (squared.T @ slope)[:, None] + l2 * v,
            slope.sum(keepdims=True),
        )
    return FactorisationMachine(words, float(bias[0]), w, v)


def held_out() -> Column:
    """Documents that no fit may see: crc32 of the id, as text, leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, words: int = WORDS) -> FactorisationMachine:
    """Fit ``labels.quality`` (1 is good) on at most ``sample_rows`` labelled rows that are not held out.

    Without labelled rows every text scores 0.5.
    """
    sample = materialize(labelled_sample(docs, labels, "quality", sample_rows, ~held_out()))
    chosen = telling_features(feature_counts(sample, word_features), words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in vectors(batch.column("text"), batch.column("n_chars"), chosen):
                offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(at, len(x)), pa.ListArray.from_arrays(offsets, pa.array(x.ravel().astype(np.float32)))],
                    ["label", "x"],
                )
                at += len(x)

    got = sample.mapInArrow(run, "label int, x array<float>").toArrow().combine_chunks()
    width = len(STRUCTURE) + len(chosen)
    if not got.num_rows:
        return FactorisationMachine(chosen, 0.0, np.zeros(width), np.zeros((width, FACTORS)))
    flat = got.column("x").combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    x = flat.to_numpy(zero_copy_only=False).reshape(got.num_rows, width).astype(float)
    return fit_machine(x, (got.column("label").to_numpy() > 0).astype(float), chosen)


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, from the whole text and ``n_chars``.

    ``score`` rises with quality; ``predicted`` is 1 from 0.5 on. NULL and empty texts are scored by their
    structure (nothing in them). A NULL ``n_chars`` counts as the real size. Repeated rows are
    repeated; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(x) for x in vectors(batch.column("text"), batch.column("n_chars"), model.words)]
            score = np.concatenate([np.empty(0), *parts])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("held_out"),
                    pa.array(score),
                    pa.array((score >= 0.5).astype(np.int32)),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    size = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", "text", size.alias("n_chars"), held_out().alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )
