"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapecheck.llm.samples import SPACE, Adam, feature_counts, feature_ids, labelled_sample, sigmoid, telling_features
from tapecheck.llm.text import distinct, word_slices
from tapecheck.operators.blocks import materialize

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are features besides the word itself.
PREFIXES = (3, 4, 5, 6, 7)
#: Variety of evidence (distinct features telling for toxicity) from which a toxic text has grade 2, 3.
GRADES_FROM = (4, 10)
LEAST_RATE = 0.5
SAMPLE_ROWS = 20_000
FEATURES = 2048
#: ASCII letters become small, other ASCII ends a word; what else a word holds is looked at once it is cut.
_KEPT = np.array([c if c >= 128 else ord(chr(c).lower()) * chr(c).isalpha() for c in range(256)], np.uint8)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _words(column: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """For slices ``start, stop`` of a column of texts: words, and of every place in them the number of its word and text.

    They are :func:`words_of` every text, but equal runs of letters are looked at once a slice.
    """
    column = column.cast(pa.large_string())
    if pc.any(pc.match_substring(column, "Σ")).as_py():  # becomes what the letters around it demand
        column = pa.array([t.lower() if t and "Σ" in t else t for t in column.to_pylist()], pa.large_string())
    for start, stop, runs, text in word_slices(column, _KEPT):
        known, many = [], np.ones(len(runs.dictionary), np.int64)
        for i, run in enumerate(runs.dictionary.cast(pa.string()).to_numpy(zero_copy_only=False)):
            if (low := run.lower()).isalpha():
                known.append(low)
            else:
                known += (parts := words_of(low))
                many[i] = len(parts)
        run = runs.indices.to_numpy()
        times = many[run]
        before = np.cumsum(times) - times
        word = np.arange(times.sum()) + np.repeat((np.cumsum(many) - many)[run] - before, times)
        yield start, stop, pa.array(known, pa.string()), word, np.repeat(text, times)


def _features(words: pa.Array) -> Iterator[np.ndarray]:
    """Feature ids of the whole words, then of their beginnings of every length; -1 where a word has none or has it already."""
    sizes, layers = pc.utf8_length(words).to_numpy(), []
    for n in (None, *PREFIXES):
        ids = feature_ids("", pc.utf8_slice_codeunits(words, 0, n), "*") if n else feature_ids("=", words)
        again = [ids == x for x in layers]
        layers.append(np.where(np.logical_or.reduce([sizes < (n or 0), *again]), -1, ids))
        yield layers[-1]


def text_features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of texts and the ids of their features, every pair once."""
    for start, _, words, word, text in _words(column):
        text, word = np.divmod(distinct(text * len(words) + word), max(len(words), 1))
        pairs = [text[ids[word] >= 0] * SPACE + ids[word][ids[word] >= 0] for ids in _features(words)]
        text, ids = np.divmod(distinct(np.concatenate(pairs)), SPACE)
        yield start + text, ids


@dataclass(frozen=True)
class OrdinalModel:
    """``P(grade > k) = sigmoid(weights . x - thresholds[k])`` with ascending thresholds.

    ``x`` is the logarithm of one plus how often each of ``features`` (sorted ids) occurs in a thousand words, so a text
    said twice has the same severity; at least :data:`LEAST_RATE` where it occurs, so that length does not hide it.
    """

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def exceeding(self, texts: pa.Array) -> np.ndarray:
        """For every text the probabilities that its grade exceeds 0, 1, ..."""
        rows, columns, values = vectors(texts, self.features)
        score = np.bincount(rows, values * self.weights[columns], len(texts)) if len(rows) else np.zeros(len(texts))
        return sigmoid(score[:, None] - self.thresholds[None, :])


def vectors(texts: pa.Array, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows over the chosen features: row numbers, positions and values."""
    place = np.full(SPACE + 1, -1)  # the last is for the id -1
    place[features] = np.arange(len(features))
    parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for start, stop, words, word, text in _words(texts):
        total, cells = np.bincount(text, minlength=stop - start), []
        for ids in _features(words):
            at = place[ids][word]
            hit = np.flatnonzero(at >= 0)
            cells.append(text[hit] * len(features) + at[hit])
        cells, counts = np.unique(np.concatenate(cells), return_counts=True)
        row, column = np.divmod(cells, max(len(features), 1))
        parts.append((start + row, column, np.maximum(counts * 1000 / total[row], LEAST_RATE)))
    rows, columns, values = map(np.concatenate, zip(*parts))
    return rows, columns, np.log1p(values)


def fit_ordinal(
    sparse: tuple[np.ndarray, np.ndarray, np.ndarray], grades: np.ndarray, width: int, steps: int = 400, l2: float = 2e-4
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of least penalised loss, summed over all thresholds.

    Thresholds are a first one and positive gaps, so they stay ordered; the weights are shared.
    """
    rows, columns, values = sparse
    top = max(int(grades.max(initial=0)), 1)
    weights, first, gaps = np.zeros(width), np.array([2.0]), np.zeros(top - 1)
    above = (grades[:, None] > np.arange(top)[None, :]).astype(float)
    adam = Adam(weights, first, gaps, rate=0.08)
    for _ in range(steps):
        score = np.bincount(rows, values * weights[columns], len(grades))
        thresholds = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        slope = (sigmoid(score[:, None] - thresholds[None, :]) - above) / len(grades)
        by_row, by_threshold = slope.sum(axis=1), -slope.sum(axis=0)
        later = by_threshold[1:][::-1].cumsum()[::-1]
        adam.step(
            np.bincount(columns, values * by_row[rows], width) + l2 * weights,
            by_threshold.sum(keepdims=True),
            later * np.exp(gaps),
        )
    return weights, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def fit(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, fits=None
) -> OrdinalModel:
    """Fit on at most ``sample_rows`` labelled documents.

    Values of ``labels.toxic`` above 1 are given grades. Where it is only 0 or 1, the grades above 0 are read off the
    variety of evidence in a toxic text: how many features it holds that in the sample occur in toxic texts at least ten times as
    often as in others; from :data:`GRADES_FROM` on a text has grade 2, or 3. How often it repeats them and how long it is
    does not count. Without labelled rows every text gets grade 0.
    """
    sample = materialize(labelled_sample(docs, labels, "toxic", sample_rows, fits))
    counts = feature_counts(sample, text_features)
    chosen = telling_features(counts, features)
    if not len(chosen):
        return OrdinalModel(chosen, np.zeros(0), np.array([40.0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns, values = vectors(batch.column("text"), chosen)
            starts = pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = (pa.ListArray.from_arrays(starts, pa.array(x)) for x in (columns, values))
            yield pa.RecordBatch.from_arrays([batch.column("label"), *lists], ["label", "columns", "values"])

    got = sample.mapInArrow(run, "label int, columns array<long>, values array<double>").toArrow().combine_chunks()
    grades = got.column("label").to_numpy().astype(int)
    lists = got.column("columns").combine_chunks()
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    columns = lists.flatten().to_numpy()
    values = got.column("values").combine_chunks().flatten().to_numpy()
    if grades.max() <= 1:
        toxic = grades > 0
        in_toxic = np.bincount(columns[toxic[rows]], minlength=len(chosen)) / max(toxic.sum(), 1)
        in_clean = np.bincount(columns[~toxic[rows]], minlength=len(chosen)) / max((~toxic).sum(), 1)
        telling = in_toxic >= 10 * in_clean
        variety = np.bincount(rows[telling[columns]], minlength=len(grades))
        grades = np.where(toxic, 1 + sum((variety >= n).astype(int) for n in GRADES_FROM), 0)
    weights, thresholds = fit_ordinal((rows, columns, values), grades, len(chosen))
    return OrdinalModel(chosen, weights, thresholds)


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``doc_id, severity, p_toxic, toxic`` for every row, from the whole text.

    ``severity`` is the expected grade, the sum of the probabilities to exceed each
    threshold; ``toxic`` is ``p_toxic >= 0.5``. A NULL or empty text has no features; a text of any length is
    read whole, in one row. Repeated rows are repeated and score alike; a NULL id is kept; extra columns are not read;
    an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.exceeding(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(p.sum(axis=1)),
                    pa.array(p[:, 0]),
                    pa.array(p[:, 0] >= 0.5),
                ],
                ["doc_id", "severity", "p_toxic", "toxic"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, severity double, p_toxic double, toxic boolean"
    )


def without_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` without the rows that are toxic by ``model``, columns and their types unchanged.

    NULL and empty texts have no features and stay where the model calls that clean; repeated rows stay or go together;
    rows without id are judged like others. Extra columns may have any name; an empty table gives an empty result.
    """
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.exceeding(batch.column(place))
            yield batch.filter(pa.array(p[:, 0] < 0.5))

    return docs.mapInArrow(run, docs.schema)
