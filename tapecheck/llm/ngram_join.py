"""N-gram Jaccard join: prefix signatures of single rare and combined frequent shingles, verified on full sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapecheck.llm import linking
from tapecheck.llm.near import shingle_set, split_words
from tapecheck.llm.prefixes import Prefixes, signatures
from tapecheck.operators.blocks import materialize


@dataclass(frozen=True)
class Joining:
    """Words in a shingle, and the similarity with the classes of shingles."""

    words: int = 5
    prefixes: Prefixes = field(default_factory=lambda: Prefixes(percent=80))

    @property
    def percent(self) -> int:
        return self.prefixes.percent


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(shingles.tobytes())


def _name(digest: bytes) -> int:
    """A set's name of 64 bits for the screen, never 0; sets that share one only pass more easily."""
    return int.from_bytes(digest[:8], "little", signed=True) or 1


def _shown(size: int, how: Joining) -> int:
    """The ``r`` of a set of this size (see :func:`_marks`); it does not fall with the size. 0 if only equal sets are similar."""
    slack = size - how.prefixes.least_shared(size)
    if not slack:  # all must be shared, but a similar set may have more
        return int(size * 100 // how.percent > size)
    return min(slack, size - slack)


def _least(size: int, how: Joining) -> int:
    """How many of the first shingles of a set every similar one has among its own: what the smallest of those shows."""
    return _shown(how.prefixes.least_shared(size), how)


def _sized(docs: DataFrame, how: Joining) -> DataFrame:
    """``doc_id, n_shingles, same, name, least``; texts without words have no ``same``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for text in batch.column("text"):
                found = shingle_set(split_words(text.as_py()), how.words)
                sizes.append(len(found))
                digests.append(_digest(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array([None if d is None else _name(d) for d in digests], pa.int64()),
                    pa.array([_least(n, how) for n in sizes], pa.int64()),
                ],
                ["doc_id", "n_shingles", "same", "name", "least"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, same binary, name long, least long"
    )


def _lists(flat: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat))


#: Shingles that a task sorts at once, and that one group of the screen holds on average.
CHUNK = 1 << 20


def _marks(docs: DataFrame, how: Joining, parts: int) -> DataFrame:
    """``name, n``: how many of the first shingles of each set other sets have among their first, never too few.

    In order of hashes the first ``size - a + r`` shingles of either of two similar sets hold the first ``r`` that
    they share, ``a`` being the least number they share; ``r`` is as large as ``size - a`` here.

    Shingles travel packed, sixteen bytes each, to the group their hash names. What several sets of a task share is
    marked in place, and only one entry for it travels, so a shingle of very many texts does not make a large group.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            pairs = np.stack([np.concatenate(tokens), np.concatenate(owners).view(np.uint64)])
            tokens.clear(), owners.clear()
            pairs = pairs[:, np.lexsort(pairs[::-1])]
            new = np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)])
            token, owner = pairs[:, new]
            first = np.concatenate([[True], token[1:] != token[:-1]])
            start = np.flatnonzero(first)
            many = np.diff(np.append(start, len(token)))
            shared = np.repeat(many > 1, many)
            names, n = np.unique(owner[shared].view(np.int64), return_counts=True)
            token, owner = token[start], np.where(many > 1, np.uint64(0), owner[start])
            part = ((token * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            part, token, owner = part[order], token[order], owner[order]
            begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            cuts = np.append(begin, len(part))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[begin].astype(np.int64)), pa.array(np.zeros(len(begin), bool)),
                    _lists(token.view(np.int64), cuts), _lists(owner.view(np.int64), cuts),
                ],
                ["part", "marked", "tokens", "owners"],
            )
            if len(names):
                cuts = np.append(np.arange(0, len(names), 4096), len(names))
                to = pa.array(names[cuts[:-1]] % parts)
                yield pa.RecordBatch.from_arrays(
                    [to, pa.array(np.ones(len(cuts) - 1, bool)), _lists(n.astype(np.int64), cuts), _lists(names, cuts)],
                    ["part", "marked", "tokens", "owners"],
                )

        held = 0
        for batch in batches:
            for text in batch.column("text"):
                found = shingle_set(split_words(text.as_py()), how.words)
                r = _shown(len(found), how)
                if r:
                    head = found[: len(found) - how.prefixes.least_shared(len(found)) + r]
                    tokens.append(head)
                    owners.append(np.full(len(head), _name(_digest(found)), np.int64))
                    held += len(head)
                if held > CHUNK:
                    yield from flush()
                    held = 0
        if held:
            yield from flush()

    def meet(rows: pa.Table) -> pa.Table:
        marked = rows.column("marked").to_numpy()
        flat = lambda table, name: table.column(name).combine_chunks().flatten().to_numpy()
        done, open_ = rows.filter(pa.array(marked)), rows.filter(pa.array(~marked))
        token, owner = flat(open_, "tokens"), flat(open_, "owners")
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        many = np.diff(np.append(start, len(token)))
        last = owner[np.cumsum(many) - 1]
        # Entries of one token are in order of owner, 0 stands for several: it is shared unless all are of one owner.
        shared = np.repeat((owner[start] != last) | (owner[start] == 0), many)
        names, n = np.unique(np.concatenate([owner[shared & (owner != 0)]]), return_counts=True)
        return pa.table({
            "name": pa.array(np.concatenate([names, flat(done, "owners")]), pa.int64()),
            "n": pa.array(np.concatenate([n, flat(done, "tokens")]), pa.int64()),
        })

    sent = docs.select("text").mapInArrow(send, "part long, marked boolean, tokens array<long>, owners array<long>")
    return sent.groupBy("part").applyInArrow(meet, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, nodes: DataFrame, how: Joining) -> DataFrame:
    """Full sets ``node, same, shingles`` of the nodes that enough of whose first shingles others hold too."""
    able = nodes.filter("node IS NOT NULL AND least > 0")  # others are linked with equal ones only
    total = able.agg(F.sum(F.col("least") * 2)).first()[0] or 0
    marks = _marks(docs, how, max(64, total // CHUNK))
    likely = marks.join(able, "name").filter("n >= least")
    named = materialize(likely.select(F.col("node").alias("__node"), F.col("same").alias("__same")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounded output batches
                part = batch.slice(at, 256)
                sets = [shingle_set(split_words(t.as_py()), how.words) for t in part.column("text")]
                wanted = part.column("__same").to_pylist()
                rows = [i for i, s in enumerate(sets) if _digest(s) == wanted[i]]  # else another text of the same id
                cuts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in rows])])
                flat = np.concatenate([*(sets[i] for i in rows), np.empty(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()).take(pa.array(rows, pa.int64())),
                        pa.array([wanted[i] for i in rows], pa.binary()),
                        _lists(flat, cuts),
                    ],
                    ["node", "same", "shingles"],
                )

    texts = docs.select("doc_id", "text").join(named, F.col("doc_id") == F.col("__node")).select("doc_id", "text", "__same")
    return linking.one_set_each(texts.mapInArrow(run, "node long, same binary, shingles array<long>"))


def ngram_classes(docs: DataFrame, how: Joining = Joining()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Documents are linked when the distinct shingles they share are at least ``how.percent`` of those that either
    has; ``component_id`` is the smallest ``doc_id`` reachable over links.

    1. Rows with equal shingle sets become one node, aggregated before the shuffle.
    2. A screen on a part of each set (the smallest hashes) leaves out texts that can have no partner; what is left
       is counted and ordered as a whole.
    3. :mod:`tapecheck.llm.prefixes` gives signatures; all similar sets share one, without exception. Single shingles
       stand for rare classes, combinations for frequent ones, so texts that share a common passage only never meet.
    4. Within a bucket all are verified on full sets against one pivot; members which that leaves in different components
       are compared in slices (:func:`tapecheck.llm.linking.remaining_links`), so every link between components is found
       and a large group of copies costs as many pairs as it has members.

    Texts without words (NULL, empty) have size 0 and are linked with nothing. Rows without ``doc_id`` belong
    to the component of an equal set if there is one with an id; otherwise they have no ``component_id``. Rows
    that repeat a ``doc_id`` are one node, linked where any of their texts is. Texts of any length are read whole. Extra columns are
    not read; an empty table gives an empty result.
    """
    screened = materialize(_sized(docs, how))
    nodes = materialize(
        screened.filter("same IS NOT NULL")
        .groupBy("same", "name", "least")
        .agg(F.min("doc_id").alias("node"))
    )
    sets = _candidates(docs, nodes, how)
    found = linking.completed(materialize(signatures(sets, how.prefixes)), sets, how.percent)
    return (
        screened.select("doc_id", "n_shingles", "same")
        .join(nodes.select("same", "node"), "same", "left")
        .join(found, "node", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"))
    )
