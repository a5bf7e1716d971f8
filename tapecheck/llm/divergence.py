"""How far the sources of a language lie apart in their words: a cube of (sources, sources, terms) cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapecheck.llm.text import bodies, byte_slices, cut_words
from tapecheck.operators.blocks import materialize

#: Every ASCII byte that is no letter becomes zero, A-Z become lower case, the rest stays.
_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 0 for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Audit:
    """Which terms count, how shares are smoothed, and the sides of a cell of the cube.

    A side in sources grows with the root of their number up to ``most_sources``, so that few
    copies of a slice travel and a cell stays small.
    """

    least_documents: int = 30
    smoothing: int = 5
    scale: int = 1_000_000_000
    top_terms: int = 50
    least_sources: int = 8
    most_sources: int = 256
    terms: int = 1024


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


#: Bytes of text whose terms are counted at once.
SLICE_BYTES = 16 << 20


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents that hold the term; ``term`` is NULL
    in one more row for each group, with its documents.

    The texts of a batch are cut and counted as arrays, slice by slice. Rows are dealt by language and term, so what
    is wanted of a term in all sources of its language needs no further exchange.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = bodies(batch.column("text"))
            named = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            for start, stop in byte_slices(at, SLICE_BYTES):
                part = at[start : stop + 1]
                groups: dict[tuple, int] = {}
                group = np.array([groups.setdefault(g, len(groups)) for g in named[start:stop]], np.int64)
                terms, text = cut_words(body[part[0] : part[-1]], part - part[0], _LETTERS)
                code, size = terms.indices.to_numpy().astype(np.int64), max(1, len(terms.dictionary))
                pair, n = _distinct(group[text] * size + code)
                once, _ = _distinct(text * size + code)
                _, held = _distinct(group[once // size] * size + once % size)
                langs, sources = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
                of = pa.array(np.concatenate([np.arange(len(groups)), pair // size]))
                names = pa.concat_arrays([pa.nulls(len(groups), pa.binary()), terms.dictionary.take(pa.array(pair % size))])
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.take(of), sources.take(of), names.cast(pa.string()),
                        pa.array(np.concatenate([np.zeros(len(groups), np.int64), n])),
                        pa.array(np.concatenate([np.bincount(group, minlength=len(groups)), held])),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return (
        texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
        .repartition("lang", "term")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def _share(n: str | Column, whole: str | Column, how: Audit) -> Column:
    """``1 + floor(scale * (n + smoothing) / whole)`` in whole numbers of 38 digits."""
    count = F.col(n) if isinstance(n, str) else n
    top = (count + how.smoothing).cast("decimal(20,0)") * F.lit(how.scale).cast("decimal(12,0)")
    bottom = (F.col(whole) if isinstance(whole, str) else whole).cast("decimal(20,0)")
    return (F.call_function("div", top, bottom) + 1).cast("long")


def _cells(slices: DataFrame) -> DataFrame:
    """``lang, a, b, f``: the distances of the sources of every cell over its block of terms.

    ``slices`` holds ``lang, i, j, k``, the cell; ``side``, the block of the row's source; ``source``;
    ``term`` and its share ``p``; and in rows without a term the share ``p`` of absent terms with
    the number ``terms`` of terms in the block.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lang, i, j, _ = (k.as_py() for k in key)
        source, side = rows.column("source").to_pylist(), rows.column("side").to_numpy()
        absent = np.flatnonzero(rows.column("term").is_null().to_numpy())
        place = {source[r]: x for x, r in enumerate(absent)}
        block = side[absent]
        size = rows.column("terms").take(pa.array(absent)).to_numpy()
        shares = rows.column("p").to_numpy()
        codes = rows.column("term").combine_chunks().dictionary_encode().indices
        present = np.flatnonzero(codes.is_valid().to_numpy(zero_copy_only=False))
        column = codes.take(pa.array(present)).to_numpy()
        width = int(column.max()) + 1 if len(column) else 0
        table = np.repeat(shares[absent][:, None], width + 1, axis=1)
        table[[place[source[r]] for r in present], column] = shares[present]
        table[:, width] = shares[absent]
        weight = np.ones(width + 1, np.int64)
        weight[width] = (size[0] if len(size) else 0) - width  # terms that no source of the cell has
        names = [source[r] for r in absent]
        a, b, f = [], [], []
        for x in np.flatnonzero(block == i):
            to = np.flatnonzero(block == j)
            if i == j:
                to = to[to > x]
            apart = np.abs(table[to] - table[x]) @ weight
            a += [names[x]] * len(to)
            b += [names[y] for y in to]
            f += apart.tolist()
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()),
                         "b": pa.array(b, pa.string()), "f": pa.array(f, pa.int64())})

    return slices.groupBy("lang", "i", "j", "k").applyInArrow(run, "lang string, a string, b string, f long")


def source_divergence(docs: DataFrame, how: Audit = Audit()) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group (lang, source) of ``docs``.

    Every language keeps the terms that at least ``how.least_documents`` of its documents hold. The smoothed share
    of a term is a whole number of ``1 / how.scale``. Part ``pair``: the distance to every other source of the
    language, the sum over all kept terms of the differences of shares. Part ``term``: the terms
    that a group uses more than its language does, the ``how.top_terms`` with the largest difference.

    1. Terms are counted by group in every task, dealt by term, and those that few documents hold are left out there.
    2. Sources and terms of a language are dealt into blocks by hash. The slice of one block of
       sources and one of terms is sent to every cell (sources, sources, terms) that needs it; a cell
       is one table of about ``how.most_sources`` rows a side at most and about ``how.terms`` columns.
       What absent terms contribute is counted, not sent.
    3. The distances of the cells are added up over the blocks of terms.

    A hot source is reduced to its counts before anything is shuffled by group. NULL text, lang and source count as
    empty; a group without terms has the shares of absent terms (and distance 0 to all where its language keeps
    none). Repeated rows count each time; ties rank by name. Very long texts are counted whole. ``doc_id`` and extra
    columns are not read; an empty table gives an empty result.
    """
    of_term = Window.partitionBy("lang", "term")  # one row for each source
    counts = materialize(
        term_counts(docs)
        .withColumns({"held": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term)})
        .filter(F.col("term").isNull() | (F.col("held") >= how.least_documents))
        .select("lang", "source", "term", "n", "lang_n")
    )
    used = counts.filter("term IS NOT NULL")
    kept = materialize(used.select("lang", "term", "lang_n").distinct())
    groups = counts.filter("term IS NULL").select("lang", "source")
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    side = F.least(F.lit(how.most_sources), F.greatest(F.lit(how.least_sources), F.ceil(2 * F.sqrt("sources"))))
    langs = materialize(  # one row for each language
        sources.join(sizes, "lang", "left").select(
            "lang",
            F.coalesce("terms", F.lit(0)).alias("kept_terms"),
            F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
            F.ceil(F.col("sources") / side).cast("long").alias("source_blocks"),
            F.greatest(F.lit(1), F.ceil(F.coalesce("terms", F.lit(0)) / F.lit(how.terms))).cast("long").alias("term_blocks"),
        )
    )
    spread = lambda name, blocks: F.pmod(F.xxhash64(name), F.col(blocks))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("used"))
    facts = (
        groups.join(totals, ["lang", "source"], "left")
        .join(langs, "lang")
        .withColumn("whole", F.coalesce("used", F.lit(0)) + how.smoothing * F.col("kept_terms"))
        .withColumn("side", spread("source", "source_blocks"))
    )
    facts = materialize(facts)
    entries = used.join(facts, ["lang", "source"]).select(
        "lang", "source", "side", "source_blocks", spread("term", "term_blocks").alias("k"), "term",
        _share("n", "whole", how).alias("p"),
        _share("lang_n", F.col("lang_total") + how.smoothing * F.col("kept_terms"), how).alias("q"),
    )
    entries = materialize(entries)
    blocks = kept.join(langs, "lang").groupBy("lang", spread("term", "term_blocks").alias("k")).agg(F.count("*").alias("terms"))
    absent = (
        facts.filter("kept_terms > 0")
        .select("lang", "source", "side", "source_blocks", "whole", F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1)).alias("k"))
        .join(blocks, ["lang", "k"])
        .select("lang", "source", "side", "source_blocks", "k", F.lit(None).cast("string").alias("term"),
                _share(F.lit(0), "whole", how).alias("p"), "terms")
    )
    slices = (
        entries.drop("q").withColumn("terms", F.lit(None).cast("long"))
        .unionByName(absent)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("source_blocks") - 1)))
        .select("lang", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "k", "side", "source", "term", "p", "terms")
    )
    summed = _cells(slices).groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    # A language without kept terms has no cells; its sources are at distance 0.
    empty = facts.filter("kept_terms = 0").select("lang", "source")
    at_zero = empty.select("lang", F.col("source").alias("a")).join(empty.select("lang", F.col("source").alias("b")), "lang").filter("a < b")
    apart = summed.unionByName(at_zero.withColumn("value", F.lit(0).cast("long")))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = apart.select("lang", F.explode(both).alias("x"), "value").select(
        "lang", "x.source", F.lit("pair").alias("part"), "x.item", "value"
    )
    terms = entries.filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")
    )
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = terms.withColumn("rank", place).filter(F.col("rank") <= how.top_terms)
    return pairs.withColumn("rank", place).unionByName(ranked)
