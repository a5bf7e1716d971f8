"""Signatures from prefixes of rare-first ordered sets: two sets that are similar enough share one.

Sets are ordered by how many sets hold a token, rare ones first. If two sets share at
least ``a`` tokens, their first ``r`` shared ones lie among the first ``size - a + r`` of either.

* If the first shared token is rare, both hold it among the first ``size - a + 1``: rare tokens there
  are signatures of their own.
* If not, all shared tokens are frequent. Frequent tokens fall into classes by frequency, and those of a class into
  ``m`` drawers by hash; signatures are the combinations of ``k`` tokens of one drawer, ``k`` by class. Of the first
  ``1 + sum of m * (k - 1)`` shared tokens, some drawer of some class must hold ``k`` (else there were fewer), so the
  prefix extended by that sum has a combination in common.

The number of drawers grows with the size of a set, so a drawer holds a few tokens and signatures grow
in proportion to the set. It follows from the power of two below a set's size; a set also writes the signatures
of the next power where a similar larger set may lie there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapecheck.operators.blocks import materialize


@dataclass(frozen=True)
class Prefixes:
    """Similarity in percent; and up to how many sets hold a token of each class, with its ``k``."""

    percent: int = 90
    rare: int = 64
    frequent: tuple[tuple[int, int], ...] = ((1 << 62, 2),)

    def least_shared(self, size: int) -> int:
        """Tokens that a set of ``size`` shares at least with a similar one."""
        return -(-size * self.percent // 100)

    def drawers(self, power: int) -> int:
        return max(1, (1 << power) * (100 - self.percent) // 200)

    def powers(self, size: int) -> set[int]:
        return {size.bit_length() - 1, (size * 100 // self.percent).bit_length() - 1}


def set_signatures(size: int, many: np.ndarray, token: np.ndarray, how: Prefixes) -> list[int]:
    """Signatures of one set of ``size``; ``many, token`` are its tokens that other sets hold too, in order.

    The tokens that no other set holds come before these and need no signature.
    """
    own = size - len(token)
    slack = size - how.least_shared(size)
    out = [int(t) for t, d in zip(token[: max(0, slack + 1 - own)], many) if d <= how.rare]
    for power in how.powers(size):
        m = how.drawers(power)
        extra = sum(m * (k - 1) for _, k in how.frequent)
        drawers: dict[tuple[int, int], list[int]] = {}
        for t, d in zip(token[: max(0, slack + 1 + extra - own)].tolist(), many.tolist()):
            if d > how.rare:
                which = next(i for i, (most, _) in enumerate(how.frequent) if d <= most)
                drawers.setdefault((which, (t * 0x9E3779B97F4A7C15 >> 20) % m), []).append(t)
        for (which, _), held in drawers.items():
            for some in combinations(held, how.frequent[which][1]):
                name = np.array([power, *some], np.uint64).tobytes()
                out.append(xxhash.xxh64_intdigest(name))
    return out


def signatures(sets: DataFrame, how: Prefixes) -> DataFrame:
    """``band, node``: the signatures of ``sets (node, same, shingles)`` that at least two nodes share.

    Tokens are counted over all of ``sets`` and joined back, partly aggregated before the shuffle; a token that
    only one set holds is not sent back. A set is put in order in its own row.
    """
    # Sets of one node are kept apart by some bits of their digest; rows are narrow, for there is one for each token.
    tag = F.conv(F.hex(F.substring("same", 1, 4)), 16, 10).cast("long")
    tokens = sets.select("node", tag.alias("tag"), F.size("shingles").alias("size"), F.explode("shingles").alias("token"))
    held = tokens.groupBy("token").agg(F.count("*").alias("many")).filter("many > 1")
    ordered = (
        tokens.join(held, "token")
        .groupBy("node", "tag")
        .agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("many", "token"))).alias("tokens"))
        .select("node", "size", "tokens.many", "tokens.token")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                nodes, found = [], []
                for node, size, many, token in zip(*(part.column(c) for c in ("node", "size", "many", "token"))):
                    many, token = many.values.to_numpy(), token.values.to_numpy().view(np.uint64)
                    mine = set_signatures(size.as_py(), many, token, how)
                    nodes += [node.as_py()] * len(mine)
                    found += mine
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(found, np.uint64).view(np.int64)), pa.array(nodes, pa.int64())], ["band", "node"]
                )

    rows = materialize(ordered.mapInArrow(run, "band long, node long"))
    # Copies share many signatures: of those with the same nodes one is enough. Sums of two hashes tell nodes apart.
    lane = lambda seed: F.sum(F.xxhash64("node", F.lit(seed)).bitwiseAND(F.lit((1 << 31) - 1)))
    buckets = rows.groupBy("band").agg(F.count("*").alias("n"), lane(1).alias("x"), lane(2).alias("y")).filter("n > 1")
    return rows.join(buckets.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band", "n"), "band")
