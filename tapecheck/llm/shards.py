"""Sharding over fixed virtual slots with a versioned slot-to-shard map."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapecheck.operators.blocks import materialize


def _lookup(values: tuple[int, ...], key: Column, kind: str) -> Column:
    """``values[key]`` as an expression over one constant array."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>"), key + 1)


@dataclass(frozen=True)
class SlotMap:
    """Which shard owns each slot. Never changed in place: edits give the next version."""

    version: int
    shards: int
    owner: tuple[int, ...]

    @classmethod
    def even(cls, slots: int, shards: int) -> SlotMap:
        return cls(0, shards, tuple(i % shards for i in range(slots)))

    def rebalanced(self, slot_bytes: Mapping[int, int], shards: int | None = None) -> SlotMap:
        """The next version: slots move from the heaviest to the lightest shard while that helps.

        More ``shards`` than before start empty. A move takes the slot nearest to half the
        gap between the two shards, so at the end the shards differ by less than the
        smallest filled slot of the heaviest one.
        """
        shards = shards or self.shards
        owner = list(self.owner)
        held: list[dict[int, int]] = [{} for _ in range(shards)]
        for slot, size in slot_bytes.items():
            if size:
                held[owner[slot]][slot] = size
        total = [sum(h.values()) for h in held]
        while True:
            heavy = max(range(shards), key=lambda s: (total[s], -s))
            light = min(range(shards), key=lambda s: (total[s], s))
            gap = total[heavy] - total[light]
            movable = [(abs(2 * size - gap), slot) for slot, size in held[heavy].items() if size < gap]
            if not movable:
                return SlotMap(self.version + 1, shards, tuple(owner))
            slot = min(movable)[1]
            size = held[heavy].pop(slot)
            held[light][slot] = size
            owner[slot] = light
            total[heavy] -= size
            total[light] += size

    def table(self, spark: SparkSession) -> DataFrame:
        slot = F.col("id").cast("int")
        return spark.range(len(self.owner)).select(
            F.lit(self.version).alias("version"),
            F.lit(self.shards).alias("shards"),
            slot.alias("slot"),
            _lookup(self.owner, slot, "int").alias("shard"),
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the map table at ``path`` (a shared folder)."""
        self.table(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, by default the latest."""
        rows = spark.read.parquet(path)
        if version is None:
            version = rows.agg(F.max("version")).first()[0]
        found = rows.filter(F.col("version") == version).select("slot", "shard", "shards").collect()
        owner = {r["slot"]: r["shard"] for r in found}
        return cls(version, found[0]["shards"], tuple(owner[i] for i in range(len(owner))))


def sized(docs: DataFrame, slots: int) -> DataFrame:
    """``doc_id, size, text_crc32, vslot``. The slot is a hash of id and content, so that
    repeated or missing ids do not gather in one slot."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    ).withColumn(
        "vslot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int")
    )


#: Times that a row may repeat id and content before its repeats are dealt over slots.
REPEATS = 1000


def _dealt(rows: DataFrame, slots: int) -> DataFrame:
    """``rows`` of :func:`sized`, written out; the repeats of rows that occur very often are dealt over all slots.

    Such rows are one key to any hash; they get a slot by a number that every row is given once.
    """
    keys = ["doc_id", "size", "text_crc32"]
    placed = materialize(rows.withColumn("at", F.monotonically_increasing_id()))
    often = placed.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > REPEATS)
    often = materialize(often.select(*[F.col(c).alias(f"__{c}") for c in keys]))
    if often.isEmpty():
        return placed.drop("at")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    marked = placed.join(often, same, "left")
    spread = F.pmod(F.xxhash64("at"), F.lit(slots)).cast("int")
    repeated = F.col("__size").isNotNull()
    return materialize(marked.withColumn("vslot", F.when(repeated, spread).otherwise(F.col("vslot"))).select(*rows.columns))


def shard_by_bytes(
    docs: DataFrame, shards: int = 8, slots: int = 4096, store: str | None = None
) -> DataFrame:
    """Deal all rows into ``shards`` of near equal bytes.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``: ``slot`` is the
    row's place in its shard, without gaps from 0; ``grown_shard`` is NULL, because under
    the law ``bytes`` a new shard takes part in the next rebalancing.

    Rows are hashed into fixed virtual slots, bytes are summed per slot, and version 0 of the
    slot map (dealt round) is edited to version 1 by those sums; both versions go to ``store``
    if it is given. Only the per-slot sums reach the driver: ``slots`` rows at any input size.
    Places are numbered inside virtual slots and offset by the counts of earlier ones, so
    no shard is ever ordered in one task; raise ``slots`` with the corpus.

    A NULL text has size 1; texts of any length are read whole. Rows without id are dealt like others; those of
    which more than :data:`REPEATS` have the same id and content are dealt over all slots, for a hash would send them to
    one. An empty table gives an empty result; extra columns are not read.
    """
    spark = docs.sparkSession
    rows = _dealt(sized(docs, slots), slots)
    loads = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    start = SlotMap.even(slots, shards)
    current = start.rebalanced({r["vslot"]: r["bytes"] for r in loads})
    if store:
        for version in (start, current):
            version.save(spark, store)
    counts, reached, offsets = {r["vslot"]: r["rows"] for r in loads}, [0] * shards, []
    for slot, shard in enumerate(current.owner):
        offsets.append(reached[shard])
        reached[shard] += counts.get(slot, 0)
    inside = F.row_number().over(
        Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")
    )
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        _lookup(current.owner, F.col("vslot"), "int").alias("shard"),
        (_lookup(tuple(offsets), F.col("vslot"), "bigint") + inside - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
