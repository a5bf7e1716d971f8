"""Reading, truncating and publishing tables of canonical bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapecheck.constants import BAR_COLUMNS
from tapecheck.operators.blocks import BY_POSITION, DAILY, Layout, Positions, with_blocks
from tapecheck.operators.timeline import stamp
from tapecheck.sources.digest import digest_of, table_digest


def scan_bars(spark: SparkSession, path: str) -> DataFrame:
    """Canonical columns of a Parquet table of bars.

    The schema is stated, so symbols that look like numbers in folder names stay text.
    """
    kinds = {"symbol": "string", "ts": "timestamp_ntz"}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in BAR_COLUMNS)
    return spark.read.schema(schema).parquet(path).select(*BAR_COLUMNS)


def before_cutoff(bars: DataFrame, cutoff: str, column: str = "ts") -> DataFrame:
    """Rows strictly before ``cutoff``; the condition is pushed into the scan."""
    if column not in bars.columns:
        raise ValueError(f"missing timestamp column {column!r}")
    if not isinstance(bars.schema[column].dataType, T.TimestampNTZType):
        raise ValueError(f"{column!r} must be a timestamp without time zone")
    return bars.where(F.col(column) < stamp(cutoff))


def research_rows(spark: SparkSession, path: str, cutoff: str, column: str = "ts") -> DataFrame:
    return before_cutoff(spark.read.parquet(path), cutoff, column)


def cutoff_violations(rows: DataFrame, cutoff: str, column: str = "ts") -> DataFrame:
    """One row per broken invariant of a truncated table: empty, or a late row."""
    facts = rows.agg(F.count("*").alias("n"), F.max(column).alias("newest"))
    rule = F.when(F.col("n") == 0, "no_rows").when(F.col("newest") >= stamp(cutoff), "row_after_cutoff")
    return facts.select(rule.alias("rule")).where("rule is not null")


def write_bars(
    bars: DataFrame, root: str, provider: str, interval: str = "1d", layout: Layout = DAILY
) -> None:
    """Publish under ``provider=/symbol=/interval=``; an existing table is an error.

    Rows are spread by symbol and chunk, so a dominant symbol is written by as
    many tasks as it has chunks.
    """
    (
        with_blocks(bars, layout)
        .repartition("symbol", "chunk")
        .drop("chunk", "blk")
        .withColumn("provider", F.lit(provider))
        .withColumn("interval", F.lit(interval))
        .write.mode("errorifexists")
        .partitionBy("provider", "symbol", "interval")
        .parquet(root)
    )


def write_clustered(
    bars: DataFrame, table: str, path: str, buckets: int, layout: Layout | Positions = BY_POSITION
) -> DataFrame:
    """Store bars with their ``chunk``, bucketed by symbol and chunk and sorted inside; returns the table.

    Panels over it (``layout=STORED``) read every chunk where it lies: neither the scan nor the joins between bars and what
    is carried into their chunks exchange a bar. Choose ``buckets`` for the size the table will have, some
    hundred megabytes each; an existing table is an error.
    """
    rows = with_blocks(bars, layout).drop("blk").repartition(buckets, "symbol", "chunk")
    rows.write.mode("errorifexists").option("path", path).bucketBy(buckets, "symbol", "chunk").sortBy("symbol", "chunk", "ts").saveAsTable(table)
    return bars.sparkSession.table(table)


def snapshot_metadata(bars: DataFrame, interval: str = "1d") -> DataFrame:
    """Row count, first and last timestamp and column list per symbol."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return bars.groupBy("symbol").agg(
        F.lit(interval).alias("interval"),
        F.count("*").alias("row_count"),
        iso(F.min("ts")).alias("first_timestamp"),
        iso(F.max("ts")).alias("last_timestamp"),
        F.lit(",".join(bars.columns)).alias("columns"),
    )


class ParentChanged(ValueError):
    """The parent table is not the one whose digest was recorded."""


def derive_research(
    spark: SparkSession, parent: str, target: str, cutoff: str, parent_digest: str
) -> DataFrame:
    """Publish the rows before ``cutoff`` as their own table; returns its lineage per symbol.

    The parent is read and its digest (:func:`tapecheck.sources.digest.table_digest`) compared with the recorded
    one first, whatever its files are called or how its rows lie in them; if it changed, :class:`ParentChanged` is
    raised and nothing is written. Later rows never leave the scan of the second reading, and the
    published table does not contain them physically; its own digest is part of the lineage.
    """
    rows, found = digest_of(spark.read.parquet(parent))
    if found != parent_digest:
        raise ParentChanged(f"{parent} has {rows} rows of digest {found}, recorded was {parent_digest}")
    research_rows(spark, parent, cutoff).write.mode("errorifexists").parquet(target)
    published = spark.read.parquet(target)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    facts = published.groupBy("symbol").agg(
        F.lit("research_snapshot").alias("kind"),
        F.lit(1).alias("schema_version"),
        F.lit(parent_digest).alias("source_processed_sha256"),
        F.lit(f"ts < {cutoff}").alias("derivation_predicate"),
        F.lit(cutoff).alias("research_half_open_end"),
        F.count("*").alias("row_count"),
        iso(F.min("ts")).alias("first_timestamp"),
        iso(F.max("ts")).alias("last_timestamp"),
    )
    own = table_digest(published, ["symbol"]).select("symbol", F.col("digest").alias("content_digest"))
    return facts.join(own, "symbol")
