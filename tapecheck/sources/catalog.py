"""The catalog of artifacts: hashes, latest versions, lineage and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_files(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """SHA-256 of every file below ``root``; files are hashed where they are read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", F.sha2("content", 256).alias("sha256"))
    )


def hash_rows(rows: DataFrame, path: Column, content: Column) -> DataFrame:
    """The same for content held in rows, which has no limit on the size of a file."""
    return rows.select(path.alias("path"), F.octet_length(content).cast("bigint").alias("length"), F.sha2(content, 256).alias("sha256"))


def artifact_audit(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Recorded against actual hashes, and artifacts or records without the other."""
    recorded = catalog.select("path", F.col("sha256").alias("recorded"))
    rows = files.join(recorded, "path", "full_outer")
    status = (
        F.when(F.col("sha256").isNull(), "file_missing")
        .when(F.col("recorded").isNull(), "not_in_catalog")
        .when(F.col("sha256") != F.col("recorded"), "hash_mismatch")
        .otherwise("ok")
    )
    return rows.withColumn("status", status)


def _utc(text: Column) -> Column:
    """A time with or without offset as zone-free UTC, whatever the session's zone."""
    offset = F.regexp_extract(text, r"([+-])([0-9]{2}):?([0-9]{2})\z", 0)
    timed = text.contains("T") | text.contains(" ")
    has_offset = timed & (offset != "") & text.rlike(r":[0-9]{2}(\.[0-9]+)?[+-][0-9]{2}:?[0-9]{2}\z")
    minutes = F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, -2, 2).cast("int")
    local = F.regexp_replace(text, r"(Z|[+-][0-9]{2}:?[0-9]{2})\z", "")
    shift = F.when(offset.startswith("-"), minutes).otherwise(-minutes)
    return F.when(
        has_offset, local.try_cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), shift)
    ).otherwise(F.regexp_replace(text, r"Z\z", "").try_cast("timestamp_ntz"))


def latest_artifact(catalog: DataFrame) -> DataFrame:
    """Newest processed artifact by recorded creation time per ``symbol, interval``.

    Creation times are instants: an offset counts, and a time without one is UTC. They are
    returned as UTC.

    Among equal times the first path in order is taken. A group with an artifact
    that has no valid creation time is reported as such and yields no path.
    """
    stamped = catalog.where("kind = 'processed'").withColumn("created_at", _utc(F.col("created_at_utc")))
    per_time = stamped.groupBy("symbol", "interval", "created_at").agg(
        F.min("path").alias("path"), F.count("*").alias("artifacts")
    )
    newest = per_time.groupBy("symbol", "interval").agg(
        F.max_by("path", "created_at").alias("path"),
        F.max("created_at").alias("created_at"),
        F.sum("artifacts").alias("artifacts"),
        F.sum(F.when(F.col("created_at").isNull(), F.col("artifacts")).otherwise(0)).alias("invalid"),
    )
    ok = F.col("invalid") == 0
    return newest.select(
        "symbol",
        "interval",
        F.when(ok, F.col("path")).alias("path"),
        F.when(ok, F.col("created_at")).alias("created_at"),
        "artifacts",
        F.when(ok, "ok").otherwise("invalid_metadata").alias("status"),
    )


def lineage_join(catalog: DataFrame) -> DataFrame:
    """Processed artifacts with the raw artifact they were made from.

    The recorded path leads to the parent and the recorded hash must be its own; ``status`` is
    ``raw_missing`` or ``hash_differs`` otherwise, and ``raw_path`` NULL.
    """
    raw = catalog.where("kind = 'raw'").select(F.col("path").alias("source_raw_file"), F.col("sha256").alias("actual"))
    processed = catalog.where("kind = 'processed'").select("path", "symbol", "source_raw_file", "source_raw_sha256")
    status = (
        F.when(F.col("actual").isNull(), "raw_missing")
        .when(~F.col("actual").eqNullSafe(F.col("source_raw_sha256")), "hash_differs")
        .otherwise("ok")
    )
    return processed.join(raw, "source_raw_file", "left").select(
        "source_raw_sha256",
        "path",
        "symbol",
        F.when(status == "ok", F.col("source_raw_file")).alias("raw_path"),
        status.alias("status"),
    )


def identity_violations(catalog: DataFrame) -> DataFrame:
    """Path parts of a processed artifact against its recorded identity."""
    parts = F.split("path", "/")
    identity = F.concat_ws("/", "provider", "symbol", "interval")
    found = F.concat_ws("/", parts[1], parts[2], parts[3])
    rule = (
        F.when((F.size(parts) != 5) | (parts[0] != "processed"), "not_a_processed_location")
        .when(~F.col("path").endswith(".canonical.parquet"), "not_a_canonical_file")
        .when(
            F.exists(F.array("provider", "symbol", "interval"), lambda x: F.coalesce(x, F.lit("")) == ""),
            "identity_incomplete",
        )
        .when(identity != found, "identity_differs_from_path")
        .when(~F.col("file").eqNullSafe(F.col("path")), "file_differs_from_path")
    )
    return catalog.where("kind = 'processed'").select("path", rule.alias("rule")).where("rule is not null")


def new_artifacts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths in the later listing that the earlier one lacks."""
    return after.select("path").join(before.select("path"), "path", "left_anti")
