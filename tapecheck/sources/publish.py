"""Tables that change by commits: staged, audited, then made visible by one row of a manifest.

A published table is a folder with ``data/commit=<token>/`` and ``manifest/``. Rows are written to a commit's own
folder first, read back and audited there. Only then the commit is entered in the manifest, a small Parquet
table, by one append, whose job commit is a rename. Readers take rows of commits that the manifest names, so a crash at any
point before leaves nothing visible, and a batch that is already in is not written a second time.

Commits are numbered. Two writers may claim the same number; the first token in order has it, and the other finds that out
when it reads the manifest back, before it reports success: its rows were never visible.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapecheck.operators.blocks import materialize
from tapecheck.sources.digest import table_digest

_MANIFEST = "version long, token string, batch_id string, rows long, digest string"


class Refused(ValueError):
    """A batch that the audit does not let pass; the table is as it was."""


class Conflict(RuntimeError):
    """Another writer took the version; nothing was made visible and the call may be repeated."""


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row per batch and commit, those that lost their version left out."""
    path = f"{root}/manifest"
    if not _exists(spark, path):
        return spark.createDataFrame([], _MANIFEST)
    rows = spark.read.schema(_MANIFEST).parquet(path)
    first = F.min("token").over(Window.partitionBy("version"))
    return rows.withColumn("__first", first).where("token = __first").drop("__first")


def visible(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of all commits, or of those up to ``version``.

    Commits are folders, so what others staged is pruned and not read.
    """
    entered = manifest(spark, root)
    if version is not None:
        entered = entered.where(F.col("version") <= version)
    # The token is a partition column: Spark turns this join into a choice of folders.
    data = spark.read.option("basePath", f"{root}/data").parquet(f"{root}/data")
    return data.join(entered.select(F.col("token").alias("commit")).distinct(), "commit", "left_semi").drop("commit")


def append_batches(
    rows: DataFrame,
    root: str,
    violations: Callable[[DataFrame], DataFrame],
    batch: str = "batch_id",
    after_stage: Callable[[], None] = lambda: None,
) -> DataFrame:
    """Append every batch of ``rows`` that is new and sound; returns ``batch_id, rows, status``.

    ``violations`` gives the bad rows among those it is shown, with their ``batch_id``. A batch with one of them is
    ``refused`` whole; one that the manifest has is ``already_in`` and not written again; the others are ``appended`` in one
    commit, all of them or none. Batches are judged by joins, so there may be any number. Rows without a batch id are refused
    under the id NULL. ``after_stage`` runs between writing and entering (tests end the job there).
    """
    spark = rows.sparkSession
    known = materialize(manifest(spark, root).select(F.col("batch_id").alias(batch), "version"))
    latest = known.agg(F.max("version")).first()[0] or 0
    bad = violations(rows).select(batch).distinct().withColumn("bad", F.lit(True))
    judged = rows.groupBy(batch).agg(F.count("*").alias("rows"))
    judged = judged.join(known.select(batch).distinct().withColumn("known", F.lit(True)), batch, "left").join(bad, batch, "left")
    status = (
        F.when(F.col(batch).isNull(), "refused").when(F.col("known"), "already_in").when(F.col("bad"), "refused").otherwise("appended")
    )
    judged = materialize(judged.select(F.col(batch).alias("batch_id"), "rows", status.alias("status")))
    new = judged.where("status = 'appended'")
    if new.isEmpty():
        return judged
    token = uuid.uuid4().hex
    staged = f"{root}/data/commit={token}"
    # Hashed, not sorted: the rows are wide, and a batch is one narrow row on the other side.
    wanted = new.select(F.col("batch_id").alias(batch)).hint("shuffle_hash")
    rows.join(wanted, batch, "left_semi").select(*rows.columns).write.parquet(staged)
    after_stage()
    # What was written is what is judged: a batch whose rows changed on the way is refused with all others.
    found = spark.read.parquet(staged)
    written = materialize(table_digest(found, [batch]).withColumnRenamed(batch, "batch_id"))
    short = new.join(written.withColumnRenamed("rows", "found"), "batch_id", "left").where("rows != coalesce(found, 0)")
    if not short.isEmpty() or not violations(found).isEmpty():
        raise Refused(f"the rows staged in {staged} are not those that were judged")
    entry = written.select(F.lit(latest + 1).cast("long").alias("version"), F.lit(token).alias("token"), "batch_id", "rows", "digest")
    entry.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    if manifest(spark, root).where(F.col("token") == token).isEmpty():
        raise Conflict(f"version {latest + 1} of {root} was taken")
    return judged


def publish(
    rows: DataFrame,
    root: str,
    batch_id: str,
    violations: Callable[[DataFrame], DataFrame],
    after_stage: Callable[[], None] = lambda: None,
) -> str:
    """The same for one batch without a column of its own: ``appended`` or ``already_in``; raises :class:`Refused`."""
    one = rows.withColumn("batch_id", F.lit(batch_id))
    judge = lambda df: violations(df.drop("batch_id")).select(F.lit(batch_id).alias("batch_id"))
    found = append_batches(one, root, judge, after_stage=after_stage).first()
    status = "appended" if found is None else found["status"]
    if status == "refused":
        raise Refused(f"batch {batch_id!r} breaks a rule; {root} is as it was")
    return status


def batch_violations(spark: SparkSession, root: str, batch: str = "batch_id") -> DataFrame:
    """Batches whose visible rows are not those entered in the manifest."""
    entered = manifest(spark, root).select("batch_id", "rows", "digest")
    actual = table_digest(visible(spark, root), [batch]).select(
        F.col(batch).alias("batch_id"), F.col("rows").alias("found"), F.col("digest").alias("actual")
    )
    rule = (
        F.when(F.col("digest").isNull(), "not_entered")
        .when(F.col("actual").isNull(), "rows_missing")
        .when(F.col("actual") != F.col("digest"), "content_differs")
    )
    return entered.join(actual, "batch_id", "full_outer").select("batch_id", rule.alias("rule")).where("rule is not null")
