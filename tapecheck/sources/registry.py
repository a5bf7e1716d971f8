"""The experiment registry: a CSV table that is appended to, never rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapecheck.constants import REGISTRY_COLUMNS, REGISTRY_OLD_COLUMNS
from tapecheck.operators.quality import registry_violations, require_empty
from tapecheck.sources import publish

# Doubled quotes inside quoted fields; fields may hold commas and line breaks.
CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "emptyValue": ""}


def _schema(columns) -> str:
    return ", ".join(f"{c} string" for c in columns)


def registry_scan(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, blanks as empty strings; a wrong header is an error."""
    rows = spark.read.options(**CSV).option("enforceSchema", "false").schema(_schema(REGISTRY_COLUMNS)).csv(path)
    return rows.na.fill("")


def append_records(records: DataFrame, path: str) -> None:
    """Append records that keep the contract; refuses the batch otherwise."""
    require_empty(registry_violations(records), "registry contract")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in REGISTRY_COLUMNS]
    records.select(*text).write.options(**{k: v for k, v in CSV.items() if k != "multiLine"}).mode("append").csv(path)


def append_batches(records: DataFrame, root: str, batch: str = "batch_id") -> DataFrame:
    """Records in batches, committed by :func:`tapecheck.sources.publish.append_batches`: a batch that is in is not
    appended again, and one with a record that breaks the contract is refused whole."""

    def bad(rows: DataFrame) -> DataFrame:
        return registry_violations(rows, [batch])

    return publish.append_batches(records, root, bad, batch)


def registry_migrate(old: DataFrame) -> DataFrame:
    """Old layout to new: ``params`` is renamed, new columns are blank, status dev."""
    if tuple(old.columns) != REGISTRY_OLD_COLUMNS:
        raise ValueError(f"unexpected registry header: {old.columns}")
    source = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in REGISTRY_OLD_COLUMNS}
    source["params_json"] = source.pop("params")
    source["record_status"] = F.lit("dev")
    return old.select(*[source.get(c, F.lit("")).alias(c) for c in REGISTRY_COLUMNS])
