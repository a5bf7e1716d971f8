"""The digest of a table's content: the same for any order of rows and any layout of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A row's hash is cut into lanes that are added up apart. Twenty bits a lane leave room for 2**43 rows
# in a 64-bit sum, so a total never overflows.
LANES, LANE_DIGITS = 12, 5


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of a row: by column in order of name, NULL or the length and text of its value.

    Names and lengths keep rows apart whose texts only run together alike.
    """
    parts = []
    for name in sorted(columns):
        text = F.col(f"`{name}`").cast("string")
        parts += [
            F.lit(f"{name}="),
            F.when(text.isNull(), "-").otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text)),
            F.lit(";"),
        ]
    return F.sha2(F.concat(*parts), 256)


def table_digest(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, rows, digest``: the number of rows and a digest of them as a multiset.

    Hashes are added, lane by lane, so partial sums combine before the one small shuffle, order and files do not
    matter, and a row more, less or repeated changes the digest. An empty table without ``keys`` has a digest too.
    Nested columns are hashed as Spark writes them as text.
    """
    lanes = [
        F.sum(F.conv(F.substring("__hash", 1 + LANE_DIGITS * i, LANE_DIGITS), 16, 10).cast("bigint")) for i in range(LANES)
    ]
    hashed = rows.select(*keys, row_hash(rows.columns).alias("__hash"))
    total = F.concat_ws(",", F.count("*").cast("string"), *[F.coalesce(x, F.lit(0)).cast("string") for x in lanes])
    return hashed.groupBy(*keys).agg(F.count("*").alias("rows"), F.sha2(total, 256).alias("digest"))


def digest_of(rows: DataFrame) -> tuple[int, str]:
    """Rows and digest of a whole table (one row reaches the driver)."""
    return tuple(table_digest(rows).first())


def digest_violations(rows: DataFrame, recorded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups whose content is not the one recorded in ``keys, digest``, with the ``rule`` they break."""
    actual = table_digest(rows, keys).select(*keys, F.col("digest").alias("actual"))
    rule = (
        F.when(F.col("digest").isNull(), "not_recorded")
        .when(F.col("actual").isNull(), "rows_missing")
        .when(F.col("actual") != F.col("digest"), "content_differs")
    )
    both = actual.join(recorded.select(*keys, "digest"), list(keys), "full_outer")
    return both.select(*keys, rule.alias("rule")).where("rule is not null")
