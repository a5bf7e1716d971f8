"""Raw page artifacts: nested JSON with a closed schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapecheck.constants import (
    ARTIFACT_KEYS,
    CANDLE_KEYS,
    PAGE_KEYS,
    RATE_LIMIT_KEYS,
    RAW_GRANULARITY,
    RAW_INTERVAL,
    RAW_PRODUCTS,
    RAW_PROVIDER,
    RAW_SCHEMA_VERSION,
    REQUEST_KEYS,
    RETRIEVAL_KEYS,
)
from tapecheck.functions.documents import as_list, as_object, whole_document

CANDLE = "struct<" + ",".join(f"{k}:string" for k in CANDLE_KEYS) + ">"
PAGE = (
    "struct<request:struct<" + ",".join(f"{k}:string" for k in REQUEST_KEYS) + ">,"
    f"rate_limit_headers:map<string,string>,candles:array<{CANDLE}>>"
)
ARTIFACT = (
    "schema_version int, provider string, product string, interval string, "
    "retrieval struct<" + ",".join(f"{k}:string" for k in RETRIEVAL_KEYS) + ">, "
    f"pages array<{PAGE}>"
)


def read_artifacts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Artifacts under the fixed schema; never inferred.

    ``strict`` fails on text that is not such a document, otherwise it is kept
    in ``_corrupt``.
    """
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    schema = ARTIFACT if strict else ARTIFACT + ", _corrupt string"
    return reader.option("columnNameOfCorruptRecord", "_corrupt").schema(schema).json(path)


def flatten_pages(artifacts: DataFrame) -> DataFrame:
    """One row per candle, with its page and place in the response."""
    pages = artifacts.select(
        "product", "retrieval.started_at_utc", F.posexplode("pages").alias("page_no", "page")
    )
    return pages.select(
        "product",
        "started_at_utc",
        "page_no",
        F.col("page.request.start").alias("request_start"),
        F.col("page.request.end").alias("request_end"),
        F.posexplode("page.candles").alias("pos", "candle"),
    ).select("product", "started_at_utc", "page_no", "request_start", "request_end", "pos", "candle.*")


def artifact_counts(artifacts: DataFrame) -> DataFrame:
    """Pages and candles per artifact, without exploding them."""
    return artifacts.select(
        "product",
        F.size("pages").cast("bigint").alias("page_count"),
        F.aggregate(
            "pages", F.lit(0).cast("bigint"), lambda n, p: n + F.size(p["candles"])
        ).alias("candle_count"),
    )


def page_plan_mismatch(stored: DataFrame, planned: DataFrame, keys: Sequence[str] = ("product",)) -> DataFrame:
    """Stored request bounds against the plan made again from retrieval time."""
    side = lambda df, p: df.select(
        *keys, F.col("page_no").cast("int"),
        F.col("request_start").alias(f"{p}_start"), F.col("request_end").alias(f"{p}_end"),
    )
    rows = side(stored, "found").join(side(planned, "expected"), [*keys, "page_no"], "full_outer")
    reason = (
        F.when(F.col("found_start").isNull(), "page_missing")
        .when(F.col("expected_start").isNull(), "page_unplanned")
        .when(
            (F.col("found_start") != F.col("expected_start")) | (F.col("found_end") != F.col("expected_end")),
            "window_mismatch",
        )
    )
    return rows.withColumn("reason", reason).where("reason is not null")


def _keys_differ(found: Column, wanted: Sequence[str]) -> Column:
    expected = F.array(*[F.lit(k) for k in wanted])
    return F.coalesce(
        (F.size(F.array_except(found, expected)) > 0) | (F.size(F.array_except(expected, found)) > 0),
        F.lit(True),
    )


def _all_text(m: Column, keys: Sequence[str] | None = None) -> Column:
    values = F.map_values(m) if keys is None else F.array(*[m[k] for k in keys])
    return F.coalesce(
        F.forall(values, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))), F.lit(False)
    )


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def page_schema_violations(
    documents: DataFrame,
    keys: Sequence[str],
    body: str = "body",
    provider: str = RAW_PROVIDER,
    products: Sequence[str] | None = RAW_PRODUCTS,
) -> DataFrame:
    """``keys, rule`` for each part of the closed schema a document breaks."""
    v = F.col("v")
    rows = documents.select(*keys, whole_document(F.col(body)).alias("v"))
    pages = as_list(v, "$.pages")
    utc = lambda f: F.coalesce(
        _text(v, f"$.retrieval.{f}").rlike(r"(Z|\+00:00)\z")
        & F.try_to_timestamp(_text(v, f"$.retrieval.{f}")).isNotNull(),
        F.lit(False),
    )
    some = lambda test: F.exists(pages, test)
    candles = lambda p: as_list(p, "$.candles")
    flag = lambda c: F.coalesce(c, F.lit(False))
    version = F.try_variant_get(v, "$.schema_version", "variant")
    rules = {
        "artifact_keys": _keys_differ(F.map_keys(as_object(v)), ARTIFACT_KEYS),
        "schema_version": ~flag(
            (F.schema_of_variant(version) == "BIGINT")
            & (F.try_variant_get(v, "$.schema_version", "int") == RAW_SCHEMA_VERSION)
        ),
        "provider": ~flag(_text(v, "$.provider") == provider),
        "product": ~flag(_text(v, "$.product").isin(*products) if products else _text(v, "$.product").isNotNull()),
        "interval": ~flag(_text(v, "$.interval") == RAW_INTERVAL),
        "retrieval_keys": _keys_differ(F.map_keys(as_object(v, "$.retrieval")), RETRIEVAL_KEYS),
        "retrieval_text": ~_all_text(as_object(v, "$.retrieval")),
        "retrieval_time": ~(utc("started_at_utc") & utc("completed_at_utc")),
        "pages_not_list": pages.isNull(),
        "pages_empty": F.size(pages) == 0,
        "page_keys": some(lambda p: _keys_differ(F.map_keys(as_object(p)), PAGE_KEYS)),
        "request_keys": some(lambda p: _keys_differ(F.map_keys(as_object(p, "$.request")), REQUEST_KEYS)),
        "request_text": some(lambda p: ~_all_text(as_object(p, "$.request"))),
        "granularity": some(lambda p: ~flag(_text(p, "$.request.granularity") == RAW_GRANULARITY)),
        "request_product": some(lambda p: ~flag(_text(p, "$.request.product_id") == _text(v, "$.product"))),
        "rate_limit_headers": some(
            lambda p: ~flag(F.is_variant_null(F.try_variant_get(p, "$.rate_limit_headers", "variant")))
            & ~flag(
                (F.size(F.array_except(
                    F.map_keys(as_object(p, "$.rate_limit_headers")),
                    F.array(*[F.lit(k) for k in RATE_LIMIT_KEYS]),
                )) == 0)
                & _all_text(as_object(p, "$.rate_limit_headers"))
            )
        ),
        "candles_not_list": some(lambda p: candles(p).isNull()),
        "candle_keys": some(
            lambda p: F.exists(candles(p), lambda c: _keys_differ(F.map_keys(as_object(c)), CANDLE_KEYS))
        ),
        "candle_text": some(lambda p: F.exists(candles(p), lambda c: ~_all_text(as_object(c)))),
    }
    broken = F.filter(
        F.array(*[F.when(flag(c), F.lit(n)) for n, c in rules.items()]), lambda r: r.isNotNull()
    )
    found = F.when(v.isNull(), F.array(F.lit("not_json"))).otherwise(broken)
    return rows.select(*keys, F.explode(found).alias("rule"))


