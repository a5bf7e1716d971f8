"""Candle decoding, exact decimals and snapshot revision."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from tapecheck.functions.decimals import is_finite_decimal, normal_form
from tapecheck.operators import candles, revision
from tapecheck.sources import pages

GOOD = {"start": "1704067200", "low": "1.5", "high": "3", "open": "2", "close": "2.5", "volume": "10"}
FIELDS = list(GOOD)


def _raw(spark, *changes, now="2024-02-01", pos=None):
    rows = [("P", 0, i, *({**GOOD, **c}[f] for f in FIELDS)) for i, c in enumerate(changes)]
    df = spark.createDataFrame(rows, "product string, page_no int, pos int, " + ", ".join(f"{f} string" for f in FIELDS))
    return df.withColumns({
        "first_day": F.lit("2024-01-01").cast("date"), "last_day": F.lit("2024-01-20").cast("date"),
        "now": F.lit(now).cast("timestamp_ntz")})


@pytest.mark.parametrize(
    "change, reason",
    [
        ({}, None),
        ({"open": None}, "malformed:missing_or_not_text"),
        ({"start": ""}, "malformed:start_not_digits"),
        ({"start": "-1704067200"}, "malformed:start_not_digits"),
        ({"start": "١٧٠٤٠٦٧٢٠٠"}, "malformed:start_not_digits"),
        ({"start": "1704067200\n"}, "malformed:start_not_digits"),
        ({"start": "99999999999999999999999"}, "malformed:start_out_of_range"),
        ({"start": "1704067201"}, "malformed:start_not_midnight"),
        ({"close": "NaN"}, "malformed:close_not_finite"),
        ({"close": "-Infinity"}, "malformed:close_not_finite"),
        ({"volume": "ten"}, "malformed:volume_not_decimal"),
        ({"low": "1,5"}, "malformed:low_not_decimal"),
        ({"low": "1E+2"}, None),
        ({"low": " 1_0.5 "}, None),
        ({"start": "1706659200"}, "outside_window"),
        ({"start": "1703980800"}, "outside_window"),
    ],
)
def test_reject_reasons(spark, change, reason):
    assert candles.decode_candles(_raw(spark, change)).first().reject == reason


def test_duplicates_and_open_bucket(spark):
    out = candles.decode_candles(_raw(spark, {}, {}, {"start": "1704153600"}, now="2024-01-02 12:00:00"))
    got = {r.pos: r.reject for r in out.collect()}
    assert got == {0: None, 1: "duplicate_bucket", 2: "incomplete_bucket"}
    products = spark.createDataFrame([("P",), ("Q",)], "product string")
    assert {(r.product, r.reject) for r in candles.decode_rejects(out, products).collect()} == {
        ("P", "duplicate_bucket"), ("P", "incomplete_bucket"), ("Q", "empty_history")}
    assert candles.publishable(out, products).count() == 0


def test_bars_are_nearest_doubles(spark):
    texts = ["0.1", "123456789.123456789012345678901", "1E-7", " 2_5.50"]
    rows = [{"open": x, "start": str(1704067200 + 86400 * i)} for i, x in enumerate(texts)]
    got = [r.open for r in candles.to_bars(candles.decode_candles(_raw(spark, *rows))).orderBy("ts").collect()]
    assert got == [float(Decimal(x.strip().replace("_", ""))) for x in texts]


def test_normal_form_is_exact(spark):
    texts = ["1", "1.0", "1.000000000000000000001", "10E-1", "0.1E1", "-0", "0.00", "+.5", "5E-1", "1E+30", "1000", "1e3",
             "-2.50", "-2.5", "00012.30", "12.3", "123456789012345678901234567890123456789012", "7."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", normal_form(F.col("t")).alias("n"), is_finite_decimal(F.col("t")).alias("ok")).collect()
    assert all(r.ok for r in rows)
    for a in rows:
        for b in rows:
            assert (a.n == b.n) == (Decimal(a.t) == Decimal(b.t)), (a.t, b.t)


def test_page_profile(spark):
    def page(no, starts):
        return ("P", no, "1704067200", "1704412800", [{**GOOD, "start": s} for s in starts])

    day = lambda i: str(1704067200 + 86400 * i)
    df = spark.createDataFrame(
        [page(0, [day(2), day(1), day(0)]), page(1, [day(0), day(3)]), page(2, [day(1), day(0), "x", day(2)]), page(3, [])],
        f"product string, page_no int, request_start string, request_end string, candles array<{pages.CANDLE}>",
    )
    out = {r.page_no: r for r in candles.page_profile(df, F.lit("2024-01-04").cast("date")).collect()}
    assert [out[i].ordering for i in range(4)] == ["descending", "ascending", "mixed", "single_or_empty"]
    assert [out[i].missing_days for i in range(4)] == [1, 2, 1, 4]
    assert [(out[i].returned, out[i].parseable) for i in range(4)] == [(3, 3), (2, 2), (4, 3), (0, 0)]
    assert out[1].newest_is_run_day and not out[0].newest_is_run_day


def _snapshot(spark, days):
    rows = [("P", d, *({**GOOD, **c}[f] for f in FIELDS)) for d, c in days]
    df = spark.createDataFrame(rows, "product string, d string, " + ", ".join(f"{f} string" for f in FIELDS))
    return df.withColumn("day", F.col("d").cast("date")).drop("d")


@pytest.fixture
def reference(spark):
    return spark.createDataFrame([("P", "2026-10-20")], "product string, d string").select(
        "product", F.col("d").cast("date").alias("reference_day"))


AGES = {"2026-10-19": "1", "2026-10-18": "2-7", "2026-10-13": "2-7", "2026-10-12": "8-30", "2026-09-20": "8-30", "2026-09-19": ">30"}


def test_revision_kinds_and_counts(spark, reference):
    base = _snapshot(spark, [(d, {}) for d in AGES if d != "2026-10-13"])
    audit = _snapshot(spark, [
        ("2026-10-19", {}), ("2026-10-18", {"close": "2.50"}), ("2026-10-13", {}),
        ("2026-09-20", {"close": "2.51", "low": "1.50"}), ("2026-09-19", {}), ("2026-10-20", {})])
    diff = {(str(r.day), r.field, r.kind, r.bucket) for r in revision.revision_diff(base, audit, reference).collect()}
    assert diff == {
        ("2026-10-18", "close", "format_only", "2-7"), ("2026-10-13", None, "audit_only", "2-7"),
        ("2026-10-12", None, "baseline_only", "8-30"), ("2026-09-20", "close", "value", "8-30"),
        ("2026-09-20", "low", "format_only", "8-30")}
    counts = {r.bucket: r for r in revision.revision_counts(base, audit, reference).collect()}
    assert [counts[b].days_evaluated for b in ("1", "2-7", "8-30", ">30", "total")] == [1, 6, 23, 1, 31]
    total = counts["total"]
    assert (total.matched_days, total.identical_days, total.differing_days, total.semantic_differing_days) == (4, 2, 4, 3)
    assert (total.value_records, total.format_only_records, total.baseline_only_records, total.audit_only_records) == (1, 2, 1, 1)
    v = revision.revision_verdict(base, audit, reference).first()
    assert (v.verdict, v.raw_representation_stable, v.audit_days_after_baseline) == ("STOP", False, 1)
    assert revision.snapshot_pair_violations(base, audit, reference).count() == 0


@pytest.mark.parametrize(
    "day, change, verdict",
    [
        ("2026-10-19", {}, "PASS"), ("2026-10-19", {"open": "2.0"}, "PASS_WITH_FORMAT_DRIFT"),
        ("2026-10-19", {"open": "2.1"}, "PASS_WITH_1D_EMBARGO"), ("2026-10-18", {"open": "2.1"}, "PASS_WITH_7D_EMBARGO"),
        ("2026-10-13", {"open": "2.1"}, "PASS_WITH_7D_EMBARGO"), ("2026-10-12", {"open": "2.1"}, "STOP"),
    ],
)
def test_verdict_boundaries(spark, reference, day, change, verdict):
    base = _snapshot(spark, [(d, {}) for d in AGES])
    audit = _snapshot(spark, [(d, change if d == day else {}) for d in reversed(AGES)])
    assert revision.revision_verdict(base, audit, reference).first().verdict == verdict


def test_pair_preconditions(spark, reference):
    base = _snapshot(spark, [("2026-10-18", {}), ("2026-10-18", {})])
    audit = _snapshot(spark, [("2026-10-18", {})]).withColumn("product", F.lit("Q"))
    rules = {r.rule for r in revision.snapshot_pair_violations(base, audit, reference).collect()}
    assert rules == {"baseline_duplicate_day", "baseline_last_day", "product_mismatch"}


def _artifact(**changes):
    page = {"request": {"product_id": "ADA-EUR", "start": "1", "end": "2", "granularity": "ONE_DAY"},
            "rate_limit_headers": None, "candles": [dict(GOOD)]}
    doc = {"schema_version": 1, "provider": "coinbase", "product": "ADA-EUR", "interval": "1d",
           "retrieval": {"python_version": "3", "sdk_version": "1", "started_at_utc": "2024-01-01T00:00:00Z",
                         "completed_at_utc": "2024-01-01T00:00:01+00:00"}, "pages": [page]}
    for path, value in changes.items():
        target, *steps = doc, *path.split("__")
        for s in steps[:-1]:
            target = target[int(s) if s.isdigit() else s]
        if value is KeyError:
            del target[steps[-1]]
        else:
            target[steps[-1]] = value
    return json.dumps(doc)


DOCUMENTS = [
    (_artifact(), set()), ("{", {"not_json"}), (_artifact() + "}", {"not_json"}), (_artifact(extra=1), {"artifact_keys"}),
    (_artifact(schema_version=True), {"schema_version"}), (_artifact(schema_version=2), {"schema_version"}),
    (_artifact(provider="x"), {"provider"}), (_artifact(product="BTC-EUR"), {"product", "request_product"}),
    (_artifact(interval="1h"), {"interval"}), (_artifact(retrieval__sdk_version=1), {"retrieval_text"}),
    (_artifact(retrieval__started_at_utc="2024-01-01T00:00:00"), {"retrieval_time"}),
    (_artifact(retrieval__started_at_utc="2024-01-01T00:00:00+02:00"), {"retrieval_time"}),
    (_artifact(pages=[]), {"pages_empty"}), (_artifact(pages="x"), {"pages_not_list"}),
    (_artifact(pages__0__extra=1), {"page_keys"}), (_artifact(pages__0__request__granularity="ONE_HOUR"), {"granularity"}),
    (_artifact(pages__0__request__start=1), {"request_text"}), (_artifact(pages__0__rate_limit_headers={"x": "1"}), {"rate_limit_headers"}),
    (_artifact(pages__0__rate_limit_headers={"x-ratelimit-limit": "1"}), set()),
    (_artifact(pages__0__rate_limit_headers=[]), {"rate_limit_headers"}),
    (_artifact(pages__0__candles={}), {"candles_not_list"}), (_artifact(pages__0__candles__0__low=1.5), {"candle_text"}),
    (_artifact(pages__0__candles__0__low=KeyError), {"candle_keys"}),
]


def test_page_schema(spark):
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(DOCUMENTS)], "i int, body string")
    found = {}
    for r in pages.page_schema_violations(df, ["i"]).collect():
        found.setdefault(r.i, set()).add(r.rule)
    assert {i: found.get(i, set()) for i in range(len(DOCUMENTS))} == {i: want for i, (_, want) in enumerate(DOCUMENTS)}


def test_read_and_flatten(spark, tmp_path):
    (tmp_path / "a.json").write_text(_artifact() + "\n")
    df = pages.read_artifacts(spark, str(tmp_path))
    row = pages.flatten_pages(df).first()
    assert (row.product, row.page_no, row.pos, row.close, row.request_end) == ("ADA-EUR", 0, 0, "2.5", "2")
    assert pages.artifact_counts(df).first().candle_count == 1
    (tmp_path / "b.json").write_text('{"schema_version": "x", \n')
    with pytest.raises(Exception):
        pages.read_artifacts(spark, str(tmp_path)).collect()
    kept = pages.read_artifacts(spark, str(tmp_path), strict=False).collect()
    assert sorted(r._corrupt is not None for r in kept) == [False, True]
