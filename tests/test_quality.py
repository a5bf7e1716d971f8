import pytest
from pyspark.sql import functions as F
from tapecheck.constants import REGISTRY_COLUMNS, REGISTRY_OLD_COLUMNS
from tapecheck.operators import quality
from tapecheck.sources.digest import digest_of
from tapecheck.sources import bars as bar_tables
from tapecheck.sources import catalog, registry

NAN, INF = float("nan"), float("inf")
OK = {"open": 10.0, "high": 11.0, "low": 9.0, "close": 10.0, "volume": 1.0}
BAR_SCHEMA = "symbol string, day string, seq long, open double, high double, low double, close double, volume double"


def _bars(spark, *rows):
    data = [("X", d, i, *({**OK, **c}[k] for k in OK)) for i, (d, c) in enumerate(rows)]
    return spark.createDataFrame(data, BAR_SCHEMA).withColumn("ts", F.col("day").cast("timestamp_ntz"))


@pytest.mark.parametrize(
    "rows, rules",
    [
        ([("2024-01-01", {})], set()),
        ([("2024-01-01", {"open": None})], {"missing_value"}),
        ([("2024-01-01", {"high": NAN})], {"missing_value"}),
        ([("2024-01-01", {"close": NAN})], {"missing_value"}),
        ([("2024-01-01", {"high": INF})], {"infinite_value"}),
        ([("2024-01-01", {"volume": -INF})], {"infinite_value", "negative_volume"}),
        ([("2024-01-01", {}), ("2024-01-01", {})], {"duplicate_ts"}),
        ([("2024-01-02", {}), ("2024-01-01", {})], {"not_ascending"}),
        ([("2024-01-01", {"low": 0.0})], {"non_positive_price"}),
        ([("2024-01-01", {"volume": -1.0})], {"negative_volume"}),
        ([("2024-01-01", {"high": 9.5})], {"high_below_bar"}),
        ([("2024-01-01", {"low": 10.5})], {"low_above_bar"}),
        ([("2024-01-01", {"low": 12.0})], {"low_above_bar", "high_below_bar"}),
    ],
)
def test_bar_rules(spark, rows, rules):
    assert {r.rule for r in quality.ohlcv_violations(_bars(spark, *rows), arrival="seq").collect()} == rules


def test_order_is_checked_across_slices(spark, monkeypatch):
    monkeypatch.setattr(quality, "ARRIVAL_SLICE", 2)
    good = _bars(spark, *[(f"2024-01-{d:02d}", {}) for d in range(1, 10)])
    assert quality.ohlcv_violations(good, arrival="seq").count() == 0
    bad = _bars(spark, *[(f"2024-01-{d:02d}", {}) for d in (3, 4, 1, 2)])
    assert [r.rule for r in quality.ohlcv_violations(bad, arrival="seq").collect()] == ["not_ascending"]


def test_expected_symbols_and_types(spark):
    bars = _bars(spark, ("2024-01-01", {}))
    want = spark.createDataFrame([("X",), ("Y",)], "symbol string")
    assert [(r.symbol, r.rule) for r in quality.ohlcv_violations(bars, expected=want).collect()] == [("Y", "empty")]
    for bad in (F.lit(True), F.lit("1")):
        with pytest.raises(ValueError, match="open"):
            quality.ohlcv_violations(bars.withColumn("open", bad))
    with pytest.raises(ValueError, match="missing"):
        quality.ohlcv_violations(bars.drop("low"))
    with pytest.raises(quality.ViolationError):
        quality.require_empty(bars, "x")


def test_corporate_actions(spark):
    rows = [("A", "2012-01-01", 0.0, 0.5), ("A", "2013-01-01", 0.0, 0.1), ("A", "2023-01-01", 2.0, 0.9),
            ("B", "2012-01-01", 2.0, 0.0), ("C", "2012-01-01", None, 0.0)]
    df = spark.createDataFrame(rows, "symbol string, d string, stock_splits double, dividends double")
    out = {r.symbol: r for r in quality.corporate_actions(df.withColumn("ts", F.col("d").cast("timestamp_ntz"))).collect()}
    assert [out[s].status for s in "ABC"] == ["ok", "unsupported_split", "unsupported_split"]
    assert (out["A"].dividend_events, out["A"].last_dividend.year) == (2, 2013)
    with pytest.raises(ValueError):
        quality.corporate_actions(df.drop("stock_splits"))


def test_gap_metadata(spark):
    base = dict(symbol="X", provider="p", missing_days=["2024-01-02"], missing_day_count=1, volume_unit=None,
                volume_unit_status="u", volume_unit_inference="i", volume_unit_evidence="e")
    schema = ("symbol string, provider string, missing_days array<string>, missing_day_count int, volume_unit string, "
              "volume_unit_status string, volume_unit_inference string, volume_unit_evidence string")
    cases = [
        ({}, set()), ({"provider": None}, {"field_without_provider"}), ({"volume_unit_status": None}, {"required_field_missing"}),
        ({"missing_day_count": -1}, {"negative_count", "count_mismatch"}), ({"missing_days": ["2024-1-2"]}, {"bad_date"}),
        ({"missing_days": ["2024-02-30"]}, {"bad_date"}), ({"missing_days": ["2024-01-02"] * 2, "missing_day_count": 2}, {"duplicate_date"}),
        ({"missing_days": ["2024-01-03", "2024-01-02"], "missing_day_count": 2}, {"not_ascending"}),
        ({"missing_day_count": 2}, {"count_mismatch"}), ({"volume_unit": ""}, {"blank_unit_text"}),
        ({"volume_unit_evidence": ""}, {"blank_unit_text"}), ({"missing_days": [], "missing_day_count": 0}, set()),
    ]
    rows = [tuple({**base, **c, "symbol": str(i)}.values()) for i, (c, _) in enumerate(cases)]
    found = {}
    for r in quality.gap_metadata_violations(spark.createDataFrame(rows, schema)).collect():
        found.setdefault(int(r.symbol), set()).add(r.rule)
    assert [found.get(i, set()) for i in range(len(cases))] == [w for _, w in cases]


FINAL = {c: c for c in REGISTRY_COLUMNS} | {
    "record_status": "finalized", "working_tree_clean": "true", "params_json": '{"a": "x, \\"y\\""}', "notes": "line\nbreak, and \"quotes\"",
    "dependency_versions_json": '{"python":"3","pandas":"2","pyarrow":"1","vectorbt":"0"}'}


def _records(spark, *changes):
    rows = [tuple({**FINAL, **c}[k] for k in REGISTRY_COLUMNS) for c in changes]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in REGISTRY_COLUMNS))


@pytest.mark.parametrize(
    "change, rules",
    [
        ({}, set()), ({"record_status": "dev", "git_commit": ""}, set()), ({"record_status": "old"}, {"unknown_status"}),
        ({"config_sha256": ""}, {"missing_config_sha256"}), ({"working_tree_clean": ""}, {"working_tree_not_clean"}),
        ({"dependency_versions_json": "nope"}, {"versions_not_json"}), ({"dependency_versions_json": "[1]"}, {"versions_not_object"}),
        ({"dependency_versions_json": '{"python":"3"}'}, {"versions_key_missing"}),
    ],
)
def test_registry_contract(spark, change, rules):
    assert {r.rule for r in quality.registry_violations(_records(spark, change)).collect()} == rules


def test_registry_round_trip_and_migration(spark, tmp_path):
    path = str(tmp_path / "registry")
    registry.append_records(_records(spark, {}), path)
    registry.append_records(_records(spark, {"experiment_id": "two"}), path)
    rows = registry.registry_scan(spark, path).orderBy("experiment_id").collect()
    assert [r.asDict() for r in rows] == [FINAL, {**FINAL, "experiment_id": "two"}]
    with pytest.raises(quality.ViolationError):
        registry.append_records(_records(spark, {"git_commit": ""}), path)
    old = spark.createDataFrame([tuple(REGISTRY_OLD_COLUMNS)], ", ".join(f"{c} string" for c in REGISTRY_OLD_COLUMNS))
    new = registry.registry_migrate(old).first()
    assert (new.params_json, new.record_status, new.git_commit, new.config_sha256) == ("params", "dev", "git_commit", "")
    with pytest.raises(ValueError):
        registry.registry_migrate(old.drop("notes"))


def test_publish_and_truncate(spark, tmp_path):
    rows = [(f"2024-01-{d:02d}", {}) for d in range(1, 5)] + [("2025-01-01", {"close": -999999.0}), ("2025-01-02", {"close": -999999.0})]
    bars = _bars(spark, *rows).drop("day", "seq")
    root = str(tmp_path / "processed")
    bar_tables.write_bars(bars, root, "acme")
    back = bar_tables.scan_bars(spark, root)
    assert back.count() == 6 and set(back.columns) == set(bars.columns)
    with pytest.raises(Exception, match="(?i)exists"):
        bar_tables.write_bars(bars, root, "acme")
    _, recorded = digest_of(spark.read.parquet(root))  # a parent that is not the recorded one is refused, see test_publishing
    lineage = bar_tables.derive_research(spark, root, str(tmp_path / "research"), "2025-01-01", recorded).first()
    assert (lineage.row_count, lineage.last_timestamp, lineage.source_processed_sha256) == (4, "2024-01-04T00:00:00", recorded)
    published = spark.read.parquet(str(tmp_path / "research"))
    assert published.where("close < 0").count() == 0
    assert bar_tables.cutoff_violations(published, "2025-01-01").count() == 0
    assert [r.rule for r in bar_tables.cutoff_violations(back, "2025-01-01").collect()] == ["row_after_cutoff"]
    assert [r.rule for r in bar_tables.cutoff_violations(back.limit(0), "2025-01-01").collect()] == ["no_rows"]
    plan = bar_tables.research_rows(spark, root, "2025-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(ts,2025-01-01" in plan
    with pytest.raises(ValueError):
        bar_tables.before_cutoff(bars.withColumn("ts", F.col("ts").cast("timestamp")), "2025-01-01")


def test_catalog(spark, tmp_path):
    import hashlib

    for name, body in (("a.parquet", b"one"), ("b.parquet", b"two"), ("c.parquet", b"three")):
        (tmp_path / name).write_bytes(body)
    files = catalog.hash_files(spark, str(tmp_path))
    sha = {r.path.rsplit("/", 1)[1]: r.sha256 for r in files.collect()}
    assert sha["a.parquet"] == hashlib.sha256(b"one").hexdigest()
    paths = {r.path.rsplit("/", 1)[1]: r.path for r in files.collect()}
    known = spark.createDataFrame([(paths["a.parquet"], sha["a.parquet"]), (paths["b.parquet"], "bad"), ("gone", "x")], "path string, sha256 string")
    assert {r.path.rsplit("/", 1)[-1]: r.status for r in catalog.artifact_audit(files, known).collect()} == {
        "a.parquet": "ok", "b.parquet": "hash_mismatch", "c.parquet": "not_in_catalog", "gone": "file_missing"}
    rows = [("X", "1d", "z", "2024-01-01T00:00:00"), ("X", "1d", "a", "2023-01-01T00:00:00"), ("X", "1d", "m", "2024-01-01T00:00:00"),
            ("Y", "1d", "q", None), ("Y", "1d", "r", "2024-01-01T00:00:00"), ("Z", "1d", "s", "soon")]
    df = spark.createDataFrame(rows, "symbol string, interval string, path string, created_at_utc string").withColumn("kind", F.lit("processed"))
    out = {r.symbol: (r.path, r.status) for r in catalog.latest_artifact(df).collect()}
    assert out == {"X": ("m", "ok"), "Y": (None, "invalid_metadata"), "Z": (None, "invalid_metadata")}
    good = "processed/acme/X/1d/1.canonical.parquet"
    ident = spark.createDataFrame(
        [("processed", good, "acme", "X", "1d", good), ("processed", good, "acme", "Y", "1d", good), ("processed", good, "", "X", "1d", good),
         ("processed", "processed/X/1d/1.canonical.parquet", "acme", "X", "1d", "f"), ("processed", good, "acme", "X", "1d", "other"),
         ("processed", "processed/acme/X/1d/1.parquet", "acme", "X", "1d", "f")],
        "kind string, path string, provider string, symbol string, interval string, file string")
    assert sorted(r.rule for r in catalog.identity_violations(ident).collect()) == sorted([
        "identity_differs_from_path", "identity_incomplete", "not_a_processed_location", "file_differs_from_path", "not_a_canonical_file"])
    assert [r.path for r in catalog.new_artifacts(df.where("symbol = 'X'"), df).orderBy("path").collect()] == ["q", "r", "s"]


def test_creation_times_are_instants(spark):
    rows = [("a", "2024-01-01T10:00:00+02:00"), ("b", "2024-01-01T09:00:00+00:00"), ("c", "2024-01-01T08:59:59Z"), ("d", "2023-12-31T20:00:00-05:00")]
    df = spark.createDataFrame([("X", "1d", p, t, "processed") for p, t in rows], "symbol string, interval string, path string, created_at_utc string, kind string")
    r = catalog.latest_artifact(df).first()
    assert (r.path, str(r.created_at)) == ("b", "2024-01-01 09:00:00")
