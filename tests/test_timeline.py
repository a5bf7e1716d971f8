import pytest
from pyspark.sql import functions as F
from tapecheck.operators import timeline as t

SPLITS = [("train", "2020-01-01", "2021-01-01"), ("validation", "2021-01-01", "2022-01-01"), ("test", "2022-01-01", "2023-01-01")]


def _stamps(spark, *days):
    return spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("timestamp_ntz").alias("ts"))


def test_half_open_labels(spark):
    df = _stamps(spark, "2019-12-31", "2020-01-01", "2020-12-31 23:59:59", "2021-01-01", "2023-01-01")
    labels = [r.split for r in t.split_label(df, SPLITS).orderBy("ts").collect()]
    assert labels == [None, "train", "train", "validation", None]
    assert t.split_rows(df, SPLITS).count() == 3


def test_research_filter_reaches_the_scan(spark, tmp_path):
    _stamps(spark, "2020-05-01", "2022-05-01").write.parquet(str(tmp_path / "p"))
    out = t.research_filter(spark.read.parquet(str(tmp_path / "p")), SPLITS)
    assert out.count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan
    with pytest.raises(ValueError):
        t.research_filter(out, SPLITS[:1])


@pytest.mark.parametrize(
    "splits, words",
    [
        ([], "empty"),
        ([("a", "2020-01-02", "2020-01-02")], "not_before"),
        ([("a", "2020-01-01", "2020-01-03"), ("b", "2020-01-02", "2020-01-04")], "overlap"),
        ([("a", "2020-01-01", "2020-01-02"), ("b", "2020-01-03", "2020-01-04")], "gap"),
    ],
)
def test_bad_splits(splits, words):
    with pytest.raises(ValueError, match=words):
        t.check_splits(splits)


@pytest.mark.parametrize("burn, years", [(2019, []), (2019, [2021, 2020]), (2019, [2020, 2022]), (2018, [2020])])
def test_bad_windows(burn, years):
    with pytest.raises(ValueError):
        t.build_windows(burn, years)


def test_as_of_is_strict(spark):
    df = _stamps(spark, "2020-01-01", "2020-06-01", "2021-01-01").withColumns(
        {"k": F.lit("X"), "equity": F.year("ts") * 1.0 + F.month("ts")})
    out = {str(r.boundary)[:10]: (r.equity, r.status) for r in t.equity_before(df, ["2020-01-01", "2021-01-01", "2022-01-01"], ["k"]).collect()}
    assert out == {"2020-01-01": (None, "no_earlier_row"), "2021-01-01": (2026.0, "ok"), "2022-01-01": (2022.0, "ok")}


def test_completed_buckets(spark):
    df = _stamps(spark, "2024-01-01", "2024-01-02", "2024-01-03")
    assert t.completed_buckets(df, t.stamp("2024-01-03 00:00:00")).count() == 2
    assert t.completed_buckets(df, t.stamp("2024-01-02 23:59:59")).count() == 1
    odd = _stamps(spark, "2024-01-01 01:00:00", "2024-01-01")
    assert t.completed_buckets(odd, t.stamp("2025-01-01")).count() == 1
    assert [r.rule for r in t.bucket_violations(odd).collect()] == ["start_not_midnight"]
    now = spark.range(1).select(t.last_completed_bucket(t.stamp("2024-01-03 00:00:00")).alias("b"))
    assert str(now.first().b) == "2024-01-02 00:00:00"


def test_plan(spark):
    one = spark.createDataFrame([("X",)], "symbol string")
    rows = sorted(t.plan_windows(one, t.stamp("2015-11-02 05:00:00"), days=300).collect(), key=lambda r: r.page_no)
    assert [(str(r.first_day), str(r.last_day), r.day_count) for r in rows] == [
        ("2015-01-01", "2015-10-27", 300), ("2015-10-28", "2015-11-01", 5)]
    assert rows[0].request_start == "1420070400"
    early = t.plan_windows(one, t.stamp("2015-01-01 12:00:00")).collect()
    assert [(r.status, r.page_no, r.first_day, r.last_day) for r in early] == [("too_early", None, None, None)]
    for days in (0, 351):
        with pytest.raises(ValueError):
            t.plan_windows(one, t.stamp("2016-01-01"), days=days)


def test_gaps_start_at_the_first_bucket(spark):
    df = _stamps(spark, "2024-01-03", "2024-01-05").withColumn("symbol", F.lit("X"))
    last = spark.createDataFrame([("X", "2024-01-07")], "symbol string, d string").select("symbol", F.col("d").cast("date").alias("last_day"))
    assert [str(r.day) for r in t.calendar_gaps(df, last).orderBy("day").collect()] == ["2024-01-04", "2024-01-06", "2024-01-07"]
    r = t.history_summary(df, last).first()
    assert (r.candle_count, r.missing_day_count, r.missing_days[0]) == (2, 3, "2024-01-04")


def test_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "bars")
    _stamps(spark, "2020-01-01", "2020-06-01", "2021-01-01").write.parquet(path)
    rows = spark.read.parquet(path)
    _, windows = t.build_windows(2019, [2020])
    for df in (
        t.split_rows(rows, [("a", "2020-01-01", "2020-07-01")]),
        t.window_rows(rows, windows),
        t.completed_buckets(rows, t.stamp("2020-07-01 12:00:00")),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "LessThan" in plan.split("PushedFilters")[1].split("]")[0]
