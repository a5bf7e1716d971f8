"""Digests, commits that fail half-way, repeated and bad batches, lineage of any depth."""

import pytest
from pyspark.sql import functions as F
from tapecheck.constants import REGISTRY_COLUMNS
from tapecheck.operators import candles
from tapecheck.plans import workload
from tapecheck.sources import bars as bar_tables
from tapecheck.plans import workload
from tapecheck.sources import digest, lineage, publish, registry

ROWS = "k int, text string, batch_id string"


def test_digest_ignores_order_and_files_but_nothing_else(spark, tmp_path):
    rows = [(i, f"t{i % 7}" if i % 5 else None, "b") for i in range(200)]
    df = spark.createDataFrame(rows, ROWS)
    same = digest.digest_of(df)
    assert same[0] == 200
    df.orderBy(F.desc("k")).repartition(5).write.parquet(str(tmp_path / "a"))
    assert digest.digest_of(spark.read.parquet(str(tmp_path / "a")).select("batch_id", "text", "k")) == same
    others = [
        rows[:-1], [*rows, rows[0]], [*rows, rows[0], rows[0]], [*rows[:-1], rows[0]], [(0, "", "b"), *rows[1:]], [(0, "-", "b"), *rows[1:]],
        [(r[0], r[1], "c") if i == 3 else r for i, r in enumerate(rows)],
    ]
    found = {digest.digest_of(spark.createDataFrame(o, ROWS))[1] for o in others}
    assert len(found) == len(others) and same[1] not in found
    assert digest.digest_of(df.withColumnRenamed("text", "other"))[1] != same[1]
    assert digest.digest_of(df.limit(0))[0] == 0


def test_a_changed_parent_is_refused(spark, tmp_path):
    df = spark.createDataFrame([("A", "2020-01-01", 1.0), ("A", "2021-01-01", 2.0)], "symbol string, d string, v double")
    df = df.select("symbol", F.col("d").cast("timestamp_ntz").alias("ts"), "v")
    parent, other = str(tmp_path / "parent"), str(tmp_path / "other")
    df.write.parquet(parent)
    df.withColumn("v", F.when(F.col("v") == 2, 2.5).otherwise(F.col("v"))).write.parquet(other)
    _, recorded = digest.digest_of(spark.read.parquet(parent))
    with pytest.raises(bar_tables.ParentChanged):
        bar_tables.derive_research(spark, other, str(tmp_path / "t"), "2020-06-01", recorded)
    assert not (tmp_path / "t").exists()
    row = bar_tables.derive_research(spark, parent, str(tmp_path / "t"), "2020-06-01", recorded).first()
    assert (row.row_count, row.source_processed_sha256) == (1, recorded) and len(row.content_digest) == 64


def _bad(rows):
    return rows.where("text = 'bad'").select("batch_id")


def _seen(spark, root):
    return sorted((r.k, r.text, r.batch_id) for r in publish.visible(spark, root).collect())


def test_nothing_is_visible_before_the_commit(spark, tmp_path):
    root = str(tmp_path)
    one = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], ROWS)

    def crash():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        publish.append_batches(one, root, _bad, after_stage=crash)
    assert publish.manifest(spark, root).isEmpty() and _seen(spark, root) == []
    assert [(r.batch_id, r.rows, r.status) for r in publish.append_batches(one, root, _bad).collect()] == [("x", 2, "appended")]
    assert [r.status for r in publish.append_batches(one, root, _bad).collect()] == ["already_in"]
    assert _seen(spark, root) == [(1, "a", "x"), (2, "b", "x")]
    assert publish.manifest(spark, root).select("version").distinct().count() == 1
    assert publish.batch_violations(spark, root).isEmpty()


def test_bad_batches_are_refused_whole(spark, tmp_path):
    root = str(tmp_path)
    rows = [(1, "a", "x"), (2, "bad", "y"), (3, "c", "y"), (4, "d", "z"), (5, "e", None)]
    said = {r.batch_id: r.status for r in publish.append_batches(spark.createDataFrame(rows, ROWS), root, _bad).collect()}
    assert said == {"x": "appended", "y": "refused", "z": "appended", None: "refused"}
    again = [(1, "a", "x"), (2, "mended", "y"), (3, "c", "y")]
    said = {r.batch_id: r.status for r in publish.append_batches(spark.createDataFrame(again, ROWS), root, _bad).collect()}
    assert said == {"x": "already_in", "y": "appended"}
    assert [r[0] for r in _seen(spark, root)] == [1, 2, 3, 4]
    assert sorted(r.k for r in publish.visible(spark, root, version=1).collect()) == [1, 4]
    with pytest.raises(publish.Refused):
        publish.publish(spark.createDataFrame([(9, "bad")], "k int, text string"), root, "w", lambda df: df.where("text = 'bad'"))
    assert len(_seen(spark, root)) == 4


def test_the_later_writer_of_a_version_is_told(spark, tmp_path):
    root = str(tmp_path)
    one = spark.createDataFrame([(1, "a", "x")], ROWS)
    two = spark.createDataFrame([(2, "b", "y")], ROWS)

    def other_writer():
        publish.append_batches(two, root, _bad)
        found = spark.read.parquet(f"{root}/manifest")
        first = found.withColumn("token", F.lit("0" * 32)).collect()  # its token sorts first
        spark.createDataFrame(first, found.schema).write.mode("append").parquet(f"{root}/manifest")

    with pytest.raises(publish.Conflict):
        publish.append_batches(one, root, _bad, after_stage=other_writer)
    assert [r.version for r in publish.manifest(spark, root).collect()] == [1]


def test_registry_batches(spark, tmp_path):
    good = {c: "x" for c in REGISTRY_COLUMNS} | {
        "working_tree_clean": "true", "record_status": "finalized", "test_evaluated": "false",
        "dependency_versions_json": '{"python":"3","pandas":"2","pyarrow":"1","vectorbt":"0"}',
    }
    rows = [good | {"experiment_id": f"e{i}", "batch_id": f"b{i // 3}"} for i in range(9)]
    rows[4]["git_commit"] = ""
    df = spark.createDataFrame(rows).select(*REGISTRY_COLUMNS, "batch_id")
    for want in ({"b0": "appended", "b1": "refused", "b2": "appended"}, {"b0": "already_in", "b1": "refused", "b2": "already_in"}):
        assert {r.batch_id: r.status for r in registry.append_batches(df, str(tmp_path)).collect()} == want
    assert publish.visible(spark, str(tmp_path)).count() == 6


def test_bars_that_overflow_are_no_bars(spark):
    row = dict(product="A", page_no=0, pos=0, start="1577836800", low="1", high="2", open="1", close="1", volume="1",
               first_day=None, last_day=None, now=None, ts=None, reject=None)
    df = spark.createDataFrame(
        [row | {"ts": "2020-01-01"}, row | {"product": "B", "high": "1e999"}, row | {"product": "C", "low": "1e-999"}],
        "product string, page_no int, pos int, start string, low string, high string, open string, close string, volume string, "
        "first_day string, last_day string, now string, ts string, reject string",
    ).withColumn("ts", F.lit("2020-01-01").cast("timestamp_ntz"))
    assert {(r.symbol, r.rule) for r in candles.bar_violations(df).collect()} >= {("B", "infinite_value"), ("C", "non_positive_price")}
    assert [r.symbol for r in candles.sound_bars(df).collect()] == ["A"]


def test_lineage_of_any_depth(spark):
    rows = [("r0", "h", None, None)]
    rows += [(f"a{i}", f"a{i}", f"a{i - 1}" if i else "r0", f"a{i - 1}" if i else "h") for i in range(37)]
    rows += [(f"c{i}", f"c{i}", f"c{(i + 1) % 5}", f"c{(i + 1) % 5}") for i in range(5)]  # a ring
    rows += [("into", "x", "c2", "c2"), ("self", "s", "self", "s"), ("gone", "g", "nowhere", "n"), ("after", "f", "gone", "g")]
    rows += [("wrong", "w", "a3", "other"), ("later", "l", "wrong", "w")]
    got = {r.path: (r.root, r.depth, r.status) for r in lineage.lineage_closure(
        spark.createDataFrame(rows, "path string, sha256 string, parent_path string, parent_sha256 string")).collect()}
    assert len(got) == len(rows)
    assert got["r0"] == ("r0", 0, "ok") and got["a36"] == ("r0", 37, "ok") and got["a7"] == ("r0", 8, "ok")
    assert {got[p] for p in ("c0", "c1", "c2", "c3", "c4", "into", "self")} == {(None, None, "cycle")}
    assert got["gone"] == (None, 1, "parent_missing") and got["after"] == (None, 2, "parent_missing")
    assert got["wrong"] == ("r0", 5, "hash_differs") and got["later"] == ("r0", 6, "hash_differs")


def test_rings_do_not_make_lineage_go_on(spark, monkeypatch):
    """Rounds follow the longest chain that ends, not the size of a table that holds a ring; ended chains do not move again."""
    moved = []
    keep = lineage.materialize
    monkeypatch.setattr(lineage, "materialize", lambda df: moved.append(keep(df)) or moved[-1])
    rows = [(f"c{i}-{j}", "s", f"c{i}-{j - 1}" if j else None, "s") for i in range(300) for j in range(10)]
    rows += [("x", "s", "y", "s"), ("y", "s", "x", "s")]
    schema = "path string, sha256 string, parent_path string, parent_sha256 string"
    got = lineage.lineage_closure(spark.createDataFrame(rows, schema))
    assert got.where("status = 'cycle'").count() == 2 and got.where("depth = 9 and root like '%-0'").count() == 300
    assert [df.count() for df in moved] == [3002, 2702, 2402, 1802, 602, 2]


def test_records_without_a_number_refuse_their_batch(spark, tmp_path):
    """A broken record is traced by its batch, not by its own number, which may be missing or used in another batch."""
    good = {c: "x" for c in REGISTRY_COLUMNS} | {
        "working_tree_clean": "true", "record_status": "finalized", "test_evaluated": "false",
        "dependency_versions_json": '{"python":"3","pandas":"2","pyarrow":"1","vectorbt":"0"}',
    }
    rows = [good | {"batch_id": f"b{i}", "experiment_id": e} for i, e in enumerate(("e", "e", None, "f"))]
    rows[1]["git_commit"] = rows[2]["git_commit"] = ""
    df = spark.createDataFrame(rows).select(*REGISTRY_COLUMNS, "batch_id")
    said = {r.batch_id: r.status for r in registry.append_batches(df, str(tmp_path)).collect()}
    assert said == {"b0": "appended", "b1": "refused", "b2": "refused", "b3": "appended"}


def test_batched_records_are_read_off_the_orders(spark):
    """No join of wide records with the table they were made of."""
    plan = workload.batched_records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
