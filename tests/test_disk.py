"""Disk that intermediate rows take."""

from pathlib import Path

import pytest
from conftest import SF, rows_of
from pyspark.sql import functions as F

from riskbridge import schema as S
from riskbridge.functions import durable as durable_module
from riskbridge.functions.durable import durable
from riskbridge.functions.skew import hot_pairs
from riskbridge.plans import queries as q


@pytest.fixture
def shared(spark, tmp_path, monkeypatch):
    """A shared folder, as a cluster has."""
    monkeypatch.setattr(durable_module, "shared_dir", lambda spark: str(tmp_path / "kept"))
    return tmp_path / "kept"


def test_written_rows_leave_no_shuffle_files(spark, shared):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}

    before = shuffled()
    kept = durable(spark.range(1000).repartition(3, "id"))
    assert not shuffled() - before and kept.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_extracts_are_written_compressed(spark, shared):
    got = q.queries()["csv_roundtrip_policies"](spark, SF)
    written = [f for f in Path(shared).rglob("part-*") if not f.name.startswith(".")]
    assert written and all(f.name.endswith(".csv.gz") for f in written)
    assert got.groupBy("PERIOD", "SEGMENT").count().count() == 4 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_a_segment_without_rows(spark, shared, frame):
    rows = frame("ACCNTNUM POLICYNUM BLANPREAMT", [("A", "1", 2), ("B", "2", 0)], segment=S.STANDARD)
    for kept in (rows, rows.filter("ACCNTNUM = ''")):
        again = q._csv_roundtrip(lambda spark, sf: kept, S.POLICY_COLUMNS)(spark, "")
        assert again.columns == kept.columns and rows_of(again) == rows_of(kept)
    assert rows_of(again) == [] and rows_of(rows.select(F.col("SEGMENT"))) == [(S.STANDARD,)] * 2


def test_locations_are_not_shuffled_again(spark, shared):
    """Locations are landed by account: only policies move for the join."""
    with durable_module.settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        merged = q.queries()["merge_exposure"](spark, SF)
        plan = merged._sc._jvm.PythonSQLUtils.explainString(merged._jdf.queryExecution(), "simple")
    assert "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") == 2  # policies, and their accounts' totals


def test_an_account_of_many_locations_is_cut(spark, hot):
    """Few pairs, but more rows than a task should hold."""
    counts = spark.createDataFrame([("A", 9, 1), ("B", 1, 1)], "k string, l long, r long")
    spark.conf.set("riskbridge.hotRows", "4")
    assert [tuple(r) for r in hot_pairs(counts, ["k"], "l", "r").collect()] == [("A", 3, 1)]
    spark.conf.set("riskbridge.hotRows", "16")
    assert hot_pairs(counts, ["k"], "l", "r") is None
