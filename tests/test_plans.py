"""The plans are the ones meant for large tables."""

import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from riskbridge.functions.durable import durable
from riskbridge.operators import merge, mom, profile, stats
from riskbridge.sources.fixtures import locations, policies


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def landed(spark):
    return durable(locations(spark, SF)), durable(policies(spark, SF))


RELATIONAL = {
    "merge": merge.merge_exposure,
    "financials": merge.merged_financials,
    "hhi": merge.hhi,
    "match": merge.match_diagnostics,
    "kpis": mom.kpis,
    "waterfall": mom.waterfall,
    "state": lambda l, p: mom.exposure_drift(l, p, "STATE"),
    "lob": lambda l, p: mom.exposure_drift(l, p, "LOBNAME"),
    "top": mom.top_accounts,
    "stress": stats.stress_tests,
    "tail": stats.tail_risk,
    "curve": stats.ep_curve,
    "profile": lambda l, p: profile.profile_locations(l),
}


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_cross_join_and_no_python(landed, name):
    text = plan(RELATIONAL[name](*landed))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"EvalPython|InPandas|PythonUDF", text)


def test_totals_do_not_build_merged_rows(landed):
    """A large account must not meet all its policies in totals: each side is added up first."""
    for df in (mom.exposure_drift(*landed, "STATE"), merge.merged_financials(*landed), stats.stress_tests(*landed)):
        joins = [line for line in plan(df, "simple").splitlines() if "Join" in line]
        assert joins
        optimized = df._jdf.queryExecution().optimizedPlan().toString()
        for block in re.split(r"(?=Join Inner)", optimized)[1:]:
            assert block.count("Aggregate") >= 2


def test_scan_reads_what_is_needed(spark, landed):
    text = plan(mom.exposure_drift(*landed, "STATE"))
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", text)
    assert schemas and all(len(s.split(",")) <= 6 for s in schemas)
    text = plan(profile.geocode_quality(landed[0].filter("PERIOD = 'curr'")))
    assert "PushedFilters: [IsNotNull(PERIOD), EqualTo(PERIOD,curr)]" in text


def test_whole_tables_are_read(spark):
    """Each order is a policy and each line item a location, of one period."""
    for table, rows in (("orders", policies(spark, SF)), ("lineitem", locations(spark, SF))):
        assert rows.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert {r.PERIOD for r in policies(spark, SF).select("PERIOD").distinct().collect()} == {"prior", "curr"}


def test_windows_run_on_bucket_totals_only(landed):
    """Running sums go by bucket; the only windows without one add up the bucket totals."""
    for df in (stats.ep_curve(*landed), profile.profile_locations(landed[0])):
        for window in re.findall(r"Window \[.*", plan(df, "simple")):
            assert "_b" in window or "_all" in window
    assert "Window" not in plan(merge.merge_exposure(*landed), "simple")


def test_sample_sorts_few_rows(spark):
    from riskbridge.functions.order import sample_n

    text = plan(sample_n(spark.range(1000), 10, ["id"]))
    assert "TakeOrderedAndProject" in text and text.count("Filter") >= 1


def test_grid_join_has_no_collect(spark, landed, hot):
    text = plan(merge.merge_exposure(*landed))
    assert "CartesianProduct" not in text and "_lt" in text
    assert merge.merge_exposure(*landed).agg(F.count("*")).first()[0] > 0
